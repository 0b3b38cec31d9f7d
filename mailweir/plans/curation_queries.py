"""Queries on decisions, subsets, counters and protected spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailweir.functions import protect as P
from mailweir.operators import curation as C
from mailweir.plans.registry import Registry
from mailweir.sources.tables import table

query = Registry()
_DECISIONS = "(select id_thu, id_phan_tich as ord, case when muc_rui_ro = 'MEDIUM' then 'defer' else nhan_du_doan end as decision from phan_tich_thu where phien_ban_mo_hinh = (select min(phien_ban_mo_hinh) from phan_tich_thu))"
_LAST = f"(select id_thu, decision from (select *, row_number() over (partition by id_thu order by ord desc) as n from (select distinct * from {_DECISIONS})) where n = 1)"
_PROPOSED = "(select id_thu, case thu_muc when 'thu_rac' then 'spam' when 'cach_ly' then 'phishing' when 'hop_thu_den' then 'normal' end as label from thu)"


def _frames(spark, d):
    a = table(spark, d, "phan_tich_thu", ("id_thu", "id_phan_tich", "muc_rui_ro", "nhan_du_doan", "phien_ban_mo_hinh"))
    first = a.agg(F.min("phien_ban_mo_hinh").alias("v")).first()["v"]
    decision = F.when(F.col("muc_rui_ro") == "MEDIUM", "defer").otherwise(F.col("nhan_du_doan")).alias("decision")
    decisions = a.filter(F.col("phien_ban_mo_hinh") == first).select("id_thu", F.col("id_phan_tich").alias("ord"), decision).distinct()
    label = F.when(F.col("thu_muc") == "thu_rac", "spam").when(F.col("thu_muc") == "cach_ly", "phishing").when(F.col("thu_muc") == "hop_thu_den", "normal")
    return table(spark, d, "thu", ("id_thu", "thu_muc")).select("id_thu", label.alias("label")), decisions


@query(
    "decision_overlay",
    f"select p.id_thu, case when d.decision is null then label when d.decision = 'defer' then null else d.decision end as final_label, case when d.decision is null then case when label is null then 'open' else 'rule' end when d.decision = 'defer' then 'open' else 'human' end as decided_by from {_PROPOSED} p left join {_LAST} d using (id_thu)",
)
def decision_overlay(spark, d):
    proposals, decisions = _frames(spark, d)
    return C.overlay(proposals, decisions, ["id_thu"], F.col("ord").desc()).select("id_thu", "final_label", "decided_by")


@query("pending_decisions", f"select id_thu from {_PROPOSED} p where not exists (select 1 from {_LAST} d where d.id_thu = p.id_thu and decision <> 'defer')")
def pending_decisions(spark, d):
    proposals, decisions = _frames(spark, d)
    return C.pending(proposals, decisions, ["id_thu"], F.col("ord").desc(), revisit=True).select("id_thu")


@query("manifest_subset", "select id from messages where source in ('data_vi','native_vi_pilot') and split in ('test') and language in ('vi','vie')")
def manifest_subset(spark, d):
    m = table(spark, d, "messages", ("id", "source", "split", "language"))
    return C.subset(m, {"source": ["data_vi", "native_vi_pilot"], "split": ["test"], "language": ["vi", "vie"]}).select("id")


@query(
    "overlapping_subsets",
    "select scope, count(*) as n_rows from (select 'combined' as scope from messages union all select 'english_original' from messages where language = 'en' and coalesce(data_origin,'') = '' union all select 'translated' from messages where data_origin = 'translated' union all select 'controlled' from messages where augmentation_type = 'controlled_translation') group by 1",
)
def overlapping_subsets(spark, d):
    m = table(spark, d, "messages", ("language", "data_origin", "augmentation_type"))
    scopes = {
        "combined": F.lit(True), "english_original": (F.col("language") == "en") & (F.coalesce("data_origin", F.lit("")) == ""),
        "translated": F.col("data_origin") == "translated", "controlled": F.col("augmentation_type") == "controlled_translation",
    }
    return C.in_scopes(m, scopes).groupBy("scope").agg(F.count(F.lit(1)).alias("n_rows"))


@query("label_counts_with_zeros", "select v.label, count(m.id) as n_rows from (values ('normal'),('spam'),('phishing'),('absent')) v(label) left join messages m on m.label = v.label group by 1")
def label_counts_with_zeros(spark, d):
    return C.counts_with_zeros(table(spark, d, "messages", ("id", "label")), "label", ["normal", "spam", "phishing", "absent"])


@query("selection_counters", "select count(*) as n_rows, count(*) filter (where training_eligible) as eligible, count(*) filter (where split_constraint = 'train_only') as train_only, count(*) filter (where coalesce(trim(body),'') = '') as blank from messages")
def selection_counters(spark, d):
    m = table(spark, d, "messages", ("training_eligible", "split_constraint", "body"))
    return C.counters(m, {"eligible": F.col("training_eligible"), "train_only": F.col("split_constraint") == "train_only", "blank": F.coalesce(F.trim("body"), F.lit("")) == ""})


@query("repeated_hash_members", "select id, coalesce(content_hash <> '' and count(*) over (partition by content_hash) > 1, false) as repeated from messages")
def repeated_hash_members(spark, d):
    return C.repeated_members(table(spark, d, "messages", ("id", "content_hash")), "content_hash").select("id", "repeated")


@query(
    "inherited_labels",
    """with l as (select vietnamese_id as id, english_id as parent_id, row_number() over (partition by vietnamese_id order by overlap_id desc) as n from cross_language_overlap where lower(trim(review_status)) = 'confirmed')
    select m.id, l.parent_id, case when p.label_provenance in ('human_confirmed','source_policy') then p.label end as inherited from messages m join l on m.id = l.id and l.n = 1 join messages p on p.id = l.parent_id""",
)
def inherited_labels(spark, d):
    m = table(spark, d, "messages", ("id", "label", "label_provenance"))
    o = table(spark, d, "cross_language_overlap").filter("lower(trim(review_status)) = 'confirmed'")
    links = o.select(F.col("vietnamese_id").alias("id"), F.col("english_id").alias("parent_id"), F.col("overlap_id").alias("ord"))
    return C.inherited_label(m, links, m.withColumnRenamed("id", "parent_id"), ("human_confirmed", "source_policy"))


@query("protected_round_trip", "select id, coalesce(body,'') as restored from messages")
def protected_round_trip(spark, d):
    m = table(spark, d, "messages", ("id", "body")).select("id", P.protect_text(F.col("body")).alias("p"))
    return m.select("id", P.restore_text(F.col("p.text"), F.col("p.values")).alias("restored"))


@query("protected_kinds")
def protected_kinds(spark, d):
    m = table(spark, d, "messages", ("body",)).select(F.explode(F.map_values(P.protect_text(F.col("body"))["kinds"])).alias("kind"))
    return m.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


QUERIES, SQL = query.queries, query.sql
