"""Queries on field mapping, labels, duplicates and dispositions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailweir.functions import text as T
from mailweir.operators import standardize as S
from mailweir.plans.registry import Registry
from mailweir.sources.tables import table

query = Registry()

TEXT_KEY = "sha256(lower(trim(regexp_replace(nfc_normalize(coalesce(subject,'') || chr(10) || coalesce(body,'')), '[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+', ' ', 'g'))))"
LABEL = "lower(trim(coalesce(label,'')))"


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "messages", ("id", "original_row_id", "source", "label", "subject", "body", "raw_label", "label_status"))
    text = F.concat_ws("\n", F.coalesce("subject", F.lit("")), F.coalesce("body", F.lit("")))
    return m.select("id", "original_row_id", "source", F.lower(F.trim(F.coalesce("label", F.lit("")))).alias("label"), F.sha2(F.lower(T.normalize_text(text)), 256).alias("key"), "subject", "body", "label_status")


ARTIFACTS = ("mailbox internal data", "unsubscribe")


def _disposed(spark, d):
    """Review rows first, then labels that are none of the classes, placeholders and container phrases."""
    both = F.concat_ws(" ", F.coalesce("subject", F.lit("")), F.coalesce("body", F.lit("")))
    before = (
        F.when(F.lower(F.trim(F.coalesce("label_status", F.lit("")))) == "review", "review").when(~F.col("label").isin(*S.LABELS), "excluded")
        .when(S.is_placeholder(F.col("body")), "placeholder").when(S.has_phrase(both, ARTIFACTS), "artifact")
    )
    return S.dispositions(_keyed(spark, d), before=before)


_KEYED_SQL = f"select id, original_row_id, source, {LABEL} as label, {TEXT_KEY} as key, subject, body, label_status from messages"


@query(
    "field_mapping",
    """select cast(id_thu as varchar) as original_id, coalesce(nguoi_gui,'') as sender, coalesce(nguoi_nhan,'') as receiver, coalesce(ngay_gui,'') as date,
    coalesce(tieu_de,'') as subject, coalesce(noi_dung,'') as body, '' as raw_label from thu""",
)
def field_mapping(spark, d):
    names = {"original_id": "id_thu", "sender": "nguoi_gui", "receiver": "nguoi_nhan", "date": "ngay_gui", "subject": "tieu_de", "body": "noi_dung", "raw_label": None}
    return S.project_fields(table(spark, d, "thu"), names)


@query(
    "harmonised_union",
    """select 'messages' as input_artifact, count(*) as n_rows, count(label) as labelled, count(folder) as with_folder from (select label, cast(null as varchar) as folder from messages)
    union all select 'thu', count(*), count(label), count(folder) from (select cast(null as varchar) as label, thu_muc as folder from thu)
    union all select 'documents', count(*), count(label), count(folder) from (select label, cast(null as varchar) as folder from documents)""",
)
def harmonised_union(spark, d):
    parts = {
        "messages": table(spark, d, "messages", ("id", "label")),
        "thu": table(spark, d, "thu").select(F.col("id_thu").cast("string").alias("id"), F.col("thu_muc").alias("folder")),
        "documents": table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "label"),
    }
    all_rows = S.harmonise(parts)
    return all_rows.groupBy("input_artifact").agg(F.count(F.lit(1)).alias("n_rows"), F.count("label").alias("labelled"), F.count("folder").alias("with_folder"))


@query("repeated_external_ids", "select ma_thu_ngoai as external_id, count(*) as n_rows from thu where ma_thu_ngoai is not null group by 1 having count(*) > 1")
def repeated_external_ids(spark, d):
    rows = table(spark, d, "thu").select(F.col("ma_thu_ngoai").alias("external_id")).filter("external_id is not null")
    return S.repeated_ids(rows, "external_id")


@query(
    "placeholder_bodies",
    r"""select id, source from messages where lower(trim(regexp_replace(coalesce(body,''), '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g'))) in ('','empty','none','null','nan','n/a','na')""",
)
def placeholder_bodies(spark, d):
    return table(spark, d, "messages", ("id", "source", "body")).filter(S.is_placeholder(F.col("body"))).select("id", "source")


@query("phrase_artifacts", "select id from messages where contains(lower(coalesce(subject,'')||' '||coalesce(body,'')), 'unsubscribe') or contains(lower(coalesce(subject,'')||' '||coalesce(body,'')), 'this bulletin')")
def phrase_artifacts(spark, d):
    both = F.concat_ws(" ", F.coalesce("subject", F.lit("")), F.coalesce("body", F.lit("")))
    return table(spark, d, "messages", ("id", "subject", "body")).filter(S.has_phrase(both, ("unsubscribe", "this bulletin"))).select("id")


_RAW = r"case when raw_label is null or lower(trim(raw_label)) in ('nan','','<missing>') then '<MISSING>' else regexp_replace(trim(raw_label), '\.0$', '') end"


@query("raw_label_counts", f"select source, {_RAW} as raw_label, count(*) as n_rows from messages group by 1, 2")
def raw_label_counts(spark, d):
    m = table(spark, d, "messages", ("source", "raw_label"))
    return m.groupBy("source", S.raw_label(F.col("raw_label")).alias("raw_label")).agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "label_policy",
    f"""with p(source, raw_label, policy_status, policy_provenance) as (values ('corp_ham','0','normal','source_policy'), ('list_ham','0','normal','source_policy'), ('bulk_trap','1','review','source_policy'), ('phish_feed','1','phishing','source_policy')),
    c as (select distinct source, original_row_id from messages where lower(trim(label)) = 'spam' and label_provenance = 'human_confirmed'),
    m as (select id, source, original_row_id, {_RAW} as raw_label from messages)
    select m.id, m.raw_label, case when coalesce(policy_status,'review') = 'review' and c.source is not null then 'spam' else coalesce(policy_status,'review') end as resolved,
    case when coalesce(policy_status,'review') = 'review' and c.source is not null then 'human_confirmed' else coalesce(policy_provenance,'none') end as provenance
    from m left join p on m.source = p.source and m.raw_label = p.raw_label left join c on m.source = c.source and m.original_row_id = c.original_row_id""",
)
def label_policy(spark, d):
    m = table(spark, d, "messages", ("id", "source", "original_row_id", "raw_label", "label", "label_provenance"))
    policy = spark.createDataFrame(
        [("corp_ham", "0", "normal", "source_policy"), ("list_ham", "0", "normal", "source_policy"), ("bulk_trap", "1", "review", "source_policy"), ("phish_feed", "1", "phishing", "source_policy")],
        "source string, raw_label string, policy_status string, policy_provenance string",
    )
    curated = m.filter("lower(trim(label)) = 'spam' and label_provenance = 'human_confirmed'")
    rows = m.select("id", "source", "original_row_id", S.raw_label(F.col("raw_label")).alias("raw_label"))
    return S.resolve_labels(rows, policy, curated).select("id", "raw_label", "resolved", "provenance")


@query("trusted_provenance", "select id from messages where (label = 'spam' and label_provenance in ('human_confirmed')) or (label = 'normal' and label_provenance in ('human_confirmed','source_policy'))")
def trusted_provenance(spark, d):
    ok = S.trusted({"spam": ("human_confirmed",), "normal": ("human_confirmed", "source_policy")}, F.col("label"), F.col("label_provenance"))
    return table(spark, d, "messages", ("id", "label", "label_provenance")).filter(ok).select("id")


_DISPOSED_SQL = rf"""with k0 as ({_KEYED_SQL}), k1 as (select *, case when lower(trim(coalesce(label_status,''))) = 'review' then 'review' when label not in ('normal','spam','phishing') then 'excluded'
    when lower(trim(regexp_replace(coalesce(body,''), '[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+', ' ', 'g'))) in ('','empty','none','null','nan','n/a','na') then 'placeholder'
    when contains(lower(coalesce(subject,'') || ' ' || coalesce(body,'')), 'mailbox internal data') or contains(lower(coalesce(subject,'') || ' ' || coalesce(body,'')), 'unsubscribe') then 'artifact' end as pre from k0),
    k as (select * from k1 where pre is null), w as (select *, count(*) over (partition by key) as n_copies,
    first_value(id) over (partition by key order by original_row_id nulls first, id) as canonical_id, row_number() over (partition by key order by original_row_id nulls first, id) as r from k),
    l as (select key, count(distinct label) as labels from k group by key),
    x as (select w.id, w.source, w.label, canonical_id, n_copies, case when labels > 1 then 'label_conflict' when r > 1 then 'exact_duplicate' else 'kept' end as disposition from w join l using (key)
    union all select id, source, label, null, null, pre from k1 where pre is not null)"""


@query("std_dispositions", _DISPOSED_SQL + " select id, canonical_id, n_copies, disposition from x")
def std_dispositions(spark, d):
    return _disposed(spark, d).select("id", "canonical_id", "n_copies", "disposition")


@query(
    "std_lifecycle",
    _DISPOSED_SQL
    + """ select source, count(*) as input_rows, count(*) filter (where disposition not in ('review','excluded')) as candidate_rows, count(*) filter (where disposition = 'review') as review_rows, count(*) filter (where disposition = 'excluded') as excluded_rows,
    count(*) filter (where disposition = 'placeholder') as empty_rows, count(*) filter (where disposition = 'artifact') as artifact_rows, count(*) filter (where disposition = 'label_conflict') as conflict_rows,
    count(*) filter (where disposition = 'exact_duplicate') as duplicate_rows, count(*) filter (where disposition = 'kept') as output_rows,
    count(*) filter (where disposition = 'kept' and label = 'normal') as normal_rows, count(*) filter (where disposition = 'kept' and label = 'spam') as spam_rows,
    count(*) filter (where disposition = 'kept' and label = 'phishing') as phishing_rows from x group by source""",
)
def std_lifecycle(spark, d):
    return S.lifecycle_summary(_disposed(spark, d))


@query("label_conflicts", f"select key, count(distinct label) as n_labels, count(*) as n_rows from ({_KEYED_SQL}) group by key having count(distinct label) > 1")
def label_conflicts(spark, d):
    return _keyed(spark, d).groupBy("key").agg(F.countDistinct("label").alias("n_labels"), F.count(F.lit(1)).alias("n_rows")).filter("n_labels > 1")


@query(
    "dup_summary",
    f"""select count(*) as dup_groups, coalesce(sum(n),0)::bigint as participating_rows, coalesce(sum(n-1),0)::bigint as redundant_rows, coalesce(sum(case when labels > 1 then 1 else 0 end),0)::bigint as conflicting_groups,
    coalesce(sum(case when labels > 1 then n else 0 end),0)::bigint as conflicting_rows from (select key, count(*) as n, count(distinct label) as labels from ({_KEYED_SQL}) group by key having count(*) > 1)""",
)
def dup_summary(spark, d):
    return S.duplicate_summary(_keyed(spark, d), "key", "label")


@query("template_groups")
def template_groups(spark, d):
    m = table(spark, d, "messages", ("id", "source", "subject", "body"))
    keyed = m.select("id", "source", T.template_hash(F.col("subject"), F.col("body")).alias("template"), T.content_hash(F.col("subject"), F.col("body")).alias("content"))
    return keyed.groupBy("template").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("content").alias("n_contents"), F.min("id").alias("first_id")).filter("n_rows > 1")


@query(
    "keep_last_analysis_per_version",
    """select id_thu, phien_ban_mo_hinh, id_phan_tich from (select *, row_number() over (partition by id_thu, phien_ban_mo_hinh order by thoi_gian_phan_tich desc nulls last, id_phan_tich desc, nhan_du_doan desc nulls last) as n from phan_tich_thu) where n = 1""",
)
def keep_last_analysis_per_version(spark, d):
    a = table(spark, d, "phan_tich_thu", ("id_thu", "phien_ban_mo_hinh", "id_phan_tich", "thoi_gian_phan_tich", "nhan_du_doan"))
    last = S.keep_last(a, ["id_thu", "phien_ban_mo_hinh"], F.col("thoi_gian_phan_tich").desc_nulls_last(), F.col("id_phan_tich").desc(), F.col("nhan_du_doan").desc_nulls_last())
    return last.select("id_thu", "phien_ban_mo_hinh", "id_phan_tich")


@query(
    "text_fields",
    r"""select id, regexp_replace(trim(regexp_replace(coalesce(body,''), '[\t\n\f\r ]+', ' ', 'g')), '^$', '') as flat, len(regexp_extract_all(coalesce(body,''), '[^\t\n\f\r\v ]+')) as n_tokens,
    case when len(regexp_extract_all(coalesce(body,''), '[^\t\n\f\r\v ]+')) < 50 then 'short' when len(regexp_extract_all(coalesce(body,''), '[^\t\n\f\r\v ]+')) <= 150 then 'medium' else 'long' end as bucket,
    lower(trim(label_status)) in ('true','1','yes','y') as yes_flag, lower(trim(label_status)) in ('1','true','yes','eligible') as eligible_flag from messages""",
)
def text_fields(spark, d):
    m = table(spark, d, "messages", ("id", "body", "label_status"))
    n = T.token_count(F.col("body"))
    return m.select(
        "id", T.excerpt(F.col("body"), 10**9).alias("flat"), n.cast("bigint").alias("n_tokens"), T.length_bucket(n).alias("bucket"),
        T.flag_yes(F.col("label_status")).alias("yes_flag"), T.flag_eligible(F.col("label_status")).alias("eligible_flag"),
    )


@query("mail_fingerprints")
def mail_fingerprints(spark, d):
    t = table(spark, d, "thu")
    c = F.col
    fp = T.mail_fingerprint(c("nguoi_gui"), c("nguoi_nhan"), c("cc"), c("tieu_de"), c("noi_dung"), c("ngay_gui"))
    return t.select("id_thu", fp.alias("fingerprint"), T.stable_id("template_", T.duplicate_text(c("tieu_de"), c("noi_dung"), True)).alias("template_id"))


@query("accent_forms")
def accent_forms(spark, d):
    """Every message. No SQL: DuckDB strips other marks than these."""
    return table(spark, d, "messages", ("id", "subject")).select("id", T.strip_accents(F.col("subject")).alias("plain"))


QUERIES, SQL = query.queries, query.sql
