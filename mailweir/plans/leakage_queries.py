"""Queries on leakage between splits and on sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailweir.operators import leakage as L
from mailweir.operators import sampling as S
from mailweir.plans.registry import Registry
from mailweir.sources.tables import table

query = Registry()
SPLIT = "case when lower(trim(split)) in ('train','validation','test') then lower(trim(split)) end"


def _m(spark, d, *columns):
    m = table(spark, d, "messages", ("id", "split", *columns))
    return m.withColumn("split", L.split_name(F.col("split")))


@query(
    "keys_across_splits",
    f"""with m as (select {SPLIT} as split, group_id, lower(content_hash) as content_hash from messages), k as (select distinct 'group_id' as key_name, group_id as v, split from m union select distinct 'content_hash', content_hash, split from m),
    n as (select * from k where v is not null and v <> '' and split is not null)
    select a.key_name, a.split as left_split, b.split as right_split, count(*) as n_keys from n a join n b on a.key_name = b.key_name and a.v = b.v and a.split < b.split group by all""",
)
def keys_across_splits(spark, d):
    return L.crossing_keys(_m(spark, d, "group_id", "content_hash"), {"group_id": F.col("group_id"), "content_hash": F.lower("content_hash")})


_PAIRS = [("id", "id"), ("id", "parent_id"), ("parent_id", "id"), ("parent_id", "parent_id"), ("content_hash", "content_hash"), ("group_id", "group_id")]


@query(
    "contamination",
    f"""with m as (select id, parent_id, content_hash, group_id, {SPLIT} as split from messages), s as (select * from m where split = 'test'), t as (select * from m where split = 'train') """
    + " union all ".join(
        f"select '{a}' as seed_column, '{b}' as training_column, count(*) as n_rows from s where {a} is not null and {a} <> '' and {a} in (select {b} from t where {b} is not null)" for a, b in _PAIRS
    ),
)
def contamination(spark, d):
    m = _m(spark, d, "parent_id", "content_hash", "group_id")
    return L.contamination(m.filter("split = 'test'"), m.filter("split = 'train'"), _PAIRS)


@query(
    "parent_checks",
    f"""with m as (select id, parent_id, {SPLIT} as split from messages) select c.id, c.parent_id, case when c.parent_id = c.id then 'own_parent' when p.id is null then 'missing_parent' else 'split_apart' end as problem
    from m c left join m p on c.parent_id = p.id where c.parent_id is not null and c.parent_id <> '' and (c.parent_id = c.id or p.id is null or c.split is distinct from p.split)""",
)
def parent_checks(spark, d):
    return L.parent_checks(_m(spark, d, "parent_id"))


@query(
    "known_by_any",
    f"""with m as (select id, content_hash, group_id, {SPLIT} as split from messages), t as (select * from m where split = 'train')
    select id, case when h and g then 'content_hash,group_id' when h then 'content_hash' when g then 'group_id' else '' end as known_by from (select id,
    content_hash <> '' and coalesce(content_hash in (select content_hash from t where content_hash is not null and content_hash <> ''), false) as h,
    group_id <> '' and coalesce(group_id in (select group_id from t where group_id is not null and group_id <> ''), false) as g from m where split = 'validation')""",
)
def known_by_any(spark, d):
    m = _m(spark, d, "content_hash", "group_id")
    out = L.known_by_any(m.filter("split = 'validation'"), m.filter("split = 'train'"), ["content_hash", "group_id"])
    return out.select("id", F.array_join("known_by", ",").alias("known_by"))


@query(
    "source_overlap",
    """with p as (select distinct source, lower(content_hash) as k from messages where content_hash is not null and source is not null), n as (select source, count(*) as n from p group by 1),
    s as (select a.source as left_name, b.source as right_name, count(*) as n_shared from p a join p b on a.k = b.k and a.source < b.source group by all)
    select left_name, right_name, l.n as left_keys, r.n as right_keys, n_shared, round(n_shared / least(l.n, r.n), 6) as ratio,
    case when round(n_shared / least(l.n, r.n), 6) >= 0.8 then 'near_copy' when round(n_shared / least(l.n, r.n), 6) >= 0.2 then 'substantial' when round(n_shared / least(l.n, r.n), 6) > 0 then 'partial' else 'none' end as verdict
    from s join n l on l.source = left_name join n r on r.source = right_name""",
)
def source_overlap(spark, d):
    m = table(spark, d, "messages", ("source", "content_hash")).withColumn("content_hash", F.lower("content_hash"))
    return L.shared_key_pairs(m, "source", "content_hash")


@query("untranslated_parents", "select id from messages m where language = 'en' and not exists (select 1 from messages c where c.parent_id = m.id and c.source = 'controlled_translation')")
def untranslated_parents(spark, d):
    m = table(spark, d, "messages", ("id", "language", "source", "parent_id"))
    done = m.filter("source = 'controlled_translation' and parent_id is not null").select(F.col("parent_id").alias("id"))
    return m.filter("language = 'en'").join(done, "id", "left_anti").select("id")


@query("children_of_english", "select id from messages m where exists (select 1 from messages p where p.id = m.parent_id and p.language = 'en')")
def children_of_english(spark, d):
    m = table(spark, d, "messages", ("id", "language", "parent_id"))
    english = m.filter("language = 'en'").select(F.col("id").alias("parent_id"))
    return m.join(english, "parent_id", "left_semi").select("id")


_SHA = "sha256(concat_ws('|', '{seed}', coalesce(cast({c} as varchar),'')))"


@query("hash_sample", "select id, source from messages order by sha256(concat_ws('|', 'seed-42', coalesce(source,''), coalesce(cast(original_row_id as varchar),''))), source, original_row_id limit 200")
def hash_sample(spark, d):
    """A stable sample of 200 rows: the size is the feature."""
    m = table(spark, d, "messages", ("id", "source", "original_row_id"))
    return S.hash_sample(m, "seed-42", ["source", "original_row_id"], 200).select("id", "source")


_ELIGIBLE = "(select id, lower(trim(label)) as label, source, group_id, length(coalesce(body,'')) as size from messages where training_eligible and lower(trim(label)) in ('normal','spam','phishing'))"


def _eligible(spark, d):
    m = table(spark, d, "messages", ("id", "label", "source", "group_id", "body", "training_eligible"))
    m = m.filter("training_eligible and lower(trim(label)) in ('normal','spam','phishing')")
    return m.select("id", F.lower(F.trim("label")).alias("label"), "source", "group_id", F.length(F.coalesce("body", F.lit(""))).alias("size"))


@query(
    "quota_sample",
    f"""with q(label, source, quota) as (values ('spam','bulk_trap',30),('spam','corp_ham',10),('phishing','phish_feed',25),('normal','list_ham',40))
    select id, label, source from (select m.*, quota, row_number() over (partition by label, source order by {_SHA.format(seed='quota', c='id')}, id) as n from {_ELIGIBLE} m join q using (label, source)) where n <= quota""",
)
def quota_sample(spark, d):
    quotas = spark.createDataFrame([("spam", "bulk_trap", 30), ("spam", "corp_ham", 10), ("phishing", "phish_feed", 25), ("normal", "list_ham", 40)], "label string, source string, quota int")
    return S.quota_sample(_eligible(spark, d), quotas, ["label", "source"], "quota").select("id", "label", "source")


@query(
    "first_per_group",
    f"""select id from (select id, row_number() over (partition by case when group_id is null or trim(group_id) = '' then '#' || id else group_id end order by {_SHA.format(seed='group', c='id')}, id) as n from {_ELIGIBLE}) where n = 1""",
)
def first_per_group(spark, d):
    return S.first_per_group(_eligible(spark, d), F.col("group_id"), "group").select("id")


@query(
    "round_robin",
    f"""with r as (select *, row_number() over (partition by label, source order by {_SHA.format(seed='turn', c='id')}, id) as rn from {_ELIGIBLE})
    select id, label, source, turn from (select *, row_number() over (partition by label order by rn, source) as turn from r) where turn <= 60""",
)
def round_robin(spark, d):
    return S.round_robin(_eligible(spark, d), "label", "source", "turn", 60).select("id", "label", "source", F.col("turn").cast("bigint").alias("turn"))


@query(
    "quartile_sample",
    f"""with s as (select *, ntile(4) over (partition by label order by size, id) as stratum from {_ELIGIBLE}) select id, label, stratum from (select *, row_number() over (partition by label, stratum order by {_SHA.format(seed='strata', c='id')}, id) as n from s)
    where n <= 7 + case when stratum <= 2 then 1 else 0 end""",
)
def quartile_sample(spark, d):
    return S.quartile_sample(_eligible(spark, d), "size", "label", 30, "strata").select("id", "label", F.col("stratum").cast("bigint").alias("stratum"))


@query(
    "evenly_spaced",
    f"""with r as (select *, row_number() over (partition by source order by size, id) - 1 as r, count(*) over (partition by source) as c from {_ELIGIBLE})
    select id, source from r where r in (0, round_even((c-1)/4.0, 0), round_even(2*(c-1)/4.0, 0), round_even(3*(c-1)/4.0, 0), c-1)""",
)
def evenly_spaced(spark, d):
    return S.evenly_spaced(_eligible(spark, d), "source", ["size", "id"]).select("id", "source")


QUERIES, SQL = query.queries, query.sql
