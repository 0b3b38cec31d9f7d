"""Queries on groups, targets and the allocation of groups to splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailweir.functions import text as T
from mailweir.operators import allocation, groups
from mailweir.operators.standardize import clean_key, label_class
from mailweir.plans.registry import Registry
from mailweir.session import cut
from mailweir.sources.tables import table

query = Registry()
RATIOS = {"train": 0.7, "validation": 0.15, "test": 0.15}
_MISSING = "('','empty','none','null','nan','n/a','na')"
_KEYS = {"group_id": "trim(group_id)", "content_hash": "lower(trim(content_hash))"}
_CLEAN = ", ".join(f"case when lower(trim({c})) not in {_MISSING} then {e} end as {c}" for c, e in _KEYS.items())
_TIED = f"""m as (select id, {_CLEAN}, case when trim(coalesce(parent_id,'')) <> '' then parent_id end as parent_id from messages),
    k as (select id, 'g|' || group_id as k from m where group_id is not null union all select id, 'h|' || content_hash from m where content_hash is not null),
    p as (select m.parent_id as u, m.id as v from m join messages o on o.id = m.parent_id where m.parent_id <> m.id)"""


def _rows(spark, d, *columns):
    return table(spark, d, "messages", ("id", "group_id", "content_hash", "parent_id", *columns))


def _keys():
    return {"group_id": clean_key(F.col("group_id")), "content_hash": clean_key(F.col("content_hash"), lower=True)}


@query(
    "key_groups",
    f"""with recursive {_TIED}, s as (select min(id) over (partition by k) as u, id as v from k union all select u, v from p),
    e as (select u, v from s where u <> v union select v, u from s where u <> v), r(id, reach) as (select id, id from messages union select e.v, r.reach from r join e on e.u = r.id)
    select id, min(reach) as root, 'group_' || substring(sha256(min(reach)), 1, 20) as final_group_id from r group by id""",
)
def key_groups(spark, d):
    """Rows tied by group, stored digest or parent."""
    return groups.final_groups(_rows(spark, d), _keys(), missing="drop")


@query("final_groups")
def final_groups(spark, d):
    """All four keys: group, stored digest, and the digests of the text and of its template, which SQL cannot build."""
    m = _rows(spark, d, "subject", "body")
    computed = {"normalized_content_hash": T.content_hash(F.col("subject"), F.col("body")), "template_hash": T.template_hash(F.col("subject"), F.col("body"))}
    rows = cut(m.select("id", "parent_id", *[c.alias(n) for n, c in (_keys() | computed).items()]))
    return groups.final_groups(rows, {n: F.col(n) for n in (*_keys(), *computed)}, missing="drop")


@query("group_edge_counters", f"with {_TIED} select case substring(k, 1, 1) when 'g' then 'group_id' else 'content_hash' end as edge, sum(n)::bigint as n from (select k, count(*) - 1 as n from k group by 1) group by 1 union all select 'parent', count(*) from p")
def group_edge_counters(spark, d):
    return groups.edge_counters(_rows(spark, d), _keys())


@query(
    "translation_groups",
    """with c as (select m.id, m.parent_id from messages m join messages o on o.id = m.parent_id where trim(m.parent_id) <> '' and m.parent_id <> m.id), o as (select distinct parent_id from c)
    select m.id, 'translation_' || substring(sha256(coalesce(o.parent_id, c.parent_id)), 1, 20) as translation_group_id from messages m left join c using (id) left join o on o.parent_id = m.id""",
)
def translation_groups(spark, d):
    return groups.translation_groups(table(spark, d, "messages", ("id", "parent_id")))


@query(
    "group_profiles",
    "select group_id, count(*) as size, count(distinct label) as n_labels, min(label) as label, coalesce(array_to_string(list_sort(list(distinct source)), '+'), '') || '|' || coalesce(array_to_string(list_sort(list(distinct language)), '+'), '') as stratum, coalesce(max(case when split_constraint = 'train_only' then 1 when split_constraint is null then null else 0 end), 0) as forced from messages where trim(coalesce(group_id,'')) <> '' group by 1",
)
def group_profiles(spark, d):
    m = table(spark, d, "messages", ("group_id", "label", "source", "language", "split_constraint")).filter("trim(coalesce(group_id,'')) <> ''")
    return allocation.group_table(m, "group_id", "label", ["source", "language"], "split_constraint").withColumn("forced", F.coalesce("forced", F.lit(0)))


def _groups(spark, d):
    m = table(spark, d, "messages", ("id", "group_id", "label", "source", "language", "split_constraint"))
    m = m.withColumn("group_id", F.coalesce(clean_key(F.col("group_id")), "id")).withColumn("label", label_class(F.col("label")))
    return allocation.group_table(m, "group_id", "label", ["source", "language"], "split_constraint")


_GROUPED = f"""g as (select coalesce(case when lower(trim(group_id)) not in {_MISSING} then trim(group_id) end, id) as group_id, min(case when lower(trim(label)) in ('normal','spam','phishing') then lower(trim(label)) else 'other' end) as label, count(*) as size,
    max(case when split_constraint = 'train_only' then 1 else 0 end) as forced from messages group by 1)"""


@query(
    "label_targets",
    f"""with {_GROUPED}, t as (select label, sum(size) as total, sum(case when forced = 1 then size else 0 end) as bound from g group by 1),
    x as (select label, bound, split, place, total * ratio as exact from t, (values ('train', 0, 0.7), ('validation', 1, 0.15), ('test', 2, 0.15)) r(split, place, ratio)),
    y as (select *, row_number() over (partition by label order by exact - floor(exact) desc, place) as r, (sum(exact) over (partition by label) - sum(floor(exact)) over (partition by label)) as spare from x)
    select label, split, (floor(exact) + case when r <= round(spare) then 1 else 0 end)::bigint as target, (floor(exact) + case when r <= round(spare) then 1 else 0 end - case when place = 0 then bound else 0 end)::bigint as need from y""",
)
def label_targets(spark, d):
    """Target rows of each label, and those left after the rows bound to train."""
    return allocation.label_needs(_groups(spark, d), RATIOS).select("label", "split", "target", "need")


@query("group_allocation")
def group_allocation(spark, d):
    """Strata of source and language profiles."""
    return allocation.assign(_groups(spark, d), RATIOS)


@query("mixed_source_allocation")
def mixed_source_allocation(spark, d):
    """Strata by source, with one for the groups of several sources."""
    m = table(spark, d, "messages", ("id", "group_id", "label", "source"))
    m = m.withColumn("group_id", F.coalesce(clean_key(F.col("group_id")), "id")).withColumn("label", label_class(F.col("label")))
    return allocation.assign(allocation.source_strata(allocation.group_table(m, "group_id", "label", "source")), RATIOS)


@query("allocation_placements", f"with {_GROUPED} select 1::bigint as n_splits, count(*) as n_groups from g")
def allocation_placements(spark, d):
    """Groups by the number of splits they stand in: every group in one."""
    per = group_allocation(spark, d).groupBy("group_id").agg(F.countDistinct("split").alias("n_splits"))
    return per.groupBy("n_splits").agg(F.count(F.lit(1)).alias("n_groups"))


@query("mixed_label_groups", "select group_id, count(*) as size, count(distinct label) as n_labels from messages where trim(coalesce(group_id,'')) <> '' group by 1 having count(distinct label) > 1")
def mixed_label_groups(spark, d):
    m = table(spark, d, "messages", ("group_id", "label", "source")).filter("trim(coalesce(group_id,'')) <> ''")
    return allocation.mixed_label_groups(allocation.group_table(m, "group_id", "label", "source"))


QUERIES, SQL = query.queries, query.sql
