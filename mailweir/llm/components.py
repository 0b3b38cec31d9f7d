"""Connected components by contraction (problem 2, and the grouping of problem 7).

Each round removes an independent set of vertices of degree one (rake) and of degree two (compress: the independent
set is the list-ranking step on chains, chosen by random priorities, so a chain of any length loses a constant share
per round). A removed vertex remembers one neighbour; a removed chain vertex leaves an edge between its neighbours.
Rounds follow until a round removes nothing: every vertex then has three neighbours or more, or none is left. This core is
solved by alternating large-star and small-star steps; then labels are restored to the removed vertices, last round first.
The rule is the same at every size.

All steps are joins and aggregates over (id, id) rows; no adjacency list is ever built, nothing goes to the driver
but row counts. Stars around a hot key vanish in the first round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailweir.operators.groups import star_components, value_edges
from mailweir.operators.skew import attach_by_key
from mailweir.operators.standardize import clean_key
from mailweir.session import cut

def _symmetric(edges: DataFrame) -> DataFrame:
    edges = edges.filter("u <> v").select("u", "v")
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def _contract(e: DataFrame, rounds: int) -> tuple[DataFrame, list[DataFrame], int]:
    removed: list[DataFrame] = []
    left = e.count()
    for k in range(rounds):
        if not left:
            break
        degree = e.groupBy("u").agg(F.count(F.lit(1)).alias("d"), F.min("v").alias("a"), F.max("v").alias("b"))
        small = degree.filter("d <= 2").withColumn("p", F.struct(F.xxhash64("u", F.lit(k)).alias("h"), F.col("u").alias("i")))
        pr = small.select(F.col("u").alias("w"), F.col("p").alias("q"))
        gone = cut(
            small.join(pr.select(F.col("w").alias("a"), F.col("q").alias("qa")), "a", "left")
            .join(pr.select(F.col("w").alias("b"), F.col("q").alias("qb")), "b", "left")
            .filter("(qa is null or p < qa) and (qb is null or p < qb)")
            .select("u", "a", "b", "d")
        )
        removed.append(gone.select("u", "a"))
        out = gone.select("u")
        bridge = gone.filter("d = 2")
        e = cut(
            e.join(out, "u", "left_anti")
            .join(out.withColumnRenamed("u", "v"), "v", "left_anti")
            .select("u", "v")
            .unionByName(bridge.select(F.col("a").alias("u"), F.col("b").alias("v")))
            .unionByName(bridge.select(F.col("b").alias("u"), F.col("a").alias("v")))
            .distinct()
        )
        before, left = left, e.count()
        if left == before:  # nothing was removed
            break
    return e, removed, left


def _solve_core(e: DataFrame, left: int) -> DataFrame | None:
    """(id, root) of the reduced core, by stars."""
    return star_components(e) if left else None


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(component_id, id, n) of every node of an edge; ``component_id`` is the smallest node id of the component.

    ``edges``: columns u, v of one type; loops, repeats and nulls are allowed and tie nothing. Empty edges give an
    empty result.
    """
    e = cut(_symmetric(edges.filter("u is not null and v is not null")))
    e, removed, left = _contract(e, rounds)
    labels = _solve_core(e, left)
    for k, gone in enumerate(reversed(removed)):
        if labels is None:
            labels = gone.select(F.col("u").alias("id"), F.col("a").alias("root"))
            continue
        known = labels.select(F.col("id").alias("a"), "root")
        new = gone.join(known, "a", "left").select(F.col("u").alias("id"), F.coalesce("root", "a").alias("root"))
        labels = labels.unionByName(new)
        if k % 4 == 3:
            labels = cut(labels)
    if labels is None:
        node = edges.select(F.col("u").alias("component_id"), F.col("v").alias("id"))
        return node.limit(0).withColumn("n", F.lit(0).cast("bigint"))
    labels = cut(labels)
    per = labels.groupBy("root").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("c"), F.max((F.col("id") == F.col("root")).cast("int")).alias("own"))
    # a tree that was stripped down to its root has no row for the root itself
    per = cut(per.select("root", F.least("low", "root").alias("component_id"), (F.col("c") + 1 - F.col("own")).alias("n"), "own"))
    total = labels.count()
    members = attach_by_key(labels, per.select("root", "component_id", "n"), ["root"], "n", total).select("component_id", "id", "n")
    return members.unionByName(per.filter("own = 0").select("component_id", F.col("root").alias("id"), "n"))


def message_ties(messages: DataFrame, overlap: DataFrame | None = None, hashes: bool = True) -> DataFrame:
    """Edges u, v between message ids.

    Same ``group_id``; same ``content_hash`` in any case (if ``hashes``); ``parent_id`` naming another message; the
    two ids of an overlap row that is not rejected. Keys are trimmed; words for "missing" and ids of no message tie
    nothing; a message that is its own parent is not tied by that.
    """
    m = messages.select(F.col("id"), clean_key(F.col("id")).alias("key"), "group_id", "content_hash", "parent_id")
    kinds = [F.struct(F.lit("g").alias("kind"), clean_key(F.col("group_id")).alias("k"))]
    if hashes:
        kinds.append(F.struct(F.lit("h").alias("kind"), clean_key(F.col("content_hash"), lower=True).alias("k")))
    keyed = m.select("id", F.explode(F.array(*kinds)).alias("x")).select("id", F.concat(F.col("x.kind"), F.col("x.k")).alias("k"))
    keyed = cut(keyed.filter("k is not null").select("id", F.unhex(F.md5("k")).alias("k")))
    edges = value_edges(keyed)
    refs = m.select("key", clean_key(F.col("parent_id")).alias("other")).filter("other is not null and key <> other")
    if overlap is not None:
        status = F.lower(clean_key(F.coalesce(F.col("review_status"), F.lit(""))))
        links = overlap.filter(F.coalesce(status, F.lit("")) != "rejected").select(
            clean_key(F.col("english_id")).alias("key"), clean_key(F.col("vietnamese_id")).alias("other")
        )
        refs = refs.unionByName(links.filter("key is not null and other is not null and key <> other"))
    names = m.select("key", F.col("id")).filter("key is not null")
    known = refs.distinct().join(names.withColumnRenamed("id", "u"), "key")
    known = known.join(names.select(F.col("key").alias("other"), F.col("id").alias("v")), "other")
    return edges.unionByName(known.select("u", "v"))


def message_components(messages: DataFrame, overlap: DataFrame | None = None, hashes: bool = True) -> DataFrame:
    """(component_id, id, n) of every message tied to another one."""
    return components(message_ties(messages, overlap, hashes))
