"""Groups of rows tied by shared values and by parents, and the groups of translations.

Components are found by alternating large-star and small-star steps over (u, v) edges: each step is a join and an
aggregate, no list of neighbours is ever built. Rows of one value are tied in two levels, so that no node has more than
about ``FAN`` edges, or as many as there are blocks, from one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailweir.functions.text import stable_id
from mailweir.session import cut

#: Rows of one value that are tied directly to the same node.
FAN = 1000


def value_edges(keyed: DataFrame) -> DataFrame:
    """Edges (u, v) that tie the ids of each key, from (k, id); keys of one id give none.

    Ids of a key are hashed into blocks of about ``FAN``; a block ties to its smallest id, and these to the smallest of
    all.
    """
    sizes = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    block = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / FAN)).cast("int")
    rows = keyed.join(sizes.filter("n > 1"), "k").withColumn("b", block)
    low = rows.groupBy("k", "b").agg(F.min("id").alias("u"))
    inside = rows.join(low, ["k", "b"]).select("u", F.col("id").alias("v"))
    first = low.groupBy("k").agg(F.min("u").alias("first"))
    across = low.join(first, "k").select(F.col("first").alias("u"), F.col("u").alias("v"))
    return inside.unionByName(across).filter("u <> v")


def star_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, root) of every node of an edge; the root is the smallest node of its component and has a row too.

    Loops, repeats and nulls tie nothing. Empty edges give an empty result.
    """
    e = edges.filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e = cut(e.distinct())
    state = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            roots = e.select(F.col("u").alias("id"), F.col("v").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("id"), "root").distinct())
        state = now
    raise RuntimeError("components did not settle")


def keyed_values(rows: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """(name, k, id): one row for each key of a row that is not blank; the name is part of the key."""
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c.alias("v")) for n, c in keys.items()]))
    long = rows.select("id", cells.alias("x")).filter("x.v is not null and trim(x.v) <> ''")
    return long.select("x.name", F.concat_ws("|", "x.name", "x.v").alias("k"), "id")


def parent_edges(rows: DataFrame, parent: str = "parent_id", missing: str = "raise") -> DataFrame:
    """Edges from parents to children. A parent that is no row is an error, or ties nothing with ``missing="drop"``."""
    wanted = rows.select(F.col(parent).alias("u"), F.col("id").alias("v")).filter(f"{parent} is not null and trim({parent}) <> ''")
    if missing == "raise":
        lost = wanted.join(rows.select(F.col("id").alias("u")), "u", "left_anti").limit(5).collect()
        if lost:
            raise ValueError("parents that do not exist: " + ", ".join(sorted(r["u"] for r in lost)))
    return wanted.join(rows.select(F.col("id").alias("u")), "u", "left_semi").filter("u <> v")


def edge_counters(rows: DataFrame, keys: dict[str, Column], parent: str = "parent_id") -> DataFrame:
    """(edge, n): rows beyond the first of each value of a key, connected already or not, and the parent edges."""
    per = keyed_values(rows, keys).groupBy("name", "k").agg((F.count(F.lit(1)) - 1).alias("n"))
    by_key = per.groupBy(F.col("name").alias("edge")).agg(F.sum("n").alias("n"))
    parents = parent_edges(rows, parent, "drop").agg(F.count(F.lit(1)).alias("n")).select(F.lit("parent").alias("edge"), "n")
    return by_key.unionByName(parents)


def final_groups(rows: DataFrame, keys: dict[str, Column], parent: str = "parent_id", missing: str = "raise") -> DataFrame:
    """(id, root, final_group_id): rows tied by equal values of any key, or as parent and child, share one group.

    The group's name is a digest of its smallest id: a digest of all ids would need a whole group in one task.
    """
    edges = value_edges(keyed_values(rows, keys).select("k", "id")).unionByName(parent_edges(rows, parent, missing))
    found = star_components(edges)
    out = rows.select("id").join(found, "id", "left").withColumn("root", F.coalesce("root", "id"))
    return out.withColumn("final_group_id", stable_id("group_", F.col("root")))


def conflicting_groups(groups: DataFrame, rows: DataFrame, label: str = "label") -> DataFrame:
    """(final_group_id, n_labels) of groups with more than one label."""
    both = groups.join(rows.select("id", label), "id")
    return both.groupBy("final_group_id").agg(F.countDistinct(label).alias("n_labels")).filter("n_labels > 1")


def translation_groups(rows: DataFrame, parent: str = "parent_id") -> DataFrame:
    """(id, translation_group_id): a child and its parent carry one name made of the parent's id; others none.

    A parent that is itself a child keeps its own children's name.
    """
    children = rows.filter(f"{parent} is not null and trim({parent}) <> '' and {parent} <> id")
    children = children.join(rows.select(F.col("id").alias(parent)), parent, "left_semi").select("id", F.col(parent).alias("_p"))
    owners = children.select(F.col("_p").alias("id")).distinct().withColumn("_o", F.col("id"))
    out = rows.select("id").join(owners, "id", "left").join(children.dropDuplicates(["id"]), "id", "left")
    return out.select("id", F.when(F.coalesce("_o", "_p").isNotNull(), stable_id("translation_", F.coalesce("_o", "_p"))).alias("translation_group_id"))
