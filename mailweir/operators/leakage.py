"""Overlaps that must not be: keys across splits, contamination, parents apart from children, shared files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class LeakageError(ValueError):
    """A key crosses splits, or a constraint of a split set is broken."""


def split_name(col: Column) -> Column:
    s = F.lower(F.trim(col))
    return F.when(s.isin("train", "validation", "test"), s)


def crossing_keys(df: DataFrame, keys: dict[str, Column], split: str = "split") -> DataFrame:
    """(key_name, left_split, right_split, n_keys) for each pair of splits that share values of a key; one shuffle."""
    named = F.explode(F.array(*[F.struct(F.lit(k).alias("key_name"), c.alias("v")) for k, c in keys.items()]))
    rows = df.filter(F.col(split).isNotNull()).select(split, named.alias("x")).select(split, "x.key_name", "x.v").filter("v is not null and v <> ''")
    per = rows.groupBy("key_name", "v").agg(F.array_sort(F.collect_set(split)).alias("s")).filter(F.size("s") > 1)
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("left_split"), b.alias("right_split")))))
    return per.select("key_name", F.explode(pairs).alias("p")).groupBy("key_name", "p.left_split", "p.right_split").agg(F.count(F.lit(1)).alias("n_keys"))


def contamination(seed: DataFrame, training: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(seed_column, training_column, n_rows): seed rows whose value occurs in training, for each pair of columns."""
    out = []
    for a, b in pairs:
        known = training.select(F.col(b).alias(a)).filter(f"{a} is not null and {a} <> ''").distinct()
        hit = seed.filter(f"{a} is not null and {a} <> ''").join(known, a, "left_semi")
        out.append(hit.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(a).alias("seed_column"), F.lit(b).alias("training_column"), "n_rows"))
    return reduce(DataFrame.unionByName, out)


def parent_checks(df: DataFrame, split: str = "split") -> DataFrame:
    """(id, parent_id, problem) of rows whose parent is missing, is the row itself, or stands in another split."""
    children = df.filter("parent_id is not null and parent_id <> ''")
    parents = df.select(F.col("id").alias("parent_id"), F.col(split).alias("parent_split"), F.lit(1).alias("found"))
    both = children.join(parents, "parent_id", "left")
    apart = ~F.col(split).eqNullSafe(F.col("parent_split"))
    problem = F.when(F.col("parent_id") == F.col("id"), "own_parent").when(F.col("found").isNull(), "missing_parent").when(apart, "split_apart")
    return both.select("id", "parent_id", problem.alias("problem")).filter("problem is not null")


def known_by_any(rows: DataFrame, known: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with ``known_by``: the columns by which a row is known (one semi join each, no OR join)."""
    flags = []
    for c in columns:
        seen = known.select(c).filter(f"{c} is not null and {c} <> ''").distinct().withColumn(f"_{c}", F.lit(c))
        rows = rows.join(seen, c, "left")
        flags.append(F.col(f"_{c}"))
    return rows.withColumn("known_by", F.filter(F.array(*flags), lambda x: x.isNotNull())).drop(*[f"_{c}" for c in columns])


def shared_key_pairs(df: DataFrame, by: str, key: str) -> DataFrame:
    """Pairs of groups sharing keys: counts, share of the smaller one, and a verdict. Groups are few, keys many."""
    pairs = df.filter(F.col(key).isNotNull() & F.col(by).isNotNull()).select(by, key).distinct()
    sizes = pairs.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    names = pairs.groupBy(key).agg(F.array_sort(F.collect_set(by)).alias("s")).filter(F.size("s") > 1)
    two = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    shared = names.select(F.explode(two).alias("p")).groupBy(F.col("p.a").alias("left_name"), F.col("p.b").alias("right_name")).agg(F.count(F.lit(1)).alias("n_shared"))
    left, right = sizes.toDF("left_name", "left_keys"), sizes.toDF("right_name", "right_keys")
    out = shared.join(F.broadcast(left), "left_name").join(F.broadcast(right), "right_name")
    ratio = F.round(F.col("n_shared") / F.least("left_keys", "right_keys"), 6)
    verdict = F.when(ratio >= 0.8, "near_copy").when(ratio >= 0.2, "substantial").when(ratio > 0, "partial").otherwise("none")
    return out.select("left_name", "right_name", "left_keys", "right_keys", "n_shared", ratio.alias("ratio"), verdict.alias("verdict"))


def require_empty(df: DataFrame, what: str) -> None:
    """Raise if the frame has a row; the message holds at most five of them."""
    bad = df.limit(5).collect()
    if bad:
        raise LeakageError(f"{what}: " + "; ".join(str(r.asDict()) for r in bad))


def validate_splits(df: DataFrame, keys: list[str], labels: tuple[str, ...], train_only: str | None = None) -> None:
    """All checks of a split set: unique ids, keys, labels, parents, rows bound to train."""
    require_empty(df.groupBy("id").count().filter("count > 1"), "Repeated ids")
    for k in keys:
        require_empty(crossing_keys(df, {k: F.col(k)}), f"{k} crosses splits")
    require_empty(df.filter(~F.col("label").isin(*labels) | F.col("label").isNull()).select("id", "label"), "Invalid labels")
    if "training_eligible" in df.columns:
        require_empty(df.filter(~F.coalesce("training_eligible", F.lit(False))).select("id"), "Rows that are non-training-eligible")
    if "parent_id" in df.columns:
        require_empty(parent_checks(df).filter("problem = 'split_apart'"), "Parent/translation in different splits")
    if train_only:
        require_empty(df.filter((F.col(train_only) == "train_only") & (F.col("split") != "train")).select("id", "split"), "Train-only rows elsewhere")
