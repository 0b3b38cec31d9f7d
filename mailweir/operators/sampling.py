"""Deterministic samples: orders come from hashes, ties end in a unique id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def stable_key(seed: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def hash_sample(df: DataFrame, seed: str, parts: list[str], n: int) -> DataFrame:
    """The ``n`` rows of least hash (top-n, no full sort)."""
    return df.withColumn("_h", stable_key(seed, *[F.col(p) for p in parts])).orderBy("_h", *parts).limit(n).drop("_h")


def quota_sample(df: DataFrame, quotas: DataFrame, by: list[str], seed: str, id_col: str = "id") -> DataFrame:
    """Rows of least hash per group up to its ``quota`` (a small table); groups without a quota give none."""
    h = stable_key(seed, F.col(id_col))
    w = Window.partitionBy(*by).orderBy("_h", id_col)
    rows = df.join(F.broadcast(quotas), by).withColumn("_h", h)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n <= quota").drop("_h", "_n", "quota")


def first_per_group(df: DataFrame, group: Column, seed: str, id_col: str = "id") -> DataFrame:
    """One row per group, the least by hash; a blank group counts as the row's own."""
    g = F.when(group.isNull() | (F.trim(group) == ""), F.concat(F.lit("#"), F.col(id_col))).otherwise(group)
    h = stable_key(seed, F.col(id_col))
    w = Window.partitionBy("_g").orderBy("_h", id_col)
    return df.withColumn("_g", g).withColumn("_h", h).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_g", "_h", "_n")


def round_robin(df: DataFrame, label: str, source: str, seed: str, target: int, id_col: str = "id") -> DataFrame:
    """Up to ``target`` rows a label, taken from its sources in turn; exhausted sources are passed over."""
    h = stable_key(seed, F.col(id_col))
    per = Window.partitionBy(label, source).orderBy("_h", id_col)
    rows = df.withColumn("_h", h).withColumn("_rn", F.row_number().over(per)).filter(F.col("_rn") <= target)
    turn = Window.partitionBy(label).orderBy("_rn", source)
    return rows.withColumn("turn", F.row_number().over(turn)).filter(F.col("turn") <= target).drop("_h", "_rn")


def quartile_sample(df: DataFrame, size: str, label: str, n: int, seed: str, id_col: str = "id") -> DataFrame:
    """``n`` rows a label, spread evenly over four strata of ``size``; the remainder goes to the first strata."""
    strata = Window.partitionBy(label).orderBy(size, id_col)
    pick = Window.partitionBy(label, "stratum").orderBy("_h", id_col)
    rows = df.withColumn("stratum", F.ntile(4).over(strata)).withColumn("_h", stable_key(seed, F.col(id_col)))
    quota = F.lit(n // 4) + F.when(F.col("stratum") <= n % 4, 1).otherwise(0)
    return rows.withColumn("_n", F.row_number().over(pick)).filter(F.col("_n") <= quota).drop("_h", "_n")


def evenly_spaced(df: DataFrame, by: str, order: list[str], k: int = 5) -> DataFrame:
    """Rows at ``k`` evenly spaced places of each group's order, ends included."""
    w = Window.partitionBy(by)
    rows = df.withColumn("_r", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_c", F.count(F.lit(1)).over(w))
    places = F.array(*[F.bround(F.lit(i) * (F.col("_c") - 1) / (k - 1)).cast("long") for i in range(k)])
    return rows.filter(F.array_contains(places, F.col("_r").cast("long"))).drop("_r", "_c")
