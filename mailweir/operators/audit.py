"""Profiles and reports over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def column_profile(df: DataFrame) -> DataFrame:
    """(column, dtype, n_rows, non_null, missing_share, n_distinct), all columns in one pass over (column, value)."""
    kinds = dict(df.dtypes)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in df.columns]))
    values = df.select(cells.alias("x")).groupBy("x.column", "x.v").agg(F.count(F.lit(1)).alias("n"))
    per = values.groupBy("column").agg(F.sum("n").alias("n_rows"), F.sum(F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0)).alias("non_null"), F.count("v").alias("n_distinct"))
    kind = reduce(lambda a, c: F.when(F.col("column") == c, kinds[c]).otherwise(a), df.columns, F.lit(""))
    return per.select("column", kind.alias("dtype"), "n_rows", "non_null", F.round(100 * (F.col("n_rows") - F.col("non_null")) / F.col("n_rows"), 6).alias("missing_percent"), "n_distinct")


def sample_values(df: DataFrame, column: str, k: int = 5, width: int = 120) -> DataFrame:
    """Up to ``k`` least distinct values of a column, shortened."""
    return df.filter(F.col(column).isNotNull()).select(F.substring(F.col(column).cast("string"), 1, width).alias("value")).distinct().orderBy("value").limit(k)


def table_profile(df: DataFrame, content: list[str]) -> DataFrame:
    """One row: rows, columns, missing cells, rows repeated in all columns, rows repeated in content, distinct contents."""
    whole, text = F.xxhash64(*df.columns), F.xxhash64(*content)
    missing = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in df.columns])
    rows = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("w"), F.struct(*[F.col(c) for c in content]).alias("t"), missing.alias("m"), whole.alias("hw"), text.alias("ht"))
    a = rows.groupBy("hw", F.to_json("w").alias("j")).agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("m"))
    a = a.agg(F.sum("n").alias("n_rows"), F.sum("m").alias("missing_cells"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("repeated_rows"))
    b = rows.groupBy("ht", F.to_json("t").alias("j")).agg(F.count(F.lit(1)).alias("n"))
    b = b.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("repeated_contents"), F.count(F.lit(1)).alias("distinct_contents"))
    both = a.withColumn("one", F.lit(1)).join(F.broadcast(b.withColumn("one", F.lit(1))), "one").drop("one")  # a row each
    return both.select(F.lit(len(df.columns)).alias("n_columns"), "*")


def length_stats(df: DataFrame, text: Column, by: str | None = None) -> DataFrame:
    n, w = F.length(text), F.regexp_count(text, F.lit(r"\S+"))
    g = F.coalesce(F.col(by), F.lit("(none)")) if by else F.lit("all")
    p = lambda q: F.round(F.percentile("n", q), 6)
    return df.select(g.alias("scope"), n.alias("n"), w.alias("w")).groupBy("scope").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("n").alias("shortest"), p(0.25).alias("p25"), p(0.5).alias("median"), F.round(F.avg("n"), 6).alias("mean"),
        p(0.75).alias("p75"), p(0.95).alias("p95"), F.max("n").alias("longest"), F.round(F.percentile("w", 0.5), 6).alias("median_words"), F.round(F.avg("w"), 6).alias("mean_words"),
    )


def pattern_counts(df: DataFrame, text: Column, patterns: dict[str, str]) -> DataFrame:
    """(pattern, n_rows) for named patterns, and "any" for the rows that some pattern hits."""
    hits = [F.coalesce(text.rlike(p), F.lit(False)) for p in patterns.values()]
    any_hit = reduce(lambda a, b: a | b, hits)
    one = df.agg(*[F.sum(h.cast("int")).alias(n) for n, h in zip([*patterns, "any"], [*hits, any_hit])])
    names = [*patterns, "any"]
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("pattern"), F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias("n_rows")) for n in names])).alias("x")).select("x.*")


def distribution(df: DataFrame, column: Column, blank: str = "not_declared") -> DataFrame:
    v = F.when(column.isNull() | (F.trim(column) == ""), blank).otherwise(column)
    per = df.groupBy(v.alias("value")).agg(F.count(F.lit(1)).alias("n_rows"))
    return per.withColumn("percent", F.round(100 * F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy()), 6))


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    return df.groupBy(row).pivot(column, values).count().fillna(0, values)


def split_summary(df: DataFrame, split: str, group: Column, targets: DataFrame) -> DataFrame:
    """Rows, groups, actual share and deviation in points of each split."""
    per = df.groupBy(F.col(split).alias("split")).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(group).alias("n_groups"))
    share = F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy())
    return per.withColumn("share", F.round(share, 8)).join(F.broadcast(targets), "split").withColumn("deviation_points", F.round(100 * (F.col("share") - F.col("ratio")), 6)).drop("ratio")


def phrase_hits(df: DataFrame, phrases: list[str], text: str, id_col: str = "id") -> DataFrame:
    """Least hit phrase of a short phrase list in each text, and the number of phrases that hit."""
    if len(phrases) > 1000:
        raise ValueError("too many phrases to try on every text")
    found = F.filter(F.array(*[F.lit(p) for p in sorted(phrases)]), lambda p: F.contains(F.col(text), p))
    rows = df.select(id_col, found.alias("f")).filter(F.size("f") > 0)
    return rows.select(id_col, F.element_at("f", 1).alias("first_phrase"), F.size("f").alias("n_phrases"))


def summed_distribution(df: DataFrame, by: str, column: str) -> DataFrame:
    """(value, n_rows, n_splits): the distributions of all parts added up."""
    per = df.groupBy(by, F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("value").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias(f"n_{by}s"))


def availability(df: DataFrame, by: str, status: Column, values: list[str]) -> DataFrame:
    """Rows of each group by status, the rest as ``other``, and all."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    s = F.coalesce(status, F.lit(""))
    return df.groupBy(by).agg(*[n(s == v).alias(v) for v in values], n(~s.isin(*values)).alias("other"), F.count(F.lit(1)).alias("n_rows"))


def long_crosstabs(df: DataFrame, by: str, columns: list[str], blank: str = "not_declared") -> DataFrame:
    """(by, dimension, value, n_rows): the crosstabs of several columns in one pass."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.when(F.trim(F.coalesce(c, F.lit(""))) == "", blank).otherwise(F.col(c)).alias("value")) for c in columns]))
    return df.select(by, cells.alias("x")).groupBy(by, "x.dimension", "x.value").agg(F.count(F.lit(1)).alias("n_rows"))
