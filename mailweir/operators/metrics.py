"""Classification metrics by confusion counts: explicit labels, zero where a ratio has no denominator, null where a class is absent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def confusion(df: DataFrame, truth: str, predicted: str, scopes: list[str] | None = None) -> DataFrame:
    by = [*(scopes or []), truth, predicted]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def class_metrics(df: DataFrame, truth: str, predicted: str, labels: tuple[str, ...], scope: str | None = None) -> DataFrame:
    """(scope, label, support, predicted, hits, precision, recall, f1); one pass over the rows, then label-sized tables.

    An absent class has null precision, recall and f1.
    """
    s = F.col(scope) if scope else F.lit("all")
    rows = df.select(s.alias("scope"), F.col(truth).alias("t"), F.col(predicted).alias("p"))
    cm = rows.groupBy("scope", "t", "p").agg(F.count(F.lit(1)).alias("n"))
    parts = F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.when(F.col("t") == x, F.col("n")).otherwise(0).alias("s"), F.when(F.col("p") == x, F.col("n")).otherwise(0).alias("q"), F.when((F.col("t") == x) & (F.col("p") == x), F.col("n")).otherwise(0).alias("h")) for x in labels]))
    per = cm.select("scope", parts.alias("x")).groupBy("scope", "x.label").agg(F.sum("x.s").alias("support"), F.sum("x.q").alias("predicted"), F.sum("x.h").alias("hits"))
    ratio = lambda a, b: F.when(F.col("support") == 0, None).when(b == 0, 0.0).otherwise(a / b)
    per = per.withColumn("precision", ratio(F.col("hits"), F.col("predicted"))).withColumn("recall", ratio(F.col("hits"), F.col("support")))
    f1 = F.when(F.col("support") == 0, None).when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return per.withColumn("f1", f1)


def scope_metrics(per_class: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """(scope, n_rows, accuracy, macro over supported classes, weighted, macro over all if all are supported)."""
    mean = lambda c: F.avg(F.when(F.col("support") > 0, F.col(c)))
    weigh = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0.0)) * F.col("support")) / F.sum("support")
    full = F.sum((F.col("support") > 0).cast("int")) == len(labels)
    return per_class.groupBy("scope").agg(
        F.sum("support").alias("n_rows"), (F.sum("hits") / F.sum("support")).alias("accuracy"),
        mean("precision").alias("macro_precision"), mean("recall").alias("macro_recall"), mean("f1").alias("macro_f1"),
        weigh("f1").alias("weighted_f1"), F.when(full, mean("f1")).alias("full_macro_f1"),
    )


def report_rows(per_class: DataFrame, per_scope: DataFrame) -> DataFrame:
    """Flat report: a summary row a scope, a row a class."""
    a = per_scope.select("scope", F.lit("scope_summary").alias("row_type"), F.lit(None).cast("string").alias("label"), "n_rows", F.col("macro_f1").alias("f1"), F.col("accuracy"))
    b = per_class.select("scope", F.lit("class_metric").alias("row_type"), "label", F.col("support").alias("n_rows"), "f1", F.lit(None).cast("double").alias("accuracy"))
    return a.unionByName(b)


def wide_rows(per_class: DataFrame, labels: tuple[str, ...], measures: tuple[str, ...] = ("precision", "recall", "f1")) -> DataFrame:
    """One row a scope with a column ``<label>_<measure>`` for each class and measure."""
    cells = [F.max(F.when(F.col("label") == x, F.col(c))).alias(f"{x}_{c}") for x in labels for c in measures]
    return per_class.groupBy("scope").agg(*cells)


def comparison_rows(per_class: DataFrame, labels: tuple[str, ...], reference: str, harmless: str = "normal") -> DataFrame:
    """(scope, macro_f1, normal_false_positive_rate, delta_macro_f1): each scope beside the reference scope; null stays null."""
    per = scope_metrics(per_class, labels).select("scope", "macro_f1")
    rate = per_class.filter(F.col("label") == harmless).select("scope", (1 - F.col("recall")).alias("normal_false_positive_rate"))
    base = per.filter(F.col("scope") == reference).select(F.col("macro_f1").alias("_base"), F.lit(1).alias("_one"))
    out = per.join(rate, "scope", "left").withColumn("_one", F.lit(1)).join(F.broadcast(base), "_one", "left")  # one row
    return out.select("scope", "macro_f1", "normal_false_positive_rate", (F.col("macro_f1") - F.col("_base")).alias("delta_macro_f1"))


def require_labels(df: DataFrame, label: str, labels: tuple[str, ...]) -> None:
    """Raise unless the observed labels are exactly the configured ones."""
    seen = {r[0] for r in df.select(label).distinct().limit(1000).collect()}
    if seen != set(labels):
        raise ValueError(f"labels differ: missing {sorted(set(labels) - seen)}, unexpected {sorted(map(str, seen - set(labels)))}")


def rank_experiments(runs: DataFrame) -> DataFrame:
    """Runs in order of preference: macro f1 and phishing recall down, language gap and false alarms up, then id."""
    w = Window.orderBy(F.col("macro_f1").desc_nulls_last(), F.col("phishing_recall").desc_nulls_last(), F.col("language_gap").asc_nulls_last(), F.col("false_alarms").asc_nulls_last(), "run_id")
    return runs.withColumn("rank", F.row_number().over(w)).withColumn("selected", F.col("rank") == 1)


def overlapping_scopes(df: DataFrame, measures: list, sets: dict[str, list[str]]) -> DataFrame:
    """Measures over several groupings in one pass (grouping sets); ``scope`` names the grouping."""
    columns = sorted({c for cs in sets.values() for c in cs})
    out = df.groupingSets([[F.col(c) for c in cs] for cs in sets.values()], *[F.col(c) for c in columns]).agg(F.grouping_id().alias("_g"), *measures)
    scope = F.lit(None).cast("string")
    for name, cs in sets.items():
        gid = sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in cs)
        scope = F.when(F.col("_g") == gid, name).otherwise(scope)
    return out.withColumn("scope", scope).drop("_g")


def tag_counts(df: DataFrame, column: str, separator: str) -> DataFrame:
    tags = F.explode(F.split(F.coalesce(column, F.lit("")), separator)).alias("tag")
    return df.select(tags).select(F.trim("tag").alias("tag")).filter("tag <> ''").groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
