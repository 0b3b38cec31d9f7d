"""Rules given as data: regular expressions compiled to columns, findings as arrays, capped sums, level look-up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def findings(text: Column, rules: list[dict]) -> Column:
    """array<struct(code, rule_id, n, evidence)> of the rules that hit; a rule has id, code and regex (Java syntax).

    ``evidence``: the first five distinct matches (in any case) of at most 160 characters.
    """
    t = F.coalesce(text, F.lit(""))

    def one(rule: dict) -> Column:
        hits = F.regexp_extract_all(t, F.lit(rule["regex"]), F.lit(0))
        distinct = F.aggregate(hits, F.array().cast("array<string>"), lambda a, x: F.when(F.exists(a, lambda y: F.lower(y) == F.lower(x)), a).otherwise(F.concat(a, F.array(x))))
        return F.struct(F.lit(rule["code"]).alias("code"), F.lit(rule["id"]).alias("rule_id"), F.size(hits).alias("n"), F.transform(F.slice(distinct, 1, 5), lambda x: F.substring(x, 1, 160)).alias("evidence"))

    return F.filter(F.array(*[one(r) for r in rules]), lambda x: x.n > 0)


def hit_codes(text: Column, rules: list[dict]) -> Column:
    """Sorted distinct codes of the rules that hit."""
    return F.array_sort(F.array_distinct(F.transform(findings(text, rules), lambda x: x.code)))


def capped_sum(codes: Column, weights: dict[str, float], cap: float) -> Column:
    """Sum of the weights of distinct codes, not above ``cap``; an unknown code weighs nothing."""
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return F.least(F.lit(float(cap)), F.aggregate(F.array_distinct(codes), F.lit(0.0), lambda a, c: a + F.coalesce(table[c], F.lit(0.0))))


def with_level(df: DataFrame, score: str, levels: list[tuple[str, float, float]]) -> DataFrame:
    """``df`` with the name of the level whose closed range holds the score; ranges must touch without gaps."""
    for (_, _, high), (_, low, _) in zip(levels, levels[1:]):
        if low - high != 1:
            raise ValueError("levels must be contiguous")
    case = reduce(lambda acc, lv: acc.when((F.col(score) >= lv[1]) & (F.col(score) <= lv[2]), lv[0]), levels, F.when(F.lit(False), ""))
    return df.withColumn("level", case)


def uppercase_share(text: Column) -> Column:
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.when(letters > 0, F.length(F.regexp_replace(text, r"[^\p{Lu}]", "")) / letters).otherwise(0.0)
