"""Record linkage between two corpora: evidence, inverted-index candidates, scores, ranks.

Candidates share a rare value in some field; values that many left records hold block nothing, so no hot value is
paired (the cap is the operator's definition of "rare", as in the document-frequency limits of text search).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mailweir.functions import extract as X

FIELDS = ("tokens", "identifiers", "numbers", "emails", "urls")
# A value blocks if at most so many left records hold it; points of evidence.
CAPS = {"tokens": 40, "identifiers": 25, "numbers": 12, "emails": 40, "urls": 40}
POINTS = {"tokens": 1.0, "identifiers": 2.0, "numbers": 0.75, "emails": 5.0, "urls": 6.0}
LIMITS = {"tokens": 10.0, "identifiers": 6.0, "numbers": 5.0, "emails": 15.0, "urls": 18.0}
FULL_SCORE = 15.0


def evidence(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with one sorted array column of distinct values for each field, and the text's length."""
    return df.withColumns(
        {"tokens": X.tokens(text), "identifiers": X.identifiers(text), "numbers": X.numbers(text), "emails": X.loose_emails(text), "urls": X.url_anchors(text), "n_chars": F.length(text)}
    )


def full_text(*columns: Column) -> Column:
    """All fields of a record joined by blanks; missing ones are empty."""
    return F.trim(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in columns]))


def subject_evidence(df: DataFrame, text: Column, subject: Column | None = None) -> DataFrame:
    """``df`` with the tokens of the subject, or of the first 240 characters of the text where there is none."""
    head = F.substring(text, 1, 240)
    return df.withColumn("subject_tokens", X.tokens(head if subject is None else F.coalesce(F.nullif(subject, F.lit("")), head)))


def field_values(profiles: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(id, field, value) of every value."""
    def named(f: str) -> Column:
        return F.transform(f, lambda v: F.struct(F.lit(f).alias("field"), v.alias("value")))

    parts = F.flatten(F.array(*[named(f) for f in fields]))
    return profiles.select("id", F.explode(parts).alias("x")).select("id", "x.field", "x.value")


def document_frequency(profiles: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    return field_values(profiles, fields).groupBy("field", "value").agg(F.count(F.lit(1)).alias("df"))


def candidates(left: DataFrame, right: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """(left_id, right_id, field, value) for each shared rare value."""
    caps = caps or CAPS
    values = field_values(left)
    cap = F.lit(0)
    for f, n in caps.items():
        cap = F.when(F.col("field") == f, n).otherwise(cap)
    rare = values.groupBy("field", "value").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") <= cap)
    blocked = values.join(rare, ["field", "value"]).select("field", "value", F.col("id").alias("left_id"))
    return blocked.join(field_values(right).withColumnRenamed("id", "right_id"), ["field", "value"]).select("left_id", "right_id", "field", "value")


def scored(pairs: DataFrame) -> DataFrame:
    """(left_id, right_id, points, score, n_types): points per shared value, limited per field."""
    weight, limit = F.lit(0.0), F.lit(0.0)
    for f in FIELDS:
        weight = F.when(F.col("field") == f, POINTS[f]).otherwise(weight)
        limit = F.when(F.col("field") == f, LIMITS[f]).otherwise(limit)
    per = pairs.groupBy("left_id", "right_id", "field").agg(F.count(F.lit(1)).alias("n"))
    per = per.withColumn("p", F.least(F.col("n") * weight, limit))
    both = per.groupBy("left_id", "right_id").agg(F.sum("p").alias("points"), F.count(F.lit(1)).alias("n_types"))
    return both.select("left_id", "right_id", "points", F.least(F.lit(1.0), F.col("points") / FULL_SCORE).alias("score"), "n_types")


def overlap_scored(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id, points, score, n_types) over all shared values of the candidate pairs, rare or not.

    Points by how many left records hold a value: 5 or 3 a mailbox (to three of them 5; the first three in order count),
    6 or 4 a page, 2 an identifier (6 at most), 2.5, 1.75 or 1 a token (ten count, 10 at most), 1.5 or 0.75 a number
    (eight count, 5 at most); 1.25 a token of both subjects (4 at most) and 0.5 for texts of like length.
    """
    few = document_frequency(left).filter("df <= 3")  # all tiers end at three
    tiers = field_values(left).join(few, ["field", "value"]).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "field", "value"), "df"))).alias("few"))  # values of one record
    used = [*FIELDS, "subject_tokens", "n_chars"]
    a = left.join(tiers, "id", "left").select(F.col("id").alias("left_id"), "few", *[F.col(c).alias(f"l_{c}") for c in used])
    b = right.select(F.col("id").alias("right_id"), *[F.col(c).alias(f"r_{c}") for c in used])
    both = pairs.select("left_id", "right_id").distinct().join(a, "left_id").join(b, "right_id")
    both = both.select("left_id", "right_id", "few", "l_n_chars", "r_n_chars", *[F.array_sort(F.array_intersect(f"l_{c}", f"r_{c}")).alias(c) for c in used[:-1]])

    def total(field: str, most: int, points) -> Column:
        def of(value: Column) -> Column:
            return points(F.coalesce(F.element_at("few", F.concat(F.lit(field + ":"), value)), F.lit(4)))

        return F.aggregate(F.slice(field, 1, most), F.lit(0.0), lambda s, v: s + of(v))

    ratio = F.col("r_n_chars") / F.nullif(F.col("l_n_chars"), F.lit(0))
    points = (
        total("emails", 3, lambda n: F.when(n <= 3, 5.0).otherwise(3.0))
        + total("urls", 3, lambda n: F.when(n <= 3, 6.0).otherwise(4.0))
        + F.least(F.lit(6.0), 2.0 * F.size("identifiers"))
        + F.least(F.lit(10.0), total("tokens", 10, lambda n: F.when(n == 1, 2.5).when(n <= 3, 1.75).otherwise(1.0)))
        + F.least(F.lit(5.0), total("numbers", 8, lambda n: F.when(n == 1, 1.5).otherwise(0.75)))
        + F.least(F.lit(4.0), 1.25 * F.size("subject_tokens"))
        + F.when(ratio.between(0.55, 2.6), 0.5).otherwise(0.0)
    )
    n_types = sum(((F.size(f) > 0).cast("int") for f in FIELDS), F.lit(0))
    out = both.select("left_id", "right_id", points.alias("points"), n_types.cast("bigint").alias("n_types"))
    return out.select("left_id", "right_id", "points", F.least(F.lit(1.0), F.col("points") / FULL_SCORE).alias("score"), "n_types")


def ranked(scores: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` best left records of each right one, with the margin of the first over the second."""
    w = Window.partitionBy("right_id").orderBy(F.col("points").desc(), "left_id")
    rows = scores.withColumn("candidate_rank", F.row_number().over(w))
    rows = rows.withColumn("margin", F.when(F.col("candidate_rank") == 1, F.col("points") - F.lead("points", 1, 0.0).over(w)))
    return rows.filter(F.col("candidate_rank") <= k)


def shared_groups(links: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, cross_group) of the records of accepted links: one id for both ends, their own group for the rest."""
    gid = F.concat(F.lit("xlang_"), F.substring(F.sha2(F.concat_ws("|", "left_id", "right_id"), 256), 1, 20))
    per_left = links.groupBy(F.col("left_id").alias("id")).agg(F.min(gid).alias("g"))
    per_right = links.groupBy(F.col("right_id").alias("id")).agg(F.min(gid).alias("g"))
    known = per_left.unionByName(per_right).groupBy("id").agg(F.min("g").alias("g"))
    rows = left.select("id", "group_id").unionByName(right.select("id", "group_id"))
    return rows.join(known, "id", "left").select("id", F.coalesce("g", "group_id").alias("cross_group"))


def single_links(links: DataFrame) -> DataFrame:
    """Right ids that name exactly one left id, with it."""
    per = links.groupBy("right_id").agg(F.countDistinct("left_id").alias("n"), F.min("left_id").alias("left_id"))
    return per.filter("n = 1").select("right_id", "left_id")
