"""Text variants for robustness tests, and measures of how results change under them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from mailweir.functions.text import strip_accents

VARIANTS = ("clean", "no_accents", "characters", "spacing", "punctuation", "mixed_language")
# Substitutions of the character variant and words of the mixed-language one.
CHARACTERS = {"a": "@", "o": "0", "i": "1", "e": "3"}
WORDS = {"tài khoản": "account", "mật khẩu": "password", "xác nhận": "confirm", "đăng nhập": "login", "cuộc họp": "meeting", "báo cáo": "report"}


def _limited(pairs: dict[str, str], each: int):
    """Replace the first ``each`` occurrences of every key; Spark's own functions replace all."""

    @F.arrow_udf(StringType())
    def run(col: pa.Array) -> pa.Array:
        out = []
        for v in col.to_pylist():
            for a, b in pairs.items():
                v = v if v is None else v.replace(a, b, each)
            out.append(v)
        return pa.array(out, pa.string())

    return run


def variants(df: DataFrame, text: str = "body", id_col: str = "id") -> DataFrame:
    """Six rows a text: (variant_id, parent_id, variant, text)."""
    c = F.coalesce(F.col(text), F.lit(""))
    forms = {
        "clean": c,
        "no_accents": strip_accents(c, "both"),
        "characters": _limited(CHARACTERS, 3)(c),
        "spacing": F.regexp_replace(c, " ", "  "),
        "punctuation": F.concat(F.regexp_replace(c, r"\.", "!!"), F.lit(" ...")),
        "mixed_language": _limited(WORDS, 1)(c),
    }
    wide = df.select(F.col(id_col).alias("parent_id"), *[x.alias(n) for n, x in forms.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), F.col(n).alias("text")) for n in forms]))
    long = wide.select("parent_id", rows.alias("x")).select("parent_id", "x.variant", "x.text")
    vid = F.concat(F.lit("robust_"), F.substring(F.sha2(F.concat_ws("|", "parent_id", "variant"), 256), 1, 20))
    return long.select(vid.alias("variant_id"), "parent_id", "variant", "text")


def against_clean(results: DataFrame) -> DataFrame:
    """Each result beside the one of its clean sibling: flip, confidence drop, risk change. Columns: parent_id, variant, prediction, confidence, risk."""
    per = Window.partitionBy("parent_id")
    base = lambda c: F.max(F.when(F.col("variant") == "clean", F.col(c))).over(per)
    return results.withColumns(
        {"flipped": F.col("prediction") != base("prediction"), "confidence_drop": base("confidence") - F.col("confidence"), "risk_change": F.col("risk") - base("risk")}
    )


def variant_measures(compared: DataFrame) -> DataFrame:
    """Per variant, and over all changed variants: rows, flip rate, mean confidence, drop and risk change."""
    scopes = F.when(F.col("variant") == "clean", F.array("variant")).otherwise(F.array("variant", F.lit("all_transformed")))
    rows = compared.withColumn("scope", F.explode(scopes))
    return rows.groupBy("scope").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(F.col("flipped").cast("double")).alias("flip_rate"), F.avg("confidence").alias("mean_confidence"),
        F.avg("confidence_drop").alias("mean_drop"), F.avg("risk_change").alias("mean_risk_change"),
    )
