"""Records that differ only in white space, case, punctuation or field order (problem 4).

The key of a record is a 128-bit digest of its two fields, each reduced to the letters and digits of its consistent
form, in sorted order, so that swapped fields meet. Partial counts find every hot key exactly; hot keys are grouped
in two levels with a salt, the others in one shuffle. The representative is the smallest id.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from mailweir.llm.canonical import digest128, letter_count, squash
from mailweir.operators.skew import hot_threshold
from mailweir.session import cut, spread

_KEY = StructType([StructField("lo", LongType()), StructField("hi", LongType()), StructField("letters", IntegerType())])


@F.arrow_udf(_KEY)
def format_key(subject: pa.Array, body: pa.Array) -> pa.Array:
    lo, hi, letters = [], [], []
    for s, b in zip(subject.to_pylist(), body.to_pylist()):
        x, y = squash(s), squash(b)
        if y < x:
            x, y = y, x
        low, high = digest128(f"{x}\0{y}")
        lo.append(low)
        hi.append(high)
        letters.append(letter_count(s) + letter_count(b))
    cols = [pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(letters, pa.int32())]
    return pa.StructArray.from_arrays(cols, ["lo", "hi", "letters"])


def keyed(df: DataFrame, id_col: str, first: str, second: str) -> DataFrame:
    """(id, lo, hi, letters), one row for each row of ``df``; null fields count as empty."""
    df = spread(df.select(id_col, first, second))
    k = df.select(F.col(id_col).alias("id"), format_key(F.col(first), F.col(second)).alias("k"))
    return k.select("id", "k.lo", "k.hi", "k.letters")


def copies(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From cut (id, lo, hi): one row a key (id, n_copies, lo, hi), and every other copy as (id_a, id_b)."""
    total = keys.count()
    limit = hot_threshold(total)
    counts = keys.groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    hot = F.broadcast(cut(counts.filter(F.col("n") >= limit).select("lo", "hi")))  # at most total / limit rows
    hot_rows = keys.join(hot, ["lo", "hi"])
    salted = hot_rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    partial = salted.groupBy("lo", "hi", "salt").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("c"))
    hot_reps = cut(partial.groupBy("lo", "hi").agg(F.min("a").alias("id_a"), F.sum("c").alias("n")))
    cold = keys.join(hot, ["lo", "hi"], "left_anti").groupBy("lo", "hi")
    cold = cold.agg(F.min("id").alias("id_a"), F.count(F.lit(1)).alias("n"), F.collect_list("id").alias("ids"))
    columns = [F.col("id_a").alias("id"), F.col("n").alias("n_copies"), "lo", "hi"]
    records = cold.select(*columns).unionByName(hot_reps.select(*columns))
    hot_pairs = hot_rows.join(F.broadcast(hot_reps), ["lo", "hi"]).select("id_a", F.col("id").alias("id_b"))
    cold_pairs = cold.filter("n > 1").select("id_a", F.explode("ids").alias("id_b"))
    return records, hot_pairs.unionByName(cold_pairs).filter("id_a <> id_b")


def collapse(df: DataFrame, id_col: str = "id", first: str = "subject", second: str = "body") -> DataFrame:
    """One record per distinct content: ``id`` (the smallest) and ``n_copies``.

    Records without any letter or digit are one content of their own. An empty table gives an empty result; rows
    that repeat an id count as copies.
    """
    return copies(cut(keyed(df, id_col, first, second).select("id", "lo", "hi")))[0].select("id", "n_copies")


def copy_pairs(df: DataFrame, id_col: str = "id", first: str = "subject", second: str = "body", least_letters: int = 20) -> DataFrame:
    """(id_a, id_b): the smallest id of each content with each of its other ids; texts of few letters are left out."""
    rows = keyed(df, id_col, first, second).filter(F.col("letters") >= least_letters)
    return copies(cut(rows.select("id", "lo", "hi")))[1]
