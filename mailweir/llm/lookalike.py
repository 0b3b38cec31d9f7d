"""Visually identical text with different characters (problem 3).

Quick check first: a text without any character outside the stable ranges is handed back unread by the normaliser.
Otherwise only the unstable segments are normalised. A segment is a run of unstable characters, widened to a place
where a change cannot reach across: to the left over combining marks to the starter that they sit on, to the right
over combining marks that could compose with it. The canonical segments are spliced into the unchanged rest. The
result equals the whole-text definition in ``functions.canonical`` (a test holds the two against each other).
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from mailweir.llm.canonical import FOREIGN, digest128, letter_count, settle, unstable_pattern
from mailweir.operators.skew import block_pairs
from mailweir.session import cut, spread


@lru_cache(1)
def _unstable_run() -> re.Pattern[str]:
    return re.compile(unstable_pattern() + "+")


def unstable_segments(text: str) -> list[tuple[int, int]]:
    """Half-open spans that may change, in order, not touching each other."""
    spans: list[tuple[int, int]] = []
    for m in _unstable_run().finditer(text):
        a, b = m.span()
        if any(c in FOREIGN for c in m.group()):  # whether these letters change is a matter of the whole word
            unstable = _unstable_run().match  # marks, silent characters and joined letters stand inside words
            while a > 0 and (text[a - 1].isalpha() or unstable(text[a - 1])):
                a -= 1
            while b < len(text) and (text[b].isalpha() or unstable(text[b])):
                b += 1
        if a > 0:
            a -= 1  # the starter (or Hangul lead) that the run may compose with
            while a > 0 and unicodedata.combining(text[a]):
                a -= 1
        while b < len(text) and unicodedata.combining(text[b]):
            b += 1
        while spans and a <= spans[-1][1]:
            before = spans.pop()
            a, b = min(a, before[0]), max(b, before[1])
        spans.append((a, b))
    return spans


def splice(text: str | None) -> str | None:
    """Consistent form of one text; null stays null."""
    if text is None:
        return None
    spans = unstable_segments(text)
    if not spans:
        return text
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        out.append(settle(text[a:b]))
        at = b
    out.append(text[at:])
    return "".join(out)


@F.arrow_udf(StringType())
def consistent_form(col: pa.Array) -> pa.Array:
    return pa.array([splice(v) for v in col.to_pylist()], pa.string())


_KEY = StructType([StructField(n, LongType()) for n in ("lo", "hi", "raw")] + [StructField("letters", IntegerType())])


@F.arrow_udf(_KEY)
def form_key(subject: pa.Array, body: pa.Array) -> pa.Array:
    lo, hi, raw, letters = [], [], [], []
    for s, b in zip(subject.to_pylist(), body.to_pylist()):
        s, b = s or "", b or ""
        x, y = splice(s), splice(b)
        low, high = digest128(f"{x}\0{y}")
        lo.append(low)
        hi.append(high)
        raw.append(low if (x, y) == (s, b) else digest128(f"{s}\0{b}")[1])
        letters.append(letter_count(x) + letter_count(y))
    cols = [pa.array(v, pa.int64()) for v in (lo, hi, raw)] + [pa.array(letters, pa.int32())]
    return pa.StructArray.from_arrays(cols, ["lo", "hi", "raw", "letters"])


def normalise(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with the named text columns in consistent form."""
    return df.withColumns({c: consistent_form(F.col(c)) for c in columns})


def disguised_pairs(df: DataFrame, id_col: str = "id", first: str = "subject", second: str = "body", least_letters: int = 20) -> DataFrame:
    """(id_a, id_b), smaller id first: equal fields in consistent form, other stored characters.

    Null counts as empty. Records of few letters never match. Only keys with two stored forms are paired; a key's
    rows are paired in blocks, and rows of one stored form are not paired with each other.
    """
    rows = spread(df.select(id_col, first, second)).select(F.col(id_col).alias("id"), form_key(F.col(first), F.col(second)).alias("k"))
    rows = rows.select("id", "k.lo", "k.hi", "k.raw", "k.letters").filter(F.col("letters") >= least_letters).drop("letters")
    rows = cut(rows)
    per = rows.groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("n"), F.min("raw").alias("r0"), F.max("raw").alias("r1"))
    per = per.filter("r0 <> r1").select("lo", "hi", "n")
    several = cut(rows.join(per, ["lo", "hi"]))
    a = several.select("lo", "hi", "n", F.col("id").alias("id_a"), F.col("raw").alias("raw_a"))
    b = several.select("lo", "hi", "n", F.col("id").alias("id_b"), F.col("raw").alias("raw_b"))
    b = b.withColumnRenamed("n", "m").withColumn("n", F.col("m"))
    pairs = block_pairs(a.withColumn("m", F.col("n")), b, ["lo", "hi"], "n", "m")
    return pairs.filter("raw_a <> raw_b and id_a < id_b").select("id_a", "id_b")
