"""Mixing sources to target weights (problem 9).

Sizes are token counts. The total is the largest for which every weighted source that has documents can give its
share within its repeats. A source's budget is a number of whole passes over the source and a rest; the rest is
chosen by a threshold on a hash of the document id. Thresholds come from histograms: tokens by source and hash
bucket give the bucket in which each budget ends, and only that bucket is counted again on finer hash bits, level by
level, until it holds few documents. Documents are then kept by comparing hashes; nothing is sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mailweir.llm.encode import DEFAULT_RANKS, token_count
from mailweir.session import cut, spread

BUCKET_BITS = 10
LEVELS = 5
SPACE = 1 << (BUCKET_BITS * LEVELS)


def _sized(documents: DataFrame, path: str) -> DataFrame:
    h = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(11)), 64 - BUCKET_BITS * LEVELS)
    return spread(documents.select("doc_id", "source", "text")).select("doc_id", "source", token_count(documents.sparkSession, path)(F.col("text")).cast("bigint").alias("n_tokens"), h.alias("h"))


def _plan(sized: DataFrame, weights: DataFrame, total: int | None) -> list[dict]:
    """One dict a weighted source (the weight table is small and fixed): passes, rest, threshold, last tokens."""
    wanted = {r["source"]: r for r in weights.filter("source is not null and target_share > 0").collect()}
    have = {r["source"]: r["t"] for r in sized.filter(F.col("source").isin(*wanted)).groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    able = {s: max(1, int(wanted[s]["max_repeats"] or 1)) * t for s, t in have.items() if t}
    if not able:
        return []
    most = min(able[s] / wanted[s]["target_share"] for s in able)
    whole = most if total is None else total
    out = []
    for s in sorted(able):
        budget = min(int(whole * wanted[s]["target_share"]), able[s])
        passes = min(budget // have[s], max(1, int(wanted[s]["max_repeats"] or 1)))
        rest = budget - passes * have[s]
        out.append({"source": s, "passes": int(passes), "rest": int(rest), "low": 0, "width": SPACE})
    # refine the boundary bucket of each source
    for _ in range(LEVELS):
        live = [p for p in out if p["rest"] > 0]
        if not live:
            break
        width = live[0]["width"] >> BUCKET_BITS
        inside = None
        for p in live:
            one = (F.col("source") == p["source"]) & (F.col("h") >= p["low"]) & (F.col("h") < p["low"] + p["width"])
            inside = one if inside is None else inside | one
        bucket = F.pmod(F.floor(F.col("h") / F.lit(width)), F.lit(1 << BUCKET_BITS)).cast("int")
        sums = sized.filter(inside).groupBy("source", bucket.alias("b")).agg(F.sum("n_tokens").alias("t")).collect()
        by = {}
        for r in sums:  # at most sources x buckets rows
            by.setdefault(r["source"], {})[r["b"]] = r["t"]
        for p in live:
            spent, left = 0, p["rest"]
            for b in range(1 << BUCKET_BITS):
                t = by.get(p["source"], {}).get(b, 0)
                if spent + t > left:
                    break
                spent += t
            else:
                b = 1 << BUCKET_BITS
            p["low"] += b * width
            p["rest"] -= spent
            p["width"] = width
    return out


def mix(documents: DataFrame, weights: DataFrame, total: int | None = None, path: str = DEFAULT_RANKS) -> DataFrame:
    """(doc_id, source, n_tokens, times) of every document that is used at least once.

    ``times`` is never above the source's ``max_repeats``. Documents without a source, or of a source without a
    weight, are not used. A null ``max_repeats`` counts as 1. Empty documents of zero tokens follow their hash like
    others. No weighted document at all gives an empty result.
    """
    sized = cut(_sized(documents, path))
    return _used(sized, _plan(sized, weights, total))


def _used(sized: DataFrame, plan: list[dict]) -> DataFrame:
    times = F.lit(0)
    for p in plan:
        n = F.lit(p["passes"]) + F.when(F.col("h") < p["low"], 1).otherwise(0)
        times = F.when(F.col("source") == p["source"], n).otherwise(times)
    return sized.select("doc_id", "source", "n_tokens", times.cast("int").alias("times")).filter("times > 0")


def mix_report(mixed: DataFrame, weights: DataFrame) -> DataFrame:
    """Target and actual share of each weighted source; a source without documents has zeros."""
    per = mixed.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("n_tokens") * F.col("times")).alias("used_tokens"), F.max("times").alias("most_times")
    )
    joined = weights.select("source", "target_share", "max_repeats").join(per, "source", "left").fillna(0, ["n_docs", "used_tokens", "most_times"])
    whole = F.sum("used_tokens").over(Window.partitionBy())  # over one row a source
    share = F.when(whole == 0, 0.0).otherwise(F.col("used_tokens") / whole)
    return joined.select("source", "target_share", "max_repeats", "n_docs", "used_tokens", "most_times", share.alias("actual_share"))
