"""Helpers for keys that may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many keys are hot, whatever the input: their table is what is broadcast.
HOT_KEYS = 4096


def hot_threshold(rows: int, floor: int = 1000) -> int:
    """Count from which a key is hot. At most ``rows / threshold`` keys can be hot, which bounds their table."""
    return max(floor, rows // HOT_KEYS)


def attach_by_key(rows: DataFrame, per_key: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with one row per key; hot keys (by the count column ``n``) go by bounded broadcast.

    ``per_key`` is used twice and should be cut before. Nulls in keys match nothing.
    """
    limit = hot_threshold(total)
    hot, cold = per_key.filter(F.col(n) >= limit), per_key.filter(F.col(n) < limit)
    hot = F.broadcast(hot)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys))


def blocks_of(n: Column, per_block: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / F.lit(per_block)).cast("int"))


def block_pairs(left: DataFrame, right: DataFrame, keys: list[str], left_n: str, right_n: str, per_block: int = 2000) -> DataFrame:
    """Join of ``left`` and ``right`` on ``keys`` in blocks, so that a hot key is spread over many tasks.

    Every row carries the counts of its key on both sides. A key's rows are hashed into blocks of about ``per_block``
    rows; each left block meets each right block exactly once, in its own join key. The result holds every pair of
    the plain join once. Columns other than the keys must have distinct names on the two sides.
    """
    lb, rb = blocks_of(F.col(left_n), per_block), blocks_of(F.col(right_n), per_block)
    salt = F.xxhash64(*[F.col(c) for c in left.columns if c not in keys])
    salt_r = F.xxhash64(*[F.col(c) for c in right.columns if c not in keys])
    a = left.withColumn("_lb", F.pmod(salt, lb).cast("int")).withColumn("_rb", F.explode(F.sequence(F.lit(0), rb - 1)))
    b = right.withColumn("_rb", F.pmod(salt_r, rb).cast("int")).withColumn("_lb", F.explode(F.sequence(F.lit(0), lb - 1)))
    drop = {left_n, right_n} & set(left.columns) & set(right.columns)
    return a.join(b.drop(*drop), [*keys, "_lb", "_rb"]).drop("_lb", "_rb")
