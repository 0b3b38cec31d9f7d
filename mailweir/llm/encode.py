"""Encoding of a whole corpus with a public tokenizer (problem 8).

The text is split by the tokenizer's pattern; each piece starts as its bytes and is merged by rank. The ranks of
adjacent pairs stand in a segment tree whose root is the leftmost pair of lowest rank. A merge changes two leaves
(the pairs to its left and right) and closes one, each a logarithmic update, until the root holds no rank. A piece of
n bytes so takes n log n steps, however long. Pieces recur, so a bounded table of finished pieces is kept.

Null and empty texts have the empty list of ids. Special tokens' strings in a text are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from mailweir.session import spread

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pattern of the byte-level tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = 1 << 40
CACHE = 300_000


class Tokenizer:
    def __init__(self, source: str | bytes = DEFAULT_RANKS, pattern: str = PATTERN):
        """``source``: the path of a file of ranks, or its content."""
        self.ranks: dict[bytes, int] = {}
        for line in (source if isinstance(source, bytes) else _content(source)).splitlines():
            if line.strip():
                token, rank = line.split()
                self.ranks[base64.b64decode(token)] = int(rank)
        self.find = regex.compile(pattern).findall
        self.done: dict[str, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece by the segment tree of pair ranks."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        size = 1
        while size < n - 1:
            size *= 2
        # tree[i]: rank * n + position, so that the least value is the leftmost pair of lowest rank
        tree = [NONE * n] * (2 * size)
        for i in range(n - 1):
            r = ranks.get(piece[i : i + 2])
            if r is not None:
                tree[size + i] = r * n + i
        for i in range(size - 1, 0, -1):
            x, y = tree[2 * i], tree[2 * i + 1]
            tree[i] = x if x <= y else y
        end = list(range(1, n + 1))  # end of the part that begins here
        before = list(range(-1, n - 1))  # begin of the part to the left

        def put(i: int, value: int) -> None:
            i += size
            tree[i] = value
            i //= 2
            while i:
                x, y = tree[2 * i], tree[2 * i + 1]
                tree[i] = x if x <= y else y
                i //= 2

        never = NONE * n
        while tree[1] < never:
            i = tree[1] % n
            j = end[i]
            k = end[j]
            end[i] = k
            put(j, never) if j < n - 1 else None
            if k < n:
                before[k] = i
                r = ranks.get(piece[i : end[k]])
                put(i, never if r is None else r * n + i)
            else:
                put(i, never)
            h = before[i]
            if h >= 0:
                r = ranks.get(piece[h:k])
                put(h, never if r is None else r * n + h)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        done = self.done
        for piece in self.find(text):
            ids = done.get(piece)
            if ids is None:
                ids = self.merge(piece.encode("utf-8", "surrogatepass"))
                if len(piece) <= 64:
                    if len(done) >= CACHE:
                        done.clear()
                    done[piece] = ids
            out += ids
        return out


@lru_cache(4)
def _content(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


@lru_cache(4)
def _tokenizer(content: bytes) -> Tokenizer:
    return Tokenizer(content)


def _shipped(spark: SparkSession, path: str):
    """The file of ranks (about a megabyte), read by the driver and sent along."""
    return spark.sparkContext.broadcast(_content(path))


def token_ids(spark: SparkSession, path: str = DEFAULT_RANKS):
    """Arrow function text -> array<int>."""
    ranks = _shipped(spark, path)

    @F.arrow_udf(ArrayType(IntegerType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t = _tokenizer(ranks.value)
        for col in batches:
            yield pa.array([t.encode(v) for v in col.to_pylist()], pa.list_(pa.int32()))

    return run


def token_count(spark: SparkSession, path: str = DEFAULT_RANKS):
    """Arrow function text -> number of tokens, without carrying the ids."""
    ranks = _shipped(spark, path)

    @F.arrow_udf(IntegerType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t = _tokenizer(ranks.value)
        for col in batches:
            yield pa.array([len(t.encode(v)) for v in col.to_pylist()], pa.int32())

    return run


def encode_corpus(documents: DataFrame, path: str = DEFAULT_RANKS) -> DataFrame:
    """(doc_id, ids), one row a document; no shuffle, unless the input has fewer splits than there are cores."""
    return spread(documents.select("doc_id", "text")).select("doc_id", token_ids(documents.sparkSession, path)(F.col("text")).alias("ids"))
