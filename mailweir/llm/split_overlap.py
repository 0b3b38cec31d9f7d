"""Records of evaluation splits that also occur, exactly or almost, in the training split (problem 5).

Minwise hashing with banded buckets. A pair is wanted if at most one word in ten differs, so five-word shingles would
not do: changes spread evenly leave a Jaccard similarity near 0.27. The shingle is therefore one word with its
occurrence number; a pair at the limit then has a similarity of at least 9/11. With 26 bands of 6 rows a pair at that
limit is missed with a probability below 1e-4, any closer pair with less. Copies of one word sequence are hashed once.
Buckets are joined evaluation side to training side only; candidates whose lengths or 112 one-bit sketches rule them
out are dropped in the join, the rest is verified by Jaccard similarity and word edit distance over word hashes, and what remains by the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from mailweir.llm.canonical import digest128, words
from mailweir.operators.skew import block_pairs
from mailweir.session import cut, spread

BANDS, ROWS = 26, 6
#: One-bit sketch beside each band key: 48 bits share a long with the length, 64 more have their own. A pair at the limit
#: agrees in 101.8 of 112 bits on average (deviation 3.0).
LENGTH_BITS, SKETCH_BITS, SKETCH_LEAST = 48, 112, 90
LEAST_WORDS = 30
#: Buckets of ids by which the texts of the last check are picked: at most so many numbers are broadcast.
BUCKETS = 1 << 20
#: One word in so many may differ; the longer text counts.
TENTH = 10
_P = BANDS * ROWS
_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 2**63, _P, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 2**63, _P, dtype=np.uint64)
_C = _rng.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_BAND = _rng.integers(0, 2**63, BANDS, dtype=np.uint64)

_TEXT_SCHEMA = "id string, side int, wlo long, clo long, chi long, words binary"


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, bytes] = {}
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        for i, side, s, b in zip(*(c.to_pylist() for c in batch.columns)):
            ws, wb = words(s), words(b)
            both = ws + wb
            if len(both) < LEAST_WORDS:
                continue
            if len(known) > 500_000:
                known.clear()
            hashed = []
            for w in both:
                h = known.get(w)
                if h is None:
                    h = known[w] = xxhash.xxh32_intdigest(w).to_bytes(4, "little")[:3]
                hashed.append(h)
            x, y = "".join(ws), "".join(wb)
            if y < x:
                x, y = y, x
            row = (i, side, digest128(" ".join(both))[0], *digest128(f"{x}\0{y}"), b"".join(hashed))
            for col, v in zip(out, row):
                col.append(v)
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], ["id", "side", "wlo", "clo", "chi", "words"])


def unpack(words_: bytes) -> np.ndarray:
    """Word hashes of 24 bits."""
    b = np.frombuffer(words_, np.uint8).reshape(-1, 3).astype(np.uint32)
    return b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16


def numbered(tokens: np.ndarray) -> np.ndarray:
    """Each word hash with its occurrence number in the text, so that the set keeps multiplicities."""
    order = np.argsort(tokens, kind="stable")
    s = tokens[order]
    start = np.r_[True, s[1:] != s[:-1]]
    pos = np.arange(len(s))
    occ = pos - np.maximum.accumulate(np.where(start, pos, 0))
    out = np.empty(len(s), np.uint64)
    out[order] = s.astype(np.uint64) + (occ.astype(np.uint64) << np.uint64(32))
    return out


def signatures(token_lists: list[np.ndarray]) -> np.ndarray:
    """(permutations, texts) minima of 32 bits; every list holds at least one token."""
    flat = np.concatenate(token_lists)
    flat ^= flat >> np.uint64(29)
    flat *= np.uint64(0x9E3779B97F4A7C15)
    flat ^= flat >> np.uint64(32)
    starts = np.r_[0, np.cumsum([len(t) for t in token_lists])[:-1]].astype(np.int64)
    sig = np.empty((_P, len(token_lists)), np.uint64)
    for p in range(_P):
        sig[p] = np.minimum.reduceat((flat * _A[p] + _B[p]) >> np.uint64(32), starts)
    return sig


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 2000):
            part = batch.slice(lo, 2000)
            rid, blobs = (c.to_pylist() for c in part.columns)
            n = [len(w) // 3 for w in blobs]
            sig = signatures([numbered(unpack(w)) for w in blobs])
            bits = np.zeros((2, len(rid)), np.uint64)
            for k in range(SKETCH_BITS):
                word, place = (0, k) if k < LENGTH_BITS else (1, k - LENGTH_BITS)
                bits[word] |= (sig[k] & np.uint64(1)) << np.uint64(place)
            bits[0] |= np.minimum(np.array(n, np.uint64), np.uint64(0x7FFF)) << np.uint64(LENGTH_BITS)
            keys = (sig.reshape(BANDS, ROWS, -1) * _C[:, :, None]).sum(axis=1, dtype=np.uint64) ^ _BAND[:, None]
            keys ^= keys >> np.uint64(31)
            keys *= np.uint64(0xBF58476D1CE4E5B9)
            cols = [keys.ravel(), *(np.tile(x, BANDS) for x in (np.array(rid, np.int64), bits[0], bits[1]))]
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in cols], ["key", "rid", "sk", "sl"])


def word_distance(a: list[int], b: list[int]) -> int:
    """Edit distance of two word sequences, bit-parallel over the shorter one."""
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    while a and a[-1] == b[-1]:
        a.pop()
        b.pop()
    if not a:
        return len(b)
    where: dict[int, int] = {}
    for k, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << k
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for w in b:
        eq = where.get(w, 0)
        diag = (((eq & up) + up) ^ up) | eq | down
        hp = down | ~(diag | up) & full
        hn = up & diag
        if hp & top:
            score += 1
        if hn & top:
            score -= 1
        hp = (hp << 1 | 1) & full
        hn = hn << 1 & full
        up = hn | ~(diag | hp) & full
        down = hp & diag
    return score


@F.arrow_udf(BooleanType())
def _near(a: pa.Array, b: pa.Array) -> pa.Array:
    out = []
    for x, y in zip(a.to_pylist(), b.to_pylist()):
        u, v = unpack(x), unpack(y)
        longer = max(len(u), len(v))
        shared = len(np.intersect1d(numbered(u), numbered(v), assume_unique=True))
        # Jaccard similarity of the numbered words: at the limit (n - k) / (n + k) with k = n / 10
        if 11 * shared < 9 * (len(u) + len(v) - shared):
            out.append(False)
        else:
            out.append(TENTH * word_distance(u.tolist(), v.tolist()) <= longer)
    return pa.array(out, pa.bool_())


@F.arrow_udf(BooleanType())
def _truly_near(s1: pa.Array, b1: pa.Array, s2: pa.Array, b2: pa.Array) -> pa.Array:
    out = []
    for a, b, c, d in zip(*(x.to_pylist() for x in (s1, b1, s2, b2))):
        number: dict[str, int] = {}
        u, v = ([number.setdefault(w, len(number)) for w in words(x) + words(y)] for x, y in ((a, b), (c, d)))
        longer = max(len(u), len(v))
        out.append(TENTH * word_distance(u, v) <= longer)
    return pa.array(out, pa.bool_())


def _exactly(pairs: DataFrame, rows: DataFrame, messages: DataFrame) -> DataFrame:
    """Pairs that are near by their words themselves, since two words may share a hash. One message stands for each text."""
    wanted = pairs.select(F.col("wt").alias("wlo")).unionByName(pairs.select(F.col("we").alias("wlo"))).distinct()
    one = cut(rows.select("wlo", "id").join(wanted, "wlo").groupBy("wlo").agg(F.min("id").alias("id")))
    # only messages whose id falls into a bucket of a wanted one are shuffled; the table of buckets has a fixed bound
    bucket = F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).alias("_h")
    near = messages.select("id", "subject", "body", bucket).join(F.broadcast(one.select(bucket).distinct()), "_h", "left_semi")
    texts = near.select("id", "subject", "body").join(one, "id").dropDuplicates(["wlo"])
    a = texts.select(F.col("wlo").alias("wt"), F.col("subject").alias("s1"), F.col("body").alias("b1"))
    b = texts.select(F.col("wlo").alias("we"), F.col("subject").alias("s2"), F.col("body").alias("b2"))
    return pairs.join(a, "wt").join(b, "we").filter(_truly_near("s1", "b1", "s2", "b2")).select("wt", "we")


def _side(split: Column) -> Column:
    s = F.lower(F.trim(split))
    return F.when(s == "train", 0).when(s.isin("validation", "test"), 1)


def overlap_pairs(messages: DataFrame) -> DataFrame:
    """(train_id, eval_id) of all cross-split copies and near copies.

    Rows without a split, and texts under 30 words, take no part. Null fields count as empty. A row that repeats an id is
    a row of its own, so its pairs are repeated. An empty table gives an empty result.
    """
    rows = messages.select("id", _side(F.col("split")).alias("side"), "subject", "body").filter("side is not null")
    rows = cut(spread(rows).mapInArrow(_texts, _TEXT_SCHEMA))

    # copies by letters and digits, in blocks
    light = rows.select("id", "side", "wlo", "clo", "chi")
    per = light.groupBy("clo", "chi").agg(F.sum(1 - F.col("side")).alias("nt"), F.sum("side").alias("ne")).filter("nt > 0 and ne > 0")
    copied = cut(light.join(per, ["clo", "chi"]))
    train = copied.filter("side = 0").select(F.col("id").alias("train_id"), "clo", "chi", "nt", "ne")
    evalu = copied.filter("side = 1").select(F.col("id").alias("eval_id"), "clo", "chi", "nt", "ne")
    exact = block_pairs(train, evalu, ["clo", "chi"], "nt", "ne").select("train_id", "eval_id")

    # near copies between distinct word sequences
    # (all uses need both aggregates, so that one exchange serves them all)
    texts = rows.groupBy("wlo").agg(F.bit_or(F.col("side") + 1).alias("sides"), F.first("words").alias("w"))

    def banded(side: int, *names: str) -> DataFrame:
        rows = texts.filter(F.col("sides").bitwiseAND(F.lit(side)) > 0).select("wlo", "w").mapInArrow(_bands, "key long, rid long, sk long, sl long")
        return rows.toDF("key", *names)

    a, b = banded(1, "wt", "st", "rt"), banded(2, "we", "se", "re")
    mask = F.lit((1 << LENGTH_BITS) - 1)
    nt, ne = F.shiftright("st", LENGTH_BITS), F.shiftright("se", LENGTH_BITS)
    differ = F.bit_count(F.col("st").bitwiseXOR(F.col("se")).bitwiseAND(mask)) + F.bit_count(F.col("rt").bitwiseXOR(F.col("re")))
    close = (TENTH * F.abs(nt - ne) <= F.greatest(nt, ne)) | (F.least(nt, ne) == 0x7FFF)
    pairs = a.join(b, "key").filter((F.col("wt") != F.col("we")) & close & (differ <= SKETCH_BITS - SKETCH_LEAST))
    pairs = pairs.select("wt", "we").distinct()
    known = texts.filter("sides > 0").select("wlo", "w")
    checked = (
        pairs.join(known.toDF("wt", "x"), "wt")
        .join(known.toDF("we", "y"), "we")
        .filter(_near("x", "y"))
        .select("wt", "we")
    )
    # one word sequence with different field borders or word borders
    same = rows.groupBy("wlo").agg(F.min("clo").alias("lo"), F.max("clo").alias("hi"), F.min("side").alias("s0"), F.max("side").alias("s1"))
    same = same.filter("lo <> hi and s0 < s1").select(F.col("wlo").alias("wt"), F.col("wlo").alias("we"))
    checked = _exactly(cut(checked), rows, messages)
    found = cut(checked.unionByName(same))
    train = light.filter("side = 0").select(F.col("wlo").alias("wt"), F.col("id").alias("train_id"), F.col("clo").alias("ct"))
    evalu = light.filter("side = 1").select(F.col("wlo").alias("we"), F.col("id").alias("eval_id"), F.col("clo").alias("ce"))
    near = found.join(train, "wt").join(evalu, "we").filter("ct <> ce").select("train_id", "eval_id")
    return exact.unionByName(near)


def overlap_found(messages: DataFrame) -> DataFrame:
    return overlap_pairs(messages).select(F.least("train_id", "eval_id").alias("id_a"), F.greatest("train_id", "eval_id").alias("id_b"))


def overlap_report(messages: DataFrame) -> DataFrame:
    """Confirmed pairs by evaluation split, its source and the training source: pairs and distinct evaluation records."""
    pairs = cut(overlap_pairs(messages))
    about = messages.select("id", F.lower(F.trim("split")).alias("split"), F.coalesce("source", F.lit("(none)")).alias("source"))
    e = about.select(F.col("id").alias("eval_id"), F.col("split"), F.col("source").alias("eval_source"))
    t = about.select(F.col("id").alias("train_id"), F.col("source").alias("train_source"))
    per_eval = pairs.join(t, "train_id").groupBy("eval_id", "train_source").agg(F.count(F.lit(1)).alias("pairs"))
    return (
        per_eval.join(e, "eval_id")
        .groupBy("split", "eval_source", "train_source")
        .agg(F.sum("pairs").alias("pairs"), F.count(F.lit(1)).alias("eval_records"))
    )
