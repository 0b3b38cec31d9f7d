"""Missing or wrong document language labels (problem 1).

Error-correcting output codes. The five languages have codewords over all 15 ways to part them in two; each bit has a
binary classifier on hashed character n-grams and words, whose weight for a feature is the log-odds of the feature
between the two sides. A text's margins are the sums over its words (a word's weights are kept, so a text costs one
lookup a word). Loss-weighted decoding takes the codeword of least logistic loss, where each bit's loss is weighed by
that classifier's accuracy on the language; its distance to the runner-up gives
the confidence and flags ambiguity.

The classifiers are fitted on a bounded sample of labelled rows (``SAMPLE`` rows a language, chosen by a hash of the
id), once, then again without the rows whose label the first fit denies. Everything else covers all rows.

A body is read in pieces (sentences, lines, parts between separators). The least-cost path over the pieces' losses,
with a price for each change of language, gives the runs of a mixed body. Pieces without evidence (numbers, names,
addresses) take the language of their run. Null and empty texts, and texts without letters, have a null language.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailweir.llm.canonical import canonical
from mailweir.session import spread

LANGUAGES = ("en", "vi", "fr", "de", "es")
SAMPLE = 1200
BUCKETS = 1 << 16
SWITCH = 9.0
TEMPER = 0.35
UNSURE = 0.8

# Spellings of the language names in labels (compared in lower case, before any region).
NAMES = {
    "en": ("en", "eng", "english"),
    "vi": ("vi", "vie", "vietnamese", "tiếng việt", "tieng viet", "vn"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano"),
}
# Labels that name no language.
MISSING = ("", "unknown", "und", "none", "null", "n/a", "na", "nan", "empty")

CODES = np.array([[1 if i and (k + 1) >> (i - 1) & 1 else -1 for k in range(2 ** (len(LANGUAGES) - 1) - 1)] for i in range(len(LANGUAGES))], np.float32)


def label_language(col: Column) -> Column:
    """Language code that a label names, "mixed", another name as it is, or null if it names none."""
    low = F.lower(F.trim(col))
    short = F.when(low.rlike("^[a-z]{2,3}[-_]"), F.regexp_extract(low, "^([a-z]{2,3})[-_]", 1)).otherwise(low)
    out = F.when(low.isNull() | low.isin(*MISSING), F.lit(None).cast("string"))
    for code, names in NAMES.items():
        out = out.when(short.isin(*names), code)
    return out.otherwise(low)


_CLEAN = re.compile(r"(?:https?|hxxps?)\s?:\s?/\s?/\s?\S+(?:\s/\s\S+)*|www\.\S+|\S*@\s?\S+(?:\s\.\s\S+)*")
_SPLIT = re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+|[\r\n]+|\s+/\s+")
_WORD = re.compile(r"[^\W\d_]+")


def pieces(text: str) -> list[str]:
    return [p for p in _SPLIT.split(text) if p and not p.isspace()]


def scored_words(piece: str) -> list[str]:
    """Words that speak for a language: names (capitals inside a piece) are left out unless all is in capitals."""
    found = _WORD.findall(piece)
    if not found:
        return found
    small = [w for w in found if w[0].islower()]
    if not small:  # capitals throughout, or a line of names
        return [w.lower() for w in found] if piece.isupper() else small
    if found[0] is not small[0]:
        small.append(found[0].lower())
    return small


def _features(word: str) -> list[int]:
    padded = f"_{word}_"
    grams = [padded]
    for n in (2, 3, 4):
        grams += [padded[i : i + n] for i in range(len(padded) - n + 1) if len(padded) > n]
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for g in grams]


@dataclass
class Model:
    weights: np.ndarray  # features x bits
    trust: np.ndarray | None = None  # languages x bits: how often a bit is right on a language

    def word(self, w: str) -> np.ndarray:
        f = _features(w)
        return self.weights[f].mean(axis=0) * (1.0 + min(len(w), 8) / 2.0)


def _plain(text: str) -> str:
    stripped = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    return stripped.replace("đ", "d").replace("Đ", "D")


def fit(rows: list[tuple[str, str]]) -> Model:
    """From (language, text); texts are cut into words as in scoring."""
    bags: list[tuple[int, dict[str, int]]] = []
    for lang, text in rows:
        bag: dict[str, int] = {}
        for p in pieces(_prepare(text)):
            for w in scored_words(p):
                bag[w] = bag.get(w, 0) + 1
        if bag:
            bags.append((LANGUAGES.index(lang), bag))
    cache: dict[str, list[int]] = {}

    def counts(use: list[tuple[int, dict[str, int]]]) -> np.ndarray:
        c = np.zeros((len(LANGUAGES), BUCKETS), np.float64)
        total: list[dict[str, float]] = [{} for _ in LANGUAGES]
        for k, bag in use:
            for w, n in bag.items():
                total[k][w] = total[k].get(w, 0) + n
                if k == LANGUAGES.index("vi"):  # Vietnamese is also written without accents
                    bare = _plain(w)
                    if bare != w:
                        total[k][bare] = total[k].get(bare, 0) + 0.4 * n
        for k, words in enumerate(total):
            for w, n in words.items():
                f = cache.get(w)
                if f is None:
                    f = cache[w] = _features(w)
                np.add.at(c[k], f, n ** 0.75)
        return c

    def weigh(c: np.ndarray) -> Model:
        p = (c + 0.5) / (c.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
        bits = []
        for j in range(CODES.shape[1]):
            plus, minus = p[CODES[:, j] > 0].mean(axis=0), p[CODES[:, j] < 0].mean(axis=0)
            bits.append(np.log(plus / minus))
        return Model(np.array(bits, np.float32).T)

    first = weigh(counts(bags))
    scorer = Scorer(first)
    kept = [(k, bag) for k, bag in bags if k == int(np.argmin(loss(sum(scorer.vector(w) * n for w, n in bag.items()))))]
    second = weigh(counts(kept or bags))
    # the share of rows of each language on which each bit is right weighs its loss
    scorer = Scorer(second)
    right, rows_of = np.ones(CODES.shape), np.full(len(LANGUAGES), 1.0)
    for k, bag in kept or bags:
        right[k] += sum(scorer.vector(w) * n for w, n in bag.items()) * CODES[k] > 0
        rows_of[k] += 1
    second.trust = (right / rows_of[:, None]).astype(np.float32)
    return second


def loss(margins: np.ndarray, trust: np.ndarray | None = None) -> np.ndarray:
    """Logistic loss of each codeword for margins (..., bits), each bit weighed by its accuracy on that language."""
    x = -(margins[..., None, :] * TEMPER) * CODES
    each = np.logaddexp(0.0, x)
    if trust is not None:
        each = each * (trust * (trust.shape[1] / trust.sum(axis=1, keepdims=True)))
    return each.sum(axis=-1) / (2 ** (len(LANGUAGES) - 2))


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.index: dict[str, int] = {}
        self.rows = np.zeros((4096, CODES.shape[1]), np.float32)

    def vector(self, w: str) -> np.ndarray:
        return self.rows[self.lookup(w)]

    def lookup(self, w: str) -> int:
        i = self.index.get(w)
        if i is None:
            i = len(self.index)
            if i == len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[i] = self.model.word(w)
            self.index[w] = i
        return i

    def reset(self, most: int = 400_000) -> None:
        if len(self.index) > most:
            self.index.clear()

    def losses(self, word_lists: list[list[int]]) -> np.ndarray:
        """(lists, languages) losses; an empty list has equal losses."""
        out = np.zeros((len(word_lists), len(LANGUAGES)), np.float32)
        full = [k for k, ws in enumerate(word_lists) if ws]
        if full:
            flat = np.fromiter((w for k in full for w in word_lists[k]), np.int64)
            starts = np.cumsum([0, *(len(word_lists[k]) for k in full[:-1])])
            out[full] = loss(np.add.reduceat(self.rows[flat], starts, axis=0), self.model.trust)
        return out


def path(costs: np.ndarray, switch: float = SWITCH) -> list[int]:
    """Language of each piece on the least-cost path."""
    best = costs[0].copy()
    back = []
    for row in costs[1:]:
        jump = int(best.argmin())
        stay = best <= best[jump] + switch
        back.append(np.where(stay, np.arange(len(best)), jump))
        best = np.where(stay, best, best[jump] + switch) + row
    k = int(best.argmin())
    out = [k]
    for b in reversed(back):
        k = int(b[k])
        out.append(k)
    return out[::-1]


def _confidence(total: np.ndarray) -> float:
    p = np.exp(-(total - total.min()))
    return float(1.0 / p.sum())


def _prepare(text: str | None) -> str:
    """Consistent form without addresses of pages and mailboxes."""
    if not text:
        return ""
    text = canonical(text)
    return _CLEAN.sub(" ", text) if "@" in text or "://" in text or ": /" in text or "www." in text else text


def segments(scorer: Scorer, batch: list[tuple[str | None, str | None]]) -> list[list[tuple[str, float, bool]]]:
    """For each (subject, body): (language, confidence, ambiguous) of each segment; none for texts without evidence."""
    scorer.reset()
    lists: list[list[int]] = []
    spans: list[tuple[int, int, int]] = []
    lookup = scorer.lookup
    for subject, body in batch:
        at = len(lists)
        for p in pieces(_prepare(subject)):
            lists.append([lookup(w) for w in scored_words(p)])
        mid = len(lists)
        for p in pieces(_prepare(body)):
            lists.append([lookup(w) for w in scored_words(p)])
        spans.append((at, mid, len(lists)))
    costs = scorer.losses(lists)
    clear = costs.argmin(axis=1)
    gap = np.partition(costs, 1, axis=1)
    gap = gap[:, 1] - gap[:, 0]
    out = []
    for at, mid, end in spans:
        if at == end:
            out.append([])
            continue
        sure = clear[mid:end][gap[mid:end] > 1.0]
        runs: list[list[int]] = []
        if len(sure) and (sure != sure[0]).any():
            way = path(costs[mid:end])
            for i, k in enumerate(way):
                if runs and runs[-1][0] == k:
                    runs[-1].append(mid + i)
                else:
                    runs.append([k, mid + i])
        if len(runs) > 1:
            totals = [(r[0], costs[r[1:]].sum(axis=0)) for r in runs]
        else:
            total = costs[at:end].sum(axis=0)
            if not any(lists[at:end]):
                out.append([])
                continue
            totals = [(int(total.argmin()), total)]
        row = []
        for k, total in totals:
            c = _confidence(total)
            row.append((LANGUAGES[k], c, c < UNSURE))
        out.append(row)
    return out


def training_sample(labelled: DataFrame, per_label: int = SAMPLE) -> list[tuple[str, str]]:
    """At most ``2 * per_label`` rows a language: those whose id hash is under a threshold from the label counts."""
    known = labelled.select("id", "subject", "body", label_language(F.col("language")).alias("lang")).filter(F.col("lang").isin(*LANGUAGES))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    space = 1 << 40
    h = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(space))
    chosen = None
    for lang, n in counts.items():
        one = (F.col("lang") == lang) & (h < int(space * min(1.0, per_label / n)))
        chosen = one if chosen is None else chosen | one
    if chosen is None:
        return []
    text = F.concat_ws("\n", "subject", "body")
    rows = known.filter(chosen).select("lang", text.alias("text")).limit(2 * per_label * len(LANGUAGES)).collect()
    return [(r["lang"], canonical(r["text"])) for r in rows]


_SCHEMA = "id string, label string, letters int, segment int, n_segments int, lang string, confidence double, ambiguous boolean"


def detect(messages: DataFrame, model: Model | None = None) -> DataFrame:
    """(id, label, letters, segment, n_segments, lang, confidence, ambiguous): one row a segment of each message.

    ``label`` is the language that the stored label names; A text in one language has one segment, 0. A text without
    evidence has one row with a null language and confidence 0. No shuffle.
    """
    if model is None:
        model = fit(training_sample(messages))
    shared = messages.sparkSession.sparkContext.broadcast((model.weights.astype(np.float16), model.trust))  # fixed size: 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(shared.value[0].astype(np.float32), shared.value[1]))
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                ids, labels, subjects, bodies = (c.to_pylist() for c in whole.slice(lo, 1000).columns)
                found = segments(scorer, list(zip(subjects, bodies)))
                cols: list[list] = [[] for _ in range(8)]
                for i, label, s, b, segs in zip(ids, labels, subjects, bodies, found):
                    letters = sum(map(len, _WORD.findall(canonical(f"{s or ''} {b or ''}"))))
                    for k, (lang, c, unsure) in enumerate(segs or [(None, 0.0, True)]):
                        for col, v in zip(cols, (i, label, letters, k, len(segs) or 1, lang, c, unsure)):
                            col.append(v)
                kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.bool_()]
                names = [part.split()[0] for part in _SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    rows = messages.select("id", label_language(F.col("language")).alias("label"), "subject", "body")
    return spread(rows).mapInArrow(run, _SCHEMA)


def wrong_labels(messages: DataFrame, model: Model | None = None, least_letters: int = 20) -> DataFrame:
    """(id, segment, lang) of messages with a missing or wrong label, and of all mixed ones."""
    found = detect(messages, model).filter((F.col("letters") >= least_letters) & F.col("lang").isNotNull())
    case = (F.col("n_segments") > 1) | F.col("label").isNull() | (F.col("label") != F.col("lang"))
    return found.filter(case).select("id", "segment", "lang")
