"""Full names of persons in running text, found by a fitted linear model over words (for problem 10).

Nobody labels names, so the model labels the corpus itself, all of it. The seeds are names whose place in a mail gives
them away: the line under a closing formula, the words before a mailbox in angle brackets, the words behind a form of
address. Parts that recur in seeds make a lexicon; runs of such parts anywhere in the corpus are the positive words, all
other words the negative ones. A logistic model is fitted on each word (identity, beginning, end, case), its neighbours
and the marks between them; two more views of each word leave out identity and lexicon, so that context and form can
decide alone. The model then labels the corpus again, which extends the lexicon by the parts that stand beside known
ones, and is fitted a second time. No phrase that introduces names is written down: the model learns those of the corpus.

The corpus is held in blocks of coded words (``Block``), equal examples are one with a count (``Examples``), and each pass of the fit sums the gradients of all blocks. ``fit`` does this in one process, ``pii.fitted`` on the
cluster, with the same functions. What is sent to the workers is the weight table, of ``BUCKETS`` numbers.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BUCKETS = 1 << 17
PASSES = 30
#: Weight of an example in small letters that is no name, in no lexicon and beside no name: such words are most of a text.
FAR = 0.15
#: Characters of the texts of a block, and different examples that are held before they are handed on.
BLOCK, HELD = 1_000_000, 300_000
#: Log-odds at which a word is in a name, at which a capitalised word beside such a word is (one at the begin of a
#: sentence needs more), and the mean at which two capitalised words are one without either being sure.
SURE, WEAK, WEAK_START, PAIR = 0.0, -3.2, -0.7, -2.2

# Closing formulas of mails, and forms of address.
CLOSINGS = (
    "best regards", "kind regards", "regards", "warm regards", "thanks", "many thanks", "thank you", "cheers", "sincerely", "yours sincerely", "yours faithfully", "best", "best wishes", "all the best",
    "trân trọng", "trân trọng cảm ơn", "cảm ơn", "kính thư", "thân mến", "thân ái", "thân", "tran trong", "tran trong cam on", "cam on", "kinh thu", "than men", "than ai",
    "cordialement", "bien cordialement", "merci", "salutations", "mit freundlichen grüßen", "viele grüße", "beste grüße", "danke", "vielen dank", "saludos", "un saludo", "atentamente", "gracias", "muchas gracias", "--",
)
TITLES = ("mr", "mrs", "ms", "miss", "dr", "prof", "herr", "frau", "monsieur", "madame", "mme", "señor", "señora", "sra", "ông", "bà")

_WORD = re.compile(r"[^\W\d_]+")
_CLOSING = re.compile(rf"(?:{'|'.join(map(re.escape, CLOSINGS))})[ \t]*[,.!]?[ \t\r]*", re.I)
_BOX = re.compile(r"\S*[ ]?@[ ]?\S*")
_MAILBOX_NAME = re.compile(r"((?:[^\W\d_][\w.'’-]*[ ,]+){1,4}[^\W\d_][\w.'’-]*)[\"']?[ ]?<[^<>@\s]+@")
_TITLE = re.compile("|".join(TITLES), re.I)
_TITLED = re.compile(rf"\b(?:{'|'.join(TITLES)})\b\.?[ ]((?:[^\W\d_][\w'’-]*\.?[ ]){{1,3}}[^\W\d_][\w'’-]*)", re.I)

JOIN, GLUE, COMMA, STOP, COLON, LINE, OTHER = range(7)
LOWER, CAPITAL, UPPER, LETTER = range(4)


def _hash(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)


def _part(word: str) -> int:
    """Place of a word in the lexicon, which tells words in small letters from the others."""
    return _hash(f"x {word}" if word[0].islower() else f"X {word.lower()}")


def _gap(gap: str) -> int:
    if gap == " ":
        return JOIN
    if gap in ("-", "'", "’"):
        return GLUE
    if gap == ", ":
        return COMMA
    if "\n" in gap:
        return LINE
    if any(c in ".!?" for c in gap):
        return STOP
    return COLON if ":" in gap else OTHER


def _case(word: str) -> int:
    if len(word) == 1:
        return LETTER if word.isupper() else LOWER
    if word[0].isupper():
        return UPPER if word.isupper() else CAPITAL
    return LOWER


class _Words(dict):
    """Word to row number; a new word gets its features and weights, one row of a table that grows."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.table = np.zeros((4096, 7), np.float32)

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        if n == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[n] = self.model.describe(word)
        return n

    def column(self, k: int) -> np.ndarray:
        return self.table[: len(self), k]


class _Gaps(dict):
    def __missing__(self, gap: str) -> int:
        n = self[gap] = _gap(gap)
        return n


def word_features(word: str) -> tuple[list[int], int, int, int, int]:
    """Hashed features of a word as itself; as the one before, two before and after; its case."""
    low = word.lower()
    case = _case(word)
    own = [_hash(f"w {low}"), _hash(f"e {low[-3:]}"), _hash(f"b {low[:3]}"), _hash(f"n {min(len(low), 9)} {case}")]
    return own, _hash(f"p {low}"), _hash(f"q {low}"), _hash(f"f {low}"), case


def _rows(lists: pa.ListArray, known: dict) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers in ``known`` of all values, and their lengths; each distinct value is looked up once."""
    coded = lists.flatten().dictionary_encode()
    rows = np.array([known[v] for v in coded.dictionary.to_pylist()], np.int64)
    sizes = pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    return (rows[codes], sizes[codes]) if len(codes) else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Layout:
    """The words of many texts in one row of arrays; texts are parted by a line mark. A word is a run of letters."""

    def __init__(self, texts: Sequence[str], words: dict, gaps: dict):
        column = pa.array(texts, pa.large_string())
        # a letter on each side makes every text begin and end with a word, so that words and gaps alternate
        column = pc.binary_join_element_wise(pa.scalar("x ", pa.large_string()), column, pa.scalar(" x", pa.large_string()), pa.scalar("", pa.large_string()))
        cut = pc.split_pattern_regex(column, r"[^\pL]+")
        between = pc.split_pattern_regex(column, r"\pL+")
        ids, lengths = _rows(cut, words)
        marks, widths = _rows(between, gaps)
        n = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
        # gaps: an empty one, those between words, an empty one
        last = np.cumsum(n + 1) - 1
        keep = np.ones(len(marks), np.bool_)
        keep[last] = False
        marks, widths = marks[keep], widths[keep]  # the gap before each word
        ends = np.cumsum(lengths + widths)
        first = np.cumsum(n) - n
        base = np.repeat(np.r_[0, ends[np.cumsum(n) - 1][:-1]] if len(n) else ends[:0], n)
        begins = ends - lengths - base - 2
        real = np.ones(len(ids), np.bool_)
        real[first] = False
        real[first + n - 1] = False
        marks[(first + 1)[n > 2]] = LINE
        tight = widths == 1  # one character after a word
        tight[(first + 1)[n > 2]] = False
        self.ids, self.marks, self.begins, self.lengths, self.tight = ids[real], marks[real], begins[real], lengths[real], tight[real]
        self.counts = (n - 2).tolist()

    def settle(self, case: np.ndarray) -> None:
        """A full stop behind a single capital letter does not part words."""
        self.case = case[self.ids]
        initial = np.r_[False, self.case[:-1] == LETTER][: len(self.case)]
        self.marks = np.where(initial & (self.marks == STOP), JOIN, self.marks)
        self.after = np.r_[self.marks[1:], LINE] if len(self.marks) else self.marks
        # cases of the words beside each, which do not reach into other texts
        n = np.array(self.counts, np.int64)
        ends = np.cumsum(n)[n > 0]
        self.first, self.last = ends - n[n > 0], ends - 1
        self.case_before, self.case_behind = np.r_[LOWER, self.case[:-1]][: len(self.case)], np.r_[self.case[1:], LOWER][: len(self.case)]
        self.case_before[self.first] = LOWER
        self.case_behind[self.last] = LOWER


_CONTEXT = {(k, m): _hash(f"{k} <{m}>") for k in "pqf" for m in range(7)}
_CASES = {(k, m, c): _hash(f"{k} {m} {c}") for k in ("before", "behind", "start", "lexb", "lexf") for m in range(7) for c in range(8)}
_LEX = _hash("lexicon")


class Model:
    """Weights of hashed features, and the lexicon as features of its own."""

    def __init__(self, weights: np.ndarray | None = None, lexicon: np.ndarray | None = None):
        self.weights = np.zeros(BUCKETS, np.float32) if weights is None else weights
        self.lexicon = np.zeros(BUCKETS, np.bool_) if lexicon is None else lexicon
        self.words = _Words(self)
        self.gaps = _Gaps()

    def known(self, word: str) -> bool:
        return bool(self.lexicon[_part(word)])

    def describe(self, word: str) -> tuple:
        own, before, before2, after, case = word_features(word)
        w = self.weights
        capital = bool(self.lexicon[_part(word[0].upper() + word[1:])])
        return float(w[own].sum()), float(w[before]), float(w[before2]), float(w[after]), case, self.known(word), capital

    def _table(self, kind: str) -> np.ndarray:
        return np.array([[self.weights[_CASES[kind, m, c]] for c in range(8)] for m in range(7)], np.float32)

    def find(self, texts: Sequence[str]) -> list[list[tuple[int, int]]]:
        """Spans of the full names of each text."""
        if len(self.words) > 400_000:
            self.words.clear()
        if len(self.gaps) > 100_000:
            self.gaps.clear()
        lay = Layout(texts, self.words, self.gaps)
        if not len(lay.ids) or not self.lexicon.any():  # an unfitted model finds nothing
            return [[] for _ in texts]
        return decode(texts, lay, self.good(lay, self.words.column))

    def good(self, lay: Layout, column: Callable[[int], np.ndarray]) -> np.ndarray:
        """Whether each word is taken for a part of a name; ``column`` has what ``describe`` says of the words."""
        lay.settle(column(4).astype(np.int64))
        z = self.score(lay, column(0), column(1), column(2), column(3), column(5).astype(np.int64))
        return self.grow(lay, z, column(6) > 0)

    def grow(self, lay: Layout, z: np.ndarray, could: np.ndarray) -> np.ndarray:
        """Sure words, likely pairs, and the weak words that stand beside them.

        A word in small letters takes part if the lexicon holds it with a capital.
        """
        big = (lay.case != LOWER) | could[lay.ids]
        weak = (z > np.where(lay.marks <= GLUE, WEAK, WEAK_START)) & big
        pair = weak[:-1] & weak[1:] & (lay.marks[1:] == JOIN) & (z[:-1] + z[1:] > 2 * PAIR)
        good = (z > SURE) | np.r_[pair, False] | np.r_[False, pair]
        for _ in range(3):
            left = np.r_[good[1:], False] & (lay.after <= GLUE) & np.r_[big[1:], False]
            right = np.r_[False, good[:-1]] & (lay.marks <= GLUE) & np.r_[False, big[:-1]]
            good = good | weak & (left | right)
        return good

    def score(self, lay: Layout, self_w, prev_w, prev2_w, next_w, lex) -> np.ndarray:
        ids, m, a = lay.ids, lay.marks, lay.after
        back, back2, on = np.r_[ids[:1], ids[:-1]], np.r_[ids[:1], ids[:1], ids[:-2]][: len(ids)], np.r_[ids[1:], ids[-1:]]
        m_back = np.r_[m[:1], m[:-1]]
        const = {k: np.array([self.weights[_CONTEXT[k, x]] for x in range(7)], np.float32) for k in "pqf"}
        near = m <= COMMA
        z = self_w[ids] + np.where(near, prev_w[back], const["p"][m]) + np.where(a <= COMMA, next_w[on], const["f"][a])
        z += np.where(near & (m_back <= COMMA), prev2_w[back2], const["q"][m])
        l = lex[ids]
        z += self._table("before")[m, lay.case_before] + self._table("behind")[a, lay.case_behind]
        z += self._table("start")[m, lay.case]
        z += self.weights[_LEX] * l + self._table("lexb")[m, np.where(near, lex[back], 0)] + self._table("lexf")[a, np.where(a <= COMMA, lex[on], 0)]
        return z


def _runs(lay: Layout, good: np.ndarray) -> Iterator[list[int]]:
    """Runs of two or more words that the model takes for parts of names, one case throughout. A text begins with a line
    mark, so none reaches into the next."""
    hits = np.flatnonzero(good)
    marks = lay.marks[hits].tolist()
    hits = hits.tolist()
    k = 0
    while k < len(hits):
        run = [hits[k]]
        k += 1
        while k < len(hits) and hits[k] == run[-1] + 1:
            if marks[k] <= GLUE or marks[k] == COMMA and _n_parts(lay, run) == 1:
                run.append(hits[k])
                k += 1
            else:
                break
        run = _trim(lay, run)
        if run:
            yield run


def decode(texts: Sequence[str], lay: Layout, good: np.ndarray) -> list[list[tuple[int, int]]]:
    """Places of the names in each text."""
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    ends = np.cumsum(lay.counts)
    for run in _runs(lay, good):
        at = int(np.searchsorted(ends, run[0], "right"))
        a, b = int(lay.begins[run[0]]), int(lay.begins[run[-1]] + lay.lengths[run[-1]])
        if lay.case[run[-1]] == LETTER and texts[at][b : b + 1] == ".":
            b += 1
        out[at].append((a, b))
    return out


def _n_parts(lay: Layout, run: list[int]) -> int:
    """Parts of a name: words that a hyphen or apostrophe glues are one part."""
    return len(run) - sum(lay.marks[i] == GLUE for i in run[1:])


def _trim(lay: Layout, run: list[int]) -> list[int]:
    case = [lay.case[i] for i in run]
    if case[0] != LOWER:  # a capitalised name ends before a small word
        while run and lay.case[run[-1]] == LOWER:
            run.pop()
        if any(lay.case[i] == LOWER for i in run):
            cut = next(x for x, i in enumerate(run) if lay.case[i] == LOWER)
            run = run[:cut]
    else:
        while run and lay.case[run[-1]] != LOWER:
            run.pop()
    if not run or not 2 <= _n_parts(lay, run) <= 6 or all(lay.case[i] == LETTER for i in run):
        return []
    return run


# ---------------------------------------------------------------- fitting


def seeds(text: str, titled: bool = True) -> list[str]:
    """Names that their place gives away; ``titled`` is false if no form of address is in the text."""
    found = []
    armed = False
    for line in text.split("\n"):
        bare = line.strip()
        if armed and bare:
            words = _WORD.findall(bare)
            if 2 <= len(words) <= 6 and len(bare) <= sum(map(len, words)) + 2 * len(words) and not any(c.isdigit() for c in bare):
                found.append(bare)
            armed = False
        if bare and _CLOSING.fullmatch(bare):
            armed = True
        if "<" in line and "@" in line:
            found += _MAILBOX_NAME.findall(line)
    if titled:
        found += _TITLED.findall(text)
    return found


def _label(lay: Layout, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words in full names, and words that no one can tell.

    A name begins and ends with a word of the lexicon or an initial; capitals between two such words belong to it.
    Capitals beside a name or a word of the lexicon are left out of the fit, unless a mark parts them.
    """
    n = len(lay.ids)
    y = np.zeros(n, np.bool_)
    doubt = np.zeros(n, np.bool_)
    at = np.flatnonzero(inside).tolist()
    inside, sure, big = inside.tolist(), (inside | (lay.case == LETTER)).tolist(), (lay.case != LOWER).tolist()
    letter, marks = (lay.case == LETTER).tolist(), [*lay.marks.tolist(), LINE]  # a text ends before a line mark
    k = 0
    while k < len(at):
        lo = hi = last = i = at[k]
        while lo > 0 and marks[lo] <= GLUE and letter[lo - 1]:
            lo -= 1
        while (marks[hi + 1] <= GLUE or marks[hi + 1] == COMMA and hi == lo) and (sure[hi + 1] or big[hi + 1] and big[i]):
            hi += 1
            if sure[hi]:
                last = hi
        if last > lo and sum(inside[lo : last + 1]) * 2 >= last + 1 - lo and len(set(big[lo : last + 1])) == 1:
            y[lo : last + 1] = True
        else:
            last = lo
            doubt[lo] = big[lo]
        if marks[last + 1] <= GLUE and big[last] and big[last + 1]:
            doubt[last + 1] = True
        k += 1
        while k < len(at) and at[k] <= last:
            k += 1
    return y, doubt & ~y


def listed(part: str, n: int, held: int) -> bool:
    """Whether a part belongs to the lexicon: it stands in two names or more, and not mostly as another word.

    ``held`` is the number of texts that hold it. Of the parts of seeds, which are but few of the names, those with a
    capital have 0. Of those that a model finds it has all: in a large corpus any word beside a name is found twice.
    """
    return n >= 2 and len(part) > 1 and held <= 2 * n


def lexicon_of(parts: Iterable[str]) -> np.ndarray:
    out = np.zeros(BUCKETS, np.bool_)
    out[[_part(p) for p in parts]] = True
    return out


def _parts(name: str) -> list[str]:
    """Words of a name of one case; capitals throughout count as first capitals."""
    return _one_case(_WORD.findall(name))


def _one_case(words: list[str]) -> list[str]:
    if len({w[0].islower() for w in words}) != 1:
        return []
    return [w if w[0].islower() else w[0] + w[1:].lower() for w in words]


class Block(Layout):
    """The words of many texts as numbers of a vocabulary of their own."""

    def __init__(self, texts: Sequence[str]):
        self.words: dict[str, int] = _Numbers()
        super().__init__(texts, self.words, _Gaps())

    def pack(self) -> bytes:
        """Without places."""
        flags = (self.marks | self.tight * 8).astype(np.uint8)
        return _packed(list(self.words), self.ids.astype(np.int32), flags, np.array(self.counts, np.int32))

    @classmethod
    def unpack(cls, data: bytes) -> Block:
        block = cls.__new__(cls)
        words, ids, flags, counts = _unpacked(data)
        block.words, block.ids, block.marks, block.tight, block.counts = words, ids.astype(np.int64), (flags & 7).astype(np.int64), flags > 7, counts.tolist()
        return block


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _packed(*values) -> bytes:
    raw = pickle.dumps(values, pickle.HIGHEST_PROTOCOL)
    return pickle.dumps((len(raw), pa.compress(raw, "zstd", asbytes=True)))


def _unpacked(data: bytes) -> tuple:
    size, raw = pickle.loads(data)
    return pickle.loads(pa.decompress(raw, size, "zstd", asbytes=True))


def blocks(texts: Iterable[str]) -> Iterator[list[str]]:
    """Texts in lists of ``BLOCK`` characters, a longer one by itself."""
    held, n = [], 0
    for text in texts:
        held.append(text)
        n += len(text)
        if n >= BLOCK:
            yield held
            held, n = [], 0
    if held:
        yield held


def census(texts: Sequence[str], block: Block) -> tuple[Counter, Counter, Counter]:
    """Texts that hold each part in a seed, each word in small letters outside of mailboxes, and each word with a capital;
    ``block`` has the texts' words."""
    words = list(block.words)
    at = np.repeat(np.arange(len(texts)), block.counts)
    titled = np.zeros(len(texts), np.bool_)
    titled[at[np.array([bool(_TITLE.fullmatch(w)) for w in words], np.bool_)[block.ids]]] = True
    boxed = np.array(["@" in text for text in texts], np.bool_)
    small = np.array([w[0].islower() for w in words], np.bool_)[block.ids]
    lower: Counter = Counter()
    capital: Counter = Counter()
    for use, total in ((small & ~boxed[at], lower), (~small, capital)):
        held = np.bincount(np.unique(at[use] * len(words) + block.ids[use]) % len(words), minlength=len(words)).tolist()
        total.update({w: n for w, n in zip(words, held) if n})
    for word in [w for w in capital if w[1:] != w[1:].lower()]:  # as in ``_one_case``
        capital[word[0] + word[1:].lower()] += capital.pop(word)
    parts: Counter = Counter()
    for text, title, box in zip(texts, titled.tolist(), boxed.tolist()):
        parts.update({w for s in seeds(text, title) for w in _parts(s)})
        if box:
            lower.update({w for w in set(_WORD.findall(_BOX.sub(" ", text))) if w[0].islower()})
    return parts, lower, capital


def more_parts(block: Block, model: Model) -> Counter:
    """Parts of the names that a model finds, if one of the parts is known."""
    more: Counter = Counter()
    words = list(block.words)
    if not len(block.ids):
        return more
    table = np.array([model.describe(w) for w in words], np.float32)
    for run in _runs(block, model.good(block, lambda k: table[:, k])):
        found = _one_case([words[block.ids[i]] for i in run])
        # the first word of a sentence may be another word with a capital, and adds nothing
        if any(map(model.known, found)):
            more.update(found[int(not block.tight[run[0]]) :])
    return more


# Shapes are what an example has besides words: marks on both sides, whether the second word before counts, cases of three
# words, lexicon on three words.
_RADIX = (7, 7, 2, 4, 4, 4, 2, 2, 2)
_NONE = BUCKETS  # no feature


def _shape_features(shapes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of each shape: those of contexts, of cases, of the lexicon, and of the lexicon where it is left out."""
    rows: tuple[list, list, list, list] = ([], [], [], [])
    for m, a, far, before, case, behind, here, back, on in zip(*(x.tolist() for x in np.unravel_index(shapes, _RADIX))):
        rows[0].append((_NONE if m <= COMMA else _CONTEXT["p", m], _NONE if far else _CONTEXT["q", m], _NONE if a <= COMMA else _CONTEXT["f", a]))
        rows[1].append((_CASES["before", m, before], _CASES["behind", a, behind], _CASES["start", m, case]))
        rows[2].append((_LEX if here else _NONE, _CASES["lexb", m, back], _CASES["lexf", a, on]))
        rows[3].append((_CASES["lexb", m, 0], _CASES["lexf", a, 0]))
    return tuple(np.array(r, np.int64).reshape(len(shapes), -1) for r in rows)


class Examples:
    """Examples of many blocks; equal ones are one with their number. Word 0 is none."""

    _KEYS = ("w", "p", "q", "f", "s")

    def __init__(self, lexicon: np.ndarray):
        self.model = Model(lexicon=lexicon)
        self._clear()

    def _clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.features: list[tuple] = []  # of each word: hashed ones, case, whether the lexicon has it
        self.tables: list[pa.Table] = []
        self.settled = self.rows = 0

    def _number(self, word: str) -> int:
        n = self.numbers.get(word)
        if n is None:
            own, p, q, f, case = word_features(word)
            self.features.append(((*own, p, q, f), case, self.model.known(word)))
            n = self.numbers[word] = len(self.features)
        return n

    def add(self, block: Block) -> None:
        numbers = [self._number(w) for w in block.words]
        lex = np.array([self.features[n - 1][2] for n in numbers], np.bool_)[block.ids]
        block.settle(np.array([self.features[n - 1][1] for n in numbers], np.int64))
        ids, m, a = np.array(numbers, np.int64)[block.ids], block.marks, block.after
        y, doubt = _label(block, lex)
        near, ahead = m <= COMMA, a <= COMMA
        far = near & (np.r_[LINE, m[:-1]][: len(m)] <= COMMA)
        earlier = lambda x, k: np.concatenate([np.zeros(k, x.dtype), x])[: len(x)]
        later = lambda x: np.append(x[1:], np.zeros(1, x.dtype))[: len(x)]
        shape = np.ravel_multi_index((m, a, far, block.case_before, block.case, block.case_behind, lex, near & earlier(lex, 1), ahead & later(lex)), _RADIX)
        before, behind = earlier(y, 1), later(y)
        before[block.first] = behind[block.last] = False
        full = y | (block.case != LOWER) | lex | before | behind
        columns = (ids, earlier(ids, 1) * near, earlier(ids, 2) * far, later(ids) * ahead, (shape * 2 + y) * 2 + full)
        table = pa.table([pa.array(c[~doubt], pa.int32()) for c in columns], list(self._KEYS))
        self._hold(table.append_column("n", pa.array(np.ones(len(table), np.int64))))
        if self.rows > 2 * max(self.settled, HELD // 4):
            self._settle()

    def _hold(self, table: pa.Table) -> None:
        self.tables.append(table.group_by(list(self._KEYS), use_threads=False).aggregate([("n", "sum")]).rename_columns([*self._KEYS, "n"]))
        self.rows += len(self.tables[-1])

    def _settle(self) -> None:
        table, self.tables, self.rows = pa.concat_tables(self.tables), [], 0
        self._hold(table)
        self.settled = self.rows

    def pack(self) -> bytes:
        """What is held, for ``gradient``."""
        self._settle()
        table = self.tables[0]
        code = table["s"].to_numpy()
        weight = table["n"].to_numpy() * np.where(code & 1, 1.0, FAR)
        shapes, shape = np.unique(code >> 2, return_inverse=True)
        columns = [table[c].to_numpy() for c in "wpqf"]
        hashed = np.array([f[0] for f in self.features], np.int32).reshape(-1, 7)
        self._clear()
        return _packed(hashed, _shape_features(shapes), *columns, shape.astype(np.int32), (code >> 1 & 1).astype(np.bool_), weight)


def examples(coded: Iterable[bytes], lexicon: np.ndarray) -> Iterator[bytes]:
    """The examples of packed blocks, packed for ``gradient``."""
    held = Examples(lexicon)
    for data in coded:
        held.add(Block.unpack(data))
        if held.settled > HELD:
            yield held.pack()
    if held.tables:
        yield held.pack()


def gradient(data: bytes, w: np.ndarray) -> np.ndarray:
    """Sum of the gradients of packed examples at weights ``w`` of ``BUCKETS + 1`` numbers, the last of which is zero.

    Each example has two more views: without identity and lexicon, and without the words around it either.
    """
    hashed, (contexts, cases, lexical, blank), word, p, q, f, shape, y, weight = _unpacked(data)
    n, k = len(hashed) + 1, len(cases)
    own, other = hashed[:, 0], hashed[:, 1:4]
    pad = lambda x: np.append(0.0, x)
    form = pad(w[other].sum(axis=1))[word] + (w[cases].sum(axis=1) + w[blank].sum(axis=1))[shape]
    around = pad(w[hashed[:, 4]])[p] + pad(w[hashed[:, 5]])[q] + pad(w[hashed[:, 6]])[f] + w[contexts].sum(axis=1)[shape]
    blind = form + around
    full = blind + pad(w[own])[word] + (w[lexical].sum(axis=1) - w[blank].sum(axis=1))[shape]
    full, blind, form = (weight * (1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - y) for z in (full, blind, form))
    around, less = full + blind, blind + form
    whole = full + less
    of_word = lambda index, err: np.bincount(index, err, n)[1:]
    of_shape = lambda err: np.bincount(shape, err, k)[:, None]
    sums = [
        (own, of_word(word, full)), (other, of_word(word, whole)[:, None]),
        (hashed[:, 4], of_word(p, around)), (hashed[:, 5], of_word(q, around)), (hashed[:, 6], of_word(f, around)),
        (contexts, of_shape(around)), (cases, of_shape(whole)), (lexical, of_shape(full)), (blank, of_shape(less)),
    ]
    index = np.concatenate([i.ravel() for i, _ in sums])
    return np.bincount(index, np.concatenate([np.broadcast_to(g, i.shape).ravel() for i, g in sums]), BUCKETS + 1)


def descend(gradient_at: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Weights after ``PASSES`` steps over all examples, whose gradient at given weights is asked for."""
    w = np.zeros(BUCKETS + 1, np.float64)
    speed = np.full(BUCKETS + 1, 1e-3)
    for _ in range(PASSES):
        grad = gradient_at(w) + 0.05 * w
        grad[BUCKETS] = 0.0
        speed += grad * grad
        w -= 0.5 * grad / np.sqrt(speed)
        w[BUCKETS] = 0.0
    return w[:BUCKETS].astype(np.float32)


def fit(texts: Sequence[str]) -> Model:
    """A model from unlabelled texts; without seeds it finds nothing."""
    parts: Counter = Counter()
    lower: Counter = Counter()
    capital: Counter = Counter()
    coded = []
    for held in blocks(texts):
        block = Block(held)
        for total, own in zip((parts, lower, capital), census(held, block)):
            total.update(own)
        coded.append(block.pack())
    if not parts:
        return Model()
    lexicon = lexicon_of(p for p, n in parts.items() if listed(p, n, lower[p]))
    for again in range(2):
        packed = list(examples(coded, lexicon))
        model = Model(descend(lambda w: sum(gradient(x, w) for x in packed)), lexicon)
        if not again:
            more: Counter = Counter()
            for b in coded:
                more.update(more_parts(Block.unpack(b), model))
            lexicon = lexicon | lexicon_of(p for p, n in more.items() if listed(p, n, lower[p] + capital[p]))
    return model
