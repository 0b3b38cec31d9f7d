"""Personal information inside free text (problem 10).

Finding, over the consistent form of whole texts:

* mailboxes around each at-sign, plain or disguised (blanks, "[at]", "(dot)");
* numbers in one scan for runs of digits with single marks between them; a run is an identity or telephone number if its
  whole form fits and its parts are valid (``pseudonym``), unless the word before it announces another number;
* addresses from a house number on, in English, Vietnamese and French order, and from the street on in German and Spanish;
* full names by a model fitted on the whole corpus (``names``).

Spans already taken are kept in order and looked up by bisection, so the time is linear in the length of the text but
for a logarithm.

Replacing: typed placeholders. Numbers, and dates of birth, carry a format-preserving keyed pseudonym of their canonical
value (``pseudonym``), so equal values stay linked across documents and spellings; other kinds carry a keyed tag. Other
dates are no personal information and stay. Null and empty texts have no values; null stays null.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailweir.llm import names, pseudonym
from mailweir.llm.canonical import canonical, settle
from mailweir.llm.lookalike import unstable_segments
from mailweir.session import cut, spread

# Words that come before identity numbers, and before numbers that are no personal information.
ID_CUES = (
    "passport", "social security", "ssn", "id no", "id number", "identity", "national insurance", "cccd", "cmnd", "căn cước", "can cuoc",
    "hộ chiếu", "ho chieu", "định danh", "dinh danh", "chứng minh", "chung minh", "passeport", "sécurité sociale", "pasaporte", "dni", "nie",
    "reisepass", "ausweis", "personalausweis", "sozialversicherung", "seguridad social", "carte d'identité",
)
OTHER_CUES = (
    "serial", "invoice", "tracking", "meeting code", "code", "batch", "firmware", "version", "voucher", "order", "job", "request", "case",
    "mã vận đơn", "ma van don", "hóa đơn", "hoa don", "mã đơn", "mã số đơn", "mã", "ma", "facture", "factura", "rechnung", "vorgang", "dossier", "expediente",
    "reference", "line", "isbn", "iban", "account no", "số tài khoản", "numéro de suivi", "sendungsnummer", "seriennummer", "phiên bản", "số sê-ri",
)
PHONE_CUES = ("phone", "tel", "telephone", "mobile", "mob", "cell", "call", "fax", "đt", "sđt", "điện thoại", "gọi", "hotline", "m", "t")
BIRTH_CUES = ("born", "birth", "dob", "birthday", "sinh ngày", "sinh", "ngày sinh", "né le", "née le", "geboren", "geburtsdatum", "nacido", "nacida", "nacimiento")
STREETS = r"(?:Street|St\.?|Road|Rd\.?|Lane|Ln\.?|Way|Close|Avenue|Ave\.?|Drive|Dr\.?|Court|Ct\.?|Place|Pl\.?|Boulevard|Blvd\.?|Square|Sq\.?|Terrace|Hill|Row|Crescent|Gardens?|Park|Walk|Mews|Quay)"

#: Capital letters of the scripts that addresses are written in, as a class of ``re``.
_UPPER = "".join(chr(o) for o in range(0x2000) if unicodedata.category(chr(o)) == "Lu")
_L = r"[^\W\d_]"
_U = f"[{_UPPER}]"

# mailboxes
_PLAIN_DOMAIN = re.compile(rf"[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)*\.{_L}{{2,}}(?![\w@])")
_DOT = r"(?:\.|\s\.\s|\s?[\[({]\s?dot\s?[\])}]\s?)"
_SIGN = re.compile(r"@|[\[({]\s?[aA][tT]\s?[\])}]")
_SPACED_LOCAL = re.compile(rf"[^\W_][\w%+-]*(?:{_DOT}[\w%+-]+)*\Z", re.I)
_SPACED_DOMAIN = re.compile(rf"[^\W_][\w-]*(?:{_DOT}[^\W_][\w-]*)*{_DOT}{_L}{{2,}}(?![\w@])", re.I)
_SPACED_DOT_BEFORE = re.compile(r"(?:\s\.\s|[\])}]\s?)\Z")
_URL = re.compile(r"[hHfFwW](?:(?<=[hH])(?:[tT]{2}|[xX]{2})[pP][sS]?\s?:\s?/\s?/\s?\S+(?:\s?/\s?\S+)*|(?<=[fF])[tT][pP]\s?:\s?/\s?/\s?\S+(?:\s?/\s?\S+)*|(?<=[wW])[wW]{2}\.\S+)")

# numbers
_DIGIT = re.compile(r"\d")
_CHUNK = re.compile(r"\d+(?:\)?[ .-]?\(?\d+)*")
_SOCIAL = re.compile(r"\d{3}([ -])\d{2}\1\d{4}")
_CITIZEN = re.compile(r"0\d{2}(?: \d{3}){3}|0\d{11}")
_INSURANCE = re.compile(r"(?<![\w#@/=.+-])[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?![\w@])")
_LETTERED = re.compile(r"(?<![\w#@/=.+-])[A-Z]{1,3} ?\d{5,10}[A-Z]?(?![\w@]|[-./]\d)")
_PHONES = re.compile(
    r"\(?(?:\+|00) ?84\)?[ .-]?(?:\(0\))?\d{2,3}(?:[ .-]?\d{3,4}){2}"
    r"|\(?\+ ?1\)?[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}"
    r"|1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]\d{4}"
    r"|\+ ?\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,5}"
    r"|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}"
    r"|\d{3}([ .-])\d{3}\1\d{4}"
    r"|0\d{2,3}([ .-])\d{3,4}\2\d{3,4}"
    r"|0084(?:[ .-]?\d{2,4}){3}"
    r"|0\d{9,10}"
)
_LOCAL_PHONE = re.compile(r"\d{3,4}[ .-]\d{3,4}(?:[ .-]\d{3,4})?")
_OTHER_BEFORE = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, OTHER_CUES))})(?:\s+(?:number|no\.?|code|số|so|id|is|n°))?\s*[:#]?\s*\Z", re.I)
_PHONE_BEFORE = re.compile(rf"\b(?:{'|'.join(map(re.escape, PHONE_CUES))})\b[.:]?\s*\Z", re.I)
_ID_BEFORE = re.compile(rf"\b(?:{'|'.join(map(re.escape, ID_CUES))})\b[^\d\n.;]*(?:(?:no|nº|n°|num)\.[^\d\n.;]*)?\Z", re.I)
_BIRTH_BEFORE = re.compile(rf"\b(?:{'|'.join(map(re.escape, BIRTH_CUES))})\b[^\d\n.;]*\Z", re.I)

# addresses
_CAP = rf"{_U}[\w'’]*(?:-{_U}[\w'’]*)*"
_ENGLISH = re.compile(
    rf"\d{{1,5}}{_U}?(?: {_CAP}){{1,3}}? {STREETS}(?!{_L})(?:,? (?:(?:Apt|Apartment|Flat|Unit|Suite|Room|Floor)\.? \d+{_L}?|\# ?\d+{_L}?))?"
    rf"(?:, {_CAP}(?: {_CAP}){{0,2}}(?:, {_U}{{2}}(?= \d))?(?:,? \d{{4,6}}(?!\d))?)?"
)
_PLACE = rf"{_U}{_L}*(?: {_U}{_L}*){{0,3}}"
_VIETNAMESE = re.compile(
    rf"\d{{1,5}}(?:/\d{{1,4}})*{_U}?(?: (?:ngõ|ngo|ngách|ngach|hẻm|hem|kiệt|kiet) \d+(?:/\d+)*,?)?(?: (?:đường|duong|phố|pho|Đường|Phố))? {_PLACE}"
    rf"(?:, (?:(?:phường|phuong|xã|xa|thị trấn|thi tran|quận|quan|huyện|huyen|thành phố|thanh pho|tỉnh|tinh|thị xã|thi xa|P\.|Q\.|H\.|X\.|TP\.?|TX\.|T\.) ?)?{_PLACE}){{1,4}}(?: \d{{5,6}}(?!\d))?"
)
_VIETNAMESE_MARK = re.compile(r"đường|duong|phố|pho\b|ngõ|ngo |ngách|hẻm|phường|phuong|xã |\bxa |P\. ?|TP\.|quận|huyện|tỉnh|tinh |thành phố|thanh pho")
_FRENCH = re.compile(rf"\d{{1,4}}(?: ?(?:bis|ter))?,? (?:rue|avenue|boulevard|place|chemin|quai|impasse|allée)(?: (?:de la|de l'|du|des|de|d'|le|la|les))? ?{_U}[\w'’-]*(?: (?:de|du|la|le|des|{_CAP}))*(?:, \d{{5}} {_CAP}(?: {_CAP})*)?")
_GERMAN = re.compile(rf"{_U}{_L}*(?:straße|strasse|str\.|weg|platz|allee|gasse) \d{{1,4}}{_L}?(?:, \d{{5}} {_CAP}(?: {_CAP})*)?")
_SPANISH = re.compile(rf"(?:Calle|Avenida|Avda\.|Plaza|Paseo|Camino)(?: (?:de la|de los|de las|del|de|la|el))? {_CAP}(?: (?:de|del|la|{_CAP}))*,? (?:n[.º°]+ ?)?\d{{1,4}}(?:, \d{{5}} {_CAP}(?: {_CAP})*)?")
_HOUSE = re.compile(rf"\d{{1,5}}(?=(?:/\d{{1,4}})*{_U}?,? (?:{_U}|ng|h[ẻe]m|ki[ệe]t|đường|duong|ph[ốo]|rue|avenue|boul|place|chemin|quai|impasse|allée|bis|ter))")
_STREET_WORDS = ("stra", "str.", "weg ", "platz ", "llee ", "gasse ", "Calle ", "Avenida ", "Avda.", "Plaza ", "Paseo ", "Camino ")
_STREET_FIRST = re.compile(rf"(?<!\w)(?=(?:{_U}{_L}*(?:straße|strasse|str\.|weg|platz|allee|gasse) \d|(?:Calle|Avenida|Avda\.|Plaza|Paseo|Camino) ))")

Span = tuple[int, int, str]


class Spans:
    """Spans that do not overlap, in order."""

    def __init__(self):
        self.begins: list[int] = []
        self.items: list[Span] = []

    def free(self, a: int, b: int) -> bool:
        k = bisect_left(self.begins, b)
        return k == 0 or self.items[k - 1][1] <= a

    def add(self, a: int, b: int, kind: str) -> bool:
        k = bisect_left(self.begins, b)
        if k and self.items[k - 1][1] > a:
            return False
        self.begins.insert(k, a)
        self.items.insert(k, (a, b, kind))
        return True


def _mailboxes(text: str, taken: Spans) -> None:
    low = 0  # a mailbox begins after the one before
    for sign in _SIGN.finditer(text):
        a, b = sign.span()
        a -= a > low and text[a - 1].isspace()
        b += text[b : b + 1].isspace()
        if b - a == 1:
            at = a
            i = at
            while i > low and (text[i - 1].isalnum() or text[i - 1] in "._%+'-"):
                i -= 1
            while i < at and not (text[i].isalnum()):
                i += 1
            hit = _PLAIN_DOMAIN.match(text, b)
            before = text[i - 1] if i else ""
            if hit and i < at and before not in ("@", "/") and not _SPACED_DOT_BEFORE.search(text, max(low, i - 3), i):
                taken.add(i, hit.end(), "email")
                low = hit.end()
                continue
        line = max(low, text.rfind("\n", 0, a) + 1)
        left = _SPACED_LOCAL.search(text[line:a])
        hit = _SPACED_DOMAIN.match(text, b)
        if left and hit:
            begin = line + left.start()
            if begin and (text[begin - 1].isalnum() or text[begin - 1] in "@/.+%"):
                continue
            taken.add(begin, hit.end(), "email")
            low = hit.end()


_ENDS_LEFT = frozenset("\n;!?.0123456789")


def _left_of(text: str, a: int) -> str:
    """The words before a place, back to the last break or digit; "no." and "id." break nothing."""
    lo = a
    while lo > 0:
        c = text[lo - 1]
        if c in _ENDS_LEFT and (c != "." or text[lo : lo + 1] == " " and lo < a and text[max(0, lo - 3) : lo - 1].lower() not in _SHORTENED):
            break
        lo -= 1
    return text[lo:a]


_SHORTENED = (" no", " id", "\nno", "\nid", "no", "id")


def _after_other(left: str) -> bool:
    """Whether the last words announce a number that is no personal information."""
    tail = " ".join(left.split()[-6:])  # no cue has more words
    low = tail.lower()
    return any(map(low.__contains__, OTHER_CUES)) and bool(_OTHER_BEFORE.search(tail))


def _after_id(left: str) -> bool:
    low = left.lower()
    return any(map(low.__contains__, ID_CUES)) and bool(_ID_BEFORE.search(left))


def _lettered(text: str, a: int, taken: Spans, blocked) -> bool:
    """Take the national insurance or passport number whose digits begin at ``a``, behind one to three capitals."""
    i = a - 1 if text[a - 1] == " " else a
    while i > 0 and a - i < 5 and "A" <= text[i - 1] <= "Z":
        i -= 1
    hit = _INSURANCE.match(text, i)
    if hit:
        if not blocked(*hit.span()) and not _after_other(_left_of(text, i)):
            taken.add(*hit.span(), "national_id")
        return True
    hit = _LETTERED.match(text, i)
    if hit and not blocked(*hit.span()) and _after_id(_left_of(text, i)):
        return taken.add(*hit.span(), "national_id")
    return False


def _numbers(text: str, taken: Spans, blocked) -> None:
    n = len(text)
    for m in _CHUNK.finditer(text):
        a, b = m.span()
        if b - a < 5:
            continue
        before = text[a - 1] if a else ""
        if "A" <= before <= "Z" or before == " " and a > 1 and "A" <= text[a - 2] <= "Z":
            if _lettered(text, a, taken, blocked):
                continue
        if b - a < 7:
            continue
        for mark in (" ", "+", "("):  # "(+84", "+ 84", "(095"
            if a and text[a - 1] == mark and (mark != " " or a > 1 and text[a - 2] == "+"):
                a -= 1
        if a and text[a] == "+" and text[a - 1] == "(":
            a -= 1
        value = text[a:b]
        before, after = text[a - 1] if a else "", text[b] if b < n else ""
        if before and (before.isalnum() or before in "_#@/=.,+-") or after and (after.isalnum() or after in "_@" or after in "-./" and text[b + 1 : b + 2].isdigit()):
            continue
        digits = "".join(filter(str.isdigit, value))
        if not 6 <= len(digits) <= 15 or blocked(a, b):
            continue
        left = _left_of(text, a)
        if _SOCIAL.fullmatch(value) or _CITIZEN.fullmatch(value):
            if not _after_other(left) and (pseudonym.valid_social(digits) or pseudonym.valid_citizen(digits)):
                taken.add(a, b, "national_id")
                continue
        if len(digits) <= 14 and value[0] not in "+(" and _after_id(left) and not _after_other(left):
            if not _SOCIAL.fullmatch(value) or pseudonym.valid_social(digits):
                taken.add(a, b, "national_id")
            continue
        if _PHONES.fullmatch(value) and len(digits) >= 9:
            if not _after_other(left) and pseudonym.valid_phone(value):
                taken.add(a, b, "phone")
        elif len(digits) >= 7 and _LOCAL_PHONE.fullmatch(value) and digits.strip("0") and _PHONE_BEFORE.search(left):
            taken.add(a, b, "phone")


def _addresses(text: str, taken: Spans, blocked) -> None:
    for m in _HOUSE.finditer(text):
        a = m.start()
        if a and (text[a - 1].isalnum() or text[a - 1] in "_#/.-"):
            continue
        hit = _ENGLISH.match(text, a)
        if not hit:
            hit = _VIETNAMESE.match(text, a)
            if hit and not _VIETNAMESE_MARK.search(hit.group()):
                hit = None
            if hit and text[max(0, a - 3) : a] in ("Số ", "số ", "So ", "so ") and not text[max(0, a - 4) : a - 3].isalpha():
                a -= 3
            elif not hit:
                hit = _FRENCH.match(text, a)
        if hit and not blocked(a, hit.end()):
            taken.add(a, hit.end(), "address")
    for m in _STREET_FIRST.finditer(text) if any(w in text for w in _STREET_WORDS) else ():
        hit = _GERMAN.match(text, m.start()) or _SPANISH.match(text, m.start())
        if hit and not blocked(*hit.span()):
            taken.add(*hit.span(), "address")


def _fixed_spans(text: str, dates: bool) -> Spans:
    """All kinds but names, in the consistent form."""
    taken = Spans()
    if "@" in text or "at" in text and ("[" in text or "(" in text or "{" in text):
        _mailboxes(text, taken)
    urls = [m.span() for m in _URL.finditer(text)] if ":/" in text or ": /" in text or "www." in text or "WWW." in text else []
    ends = [y for _, y in urls]

    def blocked(a: int, b: int) -> bool:
        k = bisect_left(ends, a + 1)
        return k < len(urls) and urls[k][0] < b or not taken.free(a, b)

    if _DIGIT.search(text):
        _addresses(text, taken, blocked)
        if dates:
            for m in pseudonym.DATE.finditer(text):
                if not blocked(*m.span()) and pseudonym.read_date(m.group()) and _BIRTH_BEFORE.search(_left_of(text, m.start())):
                    taken.add(*m.span(), "date")
        _numbers(text, taken, blocked)
    taken.blocked = blocked
    return taken


class _Form:
    """Consistent form of a text, with the way back from its places to those of the text."""

    def __init__(self, text: str):
        self.plain = canonical(text)
        self.begins: list[int] | None = None
        if self.plain is text or self.plain == text:
            return
        pieces: list[str] = []
        begins: list[int] = []
        ends: list[int] = []
        at = 0
        for a, b in [*unstable_segments(text), (len(text), len(text))]:
            pieces.append(text[at:a])
            begins.extend(range(at, a))
            ends.extend(range(at + 1, a + 1))
            lo = a
            for i in range(a + 1, b + 1):  # one character with the marks that sit on it
                if i == b or not unicodedata.category(text[i]).startswith("M"):
                    piece = settle(text[lo:i])
                    pieces.append(piece)
                    begins.extend([lo] * len(piece))
                    ends.extend([i] * len(piece))
                    lo = i
            at = b
        self.plain, self.begins, self.ends = "".join(pieces), begins, ends

    def back(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.begins is None else (self.begins[a], self.ends[b - 1])


def find_all(texts: Sequence[str | None], model: names.Model, dates: bool = False) -> list[list[Span]]:
    """Non-overlapping (begin, end, kind) of each text, in reading order."""
    forms = [_Form(t) if t else None for t in texts]
    live = [f for f in forms if f is not None]
    found = iter(model.find([f.plain for f in live]))
    out: list[list[Span]] = []
    for f in forms:
        if f is None:
            out.append([])
            continue
        taken = _fixed_spans(f.plain, dates)
        for a, b in next(found):
            if not taken.blocked(a, b):
                taken.add(a, b, "person")
        out.append([(*f.back(a, b), kind) for a, b, kind in taken.items])
    return out


def find_spans(text: str | None, model: names.Model | None = None, dates: bool = False) -> list[Span]:
    return find_all([text], model or names.Model(), dates)[0]


def _coded(documents: DataFrame) -> DataFrame:
    """Blocks of coded words of all texts; beside them (word, and the counts of ``names.census``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = (canonical(t) for batch in batches for t in batch.column(0).to_pylist())
        for held in names.blocks(texts):
            block = names.Block(held)
            counts = names.census(held, block)
            words = list(dict.fromkeys(w for c in counts for w in c))
            columns = [[None, *words], *([0, *(c[w] for w in words)] for c in counts), [block.pack(), *[None] * len(words)]]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["word", "n", "lower", "capital", "block"])

    return spread(documents.filter("text is not null and text <> ''").select("text")).mapInArrow(run, "word string, n long, lower long, capital long, block binary")


def _lexicon(counts: DataFrame) -> np.ndarray:
    """Lexicon of the (word, n, held) whose sums over the whole corpus suffice (``names.listed``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets = np.flatnonzero(names.lexicon_of(w for w, n, held in zip(*(c.to_pylist() for c in batch.columns)) if names.listed(w, n, held)))
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32())], ["bucket"])

    words = counts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("held").alias("held")).filter("n > 0")
    out = np.zeros(names.BUCKETS, np.bool_)
    out[[r[0] for r in words.mapInArrow(run, "bucket int").distinct().collect()]] = True  # at most one row a bucket
    return out


def _blocks(df: DataFrame, tasks: int) -> RDD:
    """The packed blocks of ``df``, a few at a time in Python. Coalesced before Python, which would else have them twice."""
    return df.filter("block is not null").select("block").coalesce(tasks).rdd.map(lambda r: bytes(r[0]))


def _descended(packed: DataFrame, tasks: int) -> np.ndarray:
    """Weights of a fit over all packed examples: one job a pass, which sums the gradients of all blocks."""
    sc, rdd = packed.sparkSession.sparkContext, _blocks(packed, tasks)
    depth = 1 if tasks <= 32 else 2

    def gradient_at(w: np.ndarray) -> np.ndarray:
        shared = sc.broadcast(w)

        def run(blocks: Iterator[bytes]) -> Iterator[np.ndarray]:
            total = np.zeros(names.BUCKETS + 1)
            for block in blocks:
                total += names.gradient(block, shared.value)
            yield total

        total = rdd.mapPartitions(run).treeReduce(np.add, depth)
        shared.destroy()
        return total

    return names.descend(gradient_at)


def fitted(documents: DataFrame) -> names.Model:
    """The model of ``names.fit``, fitted on all texts in the cluster."""
    spark = documents.sparkSession
    coded = cut(_coded(documents))
    counts = coded.filter("word is not null")
    model = names.Model(lexicon=_lexicon(counts.selectExpr("word", "n", "lower as held")))
    if not model.lexicon.any():
        return model
    # a task has a fixed cost at each pass: four blocks are worth one, up to the number of cores
    tasks = max(1, min(coded.filter("block is not null").count() // 4, spark.sparkContext.defaultParallelism))
    for again in range(2):
        lexicon = model.lexicon
        packed = _blocks(coded, tasks).mapPartitions(lambda blocks, lexicon=lexicon: ((e,) for e in names.examples(blocks, lexicon)))
        model = names.Model(_descended(cut(spark.createDataFrame(packed, "block binary")), tasks), lexicon)
        if not again:
            state = spark.sparkContext.broadcast((model.weights, model.lexicon))

            def more(blocks: Iterator[bytes], state=state) -> Iterator[tuple[str, int, int]]:
                known = names.Model(*state.value)
                for block in blocks:
                    yield from ((w, n, 0) for w, n in names.more_parts(names.Block.unpack(block), known).items())

            found = spark.createDataFrame(_blocks(coded, tasks).mapPartitions(more), "word string, n long, held long")
            model.lexicon = lexicon | _lexicon(found.unionAll(counts.selectExpr("word", "0L as n", "lower + capital as held")))
    return model


def _shared(documents: DataFrame, model: names.Model | None):
    model = model or fitted(documents)
    return documents.sparkSession.sparkContext.broadcast((model.weights.astype(np.float16), np.packbits(model.lexicon)))  # fixed size: 0.3 MB


def _received(shared) -> names.Model:
    weights, bits = shared.value
    return names.Model(weights.astype(np.float32), np.unpackbits(bits).astype(np.bool_))


_STEP = 2000


def find_pii(documents: DataFrame, model: names.Model | None = None) -> DataFrame:
    """(doc_id, kind, pii_value): each distinct value of each document, as it stands."""
    shared = _shared(documents, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _received(shared)
        for whole in batches:
            for lo in range(0, whole.num_rows, _STEP):
                ids, texts = (c.to_pylist() for c in whole.slice(lo, _STEP).columns)
                out: tuple[list, list, list] = ([], [], [])
                for i, text, spans in zip(ids, texts, find_all(texts, known)):
                    for kind, value in dict.fromkeys((kind, text[a:b]) for a, b, kind in spans):
                        for col, v in zip(out, (i, kind, value)):
                            col.append(v)
                kinds = (pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "kind", "pii_value"])

    return spread(documents.select("doc_id", "text")).mapInArrow(run, "doc_id long, kind string, pii_value string")


def redact_all(texts: Sequence[str | None], key: bytes, model: names.Model) -> list[str | None]:
    out: list[str | None] = []
    for text, spans in zip(texts, find_all(texts, model, dates=True)):
        if not spans:
            out.append(text)
            continue
        pieces, at = [], 0
        for a, b, kind in spans:
            pieces += [text[at:a], pseudonym.placeholder(kind, text[a:b], key)]
            at = b
        out.append("".join(pieces) + text[at:])
    return out


def redact(text: str | None, key: bytes, model: names.Model | None = None) -> str | None:
    """``text`` with every value replaced; all else is kept as it is. Null stays null."""
    return redact_all([text], key, model or names.Model())[0]


def redact_documents(documents: DataFrame, key: str, model: names.Model | None = None) -> DataFrame:
    """(doc_id, text) with placeholders. ``key`` is the secret of the permutation."""
    secret, shared = key.encode(), _shared(documents, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _received(shared)
        for whole in batches:
            for lo in range(0, whole.num_rows, _STEP):
                ids, texts = whole.slice(lo, _STEP).columns
                yield pa.RecordBatch.from_arrays([ids, pa.array(redact_all(texts.to_pylist(), secret, known), pa.string())], ["doc_id", "text"])

    return spread(documents.select("doc_id", "text")).mapInArrow(run, "doc_id long, text string")
