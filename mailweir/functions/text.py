"""Text functions. Built-in expressions where Spark has them; Arrow functions for Unicode forms, which it lacks."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Patterns that decide equal results.
URL = r"(?i)\b(?:https?://|www\.)[^\s<>\"']+"
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
SPACED_URL = (
    r"(?i)\b(?:hxxps?|https?)\s*:\s*/\s*/\s*[a-z0-9-]+(?:\s*\.\s*[a-z0-9-]+)+(?:\s*/\s*[a-z0-9._~!$&()*+=:@%-]+)*"
    r"|\bwww\s*\.\s*[a-z0-9-]+(?:\s*\.\s*[a-z0-9-]+)+(?:\s*/\s*[a-z0-9._~!$&()*+=:@%-]+)*"
)
SPACED_EMAIL = r"(?i)\b[A-Z0-9._%+-]+\s*@\s*[A-Z0-9.-]+(?:\s*\.\s*[A-Z]{2,})\b"
URL_TAIL = ".,;:!?)]}>"
SUBJECT_PREFIXES = ("Subject", "Chủ đề", "Tiêu đề")

_BLANK = re.compile(r"\s+")


def _per_value(fn):
    @F.arrow_udf(StringType())
    def run(col: pa.Array) -> pa.Array:
        return pa.array([None if v is None else fn(v) for v in col.to_pylist()], pa.string())

    return run


def _collapse(v: str) -> str:
    return _BLANK.sub(" ", v).strip()


_NFC = _per_value(lambda v: _collapse(unicodedata.normalize("NFC", v)))
_NFKC = _per_value(lambda v: _collapse(unicodedata.normalize("NFKC", v)))
_FOLD = _per_value(lambda v: _collapse(unicodedata.normalize("NFKC", v)).casefold())


def _strip(v: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", v) if not unicodedata.combining(c))


_PLAIN = _per_value(_strip)
_PLAIN_D = _per_value(lambda v: _strip(v).replace("đ", "d"))
_PLAIN_DD = _per_value(lambda v: _strip(v).replace("đ", "d").replace("Đ", "D"))
_IS_NFC_TEXT = _per_value(lambda v: "1" if unicodedata.is_normalized("NFC", v) else "0")


def normalize_text(col: Column, form: str = "NFC") -> Column:
    """Null becomes empty; Unicode form; all Unicode white space collapsed to one blank and trimmed."""
    col = F.coalesce(col, F.lit(""))
    return {"NFC": _NFC, "NFKC": _NFKC}[form](col)


def fold_text(col: Column) -> Column:
    """NFKC, collapsed, case folded; null becomes empty."""
    return _FOLD(F.coalesce(col, F.lit("")))


def strip_accents(col: Column, stroke: str = "none") -> Column:
    """Without combining marks. ``stroke``: "none" keeps d with stroke, "lower" maps the small one, "both" maps both."""
    return {"none": _PLAIN, "lower": _PLAIN_D, "both": _PLAIN_DD}[stroke](col)


def is_nfc(col: Column) -> Column:
    return _IS_NFC_TEXT(col) == "1"


def mask(col: Column) -> Column:
    """Pages and mailboxes replaced by one word each."""
    return F.regexp_replace(F.regexp_replace(col, URL, " <url> "), EMAIL, " <email> ")


def mask_spaced(col: Column) -> Column:
    """Plain pages and mailboxes first, then those written with blanks or a defused scheme."""
    return F.regexp_replace(F.regexp_replace(_blanks(mask(col)), SPACED_URL, " <url> "), SPACED_EMAIL, " <email> ")


def _blanks(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def duplicate_text(subject: Column, body: Column, template: bool = False, spaced: bool = False) -> Column:
    """Text whose equality means "same message": subject, line feed, body; folded; as a template with masks."""
    text = fold_text(F.concat_ws("\n", F.coalesce(subject, F.lit("")), F.coalesce(body, F.lit(""))))
    if template:
        text = _blanks(mask_spaced(text) if spaced else mask(text))
    return text


def content_hash(subject: Column, body: Column) -> Column:
    return F.sha2(duplicate_text(subject, body), 256)


def template_hash(subject: Column, body: Column, spaced: bool = False) -> Column:
    return F.sha2(duplicate_text(subject, body, True, spaced), 256)


def comparison_text(subject: Column, body: Column) -> Column:
    """The second, separate family of keys: NFKC, lower case (not folded), pages up to the next blank."""
    low = F.lower(normalize_text(F.concat_ws("\n", F.coalesce(subject, F.lit("")), F.coalesce(body, F.lit(""))), "NFKC"))
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(low, r"(?:https?://|www\.)\S+", "<url>"), EMAIL, "<email>"), r"\s+", " "))


def stable_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 20))


def mail_fingerprint(sender: Column, receiver: Column, cc: Column, subject: Column, body: Column, sent_at: Column) -> Column:
    """Digest of the six fields as canonical JSON (sorted keys), each normalised."""
    named = {"body": body, "cc": cc, "receiver": receiver, "sender": sender, "sent_at": sent_at, "subject": subject}
    return F.sha2(F.to_json(F.struct(*[normalize_text(c.cast("string")).alias(n) for n, c in sorted(named.items())])), 256)


def relaxed_template(body: Column) -> Column:
    """Template of a body alone, with spaced pages and mailboxes masked too."""
    return duplicate_text(F.lit(""), body, True, True)


def column_name(name: str) -> str:
    """Plain name of a column: lower case, one underscore for each run of other characters than letters and digits."""
    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")


def row_key(*parts: Column) -> Column:
    """Digest that names a row by its content."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def config_fingerprint(config: dict) -> str:
    """Digest of a configuration, whatever the order of its keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def excerpt(col: Column, n: int) -> Column:
    """Collapsed; cut to ``n`` characters, the last an ellipsis."""
    c = F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), r"\s+", " "))
    return F.when(F.length(c) > n, F.concat(F.rtrim(F.substring(c, 1, n - 1)), F.lit("…"))).otherwise(c)


def report_safe(col: Column, n: int) -> Column:
    """Excerpt that no spreadsheet takes for a formula."""
    c = excerpt(col, n)
    return F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def token_count(col: Column) -> Column:
    return F.regexp_count(F.coalesce(col, F.lit("")), F.lit(r"\S+"))


def length_bucket(tokens: Column, short: int = 50, medium: int = 150) -> Column:
    return F.when(tokens < short, "short").when(tokens <= medium, "medium").otherwise("long")


def low_information(col: Column, least_chars: int = 30, least_tokens: int = 5) -> Column:
    c = F.coalesce(col, F.lit(""))
    return (F.length(c) < least_chars) | (F.regexp_count(c, F.lit(r"(?U)\w+")) < least_tokens)


def display_timestamp(col: Column) -> Column:
    """Minutes of an ISO time; blank as a dash; what cannot be read stays."""
    c = F.trim(col)
    iso = F.date_format(F.try_to_timestamp(c), "yyyy-MM-dd HH:mm")
    return F.when(c.isNull() | (c == ""), "—").otherwise(F.coalesce(iso, c))


def prefixed_subject(col: Column, prefixes: tuple[str, ...] = SUBJECT_PREFIXES) -> Column:
    """struct(subject, body) of a text that begins "Prefix: subject", with the body on later lines; else ("", text)."""
    pattern = rf"(?is)^\s*(?:{'|'.join(prefixes)})\s*:[ \t]*([^\n]*\S)[ \t]*\n\s*(\S.*)$"
    hit = col.rlike(pattern)
    subject = F.when(hit, F.trim(F.regexp_extract(col, pattern, 1))).otherwise("")
    return F.struct(subject.alias("subject"), F.when(hit, F.rtrim(F.regexp_extract(col, pattern, 2))).otherwise(col).alias("body"))


def flag_yes(col: Column) -> Column:
    """True for true, 1, yes, y."""
    return F.lower(F.trim(col)).isin("true", "1", "yes", "y")


def flag_eligible(col: Column) -> Column:
    """True for 1, true, yes, eligible: observably another rule than ``flag_yes``."""
    return F.lower(F.trim(col)).isin("1", "true", "yes", "eligible")
