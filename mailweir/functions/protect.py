"""Spans that a rewriting step must keep: masking with placeholders, restoring, and checks of the result."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

# Kinds of protected spans in order of priority.
PATTERNS = (
    ("URL", re.compile(r"(?:https?|hxxps?)://[^\s<>\"']+|www\.[^\s<>\"']+", re.I)),
    ("EMAIL", re.compile(r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}", re.I)),
    ("DATE", re.compile(r"\b\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}\b")),
    ("TIME", re.compile(r"\b\d{1,2}:\d{2}(?::\d{2})?\b")),
    ("AMOUNT", re.compile(r"(?:USD|EUR|VND|[$€£])\s?\d[\d.,]*\d|\d(?:[\d.,]*\d)?\s?(?:USD|EUR|VND|đồng|dollars|%)", re.I)),
    ("CODE", re.compile(r"#\d{3,}|\b(?=[A-Z0-9/-]*\d)(?=[A-Z0-9/-]*[A-Z])[A-Z0-9]+(?:[/-][A-Z0-9]+)*\b")),
    ("NUMBER", re.compile(r"\b\d+(?:[.,]\d+)*\b")),
)
TAIL = ".,;:!?)]}>"


def spans(text: str) -> list[tuple[int, int, str]]:
    """Non-overlapping spans; an earlier kind wins, closing punctuation of pages is left outside."""
    taken: list[tuple[int, int, str]] = []
    for kind, pattern in PATTERNS:
        for m in pattern.finditer(text):
            a, b = m.span()
            if kind == "URL":
                b = a + len(m.group().rstrip(TAIL))
            if b > a and all(b <= x or a >= y for x, y, _ in taken):
                taken.append((a, b, kind))
    return sorted(taken)


def protect(text: str) -> tuple[str, dict[str, str], dict[str, str]]:
    """Masked text, placeholder to value, placeholder to kind. Placeholders do not occur in the text."""
    mark = "ZQ"
    while mark in text:
        mark += "Q"
    out, values, kinds, at = [], {}, {}, 0
    for n, (a, b, kind) in enumerate(spans(text)):
        name = f"{mark}{n}X"
        out += [text[at:a], name]
        values[name], kinds[name], at = text[a:b], kind, b
    return "".join(out) + text[at:], values, kinds


def restore(text: str, values: dict[str, str]) -> str:
    for name in sorted(values, key=len, reverse=True):
        text = text.replace(name, values[name])
    return text


_PROTECTED = StructType([StructField("text", StringType()), StructField("values", MapType(StringType(), StringType())), StructField("kinds", MapType(StringType(), StringType()))])


@F.arrow_udf(_PROTECTED)
def protect_text(col: pa.Array) -> pa.Array:
    rows = [protect(v or "") for v in col.to_pylist()]
    maps = pa.map_(pa.string(), pa.string())
    return pa.StructArray.from_arrays(
        [pa.array([r[0] for r in rows], pa.string()), pa.array([list(r[1].items()) for r in rows], maps), pa.array([list(r[2].items()) for r in rows], maps)], ["text", "values", "kinds"]
    )


@F.arrow_udf(StringType())
def restore_text(text: pa.Array, values: pa.Array) -> pa.Array:
    return pa.array([restore(t or "", dict(v or [])) for t, v in zip(text.to_pylist(), values.to_pylist())], pa.string())


def quality_flags_of(source: str, result: str, low: float = 0.35, high: float = 2.8) -> list[str]:
    """What a rewriting lost: empty, unchanged, changed pages, missing protected values, odd length."""
    flags = []
    if not result.strip():
        return ["empty"] if source.strip() else []
    if source.strip() == result.strip() and len(source.split()) >= 4:
        flags.append("unchanged")
    kept = lambda t, kind: Counter(t[a:b] for a, b, k in spans(t) if k == kind)
    if kept(source, "URL") != kept(result, "URL"):
        flags.append("url_mismatch")
    for kind in ("EMAIL", "DATE", "AMOUNT", "CODE"):
        if kept(source, kind) - kept(result, kind):
            flags.append(f"missing_{kind.lower()}")
    ratio = len(result) / max(1, len(source))
    if not low <= ratio <= high:
        flags.append("length_ratio")
    return flags


@F.arrow_udf(ArrayType(StringType()))
def quality_flags(source: pa.Array, result: pa.Array) -> pa.Array:
    return pa.array([quality_flags_of(a or "", b or "") for a, b in zip(source.to_pylist(), result.to_pylist())], pa.list_(pa.string()))


def occurrences(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of a text in a text."""
    return F.when(F.length(needle) > 0, (F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)).otherwise(0).cast("int")
