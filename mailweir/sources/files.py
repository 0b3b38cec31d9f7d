"""Files as sources and sinks: delimited text of unknown encoding, single mails, guarded optional reads, verified publication."""

from __future__ import annotations

import codecs
import email
import email.policy
import hashlib
import json
import os
import unicodedata
from collections.abc import Callable, Iterator
from email.utils import getaddresses, parseaddr
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from mailweir.sources.tables import require_columns

SUPPORTED = (".csv", ".tsv", ".xlsx", ".xls")
ENCODINGS = ("utf-8-sig", "utf-8", "cp1252", "latin-1")


def discover(root: str) -> list[str]:
    """Supported files under ``root``, sorted; an error if there are none."""
    found = sorted(os.path.join(base, f) for base, _, files in os.walk(root) for f in files if f.lower().endswith(SUPPORTED))
    if not found:
        raise FileNotFoundError(f"no supported file under {root}")
    return found


def probe_encoding(path: str, block: int = 1 << 20) -> str:
    """First encoding that decodes the whole file, read in blocks."""
    for name in ENCODINGS:
        decoder = codecs.getincrementaldecoder(name)()
        try:
            with open(path, "rb") as f:
                while data := f.read(block):
                    decoder.decode(data)
                decoder.decode(b"", final=True)
            if name == "utf-8-sig":
                with open(path, "rb") as f:
                    if f.read(3) != codecs.BOM_UTF8:
                        continue
            return name
        except UnicodeDecodeError:
            continue
    raise UnicodeDecodeError("utf-8", b"", 0, 1, "no encoding fits")


def read_delimited(spark: SparkSession, path: str, columns: list[str] | None = None, encoding: str | None = None) -> DataFrame:
    """All columns as text (never inferred); only wanted columns that exist; quoted line breaks kept."""
    name = encoding or probe_encoding(path)
    java = "UTF-8" if name.startswith("utf-8") else "ISO-8859-1"
    sep = "\t" if path.lower().endswith(".tsv") else ","
    df = spark.read.csv(path, header=True, sep=sep, multiLine=True, quote='"', escape='"', encoding=java, ignoreLeadingWhiteSpace=False)
    if name == "cp1252":  # Spark reads no cp1252; it differs from ISO-8859-1 in these bytes only
        low = "".join(map(chr, range(0x80, 0xA0)))
        high = "".join(bytes([ord(c)]).decode("cp1252", "replace") for c in low)
        df = df.select(*[F.translate(F.col(f"`{c}`"), low, high).alias(c.translate(str.maketrans(low, high))) for c in df.columns])
    first = df.columns[0]
    if first.startswith("﻿"):
        df = df.withColumnRenamed(first, first.lstrip("﻿"))
    return df.select(*[c for c in columns if c in df.columns]) if columns else df


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """A spreadsheet, where the reading library is installed; such files are small by nature."""
    import pandas as pd

    pdf = pd.read_excel(path, dtype=str)
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), schema=", ".join(f"`{c}` string" for c in pdf.columns))


def read_any(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    return read_workbook(spark, path) if path.lower().endswith((".xlsx", ".xls")) else read_delimited(spark, path, columns)


def read_optional(spark: SparkSession, path: str, schema: StructType, errors: list[str]) -> DataFrame:
    """A Parquet or delimited artifact; if it is missing or broken, an empty frame and a line in ``errors``."""
    try:
        df = spark.read.parquet(path) if not path.lower().endswith((".csv", ".tsv")) else read_delimited(spark, path)
        return require_columns(df, schema.fieldNames(), path).select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
    except Exception as e:  # noqa: BLE001 - any reader error means "not there"
        errors.append(f"{path}: {type(e).__name__}")
        return spark.createDataFrame([], schema)


def read_split(spark: SparkSession, path: str, required: list[str], body: str = "body") -> DataFrame:
    """A split that must have its columns, a row, and no blank body."""
    df = require_columns(spark.read.parquet(path), required, path)
    seen = df.agg(F.count(F.lit(1)).alias("n"), F.sum((F.trim(F.coalesce(body, F.lit(""))) == "").cast("int")).alias("blank")).first()
    if not seen["n"]:
        raise ValueError(f"{path} has no rows")
    if seen["blank"]:
        raise ValueError(f"{path} has {seen['blank']} blank texts")
    return df


def load_config(path: str, sections: list[str]) -> dict:
    with open(path, encoding="utf-8") as f:
        config = json.load(f)
    missing = sorted(set(sections) - set(config))
    if missing:
        raise ValueError(f"{path} lacks sections: {', '.join(missing)}")
    return config


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


class unchanged:  # noqa: N801 - used as a context
    """Raises on leaving if one of the files was changed inside the context."""

    def __init__(self, *paths: str):
        self.paths = paths

    def __enter__(self):
        self.before = {p: file_digest(p) for p in self.paths}
        return self

    def __exit__(self, kind, value, trace):
        changed = [p for p in self.paths if file_digest(p) != self.before[p]]
        if kind is None and changed:
            raise RuntimeError(f"inputs changed while in use: {', '.join(changed)}")


# ---------------------------------------------------------------- single mails and web pages


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.links: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "noscript"):
            self.hidden += 1
        for k, v in attrs:
            if tag == "a" and k == "href" and v and v.strip():
                self.links.append(v.strip())

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript") and self.hidden:
            self.hidden -= 1

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.text.append(data.strip())


def page_text(html: str | None) -> str:
    """Visible text in one line, then each link target on a line of its own."""
    if not html:
        return ""
    page = _Page()
    page.feed(html)
    page.close()
    return "\n".join([" ".join(" ".join(page.text).split()), *page.links]).strip()


@F.arrow_udf(StringType())
def html_to_text(col: pa.Array) -> pa.Array:
    return pa.array([page_text(v) for v in col.to_pylist()], pa.string())


def _header(value) -> str:
    return " ".join(unicodedata.normalize("NFC", str(value or "")).split())


def parse_mail(data: bytes) -> dict[str, str]:
    """sender, receiver (to and cc), date, subject, body of one mail; plain text before HTML, attachments left out."""
    if not isinstance(data, (bytes, bytearray)):
        raise TypeError("a mail is parsed from bytes")
    message = email.message_from_bytes(bytes(data), policy=email.policy.default)
    plain, rich = [], []
    for part in message.walk():
        if part.is_multipart() or part.get_content_disposition() == "attachment":
            continue
        kind = part.get_content_type()
        if kind not in ("text/plain", "text/html"):
            continue
        raw = part.get_payload(decode=True) or b""
        try:
            text = raw.decode(part.get_content_charset() or "utf-8")
        except (LookupError, UnicodeDecodeError):
            text = raw.decode("utf-8", "replace")
        (plain if kind == "text/plain" else rich).append(text)
    body = "\n".join(plain) if any(t.strip() for t in plain) else "\n".join(page_text(t) for t in rich)
    receivers = [x for x in (_header(message.get("to")), _header(message.get("cc"))) if x]
    return {"sender": _header(message.get("from")), "receiver": ", ".join(receivers), "date": _header(dict(message.raw_items()).get("Date")), "subject": _header(message.get("subject")), "body": body.strip()}


MAIL_SCHEMA = "path string, sender string, receiver string, date string, subject string, body string"


def read_mails(spark: SparkSession, path: str) -> DataFrame:
    """One row a mail file under ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in MAIL_SCHEMA.split(", ")]
        for batch in batches:
            rows = [{"path": p, **parse_mail(c)} for p, c in zip(*(x.to_pylist() for x in batch.columns))]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], pa.string()) for n in names], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, MAIL_SCHEMA)


_ADDRESS = StructType([StructField(n, StringType()) for n in ("display", "address", "domain")])


@F.arrow_udf(_ADDRESS)
def mail_address(col: pa.Array) -> pa.Array:
    """struct(display, address, domain) of a sender; nulls where there is no address."""
    out = []
    for v in col.to_pylist():
        name, address = parseaddr(v or "", strict=False)
        ok = "@" in address
        out.append((name or None, address if ok else None, address.rsplit("@", 1)[1].strip("[]").lower() if ok else None))
    return pa.StructArray.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in range(3)], ["display", "address", "domain"])


@F.arrow_udf(StringType())
def all_addresses(col: pa.Array) -> pa.Array:
    """All addresses of a header, joined by a comma and a blank."""
    return pa.array([", ".join(a for _, a in getaddresses([v or ""]) if "@" in a) for v in col.to_pylist()], pa.string())


# ---------------------------------------------------------------- sinks


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def publish(df: DataFrame, path: str, validate: Callable[[DataFrame], None] | None = None, fmt: str = "parquet") -> None:
    """Write beside ``path``, read back, validate, then rename; a failed check leaves ``path`` as it was."""
    spark = df.sparkSession
    staging, old = f"{path}.staging", f"{path}.old"
    df.write.mode("overwrite").format(fmt).save(staging)
    sp, fs = _fs(spark, staging)
    try:
        if validate:
            validate(spark.read.format(fmt).schema(df.schema).load(staging))
    except BaseException:
        fs.delete(sp, True)
        raise
    tp, op = _fs(spark, path)[0], _fs(spark, old)[0]
    fs.delete(op, True)
    if fs.exists(tp):
        fs.rename(tp, op)
    fs.rename(sp, tp)
    fs.delete(op, True)


def write_delimited(df: DataFrame, path: str, sep: str = ",") -> None:
    """Delimited text that tells empty text from null."""
    df.write.mode("overwrite").csv(path, header=True, sep=sep, quote='"', escape='"', emptyValue='""', nullValue="")


def not_done(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``work`` that an earlier run has not finished (resume)."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def latest_by_key(log: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """State of an append-only log of upserts: the last entry of each key."""
    from mailweir.operators.standardize import keep_last

    return keep_last(log, keys, order)


def as_json_lines(df: DataFrame) -> DataFrame:
    """Strict JSON a row: no NaN, no infinity."""
    numbers = [F.when(F.isnan(c) | F.col(c).isin(float("inf"), float("-inf")), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*numbers), {"ignoreNullFields": "false"}).alias("line"))
