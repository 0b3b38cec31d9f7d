"""Registered queries of the problems on training text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailweir.llm import components, encode, format_copies, grouped_split, language, lookalike, mixture, pii, quoted, split_overlap
from mailweir.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
#: The queries' key; a user passes an own secret to the operator.
PSEUDONYM_KEY = "example-key"
TEXTS = ("id", "subject", "body")
MESSAGE_KEYS = ("id", "group_id", "content_hash", "parent_id")
OVERLAP_KEYS = ("english_id", "vietnamese_id", "review_status")
OVERLAP_COLUMNS = ("id", "subject", "body", "split")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return language.wrong_labels(table(spark, d, "messages", (*TEXTS, "language")))


def p1_segments(spark: SparkSession, d: str) -> DataFrame:
    found = language.detect(table(spark, d, "messages", (*TEXTS, "language")))
    return found.select("id", "segment", "lang", "confidence", "ambiguous")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    messages = table(spark, d, "messages", MESSAGE_KEYS)
    overlap = table(spark, d, "cross_language_overlap", OVERLAP_KEYS)
    return components.message_components(messages, overlap).select("component_id", "id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.disguised_pairs(table(spark, d, "messages", TEXTS))


def p3_normalised(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.normalise(table(spark, d, "messages", TEXTS), "subject", "body")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return format_copies.copy_pairs(table(spark, d, "messages", ("id", "subject", "body")))


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    return format_copies.collapse(table(spark, d, "messages", ("id", "subject", "body")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.overlap_found(table(spark, d, "messages", OVERLAP_COLUMNS))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.overlap_report(table(spark, d, "messages", (*OVERLAP_COLUMNS, "source")))


def _mails(spark: SparkSession, d: str) -> DataFrame:
    return quoted.mail_table(table(spark, d, "thu", ("id_thu", "noi_dung")), table(spark, d, "messages", ("id", "body")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return quoted.not_new_lines(_mails(spark, d))


def p6_new_text(spark: SparkSession, d: str) -> DataFrame:
    return quoted.new_text(_mails(spark, d))


def p6_ancestors(spark: SparkSession, d: str) -> DataFrame:
    return quoted.ancestors(_mails(spark, d))


def p6_sources(spark: SparkSession, d: str) -> DataFrame:
    """Lines by the sources that found them."""
    lines = quoted.line_sources(_mails(spark, d))
    return lines.groupBy("tbl", "by_index", "by_recurrence", "by_fallback").agg(F.count(F.lit(1)).alias("n_lines"))


def p7_split(spark: SparkSession, d: str) -> DataFrame:
    messages = table(spark, d, "messages", (*MESSAGE_KEYS, "label"))
    return grouped_split.assign_splits(messages, table(spark, d, "split_targets"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return grouped_split.split_report(p7_split(spark, d), table(spark, d, "split_targets"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_corpus(table(spark, d, "documents", ("doc_id", "text")))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix(table(spark, d, "documents", ("doc_id", "text", "source")), table(spark, d, "source_weights"))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix_report(p9_mix(spark, d), table(spark, d, "source_weights"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find_pii(table(spark, d, "documents", ("doc_id", "text")))


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact_documents(table(spark, d, "documents", ("doc_id", "text")), PSEUDONYM_KEY)


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_segments": p1_segments,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_normalised": p3_normalised,
    "p4_found": p4_found,
    "p4_records": p4_records,
    "p5_found": p5_found,
    "p5_report": p5_report,
    "p6_found": p6_found,
    "p6_new_text": p6_new_text,
    "p6_ancestors": p6_ancestors,
    "p6_sources": p6_sources,
    "p7_split": p7_split,
    "p7_report": p7_report,
    "p8_ids": p8_ids,
    "p9_mix": p9_mix,
    "p9_report": p9_report,
    "p10_found": p10_found,
    "p10_redacted": p10_redacted,
}
SQL: dict[str, str] = {}
