"""Human decisions over machine proposals, named subsets, counters with zeros."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mailweir.operators.standardize import keep_last


def overlay(proposals: DataFrame, decisions: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """``proposals`` (with ``label``) under the last decision of each key: a decided label wins, "defer" leaves it open.

    Adds ``final_label`` and ``decided_by`` (human, rule, open).
    """
    last = keep_last(decisions, keys, order).select(*keys, "decision")
    out = proposals.join(last, keys, "left")
    final = F.when(F.col("decision").isNull(), F.col("label")).when(F.col("decision") == "defer", F.lit(None).cast("string")).otherwise(F.col("decision"))
    by = F.when(F.col("decision").isNull(), F.when(F.col("label").isNull(), "open").otherwise("rule")).when(F.col("decision") == "defer", "open").otherwise("human")
    return out.withColumn("final_label", final).withColumn("decided_by", by).drop("decision")


def pending(proposals: DataFrame, decisions: DataFrame, keys: list[str], order: Column, revisit: bool = False) -> DataFrame:
    """Proposals without a decision; with ``revisit`` also those whose last decision is "defer"."""
    last = keep_last(decisions, keys, order).select(*keys, "decision")
    closed = last.filter("decision <> 'defer'") if revisit else last
    return proposals.join(closed.select(*keys), keys, "left_anti")


def subset(df: DataFrame, manifest: dict[str, list]) -> DataFrame:
    """Rows that hold one of the listed values in every listed column; an unknown column is an error."""
    unknown = sorted(set(manifest) - set(df.columns))
    if unknown:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    return df.filter(reduce(lambda a, b: a & b, [F.col(c).isin(*v) for c, v in manifest.items()], F.lit(True)))


def in_scopes(df: DataFrame, scopes: dict[str, Column]) -> DataFrame:
    """One row for each scope that a row lies in (scopes may overlap)."""
    names = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in scopes.items()]), lambda x: x.isNotNull())
    return df.withColumn("scope", F.explode(names))


def counts_with_zeros(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Counts of the listed values, zeros included."""
    wanted = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    per = df.filter(F.col(column).isin(*values)).groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))
    return wanted.join(F.broadcast(per), column, "left").fillna(0, ["n_rows"])  # a row a value


def counters(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row: number of rows and of rows that meet each condition."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).alias(n) for n, c in conditions.items()])


def repeated_members(df: DataFrame, key: str) -> DataFrame:
    """``df`` with ``repeated``: true for every member of a non-empty key that occurs more than once."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    return df.withColumn("repeated", F.coalesce((F.col(key) != "") & (n > 1), F.lit(False)))


def inherited_label(rows: DataFrame, links: DataFrame, parents: DataFrame, trusted: tuple[str, ...]) -> DataFrame:
    """(id, parent_id, inherited): label of the last linked parent, if its provenance is trusted.

    ``links``: id, parent_id, ord; ``parents``: parent_id, label, label_provenance.
    """
    last = keep_last(links, ["id"], F.col("ord").desc())
    both = rows.select("id").join(last, "id").join(parents, "parent_id")
    return both.select("id", "parent_id", F.when(F.col("label_provenance").isin(*trusted), F.col("label")).alias("inherited"))


def map_batches(df: DataFrame, column: str, out: str, batch: Callable[[list], list], size: int = 256) -> DataFrame:
    """``df`` with ``out`` = ``batch`` over lists of values, a vectorised function of the user.

    A batch that fails is tried row by row; a row that fails has null and its error in ``<out>_error``.
    """
    none = F.lit(None).cast("string")
    schema = df.select("*", none.alias(out), none.alias(f"{out}_error")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, got, errors = b.column(b.schema.get_field_index(column)).to_pylist(), [], []
            for lo in range(0, len(values), size):
                part = values[lo : lo + size]
                try:
                    result = list(batch(part))
                    if len(result) != len(part):
                        raise ValueError("one result a value is needed")
                    got += result
                    errors += [None] * len(part)
                except Exception:  # noqa: BLE001 - the user's function
                    for v in part:
                        try:
                            got.append(batch([v])[0])
                            errors.append(None)
                        except Exception as e:  # noqa: BLE001
                            got.append(None)
                            errors.append(f"{type(e).__name__}: {e}"[:200])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string()), pa.array(errors, pa.string())], [*b.schema.names, out, f"{out}_error"])

    return df.mapInArrow(run, schema)
