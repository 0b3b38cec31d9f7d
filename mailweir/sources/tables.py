"""Parquet tables by name."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str, columns: Iterable[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def require_columns(df: DataFrame, columns: Iterable[str], name: str) -> DataFrame:
    """Raise with the sorted missing columns; else hand ``df`` back."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{name} lacks required columns: {', '.join(missing)}")
    return df
