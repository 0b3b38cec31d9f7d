"""Mail and event streams: idempotent ingest, windowed counts, running state."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StringType, StructField, StructType

from mailweir.session import ensure_checkpoint_dir


def open_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's Parquet files as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    path = f"{sf_dir}/{name}.parquet"
    glob = f"{path}/*.parquet" if os.path.isdir(path) else f"{sf_dir}/{name}.parque[t]"
    stream = spark.readStream.schema(schema).parquet(glob)
    return stream.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema.fields if f.dataType.simpleString() == "timestamp_ntz"})


def first_seen(stream: DataFrame, key: str, at: str, delay: str = "7 days") -> DataFrame:
    """Each key once within the watermark; rows without a key pass."""
    marked = stream.withWatermark(at, delay)
    return marked.withColumn("_k", F.coalesce(F.col(key), F.expr("uuid()"))).dropDuplicatesWithinWatermark(["_k"]).drop("_k")


def tumbling_counts(stream: DataFrame, at: str, width: str, by: list[str], delay: str = "1 day") -> DataFrame:
    return stream.withWatermark(at, delay).groupBy(F.window(at, width), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), *by, "n")


def sliding_sums(stream: DataFrame, at: str, width: str, step: str, by: list[str], value: str, delay: str = "1 day") -> DataFrame:
    out = stream.withWatermark(at, delay).groupBy(F.window(at, width, step), *by).agg(F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), *by, "total")


def sessions(stream: DataFrame, at: str, gap: str, by: str, delay: str = "1 day") -> DataFrame:
    out = stream.withWatermark(at, delay).groupBy(F.session_window(at, gap), by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(by, F.col("session_window.start").alias("session_start"), "n")


_STATE = StructType([StructField("n", LongType())])
_OUT = StructType([StructField("key", StringType()), StructField("n", LongType())])


def running_counts(stream: DataFrame, key: str) -> DataFrame:
    """Count of each key so far, kept in state over batches."""

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = (state.get[0] if state.exists else 0) + sum(len(b) for b in batches)
        state.update((n,))
        yield pd.DataFrame({"key": [str(k[0])], "n": [n]})

    return stream.select(key).groupBy(key).applyInPandasWithState(step, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def drain(result: DataFrame, mode: str, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a stream over all that is there and read its table; files stand in the shared folder."""
    spark = result.sparkSession
    base = os.path.join(ensure_checkpoint_dir(spark), f"stream-{uuid.uuid4().hex}")

    def sink(batch: DataFrame, number: int) -> None:
        out = batch.withColumn("batch", F.lit(number))
        # a batch that is tried again writes over its own folder; in complete mode the last batch holds everything
        out.write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/part={number}")

    query = result.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
    table = spark.read.parquet(f"{base}/out").drop("batch", "part") if keep is None else keep(spark.read.parquet(f"{base}/out"))
    return table


def receive(stream: DataFrame, store: str, key: str = "ma_thu_ngoai"):
    """Idempotent ingest: per batch, mails whose external id the store lacks are appended. Returns the started query."""
    from mailweir.operators.mailbox import first_deliveries, new_deliveries

    spark = stream.sparkSession
    base = os.path.join(ensure_checkpoint_dir(spark), f"receive-{uuid.uuid4().hex}")

    def sink(batch: DataFrame, number: int) -> None:
        try:
            fresh = new_deliveries(batch, spark.read.parquet(store).select(key))
        except Exception as e:  # noqa: BLE001 - the first batch finds no store
            if "PATH_NOT_FOUND" not in str(e):
                raise
            fresh = first_deliveries(batch)
        fresh.select(*batch.columns).write.mode("append").parquet(store)

    return stream.writeStream.option("checkpointLocation", base).trigger(availableNow=True).foreachBatch(sink).start()
