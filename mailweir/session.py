"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(cpus: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("mailweir")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared folder; a folder of our own only where none is set (tests on one machine)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    have = sc.getCheckpointDir()
    if have:
        return have
    if not named:
        named = os.path.join(tempfile.gettempdir(), f"mailweir-checkpoints-{os.getuid()}")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there, so that a lost executor costs no rerun."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)



def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, before costly Python work.

    Only an input of fewer file splits than cores is shuffled; a large one, and one that comes out of a shuffle, is
    handed back as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df
