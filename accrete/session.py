"""Sessions and the shared folder for checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A session for tests and benchmarks on one machine; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("accrete")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder: spark.checkpoint.dir if the cluster names one.

    Only where neither that setting nor an earlier call gave a folder (tests on one machine) is a temporary one made.
    """
    context = spark.sparkContext
    known = context.getCheckpointDir()
    if known:
        return known
    named = context.getConf().get("spark.checkpoint.dir")
    context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "accrete-checkpoints"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df written once as a table in the shared checkpoint folder and read back: its lineage ends there.

    A table is columnar and compressed, and may be read again with fewer columns, where checkpoint() keeps whole rows.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
