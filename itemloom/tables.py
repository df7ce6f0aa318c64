"""Tables between the steps of a plan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """The folder for tables between steps: spark.checkpoint.dir, or the checkpoint folder that was set on the context,
    which all machines share. Only a local session, as in tests, may go without and gets a temporary one."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not shared:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="itemloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared)
    return shared


def cut(df: DataFrame) -> DataFrame:
    """Compute df once and cut its lineage: a Parquet table in scratch(), which is compressed and holds columns, so a tenth of
    a checkpoint of rows. Types that Parquet lacks are checkpointed."""
    top, kinds = scratch(df.sparkSession), df.schema.simpleString()
    if not df.columns or any(k in kinds for k in ("void", "interval")):
        return df.checkpoint()
    path = f"{top.rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts_for(spark: SparkSession, rows: int, each: int = 500_000) -> int:
    """Partitions of about that many rows, so that what a task holds doesn't grow with the input."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))
