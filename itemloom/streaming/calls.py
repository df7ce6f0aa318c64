"""Call statistics over a stream of call events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

STATS = "label string, calls long, total_ms double, eval_tokens long, batch long"


def running_stats(events: DataFrame) -> DataFrame:
    """Per label so far: calls, milliseconds and tokens (A10); for output mode update or complete."""
    ms = (F.unix_micros("end_ts") - F.unix_micros("start_ts")) / 1000.0
    return events.groupBy("label").agg(F.count("*").alias("calls"), F.sum(ms).alias("total_ms"), F.sum("eval_tokens").alias("eval_tokens"))


def upsert(changed: DataFrame, batch: int, folder: str) -> None:
    """Keep the labels that a batch changed, as that batch's version. A batch that is written again after a failure takes
    the place of what it wrote before, so it changes nothing."""
    changed.write.mode("overwrite").parquet(f"{folder}/batch={batch}")


def start(events: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Run the statistics: each batch writes the labels that it changes to the shared folder, nothing goes to the driver."""
    out = running_stats(events).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return out.foreachBatch(lambda rows, batch: upsert(rows, batch, folder)).trigger(**trigger).start()


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics as the last batch of each label left them."""
    rows = spark.read.schema(STATS).option("basePath", folder).parquet(folder)
    last = F.max_by(F.struct("calls", "total_ms", "eval_tokens"), "batch").alias("s")
    return rows.groupBy("label").agg(last).select("label", "s.*")
