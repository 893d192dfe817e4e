"""Running cell totals and gene moments over a stream of events, kept by Spark's state store.

Each micro-batch is combined before its shuffle, and the state holds one row per cell or gene. The sums are merged by Spark's
own variance buffers (Chan et al.), so the result does not depend on how the stream is cut.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Schema of the events.
EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """The events of a folder as a stream of files."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def cell_totals(events: DataFrame, cell: str = "user_id") -> DataFrame:
    return events.groupBy(F.col(cell).alias("cell_id")).agg(F.count("*").cast("double").alias("total"))


def gene_moments(events: DataFrame, gene: str = "event_type", value: str = "value") -> DataFrame:
    return events.groupBy(F.col(gene).alias("gene")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))


def windowed_totals(events: DataFrame, width: str = "1 hour", late: str = "2 hours", gene: str = "event_type") -> DataFrame:
    """Counts by tumbling window; events later than ``late`` are dropped and finished windows leave the state."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), F.col(gene).alias("gene")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "gene", "n")


def drained(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there now, and read what it has written last, from the shared folder (on a local master
    without one, a temporary one)."""
    spark = stream.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    base = base or "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", uuid.uuid4().hex)
    path = f"{base.rstrip('/')}/cellmesa/{name}-{uuid.uuid4().hex}"
    schema = stream.schema

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{path}/out")

    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/out")
    running = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(keep).start()
    running.awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/out")
