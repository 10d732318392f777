"""Watch mode: a file stream whose micro-batches rescan only what arrived."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marlstone.operators.rules import NEUTRAL, Rule, scan_pack
from marlstone.session import scratch

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def watch(spark: SparkSession, directory: str, sink: Callable[[DataFrame, int], None], checkpoint: str, glob: str = "*.sol", rules: Sequence[Rule] = NEUTRAL, trigger: str = "500 milliseconds", once: bool = False) -> StreamingQuery:
    """Scans every new file below the directory and hands each micro-batch of findings (file, line_no, rule) to ``sink``.

    The trigger coalesces what arrives in between, so the last save of a burst is never missed. A file stream does not see
    edits in place: editors that write a new name do, others need versioned names. ``once`` works off what is there and ends.
    """
    stream = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(directory)
    texts = stream.select(F.col("path").alias("file"), F.decode("content", "UTF-8").alias("content"))

    def run(batch: DataFrame, number: int) -> None:
        sink(scan_pack(batch, "file", "content", rules), number)

    writer = texts.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=trigger)).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``start, event_type, n``: tumbling counts of a stream of events with a watermark for late rows."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def counts_of_stream(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Hourly counts of all events that lie in the directory, read as a stream and worked off once.

    Each micro-batch writes the windows that it changed, and the last state of a window counts, so no batch holds more than its
    own windows and the watermark lets old state go.
    """
    events = spark.readStream.schema(EVENTS).option("pathGlobFilter", name).parquet(directory).withColumn("ts", F.col("ts").cast("timestamp"))
    path = scratch(spark, "counts")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/out/batch={number:09d}")

    event_counts(events).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema("start timestamp, event_type string, n bigint, batch bigint").parquet(f"{path}/out/*")
    return rows.groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n")).withColumn("start", F.col("start").cast("timestamp_ntz"))
