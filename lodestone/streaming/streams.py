"""The same transformations over streams of files and events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.detect import format_column
from ..operators.entropy import content_entropy, obfuscation_level, packer


def artifact_stream(spark: SparkSession, folder: str, glob: str = "*", files_at_once: int = 1000) -> DataFrame:
    """Files that appear in a folder, as artifacts."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_at_once).load(folder)
    return files.select(F.col("path").alias("artifact_id"), "content", "length", F.col("modificationTime").alias("seen"))


def triage(artifacts: DataFrame) -> DataFrame:
    """Format, entropy, level and packer of each artifact: no state, so any stream of artifacts will do."""
    bits = artifacts.withColumn("entropy", content_entropy("content")).withColumn("format", format_column(archives=False))
    return bits.select("artifact_id", "format", "length", "entropy", obfuscation_level("entropy").alias("level"), packer("content").alias("packer_name"))


def _timed(events: DataFrame) -> DataFrame:
    """Watermarks need instants: times without a zone are in the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by tumbling window and type, closed once the watermark has passed."""
    return _timed(events).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by user and session."""
    return _timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Gives the sink everything that is there, batch by batch, and ends."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
