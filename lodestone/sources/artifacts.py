"""Artifacts: (artifact_id, content, length) frames from files, text columns or binary columns."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def from_files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """Whole files as artifacts; artifact_id is the path. Content is read only where a plan uses it."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(F.col("path").alias("artifact_id"), "content", "length")


def from_column(df: DataFrame, key: str, column: str) -> DataFrame:
    """A text or binary column as artifacts; text becomes its UTF-8 bytes."""
    content = F.col(column).cast("binary")
    return df.select(F.col(key).cast("string").alias("artifact_id"), content.alias("content"), F.length(content).cast("long").alias("length"))


def spread(artifacts: DataFrame) -> DataFrame:
    """The same rows dealt over all cores where a scan has fewer partitions than that (one small file); for work that costs far more than moving the bytes."""
    cores = artifacts.sparkSession.sparkContext.defaultParallelism
    return artifacts.repartition(cores) if artifacts.rdd.getNumPartitions() < cores else artifacts


def decompressed(content: Column | str) -> Column:
    """Struct (data, error): gzip by 1f 8b, zlib by 78 9c, 78 01 or 78 da; anything else is an error."""

    @F.pandas_udf("data binary, error string")
    def inflate(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows: list[tuple[bytes | None, str | None]] = []
            for data in part:
                data = b"" if data is None else bytes(data)
                try:
                    if data[:2] == b"\x1f\x8b":
                        rows.append((gzip.decompress(data), None))
                    elif data[:2] in (b"\x78\x9c", b"\x78\x01", b"\x78\xda"):
                        rows.append((zlib.decompress(data), None))
                    else:
                        rows.append((None, "unknown compression"))
                except (OSError, EOFError, zlib.error) as e:
                    rows.append((None, str(e)))
            yield pd.DataFrame(rows, columns=["data", "error"])

    return inflate(F.col(content) if isinstance(content, str) else content)
