"""Byte histograms, Shannon entropy, high-entropy regions and packing indicators.

Histograms are counted with numpy over Arrow batches, so that bytes never become rows: no shuffle,
one pass over the content. Everything after the histogram is an expression on the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.binary import latin1, starts_with

#: Chunk size and thresholds.
CHUNK, HIGH, CODE_HIGH, ENCRYPTED, STRONG = 1024, 7.5, 7.0, 7.9, 7.8
#: Constants of common ciphers and hashes.
CRYPTO_CONSTANTS = (b"\x67\x45\x23\x01", b"\x01\x23\x45\x67", b"\x89\xab\xcd\xef")
#: Packers by the text that gives them away, in the order of the test.
PACKERS = ("UPX", "VMProtect", "Themida", "ASPack")


@F.pandas_udf(T.ArrayType(T.LongType()))
def byte_histogram(contents: pd.Series) -> pd.Series:
    """256 counts; null content counts as empty."""
    return contents.map(lambda d: np.bincount(np.frombuffer(d or b"", np.uint8), minlength=256))


def _bits(counts: np.ndarray) -> float:
    p = counts[counts > 0] / counts.sum() if counts.any() else np.empty(0)
    return abs(float(-(p * np.log2(p)).sum()))


@F.pandas_udf(T.DoubleType())
def content_entropy(contents: pd.Series) -> pd.Series:
    """Shannon entropy in bits, 0 to 8; 0.0 for null and empty content."""
    return contents.map(lambda d: _bits(np.bincount(np.frombuffer(d or b"", np.uint8), minlength=256)))


@F.pandas_udf(T.DoubleType())
def content_chi_square(contents: pd.Series) -> pd.Series:
    """Distance of the byte counts from uniform ones; null for null and empty content."""

    def one(data: bytes | None) -> float | None:
        counts = np.bincount(np.frombuffer(data or b"", np.uint8), minlength=256)
        want = counts.sum() / 256
        return float(((counts - want) ** 2 / want).sum()) if want else None

    return contents.map(one)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def chunk_entropies(contents: pd.Series) -> pd.Series:
    """Entropy of each 1,024-byte chunk, the last one as long as it is."""

    def one(data: bytes | None) -> np.ndarray:
        raw = np.frombuffer(data or b"", np.uint8)
        chunk = np.arange(len(raw)) // CHUNK
        n = -(-len(raw) // CHUNK)
        counts = np.bincount(chunk * 256 + raw, minlength=n * 256).reshape(n, 256).astype(float)
        p = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        return -(p * np.log2(p, out=np.zeros_like(p), where=p > 0)).sum(axis=1) + 0.0

    return contents.map(one)


def entropy(histogram: Column | str) -> Column:
    """Shannon entropy in bits of a histogram column, 0 to 8; 0.0 if it is empty."""
    h = F.col(histogram) if isinstance(histogram, str) else histogram
    total = F.aggregate(h, F.lit(0).cast("long"), lambda s, n: s + n)
    bits = F.aggregate(h, F.lit(0.0), lambda s, n: F.when(n > 0, s - n / total * F.log2(n / total)).otherwise(s))
    return F.when(total > 0, F.abs(bits)).otherwise(F.lit(0.0))


def artifact_entropy(artifacts: DataFrame) -> DataFrame:
    """artifact_id and entropy of the whole content."""
    return artifacts.select("artifact_id", content_entropy("content").alias("entropy"))


def byte_frequencies(artifacts: DataFrame) -> DataFrame:
    """artifact_id, byte and n for the bytes that occur."""
    spread = artifacts.select("artifact_id", F.posexplode(byte_histogram("content")).alias("byte", "n"))
    return spread.where("n > 0")


def chunks(artifacts: DataFrame) -> DataFrame:
    """artifact_id, chunk, start, end and entropy for every 1,024-byte chunk."""
    spread = artifacts.select("artifact_id", F.length("content").alias("size"), F.posexplode(chunk_entropies("content")).alias("chunk", "entropy"))
    start = F.col("chunk").cast("long") * CHUNK
    return spread.select("artifact_id", "chunk", start.alias("start"), F.least(start + CHUNK, F.col("size").cast("long")).alias("end"), "entropy")


def describe(content: Column, bits: Column) -> Column:
    """What a chunk of that entropy may be."""
    text = latin1(content)
    crypto = F.lit(False)
    for constant in CRYPTO_CONSTANTS:
        crypto = crypto | F.contains(text, F.lit(constant.decode("latin-1")))
    packed = (F.length(content) >= 4) & (starts_with(content, b"\x1f\x8b") | starts_with(content, b"PK\x03\x04") | starts_with(content, b"BZh"))
    return (
        F.when(bits > ENCRYPTED, "Likely encrypted or compressed data")
        .when(crypto, "Possible cryptographic constants")
        .when(packed, "Possible compressed data")
        .otherwise("High entropy region - possible obfuscation")
    )


def high_entropy_regions(artifacts: DataFrame, threshold: float = HIGH) -> DataFrame:
    """artifact_id, start, end, entropy and description of chunks above the threshold."""
    spread = artifacts.select("artifact_id", "content", F.posexplode(chunk_entropies("content")).alias("chunk", "entropy")).where(F.col("entropy") > threshold)
    start = F.col("chunk") * CHUNK
    part = F.substring(F.col("content"), start + 1, F.lit(CHUNK))
    return spread.select(
        "artifact_id", start.cast("long").alias("start"), (start + F.length(part)).cast("long").alias("end"), "entropy", describe(part, F.col("entropy")).alias("description"),
    )


def section_entropy(artifacts: DataFrame, sections: DataFrame) -> DataFrame:
    """artifact_id, name and entropy of sections that lie in the file; of equal names the last one counts.

    Sections: artifact_id, ordinal, name, offset, size.
    """
    inside = sections.alias("s").join(artifacts.select("artifact_id", "content"), "artifact_id")
    # Header fields can be anything: no sum that may overflow. Offsets and sizes from 2^63 on are negative.
    rest = F.try_subtract(F.length("content").cast("long"), F.col("offset"))
    inside = inside.where((F.col("offset") >= 0) & (F.col("size") > 0) & (F.col("size") <= rest))
    part = F.substring(F.col("content"), (F.col("offset") + 1).cast("int"), F.col("size").cast("int"))
    bits = inside.select("artifact_id", "name", "ordinal", content_entropy(part).alias("entropy"))
    return bits.groupBy("artifact_id", "name").agg(F.max_by("entropy", "ordinal").alias("entropy"))


def packer(content: Column | str) -> Column:
    """Name of a packer that the first 1,024 bytes mention; null if there are fewer."""
    c = F.col(content) if isinstance(content, str) else content
    head, out = latin1(F.substring(c, 1, 1024)), F.lit(None).cast("string")
    for name in reversed(PACKERS):
        out = F.when(F.contains(head, F.lit(name)), F.lit(name)).otherwise(out)
    return F.when(F.length(c) >= 1024, out)


def obfuscation_level(bits: Column | str) -> Column:
    e = F.col(bits) if isinstance(bits, str) else bits
    return F.when(e > STRONG, "High").when(e > HIGH, "Medium").when(e > CODE_HIGH, "Low").otherwise("None")


def packing(artifacts: DataFrame, by_section: DataFrame | None = None) -> DataFrame:
    """artifact_id, entropy, is_packed, packer_name, compression_ratio and obfuscation_level.

    by_section: the result of section_entropy; a section named like text or code above 7.0 counts
    as packed too.
    """
    whole = artifacts.select("artifact_id", content_entropy("content").alias("entropy"), packer("content").alias("packer_name"))
    code = F.lit(False)
    if by_section is not None:
        dense = by_section.where((F.contains("name", F.lit("text")) | F.contains("name", F.lit("code"))) & (F.col("entropy") > CODE_HIGH))
        whole = whole.join(dense.select("artifact_id", F.lit(True).alias("dense")).distinct(), "artifact_id", "left")
        code = F.coalesce("dense", F.lit(False))
    packed = (F.col("entropy") > HIGH) | code
    return whole.select(
        "artifact_id", "entropy", packed.alias("is_packed"), "packer_name",
        F.when(packed, F.col("entropy") / 8).alias("compression_ratio"), obfuscation_level("entropy").alias("obfuscation_level"),
    )
