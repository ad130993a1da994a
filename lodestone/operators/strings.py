"""Printable strings, and what they hold: URLs, e-mail addresses, IP addresses, paths, base64."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.binary import latin1

#: Patterns over latin-1 text, by kind.
KINDS = {
    "url": "(?:https?|ftp)://[\\x21\\x23-\\x26\\x28-\\x3b\\x3d\\x3f-\\x7e]+",
    "email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+",
    "ip": "(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9.])",
    "windows_path": "[A-Za-z]:\\\\(?:[^\\x00-\\x1f\\\\/:*?\"<>|]+\\\\)*[^\\x00-\\x1f\\\\/:*?\"<>|]*",
    "base64": "(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{4}){5,}(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?(?![A-Za-z0-9+/=])",
}


def printable(artifacts: DataFrame, least: int = 4) -> DataFrame:
    """artifact_id, ordinal and text of runs of at least so many printable ASCII characters."""
    runs = F.regexp_extract_all(latin1("content"), F.lit(f"[\\x20-\\x7e]{{{least},}}"), 0)
    return artifacts.select("artifact_id", F.posexplode(runs).alias("ordinal", "text"))


def wide(artifacts: DataFrame, least: int = 4) -> DataFrame:
    """The same for UTF-16 little-endian text."""
    runs = F.regexp_extract_all(latin1("content"), F.lit(f"(?:[\\x20-\\x7e]\\x00){{{least},}}"), 0)
    rows = artifacts.select("artifact_id", F.posexplode(runs).alias("ordinal", "text"))
    return rows.withColumn("text", F.translate("text", "\u0000", ""))


def indicators(artifacts: DataFrame, kinds: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    """artifact_id, kind, value and n of what the content holds."""
    text = latin1("content")

    def of(kind: str):
        return F.transform(F.regexp_extract_all(text, F.lit(KINDS[kind]), 0), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    found = F.flatten(F.array(*map(of, kinds)))
    return artifacts.select("artifact_id", F.explode(found).alias("f")).groupBy("artifact_id", "f.kind", "f.value").agg(F.count(F.lit(1)).alias("n"))


def embedded(artifacts: DataFrame) -> DataFrame:
    """artifact_id and how many ELF, PE and ZIP signatures stand behind its first byte."""
    text = latin1(F.expr("substring(content, 2)"))
    return artifacts.select("artifact_id", *[F.regexp_count(text, F.lit(rx)).cast("long").alias(k) for k, rx in (("elf", "\\x7fELF"), ("pe", "(?s)MZ.{58,1024}?PE\\x00\\x00"), ("zip", "PK\\x03\\x04"))])
