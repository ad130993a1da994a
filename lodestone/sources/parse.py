"""Parsing artifacts into one nested row each, and the child tables of it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.detect import format_column
from .parsers import PARSERS, ParseError
from .parsers.common import FEATURES

SECTION = "name string, address long, size long, offset long, perm_read boolean, perm_write boolean, perm_execute boolean, section_type string, data binary"
SYMBOL = "name string, demangled_name string, address long, size long, symbol_type string, binding string, visibility string, section_index long"
IMPORT = "name string, library string, address long, import_ordinal int"
EXPORT = "name string, address long, export_ordinal int, forwarded_name string"
METADATA = "size long, format string, architecture string, entry_point long, base_address long, timestamp long, compiler_info string, endian string"
FLAGS = ", ".join(f"{c} boolean" for c in FEATURES)


def _struct(fields: str) -> str:
    return "struct<" + ", ".join(f"{a}: {b}" for a, b in (x.split() for x in fields.split(", "))) + ">"


PARSED = (
    f"artifact_id string, error string, {METADATA}, {FLAGS}, sections array<{_struct(SECTION)}>, symbols array<{_struct(SYMBOL)}>, "
    f"imports array<{_struct(IMPORT)}>, exports array<{_struct(EXPORT)}>"
)


def parse(artifacts: DataFrame, inline_limit: int = 1024, fallback: str | None = None) -> DataFrame:
    """One row of PARSED for each artifact; what cannot be parsed has an error and nulls.

    Sections of at most inline_limit bytes carry their data. Addresses from 2^63 on are negative.
    With fallback (Raw, say) that parser takes what is empty, null, or refused by the parser of
    its format; sizes of null content stay null.
    """
    detected = artifacts.withColumn("format", format_column()).select("artifact_id", "format", "content")
    names = [x.split()[0] for x in f"artifact_id string, error string, {METADATA}, {FLAGS}".split(", ")] + ["sections", "symbols", "imports", "exports"]

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for key, form, content in part.itertuples(index=False, name=None):
                try:
                    if form is None:
                        raise ParseError("empty data")
                    row = {"artifact_id": key, "error": None, **PARSERS[form](bytes(content), inline_limit)}
                except (ParseError, OverflowError, RecursionError) as e:
                    if fallback is None:
                        row = {"artifact_id": key, "error": str(e), "format": form, "size": len(content or b"")}
                    else:
                        row = {"artifact_id": key, "error": None, **PARSERS[fallback](bytes(content or b""), inline_limit)}
                        if content is None:
                            row |= {"size": None, "sections": [{**s, "size": None, "data": None} for s in row["sections"]]}
                out.append([row.get(n) for n in names])
            frame = pd.DataFrame(out, columns=names, dtype=object)
            for c in ("size", "entry_point", "base_address", "timestamp"):
                frame[c] = frame[c].astype("Int64")
            for c in FEATURES:
                frame[c] = frame[c].astype("boolean")
            yield frame

    return detected.mapInPandas(rows, PARSED)


def children(parsed: DataFrame, part: str) -> DataFrame:
    """sections, symbols, imports or exports, with artifact_id and ordinal."""
    return parsed.select("artifact_id", F.posexplode(part).alias("ordinal", "x")).select("artifact_id", "ordinal", "x.*")


def metadata(parsed: DataFrame) -> DataFrame:
    """One flat row an artifact, with its time stamp as a timestamp too."""
    flat = parsed.drop("sections", "symbols", "imports", "exports")
    return flat.withColumn("built", F.timestamp_seconds("timestamp"))
