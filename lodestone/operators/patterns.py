"""Byte, string, wildcard and magic patterns over artifacts."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pattern:
    """kind: bytes, string, hex (wildcards ??), magic (offset 0 only), regex or structural (no matches by default)."""

    name: str
    kind: str
    data: bytes | str
    category: str
    description: str = ""


@dataclass(frozen=True)
class MatchConfig:
    case_sensitive: bool = True
    #: Matches of an artifact; None for all.
    max_matches: int | None = 1000
    min_length: int = 3
    #: Strings match in content that is not UTF-8 too.
    latin1: bool = False
    #: Run regex patterns, which otherwise match nothing.
    regex: bool = False


#: The built-in signatures.
BUILTIN = (
    Pattern("PE_MZ", "magic", b"MZ", "FileFormat", "begins like a DOS or PE file"),
    Pattern("ELF", "magic", b"\x7fELF", "FileFormat", "begins like an ELF file"),
    Pattern("Mach_O_32", "magic", b"\xfe\xed\xfa\xce", "FileFormat", "begins like a Mach-O file of 32 bits"),
    Pattern("Mach_O_64", "magic", b"\xfe\xed\xfa\xcf", "FileFormat", "begins like a Mach-O file of 64 bits"),
    Pattern("GCC", "string", "GCC:", "Compiler", "GCC's comment"),
    Pattern("MSVC", "string", "Microsoft C/C++", "Compiler", "names Microsoft's compiler"),
    Pattern("UPX", "string", "UPX!", "Packer", "UPX's mark"),
    Pattern("MD5_Init", "bytes", b"\x01\x23\x45\x67", "Crypto", "a constant of MD5's start"),
    Pattern("Suspicious_API", "string", "VirtualAllocEx", "Malware", "a call that takes memory in another process"),
    Pattern("CreateProcess", "string", "CreateProcessA", "Api", "a call that starts a process"),
)


def builtin(*categories: str) -> list[Pattern]:
    """Built-in patterns of the categories, in the order asked for; all where none is named."""
    return [p for c in categories for p in BUILTIN if p.category == c] if categories else list(BUILTIN)


def hex_regex(pattern: str) -> bytes:
    """The bytes regex of a pattern like '48 ?? 6c'; ValueError for odd lengths, bad digits and empty patterns."""
    digits = pattern.replace(" ", "").replace("\n", "")
    if len(digits) % 2 or not digits:
        raise ValueError(f"a hex pattern needs whole bytes: {pattern!r}")
    cells = [digits[i : i + 2] for i in range(0, len(digits), 2)]
    return b"".join(b"." if c == "??" else re.escape(bytes([int(c, 16)])) for c in cells)


def _compile(p: Pattern, config: MatchConfig) -> tuple[re.Pattern | None, bool, bool]:
    """(regex with the match in group 1, whether the content must be UTF-8, whether its lower case is searched)."""
    raw = p.data.encode() if isinstance(p.data, str) else p.data
    if p.kind == "magic":
        return re.compile(rb"\A(?=(" + re.escape(raw) + rb"))", re.S), False, False
    if p.kind == "hex":
        body = hex_regex(p.data if isinstance(p.data, str) else p.data.decode())
        return re.compile(rb"(?=(" + body + rb"))", re.S), False, False
    if p.kind == "regex" and config.regex:
        return re.compile(rb"(?=(" + raw + rb"))", re.S), False, False
    if p.kind not in ("bytes", "string") or not raw or len(raw) < config.min_length:
        return None, False, False
    if p.kind == "string" and not config.case_sensitive:
        if config.latin1:
            return re.compile(rb"(?=(" + re.escape(raw) + rb"))", re.S | re.I), False, False
        return re.compile(rb"(?=(" + re.escape(raw.decode().lower().encode()) + rb"))", re.S), True, True
    return re.compile(rb"(?=(" + re.escape(raw) + rb"))", re.S), p.kind == "string" and not config.latin1, False


def search(artifacts: DataFrame, patterns: Sequence[Pattern] | None = None, config: MatchConfig | None = None) -> DataFrame:
    """artifact_id, pattern_idx, name, category, offset, length, data and confidence of every match.

    Matches overlap. An artifact has at most config.max_matches, in the order (pattern, offset).
    Strings match only where the whole content is UTF-8 (unless config.latin1). Without case
    sensitivity the lower case of content and pattern is compared (of ASCII letters alone with
    config.latin1); offset counts bytes of the lowered content and data are the content's own bytes
    there. Empty patterns match nothing.
    """
    config, patterns = config or MatchConfig(), list(BUILTIN if patterns is None else patterns)
    compiled = [_compile(p, config) for p in patterns]
    most = float("inf") if config.max_matches is None else config.max_matches

    @F.pandas_udf("array<struct<pattern_idx int, offset long, data binary>>")
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out = []
            for content in part:
                data, rows, text, low = bytes(content or b""), [], None, b""
                for i, (regex, needs_text, folded) in enumerate(compiled):
                    if regex is None or len(rows) >= most:
                        continue
                    if needs_text:
                        if text is None:
                            try:
                                text = data.decode()
                            except UnicodeDecodeError:
                                text = False
                        if text is False:
                            continue
                    if folded and not low and text:
                        low = text.lower().encode()
                    for m in regex.finditer(low if folded else data):
                        rows.append({"pattern_idx": i, "offset": m.start(), "data": data[m.start() : m.end(1)] if folded else m[1]})
                        if len(rows) >= most:
                            break
                out.append(rows)
            yield pd.Series(out, dtype=object)

    names = F.array(*[F.lit(p.name) for p in patterns]) if patterns else F.array(F.lit(""))
    kinds = F.array(*[F.lit(p.category) for p in patterns]) if patterns else F.array(F.lit(""))
    rows = artifacts.select("artifact_id", F.explode(found("content")).alias("m"))
    at = F.col("m.pattern_idx") + 1
    return rows.select(
        "artifact_id", "m.pattern_idx", F.element_at(names, at).alias("name"), F.element_at(kinds, at).alias("category"),
        "m.offset", F.length("m.data").alias("length"), "m.data", F.lit(1.0).alias("confidence"),
    )


def by_category(matches: DataFrame) -> DataFrame:
    """artifact_id, category and its matches in order."""
    return matches.groupBy("artifact_id", "category").agg(F.array_sort(F.collect_list(F.struct("pattern_idx", "offset", "length", "name"))).alias("matches"))


def top_categories(matches: DataFrame, each: int = 5) -> DataFrame:
    """Categories by number of matches, each with its first matches."""
    from pyspark.sql import Window

    totals = matches.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("category").orderBy("artifact_id", "pattern_idx", "offset")
    first = matches.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= each)
    return first.join(totals, "category").select("category", "n", "rank", "artifact_id", "name", "offset")
