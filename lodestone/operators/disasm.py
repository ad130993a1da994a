"""Instructions of sections and functions, by an engine for each architecture."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.instructions import category
from . import x86_batch
from .sections import executable

#: Architectures that this library decodes, to their word size.
X86 = {"X86_64": 64, "X86": 32}
#: Other engines: architecture to a function of (bytes, address, most) that gives x86.Instruction-like records.
ENGINES: dict[str, Callable[[bytes, int, int], list]] = {}
FIELDS = {
    "artifact_id": (pa.string(), "string"), "function_addr": (pa.int64(), "long"), "idx": (pa.int32(), "int"), "address": (pa.int64(), "long"), "bytes": (pa.binary(), "binary"),
    "mnemonic": (pa.string(), "string"), "operands": (pa.string(), "string"), "flow_kind": (pa.string(), "string"), "flow_target": (pa.int64(), "long"), "size": (pa.int32(), "int"),
    "engine": (pa.string(), "string"), "error": (pa.string(), "string"),
}


def register(architecture: str, engine: Callable[[bytes, int, int], list]) -> None:
    """Uses the engine for code of the architecture."""
    ENGINES[architecture] = engine


def _signed(value: int | None) -> int | None:
    return value - (1 << 64) if value is not None and value >= 1 << 63 else value


def _by_engine(engine: Callable[[bytes, int, int], list], key: tuple, address: int, data: bytes, most: int, names: Sequence[str]) -> pa.RecordBatch:
    """The rows of one piece of code, by a registered engine."""
    start = address & (1 << 64) - 1
    rows = []
    for k, i in enumerate(engine(data, start, most)):
        at = i.address - start
        rows.append((*key, k, _signed(i.address), data[at : at + i.size], i.mnemonic, i.operands, i.flow, _signed(i.target), i.size, "registered", None))
    columns = dict(zip(FIELDS, zip(*rows, strict=True), strict=True)) if rows else {}
    return pa.RecordBatch.from_arrays([pa.array(columns.get(n, ()), FIELDS[n][0]) for n in names], names=list(names))


def _x86_batches(keys: list[tuple], addresses: list[int], contents: list[bytes], bits: int, most: int, names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """The rows of many pieces of code; columns that are not asked for are not made."""
    artifact, function = pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64())
    base = np.array(addresses, np.int64)
    flows = pa.array(x86_batch.FLOWS)
    last, count = -1, 0  # the content that the window before ended in, and its instructions so far
    for found in x86_batch.sweep_all(contents, addresses, bits, most):
        n = len(found.size)
        if not n:
            continue
        content = found.content
        first = np.flatnonzero(np.concatenate(([True], content[1:] != content[:-1])))
        idx = np.arange(n) - np.repeat(first, np.diff(np.append(first, n))) + np.where(content == last, count, 0)
        last, count = int(content[-1]), int(idx[-1]) + 1
        columns: dict[str, pa.Array] = {}
        if "artifact_id" in names:
            columns["artifact_id"] = artifact.take(pa.array(content))
        if "function_addr" in names:
            columns["function_addr"] = function.take(pa.array(content))
        if "address" in names:
            columns["address"] = pa.array(base[content] + found.offset)
        if "bytes" in names or "operands" in names:
            codes = [contents[c][o : o + s] for c, o, s in zip(content.tolist(), found.offset.tolist(), found.size.tolist(), strict=True)]
            if "bytes" in names:
                columns["bytes"] = pa.array(codes, pa.binary())
            if "operands" in names:
                columns["operands"] = pa.array(x86_batch.operand_texts(codes, found.target, found.has_target, bits), pa.string())
        if "mnemonic" in names:
            columns["mnemonic"] = pa.array(list(x86_batch.heads(bits).names), pa.string()).take(pa.array(found.mnemonic))
        if "flow_kind" in names:
            columns["flow_kind"] = flows.take(pa.array(found.flow))
        if "flow_target" in names:
            columns["flow_target"] = pa.array(found.target, mask=~found.has_target)
        if "engine" in names:
            columns["engine"] = pa.repeat("x86", n)
        columns |= {"idx": pa.array(idx.astype(np.int32)), "size": pa.array(found.size)}
        yield pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, FIELDS[c][0]) for c in names], names=list(names))


def disassemble(code: DataFrame, most: int = 10_000, columns: Sequence[str] | None = None) -> DataFrame:
    """Instructions of code (artifact_id, function_addr, architecture, address, data).

    Gives artifact_id, function_addr, idx, address, bytes, mnemonic, operands, flow_kind,
    flow_target, size, engine, error and category; for an architecture without an engine one row
    with error and no mnemonic. With columns only these are made, in that order: text of operands
    costs more than all else.
    """
    wanted = [*FIELDS, "category"] if columns is None else list(columns)
    names = [c for c in wanted if c != "category"]
    if "category" in wanted and "mnemonic" not in names:
        names.append("mnemonic")

    def decoded(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            by_bits: dict[int, list[tuple]] = {}
            for artifact, function, architecture, address, content in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if (engine := ENGINES.get(architecture)) is not None:
                    yield _by_engine(engine, (artifact, function), address, content or b"", most, names)
                elif architecture in X86:
                    by_bits.setdefault(X86[architecture], []).append(((artifact, function), address, content or b""))
                else:
                    row = {"artifact_id": artifact, "function_addr": function, "error": f"no engine for {architecture}"}
                    yield pa.RecordBatch.from_arrays([pa.array([row.get(n)], FIELDS[n][0]) for n in names], names=names)
            for bits, rows in by_bits.items():
                yield from _x86_batches(*map(list, zip(*rows, strict=True)), bits, most, names)

    rows = code.select("artifact_id", "function_addr", "architecture", "address", "data").mapInArrow(decoded, ", ".join(f"{n} {FIELDS[n][1]}" for n in names))
    kind = F.when(F.col("mnemonic").isNotNull(), category("mnemonic")).alias("category")
    return rows.select(*[kind if c == "category" else c for c in wanted])


def section_code(parsed_metadata: DataFrame, sections: DataFrame) -> DataFrame:
    """Executable sections as code, each as one function at its address."""
    s = executable(sections).select("artifact_id", F.col("address").alias("function_addr"), "address", "data")
    return s.join(parsed_metadata.select("artifact_id", "architecture"), "artifact_id")


def function_code(parsed_metadata: DataFrame, sections: DataFrame, functions: DataFrame) -> DataFrame:
    """The bytes of functions (artifact_id, start, size), from the first section that holds their start, clipped to it."""
    from .sections import locate

    held = locate(functions, sections.drop("offset"), "start")
    data = sections.select(F.col("artifact_id").alias("d_id"), F.col("ordinal").alias("d_ordinal"), "data")
    both = held.join(data, (held["artifact_id"] == data["d_id"]) & (held["ordinal"] == data["d_ordinal"])).where("data is not null")
    part = F.substring(F.col("data"), (F.col("start") - F.col("address") + 1).cast("int"), F.col("size").cast("int"))
    code = both.select("artifact_id", F.col("start").alias("function_addr"), F.col("start").alias("address"), part.alias("data")).where(F.length("data") > 0)
    return code.join(parsed_metadata.select("artifact_id", "architecture"), "artifact_id")
