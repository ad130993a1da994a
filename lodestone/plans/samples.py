"""Small executables whose every field follows from one number, so that SQL over a table of numbers can say what parsing must give.

content(k) is an artifact for the number k; its format is k modulo 7, and what varies in it is a
function of k and of n = k // 7.
"""

from __future__ import annotations

import gzip
import io
import struct
import zipfile
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: push rbp; mov rbp, rsp; jump over a trap; call and return; the same bytes make sense with 32 bits.
CODE = bytes.fromhex("55" "4889e5" "7501" "cc" "e801000000" "90" "c3")
ELF_MACHINES = (3, 62, 40, 183, 8, 20, 21, 243, 999)
PE_MACHINES = (0x14C, 0x8664, 0x1C0, 0xAA64, 1)
MACHO_CPUS = (7, 0x1000007, 12, 0x100000C, 18, 0x1000012, 99)
COMPILERS = ((".comment", b"GCC: (sample) 13\0"), (".go.buildinfo", b"x"), (".rustc", b"x"), (".plain", b"x"))


def _names(names: list[str]) -> tuple[bytes, list[int]]:
    """A string table that begins with an empty name, and the places of the names."""
    out, at = b"\0", []
    for n in names:
        at.append(len(out))
        out += n.encode() + b"\0"
    return out, at


def elf(k: int) -> bytes:
    n, wide = k // 7, k % 7 == 0
    order = "<" if wide else ">"

    def symbols(rows: list[tuple[str, int, int, int, int, int]]) -> tuple[bytes, bytes]:
        """name, info, visibility, section, value, size."""
        strings, at = _names([r[0] for r in rows])
        out = b""
        for place, (name, info, other, index, value, size) in zip(at, rows, strict=True):
            place = place if name else 0
            out += struct.pack(order + "IBBHQQ", place, info, other, index, value, size) if wide else struct.pack(order + "IIIBBH", place, value, size, info, other, index)
        return out, strings

    start = 0x401000 + 16 * k
    table, strings = symbols([("", 0, 0, 0, 0, 0), ("main", 0x12, 0, 1, start, 14), ("_Z3foov", 0x22, 2, 1, start + 4, k % 9), ("local", 0x01, 1, 2, 8, 4), ("file.c", 0x04, 3, 0, 0, 0), ("odd", 0x3F, 0, 0, 0, 0)])
    dynamic, dynamic_strings = symbols([("", 0, 0, 0, 0, 0), ("printf", 0x12, 0, 0, 0, 0), ("api", 0x12, 0, 1, start + 8, 1), ("weak", 0x22, 0, 1, start, 1)])
    # name, type, flags, address, content (or size of what has none), link
    rows = [
        (".text", 1, 6, start, CODE + bytes(k % 32), 0), (".data", 1, 3, 0x500000, bytes(8), 0), (".rodata", 1, 2, 0x510000, bytes(k % 3), 0), (".debug_info", 1, 0, 0, b"d", 0),
        (".bss", 8, 3, 0x520000, k % 2000, 0), (".note", 7, 2, 0, b"n", 0), (".rela", 4, 2, 0, b"", 0), (".dynamic", 6, 3, 0, b"", 0), (".odd", 99, 0, 0, b"", 0), (".big", 1, 2, 0x530000, bytes(2000), 0),
        (".symtab", 2, 0, 0, table, 12), (".strtab", 3, 0, 0, strings, 0), (".dynsym", 11, 2, 0, dynamic, 14), (".dynstr", 3, 2, 0, dynamic_strings, 0), (COMPILERS[n % 4][0], 1, 0, 0, COMPILERS[n % 4][1], 0),
    ]
    names, at = _names([r[0] for r in rows] + [".shstrtab"])
    rows.append((".shstrtab", 3, 0, 0, names, 0))
    segments = [(0x6474E551, 6 + k % 2)] * (k % 5 != 0) + [(0x6474E552, 4)] * (k % 3 == 0)
    head, step = (64, 56) if wide else (52, 32)
    body, table = b"", [bytes(64 if wide else 40)]
    first = head + step * len(segments)
    for place, (_, what, flags, address, content, link) in zip(at, rows, strict=True):
        size = content if isinstance(content, int) else len(content)
        # The table's first row is the empty section, so links count from 1.
        table.append(struct.pack(order + ("IIQQQQIIQQ" if wide else "IIIIIIIIII"), place, what, flags, address, first + len(body), size, link, 0, 1, 0))
        body += b"" if isinstance(content, int) else content
    parts = b"".join(struct.pack("<IIQQQQQQ", t, f, 0, 0, 0, 0, 0, 0) if wide else struct.pack(">IIIIIIII", t, 0, 0, 0, 0, 0, f, 0) for t, f in segments)
    entry = 0 if k % 3 == 0 else start
    top = b"\x7fELF" + bytes([2 if wide else 1, 1 if wide else 2, 1]) + bytes(9)
    top += struct.pack(order + ("HHIQQQIHHHHHH" if wide else "HHIIIIIHHHHHH"), 3 if n % 2 == 0 else 2, ELF_MACHINES[n % 9], 1, entry, head if segments else 0, first + len(body), 0, head, step, len(segments), 64 if wide else 40, len(table), len(table) - 1)
    return top + parts + body + b"".join(table)


def pe(k: int) -> bytes:
    n, wide = k // 7, k % 7 == 2
    traits = 0x100 * (k % 2) + 0x40 * (k % 3 == 0) + 0x4000 * (k % 5 == 0)
    one, size = ("<Q", 8) if wide else ("<I", 4)
    # A section of data at 0x2000 holds what the folders name: imports of two libraries, then exports.
    blob = bytearray(1024)

    def put(at: int, data: bytes) -> int:
        blob[at : at + len(data)] = data
        return 0x2000 + at

    by_name = put(0x100, struct.pack("<H", 7) + b"VirtualAllocEx\0")
    kernel, user = put(0x120, b"KERNEL32.dll\0"), put(0x130, b"user32.dll\0")
    flag = 1 << (63 if wide else 31)
    lookup = put(0x140, struct.pack(one, by_name) + struct.pack(one, flag | k % 1000) + bytes(size))
    other = put(0x180, struct.pack(one, by_name) + bytes(size))
    put(0, struct.pack("<IIIII", lookup, 0, 0, kernel, 0x2500) + struct.pack("<IIIII", 0, 0, 0, user, other) + bytes(20))
    forward, run, fwd = put(0x270, b"lib.func\0"), put(0x280, b"run\0"), put(0x288, b"fwd\0")
    functions, names, ordinals = put(0x240, struct.pack("<II", 0x1000 + k % 256, forward)), put(0x250, struct.pack("<II", run, fwd)), put(0x260, struct.pack("<HH", 0, 1))
    exports = put(0x200, struct.pack("<IIHHIIIIIII", 0, 0, 0, 0, 0, 1, 2, 2, functions, names, ordinals))
    base = 0x140000000 if wide else 0x400000
    optional = struct.pack("<HBBIIIII", 0x20B if wide else 0x10B, 0, 0, 0, 0, 0, 0x1000 + k % 256, 0x1000)
    optional += struct.pack("<Q", base) if wide else struct.pack("<II", 0x2000, base)
    optional += struct.pack("<IIHHHHHHIIIIHH", 0x1000, 0x200, 6, 0, 0, 0, 6, 0, 0, 0x6000, 0x200, 0, 3, traits) + bytes(4 * size) + struct.pack("<II", 0, 16)
    folders = [(exports, 0x90), (0x2000, 60), (0, 0), (0, 0), (0, 8 * (k % 4 == 1))] + [(0, 0)] * 11
    optional += b"".join(struct.pack("<II", *f) for f in folders)
    rows = [(b".text", 14, 0x1000, 512, 0x400, 0x60000020), (b".data", 1024, 0x2000, 1024, 0x600, 0xC0000040), (b".rdata", k % 64, 0x3000, 2048, 0xA00, 0x40000040), (b".bss", 99, 0x4000, 0, 0, 0xC0000080), (b".odd", 1, 0x5000, 0, 0, 0x40000000)]
    head = b"MZ" + bytes(58) + struct.pack("<I", 64) + b"PE\0\0" + struct.pack("<HHIIIHH", PE_MACHINES[n % 5], len(rows), 1_600_000_000 + k, 0, k % 4, len(optional), 0x22) + optional
    head += b"".join(struct.pack("<8sIIIIIIHHI", name, virtual, rva, raw, at, 0, 0, 0, 0, flags) for name, virtual, rva, raw, at, flags in rows)
    return head.ljust(0x400, b"\0") + CODE.ljust(512, b"\0") + bytes(blob) + bytes(2048)


def macho(k: int) -> bytes:
    n = k // 7
    wide, order = n % 2 == 0, "<" if n % 4 < 2 else ">"
    sections = [(b"__text", 0x80000400), (b"__data", 0), (b"__const", 0), (b"__bss", 1), (b"__debug_line", 0), (b"__other", 0)]
    segment = struct.pack(order + ("16sQQQQIIII" if wide else "16sIIIIIIII"), b"__TEXT", 0x1000, 4096, 0, 4096, 7, 5 if k % 2 else 3, len(sections), 0)
    for i, (name, flags) in enumerate(sections):
        size, offset = len(CODE) if i == 0 else 8 * i + k % 8, 0 if name == b"__bss" else 1024 + 64 * i
        segment += struct.pack(order + ("16s16sQQIIIIIIII" if wide else "16s16sIIIIIIIII"), name, b"__TEXT", 0x1000 + 64 * i, size, offset, 0, 0, 0, flags, *[0] * (3 if wide else 2))
    library = struct.pack(order + "IIII", 24, 2, 0x10000, 0x10000) + b"/usr/lib/libSystem.dylib\0".ljust(32, b"\0")
    bind = bytes([0x11, 0x40]) + b"_printf\0" + bytes([0x51, 0x70, k % 100, 0x90, 0x40]) + b"_puts\0" + bytes([0x90, 0])
    trie = bytes([0, 1]) + b"_main\0" + bytes([9, 3, 0, 0x80 | k % 128, 1, 0])
    at = 1024 + 64 * len(sections)
    info = struct.pack(order + "10I", 0, 0, at, len(bind), 0, 0, 0, 0, at + 64, len(trie))
    commands = [(0x19 if wide else 1, segment), (0xC, library), (0x80000022, info)]
    body = b"".join(struct.pack(order + "II", kind, 8 + len(c)) + c for kind, c in commands)
    head = struct.pack(order + "IIIIIII", 0xFEEDFACF if wide else 0xFEEDFACE, MACHO_CPUS[n % 7], 3, 2, len(commands), len(body), 0x200000 * (k % 2)) + bytes(4 * wide)
    return ((head + body).ljust(1024, b"\0") + CODE).ljust(at, b"\0") + bind.ljust(64, b"\0") + trie


def java(k: int) -> bytes:
    n = k // 7
    if n % 3 == 2:
        return b"\xca\xfe\xba\xbe"
    if n % 3 == 0:
        return b"\xca\xfe\xba\xbe" + struct.pack(">HH", k % 4, 45 + k % 20) + bytes(k % 9)
    return _zip([("a/B.class", k % 100), ("readme.txt", 3), ("C.class", 7)])


def _zip(entries: list[tuple[str, int]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, size in entries:
            z.writestr(zipfile.ZipInfo(name), bytes(size))
    return out.getvalue()


def wasm(k: int) -> bytes:
    def part(kind: int, body: bytes) -> bytes:
        return bytes([kind, 0x80 | len(body) & 0x7F, len(body) >> 7]) + body

    text = lambda s: bytes([len(s)]) + s.encode()
    out = b"\0asm" + struct.pack("<I", 1) + part(0, text("note") + bytes(k % 50)) + part(1, bytes.fromhex("0160027f7f017f"))
    out += part(2, b"\2" + text("env") + text(f"f{k % 10}") + b"\0\0" + text("env") + text("memory") + b"\2\0\1") + part(3, b"\1\0") + part(7, b"\2" + text("add") + b"\0\1" + text(f"g{k % 5}") + b"\0\1")
    if k % 3:
        out += part(8, bytes([k % 3]))
    return out + part(10, bytes.fromhex("010700200020016a0b")) + part(11, b"\1\0" + bytes(k % 7))


def rest(k: int) -> bytes:
    """Wasm, an archive without classes, text, an ELF file that is cut off, or nothing."""
    kinds = (wasm, lambda k: _zip([("readme.txt", k % 100)]), lambda k: b"t" * (1 + k % 2000), lambda k: b"\x7fELF\x02\x01" + bytes(k % 9), lambda k: b"")
    return kinds[k // 7 % 5](k)


KINDS = (elf, elf, pe, pe, macho, java, rest)


def content(k: int) -> bytes:
    return KINDS[k % 7](k)


def binaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An artifact for each row of part."""

    @F.pandas_udf("binary")
    def made(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: content(int(k)))

    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    rows = parts.select(F.col("p_partkey").cast("string").alias("artifact_id"), made("p_partkey").alias("content"))
    return rows.withColumn("length", F.length("content").cast("long"))


def dense_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An artifact of one chunk for each row of part: every byte alike often, or 64 bytes alike often behind a cipher's constant, a gzip mark or nothing."""
    few = F.repeat(F.unhex(F.lit(bytes(range(64, 128)).hex())).cast("string"), 15)
    every = F.unhex(F.lit(bytes(range(256)).hex() * 4))
    kind = F.pmod("p_partkey", F.lit(4))
    content = F.when(kind == 0, every)
    for k, mark in ((1, b"\x67\x45\x23\x01"), (2, b"\x1f\x8b\x08\x00"), (3, b"none")):
        content = content.when(kind == k, F.concat(F.unhex(F.lit(mark.hex())), few.cast("binary")))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return parts.select(F.col("p_partkey").cast("string").alias("artifact_id"), content.alias("content"))


def compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An artifact for each row of part: p_partkey modulo 300 bytes by gzip or zlib, cut off or not packed at all, in turn."""

    @F.pandas_udf("binary")
    def made(keys: pd.Series) -> pd.Series:
        def one(k: int) -> bytes:
            data = b"x" * (k % 300)
            packed = gzip.compress(data, mtime=0) if k % 4 in (0, 2) else zlib.compress(data)
            return (packed, packed, packed[:12], data)[k % 4]

        return keys.map(one)

    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return parts.select(F.col("p_partkey").cast("string").alias("artifact_id"), made("p_partkey").alias("content"))
