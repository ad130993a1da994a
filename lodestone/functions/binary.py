"""Expressions over binary columns, all on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _pos(n: Column | int) -> Column:
    return n if isinstance(n, Column) else F.lit(n)


def latin1(content: Column | str) -> Column:
    """The bytes as text, one character each, for the string functions."""
    return F.decode(_col(content), "ISO-8859-1")


def view(content: Column | str, offset: Column | int, length: Column | int) -> Column:
    """Bytes offset to offset + length; null where they are not all there."""
    c, o, n = _col(content), _pos(offset), _pos(length)
    return F.when((o >= 0) & (n >= 0) & (o + n <= F.length(c)), F.substring(c, (o + 1).cast("int"), n.cast("int")))


def uint(content: Column | str, offset: Column | int, size: int, endian: str = "little") -> Column:
    """An unsigned integer of 1, 2, 4 or 8 bytes as a long (8 bytes: as decimal(20,0)); null on a short read."""
    digits = F.hex(view(content, offset, size))
    if endian == "little":
        digits = F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))])
    return F.conv(digits, 16, 10).cast("decimal(20,0)" if size == 8 else "long")


def cstring(content: Column | str, offset: Column | int, limit: int) -> Column:
    """Text from offset up to a NUL or limit bytes; null where it is not UTF-8 or begins beyond the end."""
    c, o = _col(content), _pos(offset)
    part = F.substring(c, (o + 1).cast("int"), F.lit(limit))
    end = F.locate("\u0000", latin1(part))
    body = F.when(end > 0, F.substring(part, F.lit(1), (end - 1).cast("int"))).otherwise(part)
    text = body.cast("string")
    return F.when((o >= 0) & (o <= F.length(c)) & F.is_valid_utf8(text), text)


def starts_with(content: Column | str, prefix: bytes) -> Column:
    return F.startswith(_col(content), F.lit(prefix))


def contains(content: Column | str, needle: bytes) -> Column:
    return F.contains(_col(content), F.lit(needle))


def regex_of(needle: bytes) -> str:
    """A regular expression over latin-1 text that matches exactly these bytes."""
    return "".join(f"\\x{b:02x}" for b in needle)


def count_overlapping(content: Column | str, regex: str) -> Column:
    """Overlapping matches of a latin-1 regular expression."""
    return F.regexp_count(latin1(content), F.lit(f"(?s)(?={regex})")).cast("long")


def hexdump(content: Column | str) -> Column:
    """Lines of 16 bytes: offset, bytes with a gap after the eighth, printable characters."""
    c = _col(content)

    def line(at: Column) -> Column:
        row = F.substring(c, (at + 1).cast("int"), F.lit(16))
        cells = F.rpad(F.regexp_replace(F.lower(F.hex(row)), "(..)", "$1 "), 48, " ")
        shown = F.regexp_replace(latin1(row), "[^\\x20-\\x7e]", ".")
        return F.concat(F.format_string("%08x: ", at), F.substring(cells, 1, 24), F.lit(" "), F.substring(cells, 25, 24), F.lit(" |"), shown, F.lit("|"))

    last = F.length(c) - 1
    return F.when(F.length(c) == 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), last, F.lit(16)), line), "\n"))


def address(value: Column | str) -> Column:
    """0x and lower-case hexadecimal digits; negative longs are addresses from 2^63 on."""
    return F.concat(F.lit("0x"), F.lower(F.hex(_col(value))))
