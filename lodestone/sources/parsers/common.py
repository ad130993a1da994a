"""What the parsers share."""

from __future__ import annotations

import struct

FEATURES = ("nx_bit", "aslr", "stack_canary", "cfi", "fortify", "pie", "relro", "signed")


class ParseError(ValueError):
    """The bytes are not what their signature promises."""


def fields(data: bytes, form: str, at: int) -> tuple:
    """struct.unpack_from that raises ParseError where bytes are missing."""
    if at < 0 or at + struct.calcsize(form) > len(data):
        raise ParseError(f"{struct.calcsize(form)} bytes at {at} are beyond the end")
    return struct.unpack_from(form, data, at)


def text_at(data: bytes, at: int, most: int = 4096) -> str | None:
    """Text up to a NUL; None where there is none or it is not UTF-8."""
    if not 0 <= at < len(data):
        return None
    end = data.find(b"\0", at, at + most)
    try:
        return data[at : end if end >= 0 else at + most].decode()
    except UnicodeDecodeError:
        return None


def signed(value: int | None) -> int | None:
    """An unsigned 64-bit number as the long with the same bits."""
    return value - (1 << 64) if value is not None and value >= 1 << 63 else value


def inline(data: bytes, offset: int, size: int, limit: int) -> bytes | None:
    """The bytes of a section no longer than limit that lies in the file."""
    return data[offset : offset + size] if size <= limit and 0 <= offset and offset + size <= len(data) else None


def section(name: str, address: int, size: int, offset: int, perms: tuple[bool, bool, bool], kind: str, data: bytes | None) -> dict:
    return {
        "name": name, "address": signed(address), "size": signed(size), "offset": signed(offset), "perm_read": perms[0], "perm_write": perms[1],
        "perm_execute": perms[2], "section_type": kind, "data": data,
    }


def symbol(name: str, address: int = 0, size: int = 0, kind: str = "Object", binding: str = "Global", visibility: str = "Default", index: int | None = None, demangled: str | None = None) -> dict:
    return {
        "name": name, "demangled_name": demangled, "address": signed(address), "size": signed(size), "symbol_type": kind, "binding": binding,
        "visibility": visibility, "section_index": index,
    }


def imported(name: str, library: str | None = None, address: int | None = None, ordinal: int | None = None) -> dict:
    return {"name": name, "library": library, "address": signed(address), "import_ordinal": ordinal}


def exported(name: str, address: int, forwarded: str | None = None) -> dict:
    return {"name": name, "address": signed(address), "export_ordinal": None, "forwarded_name": forwarded}


def parsed(data: bytes, form: str, architecture: str, endian: str, entry: int | None = None, base: int | None = None, timestamp: int | None = None, compiler: str | None = None, features: dict | None = None, sections=(), symbols=(), imports=(), exports=()) -> dict:
    return {
        "size": len(data), "format": form, "architecture": architecture, "entry_point": signed(entry), "base_address": signed(base), "timestamp": timestamp,
        "compiler_info": compiler, "endian": endian, **dict.fromkeys(FEATURES, False), **(features or {}), "sections": list(sections), "symbols": list(symbols),
        "imports": list(imports), "exports": list(exports),
    }
