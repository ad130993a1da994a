"""PE files, 32 and 64 bits."""

from __future__ import annotations

from .common import ParseError, exported, fields, imported, inline, parsed, section, text_at

#: The PE specification's numbers.
MACHINES = {0x14C: "X86", 0x8664: "X86_64", 0x1C0: "Arm", 0xAA64: "Arm64"}
CODE, INITIALISED, UNINITIALISED = 0x20, 0x40, 0x80
EXECUTE, READ, WRITE = 0x20000000, 0x40000000, 0x80000000
NX, DYNAMIC_BASE, GUARD_CF = 0x100, 0x40, 0x4000


def parse(data: bytes, limit: int = 1024) -> dict:
    if data[:2] != b"MZ":
        raise ParseError("not a PE file")
    (at,) = fields(data, "<I", 0x3C)
    if data[at : at + 4] != b"PE\0\0":
        raise ParseError("no PE signature")
    machine, count, stamp, _, n_symbols, optional, _ = fields(data, "<HHIIIHH", at + 4)
    start, base, entry, traits, folders = at + 24, None, None, 0, []
    if optional:
        (magic,) = fields(data, "<H", start)
        if magic not in (0x10B, 0x20B):
            raise ParseError(f"optional header magic {magic:#x}")
        wide = magic == 0x20B
        (first,) = fields(data, "<I", start + 16)
        (base,) = fields(data, "<Q" if wide else "<I", start + (24 if wide else 28))
        (traits,) = fields(data, "<H", start + 70)
        (n,) = fields(data, "<I", start + (108 if wide else 92))
        entry = first + base
        folders = [fields(data, "<II", start + (112 if wide else 96) + 8 * i) for i in range(min(n, 16))]
    else:
        wide = False

    rows, sections = [], []
    for i in range(count):
        name, size, rva, raw, offset, *_, flags = fields(data, "<8sIIIIIIHHI", start + optional + 40 * i)
        rows.append((rva, max(size, raw), offset, raw))
        kind = "Code" if flags & CODE else ("Data" if flags & WRITE else "ReadOnlyData") if flags & INITIALISED else "Bss" if flags & UNINITIALISED else "Other:PE_SECTION"
        body = inline(data, offset, raw, limit) if offset else None
        sections.append(section(name.decode("utf-8", "replace").rstrip("\0"), rva, size, offset, (bool(flags & READ), bool(flags & WRITE), bool(flags & EXECUTE)), kind, body))

    def where(rva: int) -> int:
        for first, size, offset, raw in rows:
            if first <= rva < first + size and rva - first < raw:
                return offset + rva - first
        raise ParseError(f"address {rva:#x} is in no section")

    folder = lambda i: folders[i] if i < len(folders) else (0, 0)
    features = {"nx_bit": bool(traits & NX), "aslr": bool(traits & DYNAMIC_BASE), "pie": bool(traits & DYNAMIC_BASE), "cfi": bool(traits & GUARD_CF), "signed": folder(4)[1] > 0}
    return parsed(
        data, "Pe", MACHINES.get(machine, "Unknown"), "Little", entry, base, stamp, "MSVC (detected from symbols)" if n_symbols else None, features, sections,
        imports=_imports(data, folder(1), where, wide), exports=_exports(data, folder(0), where),
    )


def _imports(data: bytes, folder: tuple[int, int], where, wide: bool) -> list[dict]:
    out: list[dict] = []
    if not folder[0]:
        return out
    at = where(folder[0])
    while True:
        lookup, _, _, name, table = fields(data, "<IIIII", at)
        if not name:
            return out
        library, step = text_at(data, where(name)) or "", 8 if wide else 4
        entry, slot = where(lookup or table), table
        while (value := fields(data, "<Q" if wide else "<I", entry)[0]) != 0:
            if value >> (63 if wide else 31):
                out.append(imported(f"ORDINAL {value & 0xFFFF}", library, slot, value & 0xFFFF))
            else:
                hint = where(value & 0x7FFFFFFF)
                out.append(imported(text_at(data, hint + 2) or "", library, slot, fields(data, "<H", hint)[0]))
            entry, slot = entry + step, slot + step
        at += 20


def _exports(data: bytes, folder: tuple[int, int], where) -> list[dict]:
    if not folder[0]:
        return []
    *_, n_functions, n_names, functions, names, ordinals = fields(data, "<IIHHIIIIIII", where(folder[0]))
    out = []
    for i in range(n_names):
        name = text_at(data, where(fields(data, "<I", where(names) + 4 * i)[0]))
        (k,) = fields(data, "<H", where(ordinals) + 2 * i)
        if name and k < n_functions:
            (rva,) = fields(data, "<I", where(functions) + 4 * k)
            inside = folder[0] <= rva < folder[0] + folder[1]
            out.append(exported(name, rva, text_at(data, where(rva)) if inside else None))
    return out
