"""ELF files of both classes and byte orders."""

from __future__ import annotations

from .common import ParseError, exported, fields, imported, inline, parsed, section, symbol, text_at

#: The ELF specification's numbers.
MACHINES = {3: "X86", 62: "X86_64", 40: "Arm", 183: "Arm64", 8: "Mips", 20: "PowerPC", 21: "PowerPC64", 243: "RiscV"}
SECTION_KINDS = {8: "Bss", 2: "Symbol", 3: "String", 4: "Relocation", 9: "Relocation", 6: "Dynamic", 7: "Note"}
SYMBOL_KINDS = {2: "Function", 1: "Object", 3: "Section", 4: "File", 5: "Common", 6: "Thread"}
BINDINGS = {0: "Local", 1: "Global", 2: "Weak"}
VISIBILITIES = {0: "Default", 1: "Internal", 2: "Hidden", 3: "Protected"}
PROGBITS, SYMTAB, NOBITS, DYNSYM = 1, 2, 8, 11
WRITE, EXEC = 1, 4
GNU_STACK, GNU_RELRO, DYN = 0x6474E551, 0x6474E552, 3


def parse(data: bytes, limit: int = 1024) -> dict:
    if len(data) < 16 or data[:4] != b"\x7fELF":
        raise ParseError("not an ELF file")
    if data[4] not in (1, 2) or data[5] not in (1, 2):
        raise ParseError("unknown ELF class or byte order")
    wide, order = data[4] == 2, "<" if data[5] == 1 else ">"
    head = fields(data, order + ("HHIQQQIHHHHHH" if wide else "HHIIIIIHHHHHH"), 16)
    kind, machine, _, entry, phoff, shoff, _, _, phsize, phnum, shsize, shnum, strings = head

    segments = []
    for i in range(phnum if phoff else 0):
        at = phoff + i * phsize
        p = fields(data, order + ("IIQQQQQQ" if wide else "IIIIIIII"), at)
        segments.append((p[0], p[1] if wide else p[6]))
    rows = []
    for i in range(shnum if shoff else 0):
        # name, type, flags, address, offset, size, link, info, alignment, entry size
        rows.append(fields(data, order + ("IIQQQQIIQQ" if wide else "IIIIIIIIII"), shoff + i * shsize))
    table = rows[strings] if strings < len(rows) else None

    def string(of: tuple | None, at: int) -> str | None:
        if of is None or at >= of[5] or of[1] == NOBITS:
            return None
        return text_at(data[: of[4] + of[5]], of[4] + at)

    names = [string(table, r[0]) for r in rows]
    sections = []
    for i, (row, name) in enumerate(zip(rows, names, strict=True)):
        _, what, flags, address, offset, size = row[:6]
        name = f".section_{i}" if name is None else name
        if what == PROGBITS:
            label = "Debug" if name.startswith((".debug_", ".zdebug_")) else "Code" if flags & EXEC else "Data" if flags & WRITE else "ReadOnlyData"
        else:
            label = SECTION_KINDS.get(what, f"Other:SHT_{what}")
        body = None if what == NOBITS else inline(data, offset, size, limit)
        sections.append(section(name, address, size, offset, (True, bool(flags & WRITE), bool(flags & EXEC)), label, body))

    def symbols_of(what: int):
        for row in rows:
            if row[1] == what:
                linked = rows[row[6]] if row[6] < len(rows) else None
                step = 24 if wide else 16
                for at in range(row[4], min(row[4] + row[5], len(data)) - step + 1, step):
                    if wide:
                        n, info, other, index, value, size = fields(data, order + "IBBHQQ", at)
                    else:
                        n, value, size, info, other, index = fields(data, order + "IIIBBH", at)
                    name = string(linked, n)
                    if (name := "unknown" if name is None else name) != "":
                        yield name, info, other, index, value, size
                return

    symbols = [
        symbol(name, value, size, SYMBOL_KINDS.get(info & 15, f"Other:STT_{info & 15}"), BINDINGS.get(info >> 4, f"Other:STB_{info >> 4}"), VISIBILITIES[other & 3], index or None, f"demangled_{name}" if name.startswith("_Z") else None)
        for name, info, other, index, value, size in symbols_of(SYMTAB)
    ]
    imports, exports = [], []
    for name, info, _, index, value, _ in symbols_of(DYNSYM):
        if index == 0:
            imports.append(imported(name))
        elif info >> 4 == 1:
            exports.append(exported(name, value))

    stack = [flags for what, flags in segments if what == GNU_STACK]
    features = {"nx_bit": bool(stack) and not stack[-1] & 1, "pie": kind == DYN, "aslr": kind == DYN, "relro": any(what == GNU_RELRO for what, _ in segments)}
    return parsed(data, "Elf", MACHINES.get(machine, "Unknown"), "Little" if order == "<" else "Big", entry or None, compiler=_compiler(data, rows, names), features=features, sections=sections, symbols=symbols, imports=imports, exports=exports)


def _compiler(data: bytes, rows: list[tuple], names: list[str | None]) -> str | None:
    """The .comment text, or what the names of sections tell."""
    for row, name in zip(rows, names, strict=True):
        if name == ".comment" and row[4] + row[5] <= len(data):
            if text := data[row[4] : row[4] + row[5]].decode("utf-8", "replace").rstrip("\0").strip():
                return text
    known = [n for n in names if n is not None]
    if any("go." in n for n in known):  # .go.buildinfo among them
        return "Go compiler"
    return "Rust compiler" if any("rust" in n for n in known) else None
