"""Mach-O files of one architecture."""

from __future__ import annotations

from .common import ParseError, exported, fields, imported, inline, parsed, section

#: Mach-O's numbers.
CPUS = {7: "X86", 0x1000007: "X86_64", 12: "Arm", 0x100000C: "Arm64", 18: "PowerPC", 0x1000012: "PowerPC64"}
SEGMENT, SEGMENT_64, DYLD_INFO, DYLD_INFO_ONLY, DYLIBS = 1, 0x19, 0x22, 0x80000022, (0xC, 0x80000018, 0x8000001F, 0x20, 0x80000023)
PIE, PURE_INSTRUCTIONS = 0x200000, 0x80000000
KINDS = (("__data", "Data"), ("__const", "ReadOnlyData"), ("__rodata", "ReadOnlyData"), ("__bss", "Bss"), ("__debug", "Debug"))


def parse(data: bytes, limit: int = 1024) -> dict:
    magic = data[:4]
    if magic in (b"\xca\xfe\xba\xbe", b"\xbe\xba\xfe\xca"):
        raise ParseError("fat binaries are not supported")
    forms = {b"\xfe\xed\xfa\xce": (">", False), b"\xfe\xed\xfa\xcf": (">", True), b"\xce\xfa\xed\xfe": ("<", False), b"\xcf\xfa\xed\xfe": ("<", True)}
    if magic not in forms:
        raise ParseError("not a Mach-O file")
    order, wide = forms[magic]
    cpu, _, _, count, _, flags = fields(data, order + "IIIIII", 4)
    at, sections, segments, libraries, info = 32 if wide else 28, [], [], [], None
    for _ in range(count):
        kind, size = fields(data, order + "II", at)
        if size < 8:
            raise ParseError("load command too short")
        if kind in (SEGMENT, SEGMENT_64):
            big = kind == SEGMENT_64
            _, address, _, _, _, _, prot, n, _ = fields(data, order + ("16sQQQQIIII" if big else "16sIIIIIIII"), at + 8)
            segments.append(address)
            head = at + (72 if big else 56)
            for i in range(n):
                row = fields(data, order + ("16s16sQQIIIIIIII" if big else "16s16sIIIIIIIII"), head + i * (80 if big else 68))
                name, where, length, offset, attributes = row[0].split(b"\0")[0].decode("utf-8", "replace"), row[2], row[3], row[4], row[8]
                code = attributes & PURE_INSTRUCTIONS or name.startswith("__text")
                label = "Code" if code else next((k for p, k in KINDS if name.startswith(p)), "Other:MACHO_SECTION")
                body = inline(data, offset, length, limit) if offset else None
                sections.append(section(name, where, length, offset, (bool(prot & 1), bool(prot & 2), bool(prot & 4)), label, body))
        elif kind in DYLIBS:
            (name_at,) = fields(data, order + "I", at + 8)
            libraries.append(data[at + name_at : at + size].split(b"\0")[0].decode("utf-8", "replace"))
        elif kind in (DYLD_INFO, DYLD_INFO_ONLY):
            info = fields(data, order + "10I", at + 8)
        at += size
    imports: list[dict] = []
    exports: list[dict] = []
    if info:
        for begin, size in (info[2:4], info[6:8]):  # bind, lazy bind
            imports += _bindings(data[begin : begin + size], segments, libraries, 8 if wide else 4)
        exports = _trie(data[info[8] : info[8] + info[9]])
    features = {"pie": bool(flags & PIE), "aslr": bool(flags & PIE), "nx_bit": True}
    return parsed(data, "MachO", CPUS.get(cpu, "Unknown"), "Big" if order == ">" else "Little", compiler="Unknown Apple toolchain", features=features, sections=sections, imports=imports, exports=exports)


def _number(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while at < len(data):
        b = data[at]
        at += 1
        out |= (b & 0x7F) << shift
        shift += 7
        if b < 0x80:
            return out, at
    raise ParseError("number beyond the end")


def _bindings(code: bytes, segments: list[int], libraries: list[str], step: int) -> list[dict]:
    """What a bind program imports: its opcodes set a name, a library and a place, and bind there."""
    at, name, library, place, out = 0, "", None, 0, []

    def bind() -> None:
        out.append(imported(name, library, place & (1 << 64) - 1))

    while at < len(code):
        op, low = code[at] & 0xF0, code[at] & 0x0F
        at += 1
        if op in (0x10, 0x20):
            k = low
            if op == 0x20:
                k, at = _number(code, at)
            library = libraries[k - 1] if 0 < k <= len(libraries) else None
        elif op == 0x40:
            end = code.find(b"\0", at)
            if end < 0:
                raise ParseError("name beyond the end")
            name, at = code[at:end].decode("utf-8", "replace"), end + 1
        elif op == 0x60:
            _, at = _number(code, at)
        elif op == 0x70:
            offset, at = _number(code, at)
            place = (segments[low] if low < len(segments) else 0) + offset
        elif op == 0x80:
            more, at = _number(code, at)
            place += more
        elif op == 0x90:
            bind()
            place += step
        elif op == 0xA0:
            bind()
            more, at = _number(code, at)
            place += step + more
        elif op == 0xB0:
            bind()
            place += step * (1 + low)
        elif op == 0xC0:
            n, at = _number(code, at)
            skip, at = _number(code, at)
            for _ in range(min(n, 1 << 16)):
                bind()
                place += step + skip
    return out


def _trie(data: bytes) -> list[dict]:
    """Names of an export trie with their offsets, in its order."""
    out, open_, seen = [], [(0, "")] if data else [], set()
    while open_:
        at, prefix = open_.pop()
        if at in seen or at >= len(data):
            continue
        seen.add(at)
        size, at = _number(data, at)
        if size:
            flags, k = _number(data, at)
            offset = 0 if flags & 8 else _number(data, k)[0]
            out.append(exported(prefix, offset))
        at += size
        if at >= len(data):
            continue
        children, at = data[at], at + 1
        more = []
        for _ in range(children):
            end = data.find(b"\0", at)
            if end < 0:
                raise ParseError("name beyond the end")
            label = data[at:end].decode("utf-8", "replace")
            child, at = _number(data, end + 1)
            more.append((child, prefix + label))
        open_.extend(reversed(more))
    return out
