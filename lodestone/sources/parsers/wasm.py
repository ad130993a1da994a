"""WebAssembly modules."""

from __future__ import annotations

from .common import ParseError, exported, imported, parsed, section


class _Cursor:
    def __init__(self, data: bytes, at: int, end: int) -> None:
        self.data, self.at, self.end = data, at, end

    def byte(self) -> int:
        if self.at >= self.end:
            raise ParseError("unexpected end")
        self.at += 1
        return self.data[self.at - 1]

    def number(self) -> int:
        """LEB128, unsigned."""
        out = shift = 0
        while True:
            b = self.byte()
            out |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return out
            if shift > 63:
                raise ParseError("number too long")

    def text(self) -> str:
        n = self.number()
        if self.at + n > self.end:
            raise ParseError("name beyond the end")
        self.at += n
        try:
            return self.data[self.at - n : self.at].decode()
        except UnicodeDecodeError as e:
            raise ParseError("name is not UTF-8") from e

    def limits(self) -> None:
        flags = self.number()
        self.number()
        if flags & 1:
            self.number()

    def type_of_import(self) -> None:
        kind = self.byte()
        if kind == 0:
            self.number()
        elif kind == 1:
            self.byte()
            self.limits()
        elif kind == 2:
            self.limits()
        elif kind == 3:
            self.byte()
            self.byte()
        elif kind == 4:
            self.byte()
            self.number()
        else:
            raise ParseError(f"import kind {kind}")


def parse(data: bytes, limit: int = 1024) -> dict:
    if data[:4] != b"\0asm" or len(data) < 8:
        raise ParseError("not a WebAssembly module")
    sections, imports, exports, start = [], [], [], None
    c = _Cursor(data, 8, len(data))
    while c.at < len(data):
        kind, size = c.byte(), c.number()
        begin, end = c.at, c.at + size
        if end > len(data):
            raise ParseError("section beyond the end")
        s = _Cursor(data, begin, end)

        def add(name: str, write: bool, run: bool, what: str, a: int = begin, b: int = end) -> None:
            sections.append(section(name, 0, b - a, a, (True, write, run), what, None))

        if kind == 0:
            name = s.text()
            add(name, False, False, f"Other:{name}", s.at)
        elif kind == 2:
            for _ in range(s.number()):
                module, name = s.text(), s.text()
                s.type_of_import()
                imports.append(imported(name, module))
            add("import", False, False, "Other:Import")
        elif kind == 7:
            for _ in range(s.number()):
                exports.append(exported(s.text(), 0))
                s.byte()
                s.number()
            add("export", False, False, "Other:Export")
        elif kind == 8:
            start = s.number()
        elif kind == 10:
            add("code", False, True, "Code")
        elif kind == 11:
            add("data", True, False, "Data")
        c.at = end
    return parsed(data, "Wasm", "Wasm", "Little", entry=start, sections=sections, imports=imports, exports=exports)
