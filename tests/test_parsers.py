"""Parsers of formats on bytes that the tests make."""

from __future__ import annotations

import io
import struct
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.sources.parsers import PARSERS, ParseError

CODE = bytes.fromhex("4889e54883ec10b8000000004883c4105dc3")


def elf(sections=(), kind=2, machine=62, segments=(), entry=0x401000) -> bytes:
    """A 64-bit little-endian ELF file; sections: (name, type, flags, address, data, link)."""
    names = b"\0" + b"".join(n.encode() + b"\0" for n, *_ in sections) + b".shstrtab\0"
    body, rows, at = b"", [struct.pack("<IIQQQQIIQQ", *[0] * 10)], 64 + 56 * len(segments)
    for n, t, f, a, d, link in [*sections, (".shstrtab", 3, 0, 0, names, 0)]:
        rows.append(struct.pack("<IIQQQQIIQQ", names.index(b"\0" + n.encode() + b"\0") + 1, t, f, a, at + len(body), len(d), link, 0, 1, 24 if t in (2, 11) else 0))
        body += d
    head = b"\x7fELF\x02\x01\x01" + bytes(9) + struct.pack("<HHIQQQIHHHHHH", kind, machine, 1, entry, 64 if segments else 0, at + len(body), 0, 64, 56, len(segments), 64, len(rows), len(rows) - 1)
    parts = b"".join(struct.pack("<IIQQQQQQ", t, f, 0, 0, 0, 0, 0, 0) for t, f in segments)
    return head + parts + body + b"".join(rows)


def symtab(*rows) -> tuple[bytes, bytes]:
    names, out = b"\0", struct.pack("<IBBHQQ", 0, 0, 0, 0, 0, 0)
    for name, info, index, value, size in rows:
        out += struct.pack("<IBBHQQ", len(names), info, 0, index, value, size)
        names += name.encode() + b"\0"
    return out, names


def sample_elf() -> bytes:
    table, names = symtab(("main", 0x12, 1, 0x401000, 18), ("_Z3foov", 0x12, 1, 0x401010, 0), ("x", 0x21, 0, 0, 8))
    dyn, dyn_names = symtab(("printf", 0x12, 0, 0, 0), ("api", 0x12, 1, 0x401000, 1), ("weak", 0x22, 1, 0x401000, 1))
    return elf(
        [(".text", 1, 6, 0x401000, CODE, 0), (".data", 1, 3, 0x402000, bytes(2000), 0), (".symtab", 2, 0, 0, table, 4), (".strtab", 3, 0, 0, names, 0),
         (".dynsym", 11, 0, 0, dyn, 6), (".dynstr", 3, 0, 0, dyn_names, 0), (".comment", 1, 0, 0, b"GCC: (x) 13\0", 0), (".debug_info", 1, 0, 0, b"d", 0), (".odd", 99, 0, 0, b"", 0)],
        segments=[(0x6474E551, 6), (0x6474E552, 4)],
    )


def test_elf():
    p = PARSERS["Elf"](sample_elf(), 1024)
    s = {x["name"]: x for x in p["sections"]}
    assert p["architecture"] == "X86_64" and p["endian"] == "Little" and p["entry_point"] == 0x401000
    assert s[".text"]["section_type"] == "Code" and s[".text"]["data"] == CODE and s[".text"]["perm_execute"]
    assert s[".data"]["section_type"] == "Data" and s[".data"]["data"] is None  # longer than 1,024 bytes
    assert s[".debug_info"]["section_type"] == "Debug" and s[".odd"]["section_type"] == "Other:SHT_99" and s[".symtab"]["section_type"] == "Symbol"
    assert [(x["name"], x["symbol_type"], x["binding"], x["section_index"], x["demangled_name"]) for x in p["symbols"]] == [
        ("main", "Function", "Global", 1, None), ("_Z3foov", "Function", "Global", 1, "demangled__Z3foov"), ("x", "Object", "Weak", None, None)]
    assert [x["name"] for x in p["imports"]] == ["printf"] and [x["name"] for x in p["exports"]] == ["api"]
    assert p["nx_bit"] and p["relro"] and not p["pie"] and p["compiler_info"] == "GCC: (x) 13"


def test_elf_without_stack_segment_is_not_nx():
    p = PARSERS["Elf"](elf(kind=3, entry=0), 1024)
    assert not p["nx_bit"] and p["pie"] and p["aslr"] and p["entry_point"] is None


@pytest.mark.parametrize(("name", "text"), [(".go.buildinfo", "Go compiler"), (".rustc", "Rust compiler"), (".plain", None)])
def test_elf_compilers(name, text):
    assert PARSERS["Elf"](elf([(name, 1, 0, 0, b"z", 0)]), 1024)["compiler_info"] == text


@pytest.mark.parametrize(("number", "name"), [(3, "X86"), (40, "Arm"), (183, "Arm64"), (8, "Mips"), (20, "PowerPC"), (21, "PowerPC64"), (243, "RiscV"), (999, "Unknown")])
def test_elf_machines(number, name):
    assert PARSERS["Elf"](elf(machine=number), 1024)["architecture"] == name


def sample_pe(traits=0x4140, symbols=0) -> bytes:
    optional = struct.pack("<HBBIIIII", 0x20B, 0, 0, 0, 0, 0, 0x1000, 0x1000) + struct.pack("<QIIHHHHHHIIIIHHQQQQII", 0x140000000, 0x1000, 0x200, 6, 0, 0, 0, 6, 0, 0, 0x3000, 0x200, 0, 3, traits, 0, 0, 0, 0, 0, 16)
    imports = struct.pack("<IIIII", 0x2028, 0, 0, 0x2048, 0x2038) + bytes(20) + struct.pack("<QQQQ", 0x2058, 0, 0x2058, 0) + b"KERNEL32.dll\0\0\0\0" + struct.pack("<H", 7) + b"VirtualAllocEx\0"
    optional += struct.pack("<IIII", 0, 0, 0x2000, 40) + bytes(8 * 14)
    head = b"MZ" + bytes(58) + struct.pack("<I", 64) + b"PE\0\0" + struct.pack("<HHIIIHH", 0x8664, 2, 1_600_000_000, 0, symbols, len(optional), 0x22) + optional
    row = lambda n, rva, size, at, flags: struct.pack("<8sIIIIIIHHI", n, size, rva, size, at, 0, 0, 0, 0, flags)
    head += row(b".text", 0x1000, 512, 1024, 0x60000020) + row(b".data", 0x2000, 512, 1536, 0xC0000040)
    return head.ljust(1024, b"\0") + CODE.ljust(512, b"\0") + imports.ljust(512, b"\0")


def test_pe():
    p = PARSERS["Pe"](sample_pe(), 1024)
    assert p["architecture"] == "X86_64" and p["base_address"] == 0x140000000 and p["entry_point"] == 0x140001000 and p["timestamp"] == 1_600_000_000
    assert [(s["name"], s["section_type"], s["address"], s["perm_execute"]) for s in p["sections"]] == [(".text", "Code", 0x1000, True), (".data", "Data", 0x2000, False)]
    assert p["imports"] == [{"name": "VirtualAllocEx", "library": "KERNEL32.dll", "address": 0x2038, "import_ordinal": 7}]
    assert p["nx_bit"] and p["aslr"] and p["pie"] and p["cfi"] and not p["signed"] and p["symbols"] == [] and p["compiler_info"] is None
    assert PARSERS["Pe"](sample_pe(0, 5), 1024)["compiler_info"].startswith("MSVC")


def test_macho():
    section = struct.pack("<16s16sQQIIIIIIII", b"__text", b"__TEXT", 0x1000, len(CODE), 200, 0, 0, 0, 0x80000400, 0, 0, 0)
    segment = struct.pack("<II16sQQQQIIII", 0x19, 72 + 80, b"__TEXT", 0x1000, 4096, 0, 4096, 5, 5, 1, 0) + section
    data = (b"\xcf\xfa\xed\xfe" + struct.pack("<IIIIII", 0x1000007, 3, 2, 1, len(segment), 0x200000) + bytes(4) + segment).ljust(200, b"\0") + CODE
    p = PARSERS["MachO"](data, 1024)
    assert p["architecture"] == "X86_64" and p["endian"] == "Little" and p["pie"] and p["nx_bit"] and p["entry_point"] is None
    assert p["sections"][0]["section_type"] == "Code" and p["sections"][0]["data"] == CODE and p["sections"][0]["perm_execute"] and not p["sections"][0]["perm_write"]
    with pytest.raises(ParseError):
        PARSERS["MachO"](b"\xca\xfe\xba\xbe" + bytes(60), 1024)


def test_java_and_jar():
    assert PARSERS["Java"](b"\xca\xfe\xba\xbe\0\x03\0\x34", 1024)["compiler_info"] == "Java class version 52.3"
    assert PARSERS["Java"](b"\xca\xfe\xba\xbe", 1024)["compiler_info"] == "Java class version 0.0"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a/B.class", b"12345")
        z.writestr("readme.txt", b"x")
    p = PARSERS["Java"](buffer.getvalue(), 1024)
    assert [(s["name"], s["size"]) for s in p["symbols"]] == [("a/B.class", 5)] and p["sections"][0]["name"] == "jar"


def wasm_add() -> bytes:
    return bytes.fromhex("0061736d01000000" "0107016002" "7f7f" "017f" "0302" "0100" "0707" "01" "03616464" "0000" "0a09" "01" "0700" "20002001" "6a0b")


def test_wasm():
    p = PARSERS["Wasm"](wasm_add(), 1024)
    assert [x["name"] for x in p["exports"]] == ["add"] and {"code", "export"} <= {s["name"] for s in p["sections"]}
    assert p["architecture"] == "Wasm"


def test_raw():
    p = PARSERS["Raw"](b"hello", 1024)
    assert p["sections"][0]["data"] == b"hello" and p["base_address"] == 0
    assert PARSERS["Raw"](bytes(1025), 1024)["sections"][0]["data"] is None


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(sorted(PARSERS)), st.binary(max_size=600), st.booleans())
def test_any_bytes_parse_or_raise(name, tail, real):
    magic = {"Elf": b"\x7fELF\x02\x01", "Pe": b"MZ", "MachO": b"\xcf\xfa\xed\xfe", "Java": b"PK\x03\x04", "Wasm": b"\0asm\1\0\0\0", "Raw": b""}[name]
    data = magic + tail if real else tail
    try:
        assert PARSERS[name](data, 1024) == PARSERS[name](data, 1024)
    except ParseError:
        pass


@pytest.mark.parametrize("cut", range(0, 900, 37))
def test_truncated_files(cut):
    for name, data in (("Elf", sample_elf()), ("Pe", sample_pe()), ("Wasm", wasm_add())):
        try:
            PARSERS[name](data[:cut], 1024)
        except ParseError:
            pass
