"""Java classes and archives."""

from __future__ import annotations

import io
import zipfile

from .common import ParseError, parsed, section, symbol


def parse(data: bytes, limit: int = 1024) -> dict:
    whole = lambda name: [section(name, 0, len(data), 0, (True, False, False), "Data", None)]
    if data[:4] == b"PK\x03\x04":
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                classes = [symbol(i.filename, size=i.file_size) for i in z.infolist() if i.filename.endswith(".class")]
        except (zipfile.BadZipFile, OSError, ValueError) as e:
            raise ParseError(f"Zip error: {e}") from e
        return parsed(data, "Java", "Jvm", "Big", compiler="Java archive", sections=whole("jar"), symbols=classes)
    if data[:4] != b"\xca\xfe\xba\xbe":
        raise ParseError("Invalid Java class magic")
    minor, major = (int.from_bytes(data[a : a + 2], "big") if len(data) >= a + 2 else 0 for a in (4, 6))
    return parsed(data, "Java", "Jvm", "Big", compiler=f"Java class version {major}.{minor}", sections=whole("class"))
