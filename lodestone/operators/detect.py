"""Which format an artifact has, from its first bytes."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.binary import starts_with, uint, view

#: File signatures.
ELF_MAGIC = b"\x7fELF"
PE_MAGIC = b"MZ"
MACHO_MAGICS = (b"\xfe\xed\xfa\xce", b"\xfe\xed\xfa\xcf", b"\xce\xfa\xed\xfe", b"\xcf\xfa\xed\xfe")
FAT_MAGICS = (b"\xca\xfe\xba\xbe", b"\xbe\xba\xfe\xca")
JAVA_MAGIC = b"\xca\xfe\xba\xbe"
ZIP_MAGIC = b"PK\x03\x04"
WASM_MAGIC = b"\x00asm"

#: How formats and architectures are shown.
FORMAT_NAMES = {"Elf": "ELF", "Pe": "PE", "MachO": "Mach-O", "Java": "Java", "Wasm": "WebAssembly", "Raw": "Raw", "Unknown": "Unknown"}


@F.pandas_udf(T.BooleanType())
def holds_classes(contents: pd.Series) -> pd.Series:
    """Whether a ZIP archive has a *.class entry."""

    def one(data: bytes | None) -> bool:
        try:
            with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
                return any(n.endswith(".class") for n in z.namelist())
        except (zipfile.BadZipFile, ValueError, OSError):
            return False

    return contents.map(one)


def _any(content: Column, magics: tuple[bytes, ...]) -> Column:
    head = F.substring(content, 1, 4)
    return head.isin(*[bytearray(m) for m in magics])


def format_column(content: str = "content", archives: bool = True) -> Column:
    """Elf, Pe, MachO, Java, Wasm or Raw, the first that fits; null for empty content.

    With archives, a ZIP file with a *.class entry is Java; only rows with ZIP's signature reach
    the Python function that looks inside. 0xcafebabe is always Java, so fat Mach-O files are too.
    """
    c = F.col(content)
    zipped = F.when(starts_with(c, ZIP_MAGIC), c)
    plain = F.when(F.coalesce(F.length(c), F.lit(0)) == 0, F.lit(None).cast("string"))
    plain = plain.when(starts_with(c, ELF_MAGIC), "Elf").when(starts_with(c, PE_MAGIC), "Pe").when(_any(c, MACHO_MAGICS), "MachO").when(starts_with(c, JAVA_MAGIC), "Java")
    if archives:
        plain = plain.when(zipped.isNotNull() & holds_classes(zipped), "Java")
    return plain.when(starts_with(c, WASM_MAGIC), "Wasm").otherwise("Raw")


def detect(artifacts: DataFrame, archives: bool = True) -> DataFrame:
    """artifact_id, format (null for empty content) and error."""
    found = artifacts.withColumn("format", format_column(archives=archives))
    return found.select("artifact_id", "format", F.when(F.col("format").isNull(), F.lit("empty data")).alias("error"))


def can_parse(content: str = "content") -> dict[str, Column]:
    """One predicate for each format: whether its parser would try."""
    c = F.col(content)
    header = uint(c, 0x3C, 4)
    return {
        "Elf": starts_with(c, ELF_MAGIC),
        "Pe": F.coalesce(starts_with(c, PE_MAGIC) & (view(c, header, 4) == F.lit(b"PE\x00\x00")), F.lit(False)),
        "MachO": _any(c, MACHO_MAGICS + FAT_MAGICS),
        "Java": starts_with(c, JAVA_MAGIC) | starts_with(c, ZIP_MAGIC),
        "Wasm": starts_with(c, WASM_MAGIC),
        "Raw": F.lit(True),
    }
