"""Parsers of executable formats: bytes in, plain dictionaries out. None of them needs Spark.

Every parser returns the fields of parse.PARSED. register() adds one for a new format.
"""

from __future__ import annotations

from collections.abc import Callable

from . import elf, java, macho, pe, raw, wasm
from .common import ParseError

PARSERS: dict[str, Callable[[bytes, int], dict]] = {"Elf": elf.parse, "Pe": pe.parse, "MachO": macho.parse, "Java": java.parse, "Wasm": wasm.parse, "Raw": raw.parse}


def register(name: str, parser: Callable[[bytes, int], dict]) -> None:
    """Uses the parser for artifacts whose format is called name."""
    PARSERS[name] = parser


__all__ = ["PARSERS", "ParseError", "register"]
