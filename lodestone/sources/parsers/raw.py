"""Anything else: one readable section."""

from __future__ import annotations

from .common import inline, parsed, section


def parse(data: bytes, limit: int = 1024) -> dict:
    return parsed(data, "Raw", "Unknown", "Little", base=0, sections=[section(".data", 0, len(data), 0, (True, False, False), "Data", inline(data, 0, len(data), limit))])
