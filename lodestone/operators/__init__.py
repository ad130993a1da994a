"""Relational operators over artifacts, sections, symbols, instructions and graphs."""
