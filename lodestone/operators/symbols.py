"""Demangling of C++ symbol names, a subset of the Itanium scheme: nested names, templates of names, and basic types."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Basic types by their letter.
BASIC = {
    "v": "void", "b": "bool", "c": "char", "a": "signed char", "h": "unsigned char", "s": "short", "t": "unsigned short", "i": "int", "j": "unsigned int",
    "l": "long", "m": "unsigned long", "x": "long long", "y": "unsigned long long", "f": "float", "d": "double", "e": "long double", "z": "...", "w": "wchar_t",
}


class _Reader:
    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self, token: str) -> bool:
        if self.text.startswith(token, self.at):
            self.at += len(token)
            return True
        return False

    def source_name(self) -> str:
        end = self.at
        while self.text[end : end + 1].isdigit():
            end += 1
        n = int(self.text[self.at : end])
        self.at = end + n
        if n == 0 or self.at > len(self.text):
            raise ValueError("name too long")
        return self.text[end : self.at]

    def name(self) -> str:
        if self.take("N"):
            constant, parts = self.take("K"), []
            while not self.take("E"):
                if self.take("St"):
                    parts.append("std")
                elif self.take("C1") or self.take("C2"):
                    parts.append(parts[-1].split("<")[0])
                elif self.take("D1") or self.take("D2") or self.take("D0"):
                    parts.append("~" + parts[-1].split("<")[0])
                elif self.peek() == "I":
                    parts[-1] += self.arguments()
                else:
                    parts.append(self.source_name())
            self.constant = constant
            return "::".join(parts)
        out = ("std::" if self.take("St") else "") + self.source_name()
        return out + (self.arguments() if self.peek() == "I" else "")

    def arguments(self) -> str:
        self.take("I")
        out = []
        while not self.take("E"):
            out.append(self.type())
        return f"<{', '.join(out)}>"

    def type(self) -> str:
        for mark, tail in (("P", "*"), ("R", "&"), ("O", "&&"), ("K", " const"), ("V", " volatile")):
            if self.take(mark):
                return self.type() + tail
        c = self.peek()
        if c in BASIC and c:
            self.at += 1
            return BASIC[c]
        return self.name()


def demangle(name: str | None) -> str | None:
    """The C++ name, or None where it is not mangled or beyond the subset."""
    if not name or not name.startswith("_Z"):
        return None
    r = _Reader(name)
    r.at, r.constant = 2, False
    try:
        out = r.name()
        if r.at == len(name):
            return out
        types = []
        while r.at < len(name):
            types.append(r.type())
        return f"{out}({'' if types == ['void'] else ', '.join(types)})" + " const" * r.constant
    except (ValueError, IndexError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def demangled(names: pd.Series) -> pd.Series:
    return names.map(demangle)


def demangle_symbols(symbols: DataFrame, placeholders: bool = True) -> DataFrame:
    """Fills demangled_name where it is null and the name is mangled.

    The ELF parser puts demangled_<name> there, which stays; without placeholders it is replaced.
    """
    kept = F.col("demangled_name")
    if not placeholders:
        kept = F.when(kept != F.concat(F.lit("demangled_"), "name"), kept)
    return symbols.withColumn("demangled_name", F.coalesce(kept, demangled("name")))
