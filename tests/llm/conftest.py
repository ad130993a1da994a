from __future__ import annotations

import random

import pytest

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "ru", "so", "ti", "va") for b in ("", "n", "r", "st", "lo", "mi", "ka", "ven")]


def prose(seed: int, n: int, per_line: int = 60) -> str:
    """Invented prose: n words, a full stop every tenth, lines of per_line words."""
    r = random.Random(seed)
    words = [r.choice(WORDS) + ("." if i % 10 == 9 else "") for i in range(n)]
    return "\n".join(" ".join(words[i : i + per_line]) for i in range(0, n, per_line))


def edited(text: str, every: int, word: str = "edit") -> str:
    """The text with each so-many-th word replaced."""
    lines, k = [], 0
    for line in text.split("\n"):
        out = []
        for w in line.split(" "):
            k += 1
            out.append(word if k % every == 0 else w)
        lines.append(" ".join(out))
    return "\n".join(lines)


def edge_rows() -> list[tuple]:
    """Nulls in any column, empty and very long texts, ties, repeated rows, and copies near and exact."""
    base, long = prose(1, 200), prose(2, 30_000)
    rows = [
        (1, base, "en", "a", 5), (2, base, "en", "a", 5), (3, edited(base, 60), None, "b", None), (4, "", "en", "b", 0), (5, None, "en", None, None), (None, None, None, None, None),
        (None, "one two three.", "en", "c", 1), (6, long, "en", "a", 1), (7, " \n\t\n ", "en", "", 1), (8, "word", "en", "b", 1), (8, "word", "en", "b", 1), (8, "other", "en", "b", 1),
        (9, prose(3, 120) + "\n" + prose(4, 70), "en", "c", 1), (10, prose(5, 80) + "\n" + prose(4, 70), "en", "c", 1), (11, "a | b | c\nd | e | f\n" + prose(6, 20), "en", "a", 1),
    ]
    return rows + [(100 + i, prose(100 + i, 30 + 7 * i), "de", f"s{i % 4}", i) for i in range(25)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
