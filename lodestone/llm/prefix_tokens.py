"""Token counts at every prefix of a text, by dynamic programming over a BPE vocabulary.

A byte-pair encoding of a prefix ends in exactly one piece that goes with the piece before it:
the pair, encoded alone, stays as it is. So the count at a prefix is one more than the count at
the place where its last piece begins, and one walk over the text gives the count at all
prefixes. Truncation and budget questions are then look-ups.

In vocabularies whose pieces hold the blank mark at their beginning only, no piece crosses from
a word into the blank after it; a text is then a row of chunks (blanks and a word) whose counts
add up. Prefix states of chunks are remembered, so a chunk seen before costs one look-up and a new
one only the characters after its longest prefix seen.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, has_columns

MARK = "▁"
#: Chunks up to so many characters are remembered, in at most so many prefix states.
CHUNK, STATES = 48, 800_000
#: Piece lengths to try where no longer piece ends alike.
ONE = (1,)


class PrefixTokens:
    """Counts of one sentencepiece BPE model with byte fallback and no normalisation."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in plain}
        self.alphabet = {c for p in self.rank for c in p}
        if MARK not in self.alphabet or any(c not in self.rank for c in self.alphabet) or any(MARK in p.lstrip(MARK) for p in self.rank):
            raise ValueError("the vocabulary has pieces that cross words, or characters without a piece")
        self.longest = max(map(len, self.rank))
        # Pieces that their own characters do not merge into never occur.
        self.pieces = {p for p in self.rank if len(p) == 1 or self._merge(p) == [p]}
        # Lengths of the pieces that end in two given characters, or are one character, the long ones first.
        ends: dict[str, set[int]] = {}
        for p in self.pieces:
            ends.setdefault(p[-2:], {1}).add(len(p))
        self.ends = {k: tuple(sorted(v, reverse=True)) for k, v in ends.items()}
        self.goes: dict[tuple[str, str], bool] = {}
        self.edges: dict[str, tuple] = {}
        self.states: dict[str, int] = {"": 0}
        self.chunks = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n").findall

    def _merge(self, text: str) -> list[str]:
        """Plain BPE: the best-ranked neighbours are joined, the left ones first, until none can be."""
        parts = list(text)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: (self.rank.get(parts[k] + parts[k + 1], np.inf), k))
            if parts[best] + parts[best + 1] not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _edges(self, piece: str) -> tuple[list[tuple[str, float, float]], list[tuple[str, float, float]]]:
        """The parts that stand at the piece's left and right edge while it is merged: (part, rank that made it, rank that ends it)."""
        if (known := self.edges.get(piece)) is not None:
            return known
        parts, made, left, right = list(piece), -1.0, [(piece[0], -1.0)], [(piece[-1], -1.0)]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: (self.rank.get(parts[k] + parts[k + 1], np.inf), k))
            at_left, at_right = best == 0, best == len(parts) - 2
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
            made = max(made, self.rank[parts[best]])
            if at_left:
                left.append((parts[0], made))
            if at_right:
                right.append((parts[-1], made))
        spans = [[(part, at, side[k + 1][1] if k + 1 < len(side) else np.inf) for k, (part, at) in enumerate(side)] for side in (left, right)]
        self.edges[piece] = out = (spans[0], spans[1])
        return out

    def _stays(self, one: str, two: str) -> bool:
        """Whether the pair, encoded alone, stays as it is.

        It does unless some part at the right edge of one and some part at the left edge of two,
        both present at the same time, make a piece that comes before either of them ends. Where
        ranks are equal, the merge further left comes first.
        """
        if (known := self.goes.get((one, two))) is not None:
            return known
        rank, ok = self.rank, True
        for a, made_a, ends_a in self._edges(one)[1]:
            for b, made_b, ends_b in self._edges(two)[0]:
                if made_a <= ends_b and made_b < ends_a and (r := rank.get(a + b)) is not None and r < ends_a and r <= ends_b:
                    ok = False
                    break
            if not ok:
                break
        if len(self.goes) > STATES:
            self.goes.clear()
        self.goes[one, two] = ok
        return ok

    def _last(self, text: str, i: int, last: Callable[[int], int]) -> int:
        """Length of the last piece of text[:i], 0 for a character that falls back to bytes; last(j): the same at j."""
        for n in self.ends.get(text[max(0, i - 2) : i], ONE):
            if n <= i and (piece := text[i - n : i]) in self.pieces:
                j = i - n
                before = last(j) if j else 0
                if not before or self._stays(text[j - before : j], piece):
                    return n
        return 0

    def _state(self, chunk: str) -> int:
        """Count and last piece's length (64 * count + length) of a short chunk; remembers all its prefixes.

        The walk of _last, written out: this is where the time goes.
        """
        states, pieces, goes, ends, n = self.states, self.pieces, self.goes, self.ends, len(chunk)
        if len(states) > STATES:
            states.clear()
            states[""] = 0
        k = n - 1
        while chunk[:k] not in states:
            k -= 1
        for i in range(k + 1, n + 1):
            state = None
            for size in ends.get(chunk[i - 2 : i] if i > 1 else chunk[0], ONE):
                if size <= i and (piece := chunk[i - size : i]) in pieces:
                    j = i - size
                    at = states[chunk[:j]]
                    if before := at & 63:
                        ok = goes.get(pair := (chunk[j - before : j], piece))
                        if not (self._stays(*pair) if ok is None else ok):
                            continue
                    state = at - before + 64 + size
                    break
            if state is None:  # bytes
                state = (states[chunk[: i - 1]] >> 6) + len(chunk[i - 1].encode()) << 6
            states[chunk[:i]] = state
        return state

    def chunk_counts(self, chunk: str) -> list[int]:
        """Counts at the chunk's prefixes of 1, 2, ... characters."""
        if len(chunk) <= CHUNK:
            self._state(chunk)
            try:
                return [self.states[chunk[:i]] >> 6 for i in range(1, len(chunk) + 1)]
            except KeyError:
                pass  # the states were emptied between two of its prefixes
        lasts, counts = [0], [0]
        for i in range(1, len(chunk) + 1):
            size = self._last(chunk, i, lasts.__getitem__)
            lasts.append(size)
            counts.append(counts[i - size] + 1 if size else counts[i - 1] + len(chunk[i - 1].encode()))
        return counts[1:]

    def split(self, text: str) -> list[str]:
        """The chunks; their concatenation is the text with marks for blanks and one mark before it."""
        return self.chunks(MARK + text.replace(" ", MARK)) if text else []

    def sizes(self, chunks: list[str]) -> list[int]:
        """Tokens of each chunk."""
        known = self.states.get
        return [s >> 6 if (s := known(c)) is not None else self._state(c) >> 6 if len(c) <= CHUNK else self.chunk_counts(c)[-1] for c in chunks]

    def count(self, text: str) -> int:
        return sum(self.sizes(self.split(text)))

    def prefix_counts(self, text: str) -> list[int]:
        """Tokens of the text's first 0, 1, 2, ... characters."""
        out, done = [0], 0
        for chunk in self.split(text):
            counts = self.chunk_counts(chunk)
            out.extend(done + c for c in counts)
            done += counts[-1]
        del out[1:2]  # the mark before the text belongs to its first character
        return out

    def longest_prefix(self, text: str, limit: int, chunks: list[str] | None = None, sizes: list[int] | None = None) -> int:
        """Characters of the longest prefix with at most limit tokens."""
        chunks = self.split(text) if chunks is None else chunks
        ends = np.cumsum(self.sizes(chunks) if sizes is None else sizes)
        k = int(np.searchsorted(ends, limit, side="right"))
        done = sum(map(len, chunks[:k]))
        if k < len(chunks):
            left = limit - (int(ends[k - 1]) if k else 0)
            done += max((i for i, c in enumerate(self.chunk_counts(chunks[k]), 1) if c <= left), default=0)
        return max(0, done - 1)


_COUNTERS: dict[str, PrefixTokens] = {}


def counter_of(model_file: str) -> PrefixTokens:
    """The counter of that vocabulary, one in a process, so that tasks share what it remembers."""
    if model_file not in _COUNTERS:
        _COUNTERS[model_file] = PrefixTokens(model_file)
    return _COUNTERS[model_file]


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096, prefixes: bool = False) -> DataFrame:
    """All rows and columns of docs with n_bytes, n_tokens, over_limit and fit_chars.

    Needs text. n_bytes: UTF-8 bytes. n_tokens: pieces of the whole text, without begin, end or
    other added tokens. over_limit: n_tokens > limit. fit_chars: characters of the longest prefix
    with at most limit tokens. With prefixes also prefix_tokens, an array with the count of every
    prefix of 0, 1, 2, ... characters, for fits() and tokens_within(). model_file must be readable
    on every executor.

    A null text counts as an empty one: 0 tokens. Existing columns of these names are replaced.
    """
    has_columns(docs, "text")
    bounded_batches(docs)
    schema = "n_bytes long, n_tokens long, over_limit boolean, fit_chars long" + ", prefix_tokens array<int>" * prefixes
    names = [x.split()[0] for x in schema.split(", ")]

    @F.pandas_udf(schema)
    def counted(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = counter_of(model_file)
        for texts in parts:
            rows = []
            for text in texts:
                text = text or ""
                chunks = counter.split(text)
                sizes = counter.sizes(chunks)
                n = sum(sizes)
                fit = len(text) if n <= limit else counter.longest_prefix(text, limit, chunks, sizes)
                rows.append((len(text.encode()), n, n > limit, fit, *([counter.prefix_counts(text)] if prefixes else ())))
            yield pd.DataFrame(rows, columns=names)

    kept = [c for c in docs.columns if c not in names]
    return docs.withColumn("counted_tokens", counted(F.col("text"))).select(*kept, "counted_tokens.*")


def fits(prefix_tokens: Column | str, limit: int) -> Column:
    """Characters of the longest prefix with at most limit tokens, from the stored counts alone."""
    counts = F.col(prefix_tokens) if isinstance(prefix_tokens, str) else prefix_tokens
    return F.array_max(F.filter(F.transform(counts, lambda c, i: F.when(c <= limit, i)), lambda i: i.isNotNull()))


def tokens_within(prefix_tokens: Column | str, chars: Column | int) -> Column:
    """Tokens of the first so many characters (all, if it has fewer), from the stored counts alone."""
    counts = F.col(prefix_tokens) if isinstance(prefix_tokens, str) else prefix_tokens
    return F.element_at(counts, F.least(F.size(counts), (chars if isinstance(chars, Column) else F.lit(chars)) + 1).cast("int"))
