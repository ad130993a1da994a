"""Packing documents into sequences of several permitted lengths by best fit.

Documents are dealt by hash into packs of bounded size, and each pack is packed on its own, the
longest pieces first. A piece goes into the open bin that it fills best. Where none has room, a
bin is opened. Which length is cheapest depends on what is left to fill it, so the lengths are
chosen jointly with the pieces: the length whose cost is least for a word of what it would hold of
the pieces still to come. Besides, the pack is packed once for every limit to the lengths that are
opened, and the plan of least total cost stays. At the end every bin is downsized to the shortest
permitted length that holds its contents.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import has_columns, n_words


@dataclass(frozen=True)
class PackRules:
    """Permitted lengths, and what a sequence of n words costs: fixed + n + n * n / square."""

    lengths: Sequence[int] = (512, 1024, 2048, 4096)
    fixed: float = 64.0
    square: float = 65_536.0
    #: Rows of a pack on average.
    pack_rows: int = 2048

    def cost(self, length: int) -> float:
        return self.fixed + length + length * length / self.square


def _held(rising: Sequence[int], n: int, room: int) -> int:
    """Words of the first n of rising pieces that fill the room, the longest that fits again and again."""
    left = room
    while left > 0 and (n := bisect_right(rising, left, 0, n)):
        n -= 1
        left -= rising[n]
    return room - left


def _plan(falling: Sequence[int], rules: PackRules, most: int | None) -> tuple[float, list[tuple[int, int]], list[int]]:
    """Cost, (bin, place) of each piece and final length of each bin, of falling pieces.

    Opened bins are as short as the piece allows but no shorter than most where there is one, else
    as long as costs least for a word with the pieces still to come.
    """
    permitted = sorted(rules.lengths)
    rising = list(reversed(falling))
    used: list[int] = []
    room: list[tuple[int, int]] = []  # (room, bin), sorted
    at: list[tuple[int, int]] = []
    for i, n in enumerate(falling):
        k = bisect_left(room, (n, -1))
        if k < len(room):
            left, b = room.pop(k)
        else:
            fitting = permitted[bisect_left(permitted, n) :]
            if most is not None:
                left = max(fitting[0], most)
            else:
                held = [n + _held(rising, len(falling) - i - 1, size - n) for size in fitting]
                # What a bin would hold decides about its final length, and that about its cost.
                left = min(zip(fitting, held, strict=True), key=lambda x: (rules.cost(permitted[bisect_left(permitted, x[1])]) / x[1], x[0]))[0]
            b = len(used)
            used.append(0)
        at.append((b, used[b]))
        used[b] += n
        if left > n:
            insort(room, (left - n, b))
    final = [permitted[bisect_left(permitted, n)] for n in used]
    return sum(map(rules.cost, final)), at, final


def best_fit(pieces: Sequence[int], rules: PackRules) -> list[tuple[int, int, int]]:
    """(bin, place in the bin, length of the bin) for each piece; pieces are 1 to max(rules.lengths) words long.

    Equal pieces keep their order. The result depends on the pieces alone.
    """
    order = sorted(range(len(pieces)), key=lambda i: (-pieces[i], i))
    falling = [pieces[i] for i in order]
    plans = [_plan(falling, rules, most) for most in (None, *sorted(rules.lengths))]
    _, at, final = min(plans, key=lambda p: p[0])
    out = [(0, 0, 0)] * len(pieces)
    for i, (b, place) in zip(order, at, strict=True):
        out[i] = (b, place, final[b])
    return out


def pack_documents(docs: DataFrame, rules: PackRules | None = None) -> DataFrame:
    """The places of all documents: doc_id, copy, piece, start, words, pack, bin, place, bin_length.

    Needs doc_id (of any type that can be grouped by; it keeps its type) and text. A document
    longer than the longest permitted length is cut into pieces of that length and a rest: piece
    counts from 0 and start is the piece's first word. A piece lies in words place to place +
    words - 1 of bin number bin of pack number pack, whose length is bin_length. Every word of
    every document lies in exactly one bin.

    A null text counts as an empty one; a document without words gives one row with 0 words and no
    bin. Rows equal in doc_id and text get copy 0, 1, ... and are packed one by one. An empty
    table gives an empty table. Other columns of docs are left out.
    """
    has_columns(docs, "doc_id", "text")
    rules = rules or PackRules()
    longest = max(rules.lengths)
    packs = max(1, math.ceil(docs.count() / rules.pack_rows))
    sized = docs.select("doc_id", F.xxhash64("text").alias("row"), n_words(F.col("text")).alias("n"))
    # Repeated rows meet as sums and are told apart by number before they are dealt, so none is hot.
    copies = sized.groupBy("doc_id", "row", "n").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    single = copies.select("doc_id", "row", "n", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    dealt = single.withColumn("pack", F.pmod(F.xxhash64(F.lit(3), "doc_id", "row", "copy"), F.lit(packs)))
    # The order in a pack: by hash, so that it does not depend on how rows arrive.
    dealt = dealt.withColumn("key", F.xxhash64(F.lit(7), "doc_id", "row", "copy"))

    def packed(pack: pa.Table) -> pa.Table:
        # Ids stay Arrow values throughout: as pandas columns, long ones beside a null would be rounded.
        pack = pack.sort_by([("key", "ascending"), ("row", "ascending"), ("copy", "ascending")])
        owner, piece, start, words = [], [], [], []
        for i, n in enumerate(pack["n"].to_pylist()):
            for k, first in enumerate(range(0, max(n, 1), longest)):
                owner.append(i)
                piece.append(k)
                start.append(first)
                words.append(min(longest, n - first))
        places: list = [(None, None, None)] * len(words)
        filled = [i for i, n in enumerate(words) if n]
        for i, where in zip(filled, best_fit([words[i] for i in filled], rules), strict=True):
            places[i] = where
        taken = pack.take(pa.array(owner, pa.int64()))
        bins, inside, lengths = zip(*places, strict=True)
        columns = [
            taken["doc_id"], taken["copy"], pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(words, pa.int64()), taken["pack"],
            pa.array(bins, pa.int64()), pa.array(inside, pa.int64()), pa.array(lengths, pa.int64()),
        ]
        return pa.table(columns, names=["doc_id", "copy", "piece", "start", "words", "pack", "bin", "place", "bin_length"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)])
    for name, kind in (("copy", "integer"), ("piece", "integer"), ("start", "long"), ("words", "long"), ("pack", "long"), ("bin", "long"), ("place", "long"), ("bin_length", "long")):
        schema = schema.add(name, kind)
    return dealt.groupBy("pack").applyInArrow(packed, schema)
