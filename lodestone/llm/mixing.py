"""Mixing sources to target weights by Sainte-Laguë apportionment.

Each source is a stream of words: its documents in a seeded hash order. The stream is cut into
blocks of equally many words. The mix has a fixed number of seats (the house); a seat is one
block taken once. Sources win seats by the highest quotients target / (2 * seats + 1). Sources of
few blocks have shorter blocks of their own, and as many seats as their target is worth. A source's
seats go to its shards in the same way, and inside a shard a seeded order picks the blocks.

Only sums leave the documents: one row per (source, bucket) cell, one per source, and the block
table, whose size is bounded by house + 8 * number of sources, about, however large the corpus is. Offsets
in a stream come from two levels (sums of cells, then a window inside a cell), so that no task
ever holds a whole source.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, has_columns, n_words, number_copies

#: Rows of a bucket on average; a cell (one source in one bucket) has fewer.
ROWS_PER_BUCKET = 4096
MIN_BUCKETS = 256
#: Sources whose sums the driver takes at most.
MOST_SOURCES = 100_000
#: Blocks of a source: one that would have fewer than the first gets as many of its own length; where the house has no room, the second at least.
OWN_BLOCKS, LEAST_OWN_BLOCKS = 64, 8
BLOCKS = pa.schema([("source", pa.string()), ("source_size", pa.int64()), ("target", pa.float64()), ("length", pa.int64()), ("block", pa.int64()), ("times", pa.int64()), ("before", pa.int64())])


def targets(sizes: Sequence[int], weights: Sequence[float], max_repeats: int) -> list[float]:
    """Shares of sum(sizes) by weight, none above max_repeats times its size.

    What is cut off goes to the others by weight, again and again, until none is above.
    """
    total, out, open_ = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_:
        weight = sum(weights[i] for i in open_)
        above = {i for i in open_ if left * weights[i] / weight > max_repeats * sizes[i]}
        if not above:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in above:
            out[i] = float(max_repeats * sizes[i])
        open_ -= above
        left = total - sum(out[i] for i in range(len(sizes)) if i not in open_)
    return out


def sainte_lague(votes: Sequence[float], seats: int, most: Sequence[int]) -> list[int]:
    """Seats by the highest quotients votes / (2 * seats so far + 1), at most most[i] each; ties go to the first."""
    out = [0] * len(votes)
    heap = [(-v, i) for i, v in enumerate(votes) if v > 0 and most[i] > 0]
    heapq.heapify(heap)
    for _ in range(seats):
        if not heap:
            break
        _, i = heap[0]
        out[i] += 1
        if out[i] < most[i]:
            heapq.heapreplace(heap, (-votes[i] / (2 * out[i] + 1), i))
        else:
            heapq.heappop(heap)
    return out


def _order(seed: int, source: str | None, block: int) -> bytes:
    return hashlib.blake2b(f"{seed}/{source is None}/{source}/{block}".encode("utf-8", "surrogatepass"), digest_size=8).digest()


def plan_blocks(sources: pd.DataFrame, weights: Sequence[float], house: int, shards: int, max_repeats: int, seed: int, min_block: int) -> pd.DataFrame:
    """The block table: source, source_size, target, length (words of the source's blocks), block, times, before (words taken in the source's blocks before it).

    sources has source and source_size, one row each. Every source has at least the row of block 0.
    """
    rows = sorted(zip(sources["source"], sources["source_size"], strict=True), key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [int(n) for _, n in rows]
    total = sum(sizes)
    length = block_length(total, house, min_block)
    want = targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], max_repeats)
    fewest = max(LEAST_OWN_BLOCKS, min(OWN_BLOCKS, house // max(1, len(rows))))
    lengths = [min(length, max(1, -(-n // fewest))) for n in sizes]
    blocks = [-(-n // own) for n, own in zip(sizes, lengths, strict=True)]
    # Sources with shorter blocks have their seats to themselves; a seat counts as the source's mean block, as its last one is short.
    seats = [0 if own == length else min(max_repeats * n, round(w * n / size)) if size else 0 for w, n, size, own in zip(want, blocks, sizes, lengths, strict=True)]
    shared = [i for i, own in enumerate(lengths) if own == length]
    votes = [want[i] * blocks[i] / sizes[i] if sizes[i] else 0.0 for i in shared]
    for i, q in zip(shared, sainte_lague(votes, round(sum(votes)), [max_repeats * blocks[i] for i in shared]), strict=True):
        seats[i] = q
    out: list[tuple] = []
    for (source, size), target, own, n, q in zip(rows, want, lengths, blocks, seats, strict=True):
        parts = [len(range(j, n, shards)) for j in range(shards)]
        times = [0] * n
        for j, quota in enumerate(sainte_lague(parts, q, [max_repeats * p for p in parts])):
            if quota:
                ordered = sorted(range(j, n, shards), key=lambda b: _order(seed, source, b))
                every, more = divmod(quota, len(ordered))
                for rank, b in enumerate(ordered):
                    times[b] = every + (rank < more)
        before = 0
        for b in range(max(n, 1)):
            k = times[b] if n else 0
            out.append((source, int(size), target, own, b, k, before))
            before += k * min(own, int(size) - b * own)
    return pd.DataFrame(out, columns=["source", "source_size", "target", "length", "block", "times", "before"])


def block_length(total: int, house: int, min_block: int = 1) -> int:
    """Words of a block, so that the whole corpus has about house blocks."""
    return max(min_block, math.ceil(total / house), 1)


def _quotient(x: Column, by: int | Column) -> Column:
    """x div by in whole numbers."""
    return F.call_function("div", x, (by if isinstance(by, Column) else F.lit(by)).cast("long"))


def mix_sources(
    docs: DataFrame,
    *,
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    house: int = 65_536,
    shards: int = 64,
    max_repeats: int = 3,
    seed: int = 20_260_101,
    min_block: int = 1,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """All rows of docs with all columns, or those named, and with what the mix takes of each.

    Needs doc_id, source and text. Sources in code point order (null last) get the weights in
    turn. Adds mix_size (words), mix_source_size, mix_target (double, its source's), mix_taken
    (words taken, repeats counted) and mix_copies (how often the block at the document's middle
    word is taken, at most max_repeats: for callers that take whole documents). Columns of
    these names are replaced.

    The block size is ceil(all words / house), at least min_block; a source of fewer than 64 such
    blocks is cut into 64 shorter ones (fewer, but 8 at least, beyond 1,024 sources). A source's
    taken words differ from its target by about one of its blocks.

    Null or empty texts have size 0 and are taken 0 times; a source with no words has target 0.
    Rows that repeat each count for themselves. An empty table gives an empty table. The same
    rows, seed and parameters give the same result however the rows are dealt out; rows equal in
    doc_id, source and text may swap their parts among themselves. Such rows are numbered before
    they are dealt, so that a third of all rows may be equal.

    With columns the texts are read once, and what is left of the rows is written down first.
    """
    has_columns(docs, "doc_id", "source", "text")
    own = ["mix_size", "mix_source_size", "mix_target", "mix_taken", "mix_copies"]
    kept = [c for c in (docs.columns if columns is None else columns) if c not in own]
    keyed = docs.select(
        *kept, F.col("source").alias("mix_source"), F.col("doc_id").alias("mix_id"), n_words(F.col("text")).alias("mix_size"),
        F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"), F.col("source")).alias("mix_row"),
    )
    if columns is not None:
        keyed = cut(keyed)
    buckets = max(MIN_BUCKETS, math.ceil((docs if columns is None else keyed).count() / ROWS_PER_BUCKET))
    keyed = number_copies(keyed, "mix_row", "mix_copy").withColumn("mix_hash", F.xxhash64("mix_row", "mix_copy"))
    keyed = keyed.withColumn("mix_bucket", F.pmod(F.col("mix_hash"), F.lit(buckets)).cast("int"))

    cells = cut(keyed.groupBy("mix_source", "mix_bucket").agg(F.sum("mix_size").alias("cell_size")))
    totals = cells.groupBy(F.col("mix_source").alias("source")).agg(F.sum("cell_size").alias("source_size"))

    def planned(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [p for p in parts if len(p)]
        if got:
            whole = pd.concat(got)
            whole["source"] = whole["source"].astype(object).where(whole["source"].notna(), None)
            yield plan_blocks(whole, weights, house, shards, max_repeats, seed, min_block)

    # One row per source meets in one place, the driver or beyond MOST_SOURCES a task; the blocks are at most house + 8 * sources, about.
    schema = "source string, source_size long, target double, length long, block long, times long, before long"
    few = totals.limit(MOST_SOURCES + 1).collect()
    if len(few) <= MOST_SOURCES:
        rows = list(planned(iter([pd.DataFrame(few, columns=["source", "source_size"])])))
        plan = docs.sparkSession.createDataFrame(pa.Table.from_pandas(rows[0], BLOCKS, preserve_index=False) if rows else BLOCKS.empty_table())
    else:
        plan = totals.coalesce(1).mapInPandas(planned, schema)
    plan = cut(plan)
    small = plan.count() <= 2 * house
    near = F.broadcast if small else (lambda x: x)

    heads = plan.where("block = 0").select(F.col("source").alias("head_source"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), F.col("length").alias("mix_length"))
    along = Window.partitionBy("mix_source").orderBy("mix_bucket")
    offsets = cells.select(
        F.col("mix_source").alias("cell_source"), F.col("mix_bucket").alias("cell_bucket"),
        (F.sum("cell_size").over(along) - F.col("cell_size")).alias("cell_start"),
    )
    offsets = offsets.join(near(heads), F.col("cell_source").eqNullSafe(F.col("head_source"))).drop("head_source")

    inside = Window.partitionBy("mix_source", "mix_bucket").orderBy("mix_hash", "mix_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = keyed.withColumn("mix_end", F.sum("mix_size").over(inside))
    placed = placed.join(offsets, placed["mix_source"].eqNullSafe(offsets["cell_source"]) & (placed["mix_bucket"] == offsets["cell_bucket"]))
    placed = placed.withColumn("mix_end", F.col("mix_end") + F.col("cell_start")).drop("cell_source", "cell_bucket", "cell_start")
    size, end = F.col("mix_size"), F.col("mix_end")
    start = end - size

    def at(df: DataFrame, name: str, word) -> DataFrame:
        """Joins the block of a word position; adds times and before under name, and the words of the block before the position."""
        own = near(plan.select(F.col("source").alias(f"{name}_source"), F.col("block").alias(f"{name}_block"), F.col("times").alias(f"{name}_times"), F.col("before").alias(f"{name}_before")))
        df = df.withColumn(f"{name}_at", _quotient(word, F.col("mix_length")))
        df = df.join(own, F.col("mix_source").eqNullSafe(F.col(f"{name}_source")) & (F.col(f"{name}_at") == F.col(f"{name}_block")), "left")
        return df.drop(f"{name}_source", f"{name}_block")

    # An empty document takes nothing, so its place does not matter: word 0 always has a block.
    placed = at(placed, "mix_first", F.when(size > 0, start).otherwise(F.lit(0)))
    placed = at(placed, "mix_last", F.when(size > 0, end - 1).otherwise(F.lit(0)))
    placed = at(placed, "mix_mid", F.when(size > 0, start + _quotient(size, 2)).otherwise(F.lit(0)))
    upto = lambda name, word: F.col(f"{name}_before") + (word - F.col(f"{name}_at") * F.col("mix_length")) * F.col(f"{name}_times")
    placed = placed.withColumns({
        "mix_taken": F.when(size > 0, upto("mix_last", end) - upto("mix_first", start)).otherwise(F.lit(0)).cast("long"),
        "mix_copies": F.when(size > 0, F.col("mix_mid_times")).otherwise(F.lit(0)).cast("int"),
    })
    return placed.select(*kept, *own)


def take_documents(mixed: DataFrame) -> DataFrame:
    """The rows of mix_sources' result, each as often as the mix takes it, without the mix_ columns."""
    own = [c for c in mixed.columns if not c.startswith("mix_")]
    return mixed.where("mix_copies > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).select(*own)
