"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of equal slots. Every shard owns virtual nodes at hashed slots; a key
falls into a slot and asks the shards it meets clockwise from there, each shard once. A shard
that is full sends the key on. Whole slots are admitted in a seeded order, and a slot that does
not fit wholly is cut at a rank, so that the plan is made from one count per slot: its size is
the ring's, not the corpus's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, has_columns, number_copies


def _hash(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("/".join(map(str, parts)).encode(), digest_size=8).digest(), "big")


def ring_orders(shards: int, vnodes: int, slots: int, seed: int) -> list[list[int]]:
    """For each slot the shards in the order in which they are met clockwise."""
    at: dict[int, list[int]] = {}
    for _, slot, shard in sorted((_hash(seed, "node", s, v), _hash(seed, "node", s, v) % slots, s) for s in range(shards) for v in range(vnodes)):
        at.setdefault(slot, []).append(shard)
    points = sorted(at)
    following: list[list[int]] = []
    for i in range(len(points)):
        seen: dict[int, None] = {}
        for k in range(len(points)):
            for shard in at[points[(i + k) % len(points)]]:
                seen.setdefault(shard)
            if len(seen) == shards:
                break
        following.append(list(seen))
    out, i = [], 0
    for slot in range(slots):
        while i < len(points) and points[i] < slot:
            i += 1
        out.append(following[i % len(points)])
    return out


def place(counts: Sequence[int], orders: Sequence[Sequence[int]], capacity: Sequence[int], seed: int) -> list[tuple[int, int, int, int, int]]:
    """(slot, first rank, rank after the last, shard, its first place) for every part of every slot.

    In turn r each slot's rest asks the r-th shard of its order; a shard admits in a seeded order
    of slots until it is full.
    """
    rest = {s: (0, n) for s, n in enumerate(counts) if n}
    room, used = list(capacity), [0] * len(capacity)
    ranked = sorted(rest, key=lambda s: _hash(seed, "slot", s))
    out = []
    for turn in range(len(capacity)):
        for s in ranked:
            if s not in rest:
                continue
            lo, hi = rest[s]
            shard = orders[s][turn]
            if take := min(room[shard], hi - lo):
                out.append((s, lo, lo + take, shard, used[shard]))
                room[shard] -= take
                used[shard] += take
                if lo + take == hi:
                    del rest[s]
                else:
                    rest[s] = (lo + take, hi)
    assert not rest, "the capacities are smaller than the rows"
    return out


def capacities(rows: int, shards: int, epsilon: float) -> list[int]:
    """Rows that each shard may hold: (1 + epsilon) times the mean; for 0 exactly the rows, at most one apart."""
    if epsilon == 0:
        return [rows // shards + (i < rows % shards) for i in range(shards)]
    return [max(-(-rows // shards), int((1 + epsilon) * rows / shards))] * shards


def shard_documents(
    docs: DataFrame,
    *,
    shards: int = 8,
    vnodes: int = 64,
    slots_log2: int = 13,
    epsilon: float = 0.0,
    seed: int = 7,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Every row of docs with its shard and its place in the shard.

    Needs doc_id and text. Adds size (UTF-8 bytes of the text plus 1), text_crc32 (unsigned, of
    the UTF-8 bytes), shard (0 to shards - 1) and slot (gapless from 0 in each shard). columns
    names the columns to keep (default: all). Columns of the added names are replaced.

    With epsilon 0 the shards' counts differ by one row at most; otherwise none holds more than
    (1 + epsilon) times the mean. The key is doc_id with the text's CRC and size, so that rows
    without doc_id spread too. A null text counts as an empty one: size 1, CRC 0. Rows equal in
    all of these may swap places among themselves; they are numbered first and the number is part
    of their key, so that a third of all rows may be equal. An empty table gives an empty table.
    """
    has_columns(docs, "doc_id", "text")
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    own = ["size", "text_crc32", "shard", "slot"]
    kept = [c for c in (docs.columns if columns is None else columns) if c not in own]
    keyed = docs.select(*kept, F.col("doc_id").alias("ring_id"), (F.length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    keyed = keyed.withColumn("ring_row", F.xxhash64(F.lit(seed), "ring_id", "text_crc32", "size"))
    if columns is not None:
        keyed = cut(keyed)  # narrow rows, so that the texts are read once
    keyed = number_copies(keyed, "ring_row", "ring_copy").withColumn("ring_hash", F.when(F.col("ring_copy") == 0, F.col("ring_row")).otherwise(F.xxhash64("ring_row", "ring_copy")))
    keyed = keyed.withColumn("ring_slot", F.shiftrightunsigned("ring_hash", 64 - slots_log2).cast("int"))

    counts = [0] * (1 << slots_log2)
    for r in keyed.groupBy("ring_slot").count().collect():  # a row for each slot of the ring at most
        counts[r[0]] = r[1]
    orders = ring_orders(shards, vnodes, 1 << slots_log2, seed)
    parts = place(counts, orders, capacities(sum(counts), shards, epsilon), seed)
    plan = docs.sparkSession.createDataFrame(parts or [(0, 0, 0, 0, 0)], "part_slot int, lo long, hi long, shard int, base long")

    ranked = keyed.withColumn("ring_rank", F.row_number().over(Window.partitionBy("ring_slot").orderBy("ring_hash", "ring_id", "text_crc32")) - 1)
    placed = ranked.join(
        F.broadcast(plan),  # slots + shards squared rows at most
        (F.col("ring_slot") == F.col("part_slot")) & (F.col("ring_rank") >= F.col("lo")) & (F.col("ring_rank") < F.col("hi")),
    )
    return placed.select(*kept, "size", "text_crc32", "shard", (F.col("base") + F.col("ring_rank") - F.col("lo")).cast("long").alias("slot"))
