"""Verified classes of documents from banded signatures, in blocks of bounded size.

Documents that share a band's bucket are linked to its least member; connected components of
these links are the candidate clusters. A cluster is dealt by hash into blocks of bounded mass,
and every pair of blocks is one unit of work, so that a cluster of any size spreads over tasks
and each pair of its members is compared in exactly one place. Where members have sketches, two
things keep clusters of several blocks from costing their square: members are first compared with a
few pivots of their cluster, and those that a pivot connects are a group whose members are not
compared again; and a member goes only to those units whose other block holds a member of another
group that its sketch agrees with. A unit returns a spanning forest of its links, never all pairs.
Components of the verified links are the classes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, release
from .graph import components


#: Rows of cluster members that are broadcast at most.
BROADCAST_ROWS = 250_000
#: Texts in a block of a bucket, about; a task holds the sketches of two blocks.
BUCKET_ROWS = 1 << 12
#: Parts in which the bands are spread one after another, so that only one part's shuffle lies on disk.
PASSES = 3
#: Members of a cluster among which pivots are sought, about; pivots of a round; sampled members that a pivot stands for at least; rounds.
SAMPLE, PIVOTS, COVERED, ROUNDS = 128, 8, 4, 4
#: Blocks whose members meet the pivots in one task.
PIVOT_BLOCKS = 4
#: A cluster has another round if a round connected this share of the members that were left.
SETTLED = 0.1


def text_key(text: Column) -> Column:
    """MD5 of the text as bytes; all nulls have a key of their own."""
    key = F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.when(text.isNull(), F.unhex(F.md5(F.lit("null").cast("binary")))).otherwise(key)


def postings_links(sets: list[np.ndarray], left: int, enough: Callable[[np.ndarray, int, np.ndarray], np.ndarray], same: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets (sorted, without repeats).

    Sets before index left are compared with those from left on; with left 0 all are compared with
    all. enough(common, size, sizes) says which sets share enough with one of the given size;
    same(i, j), if given, is asked of those that are not connected yet.
    """
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    right = np.arange(left, len(sets))
    values = np.concatenate([sets[i] for i in right]) if len(right) else np.empty(0, np.uint64)
    owner = np.repeat(right, sizes[right])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    out = []
    for i in range(left or len(sets)):
        lo, hi = np.searchsorted(values, sets[i], "left"), np.searchsorted(values, sets[i], "right")
        n = hi - lo
        total = int(n.sum())
        if not total:
            continue
        # The posting lists of the set's items, one after another.
        at = np.arange(total) + np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n)
        common = np.bincount(owner[at], minlength=len(sets))
        for j in map(int, np.flatnonzero(enough(common, sizes[i], sizes) & (common > 0))):
            if j != i and (left or j > i) and (a := root(i)) != (b := root(j)) and (same is None or same(i, j)):
                parent[max(a, b)] = min(a, b)
                out.append((i, j))
    return out


def sketch_links(sketches: np.ndarray, joined: np.ndarray, block: np.ndarray | None, share: float) -> list[tuple[int, int]]:
    """A spanning forest of the rows of sketches that agree in at least that share of slots.

    Rows marked joined are connected from the start. With block (0 or 1 for each row) only rows of
    different blocks are compared.
    """
    label = np.where(joined, -1, np.arange(len(sketches)))
    out = []
    for i in np.flatnonzero(~joined):
        others = label != label[i]
        if block is not None:
            others &= block != block[i]
        near = np.flatnonzero(others)
        near = near[(sketches[near] == sketches[i]).mean(axis=1) >= share]
        found, first = np.unique(label[near], return_index=True)
        out += [(int(i), int(j)) for j in near[first]]
        label[np.isin(label, found)] = label[i]
    return out


def agreeing(star: DataFrame, marked: DataFrame, share: float, block_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links a, b that connect all texts of a bucket whose sketches (a byte for each slot) agree in at least that share of slots.

    star: band, size, a and b, a row for each text a of a bucket of that size and the bucket's
    least member b. Members that disagree with the least one are compared with all others of the
    bucket, in blocks of bounded size, so that a stranger as least member parts no two that agree.
    """
    own = marked.groupBy(F.xxhash64("text_key").alias("id")).agg(F.first("sketch").alias("sketch"))

    @F.pandas_udf("boolean")
    def agree(one: pd.Series, two: pd.Series) -> pd.Series:
        return pd.Series([bool(np.mean(np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)) >= share) for x, y in zip(one, two, strict=True)], dtype=bool)

    both = star.select("a", "b").distinct().join(own.select(F.col("id").alias("a"), F.col("sketch").alias("one")), "a").join(own.select(F.col("id").alias("b"), F.col("sketch").alias("two")), "b")
    judged = cut(both.select("a", "b", agree("one", "two").alias("joined")))

    # Only a bucket with a member that failed, and with another one besides the least, has pairs left.
    open_ = cut(star.where("size > 2").join(judged, ["a", "b"]).select("band", "a", "joined"))
    left = open_.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("joined").alias("whole")).where("not whole and n > 1")
    left = left.select(F.col("band").alias("left_band"), F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"))
    members = open_.join(left, open_["band"] == left["left_band"]).join(own, F.col("a") == F.col("id")).withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    units = members.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.select("band", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("two"), "block", "a", "joined", "sketch")

    def compared(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found(unit: list[tuple], one: int, two: int) -> pd.DataFrame:
            sketches = np.frombuffer(b"".join(r[3] for r in unit), np.uint8).reshape(len(unit), -1)
            pairs = sketch_links(sketches, np.array([r[2] for r in unit], bool), np.array([r[0] for r in unit]) if one != two else None, share)
            return pd.DataFrame([(unit[i][1], unit[j][1]) for i, j in pairs], columns=["a", "b"], dtype="int64")

        at, unit = None, []
        for part in parts:
            for band, one, two, *row in part.itertuples(index=False, name=None):
                if at != (band, one, two):
                    if len(unit) > 1:
                        yield found(unit, *at[1:])
                    at, unit = (band, one, two), []
                unit.append(row)
        if len(unit) > 1:
            yield found(unit, *at[1:])

    more = units.repartition("band", "one", "two").sortWithinPartitions("band", "one", "two").mapInPandas(compared, "a long, b long")
    return judged.where("joined").select("a", "b").union(more)


def agreeing_blocks(sketches: np.ndarray, block: np.ndarray, first: int, share: float, mass: np.ndarray | None = None, least_share: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> list[tuple[int, int]]:
    """(row, block) for each row of sketches and each block that holds another row that agrees with it in at least that share of slots.

    Rows before first are compared with those from first on; with first 0 all are compared with all.
    least_share(one, two), if given, is the share that two rows of such masses need besides.
    """
    least = np.searchsorted(np.arange(sketches.shape[1] + 1) / sketches.shape[1], share)
    one, two = (np.arange(first), np.arange(first, len(sketches))) if first else (np.arange(len(sketches)),) * 2
    columns = np.ascontiguousarray(sketches[two].T)
    found = []
    for lo in range(0, len(one), 64):
        rows = one[lo : lo + 64]
        common = np.zeros((len(rows), len(two)), np.uint16)
        for slot, own in zip(columns, sketches[rows].T, strict=True):
            common += own[:, None] == slot
        near = common >= least
        if least_share is not None:
            near &= common >= sketches.shape[1] * least_share(mass[rows][:, None], mass[two]) - 1e-9
        if not first:
            near[np.arange(len(rows)), rows] = False
        i, j = np.nonzero(near)
        found.append(np.stack([rows[i], block[two[j]]], axis=1))
        if first:
            found.append(np.stack([two[j], block[rows[i]]], axis=1))
        found = [np.unique(np.concatenate(found), axis=0)] if sum(map(len, found)) > 1 << 20 else found
    return list(map(tuple, np.unique(np.concatenate(found), axis=0).tolist())) if found else []


def by_unit(make: Callable[[], Callable[[list[tuple], int, int], pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For mapInPandas: found(rows, one, two) for every run of rows that are equal in their first three columns (cluster, one, two), which the rows come without; make() gives found once a task."""

    def units(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = make()
        at, unit = None, []
        for part in parts:
            for cluster, one, two, *row in part.itertuples(index=False, name=None):
                if at != (cluster, one, two):
                    if len(unit) > 1:
                        yield found(unit, *at[1:])
                    at, unit = (cluster, one, two), []
                unit.append(row)
        if len(unit) > 1:
            yield found(unit, *at[1:])

    return units


def covering(sketches: np.ndarray, share: float) -> list[int]:
    """Rows that stand for many: the one that agrees with most in that share of slots, then the one that agrees with most of the others, and so on."""
    near = np.array([(sketches == x).mean(axis=1) >= share for x in sketches])
    left, out = np.ones(len(sketches), bool), []
    while len(out) < PIVOTS:
        counts = (near & left).sum(axis=1)
        i = int(counts.argmax())
        if counts[i] < COVERED:
            break
        out.append(i)
        left &= ~near[i]
    return out


def settled(held: DataFrame, sounded: DataFrame, verified: Callable, share: float, block_mass: int) -> DataFrame | None:
    """Verified links a, b between members of large clusters and pivots of theirs; None if there are none.

    held: node, cluster, mass and sketch; sounded: node, cluster and payload. Pivots come from a
    sample of the members that no pivot is linked to yet. Every round moves each payload of the
    clusters that have pivots once.
    """

    def chosen(unit: list[tuple], one: int, two: int) -> pd.DataFrame:
        rows = covering(np.frombuffer(b"".join(r[2] for r in unit), np.uint8).reshape(len(unit), -1), min(1.0, 2 * share))
        return pd.DataFrame([(unit[i][0], unit[i][1]) for i in rows], columns=["pivot_cluster", "pivot"])

    kind = held.schema["cluster"].dataType.simpleString()
    open_, found = held, None
    for k in range(ROUNDS):
        sizes = open_.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("cluster", "size_cluster")
        drawn = open_.join(sizes, open_["cluster"] == sizes["size_cluster"]).where(F.pmod(F.xxhash64("node", F.lit(k)), F.col("n")) < SAMPLE)
        drawn = drawn.select("cluster", F.lit(0).alias("one"), F.lit(0).alias("two"), F.col("cluster").alias("own"), "node", "sketch", F.xxhash64("cluster").alias("dealt"))
        # Dealt by another key than the join above: else its exchange stands for this one, and Spark may split it.
        pivots = cut(drawn.repartition("dealt").drop("dealt").sortWithinPartitions("cluster", "node").mapInPandas(by_unit(lambda: chosen), f"pivot_cluster {kind}, pivot binary"))
        if pivots.isEmpty():
            break
        # Members in blocks, and every pivot in each block of its cluster, as block -1.
        mass = held.groupBy("cluster").agg(F.ceil(F.sum("mass") / (PIVOT_BLOCKS * block_mass)).cast("int").alias("blocks"))
        mass = cut(mass.join(pivots.select(F.col("pivot_cluster").alias("cluster")).distinct(), "cluster").withColumnRenamed("cluster", "mass_cluster"))
        members = sounded.join(mass, sounded["cluster"] == mass["mass_cluster"]).join(pivots.select("pivot"), F.col("node") == F.col("pivot"), "left")
        here = F.array(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        members = members.withColumn("two", F.explode(F.when(F.col("pivot").isNull(), here).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
        members = members.select("cluster", F.lit(-1).alias("one"), "two", F.when(F.col("pivot").isNull(), F.col("two")).otherwise(F.lit(-1)).alias("block"), "node", "payload")
        links = cut(members.repartition("cluster", "two").sortWithinPartitions("cluster", "two").mapInPandas(verified, "a binary, b binary"))
        found = links if found is None else found.union(links)
        ends = links.select(F.col("a").alias("end")).union(links.select("b")).distinct()
        rest = cut(open_.join(ends, open_["node"] == ends["end"], "left"))
        shares = rest.groupBy(F.col("cluster").alias("open_cluster")).agg(F.avg(F.col("end").isNotNull().cast("int")).alias("part")).where(F.col("part") >= SETTLED)
        rest = rest.where("end is null").drop("end")
        open_ = cut(rest.join(shares.select("open_cluster"), rest["cluster"] == F.col("open_cluster"), "left_semi"))
        del sizes, drawn, pivots, mass, members, links, ends, rest, shares
        release(held.sparkSession)
    return found


def ranges(rows: DataFrame, amount: Column, level: Column, name: str) -> DataFrame:
    """rows with name, a number of a block within the cluster, and name_at, name_n, name_of: the first block and the number of blocks of the row's group, and those of its cluster.

    amount is the share of a block that a row fills. Every group of a cluster has blocks of its own, in which
    rows lie in the order of level (whole numbers, few in a group) and by hash within a level.
    """
    rows = rows.withColumn("amount", amount).withColumn("level", level)
    key = [F.col(x).alias(f"range_{x}") for x in ("cluster", "grouped", "level")]
    each = Window.partitionBy("range_cluster", "range_grouped")
    sizes = rows.groupBy(*key).agg(F.sum("amount").alias("wide")).withColumn("total", F.sum("wide").over(each))
    sizes = sizes.withColumn("before", F.sum("wide").over(each.orderBy("range_level")) - F.col("wide")).withColumn(f"{name}_n", F.greatest(F.lit(1), F.ceil("total")).cast("int"))
    # The first row of each group counts the group's blocks for the cluster.
    counted = sizes.withColumn("counts", F.when(F.row_number().over(each.orderBy("range_level")) == 1, F.col(f"{name}_n")).otherwise(0))
    cluster = Window.partitionBy("range_cluster")
    counted = counted.withColumn(f"{name}_of", F.sum("counts").over(cluster).cast("int"))
    counted = counted.withColumn(f"{name}_at", (F.sum("counts").over(cluster.orderBy("range_grouped")) - F.col(f"{name}_n")).cast("int")).drop("counts")
    both = rows.join(counted, (rows["cluster"] == F.col("range_cluster")) & (rows["grouped"] == F.col("range_grouped")) & (rows["level"] == F.col("range_level")))
    inside = F.pmod(F.xxhash64("node", F.lit(name)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    place = F.floor((F.col("before") + inside * F.col("wide")) * F.col(f"{name}_n") / F.col("total"))
    both = both.withColumn(name, (F.col(f"{name}_at") + F.least(F.col(f"{name}_n") - 1, place)).cast("int"))
    return both.drop("amount", "level", "range_cluster", "range_grouped", "range_level", "wide", "total", "before")


def meeting(held: DataFrame, share: float, block_mass: int, least_share: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, block_rows: int = BUCKET_ROWS) -> DataFrame:
    """node, block and withs (blocks of its cluster with a member of another group that agrees with it) for the members of large clusters that have any.

    held: node, cluster, mass, sketch and grouped, the member's group or an empty key for none. Each
    group has blocks of its own, so that few members without a group make few blocks for the others
    to go to; in a block lie members of near mass, as others seldom match (see agreeing_blocks for
    least_share). Sketches are compared in blocks of bounded size, too.
    """
    level = F.floor(F.log2(F.greatest(F.lit(1), F.col("mass"))) * 8).cast("int")
    placed = ranges(held, F.greatest(F.lit(1), F.col("mass")) / F.lit(float(block_mass)), level, "block")
    placed = ranges(placed, F.lit(1.0 / block_rows), F.lit(0), "part")
    alone = F.length("grouped") == 0
    every = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("part_of") - 1)))
    every = every.where(alone | (F.col("with") < F.col("part_at")) | (F.col("with") >= F.col("part_at") + F.col("part_n")))
    units = every.select("cluster", F.least("part", "with").alias("one"), F.greatest("part", "with").alias("two"), "part", "node", "block", "sketch", "mass")

    def compared(unit: list[tuple], one: int, two: int) -> pd.DataFrame:
        unit.sort(key=lambda r: r[0])
        first = sum(r[0] == one for r in unit) if one != two else 0
        sketches = np.frombuffer(b"".join(r[3] for r in unit), np.uint8).reshape(len(unit), -1)
        pairs = agreeing_blocks(sketches, np.array([r[2] for r in unit]), first, share, np.array([r[4] for r in unit]), least_share) if one == two or 0 < first < len(unit) else []
        # A row a member, so that rows stay in proportion to members.
        withs: dict[int, list[int]] = {}
        for i, k in pairs:
            withs.setdefault(i, []).append(int(k))
        return pd.DataFrame([(unit[i][1], unit[i][2], x) for i, x in withs.items()], columns=["node", "block", "withs"])

    found = units.repartition("cluster", "one", "two").sortWithinPartitions("cluster", "one", "two").mapInPandas(by_unit(lambda: compared), "node binary, block int, withs array<int>")
    return cut(found.groupBy("node").agg(F.first("block").alias("block"), F.array_distinct(F.flatten(F.collect_list("withs"))).alias("withs")))


def classes(keyed: DataFrame, marked: DataFrame, links: Callable[[], Callable[[list, int], list[tuple[int, int]]]], block_mass: int, agreement: float | None = None, many_bands: bool = False, prepared: Callable[[Column], Column] | None = None, least_share: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """doc_id, text_key, class_key and class_id for every row of marked.

    keyed: doc_id, text_key and payload, what is compared. marked: doc_id, text_key, bands (hashes,
    array of long) and mass. links() gives a function of payloads and left (see postings_links).
    With agreement, marked has sketch too, and documents of a bucket are linked only if their
    sketches agree in that share of slots: bands of few slots then do not chain strangers. Members
    of a cluster of several blocks are compared with pivots first (see settled), and then only where
    their sketches agree so, in least_share(mass, mass) of slots besides if that is given, and no
    pivot connects them. prepared, if
    given, is applied to the payload of cluster members, once each, and links() gets what it returns.
    With many_bands the rows are made one a text before their bands are spread, which moves the
    arrays once and the bands once instead of the bands twice; a third of the bands goes at a time.
    """
    # Half a key is enough here: two texts that share it share a cluster, where whole keys tell them apart.
    # Copies of a text are equal rows, so that the map-side sums already make them one.
    star = None
    for k in range(PASSES if many_bands else 1):
        if many_bands:
            # One row a text first, then one shuffle that both the aggregate and the join below read.
            few = F.ceil(F.size("bands") / PASSES).cast("int")
            some = F.slice("bands", few * k + 1, few)
            single = marked.groupBy(F.xxhash64("text_key").alias("text_id")).agg(F.first(some).alias("bands"))
            spread = single.select("text_id", F.explode("bands").alias("band")).repartition("band")
        else:
            spread = marked.select(F.xxhash64("text_key").alias("text_id"), F.explode("bands").alias("band"))
        hubs = spread.groupBy("band").agg(F.min("text_id").alias("hub"), F.max("text_id").alias("other"), F.count(F.lit(1)).alias("size")).where("hub <> other").select(F.col("band").alias("hub_band"), "hub", "size")
        part = spread.join(hubs, spread["band"] == hubs["hub_band"]).where("text_id <> hub").select("band", "size", F.col("text_id").alias("a"), F.col("hub").alias("b"))
        part = cut(part) if many_bands else part
        star = part if star is None else star.union(part)
        # The bands' shuffle is the largest one; it need not lie beside that of the next part or of the payloads.
        del spread, hubs, part
        single = None
        if many_bands:
            release(marked.sparkSession)
    clusters = components(star.select("a", "b").distinct() if agreement is None else agreeing(star if many_bands else cut(star), marked, agreement))
    del star
    release(marked.sparkSession)

    def checked() -> Callable[[list[tuple], int, int], pd.DataFrame]:
        compare = links()

        def found(rows: list[tuple], one: int, two: int) -> pd.DataFrame:
            unit = {node: (block, payload) for block, node, payload in rows}
            nodes = sorted(unit, key=lambda k: (unit[k][0] != one, k))
            left = sum(unit[k][0] == one for k in nodes) if one != two else 0
            pairs = compare([unit[k][1] for k in nodes], left) if one == two or 0 < left < len(nodes) else []
            return pd.DataFrame([(nodes[i], nodes[j]) for i, j in pairs], columns=["a", "b"])

        return found

    verified = by_unit(checked)

    # One row per text of a cluster, with the row of documents that stands for it.
    texts = marked.groupBy("text_key").agg(F.min("doc_id").alias("first_id"), F.max("mass").alias("mass"))
    members = cut(clusters.join(texts, clusters["node"] == F.xxhash64(texts["text_key"])).select(F.col("text_key").alias("node"), F.col("label").alias("cluster"), "first_id", "mass"))
    mass = members.groupBy("cluster").agg(F.greatest(F.lit(1), F.ceil(F.sum("mass") / block_mass)).cast("int").alias("blocks")).withColumnRenamed("cluster", "mass_cluster")
    dealt = members.join(mass, members["cluster"] == mass["mass_cluster"]).select("node", "first_id", "cluster", "mass", "blocks")
    rows = members.count()

    def with_payload(some: DataFrame) -> DataFrame:
        # Rows of about 60 bytes are broadcast; beyond the bound the payloads are shuffled to them.
        some = F.broadcast(some) if rows <= BROADCAST_ROWS else some
        whole = keyed.join(some, (keyed["text_key"] == some["node"]) & keyed["doc_id"].eqNullSafe(some["first_id"]))
        return whole.withColumn("payload", (prepared or F.col)("payload")).drop("doc_id", "text_key", "first_id")

    first = None
    if agreement is None:
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        units = with_payload(dealt.select("node", "first_id", "cluster", "block", "blocks")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    else:
        dealt = cut(dealt)
        units = with_payload(dealt.where("blocks = 1").select("node", "first_id", "cluster", F.lit(0).alias("block"))).withColumn("with", F.lit(0))
        large = dealt.where("blocks > 1")
        if not large.isEmpty():
            own = F.broadcast(large) if rows <= BROADCAST_ROWS else large
            held = marked.join(own, (marked["text_key"] == own["node"]) & marked["doc_id"].eqNullSafe(own["first_id"])).dropDuplicates(["node"])
            held = cut(held.select("node", "cluster", own["mass"], "sketch"))
            sounded = cut(with_payload(large.select("node", "first_id", "cluster")))
            first = settled(held, sounded, verified, agreement, block_mass)
            if first is not None:
                groups = components(first).select(F.col("node").alias("end"), F.col("label").alias("grouped"))
                held = held.join(groups, held["node"] == groups["end"], "left").drop("end").withColumn("grouped", F.coalesce("grouped", F.lit(b"")))
            else:
                held = held.withColumn("grouped", F.lit(b""))
            met = meeting(cut(held), agreement, block_mass, least_share).withColumnRenamed("node", "met")
            release(marked.sparkSession)
            more = sounded.join(met, sounded["node"] == met["met"]).withColumn("with", F.explode("withs"))
            columns = ["cluster", "block", "with", "node", "payload"]
            units = units.select(columns).union(more.select(columns))
    units = units.select("cluster", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("two"), "block", "node", "payload")

    pairs = units.repartition("cluster", "one", "two").sortWithinPartitions("cluster", "one", "two").mapInPandas(verified, "a binary, b binary")
    pairs = cut(pairs if first is None else pairs.union(first))
    del units, dealt, clusters, mass, members
    release(marked.sparkSession)
    labels = components(pairs)
    release(marked.sparkSession)

    # Class ids come from one row a text; both sides of the last join are exchanges, so that Spark can split a large class.
    by_text = texts.select("text_key", "first_id").join(labels, F.col("text_key") == F.col("node"), "left")
    ids = cut(by_text.groupBy(F.coalesce("label", "text_key").alias("id_key")).agg(F.min("first_id").alias("class_id")))
    joined = marked.select("doc_id", "text_key").join(labels, F.col("text_key") == F.col("node"), "left")
    joined = joined.select("doc_id", "text_key", F.coalesce("label", "text_key").alias("class_key"))
    return joined.join(ids, joined["class_key"] == ids["id_key"]).select("doc_id", "text_key", "class_key", "class_id")
