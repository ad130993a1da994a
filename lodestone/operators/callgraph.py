"""Call graphs: nodes, edges, degrees, depth, recursion, statistics and cycles.

nodes: artifact_id, address, name. edges: artifact_id, caller, callee, call_type; one row for each
call site. Depth and recursion grow a frontier by joins; each round is checkpointed, so a lost
executor costs one round. What is not settled after ROUNDS rounds (long call chains) is settled
artifact by artifact in one Python pass that is linear in the artifact's calls.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut

#: What makes a name a library function's, and the names of entry points.
LIBRARY_PREFIXES = ("libc_", "libm_", "__", "_GLOBAL_", "std::", "_ZN", "_Z")
LIBRARY_NAMES = ("printf", "scanf", "malloc", "free", "strlen", "strcpy", "strcat", "memcpy", "memset", "fopen", "fclose", "fread", "fwrite", "msvcrt", "kernel32", "ntdll")
ENTRY_NAMES = ("_start", "main", "DllMain")


def is_library(name: Column | str) -> Column:
    """A prefix, or one of the names anywhere inside."""
    n, out = (F.col(name) if isinstance(name, str) else name), F.lit(False)
    for p in LIBRARY_PREFIXES:
        out = out | n.startswith(p)
    for p in LIBRARY_NAMES:
        out = out | F.contains(n, F.lit(p))
    return out


def node_types(nodes: DataFrame, imports: DataFrame, entries: DataFrame) -> DataFrame:
    """nodes with node_type: EntryPoint (the header's address, or a name of one), External (an import's address), Library, Internal.

    imports: artifact_id, address. entries: artifact_id, address.
    """
    outside = imports.where("address is not null").select("artifact_id", "address", F.lit(True).alias("is_import")).distinct()
    first = entries.select("artifact_id", "address", F.lit(True).alias("is_entry")).distinct()
    n = nodes.join(outside, ["artifact_id", "address"], "left").join(first, ["artifact_id", "address"], "left")
    kind = F.when(F.coalesce("is_entry", F.lit(False)) | F.col("name").isin(*ENTRY_NAMES), "EntryPoint").when(F.coalesce("is_import", F.lit(False)), "External")
    return n.withColumn("node_type", kind.when(is_library("name"), "Library").otherwise("Internal")).drop("is_import", "is_entry")


def call_edges(instructions: DataFrame, nodes: DataFrame, indirect: bool = True) -> DataFrame:
    """One edge a call site: Direct and Recursive calls of known functions, and Indirect ones (callee 0) through memory."""
    calls = instructions.where(F.col("flow_kind") == "Call").join(nodes.select("artifact_id", F.col("address").alias("flow_target")).distinct(), ["artifact_id", "flow_target"], "left_semi")
    kind = F.when(F.col("flow_target") == F.col("function_addr"), "Recursive").otherwise("Direct")
    direct = calls.select("artifact_id", F.col("function_addr").alias("caller"), F.col("flow_target").alias("callee"), kind.alias("call_type"), F.col("address").alias("site"))
    if not indirect:
        return direct
    through = instructions.where((F.col("flow_kind") != "Call") & F.col("mnemonic").startswith("call") & F.contains("operands", F.lit("[")))
    return direct.unionByName(through.select("artifact_id", F.col("function_addr").alias("caller"), F.lit(0).cast("long").alias("callee"), F.lit("Indirect").alias("call_type"), F.col("address").alias("site")))


def tail_calls(instructions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Functions whose last instruction jumps to another known function."""
    last = instructions.groupBy("artifact_id", "function_addr").agg(F.max_by(F.struct("flow_kind", "flow_target", "address"), "idx").alias("last"))
    jumps = last.where("last.flow_kind = 'Jump' and last.flow_target <> function_addr").select("artifact_id", F.col("function_addr").alias("caller"), F.col("last.flow_target").alias("callee"), F.col("last.address").alias("site"))
    known = nodes.select("artifact_id", F.col("address").alias("callee")).distinct()
    return jumps.join(known, ["artifact_id", "callee"], "left_semi").select("artifact_id", "caller", "callee", F.lit("TailCall").alias("call_type"), "site")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with in_degree and out_degree, one for each edge."""
    into = edges.groupBy("artifact_id", F.col("callee").alias("address")).agg(F.count(F.lit(1)).alias("in_degree"))
    out = edges.groupBy("artifact_id", F.col("caller").alias("address")).agg(F.count(F.lit(1)).alias("out_degree"))
    both = nodes.join(into, ["artifact_id", "address"], "left").join(out, ["artifact_id", "address"], "left")
    return both.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("in_degree", "out_degree")})


#: Rounds of joins before the rest is settled by artifact.
ROUNDS = 24


def _by_artifact(rows: DataFrame, solve: Callable[[list[tuple]], list[tuple[int, int]]]) -> DataFrame:
    """artifact_id, address and value of solve(rows of an artifact: (a, b) pairs, sorted); rows: artifact_id, a and b."""
    dealt = rows.select("artifact_id", "a", "b").repartition("artifact_id").sortWithinPartitions("artifact_id", "a", "b")
    names = ["artifact_id", "address", "value"]

    def solved(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(artifact: str, pairs: list[tuple]) -> pa.RecordBatch:
            found = solve(pairs)
            return pa.RecordBatch.from_arrays([pa.array([artifact] * len(found), pa.string()), pa.array([x for x, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int32())], names=names)

        now, pairs = None, []
        for part in parts:
            for artifact, a, b in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if artifact != now:
                    if pairs:
                        yield batch(now, pairs)
                    now, pairs = artifact, []
                pairs.append((a, b))
        if pairs:
            yield batch(now, pairs)

    return dealt.mapInArrow(solved, "artifact_id string, address long, value int")


def farther(pairs: list[tuple], step: int, most: int | None) -> list[tuple[int, int]]:
    """(address, depth) of what a breadth-first search still reaches: a pair (address, null) is on the front at depth step, (caller, callee) a call to a node not seen before."""
    calls: dict[int, list[int]] = {}
    front = []
    for a, b in pairs:
        if b is None:
            front.append(a)
        else:
            calls.setdefault(a, []).append(b)
    seen, out = set(front), []
    while front and (most is None or step < most):
        step += 1
        front = [b for a in front for b in calls.get(a, ()) if not (b in seen or seen.add(b))]
        out += [(b, step) for b in front]
    return out


def depths(edges: DataFrame, entries: DataFrame, most: int | None = None) -> DataFrame:
    """artifact_id, address and depth, the least number of calls from an entry point, of all that can be reached."""
    hops = edges.select("artifact_id", F.col("caller").alias("address"), "callee").distinct()
    front = seen = cut(entries.select("artifact_id", "address", F.lit(0).alias("depth")).distinct())
    step = 0
    while (most is None or step < most) and step < ROUNDS:
        step += 1
        reached = front.join(hops, ["artifact_id", "address"]).select("artifact_id", F.col("callee").alias("address")).distinct()
        front = cut(reached.join(seen, ["artifact_id", "address"], "left_anti").withColumn("depth", F.lit(step)))
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
    if most is None or step < most:
        # Calls to nodes that are not reached yet, and the front that they are searched from.
        known = seen.select("artifact_id", F.col("address").alias("callee"))
        left = hops.join(known, ["artifact_id", "callee"], "left_anti").select("artifact_id", F.col("address").alias("a"), F.col("callee").alias("b"))
        rows = left.unionByName(front.select("artifact_id", F.col("address").alias("a"), F.lit(None).cast("long").alias("b")))
        seen = seen.unionByName(_by_artifact(rows, lambda pairs: farther(pairs, step, most)).withColumnRenamed("value", "depth"))
    return seen


def lasting(pairs: list[tuple]) -> list[tuple[int, int]]:
    """(caller, 1) for callers from which a cycle of the calls can be reached."""
    into: dict[int, list[int]] = {}
    out: dict[int, int] = {}
    for a, b in pairs:
        into.setdefault(b, []).append(a)
        out[a] = out.get(a, 0) + 1
    idle = [b for b in into if b not in out]
    while idle:
        for a in into.get(idle.pop(), ()):
            out[a] -= 1
            if not out[a]:
                idle.append(a)
    return [(a, 1) for a, n in out.items() if n]


def recursive(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """artifact_id and address of nodes from which a cycle can be reached: what is left once nodes without calls to others left are taken away."""
    left = cut(edges.select("artifact_id", "caller", "callee").distinct())
    n, step = left.count(), 0
    alive = None
    while n:
        callers = left.select("artifact_id", F.col("caller").alias("callee")).distinct()
        left = cut(left.join(callers, ["artifact_id", "callee"], "left_semi"))
        if (now := left.count()) == n:
            break
        n, step = now, step + 1
        if step == ROUNDS:
            alive = _by_artifact(left.select("artifact_id", F.col("caller").alias("a"), F.col("callee").alias("b")), lasting).select("artifact_id", "address")
            break
    if alive is None:
        alive = left.select("artifact_id", F.col("caller").alias("address")).distinct()
    return nodes.select("artifact_id", "address").distinct().join(alive, ["artifact_id", "address"], "left_semi")


def unreachable(nodes: DataFrame, depth_rows: DataFrame) -> DataFrame:
    return nodes.join(depth_rows, ["artifact_id", "address"], "left_anti")


def annotated(nodes: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """nodes with degrees, is_recursive and depth (null if it cannot be reached)."""
    loops = recursive(nodes, edges).withColumn("is_recursive", F.lit(True))
    both = degrees(nodes, edges).join(loops, ["artifact_id", "address"], "left").join(depths(edges, entries), ["artifact_id", "address"], "left")
    return both.withColumn("is_recursive", F.coalesce("is_recursive", F.lit(False)))


def statistics(annotated_nodes: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Eleven figures by artifact."""
    n = annotated_nodes.groupBy("artifact_id").agg(
        F.count(F.lit(1)).alias("functions"), F.count_if("is_recursive").alias("recursive_functions"), F.count_if(F.col("out_degree") == 0).alias("leaf_functions"),
        F.count_if(F.col("depth").isNull()).alias("unreachable_functions"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"),
        F.coalesce(F.avg("depth"), F.lit(0.0)).alias("avg_depth"), F.count_if("is_recursive").alias("cyclic_dependencies"),
    )
    e = edges.groupBy("artifact_id").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("call_type") == "Direct").alias("direct_calls"), F.count_if(F.col("call_type") == "Indirect").alias("indirect_calls"))
    points = entries.select("artifact_id", "address").distinct().groupBy("artifact_id").agg(F.count(F.lit(1)).alias("entry_points"))
    return n.join(e, "artifact_id", "left").join(points, "artifact_id", "left").na.fill(0, ["calls", "direct_calls", "indirect_calls", "entry_points"])


def cycle_paths(successors: dict[int, list[int]], order: list[int]) -> list[list[int]]:
    """Cycles that one depth-first search closes: each node is entered once, in the given order."""
    place: dict[int, int] = {}  # on the path; -1 when done
    out = []
    for root in order:
        if root in place:
            continue
        place[root], path, rest = 0, [root], [iter(successors.get(root, ()))]
        while path:
            for s in rest[-1]:
                if (at := place.get(s)) is None:
                    place[s] = len(path)
                    path.append(s)
                    rest.append(iter(successors.get(s, ())))
                    break
                if at >= 0:
                    out.append(path[at:])
            else:
                place[path.pop()] = -1
                rest.pop()
    return out


def cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """artifact_id, cycle (number) and path; a call that leads back to the search's path closes a cycle.

    The search is sequential in an artifact and its paths are as long as the artifact's call
    chains, so an artifact should be one program. Edges are made distinct before they meet, and
    artifacts are searched many to a Python call.
    """
    hops = edges.select("artifact_id", F.col("caller").alias("address"), "callee").distinct()
    rows = hops.unionByName(nodes.select("artifact_id", "address", F.lit(None).cast("long").alias("callee")).distinct())
    dealt = rows.repartition("artifact_id").sortWithinPartitions("artifact_id", "address", F.col("callee").asc_nulls_first())

    def searched(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(artifact: str, graph: dict[int, list[int]]) -> pa.RecordBatch:
            # Nodes come in order of address, each before its calls; one that is only called is entered on the way.
            paths = cycle_paths(graph, list(graph))
            return pa.RecordBatch.from_arrays([pa.array([artifact] * len(paths), pa.string()), pa.array(range(len(paths)), pa.int32()), pa.array(paths, pa.list_(pa.int64()))], names=["artifact_id", "cycle", "path"])

        now, graph = None, {}
        for part in parts:
            for artifact, address, callee in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if artifact != now:
                    if graph:
                        yield found(now, graph)
                    now, graph = artifact, {}
                out = graph.setdefault(address, [])
                if callee is not None:
                    out.append(callee)
        if graph:
            yield found(now, graph)

    return dealt.mapInArrow(searched, "artifact_id string, cycle int, path array<long>")


def kept_nodes(nodes: DataFrame, most: int) -> DataFrame:
    """The first nodes of every artifact, by address."""
    order = Window.partitionBy("artifact_id").orderBy("address")
    return nodes.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")
