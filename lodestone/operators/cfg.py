"""Basic blocks, control-flow edges, complexity metrics, loops and dominators.

Blocks, edges and metrics are windows and aggregates by function. What depends on the order of a
depth-first search (back edges, natural loops, dominators) runs in one Python call a function: a
function's blocks are bounded by its code, so no group is larger than that.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["artifact_id", "function_addr"]
#: Mnemonics that the cognitive measure counts.
CONDITIONS = ("je", "jne", "jl", "jle", "jg", "jge", "jz", "jnz", "js", "jns")
LOOPS = ("loop", "loope", "loopne", "loopz", "loopnz")
TRAPS = ("int", "syscall", "sysenter")


def by_function(df: DataFrame) -> DataFrame:
    """df with a function's rows in one partition; windows and aggregates by KEY and more need no other shuffle."""
    return df.repartition(*KEY)


def with_blocks(instructions: DataFrame) -> DataFrame:
    """Instructions with block, from 0 in address order: a block begins at the first instruction, after a terminator, or at a target.

    Jumps, conditional jumps, calls, returns and interrupts are terminators; indirect ones are not.
    A target meets the instruction at its address as one more row there, in the partition of the
    function, so that one shuffle is enough.
    """
    order, same = Window.partitionBy(*KEY).orderBy("idx"), Window.partitionBy(*KEY, "_at")
    goes = F.col("flow_kind").isin("Jump", "ConditionalJump", "Call") & F.col("flow_target").isNotNull()
    spread = by_function(instructions).withColumn("_goal", F.explode(F.when(goes, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    met = spread.withColumn("_at", F.when(F.col("_goal"), F.col("flow_target")).otherwise(F.col("address")))
    marked = met.withColumn("_target", F.max("_goal").over(same)).where(~F.col("_goal"))
    after = F.lag(F.col("flow_kind").isin("Jump", "ConditionalJump", "Call", "Return", "Interrupt")).over(order)
    leader = F.col("_target") | F.coalesce(after, F.lit(False)) | (F.row_number().over(order) == 1)
    numbered = marked.withColumn("_leader", leader.cast("int")).withColumn("block", (F.sum("_leader").over(order) - 1).cast("int"))
    return numbered.select(*instructions.columns, "block")


def blocks(blocked: DataFrame) -> DataFrame:
    """One row a block: start, end, n, its last flow and mnemonic, its first mnemonic."""
    last = F.struct("flow_kind", "flow_target", "mnemonic", F.coalesce(F.try_add("address", "size"), F.col("address") - F.lit((1 << 63) - 1) + F.col("size") + F.lit(-(1 << 63)) - 1).alias("end"))
    rows = blocked.groupBy(*KEY, "block").agg(
        F.min("address").alias("start"), F.max_by(last, "idx").alias("last"), F.min_by("mnemonic", "idx").alias("first_mnemonic"), F.count(F.lit(1)).alias("n"),
    )
    return rows.select(
        *KEY, "block", "start", F.col("last.end").alias("end"), "n", F.col("last.flow_kind").alias("flow_kind"), F.col("last.flow_target").alias("flow_target"),
        F.col("last.mnemonic").alias("last_mnemonic"), "first_mnemonic",
    )


def edges(block_rows: DataFrame) -> DataFrame:
    """Edges (src, dst, ord): a jump goes to its target's block, a condition there and then on, returns and interrupts nowhere, all else on."""
    order, same = Window.partitionBy(*KEY).orderBy("block"), Window.partitionBy(*KEY, "_at")
    kind = F.col("flow_kind")
    follow = F.lead("block").over(order)
    b = block_rows.select(*KEY, "block", "start", "flow_kind", "flow_target", F.when(~kind.isin("Jump", "Return", "Interrupt"), follow).alias("_next"))
    # A jump meets the block at its target as one more row there.
    jumps = kind.isin("Jump", "ConditionalJump") & F.col("flow_target").isNotNull()
    spread = b.withColumn("_goal", F.explode(F.when(jumps, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    met = spread.withColumn("_at", F.when(F.col("_goal"), F.col("flow_target")).otherwise(F.col("start")))
    met = met.withColumn("_dst", F.when(F.col("_goal"), F.max(F.when(~F.col("_goal"), F.col("block"))).over(same)).otherwise(F.col("_next")))
    return met.where("_dst is not null").select(*KEY, F.col("block").alias("src"), F.col("_dst").alias("dst"), F.when(F.col("_goal"), 0).otherwise(1).alias("ord"))


def graph(block_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Blocks with successors (in order), predecessors (sorted) and block_type."""
    own = [c for c in block_rows.columns if c not in (*KEY, "block")]
    nobody = F.lit(None).cast("int")

    def end(block: str, to: Column, origin: Column) -> Column:
        return F.struct(F.col(block).alias("block"), to.alias("to"), origin.alias("from"))

    # Blocks and both ends of edges meet in one aggregate, so that nothing is joined.
    ends = edge_rows.select(*KEY, F.explode(F.array(end("src", F.col("dst"), nobody), end("dst", nobody, F.col("src")))).alias("e"), "ord").select(*KEY, "e.*", "ord")
    both = by_function(block_rows.select(*KEY, "block", F.struct(*own).alias("own")).unionByName(ends, allowMissingColumns=True))
    step = F.when(F.col("to").isNotNull(), F.struct("ord", "to"))
    met = both.groupBy(*KEY, "block").agg(
        F.max("own").alias("own"), F.transform(F.array_sort(F.collect_list(step)), lambda x: x["to"]).alias("successors"), F.array_sort(F.collect_list("from")).alias("predecessors")
    )
    g = met.where("own is not null").select(*KEY, "block", *[F.col(f"own.{c}").alias(c) for c in own], "successors", "predecessors")
    return g.withColumn("block_type", block_type())


def block_type() -> Column:
    kind = F.col("flow_kind")
    return (
        F.when(F.col("block") == 0, "Entry").when(F.size("successors") == 0, "Exit").when(kind == "Return", "Return")
        .when(kind == "Call", "Call").when(kind == "ConditionalJump", "Conditional").otherwise("Normal")
    )


def cyclomatic(edge_count: Column, block_count: Column) -> Column:
    return F.when(block_count > 0, F.greatest(edge_count - block_count, F.lit(0)) + 2).otherwise(F.lit(0))


def cognitive(blocked: DataFrame, graph_rows: DataFrame) -> DataFrame:
    """cognitive by function: a running fold whose nesting is a window sum over what came before."""
    # Whether a block splits comes to its instructions as one more row of the block.
    wide = graph_rows.select(*KEY, "block", (F.size("successors") > 1).alias("_split"))
    both = by_function(blocked.select(*KEY, "block", "idx", "mnemonic", "flow_kind").unionByName(wide, allowMissingColumns=True))
    splits, m = F.max("_split").over(Window.partitionBy(*KEY, "block")), F.col("mnemonic")
    rows = both.withColumn("splits", splits).where(F.col("idx").isNotNull())
    last, before = Window.partitionBy(*KEY).orderBy("idx"), Window.partitionBy(*KEY).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    ends = F.coalesce(F.lead("block").over(last) != F.col("block"), F.lit(True))
    rows = rows.withColumn("deeper", m.isin(*LOOPS).cast("int") + (F.col("splits") & ends).cast("int")).withColumn("nest", F.coalesce(F.sum("deeper").over(before), F.lit(0)))
    points = (F.col("flow_kind") == "ConditionalJump").cast("int") + m.isin(*CONDITIONS, *LOOPS).cast("int")
    return rows.groupBy(*KEY).agg(F.sum(points * (1 + F.col("nest")) + m.isin(*TRAPS).cast("int")).alias("cognitive"))


def halstead(instructions: DataFrame) -> DataFrame:
    """Halstead's measures by function: mnemonics are operators, comma-separated operands are operands."""
    parts = F.filter(F.transform(F.split("operands", ","), lambda x: F.trim(x)), lambda x: x != "")
    ops = instructions.groupBy(*KEY).agg(F.countDistinct("mnemonic").alias("n1"), F.count(F.lit(1)).alias("big_n1"))
    args = instructions.select(*KEY, F.explode(parts).alias("operand")).groupBy(*KEY).agg(F.countDistinct("operand").alias("n2"), F.count(F.lit(1)).alias("big_n2"))
    h = ops.join(args, KEY, "left").withColumns({"n2": F.coalesce("n2", F.lit(0)), "big_n2": F.coalesce("big_n2", F.lit(0))})
    n1, n2, big1, big2 = (F.col(c).cast("double") for c in ("n1", "n2", "big_n1", "big_n2"))
    h = h.withColumns({
        "vocabulary": F.col("n1") + F.col("n2"), "length": F.col("big_n1") + F.col("big_n2"),
        # 0 * log2(0) is not a number.
        "calculated_length": F.when(n2 == 0, F.lit(float("nan"))).otherwise(n1 * F.log2(n1) + n2 * F.log2(n2)),
        "volume": (big1 + big2) * F.log2(n1 + n2),
        "difficulty": F.when(n2 > 0, n1 / 2 * (big2 / n2)).otherwise(F.lit(0.0)),
    })
    effort = F.col("difficulty") * F.col("volume")
    return h.withColumns({"effort": effort, "time": effort / 18, "bugs": F.col("volume") / 3000})


def maintainability(volume: Column, complexity: Column, block_count: Column) -> Column:
    """0 to 100; null without volume or blocks. Blocks stand for lines."""
    index = F.lit(171.0) - 5.2 * F.ln(volume) - 0.23 * complexity - 16.2 * F.ln(block_count)
    return F.when((volume > 0) & (block_count > 0), F.greatest(F.lit(0.0), F.least(F.lit(100.0), index)))


def complexity(blocked: DataFrame, graph_rows: DataFrame) -> DataFrame:
    """One row a function: blocks, edges, cyclomatic, nesting_depth, cognitive, maintainability and Halstead's volume."""
    counts = graph_rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("block_count"), F.sum(F.size("successors")).alias("edge_count"), F.max(F.size("predecessors")).alias("nesting_depth"))
    counts = counts.withColumn("cyclomatic", cyclomatic(F.col("edge_count"), F.col("block_count")))
    both = counts.join(cognitive(blocked, graph_rows), KEY, "left").join(halstead(blocked).select(*KEY, "volume", "difficulty", "effort"), KEY, "left")
    return both.withColumn("maintainability", maintainability(F.col("volume"), F.col("cyclomatic"), F.col("block_count")))


def cognitive_summary(metrics: DataFrame, name: str = "function_addr") -> DataFrame:
    """By artifact: total, average, maximum, the first function that has it (null if it is 0), and functions."""
    s = metrics.groupBy("artifact_id").agg(
        F.sum("cognitive").alias("total"), F.avg("cognitive").alias("average"), F.max("cognitive").alias("most"),
        F.max_by(name, F.struct(F.col("cognitive"), -F.col("function_addr"))).alias("most_complex"), F.count(F.lit(1)).alias("functions"),
    )
    return s.withColumn("most_complex", F.when(F.col("most") > 0, F.col("most_complex")))


def back_edges(successors: Sequence[Sequence[int]]) -> list[tuple[int, int]]:
    """(tail, head) of every edge to a block on the search path, by depth first from each unvisited block in turn."""
    state, out = [0] * len(successors), []
    for root in range(len(successors)):
        if state[root]:
            continue
        state[root], path = 1, [(root, iter(successors[root]))]
        while path:
            node, rest = path[-1]
            for s in rest:
                if not state[s]:
                    state[s] = 1
                    path.append((s, iter(successors[s])))
                    break
                if state[s] == 1:
                    out.append((node, s))
            else:
                state[node] = 2
                path.pop()
    return out


def natural_loop(head: int, tail: int, predecessors: Sequence[Sequence[int]]) -> set[int]:
    """Blocks that reach the tail backwards; with tail and head equal the head's predecessors count too."""
    inside, open_ = {head, tail}, [tail]
    while open_:
        fresh = set(predecessors[open_.pop()]) - inside
        inside |= fresh
        open_.extend(fresh)
    return inside


def dominators(predecessors: Sequence[Sequence[int]], successors: Sequence[Sequence[int]] | None = None, exact: bool = False) -> list[int | None]:
    """Immediate dominators; the entry's is itself, a block that cannot be reached has none.

    By default blocks are compared by number, as if numbers were a reverse post-order; exact
    ranks them by a true one.
    """
    n = len(predecessors)
    rank = list(range(n))
    if exact:
        post, state, path = [], [0] * n, [(0, iter(successors[0]))] if n else []
        if n:
            state[0] = 1
        while path:
            node, rest = path[-1]
            step = next((s for s in rest if not state[s]), None)
            if step is None:
                post.append(node)
                path.pop()
            else:
                state[step] = 1
                path.append((step, iter(successors[step])))
        place = {b: k for k, b in enumerate(reversed(post))}
        rank = [place.get(b, n + b) for b in range(n)]
    dom: list[int | None] = [0] + [None] * (n - 1) if n else []
    order = sorted(range(1, n), key=rank.__getitem__)

    def meet(a: int, b: int) -> int:
        for _ in range(4 * n):  # numbers that are no post-order may never meet
            if a == b:
                break
            if rank[a] > rank[b]:
                if dom[a] is None or dom[a] == a:
                    return b
                a = dom[a]
            else:
                if dom[b] is None or dom[b] == b:
                    return a
                b = dom[b]
        return a

    for _ in range(n + 1):
        changed = False
        for i in order:
            known = [p for p in predecessors[i] if dom[p] is not None]
            if known:
                new = known[0]
                for p in known:
                    new = meet(new, dom[p] if not exact else p)
                if dom[i] != new:
                    dom[i], changed = new, True
        if not changed:
            break
    return dom


LOOP_SCHEMA = "artifact_id string, function_addr long, header int, tail int, body array<int>, exits array<int>, loop_type string, induction_variables array<string>"


def loops(graph_rows: DataFrame, blocked: DataFrame) -> DataFrame:
    """Natural loops: one row for each back edge; arrays are sorted, exits keep repeats.

    Types: While (the header ends in cmp or test), For (in inc, dec, add, sub, loop, loope or
    loopne), else Infinite without exits, DoWhile if the least exit block begins with cmp or test,
    else Natural.
    """
    counted = blocked.where(F.col("mnemonic").isin("inc", "dec", "add", "sub")).withColumn("v", F.trim(F.element_at(F.split("operands", ","), 1))).where("v <> '' and v not like '#%' and v not like '$%'")
    variables = counted.groupBy(*KEY, "block").agg(F.collect_set("v").alias("variables"))
    rows = graph_rows.join(variables, [*KEY, "block"], "left").select(*KEY, "block", "successors", "predecessors", "last_mnemonic", "first_mnemonic", "variables")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        out, into = [list(x) for x in pdf["successors"]], [list(x) for x in pdf["predecessors"]]
        last, first = list(pdf["last_mnemonic"]), list(pdf["first_mnemonic"])
        names = [list(x) if x is not None else [] for x in pdf["variables"]]
        found = []
        for tail, head in back_edges(out):
            inside = natural_loop(head, tail, into)
            exits = sorted(s for b in inside for s in out[b] if s not in inside)
            if last[head] in ("cmp", "test"):
                kind = "While"
            elif last[head] in ("inc", "dec", "add", "sub", "loop", "loope", "loopne"):
                kind = "For"
            elif not exits:
                kind = "Infinite"
            else:
                kind = "DoWhile" if first[exits[0]] in ("cmp", "test") else "Natural"
            body = sorted(inside - {head})
            found.append((pdf["artifact_id"].iloc[0], pdf["function_addr"].iloc[0], head, tail, body, exits, kind, sorted({v for b in body for v in names[b]})))
        return pd.DataFrame(found, columns=[c.split()[0] for c in LOOP_SCHEMA.split(", ")])

    return rows.groupBy(*KEY).applyInPandas(one, LOOP_SCHEMA)


def dominator_tree(graph_rows: DataFrame, exact: bool = False) -> DataFrame:
    """Immediate dominator of every block (see dominators)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        dom = dominators([list(x) for x in pdf["predecessors"]], [list(x) for x in pdf["successors"]], exact)
        return pdf[["artifact_id", "function_addr", "block"]].assign(dominator=pd.array(dom, "Int32"))

    return graph_rows.groupBy(*KEY).applyInPandas(one, "artifact_id string, function_addr long, block int, dominator int")


def loop_summary(loop_rows: DataFrame) -> DataFrame:
    """By artifact: total, natural, irreducible, nested, deepest level, and counts by type."""
    kinds = loop_rows.groupBy("artifact_id", "loop_type").agg(F.count(F.lit(1)).alias("n"))
    return kinds.groupBy("artifact_id").agg(
        F.sum("n").alias("total"), F.sum("n").alias("natural"), F.lit(0).alias("irreducible"), F.lit(0).alias("nested"), F.lit(0).alias("deepest"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("loop_type", "n")))).alias("by_type"),
    )
