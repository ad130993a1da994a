"""JSON and DOT texts of parsed artifacts and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.binary import address
from .callgraph import kept_nodes

#: Fill colours by node type and styles by call type.
COLOURS = {"EntryPoint": "lightgreen", "Library": "lightblue", "External": "lightyellow", "Internal": "lightgray", "Indirect": "orange", "Virtual": "purple", "Unknown": "pink"}
STYLES = {"Direct": "", "Indirect": "style=dashed", "TailCall": "color=red", "Virtual": "color=purple", "Recursive": "color=green, style=bold", "Conditional": "color=orange"}


def to_json(df: DataFrame, key: str = "artifact_id") -> DataFrame:
    """key and json, an object of all columns; nulls are left out."""
    return df.select(key, F.to_json(F.struct(*df.columns)).alias("json"))


def from_json(texts: DataFrame, schema: str, key: str = "artifact_id") -> DataFrame:
    """The columns of to_json's text; a text that is no JSON gives nulls."""
    return texts.select(F.from_json("json", schema).alias("j")).select("j.*")


def _lines(rows: DataFrame, order: list[str], text: str, name: str) -> DataFrame:
    """By artifact the texts in order, one a line."""
    return rows.groupBy("artifact_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text))), lambda x: x[text]), "\n").alias(name))


def cfg_dot(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """artifact_id, function_addr and dot: blocks by their start address, edges by number."""
    key = ["artifact_id", "function_addr"]
    nodes = blocks.select(*key, F.lit(0).alias("part"), F.col("block").alias("a"), F.lit(0).alias("b"), F.concat(F.lit("  bb"), "block", F.lit(' [label="'), address("start"), F.lit('"];')).alias("line"))
    arrows = edges.select(*key, F.lit(1).alias("part"), F.col("src").alias("a"), F.col("ord").alias("b"), F.concat(F.lit("  bb"), "src", F.lit(" -> bb"), "dst", F.lit(";")).alias("line"))
    body = nodes.unionByName(arrows).groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "a", "b", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return body.select(*key, F.concat(F.lit("digraph CFG {\n"), "body", F.lit("\n}\n")).alias("dot"))


def call_graph_dot(nodes: DataFrame, edges: DataFrame, most: int = 1000, counts: bool = False, addresses: bool = True, colours: bool = True) -> DataFrame:
    """artifact_id and dot: the first nodes by address, coloured by type (all alike without colours), and the edges between them, styled by call type.

    nodes: artifact_id, address, name, node_type. edges: artifact_id, caller, callee, call_type.
    Attribute lists are always closed.
    """
    colour, style = F.lit("lightgray"), F.lit("")
    for k, v in COLOURS.items() if colours else ():
        colour = F.when(F.col("node_type") == k, v).otherwise(colour)
    for k, v in STYLES.items():
        style = F.when(F.col("call_type") == k, v).otherwise(style)
    kept = kept_nodes(nodes, most)
    label = F.concat("name", F.lit("\\n"), address("address")) if addresses else F.col("name")
    node_lines = kept.withColumn("line", F.concat(F.lit('  "'), address("address"), F.lit('" [label="'), label, F.lit('", fillcolor="'), colour, F.lit('"];')))
    known = kept.select("artifact_id", "address")
    inside = edges.join(known.withColumnRenamed("address", "caller"), ["artifact_id", "caller"], "left_semi").join(known.withColumnRenamed("address", "callee"), ["artifact_id", "callee"], "left_semi")
    merged = inside.groupBy("artifact_id", "caller", "callee", "call_type").agg(F.count(F.lit(1)).alias("n")) if counts else inside
    marks = F.array_join(F.filter(F.array(F.concat(F.lit('label="'), "n", F.lit('"')) if counts else F.lit(""), style), lambda x: x != ""), ", ")
    edge_lines = merged.withColumn("line", F.concat(F.lit('  "'), address("caller"), F.lit('" -> "'), address("callee"), F.lit('"'), F.when(marks != "", F.concat(F.lit(" ["), marks, F.lit("]"))).otherwise(""), F.lit(";")))
    both = _lines(node_lines, ["address"], "line", "nodes").join(_lines(edge_lines, ["caller", "callee", "call_type"], "line", "edges"), "artifact_id", "left")
    head = "digraph CallGraph {\n  rankdir=TB;\n  node [shape=box, style=filled];\n  edge [arrowhead=normal];\n\n"
    return both.select("artifact_id", F.concat(F.lit(head), "nodes", F.lit("\n\n"), F.coalesce(F.concat("edges", F.lit("\n")), F.lit("")), F.lit("}\n")).alias("dot"))


def call_graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """artifact_id and json, an object of nodes and edges in order."""
    n = nodes.groupBy("artifact_id").agg(F.array_sort(F.collect_list(F.struct("address", *[c for c in nodes.columns if c not in ("artifact_id", "address")]))).alias("nodes"))
    e = edges.groupBy("artifact_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in edges.columns if c != "artifact_id"]))).alias("edges"))
    return n.join(e, "artifact_id", "left").select("artifact_id", F.to_json(F.struct("nodes", "edges")).alias("json"))
