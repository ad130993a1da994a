"""Sections and addresses: containment joins, lookups and comparisons of artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def locate(points: DataFrame, sections: DataFrame, point: str) -> DataFrame:
    """Points (artifact_id, the column point) with the first section, by ordinal, whose addresses hold them.

    Sections: artifact_id, ordinal, name, address, size. Points in no section are left out. The
    join is an equi-join on bins: a section lies in at most two bins of the least power of two
    that is no smaller than it, and a point in one bin of each such width that occurs (64 at most).
    Addresses are longs, so those from 2^63 on are negative, and a section that begins before 2^63
    holds nothing from there on. Sizes below 1 (from 2^63 on, too) hold nothing.
    """
    level = F.when(F.col("size") > 1, F.length(F.bin(F.col("size") - 1))).otherwise(0)
    s = sections.where("size > 0").select(F.col("artifact_id").alias("s_id"), "ordinal", F.col("name").alias("section"), "address", F.col("size").alias("section_size"), level.alias("s_level"))
    levels = sorted(r[0] for r in s.select("s_level").distinct().collect())
    shifted = lambda at, by: F.call_function("shiftright", at, by)
    last = F.coalesce(F.try_add("address", F.col("section_size") - 1), F.lit((1 << 63) - 1))
    s = s.withColumn("s_last", last)
    s = s.withColumn("s_bin", F.explode(F.array_distinct(F.array(shifted(F.col("address"), F.col("s_level")), shifted(F.col("s_last"), F.col("s_level"))))))
    p = points.withColumn("p_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("p_bin", shifted(F.col(point), F.col("p_level")))
    held = p.join(s, (F.col("artifact_id") == F.col("s_id")) & (F.col("p_level") == F.col("s_level")) & (F.col("p_bin") == F.col("s_bin")))
    held = held.where((F.col(point) >= F.col("address")) & (F.col(point) <= F.col("s_last")))
    first = Window.partitionBy("artifact_id", point).orderBy("ordinal")
    return held.withColumn("_k", F.rank().over(first)).where("_k = 1").drop("_k", "s_id", "p_level", "p_bin", "s_level", "s_bin", "s_last")


def file_offsets(points: DataFrame, sections: DataFrame, point: str) -> DataFrame:
    """Points with the file offset of their address; null beyond 2^63 - 1."""
    offsets = sections.select(F.col("artifact_id").alias("o_id"), F.col("ordinal").alias("o_ordinal"), F.col("offset").alias("section_offset"))
    held = locate(points, sections, point)
    held = held.join(offsets, (held["artifact_id"] == offsets["o_id"]) & (held["ordinal"] == offsets["o_ordinal"]))
    return held.withColumn("file_offset", F.try_add("section_offset", F.col(point) - F.col("address"))).drop("o_id", "o_ordinal", "section_offset")


def section_named(sections: DataFrame, name: str) -> DataFrame:
    """The first section of that name of every artifact."""
    return sections.where(F.col("name") == name).groupBy("artifact_id").agg(F.min_by(F.struct(*sections.columns), "ordinal").alias("s")).select("s.*")


def executable(sections: DataFrame) -> DataFrame:
    """Executable sections whose bytes are at hand."""
    return sections.where(F.col("perm_execute") & F.col("data").isNotNull())


def function_symbols(symbols: DataFrame) -> DataFrame:
    """Functions as the control-flow view sees them: every function symbol, empty ones and repeats too."""
    return symbols.where(F.col("symbol_type") == "Function")


def call_graph_functions(symbols: DataFrame, entries: DataFrame, entry_size: int = 1000) -> DataFrame:
    """Functions as the call graph sees them: of some size, the first at each address, and the entry point if it is new.

    entries: artifact_id, entry_point.
    """
    sized = symbols.where((F.col("symbol_type") == "Function") & (F.col("size") > 0))
    first = sized.groupBy("artifact_id", "address").agg(F.min_by(F.struct("ordinal", "name", "size"), "ordinal").alias("f"))
    known = first.select("artifact_id", F.col("address").alias("start"), F.col("f.ordinal").alias("ordinal"), F.col("f.name").alias("name"), F.col("f.size").alias("size"))
    entry = entries.where("entry_point is not null").select("artifact_id", F.col("entry_point").alias("start"))
    fresh = entry.join(known, ["artifact_id", "start"], "left_anti").select("artifact_id", "start", F.lit(-1).alias("ordinal"), F.lit("_start").alias("name"), F.lit(entry_size).alias("size"))
    return known.unionByName(fresh)


def imports_by_library(imports: DataFrame) -> DataFrame:
    return imports.groupBy("artifact_id", "library").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("name")).alias("names"))


def diff(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer comparison: keys, status (added, removed, changed, same) and both sides' values."""
    a = left.select(*keys, F.struct(*values).alias("old"))
    b = right.select(*keys, F.struct(*values).alias("new"))
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "same").otherwise("changed")
    return a.join(b, keys, "full").select(*keys, status.alias("status"), "old", "new")
