"""Statistics over instruction frames: artifact_id, function_addr, idx, address, mnemonic, operands, flow_kind, flow_target, size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.instructions import category, with_flow


def classified(instructions: DataFrame) -> DataFrame:
    """With category, flow_kind and flow_target from mnemonic and operands."""
    return with_flow(instructions).withColumn("category", category("mnemonic"))


def shares(instructions: DataFrame, column: str) -> DataFrame:
    """Values of the column with n and percent of all rows."""
    counts = instructions.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select(column, "n", (F.col("n") * 100.0 / F.col("total")).alias("percent"))  # one row


def most_frequent(instructions: DataFrame, column: str, k: int) -> DataFrame:
    """The k commonest values; ties go by value."""
    return instructions.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(k)


def totals(instructions: DataFrame) -> DataFrame:
    """One row: instructions, average size, jumps and calls."""
    kind = F.col("flow_kind")
    return instructions.agg(
        F.count(F.lit(1)).alias("n"), F.avg("size").alias("avg_size"),
        F.count_if(kind.isin("Jump", "ConditionalJump")).alias("jumps"), F.count_if(kind == "Call").alias("calls"),
    )


def capped(instructions: DataFrame, most: int = 10_000) -> DataFrame:
    """The first instructions of every function, at most so many."""
    order = Window.partitionBy("artifact_id", "function_addr").orderBy("idx")
    return instructions.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")
