"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the frame's columns a and b; label is the least node of its component.

    Every round points a node at the least of itself and its neighbours, follows the pointers to
    their roots by doubling, and replaces the ends of all links by their roots; links inside a root
    go, so that each round has fewer. A node's label is what its roots of all rounds lead to. Nodes
    without links do not appear. Nothing but the question whether rows are left comes to the driver.
    """
    now = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = None
    while True:
        ends = now.select(F.col("a").alias("node"), F.col("a").alias("least")).union(now.select("b", "a")).union(now.select("a", "b"))
        step = cut(ends.groupBy("node").agg(F.min("least").alias("label")).select("node", F.least("node", "label").alias("label")))
        while True:
            ahead = step.select(F.col("node").alias("at"), F.col("label").alias("further"))
            jump = cut(step.join(ahead, step["label"] == ahead["at"]).select("node", F.col("label").alias("was"), F.col("further").alias("label")))
            step, still = jump.select("node", "label"), jump.where("label <> was")
            if still.isEmpty():
                break
        if found is None:
            found = step
        else:
            further = step.select(F.col("node").alias("at"), F.col("label").alias("further"))
            found = cut(found.join(further, found["label"] == further["at"], "left").select("node", F.coalesce("further", "label").alias("label")))
        one, two = step.select(F.col("node").alias("a"), F.col("label").alias("one")), step.select(F.col("node").alias("b"), F.col("label").alias("two"))
        moved = now.join(one, "a").join(two, "b").where("one <> two")
        now = cut(moved.select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b")).distinct())
        if now.isEmpty():
            return found
        # A round writes a file a task many times over, however few its rows.
        del ends, step, ahead, jump, one, two, moved
        release(links.sparkSession)
