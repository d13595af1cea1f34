"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlake.session import saved, scratch_scope


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of ``links`` (a, b), of any orderable type; root is its component's smallest node.

    Every node points at the smallest node it knows of.  A round hands the
    smaller of the two ends' targets over each link, and to both targets, then
    halves the pointers' paths; rounds end when no pointer moves.  A round is
    aggregates with partial sums and joins whose large side adaptive execution can
    split, so a node with very many links is no task of its own."""
    with scratch_scope(links.sparkSession):
        edges = saved(links.select("a", "b").filter("a <> b").distinct(), "component-links")
        ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
        now = saved(ends.select("node", F.col("node").alias("root")), "component-roots")
        while True:
            at = now.select(F.col("node").alias("a"), F.col("root").alias("ra"))
            seen = edges.join(at, "a").join(now.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
            low = F.least("ra", "rb").alias("low")
            told = seen.filter("ra <> rb").select(F.explode(F.array("a", "b", "ra", "rb")).alias("node"), low)
            lowest = told.groupBy("node").agg(F.min("low").alias("low"))
            moved = saved(now.join(lowest, "node", "left").select("node", F.least("root", F.coalesce("low", "root")).alias("root"),
                                                                  F.col("low").isNotNull().alias("open")), "component-moved")
            if not moved.filter("open").limit(1).count():
                return saved(moved.select("node", "root"), "components", keep=True)
            above = moved.select(F.col("node").alias("root"), F.col("root").alias("upper"))
            now = saved(moved.select("node", "root").join(above, "root").select("node", F.col("upper").alias("root")), "component-roots")
