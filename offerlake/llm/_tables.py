"""Connected components over written edge tables; written tables whose rows have a place."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlake.session import saved, scratch_path, scratch_scope

__all__ = ["Landed", "components", "numbered_columns", "saved"]


class Landed(NamedTuple):
    """A written table: its columns are c0, c1, ... in the order of ``names``; file and row name each of its rows."""

    path: str
    table: DataFrame
    names: list[str]

    def placed(self) -> DataFrame:
        """The columns c0, c1, ... with ``file`` and ``row``."""
        return self.table.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))

    def without(self, gone: DataFrame) -> DataFrame:
        """The rows that are not in ``gone`` (file, row), under the names of the input."""
        stay = self.placed().join(gone.select("file", "row"), ["file", "row"], "left_anti")
        return stay.select(*self.table.columns).toDF(*self.names)


def numbered_columns(df: DataFrame, name: str) -> Landed:
    """``df`` written to the shared folder under column names that clash with nothing."""
    path = scratch_path(df.sparkSession, name)
    renamed = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    renamed.write.parquet(path)
    return Landed(path, df.sparkSession.read.schema(renamed.schema).parquet(path), df.columns)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); root is its component's smallest node.

    Alternating large-star and small-star steps on the edge list, until it no
    longer changes: every step is a partial aggregate and a join on a node.
    """
    with scratch_scope(edges.sparkSession):
        now = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .filter("a <> b").distinct(), name)
        mark = _mark(now)
        while mark[0]:
            both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
                now.select(F.col("b").alias("u"), F.col("a").alias("v")))
            least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
            large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
            large = saved(large, name)
            least = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
            now = saved(small.union(least.select("a", F.col("m").alias("b"))).distinct(), name)
            before, mark = mark, _mark(now)
            if mark == before:
                break
        nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
        return saved(nodes, name, keep=True)


def _mark(edges: DataFrame) -> tuple:
    got = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return got[0], got[1]
