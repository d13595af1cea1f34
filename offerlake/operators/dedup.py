"""First-seen dedup (A1), skip-existing anti-join (A2), run counts (A3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_seen(df: DataFrame, keys: Sequence[str] = ("source", "source_id"),
               order: Sequence[str] = ("page", "pos")) -> DataFrame:
    """A1: keep the first row per key in ``order``.

    ``row_number() = 1`` lets Spark put a partial group limit before the
    shuffle, so a hot key leaves each map task as one row; the shuffle is
    on the key, which the store anti-join (A2) then reuses.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def skip_existing(df: DataFrame, stored: DataFrame | None,
                  keys: Sequence[str] = ("source", "source_id")) -> DataFrame:
    """A2: drop rows whose key is already stored.

    ``stored`` should be the pruned store partition projected to ``keys``.
    No broadcast hint: the stored set grows with the store, so the join
    strategy is left to adaptive execution, which broadcasts it only when
    its measured size is under the threshold.
    """
    if stored is None:
        return df
    return df.join(stored.select(*keys), list(keys), "left_anti")


def count_written(df: DataFrame, by: Sequence[str] = ("source", "ingest_date")) -> DataFrame:
    """A3: records per source and date (partial aggregation before the shuffle)."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("written"))
