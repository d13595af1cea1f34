"""The raw store (S5, S6): Parquet partitioned by ``source`` and ``ingest_date``.

A record is written once per ``(source, ingest_date, source_id)``: every
writer anti-joins against the target partition first (A2), and a Spark
write job commits all of its files or none, so a retried or replayed job
does not duplicate records.  One writer per partition at a time.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.sources.tables import RAW_POSTINGS

PARTITION_COLS = ("source", "ingest_date")


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def read_store(spark: SparkSession, path: str, source: str | None = None,
               ingest_date: dt.date | None = None) -> DataFrame:
    """The store, pruned to one source and/or date (partition filters)."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], RAW_POSTINGS)
    df = spark.read.schema(RAW_POSTINGS).parquet(path)
    if source is not None:
        df = df.where(F.col("source") == source)
    if ingest_date is not None:
        df = df.where(F.col("ingest_date") == F.lit(ingest_date))
    return df


def stored_ids(spark: SparkSession, path: str | None, source: str, ingest_date: dt.date | None,
               scope: str = "date") -> DataFrame | None:
    """Keys already stored: the ``(source, ingest_date)`` partition by default,
    every date of the source with ``scope='all_dates'``."""
    if path is None:
        return None
    if scope not in ("date", "all_dates"):
        raise ValueError(f"unknown scope {scope!r}")
    df = read_store(spark, path, source, ingest_date if scope == "date" else None)
    return df.select("source", "source_id")


def append_records(records: DataFrame, path: str) -> None:
    """Append records (already anti-joined) into their partitions."""
    cols = [f.name for f in RAW_POSTINGS.fields]
    (records.select(*cols)
     .write.mode("append")
     .partitionBy(*PARTITION_COLS)
     .parquet(path))
