"""Continuous ingest of landed listing pages.

Landed page files are read with ``readStream``.  The per-row part (postings,
salary test, keys) is stateless.  Each micro-batch then keeps the first
posting per ``(source, ingest_date, source_id)`` within the batch (A1),
drops ids already in the store partition (A2) and appends (S5) inside
``foreachBatch``.

A batch belongs to an epoch of its stream, and the epochs are recorded in the
stream's checkpoint folder, so that both have one lifetime: ``epochs/<epoch>.open/<stamp>``
is created before the batch writes, ``epochs/<epoch>.done`` after it.  A batch that is run again after its end
is left out as a whole.  One that was cut off keeps its stamp: what it had
appended is found by the store's key sketch (``sources.sketch``) and the rest
follows, so no row is repeated or lost and the epoch's rows bear one
stamp.  Ids meet the sketch first; a batch without an old id reads no column
of the store.

Pages that cannot be read are appended to a quarantine table, each
once.  A page without a fetch time is filed under the first day of 1970, so
that a replay finds it.  Paging stops (L1-L4) need a complete run and stay
batch-only; across micro-batches "first" means first to arrive.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.functions.keys import SOURCE_ID_KEYS_A, SOURCE_ID_KEYS_B, URL_KEYS_A, URL_KEYS_B, with_keys
from offerlake.operators.dedup import first_seen
from offerlake.operators.extract import locate_data_list, locate_postings
from offerlake.plans.ingest import salaried_postings
from offerlake.session import delete_path, scratch_scope
from offerlake.sources.sketch import STAMP, append_sketched, make_mark, names_in, skip_sketched
from offerlake.sources.store import path_exists
from offerlake.sources.tables import LANDED_PAGES, QUARANTINE, RAW_POSTINGS, SECTIONS, SOURCE_A


NO_DATE = dt.date(1970, 1, 1)


def stream_postings(pages: DataFrame, source: str) -> DataFrame:
    """Stateless part: one row per salaried posting with its keys, and one per
    unreadable page, with ``page_error`` and ``body``."""
    pages = pages.where(F.col("source") == source)
    pages = locate_postings(pages) if source == SOURCE_A else locate_data_list(pages)
    pages = pages.withColumn("body", F.when(F.col("page_error").isNotNull(), F.col("body")))
    posts = salaried_postings(pages, source,
                              keep=("source", "run_id", "page", "cursor", "fetched_at", "page_error", "body"))
    posts = posts.where(F.col("salaried") | F.col("page_error").isNotNull())
    keys = (SOURCE_ID_KEYS_A, URL_KEYS_A) if source == SOURCE_A else (SOURCE_ID_KEYS_B, URL_KEYS_B)
    return (with_keys(posts, *keys)
            .withColumn("ingest_date", F.coalesce(F.to_date("fetched_at"), F.lit(NO_DATE)))
            .withColumn("order_key", F.coalesce(F.col("page").cast("bigint"), F.col("cursor")))
            .drop("v"))


def _page_hash() -> Column:
    """One value per unreadable page: where it was landed, and its body."""
    return F.sha2(F.to_json(F.struct("source", "run_id", "page", "cursor", "body")), 256)


def _quarantine(batch: DataFrame, path: str) -> None:
    """Append the batch's unreadable pages that the quarantine table does not hold.

    Only the quarantine of the batch's own runs is read, and joined by a hash of the page."""
    bad = batch.where(F.col("page_error").isNotNull()).select(
        "source", "run_id", "page", "cursor", F.col("page_error").alias("reason"), "body")
    if bad.isEmpty():
        return
    spark = batch.sparkSession
    bad = bad.withColumn("_hash", _page_hash()).dropDuplicates(["_hash"])
    if path_exists(spark, path):
        runs = bad.agg(F.min("source").alias("a"), F.max("source").alias("b"),
                       F.min("run_id").alias("c"), F.max("run_id").alias("d")).first()
        held = spark.read.schema(QUARANTINE).parquet(path).where(
            F.col("source").between(runs["a"], runs["b"]) & F.col("run_id").between(runs["c"], runs["d"]))
        bad = bad.join(held.select(_page_hash().alias("_hash")), "_hash", "left_anti")
    bad.drop("_hash").write.mode("append").partitionBy("source").parquet(path)


class Epochs:
    """The record of a stream's batches: an opened epoch has a stamp, a finished one is done."""

    def __init__(self, spark: SparkSession, checkpoint: str):
        self.spark, self.folder = spark, f"{checkpoint.rstrip('/')}/epochs"

    def done(self, epoch: int) -> bool:
        return path_exists(self.spark, f"{self.folder}/{epoch}.done")

    def open(self, epoch: int) -> dt.datetime:
        """The stamp of an epoch: that of its first try."""
        path = f"{self.folder}/{epoch}.open"
        for name in names_in(self.spark, path):
            return dt.datetime.strptime(name, STAMP)
        stamp = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        make_mark(self.spark, f"{path}/{stamp.strftime(STAMP)}")
        return stamp

    def finish(self, epoch: int) -> None:
        """Mark the epoch; a stream only goes back to its last one, so the one before it is forgotten."""
        make_mark(self.spark, f"{self.folder}/{epoch}.done")
        for old in (f"{epoch}.open", f"{epoch - 2}.done"):
            delete_path(self.spark, f"{self.folder}/{old}")


def write_batch(store_path: str, quarantine_path: str, checkpoint: str | None = None):
    """``foreachBatch`` body: dedup within the batch, skip what the store holds, append; bad pages to quarantine.

    Epochs are recorded in ``checkpoint``, the stream's folder; without one, each call is a new batch."""
    def _write(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        epochs = None if checkpoint is None else Epochs(spark, checkpoint)
        if epochs is not None and epochs.done(epoch_id):
            return
        stamp = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None) if epochs is None else epochs.open(epoch_id)
        with scratch_scope(spark):
            batch = batch.persist()  # read several times below
            _quarantine(batch, quarantine_path)
            good = batch.where(F.col("page_error").isNull())
            new = first_seen(good, keys=("source", "ingest_date", "source_id"),
                             order=("fetched_at", "order_key", "pos"))
            # the span of the batch's dates prunes the sketch, and the store if that is read, to those partitions
            span = good.agg(F.min("ingest_date").alias("a"), F.max("ingest_date").alias("b"),
                            F.min("source").alias("s"), F.max("source").alias("t")).first()
            if span["a"] is not None:
                within = (F.col("ingest_date").between(span["a"], span["b"])
                          & F.col("source").between(span["s"], span["t"]))
                new = skip_sketched(new, store_path, pruned=within, dated=True)
                records = new.select(
                    "source_id", "job_slug", F.lit(stamp.isoformat(sep=" ")).cast("timestamp").alias("ingested_at"),
                    F.col("page").cast("int").alias("page"), "url", F.col("posting").alias("listing"),
                    F.lit(None).cast("string").alias("details"), F.lit(None).cast(SECTIONS).alias("sections"),
                    "run_id", "source", "ingest_date")
                append_sketched(records.select(*[f.name for f in RAW_POSTINGS.fields]), store_path, stamp)
            batch.unpersist()
        if epochs is not None:
            epochs.finish(epoch_id)
    return _write


def start_stream(spark: SparkSession, landed_dir: str, store_path: str, *, source: str,
                 checkpoint: str, quarantine_path: str | None = None, max_files_per_trigger: int | None = None,
                 available_now: bool = False, processing_time: str | None = None):
    """Start the streaming query.  ``checkpoint`` is the folder it goes on from
    at the next start; unreadable pages go to ``quarantine_path`` (default: a
    folder beside the store)."""
    reader = spark.readStream.schema(LANDED_PAGES)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    posts = stream_postings(reader.parquet(landed_dir), source)
    writer = (posts.writeStream.foreachBatch(
        write_batch(store_path, quarantine_path or f"{store_path.rstrip('/')}_quarantine", checkpoint))
              .option("checkpointLocation", checkpoint))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


def run_stream_available_now(spark: SparkSession, landed_dir: str, store_path: str, *, source: str,
                             checkpoint: str, quarantine_path: str | None = None,
                             max_files_per_trigger: int | None = None) -> None:
    """Process every landed file present now, in one or more micro-batches."""
    q = start_stream(spark, landed_dir, store_path, source=source, checkpoint=checkpoint, quarantine_path=quarantine_path,
                     max_files_per_trigger=max_files_per_trigger, available_now=True)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
