"""Key sketches of the raw store (A2, T1): which ids a store may hold, at two bytes an id.

Beside a store lies ``<store>_sketch``: per write, source and date a blocked
Bloom filter of the written ids.  An id's hash names one block of 32,768 bits,
``PROBES`` other pieces of it name bits in there; a write of n ids to a
partition has the power of two of blocks that gives each id ``BITS_PER_KEY``
bits.  ``skip_sketched`` probes the sketch first: ids without a hit are new for
certain, the others meet the store's id column, so the result is exact.

A write is recorded around the store's own commit, by its stamp (the one
value of ``ingested_at`` of its rows):

1. ``open/<stamp>`` is created;
2. the records are appended;
3. the sketch of the rows that carry the stamp is appended;
4. ``open/<stamp>`` goes.

A writer that dies in between leaves its stamp open; whoever uses the sketch
next does steps 3 and 4 for it (bits are or-ed, doing it twice changes
nothing).  One writer per store at a time, as in ``sources.store``.

Defined cases: a store that was first written without a sketch has none, and
its id column is read as a whole, until ``build_sketch``; an empty or absent
store holds nothing; a NULL id is never stored and never skipped.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlake.operators.dedup import skip_existing
from offerlake.session import delete_path, saved
from offerlake.sources.store import append_records, path_exists, read_store

BLOCK_BITS = 32768  # of Spark's bitmap functions
BITS_PER_KEY = 16
PROBES = 4

SKETCH = T.StructType([
    T.StructField("blocks", T.IntegerType()),
    T.StructField("block", T.IntegerType()),
    T.StructField("bits", T.BinaryType()),
    T.StructField("source", T.StringType()),        # partition column
    T.StructField("ingest_date", T.DateType()),     # partition column
])
STAMP = "%Y-%m-%dT%H-%M-%S.%f"


def sketch_path(store: str) -> str:
    return f"{store.rstrip('/')}_sketch"


def _block(key: str, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("block")), blocks).cast("int")


def _places(key: str) -> Column:
    """The places of a key's bits in its block."""
    h = F.xxhash64(key)
    return F.array(*[F.shiftrightunsigned(h, 15 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)) for i in range(PROBES)])


def _is_set(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (place % 8).cast("int")) == 1


def key_sketch(keys: DataFrame) -> DataFrame:
    """The blocks of bits of (source, ingest_date, source_id) rows, per source and date."""
    part = ["source", "ingest_date"]
    need = F.greatest(F.ceil(F.count(F.lit(1)) * BITS_PER_KEY / BLOCK_BITS), F.lit(1))
    sizes = keys.groupBy(*part).agg(F.pow(F.lit(2), F.ceil(F.log2(need))).cast("int").alias("blocks"))
    placed = keys.join(sizes, part).select(*part, "blocks", _block("source_id", F.col("blocks")).alias("block"),
                                           F.explode(_places("source_id")).alias("place"))
    found = placed.groupBy(*part, "blocks", "block").agg(F.bitmap_construct_agg("place").alias("bits"))
    return found.select(*SKETCH.fieldNames())


def _append_sketch(keys: DataFrame, store: str) -> None:
    key_sketch(keys).write.mode("append").partitionBy("source", "ingest_date").parquet(f"{sketch_path(store)}/bits")


def _file(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def make_mark(spark: SparkSession, path: str) -> None:
    p, fs = _file(spark, path)
    fs.create(p, True).close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    p, fs = _file(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def _stamped(spark: SparkSession, store: str, stamp: str) -> DataFrame:
    """The keys of the rows that one write left in the store (its stamp is pushed to the scan)."""
    at = dt.datetime.strptime(stamp, STAMP).isoformat(sep=" ")
    rows = read_store(spark, store).where(F.col("ingested_at") == F.lit(at).cast("timestamp"))
    return rows.select("source", "ingest_date", "source_id")


def _close(spark: SparkSession, store: str, stamp: str) -> None:
    _append_sketch(_stamped(spark, store, stamp), store)
    delete_path(spark, f"{sketch_path(store)}/open/{stamp}")


def settle(spark: SparkSession, store: str) -> None:
    """Finish the sketches of writes that were cut off."""
    for stamp in names_in(spark, f"{sketch_path(store)}/open"):
        _close(spark, store, stamp)


def has_sketch(spark: SparkSession, store: str) -> bool:
    return path_exists(spark, f"{sketch_path(store)}/covers")


def build_sketch(spark: SparkSession, store: str) -> None:
    """Sketch a store that was written without one."""
    if not has_sketch(spark, store):
        _append_sketch(read_store(spark, store).select("source", "ingest_date", "source_id"), store)
        make_mark(spark, f"{sketch_path(store)}/covers")


def append_sketched(records: DataFrame, store: str, stamp: dt.datetime) -> None:
    """S5 with the sketch: append records, already anti-joined, all of ``ingested_at`` = ``stamp``."""
    spark = records.sparkSession
    if not path_exists(spark, store) and not has_sketch(spark, store):
        make_mark(spark, f"{sketch_path(store)}/covers")  # a new store: every write is sketched
    if not has_sketch(spark, store):
        append_records(records, store)
        return
    name = stamp.strftime(STAMP)
    make_mark(spark, f"{sketch_path(store)}/open/{name}")
    append_records(records, store)
    _close(spark, store, name)


def possible_keys(keys: DataFrame, store: str, *, pruned: Column | None = None, dated: bool = False) -> DataFrame:
    """The rows of ``keys`` (source, source_id; with ``dated`` ingest_date) whose id the store may hold.

    ``pruned``: a condition on source and ingest_date that prunes the sketch."""
    spark, part = keys.sparkSession, ["source", "ingest_date"] if dated else ["source"]
    folder = f"{sketch_path(store)}/bits"
    if not path_exists(spark, folder):
        return keys.where(F.lit(False))
    bits = spark.read.schema(SKETCH).parquet(folder)
    bits = bits if pruned is None else bits.where(pruned)
    # powers of two: thirty values at most
    sizes = [r["blocks"] for r in bits.select("blocks").distinct().collect()]
    if not sizes:
        return keys.where(F.lit(False))
    merged = bits.groupBy(*part, "blocks", "block").agg(F.bitmap_or_agg("bits").alias("bits"))
    asked = (keys.select(*part, "source_id", F.explode(F.array(*[F.lit(b) for b in sizes])).alias("blocks"))
             .withColumn("block", _block("source_id", F.col("blocks"))))
    hit = F.forall(_places("source_id"), lambda place: _is_set(F.col("bits"), place))
    return asked.join(merged, [*part, "blocks", "block"]).where(hit).select(*part, "source_id").distinct()


def skip_sketched(df: DataFrame, store: str, *, source: str | None = None, pruned: Column | None = None,
                  dated: bool = False) -> DataFrame:
    """A2 by the sketch: ``df`` without the rows whose key is stored.

    The key is (source, source_id), with ``dated`` (source, ingest_date,
    source_id).  ``df`` is read twice, so it should be a written or cached
    table.  The store is not read at all if no key of ``df`` has a hit."""
    spark = df.sparkSession
    keys = ["source", "ingest_date", "source_id"] if dated else ["source", "source_id"]
    if source is not None:
        own = F.col("source") == source
        pruned = own if pruned is None else pruned & own
    stored = read_store(spark, store)
    stored = (stored if pruned is None else stored.where(pruned)).select(*keys)
    if not has_sketch(spark, store):
        return skip_existing(df, stored, keys=keys)
    settle(spark, store)
    maybe = saved(possible_keys(df.select(*keys), store, pruned=pruned, dated=dated), "possible-keys")
    if maybe.isEmpty():
        return df
    known = stored.join(maybe, keys, "left_semi")
    return skip_existing(df, known, keys=keys)
