"""Exact dedup by stateful streaming, in DataFrame operations only.

A Structured Streaming aggregation keeps, without expiry and in the RocksDB
state store (on disk, with its snapshots in the checkpoint folder), one entry
per content digest: the stable identifier of the first document, its content
locator (file and row) and the number of documents.  Files that arrive later
are added to the same state by the next start with the same checkpoint.

The state is then read as a table.  Every document is joined with its entry;
on a hit the full text is compared with the text at the entry's locator.
Documents whose bytes differ from it (a digest collision) are grouped by their
full text instead.

Texts are equal when identical after replacing each `[\\x20\\x09-\\x0D]+` by one
space.  Of equal texts the smallest doc_id stays; of several rows with that
doc_id, the first by file and row.

Defined cases: null counts as the empty text; null doc_ids come after all
others; repeated rows are members of their group; an empty table gives an
empty one.  Copies of one text may be a third of all rows: the aggregate is
partial before its shuffle, large partitions of the join with the state can be
split, and comparisons are salted by the size of the group.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlake.llm._tables import numbered_columns
from offerlake.session import materialize, saved, scratch_path

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Members of one group that are compared with one copy of its first text.
SALT_ROWS = 1024


def normalised(text: Column) -> Column:
    """The text with each run of white space replaced by one space; null is empty."""
    # only runs that change are matched: those with another character than a space, or two at least
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@contextmanager
def _rocksdb(spark: SparkSession, memory_mb: int | None = None):
    """The state store on disk; ``memory_mb`` bounds the memory of all its instances in an executor.

    A store is closed when its task ends: only as many as there are running
    tasks hold files open, however many partitions the state has."""
    prefix = "spark.sql.streaming.stateStore"
    conf = {f"{prefix}.providerClass": PROVIDER, f"{prefix}.unloadOnCommit": "true"}
    if memory_mb is not None:
        conf |= {f"{prefix}.rocksdb.boundedMemoryUsage": "true", f"{prefix}.rocksdb.maxMemoryUsageMB": str(memory_mb),
                 f"{prefix}.rocksdb.writeBufferSizeMB": "2", f"{prefix}.rocksdb.blockCacheSizeMB": "2"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _keyed(df: DataFrame, text: str, doc_id: str, digest) -> DataFrame:
    norm = normalised(F.col(text))
    return df.select(F.col(doc_id).alias("id"), F.col("_metadata.file_path").alias("file"),
                     F.col("_metadata.row_index").alias("row"), norm.alias("norm")) \
             .withColumn("digest", digest(F.col("norm")))


def update_state(spark: SparkSession, path: str, checkpoint: str, *, text: str = "text", doc_id: str = "doc_id",
                 schema: T.StructType | None = None, digest=sha256, memory_mb: int | None = None) -> DataFrame:
    """Add the files under ``path`` that the state in ``checkpoint`` has not seen; the state as a table.

    One row per digest: digest, first (absent, id, file, row), n.
    """
    schema = schema or spark.read.parquet(path).schema
    source = f"{path[:-1]}[{path[-1]}]"  # as a pattern it may name a file or a folder
    stream = _keyed(spark.readStream.schema(schema).parquet(source), text, doc_id, digest)
    state = stream.groupBy("digest").agg(
        F.min(F.struct(F.col("id").isNull().alias("absent"), "id", "file", "row")).alias("first"),
        F.count(F.lit(1)).alias("n"))
    with _rocksdb(spark, memory_mb):
        query = (state.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True).start())
        query.awaitTermination()
    return read_state(spark, checkpoint, memory_mb)


def read_state(spark: SparkSession, checkpoint: str, memory_mb: int | None = None) -> DataFrame:
    """The state as a table; with ``memory_mb`` it is written, so that the stores are opened under that bound."""
    with _rocksdb(spark, memory_mb):
        stored = spark.read.format("statestore").load(checkpoint)
        key = stored.schema["key"].dataType.names[0]
        first, n = stored.schema["value"].dataType.names[-2:]
        state = stored.select(F.col("key").getField(key).alias("digest"), F.col("value").getField(first).alias("first"),
                              F.col("value").getField(n).alias("n"))
        return state if memory_mb is None else saved(state, "dedup-state-table")


def dedup_files(spark: SparkSession, path: str, *, text: str = "text", doc_id: str = "doc_id",
                checkpoint: str | None = None, digest=sha256, memory_mb: int | None = None) -> DataFrame:
    """One row per row of the files under ``path``: its place in its group of equal texts.

    Columns: id, file, row, keep_id, group_size, kept, text_sha256.  ``digest``
    maps the normalised text to the state's key; the result does not depend on it.
    """
    schema = spark.read.parquet(path).schema
    state = update_state(spark, path, checkpoint or scratch_path(spark, "dedup-state"), text=text, doc_id=doc_id,
                         schema=schema, digest=digest, memory_mb=memory_mb)
    docs = _keyed(spark.read.schema(schema).parquet(path), text, doc_id, digest)
    is_first = (F.col("file") == F.col("first.file")) & (F.col("row") == F.col("first.row"))
    located = docs.join(state, "digest").select(
        "id", "file", "row", "digest", "first", "n", is_first.alias("is_first"),
        F.sha2("norm", 256).alias("text_sha256"), F.when(F.col("n") > 1, F.col("norm")).alias("norm"))
    # read by several branches: the text shuffle above runs once
    located = saved(located, "dedup-located")

    salts = F.ceil(F.col("n") / SALT_ROWS).cast("int")
    hits = located.filter("n > 1")
    firsts = hits.filter("is_first").select(
        F.col("digest").alias("d"), F.col("norm").alias("first_norm"),
        F.explode(F.sequence(F.lit(0), salts - 1)).alias("s"))
    members = hits.filter("NOT is_first").withColumn("salt", F.pmod(F.xxhash64("file", "row"), salts).cast("int"))
    compared = members.join(firsts, (F.col("digest") == F.col("d")) & (F.col("salt") == F.col("s")))
    other = compared.filter(F.col("norm") != F.col("first_norm")).select("id", "file", "row", "digest", "norm")
    collided = materialize(other)
    if collided.isEmpty():
        return located.select("id", "file", "row", F.col("first.id").alias("keep_id"), F.col("n").alias("group_size"),
                              F.col("is_first").alias("kept"), "text_sha256")
    return _split_collisions(located, collided)


def _split_collisions(located: DataFrame, collided: DataFrame) -> DataFrame:
    """The result where some documents share a digest with a different first text."""
    by_text = collided.groupBy("digest", "norm").agg(
        F.min(F.struct(F.col("id").isNull().alias("absent"), "id", "file", "row")).alias("own_first"),
        F.count(F.lit(1)).alias("own_n"))
    apart = collided.join(by_text, ["digest", "norm"]).select("file", "row", "own_first", "own_n")
    less = collided.groupBy("digest").agg(F.count(F.lit(1)).alias("less"))
    mine = F.coalesce(F.col("own_first"), F.col("first"))
    return (located.join(apart, ["file", "row"], "left").join(less, "digest", "left").select(
        "id", "file", "row", mine["id"].alias("keep_id"),
        F.coalesce("own_n", F.col("n") - F.coalesce("less", F.lit(0))).alias("group_size"),
        ((F.col("file") == mine["file"]) & (F.col("row") == mine["row"])).alias("kept"), "text_sha256"))


def drop_copies(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", memory_mb: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay; columns unchanged.

    The rows are first written to the shared folder, so that file and row name
    each of them for good; there their columns have names of their own, so any
    name may be in the input.
    """
    landed = numbered_columns(docs, "dedup-docs")
    own = dict(zip(docs.columns, landed.table.columns))
    gone = dedup_files(docs.sparkSession, landed.path, text=own[text], doc_id=own[doc_id], memory_mb=memory_mb).filter("NOT kept")
    return landed.without(gone)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op9: per document, the document that stays for its text."""
    found = dedup_files(spark, f"{sf_dir}/documents.parquet")
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"
ORACLE = rf"""
WITH d AS (SELECT doc_id, {_NORM} AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM d
"""
