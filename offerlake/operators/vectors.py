"""D4b, vector search: the ``k`` rows of the largest cosine for every query vector.

Scores are whole millionths (BIGINT); ties go to the smaller id.  Rows without
an id or a vector, and zero vectors, have no cosine and are in no result.

* ``search_vectors`` is exact: packed blocks of queries meet packed blocks of
  rows in a join on block numbers.  Each pair of blocks is one matrix product that
  keeps its own best ``k`` per query; a partial limit runs before the merge.
* ``VectorIndex`` is an inverted file: centroids fitted on a bounded sample, every
  row in the list of its nearest centroid, a query compared with the rows of its
  nearest lists.  How many is measured on the sample: as many as hold RECALL of the best rows.

Neither queries nor rows pass through the driver; it sees the sample and the
centroids, both of a stated size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlake.operators.corpus import MICRO, top_k
from offerlake.session import saved

#: Rows and queries of a packed block.
ROW_BLOCK, QUERY_BLOCK = 8192, 1024
#: Vectors that the index is fitted on at most (by hash of their id), and lists at most.
SAMPLE_ROWS, MAX_LISTS = 20_000, 4096
#: The recall that the number of probes is chosen for, on at most so many vectors of the sample as queries.
RECALL, TRIAL_QUERIES = 0.95, 500

PACKED = "list long, ids binary, vectors binary"


def _unit_rows(vectors: pa.Array) -> np.ndarray:
    """The vectors at length 1; NaN for those of length 0."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(vectors), -1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / np.sqrt((m * m).sum(1, keepdims=True))


def _pack(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of at most ``size`` neighbouring rows (list, id, v) of one list, ids ascending in a block."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            lists, ids, m = batch.column("list").to_numpy(), batch.column("id").to_numpy(), _unit_rows(batch.column("v"))
            some = np.flatnonzero(~np.isnan(m).any(1)) if len(m) else np.zeros(0, int)
            some = some[np.lexsort((ids[some], lists[some]))]
            cut = np.flatnonzero(np.diff(lists[some], prepend=lists[some][:1]))
            out: list[tuple] = []
            for own in np.split(some, cut):
                for lo in range(0, len(own), size):
                    at = own[lo:lo + size]
                    out.append((int(lists[at[0]]), ids[at].astype("<i8").tobytes(), m[at].astype("<f8").tobytes()))
            a, b, c = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.binary()), pa.array(c, pa.binary())],
                                             names=["list", "ids", "vectors"])

    return rows.mapInArrow(run, PACKED)


def _best(k: int):
    """The best ``k`` rows per query of each pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, queries = (np.frombuffer(batch.column(c)[i].as_buffer(), "<i8") for c in ("ids", "query_ids"))
                rows, asked = (np.frombuffer(batch.column(c)[i].as_buffer(), "<f8").reshape(n, -1)
                               for c, n in (("vectors", len(ids)), ("query_vectors", len(queries))))
                score = np.rint(asked @ rows.T * MICRO).astype(np.int64)
                # one number a row: the score, then the place, earlier places (smaller ids) first
                order = score * len(ids) + np.arange(len(ids) - 1, -1, -1)
                n = min(k, len(ids))
                top = np.argpartition(-order, n - 1, axis=1)[:, :n]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(queries, n)), pa.array(ids[top.ravel()]), pa.array(np.take_along_axis(score, top, 1).ravel())],
                    names=["query_id", "doc_id", "score"])

    return run


FOUND = "query_id long, doc_id long, score long"


def _named(table: DataFrame, item_id: str, vector: str) -> DataFrame:
    rows = table.where(F.col(item_id).isNotNull() & F.col(vector).isNotNull())
    return rows.select(F.lit(0).cast("long").alias("list"), F.col(item_id).cast("long").alias("id"), F.col(vector).alias("v"))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return top_k(found, "query_id", "doc_id", k).select("query_id", "rank", "doc_id", "score")


def search_vectors(vectors: DataFrame, queries: DataFrame, k: int = 10, item_id: str = "doc_id", vector: str = "vec") -> DataFrame:
    """D4b, exact: ``(query_id, rank, doc_id, score)``."""
    asked = saved(_pack(_named(queries, item_id, vector), QUERY_BLOCK).withColumn("q", F.monotonically_increasing_id()), "query-blocks")
    rows = _pack(_named(vectors, item_id, vector), ROW_BLOCK)
    # a query block meets every row block; its rows are dealt out by a salt, so few query blocks still use all tasks
    numbers = asked.select("q")
    blocks = max(1, numbers.count())
    salts = max(1, -(-2 * int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")) // blocks))
    ranked = asked.select("q", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("s"), F.col("ids").alias("query_ids"),
                          F.col("vectors").alias("query_vectors"))
    met = rows.select("ids", "vectors", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int").alias("s"))
    pairs = met.join(ranked, "s")
    return _ranked(pairs.select("ids", "vectors", "query_ids", "query_vectors").mapInArrow(_best(k), FOUND), k)


class VectorIndex:
    """An inverted file over the rows of ``vectors``: every row is in one list."""

    def __init__(self, vectors: DataFrame, *, item_id: str = "doc_id", vector: str = "vec", lists: int | None = None, rounds: int = 12):
        rows = _named(vectors, item_id, vector)
        sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("v").toArrow()  # SAMPLE_ROWS vectors at most
        own = _unit_rows(sample.column("v").combine_chunks()) if sample.num_rows else np.zeros((0, 1))
        own = own[~np.isnan(own).any(1)]
        self.centroids = fit_centroids(own, lists or min(MAX_LISTS, max(1, int(len(own) ** 0.5))), rounds)
        self.probes = enough_probes(own, self.centroids)
        self._item_id, self._vector = item_id, vector
        listed = self._nearest(rows, 1).repartitionByRange("list", "id").sortWithinPartitions("list", "id")
        self.blocks = saved(_pack(listed, ROW_BLOCK), "vector-lists")

    def _nearest(self, rows: DataFrame, probes: int) -> DataFrame:
        """``rows`` (list, id, v) once for each of their ``probes`` nearest lists."""
        sent = rows.sparkSession.sparkContext.broadcast(self.centroids)  # MAX_LISTS vectors at most

        def run(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                m = _unit_rows(batch.column("v")) if batch.num_rows else np.zeros((0, 1))
                some = np.flatnonzero(~np.isnan(m).any(1)) if len(sent.value) else np.zeros(0, int)
                if len(some):
                    near = np.argsort(-(m[some] @ sent.value.T), axis=1, kind="stable")[:, :probes]
                    at = pa.array(np.repeat(some, near.shape[1]))
                    yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int64)), batch.column("id").take(at), batch.column("v").take(at)],
                                                     names=["list", "id", "v"])

        kind = rows.schema["v"].dataType.simpleString()
        return rows.mapInArrow(run, f"list long, id long, v {kind}")

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
        """``(query_id, rank, doc_id, score)``: the best ``k`` among the rows of the ``probes`` nearest lists."""
        asked = self._nearest(_named(queries, self._item_id, self._vector), probes or self.probes)
        asked = _pack(asked.repartitionByRange("list", "id").sortWithinPartitions("list", "id"), QUERY_BLOCK)
        pairs = self.blocks.join(asked.select("list", F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors")), "list")
        return _ranked(pairs.drop("list").mapInArrow(_best(k), FOUND), k)


def fit_centroids(sample: np.ndarray, lists: int, rounds: int) -> np.ndarray:
    """Spherical k-means; an empty list keeps its centroid."""
    if not len(sample):
        return sample
    rng = np.random.default_rng(0)
    centroids = sample[np.sort(rng.choice(len(sample), min(lists, len(sample)), replace=False))]
    for _ in range(rounds):
        own = np.concatenate([(part @ centroids.T).argmax(1) for part in np.array_split(sample, max(1, len(sample) // 2048))])
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        centroids = np.where(size > 0, sums / np.where(size > 0, size, 1), centroids)
    return centroids


def enough_probes(sample: np.ndarray, centroids: np.ndarray, k: int = 10) -> int:
    """The least number of lists in which RECALL of the ``k`` best rows of the sample's first vectors are."""
    asked = sample[:TRIAL_QUERIES]
    if not len(asked):
        return 1
    own = np.concatenate([(part @ centroids.T).argmax(1) for part in np.array_split(sample, max(1, len(sample) // 2048))])
    best = np.argsort(-(asked @ sample.T), axis=1)[:, 1:k + 1]  # without the vector itself
    place = np.argsort(np.argsort(-(asked @ centroids.T), axis=1), axis=1)  # of each list in a query's order
    needed = np.sort(np.take_along_axis(place, own[best], 1).ravel())
    return int(needed[min(len(needed) - 1, int(RECALL * len(needed)))]) + 1 if len(needed) else 1


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact rows (query_id, doc_id) that were found."""
    hit = exact.join(found.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi").count()
    return hit / max(1, exact.count())
