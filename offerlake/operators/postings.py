"""D4a by impact-ordered postings: text search that leaves out blocks which can't matter.

The index keeps every (document, term) weight, by term, heaviest first, in
blocks of at most BLOCK postings; a block's bound is its heaviest weight.  A
query reads

1. the first SEED blocks of each of its terms; the scores of the documents in them
   are looked up, and the k-th best, the floor, is one that k documents reach at least;
2. of each term the blocks whose bound is at least the term's share of the
   floor (shares go by the terms' heaviest weights and add up to the floor).
   A document in none of these blocks stays below the floor;
3. of the documents found those whose sum, with the shares of the terms they were not
   found under, reaches the floor: their missing weights are looked up by document and term.

The rows are exactly those of ``search_text``: weights are not negative, and
ties go to the smaller id.  Blocks are packed from a sort by range, so a term
that every document holds is in no single task; a floor of 0 (fewer than k
documents found) reads all blocks of the query's terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerlake.operators.corpus import query_terms, top_k
from offerlake.session import saved

#: Postings of a block, and blocks of each term that a query reads first.
BLOCK, SEED = 128, 1


def _packed(size: int):
    """Runs of one term in the order of the rows, ``size`` postings at most each."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            names = batch.column("term").to_pylist()
            cut = [0]
            for i in range(1, len(names)):
                if names[i] != names[i - 1] or i - cut[-1] == size:
                    cut.append(i)
            edge = pa.array([*cut, len(names)] if names else [0], pa.int32())
            weights = batch.column("weight")
            yield pa.RecordBatch.from_arrays(
                [batch.column("term").take(pa.array(cut[:len(names)], pa.int64())), weights.take(pa.array(cut[:len(names)], pa.int64())),
                 pa.ListArray.from_arrays(edge, batch.column("doc_id")), pa.ListArray.from_arrays(edge, weights)],
                names=["term", "bound", "docs", "weights"])

    return run


class PostingsIndex:
    """The blocks of ``weights`` (doc_id, term, weight), and the weights themselves for single look-ups."""

    def __init__(self, weights: DataFrame):
        self.weights = saved(weights.select(F.col("doc_id").cast("long").alias("doc_id"), "term", F.col("weight").cast("long").alias("weight")),
                             "term-weights")
        heavy = ["term", F.desc("weight"), "doc_id"]
        rows = self.weights.repartitionByRange(*heavy).sortWithinPartitions(*heavy).mapInArrow(
            _packed(BLOCK), "term string, bound long, docs array<bigint>, weights array<bigint>")
        self.blocks = saved(rows.withColumn("block", F.monotonically_increasing_id()), "postings")

    def _wanted(self, queries: DataFrame, query_id: str, text: str) -> DataFrame:
        return query_terms(queries, query_id, text).distinct()

    def _read(self, chosen: DataFrame) -> DataFrame:
        """(query_id, term, doc_id, weight) of the chosen (query_id, block) blocks."""
        own = chosen.join(self.blocks.drop("bound"), "block").select("query_id", "term", F.explode(F.arrays_zip("docs", "weights")).alias("p"))
        return own.select("query_id", "term", F.col("p.docs").alias("doc_id"), F.col("p.weights").alias("weight"))

    def _scores(self, pairs: DataFrame, wanted: DataFrame) -> DataFrame:
        """(query_id, doc_id, score) of some (query_id, doc_id): their weights are looked up.

        The weights of the queries' terms meet the pairs by document and the queries there, so that
        neither a pair's terms are shuffled nor its weights a second time for the sum."""
        held = self.weights.join(wanted.select("term").distinct(), "term", "left_semi")
        met = pairs.join(held, "doc_id").join(wanted, ["query_id", "term"])
        return met.groupBy("query_id", "doc_id").agg(F.sum("weight").alias("score"))

    def plan(self, queries: DataFrame, k: int = 10, query_id: str = "item_id", text: str = "text") -> DataFrame:
        """(query_id, term, block, floor, share, read): the blocks of each query's terms, and whether it reads them."""
        wanted = saved(self._wanted(queries, query_id, text), "postings-terms")
        near = self.blocks.select("term", "block", "bound").join(wanted, "term")
        first = Window.partitionBy("query_id", "term").orderBy(F.desc("bound"), "block")
        seeds = near.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= SEED)
        seeds = saved(seeds.select("query_id", "term", "block", "bound"), "postings-seeds")
        heaviest = seeds.groupBy("query_id", "term").agg(F.max("bound").alias("most"))
        total = heaviest.groupBy("query_id").agg(F.sum("most").alias("total"))
        seen = self._read(seeds.select("query_id", "block")).select("query_id", "doc_id").distinct()
        best = top_k(self._scores(seen, wanted), "query_id", "doc_id", k)
        floor = best.filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        # a hair less, so that rounding never adds the shares up to more than the floor
        share = F.coalesce(F.col("floor") * (F.col("most") / F.nullif("total", F.lit(0))) * (1 - 1e-12), F.lit(0.0))
        shares = heaviest.join(total, "query_id").join(floor, "query_id", "left").select("query_id", "term", "floor", share.alias("share"))
        return saved(near.join(shares, ["query_id", "term"]).select("query_id", "term", "block", "floor", "share", (F.col("bound") >= F.col("share")).alias("read")),
                     "postings-plan")

    def search(self, queries: DataFrame, k: int = 10, query_id: str = "item_id", text: str = "text", plan: DataFrame | None = None) -> DataFrame:
        """``(query_id, rank, doc_id, score)``, as ``search_text``; ``plan``: of the same queries, if it is at hand."""
        plan = plan if plan is not None else self.plan(queries, k, query_id, text)
        read = self._read(plan.filter("read").select("query_id", "block"))
        shares = plan.select("query_id", "term", "floor", "share").distinct()
        whole = shares.groupBy("query_id").agg(F.sum("share").alias("whole"), F.max("floor").alias("floor"))
        found = read.join(shares.select("query_id", "term", "share"), ["query_id", "term"]).groupBy("query_id", "doc_id").agg(
            F.sum("weight").alias("score"), F.sum("share").alias("known"))
        reach = F.col("score") + F.col("whole") - F.col("known") >= F.col("floor") - 1e-6
        able = found.join(whole, "query_id").filter(F.col("floor").isNull() | reach).select("query_id", "doc_id")
        wanted = saved(self._wanted(queries, query_id, text), "postings-terms")
        scored = self._scores(saved(able, "postings-candidates"), wanted)
        return top_k(scored, "query_id", "doc_id", k).select("query_id", "rank", "doc_id", "score")
