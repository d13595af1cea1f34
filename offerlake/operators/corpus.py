"""Declared stages over a text table: exact dedupe (D2a), TF-IDF (D3) and text
search (D4a).  Near dedupe (D2b) is in ``near``, vector search (D4b) in ``vectors``.

The reference announces these stages without code; the definitions are ours.
Weights and scores are whole millionths (BIGINT), so that sums do not depend
on the order of their parts and ranks are the same everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlake.session import saved

MICRO = 1_000_000
#: Bytes of text that one task counts the terms of, so that its counts stay in memory.
TASK_BYTES = 16 << 20


def keep_first_copy(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of documents with the same text (lower case, white space collapsed and trimmed) the
    smallest id: ``(doc_id, copies)``.  One hash aggregate; a text held by many documents
    is one row per map task before the shuffle."""
    norm = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x09-\x0D\x20]+", " "))
    return (docs.select(F.col(doc_id).alias("doc_id"), F.sha2(norm, 256).alias("_text"))
            .groupBy("_text").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).drop("_text"))


def terms(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1)


def term_counts(docs: DataFrame, parts: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, term, tf)``.  The texts are dealt by document, not their terms: what is counted by document
    afterwards, terms here and scores in ``search_text``, is counted where the text is."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).repartition(parts, "doc_id")
    return own.select("doc_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def query_terms(queries: DataFrame, query_id: str = "item_id", text: str = "text") -> DataFrame:
    """``(query_id, term)``: the distinct terms of each row."""
    return queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(terms(F.col(text)))).alias("term"))


def tf_idf(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", wanted: DataFrame | None = None) -> DataFrame:
    """D3: ``(doc_id, term, weight)``; weight = occurrences * ln(documents / documents with the term).
    ``wanted`` (term): the terms whose weights are asked for, all if not given.

    The texts are read twice: for the documents with each term, which are written, and for the
    weights.  No table of a document's terms is written, and they are shuffled only if the
    documents by term are too many to be broadcast."""
    n, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(text))).first()
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-(size or 0) // TASK_BYTES))
    counts = term_counts(docs, parts, doc_id, text)
    own = counts if wanted is None else counts.join(saved(wanted.select("term").distinct(), "wanted-terms"), "term", "left_semi")
    df = saved(own.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term-documents")
    weight = F.round(F.col("tf") * F.log(F.lit(float(n)) / F.col("df")) * MICRO).cast("bigint")
    return counts.join(df, "term").select("doc_id", "term", weight.alias("weight"))


def top_k(scored: DataFrame, query: str, item: str, k: int) -> DataFrame:
    """The ``k`` best rows per query by score, ties by the smaller item; a partial limit runs before the shuffle."""
    order = Window.partitionBy(query).orderBy(F.desc("score"), F.asc(item))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_text(weights: DataFrame, queries: DataFrame, k: int = 10, query_id: str = "item_id", text: str = "text") -> DataFrame:
    """Per query the ``k`` documents with the largest summed weight of the query's
    distinct terms: ``(query_id, rank, doc_id, score)``.

    The queries' terms are written, so that their measured size decides on the join: with the weights of ``tf_idf``
    the scores are then summed where a document's text is."""
    wanted = saved(query_terms(queries, query_id, text), "query-terms")
    scored = weights.join(wanted, "term").groupBy("query_id", "doc_id").agg(F.sum("weight").alias("score"))
    return top_k(scored, "query_id", "doc_id", k).select("query_id", "rank", "doc_id", "score")
