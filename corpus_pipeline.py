"""The corpus pipeline: toxicity, exact dedup, near-duplicate join, decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; ``run`` writes each result as Parquet to the shared folder and reads
it again for the next stage.  All stages but the last return the columns of
their input unchanged.  Rows that no stage has a reason to drop stay,
repeated, empty and null ones as the operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from offerlake.llm import bpe, decontaminate, ngram_join, stream_dedup, toxicity
from offerlake.session import configure, saved


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    configure(spark)
    return toxicity.drop_toxic(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the first document stays."""
    configure(spark)
    return stream_dedup.drop_copies(docs, memory_mb=128)  # Python stages share the executors


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents one row stays, that with the smallest doc_id."""
    configure(spark)
    return ngram_join.drop_linked(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    configure(spark)
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the number and digest of their token ids and the digest of the text decoded from them."""
    configure(spark)
    return bpe.encode_digests(docs, bpe.vocabulary_path(), keep=["doc_id", "lang", "source"])


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_jaccard_join", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

# The toxicity model can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
