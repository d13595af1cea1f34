"""Language identification by character models.

One interpolated Kneser-Ney model per language is counted over every text of
the learning rows.  A text gets the language of the lowest cross-entropy per
character.  Its score is the calibrated probability that this is right: a
logistic function of the margin to the second language, fitted on every
learning row, each predicted by models that are counted on the other half of the folds.
``rejected`` marks texts whose cross-entropy is above what all but
``REJECT_SHARE`` of the rightly predicted learning texts of that language have: text
of no learned language.  Margins and cross-entropies are counted in steps of
``STEP``, so that what reaches the driver has a fixed bound.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
rows with a null language or null doc_id are not learned from; with no
learned language every text is ``und``; ties go to the language that is first
by name; repeated rows count and are labelled as they stand; an empty table
gives an empty one.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlake.llm import _charlm as C
from offerlake.llm import _text as X
from offerlake.session import saved, scratch_scope

REJECT_SHARE = 0.005
FOLDS = 5
#: The learning folds: each half is predicted by the models of the other.
HALVES = (1, 2), (3, 4)
#: Margins count up to this one; width of a step of margins and of cross-entropies.
MARGIN_MAX, STEP = 5, 1e-4


def fold(doc_id: str) -> Column:
    """crc32 of the doc_id as text, modulo 5; null for a null doc_id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


class Identifier:
    """Language models with their calibration."""

    def __init__(self, model: C.Model | None):
        self.model = model
        self.slope, self.shift = 1.0, 0.0
        self.limit = np.full(len(model.names) if model else 0, np.inf)

    def predict(self, col: pa.Array):
        """Best language (-1: none), margin to the second and cross-entropy of each text."""
        h, n = self.model.entropies(col)
        best = h.argmin(1)
        low = h[np.arange(len(h)), best]
        if h.shape[1] > 1:
            margin = np.partition(h, 1, axis=1)[:, 1] - low
        else:
            margin = np.ones(len(h))
        return np.where(n > 0, best, -1), margin, low

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.minimum(margin, MARGIN_MAX) + self.shift, -30, 30)))

    def calibrate(self, margin: np.ndarray, right: np.ndarray, count: np.ndarray):
        """Fit the score to margins of predictions, whether they are right, and how many texts have them."""
        if not count.sum():
            return
        good, bad = count[right].sum(), count[~right].sum()
        t = np.where(right, (good + 1) / (good + 2), 1 / (bad + 2))
        w = np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(margin * w[0] + w[1], -30, 30)))
            s = count * (p * (1 - p) + 1e-9)
            g = count * (p - t)
            h = np.array([[(s * margin * margin).sum(), (s * margin).sum()], [(s * margin).sum(), s.sum()]]) + 1e-3 * np.eye(2)
            w = w - np.linalg.solve(h, np.array([(g * margin).sum(), g.sum()]) + 1e-3 * w)
        if np.isfinite(w).all() and w[0] >= 0:
            self.slope, self.shift = float(w[0]), float(w[1])


def trials(rows: DataFrame, learned: Identifier) -> DataFrame:
    """(lang_pred, right, margin, low) of the ``rows`` (text, lang) that get a language; margin and low in whole steps."""
    sent = rows.sparkSession.sparkContext.broadcast(learned)

    def predict(batches):
        for batch in batches:
            best, margin, low = sent.value.predict(batch.column("text"))
            names = [*sent.value.model.names, None]
            steps = np.rint(np.minimum(margin, MARGIN_MAX) / STEP).astype(np.int64), np.ceil(low / STEP).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in best.tolist()], pa.string()), *map(pa.array, steps), batch.column("lang")],
                                             names=["lang_pred", "margin", "low", "lang"])

    got = rows.select("text", "lang").mapInArrow(predict, "lang_pred string, margin long, low long, lang string")
    return got.filter("lang_pred IS NOT NULL").select("lang_pred", (F.col("lang_pred") == F.col("lang")).alias("right"), "margin", "low")


def limits(tried: DataFrame) -> dict[str, float]:
    """Per language the cross-entropy that all but ``REJECT_SHARE`` of its rightly predicted texts don't exceed."""
    steps = tried.filter("right").groupBy("lang_pred", "low").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("lang_pred")
    steps = steps.withColumns({"upto": F.sum("n").over(own.orderBy("low")), "all": F.sum("n").over(own)})
    place = F.least(F.col("all") - 1, F.floor((1 - REJECT_SHARE) * F.col("all")))
    return {r[0]: r[1] * STEP for r in steps.filter(F.col("upto") > place).groupBy("lang_pred").agg(F.min("low")).collect()}


def learn(docs: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Identifier:
    """Models of the languages in ``docs``, over all rows but those of fold 0; calibrated on each of these rows by
    models of the half of the folds that it isn't in."""
    half = F.coalesce(*[F.when(fold(doc_id).isin(*folds), F.lit(i)) for i, folds in enumerate(HALVES)])
    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), half.alias("half"))
    rows = rows.filter("lang IS NOT NULL AND half IS NOT NULL")
    with scratch_scope(docs.sparkSession):
        # each text is counted once: the final model's counts are the sums over both halves
        counts = saved(C.gram_counts(rows, key="lang", split="half"), "language-grams")
        found = Identifier(C.fit_counts(counts.groupBy("key", "gram").agg(F.sum("c").alias("c"))))
        if found.model is None:
            return found
        parts = []
        for i in range(len(HALVES)):
            others = C.fit_counts(counts.filter(F.col("split") != i).groupBy("key", "gram").agg(F.sum("c").alias("c")))
            if others is not None:
                parts.append(trials(rows.filter(F.col("half") == i), Identifier(others)))
    if parts:
        with scratch_scope(docs.sparkSession):
            tried = saved(reduce(DataFrame.unionByName, parts), "language-trials")
            # a row per step at most: 2 * MARGIN_MAX / STEP
            steps = tried.groupBy("margin", "right").agg(F.count(F.lit(1)).alias("n")).orderBy("margin", "right").toArrow()
            margin, right, n = (steps.column(c).to_numpy() for c in ("margin", "right", "n"))
            found.calibrate(margin * STEP, right.astype(bool), n.astype(float))
            limit = limits(tried)
        found.limit = np.array([limit.get(name, np.inf) for name in found.model.names])
    return found


FOUND = T.StructType([
    T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType()),
])


def identify(docs: DataFrame, learned: Identifier, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with lang_pred, score, entropy (nats per character) and rejected."""
    sent = docs.sparkSession.sparkContext.broadcast(learned)

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        own, n = sent.value, batch.num_rows
        if own.model is None:
            return [pa.array(["und"] * n), pa.array([0.0] * n), pa.nulls(n, pa.float64()), pa.array([True] * n)]
        best, margin, low = own.predict(batch.column(text))
        names = [*own.model.names, "und"]
        some = best >= 0
        return [pa.array([names[i] for i in best.tolist()], pa.string()), pa.array(np.where(some, own.score(margin), 0.0)),
                pa.array(low, pa.float64(), mask=~some), pa.array(~some | (low > np.append(own.limit, 0)[best]))]

    return X.add_columns(docs, compute, FOUND, keep)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op4: per document, the language of its text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), learn(docs), keep=["doc_id"])
    return found.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "entropy", "rejected")
