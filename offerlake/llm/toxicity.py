"""Toxicity: noisy-channel restoration of disguised words, then a score of the restored text.

1. A character model (interpolated Kneser-Ney) is counted over every text.
2. Chunks that look disguised are restored: look-alike signs (m0r0n, a$$),
   any other sign between letters (mor-on, m.o.r.o.n, m/o/r/o/n), three or more
   chunks of one or two letters in a row (m o r o n, mo ro n), letters repeated
   three times or more (moooron).  Each is a lattice: a position offers the
   letters that its sign may stand for, a separator nothing or a blank, a
   repeated letter nothing; a Viterbi search over the last letters finds
   the likeliest reading under channel costs and the model.
3. The words of a text and of its restored chunks are looked up in a learned
   lexicon; a word that is one of its words with letters repeated (moroon)
   counts, too, unless the labelled sample knows it as an ordinary word.  A
   logistic model over the words found gives the score.

Labels are learned from at most ``TRAIN_ROWS`` labelled documents of each
label, by hash (the classifier's bounded sample): words that clearly more toxic than
other documents hold, counted once per cluster of near copies (documents of
one smallest hash of three words), and their weights.  Everything else covers every row.

Defined cases: null and empty texts have no words and the score of a text
without a lexicon word; several labels of one document count each, null ones
do not; a null doc_id is never learned from and not held out; without labels of both kinds
every score is 0; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlake.llm import _charlm as C
from offerlake.llm import _text as X
from offerlake.llm.language_id import fold
from offerlake.session import saved, scratch_scope

TRAIN_ROWS = 5000
#: The least log-likelihood ratio of a word of the lexicon.
LEAST_RATIO = 18.0
LEARN_FOLDS = "fold <> 0"

# What a sign may stand for besides itself.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
         "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
COST_LOOK, COST_DROP, COST_BLANK, COST_REPEAT, COST_STRAY = 0.7, 0.1, 2.0, 0.1, 4.0

_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[0x41:0x5B] = _ASCII_LETTER[0x61:0x7B] = True
_ASCII_LETTER[0x80:] = True
_LOOK_BYTE = np.zeros(256, bool)
_LOOK_BYTE[[ord(c) for c in LOOKS if ord(c) < 128]] = True
_LOOK_SIGN_BYTE = _LOOK_BYTE.copy()
_LOOK_SIGN_BYTE[0x30:0x3A] = False


# In a reading: a repeat of the letter before, left out.
_DROPPED = "\0"
_AGAIN = re.compile(r"([^\0])\0+")


class Lattice:
    """Viterbi search for the likeliest reading of a disguised chunk under a character model."""

    TABLE = 200_000
    LOGS = 2_000_000

    def __init__(self, model: C.Model):
        self.model = model
        self.known: dict[str, tuple[tuple[str, str], ...]] = {}
        self.logs: dict[str, float] = {}

    def _look(self, grams: list[str]) -> dict[str, float]:
        """A table of log-likelihoods that holds those of ``grams``; unknown ones are looked up together."""
        logs = self.logs
        if missing := list({g for g in grams if g not in logs}):
            if len(logs) + len(missing) > self.LOGS:
                logs.clear()
                missing = list(set(grams))
            chars = np.frombuffer("".join(missing).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(missing), -1)
            logs.update(zip(missing, self.model.log_probability(chars)[:, 0].tolist()))
        return logs

    def _log(self, context: str, letter: str) -> float:
        return self._look([context + letter])[context + letter]

    def read(self, chunk: str) -> tuple[tuple[str, str], ...]:
        """The words of the likeliest reading, without and with the letters dropped as repeats; a chunk is decoded once per worker."""
        if (words := self.known.get(chunk)) is None:
            words = tuple((w.replace(_DROPPED, ""), _AGAIN.sub(lambda m: m[1] * len(m[0]), w)) for w in self._search(chunk).split(" ") if w)
            if len(self.known) >= self.TABLE:
                self.known.clear()
            self.known[chunk] = words
        return words

    def _search(self, chunk: str) -> str:
        size = self.model.order - 1
        start = " " * size
        # state: the last letters; its cost, and the reading as a linked list
        states: dict[str, tuple[float, tuple | None]] = {start: (0.0, None)}
        before = ""
        for sign in chunk:
            options = _options(sign, before)
            letters = [c for c, _ in options if c]
            logs = self._look([s + c for s in states for c in letters])
            new: dict[str, tuple[float, tuple | None]] = {}
            for state, (cost, path) in states.items():
                for letter, price in options:
                    if not letter or letter == " " and state[-1] == " ":
                        after, total, way = state, cost + price, path
                        if sign == before and path and (path[0] == _DROPPED or path[0] == sign or path[0] in LOOKS.get(sign, "")):
                            way = _DROPPED, path
                    else:
                        after = state[1:] + letter
                        total, way = cost + price - logs[state + letter], (letter, path)
                    if after not in new or total < new[after][0]:
                        new[after] = total, way
            best = min(c for c, _ in new.values())
            # The best reading can go on as any other does; a letter costs it at most -log(LEAST) more,
            # and after as many letters as a state holds both are in one state: what is further behind can't win.
            states = {s: v for s, v in new.items() if v[0] <= best - size * np.log(C.LEAST)}
            before = sign
        last = min(((cost - self._log(s, " ") if s[-1] != " " else cost), s) for s, (cost, _) in states.items())[1]
        out, path = [], states[last][1]
        while path is not None:
            out.append(path[0])
            path = path[1]
        return "".join(reversed(out))


def _options(sign: str, before: str) -> list[tuple[str, float]]:
    """What a sign may be read as after the sign ``before``, and its price; the empty string leaves it out."""
    options = []
    if sign.isalpha():
        options.append((sign, 0.0))
    elif sign not in LOOKS:
        options += [("", COST_DROP), (" ", COST_BLANK)]
    else:
        options.append(("", COST_STRAY))
    options += [(c, COST_LOOK) for c in LOOKS.get(sign, "")]
    if sign == before and (sign.isalpha() or sign in LOOKS):
        options.append(("", COST_REPEAT))
    return options


def disguised(buf: np.ndarray, begin: np.ndarray):
    """(row, start, end) of the chunks of joined bytes that look disguised."""
    s, e, row = X.words_of(buf, X.NON_SPACE_BYTE, begin)
    if not len(s):
        return row, s, e

    def count(mask):
        total = np.concatenate(([0], np.cumsum(mask)))
        return total[e] - total[s]

    letter, look = _ASCII_LETTER[buf], _LOOK_BYTE[buf]
    for lead, size in ((0xC2, 2), (0xE2, 3)):  # signs of Latin-1 and of the punctuation and symbol blocks are no letters
        at = np.flatnonzero(buf == lead)
        for k in range(size):
            letter[at[at + k < len(buf)] + k] = False
    letters, looks = count(letter), count(look)
    part = letter | look
    begins = part.copy()  # of runs of letters and look-alikes
    begins[1:] &= ~part[:-1]
    inner = np.zeros(len(buf), bool)  # a look-alike that is no digit, between two others
    inner[1:-1] = _LOOK_SIGN_BYTE[buf[1:-1]] & part[:-2] & part[2:]
    again = np.zeros(len(buf), bool)  # the third of three equal letters
    again[2:] = (buf[2:] == buf[1:-1]) & (buf[1:-1] == buf[:-2]) & letter[2:] & (buf[2:] < 0x80)
    pick = (letters >= 1) & (letters + looks >= 2) & (looks > 0) | (letters == 0) & (looks >= 3) & (count(inner) > 0) \
        | (letters >= 1) & (letters + looks >= 3) & (count(begins) >= 2) | (count(again) > 0)
    out = [np.flatnonzero(pick)]
    first, last = [s[out[0]]], [e[out[0]]]
    # letters written apart: three or more chunks of one sign, or of one or two (a continuation byte adds no sign)
    signs = count((buf & 0xC0) != 0x80)
    single = (signs == 1) & (letters + looks > 0)
    short = (signs <= 2) & (letters > 0)
    both = [X.runs(single), X.runs(short)]
    a, b = (np.concatenate(x) for x in zip(*both))
    new_row = np.concatenate(([True], row[1:] != row[:-1]))
    for x, y in zip(a.tolist(), b.tolist()):
        if y - x >= 3:
            cut = [x, *(x + 1 + np.flatnonzero(new_row[x + 1:y])).tolist(), y]
            for p, q in zip(cut, cut[1:]):
                if q - p >= 3:
                    out.append(np.array([p]))
                    first.append(s[p:p + 1])
                    last.append(e[q - 1:q])
    at = np.concatenate(out)
    return row[at], np.concatenate(first), np.concatenate(last)


_SQUEEZE = re.compile(r"\s+")


def word_rows(col: pa.Array, lattice: Lattice | None):
    """Per slice: bytes, words (start, end, row from 0) and, for each row with disguised chunks, its restored words,
    without and with repeated letters."""
    data, starts, ends = X.utf8(col)
    for lo, hi in X.slices(starts, ends):
        buf, begin = X.joined(data, starts[lo:hi], ends[lo:hi])
        buf = X.LOWER[buf]
        ws, we, row = X.words_of(buf, X.WORD_BYTE, begin)
        restored: dict[int, set[tuple[str, str]]] = {}
        if lattice is not None:
            for r, a, b in zip(*(x.tolist() for x in disguised(buf, begin))):
                chunk = _SQUEEZE.sub(" ", buf[a:b].tobytes().decode("utf-8", "replace"))
                restored.setdefault(r, set()).update(lattice.read(chunk))
        yield lo, hi, buf, ws, we, row, restored


def squeezed(word: str) -> str:
    return re.sub(r"(.)\1+", r"\1", word)


def stretches(word: str, other: str) -> bool:
    """Whether ``word``, of the same squeezed form, has each letter of ``other`` at least as often in a row."""
    return all(len(list(x)) >= len(list(y)) for (_, x), (_, y) in zip(groupby(word), groupby(other)))


class Scorer:
    """The learned parts: character model, lexicon and weights."""

    def __init__(self, model: C.Model | None, words: list[str], weights: np.ndarray, bias: float, ordinary: frozenset[str] = frozenset()):
        """``ordinary``: words that are like a word of the lexicon with letters repeated and mean something else."""
        self.model, self.words, self.weights, self.bias, self.ordinary = model, words, weights, bias, ordinary
        self.lattice = Lattice(model) if model is not None else None
        self.number: dict[str, list[int]] = {}
        for i in sorted(range(len(words)), key=lambda i: (-len(words[i]), i)):
            self.number.setdefault(squeezed(words[i]), []).append(i)
        self.table, self.short = _lookup(words), _lookup(sorted(self.number))

    def _stretched(self, word: str) -> int | None:
        """The lexicon word that ``word`` is, or is with letters repeated."""
        if word in self.ordinary:
            return None
        return next((i for i in self.number.get(squeezed(word), []) if stretches(word, self.words[i])), None)

    def found(self, col: pa.Array) -> list[set[int]]:
        """Numbers of the lexicon words in each row of a text column, as written, with letters repeated or restored."""
        out: list[set[int]] = [set() for _ in range(len(col))]
        if self.table is None:
            return out
        for lo, _, buf, ws, we, row, restored in word_rows(col, self.lattice):
            at = self.table.find(X.span_hashes(buf, ws, we))
            for k in np.flatnonzero(at >= 0).tolist():
                i = int(self.table.values[at[k]])
                if buf[ws[k]:we[k]].tobytes() == self.words[i].encode():
                    out[lo + row[k]].add(i)
            for k in self._repeating(buf, ws, we, at < 0):
                word = buf[ws[k]:we[k]].tobytes().decode("utf-8", "replace")
                if (i := self._stretched(word)) is not None:
                    out[lo + row[k]].add(i)
            for r, words in restored.items():
                out[lo + r].update(i for _, full in words if (i := self._stretched(full)) is not None)
        return out

    def _repeating(self, buf: np.ndarray, ws: np.ndarray, we: np.ndarray, open_: np.ndarray) -> list[int]:
        """Which of the open words repeat a letter and may be lexicon words without that."""
        keep = np.ones(len(buf), bool)
        keep[1:] = (buf[1:] != buf[:-1]) | (buf[1:] >= 0x80)
        total = np.concatenate(([0], np.cumsum(keep)))
        some = np.flatnonzero(open_ & (total[we] - total[ws] < we - ws))
        if not len(some):
            return []
        return some[self.short.find(X.span_hashes(buf[keep], total[ws[some]], total[we[some]])) >= 0].tolist()

    def score(self, col: pa.Array) -> np.ndarray:
        z = np.array([self.bias + self.weights[sorted(f)].sum() if f else self.bias for f in self.found(col)])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _lookup(words: list[str]) -> C.Table | None:
    """The words' numbers by their hash; None without words."""
    if not words:
        return None
    raw = [w.encode() for w in words]
    edge = np.concatenate(([0], np.cumsum([len(w) + 1 for w in raw]))).astype(np.int64)
    return C.Table(X.span_hashes(np.frombuffer(b" ".join(raw), np.uint8), edge[:-1], edge[1:] - 1), np.arange(len(words)))


def _sample(docs: DataFrame, labels: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(label, text) of at most TRAIN_ROWS labelled learning documents of each label, by hash of the doc_id."""
    rows = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("label"), fold("doc_id").alias("fold"),
                         F.xxhash64(F.col("doc_id").cast("string")).alias("order")).filter(f"{LEARN_FOLDS} AND label IN (0, 1)")
    chosen = None
    for label in (0, 1):
        own = rows.filter(F.col("label") == label).orderBy("order", "id").limit(TRAIN_ROWS).select("id", "label")
        chosen = own if chosen is None else chosen.union(own)
    chosen = saved(chosen, "toxicity-labels")  # 2 * TRAIN_ROWS rows at most
    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id").select("label", "text")


def _document_words(sample: DataFrame, model: C.Model | None) -> DataFrame:
    """(doc, label, cluster, words): the distinct words of each sampled document, restored ones included."""
    sent = sample.sparkSession.sparkContext.broadcast(Scorer(model, [], np.zeros(0), 0.0))

    def run(batches):
        for batch in batches:
            words: list[set[str]] = [set() for _ in range(batch.num_rows)]
            cluster = np.zeros(batch.num_rows, np.uint64)
            for lo, hi, buf, ws, we, row, restored in word_rows(batch.column("text"), sent.value.lattice):
                raw = buf.tobytes()
                for r, a, b in zip(row.tolist(), ws.tolist(), we.tolist()):
                    words[lo + r].add(raw[a:b].decode("utf-8", "replace"))
                h = X.span_hashes(buf, ws, we)
                if len(h):
                    h = X.window_hashes(np.append(h, h[:2]), 3)[:len(h)]
                    edge = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
                    cluster[lo + row[edge]] = np.minimum.reduceat(h, edge)
                for r, more in restored.items():
                    words[lo + r].update(word for word, _ in more)
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(cluster.view(np.int64)),
                                              pa.array([sorted(w) for w in words], pa.list_(pa.string()))], names=["label", "cluster", "words"])

    return sample.mapInArrow(run, "label int, cluster long, words array<string>")


def learn(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> Scorer:
    """Character model over all texts; lexicon and weights from the labelled sample."""
    model = C.fit(docs, text=text)
    with scratch_scope(docs.sparkSession):
        return _learn(docs, labels, model, text, doc_id)


def _learn(docs: DataFrame, labels: DataFrame, model: C.Model | None, text: str, doc_id: str) -> Scorer:
    rows = saved(_document_words(_sample(docs, labels, text, doc_id), model).withColumn("doc", F.monotonically_increasing_id()), "toxicity-words")
    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.countDistinct("cluster").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return Scorer(None, [], np.zeros(0), -30.0)
    each = rows.select("label", "cluster", F.explode("words").alias("word"))
    seen = each.groupBy("word").agg(F.countDistinct(F.when(F.col("label") == 1, F.col("cluster"))).alias("a"),
                                    F.countDistinct(F.when(F.col("label") == 0, F.col("cluster"))).alias("b"))
    # log-likelihood ratio of the word's clusters against the share of each label
    def part(k, n):
        return F.when(k > 0, k * F.log(k / ((F.col("a") + F.col("b")) * n / (n1 + n0)))).otherwise(0.0)

    ratio = 2 * (part(F.col("a"), n1) + part(F.col("b"), n0))
    toxic = F.col("a") / n1 > 3 * F.col("b") / n0
    lexicon = seen.withColumn("ratio", ratio).filter((F.col("ratio") >= LEAST_RATIO) & toxic)
    words = [r["word"] for r in lexicon.orderBy(F.desc("ratio"), "word").select("word").collect()]
    if not words:
        share = n1 / (n1 + n0)
        return Scorer(model, [], np.zeros(0), float(np.log(share / (1 - share))))
    hit = rows.select("doc", "label", F.array_intersect("words", F.array(*[F.lit(w) for w in words])).alias("w")).collect()
    like = seen.filter(~toxic & F.regexp_replace("word", r"(.)\1+", "$1").isin(sorted({squeezed(w) for w in words})))
    ordinary = frozenset(r["word"] for r in like.select("word").collect())
    return Scorer(model, words, *_logistic(hit, words), ordinary)


def _logistic(rows, words: list[str]) -> tuple[np.ndarray, float]:
    """Weights and bias of a regularised logistic model over word presence."""
    at = {w: i for i, w in enumerate(words)}
    x = np.zeros((len(rows), len(words) + 1))
    for i, r in enumerate(rows):
        for w in r["w"]:
            x[i, at[w]] = 1
        x[i, -1] = 1
    y = np.array([r["label"] for r in rows], float)
    keep = np.full(len(words) + 1, 0.1)
    keep[-1] = 1e-6
    w = np.zeros(len(words) + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + keep * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


SCORED = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def score_texts(docs: DataFrame, scorer: Scorer, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with score and predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(scorer)

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        score = sent.value.score(batch.column(text))
        return [pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32())]

    return X.add_columns(docs, compute, SCORED, keep)


def drop_toxic(docs: DataFrame, scorer: Scorer, *, text: str = "text") -> DataFrame:
    """The documents that aren't predicted toxic; columns unchanged, whatever their names."""
    names = docs.columns
    row = docs.select(F.struct(*names).alias("__row"), F.col(text).alias("__text"))
    found = score_texts(row, scorer, text="__text", keep=["__row"])
    return found.filter("predicted = 0").select(*[F.col("__row").getField(c).alias(c) for c in names])


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op8: per document, the toxicity of its text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scorer = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = score_texts(docs, scorer, keep=["doc_id"])
    return found.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", "predicted")
