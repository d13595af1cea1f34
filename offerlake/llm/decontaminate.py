"""Benchmark decontamination: a broadcast set of normalised test n-grams.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z in lower
case.  A benchmark window is ten consecutive words of one item; an item of one
to nine words is one window.  Documents are scanned as windows of the same
lengths: a window whose hash is in the set is compared word for word with the
benchmark windows of that hash, and its words are hit.

The index is a sorted array of window hashes, the place of each window in the
benchmark's words, and the words as bytes: 16 bytes a word, and the text.  It is
broadcast only if it stays below ``block_bytes``.  A larger benchmark is a
table of windows: the documents are scanned once, past a bitmap of the window hashes
of at most ``block_bytes``, and what passes is joined with that table by the words themselves.

Defined cases: a null or empty text, or one without words, has no words and
no hits; a null benchmark text has no windows; an item without id marks hits
but is not listed; repeated items and documents count as they stand (item ids
are listed once); an empty benchmark leaves every document clean.  Input
columns named like an added one are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlake.llm import _text as X
from offerlake.llm._tables import numbered_columns, saved
from offerlake.session import scratch_scope

WIDTH = 10
BLOCK_BYTES = 64 << 20
BUCKET = 32768  # bits of one of Spark's bitmaps

SPANS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
])


def _words(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The words of a text in UTF-8, a blank after each, and where each starts; the end of the last comes last."""
    data = X.LOWER[np.frombuffer(text.encode("utf-8", "replace") + b" ", np.uint8)]
    kept = X.WORD_BYTE[data]
    s, e = X.runs(kept)
    data[~kept] = 32
    kept[e] = True
    return data[kept], np.concatenate(([0], np.cumsum(e - s + 1)))


class Windows:
    """The windows of some benchmark items in arrays, by length and hash."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int):
        lines, starts, first, names, found = [], [], [], [], {}
        at = size = 0
        for item, text in items:
            line, begin = _words(text or "")
            words = len(begin) - 1
            if not words:
                continue
            n = min(width, words)
            hashes = X.window_hashes(X.span_hashes(line, begin[:-1], begin[1:] - 1), n)
            found.setdefault(n, []).append((hashes, np.arange(at, at + len(hashes), dtype=np.uint32)))
            lines.append(line)
            starts.append((begin[:-1] + size).astype(np.uint32))
            first.append(at)
            names.append(item)
            at, size = at + words, size + len(line)
        self.line = np.concatenate(lines) if lines else np.zeros(0, np.uint8)
        self.starts = np.concatenate([*starts, np.array([size], np.uint32)])
        self.first, self.names = np.array(first, np.uint32), names
        self.sorted, self.at, self.bits = {}, {}, {}
        for n, parts in found.items():
            hashes, places = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(hashes, kind="stable")
            self.sorted[n], self.at[n] = hashes[order], places[order]
            # one bit per low 20 bits of a hash: most windows end here
            self.bits[n] = np.zeros(1 << 20, bool)
            self.bits[n][(hashes & np.uint64(0xFFFFF)).astype(np.int64)] = True

    @property
    def nbytes(self) -> int:
        """Bytes of all that grows with the items."""
        return sum(x.nbytes for x in (self.line, self.starts, self.first, *self.sorted.values(), *self.at.values()))

    def places(self, n: int, hashes: np.ndarray) -> np.ndarray:
        """Where a hash of the set stands in ``hashes``."""
        some = np.flatnonzero(self.bits[n][(hashes & np.uint64(0xFFFFF)).astype(np.int64)])
        known = self.sorted[n]
        at = np.minimum(np.searchsorted(known, hashes[some]), len(known) - 1)
        return some[known[at] == hashes[some]]

    def items(self, n: int, key: int, words: bytes) -> set | None:
        """The items with this window, compared word for word; None if there is none."""
        key = np.uint64(key)
        lo, hi = (int(np.searchsorted(self.sorted[n], key, side)) for side in ("left", "right"))
        at = self.at[n][lo:hi].astype(np.int64)
        begin, end = self.starts[at].astype(np.int64), self.starts[at + n].astype(np.int64) - 1
        at, begin = at[end - begin == len(words)], begin[end - begin == len(words)]
        same = [self.line[b:b + len(words)].tobytes() == words for b in begin.tolist()]
        own = np.unique(np.searchsorted(self.first, at[np.array(same, bool)], "right") - 1)
        return {self.names[i] for i in own.tolist()} if len(own) else None


def merged(spans: list[list[int]]) -> list[list[int]]:
    """Spans in order, overlapping or touching ones put together."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def scan_batch(col: pa.Array, windows: Windows) -> tuple[np.ndarray, list[list], list[set]]:
    """Per row of a text column: number of words, hit word spans, items found."""
    data, starts, ends = X.utf8(col)
    n_words = np.zeros(len(starts), np.int64)
    spans: list[list] = [[] for _ in range(len(starts))]
    items: list[set] = [set() for _ in range(len(starts))]
    for lo, hi in X.slices(starts, ends):
        buf, begin = X.joined(data, starts[lo:hi], ends[lo:hi])
        buf = X.LOWER[buf]
        ws, we, row = X.words_of(buf, X.WORD_BYTE, begin)
        n_words[lo:hi] = np.bincount(row, minlength=hi - lo)
        first = np.concatenate(([0], np.cumsum(n_words[lo:hi])))
        h = X.span_hashes(buf, ws, we)
        for n in windows.sorted:
            known: dict[bytes, set | None] = {}  # of this slice
            grams = X.window_hashes(h, n)
            at = windows.places(n, grams)
            at = at[row[at] == row[at + n - 1]]
            for i, key in zip(at.tolist(), grams[at].tolist()):
                text = b" ".join(buf[a:b].tobytes() for a, b in zip(ws[i:i + n].tolist(), we[i:i + n].tolist()))
                if text not in known:
                    known[text] = windows.items(n, key, text)
                if (found := known[text]) is not None:
                    r = int(row[i])
                    k = i - int(first[r])
                    own = spans[lo + r]
                    if own and own[-1][0] <= k <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], k + n)
                    else:
                        own.append([k, k + n])
                    items[lo + r] |= found
    return n_words, spans, items


def find_benchmark(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", width: int = WIDTH,
                   block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with n_words, hit_spans (word numbers, end exclusive) and hit_items.

    One pass over the documents, without a shuffle, while the index of the
    benchmark fits ``block_bytes``; beyond, one pass and a join of what may hit.
    """
    spark = docs.sparkSession
    bench = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("words"))
    words = F.regexp_count("words", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    size = bench.agg(F.sum(F.octet_length("words") + 16 * words + 64).alias("n")).first()["n"] or 0
    names = list(docs.columns if keep is None else keep)
    if size > block_bytes:
        return _find_by_join(docs, bench, text, width, block_bytes, names)
    sent = spark.sparkContext.broadcast(Windows([(r["item"], r["words"]) for r in bench.collect()], width))

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        n_words, spans, items = scan_batch(batch.column(text), sent.value)
        return [pa.array(n_words, pa.int64()), pa.array([merged(s) for s in spans], pa.list_(pa.list_(pa.int64()))),
                pa.array([sorted(x for x in s if x is not None) for s in items], pa.list_(pa.string()))]

    return X.add_columns(docs, compute, SPANS, names)


#: Windows of an Arrow batch that leaves a task.
_WINDOWS = 1 << 14


def _benchmark_windows(batches):
    """(item, n, key, gram) of every window; ``width`` is a column."""
    for batch in batches:
        for item, text, width in zip(*(batch.column(c).to_pylist() for c in ("item", "words", "width"))):
            line, begin = _words(text or "")
            n = min(width, len(begin) - 1)
            if not n:
                continue
            keys = X.window_hashes(X.span_hashes(line, begin[:-1], begin[1:] - 1), n).view(np.int64)
            for lo in range(0, len(keys), _WINDOWS):
                own = keys[lo:lo + _WINDOWS]
                grams = [line[begin[i]:begin[i + n] - 1].tobytes() for i in range(lo, lo + len(own))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(own), pa.string()), pa.array([n] * len(own), pa.int32()), pa.array(own),
                     pa.array(grams, pa.binary())], names=["item", "n", "key", "gram"])


def _find_by_join(docs: DataFrame, bench: DataFrame, text: str, width: int, filter_bytes: int, names: list[str]) -> DataFrame:
    """The hits by a join on the windows' words.

    A window of the benchmark is one row with its items, so a passage that is
    in a third of the documents is a hot key of one row there, which adaptive execution
    splits.  The bitmap only saves rows of the join; its size changes no result.
    """
    spark = docs.sparkSession
    with scratch_scope(spark):
        windows = saved(bench.withColumn("width", F.lit(width)).mapInArrow(
            _benchmark_windows, "item string, n int, key long, gram binary").distinct(), "decontaminate-windows")
        buckets = max(1, min(filter_bytes * 8 // BUCKET, 16 * windows.count() // BUCKET + 1))
        place = F.pmod("key", F.lit(buckets * BUCKET))
        bits = np.zeros(buckets * BUCKET // 8, np.uint8)
        for r in (windows.groupBy(F.floor(place / BUCKET).alias("bucket"))
                  .agg(F.bitmap_construct_agg(F.pmod(place, F.lit(BUCKET))).alias("bits")).collect()):
            bits[r["bucket"] * BUCKET // 8:(r["bucket"] + 1) * BUCKET // 8] = np.frombuffer(r["bits"], np.uint8)
        lengths = sorted(r["n"] for r in windows.select("n").distinct().collect())
        sent = spark.sparkContext.broadcast(bits)

        landed = numbered_columns(docs, "decontaminate-documents")
        column = landed.table.columns[docs.columns.index(text)]

        def candidates(batches):
            for batch in batches:
                file, number = batch.column("file"), batch.column("row")
                for r, n, at, grams in _may_hit(batch.column(column), lengths, sent.value):
                    yield pa.RecordBatch.from_arrays(
                        [file.take(pa.array(r)), number.take(pa.array(r)), pa.array(np.full(len(r), n, np.int32)), pa.array(at),
                         pa.array(grams, pa.binary())], names=["file", "row", "n", "at", "gram"])

        asked = landed.placed().select("file", "row", column).mapInArrow(
            candidates, "file string, row long, n int, at long, gram binary")
        asked = saved(asked, "decontaminate-candidates")
        known = windows.groupBy("n", "gram").agg(F.collect_set("item").alias("items"))
        hits = saved(asked.join(known, ["n", "gram"]).select("file", "row", "n", "at", "items"), "decontaminate-hits", keep=True)
    spans = (hits.groupBy("file", "row").agg(F.array_sort(F.collect_set(F.struct("at", (F.col("at") + F.col("n")).alias("end"))))
                                             .alias("spans")))
    items = (hits.select("file", "row", F.explode("items").alias("item")).distinct()
             .groupBy("file", "row").agg(F.array_sort(F.collect_list("item")).alias("items")))
    whole = landed.placed()
    new = {f.name.lower() for f in SPANS}
    stay = [(c, name) for c, name in zip(landed.table.columns, docs.columns) if name in names and name.lower() not in new]
    found = whole.join(spans, ["file", "row"], "left").join(items, ["file", "row"], "left")

    def finish(batch: pa.RecordBatch) -> list[pa.Array]:
        data, starts, ends = X.utf8(batch.column(column))
        n_words = np.zeros(len(starts), np.int64)
        for lo, hi in X.slices(starts, ends):
            buf, begin = X.joined(data, starts[lo:hi], ends[lo:hi])
            n_words[lo:hi] = np.bincount(X.words_of(X.LOWER[buf], X.WORD_BYTE, begin)[2], minlength=hi - lo)
        spans = [merged([[s["at"], s["end"]] for s in x or []]) for x in batch.column("spans").to_pylist()]
        return [pa.array(n_words), pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                pa.array([x or [] for x in batch.column("items").to_pylist()], pa.list_(pa.string()))]

    done = X.add_columns(found, finish, SPANS, [c for c, _ in stay])
    return done.toDF(*[name for _, name in stay], *SPANS.names)


def _may_hit(col: pa.Array, lengths: list[int], bits: np.ndarray):
    """Windows of a text column whose hash is in the bitmap: rows, length, word numbers and words, in parts."""
    data, starts, ends = X.utf8(col)
    for lo, hi in X.slices(starts, ends):
        buf, begin = X.joined(data, starts[lo:hi], ends[lo:hi])
        buf = X.LOWER[buf]
        ws, we, row = X.words_of(buf, X.WORD_BYTE, begin)
        first = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=hi - lo))))
        h = X.span_hashes(buf, ws, we)
        for n in lengths:
            place = X.window_hashes(h, n).view(np.int64) % (len(bits) * 8)
            at = np.flatnonzero((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1)
            at = at[row[at] == row[at + n - 1]]
            for part in range(0, len(at), _WINDOWS):
                own = at[part:part + _WINDOWS]
                grams = [b" ".join(buf[a:b].tobytes() for a, b in zip(ws[i:i + n].tolist(), we[i:i + n].tolist()))
                         for i in own.tolist()]
                yield row[own] + lo, n, own - first[row[own]], grams


def n_hit():
    """Number of hit words, from ``hit_spans``."""
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The documents without a hit word; their columns are unchanged, whatever their names."""
    names = docs.columns
    row = docs.select(F.struct(*names).alias("__row"), F.col(text).alias("__text"))
    found = find_benchmark(row, benchmark, text="__text", keep=["__row"], **options)
    return found.filter(F.size("hit_spans") == 0).select(*[F.col("__row").getField(c).alias(c) for c in names])


def remove_spans(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", width: int = WIDTH) -> DataFrame:
    """The documents with every hit word cut out of ``text``; what surrounds the words stays."""
    found = find_benchmark(docs, benchmark, text=text, width=width)

    def cut(batch: pa.RecordBatch) -> list[pa.Array]:
        out = []
        for value, spans in zip(batch.column(text).to_pylist(), batch.column("hit_spans").to_pylist()):
            if not spans:
                out.append(value)
                continue
            raw = value.encode("utf-8", "replace")
            s, e = X.runs(X.WORD_BYTE[X.LOWER[np.frombuffer(raw, np.uint8)]])
            parts, last = [], 0
            for a, b in spans:
                parts.append(raw[last:s[a]])
                last = int(e[b - 1])
            out.append(b"".join([*parts, raw[last:]]).decode("utf-8", "replace"))
        return [pa.array(out, pa.string())]

    return X.add_columns(found, cut, T.StructType([T.StructField(text, T.StringType())]))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op6: per document, the words and items of the benchmark found in it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", n_hit().alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"))


EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least({WIDTH}, len(w)) AS n, unnest([list_aggregate(w[i:i + least({WIDTH}, len(w)) - 1],
         'string_agg', ' ') FOR i IN range(1, len(w) - least({WIDTH}, len(w)) + 2)]) AS gram FROM b WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i,
         unnest([list_aggregate(w[j:j + n - 1], 'string_agg', ' ') FOR j IN range(1, len(w) - n + 2)]) AS gram
       FROM d, lens WHERE len(w) >= n),
hit AS (SELECT DISTINCT r, i, dw.n, item FROM dw JOIN bw ON dw.gram = bw.gram AND dw.n = bw.n),
hw AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
hi AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)
"""
