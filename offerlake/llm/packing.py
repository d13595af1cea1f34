"""Packing of token pieces into sequences by a configuration linear program.

1. A document's ids, with the end mark, longer than a sequence are cut into
   pieces of a whole sequence; the first piece takes what remains.
2. A configuration is a multiset of piece lengths that fits into a sequence.
   The linear program covers the histogram of lengths with as few
   configurations as possible.  It is solved by multiplicative weights: each
   length has a weight; a knapsack by dynamic programming finds the
   configurations of the largest weight; they are taken for a share of the
   pieces, whose weights shrink by exp(-rate * share); a covered length drops
   out.  Initial weights are length^(1 + LEAN), near the dual of a program
   that packs without waste, a little more for what is harder to place.
3. Rounding: every configuration as often as whole, the largest first; then
   once more, as far as pieces remain; what is left goes by best fit, longest first.
4. The histogram has at most ``capacity`` rows, so program and plan are of
   bounded size whatever the table.  Pieces are numbered within their length
   (by task, then by a running sum over the tasks); a length's numbers are
   dealt out to the places that the plan has for it, so every piece finds its
   sequence and offset by a binary search.  No group of pieces is gathered.

Defined cases: a null or empty text is one piece of the end mark; repeated
rows are pieces of their own; an empty table gives no row; lengths that tie are
told apart by task and place; columns of the input named like an added one are replaced.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlake.llm.token_shards import coder
from offerlake.session import saved, scratch_scope

CAPACITY, END = 1024, 2
#: The multiplicative weights: how far initial weights lean to long pieces, the largest share of a length that one
#: step covers, and how near to the best configuration one must be to be taken with it.
LEAN, STEP, NEAR = 0.2, 0.25, 0.003
#: Slow weights suit lengths that fill up nearly any way, fast ones lengths that few partners fit: the better plan is kept.
RATES = (0.2, 4.0)
#: A plan this near to the bound that no packing is below is kept without another try.
NEAR_BOUND = 1.001
#: The share of all tokens that the program may leave to the rounding.
REST = 0.01
#: Fixed value: the special token that the vocabulary's library recognises in texts.
SPECIAL = {"<|endoftext|>": 50256}

PIECES = T.StructType([
    T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("rank", T.LongType()),
    T.StructField("ids", T.BinaryType()),
])

Config = tuple[tuple[int, int], ...]  # (length, times), longest first


# ---- the program, over a histogram

def knapsack(value: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each size up to ``capacity`` the largest value of pieces that fit, and the type of the last of them (-1: as one less)."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    types = np.full(capacity, -1)
    types[lengths - 1] = np.arange(len(lengths))
    by_length = np.full(capacity, -1.0)  # of lengths 1, 2, ...
    by_length[lengths - 1] = value
    for c in range(int(lengths[0]), capacity + 1):
        got = best[c - 1::-1] + by_length[:c]
        j = int(got.argmax())
        if got[j] > best[c - 1]:
            best[c], last[c] = got[j], types[j]
        else:
            best[c] = best[c - 1]
    return best, last


def _filled(last: np.ndarray, lengths: np.ndarray, size: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """The configuration of ``first`` and the best pieces of ``size`` more: types and times."""
    found = [first]
    while size > 0:
        if last[size] < 0:
            size -= 1
        else:
            found.append(int(last[size]))
            size -= int(lengths[last[size]])
    return np.unique(found, return_counts=True)


def solve_program(lengths: np.ndarray, counts: np.ndarray, capacity: int, rate: float) -> dict[Config, float]:
    """Configurations and how often each is used, fractions included, covering ``counts`` pieces of ascending ``lengths``
    (all but REST of their tokens)."""
    n = counts.astype(float)
    left, out = n.copy(), {}
    start, largest = (lengths / capacity) ** (1 + LEAN), min(STEP, 0.4 / rate)
    while left @ lengths > REST * (n @ lengths):
        open_, share = left > 0, left / n
        weight = np.where(open_, start * np.exp(rate * (share / share.max() - 1)), 0)
        best, last = knapsack(weight, lengths, capacity)
        value = np.where(open_, weight + best[capacity - lengths], 0)
        use, taken = np.zeros(len(n)), {}
        for i in np.flatnonzero(value >= (1 - NEAR) * value.max()).tolist():
            types, times = _filled(last, lengths, capacity - int(lengths[i]), i)
            key = tuple(zip(lengths[types[::-1]].tolist(), times[::-1].tolist()))
            if key not in taken:
                taken[key] = (left[types] / times).min()
                use[types] += times * taken[key]
        some = use > 0
        step = min(1.0, (np.minimum(left, largest * n)[some] / use[some]).min())
        for key, often in taken.items():
            out[key] = out.get(key, 0.0) + often * step
        left = np.maximum(left - use * step, 0)
        left[left < 1e-6 * n] = 0
    return out


def best_fit(left: dict[int, int], capacity: int) -> dict[Config, int]:
    """Best fit, longest first, of pieces (length: count); bins of equal content are handled together."""
    by_room: dict[int, dict[Config, int]] = {}
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            room = min((r for r, bins in by_room.items() if r >= length and bins), default=capacity)
            config, bins = by_room[room].popitem() if by_room.get(room) else ((), n)
            each = min(room // length, n)
            used = min(bins, n // each)
            if config and bins > used:
                by_room[room][config] = bins - used
            rest = by_room.setdefault(room - each * length, {})
            key = (*config, (length, each))
            rest[key] = rest.get(key, 0) + used
            n -= used * each
    out: dict[Config, int] = {}
    for bins in by_room.values():
        for config, n in bins.items():
            out[config] = out.get(config, 0) + n
    return out


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[Config, int]:
    """How many sequences of each configuration hold exactly the pieces of ``histogram`` (length: count)."""
    left = {n: c for n, c in histogram.items() if c}
    whole = {((capacity, 1),): left.pop(capacity)} if capacity in left else {}
    if not left:
        return whole
    lengths = np.array(sorted(left))
    counts = np.array([left[n] for n in lengths.tolist()])
    plans = []
    for rate in RATES:
        plans.append(round_program(solve_program(lengths, counts, capacity, rate), left, capacity))
        if sum(plans[-1].values()) <= NEAR_BOUND * least_sequences(left, capacity):
            break
    return whole | min(plans, key=lambda plan: sum(plan.values()))


def round_program(program: dict[Config, float], histogram: dict[int, int], capacity: int) -> dict[Config, int]:
    """Whole numbers of configurations that hold exactly the pieces of ``histogram``."""
    left, plan = dict(histogram), {}
    order = sorted(program, key=lambda c: (-program[c], c))
    for often in (lambda c: int(program[c]), lambda c: 1):
        for config in order:
            k = min(often(config), min(left[n] // times for n, times in config))
            if k:
                plan[config] = plan.get(config, 0) + k
                for n, times in config:
                    left[n] -= k * times
    for config, k in best_fit({n: c for n, c in left.items() if c}, capacity).items():
        plan[config] = plan.get(config, 0) + k
    return plan


class Places:
    """Sequence and offset of the k-th piece of each length."""

    def __init__(self, plan: dict[Config, int]):
        rows: dict[int, list[tuple[int, int, int]]] = {}
        sequence = 0
        for config, k in sorted(plan.items()):
            offset = 0
            for length, times in config:
                rows.setdefault(length, []).append((sequence, times, offset))
                offset += length * times
            sequence += k
        self.sequences = sequence
        self.by_length: dict[int, tuple[np.ndarray, ...]] = {}
        often = {s: k for s, k in zip(np.cumsum([0, *(k for _, k in sorted(plan.items()))]).tolist(), (k for _, k in sorted(plan.items())))}
        for length, own in rows.items():
            first = np.concatenate(([0], np.cumsum([times * often[s] for s, times, _ in own])))[:-1]
            self.by_length[length] = (first, *(np.array(c, np.int64) for c in zip(*own)))

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for n in np.unique(length).tolist():
            at = np.flatnonzero(length == n)
            first, base, times, begin = self.by_length[n]
            row = np.searchsorted(first, number[at], "right") - 1
            k = number[at] - first[row]
            sequence[at] = base[row] + k // times[row]
            offset[at] = begin[row] + n * (k % times[row])
        return sequence, offset


# ---- over documents

_coders: dict[str, object] = {}


def encode(texts: list[str], plain, special: dict[str, int]) -> list[list[int]]:
    """Ids of each text; the strings in ``special`` are one id wherever they stand."""
    if not any(s in t for t in texts for s in special):
        return plain(texts)
    out = []
    for text in texts:
        ids: list[int] = []
        for mark, part in _parts(text, special):
            ids += [special[part]] if mark else plain([part])[0]
        out.append(ids)
    return out


def _parts(text: str, special: dict[str, int]):
    """(is a special string, string) from left to right."""
    while text:
        at, mark = min(((text.find(s), s) for s in special if s in text), default=(len(text), ""))
        if at:
            yield False, text[:at]
        if mark:
            yield True, mark
        text = text[at + len(mark):]


def cut_pieces(docs: DataFrame, vocabulary: str, *, text: str = "text", keep: list[str] | None = None, capacity: int = CAPACITY,
               end: int = END, special: dict[str, int] | None = None, with_ids: bool = False) -> DataFrame:
    """The documents' pieces: columns kept, piece, start, length, ids_crc32; part and rank number a task's pieces of each length."""
    special = SPECIAL if special is None else special
    new = {f.name for f in PIECES}
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    schema = T.StructType([docs.schema[c] for c in kept] + list(PIECES))
    with open(vocabulary, encoding="ascii") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(kept)], F.col(text).alias("text"))

    def run(batches):
        name = hashlib.sha256(sent.value.encode()).hexdigest()
        if name not in _coders:
            _coders[name] = coder(sent.value)
        plain, part, seen = _coders[name], TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                owner, fields = [], ([], [], [], [], [], [])
                for i, ids in enumerate(encode([t or "" for t in some.column("text").to_pylist()], plain, special)):
                    ids.append(end)
                    raw = np.array(ids, "<u4").tobytes()
                    edge = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(edge, edge[1:])):
                        owner.append(i)
                        own = raw[4 * a:4 * b]
                        for to, x in zip(fields, (k, a, b - a, zlib.crc32(own), int(seen[b - a]), own if with_ids else None)):
                            to.append(x)
                        seen[b - a] += 1
                piece, start, length, crc, rank, ids = fields
                at = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(some.column(c).take(at) for c in range(len(kept))), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(owner), pa.int32()),
                     pa.array(rank, pa.int64()), pa.array(ids, pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)


def pack(docs: DataFrame, vocabulary: str, *, capacity: int = CAPACITY, **options) -> DataFrame:
    """The pieces of ``cut_pieces`` with sequence_id (from 0, no gaps) and offset; ``ids`` if ``with_ids``."""
    with scratch_scope(docs.sparkSession):
        pieces = saved(cut_pieces(docs, vocabulary, capacity=capacity, **options), "pack-pieces")
        tasks = saved(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "pack-counts")
        histogram = {r["length"]: r["n"] for r in tasks.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
        sent = docs.sparkSession.sparkContext.broadcast(Places(plan_sequences(histogram, capacity)))
        earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
        before = tasks.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before"))
        kept = [c for c in pieces.columns if c not in ("part", "rank", "ids")] + (["ids"] if options.get("with_ids") else [])
        numbered = pieces.join(before, ["part", "length"]).select(*kept, (F.col("rank") + F.col("__before")).alias("__number"))
        placed = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
        kept = [c for c in kept if c.lower() not in placed.names]
        schema = T.StructType([numbered.schema[c] for c in kept] + list(placed))

        def run(batches):
            for batch in batches:
                found = sent.value.find(batch.column("length").to_numpy(), batch.column("__number").to_numpy())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *map(pa.array, found)], names=schema.names)

        return saved(numbered.mapInArrow(run, schema), "packed", keep=True)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the ids of each sequence (little-endian unsigned 32-bit), of a ``pack`` ``with_ids``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # a sequence's pieces: its capacity at most
    joined = F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))


def least_sequences(histogram: dict[int, int], capacity: int = CAPACITY) -> int:
    """No packing has fewer sequences than this."""
    return math.ceil(sum(n * c for n, c in histogram.items()) / capacity)


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")  # the ranks of byte_bpe_50k.json


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op13: every document's pieces and their places in the packed sequences."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, ranks_path(), keep=["doc_id"])
