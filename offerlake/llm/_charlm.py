"""Interpolated Kneser-Ney character models: counted by Spark over all texts, stored in sorted hash arrays.

A text is its letters in lower case; each run of other characters is one
blank.  Three blanks stand before it.  Counts of the longest n-grams are
gathered over all given texts, per key (a language, say); continuation counts,
discounts, contexts and probabilities are aggregates and joins of that table.
A model keeps every n-gram.  Its arrays are files in the shared folder, one per
range of hashes, opened with ``pyarrow.fs``; workers read the ranges that they
need and hold a fixed number of them, and the driver holds none of them.
"""

from __future__ import annotations

import posixpath
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlake.llm import _text as X
from offerlake.session import saved, scratch_path, scratch_scope

ORDER = 4
#: Values (n-grams times keys) in one file of a model, and files that a process holds at a time.
RANGE_VALUES, HELD_RANGES = 1 << 17, 32
#: The least probability.
LEAST = 1e-12
_R = np.uint64(0x9E3779B97F4A7C15)
_letters: list[np.ndarray] = []
_held: OrderedDict[tuple[str, int], Table] = OrderedDict()


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def streams(col: pa.Array, order: int = ORDER):
    """Per slice of a text column: first row, last row, characters, and where each row begins and ends in them."""
    col = pc.utf8_lower(col)
    data, starts, ends = X.utf8(col)
    for lo, hi in X.slices(starts, ends):
        buf, begin = X.joined(data, starts[lo:hi], ends[lo:hi])
        code = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        lead = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
        if len(code) != lead[-1]:  # bytes that aren't UTF-8: one row at a time
            parts = [np.frombuffer((data[s:e].tobytes().decode("utf-8", "replace") + " ").encode("utf-32-le"), np.uint32)
                     for s, e in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist())]
            code = np.concatenate(parts)
            at = np.concatenate(([0], np.cumsum([len(p) for p in parts])))[:-1]
        else:
            at = lead[begin]
        letter = letters()[code]
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        chars = np.where(letter, code, np.uint32(32))[keep]
        at = np.concatenate(([0], np.cumsum(keep)))[at]
        chars = np.insert(chars, np.repeat(at, order - 1), np.uint32(32))
        first = at + np.arange(hi - lo) * (order - 1)
        yield lo, hi, chars, first, np.append(first[1:], len(chars))


def hashes(chars: np.ndarray, order: int) -> np.ndarray:
    """Hash of the ``order`` characters from each place."""
    n = len(chars) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    c = chars.astype(np.uint64) + np.uint64(1)
    h = c[:n].copy()
    for k in range(1, order):
        h *= _R
        h += c[k:n + k]
    return h


def whole(first: np.ndarray, last: np.ndarray, size: int, order: int) -> np.ndarray:
    """Places whose n-gram lies within one row."""
    ok = np.ones(max(0, size - order + 1), bool)
    for k in range(1, order):
        at = last - k
        ok[at[(at >= first) & (at < len(ok))]] = False
    return ok


def distinct_grams(chars: np.ndarray, ok: np.ndarray, owner: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, characters and count of each distinct n-gram at the places that are ``ok``, by the places' owners (from 0).

    An n-gram is sorted as one whole number, of its characters' numbers among those of the slice after its owner's;
    where that is too wide, as a row of characters."""
    at = np.flatnonzero(ok)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros((0, order), np.uint32), np.zeros(0, np.int64)
    owner = owner[at]
    seen = np.zeros(int(chars.max()) + 1, bool)
    seen[chars] = True
    alphabet = np.flatnonzero(seen).astype(np.uint32)
    bits = max(1, (len(alphabet) - 1).bit_length())
    width = bits * order + int(owner.max()).bit_length()
    if width > 64:
        rows, c = np.unique(np.column_stack([owner, *(chars[at + j] for j in range(order))]).astype(np.int64), axis=0, return_counts=True)
        return rows[:, 0], rows[:, 1:].astype(np.uint32), c
    kind = np.uint32 if width <= 32 else np.uint64
    number = np.zeros(len(seen), kind)
    number[alphabet] = np.arange(len(alphabet), dtype=kind)
    number = number[chars]
    packed = owner.astype(kind)
    for j in range(order):
        packed = packed << kind(bits) | number[at + j]
    packed, c = np.unique(packed, return_counts=True)
    shifts = [kind(bits * (order - 1 - j)) for j in range(order)]
    grams = np.stack([alphabet[packed >> s & kind((1 << bits) - 1)] for s in shifts], 1)
    whose = packed >> kind(bits * order) if bits * order < 8 * kind().itemsize else np.zeros(len(packed))
    return whose.astype(np.int64), grams, c


def gram_counts(docs: DataFrame, *, text: str = "text", key: str | None = None, split: str | None = None,
                order: int = ORDER) -> DataFrame:
    """(key, gram, c): how often each n-gram of the longest order occurs, over all rows (with a key).  With ``split``,
    a column of whole numbers, (key, split, gram, c): counted for each of them."""
    named = docs.select(F.col(text).alias("text"), (F.col(key) if key else F.lit("")).cast("string").alias("key"),
                        (F.col(split) if split else F.lit(0)).cast("int").alias("split")).filter("key IS NOT NULL AND split IS NOT NULL")

    def run(batches):
        for batch in batches:
            keys, splits = batch.column("key").dictionary_encode(), batch.column("split").dictionary_encode()
            names, numbers = keys.dictionary.to_pylist(), splits.dictionary.to_pylist()
            code = keys.indices.to_numpy().astype(np.int64) * len(numbers) + splits.indices.to_numpy()
            held: list[tuple] = []
            for lo, hi, chars, first, last in streams(batch.column("text"), order):
                ok = whole(first, last, len(chars), order)
                held.append(distinct_grams(chars, ok, np.repeat(code[lo:hi], last - first)[:len(ok)], order))
            owner = np.concatenate([x[0] for x in held]) if held else np.zeros(0, np.int64)
            for k in np.unique(owner).tolist():
                grams = np.concatenate([x[1][x[0] == k] for x in held])
                c = np.concatenate([x[2][x[0] == k] for x in held])
                _, i, back = np.unique(_hash_rows(grams), return_index=True, return_inverse=True)
                flat = np.ascontiguousarray(grams[i], "<u4").tobytes().decode("utf-32-le")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[k // len(numbers)]] * len(i), pa.string()), pa.array([numbers[k % len(numbers)]] * len(i), pa.int32()),
                     pa.array([flat[j:j + order] for j in range(0, len(flat), order)], pa.string()),
                     pa.array(np.bincount(back, weights=c).astype(np.int64), pa.int64())], names=["key", "split", "gram", "c"])

    rows = named.mapInArrow(run, "key string, split int, gram string, c long")
    return rows.groupBy("key", *(["split"] if split else []), "gram").agg(F.sum("c").alias("c"))


class Table:
    """Sorted hashes with a row of values each; a direct index finds most of them at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.shift = np.uint64(64 - max(8, int(len(keys) * 4).bit_length()))
        self.slot = np.zeros(1 << int(64 - int(self.shift)), np.int32)
        if len(keys):
            self.slot[self._slots(self.keys)] = np.arange(len(keys), dtype=np.int32)

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0xD6E8FEB86659FD93)) >> self.shift).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row of each hash, -1 if it isn't there."""
        if not len(self.keys):
            return np.full(len(h), -1, np.int64)
        at = self.slot[self._slots(h)].astype(np.int64)
        miss = np.flatnonzero(self.keys[at] != h)
        if len(miss):
            own = np.minimum(np.searchsorted(self.keys, h[miss]), len(self.keys) - 1)
            at[miss] = np.where(self.keys[own] == h[miss], own, -1)
        return at


class Ranges:
    """Values by hash of an n-gram, in files of one range of hashes each; a process holds the last ones it read."""

    def __init__(self, folder: str, parts: int, full: set[int], width: int):
        self.folder, self.parts, self.full, self.width = folder, parts, full, width

    def part(self, h: np.ndarray) -> np.ndarray:
        return (X.mix(h) % np.uint64(self.parts)).astype(np.int64)

    def _table(self, part: int) -> Table:
        key = self.folder, part
        if key in _held:
            _held.move_to_end(key)
            return _held[key]
        fs, root = pafs.FileSystem.from_uri(self.folder)
        with fs.open_input_file(posixpath.join(root, f"{part:06d}.bin")) as f:
            raw = f.read()
        n = len(raw) // (8 + 4 * self.width)
        table = Table(np.frombuffer(raw, "<u8", n), np.frombuffer(raw, "<f4", n * self.width, 8 * n).reshape(n, self.width))
        _held[key] = table
        while len(_held) > HELD_RANGES:
            _held.popitem(last=False)
        return table

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is there, and its values."""
        if self.parts == 1:
            order, edge = None, [0, len(h)]
        else:  # whole numbers of 16 bits are sorted by their digits
            part = self.part(h)
            order = np.argsort(part.astype(np.uint16) if self.parts <= 1 << 16 else part, kind="stable")
            h, part = h[order], part[order]
            edge = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(h)]
        ok, out = np.zeros(len(h), bool), np.zeros((len(h), self.width), np.float32)
        for lo, hi in zip(edge[:-1], edge[1:]):
            k = int(part[lo]) if self.parts > 1 and hi > lo else 0
            if k in self.full and hi > lo:
                table = self._table(k)
                found = table.find(h[lo:hi])
                ok[lo:hi] = found >= 0
                if len(table.keys):
                    out[lo:hi] = table.values[found]
        out[~ok] = 0
        if order is None:
            return ok, out
        dealt_ok, dealt = np.empty_like(ok), np.empty_like(out)
        dealt_ok[order], dealt[order] = ok, out
        return dealt_ok, dealt


def _write_ranges(rows: DataFrame, name: str, width: int) -> Ranges:
    """``rows`` (gram, x: a value per key) as files of logarithms in the shared folder, a range of hashes per task.

    The files belong to no scratch scope: plans that score with the model read them when they run."""
    spark = rows.sparkSession
    parts = max(1, -(-rows.count() * width // RANGE_VALUES))
    folder = scratch_path(spark, name)
    target = Ranges(folder, parts, set(), width)

    def hashed(batches):
        for batch in batches:
            h = _hash_rows(_characters(batch.column("gram")))
            yield pa.RecordBatch.from_arrays([pa.array(target.part(h).astype(np.int32)), pa.array(h.view(np.int64)), batch.column("x")],
                                             names=["part", "h", "x"])

    def write(batches):
        held = [(b.column("part").to_numpy(), b.column("h").to_numpy(), b.column("x").flatten().to_numpy().reshape(-1, width))
                for b in batches if b.num_rows]
        if not held:
            return
        part, h, x = (np.concatenate(c) for c in zip(*held))
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        own = np.unique(part)
        for k in own.tolist():
            at = np.flatnonzero(part == k)
            at = at[np.argsort(h[at].view(np.uint64))]
            temporary = posixpath.join(root, f".{k:06d}-{TaskContext.get().taskAttemptId()}.tmp")
            with fs.open_output_stream(temporary, compression=None) as stream:
                stream.write(h[at].astype("<i8").tobytes())
                stream.write(np.log(np.maximum(x[at], LEAST)).astype("<f4").tobytes())
            fs.move(temporary, posixpath.join(root, f"{k:06d}.bin"))
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32())], names=["part"])

    dealt = rows.select("gram", "x").mapInArrow(hashed, "part int, h long, x array<double>").repartitionById(parts, F.col("part"))
    target.full = {r[0] for r in dealt.mapInArrow(write, "part int").collect()}
    return target


class Model:
    """Probabilities of a character after its context, for each key."""

    def __init__(self, names: list[str], floor: float, rest: np.ndarray, grams: list[Ranges], contexts: list[Ranges | None]):
        """``grams[k]``: of order k + 1; ``contexts[k]``: what the contexts of that order leave to the next lower one
        (``rest`` for the empty context)."""
        self.names, self.order, self.floor = names, len(grams), floor
        self.rest, self.grams, self.contexts = np.log(rest).astype(np.float32), grams, contexts

    def _rest(self, ctx: np.ndarray, k: int) -> np.ndarray:
        if k == 0:
            return np.repeat(self.rest[None], len(ctx), 0)
        return self.contexts[k].look(_hash_rows(ctx))[1]  # 0, all of it, for an unknown context

    def _log(self, chars: np.ndarray, size: int) -> np.ndarray:
        """Of the last of ``size`` characters after the others, by key."""
        if size == 0:
            return np.full((len(chars), len(self.names)), np.log(self.floor), np.float32)
        ok, out = self.grams[size - 1].look(_hash_rows(chars))
        miss = np.flatnonzero(~ok)
        if len(miss):
            out[miss] = self._rest(chars[miss, :-1], size - 1) + self._log(chars[miss, 1:], size - 1)
        return out

    def log_probability(self, chars: np.ndarray) -> np.ndarray:
        """Logarithms for each row of ``order`` characters, by key."""
        return np.maximum(self._log(chars, chars.shape[1]), np.log(LEAST))

    def entropies(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Per row: cross-entropy per character under each key, number of characters that it is taken over."""
        total = np.zeros((len(col), len(self.names)))
        count = np.zeros(len(col), np.int64)
        n = self.order
        for lo, hi, chars, first, last in streams(col, n):
            at = np.flatnonzero(whole(first, last, len(chars), n))
            if not len(at):
                continue
            ok, logs = self.grams[-1].look(hashes(chars, n)[at])
            miss = np.flatnonzero(~ok)
            if len(miss):
                logs[miss] = self.log_probability(np.stack([chars[at[miss] + j] for j in range(n)], 1))
            edge = np.searchsorted(at, np.append(first, len(chars)))  # where each row's places begin, and the end
            row = np.flatnonzero(np.diff(edge))
            total[lo + row] = np.add.reduceat(logs, edge[row], axis=0, dtype=np.float64)
            count[lo + row] = np.diff(edge)[row]
        return -total / np.maximum(count, 1)[:, None], count


def _hash_rows(chars: np.ndarray) -> np.ndarray:
    h = np.zeros(len(chars), np.uint64)
    for k in range(chars.shape[1]):
        h = (h * _R if k else h) + chars[:, k].astype(np.uint64) + np.uint64(1)
    return h


def _characters(grams: pa.Array) -> np.ndarray:
    """N-grams of one length as rows of characters."""
    flat = np.frombuffer("".join(grams.to_pylist()).encode("utf-32-le"), np.uint32)
    return flat.reshape(len(grams), -1)


def _by_key(rows: DataFrame, name: str, names: list[str], default: float) -> DataFrame:
    """(name, x): the x of each key in the order of ``names``."""
    wide = rows.groupBy(name).agg(F.map_from_entries(F.collect_list(F.struct("key", "x"))).alias("m"))
    keys = F.array(*[F.lit(n) for n in names])
    return wide.select(name, F.transform(keys, lambda k: F.coalesce(F.element_at("m", k), F.lit(default))).alias("x"))


def fit(docs: DataFrame, *, order: int = ORDER, **options) -> Model | None:
    """The model of the texts in ``docs`` (``text``), one set of probabilities per value of ``key``; None without
    any n-gram.  Options: text, key, order."""
    return fit_counts(gram_counts(docs, order=order, **options), order=order)


def fit_counts(counts: DataFrame, *, order: int = ORDER) -> Model | None:
    """The model of counted n-grams (key, gram, c: a row per key and n-gram of the longest order); None without any."""
    with scratch_scope(counts.sparkSession):
        return _fit(counts, order)


def _fit(counts: DataFrame, order: int) -> Model | None:
    level = saved(counts, "charlm-grams")
    names = sorted(r[0] for r in level.select("key").distinct().collect())
    if not names:
        return None
    shares, rests = [], []
    for k in range(order, 0, -1):
        ones = level.groupBy("key").agg(F.sum(F.when(F.col("c") == 1, 1).otherwise(0)).alias("n1"),
                                        F.sum(F.when(F.col("c") == 2, 1).otherwise(0)).alias("n2")).collect()
        discount = {r["key"]: (r["n1"] / (r["n1"] + 2 * r["n2"]) if r["n1"] and r["n2"] else 0.5) for r in ones}
        d = F.element_at(F.create_map(*[F.lit(x) for kv in discount.items() for x in kv]), F.col("key"))
        ctx = level.groupBy("key", F.substring("gram", 1, k - 1).alias("ctx")).agg(
            F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds"))
        ctx = saved(ctx, "charlm-contexts")
        share = level.withColumn("ctx", F.substring("gram", 1, k - 1)).join(ctx.select("key", "ctx", "total"), ["key", "ctx"])
        shares.append(_by_key(share.select("key", "gram", ((F.col("c") - d) / F.col("total")).alias("x")), "gram", names, 0.0))
        rests.append(_by_key(ctx.select("key", "ctx", (d * F.col("kinds") / F.col("total")).alias("x")), "ctx", names, 1.0))
        if k > 1:
            level = saved(level.groupBy("key", F.substring("gram", 2, k - 1).alias("gram")).agg(F.count(F.lit(1)).alias("c")), "charlm-grams")
    shares, rests = shares[::-1], rests[::-1]
    floor = 1 / (level.select("gram").distinct().count() + 1)
    rest = np.array(rests[0].first()["x"])
    # from the shortest n-grams up: share + rest of the context * probability after the shorter context
    add = F.zip_with("x", F.zip_with("r", "low", lambda r, low: r * low), lambda x, y: x + y).alias("x")
    below = saved(shares[0].withColumns({"r": F.array(*[F.lit(float(v)) for v in rest]), "low": F.array_repeat(F.lit(floor), len(names))})
                  .select("gram", add), "charlm-model")
    grams, contexts = [_write_ranges(below, "charlm-ranges", len(names))], [None]
    for k in range(2, order + 1):
        left = saved(rests[k - 1], "charlm-rests")
        own = shares[k - 1].withColumns({"ctx": F.substring("gram", 1, k - 1), "end": F.substring("gram", 2, k - 1)})
        own = own.join(left.select("ctx", F.col("x").alias("r")), "ctx").join(
            below.select(F.col("gram").alias("end"), F.col("x").alias("low")), "end")
        below = saved(own.select("gram", add), "charlm-model")
        grams.append(_write_ranges(below, "charlm-ranges", len(names)))
        contexts.append(_write_ranges(left.withColumnRenamed("ctx", "gram"), "charlm-ranges", len(names)))
    return Model(names, floor, rest, grams, contexts)
