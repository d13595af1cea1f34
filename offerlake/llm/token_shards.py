"""Training-order materialisation of token ids in fixed-stride binary shards.

1. Each text's token ids, followed by the end mark, are cut into sequences of
   ``length`` ids; the last one is filled up with end marks.  The sequences are
   written once, in compressed blocks, with the number of their task and their
   place in it.
2. A prefix sum over the tasks' counts numbers all sequences 0..N-1.
3. A keyed Feistel permutation on the smallest even-width binary range that
   holds N, walked until the value is below N, gives each number a slot: a
   bijection of 0..N-1 that needs no sort, no table and no state.
4. Slots are dealt out by ranges: shard s holds slots s * stride to
   (s + 1) * stride - 1 in order.  What a block has for a shard travels as one
   compressed row; the shard's task puts the records in their places (a shard
   has a fixed size) and writes them in one go.  A slot's record stands at byte
   (slot - s * stride) * record of its file, so a reader can go on from any
   slot.  A shard is written under a temporary name and renamed; a repeated
   task writes the same bytes.

Shards are opened with ``pyarrow.fs``, by the URI of the shared folder.

Defined cases: a null or empty text is one sequence of end marks; repeated
rows are sequences of their own; an empty table gives no shard; equal keys
give equal orders.  Needs ids below 2^16.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.session import saved, scratch_path

LENGTH = 256
STRIDE = 32768
#: Sequences that are compressed together.
BLOCK_ROWS = 16384
#: Tasks that write shards at most.
MAX_TASKS = 100_000
ROUNDS = 4
END = 50256
KEY = 0x5EED
_ROWS = "doc_id array<bigint>, chunk array<int>, n_tokens array<int>, ids binary"
PLACES = f"part int, place long, n_rows long, {_ROWS}"
DEALT = f"shard long, slot array<bigint>, {_ROWS}"
WRITTEN = "slot long, shard long, offset long, doc_id long, chunk int, n_tokens int, ids_sha256 string"


def walk_slots(number: np.ndarray, size: int, key: int = KEY, half: int | None = None, rounds: int = ROUNDS) -> np.ndarray:
    """The slot of each number below ``size``."""
    half = half or max(1, ((max(1, size - 1)).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(int.from_bytes(hashlib.blake2b(f"{key}/{r}".encode(), digest_size=8).digest(), "little")) for r in range(rounds)]

    def feistel(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            h = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
            left, right = right, left ^ (h & mask)
        return (left << np.uint64(half)) | right

    x = feistel(number.astype(np.uint64))
    while len(out := np.flatnonzero(x >= np.uint64(size))):
        x[out] = feistel(x[out])
    return x.astype(np.int64)


def coder(ranks: str):
    """A function from texts to lists of ids, of the byte-level vocabulary whose ranks are in ``ranks``."""
    import public_tokenizers
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    own = tiktoken.Encoding("shards", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    return lambda texts: [own.encode_ordinary(t) for t in texts]


_coders: dict[str, object] = {}


def _lists(values: np.ndarray, edge: list[int], kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(values, kind))


def sequences(docs: DataFrame, vocabulary: str, *, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH,
              end: int = END) -> DataFrame:
    """The documents' sequences, in blocks (part, place of the first one, n_rows, doc_id, chunk, n_tokens, ids); written once."""
    with open(vocabulary, encoding="ascii") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        part, place = TaskContext.get().partitionId(), 0
        name = hashlib.sha256(sent.value.encode()).hexdigest()
        if name not in _coders:
            _coders[name] = coder(sent.value)
        held: list[tuple] = []  # (doc_id, chunk, n_tokens, ids) of some documents each

        def block():
            doc, chunk, n, data = (np.concatenate(x) for x in zip(*held))
            held.clear()
            packed = zstandard.ZstdCompressor(level=9).compress(data.tobytes())
            edge = [0, len(doc)]
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([place], pa.int64()), pa.array([len(doc)], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(doc, pa.int64(), from_pandas=True)),
                 _lists(chunk, edge, pa.int32()), _lists(n, edge, pa.int32()), pa.array([packed], pa.binary())],
                names=["part", "place", "n_rows", "doc_id", "chunk", "n_tokens", "ids"])

        rows = 0
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo in range(0, len(doc_ids), 256):
                found = _coders[name]([t or "" for t in texts[lo:lo + 256].to_pylist()])
                whole = np.array([-(-(len(ids) + 1) // length) for ids in found])
                data = np.full(int(whole.sum()) * length, end, "<u2")
                first = np.concatenate(([0], np.cumsum(whole)))
                for ids, at in zip(found, first.tolist()):
                    data[at * length:at * length + len(ids)] = ids
                chunk = np.arange(first[-1]) - np.repeat(first[:-1], whole)
                total = np.repeat([len(ids) for ids in found], whole)
                held.append((np.repeat(np.array(doc_ids[lo:lo + 256], object), whole), chunk, np.clip(total - chunk * length, 0, length), data))
                rows += int(first[-1])
                if rows >= BLOCK_ROWS:
                    yield block()
                    place, rows = place + rows, 0
        if held:
            yield block()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PLACES)
    return saved(rows, "shard-sequences")


def deal(rows: DataFrame, *, length: int = LENGTH, stride: int = STRIDE, key: int = KEY) -> tuple[DataFrame, int]:
    """The blocks of ``sequences`` by shard, with the slot of each sequence; and the number of sequences."""
    counts = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.sum("n_rows").alias("n")).collect())  # a row per task
    first, size = {}, 0
    for part, n in counts:
        first[part] = size
        size += n
    sent = rows.sparkSession.sparkContext.broadcast(first)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                n = row["n_rows"].as_py()
                begin = sent.value[row["part"].as_py()] + row["place"].as_py()
                slot = walk_slots(np.arange(begin, begin + n), size, key)
                data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["ids"].as_buffer()), "<u2").reshape(n, length)
                order = np.argsort(slot)
                shard, at = np.unique(slot[order] // stride, return_index=True)
                edge = [*at.tolist(), n]
                squeeze = zstandard.ZstdCompressor(level=7)
                doc = row["doc_id"].values.take(pa.array(order))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard, pa.int64()), _lists(slot[order], edge, pa.int64()), pa.ListArray.from_arrays(pa.array(edge, pa.int32()), doc),
                     *(pa.ListArray.from_arrays(pa.array(edge, pa.int32()), row[c].values.take(pa.array(order))) for c in ("chunk", "n_tokens")),
                     pa.array([squeeze.compress(data[order[a:b]].tobytes()) for a, b in zip(edge, edge[1:])], pa.binary())],
                    names=["shard", "slot", "doc_id", "chunk", "n_tokens", "ids"])

    return rows.mapInArrow(run, DEALT), size


def write_shards(dealt: DataFrame, size: int, folder: str, *, length: int = LENGTH, stride: int = STRIDE) -> DataFrame:
    """Write the sequences of ``deal`` as shards under the URI ``folder``, a range of shards per task.

    Returns one row per sequence: slot, shard, offset, doc_id, chunk, n_tokens, ids_sha256.
    """
    record = length * 2

    def write(shard: int, rows: list[dict]) -> pa.RecordBatch:
        first = shard * stride
        n = min(stride, size - first)
        data = np.zeros((n, length), "<u2")
        filled = np.zeros(n, bool)
        expand = zstandard.ZstdDecompressor()
        for r in rows:
            at = r["slot"].values.to_numpy() - first
            data[at] = np.frombuffer(expand.decompress(r["ids"].as_buffer()), "<u2").reshape(len(at), length)
            filled[at] = True
        if not filled.all():
            raise ValueError(f"shard {shard}: {int((~filled).sum())} of {n} slots are missing")
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        temporary = posixpath.join(root, f".shard-{shard:08d}-{TaskContext.get().taskAttemptId()}.tmp")
        with fs.open_output_stream(temporary, compression=None) as stream:
            stream.write(data.tobytes())
        fs.move(temporary, posixpath.join(root, f"shard-{shard:08d}.bin"))
        slot = np.concatenate([r["slot"].values.to_numpy() for r in rows])
        digests = [hashlib.sha256(data[s - first].tobytes()).hexdigest() for s in slot.tolist()]
        flat = [pa.concat_arrays([r[c].values for r in rows]) for c in ("doc_id", "chunk", "n_tokens")]
        return pa.RecordBatch.from_arrays(
            [pa.array(slot), pa.array(np.full(len(slot), shard)), pa.array((slot - first) * record), *flat, pa.array(digests)],
            names=["slot", "shard", "offset", "doc_id", "chunk", "n_tokens", "ids_sha256"])

    def run(batches):
        now, rows = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                if (shard := row["shard"].as_py()) != now:
                    if rows:
                        yield write(now, rows)
                    now, rows = shard, []
                rows.append(row)
        if rows:
            yield write(now, rows)

    shards = max(1, -(-size // stride))
    tasks = min(shards, MAX_TASKS)
    # a task gets a range of whole shards, one if there are not too many
    own = F.floor(F.col("shard") * tasks / shards).cast("int")
    return dealt.repartitionById(tasks, own).sortWithinPartitions("shard").mapInArrow(run, WRITTEN)


def read_slots(folder: str, first: int, count: int, *, length: int = LENGTH, stride: int = STRIDE):
    """The ids of slots ``first`` to ``first + count - 1``, one array each, read in sequence."""
    fs, root = pafs.FileSystem.from_uri(folder)
    slot = first
    while slot < first + count:
        shard = slot // stride
        with fs.open_input_file(posixpath.join(root, f"shard-{shard:08d}.bin")) as f:
            f.seek((slot - shard * stride) * length * 2)
            while slot < min(first + count, (shard + 1) * stride):
                raw = f.read(length * 2)
                if len(raw) < length * 2:
                    return
                yield np.frombuffer(raw, "<u2")
                slot += 1


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op3: every document's token sequences in training order, written to shards."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows, size = deal(sequences(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")))
    return write_shards(rows, size, scratch_path(spark, "shards"))
