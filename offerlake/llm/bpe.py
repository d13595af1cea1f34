"""Byte-level BPE encoding and decoding.

A word's bytes are a doubly linked list of symbols; a priority queue holds the
merge rank of each neighbouring pair.  The lowest rank (leftmost on ties) is
merged, its neighbours' new pairs are queued, and an entry whose symbols have
changed meanwhile is stale and skipped.  Long words cost n log n.  Decoding
joins the vocabulary strings of the ids.

Every worker keeps the ids of words it has met in a bounded table: a word is
merged once, then looked up.

The vocabulary file is a parameter (a ``tokenizers`` JSON file); the driver
reads it and broadcasts its text once (a file of fixed size).

Defined cases: a null or empty text has no ids and decodes to the empty text;
repeated rows are encoded each; an empty table gives an empty one.  Input
columns named like an added one are replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlake.llm import _text as X

#: Words kept per worker before the table starts anew (about 100 bytes each).
TABLE_WORDS = 400_000

# Fixed value: how the vocabulary's byte-level pre-tokeniser cuts a text.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
           r"| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")

ENCODED = T.StructType([
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()),
])
IDS = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType()))])


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 bytes stand for themselves, the rest for the characters
    from U+0100 on, in byte order.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class ByteBPE:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, text: str):
        spec = json.loads(text)
        vocab: dict[str, int] = spec["model"]["vocab"]
        char = byte_characters()
        byte = {c: b for b, c in enumerate(char)}
        self.byte_id = [vocab[c] for c in char]
        self.strings: dict[int, bytes] = {i: bytes(byte[c] for c in s) for s, i in vocab.items()}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merge[vocab[a], vocab[b]] = rank, vocab[a + b]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.strings |= {i: s.encode() for s, i in self.added.items()}
        self.words = regex.compile(PATTERN).findall
        longest_first = sorted(self.added, key=len, reverse=True)
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")").split if self.added else None
        self.table: dict[str, bytes] = {}

    def merge_word(self, raw: bytes) -> list[int]:
        """The ids of one word."""
        ids = [self.byte_id[b] for b in raw]
        n, merge = len(ids), self.merge
        if n < 2:
            return ids
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        queue = [(merge[pair][0], i, *pair) for i, pair in enumerate(zip(ids, ids[1:])) if pair in merge]
        heapq.heapify(queue)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i] if ids[i] == left else n
            if j >= n or ids[j] != right:
                continue  # stale: one of the two symbols has been merged meanwhile
            new = merge[left, right][1]
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (found := merge.get((new, ids[k]))) is not None:
                    heapq.heappush(queue, (found[0], i, new, ids[k]))
            h = before[i]
            if h >= 0 and (found := merge.get((ids[h], new))) is not None:
                heapq.heappush(queue, (found[0], h, ids[h], new))
        return [x for x in ids if x >= 0]

    def _look_up(self, word: str) -> bytes:
        out = np.array(self.merge_word(word.encode("utf-8", "replace")), "<u4").tobytes()
        if len(word) <= 64:
            if len(self.table) >= TABLE_WORDS:
                self.table.clear()
            self.table[word] = out
        return out

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.split_added is not None and any(t in text for t in self.added):
            parts = self.split_added(text)
            return b"".join(np.array([self.added[p]], "<u4").tobytes() if i % 2 else self._encode(p)
                            for i, p in enumerate(parts))
        return self._encode(text)

    def _encode(self, text: str) -> bytes:
        words = self.words(text)
        known = list(map(self.table.get, words))
        if None in known:
            known = [k if k is not None else self.table.get(w) or self._look_up(w) for k, w in zip(known, words)]
        return b"".join(known)

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the text that the ids stand for; bytes that aren't UTF-8 become U+FFFD."""
        raw = b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()


_built: dict[str, ByteBPE] = {}


def _coder(sent) -> ByteBPE:
    """The worker's coder of a broadcast vocabulary; it and its table outlive the task."""
    text = sent.value
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _built:
        _built.clear()
        _built[key] = ByteBPE(text)
    return _built[key]


def _send(docs: DataFrame, vocabulary: str):
    with open(vocabulary, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode_ids(docs: DataFrame, vocabulary: str, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``ids``, the token ids of each text."""
    sent = _send(docs, vocabulary)

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        coder = _coder(sent)
        parts = [coder.encode(t or "") for t in batch.column(text).to_pylist()]
        at = np.concatenate(([0], np.cumsum([len(p) // 4 for p in parts]))).astype(np.int32)
        values = pa.array(np.frombuffer(b"".join(parts), "<u4").astype(np.int32), pa.int32())
        return [pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)]

    return X.add_columns(docs, compute, IDS, keep)


def decode_ids(docs: DataFrame, vocabulary: str, *, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``decoded``, the text that ``ids`` stand for (null ids: empty)."""
    sent = _send(docs, vocabulary)

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        coder = _coder(sent)
        return [pa.array([coder.decode(np.array(x or [], "<u4").tobytes()).decode()
                          for x in batch.column(ids).to_pylist()], pa.string())]

    return X.add_columns(docs, compute, T.StructType([T.StructField("decoded", T.StringType())]), keep)


def encode_digests(docs: DataFrame, vocabulary: str, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the number of ids of each text and digests of the ids and of the text decoded from them."""
    sent = _send(docs, vocabulary)

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        coder = _coder(sent)
        n, ids_hash, text_hash = [], [], []
        for value in batch.column(text):
            ids = coder.encode(value.as_py() or "")
            n.append(len(ids) // 4)
            ids_hash.append(hashlib.sha256(ids).hexdigest())
            text_hash.append(hashlib.sha256(coder.decode(ids)).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]

    return X.add_columns(docs, compute, ENCODED, keep)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op2: per document, its ids and the text decoded from them, as digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_digests(docs, vocabulary_path(), keep=["doc_id"])
