"""Secret scan: fixed base rules, and a character convolutional network over every candidate.

Base rules (leftmost non-overlapping per kind): assign, access, hex.  A
candidate is a run of 16 or more of `[A-Za-z0-9+/_.=-]`, or of 8 or more with a digit; the
network sees 48 characters at a time and the text around them, as character
classes: what lies outside the base spans, longer parts by windows that overlap
by half.  Accepted windows that overlap become one span.  It is trained in numpy on labelled findings: the windows of every
candidate, 1 if they hold half of a base rule's value (or lie half within it), 0 if no
base span touches them, others unused.  Half of both kinds, by hash, are
seen without the text around them, positive ones as the value alone: so the network learns the look
of a key, not of the rules' keywords.  It learns from every distinct finding but the quarter that
is held out by hash: the findings are dealt by hash into shards of about ``SHARD_ROWS``, each
shard trains an epoch in its own task from the shared weights, and the weights and
moments of all shards are averaged.  Scores are calibrated on all findings held out, counted in
steps of ``STEP`` of the logit, where the threshold is set, too: half way between the lowest score that the
wanted recall needs and the next one below it.  Candidates outside the base spans that reach it become
spans of kind ``cnn``; base spans always stay.

The assign rule needs one of its keywords, so only texts with a keyword and
a sign after it are matched; the other rules lie within runs of the
candidates' characters.

Defined cases: null and empty texts have no spans; repeated rows are scanned
each; without findings of both kinds there is no network and only base spans;
an empty table gives an empty one.  Offsets are code points, end exclusive.
"""

from __future__ import annotations

import copy
import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlake.llm import _text as X
from offerlake.session import saved, scratch_scope

# The base rules.
KEYWORDS = "password|passwd|secret|token|api_?key"
ASSIGN = re.compile(rf"((?i:{KEYWORDS}))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "cnn")
ASSIGN_MIN = 6

#: Findings that a task trains on (about), rounds of training, width of a step of logits.
SHARD_ROWS, EPOCHS, STEP = 8192, 6, 1e-3
RECALL = 0.98
CANDIDATE_MIN = 16
#: Shorter runs of this length are candidates if they hold a digit.
SHORT_MIN = 8
BEFORE, HEAD, AFTER = 24, 48, 8
WIDTH = BEFORE + HEAD + AFTER

_TOKEN_BYTE = np.zeros(256, bool)
_TOKEN_BYTE[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"]] = True
_DIGIT_BYTE = np.zeros(256, bool)
_DIGIT_BYTE[0x30:0x3A] = True
_GATE = rf"(?i)({KEYWORDS})[\"']?\x20*[:=]"

# Character classes: 0 is no character, letters and digits of hexadecimal numbers apart from the others.
_CLASS = np.full(256, 1, np.uint8)
for _i, _chars in enumerate(("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", " ", "\n\r\t",
                             "\"'", ":", "=", "+/", "_", "-", ".", ",;", "@", "|", "()[]{}<>"), 2):
    _CLASS[[ord(c) for c in _chars]] = _i
_CLASS[0x80:] = 20
CLASSES = 21


class Network:
    """Embedding, one convolution, maximum over places, one logistic output."""

    def __init__(self, seed: int = 7, depth: int = 12, filters: int = 24, span: int = 5):
        rng = np.random.default_rng(seed)
        self.span = span
        # two embeddings: of characters within the candidate and around it
        self.w = {"e": rng.normal(0, 0.3, (2 * CLASSES, depth)), "k": rng.normal(0, 0.15, (span * depth, filters)),
                  "c": np.zeros(filters), "o": rng.normal(0, 0.1, filters), "b": np.zeros(1)}
        self.m, self.v = ({k: np.zeros_like(a) for k, a in self.w.items()} for _ in range(2))
        self.steps = 0
        self.slope, self.shift, self.threshold = 1.0, 0.0, 2.0
        self.measured: dict = {}  # recall and precision of the threshold on the findings held out

    def _forward(self, x: np.ndarray):
        e = self.w["e"][x]
        n, length, depth = e.shape
        places = length - self.span + 1
        view = np.lib.stride_tricks.sliding_window_view(e, self.span, axis=1).transpose(0, 1, 3, 2).reshape(n, places, -1)
        z = view @ self.w["k"] + self.w["c"]
        at = z.argmax(1)
        top = np.take_along_axis(z, at[:, None, :], 1)[:, 0]
        pooled = np.maximum(top, 0)
        return pooled @ self.w["o"] + self.w["b"][0], (x, view, at, top, pooled)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i:i + 512])[0] for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores."""
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logit(x) + self.shift, -30, 30)))

    def epoch(self, x: np.ndarray, y: np.ndarray, seed: int, batch: int = 64, rate: float = 0.01):
        """One pass of Adam steps over the rows."""
        order = np.random.default_rng(seed).permutation(len(x))
        for i in range(0, len(x), batch):
            rows = order[i:i + batch]
            grads = self._gradient(x[rows], y[rows])
            self.steps += 1
            for k, g in grads.items():
                self.m[k] = 0.9 * self.m[k] + 0.1 * g
                self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
                self.w[k] = self.w[k] - rate * (self.m[k] / (1 - 0.9 ** self.steps)) / (np.sqrt(self.v[k] / (1 - 0.999 ** self.steps)) + 1e-8)

    def state(self) -> np.ndarray:
        """Weights and moments in one array."""
        return np.concatenate([d[k].ravel() for d in (self.w, self.m, self.v) for k in sorted(d)])

    def take(self, state: np.ndarray, steps: int):
        """The weights and moments of ``state``, after so many steps."""
        at, self.steps = 0, steps
        for d in (self.w, self.m, self.v):
            for k in sorted(d):
                d[k] = state[at:at + d[k].size].reshape(d[k].shape).copy()
                at += d[k].size

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        out, (x, view, at, top, pooled) = self._forward(x)
        d = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y) / len(y)
        d_top = d[:, None] * self.w["o"] * (top > 0)
        picked = np.take_along_axis(view, at[:, :, None], 1)  # the window that each filter chose
        depth = self.w["e"].shape[1]
        e = np.zeros_like(self.w["e"])
        back = (d_top[:, :, None] * self.w["k"].T[None]).reshape(len(x), -1, self.span, depth)
        chars = np.take_along_axis(x[:, None, :], at[:, :, None] + np.arange(self.span), 2)
        np.add.at(e, chars.reshape(-1), back.reshape(-1, depth))
        return {"e": e, "k": np.einsum("nfj,nf->jf", picked, d_top), "c": d_top.sum(0), "o": pooled.T @ d, "b": np.array([d.sum()])}

    def calibrate(self, z: np.ndarray, y: np.ndarray, n: np.ndarray):
        """Platt's scaling on logits, labels, and the number of held-out findings that have them."""
        # targets a little inside (0, 1), so that separable findings have a finite scale
        good, bad = n[y > 0].sum(), n[y == 0].sum()
        t = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
        middle = np.average(z, weights=n)
        spread = np.sqrt(np.average((z - middle) ** 2, weights=n)) + 1e-9
        u = (z - middle) / spread

        def loss(w):
            a = u * w[0] + w[1]
            return (n * (np.logaddexp(0, a) - t * a)).sum() + 1e-4 * (w @ w)

        w = np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(u * w[0] + w[1], -30, 30)))
            g = np.array([(n * (p - t) * u).sum(), (n * (p - t)).sum()]) + 2e-4 * w
            s = n * (p * (1 - p) + 1e-9)
            h = np.array([[(s * u * u).sum(), (s * u).sum()], [(s * u).sum(), s.sum()]]) + 2e-4 * np.eye(2)
            step, now = np.linalg.solve(h, g), loss(w)
            # a whole Newton step overshoots where the findings are separable
            scale = next((k for k in 0.5 ** np.arange(20) if loss(w - k * step) < now), 0.0)
            w = w - scale * step
        if w[0] > 0:
            self.slope, self.shift = float(w[0] / spread), float(w[1] - w[0] * middle / spread)


def _sample_key(raw: bytes, s: int, e: int) -> int:
    """Hash of a candidate with its context: copies of one finding are one finding."""
    return int.from_bytes(hashlib.blake2b(raw[max(0, s - BEFORE):e + AFTER], digest_size=8).digest(), "big", signed=True)


def _window(raw: bytes, s: int, e: int) -> bytes:
    """Character classes of the text before a candidate, of its first characters, and after it."""
    before = _CLASS[np.frombuffer(raw[max(0, s - BEFORE):s], np.uint8)]
    head = _CLASS[np.frombuffer(raw[s:min(e, s + HEAD)], np.uint8)] + CLASSES
    after = _CLASS[np.frombuffer(raw[e:e + AFTER], np.uint8)]
    out = np.zeros(WIDTH, np.uint8)
    out[BEFORE - len(before):BEFORE] = before
    out[BEFORE:BEFORE + len(head)] = head
    out[BEFORE + HEAD:BEFORE + HEAD + len(after)] = after
    return out.tobytes()


def base_spans(raw: bytes, runs: list[tuple[int, int]], assigned: bool) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of the base rules' findings; ``runs``: runs of 16 or more candidate characters."""
    out = []
    if assigned:
        text = raw.decode("latin-1")  # one character per byte: the rules' characters are ASCII
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_MIN]
    for s, e in runs:
        if e - s >= 20:
            part = raw[s:e].decode("latin-1")
            out += [(s + m.start(), 1, s + m.end()) for m in ACCESS.finditer(part)]
            out += [(s + m.start(), 2, s + m.end()) for m in HEX.finditer(part)]
    return sorted(out)


def _texts(col: pa.Array):
    """(row, bytes, runs, candidates, base spans) of the rows that have any."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    gate = pc.fill_null(pc.match_substring_regex(col, _GATE), False).to_numpy(zero_copy_only=False)
    data, starts, ends = X.utf8(col)
    for lo, hi in X.slices(starts, ends):
        buf, begin = X.joined(data, starts[lo:hi], ends[lo:hi])
        s, e = X.runs(_TOKEN_BYTE[buf])
        long = e - s >= SHORT_MIN
        s, e = s[long], e[long]
        digits = np.concatenate(([0], np.cumsum(_DIGIT_BYTE[buf])))
        some = (e - s >= CANDIDATE_MIN) | (digits[e] > digits[s])
        s, e = s[some], e[some]
        row = np.searchsorted(begin, s, "right") - 1
        for r in np.unique(np.concatenate([row, np.flatnonzero(gate[lo:hi])])).tolist():
            a, b = np.searchsorted(row, [r, r + 1])
            raw = data[starts[lo + r]:ends[lo + r]].tobytes()
            off = int(begin[r])
            runs = [(x - off, y - off) for x, y in zip(s[a:b].tolist(), e[a:b].tolist())]
            yield lo + r, raw, runs, base_spans(raw, runs, bool(gate[lo + r]))


_KEY = re.compile(rb"[A-Za-z_]+[\"']?\x20*[:=]\x20*[\"']?")


def _values(raw: bytes, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What the base spans hold, without the key of an assignment."""
    return [(_KEY.match(raw, s, e).end() if kind == 0 else s, e) for s, kind, e in base]


def _label(window: tuple[int, int], base: list[tuple[int, int, int]], values: list[tuple[int, int]]):
    """(label, what a positive one shows of the value); None for a window that holds too little of a value, or a key only."""
    s, e = window
    for a, b in values:
        common = min(e, b) - max(s, a)
        if common > 0 and 2 * common >= min(e - s, b - a):
            return 1, (max(s, a), min(e, b))
    return None if any(a < e and s < b for a, _, b in base) else (0, window)


def open_windows(candidate: tuple[int, int], base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What the network sees of a candidate: its parts outside the base spans, longer ones as overlapping windows of HEAD."""
    out, at = [], candidate[0]
    for s, _, e in [*base, (candidate[1], 0, candidate[1])]:
        s = min(s, candidate[1])
        if s - at >= CANDIDATE_MIN or (at, s) == candidate:
            last = max(at, s - HEAD)
            out += [(a, min(a + HEAD, s)) for a in [*range(at, last, HEAD // 2), last]]
        at = max(at, e)
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def labelled_findings(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """(key, label, seen) of every window of every candidate that has a label; key orders a sample."""

    def run(batches):
        for batch in batches:
            keys, labels, windows = [], [], []
            for _, raw, candidates, base in _texts(batch.column(0)):
                values = _values(raw, base)
                for w in (w for c in candidates for w in open_windows(c, [])):
                    if (told := _label(w, base, values)) is None:
                        continue
                    key = _sample_key(raw, *w)
                    bare = key & 1
                    windows.append(_window(raw[told[1][0]:told[1][1]], 0, told[1][1] - told[1][0]) if bare else _window(raw, *w))
                    labels.append(told[0])
                    keys.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(labels, pa.int32()), pa.array(windows, pa.binary())],
                                             names=["key", "label", "seen"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "key long, label int, seen binary")


def _findings(table) -> tuple[np.ndarray, np.ndarray]:
    """Character classes and labels of findings."""
    seen = table.column("seen").to_pylist()
    return np.frombuffer(b"".join(seen), np.uint8).reshape(len(seen), WIDTH).astype(np.int64), table.column("label").to_numpy().astype(float)


def _round(dealt: DataFrame, net: Network, epoch: int) -> None:
    """One epoch of every shard from the weights of ``net``, which takes their average."""
    sent = dealt.sparkSession.sparkContext.broadcast(net)

    def run(part: pa.Table) -> pa.Table:
        own = copy.deepcopy(sent.value)
        x, y = _findings(part.sort_by([("label", "ascending"), ("key", "ascending"), ("seen", "ascending")]))
        own.epoch(x, y, seed=11 + epoch)
        return pa.table({"shard": [part.column("shard")[0].as_py()], "n": [len(y)], "steps": [own.steps], "state": [own.state().tobytes()]})

    # a row of the network's size per shard
    parts = sorted(tuple(r) for r in dealt.groupBy("shard").applyInArrow(run, "shard long, n long, steps long, state binary").collect())
    states = np.stack([np.frombuffer(p[3]) for p in parts])
    net.take(np.average(states, axis=0, weights=[p[1] for p in parts]), max(p[2] for p in parts))


def _logits(findings: DataFrame, net: Network) -> DataFrame:
    """(label, z) of findings."""
    sent = findings.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for batch in batches:
            x, y = _findings(batch)
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(sent.value.logit(x))], names=["label", "z"])

    return findings.select("label", "seen").mapInArrow(run, "label int, z double")


def _set_threshold(scored: DataFrame, net: Network, recall: float) -> None:
    """Calibrate on every finding of ``scored`` (label, z); the highest threshold that keeps ``recall`` of the positive ones."""
    steps = scored.groupBy("label", F.rint(F.col("z") / STEP).cast("long").alias("step")).agg(
        F.count(F.lit(1)).alias("n"), F.min("z").alias("low"), F.max("z").alias("high")).orderBy("label", "step").toArrow()
    y, step, n, low, high = (steps.column(c).to_numpy() for c in ("label", "step", "n", "low", "high"))
    net.calibrate(step * STEP, y, n.astype(float))
    total = int(n[y > 0].sum())
    at = np.searchsorted(np.cumsum(n[y > 0]), int((1 - recall) * total), "right")
    # between the lowest finding that must stay and the next lower one: the same findings pass, new ones have room
    lowest = low[y > 0][at]
    ends = np.concatenate([low, high])
    cut = float((lowest + max(ends[ends < lowest], default=lowest)) / 2)
    net.threshold = float(1 / (1 + np.exp(-np.clip(net.slope * cut + net.shift, -30, 30))))
    taken = {r["label"]: r["n"] for r in scored.where(F.col("z") >= cut).groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    net.measured = {"rows": int(n.sum()), "positive": total, "recall": taken.get(1, 0) / total,
                    "precision": taken.get(1, 0) / max(1, sum(taken.values()))}


def train_network(docs: DataFrame, *, text: str = "text", recall: float = RECALL) -> Network | None:
    """The network trained on every distinct finding of ``docs``, but a quarter by hash, on which it is calibrated."""
    with scratch_scope(docs.sparkSession):
        found = saved(labelled_findings(docs, text=text).distinct(), "secret-findings")
        held = F.pmod(F.xxhash64("key"), F.lit(4)) == 3
        count = {(r[0], r[1]): r[2] for r in found.groupBy("label", held).count().collect()}
        if len({label for label, _ in count}) < 2:
            return None
        learned = found.where(~held) if len(count) == 4 else found
        rows = sum(n for (_, out), n in count.items() if len(count) < 4 or not out)
        shards = -(-rows // SHARD_ROWS)
        dealt = learned.withColumn("shard", F.pmod(F.xxhash64("key", F.lit("shard")), F.lit(shards)))
        net = Network()
        for epoch in range(EPOCHS):
            _round(dealt, net, epoch)
        _set_threshold(saved(_logits(found.where(held) if len(count) == 4 else found, net), "secret-logits"), net, recall)
    return net


SPANS = T.StructType([
    T.StructField("n_assign", T.LongType()), T.StructField("n_access", T.LongType()), T.StructField("n_hex", T.LongType()),
    T.StructField("base", T.StringType()), T.StructField("spans", T.StringType()),
])


def scan_secrets(docs: DataFrame, net: Network | None, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with n_assign, n_access, n_hex, base and spans (kind:start:end, comma-joined)."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        model = sent.value
        n = batch.num_rows
        counts = np.zeros((3, n), np.int64)
        base_text, all_text = [""] * n, [""] * n
        rows = list(_texts(batch.column(text)))
        open_ = [(i, c) for i, (_, _, cand, base) in enumerate(rows) for x in cand for c in open_windows(x, base)]
        if model is not None and open_:
            x = np.stack([np.frombuffer(_window(rows[i][1], *c), np.uint8) for i, c in open_]).astype(np.int64)
            accepted = np.flatnonzero(model.probability(x) >= model.threshold).tolist()
        else:
            accepted = []
        more: dict[int, list] = {}
        for k in accepted:
            i, c = open_[k]
            more.setdefault(i, []).append(c)
        for i, (r, raw, _, base) in enumerate(rows):
            spans = sorted(base + [(s, 3, e) for s, e in _merged(more.get(i, []))])
            if not spans:
                continue
            # bytes to code points
            point = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
            told = [(f"{KINDS[k]}:{point[s]}:{point[e]}", k) for s, k, e in spans]
            base_text[r] = ",".join(x for x, k in told if k < 3)
            all_text[r] = ",".join(x for x, _ in told)
            for _, k in told:
                if k < 3:
                    counts[k, r] += 1
        return [*(pa.array(c, pa.int64()) for c in counts), pa.array(base_text), pa.array(all_text)]

    return X.add_columns(docs, compute, SPANS, keep)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op10: per document, the secrets found in it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_secrets(docs, train_network(docs), keep=["doc_id"])
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")
