"""Fill-in-the-middle, prefix trie and packing, each against a brute-force version."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerlake.llm import fill_middle, packing, prefix_trie

DOCS = "doc_id long, text string, n string, form string, piece string, sequence_id string"
LONG = "Über lange Zeilen.\n" * 30_000


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["one line", None, "", "\n", "\n\n\n", "a\nb\n", "a\nb", "Ä\n日本語\n🎉 end\n", LONG, "x" * 150_000, "has <P> a mark",
             "a<\n<S\n>b\n", "same\ntext", "same\ntext", "\r\n\r", "a b" * 700, "<|endoftext|> x <|endoftext|><|endoftext|>"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id\nat all\n"), (3, "\n")]
    return spark.createDataFrame([(*r, "clash", "clash", "clash", "clash") for r in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def counted(df, *cols):
    return collections.Counter(tuple(r) for r in df.select(*cols).collect())


# ---- fill in the middle

def fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(digest[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 50:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_fill_middle(docs, empty):
    got = fill_middle.transform(docs)
    assert got.columns == ["doc_id", "text", "piece", "sequence_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = got.withColumn("again", fill_middle.restore(F.col("output"), F.col("form"))).collect()
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == fim(r.doc_id, r.text)
        assert r.again == (r.text or "")
    assert {r.form for r in got} == {"plain", "psm", "spm"} and len(got) == docs.count()
    assert fill_middle.transform(empty).count() == 0
    assert {r.form for r in fill_middle.transform(docs, rate=0).collect()} == {"plain"}
    with pytest.raises(ValueError):
        fill_middle.transform(docs, marks=("<P>", "<P", "<M>"))


@pytest.mark.parametrize("n", [0, 1, 2, 9, 100, 5000])
def test_skip_list_reaches_every_rank(n):
    rng = np.random.default_rng(n)
    points = rng.integers(1, 40, n)
    n_bytes = points + rng.integers(0, 9, n)
    units = fill_middle.SkipList(n_bytes, points)
    want = list(zip(np.concatenate(([0], np.cumsum(points))).tolist(), np.concatenate(([0], np.cumsum(n_bytes))).tolist()))
    assert [units.seek(r) for r in range(n + 1)] == want
    assert n < 100 or len(units.lanes) > 2
    for r in (-1, n + 1):
        with pytest.raises(IndexError):
            units.seek(r)


# ---- prefix trie

def trie(rows):
    """Brute force: the result rows of op12."""
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            token = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            by[conv].append((turn is not None, turn or 0, token, role, text))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in by.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    members = collections.defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, total = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            total[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return collections.Counter(
        (m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], total[p],
         hashlib.sha256(",".join(str(c) for c in m if len(whole[c]) == len(p)).encode()).hexdigest()) for p, m in members.items())


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def op12(spark, rows, base):
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, name string")
    found = prefix_trie.build_trie(*prefix_trie.rebuilt(df), base=base)
    return counted(found, "seq", "depth", "parent_seq", "n", "children", "leaves", "saved", "ends")


@pytest.mark.parametrize("base", [2, 64])
def test_trie_equals_brute_force(spark, base, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PACK", 3)
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 24), *range(100, 120), 205, 317]:
        for t in range(rng.choice([1, 2, 3, 4, 7, 8, 9, 16])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "", None, "é日"])))
    for c in range(400, 412):  # many alike
        rows += [(c, t, "user", "again" * t) for t in range(8)]
    rows += [(500, None, "user", "null turn"), (500, None, "user", "null turn"), (500, 1, "user", "tie"), (500, 1, "user", "another tie"),
             (None, 1, "user", "no conversation"), (600, 0, None, None)]
    rng.shuffle(rows)
    assert op12(spark, rows, base) == trie(rows)


def test_deep_and_empty_tries(spark):
    deep = [(0, t, "user", str(t % 3)) for t in range(300)] + [(1, t, "user", str(t % 3)) for t in range(296)]
    deep += [(2, t, "user", str(t % 3) if t < 200 else "other") for t in range(256)]
    assert op12(spark, deep, 8) == trie(deep)
    assert not op12(spark, [], 8)


def test_block_names_name_each_prefix_once():
    """Whatever the blocks' length, equal prefixes and only those have equal names."""
    rng = random.Random(3)
    seqs = [[rng.choice([b"a" * 16, b"b" * 16]) for _ in range(rng.randrange(1, 9))] for _ in range(200)]
    names = {}
    for s in seqs:
        for d, name in enumerate(prefix_trie.block_names(s, prefix_trie.ROOT, b"e" + b"".join(s)[:15] if len(s) == 8 else None, 8), 1):
            if d < 8:
                assert names.setdefault(name, tuple(s[:d])) == tuple(s[:d])
    assert len(names) == len({tuple(s[:d]) for s in seqs for d in range(1, len(s) + 1) if d < 8})
    assert prefix_trie.graft_path([[1, 2], [3, 4], [5, 6]]) == [[9, 12], [8, 10], [5, 6]]


# ---- packing

def test_packing(spark, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.no_truncation()
    own.no_padding()
    packed = packing.pack(docs, packing.ranks_path(), with_ids=True)
    assert set(packed.columns) == {"doc_id", "text", "n", "form", "start", "length", "ids_crc32", "piece", "ids", "sequence_id", "offset"}
    rows = packed.collect()
    want = collections.Counter()
    for r in docs.collect():
        ids = [*own.encode(r.text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        for k, a in enumerate([0, *range(first, len(ids), 1024)]):
            b = first if not k else a + 1024
            want[r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length, r.ids))
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    for s, own in by.items():
        at = 0
        for offset, length, _ in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024 and whole[s] == b"".join(bytes(x) for *_, x in sorted(own))
    assert sorted(by) == list(range(len(by)))
    histogram = collections.Counter(r.length for r in rows)
    assert len(by) <= packing.least_sequences(histogram) + 1
    assert packing.pack(empty, packing.ranks_path()).count() == 0


@pytest.mark.parametrize("kind", ["spread", "few", "large", "one", "thirds"])
def test_plan_is_near_its_bound(kind):
    rng = np.random.default_rng(1)
    lengths = {"spread": rng.integers(1, 1025, 20_000), "few": rng.choice([300, 301, 423], 5000), "large": rng.integers(500, 1025, 3000),
               "one": np.ones(7777, int), "thirds": rng.choice([342, 341, 340, 513], 4000)}[kind]
    histogram = {int(k): int(c) for k, c in zip(*np.unique(lengths, return_counts=True))}
    plan = packing.plan_sequences(histogram)
    used = collections.Counter()
    for config, k in plan.items():
        assert sum(n * t for n, t in config) <= 1024 and k > 0
        for n, t in config:
            used[n] += t * k
    assert used == collections.Counter(histogram)
    simple = sum(packing.best_fit(histogram, 1024).values())
    assert sum(plan.values()) <= simple * 1.001 + 1
    assert sum(plan.values()) >= packing.least_sequences(histogram)
    assert packing.plan_sequences({}) == {}


def test_knapsack_equals_search():
    rng = np.random.default_rng(2)
    lengths, value = np.array([3, 5, 8, 13]), rng.random(4)
    best, _ = packing.knapsack(value, lengths, 40)
    for c in range(41):
        want = max(a * value[0] + b * value[1] + d * value[2] + e * value[3]
                   for a in range(14) for b in range(9) for d in range(6) for e in range(4) if 3 * a + 5 * b + 8 * d + 13 * e <= c)
        assert abs(best[c] - want) < 1e-9


def test_ids_equal_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    from offerlake.llm.token_shards import coder

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    with open(packing.ranks_path(), encoding="ascii") as f:
        plain = coder(f.read())
    rng = random.Random(9)
    signs = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000] + list("  \n\n\t<|endoftext|>'s'll 123")
    texts = ["".join(rng.choices(signs, k=60)) for _ in range(3000)] + ["".join(rng.choices(" \n\t 　\u0085​ax1'", k=40)) for _ in range(3000)]
    texts += ["a<|endoftext|>b <|endoftext|>", "<|endoftext|><|endoftext|>", "<|endoftext|"]
    assert packing.encode(texts, plain, packing.SPECIAL) == [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]


# ---- language identification: every learning row counts

def test_language_of_one_fold_is_learned(spark):
    """A language whose only rows are in the fold that calibrates."""
    from offerlake.llm import language_id

    def of(fold, n):
        return [i for i in range(10_000) if zlib.crc32(str(i).encode()) % 5 == fold][:n]

    rows = [(i, f"the quick brown fox jumps over the lazy dog {i}", "en") for f in (1, 2, 3) for i in of(f, 20)]
    rows += [(i, f"zażółć gęślą jaźń i pchnąć w tę łódź jeża {i}", "pl") for i in of(1, 60)[40:]]
    rows += [(of(0, 2)[0], "pchnąć w tę łódź gęślą jaźń", None), (of(0, 2)[1], "the lazy dog jumps over the fox", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs, language_id.learn(docs)).filter("lang IS NULL").collect()}
    assert got == {of(0, 2)[0]: "pl", of(0, 2)[1]: "en"}
