"""Components, near dedupe and vector search against brute force."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerlake.operators import near, postings, vectors
from offerlake.operators.components import components
from offerlake.operators.corpus import search_text, tf_idf


def roots(links):
    parent = {x: x for link in links for x in link}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    return {x: top(x) for x in parent}


@pytest.mark.parametrize("links", [
    [(i, i + 1) for i in range(60)],  # a chain
    [(0, i) for i in range(1, 80)] + [(200, 79)],  # a star
    [(random.Random(i).randrange(80), random.Random(-i).randrange(80)) for i in range(60)],
    [(5, 5)], []])
def test_components(spark, links):
    got = components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == {k: v for k, v in roots([x for x in links if x[0] != x[1]]).items()}
    text = components(spark.createDataFrame([(f"{a:04d}", f"{b:04d}") for a, b in links], "a string, b string"))
    assert {int(r.node): int(r.root) for r in text.collect()} == {r.node: r.root for r in got.collect()}


def shingles(text):
    words = (text or "").lower().split()
    n = min(5, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if words else set()


def clusters(rows):
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    root = roots(links) if links else {}
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root.get(i, i)
        least[r] = min(least.get(r, (True, 0)), (d is None, d or 0))
    return collections.Counter((d, len(sets[i]), None if least[root.get(i, i)][0] else least[root.get(i, i)][1]) for i, (d, _) in enumerate(rows))


def family(rng, n, length, changes):
    """Texts that are each a few words away from one of the texts before."""
    out = [[f"w{rng.randrange(10**6)}" for _ in range(length)]]
    for _ in range(n - 1):
        own = list(rng.choice(out))
        for _ in range(rng.randrange(changes + 1)):
            own[rng.randrange(length)] = f"x{rng.randrange(10**6)}"
        out.append(own)
    return [" ".join(x) for x in out]


@pytest.mark.parametrize("block_rows", [3, 256])
def test_near_dedupe_equals_brute_force(spark, monkeypatch, block_rows):
    monkeypatch.setattr(near, "BLOCK_ROWS", block_rows)
    rng = random.Random(4)
    texts = family(rng, 60, 80, 2) + family(rng, 30, 150, 5) + family(rng, 20, 40, 1) + family(rng, 25, 100, 9)
    texts += [texts[0]] * 5 + [texts[3].upper().replace(" ", " \t\n")]
    texts += [None, "", "  \n", "one", "One", "two words", "four words are here", "four words are  here", "é x y", "y " * 3000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[1]), (None, "a text without an id that is alone"), (7, texts[7])]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, tag string, n string").repartition(3)
    got = near.near_dedupe(df)
    assert got.columns == ["doc_id", "n_shingles", "cluster_id"]
    assert collections.Counter(tuple(r) for r in got.collect()) == clusters(rows)
    assert near.near_dedupe(df.limit(0)).count() == 0


def test_links_inside_a_bucket_that_miss_its_first_class(spark, monkeypatch):
    """Two families in one bucket: all texts share their band keys, whatever they hold."""
    monkeypatch.setattr(near, "band_keys", lambda sets: np.tile(np.arange(near.BANDS, dtype=np.uint64), (len(sets), 1)))
    monkeypatch.setattr(near, "BLOCK_ROWS", 4)
    rng = random.Random(8)
    texts = family(rng, 12, 60, 1) + family(rng, 9, 60, 1) + family(rng, 1, 60, 1)
    rows = list(enumerate(texts))
    got = near.near_dedupe(spark.createDataFrame(rows, "doc_id long, text string"))
    assert collections.Counter(tuple(r) for r in got.collect()) == clusters(rows)


def test_candidates_reach_the_stated_share():
    """Pairs of sets at 80 to 85 % that have a band key in common."""
    rng = np.random.default_rng(6)
    sets = []
    for _ in range(600):
        own = near._mixed(rng.integers(0, 1 << 62, 110, np.uint64))
        sets += [np.unique(own[:100]), np.unique(own[10:])]  # 90 of 110
    keys = near.band_keys(sets)
    assert (keys[::2] == keys[1::2]).any(1).mean() > 0.995
    assert (keys[:-2:2] == keys[2::2]).any(1).mean() < 0.01  # unrelated ones


def test_drop_near(spark):
    long = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(3, long, "a"), (1, long + " more", "b"), (2, "else", "c")], "doc_id long, text string, z string")
    assert {tuple(r) for r in near.drop_near(df).collect()} == {(1, long + " more", "b"), (2, "else", "c")}


# ---- postings

def test_postings_give_the_same_rows_from_fewer_blocks(spark, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 8)
    rng = random.Random(2)
    vocabulary = [f"t{i}" for i in range(300)]
    chance = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(rng.choices(vocabulary, chance, k=rng.randrange(1, 200)) + ["everywhere"])) for i in range(900)]
    asked = [(f"q{i}", " ".join(rng.choices(vocabulary, k=6))) for i in range(20)]
    asked += [("common", "everywhere"), ("none", "zzz"), ("rare", "t299 everywhere t298"), ("null", None), ("twice", "t5 t5 t6")]
    weights = tf_idf(spark.createDataFrame(docs, "doc_id long, text string"))
    queries = spark.createDataFrame(asked, "item_id string, text string")
    index = postings.PostingsIndex(weights)
    plan = index.plan(queries, k=5)
    want = search_text(weights, queries, k=5)
    assert sorted(map(tuple, index.search(queries, k=5, plan=plan).collect())) == sorted(map(tuple, want.collect()))
    n = plan.agg(F.count(F.lit(1)).alias("all"), F.sum(F.col("read").cast("int")).alias("read")).first()
    print("blocks", n)
    assert 0 < n["read"] < 0.8 * n["all"]


# ---- vectors

def best(rows, queries, k):
    out = []
    m = {i: np.array(v, np.float64) / np.linalg.norm(v) for i, v in rows if i is not None and v is not None and any(v)}
    for q in queries:
        scored = sorted((-int(np.rint(m[q] @ v * 1_000_000)), i) for i, v in m.items())[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return out


@pytest.mark.parametrize("row_block, query_block", [(8192, 1024), (7, 2)])
def test_vector_search_is_exact(spark, monkeypatch, row_block, query_block):
    monkeypatch.setattr(vectors, "ROW_BLOCK", row_block)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", query_block)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(15)]  # ties
    rows += [(2000, [0.0] * 6), (2001, None), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "doc_id long, vec array<double>").repartition(4)
    asked = F.col("doc_id") % 50 == 5
    got = vectors.search_vectors(df, df.where(asked), k=7)
    want = best(rows, sorted(i for i, v in rows if i is not None and i % 50 == 5), 7)
    found = sorted(tuple(r) for r in got.collect())
    assert [r[:3] for r in found] == [r[:3] for r in want]
    assert all(abs(a[3] - b[3]) <= 1 for a, b in zip(found, want))
    assert vectors.search_vectors(df, df.limit(0)).count() == 0


def test_vector_index(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    names = {"item_id": "vec_id", "vector": "embedding"}
    queries = table.where("vec_id % 50 = 0")
    exact = vectors.search_vectors(table, queries, **names).cache()
    index = vectors.VectorIndex(table, **names)
    ids = [x for r in index.blocks.collect() for x in np.frombuffer(r.ids, "<i8").tolist()]
    assert sorted(ids) == sorted(r.vec_id for r in table.select("vec_id").collect())  # every row is in one list
    share = vectors.recall(index.search(queries), exact)
    print("recall", share)
    assert share >= 0.9
    every = index.search(queries, probes=len(index.centroids))
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, exact.collect()))
    none = vectors.VectorIndex(table.limit(0), **names)
    assert none.search(queries).count() == 0
