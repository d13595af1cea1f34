"""N-gram Jaccard join: a blocked sparse product of the document by n-gram matrix.

Words are `[^\\x20\\x09-\\x0D]+` after A-Z are lower-cased.  A document's row of
the matrix is its set of distinct 3-word shingles (64-bit hashes); a text of
one or two words has its word sequence as its only shingle.  Two documents
link when 100 * intersection >= 90 * union.

1. Documents with equal sets form one class; from here on a class is one row.
2. Size-derived bound on the columns: of a row with n shingles, at most p - 1 =
   n - ceil(0.9 n) are missing from a linked row, so in any common order of the
   columns the first p of both rows share a column.  The order puts columns
   that only one class has first: a row with p columns of its own among the
   first is linked with nothing and leaves.  Only the columns of the lowest
   hashes are looked at (a fixed share of the hash range); a row that has fewer than
   p of those is indexed with all its columns in a second name space, too,
   where rows of that kind meet.  Columns are dealt out in blocks by hash.  A
   column that several classes of one batch share is sent once, so no frequent
   column gathers in one task.
3. Size-derived bound on blocks of columns: linked rows differ in at most
   D = (sizes' sum) / 19 columns, so of D + 1 blocks of columns at least one is
   equal in both.  Rows of like size that agree on a whole block form
   clusters; rows that merely share a passage seldom do.
4. Within a cluster the product accumulates overlaps.  Each row is compared
   with the hub of its cluster.  Rows that link with it are connected; the
   others are compared with every row of the cluster, in blocks of rows, by a
   product over blocks of columns that stops once no pair can reach its
   bound.  Jaccard distance is a metric: blocks whose distances to the hub
   differ by more than 0.1 hold no linked pair and are left out.
5. The links' connected components give the component of each class.

No step emits all pairs of a group: block pairs name rows, and the product
returns a spanning forest of the links it finds.

Defined cases: null, empty and word-less texts have no shingles, are linked
with nothing and are their own component; equal non-empty sets are linked;
a null doc_id counts after all others; repeated rows are members like others;
an empty table gives an empty one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlake.llm import _text as X
from offerlake.llm._tables import components, numbered_columns
from offerlake.session import saved, scratch_scope

#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 90
#: Share of the hash range whose columns are looked at first, and the hash below which it lies.
SHARE = 3 / 16
LOW = np.uint64(3 << 60)
#: Column entries per block, rows per block of the product, columns per step of it.
BLOCK_ENTRIES, BLOCK_ROWS, STEP_COLUMNS = 2_000_000, 1024, 2048
#: Bits that mark documents whose sets are wanted: 8 MB.
MARK_BITS = 1 << 26
#: Blocks of columns beyond D + 1: how many of a row's blocks may be empty.
SPARE = 1
#: Distances to the hub are cut into bins of this width.
BIN = 0.05

_C1, _C2 = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD1342543DE82EF95)


def prefix_length(n):
    """p: how many columns of a row of n are enough to meet every linked row."""
    return n - -(-PERCENT * n // 100) + 1


def shingle_sets(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set size and tag (hash of the set) per row of a text column; all sets, sorted, one after the other."""
    data, starts, ends = X.utf8(col)
    sizes, tags, sets = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.uint64), []
    for lo, hi in X.slices(starts, ends):
        buf, begin = X.joined(data, starts[lo:hi], ends[lo:hi])
        buf = X.LOWER[buf]
        ws, we, row = X.words_of(buf, X.NON_SPACE_BYTE, begin)
        h = X.span_hashes(buf, ws, we)
        count = np.bincount(row, minlength=hi - lo)
        first = np.concatenate(([0], np.cumsum(count)))
        s = np.zeros(len(h), np.uint64)
        s[:-2] = X.mix(h[:-2] + h[1:-1] * _C1 + h[2:] * _C2) if len(h) > 2 else 0
        many = np.maximum(count - 2, (count > 0).astype(count.dtype))  # shingles with repeats, per row
        for r in np.flatnonzero((count > 0) & (count < 3)).tolist():
            a = first[r]
            s[a] = X.mix(h[a:a + 1] + np.uint64(1))[0] if count[r] == 1 else X.mix(h[a:a + 1] + h[a + 1:a + 2] * _C1 + np.uint64(2))[0]
        at = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
        s, owner = s[at], np.repeat(np.arange(hi - lo), many)
        edge = np.concatenate(([0], np.cumsum(many))).tolist()
        for a, b in zip(edge, edge[1:]):
            if b - a > 1:
                s[a:b].sort()
        if len(s):
            new = np.ones(len(s), bool)
            new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
            s, owner = s[new], owner[new]
            n = np.bincount(owner, minlength=hi - lo)
            total = np.concatenate(([np.uint64(0)], np.cumsum(X.mix(s ^ _C2))))
            edge = np.concatenate(([0], np.cumsum(n)))
            sizes[lo:hi] = n
            tags[lo:hi] = X.mix((total[edge[1:]] - total[edge[:-1]]) ^ (n.astype(np.uint64) * _C1))
            sets.append(s)
    return sizes, tags, np.concatenate(sets) if sets else np.zeros(0, np.uint64)


def _i64(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64) if a.dtype == np.uint64 else a.astype(np.int64), pa.int64())


def _binary(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([p.tobytes() for p in parts], pa.binary())


def _u64(raw) -> np.ndarray:
    return np.frombuffer(raw, np.uint64) if raw else np.zeros(0, np.uint64)


ROWS = T.StructType([T.StructField("n", T.LongType()), T.StructField("tag", T.LongType()), T.StructField("low", T.LongType())])


def _rows(docs: DataFrame, text: str, doc_id: str, keep: list[str] | None = None) -> DataFrame:
    """(id, n, tag, low): set size, tag and number of low columns of every document; with the columns ``keep`` after id."""

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        sizes, tags, sets = shingle_sets(batch.column("text"))
        edge = np.concatenate(([0], np.cumsum(sizes)))
        low = np.concatenate(([0], np.cumsum(sets < LOW)))
        return [_i64(sizes), _i64(tags), _i64(low[edge[1:]] - low[edge[:-1]])]

    kept = keep or []
    return X.add_columns(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), *kept), compute, ROWS, ["id", *kept])


_ENTRIES = "block long, hashes binary, tags binary, shared binary, own_hashes binary, own_tags binary"


def _entries(docs: DataFrame, text: str, blocks: int) -> DataFrame:
    """The indexed columns of each batch's classes, by block of columns."""

    def run(batches):
        for batch in batches:
            sizes, tags, sets = shingle_sets(batch.column(0))
            edge = np.concatenate(([0], np.cumsum(sizes)))
            hashes, owners = [], []
            _, once = np.unique(tags, return_index=True)
            for r in once[sizes[once] > 8].tolist():  # smaller sets link with equal ones only
                own = sets[edge[r]:edge[r + 1]]
                low = own[:np.searchsorted(own, LOW)]
                hashes.append(low & ~np.uint64(1))
                owners.append(np.full(len(low), tags[r]))
                if len(low) < prefix_length(int(sizes[r])):
                    hashes.append(own | np.uint64(1))
                    owners.append(np.full(len(own), tags[r]))
            if not hashes:
                continue
            h, t = np.concatenate(hashes), np.concatenate(owners)
            order = np.argsort(h, kind="stable")
            h, t = h[order], t[order]
            same = np.zeros(len(h), bool)  # columns that several classes of this batch have
            same[1:] = h[1:] == h[:-1]
            same[:-1] |= same[1:]
            shared = np.unique(h[same])
            one = _dealt(X.mix(h[~same]), blocks, h[~same], t[~same])
            two = _dealt(X.mix(shared), blocks, shared)
            three = _dealt(X.mix(t[same] ^ h[same]), blocks, h[same], t[same])
            keys = sorted({*one, *two, *three})
            none = np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()),
                 *(_binary([from_[k][i] if k in from_ else none for k in keys])
                   for from_, i in ((one, 0), (one, 1), (two, 0), (three, 0), (three, 1)))],
                names=["block", "hashes", "tags", "shared", "own_hashes", "own_tags"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, _ENTRIES)


def _dealt(key: np.ndarray, blocks: int, *columns: np.ndarray) -> dict[int, list[np.ndarray]]:
    block = (key % np.uint64(blocks)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    names, at = np.unique(block[order], return_index=True)
    parts = [np.split(c[order], at[1:]) for c in columns]
    return {k: [p[i] for p in parts] for i, k in enumerate(names.tolist())}


def _common(table: pa.Table) -> pa.Table:
    """Of one block of columns, the (tag, column) entries of columns that several classes have."""
    h = np.concatenate([_u64(x.as_py()) for x in table.column("hashes")])
    t = np.concatenate([_u64(x.as_py()) for x in table.column("tags")])
    shared = np.unique(np.concatenate([_u64(x.as_py()) for x in table.column("shared")]))
    order = np.argsort(h, kind="stable")
    h, t = h[order], t[order]
    if len(h):
        edge = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        least, most = np.minimum.reduceat(t, edge), np.maximum.reduceat(t, edge)
        many = (least != most) | np.isin(h[edge], shared)
        keep = np.repeat(many, np.diff(np.append(edge, len(h))))
        h, t = h[keep], t[keep]
    h = np.concatenate([h, *(_u64(x.as_py()) for x in table.column("own_hashes"))])
    t = np.concatenate([t, *(_u64(x.as_py()) for x in table.column("own_tags"))])
    return pa.table({"tag": _i64(t), "h": _i64(h)})


def _open_rows(common: DataFrame, classes: DataFrame) -> DataFrame:
    """(tag, odd): classes with fewer than p columns of their own among the first; odd is their share of such columns."""
    second = F.col("h").bitwiseAND(F.lit(1)) == 1
    per = common.distinct().groupBy("tag").agg(F.count(F.when(~second, 1)).alias("c0"), F.count(F.when(second, 1)).alias("c1"))
    per = per.join(classes.select("tag", "n", "low"), "tag")
    p = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1
    first = (F.col("c0") > 0) & (F.col("low") - F.col("c0") < p)
    other = (F.col("c1") > 0) & (F.col("n") - F.col("c1") < p)
    return per.filter(first | other).select("tag", (1 - F.col("c0") / F.greatest(F.col("low"), F.lit(1))).alias("odd"))


def size_class(n: int) -> int:
    """Classes whose sizes grow by the least ratio of linked sizes: linked rows are in one class or in neighbours."""
    c = int(math.log(n) / math.log(100 / PERCENT))
    while class_end(c) <= n:
        c += 1
    while c and class_end(c - 1) > n:
        c -= 1
    return c


def class_end(c: int) -> int:
    """The least size above class ``c``; linked rows a <= b have PERCENT * b <= 100 * a."""
    end = 1
    for _ in range(c + 1):
        end = 100 * end // PERCENT + 1
    return end


def block_signatures(own: np.ndarray, c: int) -> np.ndarray:
    """Signatures of a row's blocks of columns for partners up to class ``c``.

    With D the most columns that may differ, one of D + 1 + SPARE blocks is
    equal in both rows and not empty, unless a row has more than SPARE empty
    blocks; only such a row has signatures of its empty blocks.
    """
    differ = 2 * (100 - PERCENT) * (class_end(c) - 1) // (100 + PERCENT)
    blocks = differ + 1 + SPARE
    key = np.uint64(c * int(_C2) % (1 << 64))
    part = (X.mix(own ^ key) % np.uint64(blocks)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    total = np.concatenate(([np.uint64(0)], np.cumsum(X.mix(own[order] + _C1))))
    edge = np.searchsorted(part[order], np.arange(blocks + 1))
    size = np.diff(edge)
    sums = total[edge[1:]] - total[edge[:-1]] + size.astype(np.uint64) * _C1
    out = X.mix(X.mix(key + np.arange(blocks).astype(np.uint64)) ^ sums)
    return out if (size == 0).sum() > SPARE else out[size > 0]


def _signatures(batches):
    for batch in batches:
        tags, found = [], []
        for tag, raw in zip(batch.column("tag").to_pylist(), batch.column("set")):
            own = _u64(raw.as_py())
            c = size_class(len(own))
            found += [block_signatures(own, c), block_signatures(own, c + 1)]
            tags.append(np.full(len(found[-1]) + len(found[-2]), tag, np.int64))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tags)), _i64(np.concatenate(found))], names=["tag", "h"])


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def _with_hub(batches):
    for batch in batches:
        inter = [_overlap(_u64(a.as_py()), _u64(b.as_py())) for a, b in zip(batch.column("set"), batch.column("hub_set"))]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("tag", "cluster", "n", "hub", "hub_n")),
                                          pa.array(inter, pa.int64())], names=["tag", "cluster", "n", "hub", "hub_n", "inter"])


def linked_pairs(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Which rows of two blocks of sets link, as a matrix."""
    na, nb = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    la, lb = np.concatenate(left), np.concatenate(right)
    columns = np.intersect1d(la, lb)
    # the overlap that a pair needs: 100 i >= PERCENT (a + b - i)
    need = -(-PERCENT * (na[:, None] + nb[None, :]) // (100 + PERCENT))
    alive = np.minimum(na[:, None], nb[None, :]) >= need
    total = np.zeros(need.shape, np.float32)

    def entries(values, sizes):
        at = np.minimum(np.searchsorted(columns, values), max(0, len(columns) - 1))
        ok = columns[at] == values if len(columns) else np.zeros(len(values), bool)
        return np.repeat(np.arange(len(sizes)), sizes)[ok], at[ok]

    (ra, ca), (rb, cb) = entries(la, na), entries(lb, nb)
    rest_a, rest_b = np.bincount(ra, minlength=len(na)), np.bincount(rb, minlength=len(nb))
    for lo in range(0, len(columns), STEP_COLUMNS):
        if not (alive & (total + np.minimum(rest_a[:, None], rest_b[None, :]) >= need)).any():
            break
        a = np.zeros((len(na), STEP_COLUMNS), np.float32)
        b = np.zeros((len(nb), STEP_COLUMNS), np.float32)
        for m, r, c, rest in ((a, ra, ca, rest_a), (b, rb, cb, rest_b)):
            here = (c >= lo) & (c < lo + STEP_COLUMNS)
            m[r[here], c[here] - lo] = 1
            rest -= np.bincount(r[here], minlength=len(rest))
        total += a @ b.T
    return alive & (total >= need)


def _forest(mask: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[list, list]:
    """A spanning forest of the links between two blocks of rows, as two lists of tags."""
    tags, number = np.unique(np.concatenate([left, right]), return_inverse=True)
    ia, ib = number[:len(left)], number[len(left):]
    x, y = np.nonzero(mask)
    x, y = ia[x], ib[y]
    label = np.arange(len(tags))
    while len(x):
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(tags)))
    return tags[moved].tolist(), tags[label[moved]].tolist()


def _product(table: pa.Table) -> pa.Table:
    """One pair of blocks: links between its two sides (or within its only one)."""
    side = table.column("side").to_numpy()
    tags = table.column("tag").to_numpy()
    sets = [_u64(x.as_py()) for x in table.column("set")]
    a = np.flatnonzero(side == 0)
    b = np.flatnonzero(side == 1) if (side == 1).any() else a
    out_a, out_b = [], []
    if len(a) and len(b):
        out_a, out_b = _forest(linked_pairs([sets[i] for i in a], [sets[i] for i in b]), tags[a], tags[b])
    return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})


def _far_links(seen: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of rows that don't link with their hub, with any other row of their cluster.

    A cluster of at most BLOCK_ROWS rows is one block.  A larger one is cut by
    distance to the hub, and each of those bins by hash into blocks of about
    BLOCK_ROWS rows; blocks of far rows meet every block within reach."""
    d = 1 - F.col("inter") / (F.col("n") + F.col("hub_n") - F.col("inter"))
    rows = seen.filter("tag <> hub").select("tag", "cluster", F.when(F.col("linked"), 0).otherwise(1).alias("far"),
                                            F.floor(d / BIN).cast("int").alias("bin"))
    open_ = rows.groupBy("cluster").agg(F.sum("far").alias("n_far"), F.count(F.lit(1)).alias("n_rows")).filter(
        "n_far > 0 AND n_rows > 1").select("cluster", (F.col("n_rows") <= BLOCK_ROWS).alias("one"))
    rows = rows.join(open_, "cluster").withColumns({"far": F.when(F.col("one"), 1).otherwise(F.col("far")),
                                                    "bin": F.when(F.col("one"), 0).otherwise(F.col("bin"))}).drop("one")
    sizes = rows.groupBy("cluster", "far", "bin").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("subs"))
    rows = saved(rows.join(sizes, ["cluster", "far", "bin"]).withColumn(
        "sub", F.pmod(F.xxhash64("tag"), F.col("subs")).cast("int")).drop("subs"), "ngram-rows")
    blocks = rows.select("cluster", "far", "bin", "sub").distinct()
    a = blocks.filter("far = 1").select("cluster", *[F.col(c).alias(f"{c}_a") for c in ("far", "bin", "sub")])
    b = blocks.select("cluster", *[F.col(c).alias(f"{c}_b") for c in ("far", "bin", "sub")])
    reach = int(math.floor((1 - PERCENT / 100) / BIN + 1e-9)) + 1
    pairs = a.join(b, "cluster").filter(
        (F.abs(F.col("bin_a") - F.col("bin_b")) <= reach)
        & ((F.col("far_b") == 0) | (F.struct("bin_a", "sub_a") <= F.struct("bin_b", "sub_b"))))
    pairs = saved(pairs.withColumn("pair", F.xxhash64("cluster", "far_a", "bin_a", "sub_a", "far_b", "bin_b", "sub_b")), "ngram-pairs")
    key = ["cluster", "far", "bin", "sub"]

    def side(k: int, s: str, which: DataFrame) -> DataFrame:
        names = which.select("pair", "cluster", *[F.col(f"{c}_{s}").alias(c) for c in key[1:]])
        return rows.join(names, key).select("pair", F.lit(k).alias("side"), "tag")

    same = (F.col("far_b") == 1) & (F.col("bin_a") == F.col("bin_b")) & (F.col("sub_a") == F.col("sub_b"))
    both = side(0, "a", pairs).union(side(1, "b", pairs.filter(~same)))
    return both.join(sets.select("tag", "set"), "tag").groupBy("pair").applyInArrow(_product, "a long, b long")


def _components(docs: DataFrame, rows: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(tag, component, component_id) of every class of ``rows``; component is a class's tag, component_id may be null."""
    spark = docs.sparkSession
    classes = saved(rows.filter("n > 0").groupBy("tag").agg(
        F.min("id").alias("first"), F.first("n").alias("n"), F.first("low").alias("low")), "ngram-classes")
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    entries = classes.filter("n > 8").agg(F.sum("low")).first()[0] or 0
    blocks = max(shuffles, math.ceil(entries / BLOCK_ENTRIES))
    with scratch_scope(spark):
        common = _entries(docs, text, blocks).groupBy("block").applyInArrow(_common, "tag long, h long")
        rest = saved(_open_rows(common, classes).join(classes.select("tag", F.col("first").alias("id"), "n"), "tag"), "ngram-open")
        links = _links(_open_sets(docs, text, doc_id, rest))
        roots = components(links, "ngram-components")
        grouped = classes.join(roots.select(F.col("node").alias("tag"), "root"), "tag", "left").select(
            "tag", "first", F.coalesce("root", "tag").alias("component"))
        least = saved(grouped.groupBy("component").agg(F.min("first").alias("component_id")), "ngram-least")
        return saved(grouped.join(least, "component").select("tag", "component", "component_id"), "ngram-named", keep=True)


def join_components(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: id, n_shingles, tag (equal for equal sets; 0 shingles: no meaning) and component_id."""
    rows = saved(_rows(docs, text, doc_id), "ngram-rows")
    named = _components(docs, rows, text, doc_id).select("tag", "component_id")
    full = rows.filter("n > 0").join(named, "tag").select("id", F.col("n").alias("n_shingles"), "tag", "component_id")
    return full.union(rows.filter("n = 0").select("id", F.col("n").alias("n_shingles"), "tag", F.col("id").alias("component_id")))


def _mark(ids: DataFrame) -> np.ndarray:
    """One bit for each hash of a document id, modulo MARK_BITS: an array of fixed size, put together by Spark."""
    bit = F.pmod(F.xxhash64("id"), F.lit(MARK_BITS)) + 1
    rows = ids.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros(MARK_BITS, bool)
    for r in rows.collect():
        own = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little").view(bool)
        out[(r["part"] - 1) * len(own):r["part"] * len(own)] = own
    return np.packbits(out)


def _open_sets(docs: DataFrame, text: str, doc_id: str, rest: DataFrame) -> DataFrame:
    """(tag, n, odd, set) of the classes in ``rest`` (tag, id, n, odd), from the text of one of their documents.

    A bit per hash of the wanted ids (an array of fixed size) tells each task
    which of its texts to look at, so no text is shuffled; the join by tag
    makes it exact."""
    sent = docs.sparkSession.sparkContext.broadcast(_mark(rest))

    def read_sets(batches):
        marks = sent.value
        for batch in batches:
            bit = batch.column("bit").to_numpy()
            some = pa.array(np.flatnonzero(marks[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1))
            if len(some):
                sizes, tags, sets = shingle_sets(batch.column("text").take(some))
                edge = np.concatenate(([0], np.cumsum(sizes))).tolist()
                yield pa.RecordBatch.from_arrays([_i64(tags), _binary([sets[a:b] for a, b in zip(edge, edge[1:])])], names=["tag", "set"])

    own = docs.select(F.pmod(F.xxhash64(F.col(doc_id)), F.lit(MARK_BITS)).alias("bit"), F.col(text).alias("text"))
    sets = own.mapInArrow(read_sets, "tag long, set binary").join(rest, "tag").dropDuplicates(["tag"])
    return saved(sets.select("tag", "n", "odd", "set"), "ngram-sets")


def _links(sets: DataFrame) -> DataFrame:
    """Links (a, b) between classes: enough of them to connect whatever is connected."""
    signs = saved(sets.select("tag", "set").mapInArrow(_signatures, "tag long, h long"), "ngram-signatures")
    firsts = signs.groupBy("h").agg(F.min("tag").alias("b"), F.max("tag").alias("most")).filter("b <> most").select("h", "b")
    edges = signs.join(firsts, "h").select(F.col("tag").alias("a"), "b")
    clusters = components(edges, "ngram-clusters").select(F.col("node").alias("tag"), F.col("root").alias("cluster"))
    sets = saved(sets.join(clusters, "tag"), "ngram-clustered")
    hubs = sets.groupBy("cluster").agg(F.min_by("tag", F.struct("odd", "tag")).alias("hub"))
    hubs = hubs.join(sets.select(F.col("tag").alias("hub"), F.col("n").alias("hub_n"), F.col("set").alias("hub_set")), "hub")
    hubs = saved(hubs, "ngram-hubs")
    seen = sets.join(hubs, "cluster").mapInArrow(
        _with_hub, "tag long, cluster long, n long, hub long, hub_n long, inter long")
    seen = saved(seen.withColumn("linked", F.expr(f"100 * inter >= {PERCENT} * (n + hub_n - inter)")), "ngram-seen")
    near = seen.filter("linked AND tag <> hub").select(F.col("tag").alias("a"), F.col("hub").alias("b"))
    return near.union(_far_links(seen, sets))


def drop_linked(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay: of each component one row, with the smallest doc_id (null after all others).

    Rows without a shingle stay.  The rows are first written to the shared
    folder, so that file and row name each of them for good: a null or repeated
    doc_id takes no other row along.  Columns are unchanged.
    """
    landed = numbered_columns(docs, "ngram-docs")
    own = dict(zip(docs.columns, landed.table.columns))
    rows = saved(_rows(landed.placed(), own[text], own[doc_id], ["file", "row"]), "ngram-rows")
    named = _components(landed.table, rows, own[text], own[doc_id]).select("tag", "component")
    rows = rows.filter("n > 0").join(named, "tag").select("id", "file", "row", "component")
    least = rows.groupBy("component").agg(
        F.count(F.lit(1)).alias("members"),
        F.min(F.struct(F.col("id").isNull().alias("absent"), "id", "file", "row")).alias("least")).filter("members > 1")
    gone = rows.join(least, "component").filter((F.col("file") != F.col("least.file")) | (F.col("row") != F.col("least.row")))
    return landed.without(gone)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op5: per document, the size of its set and its component."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return join_components(docs).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x20\x09-\x0D]+')")
ORACLE = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) > 2 THEN [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]
                                     WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * k >= {PERCENT} * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
t AS (SELECT r, r AS o FROM d UNION SELECT t.r, e.b FROM t JOIN e ON e.a = t.o),
c AS (SELECT t.r, min(d.doc_id) AS component_id FROM t JOIN d ON d.r = t.o GROUP BY t.r)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM d JOIN c USING (r) LEFT JOIN n USING (r)
"""
