"""D2b, near dedupe: MinHash signatures, banded buckets, exact verification, components.

Words are runs of other characters than white space, in lower case.  A
document's set holds its distinct five-word shingles (a shorter text: its whole
word sequence); two documents are near if the Jaccard similarity of their sets
is at least 80 %.  A cluster is what is reachable by such links.

1. Documents with equal sets are one class, one row from here on.
2. A class has BANDS keys of BAND_ROWS minima each; classes with a key in common are
   candidates.  A pair at 80 % has none with probability (1 - 0.8^4)^20 = 3e-5.
3. Every member of a bucket is compared with the bucket's first class: as many
   pairs as members, however large the bucket.
4. Buckets that then still hold several components are compared whole, in
   blocks of bounded size, and each block returns a spanning forest of the
   links it finds.  No step emits the pairs of a group, none is capped.
5. The links' components give the clusters.

All links are verified on the sets themselves (64-bit shingle hashes).
Null, empty and word-less texts have no shingle and are clusters of their own;
a null id comes after all others; repeated rows are members like others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlake.operators.components import components
from offerlake.session import saved, scratch_scope

SHINGLE, PERCENT = 5, 80
BANDS, BAND_ROWS = 20, 4
#: Rows and set entries of a block in step 4.
BLOCK_ROWS, BLOCK_ENTRIES = 256, 1_000_000
#: Set entries whose minima are taken at a time.
SLICE_ENTRIES = 1 << 18

_ODD = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: Column) -> Column:
    """A 64-bit hash of each word."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([^\x09-\x0D\x20]+)"), 1)
    return F.transform(words, lambda w: F.xxhash64(w))


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers without visible order."""
    for shift in (30, 27):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(31))


def shingle_set(words: np.ndarray) -> np.ndarray:
    """The sorted distinct shingles of a text's word hashes."""
    width = min(SHINGLE, len(words))
    if not width:
        return np.zeros(0, np.uint64)
    n = len(words) - width + 1
    h = np.full(n, width, np.uint64)
    for k in range(width):
        h = _mixed(h * _ODD + words[k:k + n])
    return np.unique(h)


def tag_of(own: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return b"".join(int(x).to_bytes(8, "big") for x in (_mixed(own).sum(dtype=np.uint64), _mixed(own * _ODD + np.uint64(len(own))).sum(dtype=np.uint64)))


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BANDS keys for each set; sets are not empty."""
    n = BANDS * BAND_ROWS
    rng = np.random.default_rng(0x5EED)
    scale, shift = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)
    out = np.zeros((len(sets), BANDS), np.uint64)
    sizes = np.cumsum([0, *map(len, sets)])
    lo = 0
    while lo < len(sets):
        hi = max(lo + 1, int(np.searchsorted(sizes, sizes[lo] + SLICE_ENTRIES, "right")) - 1)
        entries, first = np.concatenate(sets[lo:hi]), sizes[lo:hi] - sizes[lo]
        for i in range(n):
            least = np.minimum.reduceat(_mixed(entries * scale[i] + shift[i]), first)
            band = i // BAND_ROWS
            out[lo:hi, band] = _mixed(out[lo:hi, band] * _ODD + least + np.uint64(band))
        lo = hi
    return out


def _sets(batch: pa.RecordBatch) -> list[np.ndarray]:
    words = batch.column("words")
    flat, edge = words.flatten().to_numpy(zero_copy_only=False).view(np.uint64), words.offsets.to_numpy()
    edge = edge - edge[0]
    return [shingle_set(flat[a:b]) for a, b in zip(edge.tolist(), edge[1:].tolist())]


def _classes(batches):
    for batch in batches:
        sets = _sets(batch)
        some = [i for i, s in enumerate(sets) if len(s)]
        keys = band_keys([sets[i] for i in some]).view(np.int64) if some else []
        bands: list = [None] * len(sets)
        for i, row in zip(some, keys):
            bands[i] = row.tolist()
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array([tag_of(s) for s in sets], pa.binary()),
             pa.array(bands, pa.list_(pa.int64()))], names=["id", "text_hash", "n", "tag", "bands"])


def _tagged_sets(batches):
    for batch in batches:
        sets = _sets(batch)
        yield pa.RecordBatch.from_arrays([pa.array([tag_of(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                                          pa.array([s.tobytes() for s in sets], pa.binary())], names=["tag", "n", "own"])


def _read(raw) -> np.ndarray:
    return np.frombuffer(raw.as_buffer(), np.uint64)


def near(common, na, nb):
    """Whether sets of ``na`` and ``nb`` with ``common`` entries in both are near."""
    return 100 * common >= PERCENT * (na + nb - common)


def _near_first(batches):
    """Of pairs of sets those that are near."""
    for batch in batches:
        keep = []
        for i, (a, b) in enumerate(zip(batch.column("own"), batch.column("first_own"))):
            a, b = _read(a), _read(b)
            if near(min(len(a), len(b)), len(a), len(b)) and near(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b)):
                keep.append(i)
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in ("tag", "first")], names=["a", "b"])


def _near_blocks(table: pa.Table) -> pa.Table:
    """Links between different components of two blocks (or within one): a spanning forest of them."""
    tags, side = table.column("tag").to_pylist(), table.column("side").to_numpy()
    number = {x: i for i, x in enumerate(dict.fromkeys(table.column("label").to_pylist()))}
    group = np.array([number[x] for x in table.column("label").to_pylist()])  # components, joined as links are found
    sets = [_read(x) for x in table.column("own")]
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    right = right if len(right) else left
    found = []
    if len(left) and len(right) and len(number) > 1:
        entries = np.concatenate([sets[i] for i in right])
        owner = np.repeat(np.arange(len(right)), [len(sets[i]) for i in right])
        order = np.argsort(entries, kind="stable")
        entries, owner = entries[order], owner[order]
        size = np.array([len(sets[i]) for i in right])
        for i in left.tolist():
            lo, hi = (np.searchsorted(entries, sets[i], s) for s in ("left", "right"))
            n = hi - lo
            at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            common = np.bincount(owner[at], minlength=len(right))
            for j in right[near(common, len(sets[i]), size)].tolist():
                if group[i] != group[j]:
                    group[group == group[j]] = group[i]
                    found.append((tags[i], tags[j]))
    a, b = zip(*found) if found else ((), ())
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def _buckets(classes: DataFrame) -> DataFrame:
    """(key, tag, first): the classes of each bucket with several, and the bucket's first class."""
    each = classes.select("tag", F.explode("bands").alias("key"))
    several = each.groupBy("key").agg(F.min("tag").alias("first"), F.max("tag").alias("last")).filter("first <> last")
    return saved(each.join(several.select("key", "first"), "key"), "near-buckets")


def _links(buckets: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that connect whatever the candidates' links connect."""
    pairs = buckets.filter("tag <> first").select("tag", "first").distinct()
    firsts = sets.select(F.col("tag").alias("first"), F.col("own").alias("first_own"))
    links = saved(pairs.join(sets.select("tag", "own"), "tag").join(firsts, "first").mapInArrow(_near_first, "a binary, b binary"), "near-links")
    return links.union(_block_links(buckets, sets, components(links)))


def _block_links(buckets: DataFrame, sets: DataFrame, known: DataFrame) -> DataFrame:
    """Links between the components ``known`` (node, root) that share a bucket."""
    members = buckets.select("key", "tag").join(known.withColumnRenamed("node", "tag"), "tag", "left").select(
        "key", "tag", F.coalesce("root", "tag").alias("label")).join(sets.select("tag", "n"), "tag")
    members = saved(members, "near-members")
    open_ = members.groupBy("key").agg(
        F.min("label").alias("least"), F.max("label").alias("most"), F.count(F.lit(1)).alias("rows"), F.sum("n").alias("entries"),
        F.sum(F.xxhash64("tag").cast("decimal(38,0)")).alias("who")).filter("least <> most")
    # bands with the same members are one bucket
    open_ = open_.groupBy("rows", "entries", "who").agg(F.min("key").alias("key"))
    blocks = F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("entries") / BLOCK_ENTRIES)).cast("int")
    rows = members.join(open_.select("key", blocks.alias("blocks")), "key").withColumn(
        "block", F.pmod(F.xxhash64("tag"), F.col("blocks")).cast("int"))
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"),
        (F.col("block") > F.col("other")).cast("int").alias("side"), "tag", "label")
    return met.join(sets.select("tag", "own"), "tag").groupBy("key", "x", "y").applyInArrow(_near_blocks, "a binary, b binary")


def near_dedupe(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its number of shingles and its cluster, named by the smallest id: ``(doc_id, n_shingles, cluster_id)``."""
    with scratch_scope(docs.sparkSession):
        texts = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("text_hash"), word_hashes(F.col(text)).alias("words"))
        id_type = docs.schema[doc_id].dataType.simpleString()
        rows = saved(texts.mapInArrow(_classes, f"id {id_type}, text_hash long, n long, tag binary, bands array<long>"), "near-rows")
        classes = rows.filter("n > 0").groupBy("tag").agg(
            F.min(F.struct(F.col("id").isNull().alias("absent"), "id")).alias("least"), F.min("text_hash").alias("text_hash"), F.min("bands").alias("bands"))
        classes = saved(classes, "near-classes")
        buckets = _buckets(classes)
        # the sets of one text of each class with candidates; AQE broadcasts the hashes of the texts while they are few
        wanted = classes.join(buckets.select("tag").distinct(), "tag", "left_semi").select("text_hash").distinct()
        sets = texts.join(wanted, "text_hash", "left_semi").select("words").mapInArrow(_tagged_sets, "tag binary, n long, own binary")
        sets = saved(sets.filter("n > 0").dropDuplicates(["tag"]), "near-sets")
        roots = components(_links(buckets, sets))
        named = classes.join(roots.withColumnRenamed("node", "tag"), "tag", "left").select("tag", "least", F.coalesce("root", "tag").alias("root"))
        least = named.groupBy("root").agg(F.min("least").alias("first"))
        clusters = saved(named.join(least, "root").select("tag", F.col("first.id").alias("cluster_id")), "near-clusters")
        full = rows.filter("n > 0").join(clusters, "tag").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "cluster_id")
        bare = rows.filter("n = 0").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("id").alias("cluster_id"))
        return saved(full.union(bare), "near", keep=True)


def drop_near(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay: of each cluster the one with the smallest id (ids are unique and not null)."""
    kept = near_dedupe(docs, doc_id, text).filter("doc_id = cluster_id").select(F.col("doc_id").alias(doc_id))
    return docs.join(kept, doc_id, "left_semi")
