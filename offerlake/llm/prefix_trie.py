"""Prefix trie of conversations, by van Emde Boas recursion over depth.

A sequence of turns is a path; each distinct sequence of first turns is a node.

1. Cut.  The depths 0..D are cut at half depth, both halves again, down to
   blocks of ``base`` turns, which are one row each (a conversation of any
   length is as many rows as it has blocks), and within a block on down to
   single turns.
2. Name.  Half segments get 128-bit digests from the halves below, in parallel.
   A prefix that ends at a cut is then named from the name at the segment's
   start and the digest of its first half.  So the upper trie and the lower
   forests of a cut, whose roots are the names at the cut, are named
   independently of each other.
3. Build.  Members with one name are one node: one aggregate over all names.
4. Graft.  A node belongs to its smallest member.  Totals of the nodes that
   a member owns go up its path within a block, lower half onto upper half.
   Then, level by level, the totals of the lower forests of a cut are summed
   by root and go up the path of the root's owner through the upper block: log2(D)
   rounds, whatever the depth.

Nothing holds a whole conversation, a node's members or its children in a
row: blocks are bounded, everything else is an aggregate with partial sums.  The
digest of the members that end at a node needs their ids in order: they are
sorted by range, packed 1024 to a row, and hashed as a stream.

Names are 128 bits of SHA-256 and BLAKE2b: with 10^12 nodes the chance of any
two with one name is below 10^-14.

Defined cases: a null role or text is empty; turns of one number stand in the
order of the SHA-256 of role and text; repeated rows are turns each; rows with
a null conv_id belong to no conversation; conv_id is of an integer type; an empty table gives no node (not
even a root); other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from offerlake.session import saved, scratch_scope

#: Turns of a block, at which the recursion over Spark tables ends and that within a row begins.
BASE = 64
#: Ids that end at one node packed into a row.
PACK = 1024
ROOT = bytes(16)
#: Turns at most that a conversation shares with the first of its hundred, plus one.
HEADS, HUNDRED = 6, 100


def _join(a: bytes, b: bytes) -> bytes:
    return hashlib.blake2b(a + b, digest_size=16).digest()


def joined_name(a: Column, b: Column) -> Column:
    """128 bits that name what ``a`` names, continued by ``b``."""
    return first_bytes(F.sha2(F.concat(a, b), 256))


def first_bytes(hexadecimal: Column) -> Column:
    return F.unhex(F.substring(hexadecimal, 1, 32))


def segment_digests(tokens: list[bytes]) -> dict[tuple[int, int], bytes]:
    """Digests of the whole segments of a block's recursion, by (start, end)."""
    out: dict[tuple[int, int], bytes] = {(i, i + 1): t for i, t in enumerate(tokens)}
    size = 1
    while 2 * size <= len(tokens):
        for lo in range(0, len(tokens) - 2 * size + 1, 2 * size):
            out[lo, lo + 2 * size] = _join(out[lo, lo + size], out[lo + size, lo + 2 * size])
        size *= 2
    return out


def block_names(tokens: list[bytes], root: bytes, end: bytes | None, base: int) -> list[bytes]:
    """Names of the prefixes that end within a block; ``root`` before it, ``end`` after a whole block."""
    digest = segment_digests(tokens)
    name = {0: root, base: end}
    size = base // 2
    while size:  # every cut of one size: a first half that is whole names its end
        for lo in range(0, base, 2 * size):
            if lo + size <= len(tokens):
                name[lo + size] = _join(name[lo], digest[lo, lo + size])
        size //= 2
    return [name[i] for i in range(1, len(tokens) + 1)]


def graft_path(values: list[list[int]]) -> list[list[int]]:
    """Totals from each place of a path to its end: lower halves grafted onto upper ones."""
    if len(values) == 1:
        return values
    mid = len(values) // 2
    upper, lower = graft_path(values[:mid]), graft_path(values[mid:])
    return [[a + b for a, b in zip(v, lower[0])] for v in upper] + lower


# ---- conversations to sequences

def placed_turns(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The turns in order, without a window over a conversation.

    (conv, part, at, token, chars) sorted by range; and (conv, part, first,
    before, total): a range's first turn, how many stand in earlier ranges, and in all."""
    said, by = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    token = first_bytes(F.sha2(F.concat(F.char_length(by).cast("string"), F.lit(":"), by, said), 256))
    rows = turns.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"), token.alias("token"),
        F.char_length(said).cast("long").alias("chars")).withColumn("copy", F.monotonically_increasing_id())
    # equal rows are told apart, so that any number of them can be dealt out
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("token"), F.col("copy")]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = saved(sorted_.select("conv", "token", "chars", F.monotonically_increasing_id().alias("at"))
                   .withColumn("part", F.shiftright("at", 33)), "trie-placed")
    runs = placed.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("conv")  # a row per range that holds a part of the conversation
    earlier = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return placed, saved(runs.select("conv", "part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
                                     F.sum("n").over(own).alias("total")), "trie-runs")


def rebuilt(turns: DataFrame, **columns: str) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of the first of their hundred.

    (seq, size) of every conversation; (seq, size, depth, token, chars) of its turns.  The first
    h = crc32(conv_id) % 6 turns are those of conversation conv_id - conv_id % 100, as far as it has them."""
    placed, runs = placed_turns(turns, **columns)
    whole = runs.filter("before = 0").select("conv", "total")
    first = whole.filter(F.col("conv") % HUNDRED == 0).select(F.col("conv").alias("head"), F.col("total").alias("head_total"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS).alias("h")
    plan = whole.select("conv", "total", h, (F.col("conv") - F.col("conv") % HUNDRED).alias("head")).join(first, "head", "left")
    taken = F.least("h", F.coalesce("head_total", F.lit(0)))
    plan = saved(plan.select("conv", "head", "h", taken.alias("taken"),
                             (taken + F.greatest(F.col("total") - F.col("h"), F.lit(0))).alias("size")), "trie-plan")
    ranked = placed.join(runs.drop("total").join(plan, "conv"), ["conv", "part"]).withColumn(
        "rank", F.col("at") - F.col("first") + F.col("before") + 1)
    own = ranked.filter("rank > h").select(
        F.col("conv").alias("seq"), "size", (F.col("taken") + F.col("rank") - F.col("h")).alias("depth"), "token", "chars")
    heads = placed.filter(F.col("conv") % HUNDRED == 0).join(runs.drop("total"), ["conv", "part"]).select(
        F.col("conv").alias("head"), (F.col("at") - F.col("first") + F.col("before") + 1).alias("depth"), "token", "chars")
    shared = heads.filter(F.col("depth") < HEADS).join(plan.filter("taken > 0"), "head").filter("depth <= taken").select(
        F.col("conv").alias("seq"), "size", "depth", "token", "chars")
    return plan.select(F.col("conv").alias("seq"), "size"), own.union(shared)


# ---- the trie

def named_blocks(turns: DataFrame, base: int = BASE) -> tuple[DataFrame, int]:
    """(seq, block, size, names, parents, chars): the names of every prefix, a block a row; and the levels above a block."""
    if base < 2 or base & (base - 1):
        raise ValueError("base: a power of two from 2 up")
    one = F.struct("depth", "token", "chars")
    blocks = turns.groupBy("seq", F.floor((F.col("depth") - 1) / base).alias("block")).agg(
        F.max("size").alias("size"), F.sort_array(F.collect_list(one)).alias("turns"))
    blocks = saved(blocks.select("seq", "block", "size", F.col("turns.token").alias("tokens"), F.col("turns.chars").alias("chars")),
                   "trie-blocks")
    deepest = blocks.agg(F.max("size")).first()[0] or 0
    levels = (deepest // base).bit_length()  # base * 2^levels turns are more than any sequence has
    roots = _roots(blocks.filter(F.size("tokens") == base), levels, base) if levels else None
    given = blocks.withColumns({"root": F.lit(ROOT), "end": F.lit(None).cast("binary")})
    if levels:
        ends = roots.select("seq", (F.col("block") - 1).alias("block"), F.col("name").alias("end"))
        deep = blocks.filter((F.col("size") >= base)).join(roots.withColumnRenamed("name", "root"), ["seq", "block"]) \
                     .join(ends, ["seq", "block"], "left")
        given = given.filter(F.col("size") < base).unionByName(deep)

    def run(batches):
        for batch in batches:
            roots, ends = batch.column("root").to_pylist(), batch.column("end").to_pylist()
            names = [block_names(t, r, e, base) for t, r, e in zip(batch.column("tokens").to_pylist(), roots, ends)]
            parents = [[r, *n[:-1]] for r, n in zip(roots, names)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("seq"), batch.column("block"), batch.column("size"), pa.array(names, pa.list_(pa.binary())),
                 pa.array(parents, pa.list_(pa.binary())), batch.column("chars")],
                names=["seq", "block", "size", "names", "parents", "chars"])

    named = given.mapInArrow(run, "seq long, block long, size long, names array<binary>, parents array<binary>, chars array<long>")
    return saved(named, "trie-named"), levels


def _roots(full: DataFrame, levels: int, base: int) -> DataFrame:
    """(seq, block, name): the name of the prefix before each block of the sequences that have a whole block."""

    def run(batches):
        for batch in batches:
            whole = [segment_digests(t)[0, base] for t in batch.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("seq"), batch.column("block"), pa.array(whole, pa.binary())],
                                             names=["seq", "s", "digest"])

    halves = [saved(full.mapInArrow(run, "seq long, s long, digest binary"), "trie-segments")]
    for _ in range(levels - 1):  # up: whole segments of twice the length
        left, right = (F.max(F.when(F.col("s") % 2 == k, F.col("digest"))) for k in (0, 1))
        both = halves[-1].groupBy("seq", F.shiftright("s", 1).alias("s")).agg(left.alias("a"), right.alias("b"))
        halves.append(saved(both.filter("a IS NOT NULL AND b IS NOT NULL").select("seq", "s", joined_name(F.col("a"), F.col("b")).alias("digest")),
                            "trie-segments"))
    # down: a cut's name from the name at the segment's start and its first half
    known = halves[0].filter("s = 0").select("seq", F.lit(0).cast("long").alias("s"), F.lit(ROOT).alias("name"))
    for half in reversed(halves):
        first = half.filter("s % 2 = 0").select("seq", F.shiftright("s", 1).alias("s"), "digest")
        cut = known.join(first, ["seq", "s"]).select("seq", (2 * F.col("s") + 1).alias("s"), joined_name(F.col("name"), F.col("digest")).alias("name"))
        known = saved(known.select("seq", (2 * F.col("s")).alias("s"), "name").union(cut), "trie-names")
    return known.withColumnRenamed("s", "block")


def trie_nodes(sequences: DataFrame, named: DataFrame, base: int = BASE) -> DataFrame:
    """(name, depth, parent, seq, n, n_ends, one_end, chars): the nodes, with their smallest member and numbers of members and ends."""
    each = named.select("seq", "size", "block", F.posexplode(F.arrays_zip("names", "parents", "chars")).alias("i", "x")).select(
        "seq", F.col("x.names").alias("name"), (F.col("block") * base + F.col("i") + 1).alias("depth"),
        F.col("x.parents").alias("parent"), F.col("x.chars").alias("chars"), "size")
    top = sequences.select("seq", F.lit(ROOT).alias("name"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"),
                           F.lit(0).cast("long").alias("chars"), "size")
    ends = F.col("size") == F.col("depth")
    return saved(each.union(top).groupBy("name").agg(
        F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("seq").alias("seq"), F.count(F.lit(1)).alias("n"),
        F.sum(ends.cast("long")).alias("n_ends"), F.max(F.when(ends, F.col("seq"))).alias("one_end"), F.min("chars").alias("chars")), "trie-nodes")


TOTALS = "name binary, leaves long, saved long"


def _summed(totals: DataFrame) -> DataFrame:
    return totals.groupBy("name").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def subtree_totals(nodes: DataFrame, named: DataFrame, levels: int, base: int = BASE) -> DataFrame:
    """(name, leaves, saved): childless nodes of each node's subtree, and (members - 1) times code points summed over it."""
    under = nodes.filter("depth > 0")
    leaf = (F.col("n") == F.col("n_ends")).cast("long")
    own = under.groupBy("seq", F.floor((F.col("depth") - 1) / base).alias("block")).agg(
        F.collect_list(F.struct(((F.col("depth") - 1) % base).cast("int").alias("i"), leaf.alias("leaf"),
                                ((F.col("n") - 1) * F.col("chars")).alias("saved"))).alias("owned"))

    def within(batches):
        for batch in batches:
            names, leaves, saved_ = [], [], []
            for path, owned in zip(batch.column("names").to_pylist(), batch.column("owned").to_pylist()):
                values = [[0, 0] for _ in path]
                for o in owned:
                    values[o["i"]] = [o["leaf"], o["saved"]]
                for name, (a, b) in zip(path, graft_path(values)):
                    if a or b:
                        names.append(name)
                        leaves.append(a)
                        saved_.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(leaves, pa.int64()), pa.array(saved_, pa.int64())],
                                             names=["name", "leaves", "saved"])

    totals = saved(_summed(own.join(named.select("seq", "block", "names"), ["seq", "block"]).select("names", "owned")
                           .mapInArrow(within, TOTALS)), "trie-totals")
    for level in range(levels):
        half = 1 << level  # blocks of the upper half; cuts stand at odd multiples of it
        cut = F.col("depth") / base
        is_cut = (F.col("depth") % base == 0) & (cut.cast("long") % (2 * half) == half)
        roots = nodes.filter(is_cut).select("name", "seq", cut.cast("long").alias("cut"))
        lower = under.filter((F.col("depth") % base == 1) & (F.col("depth") > base)).select("name", "parent").join(totals, "name")
        lower = lower.groupBy("parent").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).withColumnRenamed("parent", "name")
        path = roots.join(lower, "name").select("seq", F.explode(F.sequence(F.col("cut") - half, F.col("cut") - 1)).alias("block"), "leaves", "saved")
        up = path.join(named.select("seq", "block", "names"), ["seq", "block"]).select(F.explode("names").alias("name"), "leaves", "saved")
        totals = saved(_summed(totals.union(up)), "trie-totals")
    # the root stands above all blocks
    top = under.filter("depth = 1").select("name").join(totals, "name").select(F.lit(ROOT).alias("name"), "leaves", "saved")
    bare = nodes.filter("depth = 0 AND n = n_ends").select("name", F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
    return totals.union(_summed(top.union(bare)))


def end_digests(sequences: DataFrame, nodes: DataFrame, named: DataFrame, base: int = BASE) -> DataFrame:
    """(name, digest) of the nodes at which several sequences end: SHA-256 of their ids, ascending, comma-joined."""
    last = named.filter(F.col("size") == F.col("block") * base + F.size("names")).select(F.element_at("names", -1).alias("name"), "seq")
    ends = last.union(sequences.filter("size = 0").select(F.lit(ROOT).alias("name"), "seq"))
    ends = ends.join(nodes.filter("n_ends > 1").select("name"), "name", "left_semi")

    def pack(batches):
        name, ids = None, []

        def row():
            return pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([ids[0]], pa.int64()),
                                               pa.array([",".join(map(str, ids)).encode()], pa.binary())], names=["name", "first", "ids"])
        for batch in batches:
            for own, seq in zip(batch.column("name").to_pylist(), batch.column("seq").to_pylist()):
                if ids and (own != name or len(ids) == PACK):
                    yield row()
                    ids = []
                name = own
                ids.append(seq)
        if ids:
            yield row()

    def digest(batches):
        name, state = None, None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([state.hexdigest()])], names=["name", "digest"])
        for batch in batches:
            for own, ids in zip(batch.column("name").to_pylist(), batch.column("ids")):
                if own != name:
                    if state is not None:
                        yield row()
                    name, state = own, hashlib.sha256(ids.as_buffer())
                else:
                    state.update(b",")
                    state.update(ids.as_buffer())
        if state is not None:
            yield row()

    packed = ends.select("name", "seq").repartitionByRange("name", "seq").sortWithinPartitions("name", "seq").mapInArrow(
        pack, "name binary, first long, ids binary")
    return packed.repartition("name").sortWithinPartitions("name", "first").select("name", "ids").mapInArrow(digest, "name binary, digest string")


def build_trie(sequences: DataFrame, turns: DataFrame, base: int = BASE) -> DataFrame:
    """The trie of ``sequences`` (seq, size) with their ``turns`` (seq, size, depth from 1, token, chars).

    Per node: name, parent, seq (smallest member), parent_seq, depth, n (members), children, leaves, saved, ends (digest)."""
    with scratch_scope(sequences.sparkSession):
        named, levels = named_blocks(turns, base)
        nodes = trie_nodes(sequences, named, base)
        totals = subtree_totals(nodes, named, levels, base)
        ends = end_digests(sequences, nodes, named, base)
        children = nodes.filter("depth > 0").groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("children"))
        above = nodes.select(F.col("name").alias("parent"), F.col("seq").alias("parent_seq"))
        known = nodes.join(totals, "name", "left").join(children, "name", "left").join(ends, "name", "left")
        one = F.sha2(F.coalesce(F.col("one_end").cast("string"), F.lit("")).cast("binary"), 256)
        zero = F.lit(0).cast("long")
        found = known.join(above, "parent", "left").select(
            "name", "parent", "seq", "parent_seq", "depth", "n", F.coalesce("children", zero).alias("children"),
            F.coalesce("leaves", zero).alias("leaves"), F.coalesce("saved", zero).alias("saved"), F.coalesce("digest", one).alias("ends"))
        return saved(found, "trie", keep=True)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op12: the nodes of the prefix trie of the rebuilt conversations."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    with scratch_scope(spark):
        found = build_trie(*rebuilt(turns))
        return saved(found.select(
            F.col("seq").alias("conv_id"), "depth", F.col("parent_seq").alias("parent_conv_id"), F.col("n").alias("n_convs"),
            F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
            F.col("ends").alias("ends_sha256")), "trie-result", keep=True)


# crc32 bit by bit: a byte is folded in by eight steps
_CRC = ("xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), "
        "lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]), "
        "lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)")
ORACLE = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT *, sha256(length(role) || ':' || role || text) AS tok, length(text) AS chars FROM t),
r AS (SELECT conv_id, tok, chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, tok) AS i FROM k),
c AS (SELECT DISTINCT conv_id, {_CRC} % {HEADS} AS h, conv_id - conv_id % {HUNDRED} AS head FROM t),
a AS (SELECT c.conv_id AS seq, 0 AS part, i, tok, chars FROM c JOIN r ON r.conv_id = head AND i <= h
      UNION ALL SELECT c.conv_id, 1, i, tok, chars FROM c JOIN r ON r.conv_id = c.conv_id AND i > h),
q AS (SELECT seq, list(tok ORDER BY part, i) AS path, list(chars ORDER BY part, i) AS chars FROM a GROUP BY seq
      UNION ALL SELECT conv_id, [], [] FROM c WHERE conv_id NOT IN (SELECT seq FROM a)),
p AS (SELECT seq, unnest(range(0, len(path) + 1)) AS d, path, chars FROM q),
m AS (SELECT seq, d, CASE WHEN d = 0 THEN 'root' ELSE sha256(array_to_string(path[1:d], ',')) END AS node,
             CASE WHEN d = 1 THEN 'root' WHEN d > 1 THEN sha256(array_to_string(path[1:d - 1], ',')) END AS parent,
             CASE WHEN d = 0 THEN 0 ELSE chars[d] END AS chars, d = len(path) AS ends FROM p),
n AS (SELECT node, min(parent) AS parent, min(seq) AS conv_id, min(d) AS depth, count(*) AS n, min(chars) AS chars,
             coalesce(string_agg(CASE WHEN ends THEN CAST(seq AS VARCHAR) END, ',' ORDER BY seq), '') AS ends FROM m GROUP BY node),
kids AS (SELECT parent AS node, count(*) AS k FROM n WHERE parent IS NOT NULL GROUP BY parent),
f AS (SELECT n.*, coalesce(k, 0) AS k FROM n LEFT JOIN kids USING (node)),
up AS (SELECT DISTINCT x.node AS v, y.node AS w FROM m x JOIN m y ON x.seq = y.seq AND x.d <= y.d),
s AS (SELECT v, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) AS leaves, sum((n - 1) * chars) AS saved FROM up JOIN f ON f.node = w GROUP BY v)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, o.conv_id AS parent_conv_id, f.n AS n_convs, CAST(f.k AS BIGINT) AS n_children,
       CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN s ON s.v = f.node LEFT JOIN n o ON o.node = f.parent
"""
