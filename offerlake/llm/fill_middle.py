"""Fill-in-the-middle transformation, cut by an indexable skip list.

A text's units are its lines (with their line ends).  The units form the
lowest lane of a skip list; each higher lane keeps every unit whose tower
reaches it, about a quarter of the lane below.  A link of a lane carries the
number of units and of code points (and bytes) that it passes, so a descent
that adds up widths stands exactly before the unit of a given rank, after
about four links a lane, and knows where in the text that is.

Two keyed ranks cut a text into prefix, middle and suffix; keyed draws decide
whether it stays plain and which of the two orders it is written in:

* psm: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle
* spm: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle

``restore`` gives the exact text back from output and form.  The draws are
the first four 8-digit groups of the hex SHA-256 of ``seed:doc_id``.

Defined cases: a null text is empty; empty texts, texts that hold a mark, and
those outside ``rate`` stay plain; a null doc_id is the empty string in the
key; repeated rows are cut alike; an empty table gives an empty one.  Columns
of the input named like an added one are replaced.  A task holds the lanes of
one text at a time, at most 4/3 links of 32 bytes a line.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlake.llm import _text as X

MARKS = ("<P>", "<S>", "<M>")
SEED = 7
#: Per cent of the texts that are transformed, and of these that are written suffix first.
RATE, SPM_SHARE = 100, 50
#: Bits of a unit's hash that must be 0 for each further lane of its tower.
TOWER_BITS = 2


class SkipList:
    """An indexable skip list over units of given widths in bytes and in code points."""

    def __init__(self, n_bytes: np.ndarray, points: np.ndarray):
        """Lanes from the lowest up: for each node its place in the lane below, and what its link passes."""
        self.units = len(points)
        tower = X.mix(np.arange(self.units, dtype=np.uint64) + np.uint64(1))
        node = np.arange(self.units)  # the units that stand in the lane
        self.lanes = [(node, np.ones(self.units, np.int64), points.astype(np.int64), n_bytes.astype(np.int64))]
        while len(node) > 8:
            tower >>= np.uint64(TOWER_BITS)
            up = (tower & np.uint64((1 << TOWER_BITS) - 1)) == 0
            up[0] = True  # the head stands in every lane
            below = np.flatnonzero(up)
            if len(below) == len(node):
                break
            self.lanes.append((below, *(np.add.reduceat(width, below) for width in self.lanes[-1][1:])))
            node, tower = node[below], tower[below]

    def seek(self, rank: int) -> tuple[int, int]:
        """(code points, bytes) before the unit of that rank; all of them for the number of units."""
        if not 0 <= rank <= self.units:
            raise IndexError(rank)
        at, passed, points, size = 0, 0, 0, 0
        for lane, (below, units, width, n_bytes) in reversed(list(enumerate(self.lanes))):
            while at < len(units) and passed + units[at] <= rank:
                passed, points, size = passed + int(units[at]), points + int(width[at]), size + int(n_bytes[at])
                at += 1
            if passed == rank:
                break
            at = int(below[at]) if lane else at
        return points, size


def lines(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Widths in bytes and in code points of the lines of a UTF-8 text."""
    buf = np.frombuffer(raw, np.uint8)
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.concatenate(([0], np.flatnonzero(buf[:-1] == 10) + 1))
    points = np.add.reduceat((buf & 0xC0) != 0x80, starts, dtype=np.int64)
    return np.diff(np.append(starts, len(buf))), points


def draws(doc_id: str, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit draws of each row."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


CUT = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
    T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
    T.StructField("output", T.StringType()),
])


def _check_marks(marks: tuple[str, str, str]) -> None:
    """An output is read back by its marks: none begins another, and their first characters stand nowhere else in a mark."""
    begins = sum(a.startswith(b) for a in marks for b in marks)  # each begins itself
    if not all(marks) or begins > 3 or any(m[0] in other[1:] for m in marks for other in marks):
        raise ValueError(f"marks {marks}: none may begin another, and their first characters may stand nowhere else in them")


def transform(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None, seed: int = SEED,
              rate: int = RATE, spm_share: int = SPM_SHARE, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """``docs`` with n (lines), form, prefix_chars, middle_chars and output."""
    _check_marks(marks)
    pre, suf, mid = (m.encode() for m in marks)
    names = list(docs.columns if keep is None else keep)
    new = {f.name for f in CUT}
    kept = [c for c in names if c.lower() not in new]
    h1, h2, h3, h4 = draws(doc_id, seed)
    rows = docs.select(F.struct(*kept).alias("__row") if kept else F.lit(None).alias("__row"), F.col(text).alias("__text"),
                       h1.alias("__h1"), h2.alias("__h2"), (h3 % 100 < rate).alias("__changed"), (h4 % 100 < spm_share).alias("__spm"))

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        data, starts, ends = X.utf8(batch.column("__text"))
        h1, h2, changed, spm = (batch.column(c).to_pylist() for c in ("__h1", "__h2", "__changed", "__spm"))
        out: list[tuple] = []
        for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
            raw = data[a:b].tobytes()
            n_bytes, points = lines(raw)
            n = len(points)
            if not changed[i] or not raw or pre in raw or suf in raw or mid in raw:
                out.append((n, "plain", None, None, raw))
                continue
            units = SkipList(n_bytes, points)
            (first, x), (second, y) = (units.seek(r) for r in sorted((h1[i] % (n + 1), h2[i] % (n + 1))))
            parts = (suf, raw[y:], pre, raw[:x], mid, raw[x:y]) if spm[i] else (pre, raw[:x], suf, raw[y:], mid, raw[x:y])
            out.append((n, "spm" if spm[i] else "psm", first, second - first, b"".join(parts)))
        n, form, prefix, middle, output = zip(*out) if out else [()] * 5
        return [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
                pa.array(output, pa.binary()).cast(pa.string(), safe=False)]

    found = X.add_columns(rows, compute, CUT, ["__row"])
    return found.select(*[F.col("__row").getField(c).alias(c) for c in kept], *new_columns())


def new_columns() -> list[str]:
    return CUT.names


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The exact text that was transformed."""
    part = F.split(output, "|".join(re.escape(m) for m in marks), -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])) \
            .when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op11: per document, its form, its cuts, and digests of the output and of the text restored from it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = transform(docs, keep=["doc_id"])
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
                  sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT doc_id, t, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
             CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                  WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                   ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
