"""Ordered stops over pages (L1-L4) and the page range.

A crawl reads pages in order and stops on the first of several conditions.
Each stop keeps a *prefix* of pages, so each is a per-run ``min(page)``
over page-level facts, followed by a filter: no sequential loop.  Page-level
facts are computed on the page row itself (one body = one row), so the only
aggregations are per run and partially aggregated before their shuffle.

Running totals over pages use ``blocked_running_sum``: pages are grouped in
fixed-width key ranges, summed within each block, and offset by the running
total of earlier blocks, so no window ever holds a whole run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlake.session import saved

RUN_KEYS = ("source", "run_id")
NO_STOP = 2**31 - 1
# Width of a block of consecutive page numbers / cursors for running totals.
PAGE_BLOCK = 4096


def blocked_running_sum(df: DataFrame, part: Sequence[str], order: str, value: Column | str,
                        out: str, block_width: int = PAGE_BLOCK) -> DataFrame:
    """``sum(value) over (partition by part order by order rows unbounded
    preceding)`` for a non-negative integer ``order`` unique within ``part``.

    Each window partition is one block of at most ``block_width`` keys; the
    block totals (one row per block) get their own running sum and are joined
    back.
    """
    part = list(part)
    value = F.col(value) if isinstance(value, str) else value
    blk = F.floor(F.col(order) / F.lit(block_width)).cast("bigint")
    d = df.withColumn("_blk", blk).withColumn("_val", value.cast("bigint"))
    w_in = (Window.partitionBy(*part, "_blk").orderBy(order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    d = d.withColumn("_in", F.sum("_val").over(w_in))
    totals = d.groupBy(*part, "_blk").agg(F.sum("_val").alias("_tot"))
    w_blk = Window.partitionBy(*part).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_off", F.coalesce(F.sum("_tot").over(w_blk), F.lit(0))).drop("_tot")
    return (d.join(offsets, part + ["_blk"], "inner")
             .withColumn(out, F.col("_off") + F.col("_in"))
             .drop("_blk", "_val", "_in", "_off"))


def page_range(pages: DataFrame, start_page: int = 1, max_pages: int | None = None,
               col: str = "page") -> DataFrame:
    """Pages ``start_page … start_page + max_pages - 1`` (pushed to the scan
    when ``page`` is a stored column)."""
    if start_page < 1:
        raise ValueError("start_page must be 1 or more")
    c = F.col(col) >= start_page
    if max_pages is not None:
        c = c & (F.col(col) <= start_page + max_pages - 1)
    return pages.where(c)


def latest_pages(pages: DataFrame, key: str, part: Sequence[str] = RUN_KEYS) -> DataFrame:
    """One landed row per run and ``key`` (page or cursor): of a page that was
    fetched again, the latest response (ties: the larger body hash).

    The keys alone tell whether any page has two rows; only such pages' bodies
    are shuffled."""
    cols = [*part, key]
    twice = pages.select(*cols).groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    if twice.isEmpty():
        return pages
    twice = saved(twice, "twice-fetched")
    newest = Window.partitionBy(*cols).orderBy(F.desc("fetched_at"), F.desc(F.xxhash64("body")))
    again = (pages.join(twice, cols, "left_semi").withColumn("_rn", F.row_number().over(newest))
             .where("_rn = 1").drop("_rn"))
    return pages.join(twice, cols, "left_anti").unionByName(again)


def contiguous_end(pages: DataFrame, start_page: int, part: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Last page of the unbroken run of landed pages starting at ``start_page``
    (a page that was never landed ends the crawl).  One row per run:
    ``(part…, contiguous_last)``; ``start_page - 1`` when the first page is missing."""
    part = list(part)
    keys = pages.select(*part, "page").distinct()
    has_next = keys.select(*part, (F.col("page") - 1).alias("page"))
    ends = keys.join(has_next, part + ["page"], "left_anti")
    first = keys.groupBy(*part).agg(F.min("page").alias("_first"))
    last = ends.groupBy(*part).agg(F.min("page").alias("_end"))
    return (first.join(last, part, "left")
            .select(*part, F.when(F.col("_first") == start_page, F.col("_end"))
                    .otherwise(F.lit(start_page - 1)).alias("contiguous_last")))


def run_stops(pages: DataFrame, part: Sequence[str] = RUN_KEYS) -> DataFrame:
    """L1 + L2 + failed pages, one row per run.

    Input page rows carry ``page``, ``page_error``, ``n_salaried`` and
    ``has_old`` (a salaried posting older than the cutoff).  Output
    ``last_page``: the first page that failed or had no salaried posting is
    not read (the crawl stops before it), the first page with an old posting
    is the last one read; ``NO_STOP`` if no page stops the run.
    ``first_bad_page`` is reported for quarantine.
    """
    bad = F.col("page_error").isNotNull()
    return (pages.groupBy(*part).agg(
        F.min(F.when(bad, F.col("page"))).alias("first_bad_page"),
        F.min(F.when(~bad & (F.col("n_salaried") == 0), F.col("page"))).alias("_empty"),
        F.min(F.when(~bad & F.col("has_old"), F.col("page"))).alias("_old"))
        .withColumn("last_page", F.least(F.col("first_bad_page") - 1, F.col("_empty") - 1, F.col("_old"),
                                         F.lit(NO_STOP)))
        .drop("_empty", "_old"))


def target_page(records: DataFrame, target_count: int, part: Sequence[str] = RUN_KEYS) -> DataFrame:
    """L3: per run the page on which the running count of ``records`` (a row
    per new record, with ``page``) reaches ``target_count``; no row if it never does."""
    part = list(part)
    per_page = records.groupBy(*part, "page").agg(F.count(F.lit(1)).alias("_n"))
    cum = blocked_running_sum(per_page, part, "page", "_n", "_cum")
    return (cum.where(F.col("_cum") >= target_count)
            .groupBy(*part).agg(F.min("page").alias("stop_page")))


def _next_landed(keys: DataFrame, part: Sequence[str], width: int) -> DataFrame:
    """``keys`` with ``_next``, the next landed cursor of the run (NULL for the last one)."""
    part = list(part)
    keys = keys.withColumn("_blk", F.floor(F.col("cursor") / F.lit(width)).cast("bigint"))
    firsts = keys.groupBy(*part, "_blk").agg(F.min("cursor").alias("_first"))  # one row per block
    after = firsts.select(*part, "_blk", F.lead("_first").over(Window.partitionBy(*part).orderBy("_blk")).alias("_after"))
    within = F.lead("cursor").over(Window.partitionBy(*part, "_blk").orderBy("cursor"))
    return (keys.withColumn("_next", within).join(after, [*part, "_blk"])
            .withColumn("_next", F.coalesce("_next", "_after")).drop("_blk", "_after"))


def cursor_chain(pages: DataFrame, start_cursor: int, max_pages: int | None,
                 default_step: int, part: Sequence[str] = RUN_KEYS, stored: bool = False) -> DataFrame:
    """L4: the cursor pages of a run that a crawl from ``start_cursor`` requests,
    numbered from 1; the next cursor is the page's ``next_cursor`` if given,
    else ``cursor + items_count``.

    Input: a row per landed page with ``cursor``, ``next_cursor`` and
    ``items_count`` (``stored``: read from a written table).  Output: ``(part…, cursor, page)``, the chain up to the
    first page whose successor is not landed or does not move forward, at
    most ``max_pages`` of it.

    Exact, on narrow rows: a stretch is a run of landed pages that each point
    to the next landed one.  A chain that enters a stretch goes on to its end,
    so only the stretches' ends have to be followed: by pointer doubling, the
    first 2^k stretches of the chain are known after k rounds of two joins.
    A page off the chain is never reached, whatever it points to.
    """
    if start_cursor < 0:
        raise ValueError("a cursor must be 0 or more")
    part = list(part)
    step = F.coalesce(F.col("items_count"), F.lit(default_step)).cast("bigint")
    width = PAGE_BLOCK * max(default_step, 1)
    keys = pages.where(F.col("cursor") >= start_cursor).select(
        *part, "cursor", F.coalesce(F.col("next_cursor"), F.col("cursor") + step).alias("to"))
    keys = keys if stored else saved(keys, "chain-keys")
    flagged = _next_landed(keys, part, width).withColumn("_end", (~F.col("to").eqNullSafe(F.col("_next"))).cast("int"))
    counted = blocked_running_sum(flagged.withColumn("_one", F.lit(1)), part, "cursor", "_one", "pos", width)
    counted = blocked_running_sum(counted, part, "cursor", "_end", "_ends", width)
    placed = saved(counted.select(*part, "cursor", "to", "pos", (F.col("_ends") - F.col("_end")).alias("stretch"),
                                  (F.col("_end") == 1).alias("last")), "chain-places")
    ends = placed.where("last").select(*part, "stretch", F.col("pos").alias("end"), "cursor", "to")
    entry = placed.select(*part, F.col("cursor").alias("to"), F.col("stretch").alias("into"), F.col("pos").alias("at"))
    # from the end of a stretch: the stretch it points into, the place there, that stretch's end, pages in between
    jump = (ends.where("to > cursor").join(entry, [*part, "to"])
            .join(ends.select(*part, F.col("stretch").alias("into"), F.col("end").alias("into_end")), [*part, "into"])
            .select(*part, "stretch", "into", "at", "into_end", F.lit(0).cast("bigint").alias("between")))
    # a stretch on the chain: where it is entered, its end, pages of the chain before it
    reached = (placed.where(F.col("cursor") == start_cursor).select(*part, "stretch", F.col("pos").alias("at"))
               .join(ends.select(*part, "stretch", "end"), [*part, "stretch"])
               .withColumn("before", F.lit(0).cast("bigint")))
    while True:
        ahead = reached.withColumnRenamed("at", "from").join(jump, [*part, "stretch"]).select(
            *part, F.col("into").alias("stretch"), "at", F.col("into_end").alias("end"),
            (F.col("before") + F.col("end") - F.col("from") + 1 + F.col("between")).alias("before"))
        if max_pages is not None:
            ahead = ahead.where(F.col("before") < max_pages)
        ahead = saved(ahead, "chain-ahead")
        if ahead.isEmpty():
            break
        reached = reached.unionByName(ahead)
        second = jump.select(*part, F.col("stretch").alias("into"), F.col("into").alias("into2"), F.col("at").alias("at2"),
                             F.col("into_end").alias("end2"), F.col("between").alias("between2"))
        jump = saved(jump.join(second, [*part, "into"]).select(
            *part, "stretch", F.col("into2").alias("into"), F.col("at2").alias("at"), F.col("end2").alias("into_end"),
            (F.col("between") + F.col("into_end") - F.col("at") + 1 + F.col("between2")).alias("between")), "chain-jumps")
    chain = placed.join(reached.drop("end"), [*part, "stretch"]).where("pos >= at").select(
        *part, "cursor", (F.col("before") + F.col("pos") - F.col("at") + 1).cast("int").alias("page"))
    return chain if max_pages is None else chain.where(F.col("page") <= max_pages)
