"""A whole ingest run (L5), both sources.

Per run, in the order a crawl applies them:

  landed pages of the run (P8 page range / L4 cursor chain)
  -> postings list per page (E1-E5) -> salaried postings (P1/P2) with their
     publication time (J5), computed on the page row, no shuffle
  -> the run's stops: failed page, empty page (L1), too-old posting (L2)
  -> one row per kept posting, ``since`` filter (P5), source id (J1/J2)
  -> first per source id (A1, shuffle on the id) -> not already stored (A2)
  -> target count (L3) -> detail join (N1, E10) -> record envelope (J3, J6, J7).

Every stop keeps a prefix of pages, and first-wins dedup commutes with a
prefix cut.  So the stops are found first, on narrow page facts, and the page
that ends the run is a literal filter on the landed table: the pass that makes
the records reads the kept pages and no others.  Pages are looked at in ranges
of growing width until one holds a stop, so a run that ends early reads
little; the result does not depend on the widths.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.functions.keys import SOURCE_ID_KEYS_A, SOURCE_ID_KEYS_B, URL_KEYS_A, URL_KEYS_B, with_keys
from offerlake.functions.salary import has_salary_a, has_salary_b
from offerlake.functions.time import keep_since, since_column, with_posted_at
from offerlake.operators.dedup import count_written, first_seen, skip_existing
from offerlake.operators.details import attach_details
from offerlake.operators.extract import locate_data_list, locate_postings
from offerlake.operators.paging import (NO_STOP, contiguous_end, cursor_chain, latest_pages, page_range, run_stops,
                                        target_page)
from offerlake.session import saved, scratch_scope
from offerlake.sources.sketch import append_sketched, skip_sketched
from offerlake.sources.store import read_store, stored_ids
from offerlake.sources.tables import (DEFAULT_PAGE_SIZE_A, DEFAULT_PAGE_SIZE_B, MAX_ITEMS_B, RAW_POSTINGS,
                                      SOURCE_A, SOURCE_B)


# Pages in the first range that is searched for a stop, and the growth of the next ones.
FIRST_RANGE, RANGE_GROWTH = 1024, 8

_KEY_LISTS = {SOURCE_A: (SOURCE_ID_KEYS_A, URL_KEYS_A), SOURCE_B: (SOURCE_ID_KEYS_B, URL_KEYS_B)}


@dataclass
class RunPlan:
    records: DataFrame     # rows to append, RAW_POSTINGS layout
    quarantine: DataFrame  # the failed page that ended the run, if any
    postings: DataFrame    # kept postings before dedup (page, pos, source_id, …)
    failed_page: int | None = None  # page (source B: cursor) whose failure ended the run


def salaried_postings(pages: DataFrame, source: str, since=None,
                      keep: tuple[str, ...] = ("source", "run_id", "page", "page_error")) -> DataFrame:
    """One row per posting (``posexplode_outer``: a page with an empty or
    unreadable list keeps one row with NULL ``posting``), parsed once, with
    ``salaried`` (P1/P2), ``posted_at`` (J5) and ``old`` (older than ``since``)."""
    has_salary = has_salary_a if source == SOURCE_A else has_salary_b
    # parsed inside the list: a filter on the parsed value can't be pushed below the explode and parse it again
    parsed = F.transform("postings", lambda p: F.struct(p.alias("posting"), F.try_parse_json(p).alias("v")))
    posts = (pages.select(*keep, F.posexplode_outer(parsed).alias("pos", "_parsed"))
             .select(*keep, F.col("pos").cast("int").alias("pos"), "_parsed.posting", "_parsed.v"))
    posts = posts.withColumn("salaried", F.coalesce(has_salary(F.col("v")), F.lit(False)))
    posts = with_posted_at(posts, when=F.col("salaried"))
    since_c = since_column(since)
    old = F.coalesce(F.col("posted_at") < since_c, F.lit(False)) if since_c is not None else F.lit(False)
    return posts.withColumn("old", F.col("salaried") & old)


def page_facts(posts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Per page: ``page_error``, ``n_salaried``, ``has_old``.  The rows of a
    page come from one input row, so the partial aggregate already holds one
    row per page and the shuffle carries only those."""
    return posts.groupBy(*keys).agg(
        F.max("page_error").alias("page_error"),
        F.sum(F.col("salaried").cast("int")).alias("n_salaried"),
        F.max(F.col("old")).alias("has_old"))


def stop_facts(pages: DataFrame, source: str, since, keys: tuple[str, ...]) -> DataFrame:
    """What ``run_stops`` reads of located pages, one row per page.

    Without ``since`` a page only tells whether it has a salaried posting (``n_salaried`` 1 or 0): its postings are
    parsed up to the first one, on the page row.  ``pages`` has one row per value of ``keys``."""
    if since is not None:
        return page_facts(salaried_postings(pages, source, since, keep=(*keys, "page_error")), keys)
    has_salary = has_salary_a if source == SOURCE_A else has_salary_b
    some = F.exists("postings", lambda p: F.coalesce(has_salary(F.try_parse_json(p)), F.lit(False)))
    return pages.select(*keys, "page_error", F.coalesce(some, F.lit(False)).cast("bigint").alias("n_salaried"),
                        F.lit(False).alias("has_old"))


def _ranges(first: int, last: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of growing width that cover ``first`` to ``last``."""
    width = FIRST_RANGE
    while first <= last:
        yield first, min(last, first + width - 1)
        first, width = first + width, width * RANGE_GROWTH


@dataclass
class RunPages:
    """Where a run ends, and its landed pages up to there."""

    pages: DataFrame              # landed rows of the run's pages; source B with ``page`` from the chain
    order: str                    # their order: page (A) or cursor (B)
    upto: int                     # last value of ``order`` that is read
    numbers: DataFrame | None     # source B: (cursor, page) of the chain
    bad: int | None               # value of ``order`` of the failed page that ended the run


def _stop_of(facts: DataFrame) -> tuple[int, int | None]:
    """Last page by L1, L2 and failed pages (``NO_STOP``: none), and the failed page if that is what ended the run."""
    row = run_stops(facts).select("last_page", "first_bad_page").first()
    if row is None:
        return NO_STOP, None
    return row["last_page"], row["first_bad_page"] if row["first_bad_page"] == row["last_page"] + 1 else None


def find_run_a(landed: DataFrame, *, run_id: str, max_pages: int | None, start_page: int = 1, since=None) -> RunPages:
    """The pages of a source-A run."""
    pages = latest_pages(page_range(landed.where((F.col("source") == SOURCE_A) & (F.col("run_id") == run_id)),
                                    start_page, max_pages), "page")
    end = contiguous_end(pages, start_page).first()
    end = end["contiguous_last"] if end is not None else start_page - 1
    upto, bad = end, None
    for lo, hi in _ranges(start_page, end):
        some = locate_postings(pages.where(F.col("page").between(lo, hi)))
        last, bad = _stop_of(stop_facts(some, SOURCE_A, since, ("source", "run_id", "page")))
        if last != NO_STOP:
            upto = min(end, last)
            break
    return RunPages(pages.where(F.col("page") <= upto), "page", upto, None, bad)


def find_run_b(landed: DataFrame, *, run_id: str, max_pages: int | None, start_page: int = 1, since=None,
               page_size: int | None = None) -> RunPages:
    """The pages of a source-B run, numbered along the cursor chain.

    One pass over a range of cursors gives each page's successor and its
    facts; the chain and the stops are found on those narrow rows."""
    size = page_size or DEFAULT_PAGE_SIZE_B
    if start_page < 1:
        raise ValueError("start_page must be 1 or more")
    start, step = (start_page - 1) * size, min(size, MAX_ITEMS_B)
    pages = landed.where((F.col("source") == SOURCE_B) & (F.col("run_id") == run_id) & (F.col("cursor") >= start))
    pages = latest_pages(pages, "cursor")
    top = pages.agg(F.max("cursor").alias("c")).first()["c"]
    seen, numbers, bad = None, None, None
    keys = ("source", "run_id", "cursor", "next_cursor", "items_count")
    for lo, hi in _ranges(start // step, (top if top is not None else -1) // step):
        some = locate_data_list(pages.where(F.col("cursor").between(lo * step, hi * step + step - 1)))
        facts = saved(stop_facts(some, SOURCE_B, since, keys), "page-facts")
        seen = facts if seen is None else seen.unionByName(facts)
        numbers = saved(cursor_chain(seen, start, max_pages, step, stored=True), "chain")
        end = numbers.agg(F.max("cursor").alias("c"), F.max("page").alias("p")).first()
        if end["c"] is None:
            break
        on_chain = seen.join(numbers, ["source", "run_id", "cursor"])
        last, bad = _stop_of(on_chain)
        if last != NO_STOP:
            if bad is not None:
                bad = numbers.where(F.col("page") == bad).select("cursor").first()["cursor"]
            numbers = numbers.where(F.col("page") <= last)
            break
        # the chain goes on only if its last known page points beyond this range
        ahead = on_chain.where(F.col("cursor") == end["c"]).select(
            F.coalesce("next_cursor", F.col("cursor") + F.coalesce("items_count", F.lit(step))).alias("to")).first()["to"]
        if ahead <= hi * step + step - 1 or max_pages is not None and end["p"] >= max_pages:
            break
    if numbers is None:
        return RunPages(pages.where(F.lit(False)), "cursor", -1, None, None)
    upto = numbers.agg(F.max("cursor").alias("c")).first()["c"]
    numbers = numbers.select("cursor", "page")
    upto = -1 if upto is None else upto
    return RunPages(pages.where(F.col("cursor") <= upto), "cursor", upto, numbers, bad)


def _kept_postings(run: RunPages, source: str, since, upto: int | None = None, after: int | None = None) -> DataFrame:
    """Kept postings with their keys, in pages from ``after`` up to ``upto`` (filters that reach the scan)."""
    pages = run.pages if upto is None else run.pages.where(F.col(run.order) <= upto)
    pages = pages if after is None else pages.where(F.col(run.order) >= after)
    if source == SOURCE_B:
        # pages that are landed but off the chain; adaptive execution broadcasts the narrow side if it is small
        pages = pages.join(run.numbers.select("cursor"), "cursor", "left_semi") if run.numbers is not None else pages
        pages = locate_data_list(pages)
    else:
        pages = locate_postings(pages)
    posts = salaried_postings(pages, source, since, keep=("source", "run_id", run.order)).where(F.col("salaried"))
    posts = posts.where(keep_since(F.col("posted_at"), since_column(since)))
    # every key is read from the parsed posting before the shuffle; the
    # VARIANT copy is dropped so only the JSON text travels
    return with_keys(posts, *_KEY_LISTS[source]).select(
        "source", "run_id", run.order, "pos", "posting", "source_id", "job_slug", "url")


def plan_run(spark: SparkSession, landed: DataFrame, *, source: str, run_id: str,
             max_pages: int | None, ingest_date: dt.date, start_page: int = 1,
             since: dt.datetime | None = None, target_count: int | None = None,
             store_path: str | None = None, scope: str = "date",
             details: DataFrame | None = None, fetch_details: bool | None = None,
             ingested_at: dt.datetime | None = None, page_size: int | None = None) -> RunPlan:
    """The records one run writes, as a plan.

    Planning runs jobs: they find the run's last page on narrow rows (and,
    with details, write the new records once).  The records themselves are
    computed when the plan is used."""
    if fetch_details is None:
        fetch_details = source == SOURCE_A
    if source == SOURCE_A:
        run = find_run_a(landed, run_id=run_id, max_pages=max_pages, start_page=start_page, since=since)
    else:
        run = find_run_b(landed, run_id=run_id, max_pages=max_pages, start_page=start_page, since=since, page_size=page_size)
    at_bad = landed.where((F.col("source") == source) & (F.col("run_id") == run_id))
    at_bad = at_bad.where(F.lit(False) if run.bad is None else F.col(run.order) == int(run.bad))
    located = locate_postings(at_bad) if source == SOURCE_A else locate_data_list(at_bad)
    quarantine = located.where(F.col("page_error").isNotNull()).select(
        "source", "run_id", "page", "cursor", F.col("page_error").alias("reason"), "body")

    order = (run.order, "pos")
    if scope == "all_dates" and store_path is not None:
        def skip(df):  # the key sketch names the few ids that the store may hold, and only those meet its id column
            return skip_sketched(saved(df, "first-seen"), store_path, source=source)
    else:
        stored = stored_ids(spark, store_path, source, ingest_date, scope)

        def skip(df):
            return skip_existing(df, stored)
    if target_count:
        run.pages = run.pages.where(F.col(run.order) <= _target(run, source, since, skip, target_count, order))
    posts = _kept_postings(run, source, since)
    new = skip(first_seen(posts, order=order))
    if source == SOURCE_B:
        empty = spark.createDataFrame([], "cursor long, page int")
        numbers = run.numbers if run.numbers is not None else empty
        new, posts = new.join(numbers, "cursor"), posts.join(numbers, "cursor")
    if details is not None and fetch_details:
        new = saved(new, "new-records")  # read for their slugs and for the join
    new = attach_details(new, details if fetch_details else None, source)
    stamp = (F.lit(ingested_at.isoformat(sep=" ")).cast("timestamp") if ingested_at is not None
             else F.current_timestamp())
    records = new.select(
        "source_id", "job_slug", stamp.alias("ingested_at"), F.col("page").cast("int").alias("page"), "url",
        F.col("posting").alias("listing"), "details", "sections", "run_id", "source",
        F.lit(ingest_date).cast("date").alias("ingest_date"))
    return RunPlan(records=records.select(*[f.name for f in RAW_POSTINGS.fields]), quarantine=quarantine,
                   postings=posts.select("source", "run_id", "page", "pos", "posting", "source_id", "job_slug", "url"),
                   failed_page=run.bad)


def _target(run: RunPages, source: str, since, skip, target_count: int, order: tuple[str, str]) -> int:
    """L3: the value of the run's order on which ``target_count`` new records are reached, else its last one.

    Only ids and places are deduplicated and counted, over growing ranges of
    pages.  A range reads its own pages: the ids that are new in it are written,
    and the next ranges leave them out and count on from them."""
    first = run.pages.agg(F.min(run.order).alias("c")).first()["c"]
    if first is None:
        return run.upto
    unit = 1 if source == SOURCE_A else MAX_ITEMS_B
    seen, missing = None, target_count
    with scratch_scope(run.pages.sparkSession):
        for lo, hi in _ranges(first // unit, run.upto // unit):
            after, upto = lo * unit, min(run.upto, hi * unit + unit - 1)
            ids = _kept_postings(run, source, since, upto, after).select("source", "run_id", run.order, "pos", "source_id")
            new = saved(skip(skip_existing(first_seen(ids, order=order), seen)).withColumn("page", F.col(run.order)), "target-ids")
            stop = target_page(new, missing).first()
            if stop is not None:
                return int(stop["stop_page"])
            missing -= new.count()
            known = new.select("source", "source_id")
            seen = known if seen is None else seen.unionByName(known)
    return run.upto


def run_ingest(spark: SparkSession, landed: DataFrame, *, store_path: str, on_bad_page: str = "quarantine",
               quarantine_path: str | None = None, **kwargs) -> DataFrame:
    """Plan, check for a failed page, append to the store; returns A3 counts.

    ``on_bad_page='fail'`` raises and writes nothing when the run reaches a
    page that cannot be read; ``'quarantine'`` writes the pages before it
    (what the reference leaves on disk) and appends the failed page to
    ``quarantine_path`` (default: a folder beside the store).  The counts are
    read back from the written partition (pruned by source and date, filtered
    on this write's stamp), so the records are computed once."""
    stamp = kwargs.pop("ingested_at", None) or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    plan = plan_run(spark, landed, store_path=store_path, ingested_at=stamp, **kwargs)
    if on_bad_page == "fail" and plan.failed_page is not None:
        row = plan.quarantine.select("page", "cursor", "reason").first()
        raise RuntimeError(f"unreadable listing page {row['page']} (cursor {row['cursor']}): {row['reason']}")
    append_sketched(plan.records, store_path, stamp)
    if plan.failed_page is not None:
        path = quarantine_path or f"{store_path.rstrip('/')}_quarantine"
        plan.quarantine.write.mode("append").partitionBy("source").parquet(path)
    written = (read_store(spark, store_path, kwargs["source"], kwargs["ingest_date"])
               .where((F.col("run_id") == kwargs["run_id"])
                      & (F.col("ingested_at") == F.lit(stamp.isoformat(sep=" ")).cast("timestamp"))))
    return count_written(written)


def plan_sources(spark: SparkSession, landed: DataFrame, runs: list[dict], **common) -> DataFrame:
    """Several runs (e.g. one per source) as one frame of records."""
    out = None
    for r in runs:
        rec = plan_run(spark, landed, **{**common, **r}).records
        out = rec if out is None else out.unionByName(rec)
    return out


__all__ = ["RunPlan", "find_run_a", "find_run_b", "page_facts", "plan_run", "plan_sources", "run_ingest",
           "salaried_postings", "DEFAULT_PAGE_SIZE_A", "DEFAULT_PAGE_SIZE_B"]
