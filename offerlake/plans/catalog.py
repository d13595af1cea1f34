"""Registered queries: one per operator group, each over the driver tables.

Every query builds landed-response fixtures from the base tables in Spark
(``offerlake.sources.fixtures``) and runs the operators on them.  Its work
grows with the tables, except where reading a prefix is the operator itself
(page range, target stop).  ``ORACLE_SQL`` states the same answer directly on the
base tables in plain SQL (DuckDB dialect).  Integers are BIGINT, times are
epoch microseconds, lists are joined with ``|``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.functions.keys import job_slug, source_id_a, source_id_b, url_a
from offerlake.functions.salary import has_salary_a, has_salary_b
from offerlake.functions.text import with_html_text
from offerlake.functions.time import keep_since, posted_at, resolve_date, resolve_since, since_column
from offerlake.operators.corpus import keep_first_copy, query_terms, search_text, tf_idf
from offerlake.operators.dedup import count_written, first_seen, skip_existing
from offerlake.operators.details import attach_details, with_sections
from offerlake.operators.extract import explode_postings, first_list, locate_data_list, locate_postings
from offerlake.operators.near import PERCENT, SHINGLE, near_dedupe
from offerlake.operators.paging import cursor_chain, page_range
from offerlake.operators.postings import PostingsIndex
from offerlake.operators.vectors import VectorIndex, search_vectors
from offerlake.plans.ingest import plan_run, plan_sources
from offerlake.session import configure, saved, scratch_path
from offerlake.sources.fixtures import damaged_a, landed, odd_cursors_b, table
from offerlake.sources.sketch import append_sketched, skip_sketched
from offerlake.sources.store import append_records, stored_ids
from offerlake.sources.tables import QUARANTINE, RAW_POSTINGS, SOURCE_A, SOURCE_B

RUN_DATE = resolve_date("2024-02-01")  # P7
STAMP = dt.datetime(2024, 2, 1, 12, 0, 0)
UNLIMITED = 10**9
#: Micro-batches of the stream query.
BATCHES = 4


def _a_postings(spark: SparkSession, sf: str) -> DataFrame:
    return explode_postings(locate_postings(landed(spark, sf, "a")), ["source", "run_id", "page"])


def _b_postings(spark: SparkSession, sf: str) -> DataFrame:
    return explode_postings(locate_data_list(landed(spark, sf, "b")), ["source", "run_id", "cursor"])


def _id(col: str = "v") -> F.Column:
    return F.try_variant_get(F.col(col), "$.id", "bigint")


def _big(c: str) -> F.Column:
    return F.col(c).cast("bigint").alias(c)


# --------------------------------------------------------------------------- E, S


def q_locate_postings(spark, sf):
    """Every posting of every page, nested pages included."""
    return _a_postings(spark, sf).select(_big("page"), _big("pos"), _id().alias("id"))


def q_locate_data_list(spark, sf):
    """Source-B ``data`` lists."""
    return _b_postings(spark, sf).select(
        "cursor", _big("pos"), _id().alias("id"),
        F.try_variant_get("v", "$.slug", "string").alias("slug"))


def q_cursor_chain(spark, sf):
    """E5 L4: the cursor chain, numbered from 1; landed batches that it skips have no number."""
    pages = locate_data_list(landed(spark, sf, "b_skips"))
    chain = cursor_chain(pages, start_cursor=0, max_pages=None, default_step=100)
    return pages.drop("page").join(chain, ["source", "run_id", "cursor"]).select(
        _big("page"), "cursor", F.col("next_cursor").alias("api_next"),
        F.coalesce("next_cursor", F.col("cursor") + F.col("items_count")).alias("next_cursor"))


def q_first_list(spark, sf):
    """The first of postings / content / data that is a list, on both
    sources' bodies; nested pages have none, which is an error (E3 does not search)."""
    a = landed(spark, sf, "a").select("source", F.col("page").cast("bigint").alias("at"), "body")
    b = landed(spark, sf, "b").select("source", F.col("cursor").alias("at"), "body")
    both = first_list(a.unionByName(b))
    return both.select("source", "at", F.col("page_error").isNotNull().alias("failed"),
                       F.posexplode_outer("postings").alias("pos", "posting")).select(
        "source", "at", "failed", _big("pos"), F.get_json_object("posting", "$.slug").alias("slug"),
        F.get_json_object("posting", "$.url").alias("url"))


def q_strict_bodies_a(spark, sf):
    """E1 on pages of which some are not one JSON document."""
    pages = locate_postings(damaged_a(landed(spark, sf, "a")))
    return pages.select(_big("page"), F.col("page_error").isNotNull().alias("failed"),
                        F.size("postings").cast("bigint").alias("n_postings"))


def q_strict_bodies_b(spark, sf):
    """Next cursors that are numbers, texts, decimals and none of these."""
    pages = locate_data_list(odd_cursors_b(landed(spark, sf, "b")))
    return pages.select("cursor", F.col("page_error").isNotNull().alias("failed"), "next_cursor",
                        F.size("postings").cast("bigint").alias("n_postings"))


# --------------------------------------------------------------------------- P


def q_has_salary_truthy(spark, sf):
    """P1 P4."""
    return _a_postings(spark, sf).where(has_salary_a(F.col("v"))).select(_id().alias("id"))


def q_has_salary_numeric(spark, sf):
    """P2 P3."""
    return _b_postings(spark, sf).where(has_salary_b(F.col("v"))).select("cursor", _big("pos"))


def q_since_filter(spark, sf):
    """P5 with an absolute cutoff."""
    since = since_column(resolve_since("1998-01-01"))
    p = _a_postings(spark, sf).withColumn("ts", posted_at(F.col("v")))
    return p.where(keep_since(F.col("ts"), since)).select(_id().alias("id"), F.unix_micros("ts").alias("posted_us"))


def q_since_window(spark, sf):
    """P5 with a relative window (P6) from a fixed 'now'."""
    since = since_column(resolve_since(window="last_year", now=dt.datetime(2000, 6, 30, tzinfo=dt.timezone.utc)))
    p = _a_postings(spark, sf).withColumn("ts", posted_at(F.col("v")))
    return p.where(keep_since(F.col("ts"), since)).select(_id().alias("id"))


def q_page_range(spark, sf):
    """Pages 5 … 504 of the run."""
    pages = page_range(landed(spark, sf, "a"), start_page=5, max_pages=500)
    return explode_postings(locate_postings(pages), ["page"]).select(_big("page"), _big("pos"), _id().alias("id"))


# --------------------------------------------------------------------------- J


def q_source_id_a(spark, sf):
    """J1."""
    return _a_postings(spark, sf).select(_id().alias("id"), source_id_a(F.col("v"), F.col("posting")).alias("source_id"))


def q_job_slug(spark, sf):
    """J3."""
    return _a_postings(spark, sf).select(_id().alias("id"), job_slug(F.col("v"), F.col("posting")).alias("job_slug"))


def q_url(spark, sf):
    """J6."""
    return _a_postings(spark, sf).select(_id().alias("id"), url_a(F.col("v")).alias("url"))


def q_source_id_b(spark, sf):
    """J2."""
    return _b_postings(spark, sf).select("cursor", _big("pos"),
                                         source_id_b(F.col("v"), F.col("posting")).alias("source_id"))


def q_content_id(spark, sf):
    """Postings without any id key get the content hash."""
    c = table(spark, sf, "customer")
    posting = F.to_json(F.struct(F.col("c_custkey").alias("cust"), F.col("c_name").alias("name"),
                                 F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")))
    p = c.select(posting.alias("posting")).withColumn("v", F.try_parse_json("posting"))
    return p.select(F.try_variant_get("v", "$.cust", "bigint").alias("cust"),
                    source_id_a(F.col("v"), F.col("posting")).alias("source_id"))


def q_posted_at(spark, sf):
    """J5."""
    return _a_postings(spark, sf).select(_id().alias("id"), F.unix_micros(posted_at(F.col("v"))).alias("posted_us"))


# --------------------------------------------------------------------------- A, N, E10, E9


def _salaried_a(spark, sf):
    p = _a_postings(spark, sf).where(has_salary_a(F.col("v")))
    return p.withColumn("source_id", source_id_a(F.col("v"), F.col("posting")))


def q_first_seen(spark, sf):
    """A1: first posting per source id in (page, pos) order."""
    return first_seen(_salaried_a(spark, sf)).select("source_id", _big("page"), _id().alias("id"))


def _stored_record(df: DataFrame) -> DataFrame:
    return df.select(
        "source_id", F.col("source_id").alias("job_slug"), F.lit(STAMP).cast("timestamp").alias("ingested_at"),
        F.col("page").cast("int").alias("page"), F.lit(None).cast("string").alias("url"),
        F.col("posting").alias("listing"), F.lit(None).cast("string").alias("details"),
        F.lit(None).cast(RAW_POSTINGS["sections"].dataType).alias("sections"),
        F.lit("earlier").alias("run_id"), "source", F.lit(RUN_DATE).alias("ingest_date"))


def q_skip_existing(spark, sf):
    """A store holding the postings of every 50th order is written
    first; the first-seen postings not in it remain."""
    store = scratch_path(spark, "store-skip")
    sal = _salaried_a(spark, sf)
    append_records(_stored_record(sal.where(_id() % 50 == 0)), store)
    new = skip_existing(first_seen(sal), stored_ids(spark, store, SOURCE_A, RUN_DATE))
    return new.select("source_id", _big("page"), _id().alias("id"))


def q_skip_sketched(spark, sf):
    """A2 by the key sketch: the store of every 50th order, over three dates; the
    first-seen postings that no date holds remain."""
    store = scratch_path(spark, "store-sketched")
    sal = _salaried_a(spark, sf)
    for i in range(3):
        stamp = STAMP + dt.timedelta(seconds=i)
        rec = first_seen(sal.where((_id() % 50 == 0) & (_id() % 3 == i)))
        rec = _stored_record(rec).withColumn("ingested_at", F.lit(stamp.isoformat(sep=" ")).cast("timestamp"))
        append_sketched(rec.withColumn("ingest_date", F.date_add("ingest_date", i)), store, stamp)
    first = saved(first_seen(sal).select("source", "source_id", "page", _id().alias("id")), "first-seen")
    return skip_sketched(first, store, source=SOURCE_A).select("source_id", _big("page"), "id")


def q_enrich_details(spark, sf):
    """Every posting left-joined to its latest detail document."""
    p = _a_postings(spark, sf).select(_id().alias("id"), job_slug(F.col("v"), F.col("posting")).alias("job_slug"))
    out = attach_details(saved(p, "slugs"), landed(spark, sf, "c"), SOURCE_A)  # read for the slugs and for the join
    return out.select("id", F.col("details").isNotNull().alias("has_details"))


def q_enrich_details_b(spark, sf):
    """S4 N1 on a source-B run: details fetched on request are kept as they
    are; several versions of a slug resolve to the latest."""
    plan = _run_b(spark, sf, "b_whole", fetch_details=True, details=landed(spark, sf, "d"))
    return plan.records.select("source_id", _big("page"), "details")


def q_detail_sections(spark, sf):
    """Sections of every detail document, both layouts."""
    d = with_sections(landed(spark, sf, "c"), "body", "s")
    return d.select("job_slug", F.array_join("s.must_have", "|").alias("must_have"),
                    F.col("s.requirements_description").alias("requirements_description"),
                    F.col("s.offer_description").alias("offer_description"))


def q_strip_html(spark, sf):
    """E9 on whole web pages."""
    return with_html_text(table(spark, sf, "pages").select("page_id", "html"), {"text": "html"}).select("page_id", "text")


# --------------------------------------------------------------------------- L, runs


def _run_b(spark, sf, which="b", **kw):
    args = dict(source=SOURCE_B, run_id="fb", max_pages=UNLIMITED, ingest_date=RUN_DATE, ingested_at=STAMP)
    args.update(kw)
    return plan_run(spark, landed(spark, sf, which), **args)


def q_empty_page_stop(spark, sf):
    """L1: the run stops before the first batch without a salaried posting."""
    return _run_b(spark, sf).postings.select(_big("page"), _big("pos"))


def q_since_stop(spark, sf):
    """L2 + P5: the batch holding the first too-old posting is the last read."""
    return _run_b(spark, sf, since=resolve_since("2024-01-15")).postings.select(_big("page"), _big("pos"))


def q_target_stop(spark, sf):
    """L3: stop after the batch on which 500 new records are reached."""
    return _run_b(spark, sf, target_count=500).records.select("source_id", _big("page"))


def _stored_b(spark, sf, store):
    e = table(spark, sf, "events").where(F.col("event_id") % 10 == 0)
    sid = F.when(F.col("event_type") == "purchase", F.concat(F.lit("user-"), F.col("user_id").cast("string"))) \
           .otherwise(F.col("event_id").cast("string"))
    rec = e.select(sid.alias("source_id"), F.lit(0).alias("page"), F.lit("{}").alias("posting"),
                   F.lit(SOURCE_B).alias("source"))
    append_records(_stored_record(rec), store)


def q_ingest_run(spark, sf):
    """L5 on source B: since cutoff, target count and an existing store."""
    store = scratch_path(spark, "store-run-b")
    _stored_b(spark, sf, store)
    plan = _run_b(spark, sf, since=resolve_since("2024-01-10"), target_count=2500, store_path=store)
    return plan.records.select("source_id", _big("page"))


def q_ingest_run_a(spark, sf):
    """L5 on source A: details joined and sectioned, target count 1000."""
    plan = plan_run(spark, landed(spark, sf, "a"), source=SOURCE_A, run_id="fa", max_pages=UNLIMITED,
                    ingest_date=RUN_DATE, ingested_at=STAMP, target_count=1000, details=landed(spark, sf, "c"))
    r = plan.records
    return r.select("source_id", _big("page"), "url", F.unix_micros("ingested_at").alias("ingested_us"),
                    F.array_join("sections.must_have", "|").alias("must_have"),
                    F.col("sections.requirements_description").alias("requirements_description"),
                    F.col("sections.offer_description").alias("offer_description"))


def q_run_summary(spark, sf):
    """Both sources in one frame, records counted per source and date."""
    both = landed(spark, sf, "a").unionByName(landed(spark, sf, "b_whole"))
    recs = plan_sources(spark, both, [dict(source=SOURCE_A, run_id="fa"), dict(source=SOURCE_B, run_id="fb")],
                        max_pages=UNLIMITED, ingest_date=RUN_DATE, ingested_at=STAMP)
    return count_written(recs).select("source", F.col("ingest_date").cast("string").alias("ingest_date"),
                                      F.col("written").cast("bigint").alias("written"))


def q_normalize_salary(spark, sf):
    """One row per salary entry of every salaried posting of both sources."""
    from offerlake.operators.normalize import normalize_salaries

    a = _a_postings(spark, sf).where(has_salary_a(F.col("v"))).withColumn("id", _id()).drop("v")
    b = landed(spark, sf, "b_whole")
    b = explode_postings(locate_data_list(b), ["source", "cursor"]).where(has_salary_b(F.col("v")))
    b = b.select("source", (F.col("cursor") + F.col("pos")).alias("id"), "posting")
    keep = ("source", "id")
    return normalize_salaries(a, SOURCE_A, listing="posting", keep=keep).unionByName(
        normalize_salaries(b, SOURCE_B, listing="posting", keep=keep))


def q_stream_ingest(spark, sf):
    """Landed pages arrive as files, some unreadable; micro-batches dedup, append and quarantine."""
    from offerlake.sources.store import read_store
    from offerlake.streaming.ingest import run_stream_available_now

    landed_dir = scratch_path(spark, "landed-a")
    pages = damaged_a(landed(spark, sf, "a"))
    tasks = spark.sparkContext.defaultParallelism
    pages.repartition(BATCHES * tasks).write.parquet(landed_dir)  # each micro-batch has a file for every core
    store, bad = scratch_path(spark, "store-stream"), scratch_path(spark, "quarantine-stream")
    run_stream_available_now(spark, landed_dir, store, source=SOURCE_A, max_files_per_trigger=tasks, quarantine_path=bad,
                             checkpoint=scratch_path(spark, "stream-ckpt"))
    held = spark.read.schema(QUARANTINE).parquet(bad)
    return read_store(spark, store, SOURCE_A).select(F.lit("posting").alias("kind"), F.col("source_id").alias("value")).unionByName(
        held.select(F.lit("quarantine").alias("kind"), F.col("page").cast("string").alias("value")))


# --------------------------------------------------------------------------- declared stages over texts and vectors


def q_exact_dedupe(spark, sf):
    """D2a on the documents table."""
    return keep_first_copy(table(spark, sf, "documents"))


def q_tf_idf(spark, sf):
    """D3 on the documents table."""
    return tf_idf(table(spark, sf, "documents"))


def q_search_text(spark, sf):
    """Every benchmark item as a query against all documents."""
    queries = table(spark, sf, "benchmark")
    return search_text(tf_idf(table(spark, sf, "documents"), wanted=query_terms(queries)), queries)


def q_search_vectors(spark, sf):
    """Every vector whose id is divisible by 50 against all vectors."""
    vectors = table(spark, sf, "embeddings")
    return search_vectors(vectors, vectors.where(F.col("vec_id") % 50 == 0), item_id="vec_id", vector="embedding")


def q_search_text_blocks(spark, sf):
    """D4a by the postings index: the queries of search_text."""
    return PostingsIndex(tf_idf(table(spark, sf, "documents"))).search(table(spark, sf, "benchmark"))


def q_near_dedupe(spark, sf):
    """D2b on the documents table."""
    return near_dedupe(table(spark, sf, "documents"))


def q_search_vectors_index(spark, sf):
    """D4b by the inverted file: the queries of search_vectors; recall is measured in the tests."""
    vectors = table(spark, sf, "embeddings")
    return VectorIndex(vectors, item_id="vec_id", vector="embedding").search(vectors.where(F.col("vec_id") % 50 == 0))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "locate_postings": q_locate_postings,
    "locate_data_list": q_locate_data_list,
    "cursor_chain": q_cursor_chain,
    "first_list": q_first_list,
    "strict_bodies_a": q_strict_bodies_a,
    "strict_bodies_b": q_strict_bodies_b,
    "has_salary_truthy": q_has_salary_truthy,
    "has_salary_numeric": q_has_salary_numeric,
    "source_id_a": q_source_id_a,
    "job_slug": q_job_slug,
    "url": q_url,
    "source_id_b": q_source_id_b,
    "content_id": q_content_id,
    "posted_at": q_posted_at,
    "since_filter": q_since_filter,
    "since_window": q_since_window,
    "page_range": q_page_range,
    "first_seen": q_first_seen,
    "skip_existing": q_skip_existing,
    "skip_sketched": q_skip_sketched,
    "run_summary": q_run_summary,
    "enrich_details": q_enrich_details,
    "enrich_details_b": q_enrich_details_b,
    "detail_sections": q_detail_sections,
    "strip_html": q_strip_html,
    "empty_page_stop": q_empty_page_stop,
    "since_stop": q_since_stop,
    "target_stop": q_target_stop,
    "ingest_run": q_ingest_run,
    "ingest_run_a": q_ingest_run_a,
    "stream_ingest": q_stream_ingest,
    "normalize_salary": q_normalize_salary,
    "exact_dedupe": q_exact_dedupe,
    "tf_idf": q_tf_idf,
    "search_text": q_search_text,
    "search_vectors": q_search_vectors,
    "near_dedupe": q_near_dedupe,
    "search_vectors_index": q_search_vectors_index,
    "search_text_blocks": q_search_text_blocks,
}


def wrap(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return fn(spark, sf_dir)
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


# --------------------------------------------------------------------------- oracles

_E = "e AS (SELECT (SELECT max(event_id) FROM events) - event_id AS g, * FROM events)"
# an id of 0 is falsy, so that posting falls through to its slug
_SID_B = ("CASE WHEN event_type = 'purchase' THEN 'user-' || user_id WHEN event_id = 0 THEN 'e-0' "
          "ELSE CAST(event_id AS VARCHAR) END")
_OK_W = "event_type IN ('click','purchase','error')"  # batches without the empty one
_OK_B = _OK_W + " AND g // 100 <> (SELECT (max(event_id) // 100 + 1) * 7 // 10 FROM events)"
# damaged pages that aren't one JSON document
_BAD_A = "(o_orderkey // 20 + 1) % 7 IN (1, 2, 3)"
_SID_A = "CASE WHEN o_orderkey % 3 = 0 THEN 'C' || o_custkey ELSE 'order-' || o_orderkey END"
_TRIM = "regexp_replace({x}, '^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$', '', 'g')"
_SECTIONS = f"""
SELECT 'order-' || l_orderkey AS job_slug,
       string_agg(DISTINCT p_name, '|' ORDER BY p_name) AS must_have,
       count(*) || ' lines' AS requirements_description,
       'Total' || CASE WHEN l_orderkey % 4 = 0 THEN '; ' ELSE chr(10) END || count(*) AS offer_description
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey"""

_TERMS = "unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+'))"
_WEIGHTS = f"""t AS (SELECT doc_id, {_TERMS} AS term FROM documents),
c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM c GROUP BY term),
w AS (SELECT doc_id, term, CAST(round(tf * ln((SELECT count(*) FROM documents)::DOUBLE / df) * 1000000) AS BIGINT) AS weight
      FROM c JOIN f USING (term))"""

ORACLE_SQL: dict[str, str] = {
    "exact_dedupe": """SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents
GROUP BY trim(regexp_replace(lower(coalesce(text, '')), '[\\x09-\\x0D\\x20]+', ' ', 'g'))""",
    "tf_idf": f"WITH {_WEIGHTS} SELECT doc_id, term, weight FROM w",
    "search_text": f"""WITH {_WEIGHTS},
q AS (SELECT DISTINCT item_id AS query_id, {_TERMS} AS term FROM benchmark),
s AS (SELECT query_id, doc_id, CAST(sum(weight) AS BIGINT) AS score FROM w JOIN q USING (term) GROUP BY ALL)
SELECT query_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""",
    "search_vectors": """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id,
             CAST(round(list_cosine_similarity(q.v, e.v) * 1000000) AS BIGINT) AS score
      FROM e q, e WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""",
    "near_dedupe": f"""WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x09-\\x0D\\x20]+') AS w FROM documents),
s AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) >= {SHINGLE} THEN [list_aggregate(w[i:i + {SHINGLE - 1}], 'string_agg', ' ')
                                                               FOR i IN range(1, len(w) - {SHINGLE - 2})]
                                     WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * k >= {PERCENT} * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
t AS (SELECT r, r AS o FROM d UNION SELECT t.r, e.b FROM t JOIN e ON e.a = t.o),
c AS (SELECT t.r, min(d.doc_id) AS cluster_id FROM t JOIN d ON d.r = t.o GROUP BY t.r)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, cluster_id FROM d JOIN c USING (r) LEFT JOIN n USING (r)""",
    "locate_postings": "SELECT o_orderkey // 20 + 1 AS page, o_orderkey % 20 AS pos, o_orderkey AS id FROM orders",
    "locate_data_list": f"""WITH {_E}
SELECT (g // 100) * 100 AS cursor, g % 100 AS pos,
       CASE WHEN event_type <> 'purchase' THEN event_id END AS id,
       CASE WHEN event_type = 'purchase' THEN 'user-' || user_id ELSE 'e-' || event_id END AS slug
FROM e""",
    "cursor_chain": """WITH b AS (SELECT DISTINCT ((SELECT max(event_id) FROM events) - event_id) // 100 AS b FROM events),
c AS (SELECT b, CASE WHEN b % 10 = 4 THEN b + 3 WHEN b % 2 = 0 THEN b + 1 END AS nxt FROM b WHERE b % 10 NOT IN (5, 6))
SELECT row_number() OVER (ORDER BY b) AS page, b * 100 AS cursor, nxt * 100 AS api_next, coalesce(nxt, b + 1) * 100 AS next_cursor
FROM c""",
    "first_list": f"""SELECT 'nofluff' AS source, o_orderkey // 20 + 1 AS at, false AS failed, o_orderkey % 20 AS pos,
       CAST(NULL AS VARCHAR) AS slug, 'order-' || o_orderkey AS url
FROM orders WHERE (o_orderkey // 20 + 1) % 10 <> 0
UNION ALL
SELECT DISTINCT 'nofluff', o_orderkey // 20 + 1, true, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR)
FROM orders WHERE (o_orderkey // 20 + 1) % 10 = 0
UNION ALL
SELECT 'justjoin', (g // 100) * 100, false, g % 100,
       CASE WHEN event_type = 'purchase' THEN 'user-' || user_id ELSE 'e-' || event_id END, NULL
FROM (SELECT (SELECT max(event_id) FROM events) - event_id AS g, * FROM events)""",
    "strict_bodies_a": f"""SELECT page, failed, CASE WHEN NOT failed THEN n END AS n_postings
FROM (SELECT o_orderkey // 20 + 1 AS page, {_BAD_A} AS failed, count(*) AS n FROM orders GROUP BY 1, 2)""",
    "strict_bodies_b": f"""WITH {_E}, b AS (SELECT g // 100 AS b, count(*) AS n FROM e GROUP BY 1),
k AS (SELECT *, b % 2 = 0 AND (b // 2) % 4 = 3 AS failed FROM b)
SELECT b * 100 AS cursor, failed, CASE WHEN b % 2 = 0 AND NOT failed THEN (b + 1) * 100 END AS next_cursor,
       CASE WHEN NOT failed THEN n END AS n_postings FROM k""",
    "has_salary_truthy": "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus IN ('F','O')",
    "has_salary_numeric": f"WITH {_E} SELECT (g // 100) * 100 AS cursor, g % 100 AS pos FROM e WHERE {_OK_B}",
    "source_id_a": f"SELECT o_orderkey AS id, {_SID_A} AS source_id FROM orders",
    "job_slug": f"SELECT o_orderkey AS id, {_SID_A} AS job_slug FROM orders",
    "url": "SELECT o_orderkey AS id, 'order-' || o_orderkey AS url FROM orders",
    "source_id_b": f"WITH {_E} SELECT (g // 100) * 100 AS cursor, g % 100 AS pos, {_SID_B} AS source_id FROM e",
    "content_id": """SELECT c_custkey AS cust,
       substr(sha256('{"cust": ' || c_custkey || ', "name": "' || c_name || '", "nation": ' || c_nationkey
                     || ', "segment": "' || c_mktsegment || '"}'), 1, 20) AS source_id
FROM customer""",
    "posted_at": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 <> 0 THEN epoch_us(o_orderdate) END AS posted_us FROM orders",
    "since_filter": """SELECT id, posted_us FROM (
  SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 <> 0 THEN epoch_us(o_orderdate) END AS posted_us FROM orders)
WHERE posted_us IS NULL OR posted_us >= epoch_us(TIMESTAMP '1998-01-01')""",
    "since_window": """SELECT o_orderkey AS id FROM orders
WHERE o_orderkey % 7 = 0 OR o_orderdate >= TIMESTAMP '2000-06-30' - INTERVAL 365 DAY""",
    "page_range": """SELECT * FROM (SELECT o_orderkey // 20 + 1 AS page, o_orderkey % 20 AS pos, o_orderkey AS id FROM orders)
WHERE page BETWEEN 5 AND 504""",
    "first_seen": f"""WITH p AS (SELECT o_orderkey, {_SID_A} AS source_id FROM orders WHERE o_orderstatus IN ('F','O'))
SELECT source_id, min(o_orderkey) // 20 + 1 AS page, min(o_orderkey) AS id FROM p GROUP BY source_id""",
    "skip_existing": f"""WITH p AS (SELECT o_orderkey, {_SID_A} AS source_id FROM orders WHERE o_orderstatus IN ('F','O')),
s AS (SELECT DISTINCT source_id FROM p WHERE o_orderkey % 50 = 0)
SELECT source_id, min(o_orderkey) // 20 + 1 AS page, min(o_orderkey) AS id FROM p
WHERE source_id NOT IN (SELECT source_id FROM s) GROUP BY source_id""",
    "skip_sketched": f"""WITH p AS (SELECT o_orderkey, {_SID_A} AS source_id FROM orders WHERE o_orderstatus IN ('F','O')),
s AS (SELECT DISTINCT source_id FROM p WHERE o_orderkey % 50 = 0)
SELECT source_id, min(o_orderkey) // 20 + 1 AS page, min(o_orderkey) AS id FROM p
WHERE source_id NOT IN (SELECT source_id FROM s) GROUP BY source_id""",
    "run_summary": f"""WITH a AS (SELECT count(DISTINCT {_SID_A}) AS n FROM orders WHERE o_orderstatus IN ('F','O')),
{_E},
s AS (SELECT g // 100 AS b, {_SID_B} AS source_id, {_OK_W} AS ok FROM e),
st AS (SELECT coalesce(min(b), 1000000000) AS stop FROM (SELECT b FROM s GROUP BY b HAVING NOT bool_or(ok))),
bb AS (SELECT count(DISTINCT source_id) AS n FROM s WHERE ok AND b < (SELECT stop FROM st))
SELECT 'nofluff' AS source, '2024-02-01' AS ingest_date, n AS written FROM a
UNION ALL SELECT 'justjoin', '2024-02-01', n FROM bb""",
    "enrich_details": """SELECT o_orderkey AS id,
       (o_orderkey % 3 <> 0 AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)) AS has_details
FROM orders""",
    "enrich_details_b": f"""WITH {_E},
s AS (SELECT g, g // 100 AS b, {_SID_B} AS source_id,
             CASE WHEN event_type = 'purchase' THEN 'user-' || user_id ELSE 'e-' || event_id END AS job_slug,
             {_OK_W} AS ok FROM e),
l1 AS (SELECT coalesce(min(b), 1000000000) - 1 AS stop FROM (SELECT b FROM s GROUP BY b HAVING NOT bool_or(ok))),
f AS (SELECT source_id, arg_min(job_slug, g) AS job_slug, min(g) // 100 AS b FROM s
      WHERE ok AND b <= (SELECT stop FROM l1) GROUP BY source_id),
d AS (SELECT CASE WHEN event_type = 'purchase' THEN 'user-' || user_id ELSE 'e-' || event_id END AS job_slug,
             arg_max(props, ts) AS details FROM events GROUP BY 1)
SELECT f.source_id, f.b + 1 AS page, d.details FROM f LEFT JOIN d ON d.job_slug = f.job_slug""",
    "detail_sections": _SECTIONS,
    # entities: the four names present in the data, with ";" or cut off before a
    # non-alphanumeric; "&amp;" last so that "&amp;quot;" stays "&quot;"
    "strip_html": "SELECT page_id, array_to_string(list_filter(list_transform(string_split("
                  "replace(replace(replace(replace("
                  "regexp_replace(regexp_replace(regexp_replace(regexp_replace("
                  "regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>"
                  "|<template\\b.*?</template\\s*>|<[^>]*>', chr(10), 'g'),"
                  "'&middot([^a-zA-Z0-9;])', '·\\1', 'g'), '&copy([^a-zA-Z0-9;])', '©\\1', 'g'),"
                  "'&quot([^a-zA-Z0-9;])', '\"\\1', 'g'), '&amp([^a-zA-Z0-9;])', '&\\1', 'g'),"
                  "'&middot;','·'),'&copy;','©'),'&quot;','\"'),'&amp;','&'), chr(10)), lambda x: "
                  + _TRIM.format(x="x") + "), lambda x: x <> ''), chr(10)) AS text FROM pages",
    "empty_page_stop": f"""WITH {_E},
s AS (SELECT g // 100 AS b, g % 100 AS pos, {_OK_B} AS ok FROM e),
st AS (SELECT coalesce(min(b), 1000000000) AS stop FROM (SELECT b FROM s GROUP BY b HAVING NOT bool_or(ok)))
SELECT b + 1 AS page, pos FROM s WHERE ok AND b < (SELECT stop FROM st)""",
    "since_stop": f"""WITH {_E},
a AS (SELECT g // 100 AS b, g % 100 AS pos, ts, {_OK_B} AS ok FROM e),
l1 AS (SELECT coalesce(min(b), 1000000000) - 1 AS stop FROM (SELECT b FROM a GROUP BY b HAVING NOT bool_or(ok))),
s AS (SELECT * FROM a WHERE ok),
l2 AS (SELECT coalesce(min(b), 1000000000) AS stop FROM s WHERE ts < TIMESTAMP '2024-01-15')
SELECT b + 1 AS page, pos FROM s
WHERE b <= least((SELECT stop FROM l1), (SELECT stop FROM l2)) AND ts >= TIMESTAMP '2024-01-15'""",
    "target_stop": f"""WITH {_E},
a AS (SELECT g, g // 100 AS b, {_SID_B} AS source_id, {_OK_B} AS ok FROM e),
l1 AS (SELECT coalesce(min(b), 1000000000) - 1 AS stop FROM (SELECT b FROM a GROUP BY b HAVING NOT bool_or(ok))),
s AS (SELECT g, source_id FROM a WHERE ok AND b <= (SELECT stop FROM l1)),
f AS (SELECT source_id, min(g) // 100 AS b FROM s GROUP BY source_id),
c AS (SELECT b, sum(count(*)) OVER (ORDER BY b) AS cum FROM f GROUP BY b),
st AS (SELECT coalesce(min(b), 1000000000) AS stop FROM c WHERE cum >= 500)
SELECT source_id, b + 1 AS page FROM f WHERE b <= (SELECT stop FROM st)""",
    "ingest_run": f"""WITH {_E},
s AS (SELECT g, g // 100 AS b, ts, {_SID_B} AS source_id, {_OK_B} AS ok FROM e),
l1 AS (SELECT coalesce(min(b), 1000000000) - 1 AS stop FROM (SELECT b FROM s GROUP BY b HAVING NOT bool_or(ok))),
l2 AS (SELECT coalesce(min(b), 1000000000) AS stop FROM s WHERE ok AND ts < TIMESTAMP '2024-01-10'),
k AS (SELECT * FROM s WHERE ok AND ts >= TIMESTAMP '2024-01-10'
      AND b <= least((SELECT stop FROM l1), (SELECT stop FROM l2))),
f AS (SELECT source_id, min(g) // 100 AS b FROM k GROUP BY source_id),
n AS (SELECT * FROM f WHERE source_id NOT IN (SELECT {_SID_B} FROM events WHERE event_id % 10 = 0)),
c AS (SELECT b, sum(count(*)) OVER (ORDER BY b) AS cum FROM n GROUP BY b),
st AS (SELECT coalesce(min(b), 1000000000) AS stop FROM c WHERE cum >= 2500)
SELECT source_id, b + 1 AS page FROM n WHERE b <= (SELECT stop FROM st)""",
    "ingest_run_a": f"""WITH p AS (SELECT o_orderkey AS k, {_SID_A} AS source_id FROM orders WHERE o_orderstatus IN ('F','O')),
f AS (SELECT source_id, min(k) AS k FROM p GROUP BY source_id),
c AS (SELECT k // 20 + 1 AS page, sum(count(*)) OVER (ORDER BY k // 20 + 1) AS cum FROM f GROUP BY 1),
st AS (SELECT coalesce(min(page), 1000000000) AS stop FROM c WHERE cum >= 1000),
r AS (SELECT source_id, k, k // 20 + 1 AS page FROM f WHERE k // 20 + 1 <= (SELECT stop FROM st)),
d AS ({_SECTIONS})
SELECT r.source_id, r.page, 'order-' || r.k AS url, epoch_us(TIMESTAMP '2024-02-01 12:00:00') AS ingested_us,
       d.must_have, d.requirements_description, d.offer_description
FROM r LEFT JOIN d ON d.job_slug = r.source_id""",
    "stream_ingest": f"""SELECT DISTINCT 'posting' AS kind, {_SID_A} AS value FROM orders
WHERE o_orderstatus IN ('F','O') AND NOT ({_BAD_A})
UNION ALL SELECT DISTINCT 'quarantine', CAST(o_orderkey // 20 + 1 AS VARCHAR) FROM orders WHERE {_BAD_A}""",
    "normalize_salary": f"""WITH {_E}
SELECT 'nofluff' AS source, o_orderkey AS id, CAST(NULL AS VARCHAR) AS employment_type, o_totalprice AS salary_from,
       CAST(NULL AS DOUBLE) AS salary_to, 'PLN' AS currency, 'month' AS period FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'nofluff', o_orderkey, 'b2b', o_totalprice, NULL, 'PLN', 'month' FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT 'nofluff', o_orderkey, 'perm', NULL, NULL, 'PLN', 'month' FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT 'justjoin', g, CASE WHEN event_type <> 'click' THEN 'b2b' END,
       CASE WHEN event_type = 'error' THEN 0.0 ELSE value END, NULL, 'PLN', 'month' FROM e WHERE {_OK_W}""",
}
ORACLE_SQL["search_text_blocks"] = ORACLE_SQL["search_text"]
