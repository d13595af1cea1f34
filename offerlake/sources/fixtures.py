"""Landed-response fixtures derived in Spark from the driver tables.

The engine's inputs are tables of landed response bodies.  These builders
write such tables from the TPC-H-like test data so that each query parses
real JSON while its expected answer can be stated in SQL on the base tables:

* F-A  listing pages of source A from ``orders`` (20 postings per page);
* F-B  cursor batches of source B from ``events`` (100 per batch, newest first), with
  one batch without salaries after seven tenths of them; without such a batch; and
  with a chain that skips landed batches;
* F-C  detail documents for F-A from ``lineitem`` join ``part``.

Each page is one group of at most 20 (A) or 100 (B) rows, so the
``collect_list`` that assembles a body is bounded by construction.
"""

from __future__ import annotations

import datetime as dt
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.sources.tables import SOURCE_A, SOURCE_B

FIXTURE_FETCHED_AT = dt.datetime(2024, 2, 1)
PAGE_SIZE_A = 20
PAGE_SIZE_B = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _ts_lit(t: dt.datetime) -> Column:
    return F.lit(t.isoformat(sep=" ")).cast("timestamp")


def _assemble(items: DataFrame, group_cols: list[str], prefix: Column, suffix: Column) -> DataFrame:
    """Bodies from ``(group…, pos, posting)`` rows: postings joined in ``pos`` order."""
    g = items.groupBy(*group_cols).agg(
        F.array_sort(F.collect_list(F.struct("pos", "posting"))).alias("_items"))
    joined = F.array_join(F.transform("_items", lambda x: x["posting"]), ",")
    return g.withColumn("body", F.concat(prefix, joined, suffix)).drop("_items")


def orders_postings(orders: DataFrame) -> DataFrame:
    """One source-A posting (JSON text) per order, with its page and position."""
    k = F.col("o_orderkey")
    date = F.col("o_orderdate")
    iso = F.concat(F.lit('"'), F.date_format(date, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"'))
    millis = F.unix_millis(date.cast("timestamp")).cast("string")
    posted = (F.when(k % 7 == 0, F.lit(None))
               .when(k % 5 == 0, F.parse_json(iso))
               .otherwise(F.parse_json(millis)))
    price = F.col("o_totalprice")
    status = F.col("o_orderstatus")

    def entry(kind, salary_from, flat_from):
        return F.struct(F.lit(kind).alias("type"),
                        F.when(salary_from.isNotNull(), F.struct(salary_from.alias("from"))).alias("salary"),
                        flat_from.alias("from"))

    null_d = F.lit(None).cast("double")
    types = (F.when(status == "O", F.array(entry("b2b", price, null_d), entry("perm", null_d, null_d)))
              .when(status == "P", F.array(entry("b2b", null_d, F.lit(0.0)))))
    posting = F.to_json(F.struct(
        k.alias("id"),
        F.when(k % 3 == 0, F.concat(F.lit("C"), F.col("o_custkey").cast("string"))).alias("reference"),
        F.concat(F.lit("order-"), k.cast("string")).alias("url"),
        F.col("o_orderpriority").alias("title"),
        posted.alias("posted"),
        F.when(status == "F", F.struct(price.alias("from"))).alias("salary"),
        types.alias("employmentTypes"),
    ))
    return orders.select(
        (F.floor(k / PAGE_SIZE_A) + 1).cast("int").alias("page"),
        (k % PAGE_SIZE_A).cast("int").alias("pos"),
        posting.alias("posting"))


def fixture_a(spark: SparkSession, sf_dir: str, run_id: str = "fa",
              fetched_at: dt.datetime = FIXTURE_FETCHED_AT) -> DataFrame:
    """F-A: landed pages of source A.  Every tenth page nests its list under
    ``outer`` so that it needs the document search."""
    items = orders_postings(table(spark, sf_dir, "orders"))
    nested = F.col("page") % 10 == 0
    prefix = F.when(nested, F.lit('{"outer":{"postings":[')).otherwise(F.lit('{"postings":['))
    suffix = F.when(nested, F.lit("]}}")).otherwise(F.lit("]}"))
    pages = _assemble(items, ["page"], prefix, suffix)
    return pages.select(
        F.lit(SOURCE_A).alias("source"), F.lit(run_id).alias("run_id"), "page",
        F.lit(None).cast("bigint").alias("cursor"), F.lit(None).cast("int").alias("items_count"),
        _ts_lit(fetched_at).alias("fetched_at"), "body")


def events_postings(events: DataFrame, empty_batch: bool = True) -> DataFrame:
    """One source-B posting per event, newest first: batch ``g div 100``.  With
    ``empty_batch`` the batch after seven tenths of all has no salary."""
    last = F.lit(events.select(F.max("event_id")).scalar())
    g = last - F.col("event_id")
    et = F.col("event_type")
    value = F.col("value")
    batches = F.floor(last / PAGE_SIZE_B) + 1
    empty = (F.floor(g / PAGE_SIZE_B) == F.floor(batches * 7 / 10)) if empty_batch else F.lit(False)
    entry = lambda amount: F.array(F.struct(F.lit("b2b").alias("type"), amount.alias("from")))
    posting = F.to_json(F.struct(
        F.when(et != "purchase", F.col("event_id")).alias("id"),
        F.when(et == "purchase", F.concat(F.lit("user-"), F.col("user_id").cast("string")))
         .otherwise(F.concat(F.lit("e-"), F.col("event_id").cast("string"))).alias("slug"),
        F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("publishedAt"),
        F.when(~empty & (et == "click"), value).alias("salary_from"),
        F.when(~empty & (et == "view"), F.lit("12")).alias("salary"),
        F.when(~empty & (et == "purchase"), entry(value))
         .when(~empty & (et == "error"), entry(F.lit(0.0))).alias("employmentTypes"),
    ))
    return events.select(
        F.floor(g / PAGE_SIZE_B).cast("bigint").alias("batch"),
        (g % PAGE_SIZE_B).cast("int").alias("pos"),
        posting.alias("posting"))


def fixture_b(spark: SparkSession, sf_dir: str, run_id: str = "fb", fetched_at: dt.datetime = FIXTURE_FETCHED_AT,
              empty_batch: bool = True, skips: bool = False) -> DataFrame:
    """F-B: landed cursor batches of source B; ``meta.next`` only on even batches.

    With ``skips``, a batch numbered 4 modulo 10 points three batches ahead, so
    the two after it are off the chain; the first of those points past it."""
    items = events_postings(table(spark, sf_dir, "events"), empty_batch)
    b = F.col("batch")
    ahead = F.when(F.lit(skips) & (b % 10 == 4), 3).when(F.lit(skips) & (b % 10 == 5), 4).when(b % 2 == 0, 1)
    nxt = F.when(ahead.isNotNull(), F.concat(F.lit('"next":{"cursor":'), ((b + ahead) * PAGE_SIZE_B).cast("string"),
                                             F.lit("}"))).otherwise(F.lit(""))
    pages = _assemble(items, ["batch"], F.lit('{"data":['), F.concat(F.lit('],"meta":{'), nxt, F.lit("}}")))
    return pages.select(
        F.lit(SOURCE_B).alias("source"), F.lit(run_id).alias("run_id"),
        F.lit(None).cast("int").alias("page"),
        (b * PAGE_SIZE_B).cast("bigint").alias("cursor"), F.lit(PAGE_SIZE_B).alias("items_count"),
        _ts_lit(fetched_at).alias("fetched_at"), "body")


def damaged_a(pages: DataFrame) -> DataFrame:
    """F-A pages of which some aren't one JSON document: text after it, single quotes, cut off."""
    kind = F.col("page") % 7
    return pages.withColumn("body", F.when(kind == 1, F.concat("body", F.lit(" trailing")))
                            .when(kind == 2, F.replace("body", F.lit('"'), F.lit("'")))
                            .when(kind == 3, F.expr("substring(body, 1, length(body) - 1)"))
                            .when(kind == 4, F.concat("body", F.lit("\n"))).otherwise(F.col("body")))


def odd_cursors_b(pages: DataFrame) -> DataFrame:
    """F-B pages whose next cursor, if given, is a number, a text, a decimal or no number."""
    kind = F.floor(F.col("cursor") / (2 * PAGE_SIZE_B)) % 4
    to = lambda x: F.regexp_replace("body", r'"cursor":(\d+)', f'"cursor":{x}')
    return pages.withColumn("body", F.when(kind == 1, to('"$1"')).when(kind == 2, to("$1.0"))
                            .when(kind == 3, to('"p$1"')).otherwise(F.col("body")))


def fixture_c(spark: SparkSession, sf_dir: str, fetched_at: dt.datetime = FIXTURE_FETCHED_AT) -> DataFrame:
    """F-C: one detail document per order with lineitems; modern form, or the
    legacy ``sections`` form when ``l_orderkey % 4 = 0``."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    per_order = (li.join(part, li.l_partkey == part.p_partkey)
                   .groupBy("l_orderkey")
                   .agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("p_name")).alias("names")))
    n = F.col("n").cast("string")
    names = F.col("names")
    modern = F.to_json(F.struct(
        F.struct(F.transform(names, lambda x: F.struct(x.alias("value"))).alias("musts"),
                 F.concat(F.lit("<p>"), n, F.lit(" lines</p>")).alias("description")).alias("requirements"),
        F.struct(F.concat(F.lit("<p>Total <b>"), n, F.lit("</b></p>")).alias("description")).alias("details"),
    ))
    null_items = F.lit(None).cast("array<string>")
    null_s = F.lit(None).cast("string")

    def section(title, items, content):
        return F.struct(F.lit(title).alias("title"), items.alias("items"), content.alias("content"))

    legacy = F.to_json(F.struct(F.struct(F.array(
        section("Must have", names, null_s),
        section("Requirements", null_items, F.concat(n, F.lit(" lines"))),
        section("We offer", F.array(F.lit("Total"), n), null_s),
    ).alias("sections")).alias("x")))
    return per_order.select(
        F.lit(SOURCE_A).alias("source"),
        F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("job_slug"),
        _ts_lit(fetched_at).alias("fetched_at"),
        F.when(F.col("l_orderkey") % 4 == 0, legacy).otherwise(modern).alias("body"),
        F.lit(None).cast("string").alias("error"))


def fixture_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-D: detail documents for F-B, one per event (its ``props`` JSON), keyed
    by the posting's slug and fetched at the event time; a user's purchases
    share one slug, so the latest one is the detail."""
    e = table(spark, sf_dir, "events")
    slug = (F.when(F.col("event_type") == "purchase", F.concat(F.lit("user-"), F.col("user_id").cast("string")))
             .otherwise(F.concat(F.lit("e-"), F.col("event_id").cast("string"))))
    return e.select(F.lit(SOURCE_B).alias("source"), slug.alias("job_slug"),
                    F.col("ts").cast("timestamp").alias("fetched_at"), F.col("props").alias("body"),
                    F.lit(None).cast("string").alias("error"))


_LANDED: dict[tuple, str] = {}


def landed(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """A fixture written once per session as a Parquet table under the shared
    checkpoint folder, then scanned like any landed table."""
    from offerlake.session import scratch_path

    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), which)
    path = _LANDED.get(key)
    if path is None:
        build = {"a": fixture_a, "b": fixture_b, "c": fixture_c, "d": fixture_d,
                 "b_whole": partial(fixture_b, empty_batch=False),
                 "b_skips": partial(fixture_b, empty_batch=False, skips=True)}[which]
        path = scratch_path(spark, f"landed-{which}")
        build(spark, sf_dir).write.parquet(path)
        _LANDED[key] = path
    return spark.read.parquet(path)
