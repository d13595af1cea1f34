"""Plan shape: pushdown, pruning, partial limits, bounded broadcasts, skew."""

import datetime as dt
import json
import math
import re

from pyspark.sql import functions as F

from offerlake.operators.dedup import first_seen
from offerlake.plans.ingest import plan_run
from offerlake.sources.tables import LANDED_PAGES, SOURCE_A, SOURCE_B
from tests import model

DATE = dt.date(2024, 3, 1)


def _plan(df) -> str:
    jvm = df.sparkSession.sparkContext._jvm
    mode = jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def _landed_parquet(spark, tmp_path, pages):
    rows = [(SOURCE_A, "r", pg, None, None, dt.datetime(2024, 3, 1), json.dumps({"postings": ps}))
            for pg, ps in pages.items()]
    path = str(tmp_path / "landed")
    spark.createDataFrame(rows, LANDED_PAGES).write.parquet(path)
    return spark.read.parquet(path)


def test_scan_gets_filters_and_only_needed_columns(spark, tmp_path):
    pages = {pg: [{"title": "t", "url": f"u{pg}-{i}", "salary": 1} for i in range(3)] for pg in range(1, 6)}
    landed = _landed_parquet(spark, tmp_path, pages)
    plan = plan_run(spark, landed, source=SOURCE_A, run_id="r", max_pages=3, start_page=2, ingest_date=DATE)
    text = _plan(plan.records)
    assert "EqualTo(source,nofluff)" in text and "EqualTo(run_id,r)" in text
    assert "GreaterThanOrEqual(page,2)" in text and "LessThanOrEqual(page,4)" in text
    schemas = [line for line in text.splitlines() if line.startswith("ReadSchema:")]
    assert schemas and all("fetched_at" not in s and "items_count" not in s for s in schemas)
    assert sorted(r["page"] for r in plan.records.collect()) == [2, 2, 2, 3, 3, 3, 4, 4, 4]


def test_first_seen_limits_before_the_shuffle(spark):
    df = spark.range(1000).select(F.lit("s").alias("source"), (F.col("id") % 3).cast("string").alias("source_id"),
                                  F.floor(F.col("id") / 10).alias("page"), (F.col("id") % 10).alias("pos"))
    text = _plan(first_seen(df))
    tree = text.split("\n\n")[0]
    assert "WindowGroupLimit" in tree
    # the partial limit sits below the exchange in the tree: it runs map-side
    lines = tree.splitlines()
    exch = next(i for i, ln in enumerate(lines) if "Exchange" in ln)
    assert any("WindowGroupLimit" in ln for ln in lines[exch + 1:])


def test_the_stop_reaches_the_scan(spark, tmp_path):
    """A run that ends at page 2 reads no body of a later page for its records."""
    pages = {pg: [{"title": "t", "url": f"u{pg}", "salary": 1 if pg < 3 else 0}] for pg in range(1, 9)}
    plan = plan_run(spark, _landed_parquet(spark, tmp_path, pages), source=SOURCE_A, run_id="r", max_pages=1000,
                    ingest_date=DATE)
    assert "LessThanOrEqual(page,2)" in _plan(plan.records)
    assert sorted(r["page"] for r in plan.records.collect()) == [1, 2]


def test_the_target_reaches_the_scan(spark, tmp_path):
    pages = {pg: [{"title": "t", "url": f"u{pg}-{i}", "salary": 1} for i in range(5)] for pg in range(1, 9)}
    plan = plan_run(spark, _landed_parquet(spark, tmp_path, pages), source=SOURCE_A, run_id="r", max_pages=1000,
                    ingest_date=DATE, target_count=12)
    assert "LessThanOrEqual(page,3)" in _plan(plan.records)
    assert plan.records.count() == 15


def test_hot_slug_is_split(spark):
    """Two thirds of the records share a slug: adaptive execution splits their partition."""
    from offerlake.operators.details import attach_details
    from offerlake.sources.tables import SOURCE_B

    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "65536", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "65536"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        recs = spark.range(0, 200_000, 1, 8).select(
            F.lit(SOURCE_B).alias("source"), F.sha2(F.col("id").cast("string"), 256).alias("text"),
            F.when(F.col("id") % 3 != 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5000)).alias("job_slug"))
        details = spark.range(5000).select(
            F.lit(SOURCE_B).alias("source"), F.concat(F.lit("s"), F.col("id")).alias("job_slug"),
            F.current_timestamp().alias("fetched_at"), F.lit("{}").alias("body"), F.lit(None).cast("string").alias("error"))
        joined = attach_details(recs, details.union(details.limit(1).withColumn("job_slug", F.lit("hot"))), SOURCE_B)
        assert joined.where("details IS NOT NULL").count() > 133_000
        out = joined.groupBy("details").agg(F.max("text"))
        out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_hot_id_holding_a_third_of_rows(spark, tmp_path):
    """One reference shared by a third of all postings across every page."""
    pages = {}
    for pg in range(1, 61):
        ps = []
        for i in range(30):
            p = {"title": "t", "url": f"u-{pg}-{i}", "salary": {"from": 1}}
            if i % 3 == 0:
                p["reference"] = "HOT"
            ps.append(p)
        pages[pg] = ps
    landed = _landed_parquet(spark, tmp_path, pages)
    plan = plan_run(spark, landed, source=SOURCE_A, run_id="r", max_pages=100, ingest_date=DATE, target_count=500)
    got = sorted((r["source_id"], r["page"]) for r in plan.records.collect())
    want = sorted(model.run_a(pages, start_page=1, pages_max=100, target=500))
    assert got == want
    assert ("HOT", 1) in got and sum(1 for s, _ in got if s == "HOT") == 1


def test_text_scores_are_summed_where_the_texts_are(spark):
    """The texts are dealt by document; neither their terms nor the pairs of queries and documents are."""
    from offerlake.operators.corpus import query_terms, search_text, tf_idf
    from offerlake.operators.postings import PostingsIndex

    docs = spark.createDataFrame([(1, "a b c a"), (2, "b c"), (2, "b d"), (None, "a d"), (3, None)], "doc_id long, text string")
    queries = spark.createDataFrame([("q1", "a b"), ("q2", "d x")], "item_id string, text string")
    dealt = lambda df: re.findall(r"hashpartitioning\((\w+)#\d+L?, (?:(\w+)#|\d)", _plan(df))
    weights = tf_idf(docs)
    assert dealt(weights) == [("doc_id", "")]
    some = tf_idf(docs, wanted=query_terms(queries))
    assert sorted(dealt(search_text(some, queries))) == [("doc_id", ""), ("query_id", "")]
    index = PostingsIndex(weights)
    pairs = index.weights.select(F.lit("q1").alias("query_id"), "doc_id").distinct()
    scores = index._scores(pairs, query_terms(queries))
    assert ("doc_id", "term") not in dealt(scores)
    got = {tuple(r) for r in weights.collect()}
    assert got == {(d, t, round(tf * math.log(5 / df) * 1e6)) for d, t, tf, df in
                   [(1, "a", 2, 2), (1, "b", 1, 2), (1, "c", 1, 2), (2, "b", 2, 2), (2, "c", 1, 2), (2, "d", 1, 2), (None, "a", 1, 2), (None, "d", 1, 2)]}


def test_details_without_sections_make_none(spark):
    """a plan that reads no sections runs no helper for them; a detail that is no JSON object is dropped all the same."""
    from offerlake.operators.details import attach_details
    from offerlake.sources.tables import SOURCE_A

    records = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "id long, job_slug string")
    body = '{"sections":[{"title":"Offer","content":"x"}]}'
    details = spark.createDataFrame([(SOURCE_A, "a", 1, body, None), (SOURCE_A, "b", 1, "[1]", None)],
                                    "source string, job_slug string, fetched_at long, body string, error string")
    out = attach_details(records, details, SOURCE_A)
    told = out.select("id", F.col("details").isNotNull().alias("has"))
    assert "ArrowEvalPython" in _plan(out) and "ArrowEvalPython" not in _plan(told)
    assert {tuple(r) for r in told.collect()} == {(1, True), (2, False), (3, False), (4, False)}
    assert {r["id"]: r["sections"] and r["sections"]["offer_description"] for r in out.collect()} == {1: "x", 2: None, 3: None, 4: None}


def _odd_pages(spark):
    """Located pages of both sources: salaried first, last, not at all, empty, failed, with broken and null postings."""
    yes = {SOURCE_A: '{"salary":1}', SOURCE_B: '{"salary":1,"employmentTypes":[{"from":0}]}'}
    no, rows = '{"id":1,"employmentTypes":[{"from":""}]}', []
    for source, one in yes.items():
        lists = [[one, no], [no, no, one], [no, no], [], None, [None, "{", one], [None, "{"], [one] * 3]
        rows += [(source, "r", i, i, "bad" if x is None else None, x) for i, x in enumerate(lists)]
    return spark.createDataFrame(rows, "source string, run_id string, page int, cursor long, page_error string, postings array<string>")


def test_stop_facts_stop_where_page_facts_do(spark):
    from offerlake.plans.ingest import page_facts, salaried_postings, stop_facts

    keys = ("source", "run_id", "page")
    for source in (SOURCE_A, SOURCE_B):
        pages = _odd_pages(spark).where(F.col("source") == source)
        want = page_facts(salaried_postings(pages, source), keys)
        for since in (None, dt.datetime(2024, 1, 1)):
            got = stop_facts(pages, source, since, keys)
            assert {(r["page"], r["page_error"], r["n_salaried"] > 0, r["has_old"]) for r in got.collect()} == \
                {(r["page"], r["page_error"], r["n_salaried"] > 0, r["has_old"]) for r in want.collect()}
        assert got.count() == 8


def test_a_filter_does_not_parse_postings_again(spark):
    from offerlake.plans.ingest import salaried_postings

    kept = salaried_postings(_odd_pages(spark), SOURCE_A, keep=("source", "page")).where("salaried").select("page", "posting")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"(?i)parse_?json", plan)) == 1
