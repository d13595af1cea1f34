"""Whole runs (L1-L5, A1-A3, S5, T1) against a sequential model on random pages."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from offerlake.plans.ingest import plan_run, run_ingest
from offerlake.session import scratch_path
from offerlake.sources.store import append_records, read_store
from offerlake.sources.tables import LANDED_PAGES, RAW_POSTINGS, SOURCE_A, SOURCE_B
from offerlake.streaming.ingest import run_stream_available_now
from tests import model

DATE = dt.date(2024, 3, 1)
BASE = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def _posting(rng, n_ids, b=False):
    p = {}
    i = rng.randrange(n_ids)
    if b:
        if rng.random() < 0.8:
            p["id"] = i
        p["slug"] = f"s-{i}"
        r = rng.random()
        if r < 0.3:
            p["salary_from"] = rng.choice([0, 10, 2.5])
        elif r < 0.55:
            p["employmentTypes"] = [{"type": "b2b", "from": rng.choice([0, 100, None, "9"])}]
        elif r < 0.65:
            p["salary"] = "12"
    else:
        p["title"] = f"job {i}"
        if rng.random() < 0.3:
            p["reference"] = f"R{i % 7}"
        p["url"] = f"u-{i}"
        r = rng.random()
        if r < 0.35:
            p["salary"] = {"from": 1}
        elif r < 0.6:
            p["employmentTypes"] = [{"type": "b2b", "salary": rng.choice([{"from": 5}, {}, None])}]
        elif r < 0.7:
            p["employmentTypes"] = [{"from": 0}]
    t = BASE + dt.timedelta(days=rng.randrange(60))
    r = rng.random()
    key = "publishedAt" if b else "posted"
    if r < 0.4:
        p[key] = int(t.timestamp() * 1000)
    elif r < 0.8:
        p[key] = t.isoformat().replace("+00:00", "Z")
    return p


def _case_a(rng):
    n_pages = rng.randrange(3, 12)
    pages = {}
    for pg in range(1, n_pages + 1):
        if rng.random() < 0.05 and pg > 1:
            continue  # never landed: the crawl ends there
        k = rng.randrange(0, 8)
        pages[pg] = [_posting(rng, 25) for _ in range(k)]
    return pages


def _landed_a(spark, pages, run_id="r"):
    rows = [(SOURCE_A, run_id, pg, None, None, dt.datetime(2024, 3, 1),
             json.dumps({"postings": ps} if pg % 3 else {"wrap": {"postings": ps or [{"id": "x"}]}}))
            for pg, ps in pages.items()]
    # nested pages must hold a posting-like list; keep them non-empty in the model too
    return spark.createDataFrame(rows, LANDED_PAGES)


def _model_pages_a(pages):
    return {pg: (ps if pg % 3 else (ps or [{"id": "x"}])) for pg, ps in pages.items()}


def _store_with(spark, source, ids):
    path = scratch_path(spark, "test-store")
    rec = spark.createDataFrame([(i,) for i in ids] or [("__none__",)], "source_id string").select(
        "source_id", F.lit(None).cast("string").alias("job_slug"), F.current_timestamp().alias("ingested_at"),
        F.lit(0).alias("page"), F.lit(None).cast("string").alias("url"), F.lit("{}").alias("listing"),
        F.lit(None).cast("string").alias("details"), F.lit(None).cast(RAW_POSTINGS["sections"].dataType).alias("sections"),
        F.lit("old").alias("run_id"), F.lit(source).alias("source"), F.lit(DATE).alias("ingest_date"))
    append_records(rec, path)
    return path


@pytest.mark.parametrize("seed", range(6))
def test_run_a_matches_sequential_model(spark, seed):
    rng = random.Random(seed)
    pages = _case_a(rng)
    start = rng.choice([1, 1, 2])
    n = rng.choice([3, 20])
    since = BASE + dt.timedelta(days=rng.choice([0, 20, 45])) if rng.random() < 0.6 else None
    target = rng.choice([None, 3, 10])
    stored = {f"u-{i}" for i in range(25) if rng.random() < 0.2}
    store = _store_with(spark, SOURCE_A, sorted(stored))
    plan = plan_run(spark, _landed_a(spark, pages), source=SOURCE_A, run_id="r", max_pages=n, start_page=start,
                    since=since, target_count=target, store_path=store, ingest_date=DATE)
    got = sorted((r["source_id"], r["page"]) for r in plan.records.collect())
    want = sorted(model.run_a(_model_pages_a(pages), start_page=start, pages_max=n, since=since, target=target,
                              stored=frozenset(stored)))
    assert got == want


def _case_b(rng):
    cursors, batches = [], {}
    c = 0
    for _ in range(rng.randrange(3, 10)):
        cursors.append(c)
        r = rng.random()
        if r < 0.15:
            nxt = c + 200  # skips a page that is landed but never requested; it may point past the chain
            batches[c + 100] = ([_posting(rng, 40, b=True)], rng.choice([None, c + 150, c + 300]))
            batches[c + 150] = ([_posting(rng, 40, b=True)], None)
        elif r < 0.5:
            nxt = c + 100
        elif r < 0.55:
            nxt = c  # does not move forward: the end
        else:
            nxt = None
        k = rng.randrange(0, 9)
        batches[c] = ([_posting(rng, 40, b=True) for _ in range(k)], nxt)
        c = nxt if nxt and nxt > c else c + 100
    return batches


@pytest.mark.parametrize("seed", range(6))
def test_run_b_matches_sequential_model(spark, seed):
    rng = random.Random(100 + seed)
    batches = _case_b(rng)
    n = rng.choice([2, 50])
    since = BASE + dt.timedelta(days=rng.choice([10, 30])) if rng.random() < 0.5 else None
    target = rng.choice([None, 4, 12])
    stored = {str(i) for i in range(40) if rng.random() < 0.2}
    store = _store_with(spark, SOURCE_B, sorted(stored))
    rows = [(SOURCE_B, "r", None, c, 100, dt.datetime(2024, 3, 1),
             json.dumps({"data": d, "meta": ({"next": {"cursor": nx}} if nx is not None else {})}))
            for c, (d, nx) in batches.items()]
    landed = spark.createDataFrame(rows, LANDED_PAGES)
    plan = plan_run(spark, landed, source=SOURCE_B, run_id="r", max_pages=n, since=since, target_count=target,
                    store_path=store, ingest_date=DATE)
    got = sorted((r["source_id"], r["page"]) for r in plan.records.collect())
    want = sorted(model.run_b(batches, pages_max=n, since=since, target=target, stored=frozenset(stored)))
    assert got == want


def test_run_ingest_is_idempotent_and_counts(spark):
    rng = random.Random(7)
    pages = _case_a(rng)
    landed = _landed_a(spark, pages)
    store = scratch_path(spark, "test-idem")
    kw = dict(source=SOURCE_A, run_id="r", max_pages=50, ingest_date=DATE, store_path=store)
    first = {r["source"]: r["written"] for r in run_ingest(spark, landed, **kw).collect()}
    n_first = read_store(spark, store, SOURCE_A, DATE).count()
    assert first.get(SOURCE_A, 0) == n_first == len(model.run_a(_model_pages_a(pages), start_page=1, pages_max=50))
    second = {r["source"]: r["written"] for r in run_ingest(spark, landed, **kw).collect()}
    assert second.get(SOURCE_A, 0) == 0
    assert read_store(spark, store, SOURCE_A, DATE).count() == n_first


def test_bad_page_is_quarantined_or_fails(spark):
    rows = [(SOURCE_A, "r", 1, None, None, dt.datetime(2024, 3, 1), json.dumps({"postings": [{"id": 1, "salary": 1}]})),
            (SOURCE_A, "r", 2, None, None, dt.datetime(2024, 3, 1), "not json"),
            (SOURCE_A, "r", 3, None, None, dt.datetime(2024, 3, 1), json.dumps({"postings": [{"id": 3, "salary": 1}]}))]
    landed = spark.createDataFrame(rows, LANDED_PAGES)
    plan = plan_run(spark, landed, source=SOURCE_A, run_id="r", max_pages=10, ingest_date=DATE)
    assert [r["source_id"] for r in plan.records.collect()] == ["1"]
    assert [r["page"] for r in plan.quarantine.collect()] == [2]
    qpath = scratch_path(spark, "test-quarantine")
    run_ingest(spark, landed, source=SOURCE_A, run_id="r", max_pages=10, ingest_date=DATE,
               store_path=scratch_path(spark, "test-q-store"), quarantine_path=qpath)
    q = spark.read.parquet(qpath).collect()
    assert [(r["page"], r["body"]) for r in q] == [(2, "not json")]
    with pytest.raises(RuntimeError):
        run_ingest(spark, landed, source=SOURCE_A, run_id="r", max_pages=10, ingest_date=DATE,
                   store_path=scratch_path(spark, "test-fail"), on_bad_page="fail")


def test_stream_ingest_replay_safe(spark):
    rng = random.Random(11)
    pages = _case_a(rng)
    landed_dir = scratch_path(spark, "test-landed")
    _landed_a(spark, pages).repartition(3).write.parquet(landed_dir)
    store = scratch_path(spark, "test-stream-store")
    run_stream_available_now(spark, landed_dir, store, source=SOURCE_A, max_files_per_trigger=1,
                             checkpoint=scratch_path(spark, "test-stream-ckpt"))
    want = {model.name_of(p, model.A_IDS) for ps in _model_pages_a(pages).values() for p in ps if model.pays_a(p)}
    got = [r["source_id"] for r in read_store(spark, store, SOURCE_A).collect()]
    assert sorted(got) == sorted(want)
    # a second stream over the same files (fresh checkpoint) writes nothing twice
    run_stream_available_now(spark, landed_dir, store, source=SOURCE_A, checkpoint=scratch_path(spark, "test-stream-ckpt"))
    assert read_store(spark, store, SOURCE_A).count() == len(want)


def test_bad_page_has_a_default_quarantine(spark):
    rows = [(SOURCE_A, "r", 1, None, None, dt.datetime(2024, 3, 1), json.dumps({"postings": [{"id": 1, "salary": 1}]})),
            (SOURCE_A, "r", 2, None, None, dt.datetime(2024, 3, 1), '{"postings": [{"id": 2, "salary": 1}]} x')]
    store = scratch_path(spark, "test-default-q")
    run_ingest(spark, spark.createDataFrame(rows, LANDED_PAGES), source=SOURCE_A, run_id="r", max_pages=10, ingest_date=DATE,
               store_path=store)
    assert [r["page"] for r in spark.read.parquet(f"{store}_quarantine").collect()] == [2]


def test_two_writes_in_one_second_count_their_own(spark):
    def landed(i):
        return spark.createDataFrame([(SOURCE_A, "r", 1, None, None, dt.datetime(2024, 3, 1),
                                       json.dumps({"postings": [{"id": i, "salary": 1}]}))], LANDED_PAGES)
    store = scratch_path(spark, "test-stamp")
    second = dt.datetime(2024, 3, 1, 12, 0, 0)
    counts = [run_ingest(spark, landed(i), source=SOURCE_A, run_id="r", max_pages=1, ingest_date=DATE, store_path=store,
                         ingested_at=second.replace(microsecond=i)).first()["written"] for i in (1, 2)]
    assert counts == [1, 1]


def test_a_page_fetched_again_counts_once(spark):
    old = [{"id": "o1", "salary": 1}, {"id": "o2", "salary": 1}]
    rows = [(SOURCE_A, "r", 1, None, None, dt.datetime(2024, 3, 1), json.dumps({"postings": old})),
            (SOURCE_A, "r", 1, None, None, dt.datetime(2024, 3, 2), json.dumps({"postings": [{"id": "n1", "salary": 1}]})),
            (SOURCE_A, "r", 2, None, None, dt.datetime(2024, 3, 1), json.dumps({"postings": [{"id": "p2", "salary": 1}]}))]
    plan = plan_run(spark, spark.createDataFrame(rows, LANDED_PAGES), source=SOURCE_A, run_id="r", max_pages=9, ingest_date=DATE)
    assert sorted((r["source_id"], r["page"]) for r in plan.records.collect()) == [("n1", 1), ("p2", 2)]


def test_stops_beyond_the_first_range(spark, monkeypatch):
    """The result does not depend on the widths of the ranges that are searched."""
    from offerlake.plans import ingest
    rng = random.Random(21)
    pages = {pg: [_posting(rng, 400) for _ in range(6)] + [{"url": f"x{pg}", "salary": 1}] for pg in range(1, 40)}
    pages[30] = [{"title": "nothing"}]
    landed = _landed_a(spark, pages)
    kw = dict(source=SOURCE_A, run_id="r", max_pages=100, ingest_date=DATE)
    for target in (None, 60):
        want = sorted(model.run_a(_model_pages_a(pages), start_page=1, pages_max=100, target=target))
        for width, growth in ((256, 8), (4, 2)):
            monkeypatch.setattr(ingest, "FIRST_RANGE", width)
            monkeypatch.setattr(ingest, "RANGE_GROWTH", growth)
            got = plan_run(spark, landed, target_count=target, **kw).records
            assert sorted((r["source_id"], r["page"]) for r in got.collect()) == want


def test_stream_quarantines_each_bad_page_once(spark):
    rows = [(SOURCE_A, "r", pg, None, None, at, body) for pg, at, body in
            [(1, dt.datetime(2024, 3, 1), '{"postings": [{"id": "a", "salary": 1}]}'), (2, dt.datetime(2024, 3, 1), "broken"),
             (3, None, '{"postings": [{"id": "c", "salary": 1}]}')]]
    landed_dir, store = scratch_path(spark, "test-bad-landed"), scratch_path(spark, "test-bad-store")
    spark.createDataFrame(rows, LANDED_PAGES).write.parquet(landed_dir)
    for _ in range(2):  # the second start has no checkpoint: a replay
        run_stream_available_now(spark, landed_dir, store, source=SOURCE_A, checkpoint=scratch_path(spark, "test-bad-ckpt"))
    assert sorted(r["source_id"] for r in read_store(spark, store, SOURCE_A).collect()) == ["a", "c"]
    assert [(r["page"], r["body"]) for r in spark.read.parquet(f"{store}_quarantine").collect()] == [(2, "broken")]


def test_equal_fetch_times_have_one_latest_detail(spark):
    from offerlake.operators.details import latest_details
    at = dt.datetime(2024, 1, 1)
    rows = [(SOURCE_A, "a", at, '{"v": %d}' % i, None) for i in range(20)]
    schema = "source string, job_slug string, fetched_at timestamp, body string, error string"
    got = {latest_details(spark.createDataFrame(rows[i:] + rows[:i], schema).repartition(4), SOURCE_A).first()["details"] for i in (0, 7, 13)}
    assert len(got) == 1


def test_source_b_details_are_kept_raw(spark):
    from offerlake.operators.details import attach_details
    recs = spark.createDataFrame([(SOURCE_B, "a"), (SOURCE_B, "/b"), (SOURCE_B, "c"), (SOURCE_B, "")],
                                 "source string, job_slug string")
    details = spark.createDataFrame(
        [(SOURCE_B, "a", dt.datetime(2024, 1, 1), '{"x": 1}', None),
         (SOURCE_B, "a", dt.datetime(2024, 1, 2), '[2]', None),       # latest wins; any JSON is kept
         (SOURCE_B, "b", dt.datetime(2024, 1, 1), "oops", None),      # not JSON: a failed fetch
         (SOURCE_B, "c", dt.datetime(2024, 1, 1), None, "HTTP 500")],  # failed fetch
        "source string, job_slug string, fetched_at timestamp, body string, error string")
    got = {r["job_slug"]: (r["details"], r["sections"]) for r in attach_details(recs, details, SOURCE_B).collect()}
    assert got == {"a": ("[2]", None), "/b": (None, None), "c": (None, None), "": (None, None)}


def test_skip_existing_scope(spark):
    pages = {1: [{"title": "t", "url": "u1", "salary": 1}, {"title": "t", "url": "u2", "salary": 1}]}
    landed = _landed_a(spark, pages)
    store = _store_with(spark, SOURCE_A, ["u1"])  # stored on DATE
    other_day = DATE + dt.timedelta(days=1)
    kw = dict(source=SOURCE_A, run_id="r", max_pages=5, store_path=store, ingest_date=other_day)
    same = sorted(r["source_id"] for r in plan_run(spark, landed, **kw).records.collect())
    every = sorted(r["source_id"] for r in plan_run(spark, landed, scope="all_dates", **kw).records.collect())
    assert same == ["u1", "u2"] and every == ["u2"]


def test_stream_restart_processes_only_new_files(spark):
    """T1 restart: the same checkpoint resumes after the files it has seen."""
    first = {1: [{"title": "t", "url": "a1", "salary": 1}, {"title": "t", "url": "a2", "salary": 1}]}
    second = {2: [{"title": "t", "url": "a2", "salary": 1}, {"title": "t", "url": "b1", "salary": 1}]}
    landed_dir = scratch_path(spark, "test-restart-landed")
    store = scratch_path(spark, "test-restart-store")
    ckpt = scratch_path(spark, "test-restart-ckpt")
    _landed_a(spark, first).write.mode("append").parquet(landed_dir)
    run_stream_available_now(spark, landed_dir, store, source=SOURCE_A, checkpoint=ckpt)
    assert sorted(r["source_id"] for r in read_store(spark, store, SOURCE_A).collect()) == ["a1", "a2"]
    _landed_a(spark, second).write.mode("append").parquet(landed_dir)
    run_stream_available_now(spark, landed_dir, store, source=SOURCE_A, checkpoint=ckpt)
    rows = read_store(spark, store, SOURCE_A).collect()
    assert sorted(r["source_id"] for r in rows) == ["a1", "a2", "b1"]
    assert [r["page"] for r in rows if r["source_id"] == "b1"] == [2]
