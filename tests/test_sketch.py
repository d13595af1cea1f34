"""Key sketches of the store, epochs of the stream, and the target count that reads each page once."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from offerlake.operators.dedup import skip_existing
from offerlake.plans import ingest
from offerlake.plans.ingest import plan_run, run_ingest
from offerlake.session import saved, scratch_path
from offerlake.sources import sketch
from offerlake.sources.store import append_records, path_exists, read_store
from offerlake.sources.tables import LANDED_PAGES, RAW_POSTINGS, SECTIONS, SOURCE_A, SOURCE_B
from offerlake.streaming import ingest as stream
from tests.test_plans import _plan

DAY = dt.date(2024, 3, 1)
STAMP = dt.datetime(2024, 3, 1, 12)


def _records(ids, source=SOURCE_A, day=DAY, stamp=STAMP):
    return ids.select(
        F.col("id").cast("string").alias("source_id"), F.lit("s").alias("job_slug"),
        F.lit(stamp.isoformat(sep=" ")).cast("timestamp").alias("ingested_at"), F.lit(1).alias("page"),
        F.lit("u").alias("url"), F.lit("{}").alias("listing"), F.lit(None).cast("string").alias("details"),
        F.lit(None).cast(SECTIONS).alias("sections"), F.lit("r").alias("run_id"), F.lit(source).alias("source"),
        F.lit(day).alias("ingest_date")).select(*RAW_POSTINGS.fieldNames())


def _keys(spark, lo, hi, source=SOURCE_A, day=DAY):
    rows = spark.range(lo, hi).select(F.lit(source).alias("source"), F.lit(day).alias("ingest_date"),
                                      F.col("id").cast("string").alias("source_id"))
    return saved(rows, "test-keys")


def _ids(df):
    return sorted(int(r["source_id"]) for r in df.collect())


def test_no_stored_id_is_missed_and_few_others_hit(spark):
    """Several blocks a write, several writes, sources and dates."""
    store = scratch_path(spark, "sketch-store")
    later = DAY + dt.timedelta(days=1)
    sketch.append_sketched(_records(spark.range(0, 9000)), store, STAMP)
    sketch.append_sketched(_records(spark.range(9000, 9300), stamp=STAMP + dt.timedelta(seconds=1)), store, STAMP + dt.timedelta(seconds=1))
    sketch.append_sketched(_records(spark.range(9300, 9400), day=later, stamp=STAMP + dt.timedelta(seconds=2)), store,
                           STAMP + dt.timedelta(seconds=2))
    sketch.append_sketched(_records(spark.range(50_000, 50_100), source=SOURCE_B, stamp=STAMP), store, STAMP)
    rows = spark.read.schema(sketch.SKETCH).parquet(f"{sketch.sketch_path(store)}/bits")
    assert {r["blocks"] for r in rows.select("blocks").collect()} == {1, 8}
    asked = _keys(spark, 0, 40_000)
    hits = _ids(sketch.possible_keys(asked, store, pruned=F.col("source") == SOURCE_A))
    assert set(range(9400)) <= set(hits) and len(hits) - 9400 < 0.02 * 30_600
    assert _ids(sketch.skip_sketched(asked, store, source=SOURCE_A)) == list(range(9400, 40_000))
    # by date: the ids of the other day are new
    assert _ids(sketch.skip_sketched(asked, store, dated=True)) == list(range(9300, 40_000))


def test_a_batch_of_new_ids_reads_no_column_of_the_store(spark):
    store = scratch_path(spark, "sketch-unread")
    sketch.append_sketched(_records(spark.range(0, 100)), store, STAMP)
    fresh = _keys(spark, 1_000_000, 1_000_020)
    assert store + "/" not in _plan(sketch.skip_sketched(fresh, store, source=SOURCE_A)).replace(sketch.sketch_path(store), "")
    assert f"{store}]" not in _plan(sketch.skip_sketched(fresh, store, source=SOURCE_A))
    mixed = _keys(spark, 95, 105)
    new = sketch.skip_sketched(mixed, store, source=SOURCE_A)
    assert f"{store}]" in _plan(new) and _ids(new) == list(range(100, 105))


def test_sketch_odd_cases(spark):
    none = scratch_path(spark, "sketch-none")
    asked = _keys(spark, 0, 5)
    assert _ids(sketch.skip_sketched(asked, none, source=SOURCE_A)) == [0, 1, 2, 3, 4]  # no store
    old = scratch_path(spark, "sketch-old")
    append_records(_records(spark.range(0, 3)), old)
    sketch.append_sketched(_records(spark.range(3, 4)), old, STAMP)  # a store without a sketch stays without
    assert not sketch.has_sketch(spark, old)
    assert _ids(sketch.skip_sketched(asked, old, source=SOURCE_A)) == [4]
    sketch.build_sketch(spark, old)
    assert sketch.has_sketch(spark, old) and _ids(sketch.skip_sketched(asked, old, source=SOURCE_A)) == [4]
    empty = scratch_path(spark, "sketch-empty")
    sketch.append_sketched(_records(spark.range(0)), empty, STAMP)
    assert _ids(sketch.skip_sketched(asked, empty, source=SOURCE_A)) == [0, 1, 2, 3, 4]
    # repeated rows, a NULL id and further columns pass
    odd = saved(spark.createDataFrame([(SOURCE_A, None, "x"), (SOURCE_A, "9", "y"), (SOURCE_A, "9", "y"), (SOURCE_A, "1", "z")],
                                      "source string, source_id string, bits string"), "test-odd")
    got = sorted((r["source_id"] or "", r["bits"]) for r in sketch.skip_sketched(odd, old, source=SOURCE_A).collect())
    assert got == [("", "x"), ("9", "y"), ("9", "y")]


def test_a_write_cut_off_before_its_sketch_is_settled(spark, monkeypatch):
    store = scratch_path(spark, "sketch-cut")
    sketch.append_sketched(_records(spark.range(0, 10)), store, STAMP)
    with monkeypatch.context() as m:
        m.setattr(sketch, "_close", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            after = STAMP + dt.timedelta(seconds=5)
            sketch.append_sketched(_records(spark.range(10, 20), stamp=after), store, after)
    assert len(sketch.names_in(spark, f"{sketch.sketch_path(store)}/open")) == 1
    assert _ids(sketch.skip_sketched(_keys(spark, 0, 25), store, source=SOURCE_A)) == [20, 21, 22, 23, 24]
    assert not sketch.names_in(spark, f"{sketch.sketch_path(store)}/open")


def _page(pg, ids, at=dt.datetime(2024, 3, 1)):
    return (SOURCE_A, "r", pg, None, None, at, json.dumps({"postings": [{"id": i, "salary": 1} for i in ids]}))


def test_all_dates_scope_by_the_sketch_equals_the_join(spark):
    store = scratch_path(spark, "sketch-runs")
    for day, ids in ((0, range(1, 8)), (1, range(5, 12))):
        landed = spark.createDataFrame([_page(1, ids)], LANDED_PAGES)
        run_ingest(spark, landed, source=SOURCE_A, run_id="r", max_pages=5, ingest_date=DAY + dt.timedelta(days=day),
                   store_path=store, scope="all_dates")
    assert _ids(read_store(spark, store)) == list(range(1, 12))
    landed = spark.createDataFrame([_page(1, range(8, 15)), _page(2, range(13, 30))], LANDED_PAGES)
    kw = dict(source=SOURCE_A, run_id="r", max_pages=5, ingest_date=DAY, store_path=store, scope="all_dates")
    by_sketch = _ids(plan_run(spark, landed, **kw).records)
    every = plan_run(spark, landed, **{**kw, "store_path": None, "scope": "date"}).records
    assert by_sketch == _ids(skip_existing(every, read_store(spark, store))) == list(range(12, 30))
    assert _ids(plan_run(spark, landed, target_count=2, **kw).records) == [12, 13, 14]


def _stream(spark, landed, store, ckpt):
    stream.run_stream_available_now(spark, landed, store, source=SOURCE_A, checkpoint=ckpt, max_files_per_trigger=1)


@pytest.mark.parametrize("broken", ["before", "half", "unsketched", "after"])
def test_a_batch_that_fails_and_restarts_gives_the_one_batch_result(spark, monkeypatch, broken):
    """The write of the second batch fails: before it, after half of its rows, before its sketch, after the whole."""
    landed, store, ckpt = (scratch_path(spark, f"epoch-{n}") for n in ("landed", "store", "ckpt"))
    spark.createDataFrame([_page(1, range(1, 6))], LANDED_PAGES).coalesce(1).write.mode("append").parquet(landed)
    _stream(spark, landed, store, ckpt)
    spark.createDataFrame([_page(2, range(4, 14)), (SOURCE_A, "r", 3, None, None, dt.datetime(2024, 3, 1), "broken")],
                          LANDED_PAGES).coalesce(1).write.mode("append").parquet(landed)

    def fails(records, path, stamp):
        if broken == "half":
            records = records.where(F.col("source_id").cast("int") % 2 == 0)
        if broken in ("half", "unsketched"):
            sketch.make_mark(spark, f"{sketch.sketch_path(path)}/open/{stamp.strftime(sketch.STAMP)}")
            append_records(records, path)
        elif broken == "after":
            sketch.append_sketched(records, path, stamp)
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(stream, "append_sketched", fails)
        with pytest.raises(Exception, match="lost"):
            _stream(spark, landed, store, ckpt)
    _stream(spark, landed, store, ckpt)
    rows = read_store(spark, store).collect()
    assert sorted(int(r["source_id"]) for r in rows) == list(range(1, 14))
    # the rows of the second batch bear the stamp of its first try
    assert len({r["ingested_at"] for r in rows if r["page"] == 2}) == 1
    assert [r["page"] for r in spark.read.parquet(f"{store}_quarantine").collect()] == [3]


def test_a_finished_epoch_is_left_out(spark):
    store, ckpt = scratch_path(spark, "done-store"), scratch_path(spark, "done-ckpt")
    write = stream.write_batch(store, f"{store}_quarantine", ckpt)
    pages = spark.createDataFrame([_page(1, [1, 2])], LANDED_PAGES)
    write(stream.stream_postings(pages, SOURCE_A), 4)
    assert path_exists(spark, f"{ckpt}/epochs/4.done") and not path_exists(spark, f"{ckpt}/epochs/4.open")
    write(stream.stream_postings(spark.createDataFrame([_page(1, [3])], LANDED_PAGES), SOURCE_A), 4)
    assert _ids(read_store(spark, store)) == [1, 2]
    write(stream.stream_postings(spark.createDataFrame([_page(1, [2, 3])], LANDED_PAGES), SOURCE_A), 5)
    assert _ids(read_store(spark, store)) == [1, 2, 3]


def test_the_target_count_reads_each_page_once(spark, monkeypatch):
    monkeypatch.setattr(ingest, "FIRST_RANGE", 4)
    monkeypatch.setattr(ingest, "RANGE_GROWTH", 2)
    rows = [_page(pg, [pg * 3, pg * 3 + 1, pg]) for pg in range(1, 31)]
    landed = saved(spark.createDataFrame(rows, LANDED_PAGES), "target-landed")
    read = []
    kept = ingest._kept_postings

    def watched(run, source, since, upto=None, after=None):
        if after is not None:
            read.append((after, upto))
        out = kept(run, source, since, upto, after)
        if after is not None:
            text = _plan(out)
            assert f"GreaterThanOrEqual(page,{after})" in text and f"LessThanOrEqual(page,{upto})" in text
        return out

    monkeypatch.setattr(ingest, "_kept_postings", watched)
    got = plan_run(spark, landed, source=SOURCE_A, run_id="r", max_pages=100, ingest_date=DAY, target_count=40).records
    seen, last = set(), None
    for pg in range(1, 31):
        seen |= {pg * 3, pg * 3 + 1, pg}
        if len(seen) >= 40:
            last = pg
            break
    assert _ids(got) == sorted(seen) and max(r["page"] for r in got.collect()) == last
    assert read == [(1, 4), (5, 12), (13, 28)]
