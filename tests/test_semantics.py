"""SURVEY §2 semantics bullets as literal rows, checked against Python."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from offerlake.functions.json import is_number, truthy
from offerlake.functions.keys import content_id, job_slug, source_id_a, source_id_b, url_a, url_b
from offerlake.functions.salary import has_salary_a, has_salary_b
from offerlake.functions.text import html_to_text, split_lines, text_lines, utrim, with_html_text, without_tags
from offerlake.functions.time import posted_at, resolve_date, resolve_since
from offerlake.operators.details import with_sections
from offerlake.operators.extract import locate_data_list, locate_postings
from tests import model

VALUES = ["null", "false", "true", "0", "0.0", "-0.0", "0e0", "1", "1.5", '""', '"0"', '"a"', "[]", "{}",
          "[0]", '{"a":null}', '"  "', "-2", "1e-400"]


def test_truthy_and_number_match_python(spark):
    df = spark.createDataFrame([(v,) for v in VALUES], "j string").withColumn("v", F.parse_json("j"))
    got = {r["j"]: (r["t"], r["n"]) for r in
           df.select("j", truthy(F.col("v")).alias("t"), is_number(F.col("v")).alias("n")).collect()}
    for v in VALUES:
        x = json.loads(v)
        assert got[v] == (bool(x), isinstance(x, (int, float))), v


def test_absent_key_is_falsy_and_not_a_number(spark):
    df = spark.createDataFrame([('{"a":1}',)], "j string").withColumn("v", F.parse_json("j"))
    r = df.select(truthy(F.try_variant_get("v", "$.b", "variant")).alias("t"),
                  is_number(F.try_variant_get("v", "$.b", "variant")).alias("n")).first()
    assert (r["t"], r["n"]) == (False, False)


POSTINGS = [
    {"salary": {"from": 1}},
    {"salary": "12"},
    {"salaryRange": {}},
    {"employmentTypes": [{"from": 0}]},
    {"employmentTypes": [{"to": 5}]},
    {"employmentTypes": [], "employmentType": [{"salary": {"x": 1}}]},
    {"employmentTypes": [{"type": "b2b"}], "employmentType": [{"salary": 1}]},
    {"employmentTypes": ["x", {"salaryRange": [1]}]},
    {"employmentTypes": [{"from": True}]},
    {"employmentTypes": [{"from": "100"}]},
    {"salary_from": 0},
    {"salary_to": 3.5},
    {"salary": False},
    {"salary": None, "salary_to": None},
    [1, 2],
    "text",
    {},
]


def test_salary_rules_match_python(spark):
    df = spark.createDataFrame([(json.dumps(p),) for p in POSTINGS], "p string").withColumn("v", F.parse_json("p"))
    got = df.select("p", has_salary_a(F.col("v")).alias("a"), has_salary_b(F.col("v")).alias("b")).collect()
    for r in got:
        p = json.loads(r["p"])
        assert (r["a"], r["b"]) == (model.pays_a(p), model.pays_b(p)), r["p"]


KEYED = [
    {"reference": "R1", "url": "u", "id": 5},
    {"reference": "", "url": "/x", "id": 5},
    {"id": 0, "uuid": "U", "slug": "s"},
    {"id": 7},
    {"id": 1.0},
    {"id": True, "slug": "s"},
    {"postingId": [1, 2]},
    {"uuid": {"b": 1, "a": "é"}},
    {"title": "no keys", "salary": 1.5},
    {"slug": "only-slug", "postingUrl": "pu"},
    {"postingUrl": "/p"},
]


def test_keys_match_python_str(spark):
    df = spark.createDataFrame([(json.dumps(p, ensure_ascii=False),) for p in KEYED], "p string") \
        .withColumn("v", F.parse_json("p"))
    out = df.select("p", source_id_a(F.col("v"), F.col("p")).alias("a"), source_id_b(F.col("v"), F.col("p")).alias("b"),
                    job_slug(F.col("v"), F.col("p")).alias("s"), url_a(F.col("v")).alias("ua"),
                    url_b(F.col("v")).alias("ub")).collect()
    for r in out:
        p = json.loads(r["p"])
        assert r["a"] == model.name_of(p, model.A_IDS), r["p"]
        assert r["b"] == model.name_of(p, model.B_IDS), r["p"]
        assert r["s"] == model.name_of(p, ("reference", "url", "slug", "postingUrl", "id")), r["p"]
        assert r["ua"] == ((p.get("url") or p.get("postingUrl")) or None)
        assert r["ub"] == ((p.get("url") or p.get("slug")) or None)


def test_content_id_is_python_hash():
    assert content_id({"b": 1, "a": "x"}) == __import__("hashlib").sha256(b'{"a": "x", "b": 1}').hexdigest()[:20]


TIMES = [
    {"posted": 1704067200123},
    {"posted": "2024-01-01T10:00:00Z"},
    {"posted": "2024-01-01T10:00:00+02:00"},
    {"posted": "2024-01-01"},
    {"posted": "2024-01-01 10:30"},
    {"posted": "20240101T103000"},
    {"posted": "garbage", "renewed": 1},
    {"posted": 0, "renewed": "2024-02-02T00:00:00Z"},
    {"posted": "", "publishedAt": 1000},
    {"posted": True},
    {"publishedAt": 0},
    {"publishedAt": False},
    {"posted": 1e20},
    {"posted": -1000},
    {"posted": [1]},
    {"posted": "2024-W01-1"},
    {"posted": "2020-W53-7T10:00:00Z"},
    {"posted": "2021-W53-1"},
    {"posted": "2024W107T101500+01:00"},
    {"posted": "2024-W10"},
    {"posted": "2024-W00-1"},
    {"posted": "2024-W1-1"},
    {"posted": "2024-W011"},
    {},
]


def test_posted_at_matches_python(spark):
    df = spark.createDataFrame([(json.dumps(p),) for p in TIMES], "p string").withColumn("v", F.parse_json("p"))
    for r in df.select("p", posted_at(F.col("v")).alias("t")).collect():
        want = model.time_of(json.loads(r["p"]))
        got = r["t"]
        if want is not None:
            want = want.astimezone(dt.timezone.utc).replace(tzinfo=None)
        assert got == want, r["p"]


def test_resolve_since():
    now = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)
    assert resolve_since(window="last_week", now=now) == now - dt.timedelta(days=7)
    assert resolve_since(window="last_half_year", now=now) == now - dt.timedelta(days=182)
    assert resolve_since("2024-01-15") == dt.datetime(2024, 1, 15, tzinfo=dt.timezone.utc)
    assert resolve_since() is None
    with pytest.raises(ValueError):
        resolve_since("2024-01-01", "last_week")


TEXTS = ["a\nb", "  a  \r\n\n b ", "x\x0by\x0cz\x1cw v", "", " \t "]


def test_split_lines_and_trim_match_python(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for r in df.select("t", split_lines(F.col("t")).alias("l"), utrim(F.col("t")).alias("s")).collect():
        assert r["l"] == [x.strip() for x in r["t"].splitlines() if x.strip()]
        assert r["s"] == r["t"].strip()


HTML = [
    "<p>Water the plants</p>",
    "<p>a <b>b</b></p>",
    "<div>x<script>var t='</p>';</script>y<!-- c --><style>p{}</style>z</div>",
    "<p>Tom &amp; Jerry &middot; &quot;q&quot; &copy;</p>",
    "<p>1 < 2 and 3 > 1</p>",
    "<p>caf&eacute; &#233; &#x41; &#150;</p>",
    "<p>a&nbsp;b &nbsp;</p><title>x&amp</title><p>&am y &foo; z</p>",
    "<ul><li> one </li><li> </li><li>two</li></ul>",
    "plain text",
    "",
]


def test_html_text_agrees_with_the_parser(spark):
    df = spark.createDataFrame([(h,) for h in HTML], "h string")
    for r in with_html_text(df, {"t": "h"}).collect():
        assert r["t"] == html_to_text(r["h"]), r["h"]


def test_fast_path_on_plain_fragments(spark):
    df = spark.createDataFrame([("<p>Total <b>3</b></p>",)], "h string").select(without_tags(F.col("h")).alias("t"))
    r = df.select("t.whole", text_lines(F.col("t.text")).alias("x")).first()
    assert (r["whole"], r["x"]) == (True, "Total\n3")


DETAILS = [
    {"requirements": {"musts": [{"value": " Python "}, {"name": "SQL"}, "  Go ", {"value": ""}, 5, {"value": 7}]}},
    {"requirements": {"musts": [{"value": 1.5}, {"name": True}]}},
    {"requirements": {"description": ""}, "details": {"description": "<p>Perks</p>"}},
    {"x": {"sections": [{"title": "Must have", "items": ["A", {"text": "B"}, {"label": ""}]},
                        {"title": "Requirements", "content": " 3 lines "},
                        {"title": "We offer", "items": ["Total", "3"]}]}},
    {"requirements": {"musts": []}, "a": {"sections": [{"title": "MUST HAVE", "content": "l1\n\n l2 "}]},
     "b": {"sections": [{"title": "Offer description", "values": [{"value": "v"}]},
                        {"title": "must have", "items": ["z"]}]}},
    {"sections": [{"title": "requirements description", "items": ["i1", "i2"]}], "y": [{"sections": []}]},
    {"nothing": 1},
]


def test_locate_postings_errors_and_empty(spark):
    # what each body holds, by hand; the last value of an object is searched first
    bodies = [('{"postings": []}', []), ('{"postings": null, "a": [{"title": "t"}]}', [{"title": "t"}]), ("[1]", None), ("nope", None),
              ('{"a": [{"x": 1}]}', None), ('{"a": [{"id": 1}], "b": {"c": [{"slug": "s"}]}}', [{"slug": "s"}])]
    df = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(bodies)], "page int, body string")
    got = {r["page"]: (r["postings"], r["page_error"]) for r in locate_postings(df).collect()}
    for i, (body, want) in enumerate(bodies):
        assert (None if got[i][0] is None else [json.loads(x) for x in got[i][0]]) == want, body
        assert (got[i][1] is None) == (want is not None), body


def test_locate_data_list_shapes(spark):
    bodies = ['{"data": [{"id": 1}], "meta": {"next": {"cursor": 100}}}', '{"data": null}', '{"data": "x"}',
              '{"data": [], "meta": {}}', '{"meta": [1]}', "[]"]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "cursor bigint, body string")
    got = {r["cursor"]: r for r in locate_data_list(df).collect()}
    assert got[0]["postings"] == ['{"id":1}'] and got[0]["next_cursor"] == 100
    assert got[1]["postings"] == [] and got[1]["page_error"] is None
    assert got[2]["page_error"] is not None
    assert got[3]["postings"] == [] and got[3]["next_cursor"] is None
    assert got[4]["page_error"] is not None
    assert got[5]["page_error"] is not None


def test_resolve_date():
    assert resolve_date("2024-02-29") == dt.date(2024, 2, 29)
    assert resolve_date(None) == dt.datetime.now(dt.timezone.utc).date()


def test_strip_html_on_real_pages(spark):
    """The gated fast path equals the parser on every page of the table."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    out = with_html_text(pages.select("html"), {"t": "html"}).collect()
    assert out and all(r["t"] == html_to_text(r["html"]) for r in out)


def test_iso_strings_match_python_fromisoformat(spark):
    """J5 on random ISO-8601 variants (separators, precisions, offsets, Z)."""
    import random
    rng = random.Random(5)
    cases = set()
    for _ in range(400):
        d = f"{rng.randrange(1990, 2030):04d}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 32):02d}"
        sep = rng.choice(["T", " ", "t", "_"])
        t = rng.choice(["", f"{sep}{rng.randrange(25):02d}", f"{sep}{rng.randrange(24):02d}:{rng.randrange(61):02d}",
                        f"{sep}{rng.randrange(24):02d}{rng.randrange(60):02d}{rng.randrange(60):02d}",
                        f"{sep}{rng.randrange(24):02d}:{rng.randrange(60):02d}:{rng.randrange(61):02d}"
                        f".{rng.randrange(10 ** 8)}"])
        z = rng.choice(["", "Z", "+00:00", "-05:30", "+0530", "+01", "+23:59", "+24:00", "-01:00:30.5"]) if t else ""
        cases.add(d + t + z)
    df = spark.createDataFrame([(json.dumps({"posted": c}),) for c in sorted(cases)], "p string") \
        .withColumn("v", F.parse_json("p"))
    for r in df.select("p", posted_at(F.col("v")).alias("t")).collect():
        want = model.time_of(json.loads(r["p"]))
        if want is not None:
            want = want.astimezone(dt.timezone.utc).replace(tzinfo=None)
        assert r["t"] == want, r["p"]


def test_sections_hand_derived(spark):
    """E6/E7/E10 expected values worked out by hand from the traversal rules."""
    empty = {"must_have": [], "requirements_description": None, "offer_description": None}
    docs = [
        (DETAILS[0], {**empty, "must_have": ["Python", "SQL", "Go", "7"]}),
        (DETAILS[1], {**empty, "must_have": ["1.5", "True"]}),
        (DETAILS[2], {**empty, "requirements_description": "", "offer_description": "Perks"}),
        (DETAILS[3], {"must_have": ["A", "B"], "requirements_description": "3 lines", "offer_description": "Total; 3"}),
        # b is searched before a (last child first); in b, "Offer description"
        # comes from values, then "must have" items; a's content lines follow
        (DETAILS[4], {**empty, "must_have": ["z", "l1", "l2"], "offer_description": "v"}),
        # the document's own sections come before its children are searched
        (DETAILS[5], {**empty, "requirements_description": "i1; i2"}),
        (DETAILS[6], empty),
    ]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, (d, _) in enumerate(docs)], "i int, b string")
    got = {r["i"]: r["s"].asDict() for r in with_sections(df, "b", "s").collect()}
    assert [got[i] for i in range(len(docs))] == [want for _, want in docs]


@pytest.mark.parametrize("levels", [600, 5000])
def test_deep_bodies_are_searched(levels):
    """Nested deeper than Python recurses: the postings and sections are found all the same."""
    from offerlake.operators.details import _legacy_sections
    from offerlake.operators.extract import find_postings

    open_, close = '{"a":[' * (levels // 2), "]}" * (levels // 2)
    body = '{"first":[{"id":1}],"last":' + open_ + '[{"id":2},{"x":3}]' + close + "}"
    assert find_postings(body) == (['{"id":2}', '{"x":3}'], None)  # of several children the last one first
    assert find_postings('{"a":' + open_ + close + "}") == (None, "no postings list in body")
    doc = json.loads('{"sections":[{"title":"own"}],"b":' + open_ + '{"sections":[{"title":"deep"}]}' + close + "}")
    assert [x["title"] for x in _legacy_sections(doc)] == ["own", "deep"]
    assert find_postings("[" * 60_000 + "]" * 60_000)[1] == "body is nested deeper than a JSON parser reads"
