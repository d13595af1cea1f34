"""Each rule on an example of its own, with the result worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from offerlake.functions.salary import has_salary_a, has_salary_b
from offerlake.functions.text import html_to_text, with_html_text
from offerlake.operators.details import with_sections
from offerlake.operators.extract import explode_postings, first_list, locate_data_list, locate_postings
from offerlake.operators.normalize import normalize_salaries
from offerlake.operators.paging import cursor_chain, page_range
from offerlake.sources.tables import SOURCE_A, SOURCE_B

PAYS_A = [
    ({"salaryRange": {"to": 90}}, True),
    ({"salary": [0]}, True),
    ({"employmentTypes": [{"kind": "uop"}, {"kind": "b2b", "to": 1}]}, True),
    ({"employmentTypes": [], "employmentType": [{"from": 3}]}, True),
    ({"employmentTypes": [{"kind": "uop"}], "employmentType": [{"from": 3}]}, False),
    ({"salary": 0, "salaryRange": {}}, False),
    ({"name": "Welder", "employmentTypes": [{"salary": None}]}, False),
]
PAYS_B = [
    ({"salary_to": 0}, True),
    ({"employmentTypes": [{"to": False}]}, True),
    ({"employmentTypes": [{"from": "7000"}], "salary": "7000"}, False),
    ({"salary_from": None}, False),
]


@pytest.mark.parametrize("rule,cases", [(has_salary_a, PAYS_A), (has_salary_b, PAYS_B)])
def test_who_pays(spark, rule, cases):
    df = spark.createDataFrame([(i, json.dumps(p)) for i, (p, _) in enumerate(cases)], "i int, p string")
    got = {r["i"]: r["x"] for r in df.select("i", rule(F.try_parse_json("p")).alias("x")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]


def test_the_last_branch_is_searched_first(spark):
    body = json.dumps({"left": [{"slug": "l"}], "right": {"deep": [[{"company": "r1"}, {}], [{"nothing": 1}]]}})
    rows = explode_postings(locate_postings(spark.createDataFrame([(4, body)], "page int, body string")), ["page"])
    assert [(r["page"], r["pos"], json.loads(r["posting"])) for r in rows.orderBy("pos").collect()] == [
        (4, 0, {"company": "r1"}), (4, 1, {})]


DAMAGED = ['{"postings":[{"id":1}]} trailing', "{'postings':[{'id':1}]}", '{"postings":[{"id":1}]', '{"postings":[]}{}',
           '{"postings":[]},{}', '{"postings":[{"id":1}]}]', "", "[]", "3"]


def test_only_one_whole_document_is_a_body(spark):
    good = ['{"postings":[{"id":1}]}', ' \n{"postings":[{"id":1}]}\t']
    df = spark.createDataFrame(list(enumerate(DAMAGED + good)), "page int, body string")
    got = {r["page"]: r for r in locate_postings(df).collect()}
    assert all(got[i]["postings"] is None and got[i]["page_error"] for i in range(len(DAMAGED)))
    assert all(got[len(DAMAGED) + i]["postings"] == ['{"id":1}'] for i in range(len(good)))
    as_b = spark.createDataFrame([(i, b.replace("postings", "data")) for i, b in enumerate(DAMAGED + good)], "cursor bigint, body string")
    got = {r["cursor"]: r for r in locate_data_list(as_b).collect()}
    assert all(got[i]["postings"] is None and got[i]["page_error"] for i in range(len(DAMAGED)))
    assert all(got[len(DAMAGED) + i]["postings"] == ['{"id":1}'] for i in range(len(good)))


def test_next_cursors(spark):
    cases = [("250", 250, False), ('"250"', 250, False), ("250.0", 250, False), ("null", None, False), ("250.5", None, True),
             ('"x"', None, True), ("true", None, True), ("[1]", None, True), ('""', None, True)]
    df = spark.createDataFrame([(i, '{"data":[],"meta":{"next":{"cursor":%s}}}' % c) for i, (c, _, _) in enumerate(cases)],
                               "cursor bigint, body string")
    got = {r["cursor"]: (r["next_cursor"], r["page_error"] is not None) for r in locate_data_list(df).collect()}
    assert [got[i] for i in range(len(cases))] == [(n, bad) for _, n, bad in cases]


def test_first_list_or_an_error(spark):
    bodies = ['{"data":[1],"content":[{"a":1}]}', '{"postings":{},"data":[]}', '{"x":[1]}', "oops"]
    df = first_list(spark.createDataFrame(list(enumerate(bodies)), "i int, body string"))
    got = {r["i"]: (r["postings"], r["page_error"] is not None) for r in df.collect()}
    assert got == {0: (['{"a":1}'], False), 1: ([], False), 2: (None, True), 3: (None, True)}


def test_chain_never_counts_pages_that_only_off_chain_pages_point_to(spark):
    rows = [("s", "r", c, n, 100) for c, n in [(0, 250), (100, None), (200, 300), (250, None), (300, 350)]]
    pages = spark.createDataFrame(rows, "source string, run_id string, cursor bigint, next_cursor bigint, items_count int")
    got = {r["cursor"]: r["page"] for r in cursor_chain(pages, 0, None, 100).collect()}
    assert got == {0: 1, 250: 2}
    with pytest.raises(ValueError):
        cursor_chain(pages, -1, None, 100)
    with pytest.raises(ValueError):
        page_range(pages, 0)


FRAGMENTS = [
    ('<a title="a>b">x</a>', "x"),
    ('<p title="1 > 0">hi</p>', "hi"),
    ("<p title='it\"s <b>'>q</p>", "q"),
    ("one<script>var a=1;", "one"),
    ("a<!--c-->b", "a\nb"),
    ("a<!-- <p>c</p> -->b", "a\nb"),
    ("<!DOCTYPE html><p>d</p>", "d"),
    ("<p>5 < 6</p>", "5 < 6"),
    ("<style>p{}</style>s<template><p>t</p></template>u", "s\nu"),
    ('<script data-x="a>b">v</script>w', "w"),
    ("<p>caf&eacute; &amp;lt;</p><br/>z", "café &lt;\nz"),
    ("  <li> one </li>\n<li></li> <li>two</li>", "one\ntwo"),
    ("plain", "plain"), ("", ""), (None, None),
]


def test_html_text(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(FRAGMENTS)], "i int, h string")
    got = {r["i"]: r["t"] for r in with_html_text(df, {"t": "h"}).collect()}
    for i, (html, want) in enumerate(FRAGMENTS):
        assert got[i] == want, html
        assert html_to_text(html) == want, html


def test_sections_of_both_layouts(spark):
    modern = {"requirements": {"musts": [{"value": " Rust "}, {"name": "CAD"}, "  Weld", 4], "description": "<ul><li>Lift</li></ul>"},
              "details": {"description": "<p>Gym<br>Bus</p>"}}
    legacy = {"body": [{"sections": [{"title": "We OFFER", "values": ["x ", {"label": "y"}]},
                                     {"title": "Must have skills", "content": " m1\n\n m2"}]}]}
    df = spark.createDataFrame([(1, json.dumps(modern)), (2, json.dumps(legacy)), (3, "[]"), (4, "no")], "i int, body string")
    got = {r["i"]: r["s"] and r["s"].asDict() for r in with_sections(df, "body", "s").collect()}
    assert got == {
        1: {"must_have": ["Rust", "CAD", "Weld"], "requirements_description": "Lift", "offer_description": "Gym\nBus"},
        2: {"must_have": ["m1", "m2"], "requirements_description": None, "offer_description": "x; y"}, 3: None, 4: None}


def test_every_paying_posting_has_a_salary_row(spark):
    a = [({"salary": 5000}, [(None, 5000.0, None)]), ({"salary": "12k"}, [(None, None, None)]),
         ({"salaryRange": [1, 2]}, [(None, None, None)]), ({"salary": {"from": 1, "to": 2}}, [(None, 1.0, 2.0)]),
         ({"employmentTypes": [{"type": "b2b", "salaryRange": {"to": 9}}, {"type": "uop", "from": 3}]}, [("b2b", None, 9.0), ("uop", 3.0, None)])]
    b = [({"salary": 5000}, [(None, 5000.0, None)]), ({"salary_from": 1, "salary_to": 2, "salary": 3}, [(None, 1.0, 2.0)]),
         ({"employmentTypes": [{"type": "b2b", "from": 1, "to": True}]}, [("b2b", 1.0, 1.0)])]
    for source, cases in ((SOURCE_A, a), (SOURCE_B, b)):
        df = spark.createDataFrame([(i, json.dumps(p)) for i, (p, _) in enumerate(cases)], "i int, listing string")
        got = sorted((r["i"], r["employment_type"] or "", str(r["salary_from"]), str(r["salary_to"]))
                     for r in normalize_salaries(df, source, keep=("i",)).collect())
        assert got == sorted((i, t or "", str(x), str(y)) for i, (_, rows) in enumerate(cases) for t, x, y in rows)
