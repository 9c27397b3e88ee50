"""Declared constraints, and forms with their line numbers."""

import pytest
from pyspark.sql import functions as F

from siteglass.operators import constraints as c
from siteglass.sources import forms

ENGINES = ("google", "naver")
HEAD = "date,query_id,query_text,type,engine,run_no,cited,brand_mentioned,cited_urls,competitor_domains,note,login_state,search_enabled,answer_complete,citation_coverage"
GOOD = {"date": "2024-05-01", "query_id": "q1", "engine": "Google", "run_no": "1", "cited": "Y"}


def line(**changes):
    r = GOOD | changes
    return ",".join('"' + r.get(name, "").replace('"', '""') + '"' for name in HEAD.split(","))


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([("q1", "What is it?", "nonbrand"), ("q2", "Who?", "brand")], "id string, text string, type string")


def measure(spark, asked, *lines, head=HEAD):
    f = spark.createDataFrame([("f.csv", "\n".join([head, *lines]))], "file string, content string")
    return {r["line"]: r for r in forms.measurements(forms.records(f), asked, ENGINES, "e.org").collect()}


CASES = [
    ({}, None), ({"date": "2024-02-30"}, "date"), ({"date": "2024-5-1"}, "date"), ({"query_id": "q9"}, "query_id"), ({"query_text": "What was it?"}, "query_text"), ({"query_text": " What is it? "}, None), ({"type": "brand"}, "type"), ({"type": "NONBRAND"}, None), ({"engine": "bing"}, "engine"),
    ({"run_no": "0"}, "run_no"), ({"run_no": "1.5"}, "run_no"), ({"run_no": ""}, "run_no"), ({"cited": ""}, "cited"), ({"cited": "perhaps"}, "cited"), ({"cited": "아니오"}, None), ({"login_state": "guest"}, "login_state"), ({"search_enabled": "?"}, "search_enabled"), ({"answer_complete": "?"}, "answer_complete"),
    ({"citation_coverage": "some"}, "citation_coverage"), ({"citation_coverage": "complete"}, None), ({"citation_coverage": "complete", "answer_complete": "N"}, "complete_without_answer"), ({"citation_coverage": "not_applicable"}, "cited_without_coverage"), ({"citation_coverage": "not_applicable", "cited": "N"}, None),
]


def test_the_first_problem_of_each_record(spark, asked):
    got = measure(spark, asked, *[line(**changes) for changes, _ in CASES])
    assert [got[k]["problem"] for k in range(2, 2 + len(CASES))] == [want for _, want in CASES]


def test_fields_of_a_measurement(spark, asked):
    got = measure(spark, asked, line(cited_urls="https://a.e.org/x; https://a.e.org/x, www.no, https://WWW.Rival.com/y", competitor_domains="other.net | e.org", note='with "quotes"\nand a line'), "", line(cited="N"), line())
    a, b, d = got[2], got[3], got[4]
    assert (a["cited_urls"], a["competitors"], a["note"]) == (["https://a.e.org/x", "https://www.rival.com/y"], ["other.net", "rival.com"], 'with "quotes"\nand a line [no URL: www.no]')
    assert (a["citation_coverage"], a["answer_complete"], a["login_state"], a["surface"]) == ("partial", True, "signed_out", "google")
    assert (b["cited"], b["citation_coverage"], b["answer_complete"]) == (False, "unknown", None) and d["note"] == "[cited URL not noted]"


def test_files_from_disk(spark, asked, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿date,query_id,engine,run_no,cited,note\r\n2024-05-01,q1,naver,1,Y,first\r\n\r\n2024-05-01,q1,naver,1,N,last,too,many\r\nshort\r\n".encode())
    (tmp_path / "b.csv").write_bytes(b"date\xff\xfe")
    (tmp_path / "c.csv").write_bytes(b"")
    good, bad = forms.imported(forms.measurements(forms.read(spark, str(tmp_path)), asked, ENGINES, "e.org"))
    assert [(r["line"], r["cited"], r["note"]) for r in good.collect()] == [(3, False, "last")]
    assert sorted((r["file"].rpartition("/")[2], r["line"], r["problem"]) for r in bad.collect()) == [("a.csv", 4, "date"), ("b.csv", 0, "unreadable")]


def test_constraints_of_three_kinds(spark):
    rows = spark.createDataFrame([(1, "a", 5, "x"), (2, "a", -1, "y"), (3, "b", None, "z"), (4, None, 1, None), (5, None, 1, "x")], "n long, k string, v int, r string")
    to = spark.createDataFrame([("x",), ("y",), ("y",), (None,)], "id string")
    rules = [c.Holds("negative", F.col("v") >= 0), c.Unique("repeated", ("k",)), c.Refers("unknown", ("r",), to, ("id",))]
    got = {r["n"]: r["problems"] for r in c.checked(rows, rules).collect()}
    assert got == {1: ["repeated"], 2: ["negative", "repeated"], 3: ["negative", "unknown"], 4: [], 5: []}
    assert c.violations(rows, ["n"], rules).count() == 5
    with pytest.raises(ValueError, match="5 violations: n 1: repeated; n 2: negative"):
        c.enforced(rows, ["n"], rules)
    assert c.enforced(rows.where("n in (4, 5)"), ["n"], rules).count() == 2
    assert c.violations(rows.where("false"), ["n"], rules).count() == 0
    both = c.Unique("pair", ("k", "r")), c.Refers("no_pair", ("k", "r"), rows.where("n = 1"), ("k", "r"))
    assert {r["n"]: r["problems"] for r in c.checked(rows.unionByName(rows.where("n = 1")), list(both)).collect()} == {1: ["pair"], 2: ["no_pair"], 3: ["no_pair"], 4: [], 5: []}


def test_claims_and_facts(spark):
    pages = spark.createDataFrame([("p",)], "id string")
    claims = [("p", "t", None, None, None, None), ("q", "t", "", None, None, None), ("p", " ", "http://10.0.0.1/", None, None, None), ("p", "t" * 2001, "https://e.org/", "q" * 2001, "s" * 30_001, "d" * 41)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(claims)], "n int, page_id string, text string, source_url string, quote string, source_text string, source_date string")
    assert {r["n"]: r["problems"] for r in c.checked(df, c.review_claims(pages)).collect()} == {0: [], 1: ["unknown_page"], 2: ["bad_text", "private_source"], 3: ["bad_text", "bad_quote", "bad_source_text", "bad_source_date"]}
    intents = spark.createDataFrame([("i",)], "intent_id string")
    facts = spark.createDataFrame([(0, "f", "t", "https://e.org/", True, "i"), (1, "f", "t", "https://e.org/", False, None), (2, "g", "", "http://localhost/", None, "j"), (3, "h", "t", "https://e.org/", True, "i"), (4, "h", "t", "https://e.org/", True, "i")], "n int, id string, text string, source_url string, verified boolean, intent_id string")
    assert {r["n"]: r["problems"] for r in c.checked(facts, c.brief_facts(intents)).collect()} == {0: [], 1: [], 2: ["no_text", "private_source", "no_verdict", "unknown_intent"], 3: ["repeated_id"], 4: ["repeated_id"]}
