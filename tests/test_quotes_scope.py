"""Quotes in texts by rare grams, entries and product evidence, intents and their pages."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from siteglass.operators import quotes, scope
from siteglass.plans import scope as queries

SF = "/root/testdata/sf0.001"


def found(spark, wanted, texts):
    q = spark.createDataFrame(list(enumerate(wanted)), "quote_id int, quote string")
    t = spark.createDataFrame(list(enumerate(texts)), "source_id long, text string")
    return sorted(tuple(r) for r in quotes.containing(q, t.repartition(3)).collect())


def plain(wanted, texts):
    return sorted((i, j, t.index(q) + 1) for i, q in enumerate(wanted) if q for j, t in enumerate(texts) if t is not None and q in t)


@pytest.mark.parametrize("seed", [1, 2])
def test_containing_agrees_with_plain_search(spark, seed):
    r = random.Random(seed)
    letters = "ab é文\n"
    texts = ["".join(r.choice(letters) for _ in range(r.choice((0, 3, 40, 400)))) for _ in range(60)] + [None, "", "x" * 5000 + "needle" + "x" * 5000]
    wanted = [t[a : a + n] for t in texts if t for a in (0, len(t) // 2) for n in (1, 2, 5, 6, 11, 13, 40)] + ["needle", "nothing like it", "", None, "\U0001f600", "needle"]
    assert found(spark, wanted, texts) == plain(wanted, texts)
    assert found(spark, [], texts) == [] == found(spark, ["a"], [])


def test_a_quote_meets_only_texts_that_share_its_rarest_gram(spark):
    texts = spark.range(2000).select(F.col("id").alias("source_id"), F.concat(F.lit("the same long beginning of all texts, "), F.col("id").cast("string")).alias("text"))
    q = spark.createDataFrame([(1, "beginning of all texts, 1234")], "quote_id int, quote string")
    got = quotes.containing(q, texts)
    assert [r["source_id"] for r in got.collect()] == [1234]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "Join Cross" not in plan
    # the bitmap lets the 2,000 texts' common grams through, but the join is by the one gram that few have
    grams = {len(quotes._grams(b"abcdefghijklmnop", w)) for w in quotes.WIDTHS}
    assert grams == {5, 11, 14, 16}


def test_entries_quote_their_source(spark):
    sources = spark.createDataFrame([("s", "Some text here"), ("t", None), ("u", "x" * 2000)], "source_id string, text string")
    in_scope = spark.createDataFrame([("s", "i"), ("t", "i"), ("u", "i"), ("s", "i")], "source_id string, intent string")
    cases = [("i", "s", "text", None), ("j", "s", "text", "scope"), ("i", "t", "text", "source"), ("i", "z", "text", "source"), (None, "s", "text", "scope"), ("i", "s", " ", "blank"), ("i", "s", None, "blank"), ("i", "s", "Text", "not_quoted"), ("i", "u", "x" * 1001, "long"), ("i", "u", "x" * 1000, None)]
    e = spark.createDataFrame([(k, *c[:3]) for k, c in enumerate(cases)], "entry_id int, intent string, source_id string, quote string")
    got = {r["entry_id"]: r["problem"] for r in quotes.valid_entries(e, sources, in_scope).collect()}
    assert [got[k] for k in range(len(cases))] == [c[3] for c in cases]


def test_product_evidence(spark):
    snap = spark.createDataFrame([("a", "﻿Strong and light"), ("b", None)], "snapshot string, text string")
    good = ("product", "active", True, "https://E.com:443/p", "2024-05-01", "a", ["Strong", "light"])
    change = lambda **k: tuple(k.get(n, v) for n, v in zip(("kind", "status", "verified", "url", "date", "snap", "quotes"), good, strict=True))
    cases = [(good, None), (change(kind="service"), "not_active"), (change(status=None), "not_active"), (change(verified=None), "not_verified"), (change(url="https://www.e.com/"), "not_official"), (change(url="ftp://e.com"), "not_official"), (change(url=None), "not_official"), (change(date="2024-02-30"), "no_date"), (change(date="2024-5-1"), "no_date"), (change(date="2025-01-02"), "future_date"), (change(snap="b"), "no_snapshot"), (change(snap=None), "no_snapshot"), (change(quotes=["Strong", " "]), "no_quotes"), (change(quotes=None), "no_quotes"), (change(quotes=[]), "no_quotes"), (change(quotes=["strong"]), "not_quoted")]
    p = spark.createDataFrame([(k, *c) for k, (c, _) in enumerate(cases)], "product_id int, kind string, status string, verified boolean, source_url string, checked_at string, snapshot string, quotes array<string>")
    got = {r["product_id"]: r for r in quotes.product_evidence(p, snap, "https://e.com", "2025-01-01").collect()}
    assert [got[k]["problem"] for k in range(len(cases))] == [want for _, want in cases]
    assert got[0]["snapshot_sha256"] and not got[1]["snapshot_sha256"]


def test_grams_of_many_texts_at_once_are_those_of_each():
    """A text's grams do not depend on what stands before it."""
    import numpy as np
    import pyarrow as pa

    texts = [b"", b"a", b"ab", b"abc" * 9, b"", b"xabcdefghijklmnop"]
    (first, data, off), = quotes._slices(pa.array(texts))
    whole = quotes._all_grams(data)
    assert first == 0
    for k, t in enumerate(texts):
        own = quotes._all_grams(np.frombuffer(t, np.uint8))
        for width in quotes.WIDTHS:
            assert len(own[width]) == max(0, len(t) - width + 1)
            assert (own[width] == whole[width][off[k] : off[k] + len(own[width])]).all()


def test_terms_are_without_case_and_of_two_characters(spark):
    pages = spark.createDataFrame([(1, "Red STRASSE", None), (2, None, "straße"), (3, "a b", ""), (4, None, None)], "source_id long, title string, h1 string")
    terms = spark.createDataFrame([("i", "Straße"), ("j", "strasse"), ("k", "a"), ("l", " a "), ("m", "d s"), ("n", None), ("i", "red")], "intent string, term string")
    assert {tuple(r) for r in scope.term_hits(pages, terms).collect()} == {(1, "i"), (1, "j"), (2, "i"), (2, "j"), (1, "m")}


def test_actions(spark):
    intents = spark.createDataFrame([("named", 1, 1), ("term", 1, 1), ("both", 1, 1), ("none", 1, 1), ("blank", 0, 1), ("types", 1, 2), ("shared", 1, 1), ("shared2", 1, 1)], "intent string, n_terms int, page_types int")
    explicit = spark.createDataFrame([("named", "https://e.com/N/"), ("both", "https://e.com/b"), ("both", "https://e.com/b"), ("types", "https://e.com/t"), ("shared", "https://e.com/s"), ("shared2", "https://E.com/S/")], "intent string, url string")
    hits = spark.createDataFrame([("term", "https://e.com/x"), ("both", "https://e.com/y")], "intent string, url string")
    got = {r["intent"]: (r["action"], r["reason"], r["candidates"]) for r in scope.actions(intents, explicit, hits, True).collect()}
    assert got == {"named": ("update", "named_page", 1), "term": ("review", "term_candidate", 1), "both": ("review", "overlap", 2), "none": ("create", "none_in_complete_crawl", 0), "blank": ("review", "nothing_to_look_for", 0), "types": ("review", "overlap", 1), "shared": ("review", "overlap", 1), "shared2": ("review", "overlap", 1)}
    assert {r["reason"] for r in scope.actions(intents.where("intent = 'none'"), explicit, hits, False).collect()} == {"crawl_incomplete"}


def test_the_queries_say_something(spark):
    for f, column, values in ((queries.j22_intent_scope, "ways", 3), (queries.j23_page_actions, "action", 2), (queries.j24_comparisons, "role", 4), (queries.s28_product_evidence, "problem", 6), (queries.j27_entries, "problem", 3)):
        assert f(spark, SF).select(column).distinct().count() >= values, f.__name__
    assert queries.j27_quotes_in_texts(spark, SF).count() > 50


def test_the_queries_take_case_as_their_sql_does(spark, tmp_path):
    html = lambda title: f"<title>{title}</title><h1>x</h1>"
    titles = ["loweiß einpfß", "LOWEISS", "ΟΔΟΣ und Straße", "οδοσ", "die STRASSE WEIß", "İstan", "istan", "\u00a0x"]
    urls = [f"https://{'www.example.org' if i % 2 else 'shop.example.net'}/weiß/{i}" for i in range(len(titles))]
    spark.createDataFrame([(i, u, html(t)) for i, (u, t) in enumerate(zip(urls, titles, strict=True))], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    passages = ["Ist loweiss a und straße", "ΑΣ ss b die strasse", "Σ οδοσ c weiß weiß", "İ İSTAN d strasse weiß", "nbsp \u00a0x e x y", "ΑΣ einpfß f ΟΔΟΣ und"]
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("pages", "benchmark"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("j22_intent_scope", "j23_page_actions", "j24_comparisons"):
        got, want = queries.QUERIES[name](spark, str(tmp_path)), con.sql(queries.ORACLES[name])
        assert sorted(repr(r) for r in want.fetchall()) == sorted(repr(tuple(r)) for r in got.select(want.columns).collect()), name
