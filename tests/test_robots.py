"""Robots files: groups, specific rules, policies, what is known and what is not."""

import pytest
from pyspark.sql import functions as F

from siteglass.operators import robots
from siteglass.sources import files

ONE = """﻿Disallow: /nobody
User-agent: A # first
User-agent: b/2.0
Disallow: /x # no
Allow: /x/y
Content-Signal: search=yes
Crawl-delay: 3
User-agent: *
Disallow:
Disallow: /z
User-agent: a
disallow:/w
Content-signal: use=no, use = Maybe, odd
user-agent : c
"""


@pytest.fixture(scope="module")
def one(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("robots") / "robots.txt"
    path.write_text(ONE.replace("\n", "\r\n"))
    return files.robots_files(spark, str(path)).withColumn("state", F.lit("ok"))


def allowed(spark, rules, path, agent="bot"):
    value = "User-agent: *\n" + "\n".join(f"{'Allow' if ok else 'Disallow'}: {p}" for p, ok in rules)
    f = spark.createDataFrame([(1, value)], "file long, value string")
    return robots.access(f, spark.createDataFrame([(1, path, agent)], "file long, path string, agent string")).first()["allowed"]


def test_groups(one):
    got = robots.parsed(one).first()["found"]
    assert [(g["agents"], [tuple(r) for r in g["rules"]], g["signals"]) for g in got] == [
        ([], [("/nobody", False)], []),
        (["A", "b/2.0"], [("/x", False), ("/x/y", True)], ["search=yes"]),
        (["*"], [("", False), ("/z", False)], []),
        (["a"], [("/w", False)], ["use=no, use = Maybe, odd"]),
    ]


def test_an_agents_own_groups_decide_else_those_of_all(spark, one):
    file = one.first()["file"]
    asked = [("A", "/x"), ("A", "/x/y"), ("A", "/w"), ("A", "/z"), ("B/9", "/x"), ("B/9", "/w"), ("other", "/z1"), ("other", "/x"), ("other", None), ("other", ""), (None, "/z"), ("A", "/nobody")]
    got = {(r["agent"], r["path"]): r["allowed"] for r in robots.access(one, spark.createDataFrame([(file, p, a) for a, p in asked], "file string, path string, agent string")).collect()}
    assert {k for k, v in got.items() if not v} == {("A", "/x"), ("A", "/w"), ("B/9", "/x"), ("other", "/z1"), (None, "/z")}
    assert len(got) == len(asked)
    nofile = spark.createDataFrame([("none", "/z", "x"), (None, "/z", "x"), ("none", "/z", "x")], "file string, path string, agent string")
    assert [r["allowed"] for r in robots.access(one, nofile).collect()] == [True] * 3


@pytest.mark.parametrize(
    ("rules", "path", "want"),
    [
        ([("/a", False), ("/a/b", True)], "/a/x", False),
        ([("/a", False), ("/a/b", True)], "/a/b/x", True),
        ([("/c$", False)], "/c", False),
        ([("/c$", False)], "/cc", True),
        ([("/d", False), ("/d", True)], "/d", True),
        ([("/a***", False), ("/abc", True)], "/abcd", True),
        ([("/*.pdf$", False)], "/x/y.pdf", False),
        ([("/*.pdf$", False)], "/x/y.pdf?z", True),
        ([("*/deep", False)], "/very/deep", False),
        ([("/a.b", False)], "/aXb", True),
        ([("/(x)[y]{2}+|^", False)], "/(x)[y]{2}+|^", False),
        ([("/한글", False)], "/한글/1", False),
        ([("/a", False), ("/*b", True)], "/ab", True),
        ([("/p?q=", False)], "/p?q=1", False),
        ([("/line$", False)], "/line\n", True),
    ],
)
def test_the_most_specific_rule_decides(spark, rules, path, want):
    assert allowed(spark, rules, path) is want


@pytest.mark.parametrize(
    ("value", "agent", "want"),
    [
        ("", "GPTBot", "none"),
        (None, "GPTBot", "none"),
        ("User-agent: x\nDisallow: /", "GPTBot", "none"),
        ("User-agent: *\nDisallow: /", "GPTBot", "star-block"),
        ("User-agent: *\nDisallow: /*", "GPTBot", "star-block"),
        ("User-agent: *\nDisallow:", "GPTBot", "star-allow"),
        ("User-agent: gptbot/2\nAllow: /", "GPTBot", "explicit-allow"),
        ("User-agent: gptbot\nDisallow: /\nAllow: /ok", "GPTBot", "explicit-partial"),
        ("User-agent: gptbot\nDisallow: /x", "GPTBot", "explicit-partial"),
        ("User-agent: gptbot\nUser-agent: *\nDisallow: /x\nUser-agent: GPTBot\nDisallow: /", "GPTBot", "explicit-block"),
        ("User-agent: GPTBot", "GPTBot", "explicit-allow"),
    ],
)
def test_policies(spark, value, agent, want):
    f = spark.createDataFrame([(1, value, "ok")], "file long, value string, state string")
    assert robots.policies(f, (agent,)).first()["policy"] == want


def test_what_is_not_reached_is_unknown(spark):
    rows = [(1, 200, None, "User-agent: *\nDisallow: /"), (2, 503, None, None), (3, 301, None, ""), (4, 204, None, ""), (5, 200, "body_truncated", "User-agent: *"), (6, 200, "timeout", "User-agent: *"), (7, 200, None, " \n<?xml"), (8, None, "dns_fail", None), (9, 429, None, ""), (10, 410, None, "<html>"), (11, 199, None, "")]
    f = spark.createDataFrame(rows, "file long, status int, error string, value string")
    f = f.withColumn("state", robots.state(F.col("status"), F.col("error"), F.col("value")))
    got = {r["file"]: r["state"] for r in f.collect()}
    assert got == {1: "ok", 2: "unreachable", 3: "unreachable", 4: "ok", 5: "ok", 6: "unreachable", 7: "absent", 8: "unreachable", 9: "unreachable", 10: "absent", 11: "unreachable"}
    said = robots.policies(f)
    assert {r["file"] for r in robots.unknown(said).where("unknown").collect()} == {2, 3, 6, 8, 9, 11}
    codes = {(r["file"], r["code"]) for r in robots.policy_findings(said).collect()}
    assert (1, "AI_CRAWLER_BLOCKED") in codes and (7, "AI_CRAWLER_UNDECLARED") in codes and not {f for f, _ in codes} & {2, 3, 6, 8, 9, 11}
    assert {c for f, c in codes if f == 1} == {"AI_CRAWLER_BLOCKED", "AI_TRAINING_BLOCKED", "NAVER_CRAWLER_BLOCKED", "DAUM_CRAWLER_BLOCKED"}
    assert {c for f, c in codes if f == 10} == {"AI_CRAWLER_UNDECLARED", "DAUM_CRAWLER_UNDECLARED"}
    plan = {(r["file"], r["agent"]): r["add"] for r in robots.plan(f, ("GPTBot",)).collect()}
    assert plan[(1, "GPTBot")] is None and plan[(2, "GPTBot")] is None and plan[(4, "GPTBot")] == ["Allow: /"]


def test_plan_copies_partial_rules_of_all(spark):
    f = spark.createDataFrame([(1, "User-agent: *\nDisallow: /x\nAllow: /x/y\nDisallow:\nUser-agent: Bingbot\nDisallow: /b", "ok")], "file long, value string, state string")
    got = {r["agent"]: (r["policy"], r["add"]) for r in robots.plan(f, ("GPTBot", "Bingbot")).collect()}
    assert got == {"GPTBot": ("star-partial", ["Disallow: /x", "Allow: /x/y", "Disallow: "]), "Bingbot": ("explicit-partial", None)}


def test_agents_as_written_signals_and_managed_blocks(spark, one):
    assert [(r["value"], r["token"]) for r in robots.nonstandard(one).collect()] == [("b/2.0", "b")]
    got = [(r["place"], r["agents"], r["signals"]) for r in robots.content_signals(one).orderBy("place").collect()]
    assert got == [(1, ["A", "b/2.0"], {"search": "yes"}), (3, ["a"], {"use": "maybe"})]
    value = "User-agent: own\nDisallow: /\n  # BEGIN Cloudflare Managed content v2\nUser-agent: GPTBot/1\nUser-agent: *\nDisallow: /\nUser-agent: open\nAllow: /\n# END Cloudflare Managed Content\nUser-agent: later\nDisallow: /"
    f = spark.createDataFrame([(1, value), (2, value.replace("# END", "# end")), (3, value.replace("END", "FIN")), (4, "User-agent: x"), (5, None)], "file long, value string")
    assert {r["file"]: (r["blocked"], r["closed"]) for r in robots.managed(f).collect()} == {1: (["GPTBot"], True), 2: (["GPTBot"], True), 3: (["GPTBot", "later"], False)}


def test_paths_meet_rules_by_prefix_and_not_by_pairs(spark):
    f = spark.createDataFrame([(1, "User-agent: *\nDisallow: /x")], "file long, value string")
    paths = spark.createDataFrame([(1, "/x", "a")], "file long, path string, agent string")
    plan = robots.access(f, paths)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "Join Cross" not in plan
    none = spark.createDataFrame([], "file long, value string")
    assert robots.access(none, paths).first()["allowed"] is True
    assert robots.access(f, paths.where("false")).count() == 0
