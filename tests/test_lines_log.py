"""Texts read line by line, and logs that grow."""

import json

import pytest
from pyspark.sql import functions as F

from siteglass.functions import lines
from siteglass.operators import measure
from siteglass.sources.tables import observations
from siteglass.streaming import log

SF = "/root/testdata/sf0.001"


def test_fences_of_both_kinds():
    text = "a\n```py\nb\n~~~\n``\n``` x\n````\nc\n    ```\nd\n~~~~\n~~~\n~~~~~  \ne"
    assert [n for n, _ in lines.unfenced(text)] == [1, 8, 9, 10, 14]
    assert [x for _, x in lines.unfenced("a\n```\nb\n~~~\nc\n  ``` d\ne", strict=False)] == ["a", "c"]
    assert list(lines.unfenced(None)) == list(lines.unfenced("")) == []


def test_markdown():
    m = lines.markdown("---\nname: a-b\ndescription: 'x: y'\nname: c\nbad line\nempty:\n---\n# One #\n\n| a | b \\| c |\n|:---|---|\n| 1 | 2 |\n| 3 |\nnot | a row\n| d |\n| --- |\n\n| e |\n|--|\n![img](i.png) [l](<u v> ) [m](w \"t\") `[n](x)`\n   ###### Six\n#no\n    # code")
    assert [(f["key"], f["value"]) for f in m["front_matter"]] == [("name", "a-b"), ("description", "x: y"), ("name", "c"), ("empty", "")]
    assert m["problems"] == ["4 repeated name", "5 not_a_field", "6 empty empty"]
    assert [(t["line"], t["header"], t["rows"]) for t in m["tables"]] == [(10, ["a", "b \\| c"], [["1", "2"], ["3"]]), (15, ["d"], [])]
    assert [(h["line"], h["level"], h["text"]) for h in m["headings"]] == [(8, 1, "One"), (21, 6, "Six")]
    assert [x["target"] for x in m["links"]] == ["w"]
    assert lines.markdown(None)["problems"] == ["no_front_matter"] and lines.markdown("---\na: b")["problems"] == ["front_matter_not_closed"]


@pytest.mark.parametrize(
    ("text", "codes"),
    [
        ("# A\n> s\n## L\n- [t](https://e.org): d", []), ("﻿# A\n\n> s\n## L\n* [t]( HTTP://e.org )", []), (" <!DOCTYPE  html>", ["html_document"]), ("<htmlx>", ["h1_missing", "no_links"]), (None, ["empty"]), ("```\n# A\n```", ["empty"]),
        ("x\n# A\n> s\n## L\n- [t](https://e.org)", ["h1_not_first"]), ("# A\n## L\n- [t](https://e.org)", ["summary_missing"]), ("## L\n- [t](https://e.org)", ["h1_missing"]), ("# A\n> s\n- [t](https://e.org)", ["no_links"]), ("# A\n> s\n## L\n- [t](/x)\n- [t](mailto:a@b)", ["relative_links", "non_http_links"]),
        ("# A\n> s\n## L\n- [t](a b)\n- plain\n- [t](https://e.org) more", ["malformed_links", "no_links"]), ("# A\n> s\n## L\n# B\n- [t](https://e.org)", ["no_links"]), ("# A\n> s\n## L\n- [t](https://e.org)\n" + "x" * lines.LLMS_BYTES, ["too_large"]), ("#A\n", ["h1_missing", "no_links"]),
    ],
)
def test_notes_on_llms_files(text, codes):
    assert [n["code"] for n in lines.llms_notes(text)] == codes


def test_places_of_notes():
    notes = {n["code"]: n["lines"] for n in lines.llms_notes("intro\n\n# A\nnext\n## L\n- [a](x)\n- [b](y)\n- [c](ftp://z)")}
    assert notes == {"h1_not_first": [1], "summary_missing": [4], "relative_links": [6, 7], "non_http_links": [8]}


def test_questions_and_first_lines():
    text = "# Why?\n\n> - Because it is long enough.\n## How？ ##\nshort\nBut this is long enough too.\n### What?\n### When?\n작성 필요: this is not yet an answer\n#### Where ?\n\n## Who\nNobody asked this question here.\n# Last?"
    got = [(q["line"], q["heading"], q["candidate"]) for q in lines.question_answers(text)["questions"]]
    assert got == [(1, "Why?", True), (4, "How？", False), (7, "What?", False), (8, "When?", False), (10, "Where ?", False), (14, "Last?", False)]
    assert lines.question_answers(None) == {"questions": []}


def test_a_log_is_appended_to_with_nulls(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01", None)], "date string, note string")
    at = str(tmp_path / "log")
    log.append(rows.where("false"), at)
    assert not (tmp_path / "log").exists()
    log.append(rows, at)
    log.append(rows, at)
    said = [json.loads(x) for f in (tmp_path / "log").glob("part-*") for x in f.read_text().splitlines()]
    assert said == [{"date": "2024-01-01", "note": None}] * 2


def _shown(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


def test_batches_in_any_order_and_twice_are_the_whole(spark, tmp_path):
    rows = observations(spark, SF)
    at = f"file://{tmp_path}/state"
    parts = [rows.where(F.col("seq") % 4 == k) for k in range(4)]
    for number, k in enumerate((3, 1, 0, 2)):
        log.merge(parts[k], number, at)
    want = measure.last_write_wins(rows)
    assert _shown(log.state(spark, at)) == _shown(want)
    before = {p.name for p in (tmp_path / "state/rows").rglob("*.parquet")}
    log.merge(parts[2], 3, at)
    assert {p.name for p in (tmp_path / "state/rows").rglob("*.parquet")} == before
    # a batch that broke off before its mark is merged again, and changes nothing that is seen
    (tmp_path / "state/_merged/3").rmdir()
    log.merge(parts[2], 3, at)
    assert _shown(log.state(spark, at)) == _shown(want)
    # a batch rewrites its own dates only
    one = rows.where("date = '2024-01-05'").limit(1).withColumn("seq", F.lit(10**9).cast("long")).withColumn("outcome", F.lit("error"))
    others = {p: p.stat().st_mtime_ns for p in (tmp_path / "state/rows").rglob("*.parquet") if "2024-01-05" not in str(p)}
    log.merge(one, 9, at)
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "state/rows").rglob("*.parquet") if "2024-01-05" not in str(p)} == others
    assert log.state(spark, at).where("seq = 1000000000").count() == 1
    log.merge(rows.withColumn("date", F.lit(None).cast("date")), 10, at)
    assert _shown(measure.current(rows)) != [] and log.state(spark, at).count() == want.count()


def test_a_stream_of_upserts_that_starts_again(spark, tmp_path):
    rows = observations(spark, SF)
    here, at = str(tmp_path / "in"), f"file://{tmp_path}/state"

    def go():
        q = log.upserts(spark.readStream.schema(rows.schema).parquet(here), at).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None

    rows.where("seq >= 400").coalesce(1).write.mode("append").parquet(here)
    go()
    rows.where("seq < 600").coalesce(1).write.mode("append").parquet(here)
    go()
    assert _shown(measure.without_fulfilled(log.state(spark, at))) == _shown(measure.current(rows))
