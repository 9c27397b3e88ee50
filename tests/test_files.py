from pyspark.sql import functions as F

from siteglass.functions import parsing
from siteglass.sources import files


def value(spark, x, column):
    return spark.createDataFrame([(x,)], "x string").select(column.alias("y")).first().y


def test_parsers(spark):
    x = F.col("x")
    assert [str(value(spark, v, parsing.strict_date(x))) for v in ("2024-02-29", "2023-02-29", "2024-2-1")] == ["2024-02-29", "None", "None"]
    assert [value(spark, v, parsing.w3c_datetime(x)) for v in ("2024", "2024-13", "2024-02-30", "2024-02-28T10:00", "2024-02-28T10:00Z", "2024-02-28T10:00:01.5+09:00")] == [True, False, False, False, True, True]
    assert [value(spark, v, parsing.grouped_integer(x)) for v in ("1,234", "12,34", "7", "-1")] == [1234, None, 7, None]
    assert [value(spark, v, parsing.click_rate(x)) for v in ("2.5%", "0.025", "7", "x")] == [0.025, 0.025, None, None]
    assert [value(spark, v, parsing.rating(x)) for v in ("4.5/5", "90%", "4", "6/5", "x")] == [(4.5, 5.0), (90.0, 100.0), (4.0, None), None, None]
    assert [value(spark, v, parsing.price_visible(x, F.lit(1200))) for v in ("only 1,200 now", "1200.", "11200", "1,200,000", "1200.50")] == [True, True, False, False, False]
    assert [value(spark, v, parsing.bot_hit(x, "GPTBot")) for v in ("Mozilla (gptbot/1.0)", "notgptbot")] == [True, False]


def test_observation_log_keeps_malformed_lines_apart(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"date": "2024-01-01", "question_id": "q", "cited": true}\n{broken\n\n{"date": "2024-01-02", "cited_urls": ["a"]}\n')
    rows, broken = files.observation_log(spark, str(tmp_path))
    assert sorted(r.date for r in rows.collect()) == ["2024-01-01", "2024-01-02"] and broken.count() == 1


def test_search_export_in_two_languages(spark, tmp_path):
    (tmp_path / "en.csv").write_text('Top queries,Clicks,Impressions,CTR,Position\na,"1,000",4000,25%,1.5\nb,0,0,0%,\n')
    (tmp_path / "ko.csv").write_text("﻿날짜,클릭수,노출,클릭률,게재 순위\n2024-01-01,1,4,0.25,2\n", encoding="utf-8")
    assert [tuple(r) for r in files.search_export(spark, str(tmp_path / "en.csv")).collect()] == [("a", 1000, 4000, 0.25, 1.5), ("b", 0, 0, 0.0, None)]
    assert [tuple(r) for r in files.search_export(spark, str(tmp_path / "ko.csv")).collect()] == [("2024-01-01", 1, 4, 0.25, 2.0)]


def test_access_log(spark, tmp_path):
    (tmp_path / "access.log").write_text('1.2.3.4 - - [01/Jan/2024:00:00:00 +0000] "GET /a HTTP/1.1" 404 12 "-" "GPTBot/1.0"\nnoise\n')
    assert [tuple(r) for r in files.access_log(spark, str(tmp_path / "access.log")).collect()] == [("1.2.3.4", "GET", "/a", 404, "GPTBot/1.0")]
