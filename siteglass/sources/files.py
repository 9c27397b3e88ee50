"""Readers and writers of the formats that observations, search exports, sitemaps and access logs come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing

OBSERVATION = "schema string, campaign_id string, model string, session_id string, date string, question_id string, engine string, run_no int, planned_runs int, mode string, locale string, surface string, login string, search_enabled boolean, fingerprint string, reservation boolean, outcome string, answer_complete boolean, coverage string, cited boolean, mentioned boolean, organic boolean, cited_urls array<string>, note string"
# fixed values: the labels of a search export's columns, in English and Korean
EXPORT_COLUMNS = {
    "query": ("top queries", "query", "queries", "인기 검색어", "검색어", "쿼리", "인기 쿼리"),
    "page": ("top pages", "page", "pages", "인기 페이지", "페이지"),
    "date": ("date", "dates", "날짜"),
    "country": ("country", "countries", "국가"),
    "device": ("device", "devices", "기기"),
    "clicks": ("clicks", "클릭수", "클릭 수", "클릭"),
    "impressions": ("impressions", "노출수", "노출 수", "노출"),
    "ctr": ("ctr", "클릭률"),
    "position": ("position", "average position", "avg. position", "게재순위", "게재 순위", "평균 게재순위", "평균 게재 순위", "순위"),
}
DIMENSIONS = ("query", "page", "date", "country", "device")
# fixed values: states of a run
OUTCOMES = ("observed", "error", "unmeasured", "partial", "blocked")
ACCESS_LINE = r'^(\S+) \S+ \S+ \[([^\]]*)\] "(\S+) (\S+)[^"]*" (\d{3}) (\S+)(?: "([^"]*)" "([^"]*)")?'


def observation_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed lines) of an append-only JSONL log."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", f"{OBSERVATION}, broken string", {"columnNameOfCorruptRecord": "broken"}).alias("x"))
    return parsed.where("x.broken is null").select("x.*").drop("broken"), parsed.where("x.broken is not null").select("x.broken")


def gated(rows: DataFrame, engines: list[str], schemas: list[str]) -> DataFrame:
    """Rows of a log that count: with a date, of a known engine, and of a known schema and outcome where they name one."""
    schema = F.col("schema").isNull() | F.col("schema").isin(*schemas)
    return rows.where((F.coalesce("date", F.lit("")) != "") & F.col("engine").isin(*engines) & schema & (F.col("outcome").isNull() | F.col("outcome").isin(*OUTCOMES)))


def export_columns(names: list[str]) -> dict[str, str]:
    """The export's column for each name: one dimension and the four metrics, none twice and none unknown; else an error says what is wrong."""
    plain = lambda x: "".join(x.replace("\ufeff", "").split()).casefold()
    known = {plain(label): name for name, labels in EXPORT_COLUMNS.items() for label in labels}
    named: dict[str, str] = {}
    for c in names:
        name = known.get(plain(c))
        if name is None or name in named:
            raise ValueError(f"column {'not known' if name is None else 'repeated'}: {c}")
        named[name] = c
    dimensions = [d for d in DIMENSIONS if d in named]
    missing = [m for m in EXPORT_COLUMNS if m not in DIMENSIONS and m not in named]
    if len(dimensions) != 1 or missing:
        raise ValueError(f"columns not found: {', '.join(missing) or 'one dimension'}" if len(dimensions) < 2 else f"more than one dimension: {', '.join(dimensions)}")
    return {"key": named[dimensions[0]], **{m: named[m] for m in ("clicks", "impressions", "ctr", "position")}}


def search_export(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(key, clicks, impressions, ctr, position) of a CSV export with English or Korean labels, with or without a byte order mark.

    A cell that is not what its column says fails the whole export where strict; an empty position is null for what was never shown.
    """
    raw = spark.read.option("header", True).option("escape", '"').option("mode", "FAILFAST").csv(path)
    col = {name: F.col(f"`{c}`") for name, c in export_columns(raw.columns).items()}
    parsed = {"clicks": parsing.grouped_integer(col["clicks"]), "impressions": parsing.grouped_integer(col["impressions"]), "ctr": parsing.click_rate(col["ctr"]), "position": parsing.position(col["position"])}
    shown = F.coalesce(parsed["impressions"], F.lit(1)) > 0
    bad = parsed["clicks"].isNull() | parsed["impressions"].isNull() | parsed["ctr"].isNull() | (parsed["position"].isNull() & (shown | (F.coalesce(F.trim(col["position"]), F.lit("")) != "")))
    fail = F.raise_error(F.concat(F.lit("not a row of a search export: "), F.to_json(F.struct("*"))))
    key = F.trim(col["key"])
    return raw.select((F.when(bad, fail).otherwise(key) if strict else key).alias("key"), *[v.alias(k) for k, v in parsed.items()])


def sitemap(spark: SparkSession, path: str) -> DataFrame:
    """(loc, lastmod) of sitemap files, by Spark's XML reader."""
    return spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path)


def access_log(spark: SparkSession, path: str) -> DataFrame:
    """(host, method, path, status, agent) of a web server's combined log; other lines are dropped."""
    part = lambda k: F.regexp_extract("value", ACCESS_LINE, k)
    return spark.read.text(path).where(F.regexp_like("value", F.lit(ACCESS_LINE))).select(part(1).alias("host"), part(3).alias("method"), part(4).alias("path"), part(5).cast("int").alias("status"), part(8).alias("agent"))


def robots_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, value) of robots files, each whole: they are small by protocol."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")


def append_snapshot(df: DataFrame, path: str, date: str, kind: str) -> None:
    """Add a dated snapshot; an existing one of the same date and kind is an error, as snapshots never change."""
    df.write.mode("errorifexists").parquet(f"{path}/date={date}/kind={kind}")
