from pyspark.sql import functions as F

from siteglass.functions import text, urls
from siteglass.operators import measure


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first().y


def test_urls(spark):
    x = F.col("x")
    assert one(spark, "HTTPS://WWW.Example.org:8080?q=1#f", urls.normalize(x)) == "https://www.example.org:8080/?q=1"
    assert one(spark, "www.example.org", urls.domain(x)) == "example.org"
    assert one(spark, "notexample.org", urls.owned(x, F.lit("example.org"))) is False
    assert one(spark, "a.example.org", urls.owned(x, F.lit("example.org"))) is True
    assert one(spark, "http://a/b/c.PNG", urls.is_page(x)) is False
    assert one(spark, "http://a/b/", urls.link_key(x)) == "a/b"


def test_text(spark):
    x = F.col("x")
    assert one(spark, " a, b;a |c", text.multi(x)) == ["a", "b", "c"]
    assert one(spark, "maybe", text.yes_no(x)) is None
    assert one(spark, "한국어 title", text.script(x)) == "ko"
    assert one(spark, "NoIndex, follow,noindex", text.directives(x)) == ["follow", "noindex"]
    assert one(spark, "Bot/2.1 (x)", text.agent_token(x)) == "bot"


def test_unknown_is_not_zero(spark):
    schema = "engine string, outcome string, answer_complete boolean, coverage string, cited boolean, mentioned boolean, organic boolean"
    rows = [("a", "error", None, None, None, None, None), ("a", "observed", True, "partial", False, None, None), ("b", "observed", True, "partial", True, True, None)]
    got = {r.engine: r for r in measure.rates(spark.createDataFrame(rows, schema), ["engine"]).collect()}
    assert got["a"].citation_known == 0 and got["a"].citation_rate is None and got["a"].mention_rate is None
    assert got["b"].citation_known == 1 and got["b"].citation_rate == 1.0 and got["b"].organic_rate is None


def test_last_write_wins_stream(spark, tmp_path):
    from siteglass.streaming.log import latest

    schema = "k string, seq long, v string"
    spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("b", 2, "y")], schema).write.parquet(str(tmp_path / "log"))
    stream = latest(spark.readStream.schema(schema).parquet(str(tmp_path / "log")), ["k"], "seq")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("latest_log").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.k, r.v) for r in spark.table("latest_log").collect()} == {("a", "z"), ("b", "y")}


def test_arrow_functions(spark):
    from siteglass.functions import arrow

    cases = {
        arrow.folded: [("Ｓtraße   ﬁ", "strasse fi"), (None, None)],
        arrow.address_class: [("8.8.8.8", "public"), ("10.0.0.1", "private"), ("::1", "loopback"), ("::ffff:127.0.0.1", "loopback"), ("169.254.1.1", "link_local"), ("0.0.0.0", "unspecified"), ("host", None)],
        arrow.public_url: [("https://example.org/a", True), ("http://8.8.8.8/", True), ("http://10.0.0.1/", False), ("http://u@example.org/", False), ("http://example.org/#x", False), ("ftp://example.org", False), ("http://localhost/", False), ("http://a.local/", False), ("http://one/", False), ("http://bücher.de/", True), (None, False)],
        arrow.discovery_key: [("HTTP://Bücher.de:80/a?b#c", "http://xn--bcher-kva.de/a?b"), ("https://h.org:444", "https://h.org:444/"), ("/a", None)],
    }
    for f, rows in cases.items():
        df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(rows)], "i int, x string")
        got = [r.y for r in df.select("i", f("x").alias("y")).orderBy("i").collect()]
        assert got == [y for _, y in rows]
