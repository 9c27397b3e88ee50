"""Queries over JSON-LD, made of rows of the driver's tables, and the SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import jsonld
from ..sources.tables import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _products(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """Every part as a product: its price, a rating whose scale or count is wrong for some, and an organization that sells it."""
    k = F.col("p_partkey")
    price = F.concat((F.col("p_size") + F.when(k % 7 == 0, shift).otherwise(0)).cast("string"), F.lit(".50" if not shift else ".5"))
    rating = F.concat(F.lit('{"@type": "AggregateRating", "ratingValue": "'), (k % 7).cast("string"), F.lit('", "ratingCount": '), F.when(k % 11 == 0, "-1").otherwise("3"), F.lit("}"))
    seller = F.concat(F.lit('{"@type": "Organization", "@id": "https://Example.org#'), (k % 2).cast("string"), F.lit('", "name": "Shop"}'))
    block = F.concat(F.lit('{"@type": "Product", "name": "  '), "p_name", F.lit('", "offers": [{"@type": "Offer", "price": "'), price, F.lit('"}], "aggregateRating": '), rating, F.lit(', "seller": '), seller, F.lit("}"))
    return jsonld.leaves(table(spark, sf_dir, "part").select("p_partkey", block.alias("block")), "p_partkey", "block")


@query("SELECT event_id AS id, '/k' AS pointer, json_extract_string(props, '$.k') AS value FROM events")
def j2n2_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonld.leaves(table(spark, sf_dir, "events"), "event_id", "props").select("id", "pointer", "value")


@query("SELECT unnest(['Product', 'Offer', 'AggregateRating', 'Organization']) AS type, count(*) AS blocks FROM part")
def j2n1_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonld.type_counts(_products(spark, sf_dir))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN '/offers/0/price' ELSE '/offers/00/price' END AS pointer, CASE WHEN p_partkey % 2 = 0 THEN p_size || '.50' END AS value FROM part")
def j2n3_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    pointers = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, "/offers/0/price").otherwise("/offers/00/price").alias("pointer"))
    return jsonld.resolved(_products(spark, sf_dir), pointers).select("id", "pointer", "value")


@query("""SELECT p_partkey AS id, '/aggregateRating' AS parent, unnest(list_filter([CASE WHEN p_partkey % 7 IN (0, 6) THEN 'rating_outside' END, CASE WHEN p_partkey % 11 = 0 THEN 'ratingCount_invalid' END], lambda x: x IS NOT NULL)) AS issue FROM part""")
def a30_rating_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonld.rating_issues(_products(spark, sf_dir))


@query("SELECT count(*) AS blocks, count(DISTINCT p_partkey % 2) AS ids FROM part")
def a31_organization_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonld.organization_ids(_products(spark, sf_dir))


@query("""SELECT p_partkey AS a_id, CASE WHEN p_partkey % 7 = 0 AND (p_partkey + 1) IN (SELECT p_partkey FROM part) AND false THEN p_partkey + 1 ELSE p_partkey END AS b_id, (p_partkey % 7 = 0)::BIGINT * 2 AS differences FROM part""")
def j13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each product against itself with a price in another notation (another price for every seventh) and against the next part."""
    ids = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("a_id"))
    pairs = ids.select("a_id", F.explode(F.array("a_id", F.col("a_id") + 1)).alias("b_id"))
    return jsonld.nearest_objects(_products(spark, sf_dir), _products(spark, sf_dir, 100), pairs)


ORACLES["j13_nearest"] = "SELECT p_partkey AS a_id, p_partkey AS b_id, (p_partkey % 7 = 0)::BIGINT AS differences FROM part"


@query("SELECT p_name AS name, count(*) AS blocks FROM part WHERE true GROUP BY p_name, p_size")
def j2n6_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of one name and price are one thing, whatever their ratings."""
    who = jsonld.identities(_products(spark, sf_dir)).withColumnRenamed("id", "p_partkey")
    return who.join(table(spark, sf_dir, "part").hint("merge"), "p_partkey").groupBy("identity").agg(F.min("p_name").alias("name"), F.count("*").alias("blocks")).select("name", "blocks")


@query("SELECT p_partkey AS id, '/offers/0/price' AS pointer, p_partkey % 2 = 0 AS visible FROM part")
def z04_visible_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("costs "), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("p_size").cast("string"), F.lit(".50"))).otherwise("nothing")).alias("text"))
    return jsonld.visible_claims(_products(spark, sf_dir).where("key = 'price'"), texts).select("id", "pointer", "visible")
