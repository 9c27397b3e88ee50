"""JSON-LD as a table of leaves: one small walk for each block, and everything else as joins and aggregates over the leaves.

A leaf has id, pointer (RFC 6901), parent, key, value (text), kind (string, number, boolean, null) and types, those of the
object that holds it, sorted. A block that is no JSON gives no leaves.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parsing, text, urls

# fixed values: keys whose values are addresses, names that keep their zeros, and numbers
URL_KEYS = ("@id", "url", "item", "logo", "image", "sameAs", "contentUrl", "thumbnailUrl", "embedUrl", "mainEntityOfPage")
ID_KEYS = ("sku", "mpn", "gtin", "gtin8", "gtin12", "gtin13", "gtin14", "isbn", "productID", "identifier", "telephone", "faxNumber", "postalCode", "vatID", "taxID", "duns", "leiCode")
NUMERIC_KEYS = ("price", "lowPrice", "highPrice", "minPrice", "maxPrice", "ratingValue", "bestRating", "worstRating", "ratingCount", "reviewCount", "minValue", "maxValue")
NUMERIC_HOLDERS = ("QuantitativeValue", "MonetaryAmount")
RATINGS = ("AggregateRating", "Rating")
LEAF = "id long, pointer string, parent string, key string, value string, kind string, types array<string>"
#: What says which thing an object of a type is, by its leaves' pointers.
IDENTITY = {
    "FAQPage": r"^/mainEntity/\d+/(name|acceptedAnswer/text)$",
    "Product": r"^/(name|url|offers(/\d+)?/(price|priceCurrency|url))$",
    "Organization": r"^/(@id|name|url)$",
    "WebSite": r"^/(name|url)$",
    "BreadcrumbList": r"^/itemListElement/\d+/(position|name|item)$",
}


def _walk(node: object, pointer: str, parent: str, key: str, types: list[str]) -> Iterator[tuple]:
    stack = [(node, pointer, parent, key, types)]
    while stack:
        node, pointer, parent, key, types = stack.pop()
        if isinstance(node, dict):
            own = node.get("@type", [])
            own = sorted(x for x in (own if isinstance(own, list) else [own]) if isinstance(x, str))
            stack += [(v, f"{pointer}/{k.replace('~', '~0').replace('/', '~1')}", pointer, k, own) for k, v in reversed(node.items())]
        elif isinstance(node, list):
            stack += [(v, f"{pointer}/{i}", parent, key, types) for i, v in reversed(list(enumerate(node)))]
        else:
            kind = "null" if node is None else "boolean" if isinstance(node, bool) else "string" if isinstance(node, str) else "number"
            yield pointer, parent, key, node if kind == "string" else json.dumps(node), kind, types


def leaves(blocks: DataFrame, id: str, column: str) -> DataFrame:
    """The leaves of JSON blocks (id, column). There are many for each block, which Spark cannot know, so joins with them are merged and never broadcast."""
    names = [f.split()[0] for f in LEAF.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for number, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    root = json.loads(block or "")
                except (ValueError, RecursionError):
                    continue
                rows += [(number, *x) for x in _walk(root, "", "", "", [])]
            if rows:
                kinds = (pa.int64(), *[pa.string()] * 5, pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return blocks.select(F.col(id).cast("long").alias("id"), F.col(column).cast("string").alias("block")).mapInArrow(work, LEAF).hint("merge")


def type_counts(found: DataFrame) -> DataFrame:
    """(type, blocks) of types at any depth."""
    return found.where("key = '@type'").select("id", F.col("value").alias("type")).distinct().groupBy("type").agg(F.count("*").alias("blocks"))


def resolved(found: DataFrame, pointers: DataFrame) -> DataFrame:
    """pointers (id, pointer) with value: the leaf there, or null. Array places are plain numbers, without zeros in front."""
    return pointers.join(found.select("id", "pointer", "value"), ["id", "pointer"], "left")


def same_value(a: Column, b: Column, key: Column, types: Column, kind_a: Column, kind_b: Column) -> Column:
    """Whether two leaves say the same, whatever their notation: addresses by identifier, numbers by amount, names of things to the letter, booleans and nulls strictly, all else without regard to white space."""
    number = (key.isin(*NUMERIC_KEYS) | ((key == "value") & F.arrays_overlap(types, F.array(*map(F.lit, NUMERIC_HOLDERS))))) & ~key.isin(*ID_KEYS)
    zeros = F.regexp_like(a, F.lit(r"^\s*[+-]?0\d")) | F.regexp_like(b, F.lit(r"^\s*[+-]?0\d"))
    x, y = parsing.exact_decimal(a), parsing.exact_decimal(b)
    strict = kind_a.isin("boolean", "null") | kind_b.isin("boolean", "null")
    plain = text.squeezed(a) == text.squeezed(b)
    return F.when(strict, (kind_a == kind_b) & (a == b)).when(key.isin(*URL_KEYS), urls.identifier(F.trim(a)) == urls.identifier(F.trim(b))).when(number & ~zeros & x.isNotNull() & y.isNotNull(), x == y).otherwise(plain)


def identities(found: DataFrame) -> DataFrame:
    """(id, type, identity) of blocks: a digest of what says which thing a block of its first type is; of all its leaves for other types."""
    root = found.where("parent = '' and key = '@type'").groupBy("id").agg(F.min_by("value", "pointer").alias("type"))
    part = F.lit(False)
    for name, shape in IDENTITY.items():
        part = part | ((F.col("type") == name) & F.regexp_like("pointer", F.lit(shape)))
    known = F.col("type").isin(*IDENTITY)
    value = F.when(F.col("key").isin(*URL_KEYS), urls.identifier(F.trim(F.col("value")))).otherwise(text.squeezed(F.col("value")))
    # questions and offers are the same in any order
    place = F.when(F.col("type").isin("FAQPage", "Product"), F.regexp_replace("pointer", r"/\d+/", "/*/")).otherwise(F.col("pointer"))
    each = found.join(root, "id").where(part | ~known).select("id", "type", F.concat_ws("=", place, value).alias("line"))
    return each.groupBy("id", "type").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("identity"))


def nearest_objects(a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each block of a, of the blocks of b that pairs (a_id, b_id) allow the one with the fewest different leaves, ties to the smaller id: (a_id, b_id, differences)."""
    left = a.select(F.col("id").alias("a_id"), "pointer", "key", "types", F.col("value").alias("va"), F.col("kind").alias("ka"))
    right = b.select(F.col("id").alias("b_id"), "pointer", F.col("value").alias("vb"), F.col("kind").alias("kb"))
    size_a, size_b = left.groupBy("a_id").agg(F.count("*").alias("na")), right.groupBy("b_id").agg(F.count("*").alias("nb"))
    same = left.join(pairs, "a_id").join(right, ["b_id", "pointer"])
    same = same.groupBy("a_id", "b_id").agg(F.count("*").alias("shared"), F.count_if(same_value(F.col("va"), F.col("vb"), F.col("key"), F.col("types"), F.col("ka"), F.col("kb"))).alias("equal"))
    each = pairs.join(size_a, "a_id").join(size_b, "b_id").join(same, ["a_id", "b_id"], "left").fillna(0, ["shared", "equal"])
    # a leaf of one side only is a difference, and so is one of both that differs
    each = each.withColumn("differences", F.col("na") + F.col("nb") - F.col("shared") - F.col("equal"))
    best = each.groupBy("a_id").agg(F.min(F.struct("differences", "b_id")).alias("m"))
    return best.select("a_id", "m.b_id", "m.differences")


def rating_issues(found: DataFrame) -> DataFrame:
    """(id, parent, issue) of rating objects: value missing or no number, scale the wrong way round, value outside of it, counts that are no whole numbers of 0 or more."""
    own = found.where(F.arrays_overlap("types", F.array(*map(F.lit, RATINGS))))
    one = lambda k: F.max(F.when(F.col("key") == k, F.col("value"))).alias(k)
    each = own.groupBy("id", "parent").agg(*[one(k) for k in ("ratingValue", "worstRating", "bestRating", "ratingCount", "reviewCount")])
    rating = parsing.rating(F.col("ratingValue"))
    number = lambda k, default: F.when(F.col(k).isNull(), F.lit(default)).otherwise(F.col(k).try_cast("double"))
    worst = number("worstRating", 1.0)
    worst = F.when(F.col("worstRating").isNull() & rating["scale"].isNotNull(), F.lit(0.0)).otherwise(worst)
    best = F.when(F.col("bestRating").isNull(), F.coalesce(rating["scale"], F.lit(5.0))).otherwise(F.col("bestRating").try_cast("double"))
    scale = F.when(F.col("ratingValue").isNull(), "rating_missing").when(rating.isNull(), "rating_not_a_number").when(worst.isNull() | best.isNull(), "scale_not_a_number").when(worst >= best, "scale_reversed").when(~rating["value"].between(worst, best), "rating_outside")
    whole = lambda k: F.when(F.col(k).isNotNull() & ~F.regexp_like(F.trim(k), F.lit(r"^\d+(\.0+)?$")), F.lit(k + "_invalid"))
    return each.select("id", "parent", F.explode(F.array_compact(F.array(scale, whole("ratingCount"), whole("reviewCount")))).alias("issue"))


def organization_ids(found: DataFrame) -> DataFrame:
    """One row: how many blocks have an Organization, and how many different @id they give it; more than one is a scattered identity."""
    own = found.where(F.array_contains("types", "Organization"))
    return own.agg(F.count_distinct("id").alias("blocks"), F.count_distinct(F.when(F.col("key") == "@id", urls.identifier(F.col("value")))).alias("ids"))


def visible_claims(found: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, pointer, value, visible) of names, answers and prices against the visible text (id, text) of their page."""
    claims = found.where(F.col("key").isin("name", "text", "price") & (F.trim("value") != ""))
    seen = F.contains(F.col("text"), text.squeezed(F.col("value"))) | ((F.col("key") == "price") & F.coalesce(parsing.price_visible(F.col("text"), F.col("value").try_cast("double")), F.lit(False)))
    return claims.join(texts, "id").select("id", "pointer", "value", seen.alias("visible"))
