"""Packages of files that are to be deployed, a folder for each site, read in one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "jsonld/manifest.json"
#: What the name of a manifest's schema ends with.
MANIFEST_SCHEMA = r"/jsonld-manifest/\d+$"
DRAFT = ("url", "current_title", "draft_title", "current_description", "draft_description")
_SHAPE = r"([^/]+)/(robots\.txt|llms\.txt|sitemap[^/]*\.xml|meta-draft\.json|jsonld/[^/]+\.json)$"


def kind_of(name: Column) -> Column:
    """robots, llms, sitemap, manifest, jsonld or meta, by the name of a file in its package."""
    return F.when(name == MANIFEST, "manifest").when(F.startswith(name, F.lit("jsonld/")), "jsonld").when(F.startswith(name, F.lit("sitemap")), "sitemap").when(name == "meta-draft.json", "meta").otherwise(F.substring_index(name, ".", 1))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(site, name, kind, body, valid) of the files under path that a package can have; the site is the package's folder. valid is null for files that are no JSON. Other files are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    body = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "^\ufeff", "")
    files = raw.select(F.regexp_extract("path", _SHAPE, 1).alias("site"), F.regexp_extract("path", _SHAPE, 2).alias("name"), body.alias("body")).where("name <> ''")
    return files.withColumn("kind", kind_of(F.col("name"))).select("site", "name", "kind", "body", F.when(F.endswith("name", F.lit(".json")), F.try_parse_json("body").isNotNull()).alias("valid"))


def _text(value: Column, path: str = "$") -> Column:
    inner = F.try_variant_get(value, path, "variant") if path != "$" else value
    return F.when(F.schema_of_variant(inner) == "STRING", F.try_variant_get(inner, "$", "string"))


def mapping(files: DataFrame) -> DataFrame:
    """(site, name, url) of manifests; a file whose URL is no text has null. Manifests of another schema, or broken ones, map nothing."""
    v = F.try_parse_json("body")
    own = files.where("kind = 'manifest'").select("site", v.alias("v")).where(F.regexp_like(_text(F.col("v"), "$.schema"), F.lit(MANIFEST_SCHEMA)))
    return own.select("site", F.explode(F.try_variant_get("v", "$.files", "map<string,variant>")).alias("file", "u")).select("site", F.concat(F.lit("jsonld/"), "file").alias("name"), _text(F.col("u")).alias("url"))


def drafts(files: DataFrame) -> DataFrame:
    """(site, place, DRAFT) of the drafted titles and descriptions, in file order. What is no text is null; files that are no lists have none."""
    rows = files.where("kind = 'meta'").select("site", F.posexplode(F.try_variant_get(F.try_parse_json("body"), "$", "array<variant>")).alias("place", "v"))
    return rows.select("site", "place", *[_text(F.col("v"), f"$.{f}").alias(f) for f in DRAFT])
