"""Operators on two states of one thing: what came, went, changed, or cannot be told."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def codes(before: DataFrame, after: DataFrame, complete: bool = True) -> DataFrame:
    """(code, n_before, n_after, state): a code that is gone is resolved only if the later audit was complete, else unverified."""
    a, b = before.groupBy("code").agg(F.count("*").alias("n_before")), after.groupBy("code").agg(F.count("*").alias("n_after"))
    out = a.join(b, "code", "full").fillna(0, ["n_before", "n_after"])
    return out.withColumn("state", F.when(F.col("n_after") == 0, "resolved" if complete else "unverified").when(F.col("n_before") == 0, "new").otherwise("persisting"))


def unpivoted(df: DataFrame, key: str, fields: list[str], name: str) -> DataFrame:
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(name)) for f in fields])
    return df.select(key, F.explode(each).alias("x")).select(key, "x.*")


def controls(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(field, compared, changed, unknown) over keys on both sides; a field that is null on either side is unknown and not compared."""
    old, new = before.select(key, *[F.col(f).cast("string").alias(f"{f}_old") for f in fields]), after.select(key, *[F.col(f).cast("string").alias(f"{f}_new") for f in fields])
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_old").alias("old"), F.col(f"{f}_new").alias("new")) for f in fields])
    both = old.join(new, key).select(F.explode(each).alias("x")).select("x.*")
    known = F.col("old").isNotNull() & F.col("new").isNotNull()
    return both.groupBy("field").agg(F.count_if(known).alias("compared"), F.count_if(known & (F.col("old") != F.col("new"))).alias("changed"), F.count_if(~known).alias("unknown"))


def presence(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys on one side only."""
    gone = before.select(key).subtract(after.select(key))
    return gone.withColumn("state", F.lit("gone")).unionByName(after.select(key).subtract(before.select(key)).withColumn("state", F.lit("new")))


def points(before: DataFrame, after: DataFrame, key: str, hits: str, known: str) -> DataFrame:
    """Change of a rate in percentage points to one decimal; null where a side has no known runs."""
    a = before.select(key, F.col(hits).alias("hits_before"), F.col(known).alias("known_before"))
    b = after.select(key, F.col(hits).alias("hits_after"), F.col(known).alias("known_after"))
    out = a.join(b, key, "full").fillna(0, ["hits_before", "known_before", "hits_after", "known_after"])
    ok = (F.col("known_before") > 0) & (F.col("known_after") > 0)
    return out.withColumn("points", F.when(ok, F.round((F.col("hits_after") / F.col("known_after") - F.col("hits_before") / F.col("known_before")) * 100, 1)))


def stats(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, old, new) of values that differ or are on one side only."""
    a, b = unpivoted(before, key, fields, "old"), unpivoted(after, key, fields, "new")
    return a.join(b, [key, "field"], "full").where(~F.col("old").eqNullSafe(F.col("new")))
