"""An append-only observation log as a stream: last-write-wins in state, windowed counts, and upserts into a table by batch.

The table of a log is partitioned by date, which is part of every key, so a batch rewrites only the dates that it holds. A batch that was merged leaves
a mark of its number, and coming again changes nothing; one that broke off half-way is merged again, which gives the same rows, as the largest seq of a key wins in any order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import measure
from ..sources.scratch import kept


def latest(stream: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key so far; run it in update mode. State holds one row for each key."""
    rest = [c for c in stream.columns if c not in key and c != order]
    return stream.groupBy(*key).agg(F.max(F.struct(order, *rest)).alias("m")).select(*key, f"m.{order}", *[f"m.{c}" for c in rest])


def windowed(stream: DataFrame, time: str, every: str, late: str) -> DataFrame:
    """Rows and errors by engine and window; rows later than the watermark are dropped with their window's state."""
    return stream.withWatermark(time, late).groupBy(F.window(time, every), "engine").agg(F.count("*").alias("attempts"), F.count_if(F.col("outcome") == "error").alias("errors"))


def append(rows: DataFrame, path: str) -> None:
    """Rows as lines of JSON, added to a log's folder; nothing is written for no rows, and nulls are written as such."""
    if not rows.isEmpty():
        rows.write.mode("append").option("ignoreNullFields", "false").json(path)


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def merge(batch: DataFrame, number: int, path: str, order: str = "seq") -> None:
    """The table at path with the rows of a batch, of each key the one with the largest seq. Rows without a date are none."""
    spark, mark = batch.sparkSession, f"{path}/_merged/{number}"
    if _there(spark, mark):
        return
    rows = batch.where("date is not null")
    if _there(spark, f"{path}/rows"):
        days = rows.select("date").distinct()
        old = state(spark, path).join(F.broadcast(days) if days.limit(10_001).count() <= 10_000 else days, "date", "left_semi")
        rows = old.select(*rows.columns).unionByName(rows)
    merged = kept(measure.last_write_wins(rows, measure.KEY, order), "merged")
    # a date replaces the one that was there; a large one is written by several tasks
    merged.withColumn("_date", F.col("date")).hint("rebalance", "_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_date").parquet(f"{path}/rows")
    at = spark._jvm.org.apache.hadoop.fs.Path(mark)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)


def state(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a merged log; fulfilled reservations are among them (measure.without_fulfilled takes them out)."""
    return spark.read.parquet(f"{path}/rows").drop("_date")


def upserts(stream: DataFrame, path: str, order: str = "seq") -> DataStreamWriter:
    """A stream of rows that is merged batch by batch into the table at path; start it with a checkpoint, whose batch numbers it takes."""
    each: Callable[[DataFrame, int], None] = lambda batch, number: merge(batch, number, path, order)
    return stream.writeStream.foreachBatch(each)
