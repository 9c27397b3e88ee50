"""A stated query set against all rows, in blocks.

Queries are dealt into blocks of bounded size, which are broadcast one after the other; in each, every task reads its
own rows once, a batch at a time, and keeps the best of them. So rows are read where they lie, and never shuffled or
copied, and what is broadcast or held by a task does not grow with the table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written


def vectors(df: DataFrame, id: str, vector: str) -> DataFrame:
    """(id long, v array<double>) of rows whose vectors are not null and hold no null and nothing that is not finite; null ids are dropped."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(F.col(id).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null").where(~bad)


def matrix(ids: pa.Array, lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of columns; shorter vectors end in zeros."""
    ids = ids.to_numpy(zero_copy_only=False)
    length = lists.value_lengths().to_numpy(zero_copy_only=False)
    width = int(length.max()) if len(length) else 0
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if (length == width).all():
        return ids, flat.reshape(len(ids), width)
    out = np.zeros((len(ids), width), flat.dtype)
    out[np.arange(width) < length[:, None]] = flat
    return ids, out


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = max(a.shape[1], b.shape[1])
    return tuple(x if x.shape[1] == w else np.pad(x, ((0, 0), (0, w - x.shape[1]))) for x in (a, b))


def blocks(queries: DataFrame, query_rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of queries (id, v), about query_rows at a time; ids ascend."""
    n = max(1, math.ceil(queries.count() / query_rows))
    # rows with one id are dealt by their vectors too
    dealt = written(queries.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(n))), "queries")
    for k in range(n):
        rows = dealt.where(F.col("block") == k).orderBy("id", "v").select("id", "v").toArrow().combine_chunks()
        if len(rows):
            columns = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in rows.columns]
            yield matrix(*columns)


def searched(rows: DataFrame, queries: DataFrame, query_rows: int, tile_rows: int, kind: str, search: Callable) -> DataFrame:
    """What search(batches, block) yields for the batches of each task's rows and each block of queries, as a written table."""
    spark, found = rows.sparkSession, None
    for block in blocks(queries, query_rows):
        known = spark.sparkContext.broadcast(block)

        def work(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            yield from search(batches, known.value)

        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(tile_rows))
        out = written(rows.mapInArrow(work, kind), "found")
        known.destroy()
        found = out if found is None else found.unionByName(out)
    return rows.sparkSession.createDataFrame([], kind) if found is None else found


class Kept:
    """The k best rows of each query among all that were added, as columns; the first is the query's number."""

    def __init__(self, k: int, order: Callable[..., tuple[np.ndarray, ...]], most: int = 1_000_000):
        self.k, self.order, self.most = k, order, most
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.rows = 0

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.rows += len(columns[0])
        if self.rows > self.most:
            self.parts = [self.columns()]
            self.rows = len(self.parts[0][0])
            self.most = max(self.most, 2 * self.rows)

    def columns(self) -> tuple[np.ndarray, ...]:
        columns = tuple(np.concatenate(c) for c in zip(*self.parts, strict=True))
        at = np.lexsort((*self.order(*columns[1:]), columns[0]))
        columns = tuple(c[at] for c in columns)
        first = np.arange(len(at)) - np.searchsorted(columns[0], columns[0]) < self.k
        return tuple(c[first] for c in columns)


def best(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest scores of each query, ties to smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
