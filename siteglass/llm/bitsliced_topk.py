"""Operator 2: exact top-k search with a bit-sliced index.

Each component becomes floor(scale * x). Queries come in broadcast blocks of bounded size, and a task holds its rows a tile at
a time, so no row is shuffled before it is among a task's best. A tile of rows is stored as bit slices: one bitmap for each bit
of each component, less the tile's smallest value. For a block of queries the weighted sum of components
is built from the slices alone: a query component's bits choose slices, a negative one their complements,
and carry-save adders on bitmaps sum them into slices of the score. The top rows are then selected from the
most significant slice downward; rows still equal after the last slice are told apart by smaller id.

Vectors that are null, or hold nulls or values that are not finite, take no part. Where a tile's and a block's
values could leave 64 bits they are exact Python integers; a component or a result that itself leaves 64 bits is an
error, not a lost row. Shorter vectors end in zeros. Rows
with the same id are separate candidates; a query never finds rows with its own id. A table without
queries or candidates gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .tiles import Kept, best, matrix, same_width, searched, vectors

TILE_ROWS, QUERY_ROWS = 8192, 8192
#: Queries whose bitmaps are added at once.
LANE = 64


def bitmap(bits: np.ndarray) -> np.ndarray:
    """64-bit words of a row of booleans."""
    packed = np.packbits(bits, bitorder="little")
    return np.pad(packed, (0, -len(packed) % 8)).view(np.uint64)


def slices(values: np.ndarray) -> tuple[list[list[np.ndarray]], np.ndarray]:
    """For each column its bit slices, least first, and what was taken off it."""
    low = values.min(axis=0)
    rest = values - low
    return [[bitmap((rest[:, d] >> b & 1).astype(bool)) for b in range(int(rest[:, d].max()).bit_length())] for d in range(values.shape[1])], low


class Adder:
    """Carry-save sum of bitmaps that have weights."""

    def __init__(self) -> None:
        self.columns: list[list[np.ndarray]] = []

    def add(self, weight: int, bits: np.ndarray) -> None:
        while len(self.columns) <= weight:
            self.columns.append([])
        column = self.columns[weight]
        column.append(bits)
        if len(column) == 3:
            a, b, c = column
            x = a ^ b
            self.columns[weight] = [x ^ c]
            x &= c
            x |= a & b
            self.add(weight + 1, x)

    def total(self) -> list[np.ndarray]:
        """One slice for each weight."""
        w = 0
        while w < len(self.columns):
            column = self.columns[w]
            if len(column) == 2:
                a, b = column
                self.columns[w] = [a ^ b]
                self.add(w + 1, a & b)
            w += 1
        return [c[0] if c else None for c in self.columns]


def score_slices(parts: list[list[np.ndarray]], queries: np.ndarray) -> list[np.ndarray]:
    """Slices of the sum of |q| * u, where u is a component less its smallest value, or its complement for negative q."""
    adder = Adder()
    full = np.uint64(2**64 - 1)
    for d, own in enumerate(parts):
        size = np.abs(queries[:, d])
        flip = np.where(queries[:, d] < 0, full, np.uint64(0))[:, None]
        turned = [s[None, :] ^ flip for s in own]
        for j in range(int(size.max()).bit_length()):
            chosen = np.where(size >> j & 1, full, np.uint64(0))[:, None]
            for b, s in enumerate(turned):
                adder.add(j + b, s & chosen)
    return adder.total()


def select(total: list[np.ndarray], allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(surely selected, equal at the boundary) as bitmaps of each query."""
    sure, tied = np.zeros_like(allowed), allowed.copy()
    for s in reversed(total):
        if s is None:
            continue
        more = sure | (tied & s)
        over = (np.bitwise_count(more).sum(axis=1) > k)[:, None]
        sure = np.where(over, sure, more)
        tied &= np.where(over, s, ~s)
    return sure, tied


def rows_of(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def top_rows(ids: np.ndarray, values: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, row ids, scores) of each query's k best rows; ids ascend. Scores that could leave 64 bits are Python integers."""
    most, size = (max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0)))) for m in (values, queries))
    if most >= 2**62 or size >= 2**62:
        values, queries = values.astype(object), queries.astype(object)
    exact = values.shape[1] * most * size >= 2**63
    parts, _ = slices(values)
    alive = bitmap(np.ones(len(ids), bool))
    for at in range(0, len(query_ids), LANE):
        some, own = queries[at : at + LANE], query_ids[at : at + LANE]
        allowed = np.repeat(alive[None, :], len(own), axis=0)
        lo, hi = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
        for i in np.flatnonzero(lo < hi):
            for r in range(lo[i], hi[i]):
                allowed[i, r >> 6] &= ~(np.uint64(1) << np.uint64(r & 63))
        sure, tied = select(score_slices(parts, some), allowed, k)
        for i, query in enumerate(own):
            rows = rows_of(sure[i])
            rows = np.concatenate([rows, rows_of(tied[i])[: k - len(rows)]])
            yield query, ids[rows], values[rows].astype(object) @ some[i].astype(object) if exact else values[rows] @ some[i]


def topk(rows: DataFrame, queries: DataFrame, k: int, scale: int = 1024, tile_rows: int = TILE_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best rows by inner product of quantised vectors; rows and queries are (id, v)."""

    def quantised(df: DataFrame) -> DataFrame:
        whole = lambda x: F.when(F.abs(x * scale) < 2.0**63, F.floor(x * scale).cast("long")).otherwise(F.raise_error(F.lit("a quantised component leaves 64 bits")))
        return df.select("id", F.transform("v", whole).alias("v"))

    def search(batches: Iterator[pa.RecordBatch], block: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = block
        kept = Kept(k, lambda far, score, id: (id, ~score, -far))
        for batch in batches:
            ids, values = matrix(batch.column(0), batch.column(1))
            order = np.argsort(ids, kind="stable")
            values, own = same_width(values[order].astype(np.int64), queries.astype(np.int64))
            found = list(top_rows(ids[order], values, query_ids, own, k))
            n = [len(x[1]) for x in found]
            if sum(n):
                score = np.concatenate([x[2] for x in found])
                far = np.zeros(len(score), np.int32)  # beyond 64 bits: 1 above, -1 below
                if score.dtype == object:
                    far = (score >= 2**63).astype(np.int32) - (score < -(2**63)).astype(np.int32)
                    score = np.where(far == 0, score, 0).astype(np.int64)
                kept.add(np.repeat(np.arange(len(found)), n), far, score, np.concatenate([x[1] for x in found]))
        if kept.rows:
            query, far, score, id = kept.columns()
            yield pa.RecordBatch.from_arrays([pa.array(query_ids[query]), pa.array(query), pa.array(id), pa.array(far), pa.array(score)], ["query_id", "query", "vec_id", "far", "score"])

    found = searched(written(quantised(rows), "rows"), quantised(queries), query_rows, tile_rows, "query_id long, query long, vec_id long, far int, score long", search)
    found = best(found.select("query_id", "vec_id", F.struct("far", "score").alias("score")), k)
    score = F.when(F.col("score.far") == 0, F.col("score.score")).otherwise(F.raise_error(F.lit("a score leaves 64 bits")))
    return found.withColumn("score", score)


def op2_bitsliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk(rows, rows.where("id % 100 = 0"), 10)


QUERIES = {"op2_bitsliced_topk": op2_bitsliced_topk}
ORACLES = {
    "op2_bitsliced_topk": """
        WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
                   FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
                   AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda x: coalesce(x[1] * x[2], 0))) AS BIGINT) AS score
              FROM e q JOIN e c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""
}
