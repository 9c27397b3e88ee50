"""Operator 13: drawing documents that look like a target, by importance resampling over hashed n-grams.

Features are runs of 1 to 3 words; a feature's bucket is the CRC-32 of its bytes modulo BUCKETS. Two counts of every bucket, over
all documents and over all target texts, give the bucket's gain in thousandths of a natural logarithm. A document's weight is
the sum of the gains of its features, its score that plus Gumbel noise from a hash of its id, so the highest scores are a draw without replacement.

Both passes over texts are arrays: CRC-32 is a table of 256 values, and all words of a slice advance by one byte at a time; a
bigram goes on from the state of its first word, a trigram from that of its bigram. Counts are combined in tasks and added by bucket;
only BUCKETS sums reach the driver, and BUCKETS gains the tasks.

The draw: each task sorts its eligible documents (at least LEAST words) into runs, a bounded number of rows each, which are written. Runs
are cut into ranges of the scores by sampled bounds. Ranges that begin before the draw count is reached are merged, each in a task of
its own and of bounded size, by a tree of losers over its pieces of runs, which are read in blocks; a merge stops when the exact draw count is
reached. A row's rank is its place in its range plus the rows of the ranges before. Ranks are joined back to narrow rows by number.

Null and empty texts have no features, weight 0, and are never drawn. Null ids count as ids after all others, their noise is that of
an empty id. Ties of score and id (repeated rows) go by the order in which rows were written. Texts are taken whole; an empty
table of documents gives no rows, an empty table of targets a target that all buckets share alike.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import aside, drop, table, text_batches, written
from .wordhash import text_slices

BUCKETS, WIDTHS, LEAST, PERCENT, SEED = 10_000, 3, 20, 5, 42
#: Rows of a run, rows that a range should hold, rows that a merge reads of a run at a time.
RUN_ROWS, RANGE_ROWS, BLOCK_ROWS = 500_000, 200_000, 4096
#: Bytes of a word that go in step with those of all others; the rest of longer words goes by itself.
STEP = 48

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_FULL = np.uint32(0xFFFFFFFF)


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_CRC = _crc_table()


def spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte, length) of each word of rows data[off[r]:off[r + 1]]."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = _WORD[data]
    first = np.zeros(len(data) + 1, bool)
    first[off] = True
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1] | first[1:-1]
    end[:-1] &= ~solid[1:] | first[1:-1]
    at = np.flatnonzero(start)
    return np.searchsorted(off, at, "right") - 1, at, np.flatnonzero(end) + 1 - at


def advance(state: np.ndarray, data: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRC states after n bytes of data from at on."""
    order = np.argsort(-n, kind="stable")
    s, a, lengths = state[order], at[order], n[order]
    live = np.searchsorted(-lengths, -np.arange(min(STEP, int(lengths[0]) if len(n) else 0)), "left")
    for j, k in enumerate(live):
        s[:k] = _CRC[(s[:k] ^ data[a[:k] + j]) & np.uint32(255)] ^ (s[:k] >> np.uint32(8))
    for i in range(int(np.searchsorted(-lengths, -STEP, "left"))):
        s[i] = np.uint32(zlib.crc32(data[a[i] + STEP : a[i] + lengths[i]].tobytes(), int(s[i] ^ _FULL))) ^ _FULL
    out = np.empty_like(s)
    out[order] = s
    return out


def features(texts: pa.Array, buckets: int = BUCKETS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, past the last row, words of each row, row and bucket of each feature) of slices of texts."""
    for a, b, raw, off in text_slices(texts):
        data = _LOWER[raw]
        row, at, n = spans(data, off)
        live = np.arange(len(at))
        state = advance(np.full(len(at), _FULL, np.uint32), data, at, n)
        rows, found = [row], [state]
        for width in range(1, WIDTHS):
            ok = live + width < len(at)
            live, state = live[ok], state[ok]
            ok = row[live + width] == row[live]
            live, state = live[ok], state[ok]
            state = _CRC[(state ^ np.uint32(32)) & np.uint32(255)] ^ (state >> np.uint32(8))
            state = advance(state, data, at[live + width], n[live + width])
            rows.append(row[live])
            found.append(state)
        yield a, b, np.bincount(row, minlength=b - a), np.concatenate(rows), ((np.concatenate(found) ^ _FULL) % np.uint32(buckets)).astype(np.int64)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts (text) each bucket holds."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for b in batches:
            for *_, bucket in features(b.column(0), buckets):
                n += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(work, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much likelier each bucket is in the target, rounded down."""
    s, t, b = float(source.sum()), float(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((float(y) + 1) * (s + b) / ((float(x) + 1) * (t + b)))) for x, y in zip(source, target, strict=True)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Thousandths of Gumbel noise from a hash of the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """docs (doc_id long, text, ...) without text, with words, n_features, weight and score (long)."""
    kept = [c for c in docs.columns if c != "text"]
    known = docs.sparkSession.sparkContext.broadcast(gain)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = known.value
        for batch in batches:
            text, ids = batch.column("text"), batch.column("doc_id").to_pylist()
            for a, b, words, row, bucket in features(text, len(gain)):
                weight = np.zeros(b - a, np.int64)
                np.add.at(weight, row, gain[bucket])
                score = [int(w) + noise(i, seed) for w, i in zip(weight, ids[a:b], strict=True)]
                columns = [words, np.bincount(row, minlength=b - a), weight, score]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, b - a) for c in kept], *[pa.array(c, pa.int64()) for c in columns]], [*kept, "words", "n_features", "weight", "score"])

    kinds = ", ".join(f"`{c}` {k}" for c, k in docs.dtypes if c != "text")
    return docs.mapInArrow(work, f"{kinds}, words long, n_features long, weight long, score long")


RUNS = "run long, place long, no_id boolean, id long, row long, score long"


def _runs(run_rows: int):
    """Sorted runs of a task's rows (no_id, id, row, score): highest scores first, then smallest ids, null last, then rows."""

    def run(number: int, columns: list[np.ndarray]) -> pa.RecordBatch:
        no_id, id, row, score = columns
        at = np.lexsort((row, id, no_id, -score))
        n = np.full(len(at), TaskContext.get().partitionId() << 32 | number)
        return pa.RecordBatch.from_arrays([pa.array(n), pa.array(np.arange(len(at))), *[pa.array(c[at]) for c in columns]], ["run", "place", "no_id", "id", "row", "score"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        rows = number = 0
        for b in batches:
            parts.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
            rows += b.num_rows
            if rows >= run_rows:
                yield run(number, [np.concatenate(c) for c in zip(*parts, strict=True)])
                parts, rows, number = [], 0, number + 1
        if rows:
            yield run(number, [np.concatenate(c) for c in zip(*parts, strict=True)])

    return work


class Losers:
    """A tournament of sorted runs: each inner node holds the run that lost there, so the next winner meets as many as the tree is high."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.heads = [next(r, None) for r in runs]
        self.size = 1 << max(0, len(runs) - 1).bit_length()
        self.lost = [-1] * self.size
        self.winner = self._play(1)

    def _before(self, a: int, b: int) -> bool:
        """Whether run a's head comes before run b's; runs that are empty come last."""
        x = self.heads[a] if 0 <= a < len(self.heads) else None
        y = self.heads[b] if 0 <= b < len(self.heads) else None
        return x is not None and (y is None or x < y)

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._play(2 * node), self._play(2 * node + 1)
        a, b = (a, b) if self._before(a, b) else (b, a)
        self.lost[node] = b
        return a

    def __iter__(self) -> Iterator[tuple]:
        while 0 <= self.winner < len(self.heads) and (head := self.heads[self.winner]) is not None:
            yield head
            self.heads[self.winner] = next(self.runs[self.winner], None)
            now, node = self.winner, (self.winner + self.size) // 2
            while node:
                if self._before(self.lost[node], now):
                    now, self.lost[node] = self.lost[node], now
                node //= 2
            self.winner = now


def _cursor(columns: list[np.ndarray], a: int, z: int) -> Iterator[tuple]:
    """The keys (score falling, no id, id, row) of one run, a block at a time."""
    for at in range(a, z, BLOCK_ROWS):
        some = slice(at, min(z, at + BLOCK_ROWS))
        no_id, id, row, score = (c[some].tolist() for c in columns)
        yield from zip([-x for x in score], no_id, id, row, strict=True)


def _merge(table: pa.Table) -> pa.Table:
    """The first rows of a range, as many as its column quota says, with their ranks."""
    run, place, no_id, id, row, score, before, quota = (table[c].to_numpy() for c in ("run", "place", "no_id", "id", "row", "score", "before", "quota"))
    at = np.lexsort((place, run))
    columns = [c[at] for c in (no_id, id, row, score)]
    edges = np.append(np.flatnonzero(np.diff(run[at], prepend=run[at[:1]] - 1)), len(at))
    tree, out = Losers([_cursor(columns, a, z) for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]), []
    if quota[0] > 0:
        for head in tree:
            out.append(head)
            if len(out) == quota[0]:
                break
    rank = np.arange(1, len(out) + 1) + before[0]
    return pa.table({"no_id": pa.array([x[1] for x in out], pa.bool_()), "id": pa.array([x[2] for x in out], pa.int64()), "row": pa.array([x[3] for x in out], pa.int64()), "score": pa.array([-x[0] for x in out], pa.int64()), "rank": pa.array(rank, pa.int64())})


def highest(rows: DataFrame, draws: int, n: int, run_rows: int = RUN_ROWS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(no_id, id, row, score, rank) of the draws first of n rows (no_id, id, row, score), as a written table."""
    order = [F.desc("score"), F.asc("no_id"), F.asc("id"), F.asc("row")]
    runs = written(rows.select("no_id", "id", "row", "score").mapInArrow(_runs(run_rows), RUNS), "runs")
    cut = runs.repartitionByRange(max(1, math.ceil(n / range_rows)), *order).withColumn("range", F.spark_partition_id())
    cut = written(cut, "ranges")
    # a row for each range
    counts = cut.groupBy("range").agg(F.count("*").alias("n"))
    running = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    quotas = counts.withColumn("before", F.coalesce(F.sum("n").over(running), F.lit(0))).where(F.col("before") < draws)
    quotas = quotas.select("range", "before", F.least(F.col("n"), F.lit(draws) - F.col("before")).alias("quota"))
    first = cut.join(F.broadcast(quotas), "range")
    out = written(first.groupBy("range").applyInArrow(_merge, "no_id boolean, id long, row long, score long, rank long"), "drawn")
    drop(runs, cut)
    return out


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST, buckets: int = BUCKETS, seed: int = SEED, run_rows: int = RUN_ROWS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """docs (doc_id, text, ...) without text, with words, n_features, weight, score and rank (null where not drawn); target is (text). See above."""
    text_batches(docs.sparkSession)
    plain, back = aside(docs, ("doc_id", "text"))
    plain = plain.withColumn("doc_id", F.col("doc_id").cast("long"))
    gain = gains(bucket_counts(plain, buckets), bucket_counts(target, buckets))
    rows = written(scores(plain, gain, seed).withColumn("_row", F.monotonically_increasing_id()), "scores")
    eligible = rows.where(F.col("words") >= least)
    n = eligible.count()
    draws = percent * n // 100
    if not draws:
        return back(rows.withColumn("rank", F.lit(None).cast("long")).drop("_row"))
    drawn = highest(eligible.select(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("_row").alias("row"), "score"), draws, n, run_rows, range_rows)
    ranks = drawn.select(F.col("row").alias("_row"), "rank")
    return back(rows.join(ranks, "_row", "left").drop("_row"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its features, weight and score, and the rank of those that are drawn. Nulls, empties and ties: as the module says."""
    out = resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {"op13_importance": op13_importance}
ORACLES: dict[str, str] = {}
