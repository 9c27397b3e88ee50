"""Operator 10: approximate nearest neighbours by additive quantisation.

A vector is the sum of one full-dimensional codeword from each codebook. The codebooks are fitted on a
bounded sample (SAMPLE_ROWS rows, those of the smallest hashes of their ids): by k-means on what earlier
ones leave, then jointly by least squares on beam-searched codes. Every row is encoded by beam search over
the codebooks and stored with the squared norm of its approximation. A query's inner products with all
codewords make a lookup table, two codebooks to an entry; a row's approximate score is the sum of its codes' entries.

Rows are quantised by direction and stored with their length and with how far they lie from their approximation (the rest).
Queries come in broadcast blocks of bounded size, and rows are read where they lie. A first pass over codes finds, for each query, the approximate
score that RERANKED rows of the whole table reach (or a little less, as a task sends only so many of its best as a few times its even
share), and scores the best of each tile exactly, which gives a score that the k nearest reach for sure. A second pass scores the rows exactly that
reach the first, or whose approximate score is short of the second by no more than a share of query length times rest. That share is measured for each
block: PROBES of its queries are held against every row, and all but MISSED of their nearest must be found; a share of 1 would be exact.
Where codes say little (rows crowded together, lengths far apart, many components), more rows are scored, and recall holds.

Nearness is the inner product ("ip") or the squared distance ("l2", which uses the stored norms; its score
is the negative distance). Vectors that are null or zero, or hold nulls or values that are not finite,
take no part; shorter vectors end in zeros. Rows with the same id are separate candidates, and a query
never finds rows with its own id. Equal vectors have equal codes, which cannot tell them apart: they are indexed
as one, which holds the k + 1 smallest of their ids, and expanded when found. Ties go to the smaller id. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written
from .tiles import Kept, best, blocks, matrix, same_width, vectors

SAMPLE_ROWS = 8192
#: Codebooks (an even number) and their codewords; two codes of 16 words are a byte.
BOOKS, WORDS, BEAM = 48, 16, 3
TILE_ROWS, QUERY_ROWS = 8192, 8192
#: Rows of the whole table that are scored exactly, for each query.
RERANKED = 256
#: Queries of a block that are held against every row, the part of their nearest that may be missed, and what is added to the share that follows.
PROBES, MISSED, SPARE = 128, 0.005, 1.25


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (rows, books) that approximate x by beam search."""
    n, (m, k, d) = len(x), books.shape
    codes = np.zeros((n, 1, 0), np.uint8)
    rest, error = x[:, None, :], np.zeros((n, 1), x.dtype)
    for b in range(m):
        c = books[b]
        cost = error[:, :, None] - 2 * (rest @ c.T) + (c**2).sum(1)
        flat = cost.reshape(n, -1)
        keep = min(beam if b < m - 1 else 1, flat.shape[1])
        pick = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.tile(np.arange(keep), (n, 1))
        parent, word = pick // k, pick % k
        codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None].astype(np.uint8)], axis=2)
        rest = np.take_along_axis(rest, parent[:, :, None], 1) - c[word]
        error = np.take_along_axis(flat, pick, 1)
    return codes[:, 0, :]


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[b][codes[:, b]] for b in range(len(books)))


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 4, seed: int = 1) -> np.ndarray:
    """Codebooks (books, words, width) for rows x."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    if not len(x):
        return np.zeros((books, words, x.shape[1]), np.float32)
    rest, out = x.copy(), []
    for _ in range(books):
        c = rest[rng.choice(len(rest), words, replace=len(rest) < words)].copy()
        for _ in range(rounds):
            near = np.argmin((c**2).sum(1) - 2 * rest @ c.T, axis=1)
            n = np.bincount(near, minlength=words)
            sums = np.zeros_like(c)
            np.add.at(sums, near, rest)
            c[n > 0] = sums[n > 0] / n[n > 0, None]
        near = np.argmin((c**2).sum(1) - 2 * rest @ c.T, axis=1)
        rest -= c[near]
        out.append(c)
    out = np.stack(out)
    codes = encode(x, out).astype(np.int64) + np.arange(books) * words
    chosen = np.zeros((len(x), books * words), np.float32)
    np.put_along_axis(chosen, codes, 1, 1)
    gram, right = chosen.T @ chosen, chosen.T @ x
    return np.linalg.solve(gram + np.eye(len(gram), dtype=np.float32) * 0.1, right + 0.1 * out.reshape(len(gram), -1)).reshape(out.shape).astype(np.float32)


def distinct(rows: DataFrame, k: int) -> DataFrame:
    """(id, v, members) of every different vector of rows (id, v), none of them zero: members are the rows' ids in order, those
    of the k + 1 smallest and each at most k times, so k are left to a query that may not find its own; id is the first."""
    v = F.transform("v", lambda x: x + 0.0)  # no -0.0
    last = F.size("v") - F.array_position(F.transform(F.reverse("v"), lambda x: x != 0), True) + 1
    rows = rows.withColumn("v", v).withColumn("v", F.slice("v", F.lit(1), last.cast("int")))
    ids = rows.groupBy("id", "v").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    # tasks keep k + 1 rows of each vector before they send them
    few = ids.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("place") <= k + 1)
    members = F.sort_array(F.flatten(F.collect_list(F.array_repeat("id", F.col("n")))))
    return few.groupBy("v").agg(members.alias("members")).select(F.col("members")[0].alias("id"), "v", "members")


def _lengths(x: np.ndarray) -> np.ndarray:
    most = np.abs(x).max(1, initial=0)
    return most * np.sqrt(((x / np.where(most > 0, most, 1)[:, None]) ** 2).sum(1))


def index(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """rows (id, v, members) with codes (binary) of the direction, length, norm, the squared norm of the direction's approximation, and rest, the distance of the row from its approximation."""
    width = books.shape[2]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, x = matrix(b.column(0), b.column(1))
            length = _lengths(x)
            unit = x / length[:, None]
            x = np.pad(unit, ((0, 0), (0, max(0, width - x.shape[1]))))
            near = x[:, :width].astype(np.float32)
            codes = np.concatenate([encode(near[i : i + 2048], books) for i in range(0, len(near), 2048)]) if len(near) else np.zeros((0, len(books)), np.uint8)
            about = decode(codes, books).astype(np.float64) if len(near) else np.zeros((0, width))
            rest = np.sqrt(((x[:, :width] - about) ** 2).sum(1) + (x[:, width:] ** 2).sum(1)) + 1e-5  # more than what sums of single precision are off
            packed = (codes[:, ::2] * books.shape[1] + codes[:, 1::2]).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in packed], pa.binary()), pa.array(length), pa.array((about**2).sum(1)), pa.array(rest * length)], ["id", "v", "members", "codes", "length", "norm", "rest"])

    return rows.mapInArrow(work, "id long, v array<double>, members array<long>, codes binary, length double, norm double, rest double")


def lookup(queries: np.ndarray, books: np.ndarray) -> np.ndarray:
    """(queries, pairs of codebooks, pairs of codewords): inner products of queries with sums of two codewords."""
    m, w, d = books.shape
    one = (np.pad(queries, ((0, 0), (0, max(0, d - queries.shape[1]))))[:, :d].astype(np.float32) @ books.reshape(m * w, d).T).reshape(len(queries), m, w)
    return (one[:, ::2, :, None] + one[:, 1::2, None, :]).reshape(len(queries), m // 2, w * w)


def approximate(table: np.ndarray, codes: np.ndarray, length: np.ndarray, norm: np.ndarray, measure: str, lengths: np.ndarray) -> np.ndarray:
    """Approximate scores (queries, rows); lengths are those of the queries."""
    near = table[:, 0, :].take(codes[:, 0], axis=1)
    for b in range(1, table.shape[1]):
        near += table[:, b, :].take(codes[:, b], axis=1)
    return near * length if measure == "ip" else 2 * near * length - norm * length**2 - lengths[:, None] ** 2


def margin(near: np.ndarray, rest: np.ndarray, lengths: np.ndarray, measure: str) -> np.ndarray:
    """By how much scores can be off at most, for approximate scores (queries, rows)."""
    return lengths[:, None] * rest if measure == "ip" else rest * (2 * np.sqrt(np.maximum(0, -near)) + rest) + 1e-5 * lengths[:, None] ** 2


def exact(x: np.ndarray, queries: np.ndarray, row: np.ndarray, query: np.ndarray, measure: str) -> np.ndarray:
    """Scores of pairs in double precision, component by component in order."""
    score = np.zeros(row.shape)
    for c in range(x.shape[1]):
        p, q = x[row, c], queries[query, c]
        score += p * q if measure == "ip" else -((p - q) ** 2)
    return score


def _codes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _largest(x: np.ndarray, n: int) -> np.ndarray:
    return -np.partition(-x, n - 1, axis=-1)[..., :n] if x.shape[-1] > n else x


def thresholds(stored: DataFrame, block: tuple, books: np.ndarray, measure: str, reranked: int, tile_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query of a block the approximate score that reranked rows reach, or a little less; and an exact score that k other rows reach."""
    spark = stored.sparkSession
    tasks = max(1, stored.rdd.getNumPartitions())
    sent = min(reranked, 16 + 4 * reranked // tasks)
    known = spark.sparkContext.broadcast((block[1], books))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, words = known.value
        lengths = _lengths(queries)
        top, sure = np.zeros((len(queries), 0)), np.zeros((len(queries), 0))
        for b in batches:
            _, x = matrix(b.column(4), b.column(5))
            x, own = same_width(x, queries)
            codes, (length, norm) = _codes(b.column(0)), (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            parts, scored = [], []
            for at in range(0, len(queries), 64):
                some = slice(at, at + 64)
                near = approximate(lookup(queries[some], words), codes, length, norm, measure, lengths[some])
                parts.append(_largest(np.concatenate([top[some], near], axis=1), sent))
                # one more than k, as a query may find itself
                row = np.argpartition(-near, k, axis=1)[:, : k + 1] if near.shape[1] > k + 1 else np.tile(np.arange(near.shape[1]), (len(near), 1))
                score = exact(x, own[some], row, np.arange(len(near))[:, None], measure)
                scored.append(_largest(np.concatenate([sure[some], score], axis=1), k + 1))
            top, sure = np.concatenate(parts), np.concatenate(scored)
        if top.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(top))), *(pa.array([r.tobytes() for r in t], pa.binary()) for t in (top, sure))], ["query", "top", "sure"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits = (reranked, k + 1)
        held: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for q, *raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                old = held.get(q, [np.zeros(0), np.zeros(0)])
                held[q] = [_largest(np.concatenate([o, np.frombuffer(r)]), n) for o, r, n in zip(old, raw, limits, strict=True)]
        least = [[float(x[i].min()) if len(x[i]) >= n else -np.inf for x in held.values()] for i, n in enumerate(limits)]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), *(pa.array(x, pa.float64()) for x in least)], ["query", "least", "sure"])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(tile_rows))
    rows = stored.select("codes", "length", "norm", "rest", "id", "v").mapInArrow(work, "query long, top binary, sure binary").repartition("query").mapInArrow(merged, "query long, least double, sure double").toArrow()  # one row for each query of the block
    least, sure = np.full(len(block[0]), -np.inf), np.full(len(block[0]), -np.inf)
    least[rows["query"].to_numpy()], sure[rows["query"].to_numpy()] = rows["least"].to_numpy(), rows["sure"].to_numpy()
    known.destroy()
    return least, sure - 1e-9 * np.abs(np.where(np.isfinite(sure), sure, 0))


def share(stored: DataFrame, block: tuple, least: np.ndarray, sure: np.ndarray, books: np.ndarray, measure: str, tile_rows: int, k: int) -> float:
    """The share of the margin that finds all but MISSED of the k nearest rows of PROBES queries, which are held against every row."""
    spark = stored.sparkSession
    at = np.unique(np.linspace(0, len(block[0]) - 1, min(PROBES, len(block[0]))).astype(int))
    known = spark.sparkContext.broadcast((block[0][at], block[1][at], least[at], sure[at], books))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, least, sure, words = known.value
        lengths = _lengths(queries)
        kept = Kept(k, lambda score, needed: (-score,))
        for b in batches:
            id, x = matrix(b.column(0), b.column(1))
            copies = b.column(2).value_lengths().to_numpy()
            x, own = same_width(x, queries)
            codes, (length, norm, rest) = _codes(b.column(3)), (b.column(i).to_numpy(zero_copy_only=False) for i in (4, 5, 6))
            for i in range(0, len(own), 32):
                some = slice(i, i + 32)
                near = approximate(lookup(queries[some], words), codes, length, norm, measure, lengths[some])
                score = own[some] @ x.T if measure == "ip" else -np.stack([((x - q) ** 2).sum(1) for q in own[some]])
                score = np.where((ids[some, None] == id) & (copies == 1), -np.inf, score)
                with np.errstate(all="ignore"):
                    needed = np.where(near >= least[some, None], 0, np.nan_to_num((sure[some, None] - near) / margin(near, rest, lengths[some], measure), nan=1))
                row = np.argpartition(-score, k - 1, axis=1)[:, :k] if score.shape[1] > k else np.tile(np.arange(score.shape[1]), (len(score), 1))
                query = np.repeat(np.arange(len(score)), row.shape[1]) + i
                score, needed = (np.take_along_axis(t, row, 1).ravel() for t in (score, needed))
                real = score > -np.inf
                kept.add(query[real], score[real], needed[real])
        if kept.rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in kept.columns()], ["query", "score", "needed"])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(tile_rows))
    found = stored.select("id", "v", "members", "codes", "length", "norm", "rest").mapInArrow(work, "query long, score double, needed double")
    nearest = found.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))).where(F.col("place") <= k)
    said = nearest.agg(F.percentile("needed", F.lit(1 - MISSED)).alias("share")).first()[0]
    known.destroy()
    return min(1.0, max(0.0, said or 0.0) * SPARE)


def _expanded(rows: np.ndarray, query: np.ndarray, score: np.ndarray, members: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, score, id) of every id that the rows stand for."""
    n = sizes[rows]
    query, score = np.repeat(query, n), np.repeat(score, n)
    return query, score, members[np.arange(len(query)) + np.repeat(begins[rows] - (np.cumsum(n) - n), n)]


def nearest(rows: DataFrame, queries: DataFrame, k: int, measure: str = "ip", tile_rows: int = TILE_ROWS, query_rows: int = QUERY_ROWS, reranked: int = RERANKED, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest rows found; rows and queries are (id, v)."""
    spark = rows.sparkSession
    rows, queries = (df.where(F.exists("v", lambda x: x != 0)) for df in (rows, queries))
    rows = written(distinct(rows, k), "distinct")
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("id", "v").toArrow().combine_chunks()
    if not len(sample):
        return best(spark.createDataFrame([], "query_id long, vec_id long, score double"), k)
    known = matrix(sample["id"].chunk(0), sample["v"].chunk(0))[1]
    books = fit(known / _lengths(known)[:, None])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    stored = written(index(rows, books), "index")
    found = None
    for block in blocks(queries, query_rows):
        least, sure = thresholds(stored, block, books, measure, reranked, tile_rows, k)
        known = spark.sparkContext.broadcast((*block, least, sure, share(stored, block, least, sure, books, measure, tile_rows, k), books))

        def work(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            query_ids, queries, least, sure, part, words = known.value
            lengths = _lengths(queries)
            kept = Kept(k, lambda score, id: (id, -score))
            for b in batches:
                _, x = matrix(b.column(0), b.column(1))
                lists = b.column(2)
                members, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
                begins = np.cumsum(sizes) - sizes
                codes, (length, norm, rest) = _codes(b.column(3)), (b.column(i).to_numpy(zero_copy_only=False) for i in (4, 5, 6))
                x, own = same_width(x, queries)
                for at in range(0, len(own), 64):
                    some = slice(at, at + 64)
                    near = approximate(lookup(queries[some], words), codes, length, norm, measure, lengths[some])
                    query, row = np.nonzero((near >= least[some, None]) | ~(near + part * margin(near, rest, lengths[some], measure) < sure[some, None]))
                    score = exact(x, own[some], row, query, measure)
                    # what is below a score that k others reach is not expanded
                    query, row, score = (t[score >= sure[query + at]] for t in (query, row, score))
                    query, score, id = _expanded(row, query + at, score, members, begins, sizes)
                    other = id != query_ids[query]
                    kept.add(query[other], score[other], id[other])
            if kept.rows:
                query, score, id = kept.columns()
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[query]), pa.array(query), pa.array(id), pa.array(score)], ["query_id", "query", "vec_id", "score"])

        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(tile_rows))
        out = written(stored.select("id", "v", "members", "codes", "length", "norm", "rest").mapInArrow(work, "query_id long, query long, vec_id long, score double"), "found")
        known.destroy()
        found = out if found is None else found.unionByName(out)
    if found is None:
        found = spark.createDataFrame([], "query_id long, vec_id long, score double")
    return best(found.select("query_id", "vec_id", "score"), k)


def op10_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return nearest(rows, rows.where("id % 20 = 0"), 20)


QUERIES = {"op10_additive_ann": op10_additive_ann}
ORACLES: dict[str, str] = {}
