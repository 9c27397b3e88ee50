"""Operator 12: whitening of embeddings from an exact integer scatter.

Each entry c of a vector becomes the integer x = floor(SCALE * c) + SHIFT. Tasks subtract SHIFT again and sum rows and their
cross-products exactly: entries are split into limbs of 20 bits, so that the products of up to 8,192 rows of two limbs are whole
numbers below 2**53 and a matrix product in doubles is exact; sums of them are Python integers of any length. A task
sends one row of the triangle for each dimension; they are added by dimension, so nothing that reaches a
task or the driver grows with the number of vectors, but only with their width. The driver then has n, S and X'X, forms n X'X - SS'
in integers, turns the entries into the nearest doubles of their quotients by n**2, and decomposes by eigh. A second pass projects
(n x - S) / n, whose numerators are exact, on the components and divides by the roots of their eigenvalues.

Vectors that are null or hold nulls or values that are not finite take no part; shorter vectors end in zeros. Null
and repeated ids are rows as others are. An eigenvalue of at most 1e-12 of their sum counts as none: its component has no whitened values (null)
and takes no part in the identity's error. Where no dimension varies, explained is null. An entry whose x leaves 2**62 raises an error.
A deviation that leaves 64 bits is null as a long and whole in deviation_exact. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .tiles import matrix

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Bits of a limb, and rows whose products of two limbs are summed in doubles: 2 * 20 + 13 = 53 bits.
LIMB, ROWS = 20, 8192
#: Share of the variance at which a component counts as having none.
NONE = 1e-12


def shifted(v: np.ndarray) -> np.ndarray:
    """x - SHIFT of entries, as 64-bit integers."""
    with np.errstate(over="ignore"):
        x = np.floor(v * SCALE)
    if len(x) and np.abs(x).max(initial=0) >= 2.0**62:
        raise ValueError("an entry is too large for 64-bit integers")
    return x.astype(np.int64)


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """y as a sum of limbs times 2**(LIMB * i), doubles below 2**LIMB in size."""
    out = []
    while True:
        if np.abs(y).max(initial=0) < 1 << LIMB:
            return [*out, y.astype(np.float64)]
        out.append((y & ((1 << LIMB) - 1)).astype(np.float64))
        y = y >> LIMB


def scatter(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, cross-products) of rows y, as Python integers of any length."""
    d = y.shape[1]
    total, cross = np.zeros(d, object), np.zeros((d, d), object)
    for a in range(0, len(y), ROWS):
        parts = limbs(y[a : a + ROWS])
        for i, p in enumerate(parts):
            total += p.sum(0).astype(np.int64).astype(object) << (LIMB * i)
            for j, q in enumerate(parts):
                cross += (p.T @ q).astype(np.int64).astype(object) << (LIMB * (i + j))
    return total, cross


def _grown(x: np.ndarray, d: int) -> np.ndarray:
    out = np.zeros((d,) * x.ndim, object)
    out[tuple(slice(0, n) for n in x.shape)] = x
    return out


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's count, and for each dimension its sum and its row of the triangle of cross-products."""
    n, total, cross = 0, np.zeros(0, object), np.zeros((0, 0), object)
    for b in batches:
        _, v = matrix(pa.array(np.zeros(b.num_rows)), b.column(0))
        s, c = scatter(shifted(v))
        d = max(len(s), len(total))
        n, total, cross = n + len(v), _grown(total, d) + _grown(s, d), _grown(cross, d) + _grown(c, d)
    if n:
        d = len(total)
        # the count goes as dimension -1
        columns = [pa.array(range(-1, d), pa.int64()), pa.array([n] + [0] * d, pa.int64()), pa.array(["0"] + [str(x) for x in total], pa.string()), pa.array([[]] + [[str(x) for x in cross[i, i:]] for i in range(d)], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, ["i", "n", "total", "products"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of the rows of each dimension."""
    held: dict[int, list] = {}
    for b in batches:
        for i, n, total, products in zip(*(c.to_pylist() for c in b.columns), strict=True):
            now = held.setdefault(i, [0, 0, []])
            now[0] += n
            now[1] += int(total)
            now[2] += [0] * (len(products) - len(now[2]))
            for j, x in enumerate(products):
                now[2][j] += int(x)
    columns = [pa.array(list(held), pa.int64()), pa.array([x[0] for x in held.values()], pa.int64()), pa.array([str(x[1]) for x in held.values()], pa.string()), pa.array([[str(p) for p in x[2]] for x in held.values()], pa.list_(pa.string()))]
    yield pa.RecordBatch.from_arrays(columns, ["i", "n", "total", "products"])


PARTS = "i long, n long, total string, products array<string>"


def exact_scatter(rows: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """(n, S, X'X) of shifted rows (v): a row of at most the vectors' width for each dimension comes to the driver."""
    parts = rows.select("v").mapInArrow(_partial, PARTS).repartition("i").mapInArrow(_added, PARTS).collect()
    parts.sort(key=lambda r: r["i"])
    n, parts = sum(r["n"] for r in parts), [r for r in parts if r["i"] >= 0]
    d = len(parts)
    cross = [[0] * d for _ in range(d)]
    for r in parts:
        for j, x in enumerate(r["products"]):
            cross[r["i"]][r["i"] + j] = cross[r["i"] + j][r["i"]] = int(x)
    return n, [int(r["total"]) for r in parts], cross


def principal(n: int, total: list[int], cross: list[list[int]], most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, components as columns, trace) of the covariance, by falling eigenvalue."""
    d = len(total)
    if not d:
        return np.zeros(0), np.zeros((0, 0)), 0.0
    # quotients of integers are correctly rounded
    v = np.array([[(n * cross[i][j] - total[i] * total[j]) / (n * n) for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(v)
    order = np.argsort(-e, kind="stable")[:most]
    e, u = e[order], u[:, order]
    sign = np.sign(u[np.abs(u).argmax(0), np.arange(u.shape[1])])
    return e, u * np.where(sign == 0, 1, sign), float(np.trace(v))


def centred(y: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n * y - S, exactly; Python integers where 64 bits might not do."""
    most = n * int(np.abs(y).max(initial=0)) + max((abs(x) for x in total), default=0)
    kind = np.int64 if most < 2**62 else object
    return y.astype(kind) * n - np.array(total, kind)


def deviations(c: np.ndarray) -> list[int]:
    """The sum of squares of each row, exactly."""
    if c.dtype != object and c.shape[1] * max(int(np.abs(c).max(initial=0)), 1) ** 2 < 2**63:
        return (c * c).sum(1).tolist()
    return [sum(int(x) ** 2 for x in row) for row in c]


def whiten(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, deviation_exact, whitened, explained, identity_error): a row for each vector and component; see above."""
    v = F.col(f"`{vector}`").cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(f"`{id}`").alias("id"), v.alias("v")).where("v is not null").where(~bad)
    n, total, cross = exact_scatter(rows)
    e, u, trace = principal(n, total, cross, most)
    varies = e > NONE * trace if trace > 0 else np.zeros(len(e), bool)
    scaled = u / np.sqrt(np.where(varies, e, 1))
    width = len(total)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, x = matrix(pa.array(np.zeros(b.num_rows)), b.column(1))
            c = centred(np.pad(shifted(x), ((0, 0), (0, width - x.shape[1]))), n, total)
            exact = deviations(c)
            w = (c / n).astype(np.float64) @ scaled
            w = [[float(a) if ok else None for a, ok in zip(r, varies, strict=True)] for r in w]
            columns = [b.column(0), pa.array([x if x < 2**63 else None for x in exact], pa.int64()), pa.array([str(x) for x in exact], pa.string()), pa.array(w, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "deviation", "deviation_exact", "w"])

    kind = dict(rows.dtypes)["id"]
    out = written(rows.mapInArrow(project, f"id {kind}, deviation long, deviation_exact string, w array<double>"), "whitened")
    real = [i for i in range(len(e)) if varies[i]]
    # covar_pop centres as it goes, by partial means
    pairs = [F.abs(F.covar_pop(F.col("w")[i], F.col("w")[j]) - float(i == j)) for i in real for j in real if i <= j]
    error = out.agg(F.greatest(*pairs, F.lit(0.0)).alias("error")).first()["error"] if pairs else None
    numbers = F.array(*[F.struct(F.lit(i + 1).alias("component"), F.col("w")[i].alias("whitened"), F.lit(float(x / trace) if trace > 0 else None).cast("double").alias("explained")) for i, x in enumerate(e)])
    if not len(e):
        numbers = F.lit(None).cast("array<struct<component int, whitened double, explained double>>")
    long = out.select("id", "deviation", "deviation_exact", F.explode(numbers).alias("x"))
    return long.select(F.col("id").alias(id), F.col("x.component").cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "deviation_exact", F.col("x.whitened").alias("whitened"), F.col("x.explained").alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finite vector of embeddings on the first 8 components. Nulls, ties, widths: as the module says."""
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op12_whitening": op12_whitening}
ORACLES: dict[str, str] = {}
