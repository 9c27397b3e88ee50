"""Operators 11, 12 and 13 against plain versions, on the given tables and on odd inputs."""

import hashlib
import math
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteglass.llm import importance, line_dedup, whitening

from .helpers import DOCS, SF, long_text, no_docs, odd_docs

BLANKS = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_lines(rows, min_docs=3, least=20):
    """[(id, n_lines, n_dropped, kept)] of rows (id, text)."""
    ids = {}
    below = -(2**63)
    for i, text in rows:
        for line in (text or "").split("\n"):
            k = lower(line.strip(BLANKS))
            if len(k) >= least:
                ids.setdefault(k, set()).add(below if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stays = []
        for line in lines:
            held = ids.get(lower(line.strip(BLANKS)), ())
            if len(held) < min_docs or max(held) == (below if i is None else i):
                stays.append(line)
        out.append((i, len(lines), len(lines) - len(stays), "\n".join(stays)))
    return out


def lined_docs(spark):
    """Lines that documents share, at other cases and blanks, in one document twice, of 19 and 20 code points, and in rows that repeat."""
    a, b, c = "A line that is shared by all", "Grüße an die ganze weite Welt", "exactly 19 letters "
    rows = []
    for i in range(40):
        rows.append((i, f"  {a.upper()}\t\nown line of document number {i}\n{a if i % 2 else b}\n{c.strip()}x\n{c}\n\n"))
    rows += [(None, a + "\n" + "null id, unshared line of its own"), (39, a), (39, a), (7, None), (8, ""), (9, "twice in two documents only"), (10, "twice in two documents only"), (11, "x" * 20), (12, "X" * 20), (13, "\t" + "x" * 20 + "\r"), (14, "é" * 19), (15, "é" * 19), (16, "é" * 19), (17, "é" * 20), (18, "é" * 20), (19, "é" * 20), (50, long_text(30_000) + "\n" + a)]
    full = [(i, t, None, None, None, "1", None, "h", 1, "t", None, "k", "c") for i, t in rows]
    return spark.createDataFrame(full, DOCS)


@pytest.mark.parametrize("most", [{}, {"block_bytes": 400, "shard_rows": 10}])
def test_lines_agree_with_plain_loops(spark, most):
    for docs in (lined_docs(spark), odd_docs(spark)):
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        out = line_dedup.drop_lines(docs.repartition(5), **most)
        assert set(docs.columns) - {"kept"} <= set(out.columns)
        got = sorted((repr(tuple(r)) for r in out.select("doc_id", "n_lines", "n_dropped", "kept").collect()))
        assert got == sorted(map(repr, plain_lines(rows)))
    assert line_dedup.drop_lines(no_docs(spark), **most).count() == 0


def test_lines_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = {i: (n, k, hashlib.sha256(kept.encode()).hexdigest()) for i, n, k, kept in plain_lines(rows)}
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in line_dedup.op11_line_dedup(spark, SF).collect()}
    assert got == want and any(x[1] for x in got.values())


def test_a_perfect_hash_gives_each_key_its_own_place():
    rng = np.random.default_rng(5)
    h1, h2 = rng.integers(0, 2**64, (2, 20_000), dtype=np.uint64)
    h1[:50] = h1[50:100]  # the second halves tell them apart
    sizes, words, order = line_dedup.perfect(h1, h2)
    assert sorted(order.tolist()) == list(range(len(h1)))
    assert int(np.bitwise_count(words).sum()) == len(h1)
    assert sum(sizes) < 5 * len(h1)
    row = {"shard": 0, "levels": sizes, "bits": words.tobytes(), "fingerprints": h2[order].tobytes(), "counts": np.full(len(h1), 3, np.uint8).tobytes(), "keepers": order.astype(np.int64).tobytes()}
    arrays = line_dedup.Arrays([row], 1)
    count, keeper = arrays.probe(h1, h2)
    assert (count == 3).all() and (keeper == np.arange(len(h1))).all()
    count, _ = arrays.probe(*rng.integers(0, 2**64, (2, 50_000), dtype=np.uint64))
    assert not count.any()


def test_a_line_of_all_documents_is_a_few_rows_a_task(spark):
    docs = spark.range(20_000).select(F.col("id").alias("id"), F.lit("one line that every document holds").alias("text")).repartition(4)
    sent = docs.mapInArrow(line_dedup._hashes(3, 20), "h1 long, h2 long, doc long")
    assert sent.count() <= 4 * 3


def plain_whitening(vectors):
    """(n, deviations, eigenvalues, trace) with fractions."""
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    cov = [[Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x), n**3) for j in range(d)] for i in range(d)]
    dev = [sum((n * r[i] - s[i]) ** 2 for i in range(d)) for r in x]
    return n, dev, np.linalg.eigvalsh(np.array(cov, float))[::-1], float(sum(cov[i][i] for i in range(d)))


def test_whitening_agrees_with_fractions(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 5)) @ np.diag([9, 4, 1, 0.5, 0.1])
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(None, base[0].tolist()), (3, base[3].tolist())]
    bad = [(90, None), (91, [1.0, None, 0, 0, 0]), (92, [float("nan"), 0, 0, 0, 0]), (93, [0, 0, float("inf"), 0, 0])]
    df = spark.createDataFrame([(i, v if v is None else [None if c is None else float(c) for c in v], "w", 1.0) for i, v in rows + bad], "vec_id long, embedding array<double>, w string, n double")
    got = whitening.whiten(df.repartition(7)).collect()
    n, dev, e, trace = plain_whitening([v for _, v in rows])
    assert len(got) == 5 * n and {r["n"] for r in got} == {n}
    assert sorted(r["deviation"] for r in got if r["component"] == 1) == sorted(dev)
    assert all(r["deviation"] == int(r["deviation_exact"]) for r in got)
    for r in got:
        assert abs(r["explained"] - e[r["component"] - 1] / trace) < 1e-9 and r["identity_error"] < 1e-9
    w = {}
    for r in got:
        w.setdefault(r["vec_id"], []).append((r["component"], r["whitened"]))
    assert sorted(w[3])[0] == sorted(w[3])[1]
    own = np.array([[r["whitened"] for r in sorted(got, key=lambda r: r["component"]) if r["vec_id"] == i] for i in (0, 1) if i == 1])
    x = np.floor(1024 * base)
    x = np.vstack([x, x[0], x[3]])
    lam, u = np.linalg.eigh(np.cov(x.T, bias=True))
    want = ((x[1] - x.mean(0)) @ u / np.sqrt(lam))[::-1]
    assert np.allclose(np.abs(own[0]), np.abs(want), rtol=1e-6)


def test_whitening_sums_beyond_64_bits_and_what_does_not_vary(spark):
    big = [[2.0**40, 1.0], [-(2.0**40), 1.0], [3.5, 1.0], [2.0**39 + 1, 1.0]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(big)], "vec_id long, embedding array<double>")
    got = whitening.whiten(df).collect()
    _, dev, _, _ = plain_whitening(big)
    assert sorted({int(r["deviation_exact"]) for r in got}) == sorted(set(dev)) and any(r["deviation"] is None for r in got)
    assert [r["whitened"] for r in got if r["component"] == 2] == [None] * 4
    n, s, m = whitening.exact_scatter(df.select(F.col("embedding").alias("v")).repartition(3))
    x = [[math.floor(1024 * c) for c in v] for v in big]
    assert (n, s) == (4, [sum(r[i] for r in x) for i in range(2)])
    assert m == [[sum(r[i] * r[j] for r in x) for j in range(2)] for i in range(2)]
    same = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert {(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in same} == {(None, None, None, 0)}
    short = whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [0.5, 2.0]), (3, [])], "vec_id long, embedding array<double>")).collect()
    assert len(short) == 6 and short[0]["n"] == 3
    assert whitening.whiten(spark.createDataFrame([(1, [])], "vec_id long, embedding array<double>")).count() == 0
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(spark.createDataFrame([(1, [1e300])], "vec_id long, embedding array<double>")).count()


def test_whitening_of_the_table(spark):
    rows = [r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = whitening.op12_whitening(spark, SF).collect()
    x = np.floor(1024 * np.array(rows, float))
    e = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert len(got) == 8 * len(rows)
    for r in got:
        assert abs(r["explained"] / (e[r["component"] - 1] / e.sum()) - 1) < 1e-6 and r["identity_error"] < 1e-4


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text):
    w = WORD.findall(lower(text or ""))
    return len(w), [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plain_draw(rows, target, percent=5, least=20, buckets=10_000):
    """{(id, row): (n_features, weight, score, rank)} of rows (id, text)."""
    own, source, aim = [], [0] * buckets, [0] * buckets
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    for _, text in rows:
        n, found = plain_features(text)
        own.append((n, [bucket(f) for f in found]))
        for b in own[-1][1]:
            source[b] += 1
    for text in target:
        for f in plain_features(text)[1]:
            aim[bucket(f)] += 1
    s, t = sum(source), sum(aim)
    gain = [math.floor(1000 * math.log((y + 1) * (s + buckets) / ((x + 1) * (t + buckets)))) for x, y in zip(source, aim, strict=True)]
    out = []
    for (i, _), (n, found) in zip(rows, own, strict=True):
        weight = sum(gain[b] for b in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((n, i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    ranked = sorted((-o[4], o[1] is None, o[1] or 0, k) for k, o in enumerate(out) if o[0] >= least)
    rank = {x[3]: r + 1 for r, x in enumerate(ranked[: percent * len(ranked) // 100])}
    return sorted(repr((o[1], *o[2:], rank.get(k))) for k, o in enumerate(out))


@pytest.mark.parametrize("most", [{}, {"run_rows": 7, "range_rows": 5}])
def test_draw_of_the_table(spark, most):
    docs, target = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = plain_draw(rows, [r["text"] for r in target.collect()])
    got = importance.resample(docs.repartition(6), target, **most) if most else importance.op13_importance(spark, SF)
    assert sorted(repr(tuple(r)) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()) == want
    assert any(not x.endswith("None)") for x in want)


@pytest.mark.parametrize("percent", [0, 5, 50, 100])
def test_draw_of_odd_inputs(spark, percent):
    docs = odd_docs(spark).unionByName(odd_docs(spark)).withColumn("text", F.when(F.col("doc_id") == 4, F.repeat(F.lit("Zoë's 2nd-word {x} `q` "), 12)).otherwise(F.col("text")))
    long = [(70 + k, ("w" * n + " ") * 30) for k, n in enumerate((47, 48, 49, 300))]
    docs = docs.unionByName(spark.createDataFrame([(i, t, None, None, None, "1", None, "h", 1, "t", None, "k", "c") for i, t in long], DOCS))
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    target = spark.createDataFrame([(1, "one two three"), (2, None), (3, "")], "item_id long, text string")
    out = importance.resample(docs.coalesce(1), target, percent=percent, range_rows=3, run_rows=4)
    assert set(docs.columns) - {"text"} <= set(out.columns)
    # rows that repeat are alike, so their ranks are compared as a set
    assert sorted(repr(tuple(r)) for r in out.select("doc_id", "n_features", "weight", "score", "rank").collect()) == plain_draw(rows, ["one two three", None, ""], percent)
    assert importance.resample(no_docs(spark), target).count() == 0
    assert importance.resample(docs, target.where("false")).count() == len(rows)


def test_a_tree_of_losers_merges():
    import random

    r = random.Random(2)
    for k in (0, 1, 2, 3, 7, 8):
        runs = [sorted((r.randint(0, 9), j) for j in range(r.randint(0, 20))) for _ in range(k)]
        assert list(importance.Losers([iter(x) for x in runs])) == sorted(x for run in runs for x in run)
