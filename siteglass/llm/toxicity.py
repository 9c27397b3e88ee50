"""Operator 3: toxicity by cumulative-link ordinal regression.

P(grade <= k) = sigmoid(theta_k - w.x): one weight vector is shared by all ordered thresholds theta. x marks
which of the chosen words, and beginnings of words, a text holds. The output is the expected severity, the sum over k of
P(grade >= k), with the likeliest grade; a text is toxic if P(grade >= 1) is a half or more.

Labels say only whether a text is toxic. Grade 0 is a clean text; toxic ones get grades 1 to 3 by thirds of
how toxic they look to log-odds of words counted in the other half of the labelled texts, so a text's grade says what texts
without it say about its words. Words are runs of letters, lower-cased. The model is fitted
on at most SAMPLE_ROWS labelled texts (those of the smallest hashes of their ids; of texts
whose word sets have the same four min-hashes, copies as a rule, one) and on the FEATURES words that tell the classes apart best in it; scoring covers every text.

A text that is null, empty or without known words gets the thresholds' own severity. Of several labels of
an id the highest counts; labels that are null or without a text are left out. Without any labels, or with
only one class, nothing is toxic. Extra columns pass through; columns named like a result are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, text_batches, trimmed, written

SAMPLE_ROWS = 20_000
FEATURES = 384
GRADES = 3
#: Texts whose words a worker holds at a time.
SET_ROWS = 32
#: Texts of the sample in which a word must be.
LEAST_TEXTS = 5
#: Lengths of the beginnings of words that are features like words.
BEGINNINGS = (4, 5, 6)
WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> set[str]:
    """The words of a text and the beginnings of its longer words, which are marked by a hyphen."""
    words = set(WORD.findall((text or "").lower()))
    return words.union(*[{w[:n] + "-" for w in words if len(w) > n} for n in BEGINNINGS])


@dataclass
class Model:
    words: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.full(GRADES, 20.0))

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1, a column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))

    def score(self, text: str | None) -> float:
        found = self.words.keys() & features(text)
        return float(self.weights[[self.words[w] for w in found]].sum()) if found else 0.0


def fit(row: np.ndarray, word: np.ndarray, grade: np.ndarray, n_words: int, rounds: int = 500, penalty: float = 2e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that minimise the ordinal loss with an L2 penalty, by Adam; (row, word) are the marks."""
    n, k = len(grade), GRADES
    weights = np.zeros(n_words)
    above = np.array([np.clip((grade >= j).mean(), 1e-3, 1 - 1e-3) for j in range(1, k + 1)])
    theta = np.log((1 - above) / above)
    free = np.concatenate([theta[:1], np.log(np.maximum(np.diff(theta), 1e-2))])
    m, v = np.zeros(n_words + k), np.zeros(n_words + k)
    for t in range(1, rounds + 1):
        theta = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
        eta = np.bincount(row, weights[word], minlength=n)
        p = 1 / (1 + np.exp(np.clip(eta[:, None] - theta[None, :], -60, 60)))  # P(grade < j)
        low = np.concatenate([np.zeros((n, 1)), p], 1)
        high = np.concatenate([p, np.ones((n, 1))], 1)
        r = np.arange(n)
        mass = np.maximum(high[r, grade] - low[r, grade], 1e-9)
        slope_low, slope_high = low * (1 - low), high * (1 - high)
        d_eta = (slope_high[r, grade] - slope_low[r, grade]) / mass / n
        d_theta = np.array([(-(slope_high[r, grade] * (grade == j)) + slope_low[r, grade] * (grade == j + 1)).__truediv__(mass).sum() / n for j in range(k)])
        tail = np.cumsum(d_theta[::-1])[::-1]
        g = np.concatenate([np.bincount(word, d_eta[row], minlength=n_words) + penalty * weights, tail[:1], tail[1:] * np.exp(free[1:])])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        weights, free = weights - step[:n_words], free - step[n_words:]
    return weights, np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))


def grades(row: np.ndarray, word: np.ndarray, bad: np.ndarray, half: np.ndarray, n_words: int) -> np.ndarray:
    """Grades of labelled texts: 0 for clean ones, and thirds of the toxic ones by how toxic a text looks to log-odds of words that are counted in the other half of the texts only."""
    score = np.zeros(len(bad))
    for own in (half, ~half):
        other = ~own
        in_bad, in_clean = (np.bincount(word[(other & side)[row]], minlength=n_words) + 0.5 for side in (bad, ~bad))
        odds = np.log(in_bad / ((other & bad).sum() + 1)) - np.log(in_clean / ((other & ~bad).sum() + 1))
        score[own] = np.bincount(row, odds[word], minlength=len(bad))[own]
    return np.where(bad, 1 + np.searchsorted(np.quantile(score[bad], [1 / 3, 2 / 3]), score, "left"), 0)


def _hashed(seed: int):
    return lambda word: F.xxhash64(word, F.lit(seed))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """The model for docs (doc_id, text) and labels (doc_id, toxic)."""
    text_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    sample = written(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows), "labels")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "text")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # words of a few texts at a time: as Python objects they are many times the texts
            for a in range(0, b.num_rows, SET_ROWS):
                some = b.slice(a, SET_ROWS)
                sets = [sorted(features(x.as_py())) for x in some.column(2)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(sets, pa.list_(pa.string()))], ["doc_id", "toxic", "words"])

    sets = texts.mapInArrow(trimmed(words), "doc_id long, toxic int, words array<string>")
    least = [F.array_min(F.transform("words", _hashed(seed))) for seed in range(4)]
    sets = written(sets.groupBy(F.xxhash64(*least).alias("key")).agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id"), F.min_by("words", F.struct("doc_id", "words")).alias("words")), "wordsets")
    size = sets.agg(F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") > 0)).first()
    clean, toxic = (int(x) for x in size)
    if not clean or not toxic:
        return Model()
    each = sets.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count_if(F.col("toxic") > 0).alias("t"), F.count_if(F.col("toxic") == 0).alias("c")).where(F.col("t") + F.col("c") >= LEAST_TEXTS)
    odds = F.log((F.col("t") + 0.5) / (toxic - F.col("t") + 0.5)) - F.log((F.col("c") + 0.5) / (clean - F.col("c") + 0.5))
    spread = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    chosen = each.withColumn("odds", odds).orderBy(F.desc(F.abs(odds / spread)), "word").limit(FEATURES).collect()  # at most FEATURES rows
    index = {r.word: i for i, r in enumerate(chosen)}

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(1).to_pylist()
            found = [[index[w] for w in x or [] if w in index] for x in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32())), b.column(2)], ["toxic", "found", "doc_id"])

    data = sets.select("toxic", "words", "doc_id").mapInArrow(trimmed(marks), "toxic int, found array<int>, doc_id long").sort("doc_id").toArrow()  # at most sample_rows rows of chosen words
    found = data["found"].combine_chunks()
    per_row = found.value_lengths().to_numpy(zero_copy_only=False)
    word = found.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(per_row)), per_row)
    bad = data["toxic"].to_numpy() > 0
    grade = grades(row, word, bad, data["doc_id"].to_numpy() % 2 == 0, len(index))
    weights, thresholds = fit(row, word, grade, len(index))
    return Model(index, weights, thresholds)


def severity(docs: DataFrame, model: Model) -> DataFrame:
    """docs with expected_severity, severity (the likeliest grade) and toxic."""
    text_batches(docs.sparkSession)
    new = [T.StructField("expected_severity", T.DoubleType()), T.StructField("severity", T.IntegerType()), T.StructField("toxic", T.BooleanType())]
    docs = docs.drop(*[f.name for f in new])
    names = docs.columns
    at = names.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = model.at_least(np.array([model.score(x.as_py()) for x in b.column(at)]))
            mass = -np.diff(np.concatenate([np.ones((len(p), 1)), p, np.zeros((len(p), 1))], 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p.sum(1)), pa.array(mass.argmax(1), pa.int32()), pa.array(p[:, 0] >= 0.5)], [*names, *[f.name for f in new]])

    return docs.mapInArrow(trimmed(work), T.StructType([*docs.schema.fields, *new]))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return severity(docs, train(docs, table(spark, sf_dir, "labels"))).drop("text")


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLES: dict[str, str] = {}
