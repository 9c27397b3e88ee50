"""Operator 8: language-model scores from a causal self-attention model trained in numpy.

Like the base score, the model sees a text as its words, lower-cased in A-Z; white space and capitals are
not scored. Words become subword ids of a public vocabulary, by its own library. The most frequent ids of the training texts have
slots of their own, in CLUSTERS clusters; all others share the last slot, within which an id has its
smoothed frequency. A window of SCORED positions, preceded by up to SEEN earlier ones, attends
causally with one head and a bias for each distance; the window's own positions are scored, so windows
overlap and every token is scored once. Before a text stands a beginning, after it an end, which is scored.
A slot's probability is that of its cluster times that of the slot in the cluster, both from what attention finds.
Counted frequencies of all training texts, summed by a shuffle, are only where the output's biases begin.

The model is fitted by rounds of local steps: a hash deals all windows of all training texts, of any
length, to ROUNDS rounds and, in each, to parts of about PART_WINDOWS windows; every part makes a pass of Adam steps (over few windows, more passes) from the round's common parameters, and the round
ends with the mean of what its parts found. Parts grow in number with the input, and the driver holds arrays of the model's size only.
Word counts for the base score cover all training texts too: tasks count words by 64-bit hash, the counts are summed by a
shuffle, and a word's count is looked up in a bounded table of the most frequent words or, for all others, by a shuffled join.

Equal texts are tokenised and scored once, and counted as often as they occur. A null or empty text has one token, the
end. A null id is in the training part. Rows with the same id are scored one by one. Without training texts the base
score is 0 for each token and the model is untrained. An empty table gives no rows; other columns of the input are left out.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checked_broadcast, table, text_batches, written
from .sentencepiece_bpe import model_path, vocabulary
from .wordhash import U, mix, text_slices, word_spans, words

HEAD, CLUSTERS = 1023, 32
WIDTH, SEEN, SCORED = 32, 6, 18
BATCH, RATE = 256, 0.01
#: Of the fit: rounds, windows of a part, tasks that take the mean, and the least steps of a part, which passes over few windows again.
ROUNDS, PART_WINDOWS, MEAN_TASKS, LEAST_STEPS = 5, 64_000, 4, 200
#: Words in the table that every task holds.
FREQUENT_WORDS = 400_000
SLOTS = HEAD + 1
PER = SLOTS // CLUSTERS
BEGIN, END = SLOTS, SLOTS - 2
#: Words whose ids a worker remembers.
REMEMBERED = 400_000

_ids: dict[bytes, bytes] = {}


@functools.cache
def _encoder(path: str | None) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path or model_path())


def _ids_of_words(words_: list[bytes], path: str | None) -> list[bytes]:
    """Ids of lower-cased words, each with a space before it; a word that the vocabulary's normaliser leaves nothing of is one unknown."""
    found = [_ids.get(w) for w in words_]
    new = [i for i, f in enumerate(found) if f is None]
    if new:
        encoder = _encoder(path)
        if len(_ids) + len(new) >= REMEMBERED:
            _ids.clear()
        for i, ids in zip(new, encoder.encode([words_[i].decode() for i in new]), strict=True):
            found[i] = np.array(ids or [encoder.unk_id()], np.uint16).tobytes()
            if len(found[i]) <= 64:
                _ids[words_[i]] = found[i]
    return found


def token_ids(text: str, path: str | None = None) -> np.ndarray:
    """Ids of a text's words, lower-cased in A-Z, with a space before each."""
    return np.frombuffer(b"".join(_ids_of_words(text.encode().lower().split(), path)), np.uint16)


def batch_ids(texts: pa.Array, path: str | None = None) -> list[bytes]:
    """The ids of each text, as token_ids gives them; of the words of a slice each different one is looked up once."""
    out: list[bytes] = []
    for x, y, data, off in text_slices(texts):
        row, begin, end, h = word_spans(data, off)
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        raw = data.tobytes()
        found = _ids_of_words([raw[a:b].lower() for a, b in zip(begin[first].tolist(), end[first].tolist(), strict=True)], path)
        length = np.array([len(f) // 2 for f in found], np.int64)
        start = np.cumsum(length) - length
        n = length[which]
        at = np.repeat(start[which], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        ids = np.frombuffer(b"".join(found), np.uint16)[at]
        edge = np.concatenate([[0], np.cumsum(np.bincount(row, n, minlength=y - x).astype(np.int64))]).tolist()
        out += [ids[i:j].tobytes() for i, j in zip(edge, edge[1:], strict=False)]
    return out


#: Scores are held below this, so that their exponentials are finite.
LARGE = np.float32(60)


def _ones(n: int) -> np.ndarray:
    return np.ones(n, np.float32)


def _added_up(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The sums of the rows that go to each of n places."""
    order = np.argsort(at.astype(np.uint16), kind="stable")
    own = at[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    out = np.zeros((n, rows.shape[1]), np.float32)
    out[own[first]] = np.add.reduceat(rows.take(order, 0), first, axis=0)
    return out


def _softmax(h: np.ndarray, weights: np.ndarray, bias: np.ndarray, wanted: np.ndarray, row: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, float]:
    """(gradient of the loss in the scores, loss) of a softmax over h @ weights + bias that should give what is wanted, at rows that are ok."""
    z = h @ weights
    z += bias
    np.exp(np.minimum(z, LARGE, out=z), out=z)
    z /= (z @ _ones(z.shape[1]))[:, None]
    loss = -(ok @ np.log(z[row, wanted] + 1e-30))
    z[row, wanted] -= 1
    z *= ok[:, None]
    return z, loss


class Attention:
    """The parameters, and what is derived from them for scoring."""

    def __init__(self, slot_of: np.ndarray, tail: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        r = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        self.slot_of, self.tail = slot_of, tail  # slot of each id; natural log of an id's share of the last slot, else 0
        self.fitted_windows = 0  # how many windows the rounds of the fit have taken
        self.p = {"e": r(SLOTS + 2, WIDTH), "q": r(WIDTH, WIDTH), "k": r(WIDTH, WIDTH), "v": r(WIDTH, WIDTH), "near": np.zeros(SEEN + SCORED, np.float32), "c": r(WIDTH, CLUSTERS), "cb": np.zeros(CLUSTERS, np.float32), "w": r(CLUSTERS, WIDTH, PER), "wb": np.zeros((CLUSTERS, PER), np.float32)}
        at = np.arange(SEEN + SCORED)
        self.distance = (np.arange(SCORED) + SEEN)[:, None] - at[None, :]
        self.mask = np.where(self.distance < 0, np.float32(-1e9), np.float32(0))
        self.distance = np.maximum(self.distance, 0)

    def inputs(self, slots: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slots before each scored one, scored slots) of windows at starts; slots has SEEN + 1 entries before each text."""
        return slots[starts[:, None] + np.arange(SEEN + SCORED)], slots[starts[:, None] + SEEN + 1 + np.arange(SCORED)]

    def set_biases(self, count: np.ndarray) -> None:
        """Begin with the frequencies of the slots."""
        share = (count + 0.5).reshape(CLUSTERS, PER)
        cluster = share.sum(1)
        self.p["cb"] = np.log(cluster / cluster.sum()).astype(np.float32)
        self.p["wb"] = np.log(share / cluster[:, None]).astype(np.float32)

    def prepare(self) -> None:
        p = self.p
        self.eq, self.ek, self.ev = p["e"] @ p["q"] / np.float32(WIDTH**0.5), p["e"] @ p["k"], p["e"] @ p["v"]
        self.bias = (p["near"][self.distance] + self.mask).astype(np.float32)

    def hidden(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pad = np.where(x == SLOTS + 1, np.float32(-1e9), np.float32(0))[:, None, :]
        late = x[:, SEEN:]
        a = self.eq.take(late, 0) @ self.ek.take(x, 0).transpose(0, 2, 1)
        a += self.bias
        if pad.any():
            a += pad
        np.exp(np.minimum(a, LARGE, out=a), out=a)
        a /= (a @ _ones(a.shape[2]))[:, :, None] + np.float32(1e-30)
        h = a @ self.ev.take(x, 0)
        h += self.p["e"].take(late, 0)
        return a, h

    def log_probability(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each slot of y, in windows."""
        p = self.p
        h = self.hidden(x)[1].reshape(-1, WIDTH)
        y = y.ravel()
        cluster, inside = y // PER, y % PER
        row = np.arange(len(y))
        z = h @ p["c"]
        z += p["cb"]
        np.minimum(z, LARGE, out=z)
        out = z[row, cluster]
        out -= np.log(np.exp(z, out=z) @ _ones(CLUSTERS))
        order = np.argsort(cluster.astype(np.uint8), kind="stable")
        ends = np.searchsorted(cluster[order], np.arange(CLUSTERS + 1))
        for c in range(CLUSTERS):
            rows = order[ends[c] : ends[c + 1]]
            if len(rows):
                z = h[rows] @ p["w"][c]
                z += p["wb"][c]
                np.minimum(z, LARGE, out=z)
                own = z[np.arange(len(rows)), inside[rows]]
                out[rows] += own - np.log(np.exp(z, out=z) @ _ones(PER))
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray, ok: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
        """(mean loss, its gradients) over the positions of y, or those that are ok."""
        ok = np.ones(y.size, np.float32) if ok is None else ok.ravel().astype(np.float32)
        p, n = self.p, max(1.0, float(ok.sum()))
        g = {k: np.zeros_like(v) for k, v in p.items()}
        self.prepare()
        a, h3 = self.hidden(x)
        y = y.ravel()
        cluster = y // PER
        # positions in the order of their clusters, so that a cluster's are a slice
        order = np.argsort(cluster.astype(np.uint8), kind="stable")
        h, ok, cluster, inside, row = h3.reshape(-1, WIDTH)[order], ok[order], cluster[order], y[order] % PER, np.arange(y.size)
        ends = np.searchsorted(cluster, np.arange(CLUSTERS + 1)).tolist()
        z, loss = _softmax(h, p["c"], p["cb"], cluster, row, ok)
        g["c"], g["cb"] = h.T @ z, _ones(len(z)) @ z
        dh = z @ p["c"].T
        for c, (i, j) in enumerate(zip(ends, ends[1:], strict=False)):
            if i < j:
                z, more = _softmax(h[i:j], p["w"][c], p["wb"][c], inside[i:j], row[: j - i], ok[i:j])
                loss += more
                g["w"][c], g["wb"][c] = h[i:j].T @ z, _ones(j - i) @ z
                dh[i:j] += z @ p["w"][c].T
        back = np.empty_like(dh)
        back[order] = dh
        dh = back.reshape(h3.shape)
        late, s = x[:, SEEN:], np.float32(WIDTH**0.5)
        xk, xv, xq = self.ek.take(x, 0), self.ev.take(x, 0), self.eq.take(late, 0)
        dv = (a.transpose(0, 2, 1) @ dh).reshape(-1, WIDTH)
        da = dh @ xv.transpose(0, 2, 1)
        da -= (da * a) @ _ones(a.shape[2])[:, None]
        da *= a
        np.add.at(g["near"], self.distance, da.sum(0))
        dq, dk = (da @ xk).reshape(-1, WIDTH), (da.transpose(0, 2, 1) @ xq).reshape(-1, WIDTH)
        each, before = p["e"].take(x.ravel(), 0), p["e"].take(late.ravel(), 0)
        g["q"], g["k"], g["v"] = before.T @ dq / s, each.T @ dk, each.T @ dv
        de = (dk @ p["k"].T + dv @ p["v"].T).reshape(*x.shape, WIDTH)
        de[:, SEEN:] += dh
        de[:, SEEN:] += (dq @ (p["q"].T / s)).reshape(dh.shape)
        g["e"] = _added_up(x.ravel(), de.reshape(-1, WIDTH), len(p["e"]))
        return float(loss) / n, {k: v / np.float32(n) for k, v in g.items()}

    def sequence(self, texts_ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(slots, window starts, text of each window, scored positions in each window) of texts laid one after another."""
        step = SEEN + 1
        counts = np.array([len(t) + 1 for t in texts_ids])  # with the end
        windows = -(-counts // SCORED)
        span = step + windows * SCORED
        at = np.concatenate([[0], np.cumsum(span)])
        slots = np.full(at[-1] + SCORED, SLOTS + 1, np.int32)
        for t, a in zip(texts_ids, at, strict=False):
            slots[a + SEEN] = BEGIN
            slots[a + step : a + step + len(t)] = self.slot_of[t]
            slots[a + step + len(t)] = END
        text = np.repeat(np.arange(len(texts_ids)), windows)
        nth = np.arange(len(text)) - np.repeat(np.concatenate([[0], np.cumsum(windows)])[:-1], windows)
        return slots, at[text] + nth * SCORED, text, np.minimum(SCORED, counts[text] - nth * SCORED)

    def score(self, texts_ids: list[np.ndarray]) -> np.ndarray:
        """log10 of the probability of each text."""
        total = np.array([self.tail[t].sum() for t in texts_ids], np.float64)
        slots, starts, text, valid = self.sequence(texts_ids)
        for i in range(0, len(starts), 2048):
            x, y = self.inputs(slots, starts[i : i + 2048])
            ok = np.arange(SCORED) < valid[i : i + 2048, None]
            lp = self.log_probability(x, np.where(ok, y, 0)).reshape(ok.shape)
            total += np.bincount(text[i : i + 2048], np.where(ok, lp, 0).sum(1), minlength=len(total))
        return total / np.log(10)


class Adam:
    def __init__(self, m: Attention):
        self.m, self.t = m, 0
        self.first = {k: np.zeros_like(v) for k, v in m.p.items()}
        self.second = {k: np.zeros_like(v) for k, v in m.p.items()}

    def step(self, g: dict[str, np.ndarray], rate: float) -> None:
        self.t += 1
        for k, v in g.items():
            self.first[k] = 0.9 * self.first[k] + 0.1 * v
            self.second[k] = 0.98 * self.second[k] + 0.02 * v * v
            self.m.p[k] = (self.m.p[k] - rate * (self.first[k] / (1 - 0.9**self.t)) / (np.sqrt(self.second[k] / (1 - 0.98**self.t)) + 1e-8)).astype(np.float32)


def untrained(count: np.ndarray) -> Attention:
    """A model whose slots follow from how often each id occurs."""
    order = np.argsort(-count, kind="stable")
    slot_of = np.full(len(count), SLOTS - 1, np.int32)
    head = order[: HEAD - 1]
    slot_of[head] = np.arange(len(head))  # neighbours in frequency share a cluster; the end has slot SLOTS - 2
    rest = slot_of == SLOTS - 1
    share = (count + 0.5) * rest
    tail = np.where(rest, np.log(np.maximum(share, 1e-9) / max(share.sum(), 1e-9)), 0.0)
    return Attention(slot_of, tail)


def pass_over(m: Attention, windows: np.ndarray, seed: int, begun: float, ended: float, batch: int = BATCH, least: int = LEAST_STEPS) -> None:
    """Adam steps over windows (slots, then the number of scored positions), in the time from begun to ended of the whole fit."""
    rng = np.random.default_rng(seed)
    order = np.concatenate([rng.permutation(len(windows)) for _ in range(max(1, -(-least * batch // len(windows))))])
    adam, wide = Adam(m), SEEN + SCORED + 1
    steps = -(-len(order) // batch)
    for t in range(steps):
        w = windows[order[t * batch : (t + 1) * batch]].astype(np.int64)
        ok = np.arange(SCORED) < w[:, wide, None]
        at = begun + (ended - begun) * t / steps
        adam.step(m.gradients(w[:, : wide - 1], np.where(ok, w[:, SEEN + 1 : wide], 0), ok)[1], RATE * min(1, (t + 1) / 20) * (1 - 0.9 * at) * len(w) / batch)


def train(texts_ids: list[np.ndarray], n_ids: int, steps: int = 1000, batch: int = BATCH, seed: int = 7) -> Attention:
    """The model of a few texts, without Spark."""
    count = np.bincount(np.concatenate([np.zeros(0, np.int64), *texts_ids]).astype(np.int64), minlength=n_ids)
    m = untrained(count)
    slots = np.bincount(m.slot_of, count, minlength=SLOTS)
    slots[END] = len(texts_ids)
    m.set_biases(slots)
    if texts_ids:
        slots, starts, _, valid = m.sequence(texts_ids)
        at = np.random.default_rng(seed).integers(0, len(starts), steps * batch)
        wide = np.arange(SEEN + SCORED + 1)
        pass_over(m, np.concatenate([slots[starts[at, None] + wide], valid[at, None]], axis=1), seed, 0, 1, batch, 1)
    m.prepare()
    return m


def _ids_of(column: pa.Array, times: np.ndarray | None = None) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """The ids of texts, in lists of bounded size or of one text, and the number of each text."""
    held: list[np.ndarray] = []
    size, done = 0, 0
    times = np.ones(len(column), np.int64) if times is None else times
    for raw in column.to_pylist():
        held.append(np.frombuffer(raw, np.uint16))
        size += len(held[-1])
        if size > 250_000:
            yield held, times[done : done + len(held)]
            done += len(held)
            held, size = [], 0
    if held:
        yield held, times[done:]


def _summed(texts: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in texts (ids, times), and at last how many texts there are."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, np.int64)
        for b in batches:
            for ids, times in _ids_of(b.column(0), b.column(1).to_numpy(zero_copy_only=False)):
                total[:size] += np.bincount(np.concatenate(ids).astype(np.int64), np.repeat(times, [len(t) for t in ids]), minlength=size).astype(np.int64)
                total[size] += times.sum()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    rows = texts.select("ids", "times").mapInArrow(work, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size + 1, np.int64)
    out[rows["at"].to_numpy()] = rows["n"].to_numpy()
    return out


def fitted(texts: DataFrame, n_ids: int, rounds: int = ROUNDS, part_windows: int = PART_WINDOWS) -> Attention:
    """The model of all texts (copy, ids, times): frequencies of all of them, and passes over all their windows, each window in one round."""
    spark = texts.sparkSession
    count = _summed(texts, n_ids)
    m = untrained(count[:-1])
    slots = np.bincount(m.slot_of, count[:-1], minlength=SLOTS)
    slots[END] = count[-1]
    m.set_biases(slots)
    windows = texts.agg(F.sum(F.ceil((F.octet_length("ids") / 2 + 1) / SCORED))).first()[0]
    if not windows:
        m.prepare()
        return m
    layout = spark.sparkContext.broadcast(m)
    parts, wide = max(1, round(windows / rounds / part_windows)), SEEN + SCORED + 1
    names = list(m.p)

    for t in range(rounds):
        params = spark.sparkContext.broadcast(m.p)

        def deal(batches: Iterator[pa.RecordBatch], t=t) -> Iterator[pa.RecordBatch]:
            for b in batches:
                copies, done = b.column(0).to_numpy(zero_copy_only=False).view(U), 0
                for ids, _ in _ids_of(b.column(1)):
                    slots, starts, text, valid = layout.value.sequence(ids)
                    nth = np.arange(len(text)) - np.searchsorted(text, text)
                    h = mix(copies[done + text] + mix(nth.astype(U) + U(1)))
                    done += len(ids)
                    own = np.flatnonzero((h >> U(32)) % U(rounds) == t)
                    part = (h[own] & U(2**32 - 1)) % U(parts)
                    order = np.argsort(part, kind="stable")
                    own, part = own[order], part[order].astype(np.int32)
                    edge = np.flatnonzero(np.diff(part, prepend=-1, append=parts)).astype(np.int32)
                    x = slots[starts[own, None] + np.arange(wide)].astype(np.int16)
                    raw = np.concatenate([x, valid[own, None].astype(np.int16)], axis=1)
                    lists = pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer(edge * np.int32(2 * wide + 2)), pa.py_buffer(raw.tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(part[edge[:-1]]), lists], ["part", "windows"])

        def steps(batches: Iterator[pa.RecordBatch], params=params, t=t) -> Iterator[pa.RecordBatch]:
            held: dict[int, list[bytes]] = {}
            for b in batches:
                for k, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    held.setdefault(k, []).append(w)
            for k in sorted(held):
                w = np.frombuffer(b"".join(sorted(held[k])), np.int16).reshape(-1, wide + 1)
                own = layout.value
                own.p = dict(params.value)
                pass_over(own, w, k, t / rounds, (t + 1) / rounds)
                sums = np.concatenate([own.p[x].ravel() for x in names]).astype(np.float64) * len(w)
                yield pa.RecordBatch.from_arrays([pa.array([len(w)], pa.int64()), pa.array([sums.tobytes()], pa.binary())], ["n", "sums"])

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = 0, 0.0
            for b in batches:
                for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    n, total = n + i, total + np.frombuffer(raw)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["n", "sums"])

        kind = "n long, sums binary"
        own = texts.select("copy", "ids").mapInArrow(deal, "part int, windows binary").repartition(parts, "part")
        rows = own.mapInArrow(steps, kind).repartition(MEAN_TASKS).mapInArrow(added, kind).collect()  # at most MEAN_TASKS rows
        params.destroy()
        if not rows:
            continue
        n = sum(r.n for r in rows)
        mean = sum(np.frombuffer(bytes(r.sums)) for r in sorted(rows)) / n
        m.fitted_windows += n
        at = 0
        for k in names:
            m.p[k] = mean[at : at + m.p[k].size].reshape(m.p[k].shape).astype(np.float32)
            at += m.p[k].size
    layout.unpersist()
    m.prepare()
    return m


class CountTable:
    """Counts of hashes: a direct-mapped table, and a sorted one for what it has no room for."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray, bits: int = 22):
        self.mask = U((1 << bits) - 1)
        self.key, self.value = np.zeros(1 << bits, U), np.zeros(1 << bits, np.float64)
        slot = hashes & self.mask
        self.key[slot], self.value[slot] = hashes, values
        out = np.flatnonzero(self.key[slot] != hashes)
        out = out[np.argsort(hashes[out])]
        self.more, self.more_values = hashes[out], values[out]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, value)"""
        slot = h & self.mask
        ok, value = self.key[slot] == h, self.value[slot]
        if len(self.more):
            lost = np.flatnonzero(~ok)
            at = np.minimum(np.searchsorted(self.more, h[lost]), len(self.more) - 1)
            hit = self.more[at] == h[lost]
            ok[lost[hit]], value[lost[hit]] = True, self.more_values[at[hit]]
        return ok, value


_tables: dict[str, CountTable] = {}


def word_counts(texts: DataFrame) -> DataFrame:
    """(hash, n) of the words of texts (text, times)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def summed() -> pa.RecordBatch:
            h, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            n = np.bincount(at, np.concatenate([y for _, y in held]), minlength=len(h))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["hash", "n"])

        for b in batches:
            times = b.column(1).to_numpy(zero_copy_only=False)
            for x, y, data, off in text_slices(b.column(0)):
                row, w = words(data, off)
                held.append((w, times[x:y][row]))
                size += len(w)
                if size > 5_000_000:
                    yield summed()
                    size = 0
        if size:
            yield summed()

    return texts.select("text", "times").mapInArrow(work, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def distinct_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (doc_id, held_out, copy, other) of docs (doc_id, text, held_out), and (copy, other, text, times) of each different text, times of them in training rows."""
    docs = docs.withColumns({"copy": F.xxhash64("text"), "other": F.xxhash64("text", F.lit(1))})
    rows = written(docs.select("doc_id", "held_out", "copy", "other"), "rows")
    named = F.coalesce("doc_id", F.lit(-(2**63)))
    ids = rows.groupBy("copy", "other", named.alias("id")).agg(F.count("*").alias("n"), F.count_if(~F.col("held_out")).alias("times"))
    first = ids.groupBy("copy", "other").agg(F.min("id").alias("id"), F.min_by("n", "id").alias("n"), F.sum("times").alias("times"))
    first = written(first, "first")
    texts = docs.withColumn("id", named).join(checked_broadcast(first), ["copy", "other", "id"]).select("copy", "other", "text", "times")
    return rows, texts.dropDuplicates(["copy", "other"]) if first.where("n > 1").limit(1).count() else texts


def scores(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    text_batches(spark)
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("held_out", held_out)
    rows, texts = distinct_texts(docs)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = batch_ids(b.column(2), path)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.binary())], ["copy", "other", "text", "times", "ids"])

    texts = written(texts.mapInArrow(tokens, "copy long, other long, text string, times long, ids binary"), "tokens")
    known = texts.where("times > 0")
    counts = written(word_counts(known), "counts")
    limits = [1 << i for i in range(0, 40)]
    stats = counts.agg(F.count("*"), F.sum("n"), *[F.count_if(F.col("n") >= x) for x in limits]).first()
    ends = known.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    n_train, n_words = (stats[1] or 0) + ends, stats[0] + (ends > 0)
    below = float(n_train + 0.5 * (n_words + 1))
    least = next(x for x, n in zip(limits, stats[2:], strict=True) if n <= FREQUENT_WORDS)
    frequent = counts.where(F.col("n") >= least).toArrow()  # at most FREQUENT_WORDS rows
    key = uuid.uuid4().hex
    shared = spark.sparkContext.broadcast((frequent["hash"].to_numpy().view(U), frequent["n"].to_numpy()))
    model = fitted(known, len(vocabulary(path).pieces))
    end_score = float(np.log10((ends + 0.5) / below))
    models = spark.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _tables:
            _tables.clear()
            h, n = shared.value
            _tables[key] = CountTable(h, np.log10((n + 0.5) / below))
        find, m = _tables[key].find, models.value
        for b in batches:
            n, some, base, rare_hash, rare_times, score = [], [], [], [], [], []
            for x, y, data, off in text_slices(b.column(2), 1_000_000):
                row, h = words(data, off)
                ok, value = find(h)
                count = np.bincount(row, minlength=y - x)
                n += (count + 1).tolist()
                some += (np.bincount(row, ok, minlength=y - x).astype(int) + (ends > 0)).tolist()
                base += (np.bincount(row, np.where(ok, value, 0), minlength=y - x) + end_score).tolist()
                lost_row, lost = row[~ok], h[~ok].view(np.int64)
                at = np.searchsorted(lost_row, np.arange(y - x + 1))
                for r in range(y - x):
                    u, times = np.unique(lost[at[r] : at[r + 1]], return_counts=True)
                    rare_hash.append(u)
                    rare_times.append(times.astype(np.int32))
                score += m.score([np.frombuffer(i, np.uint16) for i in b.column(4).slice(x, y - x).to_pylist()]).tolist()
            off = pa.array(np.concatenate([[0], np.cumsum([len(u) for u in rare_hash])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(off, pa.array(np.concatenate([np.zeros(0, k), *v]))) for v, k in ((rare_hash, np.int64), (rare_times, np.int32))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(some, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()), *lists], ["copy", "other", "n_tokens", "known", "base", "score", "rare", "times"])

    out = texts.mapInArrow(work, "copy long, other long, n_tokens long, known long, base double, score double, rare array<long>, times array<int>")
    out = written(out, "scored")
    rare = out.select("copy", "other", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("copy", "other", F.col("x.rare").alias("hash"), F.col("x.times").alias("times"))
    found = rare.join(counts.where(F.col("n") < least), "hash", "left")
    value = F.log10((F.coalesce("n", F.lit(0)) + 0.5) / below)
    sums = found.groupBy("copy", "other").agg(F.sum(F.col("times") * value).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("also"))
    full = out.drop("rare", "times").join(sums, ["copy", "other"], "left")
    full = full.select("copy", "other", "n_tokens", (F.col("known") + F.coalesce("also", F.lit(0))).cast("long").alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score")
    return rows.join(full, ["copy", "other"]).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))


QUERIES = {"op8_attention_lm": op8_attention_lm}
ORACLES: dict[str, str] = {}
