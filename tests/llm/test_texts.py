"""Operators 3, 4, 6, 7, 8 and 9 on documents."""

import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from siteglass.llm import attention_lm, curriculum, ngram_join, sentencepiece_bpe, suffix_dedup, toxicity
from siteglass.llm.common import table

from .helpers import DOCS, SF, classes, long_text, no_docs, odd_docs, repeats, words


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]


def test_toxicity_held_out_accuracy(spark):
    d, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    model = toxicity.train(d, labels.where("doc_id % 2 = 0"))
    rows = toxicity.severity(d, model).join(labels.where("doc_id % 2 = 1").select("doc_id", labels.toxic.alias("real")), "doc_id").collect()
    right = sum(r.toxic == bool(r.real) for r in rows)
    assert right / len(rows) >= 0.95
    assert all(0 <= r.expected_severity <= 3 and 0 <= r.severity <= 3 for r in rows)
    assert all(a <= b for a, b in zip(model.thresholds, model.thresholds[1:], strict=False))


def test_severity_ranks_texts_that_the_model_has_not_seen(spark):
    """Expected severity of held-out toxic texts follows log-odds of words counted in texts that were not used to fit the model."""
    import numpy as np

    d, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    model = toxicity.train(d, labels.where("doc_id % 3 = 0"))
    rows = d.join(labels.where("doc_id % 3 <> 0").select("doc_id", "toxic"), "doc_id").select("doc_id", "text", "toxic").collect()
    seen = {r.doc_id: toxicity.features(r.text) & model.words.keys() for r in rows}
    other = [r for r in rows if r.doc_id % 3 == 1]
    bad, clean = Counter(), Counter()
    for r in other:
        (bad if r.toxic else clean).update(seen[r.doc_id])
    n_bad, n_clean = sum(r.toxic for r in other), sum(not r.toxic for r in other)
    odds = lambda w: math.log((bad[w] + 0.5) / (n_bad + 1)) - math.log((clean[w] + 0.5) / (n_clean + 1))
    held = [r for r in rows if r.doc_id % 3 == 2 and r.toxic]
    got = {r.doc_id: r.expected_severity for r in toxicity.severity(d.join(labels.where("doc_id % 3 = 2 and toxic = 1").select("doc_id"), "doc_id"), model).collect()}
    x, y = [sum(map(odds, seen[r.doc_id])) for r in held], [got[r.doc_id] for r in held]
    rank = lambda v: np.argsort(np.argsort(v))
    assert len(held) > 50 and np.corrcoef(rank(x), rank(y))[0, 1] > 0.5


def test_toxicity_is_the_same_on_every_run(spark):
    d, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    a, b = toxicity.train(d, labels), toxicity.train(d.repartition(7), labels.repartition(3))
    assert a.words == b.words and (a.weights == b.weights).all() and (a.thresholds == b.thresholds).all()


def test_toxicity_odd_inputs(spark):
    labels = table(spark, SF, "labels")
    odd = odd_docs(spark)
    out = toxicity.severity(odd, toxicity.train(table(spark, SF, "documents"), labels))
    assert out.count() == odd.count()
    assert set(out.columns) == set(odd.columns) | {"expected_severity", "severity"}
    empty = toxicity.train(odd, labels.where("false"))
    assert not any(r.toxic for r in toxicity.severity(odd, empty).collect())
    assert toxicity.severity(no_docs(spark), empty).count() == 0


def test_curriculum_agrees_with_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(curriculum.ORACLES["op4_curriculum"]).fetchall()
    got = [tuple(r) for r in curriculum.op4_curriculum(spark, SF).collect()]
    assert sorted(got) == sorted(want)
    by = {}
    for _, size, source_size, target, taken, position, passes in got:
        assert (position is None) == (taken == 0) == (passes == 0)
        assert taken <= 2 * size
        by.setdefault((source_size, target), [0])[0] += taken
    assert all(abs(v[0] - target) <= 1 for (_, target), v in by.items())


def test_curriculum_follows_its_schedules(spark):
    """Sources have their words where their schedules want them, and positions run over the whole mix."""
    rows = [(i, "w " * 50, "abc"[i % 3]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for schedules in (curriculum.SCHEDULES, (curriculum.SCHEDULES[2], curriculum.SCHEDULES[1], curriculum.SCHEDULES[0])):
        got = curriculum.curriculum(docs, schedules=schedules).collect()
        kind = {r.doc_id: r.doc_id % 3 for r in got}
        total = sum(r.taken for r in got)
        assert {r.mix_size for r in got} == {total}
        begins = sorted((p * total, min(r.size, r.taken), kind[r.doc_id]) for r in got for p in r.positions)
        # what has been taken before a position is about that position
        seen = 0
        for p, n, _ in begins:
            assert abs(seen - p) <= 200
            seen += n
        early = sum(n for p, n, k in begins if k == 0 and p < total / 2) / sum(n for _, n, k in begins if k == 0)
        assert early > 0.55 if schedules[0][0][1] > 1 else early < 0.45


def test_curriculum_odd_inputs(spark):
    got = curriculum.curriculum(odd_docs(spark)).collect()
    assert len(got) == odd_docs(spark).count()
    assert all(r.taken == 0 and not r.positions for r in got if r.size == 0)
    assert all(0 <= p <= 1 for r in got for p in r.positions)
    assert sum(r.taken for r in got) == pytest.approx(1.5 * sum(r.size for r in got), abs=3)
    assert curriculum.curriculum(no_docs(spark)).count() == 0


def test_curriculum_inverts_its_schedule(spark):
    from pyspark.sql import functions as F

    knots = ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5))
    got = [r.p for r in spark.range(101).select(curriculum.position(F.col("id") / 100, knots).alias("p")).collect()]
    integral = lambda t: 1.5 * t - t * t / 2
    assert all(integral(p) == pytest.approx(i / 100, abs=1e-9) for i, p in enumerate(got))


def edited(text, n, seed):
    w, r = text.split(), random.Random(seed)
    for _ in range(n):
        w[r.randrange(len(w))] = f"edit{seed}x{r.randrange(1000)}"
    return " ".join(w)


def similar_docs():
    """Texts around the threshold of many sizes, chains of small edits, copies, and texts that share a long passage only."""
    rows, i = [], 0
    passage = long_text(80, 99)
    for size in (3, 4, 5, 7, 12, 20, 33, 60, 110, 250, 700):
        base = long_text(size, size)
        for n in (0, 0, 1, 1, 2, 3, 5, 8):
            i += 1
            rows.append((i, edited(base, min(n, size // 6), i)))
        i += 1
        rows.append((i, passage + " " + long_text(size, 1000 + size)))
        chain = base
        for _ in range(4):
            i += 1
            chain = edited(chain, max(1, size // 60), i)
            rows.append((i, chain))
    return rows


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_similarity_classes_on_edits(spark, width, percent):
    rows = similar_docs()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string"), width, percent).collect()}
    assert got == classes(rows, width, percent)


@pytest.mark.parametrize("sets,shingles", [(5, 10**9), (1000, 400)])
def test_large_clusters_are_compared_in_tiles(spark, sets, shingles):
    rows = similar_docs()
    got = ngram_join.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, sets=sets, shingles=shingles)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == classes(rows, 4, 85)


def test_sketches_rule_out_no_similar_pair():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(40):
        base, sets = np.unique(rng.integers(0, 2**63, int(rng.integers(5, 3000)), dtype=np.uint64)), []
        for _ in range(int(rng.integers(2, 30))):
            kept = rng.permutation(base)[: int(len(base) * rng.uniform(0.6, 1))]
            sets.append(np.unique(np.concatenate([kept, rng.integers(0, 2**63, int(rng.integers(0, max(1, len(base) // 4))), dtype=np.uint64)])))
        n, sketches = np.array([len(s) for s in sets]), [ngram_join.parities(s) for s in sets]
        root = np.arange(len(sets))
        for x, y in zip(*ngram_join.may_be_similar(n, sketches, 80), strict=True):
            root[root == root[x]] = root[y]
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                assert ngram_join._apart(sketches[i], sketches[j]) <= n[i] + n[j] - 2 * both
                assert root[i] == root[j] or both * 100 < 80 * (n[i] + n[j] - both)


def test_similarity_classes_on_documents(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.op6_ngram_join(spark, SF).collect()}
    assert got == classes(docs, 4, 85)


def test_similar_sets_share_a_signature():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (1, 2, 6, 7, 13, 40, 90, 300, 1500):
        for percent in (80, 85):
            for _ in range(20):
                s = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
                out = rng.integers(0, int(len(s) * (100 - percent) / 100) + 1)
                put = rng.integers(0, max(1, int((len(s) - out) * 100 / percent - len(s)) + 1))
                t = np.union1d(rng.permutation(s)[out:], rng.integers(0, 2**63, put, dtype=np.uint64))
                if len(np.setxor1d(s, t)) and 100 * len(np.intersect1d(s, t)) >= percent * len(np.union1d(s, t)):
                    assert len(np.intersect1d(ngram_join.signatures(s, percent), ngram_join.signatures(t, percent)))


def test_similarity_classes_odd_inputs(spark):
    got = ngram_join.similarity_classes(odd_docs(spark), 5, 80).collect()
    rows = [(r.doc_id, r.text) for r in odd_docs(spark).collect() if r.doc_id is not None]
    assert len(got) == len(rows)
    want = classes(rows, 5, 80)
    assert {r.doc_id: r.component_id for r in got} == {i: c for i, (_, c) in want.items()}
    assert ngram_join.similarity_classes(no_docs(spark), 5, 80).count() == 0


def removed(texts, length):
    out = []
    for t, gone in zip(texts, repeats(texts, length), strict=True):
        d = (t or "").encode()
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeated_strings_go(spark, docs):
    want = {i: x for (i, _), x in zip(docs, removed([t for _, t in docs], 400), strict=True)}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.op7_suffix_dedup(spark, SF).collect()}
    assert got == want


@pytest.mark.parametrize("frequent", [1000, 2])
def test_repeated_strings_go_from_odd_inputs(spark, frequent):
    r = random.Random(5)
    passage = long_text(60, 7)
    texts = [None, "", "x" * 1000, "ab" * 300, "x" * 90, passage[:200], long_text(30, 1) + passage + long_text(9, 2), passage + "!", "y" + passage, passage * 3]
    texts += [long_text(r.randint(1, 40), k) + passage[k * 3 : 180 + k * 5] + long_text(r.randint(1, 20), k + 50) for k in range(25)]
    rows = [(k % 20, t, "c") for k, t in enumerate(texts)] + [(3, "ab" * 300, "c")]
    texts = [x[1] for x in rows]
    out = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, kept string"), 100, frequent).collect()
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in out)
    assert got == sorted((x[0], *y) for x, y in zip(rows, removed(texts, 100), strict=True))


def test_suffix_dedup_edge_tables(spark):
    assert suffix_dedup.remove_repeats(odd_docs(spark), 200).count() == odd_docs(spark).count()
    assert suffix_dedup.remove_repeats(no_docs(spark), 200).count() == 0


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 1


def test_language_model_scores(spark, docs):
    got = {r.doc_id: r for r in attention_lm.op8_attention_lm(spark, SF).collect()}
    counts = Counter(w for i, t in docs if not held_out(i) for w in [*words(t), None])
    n, v = sum(counts.values()), len(counts)
    for i, t in docs:
        tokens = [*words(t), None]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held_out(i), len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0


def test_language_model_odd_inputs(spark):
    got = attention_lm.scores(odd_docs(spark)).collect()
    assert len(got) == odd_docs(spark).count()
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert attention_lm.scores(no_docs(spark)).count() == 0


def test_language_model_learns_from_texts_of_any_length_and_number(spark):
    """Words of which one training text beyond the former bounds (500,000 bytes; 2,000 texts) says what follows them."""
    new = [i for i in range(100) if held_out(i)][:2]
    known = [i for i in range(10_000) if not held_out(i)][:2400]
    rows = [(known[0], "seven winters passed " * 30_000), (new[0], "seven winters passed " * 20)]
    rows += [(i, f"{'green hills' if k < 1200 else 'quiet rivers'} number {i % 7}") for k, i in enumerate(known[1:])] + [(new[1], "other words here " * 20)]
    got = {r.doc_id: r.score / r.n_tokens for r in attention_lm.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[new[0]] > -0.5 > got[new[1]]


def test_language_model_is_fitted_on_every_window(spark):
    """More windows than the former bound (128,000, or 1/16 of them) take part, each once; a long text has several."""
    ids = F.expr("unhex(substring('0A000B000C000D00', 1, CAST(4 * (id % 4) + 4 AS INT)))")
    rows = spark.range(140_000).select(F.xxhash64("id").alias("copy"), ids.alias("ids"), F.lit(1).cast("long").alias("times"))
    rows = rows.unionByName(spark.range(1).select(F.lit(7).cast("long").alias("copy"), F.expr("unhex(repeat('0A00', 180))").alias("ids"), F.lit(1).cast("long").alias("times")))
    assert attention_lm.fitted(rows, 20).fitted_windows == 140_000 + 11


def test_gradients_follow_differences_of_the_loss():
    import numpy as np

    L, rng = attention_lm, np.random.default_rng(4)
    m = L.train([rng.integers(0, 2000, 60).astype(np.uint16) for _ in range(40)], 3000, steps=20)
    slots, starts, _, valid = m.sequence([rng.integers(0, 2000, 90).astype(np.uint16)])
    x, y = m.inputs(slots, starts)
    ok = np.arange(L.SCORED) < valid[:, None]
    y = np.where(ok, y, 0)
    g = m.gradients(x, y, ok)[1]
    for name, own in g.items():
        way = (own / np.abs(own).max()).astype(np.float32)
        here, loss = m.p[name], []
        for step in (0.01, -0.01):
            m.p[name] = here + np.float32(step) * way
            loss.append(m.gradients(x, y, ok)[0])
        m.p[name] = here
        assert (loss[0] - loss[1]) / 0.02 == pytest.approx(float((own * way).sum()), rel=0.03, abs=1e-4)


def test_attention_learns_what_pairs_do_not_show():
    """Ids that follow from the one two places back: counts of neighbours say nothing about them, attention must find it."""
    import numpy as np

    rng = np.random.default_rng(2)

    def text():
        ids = list(rng.integers(0, 12, 2))
        for _ in range(60):
            ids.append((ids[-2] * 5 + 3) % 12 if rng.random() < 0.9 else rng.integers(0, 12))
        return np.array(ids, np.uint16)

    new = [text() for _ in range(40)]
    m = attention_lm.train([text() for _ in range(400)], 40, steps=600)
    assert m.score(new).sum() / sum(len(t) + 1 for t in new) > math.log10(1 / 12) + 0.2


def test_scores_agree_with_plain_loops():
    """The score of a text, token by token, from the model's parameters and the rule of its windows, without arrays of windows."""
    import numpy as np

    L = attention_lm
    rng = np.random.default_rng(3)
    m = L.train([rng.integers(0, 2000, 70).astype(np.uint16) for _ in range(60)], 3000, steps=30)
    p = {k: v.astype(float) for k, v in m.p.items()}

    def softmax(z):
        z = np.exp(np.array(z) - max(z))
        return z / z.sum()

    for n in (0, 1, 17, 18, 19, 50):
        ids = rng.integers(0, 3000, n).astype(np.uint16)
        given = [L.BEGIN, *[int(m.slot_of[i]) for i in ids]]
        wanted = [*given[1:], L.END]
        total = sum(float(m.tail[i]) for i in ids)
        for j, y in enumerate(wanted):
            seen = range(max(0, j // L.SCORED * L.SCORED - L.SEEN), j + 1)
            query = p["e"][given[j]] @ p["q"]
            weight = softmax([query @ (p["e"][given[i]] @ p["k"]) / L.WIDTH**0.5 + p["near"][j - i] for i in seen])
            h = p["e"][given[j]] + sum(w * (p["e"][given[i]] @ p["v"]) for w, i in zip(weight, seen, strict=True))
            cluster = y // L.PER
            total += math.log(softmax(h @ p["c"] + p["cb"])[cluster]) + math.log(softmax(h @ p["w"][cluster] + p["wb"][cluster])[y % L.PER])
        assert m.score([ids])[0] == pytest.approx(total / math.log(10), rel=1e-4, abs=1e-3)


def test_attention_probabilities_sum_to_one():
    import numpy as np

    rng = np.random.default_rng(0)
    m = attention_lm.train([rng.integers(0, 3000, 60).astype(np.uint16) for _ in range(300)], 3000, steps=5)
    slots, starts, _, _ = m.sequence([rng.integers(0, 3000, 30).astype(np.uint16)])
    x, y = m.inputs(slots, starts)
    total = sum(np.exp(m.log_probability(x, np.full_like(y, s))) for s in range(attention_lm.SLOTS))
    assert total == pytest.approx(np.ones(y.size), abs=2e-3)
    assert np.exp(m.tail[m.slot_of == attention_lm.SLOTS - 1]).sum() == pytest.approx(1)


TEXTS = [None, "", " ", "  two  spaces ", "tab\tand\nline\r\n", "ÀÉ ñ 文字 한국어 🙂👩‍👩‍👧 ▁ x", "<s> </s> <unk> <0x41>", " ​﻿abc", "é ﬁ ① ｶﾞ", "a" * 3000, "the " * 2000, "\u0000 \u0001 ퟿  \U0010ffff", "...!!!???", "x　y", "12345 67.89 $%^&*()"]


def test_encoding_agrees_with_library(spark, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.model_path())
    rows = [*enumerate(TEXTS), *((100 + i, t) for i, t in docs), (9999, long_text(3000))]
    out = sentencepiece_bpe.encode_decode(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()}
    for i, t in rows:
        ids = sp.encode(t or "")
        assert got[i] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()), repr(t)[:80]


def test_encoding_odd_inputs(spark):
    assert sentencepiece_bpe.encode_decode(odd_docs(spark)).count() == odd_docs(spark).count()
    assert sentencepiece_bpe.encode_decode(no_docs(spark)).count() == 0


def test_new_words_are_encoded_many_at_a_time_and_as_one_by_one(monkeypatch):
    r = random.Random(5)
    words = ["".join(r.choice("thaeinos.,éß") for _ in range(r.choice((1, 2, 3, 7, 12, 30, 45)))) for _ in range(400)] + ["文字", "\U0001f600x", "a\U000e0001", "x\ny", "\n", "aaaaaaa", "ththththth"]
    texts = [" ".join(r.choice(words) for _ in range(r.choice((1, 2, 30)))) for _ in range(200)]
    texts += ["", " ", "a  b", " a", "a ", "a\nb", "\na", "a\n", "a\n\nb", "▁a b", "a\x00b", "line one\nline two\n \nend.", "<s> a </s>", "\U000e0001 a"]
    one, many = (sentencepiece_bpe.Vocabulary(sentencepiece_bpe.model_path()) for _ in range(2))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(n, sha(ids), sha(back), ids) for n, ids, back in map(one.whole, texts)]
    for size in (1 << 22, 50):
        monkeypatch.setattr(sentencepiece_bpe, "SLICE", size, raising=False)
        assert [(n, a, b, joined()) for n, a, b, joined in many.digests(texts)] == want
    assert list(many.digests([])) == []
    fresh, alone = sentencepiece_bpe.Vocabulary(sentencepiece_bpe.model_path()), []
    monkeypatch.setattr(fresh, "merge", lambda text, merge=fresh.merge: alone.append(text) or merge(text))
    assert len(list(fresh.digests(["some plain words that nobody merges alone"] * 3))) == 3 and not alone


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    d = table(spark, SF, "documents")
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, d, SF)
        assert out.columns == d.columns and out.count() > 0, name
    kept = {r.doc_id for r in p.one_of_each_class(spark, d, SF).collect()}
    assert kept == {c for _, c in classes([(r.doc_id, r.text) for r in d.collect()], 5, 80).values()}
    rows = d.collect()
    cut = {r.doc_id: r.text for r in p.without_repeats(spark, d, SF).collect()}
    for r, gone in zip(rows, repeats([r.text for r in rows], p.REPEATED_BYTES), strict=True):
        kept_bytes = bytes(b for b, g in zip(r.text.encode(), gone, strict=True) if not g)
        assert cut[r.doc_id] == (kept_bytes.decode(errors="replace") if any(gone) else r.text) or any(gone) and "�" in cut[r.doc_id]
    taken = {r.doc_id: r.taken for r in curriculum.curriculum(d).collect()}
    mixed = Counter(r.doc_id for r in p.mixed(spark, d, SF).collect())
    assert set(mixed) == {i for i, n in taken.items() if n}


def test_pipeline_mixes_rows_with_null_and_repeated_ids(spark):
    import corpus_pipeline as p

    rows = [(None, "no id but words", "a"), (None, "no id and other words here", "b"), (1, "one two", "a"), (2, "same id first text", "b"), (2, "same id", "b"), (2, "same id", "c"), (3, None, "a")]
    d = spark.createDataFrame([*rows, *[(i, f"filler text {i} of some length", "abc"[i % 3]) for i in range(10, 40)]], "doc_id long, text string, source string")
    want = Counter()
    for r in curriculum.curriculum(d, keep=("text",)).collect():
        want[r.doc_id, r.text] += len(r.positions)
    got = Counter((r.doc_id, r.text) for r in p.mixed(spark, d, SF).collect())
    assert got == +want and any(i is None for i, _ in got)


def clashing(docs):
    """docs with columns of the names that operators and stages use themselves."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit(7) for c in ("positions", "position", "_id", "_copy", "_row", "spans", "severity", "expected_severity", "n_bytes", "n_removed", "n_spans", "component_id", "own", "label", "tile", "mix_size")})


@pytest.mark.parametrize("make", [odd_docs, no_docs])
def test_pipeline_takes_odd_inputs(spark, make):
    import corpus_pipeline as p

    d = make(spark)
    for _, stage in p.STAGES[1:]:
        stage(spark, d, SF).count()
    assert DOCS.split()[0] in d.columns


@pytest.mark.parametrize("make", [odd_docs, no_docs])
def test_pipeline_keeps_columns_of_any_name(spark, make):
    """All stages in turn, toxicity included, on nulls, repeats and clashing names: columns keep their values, and only what should go goes."""
    import corpus_pipeline as p

    d = clashing(make(spark))
    before = d.collect()
    clean = p.without_toxic(spark, d, SF).collect()
    assert sorted(map(str, clean)) == sorted(map(str, before))
    d = p.one_of_each_class(spark, d, SF)
    rows = d.collect()
    assert set(map(str, rows)) <= set(map(str, before))
    if before:
        kept = [(r.doc_id, r.text) for r in rows]
        assert len(set(kept)) == len(kept) and {i for i, _ in kept} == {1, 2, 3, 4, 6, None, 8, 10, 11, 12}
    cut = p.without_repeats(spark, d, SF).collect()
    assert len(cut) == len(rows) and all(r.positions == r._id == 7 for r in cut)
    mixed = p.mixed(spark, d, SF)
    assert mixed.columns == d.columns and all(r.position == r._row == 7 and words(r.text) for r in mixed.collect())
    out = p.encoded(spark, d, SF).collect()
    assert len(out) == len(rows) and all(r.severity == r.tile == 7 for r in out)


def test_pipeline_runs_end_to_end(spark, tmp_path):
    import corpus_pipeline as p

    for name in ("documents", "labels"):
        table(spark, SF, name).write.parquet(f"{tmp_path}/{name}.parquet")
    out = p.run(spark, str(tmp_path))
    assert out.count() > 0 and {"n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)
    table(spark, SF, "documents").where("false").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
