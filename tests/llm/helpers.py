"""Inputs that every operator must take, and plain versions of what they compute."""

from __future__ import annotations

import re

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, `id` string, `key` long, `hash` string, `size` int, `taken` string, `toxic` string, `kept` string, copy string"


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lower)


def long_text(n, seed=3):
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeéß文") for _ in range(r.randint(1, 9))) for _ in range(n))


def odd_docs(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows and ids, clashing column names."""
    long = long_text(6000)
    texts = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (6, "One two three four five six"), (6, "One two three four five six"), (7, "one two three four five six"), (None, "no id here at all, but words"), (8, long), (9, long + " tail"), (10, "é" * 900), (11, "x" * 1200), (12, "a b c d"), (12, "other text with the same id")]
    rows = [(i, t, None, None if k % 3 == 0 else "s" + "xyz"[k % 3], None, "1", None, "h", 1, "t", None, "k", "c") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text, width):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def classes(rows, width, percent):
    """{doc_id: (size of its set, smallest id reachable)} by comparing all pairs."""
    sets = [(i, shingles(t, width)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (max(len(s) for j, s in sets if j == i), find(i)) for i, _ in sets}


def repeats(texts, length):
    """For each text a list of booleans: bytes covered by strings of that length that start anywhere else too."""
    seen = {}
    data = [(t or "").encode() for t in texts]
    for d in data:
        for i in range(len(d) - length + 1):
            s = d[i : i + length]
            seen[s] = seen.get(s, 0) + 1
    out = []
    for d in data:
        gone, until = [], 0
        for i in range(len(d)):
            if i + length <= len(d) and seen[d[i : i + length]] > 1:
                until = i + length
            gone.append(i < until)
        out.append(gone)
    return out
