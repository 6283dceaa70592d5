from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from corpus import DOCS, corpus, prose, rows

from palimpsest.llm.fmindex import Index, Wavelet, repeated_intervals, suffix_array


def brute(docs, length):
    texts = {i: t.split() for i, t in docs if t}
    at = defaultdict(set)
    for i, w in texts.items():
        for p in range(len(w) - length + 1):
            at[tuple(w[p : p + length])].add(i)
    out = []
    for i, w in texts.items():
        cover = [False] * len(w)
        for p in range(len(w) - length + 1):
            if len(at[tuple(w[p : p + length])]) > 1:
                cover[p : p + length] = [True] * length
        p = 0
        while p < len(w):
            if cover[p]:
                q = p
                while q < len(w) and cover[q]:
                    q += 1
                out.append((i, p, q))
                p = q
            p += 1
    return sorted(out)


@pytest.mark.parametrize("seed, shard_words, piece", [(1, 400_000, 400), (2, 1500, 60)])
def test_same_as_brute_force(spark, seed, shard_words, piece):
    docs = corpus(seed, 60)
    got = repeated_intervals(spark.createDataFrame(rows(docs), DOCS), 20, shard_words, piece).collect()
    want = brute(docs, 20)
    assert len(want) > 20
    assert sorted((r.doc_id, r.start, r.stop) for r in got) == want
    words = {i: t.split() for i, t in docs}
    for r in got:
        assert r.other_doc_id != r.doc_id and r.n_words == r.stop - r.start
        mine, other = words[r.doc_id][r.start : r.stop], words[r.other_doc_id]
        grams = {tuple(other[p : p + 20]) for p in range(len(other) - 19)}
        assert any(tuple(mine[p : p + 20]) in grams for p in range(len(mine) - 19))


def test_suffix_array_and_wavelet_tree():
    rng = random.Random(2)
    for _ in range(20):
        s = np.array([rng.randrange(1, 4) for _ in range(rng.randrange(1, 60))] + [0], np.int64)
        s[rng.randrange(len(s))] = 0
        full, end = [], 0
        for x in s.tolist():
            full.append((0, end) if x == 0 else (1, x))
            end += x == 0
        sa, lcp = suffix_array(s)
        assert sa.tolist() == sorted(range(len(s)), key=lambda i: full[i:])
        for r in range(1, len(s)):
            a, b = full[sa[r - 1] :], full[sa[r] :]
            n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert lcp[r] == n
        w = Wavelet(s, 4)
        for c in range(4):
            for i in (0, len(s) // 2, len(s)):
                assert w.rank(np.array([c]), np.array([i]))[0] == (s[:i] == c).sum()
        index = Index(s, np.zeros(len(s), np.int64))
        for i in range(len(s) - 2):
            pat = s[i : i + 3]
            lo, hi = np.array([0]), np.array([len(s)])
            for x in pat[::-1]:
                lo, hi = index.back(np.array([x]), lo, hi)
            if 0 not in pat:
                assert hi[0] - lo[0] == sum((s[j : j + 3] == pat).all() for j in range(len(s) - 2))


def test_awkward_rows(spark):
    rng = random.Random(6)
    p = " ".join(prose(rng, 60))
    data = [(1, None, None, None, None, 1, "x"), (None, p, "en", "a", 3, 2, "y"), (2, "", "en", "a", 0, None, None), (3, p, None, "a", 9, 4, "z"), (4, "\n " + p.replace(" ", " \t", 3), "en", None, 1, 5, "z"), (4, "\n " + p.replace(" ", " \t", 3), "en", None, 1, 5, "z"), (5, "a " * 5000, "en", None, 1, 5, "z"), (6, "b " + "a " * 3000, "en", None, 1, 5, "z"), (7, "q " * 5000, "en", None, 1, 5, "z")]
    df = spark.createDataFrame(data, DOCS + ", start long, shard string")
    got = sorted((r.doc_id, r.start, r.stop, r.other_doc_id) for r in repeated_intervals(df, 20).collect())
    assert got == [(3, 0, 60, 4), (4, 0, 60, 3), (5, 0, 5000, 6), (6, 1, 3001, 5)]
    assert repeated_intervals(df.limit(0), 20).count() == 0
