from __future__ import annotations

import random
from itertools import combinations

import pytest
from corpus import DOCS, corpus, prose, rows

from palimpsest.llm import minhash
from palimpsest.llm.minhash import _linked, near_duplicates, one_of_each


def shingles(t, k=3):
    w = (t or "").split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def groups(pairs, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_finds_brute_force_pairs(spark):
    docs = corpus(11, 150)
    sets = {i: shingles(t) for i, t in docs}
    want = [(a, b) for a, b in combinations(sorted(sets), 2) if jaccard(sets[a], sets[b]) >= 0.5]
    got = {r.doc_id: r.near_doc_id for r in near_duplicates(spark.createDataFrame(rows(docs), DOCS)).collect()}
    full = groups(want, sets)
    assert len(want) > 40
    hit = sum(got.get(a, a) == got.get(b, b) for a, b in want)
    assert hit >= 0.95 * len(want)
    for a, b in got.items():  # never joins what isn't connected, and keeps the least
        assert full[a] == full[b] and b < a and b not in got


def test_scores_are_exact(spark):
    docs = corpus(12, 60)
    sets = {i: shingles(t) for i, t in docs}
    for r in near_duplicates(spark.createDataFrame(rows(docs), DOCS)).collect():
        assert abs(r.jaccard - jaccard(sets[r.doc_id], sets[r.near_doc_id])) < 1e-12


def test_awkward_rows(spark):
    rng = random.Random(3)
    long = " ".join(prose(rng, 30000))
    data = [(1, None, None, None, None, 1, "x"), (2, None, "en", "a", 3, 2, "y"), (3, "", "en", "a", 0, None, None), (4, " ", None, "a", 9, 4, "z"), (5, "two words", "en", None, 1, 5, "z"), (6, "two  words", "en", None, 1, 5, "z"), (6, "two  words", "en", None, 1, 5, "z"), (7, long, "en", "a", 1, 1, ""), (8, long + " end", "en", "a", 1, 1, ""), (None, long, "en", "a", 1, 1, "")]
    df = spark.createDataFrame(data, DOCS + ", key long, b string")
    got = sorted((r.doc_id, r.near_doc_id) for r in near_duplicates(df).collect())
    assert got == [(6, 5), (8, 7)]
    assert near_duplicates(df.limit(0)).count() == 0
    kept = one_of_each(spark, df, "")
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7]


def test_members_unlike_the_bucket_head_are_compared(spark):
    """Similarity isn't transitive: b and c are alike, but a, the least id, is like neither enough."""
    rng = random.Random(9)
    base = prose(rng, 200, 5000)
    a = base[:140] + prose(rng, 60, 90000)
    docs = [(1, " ".join(a)), (2, " ".join(base)), (3, " ".join(base[:190] + prose(rng, 10, 90000)))]
    got = [(r.doc_id, r.near_doc_id) for r in near_duplicates(spark.createDataFrame(rows(docs), DOCS), side=12, hashes=1, least=0.8).collect()]
    assert got == [(3, 2)]


def test_several_texts_under_one_id(spark):
    rng = random.Random(4)
    p, q = (" ".join(prose(rng, 80, 9000)) for _ in "pq")
    docs = [(1, p), (5, p + " more"), (5, q), (9, q + " less"), (7, "something else altogether here")]
    got = sorted((r.doc_id, r.near_doc_id) for r in near_duplicates(spark.createDataFrame(rows(docs), DOCS)).collect())
    assert got == [(5, 1), (9, 1)]


@pytest.mark.parametrize("pairs", [1, 64])
def test_buckets_of_unlike_members_lose_no_link(spark, monkeypatch, pairs):
    """One key for all: clusters around many heads, and links across clusters that only the triangle inequality leaves to compare."""
    monkeypatch.setattr(minhash, "PAIRS", pairs)
    rng = random.Random(21)
    docs = []
    for c in range(3):
        base = prose(rng, 120, 10**6)
        for _ in range(7):
            d = list(base)
            for _ in range(rng.randrange(1, 40)):
                d[rng.randrange(len(d))] = f"y{rng.randrange(10**6)}"
            docs.append(d)
        docs.append(base[:70] + (docs[0][70:] if c else []))
    rng.shuffle(docs)
    sets = {i: shingles(" ".join(d)) for i, d in enumerate(docs)}
    member = spark.createDataFrame([(1, i, 0) for i in range(1, len(docs))], "key long, a long, b long")
    bytes_of = {t: (hash(t) & (2**63 - 1)) for s in sets.values() for t in s}
    table = spark.createDataFrame([(i, b"".join(x.to_bytes(8, "little") for x in sorted(bytes_of[t] for t in s))) for i, s in sets.items()], "doc_id long, shingles binary")
    found = [(r.a, r.b) for r in _linked(member, table, 0.5).where("near").collect()]
    want = [(a, b) for a, b in combinations(sorted(sets), 2) if jaccard(sets[a], sets[b]) >= 0.5]
    assert groups(found, sets) == groups(want, sets)
