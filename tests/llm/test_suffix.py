from __future__ import annotations

import random
from collections import defaultdict

import pytest
from corpus import DOCS, corpus, prose, rows

from palimpsest.llm.suffix import _sorted, interval_tree, maximal_repeats, without_repeats


def brute(docs, length):
    """Every maximal repeat by definition."""
    texts = {i: t.split() for i, t in docs if t}
    at = defaultdict(list)
    for i, w in texts.items():
        for p in range(len(w) - length + 1):
            at[tuple(w[p : p + length])].append((i, p))
    found = {}
    level = {k: v for k, v in at.items() if len(v) > 1}
    n = length
    while level:
        longer = defaultdict(list)
        for k, v in level.items():
            left = [texts[i][p - 1] if p else (i, "begin") for i, p in v]
            right = [texts[i][p + n] if p + n < len(texts[i]) else (i, "end") for i, p in v]
            if len(set(left)) > 1 and len(set(right)) > 1:
                found[k] = sorted(v)
            for (i, p), r in zip(v, right):
                if not isinstance(r, tuple):
                    longer[(*k, r)].append((i, p))
        level = {k: v for k, v in longer.items() if len(v) > 1}
        n += 1
    return sorted((len(k), v) for k, v in found.items())


def grouped(df):
    """(words, places) of each group, its children's places included."""
    own, kind, kids = defaultdict(set), {}, defaultdict(set)
    for r in df.collect():
        own[r.group_id].add((r.doc_id, r.start))
        assert kind.setdefault(r.group_id, (r.n_words, r.n_occurrences, r.parent_id)) == (r.n_words, r.n_occurrences, r.parent_id)
        if r.parent_id is not None:
            kids[r.parent_id].add(r.group_id)
    every = {}
    for g in sorted(own, key=lambda g: -kind[g][0]):  # children are longer
        every[g] = own[g].union(*(every[k] for k in kids[g]))
        assert len(every[g]) == kind[g][1]
    assert set(kids) <= set(own)
    return sorted((kind[g][0], sorted(p)) for g, p in every.items())


def ours(spark, docs, length, hot=10_000):
    return grouped(maximal_repeats(spark.createDataFrame(rows(docs), DOCS), length, hot))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_same_as_brute_force(spark, seed):
    docs = corpus(seed)
    want = brute(docs, 20)
    assert len(want) > 5
    assert ours(spark, docs, 20) == want


def test_repeats_within_a_text_and_at_its_ends(spark):
    rng = random.Random(5)
    p, q = prose(rng, 30), prose(rng, 30)
    docs = [(1, " ".join([*p, "a", *p, "b", *q])), (2, " ".join(q)), (3, " ".join([*q, *p])), (4, " ".join(q))]
    assert ours(spark, docs, 20) == brute(docs, 20)


def test_awkward_rows(spark):
    rng = random.Random(6)
    p = " ".join(prose(rng, 60))
    schema = DOCS + ", fp long, copies string"
    data = [(1, None, None, None, None, 1, "x"), (None, p, "en", "a", 3, 2, "y"), (2, "", "en", "a", 0, None, None), (3, p, None, "a", 9, 4, "z"), (4, "\n " + p.replace(" ", " \t", 3), "en", None, 1, 5, "z"), (4, "\n " + p.replace(" ", " \t", 3), "en", None, 1, 5, "z")]
    df = spark.createDataFrame(data, schema)
    for hot in (0, 10_000):
        assert grouped(maximal_repeats(df, 20, hot)) == [(60, [(3, 0), (4, 0)])]
    empty = maximal_repeats(df.limit(0), 20)
    assert empty.count() == 0 and empty.columns == ["group_id", "parent_id", "n_words", "n_occurrences", "doc_id", "start"]


@pytest.mark.parametrize("seed", [1, 2])
def test_hot_anchors_give_the_same_groups(spark, seed):
    docs = [*corpus(seed), (500, "b c " * 40), (501, "z " + "b c " * 30), (502, "z " + "b c " * 30)]
    want = brute(docs, 20)
    assert ours(spark, docs, 20, 0) == want
    assert ours(spark, docs, 20, 3) == want


def test_one_word_over_and_over(spark):
    docs = [(1, "a " * 300), (2, "b c " * 70), (3, "z " + "a " * 300)]
    assert ours(spark, docs, 20) == brute(docs, 20)


def test_a_very_long_text(spark):
    rng = random.Random(8)
    words = [f"v{rng.randrange(10**6)}" for _ in range(30_000)]
    docs = [(1, " ".join(words)), (2, " ".join(words[500:700])), (3, " ".join(["x", *words[20_000:]]))]
    assert ours(spark, docs, 50) == [(200, [(1, 500), (2, 0)]), (10_000, [(1, 20_000), (3, 1)])]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_anchors_that_recur_within_a_passage(spark, seed):
    """Lines over and over, and passages right after a part of themselves."""
    rng = random.Random(seed)
    shared = prose(rng, 60)
    docs = []
    for i in range(14):
        d = prose(rng, rng.randrange(30))
        for _ in range(rng.randrange(1, 4)):
            a = rng.randrange(30)
            unit = rng.choice((shared[:a], [f"u{rng.randrange(3)}" for _ in range(a)]))
            d += rng.choice((unit * rng.randrange(2, 6), shared[a : a + 20] + shared, shared)) + prose(rng, rng.randrange(5))
        docs.append((i, " ".join(d)))
    want = brute(docs, 20)
    assert len(want) > 5
    assert ours(spark, docs, 20) == want


def test_periodic_texts(spark):
    docs = [(1, "a " * 200), (2, "b c " * 60), (3, "z " + "a " * 150), (4, "z a")]
    assert ours(spark, docs, 20) == brute(docs, 20)


def test_order_of_places_needs_no_copies():
    rng = random.Random(9)
    texts = [b"a " * 300, b"b c " * 100 + b"a " * 150, b"a " * 200 + b"d "]
    places = [(t, p, rng.randrange(3), rng.randrange(9)) for t in texts for p in range(0, len(t), 2)]
    rng.shuffle(places)
    assert _sorted(places, 0) == _sorted(places, 1 << 30) == sorted(places, key=lambda p: (p[0][p[1] :], p[2], p[3]))


def test_stage_keeps_the_first_place(spark):
    docs = corpus(4)
    df = spark.createDataFrame(rows(docs), DOCS)
    got = {r.doc_id: r.text for r in without_repeats(spark, df, "").collect()}
    texts = {i: t.split() for i, t in docs}
    first: dict = {}
    drop = defaultdict(set)
    for i in sorted(texts):
        for p in range(len(texts[i]) - 49):
            k = tuple(texts[i][p : p + 50])
            if k in first:
                drop[i] |= set(range(p, p + 50))
            first.setdefault(k, i)
    assert any(drop.values())
    for i, w in texts.items():
        left = " ".join(x for p, x in enumerate(w) if p not in drop[i])
        assert got.get(i, "") == left
    assert set(got) == {i for i, w in texts.items() if len(drop[i]) < len(w)}


def test_stack_scan():
    groups, cut = interval_tree([2, 3, 3, 0, 1], [5, 4, 3, 2, 1, 0], lambda value, a, b: True)
    got = sorted((g.value, g.a, g.b, sorted(g.own), g.parent.value if g.parent else None) for g in groups)
    assert got == [(0, 0, 5, [], None), (1, 4, 5, [4, 5], 0), (2, 0, 3, [0], 0), (3, 1, 3, [1, 2, 3], 2)]
    assert cut == [2, 3, 3, 0, 1, 0]


def test_stage_leaves_awkward_rows_alone(spark):
    rng = random.Random(10)
    p, q = (" ".join(prose(rng, 60)) for _ in "pq")
    schema = "doc_id int, text string, __id string, same int, start string"
    data = [(1, p + " tail one", "a", 1, "b"), (2, p, "c", 2, "d"), (2, q, "e", 3, "f"), (3, "", "g", 4, "h"), (4, None, "i", 5, "j"), (None, p, "k", 6, "l"), (5, "  odd\n\n space ", "m", 7, "n"), (6, "x " + p + "\ty", "o", 8, "p"), (6, "x " + p + "\ty", "o", 8, "p")]
    df = spark.createDataFrame(data, schema)
    out = without_repeats(spark, df, "")
    assert out.schema == df.schema
    key = lambda t: [str(x) for x in t]
    got = sorted(map(tuple, out.collect()), key=key)
    want = [data[0], data[2], data[3], data[4], data[5], data[6], (6, "x\ty", "o", 8, "p"), (6, "x\ty", "o", 8, "p")]
    assert got == sorted(want, key=key)
    assert without_repeats(spark, df.limit(0), "").count() == 0
