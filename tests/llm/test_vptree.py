from __future__ import annotations

import numpy as np
import pytest

from palimpsest.llm.vptree import EVERY, neighbours

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(x: dict, k: int):
    ids = np.array(sorted(x))
    m = np.array([x[i] for i in ids], np.float64)
    out = {}
    for n, i in enumerate(ids):
        d = np.sqrt(((m - m[n]) ** 2).sum(1))
        d[n] = np.inf
        order = np.lexsort((ids, d))[:k]
        out[int(i)] = [(int(ids[j]), d[j]) for j in order if np.isfinite(d[j])]
    return out


def found(df):
    out: dict = {}
    for r in sorted(df.collect(), key=lambda r: (r.vec_id, r.rank)):
        out.setdefault(r.vec_id, []).append((r.neighbor_id, r.distance))
    return out


def data(seed, n, dim, clusters):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(clusters, dim)) * 2
    x = centre[rng.integers(0, clusters, n)] + rng.normal(size=(n, dim))
    x[5] = x[4]
    x[7] = x[4]
    return {i * 7: v.astype(np.float32).tolist() for i, v in enumerate(x)}


@pytest.mark.parametrize("shard, block", [(10_000, 10_000), (60, 100)])
def test_factor_one_is_exact(spark, shard, block):
    x = data(1, 900, 8, 6)
    got = found(neighbours(spark.createDataFrame([(i, v, 0) for i, v in x.items()], SCHEMA), 5, 1.0, shard, block))
    want = brute(x, 5)
    for i in x:
        assert [a for a, _ in got[i]] == [a for a, _ in want[i]]
        assert np.allclose([d for _, d in got[i]], [d for _, d in want[i]])


def test_recall_of_the_query(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = {r.vec_id: r.embedding for r in df.collect()}
    want = brute(x, 10)
    ask = [i for i in x if i % EVERY == 0]
    for shard in (8192, 200):
        got = found(neighbours(df, shard=shard, every=EVERY))
        hit = sum(len({a for a, _ in got[i]} & {a for a, _ in want[i]}) for i in ask)
        assert set(got) == set(ask) and hit >= 0.95 * 10 * len(ask)


def test_copies_of_one_vector_are_parted(spark):
    x = data(3, 300, 4, 3)
    x |= {10_000 + i: x[0] for i in range(300)}
    got = found(neighbours(spark.createDataFrame([(i, v, 0) for i, v in x.items()], SCHEMA), 4, 1.0, 20, 50))
    want = brute(x, 4)
    assert all([a for a, _ in got[i]] == [a for a, _ in want[i]] for i in x)


def test_awkward_rows(spark):
    rows = [(1, None, 0), (2, [], 0), (None, [1.0, 2.0], 0), (3, [1.0, None], 0), (4, [float("nan"), 1.0], 0), (5, [0.0, 0.0], 0), (6, [0.0, 0.0], 0), (7, [3.0, 4.0], None), (7, [3.0, 4.0], None), (8, [1.0, 1.0, 1.0], 0), (9, [float("inf"), 1.0], 0), (7, [9.0, 9.0], 1)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", rank long, distance string")
    got = found(neighbours(df))
    assert got == {5: [(6, 0.0), (7, 5.0)], 6: [(5, 0.0), (7, 5.0)], 7: [(5, 5.0), (6, 5.0)]}
    assert neighbours(df.limit(0)).count() == 0
