from __future__ import annotations

import numpy as np
from corpus import DOCS
from pyspark.sql import functions as F

from palimpsest.llm.factorisation import BINS, META, RANK, SIZE, Model, score, scored, sparse, trained

SF = "/root/testdata/sf0.1"


def test_linear_time_score_is_the_pairwise_sum():
    rng = np.random.default_rng(1)
    model = Model(0.3, rng.normal(size=SIZE), rng.normal(size=(RANK, SIZE)))
    r, f, x = sparse([b"a b c a d", b"", b"The 12 cats !! ran"], ["en", None, "de"], ["s", "t", None])
    got = score(model, r, f, x, 3)
    for i in range(3):
        at = np.flatnonzero(r == i)
        want = model.bias + sum(model.weight[f[j]] * x[j] for j in at)
        want += sum(model.factor[:, f[a]] @ model.factor[:, f[b]] * x[a] * x[b] for n, a in enumerate(at) for b in at[n + 1 :])
        assert abs(got[i] - want) < 1e-9
    assert f.max() == BINS + META + 7


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    train, test = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    model = trained(docs, train)
    got = scored(docs, model).join(test, "doc_id").groupBy("quality", "keep").count().collect()
    n = {(r.quality, r.keep): r["count"] for r in got}
    assert n.get((1, True), 0) >= 0.99 * sum(v for (q, _), v in n.items() if q == 1)
    assert n.get((0, False), 0) >= 0.9 * sum(v for (q, _), v in n.items() if q == 0)


def test_awkward_rows(spark):
    data = [(1, None, None, None, None, 1, "x"), (None, "a b", "en", "a", 3, 2, "y"), (2, "", "en", "a", 0, None, None), (3, "z " * 300_000, None, "a", 9, 4, "z"), (4, "a b", "en", None, 1, 5, "z"), (4, "a b", "en", None, 1, 5, "z")]
    df = spark.createDataFrame(data, DOCS + ", label long, feat string")
    labels = spark.createDataFrame([(3, 0), (4, 1), (4, 1), (None, 1), (99, 1), (1, None)], "doc_id long, quality int")
    model = trained(df, labels)
    got = {(r.doc_id, r.keep, r.score is None) for r in scored(df, model).collect()}
    assert (1, False, True) in got and (2, False, True) in got and (4, True, False) in got and (3, False, False) in got
    assert scored(df.limit(0), model).count() == 0
    none = scored(df, trained(df, labels.limit(0))).where(F.col("doc_id") == 4).first().score
    assert abs(none - 0.5) < 0.05
