from __future__ import annotations

from corpus import DOCS
from test_rules import AWKWARD

from palimpsest.llm.mixing import mixed, mixing_stage

SF = "/root/testdata/sf0.001"


def test_given_weights(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    all_tokens = {r.source: 0 for r in df.select("source").distinct().collect()}
    sizes = dict(all_tokens)
    for r in df.collect():
        sizes[r.source] += len(r.text.split())
    got = mixed(df, (10, 40), {"src0": 3, "src1": 1, "src2": 0}).collect()
    total = sum(sizes.values())
    for s, share in (("src0", 0.75), ("src1", 0.25)):
        for tier in (10, 40):
            have = sum(r.n_tokens for r in got if r.source == s and r.tier <= tier)
            assert have <= tier / 100 * total * share
            assert have == sizes[s] or have > tier / 100 * total * share - 6000
    assert {r.source for r in got} <= {"src0", "src1"}


def test_awkward_rows(spark):
    df = spark.createDataFrame(AWKWARD, DOCS + ", h long, tier string")
    got = sorted(((r.doc_id or 0), r.n_tokens) for r in mixed(df, (100,)).collect())
    assert got and set(got) <= {(0, 2), (1, 0), (2, 0), (3, 100_000), (4, 2)}
    kept = mixing_stage(spark, df, "")
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(4) in (0, 2)
    assert mixed(df.limit(0)).count() == 0 and mixing_stage(spark, df.limit(0), "").count() == 0
