from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from palimpsest.engine import Memory
from palimpsest.operators import fusion, graph
from palimpsest.streaming.ingest import ingest, window_counts

ROWS = [(1, "Ann bought a red bicycle", [1.0, 0.0], dt.datetime(2024, 1, 1), "a"), (2, "Bob sold the bicycle", [0.8, 0.6], dt.datetime(2024, 1, 2), "a"), (3, "rain in spring", [0.0, 1.0], dt.datetime(2024, 1, 3), "b"), (4, "wrong", [1.0], dt.datetime(2024, 1, 3), "b")]


def rows(spark):
    return spark.createDataFrame(ROWS, "id long, content string, embedding array<double>, created_at timestamp, namespace string")


def test_life_of_a_store(spark, tmp_path):
    m = Memory(spark, dim=2).add_batch(rows(spark))
    assert m.count() == 3 and [r.id for r in m.errors.collect()] == [4]
    m.add_mentions(spark.createDataFrame([(1, "Ann"), (2, "Bob")], "memory_id long, entity string"))
    m.add_causal_links(spark.createDataFrame([(1, 2, 0.9), (2, 3, 1.5)], "cause long, effect long, confidence double"))
    assert m.errors.count() == 1
    q = spark.createDataFrame([(7, "bicycle of Ann", [1.0, 0.0])], "query_id long, query_text string, query_embedding array<double>")
    assert [r.id for r in m.search(q, 2).orderBy(F.desc("score")).collect()] == [1, 2]
    assert [r.id for r in m.query(q, 2).orderBy("rank").collect()] == [1, 2]
    m.save(str(tmp_path / "s"))
    again = Memory.open(spark, str(tmp_path / "s"), dim=2)
    assert again.count("a") == 2
    again.delete(spark.createDataFrame([(1,)], "id long"))
    assert (again.count(), again.edges.count(), again.mentions.count()) == (2, 0, 1)
    assert again.add_with_dedup(rows(spark)).count() == 3


def test_empty_store(spark):
    m = Memory(spark, dim=2)
    q = spark.createDataFrame([(7, "x", [1.0, 0.0])], "query_id long, query_text string, query_embedding array<double>")
    assert m.query(q).count() == 0 and m.list_namespaces().count() == 0


def test_mmr_as_written_out(spark):
    rng = np.random.default_rng(3)
    n, limit = 40, 6
    v, s = rng.normal(size=(n, 4)), rng.random(n)
    m = spark.createDataFrame([(i, v[i].tolist()) for i in range(n)], "id long, embedding array<double>")
    f = spark.createDataFrame([(1, i, float(s[i])) for i in range(n)], "query_id long, id long, fused_score double")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    pool = sorted(range(n), key=lambda i: (-s[i], i))[: 5 * limit]
    want: list[int] = []
    while len(want) < limit:
        want.append(max((i for i in pool if i not in want), key=lambda i: 0.9 * s[i] - 0.1 * max([0.0, *(min(1.0, max(0.0, u[i] @ u[j])) for j in want)])))
    assert [r.id for r in fusion.select_mmr(f, m, limit).orderBy("rank").collect()] == want


def test_paths_on_a_cycle(spark):
    e = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.5), (3, 1, 0.5), (1, 3, 0.1)], "cause long, effect long, confidence double")
    x = {r.id: (r.hops, round(r.confidence, 3)) for r in graph.paths(e, spark.createDataFrame([(1,)], "id long"), 5).collect()}
    assert x == {2: (1, 0.5), 3: (1, 0.1)}


def test_stream_adds_each_content_once(spark, tmp_path):
    kind = "id long, content string"
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], kind).write.parquet(str(tmp_path / "in"))
    run = lambda: ingest(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    spark.createDataFrame([(5, "b"), (6, "c")], kind).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 6]


def test_windows(spark):
    x = spark.createDataFrame([(dt.datetime(2024, 1, 1, 3), "a", 1.0), (dt.datetime(2024, 1, 1, 5), "a", 2.0)], "ts timestamp, event_type string, value double")
    assert [tuple(r)[1:] for r in window_counts(x).collect()] == [("a", 2, 3.0)]
