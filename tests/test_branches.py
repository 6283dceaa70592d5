"""Branches of the planner, hooks, scopes and streams by small examples."""

from __future__ import annotations

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from palimpsest.engine import Memory
from palimpsest.errors import InvalidFilter, InvalidInput, NotConfigured
from palimpsest.functions import text as tx
from palimpsest.functions.stem import stem
from palimpsest.operators import fusion, search, store
from palimpsest.streaming.ingest import flush_pending, latest, log, upsert

MEM = "id long, content string, embedding array<double>, speaker string, namespace string"


def test_stop_words_of_both_lists(spark):
    x = spark.createDataFrame([("They came from the far north",)], "t string").select(tx.bm25_tokens(F.col("t"), False).alias("a"), tx.fact_words(F.col("t"), False).alias("b")).first()
    assert x.a == ["came", "far", "north"] and "from" not in x.b and "came" in x.b


def test_gate_has_two_bounds_and_spares_linked_memories(spark):
    q = spark.createDataFrame([(1, "what did he say"), (2, "list all of his hobbies")], "query_id long, query_text string")
    s = spark.createDataFrame([(k, i, v) for k in (1, 2) for i, v in ((1, 0.3), (2, 0.2), (3, 0.15), (4, 0.1), (5, 0.01))], "query_id long, id long, score double")
    linked = spark.createDataFrame([(1, 5, 0.4)], "query_id long, id long, score double")
    got = sorted((r.query_id, r.id) for r in search.semantic_gate(s, linked, q).collect())
    assert got == [(1, 1), (1, 5), (2, 1), (2, 2), (2, 3)]


def test_first_person_adds_the_user_and_leaves_the_text(spark):
    q = spark.createDataFrame([(1, "What do I like?"), (2, "What does Ann like?"), (3, "Is it mine")], "query_id long, query_text string")
    none = spark.createDataFrame([(2, "ann")], "query_id long, entity string")
    assert sorted(map(tuple, search.with_user(none, q, "Bob").collect())) == [(1, "bob"), (2, "ann"), (3, "bob")]


def test_names_of_several_words(spark):
    q = spark.createDataFrame([(1, "When did Mary Ann Lee's sister call?"), (2, "maryann lee"), (3, "Tell C++ fans")], "query_id long, query_text string")
    n = spark.createDataFrame([("mary ann",), ("mary ann lee",), ("lee",), ("c++",)], "entity string")
    assert sorted(map(tuple, search.detect_entities(q, n).collect())) == [(1, "lee"), (1, "mary ann"), (1, "mary ann lee"), (2, "lee"), (3, "c++")]


def test_stemmed_search_by_hand(spark):
    docs = ["running dogs run", "the dog ran", "cats and their kittens", "a dog's running shoes, running fast"]
    m = spark.createDataFrame(list(enumerate(docs)), "id long, content string")
    q = spark.createDataFrame([(1, "dogs running")], "query_id long, query_text string")
    stops = set(tx.KEYWORD_STOPS)
    toks = [[stem(w) for w in (x.strip(",") for x in d.lower().split()) if len(w) > 1 and w not in stops] for d in docs]
    avg, n = sum(map(len, toks)) / len(toks), len(toks)
    want = {}
    for i, t in enumerate(toks):
        c = Counter(t)
        s = sum(math.log((n - df + 0.5) / (df + 0.5) + 1) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * len(t) / avg)) for w in (stem("dogs"), stem("running")) if (df := sum(w in u for u in toks)) and c[w])
        if s:
            want[i] = round(s, 6)
    assert {r.id: round(r.score, 6) for r in search.bm25_search(m, q, 10).collect()} == want


def test_coverage_takes_what_adds_words(spark):
    m = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha beta gamma"), (3, "delta epsilon zeta eta"), (4, "alpha delta")], "id long, content string")
    q = spark.createDataFrame([(1, "list all things")], "query_id long, query_text string")
    f = spark.createDataFrame([(1, i, 0.5 - i / 100) for i in (1, 2, 3, 4)], "query_id long, id long, fused_score double")
    assert [r.id for r in fusion.select_coverage(f, m, q, 2).orderBy("rank").collect()] == [1, 3]


def _store(spark) -> Memory:
    m = Memory(spark, 2)
    return m.add_batch(spark.createDataFrame([(1, "I love tea", [1.0, 0.0], "Ann", "a"), (2, "Tea is hot", [0.0, 1.0], "Bob", "b"), (3, "I love tea", [1.0, 1.0], None, "b")], MEM))


def test_scope_sees_and_changes_only_its_own(spark):
    m = _store(spark)
    b = m.scope("b")
    assert b.count() == 2 and sorted(r.id for r in b.list_ids().collect()) == [2, 3]
    b.add_with_dedup(spark.createDataFrame([(4, "I love tea", [1.0, 0.0], "C", "zzz"), (5, "new", [1.0, 0.0], "C", "zzz")], MEM))
    assert sorted(r.id for r in b.list_ids().collect()) == [2, 3, 5]
    b.delete(spark.createDataFrame([(1,), (2,)], "id long"))
    assert sorted(r.id for r in m.list_ids().collect()) == [1, 3, 5]
    b.delete_all()
    assert [r.id for r in m.list_ids().collect()] == [1]


def test_hooks_and_errors(spark):
    m = _store(spark)
    with pytest.raises(NotConfigured):
        m.rebuild_speaker_embeddings()
    with pytest.raises(NotConfigured):
        m.last_query_trace()
    with pytest.raises(InvalidInput):
        m.add_batch(spark.createDataFrame([(1,)], "id long"))
    with pytest.raises(InvalidFilter):
        store.filtered(m.memories, [{"field": "x", "op": "like", "value": 1}])
    m.set_embedding_fn(lambda c: F.array(F.length(c).cast("double"), F.lit(2.0)))
    m.rebuild_speaker_embeddings()
    assert {r.id: r.embedding for r in m.memories.collect()} == {1: [float(len("Ann love tea")), 2.0], 2: [0.0, 1.0], 3: [1.0, 1.0]}

    def say(batches):
        for df in batches:
            df["extraction"] = '{"entities": [], "entity_facts": [{"entity": "Ann", "fact_type": "food", "value": "tea leaves"}]}'
            yield df[["id", "extraction"]]

    m.set_llm_extractor(say).flush_extraction(spark.createDataFrame([(2,)], "id long"))
    assert [(r.entity, r.value, r.source_memory) for r in m.facts.collect()] == [("ann", "tea leaves", 1)]
    assert sorted(map(tuple, m.mentions.collect())) == [(1, "ann"), (3, "ann")]


def test_streams_of_changes_and_of_pending_work(spark, tmp_path):
    kind = "id long, created_at timestamp, k string, content string, speaker string"
    at = "2024-01-01 00:00:00"
    rows = lambda *x: spark.createDataFrame(list(x), "id long, t string, k string, content string, speaker string").selectExpr("id", "cast(t as timestamp) as created_at", "k", "content", "speaker")
    rows((1, at, "a", "x", "s"), (2, at, "b", "y", "s"), (3, at, None, "z", "s")).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    run = lambda: upsert(read(), str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    run()
    rows((4, "2020-01-01 00:00:00", "a", "later batch", "s")).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    now = latest(log(spark, str(tmp_path / "log"), kind), "k")
    assert sorted(r.id for r in now.collect()) == [2, 3, 4]

    def extract(batches):
        for df in batches:
            df["extraction"] = df["content"].str.upper()
            yield df[["id", "extraction"]]

    flush_pending(read(), extract, str(tmp_path / "done"), str(tmp_path / "cp2")).awaitTermination()
    assert {r.id: r.extraction for r in spark.read.parquet(str(tmp_path / "done")).collect()}[4] == "LATER BATCH"
