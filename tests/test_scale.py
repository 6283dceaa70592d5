"""Steps that must not grow faster than their tables, and ranks of equal scores, by small examples."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import functions as F

from palimpsest.operators import graph, search


def test_equal_vectors_meet_once(spark):
    rng = np.random.default_rng(1)
    kinds = [[float(y) for y in v] for v in rng.normal(size=(6, 4))]
    m = spark.createDataFrame([(i, kinds[i % 6]) for i in range(60)], "id long, embedding array<double>")
    q = spark.createDataFrame([(i, kinds[i % 3]) for i in range(12)], "query_id long, query_embedding array<double>")
    got = search.vector_search(m, q, 4)
    rows = {}
    for r in got.collect():
        rows.setdefault(r.query_id, set()).add((r.id, round(r.score, 6)))
    unit = [np.array(v) / np.linalg.norm(v) for v in kinds]
    for i in range(12):
        s = [(-round(float(np.clip(unit[i % 3] @ unit[j % 6], 0, 1)), 9), j) for j in range(60)]
        assert rows[i] == {(j, round(-x, 6)) for x, j in sorted(s)[:4]}
    # What meets the queries in Python is a row for each distinct vector.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "collect_list(id" in plan


def test_query_vectors_go_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BYTES", 64)
    rng = np.random.default_rng(2)
    v = [[float(y) for y in x] for x in rng.normal(size=(20, 4))]
    m = spark.createDataFrame(list(enumerate(v)), "id long, embedding array<double>")
    got = search.vector_search(m, m.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding")), 1)
    assert sorted((r.query_id, r.id) for r in got.collect()) == [(i, i) for i in range(20)]
    assert "Join Cross" not in got._jdf.queryExecution().optimizedPlan().toString()


def _equal_but_for_bits() -> tuple[float, float, float, float]:
    """Scores and confidences a * c = b * d, where the floats' first product with a hop's 0.7 is the greater."""
    grid = [0.5 + i / 100 for i in range(50)]
    seen: dict = {}
    for a, c in itertools.product(grid, grid):
        key, p = round(a * 100) * round(c * 100), a * c * 0.7
        b, d = seen.setdefault(key, (a, c))
        if p > b * d * 0.7:
            return a, c, b, d
    raise AssertionError


def test_equal_causal_scores_rank_by_id(spark):
    a, c, b, d = _equal_but_for_bits()
    seeds = spark.createDataFrame([(1, 10, a), (1, 20, b)], "query_id long, id long, score double")
    edges = spark.createDataFrame([(10, 31, c), (20, 30, d)], "cause long, effect long, confidence double")
    assert [r.id for r in graph.expand_causal(seeds, edges, 1).collect()] == [30]
    mentions = spark.createDataFrame([], "memory_id long, entity string")
    relations = spark.createDataFrame([], "from_entity string, to_entity string, relation string")
    assert [r.id for r in graph.expand_hybrid(seeds, edges, mentions, relations, 1).collect()] == [30]


def test_keyword_search_of_focused_queries_only(spark, monkeypatch):
    from palimpsest.plans import queries

    seen, real = [], search.bm25_search
    monkeypatch.setattr(search, "bm25_search", lambda m, q, *a, **kw: seen.append(q) or real(m, q, *a, **kw))
    queries.QUERIES["entity_focused"](spark, "/root/testdata/sf0.001")
    texts = [r.query_text for r in seen[0].select("query_text").collect()]
    assert texts and all(t.startswith(("What does", "Tell me about", "Show", "List")) for t in texts) and not any("led to" in t for t in texts)


def _said(spark, n: int):
    from palimpsest.plans import more

    e = spark.range(n).selectExpr("id as event_id", "id % 7 as user_id", "array('click', 'error')[id % 2] as event_type", "timestamp_seconds(1704067200 + id * 86400) as ts")
    return e.transform(lambda x: x), more


def test_scores_are_made_once_for_queries_alike(spark, monkeypatch):
    """No product of queries and descriptions: whatever their number, the scores' input has a row for each kind of both."""
    e, more = _said(spark, 40)
    monkeypatch.setattr(more.T, "table", lambda s, d, n: e)
    raw = more.described(spark, "")
    q = spark.createDataFrame([(i, f"Why did User{i} see an error?") for i in range(50)] + [(50 + i, f"What of User{i} before 2024-01-0{i + 1}?") for i in range(3)], "query_id long, query_text string")
    names = q.select("query_id", F.lower(F.regexp_extract("query_text", "User\\d+", 0)).alias("entity"))
    seen = []
    real = search._top_of
    monkeypatch.setattr(search, "_top_of", lambda x, *a, **kw: seen.append(x) or real(x, *a, **kw))
    for kind in ("temporal", "causal", "entity"):
        got = search.slm_search(q, raw, names, 3, kind).collect()
        assert got and max(len([r for r in got if r.query_id == i]) for i in range(53)) <= 3
    temporal, causal, entity = (x.count() for x in seen)
    assert temporal <= 4 * 40 and causal <= 2 * 6 and entity <= 50 * 7 * 2 // 4


def test_time_expressions_are_scored_once_for_queries_alike(spark, monkeypatch):
    m = spark.createDataFrame([(i, f"on 2024-01-{i % 9 + 10} it rained") for i in range(90)], "id long, content string")
    q = spark.createDataFrame([(i, f"what did user{i} do yesterday, on 2024-01-{i % 3 + 10}") for i in range(60)], "query_id long, query_text string")
    seen, real = [], search._top_of
    monkeypatch.setattr(search, "_top_of", lambda x, *a, **kw: seen.append(x) or real(x, *a, **kw))
    one, two = search.temporal_search(m, q, 5).collect(), search.temporal_overlap(m, q, 5).collect()
    assert {(r.query_id, r.id, r.score) for r in one} == {(i, i % 3 + 9 * j, 1.0) for i in range(60) for j in range(5)}
    assert {(r.query_id, r.id) for r in two} == {(i, i % 3 + 9 * j) for i in range(60) for j in range(5)}
    assert seen[0].count() == 3 and seen[1].count() == 3 * 9


def test_keywords_of_few_queries_are_scored_in_the_tasks(spark, monkeypatch):
    m = spark.createDataFrame([(i, f"apple {'pear ' * (i % 4)}plum{i % 5} of the tree") for i in range(60)] + [(60, None), (61, "")], "id long, content string")
    q = spark.createDataFrame([(1, "pears and apples"), (2, "plum3 plum3 pear"), (3, "nothing known"), (4, None)], "query_id long, query_text string")
    for stem in (True, False):
        few = search.bm25_search(m, q, 7, stem)
        plan = few._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "Join" not in plan
        with monkeypatch.context() as c:
            c.setattr(search, "FEW_QUERIES", 0)
            many = search.bm25_search(m, q, 7, stem).collect()
        assert {(r.query_id, r.id, round(r.score, 7)) for r in few.collect()} == {(r.query_id, r.id, round(r.score, 7)) for r in many}


def test_no_keyword_at_all(spark):
    m = spark.createDataFrame([(1, "apple tree")], "id long, content string")
    q = spark.createDataFrame([(1, "of the")], "query_id long, query_text string")
    assert search.bm25_search(m, q, 3).collect() == []


def test_facts_are_merged_before_names_are_looked_up(spark):
    from palimpsest.operators import profile

    f = spark.createDataFrame([("shop", "organization", "event", "sells", 0.5 + i % 3 / 10, i) for i in range(40)], "entity string, entity_type string, fact_type string, value string, confidence double, source_memory long")
    x = profile.merged(f)
    assert [(r.entity, r.confidence, r.source_memory) for r in x.collect()] == [("shop", 0.7, 0)]
    assert "SortAggregate" not in x._jdf.queryExecution().sparkPlan().toString()


def test_many_keyword_queries_meet_memories_by_rare_words(spark, monkeypatch):
    """Common words make no product of queries and memories, whether few or many queries share them, and the rows stay the same."""
    m = spark.createDataFrame([(i, f"user{i % 20} had purchase{' on monday' * (i % 3)} value {'again ' * (i % 4)}x{i}") for i in range(400)] + [(400, None), (401, "")], "id long, content string")
    kinds = ("show purchase of {}", "why {} and {} again again", "value on monday", "unknown to all", "user1 or {} purchase monday")
    q = spark.createDataFrame([(i, kinds[i % 5].replace("{}", f"user{i // 5 % 25}")) for i in range(200)] + [(200, None)], "query_id long, query_text string")
    want = {(r.query_id, r.id, round(r.score, 7)) for r in search.bm25_search(m, q, 7, stem=False).collect()}
    seen, real = [], search.top
    monkeypatch.setattr(search, "top", lambda x, *a, **kw: seen.append(x) or real(x, *a, **kw))
    monkeypatch.setattr(search, "FEW_PAIRS", 1000)
    for few in (0, 3, 2048):
        monkeypatch.setattr(search, "FEW_QUERIES", few)
        monkeypatch.setattr(search, "FEW_WORDS", -1)
        seen.clear()
        got = search.bm25_search(m, q, 7, stem=False).collect()
        assert {(r.query_id, r.id, round(r.score, 7)) for r in got} == want and len(got) == len(want)
        assert seen[-1].count() < 200 * 50  # of 200 * 400
