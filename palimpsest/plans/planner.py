"""All stages of a query, for a table of queries at once."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import fusion, graph, search, store
from ..sources import tables as T


def _with_vectors(df: DataFrame, key: str, e: DataFrame, name: str) -> DataFrame:
    n = e.agg(F.count("*").alias("__n"))
    v = e.select(F.col("vec_id").alias("__v"), F.col("embedding").cast("array<double>").alias(name))
    return df.crossJoin(F.broadcast(n)).withColumn("__v", F.col(key) % F.col("__n")).join(v, "__v").drop("__v", "__n")


def notes_with_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as memories; each takes the vector of its number, counted round."""
    return _with_vectors(T.notes(spark, sf_dir), "id", T.table(spark, sf_dir, "embeddings"), "embedding")


def questions_with_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_vectors(T.questions(spark, sf_dir), "query_id", T.table(spark, sf_dir, "embeddings"), "query_embedding")


class Trace:
    """What each stage of a run gave: rows and time since the run began, known once its result was computed."""

    def __init__(self) -> None:
        self.began = time.time()
        self._seen: list[tuple[str, float, Observation]] = []

    def stage(self, name: str, df: DataFrame) -> DataFrame:
        o = Observation(name)
        self._seen.append((name, time.time() - self.began, o))
        return df.observe(o, F.count(F.lit(1)).alias("rows"))

    def steps(self) -> list[dict]:
        """(name, planned after so many seconds, rows); waits for the run's result, so call it after an action."""
        return [{"name": n, "planned_s": t, **o.get} for n, t, o in self._seen]


def _most(a: DataFrame, *others: DataFrame) -> DataFrame:
    for b in others:
        a = a.unionByName(b.select("query_id", "id", "score"))
    return a.groupBy("query_id", "id").agg(F.max("score").alias("score"))


def focused(memories: DataFrame, queries: DataFrame, facts: DataFrame, mentions: DataFrame, limit: int, stem: bool = False, texts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(query_id, entity) of the queries about one known entity, and their results by the short way. ``texts`` are the memories, where these are at hand without vectors."""
    i = queries.select("query_id", "query_embedding", F.lower(tx.intent(F.col("query_text"))["entity_focus"]).alias("entity")).where("entity is not null")
    ask = i.join(mentions.select("entity").distinct(), "entity", "left_semi")
    q = queries.join(ask.select("query_id"), "query_id", "left_semi")
    boost = search.fact_search(facts, ask.select("query_id", "entity"), q, limit * 20, stem)[0]
    out = search.entity_focused(ask, memories, mentions, search.bm25_search(memories if texts is None else texts, q, limit * 20, stem), boost, limit)
    return ask.select("query_id", "entity"), out


def run(
    memories: DataFrame, queries: DataFrame, *, facts: DataFrame, mentions: DataFrame, relations: DataFrame, edges: DataFrame, limit: int = 10,
    namespace: str | None = None, filters: list[dict] | None = None, turns: DataFrame | None = None, strategy: str = "rrf", expand: bool = True, adaptive: float = 0.0, stem: bool = False,
    user: str | None = None, gate: float = 0.3, described: DataFrame | None = None, fact_vectors: DataFrame | None = None, trace: Trace | None = None,
) -> DataFrame:
    """(query_id, id, fused_score, rank): intent, five searches, profiles, fusion, confidence, speaker, expansion, MMR, coverage.

    ``memories`` has id, content, embedding, created_at, speaker (and namespace, metadata if filters are given); ``queries``
    query_id, query_text, query_embedding. Filters apply before the searches, so each keeps its full depth. Queries about
    one known entity take the short way. ``user`` is who says I. ``described`` (id, raw) is what a model said of the memories, whose scores
    go before those of their texts. ``fact_vectors`` are facts with an embedding, compared with the query's. ``trace`` gets each stage's rows.
    """
    see = lambda name, df: store.settled(trace.stage(name, df) if trace else df)
    m = store.filtered(memories, filters, namespace) if filters or namespace is not None else memories
    depth = limit * 5
    # Queries are few bytes that take much time: parted by number, as partitions by bytes would be one or two.
    spread = 4 * queries.sparkSession.sparkContext.defaultParallelism
    every = store.settled(queries.select("query_id", "query_text", "query_embedding").repartition(spread, "query_id"))
    facts = store.settled(facts)
    # So are texts that each search reads again; vectors are joined where they are used, as they take most of the bytes.
    texts = store.settled(m.select("id", "content", "speaker").repartition(spread, "id"))
    ask, short = focused(m, every, facts, mentions, limit, stem, texts)
    ask, short = see("focus", ask), see("focused results", short)
    q = store.settled(every.join(ask.select("query_id"), "query_id", "left_anti").repartition(spread, "query_id"))
    intents = see("intents", q.select("query_id", tx.intent(F.col("query_text")).alias("i")).select("query_id", "i.intent"))
    asked = see("entities", search.with_user(search.detect_entities(q, facts.select("entity").distinct(), True), q, user))
    semantic = see("semantic", search.vector_search(m, q, depth))
    keyword = see("bm25", search.max_norm(search.bm25_search(texts, q, depth, stem)))
    temporal, causal = see("temporal", search.temporal_search(texts, q, depth)), see("causal", search.causal_search(texts, q, edges, depth))
    found = see("mentions", search.entity_search(asked, mentions, relations, limit * 3))
    lost = asked.join(found.select("query_id").distinct(), "query_id", "left_anti")
    found = found.select("query_id", "id", "score").unionByName(search.entity_keyword_search(texts, lost, limit * 3, stem))
    if described is not None:
        known = described.join(texts.select("id"), "id", "left_semi")
        temporal, causal, found = (
            search.slm_search(q, known, asked, depth, kind).unionByName(own.join(known.select("id"), "id", "left_anti").select("query_id", "id", "score"))
            for kind, own in (("temporal", temporal), ("causal", causal), ("entity", found))
        )
    fact_scores, _ = search.fact_search(facts, asked, q, limit, stem)
    if fact_vectors is not None:
        fact_scores = _most(fact_scores, search.fact_embedding_search(fact_vectors, q, asked, limit))
    entity = search.inject_profiles(found, asked, facts, relations, fact_scores, limit)
    entity = see("entity", entity.join(texts.select("id"), "id", "left_semi").select("query_id", "id", "score"))
    if expand:
        seeds = see("seeds", _most(semantic.select("query_id", "id", "score"), keyword))
        more = graph.expansion_policy(seeds, intents, edges, mentions, relations, depth)
        more = see("expanded", more.join(texts.select("id"), "id", "left_semi").select("query_id", "id", "dim", "score"))
        temporal, causal, entity = (_most(own.select("query_id", "id", "score"), more.where(F.col("dim") == d)) for d, own in (("temporal", temporal), ("causal", causal), ("entity", entity)))
    semantic = see("gate", search.semantic_gate(semantic, entity, q, gate))
    scores = fusion.tagged(semantic=semantic, bm25=keyword, temporal=temporal, causal=causal, entity=entity)
    fused = fusion.fuse_rrf(scores) if strategy == "rrf" else fusion.fuse_weighted(scores, intents)
    fused = fusion.adjust_confidence(fused, intents)
    fused = see("fused", fusion.rerank_speaker(fused, texts, asked))
    fused = see("collected", fusion.expand_aggregation(fused, q, asked, mentions, m))
    if turns is not None:
        fused = fusion.bridge_dialog(fused, turns, q)
    # MMR and coverage hold at most 5 * limit rows of a query; coverage works on what MMR chose.
    picked = store.settled(fusion.select_mmr(fused, m, limit))
    picked = fusion.select_coverage(picked.drop("rank"), texts, q, limit)
    picked = fusion.adaptive_k(picked.drop("rank"), adaptive, limit) if adaptive else picked
    out = picked.select("query_id", "id", "fused_score", "rank").unionByName(short.select("query_id", "id", "fused_score", "rank"))
    return trace.stage("results", out) if trace else out
