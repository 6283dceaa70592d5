"""Fusion of the dimensions, and the chain of re-scoring after it.

fused(query_id, id, semantic, bm25, temporal, causal, entity, fused_score, confidence)
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.vector import cosine, norm
from .store import micros

DIMS = ("semantic", "bm25", "temporal", "causal", "entity")
WEIGHTS = {"temporal": (0.35, 0.20, 0.35, 0.05, 0.05), "causal": (0.35, 0.20, 0.05, 0.35, 0.05), "entity": (0.35, 0.20, 0.05, 0.05, 0.35), "factual": (0.50, 0.30, 0.10, 0.05, 0.05)}
SMOOTH, ENTITY_WEIGHT = 60, 0.3


def tagged(**dims: DataFrame) -> DataFrame:
    """(query_id, id, dim, score) of scores by dimension."""
    return reduce(DataFrame.unionByName, (d.select("query_id", "id", F.lit(k).alias("dim"), "score") for k, d in dims.items()))


def _wide(scores: DataFrame, *more: Column) -> DataFrame:
    """One row for each query and memory: a conditional maximum for each dimension, in one shuffle instead of four joins."""
    each = [F.coalesce(F.max(F.when(F.col("dim") == d, F.col("score"))), F.lit(0.0)).alias(d) for d in DIMS]
    return scores.groupBy("query_id", "id").agg(*each, *more)


def gate(fused: DataFrame) -> DataFrame:
    return fused.where("semantic >= 0.15 or bm25 >= 0.3")


def fuse_rrf(scores: DataFrame) -> DataFrame:
    """Reciprocal ranks, summed over the dimensions."""
    place = F.row_number().over(Window.partitionBy("query_id", "dim").orderBy(F.desc("score"), "id"))
    w = F.when(F.col("dim") == "entity", ENTITY_WEIGHT).otherwise(1.0)
    ranked = scores.withColumn("r", w / (SMOOTH + place))
    return gate(_wide(ranked, F.sum("r").alias("fused_score")))


def fuse_weighted(scores: DataFrame, intents: DataFrame) -> DataFrame:
    """Weighted sums; the weights follow the query's intent (query_id, intent)."""
    rows = [F.struct(F.lit(k).alias("intent"), *(F.lit(x / sum(v)).alias(f"w_{d}") for d, x in zip(DIMS, v))) for k, v in WEIGHTS.items()]
    pick = F.filter(F.array(*rows), lambda r: r["intent"] == F.col("intent"))[0]
    x = _wide(scores).join(intents.select("query_id", pick.alias("w")), "query_id")
    return gate(x.withColumn("fused_score", sum((F.col(d) * F.col(f"w.w_{d}") for d in DIMS), F.lit(0.0))).drop("w"))


def adjust_confidence(fused: DataFrame, intents: DataFrame) -> DataFrame:
    """Scores times a confidence that grows with the number of dimensions that found the memory."""
    n = sum((F.when(F.col(d) > 0, 1).otherwise(0) for d in DIMS), F.lit(0))
    alone = F.when(F.col("intent").isin("factual", "entity"), 0.7).otherwise(0.4)
    c = F.when(n >= 5, 1.0).when(n == 4, 0.9).when(n == 3, 0.8).when(n == 2, 0.6).when(n == 1, alone).otherwise(0.2)
    x = fused.join(intents.select("query_id", "intent"), "query_id").withColumn("confidence", c)
    return x.withColumn("fused_score", F.col("fused_score") * F.col("confidence")).drop("intent")


def rerank_speaker(fused: DataFrame, memories: DataFrame, detected: DataFrame) -> DataFrame:
    """A fifth of the score for other speakers, where the query names exactly one entity."""
    one = detected.groupBy("query_id").agg(F.count("*").alias("n"), F.min("entity").alias("who")).where("n = 1").select("query_id", "who")
    x = fused.join(one, "query_id", "left").join(memories.select("id", F.lower("speaker").alias("said")), "id", "left")
    other = F.col("who").isNotNull() & F.col("said").isNotNull() & (F.col("who") != F.col("said"))
    return x.withColumn("fused_score", F.when(other, F.col("fused_score") * 0.2).otherwise(F.col("fused_score"))).drop("who", "said")


def expand_aggregation(fused: DataFrame, queries: DataFrame, detected: DataFrame, mentions: DataFrame, memories: DataFrame, most: int = 5) -> DataFrame:
    """For queries that collect, of one entity: up to five of its other memories unlike the ten best so far."""
    one = detected.groupBy("query_id").agg(F.count("*").alias("n"), F.min("entity").alias("entity")).where("n = 1")
    ask = queries.where(tx.query_type(F.col("query_text")) == "aggregation").select("query_id", "query_embedding").join(one.select("query_id", "entity"), "query_id")
    vec = memories.select("id", "embedding", norm("embedding").alias("norm"))
    new = ask.join(mentions, "entity").select("query_id", F.col("memory_id").alias("id"), "query_embedding").join(fused.select("query_id", "id"), ["query_id", "id"], "left_anti").join(vec, "id")
    best = Window.partitionBy("query_id").orderBy(F.desc("fused_score"), "id")
    ten = fused.withColumn("r", F.row_number().over(best)).where("r <= 10").select("query_id", "id").join(vec, "id").groupBy("query_id").agg(F.collect_list(F.struct("embedding", "norm")).alias("ten"))
    near = F.array_max(F.transform("ten", lambda v: cosine(F.col("embedding"), v["embedding"], F.col("norm"), v["norm"])))
    x = new.join(ten, "query_id", "left").where(F.coalesce(near, F.lit(0.0)) < 0.8)
    x = x.withColumn("s", 0.7 * F.greatest(cosine(F.col("query_embedding"), F.col("embedding")), F.lit(0.0))).withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "id"))).where(F.col("n") <= most)
    zero = [F.lit(0.0).alias(d) for d in ("bm25", "temporal", "causal")]
    add = x.select("query_id", "id", (F.col("s") / 0.7).alias("semantic"), *zero, F.lit(0.5).alias("entity"), F.col("s").alias("fused_score"), F.lit(0.7).alias("confidence"))
    return fused.select(add.columns).unionByName(add)


def bridge_dialog(fused: DataFrame, turns: DataFrame, queries: DataFrame, least: float = 0.05) -> DataFrame:
    """Turns one or two before and after each of the three best, where they are like the query; the best parent counts.

    ``turns`` has id, conv, turn, embedding. The band join is an equi-join on the turn's number.
    """
    best = Window.partitionBy("query_id").orderBy(F.desc("fused_score"), "id")
    parent = fused.withColumn("r", F.row_number().over(best)).where((F.col("r") <= 3) & (F.col("fused_score") >= least))
    at = parent.select("query_id", "id", "fused_score").join(turns.select("id", "conv", "turn"), "id")
    want = at.select("query_id", "fused_score", "conv", "turn", F.explode(F.array(*map(F.lit, (-2, -1, 1, 2)))).alias("delta")).select("query_id", "fused_score", "conv", (F.col("turn") + F.col("delta")).alias("turn")).where("turn >= 1")
    near = want.groupBy("query_id", "conv", "turn").agg(F.max("fused_score").alias("p"))
    x = near.join(turns, ["conv", "turn"]).join(fused.select("query_id", "id"), ["query_id", "id"], "left_anti").join(queries.select("query_id", "query_embedding"), "query_id")
    x = x.withColumn("c", cosine(F.col("query_embedding"), F.col("embedding"))).where("c >= 0.2")
    zero = [F.lit(0.0).alias(d) for d in ("bm25", "temporal", "causal")]
    add = x.select("query_id", "id", F.col("c").alias("semantic"), *zero, (0.8 * F.col("p")).alias("entity"), (0.8 * F.col("p")).alias("fused_score"), F.lit(0.6).alias("confidence"))
    return fused.select(add.columns).unionByName(add)


def _greedy_mmr(score: np.ndarray, vec: list, limit: int, lam: float) -> list[int]:
    n = len(score)
    size = np.array([0 if v is None else len(v) for v in vec])
    unit = np.zeros((n, max(size, default=0)))
    for i, v in enumerate(vec):
        if size[i]:
            unit[i, : size[i]] = np.asarray(v, float) / max(np.linalg.norm(v), 1e-300)
    near = np.zeros(n)
    value = lam * np.asarray(score, float)
    left = np.ones(n, bool)
    out: list[int] = []
    while left.any() and len(out) < limit:
        best = int(np.argmax(np.where(left, value - (1 - lam) * near, -np.inf)))  # the first of equal ones
        left[best] = False
        out.append(best)
        if size[best]:
            like = np.round(np.clip((unit * unit[best]).sum(axis=1), 0.0, 1.0), 9)  # so that ranks don't hang on the order of addition
            near = np.where(size == size[best], np.maximum(near, like), near)
    return out


def select_mmr(fused: DataFrame, memories: DataFrame, limit: int, lam: float = 0.9) -> DataFrame:
    """(query_id, id, fused_score, rank): the order in which relevance less likeness picks from the 5*limit best.

    Queries with no more results than ``limit`` keep their order. Picking is sequential within a
    query, on a pool bounded by the limit; queries are spread over the tasks.
    """
    w = Window.partitionBy("query_id")
    pool = fused.select("query_id", "id", "fused_score").withColumn("r", F.row_number().over(w.orderBy(F.desc("fused_score"), "id"))).where(F.col("r") <= 5 * limit)
    x = pool.join(memories.select("id", "embedding"), "id", "left")

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("r").reset_index(drop=True)
        at = _greedy_mmr(df.fused_score.to_numpy(), list(df.embedding), limit, lam) if len(df) > limit else list(range(len(df)))
        out = df.iloc[at][["query_id", "id", "fused_score"]].copy()
        out["rank"] = range(1, len(out) + 1)
        return out

    return x.groupBy("query_id").applyInPandas(run, "query_id long, id long, fused_score double, rank int")


def select_coverage(fused: DataFrame, memories: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """(query_id, id, fused_score, rank): queries that collect take memories that add new words; others the best."""
    w = Window.partitionBy("query_id").orderBy(F.desc("fused_score"), "id")
    pool = fused.select("query_id", "id", "fused_score").withColumn("r", F.row_number().over(w)).where(F.col("r") <= max(20, 3 * limit))
    q = queries.select("query_id", tx.query_type(F.col("query_text")).alias("kind"), tx.terms(F.col("query_text")).alias("qt"))
    # Words are parted after the join, for the pool's memories alone.
    x = pool.join(memories.select("id", "content"), "id").join(q, "query_id").select("query_id", "id", "fused_score", "r", "kind", F.array_except(tx.terms(F.col("content")), "qt").alias("t"))

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("r").reset_index(drop=True)
        pick = list(range(len(df)))[:limit]
        if len(df) and df.kind[0] == "aggregation":
            left, pick, seen = list(range(len(df))), [], set()
            sets = [set(t) for t in df.t]
            while left and len(pick) < limit:
                best = max(left, key=lambda i: (0.3 * len(sets[i] - seen) + df.fused_score[i], -i))
                left.remove(best)
                pick.append(best)
                seen |= sets[best]
                if len(pick) > 1 and len(seen) < len(pick):
                    break
            pick.sort()
        out = df.iloc[pick][["query_id", "id", "fused_score"]].copy()
        out["rank"] = range(1, len(out) + 1)
        return out

    return x.groupBy("query_id").applyInPandas(run, "query_id long, id long, fused_score double, rank int")


def adaptive_k(fused: DataFrame, threshold: float, limit: int) -> DataFrame:
    """The smallest prefix that holds ``threshold`` of the softmax of scores, some rows at least."""
    w = Window.partitionBy("query_id")
    order = w.orderBy(F.desc("fused_score"), "id")
    x = fused.withColumn("e", F.exp(F.col("fused_score") - F.max("fused_score").over(w))).withColumn("rank", F.row_number().over(order)).withColumn("n", F.count("*").over(w))
    before = F.sum("e").over(order.rowsBetween(Window.unboundedPreceding, -1)) / F.sum("e").over(w)
    least = F.least(F.col("n"), F.lit(max(limit // 3, 5)))
    return x.withColumn("b", F.coalesce(before, F.lit(0.0))).where((F.col("b") < threshold) | (F.col("rank") <= least)).select("query_id", "id", "fused_score", "rank")


RERANK = {"temporal": (0.25, 0.20, 0.45, 0.10), "causal": (0.35, 0.30, 0.15, 0.20), "entity": (0.30, 0.25, 0.05, 0.40), "factual": (0.50, 0.35, 0.05, 0.10)}


def heuristic_rerank(fused: DataFrame, memories: DataFrame, queries: DataFrame, now_us: int, limit: int, depth: int = 20) -> DataFrame:
    """(query_id, id, score): the best by likeness, words in common, age and capitalised words, weighed by intent.

    ``queries`` has query_id, query_text, intent.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("fused_score"), "id")
    x = fused.withColumn("r", F.row_number().over(w)).where(F.col("r") <= depth).join(memories.select("id", "content", micros(memories, "created_at").alias("us")), "id").join(queries.select("query_id", tx.terms(F.col("query_text")).alias("qt"), "intent"), "query_id")
    caps = F.array_distinct(F.transform(F.filter(tx.words(F.col("content")), lambda s: (F.octet_length(s) > 2) & s.rlike("^\\p{Lu}")), F.lower))
    ent = F.when((F.size("qt") > 0) & (F.size(caps) > 0), F.least(F.size(F.array_intersect("qt", caps)) / F.size("qt"), F.lit(1.0))).otherwise(0.0)
    age = F.greatest((F.lit(now_us) - F.col("us")) / 86400e6, F.lit(0.0))
    tem = 0.05 + 0.95 * F.pow(F.lit(0.5), age / F.when(F.col("intent") == "temporal", 30.0).otherwise(365.0))
    parts = (F.col("semantic"), tx.jaccard(F.col("qt"), tx.terms(F.col("content"))), tem, ent)
    s = F.coalesce(*(F.when(F.col("intent") == k, sum((a * p for a, p in zip(v, parts)), F.lit(0.0))) for k, v in RERANK.items()))
    y = x.select("query_id", "id", s.alias("score"))
    return y.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= limit)
