"""Evaluation of answers and of retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", " "), " +"), lambda w: w != "")


def set_f1(answer: Column, truth: Column) -> Column:
    a, b = F.array_distinct(_tokens(answer)), F.array_distinct(_tokens(truth))
    both = F.size(F.array_intersect(a, b))
    return F.when(both > 0, 2.0 * both / (F.size(a) + F.size(b))).otherwise(0.0)


def bleu1(answer: Column, truth: Column) -> Column:
    """Words of the answer found in the truth, each as often as there, with a penalty for brevity."""
    a, b = _tokens(answer), _tokens(truth)

    def times(xs, w):
        return F.size(F.filter(xs, lambda x: x == w))

    hit = F.aggregate(F.transform(F.array_distinct(a), lambda w: F.least(times(a, w), times(b, w))), F.lit(0), lambda s, x: s + x)
    short = F.when(F.size(a) >= F.size(b), 1.0).otherwise(F.exp(1 - F.size(b) / F.size(a)))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), short * hit / F.size(a)).otherwise(0.0)


def recall_at(results: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, reciprocal_rank) of results (query_id, id, rank) against gold (query_id, id)."""
    g = gold.select("query_id", "id").distinct()
    hit = g.join(results.where(F.col("rank") <= k).select("query_id", "id", "rank"), ["query_id", "id"], "left")
    return hit.groupBy("query_id").agg((F.count("rank") / F.count("*")).alias("recall"), F.coalesce(1.0 / F.min("rank"), F.lit(0.0)).alias("reciprocal_rank"))


def failure_kinds(recall: DataFrame, correct: DataFrame) -> DataFrame:
    """(query_id, kind): why an answer is wrong: no evidence, some of it, or all of it and still wrong."""
    x = recall.join(correct, "query_id")
    kind = F.when(F.col("correct"), "correct").when(F.col("recall") == 0, "no evidence").when(F.col("recall") < 1, "partial evidence").otherwise("reasoning")
    return x.select("query_id", kind.alias("kind"))
