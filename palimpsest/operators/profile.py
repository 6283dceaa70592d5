"""Entity profiles: facts(entity, entity_type, fact_type, value, confidence, source_memory)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .search import resolve_aliases

PRONOUNS = "us it we i they them your you she her his him he myself my me".split()
NOTHING = ["no information", "not provided", "not mentioned", "not specified", "unspecified", "unknown", "na", "n/a", "none"]
SPECIFIC = "relationship_status event family career_goal research_topic affiliation occupation travel hobby food sport book pet instrument".split()
GENERIC = "characteristic action preference interest".split()


def acceptable(kind: Column, value: Column) -> Column:
    """Whether a fact says something: no pronoun, no word for nothing, neither too short nor a story, no speech act."""
    v = F.lower(F.trim(value))
    speech = (kind == "action") & v.rlike("^(?:sa(?:ys|id)|tells|asks|asked)")
    return F.octet_length(v).between(3, 100) & ~v.isin(PRONOUNS + NOTHING) & ~speech


def merged(facts: DataFrame) -> DataFrame:
    """Facts that are equal but for confidence and source as one, with the greatest and the first: by hash within each task, so that a hot entity sends few rows."""
    by = [c for c in ("entity", "entity_type", "fact_type", "value", "v") if c in facts.columns]
    return facts.groupBy(*by).agg(F.max("confidence").alias("confidence"), F.min("source_memory").alias("source_memory"))


def add_facts(facts: DataFrame) -> DataFrame:
    """One row for each entity, type and value: the greatest confidence, cut to 1, the first source.

    A value known under a specific type doesn't count under a generic one, whichever came first.
    """
    v = F.lower(F.trim("value"))
    x = merged(facts.where(acceptable(F.col("fact_type"), F.col("value"))).withColumn("v", v).withColumn("confidence", F.least("confidence", F.lit(1.0))))
    sure = x.where(F.col("fact_type").isin(SPECIFIC)).select("entity", "v").distinct()
    generic = x.where(F.col("fact_type").isin(GENERIC)).join(sure, ["entity", "v"], "left_anti")
    kept = x.where(~F.col("fact_type").isin(GENERIC)).unionByName(generic.select(x.columns))
    first = lambda c: F.min_by(c, F.struct("source_memory", "value"))
    return kept.groupBy("entity", "fact_type", "v").agg(first("entity_type").alias("entity_type"), first("value").alias("value"), F.max("confidence").alias("confidence"), F.min("source_memory").alias("source_memory")).drop("v")


def summaries(facts: DataFrame) -> DataFrame:
    """(entity, summary): facts by falling confidence until one would exceed 500 bytes."""
    head = F.concat(F.lit("Profile of "), "entity", F.lit(" ("), F.min("entity_type").over(Window.partitionBy("entity")), F.lit("): "))
    order = Window.partitionBy("entity").orderBy(F.desc("confidence"), "fact_type", "value")
    x = facts.withColumn("seg", F.concat(F.replace("fact_type", F.lit("_"), F.lit(" ")), F.lit(": "), "value")).withColumn("head", head)
    x = x.withColumn("n", F.row_number().over(order)).withColumn("len", F.octet_length("head") + F.sum(F.octet_length("seg") + F.when(F.col("n") > 1, 2).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # lengths only grow, so what fits is a prefix
    fit = x.groupBy("entity", "head").agg(F.sort_array(F.collect_list(F.when(F.col("len") <= 500, F.struct("n", "seg")))).alias("s"))
    return fit.select("entity", F.concat("head", F.array_join(F.transform("s", lambda s: s["seg"]), "; ")).alias("summary"))


def best_facts(facts: DataFrame) -> DataFrame:
    """(entity, fact_type, value, confidence): the most confident fact of each type."""
    w = Window.partitionBy("entity", "fact_type").orderBy(F.desc("confidence"), "value")
    return facts.withColumn("n", F.row_number().over(w)).where("n = 1").select("entity", "fact_type", "value", "confidence")


def context(matched: DataFrame, summary: DataFrame) -> DataFrame:
    """(query_id, line): an entity's summary where there is one, else its matching facts."""
    x = matched.join(summary, "entity", "left")
    line = F.coalesce("summary", F.concat("entity", F.lit("'s "), F.replace("fact_type", F.lit("_"), F.lit(" ")), F.lit(": "), "value"))
    return x.select("query_id", line.alias("line")).distinct()


def merge_aliases(facts: DataFrame) -> DataFrame:
    """Facts under the longer name where a name is short for another."""
    names = facts.select("entity").distinct()
    short = resolve_aliases(names, names).where("canonical is not null")
    chain = short.join(short.select(F.col("entity").alias("canonical"), F.col("canonical").alias("next")), "canonical", "left").select("entity", F.coalesce("next", "canonical").alias("canonical"))
    return facts.join(chain, "entity", "left").withColumn("entity", F.coalesce("canonical", "entity")).drop("canonical")


def _unlike(most: float):
    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["confidence", "value"], ascending=[False, True])
        kept: list[np.ndarray] = []
        keep = []
        for v in df.embedding:
            x = np.asarray(v, float) if v is not None else np.zeros(0)
            x = x / max(np.linalg.norm(x), 1e-300) if len(x) else x
            near = any(len(y) == len(x) and len(x) and float(x @ y) > most for y in kept)
            keep.append(not near)
            if not near:
                kept.append(x)
        return df[keep].drop(columns="embedding")

    return run


def consolidate(facts: DataFrame, embeddings: DataFrame | None = None, most: float = 0.85) -> DataFrame:
    """Profiles with aliases merged, empty and near-equal facts dropped, and poor profiles of non-persons dropped.

    ``embeddings`` has fact_type, value, embedding. Near-equal facts are dropped greedily within an entity and type.
    """
    x = add_facts(merge_aliases(facts))
    x = x.where(~F.lower(F.trim("value")).isin(NOTHING) & (F.octet_length(F.trim("value")) <= 100))
    if embeddings is not None:
        cols = x.columns
        y = x.join(embeddings, ["fact_type", "value"], "left")
        x = y.groupBy("entity", "fact_type").applyInPandas(_unlike(most), x.select(*[c for c in y.columns if c != "embedding"]).schema).select(cols)
    n = F.count("*").over(Window.partitionBy("entity"))
    return x.withColumn("n", n).where("entity_type = 'person' or n > 2").drop("n")


def store_relationships(extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts for both sides and edges, of (from_entity, to_entity, relation, confidence, source_memory) at 0.5 or more."""
    x = extracted.where("confidence >= 0.5").select(F.lower("from_entity").alias("a"), F.lower("to_entity").alias("b"), "relation", "confidence", "source_memory")
    fact = lambda own, other: x.select(F.col(own).alias("entity"), F.lit("person").alias("entity_type"), F.lit("relationship").alias("fact_type"), F.concat("relation", F.lit(" of "), F.col(other)).alias("value"), "confidence", "source_memory")
    return fact("a", "b").unionByName(fact("b", "a")), x.select(F.col("a").alias("from_entity"), F.col("b").alias("to_entity"), "relation").distinct()


def annotate(records: DataFrame) -> DataFrame:
    """(id, record_type, event_date, typed_summaries) of (id, records array<struct<record_type, event_date, summary>>)."""
    t = F.transform("records", lambda r: r["record_type"])
    kind = F.when(F.array_contains(t, "episodic"), "episodic").when(F.array_contains(t, "procedural"), "procedural").when(F.array_contains(t, "semantic"), "semantic")
    return records.select("id", kind.alias("record_type"), F.array_min(F.transform("records", lambda r: r["event_date"])).alias("event_date"), F.to_json(F.transform("records", lambda r: F.struct(r["record_type"].alias("type"), r["summary"].alias("summary")))).alias("typed_summaries"))


def remove_sources(facts: DataFrame, gone: DataFrame) -> DataFrame:
    """Facts whose source memory wasn't deleted; profiles without facts vanish with them."""
    return facts.join(gone.select(F.col("id").alias("source_memory")), "source_memory", "left_anti").select(facts.columns)


def mention_counts(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("entity").agg(F.count_distinct("memory_id").alias("mention_count"))


def missing_embeddings(facts: DataFrame, known: DataFrame, embed) -> DataFrame:
    """(fact_key, embedding) of facts that have none; ``embed`` maps a text column to a vector column."""
    x = facts.select(tx.fact_key(F.col("entity"), F.col("fact_type"), F.col("value")).alias("fact_key"), F.concat_ws(" ", F.replace("fact_type", F.lit("_"), F.lit(" ")), "value").alias("t")).dropDuplicates(["fact_key"])
    return x.join(known.select("fact_key"), "fact_key", "left_anti").select("fact_key", embed(F.col("t")).alias("embedding"))
