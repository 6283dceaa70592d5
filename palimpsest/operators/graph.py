"""Cause and effect, mentions and relations as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .search import DIGITS, related


def add_causal_links(edges: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges with valid new ones appended, and the new ones whose confidence isn't in [0, 1]."""
    ok = F.coalesce(F.col("confidence").between(0, 1), F.lit(False))
    return edges.unionByName(new.where(ok).select(edges.columns)), new.where(~ok)


def paths(edges: DataFrame, starts: DataFrame, most_hops: int, forward: bool = True) -> DataFrame:
    """(start, id, hops, confidence, path): one simple path to each memory reached: the shortest, then the most confident, then the least.

    One join a hop, as many as ``most_hops``; a path's confidence is the product of its edges'. Of
    several paths to a place with as many hops one goes on, so rows don't multiply.
    """
    a, b = ("cause", "effect") if forward else ("effect", "cause")
    e = edges.groupBy(F.col(a).alias("at"), F.col(b).alias("to")).agg(F.max("confidence").alias("c"))
    now = starts.select(F.col("id").alias("start"), F.col("id").alias("at"), F.lit(1.0).alias("confidence"), F.array("id").alias("path"))
    found = None
    for hop in range(1, most_hops + 1):
        step = now.join(e, "at").where(~F.array_contains("path", F.col("to")))
        step = step.select("start", F.col("to").alias("at"), (F.col("confidence") * F.col("c")).alias("confidence"), F.concat("path", F.array("to")).alias("path"))
        best = Window.partitionBy("start", "at").orderBy(F.desc("confidence"), "path")
        now = step.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")
        row = now.select("start", F.col("at").alias("id"), F.lit(hop).alias("hops"), "confidence", "path")
        found = row if found is None else found.unionByName(row)
    best = Window.partitionBy("start", "id").orderBy("hops", F.desc("confidence"), "path")
    return found.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")


def entity_memories(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    return mentions.join(entities.select("entity"), "entity").select("entity", "memory_id").distinct()


def link_entities(relations: DataFrame, new: DataFrame) -> DataFrame:
    """Each (from, to, relation) once."""
    return relations.unionByName(new.select(relations.columns)).dropDuplicates(["from_entity", "to_entity", "relation"])


def without_memories(edges: DataFrame, gone: DataFrame, *columns: str) -> DataFrame:
    """Edges of which no end was removed."""
    for c in columns:
        edges = edges.join(gone.select(F.col("id").alias(c)), c, "left_anti")
    return edges


def _cap(x: DataFrame, per: tuple[str, ...], most: int) -> DataFrame:
    w = Window.partitionBy(*per).orderBy(F.desc("score"), "id")
    return x.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")


def expand_causal(seeds: DataFrame, edges: DataFrame, limit: int, hops: int = 2, least: float = 0.3, most: int = 5) -> DataFrame:
    """(query_id, id, score): causes and effects of each query's seeds, weaker by 0.7 a hop and the path's confidence.

    ``seeds`` has query_id, id, score. Five for each seed and direction; seeds themselves don't count.
    Scores are rounded before they are ranked, as equal products of other factors differ in their last bits.
    """
    start = seeds.select("id").distinct()
    both = None
    for forward in (True, False):
        p = paths(edges, start, hops, forward).where(F.col("confidence") >= least)
        x = seeds.select("query_id", F.col("id").alias("start"), F.col("score").alias("s")).join(p, "start")
        x = _cap(x.select("query_id", "start", "id", F.round(F.col("s") * F.col("confidence") * F.pow(F.lit(0.7), F.col("hops")), DIGITS).alias("score")), ("query_id", "start"), most)
        both = x if both is None else both.unionByName(x)
    x = both.groupBy("query_id", "id").agg(F.max("score").alias("score")).join(seeds.select("query_id", "id"), ["query_id", "id"], "left_anti")
    return _cap(x, ("query_id",), limit)


def expand_entity(seeds: DataFrame, mentions: DataFrame, relations: DataFrame, limit: int, most: int = 5) -> DataFrame:
    """(query_id, id, score): memories of the seeds' entities at 0.7, of related entities at 0.49.

    Only an entity's memories nearest in id to none in particular matter: the least ``most`` ids that
    aren't the seed go on for each entity, so a hot entity doesn't multiply with its seeds.
    """
    few = mentions.withColumn("n", F.row_number().over(Window.partitionBy("entity").orderBy("memory_id"))).where(F.col("n") <= most + 1).select("entity", F.col("memory_id").alias("id"))
    own = seeds.select("query_id", F.col("id").alias("start"), "score").join(mentions, F.col("start") == F.col("memory_id")).select("query_id", "start", "score", "entity")
    direct = own.join(few, "entity").where("id <> start").select("query_id", "start", "id", (F.col("score") * 0.7).alias("score"))
    via = own.join(related(relations), "entity").select("query_id", "start", "score", F.col("other").alias("entity")).join(few, "entity").where("id <> start").select("query_id", "start", "id", (F.col("score") * 0.49).alias("score"))
    x = direct.unionByName(via).groupBy("query_id", "start", "id").agg(F.max("score").alias("score"))
    x = _cap(x, ("query_id", "start"), most).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return _cap(x.join(seeds.select("query_id", "id"), ["query_id", "id"], "left_anti"), ("query_id",), limit)


def expand_hybrid(seeds: DataFrame, edges: DataFrame, mentions: DataFrame, relations: DataFrame, limit: int) -> DataFrame:
    """Entity expansion, then causal expansion for the room that is left."""
    a = expand_entity(seeds, mentions, relations, limit).withColumn("turn", F.lit(0))
    b = expand_causal(seeds, edges, limit).withColumn("turn", F.lit(1))
    x = a.unionByName(b).withColumn("k", F.row_number().over(Window.partitionBy("query_id", "id").orderBy("turn"))).where("k = 1")
    return x.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("turn", F.desc("score"), "id"))).where(F.col("n") <= limit).select("query_id", "id", "score")


def repaired_relations(facts: DataFrame) -> DataFrame:
    """(from_entity, to_entity, relation) read from facts such as 'friend of x', 'works with x', 'x (sister)'."""
    v = F.lower(F.trim("value"))
    of, paren = "^(.+?) (?:of|with) (.+)$", "^(.+?) \\((.+)\\)$"
    to = F.when(v.rlike(of), F.regexp_extract(v, of, 2)).when(v.rlike(paren), F.regexp_extract(v, paren, 1))
    kind = F.when(v.rlike(of), F.regexp_extract(v, of, 1)).when(v.rlike(paren), F.regexp_extract(v, paren, 2))
    x = facts.where("fact_type = 'relationship'").select(F.lower("entity").alias("from_entity"), to.alias("to_entity"), kind.alias("relation"))
    names = facts.select(F.lower("entity").alias("to_entity")).distinct()
    return x.where("to_entity is not null").join(names, "to_entity").select("from_entity", "to_entity", "relation").distinct()


def expansion_policy(seeds: DataFrame, intents: DataFrame, edges: DataFrame, mentions: DataFrame, relations: DataFrame, limit: int, least: float = 0.6) -> DataFrame:
    """(query_id, id, dim, score): what graphs add to the dimensions, for queries whose seeds score ``least`` on average.

    Causal queries get causes and effects, entity and factual ones memories of the seeds' entities; temporal ones both, for time at 0.7 and
    entities at 0.5.
    """
    good = seeds.groupBy("query_id").agg(F.round(F.avg("score"), 9).alias("mean")).where(F.col("mean") >= least).join(intents.select("query_id", "intent"), "query_id").select("query_id", "intent")
    x = seeds.join(good, "query_id").select("query_id", "id", "score", "intent")
    of = lambda *kinds: x.where(F.col("intent").isin(*kinds)).select("query_id", "id", "score")
    causal = expand_causal(of("causal"), edges, limit).select("query_id", "id", F.lit("causal").alias("dim"), "score")
    entity = expand_entity(of("entity", "factual"), mentions, relations, limit).select("query_id", "id", F.lit("entity").alias("dim"), "score")
    both = expand_hybrid(of("temporal"), edges, mentions, relations, limit)
    part = F.explode(F.array(F.struct(F.lit("temporal").alias("dim"), (F.col("score") * 0.7).alias("score")), F.struct(F.lit("entity").alias("dim"), (F.col("score") * 0.5).alias("score")))).alias("p")
    return causal.unionByName(entity).unionByName(both.select("query_id", "id", part).select("query_id", "id", "p.dim", "p.score"))
