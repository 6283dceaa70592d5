"""The engine's tables, derived from the driver's: memories, edges, mentions, profiles, queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, those that have an embedding with it: id, content, embedding, created_at, namespace, metadata."""
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    at = F.timestamp_micros(F.lit(1704067200000000) + F.col("doc_id") * 60000000)
    return d.join(e, d.doc_id == e.vec_id, "left").select(
        F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("embedding").cast("array<double>").alias("embedding"), at.alias("created_at"),
        F.col("source").alias("namespace"), F.create_map(F.lit("lang"), "lang", F.lit("n_chars"), F.col("n_chars").cast("string")).alias("metadata"),
    )


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as memories of their users, in sentences with names, dates and causes."""
    e = table(spark, sf_dir, "events")
    who = F.concat(F.lit("User"), F.col("user_id").cast("string"))
    why = F.when(F.col("event_type") == "error", " because value was ").otherwise(" with value ")
    content = F.concat(who, F.lit(" had "), F.col("event_type"), F.lit(" on "), F.date_format("ts", "yyyy-MM-dd"), why, F.floor("value").cast("string"))
    return e.select(F.col("event_id").alias("id"), content.alias("content"), F.col("ts").alias("created_at"), who.alias("speaker"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").alias("k"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as memories; dialog_id is conversation:turn, turns from 1."""
    c = table(spark, sf_dir, "conversations")
    conv, turn = F.col("conv_id").cast("string"), (F.col("turn") + 1).cast("string")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("content"), F.concat_ws(":", conv, turn).alias("dialog_id"), F.col("role").alias("speaker"), "conv_id", (F.col("turn") + 1).alias("turn"))


def causal_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cause, effect, confidence): consecutive events of a user."""
    return table(spark, sf_dir, "events").selectExpr("event_id as cause", "lead(event_id) over (partition by user_id order by ts, event_id) as effect", "cast(0.5 as double) + (event_id % 50) / 100.0D as confidence").where("effect is not null")


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(memory_id, entity): events mention their user."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("memory_id"), F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("entity"))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(from_entity, to_entity, relation): users follow the next one."""
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    name = lambda c: F.concat(F.lit("user"), c.cast("string"))
    return u.select(name(F.col("user_id")).alias("from_entity"), name(F.col("user_id") + 1).alias("to_entity"), F.lit("follows").alias("relation"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, entity_type, fact_type, value, confidence, source_memory): from each user's events."""
    e = table(spark, sf_dir, "events")
    per = e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("source_memory"), F.max("event_id").alias("last"))
    kind = F.when(F.col("event_type") == "purchase", "hobby").when(F.col("event_type") == "error", "action").otherwise("interest")
    who = F.concat(F.lit("user"), F.col("user_id").cast("string"))
    return per.select(
        who.alias("entity"), F.when(F.col("user_id") % 3 == 0, "organization").otherwise("person").alias("entity_type"), kind.alias("fact_type"),
        F.concat("event_type", F.lit(" "), (F.col("n") % 7).cast("string")).alias("value"), (0.5 + (F.col("n") % 10) / 20.0).cast("double").alias("confidence"), "source_memory",
    )


TEMPLATES = (
    "What does {} like?",
    "Why did {} see an error?",
    "Show recent purchase of {} from yesterday",
    "List all purchase events of {}",
    "How many click events did {} have last week?",
    "Would {} likely return before Monday?",
    "When was I with {}?",
    "Tell me about {}",
    "what led to the error of {} on 2024-01-03",
)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, user_id, query_text): every template for every user."""
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    t = F.posexplode(F.array(*map(F.lit, TEMPLATES))).alias("k", "t")
    return u.select("user_id", t).select((F.col("user_id") * len(TEMPLATES) + F.col("k")).alias("query_id"), "user_id", F.replace("t", F.lit("{}"), F.concat(F.lit("User"), F.col("user_id").cast("string"))).alias("query_text"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query_text, query_embedding): each benchmark text with the embedding of its number."""
    b, e = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "embeddings")
    return b.join(e, b.item_id == e.vec_id).select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"), F.col("embedding").cast("array<double>").alias("query_embedding"))


# The same tables for DuckDB.
SQL = {
    "memories": "memories as (select doc_id as id, text as content, embedding::double[] as embedding, epoch_us(timestamp '2024-01-01') + doc_id * 60000000 as us, source as namespace, lang, n_chars::varchar as n_chars from documents left join embeddings on doc_id = vec_id)",
    "notes": "notes as (select event_id as id, 'User' || user_id || ' had ' || event_type || ' on ' || strftime(ts, '%Y-%m-%d') || case when event_type = 'error' then ' because value was ' else ' with value ' end || floor(value)::bigint as content, ts as created_at, epoch_us(ts) as us, 'User' || user_id as speaker, user_id, event_type, value, json_extract_string(props, '$.k') as k from events)",
    "turns": "turns as (select conv_id * 1000 + turn as id, text as content, conv_id || ':' || (turn + 1) as dialog_id, role as speaker, conv_id, turn + 1 as turn from conversations)",
    "edges": "edges as (select * from (select event_id as cause, lead(event_id) over (partition by user_id order by ts, event_id) as effect, 0.5::double + (event_id % 50) / 100.0::double as confidence from events) where effect is not null)",
    "mentions": "mentions as (select event_id as memory_id, 'user' || user_id as entity from events)",
    "relations": "relations as (select distinct 'user' || user_id as from_entity, 'user' || (user_id + 1) as to_entity, 'follows' as relation from events)",
    "facts": "facts as (select 'user' || user_id as entity, case when user_id % 3 = 0 then 'organization' else 'person' end as entity_type, case event_type when 'purchase' then 'hobby' when 'error' then 'action' else 'interest' end as fact_type, event_type || ' ' || (count(*) % 7) as value, 0.5::double + (count(*) % 10) / 20.0::double as confidence, min(event_id) as source_memory from events group by user_id, event_type)",
    "questions": "questions as (select user_id * {n} + k as query_id, user_id, replace(t, '{{}}', 'User' || user_id) as query_text from (select distinct user_id from events) cross join (values {v}) as t(k, t))".format(n=len(TEMPLATES), v=", ".join(f"({i}, '{t}')" for i, t in enumerate(TEMPLATES))),
    "queries": "queries as (select item_id as query_id, text as query_text, embedding::double[] as query_embedding from benchmark join embeddings on item_id = vec_id)",
}


def sql(*names: str) -> str:
    """The head of a DuckDB query over these tables."""
    return "with " + ", ".join(SQL[n] for n in names)
