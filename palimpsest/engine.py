"""A memory store over tables: the calls that a user of an embedded store makes, as DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import NotConfigured, need
from .functions import text as tx
from .functions.entities import entities
from .operators import extraction, graph, profile, search, store
from .plans import planner

COLUMNS = "id long, content string, embedding array<double>, created_at timestamp, namespace string, speaker string, metadata map<string,string>"
EDGES = "cause long, effect long, confidence double"
MENTIONS = "memory_id long, entity string"
RELATIONS = "from_entity string, to_entity string, relation string"
FACTS = "entity string, entity_type string, fact_type string, value string, confidence double, source_memory long"


class Memory:
    """Lazily changed tables. Calls that change return the store; calls that read return DataFrames."""

    def __init__(self, spark: SparkSession, dim: int = 384, namespace: str = ""):
        self.spark, self.dim, self.namespace = spark, dim, namespace
        self.memories = spark.createDataFrame([], COLUMNS)
        self.edges = spark.createDataFrame([], EDGES)
        self.mentions = spark.createDataFrame([], MENTIONS)
        self.relations = spark.createDataFrame([], RELATIONS)
        self.facts = spark.createDataFrame([], FACTS)
        self.errors: DataFrame | None = None
        self.embed = None
        self.user: str | None = None
        self._trace: planner.Trace | None = None
        self._hooks: dict[str, Callable] = {}

    # Functions that models stand behind; each maps batches of (id, content, speaker), as for mapInPandas

    def set_entity_extractor(self, extractor: Callable) -> Memory:
        """Gives (memory_id, entity) rows; without one, capitalised phrases are taken."""
        self._hooks["entities"] = extractor
        return self

    def set_llm_extractor(self, extractor: Callable) -> Memory:
        """Gives (id, extraction), JSON of entities and facts."""
        self._hooks["extraction"] = extractor
        return self

    def set_slm_classifier(self, classifier: Callable) -> Memory:
        """Gives (id, raw), JSON of what a memory is about; ``query(described=store.described())`` scores by it."""
        self._hooks["described"] = classifier
        return self

    def set_triple_extractor(self, extractor: Callable) -> Memory:
        """Gives (id, subject, predicate, object)."""
        self._hooks["triples"] = extractor
        return self

    def _hook(self, name: str, memories: DataFrame, kind: str) -> DataFrame:
        if name not in self._hooks:
            raise NotConfigured(f"the store was given no function for {name}")
        return extraction.extracted(memories, self._hooks[name], kind)

    def described(self) -> DataFrame:
        return self._hook("described", self.memories, "id long, raw string")

    def extract_mentions(self, ids: DataFrame | None = None) -> Memory:
        """Mentions of the memories' entities, of those in ``ids`` or of all."""
        m = self.memories if ids is None else self.get(ids)
        if "entities" in self._hooks:
            return self.add_mentions(self._hook("entities", m, "memory_id long, entity string"))
        return self.add_mentions(m.select(F.col("id").alias("memory_id"), F.explode(entities(F.col("content"))).alias("entity")))

    def with_signs(self) -> DataFrame:
        """The memories with time expressions and causal markers as JSON in their metadata, as ingest notes them."""
        c = F.col("content")
        own = F.create_map(F.lit("temporal_expressions"), F.to_json(tx.temporal_expressions(c)), F.lit("causal_markers"), F.to_json(tx.causal_markers(c)), F.lit("causal_density"), tx.causal_density(c).cast("string"))
        return self.memories.withColumn("metadata", F.map_concat(F.coalesce("metadata", F.create_map().cast("map<string,string>")), own))

    def pending_extraction(self, done: DataFrame, least: int = 0) -> DataFrame:
        return extraction.pending(self.memories, done, least)

    def flush_extraction(self, done: DataFrame, least: int = 0) -> Memory:
        """Runs the extractor over what is pending; profiles get its facts and the speakers' links."""
        wait = self.pending_extraction(done, least)
        found = self._hook("extraction", wait, "id long, extraction string")
        return self._with_profiles(wait.select("id", "speaker").join(found, "id"))

    def repair_profiles(self) -> Memory:
        """Profiles from the extractions that memories carry in their metadata."""
        return self._with_profiles(self.memories.select("id", F.col("metadata")["llm_extraction"].alias("extraction"), "speaker"))

    def _with_profiles(self, memories: DataFrame) -> Memory:
        facts, links = extraction.repaired_profiles(memories, self.facts)
        self.facts = facts.select(self.facts.columns)
        return self.add_mentions(links)

    def backfill_triples(self) -> Memory:
        """Facts and relations from the triples of all memories."""
        t = self._hook("triples", self.memories, "id long, subject string, predicate string, object string")
        self.relations = graph.link_entities(self.relations, t.select(F.lower("subject").alias("from_entity"), F.lower("object").alias("to_entity"), F.col("predicate").alias("relation")))
        self.facts = profile.add_facts(self.facts.unionByName(extraction.triple_facts(t))).select(self.facts.columns)
        return self

    def rebuild_speaker_embeddings(self) -> Memory:
        """New embeddings for what speakers say of themselves, from the text in the third person."""
        if self.embed is None:
            raise NotConfigured("the store was given no embedding function")
        return self.update_embedding(extraction.rebuilt_embeddings(self.memories, lambda c: self.embed(c).cast("array<double>")))

    def scope(self, namespace: str) -> Scope:
        return Scope(self, namespace)

    # Tables

    @classmethod
    def open(cls, spark: SparkSession, path: str, dim: int = 384, namespace: str = "") -> Memory:
        m = cls(spark, dim, namespace)
        for name in ("memories", "edges", "mentions", "relations", "facts"):
            setattr(m, name, spark.read.schema(getattr(m, name).schema).parquet(f"{path}/{name}"))
        return m

    def save(self, path: str) -> None:
        for name in ("memories", "edges", "mentions", "relations", "facts"):
            getattr(self, name).write.mode("errorifexists").parquet(f"{path}/{name}")

    def set_embedding_fn(self, embed) -> Memory:
        """``embed`` maps a text column to a vector column; rows without an embedding get theirs from it."""
        self.embed = embed
        return self

    def set_user_entity(self, name: str) -> Memory:
        self.user = name.lower()
        return self

    def add_batch(self, rows: DataFrame) -> Memory:
        """Rows with missing columns filled in; those of a wrong dimension go to ``errors``."""
        need(rows, "id", "content")
        have = {c: F.col(c) for c in rows.columns}
        kinds = {f.name: f.dataType for f in self.memories.schema}
        x = rows.select(*(have.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items())).withColumn("namespace", F.coalesce("namespace", F.lit(self.namespace)))
        if self.embed is not None:
            x = x.withColumn("embedding", F.coalesce("embedding", self.embed(tx.contextualised(F.col("content"), F.col("speaker"))).cast("array<double>")))
        good, self.errors = store.checked(x, self.dim)
        self.memories = self.memories.unionByName(good)
        return self

    add = add_batch

    def add_with_dedup(self, rows: DataFrame) -> Memory:
        return self.add_batch(store.deduplicated(rows, self.memories))

    def upsert(self, rows: DataFrame, key: str) -> Memory:
        old = self.memories
        self.memories = self.spark.createDataFrame([], COLUMNS)
        new = self.add_batch(rows).memories
        self.memories = store.upserted(old, new, key)
        return self

    def delete(self, ids: DataFrame) -> Memory:
        """Without the rows of ``ids``, their edges, mentions and facts."""
        self.memories = store.without(self.memories, ids)
        self.edges = graph.without_memories(self.edges, ids, "cause", "effect")
        self.mentions = graph.without_memories(self.mentions, ids, "memory_id")
        self.facts = profile.remove_sources(self.facts, ids)
        return self

    delete_batch = delete

    def delete_namespace(self, namespace: str) -> Memory:
        return self.delete(self.memories.where(F.col("namespace") == namespace).select("id"))

    def update_embedding(self, new: DataFrame) -> Memory:
        self.memories = store.with_embeddings(self.memories, new)
        return self

    # Reads

    def get(self, ids: DataFrame) -> DataFrame:
        return self.memories.join(ids.select("id"), "id", "left_semi")

    def count(self, namespace: str | None = None) -> int:
        return store.filtered(self.memories, None, namespace).count()

    def list_ids(self) -> DataFrame:
        return self.memories.select("id")

    def list_namespaces(self) -> DataFrame:
        return self.memories.where("namespace <> ''").select("namespace").distinct()

    def get_range(self, start, end, limit: int, namespace: str | None = None) -> DataFrame:
        return store.in_range(store.filtered(self.memories, None, namespace), start, end, limit)

    def get_recent(self, n: int, namespace: str | None = None) -> DataFrame:
        return store.recent(store.filtered(self.memories, None, namespace), n)

    def search(self, queries: DataFrame, k: int, namespace: str | None = None, filters: list[dict] | None = None) -> DataFrame:
        return search.vector_search(store.filtered(self.memories, filters, namespace), queries, k)

    def query(self, queries: DataFrame, limit: int = 10, **options) -> DataFrame:
        """Results of ``planner.run``; last_query_trace() tells of them once they were computed."""
        need(queries, "query_id", "query_text", "query_embedding")
        self._trace = options.pop("trace", None) or planner.Trace()
        options.setdefault("user", self.user)
        return planner.run(self.memories, queries, facts=self.facts, mentions=self.mentions, relations=self.relations, edges=self.edges, limit=limit, trace=self._trace, **options)

    def last_query_trace(self) -> list[dict]:
        if self._trace is None:
            raise NotConfigured("there was no query yet")
        return self._trace.steps()

    def classify(self, queries: DataFrame) -> DataFrame:
        return queries.select("query_id", tx.intent(F.col("query_text")).alias("i")).select("query_id", "i.*")

    def profile_context(self, queries: DataFrame, limit: int = 10) -> DataFrame:
        asked = search.detect_entities(queries, self.facts.select("entity").distinct())
        return profile.context(search.fact_search(self.facts, asked, queries, limit)[1], profile.summaries(self.facts))

    # Graphs and profiles

    def add_causal_links(self, links: DataFrame) -> Memory:
        self.edges, bad = graph.add_causal_links(self.edges, links)
        self.errors = bad
        return self

    def get_causes(self, ids: DataFrame, hops: int = 3) -> DataFrame:
        return graph.paths(self.edges, ids, hops, False)

    def get_effects(self, ids: DataFrame, hops: int = 3) -> DataFrame:
        return graph.paths(self.edges, ids, hops, True)

    def add_mentions(self, mentions: DataFrame) -> Memory:
        self.mentions = self.mentions.unionByName(mentions.select("memory_id", F.lower("entity").alias("entity"))).distinct()
        return self

    def apply_extraction(self, extracted: DataFrame) -> Memory:
        """Facts that a model found, as rows of FACTS."""
        self.facts = profile.add_facts(self.facts.unionByName(extracted.select(self.facts.columns).withColumn("entity", F.lower("entity")))).select(self.facts.columns)
        return self

    def list_entities(self) -> DataFrame:
        return profile.mention_counts(self.mentions)

    def get_entity_memories(self, entities: DataFrame) -> DataFrame:
        return graph.entity_memories(self.mentions, entities)

    def get_memory_entities(self, ids: DataFrame) -> DataFrame:
        return self.mentions.join(ids.select(F.col("id").alias("memory_id")), "memory_id", "left_semi")

    def list_entity_profiles(self) -> DataFrame:
        return self.facts.groupBy("entity").agg(F.min("entity_type").alias("entity_type"), F.count("*").alias("facts"))

    def summarize_profiles(self) -> DataFrame:
        return profile.summaries(self.facts)

    def consolidate_profiles(self, embeddings: DataFrame | None = None) -> Memory:
        self.facts = profile.consolidate(self.facts, embeddings).select(self.facts.columns)
        return self

    def repair_relations(self) -> Memory:
        self.relations = graph.link_entities(self.relations, graph.repaired_relations(self.facts))
        return self


class Scope:
    """A store's calls bound to a namespace; changes go to the store."""

    def __init__(self, memory: Memory, namespace: str):
        self.memory, self.namespace = memory, namespace

    def _named(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("namespace", F.lit(self.namespace))

    def _own(self, ids: DataFrame) -> DataFrame:
        return self.view().join(ids.select("id"), "id", "left_semi").select("id")

    def view(self) -> DataFrame:
        return store.filtered(self.memory.memories, None, self.namespace)

    def add_batch(self, rows: DataFrame) -> Scope:
        self.memory.add_batch(self._named(rows))
        return self

    add = add_batch

    def add_with_dedup(self, rows: DataFrame) -> Scope:
        """Contents that the namespace has are left out; other namespaces may have them."""
        self.memory.add_batch(self._named(store.deduplicated(rows, self.view())))
        return self

    def upsert(self, rows: DataFrame, key: str) -> Scope:
        rest = self.memory.memories.where(~F.col("namespace").eqNullSafe(self.namespace))
        old = self.view()
        self.memory.memories = self.memory.spark.createDataFrame([], COLUMNS)
        new = self.memory.add_batch(self._named(rows)).memories
        self.memory.memories = rest.unionByName(store.upserted(old, new, key))
        return self

    def delete(self, ids: DataFrame) -> Scope:
        self.memory.delete(self._own(ids))
        return self

    delete_batch = delete

    def delete_all(self) -> Scope:
        self.memory.delete_namespace(self.namespace)
        return self

    def get(self, ids: DataFrame) -> DataFrame:
        return self.view().join(ids.select("id"), "id", "left_semi")

    def count(self) -> int:
        return self.memory.count(self.namespace)

    def list_ids(self) -> DataFrame:
        return self.view().select("id")

    def get_range(self, start, end, limit: int | None = None) -> DataFrame:
        return self.memory.get_range(start, end, limit, self.namespace)

    def get_recent(self, n: int) -> DataFrame:
        return self.memory.get_recent(n, self.namespace)

    def search(self, queries: DataFrame, k: int, filters: list[dict] | None = None) -> DataFrame:
        return self.memory.search(queries, k, self.namespace, filters)

    def query(self, queries: DataFrame, limit: int = 10, **options) -> DataFrame:
        return self.memory.query(queries, limit, namespace=self.namespace, **options)
