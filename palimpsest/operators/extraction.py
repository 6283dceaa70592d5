"""What models extract, put in order: attribution to the speaker, facts by entity, profiles made anew, work put off."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .profile import add_facts, merged
from .search import resolve_aliases
from .store import settled

SPEAKER_WORDS = ("i", "me", "my", "myself", "the speaker")
BROADCAST_NAMES = 1 << 19  # most names, with the longer ones, that are sent to all tasks
NOT_NAMES = "anyone he her him his i it me my our she somebody someone that their them they this unknown unspecified we you your".split()
PROFILE_TYPES = ("location", "organization", "person")
EXTRACTED = "entities array<struct<name:string,type:string>>, entity_facts array<struct<entity:string,fact_type:string,value:string,confidence:double>>"


def attributed(extracted: Column, speaker: Column) -> Column:
    """``extracted`` (struct of EXTRACTED) with the speaker's name for first-person entities; a speaker with facts becomes an entity, a person."""
    own = lambda name: F.when(F.lower(name).isin(*SPEAKER_WORDS), speaker).otherwise(name)
    ents = F.transform(extracted["entities"], lambda e: F.struct(own(e["name"]).alias("name"), e["type"].alias("type")))
    facts = F.transform(extracted["entity_facts"], lambda f: F.struct(own(f["entity"]).alias("entity"), f["fact_type"].alias("fact_type"), f["value"].alias("value"), f["confidence"].alias("confidence")))
    said = F.exists(facts, lambda f: F.lower(f["entity"]) == F.lower(speaker)) & ~F.exists(ents, lambda e: F.lower(e["name"]) == F.lower(speaker))
    added = F.when(said, F.concat(ents, F.array(F.struct(speaker.alias("name"), F.lit("person").alias("type"))))).otherwise(ents)
    return F.when(speaker.isNull(), extracted).otherwise(F.struct(added.alias("entities"), facts.alias("entity_facts")))


def entity_names(extracted: Column) -> Column:
    """The distinct names of the entities, sorted."""
    return F.array_sort(F.array_distinct(F.transform(extracted["entities"], lambda e: e["name"])))


def facts_for(extracted: Column, name: Column) -> Column:
    """The facts about an entity, whatever its case."""
    return F.filter(extracted["entity_facts"], lambda f: F.lower(f["entity"]) == F.lower(name))


def truncated(text: Column, most: int) -> Column:
    """The longest head of at most ``most`` bytes that doesn't cut a character."""
    raw = text.cast("binary")

    def inside(at: int) -> Column:  # whether the byte at this place, from 1, goes on with a character
        return F.conv(F.hex(F.substring(raw, at, 1)), 16, 10).cast("int").between(128, 191)

    end = F.when(~inside(most + 1), most).when(~inside(most), most - 1).when(~inside(most - 1), most - 2).otherwise(most - 3)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.substr(raw, F.lit(1), F.greatest(end, F.lit(0))).cast("string"))


def repaired_profiles(memories: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts, and (entity, memory_id) links, of the extractions that memories carry, added to ``facts``.

    ``memories`` has id, extraction (JSON text or null), speaker. Names that are pronouns or one byte long don't
    count, nor entities of other types than PROFILE_TYPES (a person, if the type isn't given), nor values that are empty or over 100 bytes. Names
    go to the longer known name that they are short for. A speaker with a profile is linked with what it said.
    """
    x = memories.select("id", F.from_json("extraction", EXTRACTED).alias("x")).where("x is not null")
    f = x.select("id", F.explode("x.entity_facts").alias("f"), "x.entities").select("id", "f.*", "entities").withColumn("entity", F.lower("entity"))
    own = F.transform(F.filter("entities", lambda e: F.lower(e["name"]) == F.col("entity")), lambda e: F.lower(e["type"]))
    f = f.withColumn("entity_type", F.coalesce(F.try_element_at(own, F.lit(-1)), F.lit("person")))
    f = f.where((F.octet_length("entity") >= 2) & ~F.col("entity").isin(NOT_NAMES) & F.col("entity_type").isin(*PROFILE_TYPES) & F.octet_length("value").between(1, 100))
    new = f.select("entity", "entity_type", F.coalesce("fact_type", F.lit("unknown")).alias("fact_type"), "value", F.coalesce("confidence", F.lit(0.8)).alias("confidence"), F.col("id").alias("source_memory"))
    said = memories.select("id", F.lower(F.trim("speaker")).alias("entity")).where((F.octet_length("entity") >= 2) & ~F.col("entity").isin(NOT_NAMES))
    known = facts.select("entity").unionByName(new.select("entity")).distinct()
    full = settled(resolve_aliases(known.unionByName(said.select("entity")).distinct(), known).where("canonical is not null"))
    full = F.broadcast(full) if full.count() <= BROADCAST_NAMES else full
    whole = lambda df: df.join(full, "entity", "left").withColumn("entity", F.coalesce("canonical", "entity")).drop("canonical")
    # Facts are merged ahead of the join, so that an entity of many memories is no hot key.
    every = add_facts(facts.select(new.columns).unionByName(whole(merged(new)).select(new.columns)))
    links = whole(new).select("entity", F.col("source_memory").alias("memory_id")).unionByName(whole(said).join(every.select("entity").distinct(), "entity", "left_semi").select("entity", F.col("id").alias("memory_id")))
    # Links hardly repeat: they are spread before equal ones are dropped, not after a first pass over each task's input.
    return every, links.repartition("entity", "memory_id").distinct()


def speaker_texts(memories: DataFrame) -> DataFrame:
    """(id, text): memories whose text in the third person differs, with that text; of (id, content, speaker)."""
    t = tx.third_person(F.col("content"), F.col("speaker"))
    return memories.where("speaker is not null and speaker <> ''").select("id", "content", t.alias("text")).where("text <> content").select("id", "text")


def rebuilt_embeddings(memories: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """(id, embedding) of the memories that ``speaker_texts`` finds; ``embed`` maps a text column to a vector column."""
    return speaker_texts(memories).select("id", embed(F.col("text")).alias("embedding"))


def pending(memories: DataFrame, done: DataFrame, least: int = 0) -> DataFrame:
    """Memories of at least ``least`` bytes whose extraction was put off: those whose id isn't in ``done``."""
    return memories.where(F.octet_length("content") >= least).join(done.select("id"), "id", "left_anti")


def extracted(memories: DataFrame, extractor: Callable, kind: str = "id long, extraction string") -> DataFrame:
    """What a model makes of (id, content, speaker), given as a function for ``mapInPandas``."""
    return memories.select("id", "content", "speaker").mapInPandas(extractor, kind)


def triple_facts(triples: DataFrame) -> DataFrame:
    """(entity, entity_type, fact_type, value, confidence, source_memory) of (id, subject, predicate, object): what a triple says of its subject."""
    return triples.select(F.lower("subject").alias("entity"), F.lit("person").alias("entity_type"), F.replace("predicate", F.lit(" "), F.lit("_")).alias("fact_type"), F.col("object").alias("value"), F.lit(0.8).alias("confidence"), F.col("id").alias("source_memory")).where(~F.col("entity").isin(NOT_NAMES))
