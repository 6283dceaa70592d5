"""Parsing of what models extracted, and scores from it."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import FIRST_PERSON  # noqa: F401  (offered with the other query helpers)

SLM = """entities array<struct<name:string,role:string,mentions:array<string>,type:string>>,
temporal struct<markers:array<string>,sequence:string,relative_time:string,absolute_dates:array<string>>,
causal struct<relationships:array<struct<cause:string,effect:string,confidence:double>>,density:double,explicit_markers:array<string>,has_implicit_causation:boolean>,
topics array<string>, importance double,
entity_facts array<struct<entity:string,fact_type:string,value:string,confidence:double>>"""


def _text(c: Column) -> Column:
    return F.when(~F.lower(F.trim(c)).isin("", "null"), c)


def parsed_slm(raw: Column) -> Column:
    """The model's JSON with defaults filled in; null where it isn't JSON. Entries without what they need are dropped."""
    j = F.from_json(raw, SLM)
    ents = F.transform(F.filter(j["entities"], lambda e: _text(e["name"]).isNotNull()), lambda e: F.struct(e["name"].alias("name"), F.coalesce(_text(e["role"]), F.lit("subject")).alias("role"), F.coalesce(e["mentions"], F.array(e["name"])).alias("mentions"), F.coalesce(_text(e["type"]), F.lit("concept")).alias("type")))
    rels = F.transform(F.filter(j["causal"]["relationships"], lambda r: r["cause"].isNotNull() & r["effect"].isNotNull()), lambda r: F.struct(r["cause"].alias("cause"), r["effect"].alias("effect"), F.least(F.greatest(F.coalesce(r["confidence"], F.lit(0.5)), F.lit(0.0)), F.lit(1.0)).alias("confidence")))
    none = lambda kind: F.array().cast(kind)
    temporal = F.struct(*(F.coalesce(j["temporal"][k], none("array<string>")).alias(k) for k in ("markers", "absolute_dates")), *(_text(j["temporal"][k]).alias(k) for k in ("sequence", "relative_time")))
    causal = F.struct(F.coalesce(rels, none("array<struct<cause:string,effect:string,confidence:double>>")).alias("relationships"), F.coalesce(j["causal"]["density"], F.lit(0.0)).alias("density"), F.coalesce(j["causal"]["explicit_markers"], none("array<string>")).alias("explicit_markers"), F.coalesce(j["causal"]["has_implicit_causation"], F.lit(False)).alias("has_implicit_causation"))
    out = F.struct(F.coalesce(ents, none("array<struct<name:string,role:string,mentions:array<string>,type:string>>")).alias("entities"), temporal.alias("temporal"), causal.alias("causal"), F.coalesce(j["topics"], none("array<string>")).alias("topics"), F.least(F.greatest(F.coalesce(j["importance"], F.lit(0.5)), F.lit(0.0)), F.lit(1.0)).alias("importance"))
    return F.when(j["entities"].isNotNull() | j["topics"].isNotNull() | j["temporal"].isNotNull() | j["causal"].isNotNull(), out)


def slm_temporal_score(query: Column, t: Column) -> Column:
    """Markers .8, dates .9, early or late .7, before or after .6, recent .5; at most 1."""
    q = F.lower(query)
    has = lambda xs: F.exists(xs, lambda m: F.contains(q, F.lower(m)))
    seq, rel = F.lower(F.coalesce(t["sequence"], F.lit(""))), F.lower(F.coalesce(t["relative_time"], F.lit("")))
    parts = (
        (has(t["markers"]), 0.8), (has(t["absolute_dates"]), 0.9), (q.rlike("first|initial|begin") & (seq == "early"), 0.7), (q.rlike("last|final|end") & (seq == "late"), 0.7),
        (F.contains(q, F.lit("before")) & F.contains(rel, F.lit("before")), 0.6), (F.contains(q, F.lit("after")) & F.contains(rel, F.lit("after")), 0.6), (q.rlike("recent|latest") & F.contains(rel, F.lit("current")), 0.5),
    )
    return F.least(sum((F.when(c, v).otherwise(0.0) for c, v in parts), F.lit(0.0)), F.lit(1.0))


def slm_causal_score(query: Column, c: Column) -> Column:
    q = F.lower(query)
    touch = lambda x: F.contains(q, F.lower(x)) | F.contains(F.lower(x), q)
    rel = F.aggregate(F.transform(c["relationships"], lambda r: (F.when(touch(r["cause"]), 0.3).otherwise(0.0) + F.when(touch(r["effect"]), 0.3).otherwise(0.0)) * r["confidence"]), F.lit(0.0), lambda s, x: s + x)
    return F.least(0.5 * c["density"] + F.when(F.size(c["explicit_markers"]) > 0, 0.2).otherwise(0.0) + F.when(c["has_implicit_causation"], 0.3).otherwise(0.0) + rel, F.lit(1.0))


def slm_entity_score(names: Column, entities: Column) -> Column:
    """Mean over the query's (lower-case) names. A name goes through the entities until one is the same (1) or partly so (.5); mentions on the way add .9."""

    def one(n):
        def step(s, e):
            name = F.lower(e["name"])
            mention = F.when(F.exists(e["mentions"], lambda m: F.lower(m) == n), 0.9).otherwise(0.0)
            partly = F.contains(name, n) | F.contains(n, name)
            add = F.when(name == n, 1.0).otherwise(mention + F.when(partly, 0.5).otherwise(0.0))
            return F.when(s["done"], s).otherwise(F.struct((s["v"] + add).alias("v"), ((name == n) | partly).alias("done")))

        return F.aggregate(entities, F.struct(F.lit(0.0).alias("v"), F.lit(False).alias("done")), step, lambda s: s["v"])

    return F.when((F.size(names) > 0) & (F.size(entities) > 0), F.aggregate(F.transform(names, one), F.lit(0.0), lambda s, x: s + x) / F.size(names)).otherwise(0.0)


def slm_intent(raw: Column) -> Column:
    """struct(intent, confidence) of a classifier's JSON; unknown intents are factual."""
    j = F.from_json(raw, "intent string, confidence double")
    name = F.lower(j["intent"])
    return F.struct(F.when(name.isin("temporal", "causal", "entity"), name).otherwise("factual").alias("intent"), F.coalesce(j["confidence"], F.lit(0.5)).alias("confidence"))


def repair_json(text: str | None) -> str | None:
    """The first JSON object in a model's answer, mended: thoughts, doubled braces, stray 'd-' and last commas removed."""
    if text is None:
        return None
    text = re.sub(r"(?s)<think>.*?</think>", "", text)
    if "{{" in text and "}}" in text:
        text = text.replace("{{", "{").replace("}}", "}")
    text = re.sub(r"([:,]\s*)d-(?=\d)", r"\1", text)
    text = re.sub(r",(\s*[}\]])", r"\1", text)
    at = text.find("{")
    while at >= 0:
        depth, quoted, skip = 0, False, False
        for i in range(at, len(text)):
            ch = text[i]
            if skip:
                skip = False
            elif ch == "\\":
                skip = quoted
            elif ch == '"':
                quoted = not quoted
            elif not quoted and ch in "{}":
                depth += 1 if ch == "{" else -1
                if not depth:
                    part = text[at : i + 1]
                    try:
                        json.loads(part)
                        return part
                    except ValueError:
                        break
        at = text.find("{", at + 1)
    return None


@F.pandas_udf(T.StringType())
def repaired(s: pd.Series) -> pd.Series:
    return s.map(repair_json)


TRIPLE_TYPES = ("PERSON", "ORGANIZATION", "LOCATION", "EVENT", "CONCEPT", "OBJECT", "DATE", "TIME", "TOPIC")


def triples(text: Column) -> Column:
    """Array of struct(subject, predicate, object) of lines 'TYPE: a > predicate > TYPE: b'."""
    kinds = "|".join(TRIPLE_TYPES)
    line = f"^\\s*(?:{kinds}):\\s*(.+?)\\s*>\\s*(.+?)\\s*>\\s*(?:{kinds}):\\s*(.+?)\\s*$"
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(line))
    clean = lambda p: F.replace(F.regexp_replace(F.lower(p), "_of$", ""), F.lit("_"), F.lit(" "))
    return F.transform(lines, lambda x: F.struct(F.regexp_extract(x, line, 1).alias("subject"), clean(F.regexp_extract(x, line, 2)).alias("predicate"), F.regexp_extract(x, line, 3).alias("object")))


def referenced_triples(text: Column) -> Column:
    """Array of struct(subject, predicate, object) of lines '[n], TYPE: name' and '[n] predicate [m]'."""
    kinds = "|".join(TRIPLE_TYPES)
    name, edge = f"^\\s*\\[(\\d+)\\],?\\s*(?:{kinds}):\\s*(.+?)\\s*$", "^\\s*\\[(\\d+)\\]\\s*(.+?)\\s*\\[(\\d+)\\]\\s*$"
    lines = F.split(text, "\n")
    names = F.map_from_entries(F.transform(F.filter(lines, lambda x: x.rlike(name)), lambda x: F.struct(F.regexp_extract(x, name, 1), F.regexp_extract(x, name, 2))))
    clean = lambda p: F.replace(F.regexp_replace(F.lower(p), "_of$", ""), F.lit("_"), F.lit(" "))
    got = F.transform(F.filter(lines, lambda x: x.rlike(edge)), lambda x: F.struct(names[F.regexp_extract(x, edge, 1)].alias("subject"), clean(F.regexp_extract(x, edge, 2)).alias("predicate"), names[F.regexp_extract(x, edge, 3)].alias("object")))
    return F.filter(got, lambda t: t["subject"].isNotNull() & t["object"].isNotNull())
