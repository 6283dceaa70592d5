"""License scans: exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import written

LEAST = 0.8
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
}


def _tokens(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall("[a-z0-9]+", text.lower())))


def blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, block, tokens): the lines of each text with their distinct tokens."""
    line = F.posexplode(F.split("text", "\n", -1)).alias("block", "line")
    return docs.select("doc_id", line).select("doc_id", "block", F.array_distinct(F.filter(F.split(F.lower("line"), "[^a-z0-9]+"), lambda t: t != "")).alias("tokens"))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """(doc_id, block, license, overlap, containment): every line that holds at least ``least`` of a template's tokens.

    Tokens are runs of a-z and 0-9 in lower case, each counted once. Those of the templates are
    ordered by the number of blocks that hold them in the whole corpus, rare ones first. A block
    that holds o of a template's t tokens holds one of the first t-o+1 (prefix filter), has o of the templates' tokens itself
    (length filter), and after its first common token both have enough left (positional filter); what
    remains is counted. The templates are part of the plan, so no text is shuffled. All
    templates that a block meets are reported.

    Null and empty texts have no matching blocks; rows with a null doc_id are scanned; repeated
    rows give repeated rows; templates without tokens match nothing. Other columns are ignored. No rows in: no rows out.
    """
    templates = TEMPLATES if templates is None else templates
    sets = {k: s for k, t in templates.items() if (s := _tokens(t))}
    own = sorted({t for s in sets.values() for t in s})
    if not own:
        return docs.select("doc_id", F.lit(0).alias("block"), F.lit("").alias("license"), F.lit(0).alias("overlap"), F.lit(0.0).alias("containment")).limit(0)
    vocabulary = F.array(*(F.lit(t) for t in own))
    has = blocks(docs).select(F.explode(F.array_intersect("tokens", vocabulary)).alias("token")).groupBy("token").count()
    seen = {r.token: r["count"] for r in written(has).collect()}  # as many as the templates have
    order = {t: i for i, t in enumerate(sorted(own, key=lambda t: (seen.get(t, 0), t)), 1)}
    table = []
    for name, s in sorted(sets.items()):
        ranks = sorted(order[t] for t in s)
        o = math.ceil(least * len(ranks) - 1e-9)
        table.append(F.struct(F.lit(name).alias("license"), F.array(*map(F.lit, ranks)).alias("t"), F.array(*map(F.lit, ranks[: len(ranks) - o + 1])).alias("prefix"), F.lit(len(ranks)).alias("n"), F.lit(o).alias("o")))
    rank = F.create_map(*(x for t in own for x in (F.lit(t), F.lit(order[t]))))
    firsts = sorted({order[t] for s in sets.values() for t in sorted(s, key=order.__getitem__)[: len(s) - math.ceil(least * len(s) - 1e-9) + 1]})
    ordered = F.array_sort(F.transform(F.array_intersect("tokens", vocabulary), lambda t: F.element_at(rank, t)))
    x = blocks(docs).select("doc_id", "block", ordered.alias("b")).where(F.arrays_overlap("b", F.array(*map(F.lit, firsts))))

    def possible(t):
        common = F.element_at(F.array_intersect(t["prefix"], F.col("b")), 1)
        i, j = F.array_position(t["t"], common), F.array_position("b", common)
        return (F.size("b") >= t["o"]) & F.arrays_overlap(t["prefix"], "b") & (F.least(t["n"] - i, F.size("b") - j) + 1 >= t["o"])

    x = x.select("doc_id", "block", "b", F.explode(F.filter(F.array(*table), possible)).alias("m"))
    x = x.select("doc_id", "block", F.col("m.license").alias("license"), F.size(F.array_intersect("m.t", "b")).alias("overlap"), "m.n", "m.o")
    return x.where("overlap >= o").select("doc_id", "block", "license", "overlap", (F.col("overlap").cast("double") / F.col("n")).alias("containment"))


def wrapped(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """The columns of scan: runs of two lines or more of which none alone holds ``least`` of a template's tokens, but all together do.

    A run is of neighbouring lines that each hold a token of the template; lines without any token
    (blank ones, rules, comment signs) don't count, all others end it, and so do lines that scan
    reports for the template. From each first line it goes on to the first line with which it holds
    enough; it is reported, as the block of its first line, if it no longer does without that line.
    So each place of a wrapped license is reported once, by its shortest run.
    """
    templates = TEMPLATES if templates is None else templates
    sets = {k: s for k, t in templates.items() if (s := _tokens(t))}
    kind = "array<struct<block int, license string, overlap int, n int>>"

    @F.udf(kind)
    def runs(text):
        lines = [frozenset(re.findall("[a-z0-9]+", line)) for line in text.lower().split("\n")]
        words = frozenset().union(*lines)
        out = []
        for name, s in own.items():
            need = math.ceil(least * len(s) - 1e-9)
            if len(s & words) < need:
                continue
            near = [(i, s & t) for i, t in enumerate(lines) if t]
            for a, (block, _) in enumerate(near):
                held: set[str] = set()
                for b in range(a, len(near)):
                    if not near[b][1] or len(near[b][1]) >= need:
                        break
                    held |= near[b][1]
                    if len(held) >= need:
                        if len(frozenset().union(*(t for _, t in near[a + 1 : b + 1]))) < need:
                            out.append((block, name, len(held), len(s)))
                        break
        return out

    own = {k: frozenset(s) for k, s in sorted(sets.items())}
    if not own:
        return scan(docs, templates, least)
    return docs.where("text is not null").select("doc_id", F.explode(runs("text")).alias("m")).select("doc_id", "m.block", "m.license", "m.overlap", (F.col("m.overlap").cast("double") / F.col("m.n")).alias("containment"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_license_scan_wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9_license_scan, whose SQL goes by single lines, and the wrapped licenses."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs).unionByName(wrapped(docs))


_VALUES = ", ".join(f"""('{k}', '{v.replace("'", "''")}')""" for k, v in TEMPLATES.items())
ORACLE = f"""
with t as (
  select license, list_distinct(regexp_extract_all(lower(body), '[a-z0-9]+')) as t from (values {_VALUES}) as v(license, body)),
l as (
  select doc_id, unnest(range(len(lines))) as block, unnest(lines) as line
  from (select doc_id, string_split(text, chr(10)) as lines from documents)),
b as (select doc_id, block, list_distinct(regexp_extract_all(lower(line), '[a-z0-9]+')) as b from l)
select doc_id, block::integer as block, license, len(list_intersect(t, b))::integer as overlap, len(list_intersect(t, b)) / len(t)::double as containment
from b cross join t where len(list_intersect(t, b)) >= ceil({LEAST} * len(t) - 1e-9)"""
