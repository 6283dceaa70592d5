"""Registered queries over the driver's tables, each with SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import entities as en
from ..functions import text as tx
from ..operators import fusion, graph, metrics, profile, search, store
from ..sources import tables as T
from . import planner
from .oracle import BM25, FUSED, RANKED, SCORES, causal_density, causal_markers, collects, intent_of, temporal, terms, tok, VECTOR

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
K = 10
NOW_US = 1735689600000000  # the start of 2025, against which ages are counted


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def joined(c: Column | str) -> Column:
    return F.array_join(c, "|")


def scored(df: DataFrame, *more: str) -> DataFrame:
    return df.select("query_id", "id", r6("score").alias("score"), *more)


def documents(s: SparkSession, d: str) -> DataFrame:
    """All documents as memories without embeddings."""
    return T.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("source").alias("namespace"), "lang")


# Keys, filters, ranges, changes


@query(T.sql("memories") + " select id, content, namespace, us from memories where id in (select item_id from benchmark)")
def get_by_id(s, d):
    ids = T.table(s, d, "benchmark").select(F.col("item_id").alias("id"))
    return T.memories(s, d).join(ids, "id", "left_semi").select("id", "content", "namespace", F.unix_micros("created_at").alias("us"))


@query(T.sql("memories") + " select id from memories")
def list_ids(s, d):
    return T.memories(s, d).select("id")


@query(T.sql("memories") + " select count(*) as n from memories")
def count_memories(s, d):
    return T.memories(s, d).agg(F.count("*").alias("n"))


@query("select distinct source as namespace from documents where source <> ''")
def list_namespaces(s, d):
    return documents(s, d).where("namespace <> ''").select("namespace").distinct()


@query("select source as namespace, count(*) as n from documents where source is not null group by 1")
def count_namespace(s, d):
    return documents(s, d).where("namespace is not null").groupBy("namespace").agg(F.count("*").alias("n"))


@query("select doc_id as id from documents where source = (select min(source) from documents)")
def list_namespace_ids(s, d):
    x = documents(s, d)
    first = x.agg(F.min("namespace").alias("namespace"))
    return x.join(F.broadcast(first), "namespace").select("id")


@query("select doc_id as id from documents where source <> (select min(source) from documents)")
def delete_namespace(s, d):
    x = documents(s, d)
    return store.without(x, x.agg(F.min("namespace").alias("namespace")), "namespace").where("namespace is not null").select("id")


@query(T.sql("turns") + " select t.dialog_id, t.id, content from turns t join (select max(turn) as turn from turns) m using (turn)")
def find_by_dialog_id(s, d):
    t = T.turns(s, d)
    return t.join(F.broadcast(t.agg(F.max("turn").alias("turn"))), "turn").select("dialog_id", "id", "content")


@query("select case when embedding is null or len(embedding) <> 64 then 'embedding has ' || coalesce(len(embedding), -1) || ' numbers, not 64' end as error, count(*) as n from documents left join embeddings on doc_id = vec_id group by 1")
def add_batch(s, d):
    """Documents without an embedding go to the errors."""
    x = documents(s, d).join(T.table(s, d, "embeddings").withColumnRenamed("vec_id", "id"), "id", "left")
    good, bad = store.checked(x, 64)
    return good.select("id", F.lit(None).cast("string").alias("error")).unionByName(bad.select("id", "error")).groupBy("error").agg(F.count("*").alias("n"))


@query("select min(doc_id) as id, sha256(text) as hash from documents where text is not null group by text")
def dedup_exact(s, d):
    x = documents(s, d).where("content is not null")
    return store.deduplicated(x).select("id", tx.content_hash(F.col("content")).alias("hash"))


@query("select doc_id as id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as hash from documents")
def hash_normalized(s, d):
    return documents(s, d).select("id", tx.normalised_hash(F.col("content")).alias("hash"))


@query(T.sql("notes") + ", last as (select *, row_number() over (partition by user_id order by created_at desc, id desc) as n from notes where event_type = 'error') select id, user_id from notes where event_type <> 'error' and user_id not in (select user_id from last) union all select id, user_id from last where n = 1")
def upsert_latest(s, d):
    x = T.notes(s, d)
    return store.upserted(x.where("event_type <> 'error'"), x.where("event_type = 'error'"), "user_id").select("id", "user_id")


@query(T.sql("notes") + " select id, content from notes where event_type <> 'error'")
def delete_anti(s, d):
    x = T.notes(s, d)
    return store.without(x, x.where("event_type = 'error'")).select("id", "content")


@query(T.sql("memories") + " select m.id, round(coalesce(e.embedding[1]::double, m.embedding[1]), 6) as first from memories m left join embeddings e on e.vec_id = m.id + 1")
def update_embedding(s, d):
    e = T.table(s, d, "embeddings").select((F.col("vec_id") - 1).alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return store.with_embeddings(T.memories(s, d), e).select("id", r6(F.col("embedding")[0]).alias("first"))


def _filter(name: str, f: dict, where: str) -> None:
    def run(s, d):
        return store.filtered(T.memories(s, d), [f]).select("id")

    QUERIES[name] = run
    ORACLES[name] = T.sql("memories") + f" select id from memories where {where}"


for _op, _sign in (("eq", "="), ("ne", "<>"), ("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<=")):
    _filter(f"filter_{_op}", {"field": "n_chars" if _op[0] in "gl" else "lang", "op": _op, "value": "5" if _op[0] in "gl" else "en"}, f"n_chars {_sign} '5'" if _op[0] in "gl" else f"lang {_sign} 'en'")
_filter("filter_in", {"field": "lang", "op": "in", "values": ["fr", "de"]}, "lang in ('fr', 'de')")
_filter("filter_missing_field", {"field": "nothing", "op": "ne", "value": "x"}, "false")


@query(T.sql("memories") + " select id from memories where lang <> 'en' and n_chars >= '3' and namespace = (select max(source) from documents)")
def filter_and(s, d):
    top = T.memories(s, d).join(F.broadcast(documents(s, d).agg(F.max("namespace").alias("namespace"))), "namespace")
    return store.filtered(top, [{"field": "lang", "op": "ne", "value": "en"}, {"field": "n_chars", "op": "gte", "value": "3"}]).select("id")


_RANGE = ("2024-01-05 00:00:00", "2024-01-20 12:00:00")
_IN_RANGE = f"created_at between timestamp '{_RANGE[0]}' and timestamp '{_RANGE[1]}'"


def _bounds() -> tuple[Column, Column]:
    return tuple(F.lit(x).cast("timestamp_ntz") for x in _RANGE)  # type: ignore[return-value]


@query(T.sql("notes") + f", o as (select id, created_at from notes where {_IN_RANGE} order by created_at, id limit 1000) select id, row_number() over (order by created_at desc, id desc)::integer as rank from o")
def time_range(s, d):
    return store.in_range(T.notes(s, d), *_bounds(), 1000).select("id", "rank")


@query(T.sql("notes") + ", o as (select id, created_at from notes order by created_at desc, id desc limit 100) select id, row_number() over (order by created_at desc, id desc)::integer as rank from o")
def get_recent(s, d):
    return store.recent(T.notes(s, d), 100).select("id", "rank")


@query(T.sql("notes") + f" select count(*) as n from notes where {_IN_RANGE}")
def count_range(s, d):
    return T.notes(s, d).where(F.col("created_at").between(*_bounds())).agg(F.count("*").alias("n"))


@query(T.sql("notes") + f", o as (select id, created_at from notes where {_IN_RANGE} order by created_at, id limit 500), r as (select id, row_number() over (order by created_at desc, id desc) as rank from o) select id, rank::integer as rank, round(1 - (rank - 1) / 499.0::double, 6) as score from r")
def temporal_range_query(s, d):
    return store.range_scores(T.notes(s, d), *_bounds(), 500).select("id", "rank", r6("score").alias("score"))


@query("select event_id as id, event_type, date_trunc('day', ts)::date as day, greatest(epoch_us(ts) - epoch_us(timestamp '2024-01-10'), 0)::bigint as since from events")
def day_arithmetic(s, d):
    e = T.table(s, d, "events")
    return e.select(F.col("event_id").alias("id"), "event_type", F.to_date("ts").alias("day"), F.greatest(F.timestamp_diff("MICROSECOND", F.lit("2024-01-10").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")), F.lit(0)).alias("since"))


# Text functions

_ME = "'I''m sure that I have seen my ' || event_type || ' and told myself; it was for me, says ' || user_id"
_STEPS = (("(?i)\\bI''m\\b", " is"), ("(?i)\\bI''ve\\b", " has"), ("(?i)\\bI''ll\\b", " will"), ("(?i)\\bI''d\\b", " would"), ("\\bI am\\b", " is"), ("\\bI have\\b", " has"), ("\\bI will\\b", " will"), ("\\bI would\\b", " would"), ("\\bI\\b", ""), ("(?i)\\bmyself\\b", ""), ("(?i)\\bmy\\b", "''s"), ("(?i)\\bmine\\b", "''s"), ("(?i)\\bme\\b", ""))


def _third() -> str:
    x = "t"
    for pattern, after in _STEPS:
        x = f"regexp_replace({x}, '{pattern}', speaker || '{after}', 'g')"
    return x


@query(T.sql("notes") + f", m as (select id, speaker, {_ME} as t from notes) select id, {_third()} as text from m")
def first_person_to_third(s, d):
    me = F.concat(F.lit("I'm sure that I have seen my "), "event_type", F.lit(" and told myself; it was for me, says "), F.col("user_id").cast("string"))
    return T.notes(s, d).select("id", tx.third_person(me, F.col("speaker")).alias("text"))


@query(T.sql("turns") + " select id, case when coalesce(speaker, '') <> '' then speaker || ': ' || content else content end as text from turns")
def contextualize(s, d):
    return T.turns(s, d).select("id", tx.contextualised(F.col("content"), F.col("speaker")).alias("text"))


@query(f"select doc_id as id, array_to_string({tok('text')}, '|') as tokens from documents")
def bm25_tokenize(s, d):
    return documents(s, d).select("id", joined(tx.bm25_tokens(F.col("content"), False)).alias("tokens"))


@query(f"select doc_id as id, array_to_string(list_sort({terms('text')}), '|') as terms from documents")
def extract_terms(s, d):
    return documents(s, d).select("id", joined(F.array_sort(tx.terms(F.col("content")))).alias("terms"))


@query(f"with t as (select {tok('text')} as t from documents), p as (select unnest(t) as term from t) select (select count(*) from t) as n, round((select avg(len(t)) from t), 6) as avgdl, count(distinct term) as terms from p")
def bm25_stats(s, d):
    m = documents(s, d)
    post = search.postings(m, False)
    return search.corpus_stats(post).crossJoin(post.agg(F.count_distinct("term").alias("terms"))).select("n", r6("avgdl").alias("avgdl"), "terms")


@query(T.sql("notes", "questions") + f" select 'n' as kind, id, array_to_string({temporal('content')}, '|') as found from notes union all select 'q', query_id, array_to_string({temporal('query_text')}, '|') from questions")
def temporal_extract(s, d):
    x = T.notes(s, d).select(F.lit("n").alias("kind"), "id", "content").unionByName(T.questions(s, d).select(F.lit("q").alias("kind"), F.col("query_id").alias("id"), F.col("query_text").alias("content")))
    return x.select("kind", "id", joined(tx.temporal_expressions(F.col("content"))).alias("found"))


@query(T.sql("notes", "questions") + f", x as (select 'n' as kind, id, content from notes union all select 'q', query_id, query_text from questions) select kind, id, array_to_string(list_sort({causal_markers('content')}), '|') as markers, round({causal_density('content')}, 6) as density from x")
def causal_extract(s, d):
    x = T.notes(s, d).select(F.lit("n").alias("kind"), "id", "content").unionByName(T.questions(s, d).select(F.lit("q").alias("kind"), F.col("query_id").alias("id"), F.col("query_text").alias("content")))
    return x.select("kind", "id", joined(F.array_sort(tx.causal_markers(F.col("content")))).alias("markers"), r6(tx.causal_density(F.col("content"))).alias("density"))


@query(T.sql("questions") + f" select query_id, regexp_matches(lower(query_text), '^why |^how |what (?:caused|led to)|reason for|because of|due to|resulted in') or len({causal_markers('query_text')}) > 0 as causal from questions")
def causal_intent(s, d):
    return T.questions(s, d).select("query_id", tx.has_causal_intent(F.col("query_text")).alias("causal"))


@query(T.sql("questions") + ", " + intent_of("questions") + " select query_id, intent, round(confidence, 6) as confidence, entity_focus from intents")
def intent_classify(s, d):
    i = T.questions(s, d).select("query_id", tx.intent(F.col("query_text")).alias("i"))
    return i.select("query_id", "i.intent", r6("i.confidence").alias("confidence"), "i.entity_focus")


@query(T.sql("questions") + f" select query_id, {collects('query_text')} as kind from questions")
def query_type(s, d):
    return T.questions(s, d).select("query_id", tx.query_type(F.col("query_text")).alias("kind"))


@query(T.sql("turns") + " select id, regexp_extract(dialog_id, '^(.+):(-?\\d+)$', 1) as conv, regexp_extract(dialog_id, '^(.+):(-?\\d+)$', 2)::integer as turn from turns")
def parse_dialog_id(s, d):
    return T.turns(s, d).select("id", tx.dialog_parts(F.col("dialog_id")).alias("p")).select("id", "p.conv", "p.turn")


@query("select event_id as id, case when event_type = 'error' then null else ts::date end as day from events")
def iso_date(s, d):
    raw = F.concat(F.date_format("ts", "yyyy-M-d"), F.when(F.col("event_type") == "error", "x").otherwise(""))
    return T.table(s, d, "events").select(F.col("event_id").alias("id"), tx.iso_date(raw).alias("day"))


@query(T.sql("notes") + " select id, regexp_matches(lower(content), '(^|[^a-z0-9])error($|[^a-z0-9])') as found, regexp_matches(lower(content), '(^|[^a-z0-9])user($|[^a-z0-9])') as part from notes")
def whole_word_match(s, d):
    c = F.col("content")
    return T.notes(s, d).select("id", tx.whole_word(c, F.lit("error")).alias("found"), tx.whole_word(c, F.lit("user")).alias("part"))


@query("select doc_id as id, left(sha256(lower(lang) || chr(0) || source || chr(0) || lower(doc_id::varchar)), 32) as key from documents where lang is not null and source is not null")
def fact_keys(s, d):
    x = documents(s, d).where("lang is not null and namespace is not null")
    return x.select("id", tx.fact_key(F.col("lang"), F.col("namespace"), F.col("id").cast("string")).alias("key"))


@query()
def entity_extract(s, d):
    return T.notes(s, d).select("id", joined(en.entities(F.col("content"))).alias("found"))


# The five dimensions

_TOP = f"where rank <= {K}"


@query(T.sql("memories", "queries") + ", " + VECTOR + f" select query_id, id, round(score, 6) as score from sem {_TOP}")
def vector_search(s, d):
    return scored(search.vector_search(T.memories(s, d), T.queries(s, d), K))


@query(T.sql("memories", "queries") + ", " + VECTOR.replace("where embedding is not null", "where embedding is not null and lang = 'en'") + f" select query_id, id, round(score, 6) as score from sem {_TOP}")
def search_filtered(s, d):
    m = store.filtered(T.memories(s, d), [{"field": "lang", "op": "eq", "value": "en"}])
    return scored(search.vector_search(m, T.queries(s, d), K))


@query(T.sql("memories", "queries") + ", " + BM25 + f" select query_id, id, round(score, 6) as score from bm {_TOP}")
def bm25_search(s, d):
    return scored(search.bm25_search(T.memories(s, d), T.queries(s, d), K, stem=False))


@query(T.sql("memories", "queries") + ", " + BM25 + f" select query_id, id, round(score / max(score) over (partition by query_id), 6) as score from bm {_TOP}")
def bm25_normalized(s, d):
    return scored(search.max_norm(search.bm25_search(T.memories(s, d), T.queries(s, d), K, stem=False)))


@query()
def bm25_search_stemmed(s, d):
    return scored(search.bm25_search(T.memories(s, d), T.queries(s, d), K))


_KEYS = "[" + ", ".join(f"'{w}'" for w in search.KEYWORDS) + "]"
_CONTENT = f"list_sum(list_transform(e, lambda x: case when contains(lower(query_text), lower(x)) then 1.0::double when len(list_filter({_KEYS}, lambda w: contains(lower(query_text), w) and contains(lower(x), w))) > 0 then 0.7::double else 0.0::double end))"


@query(T.sql("notes", "questions") + f", m as (select id, {temporal('content')} as e from notes), k as (select query_id, e, {_CONTENT} as s from (select distinct e from m where len(e) > 0) cross join questions), x as (select query_id, id, least(s / len(e), 1.0) as score from m join k using (e) where s > 0), r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from x) select query_id, id, round(score / max(score) over (partition by query_id), 6) as score from r {_TOP}")
def temporal_score(s, d):
    return scored(search.temporal_search(T.notes(s, d), T.questions(s, d), K))


@query(T.sql("notes", "edges", "questions") + f""", asked as (select query_id from questions where regexp_matches(lower(query_text), '^why |^how |what (?:caused|led to)|reason for|because of|due to|resulted in') or len({causal_markers('query_text')}) > 0),
x as (select id, {causal_density('content')} as d from notes), t as (select cause as id from edges union select effect from edges),
s as (select id, least(least(5 * d, 1.0) * case when id in (select id from t) then 1.2 else 1.0 end, 1.0) as score from x where d > 0.1),
r as (select id, score / max(score) over () as score from s order by score desc, id limit {K}) select query_id, id, round(score, 6) as score from asked cross join r""")
def causal_score(s, d):
    return scored(search.causal_search(T.notes(s, d), T.questions(s, d), T.causal_edges(s, d), K))


_DETECTED = "names as (select distinct entity from facts), detected as (select distinct query_id, entity from (select query_id, unnest(regexp_extract_all(lower(query_text), '[a-z0-9]+')) as entity from questions) semi join names using (entity))"


def detected(s, d) -> DataFrame:
    return search.detect_entities(T.questions(s, d), T.facts(s, d).select("entity").distinct())


@query(T.sql("facts", "questions") + f", {_DETECTED} select * from detected")
def entity_detect(s, d):
    return detected(s, d)


_RELATED = "related as (select from_entity as entity, to_entity as other from relations union select to_entity, from_entity from relations)"


@query(T.sql("facts", "questions", "mentions", "relations") + f""", {_DETECTED}, {_RELATED},
f as (select query_id, memory_id as id, 0.5 as s from detected join mentions using (entity) union all select query_id, memory_id, 0.4 from detected d join related r on d.entity = r.entity join mentions m on m.entity = r.other),
g as (select query_id, id, min(s) as floor from f group by all),
names2 as (select query_id, list(entity) as names from detected group by 1), own as (select memory_id as id, list(distinct entity) as own from mentions group by 1),
h as (select query_id, id, floor, list_sum(list_transform(names, lambda n: case when list_contains(own, n) then 1.0::double when len(list_filter(own, lambda m: contains(m, n) or contains(n, m))) > 0 then 0.5::double else 0.0::double end)) / len(names) as s from g join names2 using (query_id) join own using (id)),
r as (select query_id, id, case when s > 0 then s else floor end::double as score from h), k as (select *, row_number() over (partition by query_id order by score desc, id) as rank from r)
select query_id, id, round(score / max(score) over (partition by query_id), 6) as score from k {_TOP}""")
def entity_search(s, d):
    return scored(search.entity_search(detected(s, d), T.mentions(s, d), T.relations(s, d), K))


@query(T.sql("facts") + """, n as (select distinct entity from facts),
x as (select a.entity, min(case when length(a.entity) >= 3 and length(b.entity) > length(a.entity) and starts_with(b.entity, a.entity) and regexp_matches(substr(b.entity, length(a.entity) + 1, 1), '[A-Za-z0-9]') then b.entity end) as s,
  min(case when length(a.entity) between 4 and 5 and length(b.entity) > length(a.entity) and starts_with(b.entity, left(a.entity, length(a.entity) - 1)) and regexp_matches(substr(b.entity, length(a.entity), 1), '[A-Za-z0-9]') then b.entity end) as f
  from n a cross join n b group by 1) select entity, coalesce(s, f) as canonical from x""")
def alias_resolve(s, d):
    n = T.facts(s, d).select("entity").distinct()
    return search.resolve_aliases(n, n)


_FACT_STOPS = "[" + ", ".join(f"'{w}'" for w in tx.FACT_STOPS) + "]"


def _fw(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: strlen(w) > 1 and not list_contains({_FACT_STOPS}, w)))"


_FACT_SEARCH = T.sql("facts", "questions") + f""", {_DETECTED}, q as (select query_id, {_fw('query_text')} as qw from questions), f as (select *, {_fw("replace(fact_type, '_', ' ') || ' ' || value")} as fw from facts),
x as (select query_id, entity, fact_type, value, source_memory, case when len(qw) > 0 and len(fw) > 0 then len(list_intersect(qw, fw)) / least(len(qw), len(fw))::double else 0.0 end * confidence as s from detected join q using (query_id) join f using (entity)),
y as (select *, max(s) over (partition by query_id, entity) > 0 as hit from x)"""


@query(_FACT_SEARCH + f""", z as (select query_id, source_memory as id, s from y where hit and s > 0 union all select distinct query_id, source_memory, 0.3 from y where not hit),
r as (select query_id, id, least(sum(s), 1.0) as score from z group by all), k as (select *, row_number() over (partition by query_id order by score desc, id) as rank from r) select query_id, id, round(score, 6) as score from k {_TOP}""")
def profile_fact_search(s, d):
    return scored(search.fact_search(T.facts(s, d), detected(s, d), T.questions(s, d), K, stem=False)[0])


@query(_FACT_SEARCH + ", z as (select query_id, entity, fact_type, value, max(s) as s from y where s > 0 group by all), r as (select *, row_number() over (partition by query_id order by s desc, entity, fact_type, value) as rank from z) select query_id, rank::integer as rank, entity, fact_type, value, round(s, 6) as score from r where rank <= 5")
def profile_best_facts(s, d):
    return search.fact_search(T.facts(s, d), detected(s, d), T.questions(s, d), K, stem=False)[1].withColumn("score", r6("score"))


@query(T.sql("facts", "questions", "relations") + f""", {_DETECTED}, {_RELATED}, src as (select entity, id, row_number() over (partition by entity order by id) as n from (select distinct entity, source_memory as id from facts)),
x as (select query_id, id, 2.0 as score from detected join src using (entity) where n <= 30 union all select query_id, id, 1.0 from detected d join related r on d.entity = r.entity join src on src.entity = r.other where n <= 10)
select query_id, id, max(score)::double as score from x group by all""")
def profile_injection(s, d):
    ask = detected(s, d)
    none = ask.select("query_id", F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("score")).where("false")
    return search.inject_profiles(none, ask, T.facts(s, d), T.relations(s, d), none, K)


@query(T.sql("notes") + f", x as (select id, (({NOW_US} - us) / 86400e6)::double as age, 1 - (row_number() over (order by created_at desc, id) - 1) / count(*) over ()::double as signal from notes), y as (select id, 0.3 * (0.05 + 0.95 * (0.96 * pow(0.5, greatest(age, 0.0) / 365) + 0.04 * signal)) as score from x) select id, round(score, 6) as score from y where score > 0.01")
def recency_half_life(s, d):
    return search.recency(T.notes(s, d), NOW_US).select("id", r6("score").alias("score"))


# Fusion and re-scoring: scores of three dimensions over memories


def scores(s, d) -> DataFrame:
    m, q = T.memories(s, d), T.queries(s, d)
    age = search.recency(m, NOW_US).orderBy(F.desc("score"), "id").limit(50).select("id", "score")
    return fusion.tagged(semantic=search.vector_search(m, q, 50), bm25=search.max_norm(search.bm25_search(m, q, 50, stem=False)), temporal=q.select("query_id").crossJoin(F.broadcast(age)))


def intents(s, d) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("temporal", "causal", "entity", "factual"))), (F.col("query_id") % 4 + 1).cast("int"))
    return T.queries(s, d).select("query_id", kind.alias("intent"))


def fused_rows(df: DataFrame, *more: str) -> DataFrame:
    return df.select("query_id", "id", r6("fused_score").alias("fused_score"), *more)


_INTENTS = "intents as (select query_id, (['temporal', 'causal', 'entity', 'factual'])[query_id % 4 + 1] as intent from queries)"
_SCORES = T.sql("memories", "queries") + ", " + SCORES.replace("{now}", str(NOW_US))


@query(_SCORES + ", " + RANKED + " select query_id, id, round(semantic, 6) as semantic, round(bm25, 6) as bm25, round(temporal, 6) as temporal, round(fused_score, 6) as fused_score from rrf")
def fuse_rrf(s, d):
    return fusion.fuse_rrf(scores(s, d)).select("query_id", "id", *(r6(c).alias(c) for c in ("semantic", "bm25", "temporal", "fused_score")))


@query(_SCORES + ", " + _INTENTS + ", " + FUSED + " select query_id, id, round(case intent when 'temporal' then .35 * semantic + .20 * bm25 + .35 * temporal when 'factual' then .50 * semantic + .30 * bm25 + .10 * temporal else .35 * semantic + .20 * bm25 + .05 * temporal end, 6) as fused_score from wide join intents using (query_id) where semantic >= .15 or bm25 >= .3")
def fuse_weighted(s, d):
    return fused_rows(fusion.fuse_weighted(scores(s, d), intents(s, d)))


_ADJUSTED = _SCORES + ", " + _INTENTS + ", " + RANKED + """, n as (select *, (semantic > 0)::int + (bm25 > 0)::int + (temporal > 0)::int as n from rrf join intents using (query_id)),
adjusted as (select query_id, id, intent, semantic, case n when 3 then .8 when 2 then .6 when 1 then case when intent in ('factual', 'entity') then .7 else .4 end else .2 end::double as confidence, fused_score * confidence as fused_score from n)"""


def adjusted(s, d) -> DataFrame:
    return fusion.adjust_confidence(fusion.fuse_rrf(scores(s, d)), intents(s, d))


@query(_ADJUSTED + " select query_id, id, round(fused_score, 6) as fused_score, confidence from adjusted")
def confidence_adjust(s, d):
    return fused_rows(adjusted(s, d), "confidence")


@query(_ADJUSTED + ", one as (select query_id, 'en' as who from queries where query_id % 2 = 0), x as (select a.query_id, a.id, fused_score * case when who is not null and lower(lang) <> who then 0.2 else 1.0 end as fused_score from adjusted a left join one using (query_id) join memories m on m.id = a.id) select query_id, id, round(fused_score, 9) as fused_score from x")
def speaker_rerank(s, d):
    """The language stands for the speaker; every other query names one."""
    who = T.queries(s, d).where("query_id % 2 = 0").select("query_id", F.lit("en").alias("entity"))
    m = T.memories(s, d).withColumn("speaker", F.col("metadata")["lang"])
    return fusion.rerank_speaker(adjusted(s, d), m, who).select("query_id", "id", F.round("fused_score", 9).alias("fused_score"))


@query(_ADJUSTED + ", e as (select *, exp(fused_score - max(fused_score) over (partition by query_id)) as e, row_number() over (partition by query_id order by round(fused_score, 9) desc, id) as rank, count(*) over (partition by query_id) as n from adjusted), f as (select *, coalesce(sum(e) over (partition by query_id order by rank rows between unbounded preceding and 1 preceding), 0) / sum(e) over (partition by query_id) as b from e) select query_id, id, rank::integer as rank, round(fused_score, 6) as fused_score from f where b < .3 or rank <= least(n, 5)")
def adaptive_k(s, d):
    x = adjusted(s, d).withColumn("fused_score", F.round("fused_score", 9))
    return fused_rows(fusion.adaptive_k(x, 0.3, K), "rank")


_CONV = "v as (select *, embedding::double[] as embedding2 from turns join embeddings on vec_id = turns.id % (select count(*) from embeddings))"


def turns(s, d) -> DataFrame:
    e = T.table(s, d, "embeddings")
    n = e.agg(F.count("*").alias("n"))
    t = T.turns(s, d).crossJoin(F.broadcast(n)).withColumn("vec_id", F.col("id") % F.col("n"))
    return t.join(e, "vec_id").select("id", "content", "speaker", F.col("conv_id").cast("string").alias("conv"), "turn", F.col("embedding").cast("array<double>").alias("embedding"))


@query(T.sql("turns", "queries") + f""", {_CONV}, s as materialized (select query_id, v.id, conv_id, turn, round(greatest(0, least(1, list_cosine_similarity(query_embedding, embedding2))), 9) as score from queries cross join v),
p as (select * from (select *, row_number() over (partition by query_id order by score desc, id) as r from s) where r <= 3 and score >= 0.05), ten as (select * from (select *, row_number() over (partition by query_id order by score desc, id) as r from s) where r <= 10),
w as (select query_id, conv_id, turn + delta as turn, max(score) as p from p cross join (values (-2), (-1), (1), (2)) as t(delta) where turn + delta >= 1 group by all)
select w.query_id, s.id, round(0.8 * p, 6) as fused_score, round(score, 6) as semantic from w join s on s.query_id = w.query_id and s.conv_id = w.conv_id and s.turn = w.turn anti join ten on ten.query_id = s.query_id and ten.id = s.id where score >= 0.2
union all select query_id, id, round(score, 6), round(score, 6) from ten""")
def dialog_bridge(s, d):
    t, q = turns(s, d), T.queries(s, d)
    found = search.vector_search(t, q, 10)
    zero = [F.lit(0.0).alias(c) for c in ("bm25", "temporal", "causal", "entity")]
    x = found.select("query_id", "id", F.col("score").alias("semantic"), *zero, F.col("score").alias("fused_score"), F.lit(1.0).alias("confidence"))
    return fused_rows(fusion.bridge_dialog(x, t, q), r6("semantic").alias("semantic"))


@query()
def mmr_select(s, d):
    return fused_rows(fusion.select_mmr(adjusted(s, d), T.memories(s, d), K), "rank")


@query()
def greedy_coverage(s, d):
    q = T.queries(s, d).withColumn("query_text", F.concat(F.lit("list all "), "query_text"))
    return fused_rows(fusion.select_coverage(adjusted(s, d), T.memories(s, d), q, K), "rank")


# Graphs

_START = "select event_id as id from events where event_type = 'error'"


def _paths_sql(a: str, b: str) -> str:
    return T.sql("edges").replace("with ", "with recursive ", 1) + f""", p as (select {a} as start, {b} as id, 1 as hops, confidence, {a} || '>' || {b} as path from edges where {a} in ({_START})
union all select start, {b}, hops + 1, p.confidence * e.confidence, path || '>' || {b} from p join edges e on p.id = e.{a} where hops < 3) select start, id, hops::integer as hops, round(confidence, 6) as confidence, path from p"""


def _paths(s, d, forward: bool) -> DataFrame:
    starts = T.table(s, d, "events").where("event_type = 'error'").select(F.col("event_id").alias("id"))
    return graph.paths(T.causal_edges(s, d), starts, 3, forward).select("start", "id", "hops", r6("confidence").alias("confidence"), F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(_paths_sql("cause", "effect"))
def get_effects(s, d):
    return _paths(s, d, True)


@query(_paths_sql("effect", "cause"))
def get_causes(s, d):
    return _paths(s, d, False)


@query(T.sql("edges") + " select count(*) as edges, count(distinct cause) as causes from edges")
def causal_graph_counts(s, d):
    return T.causal_edges(s, d).agg(F.count("*").alias("edges"), F.count_distinct("cause").alias("causes"))


@query(T.sql("edges") + ", x as (select cause, effect, confidence + 0.2 as confidence from edges) select cause, effect, round(confidence, 6) as confidence from edges union all select cause, effect, round(confidence, 6) from x where confidence <= 1")
def add_causal_link(s, d):
    e = T.causal_edges(s, d)
    return graph.add_causal_links(e, e.withColumn("confidence", F.col("confidence") + 0.2))[0].withColumn("confidence", r6("confidence"))


@query(T.sql("mentions", "facts") + " select distinct entity, memory_id from mentions where entity in (select entity from facts where entity_type = 'organization')")
def entity_memories(s, d):
    return graph.entity_memories(T.mentions(s, d), T.facts(s, d).where("entity_type = 'organization'").select("entity").distinct())


@query(T.sql("mentions") + " select memory_id, string_agg(entity, '|' order by entity) as entities from (select distinct * from mentions) group by 1")
def memory_entities(s, d):
    return T.mentions(s, d).groupBy("memory_id").agg(joined(F.array_sort(F.collect_set("entity"))).alias("entities"))


@query(T.sql("relations") + f", {_RELATED} select * from related")
def related_entities(s, d):
    return search.related(T.relations(s, d))


@query(T.sql("relations") + " select * from relations union select to_entity, from_entity, relation from relations")
def link_entities(s, d):
    r = T.relations(s, d)
    new = r.select(F.col("to_entity").alias("from_entity"), F.col("from_entity").alias("to_entity"), "relation")
    return graph.link_entities(r, new.unionByName(r))


@query(T.sql("edges") + f" select cause, effect from edges where cause not in ({_START}) and effect not in ({_START})")
def remove_memories(s, d):
    gone = T.table(s, d, "events").where("event_type = 'error'").select(F.col("event_id").alias("id"))
    return graph.without_memories(T.causal_edges(s, d), gone, "cause", "effect").select("cause", "effect")


@query(T.sql("mentions") + " select entity, count(distinct memory_id) as mention_count from mentions group by 1")
def mention_count(s, d):
    return profile.mention_counts(T.mentions(s, d))


_SEEDS = "seeds as (select user_id as query_id, event_id as id, 0.5::double + (event_id % 50) / 100.0::double as score from events where event_type = 'error')"


def seeds(s, d) -> DataFrame:
    return T.table(s, d, "events").where("event_type = 'error'").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), (F.lit(0.5) + F.col("event_id") % 50 / 100.0).alias("score"))


def _both_ways() -> str:
    one = lambda a, b: f"select {a} as start, {b} as id, 1 as hops, confidence from edges union all select x.{a}, y.{b}, 2, x.confidence * y.confidence from edges x join edges y on x.{b} = y.{a}"
    return f"p as ({one('cause', 'effect')} union all {one('effect', 'cause')})"


@query(T.sql("edges") + f", {_SEEDS}, {_both_ways()}, x as (select query_id, p.id, max(round(score * confidence * pow(.7, hops), 9)) as score from seeds join p on p.start = seeds.id where confidence >= .3 group by all), y as (select * from x anti join seeds using (query_id, id)), r as (select *, row_number() over (partition by query_id order by score desc, id) as n from y) select query_id, id, round(score, 6) as score from r where n <= {K}")
def expand_causal(s, d):
    return scored(graph.expand_causal(seeds(s, d), T.causal_edges(s, d), K))


@query(T.sql("mentions", "relations") + f""", {_SEEDS}, {_RELATED}, few as (select * from (select entity, memory_id as id, row_number() over (partition by entity order by memory_id) as n from mentions) where n <= 6),
own as (select query_id, s.id as start, score, entity from seeds s join mentions m on m.memory_id = s.id),
x as (select query_id, start, f.id, score * .7 as score from own join few f using (entity) where f.id <> start union all select query_id, start, f.id, score * .49 from own o join related r on r.entity = o.entity join few f on f.entity = r.other where f.id <> start),
y as (select query_id, start, id, max(score) as score from x group by all), c as (select *, row_number() over (partition by query_id, start order by score desc, id) as n from y),
z as (select query_id, id, max(score) as score from c where n <= 5 group by all), w as (select * from z anti join seeds using (query_id, id)), r as (select *, row_number() over (partition by query_id order by score desc, id) as n from w)
select query_id, id, round(score, 6) as score from r where n <= {K}""")
def expand_entity(s, d):
    return scored(graph.expand_entity(seeds(s, d), T.mentions(s, d), T.relations(s, d), K))


@query(T.sql("relations") + ", n as (select distinct from_entity as e from relations), x as (select from_entity, to_entity from relations where to_entity in (select e from n)) select from_entity, to_entity, 'friend' as relation from x union all select from_entity, to_entity, 'works' from x union all select from_entity, to_entity, 'sister' from x")
def relationship_repair(s, d):
    r = T.relations(s, d)
    value = F.explode(F.array(F.concat(F.lit("friend of "), "to_entity"), F.concat(F.lit("works with "), "to_entity"), F.concat(F.col("to_entity"), F.lit(" (sister)"))))
    return graph.repaired_relations(r.select(F.col("from_entity").alias("entity"), F.lit("relationship").alias("fact_type"), value.alias("value")))


# Profiles


@query(T.sql("facts") + """, x as (select entity, fact_type, value, confidence from facts union all select entity, 'interest', 'sport 1', 0.9 from facts union all select entity, 'sport', 'Sport 1', 1.5 from facts where entity_type = 'person' union all select entity, 'food', 'n/a', 1 from facts union all select entity, 'action', 'says hi', 1 from facts),
y as (select * from x where strlen(trim(value)) between 3 and 100 and lower(trim(value)) <> 'n/a' and not (fact_type = 'action' and lower(value) like 'says%')),
sure as (select distinct entity, lower(trim(value)) as v from y where fact_type in ('sport', 'hobby'))
select entity, fact_type, lower(trim(value)) as value, round(least(max(confidence), 1.0), 6) as confidence from y where fact_type in ('sport', 'hobby') or (entity, lower(trim(value))) not in (select (entity, v) from sure) group by entity, fact_type, lower(trim(value))""")
def profile_add_fact(s, d):
    f = T.facts(s, d)
    more = lambda x, kind, value, c: x.select("entity", "entity_type", F.lit(kind).alias("fact_type"), F.lit(value).alias("value"), F.lit(float(c)).alias("confidence"), "source_memory")
    x = f.unionByName(more(f, "interest", "sport 1", 0.9)).unionByName(more(f.where("entity_type = 'person'"), "sport", "Sport 1", 1.5)).unionByName(more(f, "food", "n/a", 1)).unionByName(more(f, "action", "says hi", 1))
    return profile.add_facts(x).select("entity", "fact_type", F.lower(F.trim("value")).alias("value"), r6("confidence").alias("confidence"))


@query(T.sql("facts") + ", x as (select entity, entity_type, string_agg(fact_type || ': ' || value, '; ' order by confidence desc, fact_type, value) as s from facts group by all) select entity, 'Profile of ' || entity || ' (' || entity_type || '): ' || s as summary from x")
def profile_summary(s, d):
    return profile.summaries(T.facts(s, d))


@query(T.sql("facts") + ", r as (select *, row_number() over (partition by entity, fact_type order by confidence desc, value) as n from facts) select entity, fact_type, value, round(confidence, 6) as confidence from r where n = 1")
def best_facts(s, d):
    return profile.best_facts(T.facts(s, d)).withColumn("confidence", r6("confidence"))


@query(T.sql("facts") + " select entity, fact_type, value from facts where source_memory not in (select event_id from events where event_type = 'error')")
def profile_remove_sources(s, d):
    gone = T.table(s, d, "events").where("event_type = 'error'").select(F.col("event_id").alias("id"))
    return profile.remove_sources(T.facts(s, d), gone).select("entity", "fact_type", "value")


@query(T.sql("edges") + ", x as (select 'n' || cause as a, 'n' || effect as b, confidence, cause as source_memory from edges where confidence >= .5) select a as entity, 'next of ' || b as value, round(confidence, 6) as confidence, source_memory from x union all select b, 'next of ' || a, round(confidence, 6), source_memory from x")
def store_relationships(s, d):
    name = lambda c: F.concat(F.lit("N"), F.col(c).cast("string"))
    x = T.causal_edges(s, d).select(name("cause").alias("from_entity"), name("effect").alias("to_entity"), F.lit("next").alias("relation"), "confidence", F.col("cause").alias("source_memory"))
    return profile.store_relationships(x)[0].select("entity", "value", r6("confidence").alias("confidence"), "source_memory")


@query(T.sql("notes") + " select user_id as id, case when bool_or(event_type = 'click') then 'episodic' when bool_or(event_type = 'view') then 'procedural' else 'semantic' end as record_type, min(strftime(created_at, '%Y-%m-%d')) as event_date from notes group by 1")
def annotate_types(s, d):
    kind = F.when(F.col("event_type") == "click", "episodic").when(F.col("event_type") == "view", "procedural").otherwise("semantic")
    r = T.notes(s, d).groupBy(F.col("user_id").alias("id")).agg(F.collect_list(F.struct(kind.alias("record_type"), F.date_format("created_at", "yyyy-MM-dd").alias("event_date"), F.col("content").alias("summary"))).alias("records"))
    return profile.annotate(r).select("id", "record_type", "event_date")


@query()
def query_full(s, d):
    """All stages for every question over all notes but the graphs' expansion, which the query expansion_policy has."""
    m, q = planner.notes_with_embeddings(s, d), planner.questions_with_embeddings(s, d)
    return fused_rows(planner.run(m, q, facts=T.facts(s, d), mentions=T.mentions(s, d), relations=T.relations(s, d), edges=T.causal_edges(s, d), limit=K, expand=False), "rank")


# Measures

_GOLD = f"""gtoks as (select id, list_distinct({tok('content')}) as t from memories), gflat as (select id, unnest(t) as term from gtoks), gdf as (select term, count(*) as df from gflat group by 1),
gq as (select query_id, unnest(list_distinct({tok('query_text')})) as term from queries), grare as (select query_id, term, row_number() over (partition by query_id order by df, term) as n from gq join gdf using (term)),
gold as (select query_id, id from (select query_id, id, count(*) as c, row_number() over (partition by query_id order by count(*) desc, id) as n from grare join gflat using (term) where grare.n <= 10 group by query_id, id) where n <= 5)"""


def gold(s, d) -> DataFrame:
    """The five memories that hold most of a query's ten rarest words stand for its evidence; taken from all memories."""
    word = T.memories(s, d).select("id", F.explode(F.array_distinct(tx.bm25_tokens(F.col("content"), False))).alias("term"))
    ask = T.queries(s, d).select("query_id", F.explode(F.array_distinct(tx.bm25_tokens(F.col("query_text"), False))).alias("term"))
    df = word.groupBy("term").agg(F.count("*").alias("df"))
    rare = ask.join(df, "term").withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("df", "term"))).where("n <= 10")
    x = rare.select("query_id", "term").join(word, "term").groupBy("query_id", "id").agg(F.count("*").alias("c"))
    return x.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("c"), "id"))).where("r <= 5").select("query_id", "id")


@query(T.sql("memories", "queries") + ", " + VECTOR + f", {_GOLD} select g.query_id, round(count(rank) / count(*)::double, 6) as recall, round(coalesce(1.0 / min(rank), 0), 6)::double as reciprocal_rank from gold g left join (select query_id, id, rank from sem where rank <= 50) s on s.query_id = g.query_id and s.id = g.id group by 1")
def recall_at_k(s, d):
    found = search.top(search.vector_search(T.memories(s, d), T.queries(s, d), 50), 50)
    return metrics.recall_at(found, gold(s, d), 50).select("query_id", r6("recall").alias("recall"), r6("reciprocal_rank").alias("reciprocal_rank"))


@query(T.sql("memories", "queries") + ", " + VECTOR + f", {_GOLD}, r as (select g.query_id, coalesce(1.0 / min(rank), 0) as rr from gold g left join (select query_id, id, rank from sem where rank <= 50) s on s.query_id = g.query_id and s.id = g.id group by 1) select round(avg(rr), 6)::double as mrr from r")
def mrr(s, d):
    return recall_at_k_raw(s, d).agg(r6(F.avg("reciprocal_rank")).alias("mrr"))


def recall_at_k_raw(s, d) -> DataFrame:
    return metrics.recall_at(search.top(search.vector_search(T.memories(s, d), T.queries(s, d), 50), 50), gold(s, d), 50)


def _tokens_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array(regexp_replace(lower({x}), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda w: w <> '')"


@query(T.sql("notes") + f", x as (select id, list_distinct({_tokens_sql('content')}) as a, list_distinct({_tokens_sql('speaker')} || {_tokens_sql('event_type')}) as b from notes) select id, round(case when len(list_intersect(a, b)) > 0 then 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) else 0 end::double, 6) as f1 from x")
def answer_f1(s, d):
    return T.notes(s, d).select("id", r6(metrics.set_f1(F.col("content"), F.concat_ws(" ", "speaker", "event_type"))).alias("f1"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: every benchmark text against all memories, five dimensions fused."""
    return fused_rows(adjusted(spark, sf_dir), "confidence")


@query("select date_trunc('day', ts)::timestamp as start, event_type, count(*) as n, round(sum(value), 2) as total from events group by all")
def window_counts(s, d):
    from ..streaming.ingest import window_counts as counts

    return counts(T.table(s, d, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


from . import more  # noqa: E402, F401  (registers further queries)
