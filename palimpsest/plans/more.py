"""Further queries: branches of the planner, what models extracted, measures, and SQL for the graph and fusion operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parse
from ..functions import text as tx
from ..operators import extraction, fusion, graph, metrics, profile, search
from ..sources import tables as T
from ..streaming import ingest
from . import planner
from .oracle import VECTOR, collects, intent_of, temporal, terms, tok
from .queries import _ADJUSTED, _DETECTED, _FACT_SEARCH, _RELATED, _SEEDS, K, NOW_US, adjusted, detected, fused_rows, intents, joined, query, r6, scored, seeds

# Planner branches


@query(T.sql("notes", "questions") + f""", m as (select id, list_sort(list_transform({temporal('content')}, lambda x: lower(x))) as e from notes), k as (select * from (select *, row_number() over (partition by e order by id) as r from m where len(e) > 0) where r <= {K}),
q as (select query_id, list_sort(list_transform({temporal('query_text')}, lambda x: lower(x))) as x from questions),
s as (select query_id, id, round(list_sum(list_transform(x, lambda y: case when list_contains(e, y) then 1.0::double when regexp_matches(y, '{tx.RELATIVE.replace("'", "''")}') then 0.5::double else 0.3::double end)) / len(x), 9) as score from q cross join k where len(x) > 0)
select query_id, id, round(score, 6) as score from (select *, row_number() over (partition by query_id order by score desc, id) as r2 from s) where r2 <= {K}""")
def temporal_overlap(s, d):
    return scored(search.temporal_overlap(T.notes(s, d), T.questions(s, d), K))


_USER = "user7"


@query(T.sql("facts", "questions") + f", {_DETECTED} select query_id, entity from detected union select query_id, '{_USER}' from questions where regexp_matches(lower(query_text), '(^|[^a-z0-9''])(i|me|my|mine|myself|i''m|i''ve|i''d|i''ll)($|[^a-z0-9''])')")
def first_person_entities(s, d):
    return search.with_user(detected(s, d), T.questions(s, d), _USER.upper())


@query(T.sql("questions") + ", " + intent_of("questions") + """, p as (select i.query_id, i.intent, unnest([{'intent': 'temporal', 'score': s.t, 'n': 0}, {'intent': 'causal', 'score': s.c, 'n': 1}, {'intent': 'entity', 'score': s.e, 'n': 2}]) as k from intents i join signs s using (query_id))
select query_id, string_agg(k.intent || ' ' || round(k.score, 1), '|' order by k.score desc, k.n) as others from p where k.intent <> intent and k.score > 0.3 group by 1""")
def intent_secondary(s, d):
    x = T.questions(s, d).select("query_id", tx.secondary(tx.intent(F.col("query_text"))).alias("o")).where(F.size("o") > 0)
    return x.select("query_id", joined(F.transform("o", lambda k: F.concat(k["intent"], F.lit(" "), F.round(k["score"], 1).cast("string")))).alias("others"))


_GATE = T.sql("memories", "queries") + ", " + VECTOR + f""", bound as (select query_id, case when {collects('query_text')} = 'aggregation' then 0.15::double else 0.3::double end as b from (select query_id, case when query_id % 2 = 0 then 'list all ' || query_text else query_text end as query_text from queries)),
linked as (select query_id, id from sem where rank <= 50 and id % 3 = 0)"""


@query(_GATE + " select query_id, id, round(score, 6) as score from (select * from sem where rank <= 50) s join bound using (query_id) left join (select *, true as l from linked) using (query_id, id) where l or score >= b")
def prefusion_gate(s, d):
    """Every other query collects; memories whose id divides by three have an entity score."""
    q = T.queries(s, d).withColumn("query_text", F.when(F.col("query_id") % 2 == 0, F.concat(F.lit("list all "), "query_text")).otherwise(F.col("query_text")))
    x = search.vector_search(T.memories(s, d), q, 50)
    return scored(search.semantic_gate(x, x.where("id % 3 = 0"), q))


def _causal_sql(seeds: str, out: str) -> str:
    return f"""{out}_x as (select query_id, s.id as start, p.id, round(s.score * confidence * pow(.7, hops), 12) as score, dir, row_number() over (partition by query_id, s.id, dir order by s.score * confidence * pow(.7, hops) desc, p.id) as n from {seeds} s join pd p on p.start = s.id where confidence >= .3),
{out}_y as (select query_id, id, max(score) as score from {out}_x where n <= 5 group by all), {out}_z as (select * from {out}_y anti join {seeds} using (query_id, id)),
{out} as (select query_id, id, score from (select *, row_number() over (partition by query_id order by score desc, id) as n from {out}_z) where n <= {K})"""


def _entity_sql(seeds: str, out: str) -> str:
    return f"""{out}_own as (select query_id, s.id as start, score, entity from {seeds} s join mentions m on m.memory_id = s.id),
{out}_x as (select query_id, start, f.id, score * .7 as score from {out}_own join few f using (entity) where f.id <> start union all select query_id, start, f.id, score * .49 from {out}_own o join related r on r.entity = o.entity join few f on f.entity = r.other where f.id <> start),
{out}_y as (select query_id, start, id, max(score) as score from {out}_x group by all), {out}_c as (select *, row_number() over (partition by query_id, start order by score desc, id) as n from {out}_y),
{out}_z as (select query_id, id, max(score) as score from {out}_c where n <= 5 group by all), {out}_w as (select * from {out}_z anti join {seeds} using (query_id, id)),
{out} as (select query_id, id, score from (select *, row_number() over (partition by query_id order by score desc, id) as n from {out}_w) where n <= {K})"""


_FEW = "few as (select * from (select entity, memory_id as id, row_number() over (partition by entity order by memory_id) as n from mentions) where n <= 6)"
_PD = "pd as (select start, id, hops, confidence, 0 as dir from (select cause as start, effect as id, 1 as hops, confidence from edges union all select x.cause, y.effect, 2, x.confidence * y.confidence from edges x join edges y on x.effect = y.cause) union all select start, id, hops, confidence, 1 from (select effect as start, cause as id, 1 as hops, confidence from edges union all select x.effect, y.cause, 2, x.confidence * y.confidence from edges x join edges y on x.cause = y.effect))"


def _hybrid_sql(a: str, b: str, out: str) -> str:
    return f"""{out}_u as (select *, 0 as turn from {a} union all select *, 1 from {b} b where not exists (select 1 from {a} a where a.query_id = b.query_id and a.id = b.id)),
{out} as (select query_id, id, score from (select *, row_number() over (partition by query_id order by turn, score desc, id) as n from {out}_u) where n <= {K})"""


_GRAPHS = T.sql("edges", "mentions", "relations") + f", {_SEEDS}, {_RELATED}, {_FEW}, {_PD}"


@query(f"{_GRAPHS}, {_entity_sql('seeds', 'ea')}, {_causal_sql('seeds', 'ca')}, {_hybrid_sql('ea', 'ca', 'hy')} select query_id, id, round(score, 6) as score from hy")
def expand_hybrid(s, d):
    return scored(graph.expand_hybrid(seeds(s, d), T.causal_edges(s, d), T.mentions(s, d), T.relations(s, d), K))


_KIND = "(['temporal', 'causal', 'entity', 'factual'])[query_id % 4 + 1]"


@query(f"""{_GRAPHS}, good as (select query_id, {_KIND} as intent from seeds group by query_id having round(avg(score), 9) >= .6),
sc as (select s.* from seeds s join good using (query_id) where intent = 'causal'), se as (select s.* from seeds s join good using (query_id) where intent in ('entity', 'factual')), st as (select s.* from seeds s join good using (query_id) where intent = 'temporal'),
{_causal_sql('sc', 'c1')}, {_entity_sql('se', 'e1')}, {_entity_sql('st', 'e2')}, {_causal_sql('st', 'c2')}, {_hybrid_sql('e2', 'c2', 'h2')}
select query_id, id, 'causal' as dim, round(score, 6) as score from c1 union all select query_id, id, 'entity', round(score, 6) from e1 union all select query_id, id, 'temporal', round(score * .7, 6) from h2 union all select query_id, id, 'entity', round(score * .5, 6) from h2""")
def expansion_policy(s, d):
    x = seeds(s, d)
    kind = F.element_at(F.array(*map(F.lit, ("temporal", "causal", "entity", "factual"))), (F.col("query_id") % 4 + 1).cast("int"))
    i = x.select("query_id").distinct().select("query_id", kind.alias("intent"))
    return graph.expansion_policy(x, i, T.causal_edges(s, d), T.mentions(s, d), T.relations(s, d), K).withColumn("score", r6("score"))


_NOTE_BM = f"""toks as (select id, {tok('content')} as t from notes), flat as (select id, len(t) as l, unnest(t) as term from toks),
post as (select id, l, term, count(*) as tf from flat group by all), stt as (select count(*) as n, avg(len(t)) as avgdl from toks), dfs as (select term, count(*) as df from post group by 1)"""


def _bm_of(asked: str, k: int) -> str:
    """CTEs qw, bs, bm over notes for (query_id, query_text)."""
    return f"""{_NOTE_BM}, qw as (select query_id, term, count(*) as times from (select query_id, unnest({tok('query_text')}) as term from {asked}) group by all),
bs as (select query_id, id, round(sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / avgdl))), 9) as score from qw join post using (term) join dfs using (term) cross join stt group by all),
bm as (select * from (select *, row_number() over (partition by query_id order by score desc, id) as rank from bs) where rank <= {k})"""


@query(T.sql("notes", "facts", "questions") + f""", {_DETECTED}, names_asked as (select distinct entity as query_id, entity as query_text from detected), {_bm_of('names_asked', K * 5)},
x as (select d.query_id, bm.id, least(sum(score / (score + 1)), 1.0) as score from detected d join bm on bm.query_id = d.entity group by all), r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from x where true)
select query_id, id, round(score / max(score) over (partition by query_id), 6) as score from r where rank <= {K}""")
def entity_keyword_fallback(s, d):
    return scored(search.entity_keyword_search(T.notes(s, d), detected(s, d), K, stem=False))


_NOTES_E = "ne as (select notes.*, embedding::double[] as embedding from notes join embeddings on vec_id = notes.id % (select count(*) from embeddings)), qe as (select questions.*, embedding::double[] as query_embedding from questions join embeddings on vec_id = query_id % (select count(*) from embeddings))"


@query(_FACT_SEARCH + f""", fe as (select entity, fact_type, value, confidence, source_memory, embedding::double[] as embedding from facts join embeddings on vec_id = source_memory % (select count(*) from embeddings)),
qe as (select questions.*, embedding::double[] as query_embedding from questions join embeddings on vec_id = query_id % (select count(*) from embeddings)),
c as (select query_id, source_memory as id, list_cosine_similarity(query_embedding, embedding) as c, confidence from detected join qe using (query_id) join fe using (entity)),
z as (select query_id, id, round(least(sum(c * confidence), 1.0), 9) as score from c where c >= .3 group by all), k as (select *, row_number() over (partition by query_id order by score desc, id) as rank from z)
select query_id, id, round(score, 6) as score from k where rank <= {K}""")
def fact_embedding_search(s, d):
    e = T.table(s, d, "embeddings")
    f = planner._with_vectors(T.facts(s, d), "source_memory", e, "embedding")
    return scored(search.fact_embedding_search(f, planner.questions_with_embeddings(s, d), detected(s, d), K))


_BOOST = """fz as (select query_id, source_memory as id, s from y where hit and s > 0 union all select distinct query_id, source_memory, 0.3 from y where not hit),
fr as (select query_id, id, least(sum(s), 1.0) as score from fz group by all), boost as (select * from (select *, row_number() over (partition by query_id order by score desc, id) as rank from fr) where rank <= 200)"""


@query(_FACT_SEARCH.replace(_DETECTED, intent_of("questions") + ", names as (select distinct entity from facts), detected as (select query_id, lower(entity_focus) as entity from intents where entity_focus is not null)").replace("with facts", T.sql("notes", "mentions") + ", facts", 1) + f""", {_BOOST}, {_NOTES_E}, {_bm_of('questions', 200)},
x2 as (select d.query_id, ne.id, greatest(list_cosine_similarity(query_embedding, embedding), 0) as sem, coalesce(bm.score, 0) as b, coalesce(boost.score, 0) as boost, lower(speaker) as who, d.entity from detected d join qe using (query_id) join mentions on mentions.entity = d.entity join ne on ne.id = memory_id left join bm on bm.query_id = d.query_id and bm.id = ne.id left join boost on boost.query_id = d.query_id and boost.id = ne.id),
f2 as (select *, (case when boost > 0 then least(.7 * sem + .3 * b + boost * .5, 1.0) else .7 * sem + .3 * b end) * case when who is null then .7 when who = entity then 1.0 else .4 end as fused_score from x2)
select query_id, id, round(fused_score, 6) as fused_score, rank::integer as rank from (select *, row_number() over (partition by query_id order by round(fused_score, 9) desc, id) as rank from f2) where rank <= {K}""")
def entity_focused(s, d):
    m, q = planner.notes_with_embeddings(s, d), planner.questions_with_embeddings(s, d)
    i = q.select("query_id", "query_embedding", F.lower(tx.intent(F.col("query_text"))["entity_focus"]).alias("entity")).where("entity is not null")
    # Only queries with a focus have results, so only their words are looked for.
    key = search.bm25_search(m, q.join(i.select("query_id"), "query_id", "left_semi"), 200, stem=False)
    boost = search.fact_search(T.facts(s, d), i.select("query_id", "entity"), q, 200, stem=False)[0]
    return fused_rows(search.entity_focused(i, m, T.mentions(s, d), key, boost, K), "rank")


@query(T.sql("notes", "facts", "questions", "mentions") + f""", {_DETECTED}, {_NOTES_E}, pairs as (select query_id, ne.id, round(greatest(0, least(1, list_cosine_similarity(query_embedding, embedding))), 9) as score from qe cross join ne),
sem as (select * from (select *, row_number() over (partition by query_id order by score desc, id) as rank from pairs) where rank <= {K}), base as (select query_id, id, 1.0::double / (60 + rank) as fused_score from sem where score >= .15),
one as (select query_id, min(entity) as entity from detected group by 1 having count(*) = 1), ask as (select q.query_id, query_embedding, entity from qe q join one using (query_id) where {collects('query_text')} = 'aggregation'),
new as (select a.query_id, m.memory_id as id, query_embedding from ask a join mentions m using (entity) anti join base b on b.query_id = a.query_id and b.id = m.memory_id),
near as (select n.query_id, n.id, max(list_cosine_similarity(ne.embedding, t.embedding)) as c from new n join ne on ne.id = n.id join base b on b.query_id = n.query_id join ne t on t.id = b.id group by all),
s as (select n.query_id, n.id, round(0.7 * greatest(list_cosine_similarity(query_embedding, embedding), 0), 12) as s from new n join ne using (id) left join near on near.query_id = n.query_id and near.id = n.id where coalesce(c, 0) < .8),
r as (select *, row_number() over (partition by query_id order by s desc, id) as n from s)
select query_id, id, round(fused_score, 6) as fused_score from base union all select query_id, id, round(s, 6) from r where n <= 5""")
def aggregation_expand(s, d):
    m, q, ask = planner.notes_with_embeddings(s, d), planner.questions_with_embeddings(s, d), detected(s, d)
    x = fusion.fuse_rrf(fusion.tagged(semantic=search.vector_search(m, q, K))).withColumn("confidence", F.lit(1.0))
    return fused_rows(fusion.expand_aggregation(x, q, ask, T.mentions(s, d), m))


@query(_ADJUSTED + f""", d as (select *, row_number() over (partition by query_id order by fused_score desc, id) as r from adjusted),
x as (select d.query_id, d.id, d.intent, semantic, {terms('query_text')} as qt, {terms('content')} as ct, list_distinct(list_transform(list_filter(regexp_split_to_array(content, '\\s+'), lambda w: strlen(w) > 2 and regexp_matches(w, '^\\p{{Lu}}')), lambda w: lower(w))) as caps, greatest(({NOW_US} - us) / 86400e6, 0.0)::double as age
  from d join memories m on m.id = d.id join queries q on q.query_id = d.query_id where r <= 20),
p as (select *, case when len(qt) > 0 and len(ct) > 0 then len(list_intersect(qt, ct)) / len(list_distinct(list_concat(qt, ct)))::double else 0 end as j, case when len(qt) > 0 and len(caps) > 0 then least(len(list_intersect(qt, caps)) / len(qt)::double, 1.0) else 0 end as e,
  0.05 + 0.95 * pow(0.5, age / case when intent = 'temporal' then 30.0 else 365.0 end) as t from x),
y as (select query_id, id, case intent when 'temporal' then .25 * semantic + .20 * j + .45 * t + .10 * e when 'causal' then .35 * semantic + .30 * j + .15 * t + .20 * e when 'entity' then .30 * semantic + .25 * j + .05 * t + .40 * e else .50 * semantic + .35 * j + .05 * t + .10 * e end as score from p)
select query_id, id, round(score, 6) as score, rank::integer as rank from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from y) where rank <= {K}""")
def heuristic_rerank(s, d):
    q = T.queries(s, d).join(intents(s, d), "query_id")
    return scored(fusion.heuristic_rerank(adjusted(s, d), T.memories(s, d), q, NOW_US, K), "rank")


# What models say: descriptions made from the events

_SAID = """to_json({'entities': [{'name': 'User' || user_id, 'role': 'subject', 'mentions': [event_type], 'type': 'person'}], 'temporal': {'markers': ['yesterday'], 'sequence': case when event_id % 2 = 0 then 'early' else 'late' end, 'relative_time': 'before lunch', 'absolute_dates': [strftime(ts, '%Y-%m-%d')]},
'causal': {'relationships': [{'cause': event_type, 'effect': 'a note', 'confidence': 0.5}], 'density': 0.25, 'explicit_markers': case when event_type = 'error' then ['because'] else [] end, 'has_implicit_causation': event_id % 3 = 0}, 'topics': [event_type], 'importance': 0.5})"""


def described(s, d) -> DataFrame:
    e = T.table(s, d, "events")
    who, day = F.concat(F.lit("User"), F.col("user_id").cast("string")), F.date_format("ts", "yyyy-MM-dd")
    raw = F.struct(
        F.array(F.struct(who.alias("name"), F.lit("subject").alias("role"), F.array("event_type").alias("mentions"), F.lit("person").alias("type"))).alias("entities"),
        F.struct(F.array(F.lit("yesterday")).alias("markers"), F.when(F.col("event_id") % 2 == 0, "early").otherwise("late").alias("sequence"), F.lit("before lunch").alias("relative_time"), F.array(day).alias("absolute_dates")).alias("temporal"),
        F.struct(F.array(F.struct(F.col("event_type").alias("cause"), F.lit("a note").alias("effect"), F.lit(0.5).alias("confidence"))).alias("relationships"), F.lit(0.25).alias("density"), F.when(F.col("event_type") == "error", F.array(F.lit("because"))).otherwise(F.array().cast("array<string>")).alias("explicit_markers"), (F.col("event_id") % 3 == 0).alias("has_implicit_causation")).alias("causal"),
        F.array("event_type").alias("topics"), F.lit(0.5).alias("importance"),
    )
    return e.select(F.col("event_id").alias("id"), F.to_json(raw).alias("raw"))


_RANKED = f"select query_id, id, round(score, 6) as score from (select *, row_number() over (partition by query_id order by score desc, id) as r from x where score > 0) where r <= {K}"


@query(T.sql("questions") + f""", q as (select query_id, lower(query_text) as t from questions), x as (select query_id, event_id as id, round(least(case when contains(t, 'yesterday') then .8 else 0 end + case when contains(t, strftime(ts, '%Y-%m-%d')) then .9 else 0 end
+ case when regexp_matches(t, 'first|initial|begin') and event_id % 2 = 0 then .7 else 0 end + case when regexp_matches(t, 'last|final|end') and event_id % 2 = 1 then .7 else 0 end + case when contains(t, 'before') then .6 else 0 end, 1.0)::double, 9) as score from q cross join events) {_RANKED}""")
def slm_temporal(s, d):
    return scored(search.slm_search(T.questions(s, d), described(s, d), detected(s, d), K, "temporal"))


@query(T.sql("questions") + f""", q as (select query_id, lower(query_text) as t from questions), x as (select query_id, event_id as id, round(least(.125 + case when event_type = 'error' then .2 else 0 end + case when event_id % 3 = 0 then .3 else 0 end + .5 * (case when contains(t, event_type) then .3 else 0 end + case when contains(t, 'a note') then .3 else 0 end), 1.0)::double, 9) as score from q cross join events) {_RANKED}""")
def slm_causal(s, d):
    return scored(search.slm_search(T.questions(s, d), described(s, d), detected(s, d), K, "causal"))


@query(T.sql("facts", "questions") + f""", {_DETECTED}, names2 as (select query_id, list(entity) as names from detected group by 1), x as (select query_id, event_id as id, round(list_sum(list_transform(names, lambda n: case when n = 'user' || user_id then 1.0::double else case when n = event_type then 0.9::double else 0.0::double end + case when contains('user' || user_id, n) or contains(n, 'user' || user_id) then 0.5::double else 0.0::double end end)) / len(names), 9) as score from names2 cross join events) {_RANKED}""")
def slm_entity(s, d):
    return scored(search.slm_search(T.questions(s, d), described(s, d), detected(s, d), K, "entity"))


@query(f"with x as (select event_id as id, event_type, json({_SAID}) as j from events) select id, json_extract_string(j, '$.entities[0].name') as name, json_extract_string(j, '$.temporal.sequence') as sequence, json_extract_string(j, '$.temporal.absolute_dates[0]') as day, (event_type = 'error')::int as markers, json_extract_string(j, '$.topics[0]') as topic, 0.5::double as importance from x")
def parse_description(s, d):
    x = described(s, d).select("id", parse.parsed_slm(F.col("raw")).alias("x"))
    return x.select("id", F.col("x.entities")[0]["name"].alias("name"), "x.temporal.sequence", F.col("x.temporal.absolute_dates")[0].alias("day"), F.size("x.causal.explicit_markers").alias("markers"), F.col("x.topics")[0].alias("topic"), "x.importance")


@query("select event_id as id, case when event_type in ('click') then 'temporal' when event_type = 'view' then 'causal' else 'factual' end as intent, case when event_id % 2 = 0 then 0.75::double else 0.5::double end as confidence from events")
def parse_intent(s, d):
    said = F.when(F.col("event_type") == "click", "Temporal").when(F.col("event_type") == "view", "causal").otherwise("other thing")
    raw = F.concat(F.lit('{"intent": "'), said, F.lit('"'), F.when(F.col("event_id") % 2 == 0, ', "confidence": 0.75').otherwise(""), F.lit("}"))
    return T.table(s, d, "events").select(F.col("event_id").alias("id"), parse.slm_intent(raw).alias("i")).select("id", "i.intent", "i.confidence")


@query("select event_id as id, 'User' || user_id as subject, 'fond of' as predicate, event_type as object, 'r' as form from events union all select event_id, 'User' || user_id, 'sent', event_type, 'n' from events")
def parse_triples(s, d):
    e = T.table(s, d, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("User"), F.col("user_id").cast("string")).alias("u"), "event_type")
    line = F.concat(F.lit("noise\n PERSON: "), "u", F.lit(" > SENT_OF > OBJECT: "), "event_type", F.lit(" \nFOO: a > b > PERSON: c"))
    ref = F.concat(F.lit("[1], PERSON: "), "u", F.lit("\n[2], OBJECT: "), "event_type", F.lit("\n[1] FOND_OF_OF [2]\n[1] LOST [9]"))
    a = e.select("id", F.explode(parse.triples(line)).alias("t"), F.lit("n").alias("form"))
    b = e.select("id", F.explode(parse.referenced_triples(ref)).alias("t"), F.lit("r").alias("form"))
    return a.unionByName(b).select("id", "t.subject", "t.predicate", "t.object", "form")


@query("""select event_id as id, case when event_id % 4 = 3 then null else '{"k": ' || user_id || '}' end as object from events""")
def repair_output(s, d):
    e = T.table(s, d, "events")
    u, kind = F.col("user_id").cast("string"), F.col("event_id") % 4
    raw = F.when(kind == 0, F.concat(F.lit("<think>{no}</think> So: {\"k\": "), u, F.lit("} and more"))).when(kind == 1, F.concat(F.lit('{{"k": '), u, F.lit("}}"))).when(kind == 2, F.concat(F.lit('here {"k": d-'), u, F.lit("}"))).otherwise(F.concat(F.lit("{nothing "), u))
    return e.select(F.col("event_id").alias("id"), parse.repaired(raw).alias("object"))


# Extraction


def _extracted(e: DataFrame) -> DataFrame:
    """(id, speaker, extraction): what a model might say of an event."""
    who = F.concat(F.lit("User"), F.col("user_id").cast("string"))
    name = F.when(F.col("event_id") % 3 == 0, F.lit("I")).when(F.col("event_id") % 3 == 1, who).otherwise(F.lit("the Speaker"))
    x = F.struct(
        F.array(F.struct(F.when(F.col("event_id") % 2 == 0, "Shop").otherwise("Mine").alias("name"), F.lit("organization").alias("type")), F.struct(F.lit("Shop").alias("name"), F.lit("organization").alias("type"))).alias("entities"),
        F.array(F.struct(name.alias("entity"), F.lit("hobby").alias("fact_type"), F.concat("event_type", F.lit(" it")).alias("value"), F.lit(0.7).alias("confidence")), F.struct(F.lit("SHOP").alias("entity"), F.lit("event").alias("fact_type"), F.lit("sells things").alias("value"), F.lit(None).cast("double").alias("confidence"))).alias("entity_facts"),
    )
    return e.select(F.col("event_id").alias("id"), who.alias("speaker"), F.to_json(x).alias("extraction"))


def _attributed(s, d) -> DataFrame:
    x = _extracted(T.table(s, d, "events"))
    return x.select("id", "speaker", extraction.attributed(F.from_json("extraction", extraction.EXTRACTED), F.col("speaker")).alias("x"))


@query("select event_id as id, 'User' || user_id as entity, 'person' as kind, case when event_id % 2 = 0 then 'Shop' else 'Mine' end as other from events")
def speaker_attribution(s, d):
    x = _attributed(s, d)
    return x.select("id", F.col("x.entity_facts")[0]["entity"].alias("entity"), F.col("x.entities")[2]["type"].alias("kind"), F.col("x.entities")[0]["name"].alias("other"))


@query("select event_id as id, case when event_id % 2 = 0 then 'Shop' else 'Mine|Shop' end || '|User' || user_id as names, 1 as about_shop from events")
def extraction_names(s, d):
    return _attributed(s, d).select("id", joined(extraction.entity_names(F.col("x"))).alias("names"), F.size(extraction.facts_for(F.col("x"), F.lit("shop"))).alias("about_shop"))


@query("select doc_id as id, left(text, list_max(list_filter(range(0, 31), lambda k: strlen(left(text, k::int)) <= 30))::int) as head from documents")
def truncate_bytes(s, d):
    return T.table(s, d, "documents").select(F.col("doc_id").alias("id"), extraction.truncated(F.col("text"), 30).alias("head"))


_ALIAS = """n as (select distinct entity from facts), al as (select a.entity, min(case when length(b.entity) > length(a.entity) and starts_with(b.entity, a.entity) and regexp_matches(substr(b.entity, length(a.entity) + 1, 1), '[A-Za-z0-9]') then b.entity end) as s,
  min(case when length(a.entity) between 4 and 5 and length(b.entity) > length(a.entity) and starts_with(b.entity, left(a.entity, length(a.entity) - 1)) and regexp_matches(substr(b.entity, length(a.entity), 1), '[A-Za-z0-9]') then b.entity end) as f from n a cross join n b group by 1),
who as (select entity, coalesce(s, f, entity) as full_name from al)"""


@query(T.sql("facts") + f", {_ALIAS}" + """, ev as (select event_id, event_type, full_name as u from events join who on entity = 'user' || user_id), sure as (select case when event_id % 3 = 1 then u else 'the speaker' end as entity, 'person' as entity_type, 'hobby' as fact_type, event_type || ' it' as value, 0.7::double as confidence, event_id as source_memory from ev where event_id % 3 > 0),
shop as (select 'shop' as entity, 'organization' as entity_type, 'event' as fact_type, 'sells things' as value, 0.8::double as confidence, event_id as source_memory from ev), x as (select * from facts union all select * from sure union all select * from shop),
y as (select * from x where strlen(value) between 3 and 100)
select entity, fact_type, lower(value) as value, round(max(confidence), 6) as confidence, min(source_memory) as source_memory from y group by entity, fact_type, lower(value)""")
def repair_profiles(s, d):
    out = extraction.repaired_profiles(_extracted(T.table(s, d, "events")), T.facts(s, d))[0]
    return out.select("entity", "fact_type", F.lower(F.trim("value")).alias("value"), r6("confidence").alias("confidence"), "source_memory")


@query(T.sql("facts") + f", {_ALIAS} select 'shop' as entity, event_id as memory_id from events union select full_name, event_id from events join who on entity = 'user' || user_id union select 'the speaker', event_id from events where event_id % 3 = 2")
def repair_profile_links(s, d):
    return extraction.repaired_profiles(_extracted(T.table(s, d, "events")), T.facts(s, d))[1]


@query(T.sql("notes") + " select id, regexp_replace('I saw ' || event_type, '\\bI\\b', speaker, 'g') as text from notes where event_type <> 'view'")
def speaker_embedding_texts(s, d):
    said = F.when(F.col("event_type") == "view", F.col("content")).otherwise(F.concat(F.lit("I saw "), "event_type"))
    return extraction.speaker_texts(T.notes(s, d).withColumn("content", said))


@query(T.sql("notes") + " select id from notes where strlen(content) >= 40 and event_type <> 'error'")
def pending_extraction(s, d):
    m = T.notes(s, d)
    return extraction.pending(m, m.where("event_type = 'error'"), 40).select("id")


@query("select 'user' || user_id as entity, 'fond_of' as fact_type, event_type as value, count(*) as n from events group by all")
def triple_facts(s, d):
    t = T.table(s, d, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("User"), F.col("user_id").cast("string")).alias("subject"), F.lit("fond of").alias("predicate"), F.col("event_type").alias("object"))
    return extraction.triple_facts(t).groupBy("entity", "fact_type", "value").agg(F.count("*").alias("n"))


# Profiles, measures, streams, days


@query(_FACT_SEARCH + ", z as (select query_id, entity, fact_type, value, max(s) as s from y where s > 0 group by all), r as (select *, row_number() over (partition by query_id order by s desc, entity, fact_type, value) as rank from z), m as (select * from r where rank <= 5), sm as (select entity, entity_type, string_agg(replace(fact_type, '_', ' ') || ': ' || value, '; ' order by confidence desc, fact_type, value) as s from facts group by all) select distinct query_id, 'Profile of ' || entity || ' (' || entity_type || '): ' || sm.s as line from m join sm using (entity)")
def profile_context(s, d):
    best = search.fact_search(T.facts(s, d), detected(s, d), T.questions(s, d), K, stem=False)[1]
    return profile.context(best, profile.summaries(T.facts(s, d)))


@query(T.sql("facts") + " select distinct left(sha256(lower(entity) || chr(0) || fact_type || chr(0) || lower(value)), 32) as fact_key, replace(fact_type, '_', ' ') || ' ' || value as t from facts where fact_type <> 'hobby'")
def missing_fact_embeddings(s, d):
    f = T.facts(s, d)
    known = f.where("fact_type = 'hobby'").select(tx.fact_key(F.col("entity"), F.col("fact_type"), F.col("value")).alias("fact_key"))
    return profile.missing_embeddings(f, known, lambda t: t).withColumnRenamed("embedding", "t")


@query(T.sql("facts") + """, n as (select distinct entity from facts), al as (select a.entity, min(case when length(b.entity) > length(a.entity) and starts_with(b.entity, a.entity) and regexp_matches(substr(b.entity, length(a.entity) + 1, 1), '[A-Za-z0-9]') then b.entity end) as s,
  min(case when length(a.entity) between 4 and 5 and length(b.entity) > length(a.entity) and starts_with(b.entity, left(a.entity, length(a.entity) - 1)) and regexp_matches(substr(b.entity, length(a.entity), 1), '[A-Za-z0-9]') then b.entity end) as f from n a cross join n b group by 1),
sh as (select entity, coalesce(s, f) as c from al where coalesce(s, f) is not null), ch as (select sh.entity, coalesce(nx.c, sh.c) as c from sh left join sh nx on nx.entity = sh.c),
x as (select coalesce(ch.c, facts.entity) as entity, entity_type, fact_type, value, confidence, source_memory from facts left join ch using (entity)),
y as (select * from x where strlen(value) between 3 and 100), sure as (select distinct entity, lower(value) as v from y where fact_type = 'hobby'),
z as (select entity, fact_type, lower(value) as v, min_by(entity_type, source_memory) as entity_type, least(max(confidence), 1.0) as confidence, min(source_memory) as source_memory from y where fact_type = 'hobby' or not exists (select 1 from sure where sure.entity = y.entity and v = lower(value)) group by all),
k as (select *, count(*) over (partition by entity) as n from z) select entity, fact_type, v as value, round(confidence, 6) as confidence, source_memory from k where entity_type = 'person' or n > 2""")
def consolidate_profiles(s, d):
    return profile.consolidate(T.facts(s, d)).select("entity", "fact_type", F.lower("value").alias("value"), r6("confidence").alias("confidence"), "source_memory")


@query(T.sql("notes") + """, w as (select id, regexp_split_to_array(lower(regexp_replace(content, '[^A-Za-z0-9 ]', ' ', 'g')), ' +') as a, regexp_split_to_array(lower(speaker || ' had ' || event_type || ' had'), ' +') as b from notes),
x as (select id, list_filter(a, lambda v: v <> '') as a, list_filter(b, lambda v: v <> '') as b from w),
y as (select *, list_sum(list_transform(list_distinct(a), lambda v: least(len(list_filter(a, lambda p: p = v)), len(list_filter(b, lambda p: p = v))))) as hit from x)
select id, round(case when len(a) >= len(b) then 1.0 else exp(1 - len(b) / len(a)::double) end * hit / len(a), 6) as bleu from y""")
def answer_bleu(s, d):
    return T.notes(s, d).select("id", r6(metrics.bleu1(F.col("content"), F.concat(F.col("speaker"), F.lit(" had "), F.col("event_type"), F.lit(" had")))).alias("bleu"))


@query("select event_id as query_id, case when event_type = 'click' then 'correct' when event_id % 3 = 0 then 'no evidence' when event_id % 3 = 1 then 'partial evidence' else 'reasoning' end as kind from events")
def answer_failures(s, d):
    e = T.table(s, d, "events")
    r = e.select(F.col("event_id").alias("query_id"), (F.col("event_id") % 3 / 2.0).alias("recall"))
    return metrics.failure_kinds(r, e.select(F.col("event_id").alias("query_id"), (F.col("event_type") == "click").alias("correct")))


@query("select event_id as id, ts::timestamp + interval 3 day as later, ts::timestamp - interval 400 day as earlier, date_trunc('day', ts)::timestamp + interval 1 day - interval 1 microsecond as day_end from events")
def day_shifts(s, d):
    t = F.col("ts").cast("timestamp_ntz")
    return T.table(s, d, "events").select(F.col("event_id").alias("id"), tx.shifted(t, 3).alias("later"), tx.shifted(t, -400).alias("earlier"), tx.day_end(t).alias("day_end"))


@query(f"with x as (select doc_id as id, {terms('text')} as a, {terms('lang || chr(32) || text[1:200]')} as b from documents) select id, round(case when len(a) > 0 and len(b) > 0 then len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::double else 0 end, 6) as j from x")
def word_jaccard(s, d):
    x = T.table(s, d, "documents")
    return x.select(F.col("doc_id").alias("id"), r6(tx.jaccard(tx.terms(F.col("text")), tx.terms(F.concat("lang", F.lit(" "), F.substring("text", 1, 200))))).alias("j"))


@query("select user_id, max(event_id) as event_id from (select *, row_number() over (partition by user_id order by case when event_type = 'error' then 1 else 0 end desc, ts desc, event_id desc) as n from events) where n = 1 group by 1")
def upsert_log(s, d):
    """The present state of a log to which a first batch brought all events and a second the errors."""
    e = T.table(s, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), "user_id", "event_type")
    log = e.withColumn("version", F.lit(0)).unionByName(e.where("event_type = 'error'").withColumn("version", F.lit(1)))
    return ingest.latest(log, "user_id").select("user_id", F.col("id").alias("event_id"))


@query(T.sql("notes") + " select namespace, count(*) as n, max(id) as last from (select id, case when event_type = 'error' then 'bad' else 'good' end as namespace from notes) where namespace = 'bad' group by 1")
def scoped_view(s, d):
    from ..engine import Memory

    m = Memory(s)
    m.memories = T.notes(s, d).select("id", F.when(F.col("event_type") == "error", "bad").otherwise("good").alias("namespace"))
    return m.scope("bad").view().groupBy("namespace").agg(F.count("*").alias("n"), F.max("id").alias("last"))


@query(T.sql("notes") + " select id, row_number() over (order by created_at desc, id desc)::integer as rank from notes where created_at >= timestamp '2024-01-05 00:00:00'")
def range_positions(s, d):
    from ..operators import store

    return store.in_range(T.notes(s, d), F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2030-01-01").cast("timestamp_ntz")).select("id", "rank")

