"""Pieces of DuckDB SQL for the queries' counterparts."""

from __future__ import annotations

from ..functions import text as tx


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"


def tok(x: str) -> str:
    bare = f"list_transform({words(f'lower({x})')}, lambda w: regexp_replace(w, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g'))"
    return f"list_filter({bare}, lambda w: strlen(w) between 2 and 50 and not list_contains({_list(tx.KEYWORD_STOPS)}, w))"


def terms(x: str) -> str:
    return f"list_distinct(list_filter({words(f'lower({x})')}, lambda w: strlen(w) > 2 and not list_contains({_list(tx.TERM_STOPS)}, w)))"


def _all(x: str, pattern: str) -> str:
    return f"regexp_extract_all({x}, {_quoted(pattern)})"


def _first_seen(xs: str) -> str:
    return f"list_filter({xs}, lambda x, i: list_position(list_transform({xs}, lambda y: lower(y)), lower(x)) = i)"


def temporal(x: str) -> str:
    exact = f"list_concat(list_concat({_all(x, tx.RELATIVE)}, {_all(x, tx.ABSOLUTE)}), {_all(x, tx.CLOCK)})"
    return f"case when len({exact}) > 0 then {_first_seen(exact)} else {_first_seen(_all(x, tx.VAGUE))} end"


def causal_markers(x: str) -> str:
    return f"list_distinct(list_transform({_all(x, tx.CAUSAL)}, lambda y: lower(y)))"


def causal_density(x: str) -> str:
    inside = f"coalesce(list_sum(list_transform({causal_markers(x)}, lambda y: len(regexp_split_to_array(y, '\\s+')))), 0)"
    return f"case when len({words(x)}) > 0 then {inside}::double / len({words(x)}) else 0.0 end"


def collects(x: str) -> str:
    return f"case when regexp_matches(lower({x}), '^(?:would|could|might|should) |likely|probably') then 'hypothetical' when regexp_matches(lower({x}), '(?:list|show|name|tell me|what are) all|what are the|^in what ways|^how many') then 'aggregation' else 'extraction' end"


def count_of(x: str, patterns) -> str:
    return "(" + " + ".join(f"regexp_matches({x}, {_quoted(p)})::int" for p in patterns) + ")"


def intent_of(table: str, x: str = "query_text") -> str:
    """CTEs up to ``intents``."""
    caught = ", ".join(f"nullif(regexp_extract({x}, {_quoted(p)}, {g}), '')" for p, g in tx.LIST_SIGNS)
    return f"""signs as (select query_id, least({count_of(x, tx.TEMPORAL_SIGNS)} * 0.4::double, 1.0) as t, least({count_of(x, tx.CAUSAL_SIGNS)} * 0.5::double, 1.0) as c,
least(least({count_of(x, tx.ENTITY_SIGNS)} * 0.2::double, 0.8) + {count_of(x, [p for p, _ in tx.LIST_SIGNS])} * 0.6::double, 1.0) as e, coalesce({caught}) as caught from {table}),
named as (select *, greatest(t, c, e, 0.3) as confidence, case when t = confidence then 'temporal' when c = confidence then 'causal' when e = confidence then 'entity' else 'factual' end as intent from signs),
intents as (select query_id, intent, confidence, case when intent = 'entity' and length(caught) > 1 then upper(left(caught, 1)) || substr(caught, 2) end as entity_focus from named)"""


VECTOR = """pairs as (select query_id, memories.id, round(greatest(0, least(1, list_cosine_similarity(query_embedding, embedding))), 9) as score from queries cross join memories where embedding is not null),
sem as (select *, row_number() over (partition by query_id order by score desc, id) as rank from pairs)"""

BM25 = f"""toks as (select id, {tok('content')} as t from memories), flat as (select id, len(t) as l, unnest(t) as term from toks),
post as (select id, l, term, count(*) as tf from flat group by all), st as (select count(*) as n, avg(len(t)) as avgdl from toks), dfs as (select term, count(*) as df from post group by 1),
qw as (select query_id, term, count(*) as times from (select query_id, unnest({tok('query_text')}) as term from queries) group by all),
bs as (select query_id, id, round(sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / avgdl))), 9) as score from qw join post using (term) join dfs using (term) cross join st group by all),
bm as (select *, row_number() over (partition by query_id order by score desc, id) as rank from bs)"""

SCORES = (
    VECTOR + ", " + BM25
    + """, ages as (select id, ({now} - us) / 86400e6 as age, 1 - (row_number() over (order by us desc, id) - 1) / count(*) over ()::double as signal from memories),
young as (select id, 0.3 * (0.05 + 0.95 * (0.96 * pow(0.5, greatest(age, 0.0) / 365) + 0.04 * signal)) as score from ages order by score desc, id limit 50),
scores as (select query_id, id, 'semantic' as dim, score from sem where rank <= 50 union all select query_id, id, 'bm25', score / max(score) over (partition by query_id) from bm where rank <= 50
  union all select query_id, young.id, 'temporal', score from queries cross join young)"""
)

_WIDE = "coalesce(max(case when dim = 'semantic' then score end), 0) as semantic, coalesce(max(case when dim = 'bm25' then score end), 0) as bm25, coalesce(max(case when dim = 'temporal' then score end), 0) as temporal"
FUSED = f"wide as (select query_id, id, {_WIDE} from scores group by all)"
RANKED = f"""places as (select *, 1.0::double / (60 + row_number() over (partition by query_id, dim order by score desc, id)) as r from scores),
rrf as (select query_id, id, {_WIDE}, sum(r) as fused_score from places group by all having semantic >= 0.15 or bm25 >= 0.3)"""
