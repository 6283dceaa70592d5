"""Quality rules whose thresholds come from quantile sketches of the corpus itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import free, only_few, written

BITS = 6  # a sketch keeps the leading BITS+1 binary digits: values within 1/64
PRIOR = 50  # documents' worth of its language that each source's sketch is mixed with, and of all that each language's is
FIXED = 1024  # counts are multiplied by it before they are mixed, and stay whole numbers
DOUBT = 6.0  # natural logarithm of the odds against a document's passing the fence by chance
# feature: (side, how many spreads beyond the quartile, of what it is a share or mean)
RULES = {
    "symbol_share": ("high", 8, "n_signs"),
    "upper_share": ("high", 8, "n_signs"),
    "repeat_share": ("high", 8, "n_words"),
    "bare_share": ("high", 8, "n_words"),
    "distinct_share": ("low", 3, "n_words"),
    "word_length": ("high", 8, "n_words"),
}
SPACE = "[ \\t\\n\\r\\f\\x0B]+"
GROUP = ["lang", "source"]


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def with_features(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a struct of n_words, n_signs and the features of RULES.

    Whole numbers, so that any two engines agree: shares in thousandths, word length in hundredths.
    """
    (raw,) = free(docs.withColumn(name, F.lit(0)), "raw")
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    x = docs.withColumn(raw, F.struct(
        words.alias("w"), F.length(F.regexp_replace(text, "\\s", "")).alias("chars"),
        F.length(F.regexp_replace(text, "[\\p{L}\\p{N}\\s]", "")).alias("symbols"), F.length(F.regexp_replace(text, "[^\\p{Lu}]", "")).alias("upper"),
    ))
    w, chars = F.col(f"{raw}.w"), F.greatest(F.col(f"{raw}.chars"), F.lit(1))
    n = F.size(w)
    again = F.size(F.filter(F.zip_with(w, F.slice(w, F.lit(2), F.greatest(n, F.lit(1))), lambda a, b: a == b), lambda e: e))
    bare = F.size(F.filter(w, lambda w: (F.length(w) <= 3) & ~F.rlike(w, F.lit("[\\p{L}\\p{N}]"))))  # a few symbols alone

    def per(a: Column, b: Column, k: int) -> Column:
        return _div(a.cast("long") * k, F.greatest(b.cast("long"), F.lit(1)))

    f = F.struct(
        n.cast("long").alias("n_words"), F.col(f"{raw}.chars").cast("long").alias("n_signs"),
        per(F.col(f"{raw}.symbols"), chars, 1000).alias("symbol_share"), per(F.col(f"{raw}.upper"), chars, 1000).alias("upper_share"),
        per(again, n, 1000).alias("repeat_share"), per(bare, n, 1000).alias("bare_share"),
        per(F.size(F.array_distinct(w)), n, 1000).alias("distinct_share"), per(F.col(f"{raw}.chars"), n, 100).alias("word_length"),
    )
    return x.withColumn(name, f).drop(raw)


def bucket(x: Column) -> Column:
    """The sketch's bucket of a value: its leading binary digits, the rest zero."""
    shift = F.greatest(F.length(F.bin(x)) - (BITS + 1), F.lit(0))
    power = F.pow(F.lit(2.0), shift).cast("long")
    return _div(x, power) * power


def sketches(f: DataFrame) -> DataFrame:
    """(lang, source, feature, value, n) of (lang, source, f): for each group a histogram over logarithmic buckets.

    Of all documents with a word, however short. Sketches merge by adding n, with the same result in any order; a quantile read from
    one is within 1/2**BITS of the exact one.
    """
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("feature"), bucket(F.col(f"f.{k}")).alias("value")) for k in RULES)))
    key = [F.coalesce(F.col(k), F.lit("")).alias(k) for k in GROUP]
    return f.where("f.n_words > 0").select(*key, each.alias("e")).groupBy("lang", "source", "e.feature", "e.value").agg(F.count("*").alias("n"))


def _mixed(own: DataFrame, wider: DataFrame, key: list[str], up: list[str]) -> DataFrame:
    """Each group's counts with PRIOR documents' worth of the wider group's: what a group lacks in rows it takes from there, by weight."""
    share = wider.withColumn("share", F.floor(F.lit(float(PRIOR * FIXED)) * (F.col("n").cast("double") / F.sum("n").over(Window.partitionBy(*up, "feature")).cast("double"))).cast("long"))
    every = own.select(*key, "feature").distinct().join(share.select(*up, "feature", "value", "share"), [*up, "feature"])
    return every.join(own, [*key, "feature", "value"], "left").select(*key, "feature", "value", (F.coalesce("n", F.lit(0)) * FIXED + F.col("share")).alias("n"))


def thresholds(f: DataFrame) -> DataFrame:
    """(lang, source, and a fence for each rule); written, a row for each group.

    The fence is so many spreads beyond the quartile of the group's mixed sketch. The spread is the distance of the
    quartiles; where they coincide half that of the outer tenths, where these do, too, the mean.
    """
    own = written(sketches(f))
    wide = own.groupBy("feature", "value").agg(F.sum("n").alias("n"))
    lang = _mixed(own.groupBy("lang", "feature", "value").agg(F.sum("n").alias("n")), wide, ["lang"], [])
    group = _mixed(own, written(lang), GROUP, ["lang"])
    w = Window.partitionBy(*GROUP, "feature")
    run = group.withColumn("up_to", F.sum("n").over(w.orderBy("value"))).withColumn("total", F.sum("n").over(w))
    at = {name: F.min(F.when(F.col("up_to") * b >= F.col("total") * a, F.col("value"))).alias(name) for name, a, b in (("q10", 1, 10), ("q25", 1, 4), ("q75", 3, 4), ("q90", 9, 10))}
    mean = F.floor(F.sum(F.col("value").cast("double") * F.col("n").cast("double")) / F.sum("n").cast("double")).cast("long")
    q = run.groupBy(*GROUP, "feature").agg(*at.values(), mean.alias("mean"))
    spread = F.when(F.col("q75") > F.col("q25"), F.col("q75") - F.col("q25")).when(_div(F.col("q90") - F.col("q10"), F.lit(2)) > 0, _div(F.col("q90") - F.col("q10"), F.lit(2))).otherwise(F.col("mean"))
    fence = reduce(lambda a, k: a.when(F.col("feature") == k, F.col("q75") + RULES[k][1] * spread if RULES[k][0] == "high" else F.col("q25") - RULES[k][1] * spread), RULES, F)
    return written(q.withColumn("fence", fence).groupBy(*GROUP).agg(*(F.max(F.when(F.col("feature") == k, F.col("fence"))).alias(k) for k in RULES)))


def allowance(feature: str, fence: Column, n: Column) -> Column:
    """How far a text of n units can be beyond the fence by chance (Bernstein's bound): the shorter, the farther.

    A share has a binomial's variance, a mean word length is taken to have a Poisson's.
    """
    n = F.greatest(n, F.lit(1)).cast("double")
    if feature == "word_length":
        return F.sqrt(F.lit(200 * DOUBT) * F.greatest(fence, F.lit(0)).cast("double") / n) + F.lit(200 * DOUBT / 3) / n
    p = F.least(F.greatest(fence, F.lit(0)), F.lit(1000)).cast("double") / 1000.0
    return F.lit(1000.0) * (F.sqrt(F.lit(2 * DOUBT) * p * (F.lit(1.0) - p) / n) + F.lit(2 * DOUBT / 3) / n)


def judged(featured: DataFrame, f: str, keep: str) -> DataFrame:
    """``featured`` (lang, source, the struct ``f``; written) with the column ``keep``."""
    limit = thresholds(featured.select(*GROUP, F.col(f).alias("f")))
    t, kl, ks = free(featured.withColumn(keep, F.lit(0)), "t", "kl", "ks")
    limit = limit.select(F.col("lang").alias(kl), F.col("source").alias(ks), F.struct(*RULES).alias(t))
    key = [F.coalesce(featured["lang"], F.lit("")) == F.col(kl), F.coalesce(featured["source"], F.lit("")) == F.col(ks)]
    good = F.col(f"{f}.n_words") > 0
    for k, (side, _, of) in RULES.items():
        x, fence, n = F.col(f"{f}.{k}").cast("double"), F.col(f"{t}.{k}"), F.col(f"{f}.{of}")
        far = allowance(k, fence, n)
        good = good & F.coalesce(x <= fence + far if side == "high" else x >= fence - far, F.lit(True))
    return featured.join(only_few(limit), key, "left").withColumn(keep, good).drop(t, kl, ks)


def passing(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, n_signs and the features) of the documents that no rule rejects.

    Each rule compares a feature with a fence that follows from the quantiles of the document's language and source:
    see ``thresholds``. Quantiles come from mergeable logarithmic histograms over all documents; a small source's is
    mixed with its language's, by weight, without a size at which that begins. A document is rejected if it lies so far beyond
    the fence that chance can't explain it, which takes the more, the shorter it is; no length is exempt.

    Null and wordless texts are rejected. A null language or source counts as the empty one. Repeated rows are judged, and counted,
    each. Very long texts are judged whole. Other columns are ignored, whatever their names. No rows in: no rows out.
    """
    f = written(with_features(docs.select("doc_id", *GROUP, "text"), "f").drop("text"))
    return judged(f, "f", "keep").where("keep").select("doc_id", *GROUP, "f.*")


def op5_adaptive_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passing(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that ``passing`` rejects go, all others stay as they are, repeated rows too.

    Null and wordless texts go; null ids, languages and sources don't matter. Any other columns stay. No rows in: no rows out.
    """
    f, keep = free(docs, "f", "keep")
    return judged(written(with_features(docs, f)), f, keep).where(keep).select(*docs.columns)


def _sql_fences() -> str:
    """By correlated sums over the bucketed values, feature by feature: another way than the windows of ``thresholds``."""
    return f"""
own as (select kl, ks, feature, value, count(*) as n from bucketed group by all),
everyone as (select feature, value, count(*) as n, floor({float(PRIOR * FIXED)}::double * (count(*)::double / (select count(*) from bucketed b where b.feature = a.feature)::double))::bigint as share from bucketed a group by feature, value),
langs as (select k.kl, e.feature, e.value, {FIXED} * (select count(*) from bucketed b where b.kl = k.kl and b.feature = e.feature and b.value = e.value) + e.share as n from (select distinct kl from bucketed) k cross join everyone e),
lang_share as (select kl, feature, value, floor({float(PRIOR * FIXED)}::double * (n::double / (select sum(n) from langs m where m.kl = l.kl and m.feature = l.feature)::double))::bigint as share from langs l),
mixed as (select g.kl, g.ks, s.feature, s.value, {FIXED} * coalesce(o.n, 0) + s.share as n
  from (select distinct kl, ks from bucketed) g join lang_share s on s.kl = g.kl left join own o on o.kl = g.kl and o.ks = g.ks and o.feature = s.feature and o.value = s.value),
lists as (select kl, ks, feature, list(value order by value) as v, list(n order by value) as n, sum(n)::bigint as total, floor(sum(value::double * n::double) / sum(n)::double)::bigint as mean from mixed group by all),
up as (select *, list_transform(n, lambda x, i: list_sum(n[1:i])::bigint) as c from lists),
q as (select kl, ks, feature, mean, {", ".join(f"list_min(list_filter(v, lambda x, i: c[i] * {b} >= total * {a})) as {name}" for name, a, b in (("q10", 1, 10), ("q25", 1, 4), ("q75", 3, 4), ("q90", 9, 10)))} from up),
spread as (select *, case when q75 <> q25 then q75 - q25 when (q90 - q10) // 2 <> 0 then (q90 - q10) // 2 else mean end as s from q),
fence as (select kl, ks, {", ".join(f"any_value({f'q75 + {times} * s' if side == 'high' else f'q25 - {times} * s'}) filter (feature = '{k}') as {k}_fence" for k, (side, times, _) in RULES.items())} from spread group by all)"""


def _sql_far(k: str, of: str) -> str:
    n, fence = f"greatest({of}, 1)::double", f"{k}_fence"
    if k == "word_length":
        return f"sqrt({200 * DOUBT}::double * greatest({fence}, 0)::double / {n}) + {200 * DOUBT / 3}::double / {n}"
    p = f"(least(greatest({fence}, 0), 1000)::double / 1000.0::double)"
    return f"1000.0::double * (sqrt({2 * DOUBT}::double * {p} * (1.0::double - {p}) / {n}) + {2 * DOUBT / 3}::double / {n})"


_FEATURES_SQL = """
words as (
  select doc_id, lang, source, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> '') as w,
    length(regexp_replace(coalesce(text, ''), '\\s', '', 'g')) as chars,
    length(regexp_replace(coalesce(text, ''), '[\\p{L}\\p{N}\\s]', '', 'g')) as symbols,
    length(regexp_replace(coalesce(text, ''), '[^\\p{Lu}]', '', 'g')) as upper
  from documents),
f as (
  select doc_id, lang, source, coalesce(lang, '') as kl, coalesce(source, '') as ks, len(w)::bigint as n_words, chars::bigint as n_signs,
    1000 * symbols // greatest(chars, 1) as symbol_share,
    1000 * upper // greatest(chars, 1) as upper_share,
    1000 * len(list_filter(list_zip(w, w[2:]), lambda p: p[1] = p[2])) // greatest(len(w), 1) as repeat_share,
    1000 * len(list_filter(w, lambda x: length(x) <= 3 and not regexp_matches(x, '[\\p{L}\\p{N}]'))) // greatest(len(w), 1) as bare_share,
    1000 * len(list_distinct(w)) // greatest(len(w), 1) as distinct_share,
    100 * chars // greatest(len(w), 1) as word_length
  from words),
long as (unpivot (select kl, ks, symbol_share, upper_share, repeat_share, bare_share, distinct_share, word_length from f where n_words > 0)
  on symbol_share, upper_share, repeat_share, bare_share, distinct_share, word_length into name feature value x),
bucketed as (select kl, ks, feature, (x >> greatest(length(bin(x)) - 7, 0)) << greatest(length(bin(x)) - 7, 0) as value from long)"""

_OK = " and ".join(f"{k}::double {'<=' if side == 'high' else '>='} {k}_fence {'+' if side == 'high' else '-'} ({_sql_far(k, of)})" for k, (side, _, of) in RULES.items())
ORACLE = f"""
with {_FEATURES_SQL}, {_sql_fences()}
select f.doc_id, f.lang, f.source, n_words, n_signs, symbol_share, upper_share, repeat_share, bare_share, distinct_share, word_length
from f join fence on f.kl = fence.kl and f.ks = fence.ks
where n_words > 0 and {_OK}"""
