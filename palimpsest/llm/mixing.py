"""Mixing sources to target weights by hash thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import only_few, written

LEVELS, STEP = 5, 12  # 60 bits of hash, 12 at a time
BUDGETS = (25, 50, 100)  # hundredths of all tokens, for the nested sets


def hashed(ident: Column) -> Column:
    """60 bits of MD5: the same number in any engine."""
    return F.conv(F.substring(F.md5(F.coalesce(ident.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def tokens(text: Column) -> Column:
    """Words by ASCII white space."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t\\n\\r\\f\\x0B]+"), lambda w: w != "")).cast("long")


def thresholds(marked: DataFrame, budgets: tuple[int, ...], weights: dict[str, float] | None) -> DataFrame:
    """(source, tier, cut): documents of the source with a hash under ``cut`` fit the tier's budget.

    ``marked`` has source, h and n. A histogram of tokens by source and leading hash bits finds
    the bucket in which the budget ends; only that bucket's documents are counted again, by their next bits,
    until the bits are used up. A null cut: all of the source fits.
    """
    spark = marked.sparkSession
    shift = STEP * (LEVELS - 1)
    hist = written(marked.groupBy("source", F.shiftright("h", shift).alias("b")).agg(F.sum("n").alias("n")))
    total = hist.groupBy("source").agg(F.sum("n").alias("n"))
    if weights is None:  # the square root of its size: between even shares and shares as they are
        weighed = total.withColumn("w", F.floor(F.sqrt(F.col("n").cast("double"))).cast("double"))
    else:
        table = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, w double")
        weighed = total.join(F.broadcast(table), "source", "left").fillna(0.0, ["w"])
    sums = weighed.agg(F.sum("n").alias("all"), F.sum("w").alias("ws"))
    tier = F.explode(F.array(*(F.struct(F.lit(b).alias("tier"), F.floor(F.lit(b) * F.col("all").cast("double") / 100 * (F.col("w") / F.col("ws"))).cast("long").alias("left")) for b in budgets)))
    state = weighed.where("w > 0").crossJoin(F.broadcast(sums)).select("source", tier.alias("t")).select("source", "t.tier", "t.left")
    none = weighed.where("w <= 0").select("source", F.explode(F.array(*(F.lit(b) for b in budgets))).alias("tier"), F.lit(0).cast("long").alias("cut"))
    by = Window.partitionBy("source", "tier").orderBy("b")
    whole = Window.partitionBy("source", "tier")

    def boundary(counts: DataFrame) -> DataFrame:
        run = counts.withColumn("up_to", F.sum("n").over(by))
        over = run.where("up_to > left").withColumn("first", F.min("b").over(whole)).where("b = first")
        return over.select("source", "tier", "b", (F.col("left") - (F.col("up_to") - F.col("n"))).alias("left"))

    every = state.select("source", "tier")
    state = written(boundary(state.join(hist, "source")))
    for level in range(1, LEVELS):
        down = STEP * (LEVELS - 1 - level)
        inside = marked.join(only_few(state.select("source", "tier", F.col("b").alias("prefix"), "left")), ["source"]).where(F.shiftright("h", down + STEP) == F.col("prefix"))
        finer = inside.groupBy("source", "tier", "left", F.shiftright("h", down).alias("b")).agg(F.sum("n").alias("n"))
        state = written(boundary(finer))
    return every.join(state.select("source", "tier", F.col("b").alias("cut")), ["source", "tier"], "left").unionByName(none)


def mixed(docs: DataFrame, budgets: tuple[int, ...] = BUDGETS, weights: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, tier): the documents chosen, with the least budget that holds them.

    A budget is so many hundredths of all tokens, parted among the sources by weight (their
    square-rooted sizes if none are given; sources not named get nothing). A source gives its documents
    in the order of a hash of doc_id until the next would exceed its part, all of them if they
    fit. A smaller budget's documents are in each larger one. Documents aren't sorted.

    Documents with the same hash, so all rows of one doc_id, come or stay out together. A null doc_id counts as
    the empty text, a null source as the empty source, null and empty texts have no tokens.
    Other columns are ignored. No rows in: no rows out.
    """
    tier = [F.lit(b) for b in budgets]
    slim = docs.select("doc_id", "source", F.coalesce("source", F.lit("")).alias("key"), hashed(F.col("doc_id")).alias("h"), tokens(F.col("text")).alias("n_tokens"))
    slim = written(slim)
    cut = thresholds(slim.select(F.col("key").alias("source"), "h", F.col("n_tokens").alias("n")), budgets, weights)
    wide = written(cut.groupBy("source").agg(*(F.max(F.when(F.col("tier") == b, F.coalesce("cut", F.lit(1 << 60)))).alias(f"c{b}") for b in budgets)))
    chosen = slim.join(only_few(wide.withColumnRenamed("source", "key")), "key")
    least = F.coalesce(*(F.when(F.col("h") < F.col(f"c{b}"), t) for b, t in zip(budgets, tier)))
    return chosen.withColumn("tier", least).where("tier is not null").select("doc_id", "source", "n_tokens", "tier")


def op6_hash_threshold_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, budget: int = 100) -> DataFrame:
    """Pipeline stage: sources that exceed their part of all tokens are cut down to it."""
    marked = written(docs.select(F.coalesce("source", F.lit("")).alias("source"), hashed(F.col("doc_id")).alias("h"), tokens(F.col("text")).alias("n")))
    cut = written(thresholds(marked, (budget,), None).select(F.col("source").alias("__source"), F.coalesce("cut", F.lit(1 << 60)).alias("__cut")))
    return docs.join(only_few(cut), F.coalesce(docs["source"], F.lit("")) == F.col("__source")).where(hashed(docs["doc_id"]) < F.col("__cut")).select(*docs.columns)


ORACLE = """
with d as (
  select doc_id, source, coalesce(source, '') as key, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as h,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> ''))::bigint as n_tokens
  from documents),
w as (select key, floor(sqrt(sum(n_tokens)::double)) as w from d group by key),
t as (select (select sum(n_tokens) from d)::double as total, (select sum(w) from w) as ws),
r as (select d.*, sum(n_tokens) over (partition by key order by h range between unbounded preceding and current row) as up_to from d)
select doc_id, source, n_tokens, min(tier)::integer as tier
from r join w using (key) cross join t cross join (values (25), (50), (100)) as b(tier)
where up_to <= floor(tier * total / 100 * (w / ws))
group by doc_id, source, n_tokens, h"""
