"""Connected components of an edge table by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the least node of each component, for every node of an edge (a, b).

    Large-star: each node tells its greater neighbours of its least neighbour;
    small-star: likewise the lesser ones. Stars that no longer change are the components.
    Each round shuffles the edges twice and is written, so nothing is kept in executors.
    Edges with a null end and loops are ignored. No edges: no rows.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.collect_list("b").alias("bs"))
        large = least.select(F.explode("bs").alias("b"), "m", "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        star = large.where("a <> b").groupBy("a").agg(F.min("b").alias("m"), F.collect_set("b").alias("bs"))
        small = star.select(F.explode(F.concat("bs", F.array("a"))).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        now = written(small)
        said = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if said == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = said
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
