"""Nearest neighbours: a vantage-point tree for each shard, pruned by a relaxed triangle inequality."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import only_few, settle, written

K = 10
RELAX = 2.0
LEAF = 256
SHARD = 8192  # vectors aimed at in a shard
BLOCK = 32768  # queries aimed at in a task
EVERY = 20  # the query asks for the vectors whose id this divides, against all vectors
PIVOT_BYTES = 64 << 20  # most that the pivots may take when sent to all tasks


class Tree:
    """Vantage points with the ranges of their children's distances; leaves hold runs of ``order``."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = points
        self.order = np.arange(len(points))
        self.square = (points * points).sum(1)
        self.nodes: list[tuple] = []
        todo = [(0, len(points), None, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            me = len(self.nodes)
            if parent is not None:
                self.nodes[parent][4][side] = me
            if b - a <= leaf:
                self.nodes.append(("leaf", a, b))
                continue
            own = self.order[a:b]
            x = points[own]
            far = ((x - x[0]) ** 2).sum(1).argmax()  # a point at the rim parts the rest best
            vantage = x[far]
            d = np.sqrt(((x - vantage) ** 2).sum(1))
            rank = np.argsort(d, kind="stable")
            self.order[a:b] = own[rank]
            d = d[rank]
            mid = (b - a) // 2
            self.nodes.append(("split", vantage, (d[0], d[mid - 1], d[mid], d[-1]), None, [0, 0]))
            todo += [(a, a + mid, me, 0), (a + mid, b, me, 1)]


class Nearest:
    """The k nearest so far of many queries, as flat (query, id, distance), ties by id."""

    def __init__(self, m: int, k: int, bound: np.ndarray):
        self.k = k
        self.d = np.full((m, k), np.inf)
        self.i = np.full((m, k), np.iinfo(np.int64).max)
        self.bound = bound.astype(float).copy()

    def offer(self, rows: np.ndarray, ids: np.ndarray, d: np.ndarray) -> None:
        """Distances of ``rows`` to the points ``ids``, as a matrix."""
        r, c = np.nonzero(d <= self.bound[rows][:, None])
        if not len(r):
            return
        hit = np.unique(r)
        row = np.concatenate([np.repeat(hit, self.k), r])
        dist = np.concatenate([self.d[rows[hit]].ravel(), d[r, c]])
        ident = np.concatenate([self.i[rows[hit]].ravel(), ids[c]])
        order = np.lexsort((ident, dist, row))
        row = row[order]
        first = np.searchsorted(row, hit)
        take = order[(first[:, None] + np.arange(self.k)).ravel()]
        self.d[rows[hit]] = dist[take].reshape(-1, self.k)
        self.i[rows[hit]] = ident[take].reshape(-1, self.k)
        self.bound[rows[hit]] = np.minimum(self.bound[rows[hit]], self.d[rows[hit], -1])


def search(tree: Tree, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, bound: np.ndarray, k: int, relax: float) -> Nearest:
    """All queries go down together; each comes to its nearer child first.

    A child whose distances to the vantage point lie in [a, b] is left out for a query at distance
    d if relax * max(a - d, d - b) exceeds the query's k-th distance. With relax 1 that is the triangle inequality.
    """
    best = Nearest(len(queries), k, bound)
    square = (queries * queries).sum(1)
    todo: list[tuple[int, np.ndarray, np.ndarray]] = [(0, np.arange(len(queries)), np.zeros(len(queries)))]
    while todo:
        at, rows, low = todo.pop()
        keep = low * relax <= best.bound[rows] * (1 + 1e-12)
        rows = rows[keep]
        if not len(rows):
            continue
        node = tree.nodes[at]
        if node[0] == "leaf":
            some = tree.order[node[1] : node[2]]
            for a in range(0, len(rows), 4096):
                r = rows[a : a + 4096]
                d = square[r][:, None] + tree.square[some][None, :] - 2.0 * (queries[r] @ tree.points[some].T)
                d = np.sqrt(np.maximum(d, 0))
                d[own[r][:, None] == ids[some][None, :]] = np.inf
                best.offer(r, ids[some], d)
            continue
        _, vantage, (a0, b0, a1, b1), _, kids = node
        d = np.sqrt(((queries[rows] - vantage) ** 2).sum(1))
        near = d <= (b0 + a1) / 2
        lows = [np.maximum(0, np.maximum(a - d, d - b)) for a, b in ((a0, b0), (a1, b1))]
        for side, these in ((1, near), (0, ~near), (0, near), (1, ~near)):  # the last is taken first
            if these.any():
                todo.append((kids[side], rows[these], lows[side][these]))
    return best


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    return np.asarray(flat.flatten(), np.float64).reshape(n, -1)


OUT = "vec_id long, neighbor_id long, distance double"


def _rows(own: np.ndarray, queries: np.ndarray, ids: np.ndarray, points: np.ndarray, best: Nearest) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r, c = np.nonzero(np.isfinite(best.d))
    got = best.i[r, c]
    order = np.argsort(ids, kind="stable")
    at = order[np.searchsorted(ids, got, sorter=order)]
    return own[r], got, np.sqrt(((queries[r] - points[at]) ** 2).sum(1))


def _away(k: int, relax: float):
    """Nearer neighbours in another shard."""

    def run(members: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["vec_id", "neighbor_id", "distance"]
        if not members.num_rows or not queries.num_rows:
            return pa.Table.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names)
        ids, own = members.column("vec_id").to_numpy(), queries.column("vec_id").to_numpy()
        x, q = _matrix(members.column("x"), members.num_rows), _matrix(queries.column("x"), queries.num_rows)
        best = search(Tree(x), ids, q, own, queries.column("bound").to_numpy(), k, relax)
        return pa.Table.from_arrays([pa.array(c) for c in _rows(own, q, ids, x, best)], names)

    return run


def _assign(pivots: dict[int, np.ndarray]):
    """The nearest pivot of the same dimension, and the distance to it."""

    def run(batches):
        for batch in batches:
            for dim in np.unique(batch.column(2).to_numpy()):
                part = batch.filter(pa.array(batch.column(2).to_numpy() == dim))
                x = _matrix(pa.chunked_array([part.column(1)]), part.num_rows)
                number, p = pivots[int(dim)]
                d = np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * x @ p.T, 0)
                at = d.argmin(1)
                exact = np.sqrt(((x - p[at]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(number[at].astype(np.int32)), pa.array(exact)], ["vec_id", "x", "shard", "reach"])

    return run


def _route(pivots: dict, radius: dict[int, float], relax: float):
    """A query goes to each other shard that can hold something nearer than its k-th neighbour so far."""

    def run(batches):
        for batch in batches:
            bound = batch.column(3).to_numpy()
            home = batch.column(2).to_numpy()
            for number, p in pivots.values():
                mine = np.flatnonzero(np.isin(home, number))
                if not len(mine):
                    continue
                x = _matrix(pa.chunked_array([batch.column(1).take(pa.array(mine))]), len(mine))
                reach = np.array([radius.get(int(s), -np.inf) for s in number])
                for a in range(0, len(mine), 512):
                    y = x[a : a + 512]
                    d = np.sqrt(np.maximum((y * y).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * y @ p.T, 0))
                    low = np.maximum(d - reach[None, :], 0)
                    go = (low * relax <= bound[mine[a : a + 512]][:, None] * (1 + 1e-9)) & np.isfinite(reach)[None, :] & (number[None, :] != home[mine[a : a + 512]][:, None])
                    r, s = np.nonzero(go)
                    at = mine[a + r]
                    pick = pa.array(at)
                    yield pa.RecordBatch.from_arrays([pa.array(number[s].astype(np.int32)), batch.column(0).take(pick), batch.column(1).take(pick), batch.column(3).take(pick)], ["shard", "vec_id", "x", "bound"])

    return run


def _searched(member: DataFrame, routed: DataFrame, k: int, relax: float, block: int) -> DataFrame:
    """(vec_id, neighbor_id, distance) of ``routed`` (shard, part, vec_id, x, bound), a written table, among the members of its shard and part.

    A part's tree is made once for each ``block`` queries that come to it, so copies of members follow the queries, not the square of anything.
    """
    blocks = written(routed.groupBy("shard", "part").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))
    to = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    asked = routed.join(only_few(blocks), ["shard", "part"]).select("shard", "part", to.alias("block"), "vec_id", "x", "bound")
    copies = member.join(only_few(blocks), ["shard", "part"]).select("shard", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "vec_id", "x")
    return copies.groupBy("shard", "part", "block").cogroup(asked.groupBy("shard", "part", "block")).applyInArrow(_away(k, relax), OUT)


def neighbours(vectors: DataFrame, k: int = K, relax: float = RELAX, shard: int = SHARD, block: int = BLOCK, every: int = 1) -> DataFrame:
    """(vec_id, rank, neighbor_id, distance): the k nearest other vectors, by Euclidean distance, of every vector whose id ``every`` divides.

    Vectors go to the shard of their nearest pivot (about one in ``shard`` vectors, those with the
    least hashes). A shard of over twice that size, as many copies of a vector make, is parted by hash, and its queries go to all parts. Each part makes
    a vantage-point tree. A query searches its own shard, then those whose
    ball round the pivot can hold something nearer. All lower bounds are multiplied by ``relax`` before they are compared with
    the k-th distance: 1 is exact, more prunes more. Ties go to the lesser id. All vectors are indexed.

    Null ids, and vectors that are null, empty or hold a null, NaN or infinity, are left out; of several vectors under one id the least, number by
    number, counts; vectors of different lengths aren't compared; very long ones are. Fewer than k others: as many rows as there are. Other columns are ignored.
    No rows in: no rows out. The pivots go to every task and must stay under PIVOT_BYTES; beyond, take larger shards.
    """
    spark = vectors.sparkSession
    settle(spark)
    x = F.col("embedding").cast("array<double>")
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where("vec_id is not null and size(x) > 0 and not exists(x, v -> v is null or isnan(v) or abs(v) = double('infinity'))")
    good = written(good.groupBy("vec_id").agg(F.min("x").alias("x")).withColumn("dim", F.size("x")))
    sizes = {r.dim: r["count"] for r in good.groupBy("dim").count().collect()}
    pivots: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    start = 0
    for dim, n in sorted(sizes.items()):
        m = -(-n // shard)
        if m * dim * 8 > PIVOT_BYTES:
            raise ValueError(f"{m} pivots of {dim} numbers are too many to send to all tasks; take shards of more than {shard} vectors")
        rows = good.where(F.col("dim") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(m).collect()
        pivots[dim] = (np.arange(start, start + m), np.array([r.x for r in rows]))
        start += m
    if not pivots:
        return spark.createDataFrame([], "vec_id long, rank int, neighbor_id long, distance double")
    member = written(good.select("vec_id", "x", "dim").mapInArrow(_assign(pivots), "vec_id long, x array<double>, shard int, reach double"))
    shards = written(member.groupBy("shard").agg(F.max("reach").alias("radius"), F.ceil(F.count("*") / (2 * shard)).cast("int").alias("parts")))
    radius = {r.shard: r.radius for r in shards.collect()}  # a row for each pivot
    few = only_few(shards.select("shard", "parts"))
    member = member.join(few, "shard").select("vec_id", "x", "shard", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"))
    parts = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    query = member.where(F.col("vec_id") % every == 0).select("vec_id", "x", "shard")
    home = written(query.join(few, "shard").select("shard", parts, "vec_id", "x", F.lit(float("inf")).alias("bound")))
    near = written(_searched(member, home, k, relax, block))
    order = Window.partitionBy("vec_id").orderBy("distance", "neighbor_id")
    kth = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("vec_id", F.col("distance").alias("bound"))
    asked = query.join(kth, "vec_id", "left").select("vec_id", "x", "shard", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    routed = asked.mapInArrow(_route(pivots, radius, relax), "shard int, vec_id long, x array<double>, bound double")
    away = _searched(member, written(routed.join(few, "shard").select("shard", parts, "vec_id", "x", "bound")), k, relax, block)
    both = near.unionByName(away).withColumn("rank", F.row_number().over(order))
    return both.where(F.col("rank") <= k).select("vec_id", "rank", "neighbor_id", "distance")


def op4_vp_tree_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=EVERY)


def op4_exact_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by factor one, which is exact and so has SQL."""
    x = neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), relax=1.0, every=EVERY)
    return x.select("vec_id", "rank", "neighbor_id", F.round("distance", 6).alias("distance"))


ORACLE = f"""
with e as (select vec_id, embedding::double[] as x from embeddings),
p as (select a.vec_id, b.vec_id as neighbor_id, list_distance(a.x, b.x) as d from e a join e b on a.vec_id <> b.vec_id where a.vec_id % {EVERY} = 0),
r as (select *, row_number() over (partition by vec_id order by d, neighbor_id) as rank from p)
select vec_id, rank::integer as rank, neighbor_id, round(d, 6) as distance from r where rank <= {K}"""
