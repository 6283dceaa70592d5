"""Near-duplicate documents: MinHash with tensored banding, candidates verified exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .store import free, only, settle, written
from .words import U, Words, chunks, mix, ranges, texts

SHINGLE, SIDE, HASHES, LEAST = 3, 11, 2, 0.5  # a pair at LEAST itself is found with probability 0.92
PAIRS, ROUNDS = 64, 6  # pairs a member from which on another round is worth its jobs, and rounds at most; they don't change the result


def _shingles(docs: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all documents, and how many each has. Fewer than k words make one shingle."""
    words = Words(docs)
    grams = words.grams(k)
    short = (words.count < k) & (words.count > 0)
    n = np.where(short, 1, np.maximum(words.count - k + 1, 0))
    at = ranges(words.offset[:-1], n)
    out = np.zeros(len(at), U)
    is_short = np.repeat(short, n)
    out[~is_short] = grams[at[~is_short]]
    out[is_short] = words.whole()[short]
    return out, n


def _sketch(k: int, side: int, hashes: int, seed: int):
    m = 2 * side * hashes
    rng = np.random.Generator(np.random.PCG64(seed))
    mul = rng.integers(0, 2**63, m, dtype=np.uint64) * U(2) + U(1)
    add = rng.integers(0, 2**63, m, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, docs in chunks(batches):
            s, n = _shingles(docs, k)
            keep = np.flatnonzero(n)
            starts = np.concatenate([[0], np.cumsum(n[keep])[:-1]]) if len(keep) else keep
            keys = np.zeros((len(docs), side * side), np.int64)
            if len(keep):
                low = np.empty((m, len(keep)), U)
                for i in range(m):
                    low[i] = np.minimum.reduceat(s * mul[i] + add[i], starts)
                sides = []
                for half in (low[: m // 2], low[m // 2 :]):  # the two collections
                    bands = half.reshape(side, hashes, len(keep))
                    x = mix(bands[:, 0] + U(1))
                    for r in range(1, hashes):
                        x = mix(x * U(31) + bands[:, r])
                    sides.append(x)
                for i in range(side):
                    for j in range(side):  # one table for each pair
                        keys[keep, i * side + j] = mix(sides[0][i] * U(0x9E3779B97F4A7C15) + sides[1][j] + U(i * side + j)).view(np.int64)
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            mask = np.zeros(len(docs), bool)
            mask[keep] = True
            flat = pa.array(keys[mask].reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(mask.sum() + 1, dtype=np.int32) * (side * side)), flat)
            whole = batch.column(batch.schema.get_field_index("same"))
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(mask)), whole.filter(pa.array(mask)), lists], ["doc_id", "same", "keys"])

    return run


def _sets(k: int):
    """Sorted distinct shingle hashes, 8 bytes each, as one binary value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, docs in chunks(batches):
            s, n = _shingles(docs, k)
            ends = np.cumsum(n)
            out = [np.unique(s[e - c : e]).tobytes() for e, c in zip(ends, n)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(out, pa.binary())], ["doc_id", "shingles"])

    return run


def _overlap(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, U), np.frombuffer(b, U)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = texts(batch.column(2)), texts(batch.column(3))
            j = np.array([_overlap(x, y) for x, y in zip(a, b)], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(j), pa.array(j >= least)], ["a", "b", "jaccard", "near"])

    return run


def _check(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b, jaccard, near) for the pairs (a, b); written. A document with several texts counts by the most alike."""
    pairs = written(pairs.distinct())
    some = only(sets, written(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()), "doc_id")
    one = some.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    two = some.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    each = pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(_verify(least), "a long, b long, jaccard double, near boolean")
    return written(each.groupBy("a", "b").agg(F.max("jaccard").alias("jaccard"), F.max("near").alias("near")))


def _linked(member: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b, jaccard, near): pairs of each bucket's members (key, a, with the least of them as b) that hold all links in the bucket.

    All are compared with the bucket's least. Jaccard distance obeys the triangle inequality: one at distance D from
    the least and one at distance r can be alike only if r >= D - (1 - LEAST); such pairs are compared. Those unlike the least form the next
    round's bucket, with a least of their own, while the buckets that are left would give many pairs a member; then all
    their pairs are compared.
    """
    known, now, more, last, rounds = None, member, None, False, 0
    while True:
        rounds += 1
        pairs = now.select("a", "b") if more is None else now.select("a", "b").unionByName(more)
        pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        found = _check(pairs if known is None else pairs.join(known, ["a", "b"], "left_anti"), sets, least)
        known = found if known is None else known.unionByName(found)
        if last:
            return known
        scored = written(now.join(known, ["a", "b"]).select("key", "a", "near", (1 - F.col("jaccard")).alias("d")))
        far, like = scored.where("not near"), scored.where("near")
        count = far.groupBy("key").agg(F.count("*").alias("n")).agg(F.sum("n").alias("rows"), F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2).alias("pairs")).first()
        if not count["rows"]:
            return known
        more = far.select("key", "a", F.col("d").alias("far")).join(like.select("key", F.col("a").alias("b"), "d"), "key").where(F.col("d") >= F.col("far") - (1 - least) - 1e-9).select("a", "b")
        last = count["pairs"] <= PAIRS * count["rows"] or rounds >= ROUNDS
        if last:
            now = far.select("key", "a").join(far.select("key", F.col("a").alias("b")), "key").where("a > b")
        else:
            now = far.select("key", "a").join(far.groupBy("key").agg(F.min("a").alias("b")), "key").where("a <> b")
        now = written(now)


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, side: int = SIDE, hashes: int = HASHES, least: float = LEAST, seed: int = 7) -> DataFrame:
    """(doc_id, near_doc_id, jaccard): each document to drop, with the one of its group that stays.

    Tensored banding: two collections of ``side`` bands of ``hashes`` minhashes; each pair of
    bands, one from either collection, keys one of side**2 tables. 2*side*hashes minhashes serve
    tables that would need side**2 * 2*hashes of them if drawn apart. A pair of Jaccard
    similarity J meets with probability (1-(1-J**hashes)**side)**2.

    Within a table's buckets no link is lost and nothing is capped, see ``_linked``. Groups are connected components of the
    verified pairs (Jaccard of word shingles >= least); the least doc_id stays. Identical texts, by 128 bits of hash, count
    as one node and always group. ``jaccard`` is the exact similarity to the document that stays.

    Null or wordless texts never group, rows with a null doc_id are left out; repeated rows count once; a
    doc_id with several texts is one document that is like another if any of its texts is (jaccard 1 where nothing else joins the two); texts shorter than a shingle group only with the same words.
    Very long texts are taken whole. Other columns are ignored. No rows in: no rows out.
    """
    settle(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5("text")).alias("same"), "text").where("doc_id is not null and text is not null")
    sketch = written(slim.mapInArrow(_sketch(shingle, side, hashes, seed), "doc_id long, same binary, keys array<long>"))
    # Identical texts: one of them stands for the class.
    classes = sketch.groupBy("same").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"))
    keyed = classes.select("rep", F.explode("keys").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("rep").alias("b"), F.max("rep").alias("last")).where("b <> last")
    member = written(keyed.join(buckets.select("key", "b"), "key").where("rep <> b").select("key", F.col("rep").alias("a"), "b").distinct())
    wanted = written(member.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    sets = written(only(slim, wanted, "doc_id").mapInArrow(_sets(shingle), "doc_id long, shingles binary").distinct())
    known = written(_linked(member, sets, least))
    members = written(sketch.select("doc_id", "same").join(classes.select("same", "rep"), "same").select("doc_id", "rep").distinct())
    several = members.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("last")).where("b <> last").select("doc_id", "b")
    also = members.join(several, "doc_id").select(F.col("rep").alias("a"), "b").where("a <> b")  # texts of one document belong together
    root = written(components(known.where("near").select("a", "b").unionByName(also)))
    exact = written(root.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).join(known.select("a", "b", "jaccard"), ["a", "b"], "left"))
    other = _check(exact.where("jaccard is null").select("a", "b"), sets, 0.0).select("a", "b", F.col("jaccard").alias("j"))
    score = exact.join(other, ["a", "b"], "left").select(F.col("a").alias("rep"), F.col("b").alias("root"), F.coalesce("jaccard", "j", F.lit(1.0)).alias("jaccard"))
    out = members.join(score, "rep", "left").select("doc_id", F.coalesce("root", "rep").alias("near_doc_id"), F.coalesce("jaccard", F.lit(1.0)).alias("jaccard"))
    return out.where("doc_id <> near_doc_id").groupBy("doc_id").agg(F.min_by(F.struct("near_doc_id", "jaccard"), F.struct("near_doc_id", -F.col("jaccard"))).alias("m")).select("doc_id", "m.*")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each near-duplicate group stays, all others as they are.

    Null ids, null and wordless texts stay. All rows of a doc_id stay or go; rows of one that stays are not thinned. Any other columns stay. No rows in: no rows out.
    """
    (ident,) = free(docs, "id")
    gone = written(near_duplicates(docs).select(F.col("doc_id").alias(ident)))
    return docs.join(gone, docs["doc_id"].cast("long") == gone[ident], "left_anti")
