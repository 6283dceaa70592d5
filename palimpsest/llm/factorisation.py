"""Quality classifier: a factorisation machine over hashed words, structure and metadata."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import only, settle, written
from .words import U, Words, chunks, mix

BINS = 1 << 16  # of hashed words
META = 1 << 10  # of hashed languages and sources
STATS = 8
SIZE = BINS + META + STATS
RANK = 8
MOST_LABELS = 8000  # labelled documents fitted on, those with the least hashes; the corpus is scored whole
LEAST = 0.5

_KIND = np.zeros(256, np.int64)  # 0 letters, bytes of longer letters and white space, 1 upper, 2 digit, 3 other
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3


@dataclass
class Model:
    bias: float
    weight: np.ndarray  # SIZE
    factor: np.ndarray  # RANK x SIZE


def _meta(values: list, salt: int) -> np.ndarray:
    """A bin for each language or source, by a hash of the whole value; null is one of its own."""
    h = [xxhash.xxh64_intdigest(v.encode(), salt) if v is not None else salt for v in values]
    return (mix(np.array(h, U)) % U(META)).astype(np.int64) + BINS


def sparse(docs: list[bytes], langs: list, sources: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of several squeezed texts, in order of row and feature.

    A text's hashed words count as the roots of their frequencies, scaled to length one; then one each for language
    and source; then the structure statistics, all about one in size.
    """
    w = Words(docs)
    m = len(docs)
    row = np.repeat(np.arange(m), w.count)
    key, n = np.unique(row << 16 | (w.h & U(BINS - 1)).astype(np.int64), return_counts=True)
    r, f = key >> 16, key & (BINS - 1)
    x = np.sqrt(n / np.maximum(w.count[r], 1))
    total = np.array([len(d) for d in docs], np.int64)
    kinds = np.zeros((4, m))
    full = np.flatnonzero(total)
    if len(full):
        raw = _KIND[np.frombuffer(b"".join(docs), np.uint8)]
        at = np.concatenate([[0], np.cumsum(total[full])[:-1]])
        for k in (1, 2, 3):
            kinds[k][full] = np.add.reduceat((raw == k).astype(np.int64), at)
    size, words = np.maximum(total, 1), np.maximum(w.count, 1)
    again = np.bincount(row[1:][(w.h[1:] == w.h[:-1]) & (row[1:] == row[:-1])], minlength=m) if w.n else np.zeros(m)
    distinct = np.bincount(r, minlength=m)
    stats = np.stack([np.log1p(w.count) / 8, total / words / 8, kinds[1] / size * 4, kinds[2] / size * 8, kinds[3] / size * 4, again / words, distinct / words, np.ones(m) * (w.count < 20)])
    every = np.arange(m)
    rows = np.concatenate([r, every, every, np.repeat(every, STATS)])
    feats = np.concatenate([f, _meta(langs, 1), _meta(sources, 2), np.tile(np.arange(STATS) + BINS + META, m)])
    values = np.concatenate([x, np.ones(2 * m) * 0.3, stats.T.reshape(-1)])
    order = np.lexsort((feats, rows))
    return rows[order], feats[order], values[order]


def score(model: Model, row: np.ndarray, feat: np.ndarray, x: np.ndarray, m: int) -> np.ndarray:
    """The machine's output before the logistic function, in time linear in the features present.

    Pairwise interactions by the identity: half of (the square of the sum, less the sum of squares), for each factor.
    """
    out = model.bias + np.bincount(row, model.weight[feat] * x, m)
    for v in model.factor:
        t = v[feat] * x
        s = np.bincount(row, t, m)
        out += 0.5 * (s * s - np.bincount(row, t * t, m))
    return out


def fit(rows: np.ndarray, feat: np.ndarray, x: np.ndarray, label: np.ndarray, epochs: int = 8, rate: float = 0.05, batch: int = 128, seed: int = 5) -> Model:
    """Logistic loss, classes weighted alike, by steps scaled with past gradients."""
    rng = np.random.Generator(np.random.PCG64(seed))
    m = len(label)
    model = Model(0.0, np.zeros(SIZE), rng.normal(0, 0.02, (RANK, SIZE)))
    if not m:
        return model
    begin = np.searchsorted(rows, np.arange(m + 1))
    share = np.clip(label.mean(), 1e-3, 1 - 1e-3)
    weight = np.where(label > 0, 0.5 / share, 0.5 / (1 - share))
    past_w, past_v, past_b = np.full(SIZE, 1e-8), np.full((RANK, SIZE), 1e-8), 1e-8
    for _ in range(epochs):
        order = rng.permutation(m)
        for a in range(0, m, batch):
            pick = order[a : a + batch]
            n = begin[pick + 1] - begin[pick]
            at = np.repeat(begin[pick] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            r, f, v = np.repeat(np.arange(len(pick)), n), feat[at], x[at]
            z = score(model, r, f, v, len(pick))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[pick]) * weight[pick] / len(pick)
            used, back = np.unique(f, return_inverse=True)
            past_b += g.sum() ** 2
            model.bias -= rate * g.sum() / np.sqrt(past_b)
            d = np.bincount(back, g[r] * v, len(used)) + 1e-5 * model.weight[used]
            past_w[used] += d * d
            for k in range(RANK):
                t = model.factor[k][f] * v
                s = np.bincount(r, t, len(pick))
                e = np.bincount(back, g[r] * v * (s[r] - t), len(used)) + 1e-5 * model.factor[k][used]
                past_v[k][used] += e * e
                model.factor[k][used] -= rate * e / np.sqrt(past_v[k][used])
            model.weight[used] -= rate * d / np.sqrt(past_w[used])
    return model


def _columns(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[bytes], list, list]]:
    a = 0
    for part, docs in chunks(iter([batch])):
        b = a + part.num_rows
        yield a, b, docs, part.column(2).to_pylist(), part.column(3).to_pylist()
        a = b


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, docs, langs, sources in _columns(batch):
            r, f, x = sparse(docs, langs, sources)
            cut = np.searchsorted(r, np.arange(len(docs) + 1))
            f, x = f.astype(np.int32), x.astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), batch.column(4).slice(a, b - a), *(pa.array([y[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary()) for y in (f, x))],
                ["doc_id", "label", "feat", "x"],
            )


def _scores(shared, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for a, b, docs, langs, sources in _columns(batch):
                r, f, x = sparse(docs, langs, sources)
                z = score(model, r, f, x.astype(np.float32), len(docs))
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                some = np.array([bool(d) for d in docs])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(p, mask=~some), pa.array((p >= least) & some)], ["doc_id", "score", "keep"])

    return run


def trained(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELS) -> Model:
    """Fitted on the ``most`` labelled documents whose ids have the least hashes, all if there are fewer.

    Several labels of a document: the least counts. Of several rows of a document the one of the least hash counts, so that no more
    than ``most`` come to the driver. Null labels and labels without a document are left out.
    """
    settle(docs.sparkSession)
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("label"))
    pick = written(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source").where("text is not null")
    own = only(slim, pick.select("doc_id"), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("text", "lang", "source"), F.xxhash64("text", "lang", "source")).alias("d")).select("doc_id", "d.*")
    some = own.join(F.broadcast(pick), "doc_id").select("doc_id", "text", "lang", "source", F.col("label").cast("double").alias("label"))
    rows = sorted(some.mapInArrow(_features, "doc_id long, label double, feat binary, x binary").collect(), key=lambda r: (r.doc_id, r.feat, r.x))  # at most ``most``
    n = [len(r.feat) // 4 for r in rows]
    feat = np.frombuffer(b"".join(r.feat for r in rows), np.int32).astype(np.int64)
    x = np.frombuffer(b"".join(r.x for r in rows), np.float32).astype(np.float64)
    return fit(np.repeat(np.arange(len(rows)), n), feat, x, np.array([r.label for r in rows]))


def scored(docs: DataFrame, model: Model, least: float = LEAST) -> DataFrame:
    """(doc_id, score, keep) for every document: the probability of good quality, and whether it reaches ``least``.

    Null and wordless texts have a null score and aren't kept. A null language or source is a
    value of its own. A score of exactly ``least`` is kept. Very long texts are scored whole. Repeated rows are scored each. Other columns are ignored. No rows in: no rows out. Without
    labels every document scores about one half.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text", "lang", "source").mapInArrow(_scores(shared, least), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, keep boolean")


def op3_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(docs, trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
