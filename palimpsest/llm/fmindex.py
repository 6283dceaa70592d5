"""Repeated passages by matching statistics over compressed FM-indexes, one per shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import only, written
from .suffix import ANCHOR, anchor_rows, slim
from .words import U, Words, squeeze, texts

LENGTH = 50  # words
SHARD_WORDS = 400_000  # aimed at; the number of shards follows from the corpus
PIECE = 400  # words of a streamed document searched at once


class Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.frombuffer(packed.tobytes() + bytes(16 - len(packed) % 8), U)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.ones = int(self.before[-1])
        self.zeros = n - self.ones

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before i."""
        w = i >> 6
        mask = (U(1) << (i & 63).astype(U)) - U(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)


class Wavelet:
    """A wavelet tree in matrix form: a bit vector for each binary digit of the symbols."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.depth = max(1, int(sigma - 1).bit_length())
        self.levels: list[Bits] = []
        for d in range(self.depth - 1, -1, -1):
            bit = (symbols >> d) & 1
            self.levels.append(Bits(bit.astype(bool)))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        self.base = self._walk(np.arange(sigma), np.zeros(sigma, np.int64))

    def _walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for d, level in zip(range(self.depth - 1, -1, -1), self.levels):
            ones = level.rank(i)
            i = np.where((c >> d) & 1, level.zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c occurs before i."""
        return self._walk(c, i) - self.base[c]


def suffix_array(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the words that each shares with the one before. Zeros end a text and differ."""
    n = len(s)
    zero = s == 0
    first = np.where(zero, np.cumsum(zero) - 1, s + zero.sum())
    rank = np.unique(first, return_inverse=True)[1].astype(np.int64)
    ranks, h = [rank], 1
    while True:
        nxt = np.full(n, 0, np.int64)
        nxt[: n - h] = rank[h:] + 1
        key = rank * (n + 1) + nxt
        sa = np.argsort(key)
        k = key[sa]
        new = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
        rank = np.empty(n, np.int64)
        rank[sa] = new
        if new[-1] == n - 1 or h >= n:
            break
        ranks.append(rank)
        h *= 2
    lcp = np.zeros(n + 1, np.int64)
    a, b = sa[:-1].copy(), sa[1:].copy()
    for d in range(len(ranks) - 1, -1, -1):
        ok = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[ok] = ranks[d][a[ok]] == ranks[d][b[ok]]
        step = 1 << d
        lcp[1:n][same] += step
        a[same] += step
        b[same] += step
    return sa, lcp


class Index:
    """FM-index of the texts of a shard, with the documents and the common prefixes of its suffixes."""

    def __init__(self, symbols: np.ndarray, doc: np.ndarray):
        self.n = len(symbols)
        sigma = int(symbols.max()) + 1
        sa, self.lcp = suffix_array(symbols)
        self.lcp[0] = self.lcp[self.n] = -1
        self.wave = Wavelet(symbols[sa - 1], sigma)  # the transform: the symbol before each suffix
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma))])
        self.doc = doc[sa]
        change = np.flatnonzero(self.doc[1:] != self.doc[:-1]) + 1
        at = np.searchsorted(change, np.arange(self.n), side="right")
        self.next = np.append(change, self.n)[at]  # the next suffix of another document
        self.least = [self.lcp]
        while 2 << (len(self.least) - 1) <= self.n + 1:
            x, k = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(x[:-k], x[k:]))

    def back(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: suffixes that begin with c and go on as those from lo up to hi do."""
        r = self.wave.rank(np.concatenate([c, c]), np.concatenate([lo, hi])) + self.first[np.concatenate([c, c])]
        return r[: len(c)], r[len(c) :]

    def shared(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether two documents are among the suffixes."""
        return (lo < hi) & (self.next[np.minimum(lo, self.n - 1)] < hi)

    def parent(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The interval of the longest shorter prefix that more suffixes have, and its length."""
        n = np.maximum(self.lcp[lo], self.lcp[hi])
        lo, hi = lo.copy(), hi.copy()
        for k in range(len(self.least) - 1, -1, -1):
            step, t = 1 << k, self.least[k]
            at = lo - step + 1
            ok = (at >= 1) & (t[np.clip(at, 0, len(t) - 1)] >= n)
            lo[ok] -= step
            ok = (hi + step <= self.n) & (t[np.clip(hi, 0, len(t) - 1)] >= n)
            hi[ok] += step
        return lo, hi, n


def stream(index: Index, symbols: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Matching statistics of many pieces at once, from right to left.

    (piece, start, stop, suffix): the runs of ``length`` words at least that begin at a place
    where the match can't be extended, and have two documents in the index.
    """
    m = len(begin)
    pos = end - 1  # the next word to match
    lo, hi, size = np.zeros(m, np.int64), np.full(m, index.n), np.zeros(m, np.int64)
    out: list[tuple[np.ndarray, ...]] = []

    def report(x: np.ndarray) -> None:
        x = x[size[x] >= length]
        if len(x):
            out.append((x, pos[x] + 1, pos[x] + 1 + size[x], lo[x]))

    c = np.arange(index.wave.base.shape[0])
    alone = ~index.shared(index.first[:-1][c], index.first[1:][c])  # words of one document only
    live = np.flatnonzero(pos >= begin)
    told = np.zeros(m, bool)  # the present match was reported
    while len(live):
        s = symbols[pos[live]]
        single = alone[s]
        x = live[single]
        if len(x):
            report(x[~told[x]])
            pos[x] -= 1
            lo[x], hi[x], size[x], told[x] = 0, index.n, 0, False
        x, s = live[~single], s[~single]
        a, b = index.back(s, lo[x], hi[x])
        ok = index.shared(a, b)
        y = x[ok]
        lo[y], hi[y] = a[ok], b[ok]
        size[y] += 1
        pos[y] -= 1
        told[y] = False
        x = x[~ok]
        if len(x):
            report(x[~told[x]])
            told[x] = True
            lo[x], hi[x], size[x] = index.parent(lo[x], hi[x])
        done = live[pos[live] < begin[live]]
        report(done[~told[done]])
        live = live[pos[live] >= begin[live]]
    if not out:
        none = np.empty(0, np.int64)
        return none, none, none, none
    return tuple(np.concatenate(v) for v in zip(*out))  # type: ignore[return-value]


def _segments(length: int, shards: int):
    """What each shard gets of a document: the words of the windows whose anchors belong there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            size = 0
            for doc, text, marks in zip(batch.column(0).to_pylist(), texts(batch.column(1)), batch.column(2).to_pylist()):
                raw = squeeze(text)
                ends = np.append(np.flatnonzero(np.frombuffer(raw, np.uint8) == 32), len(raw))
                of: dict[int, list[tuple[int, int]]] = {}
                for m in sorted(marks, key=lambda m: m["lo"]):
                    spans = of.setdefault(m["fp"] % shards, [])
                    a, b = m["lo"], m["hi"] + length
                    if spans and a <= spans[-1][1]:
                        spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
                    else:
                        spans.append((a, b))
                for shard, spans in of.items():
                    for a, b in spans:
                        piece = raw[(int(ends[a - 1]) + 1 if a else 0) : int(ends[b - 1])]
                        for k, v in zip(out, (shard, doc, a, piece)):
                            k.append(v)
                        size += len(piece)
                if size > 8 << 20:
                    yield _segment_batch(out)
                    out, size = ([], [], [], []), 0
            yield _segment_batch(out)

    return run


def _segment_batch(out: tuple[list, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int32(), pa.int64(), pa.int32(), pa.binary()))], ["shard", "doc_id", "start", "words"])


def _search(length: int, piece: int):
    """Index a shard and stream its documents through the index."""

    def run(table: pa.Table) -> pa.Table:
        names = ["doc_id", "start", "stop", "other_doc_id"]
        parts = texts(table.column("words"))
        doc = table.column("doc_id").to_numpy()
        start = table.column("start").to_numpy()
        words = Words(parts)
        vocabulary, ids = np.unique(words.h, return_inverse=True)
        # symbol 0 after every text
        symbols = np.zeros(words.n + len(parts), np.int64)
        shift = words.offset[:-1] + np.arange(len(parts))
        where = np.arange(words.n) + np.repeat(np.arange(len(parts)), words.count)
        symbols[where] = ids.astype(np.int64) + 1
        owner = np.repeat(np.arange(len(parts)), words.count + 1)
        number = np.unique(doc, return_inverse=True)[1]
        index = Index(symbols, number[owner])
        begin, end, of = [], [], []
        step = piece - length + 1
        for i, n in enumerate(words.count.tolist()):
            for a in range(0, max(1, n - length + 1), step):
                begin.append(shift[i] + a)
                end.append(shift[i] + min(n, a + piece))
                of.append(i)
        part = np.array(of, np.int64)
        p, a, b, row = stream(index, symbols, np.array(begin, np.int64), np.array(end, np.int64), length)
        p = part[p]
        first = np.unique(doc)[index.doc[row]]
        second = np.unique(doc)[index.doc[np.minimum(index.next[row], index.n - 1)]]
        own = doc[p]
        return pa.Table.from_arrays([pa.array(own), pa.array((a - shift[p] + start[p]).astype(np.int32)), pa.array((b - shift[p] + start[p]).astype(np.int32)), pa.array(np.where(first != own, first, second))], names)

    return run


def repeated_intervals(docs: DataFrame, length: int = LENGTH, shard_words: int = SHARD_WORDS, piece: int = PIECE) -> DataFrame:
    """(doc_id, start, stop, n_words, other_doc_id): where each document repeats others.

    An interval is a longest run of words of which each lies in a window of ``length`` words that
    another document has, too; start and stop count words from 0, stop excluded; other_doc_id is one of the documents that share
    some of it (not always all of it). Repeats within one document don't count.

    Windows that could be shared have a winnowed anchor in common. An anchor found in two different
    texts sends its windows to the shard it hashes to; there they make an FM-index (a wavelet tree
    over the Burrows-Wheeler transform) through which the shard's documents are streamed
    backwards. The match is cut to the parent interval where it can't be extended; what stays at or above
    ``length`` with a second document in its interval is reported. Texts that are equal as a whole are
    searched once and reported whole.

    Words are parted by ASCII white space and compared by 64-bit hashes. Null, empty and shorter texts
    give no rows; rows with a null doc_id are left out; repeated rows count once. Other columns are ignored. No rows in: no rows out.
    """
    base = slim(docs)
    anchor = written(base.mapInArrow(anchor_rows(length), ANCHOR).select("doc_id", "same", "lo", "hi", "fp"))
    per = anchor.groupBy("fp").agg(F.min("same").alias("s0"), F.max("same").alias("s1")).where("s0 <> s1").select("fp")
    member = written(anchor.groupBy("doc_id", "same").agg((F.max("hi") + length).alias("n_words")))
    copy = written(member.groupBy("same").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep <> last"))
    extra = member.join(copy, "same").where("rep <> doc_id").select("doc_id", "same")
    marks = written(anchor.join(per, "fp", "left_semi").join(extra, ["doc_id", "same"], "left_anti").groupBy("doc_id", "same").agg(F.collect_set(F.struct("fp", "lo", "hi")).alias("marks")))
    ids = written(marks.select("doc_id").distinct())
    total = marks.agg(F.sum(F.aggregate("marks", F.lit(0), lambda s, m: s + m["hi"] - m["lo"] + length))).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    text = only(base, ids, "doc_id").join(marks, ["doc_id", "same"]).select("doc_id", "text", "marks")
    segments = text.mapInArrow(_segments(length, shards), "shard int, doc_id long, start int, words binary")
    found = segments.groupBy("shard").applyInArrow(_search(length, piece), "doc_id long, start int, stop int, other_doc_id long")
    other = F.when(F.col("doc_id") == F.col("rep"), F.col("last")).otherwise(F.col("rep"))
    every = member.join(copy, "same").select("doc_id", F.lit(0).alias("start"), F.col("n_words").alias("stop"), other.alias("other_doc_id"))
    return _union(found.unionByName(every))


def _union(found: DataFrame) -> DataFrame:
    """Intervals of a document that overlap or touch become one."""
    order = Window.partitionBy("doc_id").orderBy("start", "stop")
    gap = F.col("start") > F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    run = found.withColumn("gap", F.coalesce(gap.cast("int"), F.lit(0))).withColumn("run", F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = run.groupBy("doc_id", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("other_doc_id").alias("other_doc_id"))
    return out.select("doc_id", "start", "stop", (F.col("stop") - F.col("start")).alias("n_words"), "other_doc_id")


def op8_fm_index_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_intervals(spark.read.parquet(f"{sf_dir}/documents.parquet"))
