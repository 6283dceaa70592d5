"""Repeated passages: maximal repeats from common-prefix interval trees."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cmp_to_key, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import apart, free, only, settle, written
from .words import U, Words, anchors, chunks, mix, ranges, squeeze, texts

LENGTH = 50  # words
HOT = 10_000  # texts with an anchor, from which on its tree is made level by level over all tasks
AT_ONCE = 16 << 20  # bytes of words that the places of one anchor may hold when sorted
PLACE = "group_id long, parent_id long, n_words int, n_occurrences long, doc_id long, same binary, copies long, start int, cut int"


def seeds(same: pa.Array) -> np.ndarray:
    """The first 64 bits of each text's hash."""
    return np.array([int.from_bytes(x[:8], "little") for x in same.to_pylist()], U)


def anchor_rows(length: int):
    """The winnowed anchors of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, docs in chunks(batches):
            a = anchors(Words(docs), length, seeds(batch.column(1)).view(np.int64))
            at = pa.array(a["doc"])
            order = np.lexsort((a["fp"], a["doc"]))
            d, f = a["doc"][order], a["fp"][order]
            lead = np.zeros(len(d), np.int32)
            lead[order] = np.append(True, (d[1:] != d[:-1]) | (f[1:] != f[:-1]))[: len(d)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), *(pa.array(a[x].astype(np.int32)) for x in ("pos", "lo", "hi")), pa.array(a["fp"]), pa.array(a["tag"]), pa.array(lead)],
                ["doc_id", "same", "pos", "lo", "hi", "fp", "tag", "lead"],
            )

    return run


ANCHOR = "doc_id long, same binary, pos int, lo int, hi int, fp long, tag long, lead int"  # lead: 1 for a text's first place of the anchor


def slim(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text in 128 bits, text; without null ids or texts."""
    settle(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5("text")).alias("same"), "text").where("doc_id is not null and text is not null")


def classes(member: DataFrame) -> DataFrame:
    """(same, rep, n): texts that several documents have, of distinct (doc_id, same); a row for each, however many they are."""
    return member.groupBy("same").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1")


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows as Python values, few at a time."""
    for a in range(0, batch.num_rows, 20):
        some = batch.slice(a, 20)
        yield from zip(some.column(0).to_pylist(), texts(some.column(1)), *(some.column(c).to_pylist() for c in range(2, some.num_columns)))


def _contexts(length: int):
    """Each anchor that begins a repeat somewhere, with the words that can belong to repeats through it.

    The right side ends where the anchors that occur more than once end: a repeat
    can't go on beyond the reach of the last of them. Places of one anchor with the same end share
    the words from the first of them on: the words go out once, with all places.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {x: [] for x in _KINDS}
            size = 0
            for doc, text, ms, same, copies in _rows(batch):
                raw = squeeze(text)
                ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
                ends = np.append(ends, len(raw))
                n = len(ends)
                ms = sorted({m["pos"]: m for m in ms}.values(), key=lambda m: m["pos"])
                reach = [0] * len(ms)
                for i in range(len(ms) - 1, -1, -1):
                    chained = i + 1 < len(ms) and ms[i + 1]["lo"] <= ms[i]["hi"] + 1
                    reach[i] = reach[i + 1] if chained else min(n, ms[i]["hi"] + length)
                shared: dict[tuple[int, int], list[dict]] = {}
                for m, to in zip(ms, reach):
                    if m["starts"]:
                        shared.setdefault((m["fp"], to), []).append(m)
                for (fp, to), places in shared.items():
                    pos, lo = (np.array([m[x] for m in places]) for x in ("pos", "lo"))
                    begin = np.append(0, ends[:-1] + 1)[np.stack([np.maximum(lo - 1, 0), pos])]  # bytes where the left and the right side begin
                    words = raw[begin[0, 0] : ends[to - 1]] + b" "
                    begin -= begin[0, 0]
                    for k, v in zip(out, (fp, doc, same, copies, pos, lo, [m["hi"] for m in places], begin[0], begin[1], words)):
                        out[k].append(v)
                    size += len(words) + 20 * len(places)
                    if size > 1 << 20:
                        yield _batch(out)
                        out, size = {k: [] for k in out}, 0
            yield _batch(out)

    return run


CONTEXT = "fp long, doc_id long, same binary, copies long, pos array<int>, lo array<int>, hi array<int>, left array<int>, right array<int>, words binary"
_INTS = pa.list_(pa.int32())
_KINDS = {"fp": pa.int64(), "doc_id": pa.int64(), "same": pa.binary(), "copies": pa.int64(), "pos": _INTS, "lo": _INTS, "hi": _INTS, "left": _INTS, "right": _INTS, "words": pa.binary()}


def _batch(out: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in _KINDS.items()], list(_KINDS))


def common_words(a: bytes, b: bytes) -> tuple[int, int]:
    """Words, and bytes, that two texts begin with alike; every word ends in a space."""
    n = min(len(a), len(b))
    if a[:n] != b[:n]:
        lo, hi = 0, n
        while hi - lo > 1:
            mid = (lo + hi) // 2
            if a[lo:mid] == b[lo:mid]:
                lo = mid
            else:
                hi = mid
        n = a.rfind(b" ", 0, lo) + 1
    else:
        n = a.rfind(b" ", 0, n) + 1
    return a.count(b" ", 0, n), n


_PLACE = {"group_id": pa.int64(), "parent_id": pa.int64(), "n_words": pa.int32(), "n_occurrences": pa.int64(), "doc_id": pa.int64(), "same": pa.binary(), "copies": pa.int64(), "start": pa.int32(), "cut": pa.int32()}


def _places(columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PLACE.values())], list(_PLACE))


class Group:
    """An interval that is a maximal repeat: its length, places of its own, greater groups within it."""

    __slots__ = ("value", "a", "b", "own", "first", "parent")

    def __init__(self, value: int, a: int, b: int, own: list[int], first: int):
        self.value, self.a, self.b, self.own, self.first, self.parent = value, a, b, own, first, None


def interval_tree(lcp: list[int], order: list[int], told) -> tuple[list[Group], list[int]]:
    """Stack scan of an enhanced suffix array: the tree of the intervals that ``told(value, a, b)`` takes, and what to cut.

    lcp[i] is the common prefix of the suffixes i and i+1. A suffix is listed in the longest of its groups only, so the tree is
    no larger than the array. cut[i] is the length of the longest group of which suffix i isn't the first by ``order``, 0 if there is none.
    """
    groups: list[Group] = []
    cut = [0] * len(order)
    stack: list[list] = []  # common prefix, first suffix, suffixes without a group so far, groups without a parent so far
    for i, x in enumerate([*lcp, -1]):
        first, loose, inner = i, [i], []
        while stack and stack[-1][0] > x:
            value, first, more, kids = stack.pop()
            if len(more) < len(loose):
                more, loose = loose, more
            more += loose
            kids += inner
            if told(value, first, i):
                least = min([*more, *(k.first for k in kids)], key=order.__getitem__)
                g = Group(value, first, i, more, least)
                for p in more:
                    if p != least:
                        cut[p] = value
                for k in kids:
                    k.parent = g
                    if k.first != least:
                        cut[k.first] = value
                groups.append(g)
                loose, inner = [], [g]
            else:
                loose, inner = more, kids
        if x >= 0:
            if stack and stack[-1][0] == x:
                stack[-1][2] += loose
                stack[-1][3] += inner
            else:
                stack.append([x, first, loose, inner])
    return groups, cut


def _sorted(places: list[tuple], limit: int) -> list[tuple]:
    """By the words on the right, doc_id and position; beyond ``limit`` bytes the words are cut out for each comparison anew."""

    def key(p: tuple) -> tuple:
        return p[0][p[1] :], p[2], p[3]

    def order(p: tuple, q: tuple) -> int:
        x, y = p[0][p[1] : p[1] + 256], q[0][q[1] : q[1] + 256]
        if x == y:
            x, y = key(p), key(q)
        return (x > y) - (x < y)

    return sorted(places, key=key if sum(len(p[0]) - p[1] for p in places) <= limit else cmp_to_key(order))


class _Found:
    """Rows of PLACE."""

    def __init__(self) -> None:
        self.columns: list[list] = [[] for _ in _PLACE]

    @property
    def size(self) -> int:
        return len(self.columns[0])

    def batch(self) -> pa.RecordBatch:
        out = _places(self.columns)
        self.columns = [[] for _ in _PLACE]
        return out


def _bucket(rows: list[dict], length: int, found: _Found, limit: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """All maximal repeats whose anchor this is: one enhanced suffix array, a scan for each left side.

    ``rows`` are the places of one anchor. The suffixes from the anchor on are sorted once;
    for each number of words to the left, places with the same words there form a class, and
    the intervals of the class in the array are repeats if the next words on the left differ.
    Full batches of rows are given out at once, the rest stays in ``found``.
    """
    places = [(r["words"], b, r["doc_id"], f, lo, hi, a, r["copies"], r["same"]) for r in rows for f, lo, hi, a, b in zip(r["pos"], r["lo"], r["hi"], r["left"], r["right"])]
    if len(places) < 2:
        return
    places = _sorted(places, limit)

    def right(p: tuple) -> bytes:
        return p[0][p[1] :]

    kept = places[:1]
    lcp = []
    for p in places[1:]:
        q = kept[-1]
        if p[2:4] == q[2:4] and p[8] == q[8]:  # repeated input rows
            continue
        lcp.append(common_words(right(q), right(p))[0])
        kept.append(p)
    n = len(kept)
    left = [p[0][p[6] : p[1]].split() for p in kept]
    pos, lo, hi = ([p[i] for p in kept] for i in (3, 4, 5))
    nearest = [p[3] - p[5] for p in kept]
    rank = [0] * n  # by document, text and position, whatever the words on the left
    for k, i in enumerate(sorted(range(n), key=lambda i: (kept[i][2], kept[i][8], pos[i]))):
        rank[i] = k
    hashed: dict[int, Words] = {}

    def ident(i: int, o: int, value: int) -> int:
        words, right_at = kept[i][:2]
        w = hashed.get(id(words))
        if w is None:
            if len(hashed) > 64:
                hashed.clear()
            w = hashed[id(words)] = Words([words[:-1]])
        x = int(np.searchsorted(w.start, right_at))
        return int(w.span(np.array([x - o]), np.array([x + value])).view(np.int64)[0])

    todo: list[tuple[int, list[int]]] = [(0, list(range(n)))]  # words to the left, places that share them
    while todo:
        o, at = todo.pop()
        if len(at) < 2:
            continue
        near = min(nearest[j] for j in at)
        if o < near:  # no window begins nearer
            same: dict[tuple, list[int]] = {}
            for j in at:
                if len(left[j]) >= near:
                    same.setdefault(tuple(left[j][-near:]), []).append(j)
            todo += [(near, x) for x in same.values() if len(x) > 1]
            continue
        kinds: dict = {}
        label = []
        for j in at:
            w = left[j]
            # a text's begin, and the end of what is shipped, differ from everything
            key = w[-1 - o] if o < len(w) else (None, j)
            label.append(kinds.setdefault(key, len(kinds)))
        if len(kinds) > 1:
            pairs = [lcp[x] if y == x + 1 else min(lcp[x:y]) for x, y in zip(at, at[1:])]
            differs = [0] * len(at)  # the next place with another word on the left
            nxt = len(at)
            for i in range(len(at) - 1, -1, -1):
                if i + 1 < len(at) and label[i] != label[i + 1]:
                    nxt = i + 1
                differs[i] = nxt

            def told(value: int, a: int, b: int) -> bool:
                j = at[a]
                return o + value >= length and differs[a] <= b and pos[j] - hi[j] <= o <= pos[j] - lo[j]

            groups, cut = interval_tree(pairs, [rank[j] for j in at], told)
            if groups:
                up = np.cumsum([0, *(kept[j][7] for j in at)])
                ids = {id(g): ident(at[g.a], o, g.value) for g in groups}
                for g in groups:
                    own = g.own or [g.first]
                    m = len(own)
                    parent = ids[id(g.parent)] if g.parent is not None else None
                    some = [kept[at[i]] for i in own]
                    cuts = [o + cut[i] if cut[i] else 0 for i in own] if g.own else [0]
                    cols = ([ids[id(g)]] * m, [parent] * m, [o + g.value] * m, [int(up[g.b + 1] - up[g.a])] * m, [p[2] for p in some], [p[8] for p in some], [p[7] for p in some], [p[3] - o for p in some], cuts)
                    for x, y in zip(found.columns, cols):
                        x += y
                if found.size > 20_000:
                    yield found.batch()
        if len(kinds) < len(at):
            split: dict[int, list[int]] = {}
            for j, x in zip(at, label):
                split.setdefault(x, []).append(j)
            todo += [(o + 1, s) for s in split.values() if len(s) > 1]


def _groups(length: int):
    """Buckets of rows sorted by anchor; a bucket can reach over several batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Found()
        rows: list[dict] = []
        fp = None
        for batch in batches:
            for r in (r for i in range(0, batch.num_rows, 500) for r in batch.slice(i, 500).to_pylist()):
                if r["fp"] != fp:
                    yield from _bucket(rows, length, found)
                    rows, fp = [], r["fp"]
                rows.append(r)
        yield from _bucket(rows, length, found)
        yield found.batch()

    return run


def _whole(length: int):
    """Texts that occur more than once, as groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, docs in chunks(batches):
            w = Words(docs)
            at = pa.array(np.flatnonzero(w.count >= length))
            n = w.count[at.to_numpy()]
            doc, same, copies = (batch.column(i).take(at) for i in (0, 2, 3))
            zero = pa.array(np.zeros(len(n), np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(w.whole()[at.to_numpy()].view(np.int64)), pa.nulls(len(n), pa.int64()), pa.array(n.astype(np.int32)), copies, doc, same, copies, zero, zero], list(_PLACE))

    return run


def _windows(length: int):
    """The windows of a hot anchor's places: (h, left), a hash of the words and one of the word before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _each(batch):
                w, s, at = _window_places(r)
                yield pa.RecordBatch.from_arrays([pa.array(w.span(at, at + length).view(np.int64)), pa.array(_before(w, s, at, r["same"]))], ["h", "left"])

    return run


def _each(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(0, batch.num_rows, 100):
        yield from batch.slice(i, 100).to_pylist()


def _window_places(r: dict) -> tuple[Words, np.ndarray, np.ndarray]:
    """A context's words, the starts of all windows through its places, and where these are among the words."""
    w = Words([r["words"][:-1]])
    shift = r["pos"][0] - int(np.searchsorted(w.start, r["right"][0]))
    lo, hi = np.array(r["lo"], np.int64), np.array(r["hi"], np.int64)
    s = np.unique(ranges(lo, hi - lo + 1))
    return w, s, s - shift


def _before(w: Words, s: np.ndarray, at: np.ndarray, same: bytes) -> np.ndarray:
    """A hash of the word before each start; a text's begin differs from every word and every other text's."""
    begin = mix(np.array([int.from_bytes(same[:8], "little") ^ 0xA5A5A5A5A5A5A5A5], U))
    return np.where(s == 0, begin, w.h[np.maximum(at - 1, 0)]).view(np.int64)


_STARTS = {"h": pa.int64(), "left": pa.int64(), "doc_id": pa.int64(), "same": pa.binary(), "copies": pa.int64(), "start": pa.int32(), "words": pa.binary()}
STARTS = "h long, left long, doc_id long, same binary, copies long, start int, words binary"


def _begins(length: int):
    """All that follows each window's begin, for windows of hot anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _each(batch):
                w, s, at = _window_places(r)
                raw = r["words"][:-1]
                h, left = w.span(at, at + length).view(np.int64), _before(w, s, at, r["same"])
                for a in range(0, len(s), 64):
                    k = min(64, len(s) - a)
                    cols = (h[a : a + k], left[a : a + k], [r["doc_id"]] * k, [r["same"]] * k, [r["copies"]] * k, s[a : a + k].astype(np.int32), [raw[x:] for x in w.start[at[a : a + k]].tolist()])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _STARTS.values())], list(_STARTS))

    return run


LEVEL = "id long, d int, next long, go boolean, left long, doc_id long, same binary, copies long, start int"


def _levels(depth: int, step: int):
    """Each place's first d words for d from ``depth`` on, ``step`` of them, and those at which the next round begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, doc, same, copies, start, words = (batch.column(batch.schema.get_field_index(c)) for c in ("left", "doc_id", "same", "copies", "start", "words"))
            for i, (raw, seed) in enumerate(zip(words.to_pylist(), seeds(same).tolist())):
                w = Words([raw])
                d = np.arange(depth, min(depth + step, w.n) + 1)
                end = mix(np.array([seed ^ (start[i].as_py() + w.n) ^ 0x5A5A5A5A5A5A5A5A], U))  # the end differs from every word
                nxt = np.append(w.h, end)[d]
                one = pa.array(np.full(len(d), i))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w.span(np.zeros(len(d), np.int64), d).view(np.int64)), pa.array(d.astype(np.int32)), pa.array(nxt.view(np.int64)), pa.array(d == depth + step), *(c.take(one) for c in (left, doc, same, copies, start))],
                    ["id", "d", "next", "go", "left", "doc_id", "same", "copies", "start"],
                )

    return run


def _hot_places(context: DataFrame, length: int, step: int = 32) -> DataFrame:
    """The groups through hot anchors, without any group in one task.

    Windows that differ in the word before them in several places begin a repeat. From each of their places the
    tree goes down level by level: places with the same first d words make a node, which is a maximal repeat if
    both neighbouring words differ. Nodes are counted by partial aggregation; only those with several places go on to
    the next round of twice as many levels.
    """
    window = context.mapInArrow(_windows(length), "h long, left long").groupBy("h").agg(F.count("*").alias("n"), F.min("left").alias("l0"), F.max("left").alias("l1"))
    begin = written(window.where("n > 1 and l0 <> l1").select("h"))
    now = written(only(context.mapInArrow(_begins(length), STARTS), begin, "h").drop("h").dropDuplicates(["doc_id", "same", "start"]))
    depth, out = length, []
    while not now.isEmpty():
        level = written(now.mapInArrow(_levels(depth, step), LEVEL))
        node = level.where("not go").groupBy("id", "d").agg(
            F.count("*").alias("n"), F.sum("copies").cast("long").alias("n_occurrences"), F.min(F.struct("doc_id", "same", "start")).alias("one"),
            *(f(c).alias(f"{c}{i}") for c in ("left", "next") for i, f in enumerate((F.min, F.max))),
        )
        node = written(node.where("n > 1 and left0 <> left1 and next0 <> next1").select("id", "d", "n_occurrences", "one"))
        first = F.struct("doc_id", "same", "start") == F.col("one")
        out.append(level.where("not go").join(node, ["id", "d"]).select("doc_id", "same", "copies", "start", F.struct("d", "id", "n_occurrences", first.alias("first")).alias("node")))
        more = level.where("go").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
        key = written(level.where("go").join(more, "id", "left_semi").select("doc_id", "same", "start"))
        now = written(now.join(key, ["doc_id", "same", "start"], "left_semi"))
        depth, step = depth + step, step * 2
    if not out:
        return context.sparkSession.createDataFrame([], PLACE)
    every = reduce(DataFrame.unionByName, out).groupBy("doc_id", "same", "copies", "start").agg(F.sort_array(F.collect_list("node")).alias("nodes"))  # of one place: as many as its words at most
    cut = F.coalesce(F.array_max(F.transform(F.filter("nodes", lambda x: ~x["first"]), lambda x: x["d"])), F.lit(0))
    each = every.select("doc_id", "same", "copies", "start", cut.alias("cut"), "nodes", F.posexplode("nodes").alias("k", "node"))
    own = F.col("k") == F.size("nodes") - 1
    row = written(each.where(own | F.col("node.first")).select(
        F.col("node.id").alias("group_id"), F.when(F.col("k") > 0, F.try_element_at("nodes", F.col("k"))["id"]).alias("parent_id"), F.col("node.d").alias("n_words"), "node.n_occurrences",
        "doc_id", "same", "copies", "start", F.when(own, F.col("cut")).otherwise(0).alias("cut"), own.alias("own"),
    ))
    bare = row.where("not own").join(row.where("own").select("group_id").distinct(), "group_id", "left_anti")
    return row.where("own").drop("own").unionByName(bare.select(row.columns).drop("own"))


def places(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """The rows of ``maximal_repeats`` with the text's hash and how many words are to go if only each group's first place is to stay (0: none)."""
    base = slim(docs)
    anchor = written(base.mapInArrow(anchor_rows(length), ANCHOR))
    per = anchor.groupBy("fp").agg(F.count("*").alias("n"), F.sum("lead").alias("texts"), (F.min("tag") != F.max("tag")).alias("starts")).where("n > 1")
    per = written(per.select("fp", "starts", (F.col("starts") & (F.col("texts") > hot)).alias("hot")))
    member = written(anchor.select("doc_id", "same").distinct())
    copy = written(classes(member))
    extra = member.join(copy, "same").where("rep <> doc_id").select("doc_id", "same")
    marks = (
        anchor.join(per.select("fp", "starts"), "fp").join(extra, ["doc_id", "same"], "left_anti")
        .groupBy("doc_id", "same").agg(F.collect_set(F.struct("fp", "pos", "lo", "hi", "starts")).alias("marks"))
        .where(F.exists("marks", lambda m: m["starts"])).join(copy.select("same", F.col("n").alias("copies")), "same", "left")
    )
    marks = written(marks.select("doc_id", "same", "marks", F.coalesce("copies", F.lit(1)).alias("copies")))
    ids = written(marks.select("doc_id").distinct())
    context = only(base, ids, "doc_id").join(marks, ["doc_id", "same"]).select("doc_id", "text", "marks", "same", "copies").mapInArrow(_contexts(length), CONTEXT)
    heads = written(per.where("hot").select("fp"))
    if heads.isEmpty():
        rest, far = context, None
    else:
        context = written(context)
        rest, far = context.join(heads, "fp", "left_anti"), _hot_places(only(context, heads, "fp"), length)
    tree = rest.repartition("fp").sortWithinPartitions("fp").mapInArrow(_groups(length), PLACE)
    tree = written(tree if far is None else tree.unionByName(far))
    reps = copy.select("same", F.col("rep").alias("doc_id"), F.col("n").alias("copies"))
    whole = only(base, written(reps.select("doc_id").distinct()), "doc_id").join(reps, ["doc_id", "same"]).select("doc_id", "text", "same", "copies").mapInArrow(_whole(length), PLACE)
    # Whole texts that occur within other texts, too, are in the tree with more places.
    known = tree.where("copies > 1 and start = 0").select("group_id", "n_words").distinct()
    alone = whole.dropDuplicates(["group_id", "n_words"]).join(known, ["group_id", "n_words"], "left_anti").drop("parent_id")
    up = tree.where("copies > 1 and start = 0").groupBy("doc_id", "same").agg(F.max_by("group_id", "n_words").alias("parent_id"))
    every = tree.unionByName(alone.join(up, ["doc_id", "same"], "left").select(tree.columns))
    cols = ["group_id", "parent_id", "n_words", "n_occurrences", "doc_id", "same", "start", "cut"]
    copied = every.where("copies > 1").join(member.withColumnRenamed("doc_id", "own"), "same")
    copied = copied.withColumn("cut", F.when(F.col("own") == F.col("doc_id"), F.col("cut")).otherwise(F.col("n_words"))).drop("doc_id").withColumnRenamed("own", "doc_id")
    return every.where("copies = 1").select(cols).unionByName(copied.select(cols))


def maximal_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(group_id, parent_id, n_words, n_occurrences, doc_id, start): all places of every maximal repeat of at least ``length`` words, as a tree.

    A maximal repeat is a run of words that occurs at two places at least, of which not all have
    the same word before it and not all the same word after it; the ends of a text differ from
    every word. A group has n_occurrences places: in doc_id from word number start on. Groups that begin alike nest: parent_id is the
    next shorter one, which has all places of its children, too. A place is listed in the longest of its groups, so that rows don't
    grow as the square of near copies or of a text that repeats itself; a group without a place of its own lists its first one. The
    places of a group are its rows and those of all groups below it. group_id is a hash of the words.

    Suffixes that could share ``length`` words meet by their winnowed anchor, which equal windows
    have in common, so each shard is a set of anchors and holds the suffixes through them; within it
    the enhanced suffix array is scanned with a stack, which gives the tree of common-prefix
    intervals, and intervals with one word only on the left are left out.
    Anchors at which no place differs on the left from another can't begin a maximal repeat,
    and their text isn't shipped. An anchor of more than ``hot`` texts doesn't go to one task: the same
    tree is made for it level by level, see _hot_places; the groups are the same. Of texts that are equal as a
    whole one is sorted; its places are then listed for each of its documents by a join.

    Words are parted by ASCII white space; how much of it doesn't matter. Null, empty and shorter texts
    have no repeats; rows with a null doc_id are left out. Places may overlap: n equal words in
    succession hold repeats of each length under n, a chain in the tree. A repeated doc_id
    is one document if its text is the same, else several that share the id. Other columns are ignored. No rows in: no rows out.
    """
    return places(docs, length, hot).select("group_id", "parent_id", "n_words", "n_occurrences", "doc_id", "start")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maximal_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the words in their spans; the white space before a word goes with it."""
    for batch in batches:
        at = batch.schema.get_field_index("text")
        out = []
        for text, spans in zip(texts(batch.column(at)), batch.column(batch.num_columns - 1).to_pylist()):
            if not spans:
                out.append(text)
                continue
            raw = np.frombuffer(text, np.uint8)
            word = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
            number = np.cumsum(word & np.concatenate([[True], ~word[:-1]])) - word  # white space belongs to the next word
            drop = np.zeros(int(number[-1]) + 2, bool)
            for s in spans:
                drop[s["start"] : s["stop"]] = True
            out.append(raw[~drop[number]].tobytes().strip())
        cols = [pa.array(out, pa.binary()).cast(batch.schema.field(at).type) if i == at else batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays(cols, batch.schema.names[:-1])


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each repeated passage the first place stays, by doc_id and position.

    Texts keep all else, white space included; n_chars, if there is one, is counted again for those that were cut. A document of which
    nothing is left goes. All others stay as they are: those without such a passage, null and empty texts, null ids.
    Texts that share a doc_id are told apart; repeated rows are cut alike. Columns named as this function's own
    are safe. No rows in: no rows out.
    """
    ident, same, cuts = free(docs, "id", "same", "cuts")
    longest = places(docs).where("cut > 0").groupBy("doc_id", "same", "start").agg(F.max(F.col("start") + F.col("cut")).alias("stop"))
    spans = written(longest.groupBy(F.col("doc_id").alias(ident), F.col("same").alias(same)).agg(F.collect_list(F.struct("start", "stop")).alias(cuts)))
    ids = written(spans.select(ident, same))
    keyed = docs.withColumns({ident: docs["doc_id"].cast("long"), same: F.unhex(F.md5(docs["text"]))})
    rest = apart(keyed, ids, [ident, same]).select(docs.columns)
    cut = only(keyed, ids, [ident, same]).join(spans, [ident, same]).select(*docs.columns, cuts).mapInArrow(_cut, docs.schema).where("text <> ''")
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rest.unionByName(cut)
