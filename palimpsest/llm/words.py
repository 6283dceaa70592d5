"""Word hashing over Arrow batches, without a Python loop over words.

A word is a maximal run of bytes other than ASCII white space. Hashes are polynomials
modulo 2**64 taken from prefix sums, then mixed; they are the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_R, _S = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64) | U(1)
CHUNK = 512 << 10  # bytes of text hashed at once; the arrays take some twenty times that


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


class _Powers:
    """Powers of an odd base and of its inverse, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.up, self.down = base, np.ones(1, U), np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16, len(self.up) * 2)
            for name, b in (("up", self.base), ("down", U(_inverse(int(self.base))))):
                x = np.full(size, b, U)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up, self.down


_bytes, _words = _Powers(_R), _Powers(_S)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The values as UTF-8 bytes."""
    return column.cast(pa.large_binary()).to_pylist()


def squeeze(text: bytes | None) -> bytes:
    """The words, with one space between; null counts as empty."""
    return b" ".join(text.split()) if text else b""


class Words:
    """Word hashes of several squeezed texts. Texts without a word have zero words."""

    def __init__(self, docs: list[bytes]):
        full = [d for d in docs if d]
        self.count = np.array([d.count(b" ") + 1 if d else 0 for d in docs], np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.count)])
        self.n = int(self.offset[-1])
        if not self.n:
            self.h = np.empty(0, U)
            self.start = self.end = np.empty(0, np.int64)
        else:
            raw = np.frombuffer(b" ".join(full) + b" ", np.uint8)
            self.end = np.flatnonzero(raw == 32)
            self.start = np.concatenate([[0], self.end[:-1] + 1])
            up, down = _bytes.get(len(raw) + 1)
            total = np.empty(len(raw) + 1, U)
            total[0] = 0
            x = _BYTE[raw]
            x *= up[: len(raw)]
            np.cumsum(x, out=total[1:])
            self.h = mix((total[self.end] - total[self.start]) * down[self.start])
        up, self._down = _words.get(self.n + 1)
        self._total = np.zeros(self.n + 1, U)
        np.cumsum(self.h * up[: self.n], out=self._total[1:])

    def span(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the words from a up to b, b not included."""
        return mix((self._total[b] - self._total[a]) * self._down[a] + (b - a).astype(U) * U(0x2545F4914F6CDD1D))

    def grams(self, k: int) -> np.ndarray:
        """Hashes of k words from each place; those that cross into the next text are there too."""
        if self.n < k:
            return np.empty(0, U)
        return mix((self._total[k:] - self._total[:-k]) * self._down[: self.n - k + 1])

    def whole(self) -> np.ndarray:
        """A hash of each text."""
        return self.span(self.offset[:-1], self.offset[1:])


def parts(size: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes each, or of one larger row."""
    a = total = 0
    for b, n in enumerate(size.tolist()):
        if total and total + n > most:
            yield a, b
            a, total = b, 0
        total += n
    if a < len(size):
        yield a, len(size)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with their squeezed texts; only one slice at a time is turned into Python values."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
        for a, b in parts(pc.fill_null(pc.binary_length(col), 0).to_numpy()):
            yield batch.slice(a, b - a), [squeeze(t) for t in col.slice(a, b - a).to_pylist()]


def ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[0], lo[0]+1, ... n[0] of them, then lo[1], ..."""
    total = int(n.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(n)
    return np.arange(total) + np.repeat(lo - (ends - n), n)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by doubling."""
    if len(x) < w:
        return x[:0]
    have = 1
    while have * 2 <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (w - have)], x[w - have :]) if have < w else x


K = 12  # words hashed into an anchor


def anchors(words: Words, length: int, same: np.ndarray, k: int = K) -> dict[str, np.ndarray]:
    """Winnowed anchors: every window of ``length`` words holds its own, chosen by content alone.

    The anchor of a window is the k words with the least hash in it, the last of equals.
    Two windows with the same words have the same anchor at the same place, so equal
    windows always meet at an equal anchor. Each anchor comes with the first and
    last window that chose it; ``tag`` covers the words on the left of the first window up to the
    anchor, or stands for the text, by its number in ``same``, where that window begins it. All
    places count words in the text.
    """
    w = length - k + 1
    g = words.grams(k)
    doc = np.flatnonzero(words.count >= length)
    if not len(doc):
        none = np.empty(0, np.int64)
        return {"doc": none, "pos": none, "lo": none, "hi": none, "fp": none, "tag": none}
    bits = U(len(g).bit_length())
    low = (U(1) << bits) - U(1)
    key = (g & ~low) | (low - np.arange(len(g), dtype=U))
    best = low - (sliding_min(key, w) & low)
    n = words.count[doc] - length + 1
    p = ranges(words.offset[doc], n)
    of = np.repeat(doc, n)
    a = best[p].astype(np.int64)
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (of[1:] != of[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(p)]]) - 1
    of, f, lo, hi = of[first], a[first], p[first], p[last]
    base = words.offset[of]
    left = np.maximum(lo - 1, base)
    tag = np.where(lo == base, mix(same.view(U)[of] ^ U(0xA5A5A5A5A5A5A5A5)), words.span(left, f))
    return {"doc": of, "pos": f - base, "lo": lo - base, "hi": hi - base, "fp": g[f].view(np.int64), "tag": tag.view(np.int64)}


def column(spec: str, values) -> pa.Array:
    return pa.array(values, {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[spec])
