"""Byte-level BPE through a sentencepiece model written directly from the vocabulary."""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# White space as the pattern's engine has it, without the four separators that Python adds.
_W = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PATTERN = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_W}\p{{L}}\p{{N}}]+|[{_W}]+(?![^{_W}])|[{_W}]+"
# Pre-tokens never reach over white space, but for one space before: these units hold whole pre-tokens.
_UNIT = re.compile(f" ?[^{_W}]+|[{_W}]+(?![^{_W}])|[{_W}]+")
CACHE = 150_000  # units whose ids a worker remembers


def read_vocabulary(path: str) -> list[bytes]:
    """The tokens in order of rank, from lines of base64 and rank."""
    with open(path, "rb") as f:
        ranks = {int(r): base64.b64decode(t) for t, r in (line.split() for line in f if line.strip())}
    return [ranks[i] for i in range(len(ranks))]


def byte_letters() -> list[str]:
    """A printable letter for every byte: itself where it is printable, else one from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, more = [], 256
    for b in range(256):
        out.append(chr(b) if b in own else chr(more))
        more += b not in own
    return out


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """One field of a protocol buffer."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model(vocabulary: list[bytes]) -> bytes:
    """A sentencepiece BPE model: piece i is token i in letters for bytes, its score -i; the unknown piece comes last.

    The highest score merges first, so merges go by rank. Normalisation is the identity:
    no prefix, no white space removed or escaped.
    """
    letter = byte_letters()
    pieces = [_field(1, _field(1, "".join(letter[b] for b in t).encode()) + _field(2, float(-i))) for i, t in enumerate(vocabulary)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    n = len(vocabulary)
    none = (1 << 64) - 1  # -1
    trainer = _field(3, 2) + _field(4, n + 1) + _field(40, n) + _field(41, none) + _field(42, none) + _field(43, none)
    normal = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normal)


class Codec:
    """Encodes texts to token ids and back."""

    def __init__(self, vocabulary: list[bytes], proto: bytes | None = None):
        self.vocabulary = vocabulary
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=proto or model(vocabulary))
        self.letters = str.maketrans({chr(b): c for b, c in enumerate(byte_letters())})
        self.split = regex.compile(PATTERN)
        self.known: dict[str, bytes] = {}

    def _learn(self, units: set[str]) -> None:
        if len(self.known) + len(units) > CACHE:
            self.known.clear()
        flat: list[str] = []
        count = []
        order = list(units)
        for u in order:
            pre = self.split.findall(u)
            count.append(len(pre))
            flat += [p.encode().decode("latin-1").translate(self.letters) for p in pre]
        ids = self.sp.encode(flat, out_type=int, num_threads=1)
        at = 0
        for u, n in zip(order, count):
            self.known[u] = np.array([i for x in ids[at : at + n] for i in x], np.int32).tobytes()
            at += n

    def encode(self, text: str) -> np.ndarray:
        units = _UNIT.findall(text)
        fresh = {u for u in units if u not in self.known}
        if fresh:
            self._learn(fresh)
            if len(self.known) == len(fresh):  # the cache was emptied
                missing = {u for u in units if u not in self.known}
                if missing:
                    self._learn_more(missing)
        return np.frombuffer(b"".join(map(self.known.__getitem__, units)), np.int32)

    def _learn_more(self, units: set[str]) -> None:
        kept = self.known
        self.known = {}
        self._learn(units)
        self.known.update(kept)

    def decode(self, ids: np.ndarray) -> str:
        """The inverse mapping: each id's bytes, joined. Ids out of range raise."""
        return b"".join(map(self.vocabulary.__getitem__, ids.tolist())).decode("utf-8", errors="replace")


def _code(shared, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, proto = shared.value
        codec = Codec(vocabulary, proto)
        for batch in batches:
            a, size = 0, 0
            column = batch.column(batch.schema.get_field_index("text"))
            sizes = [len(t) if t is not None else 0 for t in column.cast(pa.large_binary()).to_pylist()]
            for b, n in enumerate([*sizes, 0]):
                if b == len(sizes) or size + n > 4 << 20 and b > a:
                    if b > a:
                        yield _coded(batch.slice(a, b - a), codec, keep)
                    a, size = b, 0
                size += n

    return run


def _coded(batch: pa.RecordBatch, codec: Codec, keep: list[str]) -> pa.RecordBatch:
    ids, same, n = [], [], []
    for t in batch.column(batch.schema.get_field_index("text")).to_pylist():
        if t is None:
            same.append(None)
            n.append(None)
            ids.append(None)
            continue
        x = codec.encode(t)
        ids.append(x)
        n.append(len(x))
        same.append(codec.decode(x) == t)
    at = pa.array(np.concatenate([[0], np.cumsum([len(x) if x is not None else 0 for x in ids])]).astype(np.int32))
    flat = pa.array(np.concatenate([x for x in ids if x is not None] or [np.empty(0, np.int32)]))
    lists = pa.ListArray.from_arrays(at, flat, mask=pa.array([x is None for x in ids]))
    own = [batch.column(batch.schema.get_field_index(c)) for c in keep]
    return pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int32()), lists, pa.array(same, pa.bool_())], [*keep, "n_tokens", "tokens", "round_trip"])


def tokenised(docs: DataFrame, vocabulary: str = VOCABULARY, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(the columns of ``keep``, n_tokens, tokens, round_trip): the texts as token ids, whether decoding gives the text again.

    Texts are split into pre-tokens by the byte-level pattern, the pre-tokens' bytes written as
    letters, and encoded by a sentencepiece model that ``model`` makes of the vocabulary; decoding
    joins the ids' bytes. Any text can be encoded; nothing is normalised.

    The empty text has no tokens and round_trip true; a null text has nulls. Repeated rows are encoded each. Columns outside ``keep`` are
    ignored, so their names can't clash. No rows in: no rows out.
    """
    tokens = read_vocabulary(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast((tokens, model(tokens)))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(_code(shared, list(keep)), f"{kinds}, n_tokens int, tokens array<int>, round_trip boolean")


def _decoded(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*shared.value)
        for batch in batches:
            out = [codec.decode(np.array(x, np.int64)) if x is not None else None for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return run


def detokenised(coded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from (doc_id, tokens); null tokens give a null text."""
    tokens = read_vocabulary(vocabulary)
    shared = coded.sparkSession.sparkContext.broadcast((tokens, model(tokens)))
    return coded.select("doc_id", "tokens").mapInArrow(_decoded(shared), f"doc_id {coded.schema['doc_id'].dataType.simpleString()}, text string")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenised(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline's last stage: documents as token ids."""
    return tokenised(docs, keep=("doc_id", "lang", "source"))
