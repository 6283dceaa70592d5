from __future__ import annotations

import pytest
from corpus import DOCS

from palimpsest.llm import bpe

TEXTS = ["", " ", "Hello world, it's  what they'll say\n\n  ok\t", "naïve Ünïcode ßtraße — 日本語 text 🙂🙂 ", "a" * 5000, "x y\x1cz\x85 　 q", "12345 67.89%$#@!!! don't", "\r\n\r\n  \t", "'s 'S I'm 've"]


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_vocabulary(bpe.VOCABULARY))


def test_same_as_ranked_merges(codec):
    import tiktoken

    ranks = {t: i for i, t in enumerate(codec.vocabulary)}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    for t in TEXTS:
        ids = codec.encode(t)
        assert ids.tolist() == other.encode_ordinary(t)
        assert codec.decode(ids) == t


def test_corpus_round_trip(spark):
    import tiktoken

    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in bpe.tokenised(df).collect()}
    vocabulary = bpe.read_vocabulary(bpe.VOCABULARY)
    other = tiktoken.Encoding("own", pat_str=r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks={t: i for i, t in enumerate(vocabulary)}, special_tokens={})
    for r in df.collect():
        assert got[r.doc_id].round_trip and got[r.doc_id].tokens == other.encode_ordinary(r.text)
    back = {r.doc_id: r.text for r in bpe.detokenised(bpe.tokenised(df)).collect()}
    assert back == {r.doc_id: r.text for r in df.collect()}


def test_a_full_cache_changes_nothing(codec, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 5)
    fresh = bpe.Codec(codec.vocabulary)
    text = " ".join(f"word{i} and{i % 3}" for i in range(50))
    for t in (text, "word1 x", text, "and2"):
        assert fresh.encode(t).tolist() == codec.encode(t).tolist()


def test_awkward_rows(spark):
    data = [(1, None, None, None, None, 1, "x"), (None, "a b", "en", "a", 3, 2, "y"), (2, "", "en", "a", 0, None, None), (3, "z " * 300_000, None, "a", 9, 4, "z"), (4, "a b", "en", None, 1, 5, "z"), (4, "a b", "en", None, 1, 5, "z")]
    df = spark.createDataFrame(data, DOCS + ", tokens long, n_tokens string")
    got = sorted(((r.doc_id or 0), r.n_tokens, r.round_trip) for r in bpe.tokenised(df).collect())
    assert got[0][0] == 0 and got[1] == (1, None, None) and got[2] == (2, 0, True) and got[3][2] and len(got) == 6
    assert bpe.tokenised(df.limit(0)).count() == 0
