"""The pipeline against a brute-force version of all its stages."""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import combinations

import duckdb
import tiktoken
from pyspark.sql import functions as F
from test_minhash import groups, jaccard, shingles

from palimpsest.llm import bpe, rules
from palimpsest.llm.minhash import one_of_each

SF = "/root/testdata/sf0.001"


def test_same_as_brute_force(spark):
    import corpus_pipeline

    # quality rules: their SQL
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    ok = {r[0] for r in con.execute(f"select doc_id from ({rules.ORACLE})").fetchall()}
    docs = {i: (t, s) for i, t, s in con.execute("select doc_id, text, source from documents").fetchall() if i in ok}
    assert len(ok) < 200
    # near duplicates: all pairs; MinHash may miss a few
    sets = {i: shingles(t) for i, (t, _) in docs.items()}
    root = groups([(a, b) for a, b in combinations(sorted(sets), 2) if jaccard(sets[a], sets[b]) >= 0.5], sets)
    left = {r.doc_id for r in one_of_each(spark, spark.read.parquet(f"{SF}/documents.parquet").where(F.col("doc_id").isin(sorted(ok))), SF).collect()}
    alone = {i for i in docs if root[i] == i}
    assert alone <= left and len(docs) - len(left) >= 0.9 * (len(docs) - len(alone)) > 5
    docs = {i: v for i, v in docs.items() if i in left}
    # repeated passages: the first place of each window stays
    first, out = set(), {}
    drops = defaultdict(set)
    for i in sorted(docs):
        w = docs[i][0].split()
        for p in range(len(w) - 49):
            k = tuple(w[p : p + 50])
            if k in first:
                drops[i] |= set(range(p, p + 50))
            first.add(k)
    for i, (t, s) in docs.items():
        parts = re.findall(r"\s*\S+", t)
        t = "".join(x for p, x in enumerate(parts) if p not in drops[i]).strip() if drops[i] else t
        if t:
            out[i] = (t, s)
    # source mix
    con.execute("create table d (doc_id bigint, source varchar, n bigint)")
    con.executemany("insert into d values (?, ?, ?)", [(i, s, len(t.split())) for i, (t, s) in out.items()])
    kept = {r[0] for r in con.execute("""
        with h as (select *, ('0x' || substr(md5(doc_id::varchar), 1, 15))::bigint as h from d),
        w as (select source, floor(sqrt(sum(n)::double)) as w from d group by source),
        r as (select *, sum(n) over (partition by source order by h range between unbounded preceding and current row) as up_to from h)
        select doc_id from r join w using (source) where up_to <= floor((select sum(n) from d)::double * (w / (select sum(w) from w)))""").fetchall()}
    assert 0 < len(kept) < len(out)
    # token ids
    ranks = {t: i for i, t in enumerate(bpe.read_vocabulary(bpe.VOCABULARY))}
    enc = tiktoken.Encoding("own", pat_str=r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})
    want = {i: enc.encode_ordinary(out[i][0]) for i in kept}
    got = {r.doc_id: r.tokens for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want
