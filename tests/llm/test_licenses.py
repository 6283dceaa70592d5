from __future__ import annotations

import random
import re
import textwrap

from corpus import DOCS
from test_rules import AWKWARD

from palimpsest.llm.licenses import TEMPLATES, scan, wrapped


def test_same_as_brute_force(spark):
    rng = random.Random(8)
    vocabulary = sorted({t for x in TEMPLATES.values() for t in re.findall("[a-z0-9]+", x.lower())})
    docs = []
    for i in range(120):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            line = re.findall(r"\S+", rng.choice(list(TEMPLATES.values())))
            line = [w for w in line if rng.random() > rng.choice((0.0, 0.1, 0.25))] + [rng.choice(vocabulary) for _ in range(rng.randrange(8))]
            rng.shuffle(line)
            lines.append(" ".join(line))
        docs.append((i, "\n".join(lines), "en", "a", 1))
    want = set()
    for i, text, *_ in docs:
        for b, line in enumerate(text.split("\n")):
            have = set(re.findall("[a-z0-9]+", line.lower()))
            for name, t in TEMPLATES.items():
                s = set(re.findall("[a-z0-9]+", t.lower()))
                if len(s & have) >= 0.8 * len(s) - 1e-9:
                    want.add((i, b, name, len(s & have)))
    got = [(r.doc_id, r.block, r.license, r.overlap) for r in scan(spark.createDataFrame(docs, DOCS)).collect()]
    assert len(want) > 100 and set(got) == want and len(got) == len(want)


def test_awkward_rows(spark):
    rows = [*AWKWARD, (9, "x\n\nReleased under the MIT License.\n" * 2, None, None, 1, 1, ""), (9, "released UNDER\tthe mit-license", None, None, 1, 1, "")]
    df = spark.createDataFrame(rows, DOCS + ", block long, license string")
    assert sorted((r.doc_id, r.block, r.license) for r in scan(df).collect()) == [(9, 0, "mit-notice"), (9, 2, "mit-notice"), (9, 5, "mit-notice")]
    assert scan(df.limit(0)).count() == 0 and scan(df, {"empty": "--"}).count() == 0


def test_wrapped_licenses(spark):
    long = [k for k, t in TEMPLATES.items() if len(t) > 100]
    docs = []
    for i, k in enumerate(long):
        lines = textwrap.wrap(TEMPLATES[k], 70)
        docs.append((i, "some code\n\n" + "\n".join(f" * {x}\n *" for x in lines) + "\n\nmore code", "en", "a", 1))
    docs.append((90, "released under\nzebra\nthe MIT license", "en", "a", 1))  # not neighbours
    docs.append((91, TEMPLATES["mit-notice"] + "\nthe MIT", "en", "a", 1))  # a line alone
    docs.append((92, None, "en", "a", 1))
    df = spark.createDataFrame(docs, DOCS)
    assert len(long) == 4 and not [r for r in scan(df).collect() if r.license in long]
    got = wrapped(df)
    assert got.dtypes == scan(df).dtypes
    rows = got.collect()
    for i, k in enumerate(long):
        assert len([r for r in rows if r.doc_id == i and r.license == k and r.block >= 2 and r.containment >= 0.8]) >= 1
    assert not [r for r in rows if r.doc_id >= 90]
    assert wrapped(df.limit(0)).count() == 0 and wrapped(df, {"empty": "--"}).count() == 0
