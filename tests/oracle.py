"""Compare a Spark result with DuckDB's, order aside."""

from __future__ import annotations

import math
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        c.execute(f"create view {t} as select * from '{p}/*.parquet'" if p.is_dir() else f"create view {t} as select * from '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if type(v).__name__ == "Row":
        return tuple(plain(x) for x in v)
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def compare(df, sql: str, con) -> str:
    """An empty string if both give the same rows under the same column names."""
    got_names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in got_names) for r in df.collect()), key=repr)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != got_names:
        return f"columns {got_names} against {sorted(names)}"
    at = [names.index(c) for c in got_names]
    want = sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}; first other: {next((x for x in zip(got, want) if x[0] != x[1]), None)}"
    for a, b in zip(got, want):
        for n, x, y in zip(got_names, a, b):
            if x != y and not (isinstance(x, (int, float)) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)):
                return f"{n}: {a} against {b}"
    return ""
