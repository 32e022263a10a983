"""Order-insensitive comparison of a Spark result with DuckDB SQL."""

import math
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        v = round(v, 5) + 0.0
        return v
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def key(row):
    return tuple((v is not None, str(type(v) if not isinstance(v, (int, float)) else 0), v if not isinstance(v, tuple) else str(v)) for v in row)


def compare(df, con, sql):
    """Return a list of problems; empty when the results agree."""
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(cols):
        return [f"columns {sorted(df.columns)} != {sorted(cols)}"]
    order = sorted(cols)
    got = [tuple(norm(r[c]) for c in order) for r in df.collect()]
    at = [cols.index(c) for c in order]
    exp = [tuple(norm(r[i]) for i in at) for r in want]
    got.sort(key=key)
    exp.sort(key=key)
    if len(got) != len(exp):
        extra = sorted(set(map(str, got)) - set(map(str, exp)))[:2]
        missing = sorted(set(map(str, exp)) - set(map(str, got)))[:2]
        return [f"rows {len(got)} != {len(exp)}; extra {extra}; missing {missing}"]
    bad = []
    for g, e in zip(got, exp):
        for c, a, b in zip(order, g, e):
            if isinstance(a, float) and isinstance(b, (int, float)) and not isinstance(b, bool):
                if not math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-5):
                    bad.append(f"{c}: {a} != {b} in {g} / {e}")
                    break
            elif a != b or (type(a) is not type(b) and not (a is None or b is None)):
                bad.append(f"{c}: {a!r} != {b!r} in {g} / {e}")
                break
        if len(bad) >= 3:
            break
    return bad
