"""Run a query beside its SQL and compare the rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return float(value)
    return str(value)


def compare(df, db, sql):
    found = db.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    theirs = [[plain(dict(zip(names, r))[c]) for c in order] for r in found.fetchall()]
    mine = [[plain(r[c]) for c in order] for r in df.collect()]
    assert len(mine) == len(theirs)
    key = lambda row: [f"{v:.3f}" if isinstance(v, float) else v for v in row]
    for a, b in zip(sorted(mine, key=key), sorted(theirs, key=key)):
        for x, y in zip(a, b):
            assert x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-6), (a, b)
    return len(mine)
