"""Order-insensitive comparison of a Spark result with DuckDB's."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(v) if not v.is_integer() or math.isinf(v) else repr(v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(_plain(r[k]) for k in order) for r in rows)


def assert_same(df, con, sql):
    got = [tuple(r) for r in df.collect()]
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    want = rel.fetchall()
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    assert len(got) == len(want), (len(got), len(want))
    a, b = rows_of(df.columns, got), rows_of(names, want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    assert not bad, (len(bad), bad[:3])
