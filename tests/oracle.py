"""Runs a query and its SQL on the same tables and compares the rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    if hasattr(v, "quantize"):
        return float(f"{float(v):.9g}")
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, sf, name, query, sql):
    df = query(spark, sf)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = connect(sf).sql(sql)
    theirs = rows_of(rel.columns, rel.fetchall())
    assert sorted(df.columns) == sorted(rel.columns), name
    assert len(ours) == len(theirs), (name, len(ours), len(theirs))
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    assert not bad, (name, len(bad), bad[:3])
    return len(ours)
