"""Runs a query and its oracle side by side and compares rows without regard to order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    return str(v)


def oracle_rows(sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return names, cursor.fetchall()


def assert_same(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    names, rows = oracle_rows(sql, sf_dir)
    assert sorted(df.columns) == sorted(names)
    columns = sorted(names)
    mine = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    theirs = sorted(tuple(shown(r[names.index(c)]) for c in columns) for r in rows)
    assert mine == theirs
