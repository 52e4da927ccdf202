"""Comparison of a query's rows with those that DuckDB gives for its SQL."""

import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _value(x):
    if x is None or x != x:
        return "~"
    if isinstance(x, (float, decimal.Decimal)):
        return f"{float(x):.6g}"
    if hasattr(x, "isoformat"):
        return str(x)[:19]
    return f"[{','.join(map(_value, x))}]" if isinstance(x, (list, tuple)) else str(x)


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_value(r[i]) for i in order) for r in found)


def compare(df, con, sql):
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(names)
    got, want = rows(df.columns, df.collect()), rows(names, result.fetchall())
    assert got == want
