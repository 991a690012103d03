"""Spark's rows against DuckDB's."""

import math
from pathlib import Path


def norm(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else str(x + 0.0)
    return str([norm(y) for y in x]) if isinstance(x, (list, tuple)) else str(x)


def same(spark, name, query, sql, folder):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(folder).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    df = query(spark, folder)
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(df.columns) == sorted(names), name
    order = sorted(names)
    want = sorted(tuple(norm(x[names.index(c)]) for c in order) for x in r.fetchall())
    got = sorted(tuple(norm(x[c]) for c in order) for x in df.collect())
    assert got == want, name
