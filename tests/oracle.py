"""Runs a query and its SQL and compares rows, columns by name, order ignored."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows) if rows is not None else None


def compare(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = query(spark, sf_dir)
    got, want = df.collect(), con.execute(sql)
    names = [d[0] for d in want.description]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    clean = lambda names, rows: sorted((tuple(r[i] for i in sorted(range(len(names)), key=lambda i: names[i])) for r in rows), key=key)
    assert sorted(df.columns) == sorted(names)
    a, b = clean(df.columns, got), clean(names, want.fetchall())
    assert len(a) == len(b), (len(a), len(b))
    for x, y in zip(a, b, strict=True):
        assert x == y, (x, y)
    assert a
    return {c: t for c, t in df.dtypes}
