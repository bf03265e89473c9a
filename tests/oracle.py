"""Compares a query with its SQL in DuckDB, as multisets of rows with columns sorted by name."""

from __future__ import annotations

import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' * os.path.isdir(path)}')")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    text = lambda v: "None" if v is None or v != v else repr(float(v) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(text(r[i]) for i in order) for r in rows), sorted(names)


def assert_same(df, con, sql: str) -> None:
    got, names = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want, theirs = rows_of([c[0] for c in cur.description], cur.fetchall())
    assert names == theirs
    assert len(got) == len(want), (len(got), len(want))
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    assert not bad, (len(bad), bad[:3])
