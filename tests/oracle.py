"""Holds a query's rows against those of DuckDB on the same files."""

from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def rows_of_sql(sql: str, sf_dir: str = SF) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = con.execute(sql)
    return [c[0] for c in found.description], found.fetchall()


def plain(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


def assert_same(df, sql: str, sf_dir: str = SF) -> None:
    names, rows = rows_of_sql(sql, sf_dir)
    assert sorted(df.columns) == sorted(names)
    got, want = plain(df.columns, df.collect()), plain(names, rows)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert all(abs(x - y) < 2e-6 if isinstance(x, float) and isinstance(y, float) else x == y for x, y in zip(g, w, strict=True)), (g, w)
