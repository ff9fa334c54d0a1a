"""Compare a query with its SQL as multisets of normalised rows."""

from __future__ import annotations

import duckdb

from quarry.plans.tables import BASE


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, bool):
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return f"{float(v):.9g}"
    return str(v)


def rows_of(df) -> list[tuple]:
    cols = sorted(df.columns)
    return sorted((tuple(norm(x) for x in r) for r in df.select(*cols).collect()), key=repr)


def rows_of_sql(con, sql: str) -> tuple[list[str], list[tuple]]:
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    order = [names.index(n) for n in sorted(names)]
    return sorted(names), sorted((tuple(norm(r[i]) for i in order) for r in rel.fetchall()), key=repr)
