"""Compare a query with its SQL: same column names, same rows in any order."""

import math
from pathlib import Path

import duckdb


def rows_of(df) -> list[tuple]:
    names = sorted(df.columns)
    return sorted((tuple(_plain(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).collect()), key=repr)


def sql_rows(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(names), sorted((tuple(_plain(r[k]) for k in order) for r in found.fetchall()), key=repr)


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    return v
