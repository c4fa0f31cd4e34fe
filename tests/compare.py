"""Run a registered query and its SQL counterpart, and compare them as sets of rows."""

from __future__ import annotations

from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _rows(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def _plain(value):
    # -0.0 and 0.0 are one value
    return value + 0.0 if isinstance(value, float) else value


def differences(df, con, sql: str) -> str | None:
    """None if both give the same columns and rows, else what differs."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    theirs = _rows(names, found.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    ours = _rows(df.columns, [tuple(r) for r in df.collect()])
    if ours == theirs:
        return None
    return (
        f"{sum(ours.values())} rows against {sum(theirs.values())}; only here "
        f"{list((ours - theirs).items())[:3]}; only there {list((theirs - ours).items())[:3]}"
    )
