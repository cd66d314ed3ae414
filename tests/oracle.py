"""Row comparison of a Spark query with an independent SQL engine."""

import os

import duckdb

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def available() -> bool:
    return os.path.isdir(DATA)


def connect():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, str):
        return v
    if v is None or str(v) in ("<NA>", "nan", "NaT"):
        return "~"
    if type(v).__name__ in ("bool", "bool_"):
        return str(v)
    try:
        f = float(v)
    except (TypeError, ValueError):
        return str(v)
    return str(int(f)) if f == int(f) and abs(f) < 1e15 else f"{f:.7g}"


def rows(frame) -> list:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(_cell(v) for v in r) for r in frame.itertuples(index=False))
