"""Run a query and its SQL side by side and compare all rows."""

from __future__ import annotations

import math
from pathlib import Path

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return str(value) if type(value).__name__ in ("datetime", "date") else value


def compare(spark, name, query, sql, size="sf0.01"):
    import duckdb

    folder = f"{DATA}/{size}"
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{folder}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = [dict(zip(names, row, strict=True)) for row in result.fetchall()]
    df = query(spark, folder)
    assert sorted(df.columns) == sorted(names), (name, df.columns, names)
    order = sorted(names)
    got = sorted((tuple(plain(r[c]) for c in order) for r in (x.asDict(recursive=True) for x in df.collect())), key=repr)
    want = sorted((tuple(plain(r[c]) for c in order) for r in want), key=repr)
    assert len(got) == len(want), (name, len(got), len(want))
    different = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    assert not different, (name, len(different), order, different[:3])
    return len(got)
