"""Comparison of a query with its SQL on the same tables."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(frame):
    """Rows as sorted text, columns in order of their names."""
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("" if v is None or pd.isna(v) else f"{v:.6f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v) for v in r) for r in frame.astype(object).itertuples(index=False, name=None))


def compare(spark, con, query, sql, sf):
    got, want = query(spark, sf).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns), (sorted(got.columns), sorted(want.columns))
    a, b = rows(got), rows(want)
    assert len(a) == len(b), (len(a), len(b))
    differ = [(x, y) for x, y in zip(a, b) if x != y]
    assert not differ, differ[:3]
    kind = lambda t: "float" if "float" in t else "int" if "int" in t else "bool" if "bool" in t else t
    kinds = {c: (kind(str(got[c].dtype)), kind(str(want[c].dtype))) for c in got.columns if len(got)}
    loose = {c: k for c, k in kinds.items() if k[0] != k[1] and not {"object", "str"} & set(k) and not (got[c].isna().any())}
    assert not loose, loose
    return len(a)
