"""Run every registered query beside its SQL: python tests/oracle_check.py [sf] [name ...]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        kinds = df[c].dropna().map(type).unique()
        if pd.api.types.is_float_dtype(df[c]) or pd.api.types.is_integer_dtype(df[c]):
            df[c] = df[c].astype("float64").round(9)
        elif pd.api.types.is_datetime64_any_dtype(df[c]):
            df[c] = df[c].astype("datetime64[us]")
        else:
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NA or v != v else str(v))
        del kinds
    return df.sort_values(list(df.columns), ignore_index=True, na_position="first")


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    g, w = normal(got), normal(want)
    for c in g.columns:
        a, b = g[c], w[c]
        if a.dtype != b.dtype and not (a.isna().all() and b.isna().all()):
            return f"dtype of {c}: {a.dtype} != {b.dtype}"
        bad = ~((a == b) | (a.isna() & b.isna()))
        if bad.any():
            i = bad.idxmax()
            return f"{c}: {bad.sum()} differ, first {a[i]!r} != {b[i]!r}\n   {g.loc[i].to_dict()}\n   {w.loc[i].to_dict()}"
    return ""


def main():
    import __spark_entry__ as entry
    from lintlake.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    folder = f"/root/testdata/sf{sf}"
    spark, con = local_session(8, memory="12g"), connect(folder)
    names = sys.argv[2:] or list(entry.queries())
    failed = []
    for name in names:
        start = time.time()
        try:
            got = entry.queries()[name](spark, folder)
            types = {f.name: f.dataType.simpleString() for f in got.schema.fields}
            got = got.toPandas()
            took = time.time() - start
            sql = entry.oracle_sql().get(name)
            if sql is None:
                result = "rows only"
            else:
                rel = con.sql(sql)
                want_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
                result = compare(got, rel.df()) or "ok"
                match = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP"}
                off = {c: (t, want_types.get(c)) for c, t in types.items() if match.get(t) != want_types.get(c)}
                if off:
                    result += f"  types {off}"
        except Exception as exc:
            took, result = time.time() - start, f"ERROR {type(exc).__name__}: {str(exc)[:900]}"
        if result not in ("ok", "rows only"):
            failed.append(name)
        print(f"{name:28} {len(got) if 'got' in dir() and hasattr(got, '__len__') else 0:>8} {took:6.2f}s  {result}", flush=True)
    print(f"{len(names) - len(failed)} of {len(names)} match; failed: {failed}")


if __name__ == "__main__":
    main()
