"""Run registered queries next to their SQL on the same tables: ``python tests/compare.py [sf] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canon(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = [None if v is None or v != v else v for v in df[c].astype(object)]
    rows = sorted(map(tuple, df.itertuples(index=False)), key=lambda r: tuple(str(v) for v in r))
    return pd.DataFrame(rows, columns=df.columns)


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if len(want) == 0:
        return "both empty"
    kinds = [(c, got[c].dtype.kind, want[c].dtype.kind) for c in want.columns
             if got[c].dtype.kind != want[c].dtype.kind and not got[c].isna().any() and not want[c].isna().any()]
    if kinds:
        return f"types {kinds}"
    a, b = canon(got), canon(want)
    bad = [(c, x, y) for c in a.columns for x, y in zip(a[c], b[c]) if str(x) != str(y)]
    return f"{len(bad)} values, e.g. {bad[:3]}" if bad else None


def main() -> int:
    from dischargelab.plans.catalog import ORACLES, QUERIES
    from dischargelab.session import get_spark

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(QUERIES)
    names = [n for n in QUERIES if any(n == w or (w.endswith("*") and n.startswith(w[:-1])) for w in names)]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = get_spark("compare", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in names:
        t0 = time.time()
        try:
            got = QUERIES[name](spark, sf_dir).toPandas()
            t1 = time.time()
            if name not in ORACLES:
                verdict = None if len(got) else "no rows"
                tag = "rows"
            else:
                verdict, tag = differences(got, con.execute(ORACLES[name]).df()), "sql"
        except Exception as e:  # noqa: BLE001
            t1 = time.time()
            verdict, tag, got = f"{type(e).__name__}: {str(e)[:1500]}", "err", []
        failed += verdict is not None
        print(f"{'ok  ' if verdict is None else 'FAIL'} {name:24s} {tag} n={len(got):<7d} "
              f"{t1 - t0:6.2f}s oracle {time.time() - t1:5.2f}s {verdict or ''}", flush=True)
    print(f"{len(names) - failed}/{len(names)} ok")
    return failed


if __name__ == "__main__":
    sys.exit(main())
