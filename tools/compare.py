"""Run registered queries against their SQL in an in-process DuckDB and report differences.

usage: python tools/compare.py [--large] SF_DIR [NAME_PART ...]

``--large`` makes the planner act as on large tables: it never broadcasts and
splits join partitions at once.
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from catalog import REGISTRY  # noqa: E402
from tradeloom.session import build_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

LARGE = {
    "autoBroadcastJoinThreshold": "-1",
    "adaptive.skewJoin.skewedPartitionFactor": "1.0",
    "adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "adaptive.advisoryPartitionSizeInBytes": "64k",
}


def tidy(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object or "datetime" in str(df[c].dtype):
            df[c] = df[c].map(lambda x: None if x is None or x is pd.NaT or x != x else str(x)[:10] if hasattr(x, "year") else x)
        elif df[c].dtype.kind in "iuf":
            df[c] = df[c].astype(float) + 0.0
    return df.sort_values(list(df.columns), ignore_index=True, key=lambda s: s.map(str))


def main() -> int:
    large = "--large" in sys.argv
    sf, *parts = [a for a in sys.argv[1:] if a != "--large"]
    spark = build_session("compare", f"local[{os.environ.get('BENCH_CPUS', '8')}]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    if large:
        for key, value in LARGE.items():
            spark.conf.set(f"spark.sql.{key}", value)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    bad = 0
    for name, (f, sql) in REGISTRY.items():
        if parts and not any(p in name for p in parts):
            continue
        started = time.time()
        try:
            got = f(spark, sf).toPandas()
            took = time.time() - started
            if sql is None:
                print(f"rows-only {name}: {len(got)} rows, {took:.1f}s", flush=True)
                continue
            want = con.execute(sql).df()
            if sorted(got.columns) != sorted(want.columns):
                raise AssertionError(f"columns {sorted(got.columns)} against {sorted(want.columns)}")
            if len(got) != len(want):
                raise AssertionError(f"{len(got)} rows against {len(want)}")
            a, b = tidy(got), tidy(want)
            for c in a.columns:
                same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
                if not same.all():
                    i = same.idxmin()
                    raise AssertionError(f"{c}: {(~same).sum()} differ, first {a.loc[i].to_dict()} against {b.loc[i].to_dict()}")
            print(f"ok {name}: {len(got)} rows, {took:.1f}s", flush=True)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"DIFFERS {name}: {type(e).__name__} {str(e)[:700]}", flush=True)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
