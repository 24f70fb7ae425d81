"""Compare registered queries with their SQL: ``python tests/compare.py [sf] [name ...]``."""

from __future__ import annotations

import os
import sys
import tempfile
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
NUMBERS = {"BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def tidy(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind in "iub":
            df[c] = df[c].astype("object")
    text = df.map(lambda v: "" if v is None or v is pd.NA or v != v else (repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)))
    return text.sort_values(list(text.columns)).reset_index(drop=True)


def differences(spark_df, con, sql: str) -> list[str]:
    out: list[str] = []
    res = con.execute(sql)
    want_types = {d[0]: str(d[1]) for d in res.description}
    want = res.fetchdf()
    got_types = dict(spark_df.dtypes)
    got = spark_df.toPandas()
    if set(want.columns) != set(got.columns):
        return [f"columns {sorted(got.columns)} != {sorted(want.columns)}"]
    for c, t in want_types.items():
        if NUMBERS.get(t) != got_types[c]:
            out.append(f"type of {c}: {got_types[c]} != {t}")
    if len(want) != len(got):
        out.append(f"rows {len(got)} != {len(want)}")
    a, b = tidy(got), tidy(want)
    if not a.equals(b):
        if len(a) == len(b):
            bad = (a != b).any(axis=1)
            i = bad.idxmax()
            out.append(f"{int(bad.sum())} rows differ, first: {a.loc[i].to_dict()} != {b.loc[i].to_dict()}")
        else:
            only = a.merge(b, how="outer", indicator=True)
            only = only[only["_merge"] != "both"].head(2)
            out.append(f"e.g. {only.to_dict('records')}")
    return out


def main(argv: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = argv[0] if argv else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", os.environ.get("COMPARE_PARTITIONS", "8"))
        .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="eventlens-compare-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracle = entry.queries(), entry.oracle_sql()
    names = argv[1:] or list(queries)
    failed = 0
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in oracle:
                problems = differences(df, con, oracle[name])
                n = ""
            else:
                n = f"rows only: {df.count()}"
                problems = []
        except Exception as e:  # noqa: BLE001
            problems, n = [f"{type(e).__name__}: {str(e)[:700]}"], ""
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok'} {name} {time.time() - start:.1f}s {n}", flush=True)
        for p in problems:
            print("    ", p[:1200], flush=True)
    print(f"{len(names) - failed} of {len(names)} ok")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
