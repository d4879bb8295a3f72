"""Run queries next to their SQL: python -m checks.compare SF_DIR [name ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

from checks.oracles import oracle_sql
from checks.queries import queries
from shelfmark.session import local_session


def connect(sf_dir: str):
    con = duckdb.connect()
    for f in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: None if v is None or v != v else v)
    texts = df.map(lambda v: "NULL" if v is None else f"{float(v):.9g}" if isinstance(v, (int, float)) else str(v))
    return texts.sort_values(list(texts.columns)).reset_index(drop=True)


def difference(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> str:
    if sorted(spark_rows.columns) != sorted(sql_rows.columns):
        return f"columns {sorted(spark_rows.columns)} != {sorted(sql_rows.columns)}"
    if len(spark_rows) != len(sql_rows):
        return f"rows {len(spark_rows)} != {len(sql_rows)}"
    a, b = canonical(spark_rows), canonical(sql_rows)
    wrong = (a != b).any(axis=1)
    if wrong.any():
        i = wrong.idxmax()
        return f"{int(wrong.sum())} rows differ, first: {a.loc[i].to_dict()} != {b.loc[i].to_dict()}"[:600]
    return ""


def main() -> None:
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con, sql = local_session("8"), connect(sf_dir), oracle_sql()
    bad = 0
    for name, query in queries().items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            got = query(spark, sf_dir).toPandas()
            t1 = time.time()
            if name in sql:
                problem = difference(got, con.execute(sql[name]).df())
                state = "differs: " + problem if problem else "equal"
            else:
                state = "rows only"
        except Exception as e:
            t1, got, state = time.time(), [], f"failed: {type(e).__name__} {str(e)[:700]}"
        bad += state not in ("equal", "rows only")
        print(f"{name:24} {len(got):8} rows {t1 - t0:6.1f}s sql {time.time() - t1:5.1f}s {state}", flush=True)
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
