"""Run registered queries on Spark and their SQL on DuckDB and compare the rows.

    python tests/oracle_check.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def rows_of(columns: list[str], rows: list) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(con, spark, query, sf_dir: str) -> tuple[str, int]:
    df = query.run(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if query.sql is None:
        return "rows only", len(got)
    cur = con.execute(query.sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {df.columns} vs {names}", len(got)
    if got == want:
        return "ok", len(got)
    off = [(g, w) for g, w in zip(got, want) if g != w]
    return f"DIFF rows {len(got)} vs {len(want)}, {len(off)} differ, e.g. {sorted(df.columns)} {off[:2]}", len(got)


def main() -> None:
    from barweave.plans.catalog import QUERIES
    from barweave.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, q in QUERIES.items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            verdict, n = compare(con, spark, q, sf_dir)
        except Exception as e:  # report and go on
            verdict, n = f"ERROR {type(e).__name__}: {str(e)[:600]}", 0
        bad += verdict not in ("ok", "rows only")
        print(f"{name:28s} {n:7d} {time.time() - t:6.2f}s {verdict}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
