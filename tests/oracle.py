"""Run every query beside its SQL and compare the rows. `python tests/oracle.py [sf_dir] [name ...]`"""

import math
import sys
import time
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, Decimal):
        return repr(float(value))
    return repr(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows), sorted(columns)


def compare(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    got, columns = canonical(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want, wanted_columns = canonical(names, result.fetchall())
    if columns != wanted_columns:
        return f"columns {columns} != {wanted_columns}", len(got)
    if got != want:
        only_got = sorted(set(got) - set(want))[:3]
        only_want = sorted(set(want) - set(got))[:3]
        return f"rows {len(got)} vs {len(want)}\n  columns {columns}\n  spark  {only_got}\n  sql    {only_want}", len(got)
    return None, len(got)


if __name__ == "__main__":
    from offerwatch import catalog
    from offerwatch.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(catalog.queries())
    spark = local_session(8, "oracle")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    for name in names:
        start = time.time()
        try:
            problem, rows = compare(spark, con, sf_dir, catalog.queries()[name], catalog.oracles()[name])
        except Exception as error:  # noqa: BLE001 - report and go on
            problem, rows = f"{type(error).__name__}: {str(error)[:1500]}", 0
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} rows={rows} {time.time() - start:.1f}s {problem or ''}", flush=True)
