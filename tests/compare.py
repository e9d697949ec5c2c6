"""Runs queries and their SQL side by side: python tests/compare.py [--sf DIR] [NAME...]"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return tuple(plain(v) for v in x) if isinstance(x, list | tuple) else x


def rows(names: list[str], values: list) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


def difference(spark, sf_dir: str, name: str, f, sql: str | None) -> str:
    """Empty if both give the same rows."""
    df = f(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if not sql:
        return "" if got else "no rows"
    result = connection(sf_dir).execute(sql)
    names = [x[0] for x in result.description]
    want = rows(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if not want:
        return "no rows on either side prove nothing" if not got else f"{len(got)} rows and none"
    if len(got) != len(want):
        return f"rows {len(got)} and {len(want)}; first only here: {next((x for x in got if x not in set(want)), None)}, only there: {next((x for x in want if x not in set(got)), None)}"
    return next((f"{a} and {b}" for a, b in zip(got, want, strict=True) if a != b), "")


def main() -> None:
    import __spark_entry__ as entry
    from corpusmill.session import get_spark

    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        sf_dir, args = args[1], args[2:]
    spark = get_spark("compare", "local[4]", spark__sql__shuffle__partitions="8", spark__driver__memory="6g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    q, o = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args or q:
        began = time.time()
        try:
            found = difference(spark, sf_dir, name, q[name], o.get(name))
        except Exception as e:
            found = "".join(traceback.format_exception_only(e))[:700]
        bad += bool(found)
        print(f"{'bad ' if found else 'ok  '} {name} {time.time() - began:.1f} s {'' if name in o else '(no SQL)'} {found[:700]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
