"""Run queries beside their SQL: `python -m tests.compare [name-part ...] [--sf DIR]`."""

import decimal
import math
import os
import sys
import time
import traceback

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(v):
    if isinstance(v, float):
        return ("f", "nan") if math.isnan(v) else ("f", repr(v))
    if isinstance(v, decimal.Decimal):
        return ("d", str(v))
    return (type(v).__name__, str(v))


def compare(spark, con, name, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got = df.collect()
    cols = sorted(df.columns)
    if sql is None:
        return len(got), None, None
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != cols:
        return len(got), len(want), f"columns {cols} vs {sorted(names)}"
    a = sorted(tuple(canon(r[c]) for c in cols) for r in got)
    idx = [names.index(c) for c in cols]
    b = sorted(tuple(canon(r[i]) for i in idx) for r in want)
    if a == b:
        return len(got), len(want), None
    only_a = [x for x in a if x not in set(b)][:2]
    only_b = [x for x in b if x not in set(a)][:2]
    return len(got), len(want), f"cols {cols}\n  spark {only_a}\n  sql   {only_b}"


def main(argv):
    sf = "/root/testdata/sf0.001"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        argv = argv[:i] + argv[i + 2:]
    part, parts = 0, 1
    if "--shard" in argv:
        i = argv.index("--shard")
        part, parts = map(int, argv[i + 1].split("/"))
        argv = argv[:i] + argv[i + 2:]
    from staycheck.session import build_session
    import __spark_entry__ as e

    spark = build_session("local[8]", 8, **{"spark.driver.memory": os.environ.get("MEM", "8g")})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    queries, oracle = e.queries(), e.oracle_sql()
    bad = []
    for i, (name, fn) in enumerate(queries.items()):
        if i % parts != part or (argv and not any(p in name for p in argv)):
            continue
        t = time.time()
        try:
            n, m, err = compare(spark, con, name, fn, oracle.get(name), sf)
        except Exception as ex:
            n, m, err = None, None, f"{type(ex).__name__}: {str(ex)[:700]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        flag = "FAIL" if err else ("rows" if m is None else "ok")
        empty = " EMPTY" if n == 0 else ""
        print(f"{flag:5}{name:45} {n} {time.time()-t:6.1f}s{empty}", flush=True)
        if err:
            print("   ", err, flush=True)
            bad.append(name)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
