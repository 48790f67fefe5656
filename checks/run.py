"""Run registered queries against their SQL: python -m checks.run [folder] [name ...]"""

import sys
import time

import duckdb

from checks import catalog
from stopclock.session import build_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    key = lambda r: tuple((v is None, str(type(v)), v) if not isinstance(v, bool) else (False, "b", v) for v in r)
    norm = lambda v: 0.0 if isinstance(v, float) and v == 0 else v
    return [names[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in rows), key=lambda r: str(key(r)))


def main(folder: str, only: list[str]) -> int:
    catalog.load_all()
    spark = build_session(
        "checks",
        **{"spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("OFF")
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    bad = 0
    for name, build in catalog.QUERIES.items():
        if only and not any(name.startswith(o) for o in only):
            continue
        start = time.time()
        try:
            df = build(spark, folder)
            got = rows_of(df.columns, [tuple(r) for r in df.collect()])
            took = time.time() - start
            if name not in catalog.SQL:
                print(f"rows  {name} {len(got[1])} {took:.1f}s")
                continue
            start = time.time()
            cur = con.execute(catalog.SQL[name])
            names = [d[0] for d in cur.description]
            want = rows_of(names, cur.fetchall())
            duck = time.time() - start
            ok = got == want
            print(f"{'ok   ' if ok else 'DIFF '} {name} {len(got[1])} {took:.1f}s duck {duck:.1f}s", flush=True)
            if not ok:
                bad += 1
                print("   columns", got[0], want[0] if got[0] != want[0] else "")
                a, b = set(got[1]), set(want[1])
                print("   spark only", len(a - b), list(a - b)[:3])
                print("   duck only ", len(b - a), list(b - a)[:3])
        except Exception as error:
            bad += 1
            print(f"ERROR {name} {str(error)[:700]}", flush=True)
    print("failures", bad)
    return bad


if __name__ == "__main__":
    args = sys.argv[1:]
    sys.exit(main(args[0] if args else "/root/testdata/sf0.01", args[1:]) > 0)
