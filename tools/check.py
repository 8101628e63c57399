"""Compare named queries with their SQL twins.  usage: check.py [-d sf_dir] [keys or module names...]"""

from __future__ import annotations

import datetime as dt
import importlib
import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from carryover import plans  # noqa: E402
from carryover.plans.registry import ORACLES, QUERIES, TABLES  # noqa: E402
from carryover.session import build_session  # noqa: E402


def norm(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return f"b:{v}"
    if isinstance(v, int):
        return f"n:{v}"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"f:{v!r}"
    if isinstance(v, (dt.datetime,)):
        return f"t:{v.replace(tzinfo=None).isoformat()}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return f"{type(v).__name__}:{v}"


def main(args):
    sf = "/root/testdata/sf0.01"
    if args and args[0] == "-d":
        sf, args = args[1], args[2:]
    quiet = False
    wanted = []
    for a in args:
        if a in plans.MODULES:
            before = set(QUERIES)
            importlib.import_module(f"carryover.plans.{a}")
            wanted += [k for k in QUERIES if k not in before]
        else:
            wanted.append(a)
    if not wanted or any(w not in QUERIES for w in wanted):
        for m in plans.MODULES:
            if os.path.exists(os.path.join(os.path.dirname(plans.__file__), f"{m}.py")):
                importlib.import_module(f"carryover.plans.{m}")
        wanted = wanted or list(QUERIES)
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
        "spark.log.level": "ERROR", "spark.ui.showConsoleProgress": "false",
    })
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    bad = []
    for k in wanted:
        t0 = time.time()
        try:
            df = QUERIES[k](spark, sf)
            cols = sorted(df.columns)
            rows = df.select(*[f"`{c}`" for c in cols]).collect()
            took = time.time() - t0
            if k not in ORACLES:
                print(f"rows  {k:32s} {len(rows):7d} {took:6.2f}s", flush=True)
                if not rows:
                    bad.append(k)
                continue
            cur = con.execute(ORACLES[k])
            names = [d[0] for d in cur.description]
            got = cur.fetchall()
            if sorted(names) != cols:
                print(f"COLS  {k}: {cols} vs {sorted(names)}")
                bad.append(k)
                continue
            idx = [names.index(c) for c in cols]
            a = Counter(tuple(norm(v) for v in r) for r in rows)
            b = Counter(tuple(norm(r[i]) for i in idx) for r in got)
            if a == b:
                flag = "ok   " if rows else "EMPTY"
                print(f"{flag} {k:32s} {len(rows):7d} {took:6.2f}s", flush=True)
                if not rows:
                    bad.append(k)
            else:
                bad.append(k)
                print(f"DIFF  {k}: spark {len(rows)} sql {len(got)} cols {cols}")
                for r, n in list((a - b).items())[:3]:
                    print("    spark", n, r)
                for r, n in list((b - a).items())[:3]:
                    print("    sql  ", n, r)
        except Exception as e:  # noqa: BLE001
            bad.append(k)
            print(f"ERR   {k}: {str(e)[:700]}", flush=True)
    print("checked", len(wanted), "bad", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
