"""Compare registered queries with their DuckDB oracles: python tools/check.py [sf] [name-substring ...]"""

import importlib.util
import math
import os
import sys
import tempfile
import time
import traceback

import duckdb
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return f"{type(v).__name__}:{v}"


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    from palisade.plans.stage import clear_scratch

    spec = importlib.util.spec_from_file_location("entry", f"{ROOT}/__spark_entry__.py")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g").config("spark.sql.dataFrameQueryContext.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", os.environ.get("CHECK_SCRATCH") or tempfile.mkdtemp(prefix="check-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    oracle = entry.oracle_sql()
    good = bad = 0
    for name, fn in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            cols = sorted(df.columns)
            rows = [tuple(r[c] for c in cols) for r in df.collect()]
            took = time.time() - start
            clear_scratch(spark)
            if name not in oracle:
                print(f"ROWS  {name}: {len(rows)} rows, {took:.1f}s")
                good += 1
                continue
            start = time.time()
            cur = con.execute(oracle[name])
            names = [d[0] for d in cur.description]
            got = cur.fetchall()
            dtook = time.time() - start
            assert sorted(names) == cols, f"columns {cols} vs {sorted(names)}"
            perm = [names.index(c) for c in cols]
            a = sorted([tuple(norm(v) for v in r) for r in rows])
            b = sorted([tuple(norm(r[i]) for i in perm) for r in got])
            if a == b and a:
                good += 1
                print(f"ok    {name}: {len(a)} rows, spark {took:.1f}s duck {dtook:.1f}s")
            else:
                bad += 1
                sa, sb = set(a), set(b)
                print(f"DIFF  {name}: spark {len(a)} rows, duck {len(b)} rows; cols {cols}")
                for label, x in (("spark", sorted(sa - sb)), ("duck", sorted(sb - sa))):
                    print(f"   only {label} ({len(x)}):", *[str(r)[:700] for r in x[:3]], sep="\n      ")
        except Exception as e:  # report every query
            bad += 1
            print(f"FAIL  {name}: {type(e).__name__} {str(e)[:1500]}")
            if os.environ.get("TRACE"):
                traceback.print_exc()
    sys.stdout.flush()
    print(f"{good} good, {bad} bad")


main()
