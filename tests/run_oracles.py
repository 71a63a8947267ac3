"""Run registered queries against their DuckDB oracles (dev helper).

usage: python tests/run_oracles.py [--plain] [sf_dir] [name ...]
"""
import sys
import time

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
sys.path.insert(0, __file__.rsplit("/", 1)[0])

from compare import compare, duck  # noqa: E402

from tidepool.plans.catalog import REGISTRY  # noqa: E402
from tidepool.session import local_session  # noqa: E402

args = [a for a in sys.argv[1:] if a != "--plain"]
sf = args[0] if args else "/root/testdata/sf0.01"
names = args[1:] or list(REGISTRY)
if "--plain" in sys.argv:  # a default session, as a driver would build it
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[8]").getOrCreate()
else:
    spark = local_session()
con = duck(sf)
bad = 0
for n in names:
    q = REGISTRY[n]
    t = time.time()
    try:
        df = q.run(spark, sf)
        if q.sql is None:
            msg = f"rows-only: {df.count()} rows"
            ok = True
        else:
            ok, msg = compare(df, con, q.sql)
    except Exception as exc:  # report and go on
        ok, msg = False, f"ERROR {type(exc).__name__}: {str(exc)[:400]}"
    bad += not ok
    print(f"{'OK ' if ok else 'BAD'} {n:28s} {time.time()-t:6.1f}s  {msg}", flush=True)
print("failures:", bad)
