"""Compare queries with their SQL: python tests/compare.py SF_DIR [NAME...]"""

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, list):
        return tuple(map(plain, x))
    return x


def differences(spark, con, sf_dir, fn, sql):
    df = fn(spark, sf_dir)
    names = sorted(df.columns)
    got = Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    if sorted(columns) != names:
        return f"columns {names} against {sorted(columns)}"
    at = [columns.index(n) for n in names]
    want = Counter(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    if got != want:
        return f"{sum(got.values())} rows against {sum(want.values())}; only here {list((got - want).items())[:3]}; only in SQL {list((want - got).items())[:3]}"
    types = dict(df.dtypes)
    kinds = {d[0]: str(d[1]).upper() for d in cur.description}
    odd = [(n, types[n], kinds[n]) for n in names if (types[n], kinds[n]) not in PAIRS and not types[n].startswith("array")]
    return f"types {odd}" if odd else ""


PAIRS = {("bigint", "NUMBER"), ("int", "NUMBER"), ("double", "NUMBER"), ("string", "STRING"), ("boolean", "BOOL"), ("bigint", "BIGINT"), ("int", "INTEGER"), ("double", "DOUBLE"), ("string", "VARCHAR"), ("boolean", "BOOLEAN")}


def connection(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as E

    sf_dir, chosen = sys.argv[1], sys.argv[2:]
    spark = SparkSession.builder.master(f"local[{os.environ.get('TEST_CPUS', '4')}]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, queries = connection(sf_dir), E.queries()
    for name, sql in E.oracle_sql().items():
        if not chosen or name in chosen:
            t = time.time()
            try:
                bad = differences(spark, con, sf_dir, queries[name], sql)
            except Exception as e:
                bad = f"{type(e).__name__}: {str(e)[:400]}"
            if bad:
                print(f"{name}: {bad}", flush=True)
            elif chosen:
                print(f"{name}: equal, {time.time() - t:.1f} s", flush=True)
    print("done")
