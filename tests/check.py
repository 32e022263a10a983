"""python -m tests.check [sf] [name-part ...]: compare queries with their SQL and time them."""

import sys
import time
import traceback

from pyspark.sql import SparkSession

import __spark_entry__ as entry
from tests.compare import compare, connect


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    parts = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    sqls = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sqls:
                problems = compare(df, con, sqls[name])
                n = con.execute(f"SELECT count(*) FROM ({sqls[name]})").fetchall()[0][0]
            else:
                problems, n = [], df.count()
        except Exception as e:  # noqa: BLE001
            problems, n = [str(e)[:700] or traceback.format_exc()[-700:]], -1
        bad += bool(problems)
        print(f"{'BAD' if problems else 'ok '} {name} rows={n} {time.time() - t0:.1f}s{'' if name in sqls else ' (rows only)'}", flush=True)
        for p in problems:
            print("     ", p[:900], flush=True)
    print("bad:", bad)


main()
