"""Compare registered queries with their SQL: check_oracles.py FOLDER [name-prefix ...]"""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import differences
from pyspark.sql import SparkSession

import __spark_entry__ as e

if __name__ == "__main__":
    folder, prefixes = sys.argv[1], tuple(sys.argv[2:])
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    oracles = e.oracle_sql()
    bad = 0
    for name, fn in e.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            if name in oracles:
                note = differences(spark, folder, fn, oracles[name])
            else:
                note = "" if fn(spark, folder).count() >= 0 else "?"
                note = note or ""
        except Exception as err:
            note = f"{type(err).__name__}: {str(err)[:700]}"
            if "-v" in os.environ.get("CHECK", ""):
                traceback.print_exc()
        bad += bool(note)
        kind = "oracle" if name in oracles else "rows"
        print(f"{'FAIL' if note else 'ok  '} {name:38s} {kind:6s} {time.time() - start:6.2f}s {note}", flush=True)
    print("failures:", bad)
