"""Check registered queries against their SQL: python tests/run_oracle.py SF_DIR [name part ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import compare, connect  # noqa: E402

from riskloom.catalog.registry import entries  # noqa: E402
from riskloom.session import local_session  # noqa: E402

if __name__ == "__main__":
    sf, parts = sys.argv[1], sys.argv[2:]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name, (fn, sql) in entries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            if sql is None:
                n = fn(spark, sf).count()
                print(f"ROWS {name} {n} {time.time() - start:.1f}s", flush=True)
                continue
            diff = compare(spark, con, fn, sql, sf)
        except Exception as e:  # noqa: BLE001
            diff = [repr(e)[:1500]]
        bad += bool(diff)
        print(f"{'DIFF' if diff else 'OK'} {name} {time.time() - start:.1f}s", *diff, flush=True)
    print("bad:", bad)
