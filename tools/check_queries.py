"""Run every registered query and its SQL side by side and compare rows.

Usage: python tools/check_queries.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bucketscope.catalog import ORACLES, QUERIES  # noqa: E402
from bucketscope.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def sql_rows(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    found = connection.execute(sql)
    names = [d[0] for d in found.description]
    return names, found.fetchall()


def compare(spark, sf_dir: str, name: str) -> tuple[bool, str]:
    df = QUERIES[name](spark, sf_dir)
    order = sorted(df.columns)
    ours = Counter(tuple(r) for r in df.select(order).collect())
    if name not in ORACLES:
        return True, f"{sum(ours.values())} rows, no SQL"
    names, rows = sql_rows(sf_dir, ORACLES[name])
    if sorted(names) != order:
        return False, f"columns {order} against {sorted(names)}"
    at = [names.index(c) for c in order]
    theirs = Counter(tuple(r[i] for i in at) for r in rows)
    if ours == theirs:
        return True, f"{sum(ours.values())} rows"
    only_ours, only_theirs = list((ours - theirs).items())[:2], list((theirs - ours).items())[:2]
    return False, f"{sum(ours.values())} rows against {sum(theirs.values())}; {order}: ours {only_ours}, SQL {only_theirs}"


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(
        "check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    for name in sys.argv[2:] or QUERIES:
        started = time.time()
        try:
            same, note = compare(spark, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            same, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        failed += not same
        print(f"{'ok  ' if same else 'FAIL'} {name} {time.time() - started:.1f}s {note}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
