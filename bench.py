"""Seconds per query at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

``tables`` is the one-off work all queries share: joining the lines, and writing
the weekly tables, the pairs and the sums over them. Each query then runs twice in full and its faster
run counts. The value is the sum of all of them.
"""

from __future__ import annotations

import json
import os
import time

from promolift import build_session
from promolift.plans.registry import all_queries, model_for


def _run(query, spark, folder) -> float:
    start = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session(os.environ.get("BENCH_CPUS", "8"), "promolift-bench")
    spark.range(1000).selectExpr("sum(id)").collect()

    start = time.perf_counter()
    tables = model_for(spark, folder).tables
    for table in (tables.train, tables.features, tables.stores, tables.pair, tables.lift, tables.store_dept):
        table.schema
    seconds = {"tables": time.perf_counter() - start}
    for name, query in all_queries().items():
        seconds[name] = min(_run(query, spark, folder) for _ in range(2))
    print(
        json.dumps(
            {
                "metric": "tables and all queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": {name: round(value, 3) for name, value in seconds.items()},
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
