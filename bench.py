"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Each query is built
and run to the end; its result is thrown away. BENCH_QUERIES picks others.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.registry import QUERIES  # noqa: E402
from govlens.session import local_session  # noqa: E402

# One of each shape: counts, charts, lists, top-k, joins, windows, checks, whole
# feeds, schedules, the store and a stream.
HEADLINE = (
    "se_00 se_07 se_08 se_13 ov_05 ov_10 ov_11 tk_02 tk_07 tk_09 tk_10 tk_11 tk_12 tk_13"
    " cc_02 cc_04 cc_05 th_00 th_02 th_05 d_multi_ip d_newapi d_limit d_spike"
    " backtest_d_multi_ip backtest_d_newapi backtest_d_spike alerts"
    " normalize_activity normalize_activity_json normalize_usage normalize_cost"
    " rule_hits violations coverage collect_buckets ingest_counts upsert rollup_hourly"
    " chats_for_users users_with_org timechart_null stream_d_multi_ip stream_rollup"
)


def run(spark, name: str, sf_dir: str) -> float:
    begin = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES", HEADLINE).split()
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    run(spark, "ov_01", sf_dir)  # start-up is not a query's cost
    seconds, warm = {}, {}
    for name in names:
        seconds[name] = round(run(spark, name, sf_dir), 3)
        warm[name] = round(run(spark, name, sf_dir), 3)
    rows = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("events", "lineitem")}
    print(
        json.dumps(
            {
                "metric": "headline queries, warm total",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": seconds,
                "rows_per_sec": {
                    "normalize_activity": int(rows["events"] / warm["normalize_activity"])
                    if "normalize_activity" in warm
                    else None,
                    "normalize_usage": int(rows["lineitem"] / warm["normalize_usage"])
                    if "normalize_usage" in warm
                    else None,
                },
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
