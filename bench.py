"""Headline queries: one JSON line with seconds per query.

The typed record table is built once (``records``) and read by the others, as
in production. Every query runs to completion into a no-op sink.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "period_totals", "billing_blocks", "plan_estimate", "session_usage", "usage_deltas", "session_states", "state_timeline",
    "registry_changes", "status_transitions", "logical_sessions", "alert_throttle", "card_view", "ingested_snapshots", "complete_lines",
]
AGAIN = ["period_totals", "session_states", "state_timeline", "registry_changes", "status_transitions", "logical_sessions", "alert_throttle"]


def main() -> None:
    from sessionmill import build_session
    from sessionmill.plans import catalog, standin

    spark = build_session(
        f"local[{CPUS}]", app="bench",
        **{"spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
           "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-")})
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def timed(name: str, run) -> None:
        nonlocal seconds
        start = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - start, 3)

    # start-up of the session and its Python side is not part of any query
    spark.range(1000).selectExpr("sum(id)").collect()
    timed("records", lambda: standin.records(spark, SF_DIR).count())
    for name in HEADLINE:
        timed(name, lambda: catalog.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save())
    cold, seconds = seconds, {}
    timed("records", lambda: standin.parse_records(standin.transcript_lines(spark, SF_DIR)).write.format("noop").mode("overwrite").save())
    for name in AGAIN:
        timed(name, lambda: catalog.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save())
    seconds, warm = cold, seconds
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "warm": warm, "sf": os.path.basename(SF_DIR.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
