"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tokenledger.plans import views  # noqa: E402
from tokenledger.plans.queries import QUERIES  # noqa: E402
from tokenledger.session import build_session  # noqa: E402

HEADLINE = (
    "model_savings", "stats_report", "stats_breakdowns", "alternatives_all", "alternatives_best", "monthly_budget",
    "usage_nested", "heatmap", "ingest_usage_rows", "ingest_pii_hits", "cache_upsert", "pii_findings", "pii_mask",
    "injection_findings", "secret_findings", "compress_text", "json_minify", "guard_parts", "token_estimate",
    "token_pretoken", "full_prompt_hash", "construct_usage", "cache_replay", "cache_replay_events", "explain_rollup",
    "explain_issues", "plan_backfill", "verification_parse", "heartbeat_chain", "fold_chunks", "stream_ingest",
    "stream_stats_daily",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session("bench", cpus=cpus, shuffle_partitions=int(cpus), text_partitions=int(cpus))
    # Start-up work (class loading, first file listing) is not what the queries cost.
    views.table(spark, sf_dir, "documents").selectExpr("sum(length(text))").collect()
    QUERIES["model_savings"](spark, sf_dir).collect()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_wall_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(os.path.basename(sf_dir).removeprefix("sf")) if "sf" in os.path.basename(sf_dir) else None,
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
