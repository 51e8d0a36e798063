"""Plans that must hold at scale: no cross joins, no Python in the hot path, pruned scans, one pass over texts."""

import pytest
from pyspark.sql import functions as F

import tokenledger as tl
from tokenledger.operators import guard, reports
from tokenledger.plans import queries, views

STREAMS = {"heartbeat_stream", "fold_chunk_stream", "stream_ingest", "stream_stats_daily", "stream_cache", "stream_ingest_tables", "dead_letters", "replayed_letters", "stream_totals_and_late"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - STREAMS))
def test_no_cross_join_and_no_python(spark, sf_dir, name):
    text = plan(queries.QUERIES[name](spark, sf_dir))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "FlatMapGroups"):
        assert operator not in text, operator


def test_costs_and_offers_need_no_shuffle(spark, sf_dir):
    rows = views.calls_log(views.table(spark, sf_dir, "events"))
    for df in (tl.cost(rows), tl.best_alternative(rows), tl.with_alternatives(rows)):
        text = plan(df)
        assert "hashpartitioning" not in text and "Generate" not in text


def test_scans_read_only_what_they_need(spark, tmp_path):
    parts = spark.range(5).selectExpr("string(id) usage_id", "'x' name", "'long' content", "1 token_count", "0 position")
    parts.write.parquet(str(tmp_path / "parts"))
    rows = spark.range(5).selectExpr("string(id) id", "'o' org_id", "'p' project_id", "current_timestamp() timestamp", "'m' model")
    rows.write.parquet(str(tmp_path / "rows"))
    heat = reports.heatmap(spark.read.parquet(str(tmp_path / "parts")), spark.read.parquet(str(tmp_path / "rows")), "o", days=30)
    text = plan(heat)
    assert "content" not in text
    assert "PushedFilters: [IsNotNull(org_id)" in text or "EqualTo(org_id,o)" in text


def test_guard_shuffles_nothing_and_scans_once(spark, tmp_path):
    spark.range(5).selectExpr("string(id) usage_id", "int(0) position", "'x' name", "'text' content").write.parquet(str(tmp_path / "p"))
    parts = spark.read.parquet(str(tmp_path / "p"))
    wide = guard.scan_and_rewrite(parts)
    assert "Exchange" not in plan(wide)
    findings = tl.secret_findings(parts)
    assert plan(findings).count("regexp_extract_all") == 1 and "Filter (size" not in plan(findings)


def test_the_first_plan_computes_only_what_is_read(spark, sf_dir):
    text = queries.QUERIES["first_plans"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    for unread in ("mce_alternatives", "detected_issues", "variable_analysis"):
        assert unread not in text


def test_the_policies_share_one_scan_of_the_texts(spark, sf_dir):
    text = queries.QUERIES["pii_policy"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in text and "regexp" not in text
