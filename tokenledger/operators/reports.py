"""Reports over the usage log: totals, breakdowns, potential savings, heatmap, projects, budgets."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pricing import PRICES, Price
from .cost import with_best_offer
from .running import sum_before

# Report settings.
HIDDEN_PARTS = ("system", "context")
SAVINGS_WINDOW = 100
HEATMAP_PREVIEW = 5
TREEMAP_FLOOR = 50


def scope(
    usage: DataFrame,
    org: str | None = None,
    project: str | None = None,
    days: int | None = None,
    as_of: datetime | str | None = None,
    kind: str | None = None,
) -> DataFrame:
    """Usage rows of one organisation, and optionally one project, type, or the last ``days`` before ``as_of``.

    The bounds are literals, so they reach the scan as pushed filters (or prune partitions).
    """
    if org is not None:
        usage = usage.where(F.col("org_id") == org)
    if project is not None:
        usage = usage.where(F.col("project_id") == project)
    if kind is not None:
        usage = usage.where(F.col("type") == kind)
    if days is not None:
        now = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
        start = now - F.make_dt_interval(days=F.lit(days))
        usage = usage.where(F.col("timestamp") >= start)
        if "date" in usage.columns:  # the log's partition column: days before the bound are not opened
            usage = usage.where(F.col("date") >= F.to_date(start))
    return usage


def _summaries(usage: DataFrame) -> DataFrame:
    """One small row per provider and model, from which every total and breakdown follows without a second scan."""
    saved = F.coalesce("saved_tokens", F.lit(0))
    return usage.groupBy("provider", "model").agg(
        F.sum("total_tokens").alias("total_tokens"),
        F.sum("total_cost").alias("total_cost"),
        F.sum(F.when(F.col("type") == "cache_hit", saved).otherwise(0)).alias("cache_saved_tokens"),
        F.sum(F.when(F.col("type") == "execution", saved).otherwise(0)).alias("compression_saved_tokens"),
        F.sum("saved_cost").alias("total_saved_cost"),
        F.count("id").alias("total_requests"),
        F.count_if(F.col("type") == "cache_hit").alias("total_cache_hits"),
    )


def _zero(name: str, kind: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0)).cast(kind).alias(name)


def totals(usage: DataFrame) -> DataFrame:
    """One row: tokens, cost, savings by kind, requests, cache hits, average cost per request."""
    return (
        _summaries(usage)
        .agg(
            _zero("total_tokens", "bigint"),
            _zero("total_cost", "double"),
            _zero("cache_saved_tokens", "bigint"),
            _zero("compression_saved_tokens", "bigint"),
            _zero("total_saved_cost", "double"),
            _zero("total_requests", "bigint"),
            _zero("total_cache_hits", "bigint"),
        )
        .withColumn("total_saved_tokens", F.col("cache_saved_tokens") + F.col("compression_saved_tokens"))
        .withColumn("avg_cost", F.col("total_cost") / F.greatest("total_requests", F.lit(1)))
    )


def by_provider(usage: DataFrame) -> DataFrame:
    """Tokens and cost per provider."""
    return usage.groupBy("provider").agg(
        F.sum("total_tokens").alias("total_tokens"), F.sum("total_cost").alias("total_cost")
    )


def by_model(usage: DataFrame) -> DataFrame:
    """Tokens and cost per model."""
    return usage.groupBy("model").agg(
        F.sum("total_tokens").alias("total_tokens"), F.sum("total_cost").alias("total_cost")
    )


def breakdowns(usage: DataFrame) -> DataFrame:
    """Totals, per provider and per model in one scan: ``(dimension, value, total_tokens, total_cost)``."""
    return (
        _summaries(usage)
        .groupingSets([[], ["provider"], ["model"]], "provider", "model")
        .agg(
            F.grouping_id().alias("_set"),
            F.sum("total_tokens").alias("total_tokens"),
            F.sum("total_cost").alias("total_cost"),
        )
        .select(
            F.when(F.col("_set") == 3, F.lit("all"))
            .when(F.col("_set") == 1, F.lit("provider"))
            .otherwise(F.lit("model"))
            .alias("dimension"),
            F.when(F.col("_set") == 3, F.lit(""))
            .when(F.col("_set") == 1, F.col("provider"))
            .otherwise(F.col("model"))
            .alias("value"),
            "total_tokens",
            "total_cost",
        )
    )


def latest_executions(usage: DataFrame, n: int = SAVINGS_WINDOW) -> DataFrame:
    """The newest ``n`` executions (the id settles equal times)."""
    return usage.where("type = 'execution'").orderBy(F.desc("timestamp"), "id").limit(n)


def potential_savings(
    usage: DataFrame, n: int = SAVINGS_WINDOW, prices: Sequence[Price] = PRICES
) -> DataFrame:
    """One row: what the newest ``n`` executions would have saved on their cheapest alternative."""
    recent = with_best_offer(latest_executions(usage, n), prices)
    gain = F.col("total_cost") - F.col("best.cost")
    return recent.agg(F.coalesce(F.sum(F.when(gain > 0, gain)), F.lit(0.0)).alias("potential_savings"))


def count_for(usage: DataFrame, child: DataFrame, name: str) -> DataFrame:
    """One row: child rows (hits, alerts) that belong to the given usage rows.

    Children are counted per usage before the join, so a usage row with very many of them stays one row. A child with a
    column ``name`` has been counted already.
    """
    counted = child.groupBy("usage_id").agg((F.sum(name) if name in child.columns else F.count("*")).alias("_n"))
    joined = counted.join(usage.select(F.col("id").alias("usage_id")), "usage_id", "inner")
    return joined.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias(name))


def stats_report(
    usage: DataFrame, pii_hits: DataFrame, alerts: DataFrame, prices: Sequence[Price] = PRICES
) -> DataFrame:
    """The one-row statistics report. Its one-row pieces are stacked and summed, so no join is needed.

    ``pii_hits`` and ``alerts`` are rows of findings, or one table of ``scan.finding_counts`` given for both.
    """
    if pii_hits is alerts and "security_alerts" in alerts.columns:
        ids = usage.select(F.col("id").alias("usage_id"))
        both = alerts.join(ids, "usage_id", "left_semi")
        found = [both.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pii_hits", "security_alerts")])]
    else:
        found = [count_for(usage, pii_hits, "pii_hits"), count_for(usage, alerts, "security_alerts")]
    pieces = [totals(usage).drop("avg_cost"), *found, potential_savings(usage, prices=prices)]
    stacked = pieces[0]
    for piece in pieces[1:]:
        stacked = stacked.unionByName(piece, allowMissingColumns=True)
    summed = stacked.agg(*[F.sum(c).alias(c) for c in stacked.columns])
    return summed.withColumn("avg_cost", F.col("total_cost") / F.greatest("total_requests", F.lit(1)))


def heatmap(
    variables: DataFrame,
    usage: DataFrame,
    org: str | None = None,
    project: str | None = None,
    days: int | None = 30,
    as_of: datetime | str | None = None,
) -> DataFrame:
    """Tokens per part name, without the system and context parts, largest first.

    ``request_count`` counts part rows. Only three columns of the parts are read; equal totals are ordered by name.
    """
    rows = scope(usage, org, project, days, as_of).select(F.col("id").alias("usage_id"))
    parts = variables.where(~F.col("name").isin(*HIDDEN_PARTS)).select("usage_id", "name", "token_count")
    return (
        parts.join(rows, "usage_id", "inner")
        .groupBy(F.col("name").alias("variable_name"))
        .agg(F.sum("token_count").alias("total_tokens"), F.count("usage_id").alias("request_count"))
        .withColumn("treemap_size", F.greatest("total_tokens", F.lit(TREEMAP_FLOOR)))
        .orderBy(F.desc("total_tokens"), "variable_name")
    )


def projects(usage: DataFrame, org: str | None = None) -> DataFrame:
    """Distinct projects."""
    return scope(usage, org).select("project_id").distinct()


def budget(
    usage: DataFrame,
    caps: DataFrame,
    action: str = "reject",
    bucket_seconds: int = 3600,
) -> tuple[DataFrame, DataFrame]:
    """Spend of the project in the calendar month before each call, and whether its monthly cap is reached.

    ``caps``: ``(project_id, monthly_budget)``; a project without a cap is never exceeded. Returns the rows and, with
    ``action='reject'``, the refused ones apart (with ``warn`` they stay, flagged).
    """
    rows = usage.withColumns(
        {
            "project_id": F.coalesce("project_id", F.lit("default")),
            "month": F.date_trunc("month", F.col("timestamp").cast("timestamp")).cast("date"),
        }
    )
    spent = sum_before(
        rows, ["project_id", "month"], "timestamp", "id", F.col("total_cost"), "month_to_date", bucket_seconds
    )
    flagged = spent.join(caps.select("project_id", "monthly_budget"), "project_id", "left").withColumn(
        "budget_exceeded", F.coalesce(F.col("month_to_date") >= F.col("monthly_budget"), F.lit(False))
    )
    if action == "warn":
        return flagged, flagged.where("false")
    return flagged.where("not budget_exceeded"), flagged.where("budget_exceeded")
