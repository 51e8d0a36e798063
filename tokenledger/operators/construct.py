"""Build prompts from parts in bulk: guard, assemble, count, price, and apply the token limit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.pricing import PRICES, Price, with_cost
from .assemble import assemble, count_tokens
from .explain import explain
from .guard import action_rows, guard

LIMIT_REJECTED = "Token limit exceeded"


def construct(
    parts: DataFrame,
    calls: DataFrame,
    cfg: Config = Config(),
    prices: Sequence[Price] = PRICES,
    stage_path: str | None = None,
    staged: bool = True,
) -> dict[str, DataFrame]:
    """Construct every prompt of ``parts``; ``calls`` gives ``usage_id`` and optionally provider, model, endpoint,
    project_id, org_id and timestamp.

    Returns the tables ``usage_data`` (type ``construction``), ``prompt_variables``, ``variable_actions``,
    ``pii_hits``, ``security_alerts``, ``explain_plans``, ``prompts`` (messages, text, hash) and ``rejects``.
    """
    guarded = guard(parts, cfg, stage_path, staged)
    variables = count_tokens(guarded["parts"], cfg)
    prompts = assemble(variables)

    def given(name: str, default: str | None):
        fallback = F.lit(default).cast("string")
        if name not in calls.columns:
            return fallback.alias(name)
        return F.when(F.coalesce(name, F.lit("")) != "", F.col(name)).otherwise(fallback).alias(name)

    headers = calls.select(
        "usage_id",
        given("provider", cfg.default_provider),
        given("model", cfg.default_model),
        given("endpoint", None),
        given("project_id", cfg.default_project),
        given("org_id", cfg.default_org),
        (F.col("timestamp") if "timestamp" in calls.columns else F.current_timestamp()).alias("timestamp"),
    )
    rows = prompts.join(headers, "usage_id", "inner").withColumn(
        "token_limit_exceeded", F.col("total_tokens") > cfg.max_tokens
    )
    rejects = guarded["rejects"]
    if cfg.threshold_action == "reject":
        refused = rows.where("token_limit_exceeded").select("usage_id", F.lit(LIMIT_REJECTED).alias("reason"))
        rejects = rejects.unionByName(refused)
        rows = rows.where("not token_limit_exceeded")
        # Without this the children of refused prompts would still be logged.
        variables = variables.join(refused.select("usage_id"), "usage_id", "left_anti")
    rows = with_cost(rows, F.col("total_tokens"), F.lit(0), prices, names=("input_cost", "_unused")).drop("_unused")
    usage = rows.select(
        F.col("usage_id").alias("id"),
        "org_id",
        "project_id",
        F.lit("construction").alias("type"),
        "provider",
        "model",
        F.col("total_tokens").alias("input_tokens"),
        F.lit(0).cast("bigint").alias("output_tokens"),
        "total_tokens",
        "input_cost",
        F.lit(0.0).alias("output_cost"),
        F.col("input_cost").alias("total_cost"),
        "endpoint",
        "token_limit_exceeded",
        "timestamp",
    )
    tables = {
        "usage_data": usage,
        "prompt_variables": variables.select(
            "usage_id", "name", "content", "original_content", "token_count", "char_count", "position"
        ),
        "prompts": rows.select("usage_id", "messages", "full_prompt", "prompt_hash", "total_tokens"),
        "variable_actions": action_rows(guarded["actions"]),
        "pii_hits": guarded["pii_hits"],
        "security_alerts": guarded["alerts"],
        "rejects": rejects,
    }
    # The output count is unknown before the call, so explain falls back to its share of the total.
    tables["explain_plans"] = explain(usage.withColumn("input_tokens", F.lit(None).cast("bigint")), variables, prices)
    return tables
