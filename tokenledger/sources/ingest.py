"""Ingest of client records into the tables of the usage log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.pricing import PRICES, Price, with_cost
from ..operators.scan import explode_rows, with_pii

# Fixed values.
INGESTED = "ingested"
INGEST_ACTION = "ingested_warning"
CLIENT_ENDPOINT = "sdk_standalone"

USAGE_COLUMNS = (
    "id", "org_id", "project_id", "type", "provider", "model", "full_prompt", "response_content", "input_tokens",
    "output_tokens", "total_tokens", "saved_tokens", "saved_cost", "input_cost", "output_cost", "total_cost",
    "endpoint", "latency_ms", "token_limit_exceeded", "timestamp",
)


def _given(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _text_or(df: DataFrame, name: str, default: Column) -> Column:
    value = _given(df, name, "string")
    return F.when(F.coalesce(value, F.lit("")) != "", value).otherwise(default)


def _number(df: DataFrame, name: str) -> Column:
    return F.coalesce(_given(df, name, "bigint").cast("bigint"), F.lit(0).cast("bigint"))


def usage_rows(
    raw: DataFrame, cfg: Config = Config(), prices: Sequence[Price] = PRICES, kind: str = INGESTED
) -> DataFrame:
    """Usage rows from client records: defaults, totals, costs and the limit flag. Row-local but for the price join.

    ``id`` must be set by the sender or generated upstream; a random id here would change when a task is retried.
    """
    null_text = F.lit(None).cast("string")
    rows = raw.select(
        "id",
        _text_or(raw, "org_id", F.lit(cfg.default_org)).alias("org_id"),
        _text_or(raw, "project_id", F.lit(cfg.default_project)).alias("project_id"),
        F.lit(kind).alias("type"),
        _text_or(raw, "provider", F.lit(cfg.default_provider)).alias("provider"),
        _text_or(raw, "model", F.lit(cfg.default_model)).alias("model"),
        _text_or(raw, "full_prompt", null_text).alias("full_prompt"),
        _text_or(raw, "response_content", null_text).alias("response_content"),
        _number(raw, "input_tokens").alias("input_tokens"),
        _number(raw, "output_tokens").alias("output_tokens"),
        _given(raw, "endpoint", "string").alias("endpoint"),
        _given(raw, "latency_ms", "double").cast("double").alias("latency_ms"),
        F.coalesce(_given(raw, "timestamp", "timestamp").cast("timestamp"), F.current_timestamp()).alias("timestamp"),
    )
    rows = with_cost(rows, prices=prices)
    total = F.col("input_tokens") + F.col("output_tokens")
    rows = rows.withColumns(
        {
            "total_tokens": total,
            "saved_tokens": F.lit(0).cast("bigint"),
            "saved_cost": F.lit(0.0),
            "total_cost": F.col("input_cost") + F.col("output_cost"),
            "token_limit_exceeded": total > cfg.max_tokens,
        }
    )
    return rows.select(*USAGE_COLUMNS)


def _time(raw: DataFrame) -> Column:
    """When a record was made; without a time, now."""
    return F.coalesce(_given(raw, "timestamp", "timestamp").cast("timestamp"), F.current_timestamp()).alias("timestamp")


def variable_rows(raw: DataFrame, timed: bool = False) -> DataFrame:
    """``prompt_variables`` rows from the nested ``variables`` of each record, missing fields as '' or 0.

    With ``timed`` they carry the record's ``timestamp``, for the hits found in them.
    """
    v, time = F.col("v"), ["timestamp"] if timed else []
    content = F.coalesce(v["content"], F.lit(""))
    rows = raw.select(F.col("id").alias("usage_id"), *([_time(raw)] if timed else []), F.explode("variables").alias("v"))
    return rows.select(
        "usage_id",
        *time,
        v["name"].alias("name"),
        content.alias("content"),
        F.when(F.coalesce(v["original_content"], F.lit("")) != "", v["original_content"])
        .otherwise(content)
        .alias("original_content"),
        *[F.coalesce(v[c], F.lit(0)).cast("int").alias(c) for c in ("token_count", "char_count", "position")],
    )


def pii_hit_rows(variables: DataFrame, action: str = INGEST_ACTION) -> DataFrame:
    """One ``pii_hits`` row per personal-data finding in the parts."""
    time = ["timestamp"] if "timestamp" in variables.columns else []
    return explode_rows(with_pii(variables), ["usage_id", *time, F.col("name").alias("variable_name")], F.col("pii")).select(
        "usage_id", "variable_name", F.col("f.type").alias("pii_type"), F.lit(action).alias("action_taken"), *time
    )


def action_rows(raw: DataFrame, timed: bool = False) -> DataFrame:
    """``variable_actions`` rows from the nested ``actions_taken``; ``details`` is the whole action as JSON."""
    time = ["timestamp"] if timed else []
    rows = raw.select(F.col("id").alias("usage_id"), *([_time(raw)] if timed else []), F.explode("actions_taken").alias("a"))
    return rows.select(
        "usage_id",
        F.col("a.target").alias("variable_name"),
        F.col("a.type").alias("action_type"),
        F.when(F.col("a.method") != "", F.col("a.method")).alias("action_method"),
        F.to_json("a").alias("details"),
        *time,
    )


def ingest_usage(
    raw: DataFrame, cfg: Config = Config(), prices: Sequence[Price] = PRICES
) -> dict[str, DataFrame]:
    """Tables from client records (``schema.INGEST_RECORD``): usage, parts, actions, and hits if PII checks are on."""
    tables = {"usage_data": usage_rows(raw, cfg, prices)}
    if "variables" in raw.columns:
        tables["prompt_variables"] = variable_rows(raw)
        if "pii" in cfg.formatting:
            tables["pii_hits"] = pii_hit_rows(variable_rows(raw, timed=True))
    if "actions_taken" in raw.columns:
        tables["variable_actions"] = action_rows(raw, timed=True)
    return tables


def report_records(results: DataFrame) -> DataFrame:
    """Ingest records from client results ``(id, project_id, provider, model, full_prompt_string, full_prompt,
    content, usage struct<input_tokens, output_tokens>, input_tokens, output_tokens, latency_ms, endpoint, ...)``.

    Token counts come from ``usage``, else from the top level, else 0; a count of 0 counts as missing.
    """

    def tokens(name: str) -> Column:
        nested = F.col(f"usage.{name}")
        return (
            F.when(F.coalesce(nested, F.lit(0)) != 0, nested)
            .otherwise(F.coalesce(_given(results, name, "bigint"), F.lit(0)))
            .cast("bigint")
            .alias(name)
        )

    prompt = _text_or(results, "full_prompt_string", _text_or(results, "full_prompt", F.lit(None).cast("string")))
    nested = [c for c in ("variables", "actions_taken") if c in results.columns]
    return results.select(
        "id",
        "project_id",
        "provider",
        "model",
        prompt.alias("full_prompt"),
        _text_or(results, "content", F.lit(None).cast("string")).alias("response_content"),
        tokens("input_tokens"),
        tokens("output_tokens"),
        F.coalesce(_given(results, "latency_ms", "double"), F.lit(0.0)).alias("latency_ms"),
        _text_or(results, "endpoint", F.lit(CLIENT_ENDPOINT)).alias("endpoint"),
        *nested,
        *(["timestamp"] if "timestamp" in results.columns else []),
    )
