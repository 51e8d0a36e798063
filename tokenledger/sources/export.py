"""Exports of the newest usage rows as JSON lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import or_empty
from ..functions.pricing import PRICES, Price
from ..operators.listing import nest, recent

# Fixed values.
EXPORT_LIMIT = 1000
OUTPUT_PLACEHOLDER = "..."


def export_jsonl(
    usage: DataFrame,
    variables: DataFrame,
    plans: DataFrame,
    n: int = EXPORT_LIMIT,
    prices: Sequence[Price] = PRICES,
) -> DataFrame:
    """The newest ``n`` rows with parts and plan, one JSON text per row; write with ``df.write.text``."""
    rows = nest(recent(usage, n=n), variables, plans, prices)
    return rows.select("id", F.to_json(F.struct(*rows.columns)).alias("line"))


def export_traces(
    usage: DataFrame, variables: DataFrame, default_name: str = "gateway", n: int = EXPORT_LIMIT
) -> DataFrame:
    """The newest ``n`` rows as trace records; write with ``df.write.json``.

    ``inputs`` maps part names to contents; of parts with one name the last counts.
    """
    rows = recent(usage, n=n)
    inputs = (
        variables.join(rows.select(F.col("id").alias("usage_id")), "usage_id", "left_semi")
        .groupBy("usage_id", "name")
        .agg(F.max_by("content", "position").alias("content"), F.min("position").alias("position"))
        .groupBy("usage_id")
        .agg(
            F.map_from_entries(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("position", "name", "content"))),
                    lambda p: F.struct(p["name"], p["content"]),
                )
            ).alias("inputs")
        )
    )
    return rows.join(inputs, F.col("id") == F.col("usage_id"), "left").select(
        "id",
        or_empty(F.col("endpoint"), F.lit(default_name)).alias("name"),
        F.coalesce("inputs", F.expr("cast(map() as map<string,string>)")).alias("inputs"),
        F.struct(F.lit(OUTPUT_PLACEHOLDER).alias("content")).alias("outputs"),
        F.struct(
            F.col("input_tokens").alias("prompt_tokens"), F.col("output_tokens").alias("completion_tokens")
        ).alias("usage"),
        F.struct("model", "provider").alias("extra"),
    )
