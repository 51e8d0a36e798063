"""Cost of usage rows and what other models would have cost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.pricing import (
    PRICES,
    Price,
    add_alternatives,
    add_best_offer,
    canonical_provider,
    price_frame,
    with_cost,
)


def cost(usage: DataFrame, cfg: Config = Config(), prices: Sequence[Price] = PRICES) -> DataFrame:
    """Add ``input_cost, output_cost, total_cost`` and ``token_limit_exceeded``."""
    return with_cost(usage, prices=prices).withColumns(
        {
            "total_cost": F.col("input_cost") + F.col("output_cost"),
            "token_limit_exceeded": (F.col("input_tokens") + F.col("output_tokens")) > cfg.max_tokens,
        }
    )


def with_alternatives(
    usage: DataFrame, prices: Sequence[Price] = PRICES, providers: Sequence[str] | None = None
) -> DataFrame:
    """Add ``alternatives``: every other current model by rising cost, with the saving against this row's model."""
    priced = with_cost(usage, prices=prices, names=("_cost_in", "_cost_out"))
    current = F.col("_cost_in") + F.col("_cost_out")
    return add_alternatives(priced, current, prices, providers).drop("_cost_in", "_cost_out")


def alternatives(
    usage: DataFrame, prices: Sequence[Price] = PRICES, providers: Sequence[str] | None = None
) -> DataFrame:
    """One row per usage and alternative; ``rank`` counts from 0 by rising cost."""
    # The outer form: a plain explode adds a filter on the list's size, which computes the list twice.
    rows = with_alternatives(usage, prices, providers).select("id", F.posexplode_outer("alternatives").alias("rank", "a"))
    return rows.where("a is not null").select(
        "id", "rank", "a.model", "a.provider", "a.cost", F.col("a.savingsPct").alias("savings_pct")
    )


def with_best_offer(
    usage: DataFrame, prices: Sequence[Price] = PRICES, providers: Sequence[str] | None = None, name: str = "best"
) -> DataFrame:
    """Add the cheapest alternative as a struct, without building the whole list."""
    return add_best_offer(usage, prices, providers, name)


def best_alternative(
    usage: DataFrame, prices: Sequence[Price] = PRICES, providers: Sequence[str] | None = None
) -> DataFrame:
    """Cheapest alternative per usage row with the saving in percent of the recomputed current cost."""
    priced = with_cost(usage, prices=prices, names=("_cost_in", "_cost_out"))
    current = F.col("_cost_in") + F.col("_cost_out")
    return with_best_offer(priced, prices, providers).select(
        "id",
        F.col("best.model").alias("best_model"),
        F.col("best.provider").alias("best_provider"),
        F.col("best.cost").alias("best_cost"),
        F.when(current > 0, (current - F.col("best.cost")) / current * 100)
        .otherwise(F.lit(0.0))
        .alias("savings_pct"),
    )


def normalized_provider(usage: DataFrame) -> DataFrame:
    """Add ``canonical_provider``."""
    return usage.withColumn("canonical_provider", canonical_provider(F.col("provider")))


def retired_models(usage: DataFrame, prices: Sequence[Price] = PRICES) -> DataFrame:
    """Usage rows on a retired model. The provider is only lower-cased here, aliases do not count."""
    retired = (
        price_frame(usage.sparkSession, prices)
        .where("deprecated")
        .select(F.col("provider").alias("_p"), F.col("model").alias("_m"))
    )
    return usage.join(
        retired, (F.lower("provider") == F.col("_p")) & (F.lower("model") == F.col("_m")), "left_semi"
    )
