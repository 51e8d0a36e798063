"""Price list, provider aliases, cost and alternatives as columns.

The price list is configuration: a few dozen rows that travel inside the plan. Cost uses a join with a local
relation (Catalyst sees its size and broadcasts it); alternatives are computed inside the row, so no usage row is ever
multiplied or shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ALTERNATIVE


class Price(NamedTuple):
    """USD per million tokens. The place in the list (``ord``) breaks cost ties."""

    ord: int
    provider: str
    model: str
    input_rate: float
    output_rate: float
    deprecated: bool


# Place, provider, model, input rate, output rate, retired or not.
PRICES: tuple[Price, ...] = (
    Price(0, "openai", "o3-2025-12-15", 2.00, 8.00, False),
    Price(1, "openai", "gpt-5.2-preview", 1.75, 14.00, False),
    Price(2, "openai", "o4-mini", 0.15, 0.60, False),
    Price(3, "openai", "gpt-4o", 2.50, 10.00, True),
    Price(4, "openai", "gpt-4o-mini", 0.15, 0.60, True),
    Price(5, "anthropic", "claude-4-6-opus", 5.00, 25.00, False),
    Price(6, "anthropic", "claude-4-6-sonnet", 3.00, 15.00, False),
    Price(7, "anthropic", "claude-4-5-haiku", 1.00, 5.00, False),
    Price(8, "anthropic", "claude-3-5-sonnet-latest", 3.00, 15.00, True),
    Price(9, "google", "gemini-3-pro-001", 2.00, 12.00, False),
    Price(10, "google", "gemini-3-flash", 0.50, 3.00, False),
    Price(11, "google", "gemini-3-flash-preview", 0.50, 3.00, False),
    Price(12, "google", "gemini-3.5-flash", 1.50, 9.00, False),
    Price(13, "google", "gemini-2.5-pro", 1.25, 10.00, False),
    Price(14, "google", "gemini-2.5-flash", 0.30, 2.50, False),
    Price(15, "google", "gemini-2.5-flash-lite", 0.10, 0.40, False),
    Price(16, "google", "gemini-1.5-pro", 1.25, 3.75, True),
    Price(17, "google", "gemini-1.5-flash", 0.075, 0.30, True),
    Price(18, "deepseek", "deepseek-reasoner", 0.55, 2.19, False),
    Price(19, "deepseek", "deepseek-chat", 0.27, 1.10, False),
    Price(20, "mistral", "mistral-large-2601", 2.00, 6.00, False),
    Price(21, "mistral", "magistral-beta", 4.00, 12.00, False),
    Price(22, "mistral", "ministral-3-14b", 0.10, 0.10, False),
    Price(23, "meta", "llama-4-405b", 5.00, 15.00, False),
    Price(24, "meta", "llama-4-maverick-17b", 0.20, 0.50, False),
    Price(25, "amazon", "amazon.nova-premier-v1", 2.50, 12.50, False),
    Price(26, "amazon", "amazon.nova-micro-v1", 0.05, 0.20, False),
    Price(27, "alibaba", "qwen-3.5-omni", 0.70, 8.40, False),
    Price(28, "alibaba", "qwen3-coder-32b", 0.50, 2.00, False),
    Price(29, "xai", "grok-4", 3.00, 15.00, False),
    Price(30, "xai", "grok-4-fast", 0.20, 0.50, False),
    Price(31, "cohere", "command-r7-plus", 3.00, 15.00, False),
)

# Provider aliases.
PROVIDER_ALIASES = {
    "gemini": "google",
    "gcp": "google",
    "openai-api": "openai",
    "claude": "anthropic",
    "aws": "amazon",
    "bedrock": "amazon",
}


def _sql_text(text: str) -> str:
    """A string literal; a price list is a user's and may hold any character."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def price_frame(spark: SparkSession, prices: Sequence[Price] = PRICES) -> DataFrame:
    """The list as a local relation ``(ord, provider, model, input_rate, output_rate, deprecated)``."""
    models = [(p.provider, p.model) for p in prices]
    if len(set(models)) < len(models):
        raise ValueError("a model is on the price list twice")
    rows = ", ".join(
        f"({p.ord}, {_sql_text(p.provider)}, {_sql_text(p.model)}, {p.input_rate!r}D, {p.output_rate!r}D, {str(p.deprecated).lower()})"
        for p in prices
    )
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(ord, provider, model, input_rate, output_rate, deprecated)")


def canonical_provider(provider: Column) -> Column:
    """Lower-cased provider with aliases resolved."""
    lowered = F.lower(provider)
    resolved = lowered
    for alias, name in PROVIDER_ALIASES.items():
        resolved = F.when(lowered == alias, F.lit(name)).otherwise(resolved)
    return resolved


def token_cost(tokens: Column, rate: Column) -> Column:
    """Cost of ``tokens`` at ``rate`` per million, in the order of operations the log uses."""
    return (tokens / F.lit(1_000_000.0)) * rate


def with_cost(
    df: DataFrame,
    input_tokens: Column | None = None,
    output_tokens: Column | None = None,
    prices: Sequence[Price] = PRICES,
    provider: str = "provider",
    model: str = "model",
    names: tuple[str, str] = ("input_cost", "output_cost"),
) -> DataFrame:
    """Add input and output cost; an unknown provider or model costs 0."""
    tokens_in = F.col("input_tokens") if input_tokens is None else input_tokens
    tokens_out = F.col("output_tokens") if output_tokens is None else output_tokens
    rates = price_frame(df.sparkSession, prices).select(
        F.col("provider").alias("_rate_provider"),
        F.col("model").alias("_rate_model"),
        F.col("input_rate").alias("_rate_in"),
        F.col("output_rate").alias("_rate_out"),
    )
    joined = df.join(
        rates,
        (canonical_provider(F.col(provider)) == F.col("_rate_provider"))
        & (F.lower(F.col(model)) == F.col("_rate_model")),
        "left",
    )
    zero = F.lit(0.0)
    return joined.withColumns(
        {
            names[0]: F.coalesce(token_cost(tokens_in, F.col("_rate_in")), zero),
            names[1]: F.coalesce(token_cost(tokens_out, F.col("_rate_out")), zero),
        }
    ).drop("_rate_provider", "_rate_model", "_rate_in", "_rate_out")


def _candidates(prices: Sequence[Price], providers: Sequence[str] | None) -> list[Price]:
    """Models that may be offered. An allow-list is taken literally, in its own order, without aliases."""
    offered = [p for p in prices if not p.deprecated]
    if not providers:
        return offered
    return [p for name in providers for p in offered if p.provider == name]


# Columns every offer is priced from, and the row's own model in canonical form (a missing name matches no offer).
_OWN = ("_own_provider", "_own_model")


def _with_own(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            _OWN[0]: F.coalesce(canonical_provider(F.col("provider")), F.lit("")),
            _OWN[1]: F.coalesce(F.lower("model"), F.lit("")),
        }
    )


def _cost_sql(p: Price) -> str:
    return f"(input_tokens / 1e6D) * {p.input_rate!r}D + (output_tokens / 1e6D) * {p.output_rate!r}D"


def add_alternatives(
    df: DataFrame,
    current_cost: Column,
    prices: Sequence[Price] = PRICES,
    providers: Sequence[str] | None = None,
    name: str = "alternatives",
) -> DataFrame:
    """Add an array of the other current models by rising cost: ``(model, provider, cost, savingsPct)``.

    Costs are one array of doubles, zipped with the places in the list and sorted; names are looked up by place at the
    end. Building a struct per offer instead makes one generated method too long for the JIT, at six times the time.
    """
    offers = _candidates(prices, providers)
    if not offers:
        return df.withColumn(name, F.expr(f"cast(array() as array<{ALTERNATIVE}>)"))
    costs = ", ".join(_cost_sql(p) for p in offers)
    labels = ", ".join(f"struct({_sql_text(p.model)} AS model, {_sql_text(p.provider)} AS provider)" for p in offers)
    listed = f"""transform(
        filter(_sorted, o -> NOT (array({labels})[o._places].model = _own_model
                                  AND array({labels})[o._places].provider = _own_provider)),
        o -> struct(
            array({labels})[o._places].model AS model,
            array({labels})[o._places].provider AS provider,
            o._costs AS cost,
            CASE WHEN _current > 0 THEN (_current - o._costs) / _current * 100 ELSE 0.0D END AS savingsPct))"""
    return (
        _with_own(df)
        .withColumns(
            {
                "_current": current_cost,
                "_costs": F.expr(f"array({costs})"),
                "_places": F.sequence(F.lit(0), F.lit(len(offers) - 1)),
            }
        )
        .withColumn("_sorted", F.sort_array(F.arrays_zip("_costs", "_places")))
        .withColumn(name, F.expr(listed))
        .drop(*_OWN, "_current", "_costs", "_places", "_sorted")
    )


def _possible_winners(offers: Sequence[Price]) -> list[tuple[int, Price]]:
    """Places and offers that can be cheapest for some token counts (none negative) and some own model.

    An offer is out if two others are never dearer and win every tie: cheaper in both rates, or no dearer in either
    and earlier in the list. Two, as one of them may be the row's own model. The first two places stay, because
    without any tokens all costs are equal.
    """

    def beats(i: int, j: int) -> bool:
        a, b = offers[i], offers[j]
        cheaper = a.input_rate < b.input_rate and a.output_rate < b.output_rate
        return cheaper or (i < j and a.input_rate <= b.input_rate and a.output_rate <= b.output_rate)

    return [
        (j, offer)
        for j, offer in enumerate(offers)
        if j < 2 or sum(beats(i, j) for i in range(len(offers)) if i != j) < 2
    ]


def add_best_offer(
    df: DataFrame,
    prices: Sequence[Price] = PRICES,
    providers: Sequence[str] | None = None,
    name: str = "best",
) -> DataFrame:
    """Add the cheapest other model as ``(cost, place, model, provider)``, null if there is none.

    Only offers that can win are compared, and ``least`` over plain structs stays in generated code.
    """
    offers = _candidates(prices, providers)
    if not offers:
        nothing = F.lit(None).cast("struct<cost:double,place:int,model:string,provider:string>")
        return df.withColumn(name, nothing)
    options = [
        f"CASE WHEN NOT (_own_model = {_sql_text(p.model)} AND _own_provider = {_sql_text(p.provider)}) THEN "
        f"struct({_cost_sql(p)} AS cost, {place} AS place, {_sql_text(p.model)} AS model, {_sql_text(p.provider)} AS provider) END"
        for place, p in _possible_winners(offers)
    ]
    best = f"least({', '.join(options)})" if len(options) > 1 else options[0]
    return _with_own(df).withColumn(name, F.expr(best)).drop(*_OWN)
