"""Replay of a response cache over a log of calls, and the cost rows it gives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.pricing import PRICES, Price, with_cost
from .running import last_before


def _flag(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False)) if name in df.columns else F.lit(False)


def find_hits(calls: DataFrame, keys: Sequence[str] = ("prompt_hash",), bucket_seconds: int = 3600) -> DataFrame:
    """Add ``cached_usage_id``: the call whose stored reply answers this one, null for a miss.

    ``calls``: ``id, timestamp, response_content``, the key columns and optionally ``bypass`` (never answered from the
    cache, but its reply is stored) and ``streamed`` (neither reads nor stores).

    A reply is stored only by a call that was itself a miss, so the stored reply is the first non-empty one of the
    key, or the latest later one of a bypassing call. The first is a plain aggregate (one row per key after map-side
    combine); the join back is on the key, where a hot key is split by adaptive execution. Only when ``bypass`` exists
    are running values needed.
    """
    streamed, bypass = _flag(calls, "streamed"), _flag(calls, "bypass")
    at = F.struct(F.col("timestamp").alias("timestamp"), F.col("id").alias("id"))
    stores = ~streamed & (F.coalesce("response_content", F.lit("")) != "")
    firsts = calls.where(stores).groupBy(*keys).agg(F.min(at).alias("_first"))
    joined = calls.join(firsts, list(keys), "left")
    answered = ~streamed & ~bypass & (at > F.col("_first"))
    if "bypass" not in calls.columns:
        cached = F.when(answered, F.col("_first.id"))
        return joined.withColumn("cached_usage_id", cached).drop("_first")
    renewed = last_before(
        joined, keys, "timestamp", "id", F.when(bypass & stores, F.col("id")), "_renewed", bucket_seconds
    )
    cached = F.when(answered, F.coalesce("_renewed", "_first.id"))
    return renewed.withColumn("cached_usage_id", cached).drop("_first", "_renewed")


def replay_cache(
    calls: DataFrame,
    cfg: Config = Config(),
    keys: Sequence[str] = ("prompt_hash",),
    prices: Sequence[Price] = PRICES,
    bucket_seconds: int = 3600,
) -> DataFrame:
    """Usage rows as they would have been logged with the cache on.

    Besides the columns of :func:`find_hits` a call has ``provider, model, prompt_tokens`` (local count),
    ``input_tokens, output_tokens`` (as billed) and optionally ``saved_chars`` (of the first compressed part).
    A hit costs nothing and saves its prompt; a miss is an execution that saves what compression removed.
    """
    found = find_hits(calls, keys, bucket_seconds)
    hit = F.col("cached_usage_id").isNotNull()
    saved_chars = F.coalesce(F.col("saved_chars"), F.lit(0)) if "saved_chars" in calls.columns else F.lit(0)
    billed_in, billed_out = F.coalesce("input_tokens", F.lit(0)), F.coalesce("output_tokens", F.lit(0))
    rows = found.withColumns(
        {
            "type": F.when(hit, F.lit("cache_hit")).otherwise(F.lit("execution")),
            "saved_tokens": F.when(hit, F.col("prompt_tokens")).otherwise(compression_tokens(saved_chars)).cast("bigint"),
            "input_tokens": F.when(hit, F.lit(0)).otherwise(billed_in).cast("bigint"),
            "output_tokens": F.when(hit, F.lit(0)).otherwise(billed_out).cast("bigint"),
        }
    )
    rows = with_cost(rows, prices=prices)
    rows = with_cost(rows, F.col("saved_tokens"), F.lit(0), prices, names=("saved_cost", "_unused")).drop("_unused")
    total = F.col("input_tokens") + F.col("output_tokens")
    return rows.withColumns(
        {
            "total_tokens": total,
            "total_cost": F.col("input_cost") + F.col("output_cost"),
            "token_limit_exceeded": total > cfg.max_tokens,
        }
    )


def compression_tokens(saved_chars: Column) -> Column:
    """Tokens saved by compression: a quarter of the characters, rounded up."""
    return F.ceil(saved_chars / 4)


def compression_savings(actions: DataFrame, usage: DataFrame, prices: Sequence[Price] = PRICES) -> DataFrame:
    """Per usage: characters saved by its *first* compressed part, the tokens and the input cost that makes."""
    first = (
        actions.where("type = 'compress'")
        .groupBy("usage_id")
        .agg(F.min_by("saved_chars", "position").alias("saved_chars"))
    )
    rows = (
        usage.select(F.col("id").alias("usage_id"), "provider", "model")
        .join(first, "usage_id", "left")
        .withColumn("saved_chars", F.coalesce("saved_chars", F.lit(0)))
        .withColumn("saved_tokens", compression_tokens(F.col("saved_chars")).cast("bigint"))
    )
    return with_cost(rows, F.col("saved_tokens"), F.lit(0), prices, names=("saved_cost", "_unused")).drop("_unused")


def lookup_cache(prompts: DataFrame, cache: DataFrame) -> DataFrame:
    """Prompts with the stored reply of their hash; ``cached`` tells whether there is one."""
    stored = cache.select(
        "prompt_hash",
        F.col("response_content").alias("cached_response"),
        F.col("usage_id").alias("cached_usage_id"),
    )
    return prompts.join(stored, "prompt_hash", "left").withColumn("cached", F.col("cached_usage_id").isNotNull())


def upsert_cache(cache: DataFrame, new: DataFrame) -> DataFrame:
    """Cache after storing ``new`` replies: the last one per hash wins, empty replies are not stored.

    ``max_by`` keeps one row per hash and task before the shuffle, so a hot hash costs no more than a rare one.
    """
    columns = ["prompt_hash", "response_content", "usage_id", "timestamp"]
    kept = new.where("coalesce(response_content, '') <> ''").select(*columns)
    return (
        cache.select(*columns)
        .unionByName(kept)
        .groupBy("prompt_hash")
        .agg(F.max(F.struct("timestamp", "usage_id", "response_content")).alias("_last"))
        .select("prompt_hash", "_last.response_content", "_last.usage_id", "_last.timestamp")
    )
