"""From prompt parts to prompts: history expansion, token counts, messages, full text and hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text


def history_name(role: Column, index: Column) -> Column:
    """Part name of a history message."""
    return F.concat(F.lit("history_"), role, F.lit("_"), index.cast("string"))


def explode_history(prompts: DataFrame) -> DataFrame:
    """Prompts ``(usage_id, parts array<struct<name, content, messages array<struct<role, content>>>>)`` to rows.

    A part with messages becomes one part per message; positions count the expanded parts from 0. Row-local.
    """
    expanded = F.flatten(
        F.transform(
            "parts",
            lambda p: F.when(
                p["messages"].isNotNull(),
                F.transform(
                    p["messages"],
                    lambda m, i: F.struct(
                        history_name(m["role"], i).alias("name"), m["content"].alias("content")
                    ),
                ),
            ).otherwise(F.array(F.struct(p["name"].alias("name"), p["content"].alias("content")))),
        )
    )
    keep = [c for c in prompts.columns if c != "parts"]
    return prompts.select(*keep, F.posexplode(expanded).alias("position", "part")).select(
        *keep, "position", F.col("part.name").alias("name"), F.col("part.content").alias("content")
    )


def count_tokens(parts: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Add ``token_count`` and ``char_count``, and ``original_content`` where it is missing or empty."""
    content = F.col("content")
    tokens = text.token_count(content, cfg.token_mode)
    original = F.col("original_content") if "original_content" in parts.columns else F.lit(None).cast("string")
    return parts.withColumns(
        {
            "token_count": tokens,
            "char_count": F.coalesce(text.text_length(content), F.lit(0)),
            "original_content": F.when(F.coalesce(original, F.lit("")) == "", content).otherwise(original),
        }
    )


def message_role(name: Column) -> Column:
    """Role under which a part is sent."""
    return (
        F.when(name == "system", F.lit("system"))
        .when(F.startswith(name, F.lit("history_")), F.get(F.split(name, "_"), F.lit(1)))
        .otherwise(F.lit("user"))
    )


def prompt_tokens(parts: DataFrame) -> DataFrame:
    """Token total per prompt. Partial sums leave one row per prompt and task before the shuffle."""
    return parts.groupBy("usage_id").agg(F.sum("token_count").alias("total_tokens"))


def assemble(parts: DataFrame) -> DataFrame:
    """One row per prompt: ``full_prompt``, ``messages``, ``prompt_hash`` and ``total_tokens``.

    The parts of a prompt meet in one row because that row *is* the result: one text that is sent in one call.
    """
    ordered = F.array_sort(F.collect_list(F.struct("position", "name", F.coalesce("content", F.lit("")).alias("content"))))
    grouped = parts.groupBy("usage_id").agg(ordered.alias("_parts"), F.sum("token_count").alias("total_tokens"))
    return grouped.select(
        "usage_id",
        F.array_join(F.transform("_parts", lambda p: p["content"]), "\n\n").alias("full_prompt"),
        F.transform(
            "_parts",
            lambda p: F.struct(message_role(p["name"]).alias("role"), p["content"].alias("content")),
        ).alias("messages"),
        "total_tokens",
    ).withColumn("prompt_hash", F.sha2("full_prompt", 256))


def to_requests(assembled: DataFrame, style: str) -> DataFrame:
    """Messages in the shape of a provider's request: system text apart, the rest as ``contents`` or ``messages``."""
    system = F.get(
        F.transform(F.filter("messages", lambda m: m["role"] == "system"), lambda m: m["content"]), F.lit(0)
    )
    rest = F.filter("messages", lambda m: m["role"] != "system")
    if style == "gemini":
        return assembled.select(
            "usage_id",
            F.when(system != "", system).alias("system"),
            F.transform(
                rest,
                lambda m: F.struct(
                    F.when(m["role"] == "assistant", F.lit("model")).otherwise(F.lit("user")).alias("role"),
                    F.array(F.struct(m["content"].alias("text"))).alias("parts"),
                ),
            ).alias("contents"),
        )
    if style == "anthropic":
        return assembled.select("usage_id", system.alias("system"), rest.alias("messages"))
    if style == "openai":
        return assembled.select("usage_id", "messages")
    raise ValueError(f"unknown request style {style!r}")
