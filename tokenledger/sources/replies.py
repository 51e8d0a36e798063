"""Raw provider replies to one shape: text and token counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pricing import canonical_provider

# Where each provider keeps its text and counts.
_GEMINI = (
    "candidates array<struct<content struct<parts array<struct<text string>>>, finishReason string>>, text string, "
    "usageMetadata struct<promptTokenCount bigint, candidatesTokenCount bigint>"
)
_ANTHROPIC = "content array<struct<text string>>, usage struct<input_tokens bigint, output_tokens bigint>"
_CHAT = (
    "choices array<struct<message struct<content string>, finish_reason string>>, "
    "usage struct<prompt_tokens bigint, completion_tokens bigint>"
)
GOOD_FINISH = ("STOP", "MAX_TOKENS")


def _first(array: str, field: str) -> Column:
    return F.get(F.col(array), F.lit(0))[field]


def read_replies(replies: DataFrame) -> DataFrame:
    """Add ``content, input_tokens, output_tokens, finish_reason, odd_finish`` to ``(id, provider, raw)``.

    Each reply is parsed once, with the schema of its provider.
    """
    family = canonical_provider(F.col("provider"))
    raw = F.col("raw")
    parsed = replies.withColumns(
        {
            "_g": F.from_json(F.when(family == "google", raw), _GEMINI),
            "_a": F.from_json(F.when(family == "anthropic", raw), _ANTHROPIC),
            "_c": F.from_json(F.when(~family.isin("google", "anthropic"), raw), _CHAT),
        }
    )
    parts = F.array_join(
        F.transform(
            F.coalesce(
                _first("_g.candidates", "content")["parts"],
                F.expr("cast(array() as array<struct<text:string>>)"),
            ),
            lambda p: F.coalesce(p["text"], F.lit("")),
        ),
        "",
    )
    gemini_text = F.when(parts != "", parts).otherwise(F.coalesce("_g.text", F.lit("")))
    return parsed.withColumns(
        {
            "content": F.when(family == "google", gemini_text)
            .when(family == "anthropic", _first("_a.content", "text"))
            .otherwise(_first("_c.choices", "message")["content"]),
            "input_tokens": F.coalesce(
                "_g.usageMetadata.promptTokenCount", "_a.usage.input_tokens", "_c.usage.prompt_tokens", F.lit(0)
            ).cast("bigint"),
            "output_tokens": F.coalesce(
                "_g.usageMetadata.candidatesTokenCount", "_a.usage.output_tokens", "_c.usage.completion_tokens", F.lit(0)
            ).cast("bigint"),
            "finish_reason": _first("_g.candidates", "finishReason"),
        }
    ).withColumn(
        "odd_finish", F.coalesce(~F.col("finish_reason").isin(*GOOD_FINISH), F.lit(False))
    ).drop("_g", "_a", "_c")


def normalize_replies(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replies with text, and apart from them the empty ones (which must not reach a cache) with the reason."""
    rows = read_replies(replies)
    empty = F.coalesce("content", F.lit("")) == ""
    dropped = rows.where(empty).withColumn(
        "reason",
        F.concat(
            F.lit("empty content (finishReason="), F.coalesce("finish_reason", F.lit("UNKNOWN")), F.lit(")")
        ),
    )
    return rows.where(~empty), dropped
