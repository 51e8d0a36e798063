"""Scanners over a table of prompt parts ``(usage_id, position, name, content)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pii, threats
from ..functions.text import entropy as entropy_column

_PART = ("usage_id", "position", "name")


def explode_rows(df: DataFrame, keep: list, array: Column, name: str = "f") -> DataFrame:
    """One row per element of a computed array.

    A plain ``explode`` makes the optimizer add a filter on the array's size below it, which computes the array (and
    so scans the text) twice; the outer form does not.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def with_pii(parts: DataFrame, column: str = "content") -> DataFrame:
    """Add ``pii``: the findings of each part, as an array."""
    content = F.col(column)
    return (
        parts.withColumn("_low", F.lower(content))
        .withColumns(pii.hit_columns(content, F.col("_low")))
        .withColumn("pii", pii.pii_findings(content, pii.stored_hits()))
    )


def pii_findings(parts: DataFrame) -> DataFrame:
    """One row per personal-data finding: type, value and place in the text."""
    return (
        explode_rows(with_pii(parts), list(_PART), F.col("pii"))
        .select(*_PART, F.col("f.type").alias("type"), F.col("f.value").alias("value"), F.col("f.index").alias("index"))
    )


def mask_pii(parts: DataFrame) -> DataFrame:
    """Parts with personal data replaced by tags."""
    return (
        with_pii(parts)
        .withColumn("content", pii.mask_pii(F.col("content"), pii.stored_hits(), F.col("pii")))
        .select(*parts.columns)
    )


def _explode_findings(parts: DataFrame, findings) -> DataFrame:
    lowered = parts.withColumn("_low", F.lower("content"))
    keep = ["usage_id", "position", F.col("name").alias("target")]
    rows = explode_rows(lowered, keep, findings(F.col("content"), F.col("_low")))
    return rows.select("usage_id", "position", "target", "f.*")


def injection_findings(parts: DataFrame) -> DataFrame:
    """One row per part and injection rule that fires."""
    return _explode_findings(parts, threats.injection_findings).drop("match")


def secret_findings(parts: DataFrame) -> DataFrame:
    """One row per part and secret rule that fires, plus one per random-looking run."""
    return _explode_findings(parts, threats.secret_findings)


def finding_counts(parts: DataFrame) -> DataFrame:
    """Per prompt: ``pii_hits`` and ``security_alerts`` (injections and secrets), from one pass over the texts."""
    content, low = F.col("content"), F.col("_low")
    alerts = F.size(threats.injection_findings(content, low)) + F.size(threats.secret_findings(content, low))
    counted = with_pii(parts).select("usage_id", F.greatest(F.size("pii"), F.lit(0)).alias("hits"), F.greatest(alerts, F.lit(0)).alias("alerts"))
    return counted.groupBy("usage_id").agg(F.sum("hits").alias("pii_hits"), F.sum("alerts").alias("security_alerts"))


def entropy_tokens(parts: DataFrame) -> DataFrame:
    """Runs of key characters above the entropy limit, with their entropy."""
    rows = explode_rows(parts, list(_PART), threats.entropy_tokens(F.col("content")), "token")
    return rows.withColumn("entropy", entropy_column(F.col("token")))


def entropy(df: DataFrame, column: str) -> DataFrame:
    """Add the Shannon entropy of a string column, in bits per character."""
    return df.withColumn("entropy", entropy_column(F.col(column)))


def threat_flags(parts: DataFrame) -> DataFrame:
    """Per prompt: does any part carry a high or critical injection, or a critical secret?"""
    content, low = F.col("content"), F.col("_low")
    return (
        parts.withColumn("_low", F.lower("content"))
        .select(
            "usage_id",
            F.coalesce(
                threats.is_threat(
                    F.concat(threats.injection_findings(content, low), threats.secret_findings(content, low))
                ),
                F.lit(False),
            ).alias("threat"),
        )
        .groupBy("usage_id")
        .agg(F.bool_or("threat").alias("threat"))
    )
