"""Running values over long, uneven histories.

A plain window over a key puts all rows of that key in one task. Here a key is cut into time buckets and a bucket into
``SLOTS`` slots: rows are summarised per (key, bucket, slot) with map-side partial aggregation, the summaries of a bucket
(at most ``SLOTS``) and those of a key's buckets are scanned in order, and each row adds the carry of both scans to what
it sees inside its own slot. Row-level windows therefore only ever hold one slot of one key, a second by default, so a
burst on one key is spread as well; only rows of one key with (almost) the same time meet. The result equals the plain
window. Rows without a time come before all others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


SLOTS = 3600


def _timed(df: DataFrame, ts: str, value: Column, seconds: int) -> DataFrame:
    """Add the value with its bucket and its slot in the bucket."""
    width = seconds * 1_000_000
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    within = F.pmod(micros, F.lit(width))
    return df.withColumns({
        "_value": value,
        "_bucket": ((micros - within) / F.lit(width)).cast("bigint"),
        "_slot": F.floor(within / F.lit(max(width // SLOTS, 1))).cast("bigint"),
    })


def _before(window):
    return window.rowsBetween(W.unboundedPreceding, -1)


def last_before(
    df: DataFrame, keys: Sequence[str], ts: str, tie: str, value: Column, name: str, bucket_seconds: int = 3600
) -> DataFrame:
    """Add ``name``: the last non-null ``value`` of earlier rows with the same (non-null) keys, by ``(ts, tie)``."""
    rows = _timed(df, ts, value, bucket_seconds)
    latest = F.max(F.when(F.col("_value").isNotNull(), F.struct(F.col(ts), F.col(tie), F.col("_value"))))
    return _with_carry(
        rows,
        latest,
        F.max("_summary"),
        keys,
        lambda w: F.last("_summary", ignorenulls=True).over(w)["_value"],
        lambda inner, near, far: F.coalesce(F.last("_value", ignorenulls=True).over(inner), near, far),
        ts,
        tie,
        name,
    )


def sum_before(
    df: DataFrame, keys: Sequence[str], ts: str, tie: str, value: Column, name: str, bucket_seconds: int = 3600
) -> DataFrame:
    """Add ``name``: the sum of ``value`` over earlier rows with the same (non-null) keys, by ``(ts, tie)``; 0 if none."""
    rows = _timed(df, ts, value, bucket_seconds)
    zero = F.lit(0)
    return _with_carry(
        rows,
        F.sum("_value"),
        F.sum("_summary"),
        keys,
        lambda w: F.sum("_summary").over(w),
        lambda inner, near, far: F.coalesce(F.sum("_value").over(inner), zero)
        + F.coalesce(near, zero)
        + F.coalesce(far, zero),
        ts,
        tie,
        name,
    )


def _with_carry(rows, summary, merge, keys, scan, combine, ts, tie, name) -> DataFrame:
    """Summarise slots and buckets, scan both in order, and join every slot's carries to its rows.

    The join and the row window share one partitioning by key, bucket and slot.
    """
    bucket, slot = [*keys, "_bucket"], [*keys, "_bucket", "_slot"]
    slots = rows.groupBy(*slot).agg(summary.alias("_summary"))
    buckets = slots.groupBy(*bucket).agg(merge.alias("_summary"))
    far = buckets.withColumn("_far", scan(_before(W.partitionBy(*keys).orderBy("_bucket")))).drop("_summary")
    near = slots.withColumn("_near", scan(_before(W.partitionBy(*bucket).orderBy("_slot")))).drop("_summary")
    inner = _before(W.partitionBy(*slot).orderBy(ts, tie))
    joined = rows.join(near.join(far, bucket, "left"), slot, "left")
    value = combine(inner, F.col("_near"), F.col("_far"))
    return joined.withColumn(name, value).drop("_bucket", "_slot", "_near", "_far", "_value")
