"""Mixing sources to target weights.

Words are counted per source, each source gets a target number of words, and the ratio of target to size is the rate at
which its documents repeat. Every document is emitted floor(rate) times, plus one more copy if a coin, the hash of a seed and
its id, falls below the fraction of the rate. Each source tries ``TRIES`` seeds and takes the one that brings its words
nearest to the target, since a few long documents can carry a small source far from it.

Edge cases: a null or blank text has 0 words. A null source is a source of its own and comes last. A source without words
has target 0 and rate 0. Rows with the same doc_id (or a null one) share one coin. An empty table gives an empty table.
Other columns are carried along whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenledger.llm.tables import ROW, packed, stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
TRIES = 16


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def coin(key: Column, seed: str | Column) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone."""
    digits = F.substring(F.md5(F.concat(F.lit(seed) if isinstance(seed, str) else seed, F.lit(":"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, size)`` rows.

    Sources in code point order, null last, take the weights in turn and share ``share`` times all words by weight. No
    target passes ``cap`` times its source; what is cut off is shared again by weight among the rest, until nothing is.
    The loop runs over the table of sources in Spark; the driver holds three sums.
    """
    spark = sizes.sparkSession
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = totals.orderBy(F.col("source").asc_nulls_last())
    pattern = [float(w) for w in weights]
    ranked = ordered.rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], pattern[x[1] % len(pattern)]))
    table = stage(spark.createDataFrame(ranked, "source string, source_size long, weight double"), "mix-sources")
    limit = F.lit(cap) * F.col("source_size")

    words, weight = table.agg(F.sum("source_size"), F.sum("weight")).first()
    if not words:
        return table.select("source", "source_size", F.lit(0.0).alias("target"))
    budget, level, full = share * words, share * words / weight, -1
    while True:
        is_full = F.lit(level) * F.col("weight") >= limit
        count, taken, open_weight = table.agg(
            F.count_if(is_full),
            F.coalesce(F.sum(F.when(is_full, limit)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~is_full, F.col("weight"))), F.lit(0.0)),
        ).first()
        if count == full or not open_weight:
            break
        full, level = count, (budget - taken) / open_weight
    target = F.when(F.lit(level) * F.col("weight") >= limit, limit).otherwise(F.lit(level) * F.col("weight"))
    return table.select("source", "source_size", target.alias("target"))


def rates(sized: DataFrame, seed: str = "mix", sizes: DataFrame | None = None, **options) -> DataFrame:
    """``sized`` (with ``doc_id, source, size``) and, per row, its source's ``source_size`` and ``target`` and ``copies``.

    ``sizes`` is a stored table of the same three columns; without it, one is written. The table of sources is joined by
    Spark's own size check: broadcast while small, else a join that adaptive execution can split on a hot source.
    """
    if sizes is None:
        sizes = stage(sized.select("doc_id", "source", "size"), "mix-sizes")
    goal = targets(sizes, **options).withColumnsRenamed({"source": "goal_source"})
    goal = goal.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    same = F.col("source").eqNullSafe(F.col("goal_source"))
    fraction = F.col("rate") - F.floor("rate")

    drawn = [F.sum(F.when(coin(F.col("doc_id"), f"{seed}{k}") < fraction, F.col("size")).otherwise(0)).alias(f"drawn_{k}") for k in range(TRIES)]
    tried = sizes.join(goal, same).groupBy("goal_source", "source_size", "target", "rate").agg(*drawn)
    miss = [F.struct(F.abs(F.floor("rate") * F.col("source_size") + F.col(f"drawn_{k}") - F.col("target")), F.lit(k).alias("k")) for k in range(TRIES)]
    chosen = stage(tried.select("goal_source", "source_size", "target", "rate", F.array_min(F.array(*miss))["k"].alias("draw")), "mix-goals")

    extra = F.when(coin(F.col("doc_id"), F.concat(F.lit(seed), F.col("draw").cast("string"))) < fraction, 1).otherwise(0)
    joined = sized.join(chosen, same, "left")
    return joined.withColumn("copies", (F.floor("rate") + extra).cast("long")).drop("goal_source", "rate", "draw")


def mix(docs: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """The mixed corpus: every column of ``docs``, each row as many times as its copies."""
    row = packed(docs, F.col("doc_id"), F.col("source"), words_in(F.col("text")).alias("size"))
    repeated = rates(row, seed, **options).select(ROW, F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return repeated.select(f"{ROW}.*")
