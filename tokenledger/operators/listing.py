"""Listings of recent usage with nested parts and plans, filtered, sorted and paged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import to_fixed
from ..functions.pricing import PRICES, Price
from ..session import stage
from .explain import backfill_plans
from .reports import scope

# Listing defaults.
RECENT_LIMIT = 50
PAGE_SIZE = 10

_ORDERS = {
    "date": [F.desc, "timestamp"],
    "tokens": [F.desc, "total_tokens"],
    "cost": [F.desc, "total_cost"],
}
VARIABLE_FIELDS = ("name", "content", "original_content", "token_count", "char_count", "position")


def _order(sort: str) -> list[Column]:
    direction, column = _ORDERS[sort]
    return [direction(column), F.col("id")]


def recent(usage: DataFrame, org: str | None = None, project: str | None = None, n: int = RECENT_LIMIT) -> DataFrame:
    """The newest ``n`` usage rows (a top-n over tasks, no full sort)."""
    return scope(usage, org, project).orderBy(*_order("date")).limit(n)


def newest(usage: DataFrame, variables: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The newest ``n`` usage rows and their parts, written once to the shared folder.

    Explaining, nesting and listing then read these few rows and not the log again.
    """
    rows = stage(recent(usage, n=n), "newest")
    own = variables.join(rows.select(F.col("id").alias("usage_id")), "usage_id", "left_semi")
    return rows, stage(own, "newest-parts")


def page(usage: DataFrame, number: int, sort: str = "date", size: int = PAGE_SIZE) -> DataFrame:
    """Page ``number`` (from 1) of the rows in the given order."""
    return usage.orderBy(*_order(sort)).offset((number - 1) * size).limit(size)


def page_mark(rows: DataFrame, sort: str = "date") -> tuple | None:
    """Where a page ends: the sort value and id of its last row, for :func:`page_after`; None for an empty page.

    ``rows`` is a page, so the one row that comes to the driver is taken from few.
    """
    column = _ORDERS[sort][1]
    last = rows.orderBy(F.col(column).asc_nulls_first(), F.col("id").desc()).select(column, "id").first()
    return tuple(last) if last else None


def page_after(usage: DataFrame, mark: tuple | None = None, sort: str = "date", size: int = PAGE_SIZE) -> DataFrame:
    """The ``size`` rows behind ``mark`` (value and id of the last row seen; None for the first page), in the order of
    :func:`page`.

    However deep the page, a task keeps ``size`` rows. The range of the value reaches the scan, and a log laid out by day
    is read only up to the day of the mark. Rows without a value come last, by id; ids are unique and not null.
    """
    direction, column = _ORDERS[sort]
    if mark is not None:
        value, last = mark
        behind = F.col(column).isNull() & (F.col("id") > F.lit(last))
        if value is not None:
            at = F.lit(value)
            ties = (F.col(column) < at) | (F.col("id") > F.lit(last))
            behind = F.col(column).isNull() | ((F.col(column) <= at) & ties)
            if sort == "date" and "date" in usage.columns:
                usage = usage.where((F.col("date") <= F.to_date(at)) | F.col("date").isNull())
        usage = usage.where(behind)
    return usage.orderBy(direction(column), F.col("id")).limit(size)


def page_count(usage: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    """One row: rows and pages."""
    return usage.agg(F.count("*").alias("rows")).withColumn("pages", F.ceil(F.col("rows") / size).cast("bigint"))


def first_plans(plans: DataFrame) -> DataFrame:
    """One plan per usage row: the first by id. Its fields are null if no plan has an id.

    The first rows are taken as they are and packed last, so that the optimizer drops the fields that the caller does not
    read, and all that is only computed for them. Each task passes on one row of a usage at most.
    """
    place = F.row_number().over(Window.partitionBy("usage_id").orderBy(F.asc_nulls_last("id")))
    first = plans.withColumn("_place", place).where("_place = 1")
    others = [F.when(F.col("id").isNotNull(), F.col(c)).alias(c) for c in plans.columns if c not in ("usage_id", "id")]
    return first.select("usage_id", F.struct("id", *others).alias("explain_plan"))


def nest_variables(variables: DataFrame) -> DataFrame:
    """Parts of each usage as an array in position order."""
    ordered = F.array_sort(F.collect_list(F.struct("position", *[c for c in VARIABLE_FIELDS if c != "position"])))
    return variables.groupBy("usage_id").agg(ordered.alias("variables"))


def nest(usage: DataFrame, variables: DataFrame, plans: DataFrame, prices: Sequence[Price] = PRICES) -> DataFrame:
    """Usage rows with their ``variables`` and ``explain_plan`` (gaps of the plan filled in); nulls where none exist.

    Meant for a page of rows: children are first reduced to those of the page by semi-joins, whose small side Catalyst
    broadcasts when its size allows, and only then grouped.
    """
    ids = usage.select(F.col("id").alias("usage_id"))
    own_plans = backfill_plans(plans.join(ids, "usage_id", "left_semi"), usage, prices)
    plan = F.when(F.col("explain_plan.id").isNotNull(), F.col("explain_plan"))
    nested_plans = first_plans(own_plans).select(F.col("usage_id").alias("_plan_usage"), plan.alias("explain_plan"))
    nested_parts = nest_variables(variables.join(ids, "usage_id", "left_semi")).withColumnRenamed(
        "usage_id", "_part_usage"
    )
    return (
        usage.join(nested_parts, F.col("id") == F.col("_part_usage"), "left")
        .join(nested_plans, F.col("id") == F.col("_plan_usage"), "left")
        .drop("_part_usage", "_plan_usage")
    )


def filter_rows(usage: DataFrame, provider: str | None = None, endpoint: str | None = None) -> DataFrame:
    """Rows of a provider and with an endpoint containing a text (a null endpoint never does)."""
    if provider:
        usage = usage.where(F.col("provider") == provider)
    if endpoint:
        usage = usage.where(F.contains("endpoint", F.lit(endpoint)))
    return usage


def recommended(plans: DataFrame) -> DataFrame:
    """Plans that recommend something: a better model, an issue or a suggestion."""
    return plans.where(
        (F.coalesce("mce_best_alternative_model", F.lit("")) != "")
        | (F.coalesce(F.size("detected_issues"), F.lit(0)) > 0)
        | (F.coalesce(F.size("optimization_suggestions"), F.lit(0)) > 0)
    )


def listing(
    usage: DataFrame,
    variables: DataFrame,
    plans: DataFrame,
    provider: str | None = None,
    endpoint: str | None = None,
    only_recommended: bool = False,
    sort: str = "date",
    number: int = 1,
    limit: int = RECENT_LIMIT,
    size: int = PAGE_SIZE,
    prices: Sequence[Price] = PRICES,
) -> DataFrame:
    """One page of the newest ``limit`` rows, filtered, sorted and with nested parts and plan."""
    rows = nest(filter_rows(recent(usage, n=limit), provider, endpoint), variables, plans, prices)
    if only_recommended:
        plan = F.col("explain_plan")
        rows = rows.where(
            (F.coalesce(plan["mce_best_alternative_model"], F.lit("")) != "")
            | (F.coalesce(F.size(plan["detected_issues"]), F.lit(0)) > 0)
            | (F.coalesce(F.size(plan["optimization_suggestions"]), F.lit(0)) > 0)
        )
    return page(rows, number, sort, size)


def cost_text(cost: str) -> Column:
    """Text of a cost column for display: 0 as ``0.00``, below a cent with 6 decimals, else with 2."""
    value = F.expr(cost)
    return F.when(value == 0, F.lit("0.00")).when(value < 0.01, to_fixed(cost, 6)).otherwise(to_fixed(cost, 2))


def terminal_rows(usage: DataFrame) -> DataFrame:
    """Short id, model, tokens and cost with 4 decimals."""
    return usage.select(
        F.substring("id", 1, 8).alias("short_id"),
        "model",
        "total_tokens",
        F.concat(F.lit("$"), to_fixed("total_cost", 4)).alias("cost"),
    )


def size_reduction(variables: DataFrame) -> DataFrame:
    """Add ``reduced_pct``: how much shorter a part got, null unless it did (both texts non-empty)."""
    before, after = F.length("original_content"), F.length("content")
    return variables.withColumn(
        "reduced_pct",
        F.when((after > 0) & (before > after), F.floor((1 - after / before) * 100 + 0.5).cast("int")),
    )


def with_analysis(variables: DataFrame, plans: DataFrame) -> DataFrame:
    """Parts with the analysis of the same name in their plan (the first one if a name repeats)."""
    rows = (
        plans.select("usage_id", F.posexplode_outer("variable_analysis").alias("place", "a"))
        .where("a is not null")
        .groupBy("usage_id", F.col("a.variable_name").alias("name"))
        .agg(F.min(F.struct("place", "a")).alias("_first"))
        .select(
            "usage_id",
            "name",
            F.col("_first.a.percentage").alias("percentage"),
            F.col("_first.a.waste_reason").alias("waste_reason"),
            F.col("_first.a.recommendation").alias("recommendation"),
        )
    )
    return variables.join(rows, ["usage_id", "name"], "left")
