"""Explain plans: where the tokens of a call go, what is wasted, and which model would be cheaper."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.numbers import fixed_sql, or_zero, script_number, to_fixed
from ..functions.pricing import PRICES, Price, add_alternatives, add_best_offer, price_frame, with_cost
from ..functions.text import SPACE

# Thresholds in percent, and the points each problem adds to the estimated saving.
MIN_MIGRATION_SAVING = 10
DOMINANCE_PCT, DOMINANCE_POINTS = 75, 20
DISCREPANCY_PCT = 120
CONTEXT_PCT, CONTEXT_POINTS = 60, 15
HISTORY_PCT, HISTORY_POINTS = 40, 10
WASTE_PCT = 5
MAX_SAVING_PCT = 90

# Wording of the findings.
RETIRED_ADVICE = "Migrate to a current stable model (e.g., Gemini 2.0 Flash) to ensure service continuity."
DOMINANCE_REASON = "Extreme dominance in prompt composition."
DOMINANCE_FIX = "Implement semantic summarization (Action: Dev required)."
DISCREPANCY_ADVICE = (
    "The LLM provider's tokenizer is significantly more efficient for this language than the local fallback. "
    "Trust the provider's 'Input Tokens' for billing, but use this breakdown for relative weighting."
)
CONTEXT_REASON = "Context size may exceed actual relevance thresholds."
CONTEXT_FIX = "Implement re-ranking or top-k reduction."
CONTEXT_ADVICE = "Use more selective retrieval or re-rank results to reduce context size."
HISTORY_REASON = "Long conversation history causing token pressure."
HISTORY_FIX = "Use sliding window or turn summarization."
HISTORY_ADVICE = "Implement a sliding window or summarize old conversation turns."
WASTE_REASON = "Excessive whitespace/formatting bloat."
WASTE_FIX = "Enable lossless compression for this project."


def whitespace_waste(content: Column) -> Column:
    """Percent of a text that is redundant white space; null unless it contains two spaces in a row."""
    size = F.length(content)
    # A single white space character keeps the length when it is replaced by a space.
    cleaned = F.length(F.regexp_replace(content, rf"[{SPACE}]{{2,}}", " "))
    return F.when(F.contains(content, F.lit("  ")), (size - cleaned) / F.greatest(size, F.lit(1)) * 100)


def part_facts(variables: DataFrame) -> DataFrame:
    """The narrow row explain needs of each part. Texts stay behind: only their waste figure is shuffled."""
    return variables.select(
        "usage_id", "position", "name", "token_count", whitespace_waste(F.col("content")).alias("waste_pct")
    )


# Tests on one part ``p`` whose shares are known.
_DOMINANT = f"p.pct > {DOMINANCE_PCT}"
_DISCREPANT = f"p.raw > {DISCREPANCY_PCT}"
_BLOATED = f"p.name = 'context' AND p.pct > {CONTEXT_PCT}"
_AGED = f"startswith(p.name, 'history') AND p.pct > {HISTORY_PCT}"
_WASTEFUL = f"coalesce(p.waste_pct > {WASTE_PCT}, false)"


def _sql_text(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _sentence(*pieces: str) -> str:
    return f"concat({', '.join(pieces)})"


def _cases(*pairs: tuple[str, str]) -> str:
    """Array of the texts whose test holds, in order."""
    return "array_compact(array(" + ", ".join(f"CASE WHEN {test} THEN {text} END" for test, text in pairs) + "))"


def _judged_sql(parts: str) -> str:
    """SQL array of structs, one per part: its analysis, issues, advice and points."""
    quoted = "concat('\\'', p.name, '\\'')"
    issues = _cases(
        (
            _DOMINANT,
            _sentence("'Parameter Dominance: '", quoted, "' uses '", fixed_sql("p.pct", 1), "'% of total prompt weight.'"),
        ),
        (
            _DISCREPANT,
            _sentence(
                "'Tokenizer Discrepancy: Local estimate for '", quoted, "' is '", fixed_sql("p.raw", 0),
                "'% of reported total.'",
            ),
        ),
        (_BLOATED, _sentence("'Context Bloat: RAG/Context takes '", fixed_sql("p.pct", 1), "'% of tokens.'")),
        (_AGED, _sentence("'History Bloat: Conversation history takes '", fixed_sql("p.pct", 1), "'% of tokens.'")),
        (
            _WASTEFUL,
            _sentence("'Whitespace Waste: '", quoted, "' has '", fixed_sql("p.waste_pct", 1), "'% redundant whitespace.'"),
        ),
    )
    advice = _cases(
        (
            _DOMINANT,
            _sentence(
                "'Apply semantic compression to '", quoted,
                "'. Summarizing this part could be ~70% effective in reducing total input tokens without context loss.'",
            ),
        ),
        (_DISCREPANT, _sql_text(DISCREPANCY_ADVICE)),
        (_BLOATED, _sql_text(CONTEXT_ADVICE)),
        (_AGED, _sql_text(HISTORY_ADVICE)),
        (_WASTEFUL, _sentence("'Normalize whitespace in '", quoted, "' before sending to LLM.'")),
    )

    def pick(history: str, context: str, dominance: str, waste: str) -> str:
        # A later, more specific finding replaces an earlier one; waste only fills a gap.
        pairs = ((_AGED, history), (_BLOATED, context), (_DOMINANT, dominance), (_WASTEFUL, waste))
        return "CASE " + " ".join(f"WHEN {t} THEN {_sql_text(v)}" for t, v in pairs) + " END"

    points = " + ".join(
        f"CASE WHEN {t} THEN {n} ELSE 0 END"
        for t, n in ((_DOMINANT, DOMINANCE_POINTS), (_BLOATED, CONTEXT_POINTS), (_AGED, HISTORY_POINTS))
    )
    shares = f"""transform({parts}, q -> struct(
        q.name AS name, q.token_count AS token_count, q.waste_pct AS waste_pct,
        q.token_count / total_tokens * 100 AS raw, least(q.token_count / total_tokens * 100, 100D) AS pct))"""
    return f"""transform({shares}, p -> struct(
        struct(
            p.name AS variable_name,
            int(p.token_count) AS token_count,
            p.pct AS percentage,
            {pick(HISTORY_REASON, CONTEXT_REASON, DOMINANCE_REASON, WASTE_REASON)} AS waste_reason,
            {pick(HISTORY_FIX, CONTEXT_FIX, DOMINANCE_FIX, WASTE_FIX)} AS recommendation) AS analysis,
        {issues} AS issues,
        {advice} AS advice,
        {points} AS points))"""


def split_tokens(usage: DataFrame) -> DataFrame:
    """Usage rows with tokens; a missing (null or 0) input or output count becomes 80 or 20 percent of the total."""
    total = F.col("total_tokens")
    return usage.where("total_tokens <> 0").withColumns(
        {
            "input_tokens": or_zero(F.col("input_tokens"), F.floor(total * 0.8)).cast("bigint"),
            "output_tokens": or_zero(F.col("output_tokens"), F.floor(total * 0.2)).cast("bigint"),
        }
    )


def migration(usage: DataFrame, prices: Sequence[Price] = PRICES) -> DataFrame:
    """Add ``best`` (offer struct), ``saving_pct`` against the logged cost, and ``migrate`` (saving above 10 %)."""
    rows = add_best_offer(usage, prices)
    current = F.coalesce(F.col("total_cost"), F.lit(0.0))
    saving = F.when(current > 0, (current - F.col("best.cost")) / current * 100).otherwise(F.lit(0.0))
    return rows.withColumn("saving_pct", saving).withColumn(
        "migrate", F.coalesce(F.col("saving_pct") > MIN_MIGRATION_SAVING, F.lit(False))
    )


def explain(usage: DataFrame, variables: DataFrame, prices: Sequence[Price] = PRICES) -> DataFrame:
    """One plan per usage row with tokens, in the shape of ``explain_plans``.

    Parts are reduced to a few numbers each and gathered per usage before the one join, so each side is shuffled once
    on the same key and no text moves.
    """
    gathered = part_facts(variables).groupBy("usage_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "name", "token_count", "waste_pct"))).alias("_parts")
    )
    rows = split_tokens(usage).select(
        "id", "provider", "model", "input_tokens", "output_tokens", "total_tokens", "total_cost"
    )
    retired = (
        price_frame(usage.sparkSession, prices)
        .where("deprecated")
        .select(F.col("provider").alias("_p"), F.col("model").alias("_m"), F.lit(True).alias("_retired"))
    )
    rows = rows.join(retired, (F.lower("provider") == F.col("_p")) & (F.lower("model") == F.col("_m")), "left")
    rows = with_cost(migration(rows, prices), prices=prices, names=("_cost_in", "_cost_out"))
    rows = add_alternatives(rows, F.col("_cost_in") + F.col("_cost_out"), prices, name="mce_alternatives")
    no_parts = "cast(array() as array<struct<position:int,name:string,token_count:int,waste_pct:double>>)"
    joined = rows.join(gathered, F.col("id") == F.col("usage_id"), "left").withColumn(
        "_judged", F.expr(_judged_sql(f"coalesce(_parts, {no_parts})"))
    )
    retired_now = F.coalesce("_retired", F.lit(False))
    move = F.col("migrate")
    joined = joined.withColumn(
        "_points", F.aggregate("_judged", F.lit(0), lambda total, j: total + j["points"])
    )
    return joined.select(
        F.concat(F.lit("plan_"), F.col("id")).alias("id"),
        F.col("id").alias("usage_id"),
        F.transform("_judged", lambda j: j["analysis"]).alias("variable_analysis"),
        F.concat(
            F.array_compact(
                F.array(
                    F.when(
                        retired_now,
                        F.concat(F.lit("Model Retirement: "), F.col("model"), F.lit(" is deprecated or retiring soon.")),
                    )
                )
            ),
            F.flatten(F.transform("_judged", lambda j: j["issues"])),
        ).alias("detected_issues"),
        F.concat(
            F.array_compact(
                F.array(
                    F.when(retired_now, F.lit(RETIRED_ADVICE)),
                    F.when(
                        move,
                        F.concat(
                            F.lit("Potential Migration: Switching to "),
                            F.col("best.provider"),
                            F.lit("/"),
                            F.col("best.model"),
                            F.lit(" could reduce this prompt's cost by "),
                            to_fixed("saving_pct", 0),
                            F.lit("%."),
                        ),
                    ),
                )
            ),
            F.flatten(F.transform("_judged", lambda j: j["advice"])),
        ).alias("optimization_suggestions"),
        F.least(F.col("_points"), F.lit(MAX_SAVING_PCT)).cast("double").alias("estimated_savings_pct"),
        (F.col("total_cost") * F.col("_points") / 100).alias("estimated_savings_usd"),
        F.when(move, F.col("best.model")).alias("mce_best_alternative_model"),
        F.when(move, F.col("best.provider")).alias("mce_best_alternative_provider"),
        F.when(move, F.col("best.cost")).otherwise(F.lit(0.0)).alias("mce_best_alternative_cost"),
        F.when(move, F.col("saving_pct")).otherwise(F.lit(0.0)).alias("mce_savings_pct"),
        "mce_alternatives",
    )


def backfill_plans(plans: DataFrame, usage: DataFrame, prices: Sequence[Price] = PRICES) -> DataFrame:
    """Plans with the best alternative and the list filled in where either is missing.

    The base is the recomputed cost, or the stored one where that is 0; the best is only set above 10 % saving.
    """
    rows = usage.select(
        F.col("id").alias("usage_id"), "provider", "model", "input_tokens", "output_tokens", "total_cost"
    )
    rows = with_cost(rows, prices=prices, names=("_cost_in", "_cost_out"))
    joined = plans.join(rows, "usage_id", "left")
    priced = F.col("_cost_in") + F.col("_cost_out")
    missing = (F.coalesce("mce_best_alternative_model", F.lit("")) == "") | F.col("mce_alternatives").isNull()
    base = F.when(priced > 0, priced).otherwise(F.coalesce("total_cost", F.lit(0.0)))
    joined = (
        add_best_offer(joined, prices, name="_best")
        .withColumn("_fill", missing & F.col("provider").isNotNull())
        .withColumn("_base", base)
        .withColumn(
            "_saving",
            F.when(F.col("_base") > 0, (F.col("_base") - F.col("_best.cost")) / F.col("_base") * 100).otherwise(
                F.lit(0.0)
            ),
        )
        .withColumn("_move", F.col("_fill") & F.coalesce(F.col("_saving") > MIN_MIGRATION_SAVING, F.lit(False)))
    )
    joined = add_alternatives(joined, priced, prices, name="_listed")
    fill, move = F.col("_fill"), F.col("_move")
    filled = {
        "mce_alternatives": F.when(fill, F.col("_listed")).otherwise(F.col("mce_alternatives")),
        "mce_best_alternative_model": F.when(move, F.col("_best.model")).otherwise(F.col("mce_best_alternative_model")),
        "mce_best_alternative_provider": F.when(move, F.col("_best.provider")).otherwise(
            F.col("mce_best_alternative_provider")
        ),
        "mce_best_alternative_cost": F.when(move, F.col("_best.cost")).otherwise(F.col("mce_best_alternative_cost")),
        "mce_savings_pct": F.when(move, F.col("_saving")).otherwise(F.col("mce_savings_pct")),
    }
    return joined.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in plans.columns])


def analysis_prompts(usage: DataFrame, variables: DataFrame) -> DataFrame:
    """Per usage: the request text asking a model for an analysis, with one line per part."""
    line = F.concat(
        F.coalesce("name", F.lit("null")),
        F.lit(" ("),
        F.coalesce(F.col("token_count").cast("string"), F.lit("null")),
        F.lit(' tokens): "'),
        F.substring(F.coalesce("content", F.lit("")), 1, 100),
        F.lit('..."'),
    )
    lines = (
        variables.select("usage_id", "position", line.alias("line"))
        .groupBy("usage_id")
        .agg(F.array_sort(F.collect_list(F.struct("position", "line"))).alias("_lines"))
        .select("usage_id", F.array_join(F.transform("_lines", lambda x: x["line"]), "\n").alias("part_lines"))
    )
    rows = usage.join(lines, F.col("id") == F.col("usage_id"), "left").drop("usage_id")
    info = F.coalesce("part_lines", F.lit(""))
    # Fixed value: the request text.
    prompt = F.concat(
        F.lit(
            "\n    Analyze this LLM prompt structure and suggest optimizations to reduce costs while maintaining "
            "performance.\n\n    Usage Context:\n    - Provider: "
        ),
        F.coalesce("provider", F.lit("null")),
        F.lit("\n    - Model: "),
        F.coalesce("model", F.lit("null")),
        F.lit("\n    - Total Tokens: "),
        F.coalesce(F.col("total_tokens").cast("string"), F.lit("null")),
        F.lit("\n    - Total Cost: $"),
        script_number(F.col("total_cost")),
        F.lit("\n\n    Variables:\n    "),
        info,
        F.lit(
            "\n\n    Return a JSON object with:\n    - detected_issues (array of strings)\n"
            "    - optimization_suggestions (array of strings)\n    - estimated_savings_pct (number)\n    "
        ),
    )
    return rows.select(F.col("id").alias("usage_id"), info.alias("part_lines"), prompt.alias("prompt"))


ANALYSIS_REPLY = (
    "detected_issues array<string>, optimization_suggestions array<string>, estimated_savings_pct double"
)


def parse_analysis(
    replies: DataFrame, usage: DataFrame, cfg: Config = Config(), prices: Sequence[Price] = PRICES
) -> DataFrame:
    """Analyses from raw replies ``(usage_id, reply)``: the JSON between the first ``{`` and the last ``}``.

    A reply without valid JSON gives a row with ``parsed`` false and null fields; the model figures are attached to
    the others.
    """
    body = F.regexp_extract("reply", r"(?s)\{.*\}", 0)
    parsed = replies.withColumn("_json", F.when(F.try_parse_json(body).isNotNull(), body)).withColumn(
        "_a", F.from_json("_json", ANALYSIS_REPLY)
    )
    rows = parsed.join(
        usage.select(F.col("id").alias("usage_id"), "provider", "model", "input_tokens", "output_tokens", "total_cost"),
        "usage_id",
        "left",
    )
    rows = with_cost(rows, prices=prices, names=("_cost_in", "_cost_out"))
    allowed = cfg.comparison_providers or None
    ok = F.col("_json").isNotNull()
    rows = add_best_offer(rows, prices, allowed, "_best").withColumn("_best", F.when(ok, F.col("_best")))
    rows = add_alternatives(rows, F.col("_cost_in") + F.col("_cost_out"), prices, allowed, "_listed")
    spent, best_cost = F.col("total_cost"), F.col("_best.cost")
    return rows.select(
        "usage_id",
        ok.alias("parsed"),
        F.col("_a.detected_issues").alias("detected_issues"),
        F.col("_a.optimization_suggestions").alias("optimization_suggestions"),
        F.col("_a.estimated_savings_pct").alias("estimated_savings_pct"),
        F.col("_best.model").alias("mce_best_alternative_model"),
        F.col("_best.provider").alias("mce_best_alternative_provider"),
        best_cost.alias("mce_best_alternative_cost"),
        # A call that cost nothing has no meaningful percentage.
        F.when(spent > 0, (spent - best_cost) / spent * 100).alias("mce_savings_pct"),
        F.when(ok, F.col("_listed")).alias("mce_alternatives"),
    )
