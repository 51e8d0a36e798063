"""Pricing, ingest, cache, running values, reports, explain and verification."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

import tokenledger as tl
from tokenledger import schema
from tokenledger.functions import pricing
from tokenledger.operators import cache, explain as explaining, listing, reports, running, verify

START = datetime(2024, 1, 1)


def usage(spark, *rows):
    """Rows (id, provider, model, input, output)."""
    return spark.createDataFrame(
        list(rows), "id string, provider string, model string, input_tokens bigint, output_tokens bigint"
    )


# --- prices -----------------------------------------------------------------------------------------------------


def test_price_list(spark):
    rows = tl.price_frame(spark).collect()
    assert len(rows) == 32 and len({r.provider for r in rows}) == 10
    assert sum(r.deprecated for r in rows) == 5


def test_costs(spark):
    rows = tl.cost(usage(
        spark, ("a", "google", "gemini-3-flash", 1_000_000, 2_000_000),
        ("b", "Gemini", "GEMINI-3-flash-preview", 1_000_000, 1_000_000), ("c", "acme", "x", 5, 5), ("d", None, None, 1, 1),
    ))
    assert {r.id: (r.input_cost, r.output_cost) for r in rows.collect()} == {
        "a": (0.5, 6.0), "b": (0.5, 3.0), "c": (0.0, 0.0), "d": (0.0, 0.0),
    }


def test_alternatives(spark):
    rows = usage(
        spark, ("a", "openai", "o3-2025-12-15", 1000, 1000), ("b", "anthropic", "claude-4-6-opus", 1000, 1000),
        ("c", "gemini", "gemini-3-flash-preview", 1000, 1000), ("z", "aws", "amazon.nova-micro-v1", 0, 0),
    )
    best = {r.id: r for r in tl.best_alternative(rows).collect()}
    assert best["a"].best_cost < 0.0003
    assert best["z"].best_model == "o3-2025-12-15"  # all cost nothing: the first of the list
    lists = {r.id: r.alternatives for r in tl.with_alternatives(rows).collect()}
    for key, listed in lists.items():
        costs = [a.cost for a in listed]
        assert len(listed) == 26 and costs == sorted(costs)
        assert (listed[0].model, listed[0].provider) == (best[key].best_model, best[key].best_provider)
    assert any(0 < a.savingsPct <= 100 for a in lists["b"]) and any(a.savingsPct > 0 for a in lists["c"])


def test_best_offer_equals_full_list(spark):
    random.seed(3)
    prices = [(p.provider, p.model) for p in pricing.PRICES] + [("x", "y")]
    rows = [(str(i), *random.choice(prices), random.choice([0, 1, 7, 10**6, random.randrange(10**9)]),
             random.choice([0, 1, 7, 10**6, random.randrange(10**9)])) for i in range(3000)]
    frame = tl.with_alternatives(pricing.add_best_offer(usage(spark, *rows)))
    wrong = frame.where(
        (F.col("best.model") != F.col("alternatives")[0]["model"]) | (F.col("best.cost") != F.col("alternatives")[0]["cost"])
    )
    assert wrong.count() == 0


def test_provider_allow_list_is_literal(spark):
    rows = usage(spark, ("a", "openai", "o4-mini", 10, 10))
    assert tl.alternatives(rows, providers=("gemini",)).count() == 0
    twice = tl.alternatives(rows, providers=("openai", "openai")).collect()
    assert [r.model for r in twice].count("gpt-5.2-preview") == 2 and "o4-mini" not in {r.model for r in twice}


# --- ingest and the log -----------------------------------------------------------------------------------------


def records(spark, *dicts):
    return spark.createDataFrame([tuple(d.get(c.split()[0]) for c in _fields()) for d in dicts], schema.INGEST_RECORD)


def _fields():
    return ("id org_id project_id provider model full_prompt response_content input_tokens output_tokens endpoint "
            "latency_ms timestamp variables actions_taken").split()


def test_ingest(spark):
    raw = records(
        spark,
        {"id": "a", "provider": "gemini", "model": "gemini-3-flash-preview", "input_tokens": 100, "output_tokens": 50,
         "variables": [("user_query", "a@b.com or c@d.org", None, 5, 18, 0), ("context", None, None, None, None, None)],
         "actions_taken": [("compress", "context", None, 4, None)]},
        {"id": "b"},
    )
    tables = tl.ingest_usage(raw)
    rows = {r.id: r for r in tables["usage_data"].collect()}
    assert rows["a"].total_tokens == 150 and rows["a"].type == "ingested"
    assert rows["a"].total_cost == pytest.approx(100 / 1e6 * 0.5 + 50 / 1e6 * 3)
    assert (rows["b"].provider, rows["b"].model, rows["b"].project_id, rows["b"].org_id, rows["b"].total_tokens) == (
        "gemini", "gemini-3-flash-preview", "default", "default_org", 0)
    assert rows["b"].timestamp is not None and not rows["b"].token_limit_exceeded
    parts = tables["prompt_variables"].orderBy("name").collect()
    assert [(p["name"], p.content, p.original_content, p.token_count) for p in parts] == [
        ("context", "", "", 0), ("user_query", "a@b.com or c@d.org", "a@b.com or c@d.org", 5)]
    assert [h.action_taken for h in tables["pii_hits"].collect()] == ["ingested_warning"] * 2
    action = tables["variable_actions"].first()
    assert json.loads(action.details) == {"type": "compress", "target": "context", "saved_chars": 4}


def test_backfill_and_seed(spark):
    old = spark.createDataFrame([("a", "x", "y", None)], "id string, provider string, model string, type string")
    row = tl.backfill_schema(old, schema.USAGE_DATA).first()
    assert (row.org_id, row.type, row.saved_cost, row.full_prompt) == ("default_org", "execution", 0.0, None)
    orgs = spark.createDataFrame([("default_org", "mine")], "id string, name string")
    kept = tl.append_absent(orgs, tl.seed_rows(spark)["organizations"], "id").collect()
    assert [(r.id, r["name"]) for r in kept] == [("default_org", "mine")]


def test_log_files(spark, tmp_path):
    rows = tl.ingest_usage(records(spark, {"id": "a", "org_id": "o1"}, {"id": "b", "org_id": "o2"}))
    tl.write_log({"usage_data": rows["usage_data"]}, str(tmp_path))
    back = tl.read_log(spark, str(tmp_path), ["usage_data"])["usage_data"]
    assert {r.id for r in reports.scope(back, "o1").collect()} == {"a"}
    plan = reports.scope(back, "o1")._jdf.queryExecution().executedPlan().toString()
    assert "org_id" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]


def test_replies(spark):
    raw = spark.createDataFrame(
        [
            ("g", "gemini", '{"candidates":[{"content":{"parts":[{"text":"a"},{"text":"b"}]},"finishReason":"STOP"}],'
             '"usageMetadata":{"promptTokenCount":3,"candidatesTokenCount":4}}'),
            ("t", "google", '{"text":"fallback"}'),
            ("c", "claude", '{"content":[{"type":"text","text":"hi"}],"usage":{"input_tokens":1,"output_tokens":2}}'),
            ("o", "openai", '{"choices":[{"message":{"content":"yo"}}],"usage":{"prompt_tokens":5,"completion_tokens":6}}'),
            ("x", "vertex-less", "not json"),
            ("s", "gemini", '{"candidates":[{"finishReason":"SAFETY"}]}'),
        ],
        "id string, provider string, raw string",
    )
    usable, dropped = tl.normalize_replies(raw)
    assert {r.id: (r.content, r.input_tokens, r.output_tokens) for r in usable.collect()} == {
        "g": ("ab", 3, 4), "t": ("fallback", 0, 0), "c": ("hi", 1, 2), "o": ("yo", 5, 6)}
    assert {r.id: (r.reason, r.odd_finish) for r in dropped.collect()} == {
        "x": ("empty content (finishReason=UNKNOWN)", False), "s": ("empty content (finishReason=SAFETY)", True)}


def test_tenancy(spark):
    keys = spark.createDataFrame([("k1", "o1")], "key_hash string, org_id string")
    raw = spark.createDataFrame([("a", "k1"), ("b", "bad"), ("c", None), ("d", "")], "id string, api_key string")
    accepted, rejected = tl.attach_org(raw, keys)
    assert {r.id: r.org_id for r in accepted.collect()} == dict(a="o1", b="default_org", c="default_org", d="default_org")
    assert rejected.count() == 0
    from tokenledger.operators.tenancy import hash_keys

    accepted, rejected = tl.attach_org(raw, hash_keys(keys), tl.Config(managed=True), hashed=True)
    assert {r.id: r.org_id for r in accepted.collect()} == {"a": "o1"}
    assert {r.id: r.reason for r in rejected.collect()} == {
        "b": "Invalid API key", "c": "API key required", "d": "API key required"}


# --- cache and running values -----------------------------------------------------------------------------------


def calls(spark, n=1500, seed=1):
    """Calls in which one prompt makes up a third of all."""
    random.seed(seed)
    rows = []
    for i in range(n):
        prompt = "hot" if random.random() < 0.35 else f"p{random.randrange(60)}"
        rows.append((f"c{i:05d}", prompt, START + timedelta(minutes=random.randrange(9000)),
                     random.choice(["", "r", "s", "t"]), random.random() < 0.1, random.random() < 0.1))
    return rows, spark.createDataFrame(
        rows, "id string, prompt_hash string, timestamp timestamp, response_content string, bypass boolean, streamed boolean")


def test_cache_equals_simulation(spark):
    rows, frame = calls(spark)
    stored, expected = {}, {}
    for key, prompt, _, response, bypass, streamed in sorted(rows, key=lambda r: (r[2], r[0])):
        hit = None if bypass or streamed else stored.get(prompt)
        expected[key] = hit
        if hit is None and not streamed and response:
            stored[prompt] = key
    for seconds in (600, 3600, 10**7):
        found = cache.find_hits(frame, bucket_seconds=seconds).collect()
        assert {r.id: r.cached_usage_id for r in found} == expected
    plain = cache.find_hits(frame.drop("bypass", "streamed"))
    assert "Window" not in plain._jdf.queryExecution().executedPlan().toString()


def test_running_equals_window(spark):
    _, frame = calls(spark)
    frame = frame.withColumn("n", F.length("response_content") + F.hash("id") % 7)
    value = F.when(F.col("response_content") != "", F.col("id"))
    window = W.partitionBy("prompt_hash").orderBy("timestamp", "id").rowsBetween(W.unboundedPreceding, -1)
    expected = frame.select(
        "id", F.last(value, True).over(window).alias("l"), F.coalesce(F.sum("n").over(window), F.lit(0)).alias("s"))
    ours = running.sum_before(
        running.last_before(frame, ["prompt_hash"], "timestamp", "id", value, "l", 1800),
        ["prompt_hash"], "timestamp", "id", F.col("n"), "s", 1800).select("id", "l", "s")
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, expected.collect()))


def test_running_over_bursts(spark):
    """Half of the rows in two seconds of one key, with ties, times before 1970 and rows without a time."""
    random.seed(5)
    rows = []
    for i in range(1200):
        at = START + timedelta(microseconds=random.randrange(2 * 10**6)) if i % 2 else START + timedelta(seconds=random.randrange(9000))
        at = None if i % 50 == 3 else datetime(1969, 12, 31, 23, i % 60) if i % 40 == 1 else at
        rows.append((f"c{i:05d}", "hot" if i % 2 else f"p{i % 9}", START if i % 30 == 7 else at, None if i % 4 == 2 else i))
    frame = spark.createDataFrame(rows, "id string, k string, timestamp timestamp, n bigint")
    window = W.partitionBy("k").orderBy("timestamp", "id").rowsBetween(W.unboundedPreceding, -1)
    expected = frame.select(
        "id", F.last("n", True).over(window).alias("l"), F.coalesce(F.sum("n").over(window), F.lit(0)).alias("s"))
    expected = sorted(map(tuple, expected.collect()))
    for seconds in (1, 3600, 10**6):
        ours = running.last_before(frame, ["k"], "timestamp", "id", F.col("n"), "l", seconds)
        ours = running.sum_before(ours, ["k"], "timestamp", "id", F.col("n"), "s", seconds)
        assert set(ours.columns) == {*frame.columns, "l", "s"}
        assert sorted(map(tuple, ours.select("id", "l", "s").collect())) == expected


def test_upsert_and_lookup(spark):
    ddl = "prompt_hash string, response_content string, usage_id string, timestamp timestamp"
    old = spark.createDataFrame([("h", "one", "u1", START)], ddl)
    new = spark.createDataFrame([("h", "two", "u2", START + timedelta(1)), ("e", "", "u3", START), ("n", None, "u4", START)], ddl)
    stored = tl.upsert_cache(old, new)
    assert [tuple(r)[:3] for r in stored.collect()] == [("h", "two", "u2")]
    prompts = spark.createDataFrame([("h",), ("q",)], "prompt_hash string")
    assert {r.prompt_hash: (r.cached, r.cached_response) for r in tl.lookup_cache(prompts, stored).collect()} == {
        "h": (True, "two"), "q": (False, None)}


def test_budget(spark):
    rows = [("a", "p", START, 1.0), ("b", "p", START + timedelta(hours=5), 2.0), ("c", "p", START + timedelta(days=3), 1.0),
            ("d", "p", START + timedelta(days=40), 1.0), ("e", None, START, 9.0), ("f", None, START + timedelta(1), 9.0)]
    frame = spark.createDataFrame(rows, "id string, project_id string, timestamp timestamp, total_cost double")
    caps = spark.createDataFrame([("p", 3.0)], "project_id string, monthly_budget double")
    allowed, refused = tl.budget(frame, caps)
    assert {r.id: r.month_to_date for r in allowed.collect()} == {"a": 0.0, "b": 1.0, "d": 0.0, "e": 0.0, "f": 9.0}
    assert [(r.id, r.month_to_date) for r in refused.collect()] == [("c", 3.0)]
    flagged, none = tl.budget(frame, caps, action="warn")
    assert flagged.count() == 6 and none.count() == 0


# --- reports ----------------------------------------------------------------------------------------------------


def test_empty_reports(spark):
    empty = spark.createDataFrame([], schema.USAGE_DATA)
    hits = spark.createDataFrame([], schema.PII_HITS)
    row = tl.stats_report(empty, hits, hits).first()
    assert (row.total_tokens, row.total_cost, row.total_requests, row.pii_hits, row.potential_savings, row.avg_cost) == (
        0, 0.0, 0, 0, 0.0, 0.0)


def test_heatmap_scope(spark):
    rows = spark.createDataFrame(
        [("u1", "o", "p", START), ("u2", "o", "p", START - timedelta(days=60)), ("u3", "other", "p", START)],
        "id string, org_id string, project_id string, timestamp timestamp")
    parts = spark.createDataFrame(
        [("u1", "user_query", 10), ("u1", "user_query", 5), ("u1", "system", 99), ("u1", "context", 99),
         ("u2", "user_query", 7), ("u3", "notes", 3)], "usage_id string, name string, token_count int")
    got = tl.heatmap(parts, rows, "o", as_of=START + timedelta(days=1)).collect()
    assert [(r.variable_name, r.total_tokens, r.request_count, r.treemap_size) for r in got] == [("user_query", 15, 2, 50)]


def test_display(spark):
    frame = spark.createDataFrame([(0.0,), (0.0012345,), (0.015,), (12.5,)], "c double")
    assert [r.t for r in frame.select(listing.cost_text("c").alias("t")).collect()] == ["0.00", "0.001234", "0.01", "12.50"]
    parts = spark.createDataFrame([("ab", "abcd"), ("abcd", "ab"), ("", "ab")], "content string, original_content string")
    assert [r.reduced_pct for r in listing.size_reduction(parts).collect()] == [50, None, None]


# --- explain ----------------------------------------------------------------------------------------------------


def explained(spark, total, parts, provider="openai", model="gpt-4o", cost=1.0, tokens=(0, 0)):
    rows = spark.createDataFrame(
        [("u", provider, model, *tokens, total, cost)],
        "id string, provider string, model string, input_tokens bigint, output_tokens bigint, total_tokens bigint, total_cost double")
    variables = spark.createDataFrame(
        [("u", i, n, c, t) for i, (n, c, t) in enumerate(parts)],
        "usage_id string, position int, name string, content string, token_count int")
    return tl.explain(rows, variables).collect()


def test_explain(spark):
    assert explained(spark, 0, [("a", "x", 1)]) == []
    (plan,) = explained(spark, 1000, [("context", "a  " * 50, 800), ("history_user_0", "h", 450), ("user_query", "q", 1300)])
    assert plan.detected_issues == [
        "Model Retirement: gpt-4o is deprecated or retiring soon.",
        "Parameter Dominance: 'context' uses 80.0% of total prompt weight.",
        "Context Bloat: RAG/Context takes 80.0% of tokens.",
        "Whitespace Waste: 'context' has 33.3% redundant whitespace.",
        "History Bloat: Conversation history takes 45.0% of tokens.",
        "Parameter Dominance: 'user_query' uses 100.0% of total prompt weight.",
        "Tokenizer Discrepancy: Local estimate for 'user_query' is 130% of reported total.",
    ]
    assert plan.estimated_savings_pct == 65 and plan.estimated_savings_usd == pytest.approx(0.65)
    assert [a.percentage for a in plan.variable_analysis] == [80.0, 45.0, 100.0]
    assert plan.variable_analysis[0].waste_reason == explaining.CONTEXT_REASON
    assert plan.mce_best_alternative_model == "amazon.nova-micro-v1"  # 800 in, 200 out
    assert len(plan.mce_alternatives) == 27  # a retired model is not among the offers, so none is left out


def test_explain_caps_and_gaps(spark):
    (plan,) = explained(spark, 100, [(f"history_{i}", "h", 90) for i in range(4)], cost=2.0)
    assert plan.estimated_savings_pct == 90 and plan.estimated_savings_usd == pytest.approx(2.0 * 120 / 100)
    (plan,) = explained(spark, 10, [], provider="gemini", model="gemini-1.5-pro", cost=0.0, tokens=(5, 5))
    assert plan.detected_issues == [] and plan.optimization_suggestions == []  # aliases are never flagged
    assert plan.variable_analysis == [] and plan.mce_best_alternative_model is None


def test_recommended_and_backfill(spark):
    (plan,) = explained(spark, 1000, [("a", "x", 10)], provider="openai", model="o3-2025-12-15", cost=0.0, tokens=(600, 400))
    assert plan.mce_best_alternative_model is None  # nothing was paid
    rows = spark.createDataFrame(
        [("u", "openai", "o3-2025-12-15", 600, 400, 0.0)],
        "id string, provider string, model string, input_tokens bigint, output_tokens bigint, total_cost double")
    plans = spark.createDataFrame([plan], schema.EXPLAIN_PLANS)
    filled = tl.backfill_plans(plans, rows).first()
    assert filled.mce_best_alternative_model == "ministral-3-14b" and filled.mce_savings_pct > 90
    assert tl.recommended(plans).count() == 0 and tl.recommended(tl.backfill_plans(plans, rows)).count() == 1


def test_parse_analysis(spark):
    replies = spark.createDataFrame(
        [("u", 'text {"detected_issues":["a"],"estimated_savings_pct":5} tail'), ("v", "no json"), ("w", "{broken}")],
        "usage_id string, reply string")
    rows = spark.createDataFrame(
        [(i, "openai", "gpt-4o", 100, 100, 1.0) for i in "uvw"],
        "id string, provider string, model string, input_tokens bigint, output_tokens bigint, total_cost double")
    got = {r.usage_id: r for r in tl.parse_analysis(replies, rows).collect()}
    assert got["u"].detected_issues == ["a"] and got["u"].estimated_savings_pct == 5.0
    assert got["u"].mce_best_alternative_model == "ministral-3-14b"
    assert not got["v"].parsed and got["w"].mce_alternatives is None


# --- verification -----------------------------------------------------------------------------------------------


def test_verification(spark):
    replies = {
        "\n  STATUS: ON_TRACK\n  CONFIDENCE: 0.9\n  SHOULD_CONTINUE: yes\n  REASONING: fine so far\n": ("on_track", 0.9, True, "fine so far", False),
        "STATUS: FAILED\nCONFIDENCE: 0.8": ("failed", 0.8, True, "Unable to parse response", True),
        "STATUS: FAILED\nCONFIDENCE: 0": ("failed", 0.5, True, "Unable to parse response", False),
        "STATUS: looping\nSTATUS: Completed\nSHOULD_CONTINUE: no": ("completed", 0.5, False, "Unable to parse response", True),
        "garbage": ("uncertain", 0.5, True, "Unable to parse response", False),
        "CONFIDENCE: .75abc\nSTATUS: other": ("other", 0.75, True, "Unable to parse response", False),
    }
    frame = spark.createDataFrame([(r,) for r in replies], "reply string")
    for row in tl.parse_verification(frame).collect():
        assert (row.status, row.confidence, row.should_continue, row.reasoning, row.kill) == replies[row.reply]


def test_samples(spark):
    rows = spark.createDataFrame([("a", "/x"), ("b", None), ("c", "/y")], "id string, endpoint string")
    parts = spark.createDataFrame(
        [("a", 0, "system", "s"), ("a", 1, "reasoning", "thought"), ("a", 2, "safety_guardrails", "be safe"), ("b", 0, "x", "first")],
        "usage_id string, position int, name string, content string")
    samples = tl.reasoning_samples(rows, parts)
    got = {r.usage_id: (r.thinking_sample, r.task_description) for r in samples.collect()}
    assert got == {
        "a": ("thought", "Verification for endpoint /x. Safety Guardrails: be safe"),
        "b": ("first", "Verification for endpoint undefined"),
        "c": ("No thinking tokens found.", "Verification for endpoint /y")}
    usable, rejected = tl.check_inputs(samples)
    prompt = tl.verify_prompts(usable).where("usage_id = 'a'").first().prompt
    assert "thought" in prompt and "None (first check)" in prompt and rejected.count() == 0


def test_previous_status(spark):
    rows = [(f"v{i}", "r", START + timedelta(hours=i * 3), s) for i, s in enumerate(["a", "b", None, "c"])]
    frame = spark.createDataFrame(rows, "id string, request_id string, timestamp timestamp, status string")
    assert [r.previous_status for r in verify.with_previous_status(frame).orderBy("id").collect()] == [None, "a", "b", "b"]


def test_price_lists_of_any_text_and_no_doubles(spark):
    from tokenledger.functions.pricing import Price, price_frame

    odd = [Price(0, "o'neil", "m\\'x", 1.0, 2.0, False)]
    assert [(r.provider, r.model) for r in price_frame(spark, odd).collect()] == [("o'neil", "m\\'x")]
    with pytest.raises(ValueError):
        price_frame(spark, [odd[0], odd[0]._replace(ord=1)])


def test_children_carry_the_time_of_their_record(spark):
    raw = spark.sql(
        "select 'u1' id, 1 input_tokens, 1 output_tokens, timestamp'2024-01-02 03:04:05' timestamp, "
        "array(named_struct('name', 'q', 'content', 'a@b.com', 'original_content', '', 'token_count', 1, 'char_count', 7, 'position', 0)) variables, "
        "array(named_struct('type', 'pii', 'target', 'q', 'method', 'mask')) actions_taken"
    )
    tables = tl.ingest_usage(raw)
    for name in ("pii_hits", "variable_actions"):
        assert [str(r.timestamp) for r in tables[name].collect()] == ["2024-01-02 03:04:05"]


def test_a_log_of_several_ages_reads_back_with_defaults(spark, tmp_path):
    path = str(tmp_path / "log")
    old = spark.createDataFrame([("u1", "acme", 5)], "id string, org_id string, total_tokens bigint").withColumn("timestamp", F.timestamp_seconds(F.lit(1704067200)))
    new = old.withColumns({"id": F.lit("u2"), "type": F.lit("cache_hit"), "saved_tokens": F.lit(7).cast("bigint"), "project_id": F.lit("p"), "saved_cost": F.lit(0.5)})
    for rows in (old, new):
        tl.write_log({"usage_data": rows}, path)
    usage = tl.read_log(spark, path, ["usage_data"])["usage_data"]
    got = usage.select("id", "type", "project_id", "saved_tokens", "saved_cost", "org_id").orderBy("id").collect()
    assert [tuple(r) for r in got] == [("u1", "execution", "default", 0, 0.0, "acme"), ("u2", "cache_hit", "p", 7, 0.5, "acme")]
    scoped = usage.where("org_id = 'acme' and date = date'2024-01-01'")
    plan = scoped._jdf.queryExecution().executedPlan().toString().split("PartitionFilters:")[1][:200]
    assert "org_id" in plan and "date" in plan and scoped.count() == 2


def test_pages_behind_a_mark_are_the_pages_by_number(spark, tmp_path):
    made = spark.range(60).selectExpr(
        "concat('u', lpad(string(id), 3, '0')) id", "'o' org_id", "if(id % 7 = 0, null, int(id % 4)) total_tokens",
        "if(id % 11 = 0, null, timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, int(id) div 5)) timestamp")
    for sort in ("date", "tokens"):
        mark, seen = None, []
        for number in range(1, 11):
            rows = tl.page_after(made, mark, sort, 7)
            assert rows.collect() == tl.page(made, number, sort, 7).collect()
            seen += [r.id for r in rows.collect()]
            mark = tl.page_mark(rows, sort) or mark
        assert sorted(seen) == sorted(r.id for r in made.collect())
    assert tl.page_mark(made.limit(0)) is None

    made.withColumn("date", F.to_date("timestamp")).write.partitionBy("org_id", "date").parquet(str(tmp_path / "log"))
    stored = spark.read.parquet(str(tmp_path / "log"))
    rows = tl.page_after(stored, tl.page_mark(tl.page(made, 4, "date", 7)), "date", 7)
    assert [r.id for r in rows.collect()] == [r.id for r in tl.page(made, 5, "date", 7).collect()]
    text = rows._jdf.queryExecution().executedPlan().toString()
    filters = text[text.index("PartitionFilters"):]
    assert "date" in filters[: filters.index("PushedFilters")] and "LessThanOrEqual(timestamp" in filters and "TakeOrderedAndProject" in text


def test_first_plans_by_id_without_ids_and_for_no_usage(spark):
    rows = [("u1", "p2", 2.0, ["b"]), ("u1", "p1", 1.0, ["a"]), ("u1", None, 0.0, ["n"]), ("u2", None, 5.0, ["c"]), (None, "p9", 9.0, None), (None, "p8", 8.0, ["d"])]
    plans = spark.createDataFrame(rows, "usage_id string, id string, estimated_savings_pct double, detected_issues array<string>")
    got = {r.usage_id: tuple(r.explain_plan) for r in listing.first_plans(plans).collect()}
    assert got == {"u1": ("p1", 1.0, ["a"]), "u2": (None, None, None), None: ("p8", 8.0, ["d"])}
    assert listing.first_plans(plans.unionByName(plans)).count() == 3
