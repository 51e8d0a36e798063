"""Table schemas as DDL. Readers are always given a schema; nothing is inferred."""

from __future__ import annotations


USAGE_DATA = (
    "id string, org_id string, project_id string, type string, provider string, model string, "
    "full_prompt string, response_content string, input_tokens bigint, output_tokens bigint, "
    "total_tokens bigint, saved_tokens bigint, saved_cost double, input_cost double, "
    "output_cost double, total_cost double, endpoint string, latency_ms double, "
    "token_limit_exceeded boolean, timestamp timestamp"
)
PROMPT_VARIABLES = (
    "usage_id string, name string, content string, original_content string, "
    "token_count int, char_count int, position int"
)
SECURITY_ALERTS = (
    "usage_id string, type string, description string, severity string, action_taken string, timestamp timestamp"
)
ALTERNATIVE = "struct<model:string,provider:string,cost:double,savingsPct:double>"
PART_ANALYSIS = (
    "struct<variable_name:string,token_count:int,percentage:double,waste_reason:string,recommendation:string>"
)
EXPLAIN_PLANS = (
    f"id string, usage_id string, variable_analysis array<{PART_ANALYSIS}>, detected_issues array<string>, "
    "optimization_suggestions array<string>, estimated_savings_pct double, estimated_savings_usd double, "
    "mce_best_alternative_model string, mce_best_alternative_provider string, "
    f"mce_best_alternative_cost double, mce_savings_pct double, mce_alternatives array<{ALTERNATIVE}>"
)
OPV_RESULTS = (
    "id string, usage_id string, status string, confidence double, reasoning string, "
    "should_continue boolean, verified_at timestamp"
)
PII_HITS = ("usage_id string, variable_name string, pii_type string, action_taken string, timestamp timestamp")
ACTION = (
    "struct<type:string,target:string,method:string,saved_chars:int,"
    "findings:array<struct<type:string,value:string>>>"
)
VARIABLE_ACTIONS = (
    "usage_id string, variable_name string, action_type string, action_method string, details string, "
    "timestamp timestamp"
)
CACHE_ENTRIES = ("prompt_hash string, response_content string, usage_id string, timestamp timestamp")
ORGANIZATIONS = ("id string, name string, created_at timestamp")
API_KEYS = ("key_hash string, org_id string, name string, last_used_at timestamp")
USERS = ("id string, email string, name string, created_at timestamp")
ORGANIZATION_MEMBERS = ("org_id string, user_id string, role string, created_at timestamp")

TABLES = {
    "usage_data": USAGE_DATA,
    "prompt_variables": PROMPT_VARIABLES,
    "security_alerts": SECURITY_ALERTS,
    "explain_plans": EXPLAIN_PLANS,
    "opv_results": OPV_RESULTS,
    "pii_hits": PII_HITS,
    "variable_actions": VARIABLE_ACTIONS,
    "cache_entries": CACHE_ENTRIES,
    "organizations": ORGANIZATIONS,
    "api_keys": API_KEYS,
    "users": USERS,
    "organization_members": ORGANIZATION_MEMBERS,
}

# Record accepted by ingest: a usage row as a client sends it, with its nested parts and actions.
INGEST_RECORD = (
    "id string, org_id string, project_id string, provider string, model string, full_prompt string, "
    "response_content string, input_tokens bigint, output_tokens bigint, endpoint string, latency_ms double, "
    "timestamp timestamp, "
    "variables array<struct<name:string,content:string,original_content:string,token_count:int,char_count:int,"
    "position:int>>, "
    f"actions_taken array<{ACTION}>"
)
