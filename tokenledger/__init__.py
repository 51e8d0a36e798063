"""Analytics over logs of language model use, as Spark jobs."""

from .config import Config
from .functions.pricing import PRICES, Price, price_frame
from .operators.assemble import assemble, count_tokens, explode_history, prompt_tokens, to_requests
from .operators.cache import compression_savings, find_hits, lookup_cache, replay_cache, upsert_cache
from .operators.construct import construct
from .operators.cost import alternatives, best_alternative, cost, retired_models, with_alternatives
from .operators.explain import analysis_prompts, backfill_plans, explain, parse_analysis
from .operators.guard import guard, scan_and_rewrite
from .operators.listing import listing, nest, page, page_after, page_count, page_mark, recent, recommended
from .operators.reports import breakdowns, budget, by_model, by_provider, heatmap, potential_savings, projects, scope, stats_report, totals
from .operators.scan import entropy, injection_findings, mask_pii, pii_findings, secret_findings, threat_flags
from .operators.tenancy import attach_org
from .operators.verify import (
    check_inputs,
    parse_verification,
    reasoning_samples,
    verify_prompts,
    with_previous_status,
)
from .sources.export import export_jsonl, export_traces
from .sources.ingest import ingest_usage, report_records
from .sources.log import append_absent, backfill_schema, read_log, seed_rows, write_log
from .sources.replies import normalize_replies
from .streaming.chunks import fold_chunk_stream, fold_chunks
from .streaming.live import heartbeat_state, live_stats, stream_cache, stream_ingest

__all__ = [name for name in dir() if not name.startswith("_")]
