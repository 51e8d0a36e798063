"""Options of a run: one frozen record, passed to every operator that has a policy."""

from __future__ import annotations

from dataclasses import dataclass

# Defaults of a usage log.
DEFAULT_PROVIDER = "gemini"
DEFAULT_MODEL = "gemini-3-flash-preview"
DEFAULT_PROJECT = "default"
DEFAULT_ORG = "default_org"
DEFAULT_MAX_TOKENS = 32000


@dataclass(frozen=True)
class Config:
    """Which checks run and what happens on a finding.

    ``pii_action``: mask | warn | reject.  ``security_action``: warn | reject | mask.
    ``threshold_action``: warning | reject.  ``token_mode``: estimate | pretoken
    ``skip_history`` leaves ``history_*`` parts unscanned and unchanged.
    """

    formatting: tuple[str, ...] = ("pii", "compress", "neutralize")
    security: tuple[str, ...] = ("injection", "secrets")
    intelligence: tuple[str, ...] = ("explain", "cache")
    pii_action: str = "mask"
    security_action: str = "warn"
    threshold_action: str = "warning"
    max_tokens: int = DEFAULT_MAX_TOKENS
    token_mode: str = "estimate"
    default_provider: str = DEFAULT_PROVIDER
    default_model: str = DEFAULT_MODEL
    default_project: str = DEFAULT_PROJECT
    default_org: str = DEFAULT_ORG
    managed: bool = False
    skip_history: bool = False
    comparison_providers: tuple[str, ...] = ()
