"""Policy options as frozen values that operators bind into column expressions.

Values marked fixed must equal those that stored data was made with."""

from __future__ import annotations

from dataclasses import dataclass, fields
from typing import Any, TypeVar

P = TypeVar("P")


def bind(policy: type[P], options: dict[str, Any] | None = None) -> P:
    """The policy with ``options``; an unknown option is an error."""
    known = {f.name for f in fields(policy)}  # type: ignore[arg-type]
    unknown = set(options or {}) - known
    if unknown:
        raise ValueError(f"unknown options of {policy.__name__}: {sorted(unknown)}")
    return policy(**(options or {}))


@dataclass(frozen=True)
class Scoring:
    """Composite score; fixed values."""

    half_life_days: float = 7.0
    w_recency: float = 1.0
    w_relevance: float = 1.0
    w_importance: float = 1.0
    utility_weight: float = 0.5


@dataclass(frozen=True)
class Retrieval:
    """Search; fixed values."""

    top_k: int = 8
    over_fetch: int = 3
    rrf_k: int = 60
    query_chars: int = 1024
    query_terms: int = 64
    bm25_k1: float = 1.2
    bm25_b: float = 0.75


@dataclass(frozen=True)
class Assembly:
    """Context assembly; fixed values."""

    budget_tokens: int = 2048
    top_k: int = 16
    mmr_lambda: float = 0.7
    abstain_below: float = 0.25
    placement: bool = True


@dataclass(frozen=True)
class Conflict:
    """The fact ladder; fixed values."""

    trust_margin: float = 0.3
    bias: str = "newest"


@dataclass(frozen=True)
class Dedup:
    """Write-path merging; fixed values."""

    permutations: int = 128
    jaccard: float = 0.6
    cosine: float = 0.92
    importance_step: float = 0.1
    utility_step: float = 0.05


@dataclass(frozen=True)
class Decay:
    """Tiers by idle days; fixed values."""

    warm_days: float = 7.0
    cold_days: float = 30.0
    dormant_days: float = 90.0
    types: tuple[str, ...] = ("episodic", "semantic", "resource")


@dataclass(frozen=True)
class Sessions:
    """Sessions and their summaries; fixed values."""

    gap_minutes: float = 30.0
    min_members: int = 3
    summary_chars: int = 600


@dataclass(frozen=True)
class Firewall:
    """Trust, anomalies and quarantine; fixed values."""

    quarantine_below: float = 0.25
    external_cap: float = 0.3
    min_neighbours: int = 8
    outlier_below: float = 0.05
    prefix_chars: int = 96
    recent: int = 50
    corroborations: int = 2
    corroborate_trust: float = 0.5


@dataclass(frozen=True)
class Links:
    """The link graph; fixed values."""

    damping: float = 0.85
    iterations: int = 20
    budget: int = 12
    auto_links: int = 4
    auto_similarity: float = 0.6


@dataclass(frozen=True)
class Retention:
    """Legal holds and log pruning."""

    retention_days: float = 30.0
    holds: tuple[str, ...] = ()
