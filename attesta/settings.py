"""Tunable parameters of the operators, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ClaimSettings:
    max_span_chars: int = 9000
    ingest_chunk_chars: int = 3500
    min_quote_chars: int = 25
    max_quote_chars: int = 420
    min_fuzzy_ratio: float = 0.86
    max_candidates_per_consolidation: int = 70
    cross_group_duplicate_threshold: float = 0.55
    near_duplicate_threshold: float = 0.5
    premerge_overlap: float = 0.5
    merge_min_overlap: float = 0.3
    merge_max_members: int = 6
    retention_floor: float = 0.55
    selfcheck_batch: int = 25
    max_claims: int = 150
    audit_duplicate_threshold: float = 0.75
    fallback_section_max_chars: int = 4000
    fallback_section_max_spans: int = 4


@dataclass(frozen=True)
class PayoutSettings:
    winner_share: float = 0.70
    runner_up_slots: int = 4
    runner_up_decay: float = 0.5
    newcomer_share: float = 0.0
    newcomer_min_score: float = 0.0


CLAIMS = ClaimSettings()
PAYOUT = PayoutSettings()
