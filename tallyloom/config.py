"""Settings of a reconciliation. Money is in integer cents everywhere in the library."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ReconConfig:
    date_window_days: int = 3
    amount_tolerance_pct: float = 0.02
    amount_tolerance_abs: int = 50  # cents
    fuzzy_accept: float = 0.75
    ambiguous_low: float = 0.5
    ambiguous_high: float = 0.75
    weight_amount: float = 0.4
    weight_date: float = 0.3
    weight_reference: float = 0.3
    least_reference_similarity: float = 0.65
    split_window_days: int = 5
    split_pool: int = 25
    split_combo: int = 6
    split_listed: int = 5
    integrity_tolerance: int = 1  # cents


DEFAULT = ReconConfig()

# fixed values: names that appear in the data
SOURCES = ("payment", "settlement", "bank")
MATCHED_BY = ("human", "exact", "fuzzy", "split", "llm")
LEVELS = ("clear", "boundary", "decoy", "unresolvable")
