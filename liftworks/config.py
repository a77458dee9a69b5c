"""Campaigns, their metrics, designed splits, goals and contact rules. Plain values; a deployment brings its own."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Campaign:
    code: str
    metric: str  # primary metric
    stage: int  # place in the funnel
    unit_value: float
    eligibility: str  # whether value may be claimed: eligible, arguable or n/a
    split: float = 0.9  # designed share of the action arm
    secondary: str | None = None


CAMPAIGNS = (
    Campaign("ACQ", "acquisition", 1, 78.21, "eligible"),
    Campaign("SEA", "acquisition", 1, 78.21, "arguable"),
    Campaign("ACT", "activation", 2, 40.0, "eligible"),
    Campaign("USE", "usage", 3, 25.0, "eligible"),
    Campaign("TOK", "token", 4, 10.0, "n/a", secondary="usage"),
)

#: Channel -> (contacts allowed, rolling days, cool-down days).
CAPS = {"MB": (5, 365, 0), "IM": (3, 90, 14), "EM": (2, 90, 30), "EM_IM": (1, 90, 60), "DO": (2, 90, 14)}

#: Bucket upper edges (inclusive) and labels, the last label open-ended.
CONTACTS = ([1, 2, 3, 5, 10], ["1", "2", "3", "4-5", "6-10", "11+"])
GAPS = ([0, 7, 15, 25, 30, 60, 90], ["<=0", "1-7", "8-15", "16-25", "26-30", "31-60", "61-90", "90+"])
AFTER_SUCCESS = ([0, 3, 7, 14, 30, 60], ["same_day", "1-3", "4-7", "8-14", "15-30", "31-60", "60+"])
PAIR_GAPS = ([7, 14, 30, 60], ["0-7", "8-14", "15-30", "31-60", "60+"])
WINDOW_GAPS = ([0, 7, 30, 90], ["Overlapping", "1-7", "8-30", "31-90", "90+"])
AGES = ([24, 34, 44, 54, 64], ["18-24", "25-34", "35-44", "45-54", "55-64", "65+"])
TENURES = ([1, 3, 5, 10], ["0-1yr", "2-3yr", "4-5yr", "6-10yr", "10yr+"])
INCOMES = ([0, 2500, 5000, 7500], ["<=0", "0-2.5k", "2.5-5k", "5-7.5k", "7.5k+"])


#: What reports call the arms.
ARM_LABELS = {"action": "Test", "control": "Control"}


def case(key: str, values: dict, otherwise: str = "NULL") -> str:
    """SQL: the value that belongs to a key column."""
    quoted = lambda v: f"'{v}'" if isinstance(v, str) else repr(v)
    return f"CASE {key} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in values.items()) + f" ELSE {otherwise} END"
