"""Key derivation and date columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def campaign_code(tactic_id) -> Column:
    """Characters 8 to 10 of a tactic id."""
    return F.substring(tactic_id, 8, 3)


def client_key(raw) -> Column:
    """A client id without blanks and leading zeros (one zero stays of an id of zeros)."""
    return F.regexp_replace(F.trim(raw), "^0+(?!$)", "")


def card_client(card) -> Column:
    """The client id in a card number: 9 characters from the 7th, without leading zeros."""
    return F.regexp_replace(F.substring(card, 7, 9), "^0+(?!$)", "")


def cohort(start) -> Column:
    return F.date_format(start, "yyyy-MM")


def fiscal_cohort(start, first_month: int = 11) -> Column:
    """FYyyyyQn of a year that begins in `first_month` and is named after the calendar year in which it ends."""
    moved = F.add_months(start, (13 - first_month) % 12)
    return F.concat(F.lit("FY"), F.year(moved).cast("string"), F.lit("Q"), F.quarter(moved).cast("string"))


def fiscal_of_quarter(label, first_month: int = 11) -> Column:
    """Fiscal quarter of a calendar-quarter label (2025Q1, 2025-Q1 or Q1 2025), by the quarter's middle month; null for other labels."""
    year = F.nullif(F.regexp_extract(label, r"([0-9]{4})", 1), F.lit("")).cast("int")
    quarter = F.nullif(F.regexp_extract(label, r"Q([1-4])", 1), F.lit("")).cast("int")
    return F.when(year.isNotNull() & quarter.isNotNull(), fiscal_cohort(F.make_date(year, quarter * 3 - 1, F.lit(1)), first_month))


def month_end(start, cap: str) -> Column:
    """Last day of the month, at most the latest snapshot's."""
    return F.least(F.last_day(start), F.lit(cap).cast("date"))


def has_channel(channel, part: str) -> Column:
    """Whether a channel code names this part (EM in EM_IM, but not in EMX)."""
    return F.array_contains(F.split(F.trim(channel), "_"), part)
