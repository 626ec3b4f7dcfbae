"""Run parameters. Nothing in the package reads the wall clock: ``as_of`` is always given."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date

# Booking states that count as a booking.
SLOT_STATES = ("EVALUATED", "PUBLISHED", "NO_SHOW", "NO_SHOW_EXCUSED", "CANCELLED")

PERIODS = ("day", "week", "month", "quarter")


@dataclass(frozen=True)
class Params:
    """Thresholds and windows shared by the operators.

    ``period='week'`` gives Monday weeks. The other units run the same operators on a coarser or
    finer time axis.

    ``country`` keeps the rows of one country. Sources that write its code in their own way (``contacts``,
    ``tickets``, ``applicants``) have it in ``country_codes`` as pairs of source and code. ``label`` is what the
    results call the country.
    """

    as_of: date
    start: date
    history_start: date | None = date(2021, 1, 1)
    period: str = "week"
    n_periods: int = 8
    country: str | None = None
    country_codes: tuple[tuple[str, str], ...] = ()
    label: str | None = None
    slot_states: tuple[str, ...] = SLOT_STATES
    newbie_days: int = 30
    churn_days: int = 14
    newbie_churn_days: int | None = None
    kpi_lookback: int = 8
    gap_lookback: int = 16
    early_lookback_days: int | None = 60
    seconds_per_hour: float = 3600.0
    horizon: int = 2
    max_offset: int = 6

    def __post_init__(self) -> None:
        if self.period not in PERIODS:
            raise ValueError(f"period must be one of {PERIODS}, got {self.period!r}")
        if self.start > self.as_of:
            raise ValueError("start lies after as_of")
        if self.n_periods < 1:
            raise ValueError("n_periods must be positive")

    def country_of(self, source: str) -> str | None:
        """The code of the country in a source."""
        return None if self.country is None else dict(self.country_codes).get(source, self.country)

    @property
    def country_label(self) -> str:
        return self.label or self.country or "ALL"

    def but(self, **changes) -> "Params":
        return replace(self, **changes)
