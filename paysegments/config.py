"""What counts as an eligible payment, and the dates the features hang on."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from datetime import date


@dataclass(frozen=True)
class SegmentConfig:
    """Parameters shared by every feature query.

    ``window_start=None`` means "all history up to ``window_end``".
    """

    segment: str
    excluded_statuses: tuple[str, ...]
    user_types: tuple[str, ...]
    locale: int | str
    anchor: date
    window_start: date | None
    window_end: date
    recent_since: date
    payment_types: tuple[str, ...]
    one_off: str = "one off"
    recurring: str = "recurring"
    # Days since the first payment are read as "390 minus the days" before the log.
    recency_ceiling: int = 390

    def all_history(self) -> SegmentConfig:
        return replace(self, window_start=None)


def slug(name: str) -> str:
    """Column-name form of a category: ``Condo & MCST fees`` -> ``condo_mcst_fees``."""
    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")


def analysis(segment: str) -> SegmentConfig:
    """The categories and dates of the original analysis, for a segment of the caller's."""
    return replace(_FIXED, segment=segment)


# The categories and dates the original analysis was run with.
_FIXED = SegmentConfig(
    segment="",
    excluded_statuses=("Payment Failed", "Cancelled", "Refunded", "Refunding"),
    user_types=("business", "guest"),
    locale=1,
    anchor=date(2024, 9, 1),
    window_start=date(2023, 9, 1),
    window_end=date(2024, 8, 31),
    recent_since=date(2024, 6, 1),
    payment_types=(
        "Condo & MCST fees",
        "Payroll",
        "Property Tax",
        "Helper Salary",
        "Income Tax",
        "Rent",
        "Car Loan",
        "Mortgage",
        "Education",
        "Corporate Tax",
        "Supplier",
        "Renovation",
        "Electricity",
        "Insurance",
        "Stamp Duty",
        "GST",
        "Misc",
        "Parking",
    ),
)
