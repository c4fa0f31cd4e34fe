"""Small hand-made inputs: an eligible one-off payment unless said otherwise."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal
from itertools import count

from paysegments import analysis
from paysegments.sources import tables

OWN = "own"
CFG = analysis(OWN)
_ids = count(1)


def pay(company, at, **fields):
    """One payment row; ``at`` is a date or date-time text, or None."""
    when = None if at is None else datetime.fromisoformat(at)
    row = {
        "company_id": company,
        "payment_id": next(_ids),
        "schedule_id": next(_ids),
        "schedule_type": "one off",
        "payment_type": "Rent",
        "status": "Success",
        "user_type": "business",
        "locale_id": 1,
        "paid_at": when,
        "amount": 10,
    } | fields
    if row["amount"] is not None:
        row["amount"] = Decimal(row["amount"])
    return tuple(row[n] for n in tables.PAYMENTS.names)


def payments(spark, *rows):
    return spark.createDataFrame(list(rows), tables.PAYMENTS)


def segments(spark, *rows):
    """Rows of (company, owner); a bare company id is of the segment."""
    full = [r if isinstance(r, tuple) else (r, OWN) for r in rows]
    return spark.createDataFrame(full, tables.SEGMENTS)


def by_company(df, *cols):
    """Company -> value, or tuple of values; a company must not come twice."""
    rows = df.select("company_id", *cols).collect()
    found = {r[0]: r[1] if len(cols) == 1 else tuple(r)[1:] for r in rows}
    assert len(found) == len(rows)
    return found
