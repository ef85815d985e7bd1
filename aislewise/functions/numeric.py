"""Number helpers with one fixed meaning each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column | str, places: int = 4) -> Column:
    """Decimal rounding for reports.  The tiny shift keeps exact ties from depending on the
    order in which a sum was built; adding zero turns a negative zero into zero."""
    col = F.col(value) if isinstance(value, str) else value
    return F.round(col + F.lit(1e-9), places) + F.lit(0.0)


def parse_price(text: Column) -> Column:
    """Price text with comma or dot; null when it is not a number."""
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def planar(dx: Column, dz: Column) -> Column:
    return F.sqrt(dx * dx + dz * dz)


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), 0)
