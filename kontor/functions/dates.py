"""Calendar helpers on timestamp_ntz columns (no session time zone involved)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kontor.functions.text import strip


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day_of(c) -> Column:
    """Calendar day as DATE (``dt.normalize()``)."""
    return F.to_date(_col(c))


def month_of(c) -> Column:
    """First day of the month as DATE (``to_period('M').to_timestamp()``)."""
    return F.trunc(F.to_date(_col(c)), "MM")


def year_of(c) -> Column:
    return F.year(_col(c)).cast("int")


def year_text(c) -> Column:
    """Year as text, the form the year filters and year charts use."""
    return F.year(_col(c)).cast("string")


def parse_timestamp(c, formats: list[str]) -> Column:
    """First format that parses wins; unparsable text gives null (``errors='coerce'``).

    Returns timestamp_ntz.
    """
    col = strip(_col(c).cast("string"))
    # try_to_timestamp only tests the text (it is zoned); the value comes from
    # to_timestamp_ntz so wall-clock times never pass through a time zone.
    return F.coalesce(*[F.when(F.try_to_timestamp(col, F.lit(f)).isNotNull(),
                               F.to_timestamp_ntz(col, F.lit(f)))
                        for f in formats])
