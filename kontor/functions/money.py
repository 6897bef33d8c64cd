"""Money columns: wide exact decimals inside, double at the edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kontor.functions.text import strip
from kontor.schema import MONEY


def money(c) -> Column:
    """Any numeric column as exact money (rounds half-up to its last decimal)."""
    return F.col(c).cast(MONEY) if isinstance(c, str) else c.cast(MONEY)


def parse_money(c) -> Column:
    """Text such as ``-1,234.56`` or ``12.5`` to money; bad text gives null."""
    col = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(strip(col), ",", "").try_cast(MONEY)


def plain_money(c) -> Column:
    """Text holding a plain number (no thousands commas) to money; other text gives null,
    as ``pd.to_numeric(errors="coerce")`` does."""
    return strip(c).try_cast(MONEY)


def money_out(c) -> Column:
    """Money (or a sum of money) as the double the outputs carry."""
    return (F.col(c) if isinstance(c, str) else c).cast("double")
