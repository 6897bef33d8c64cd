"""Text forms of values, matching the formats the ids and searches are built on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# What Python's str.strip() takes off: all Unicode white space and the four
# separators U+001C to U+001F.
_BLANK = (r"[\t-\r\x1c-\x20\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f"
          r"\u3000]")
_EDGES = rf"\A{_BLANK}+|{_BLANK}+\z"


def strip(c) -> Column:
    """Python ``str.strip()``: all surrounding white space, not only U+0020."""
    return F.regexp_replace(_col(c), _EDGES, "")


def concept_key(c) -> Column:
    """Normal form used by prefix matching: stripped, lower case; null -> 'nan'."""
    return F.lower(strip(F.coalesce(_col(c).cast("string"), F.lit("nan"))))


def _plain_text(c) -> Column:
    # positional text of the value as a double, trailing zeros removed: '12.50' -> '12.5',
    # '3.00' -> '3.'.  Up to 13 digits and cents the decimal's own digits are the
    # double's; beyond, the double's shortest form counts, as it does for a float
    x = _col(c)
    cents = x.cast("decimal(38,2)")
    exact = (x == cents) & (F.abs(cents) < F.lit(10 ** 13))
    digits = F.when(exact, x.cast("decimal(38,18)")) \
        .otherwise(x.cast("double").cast("string").try_cast("decimal(38,18)"))
    return F.regexp_replace(digits.cast("string"), r"(\.\d*?)0+$", "$1")


def py_float_text(c) -> Column:
    """Python ``repr(float(x))``: '12.5', '3.0', '-0.1', '1e+17', '1.5e-05'; null gives 'nan'
    (what ``f"{x}"`` prints for a missing float)."""
    x = _col(c).cast("double")
    t = _plain_text(c)
    plain = F.when(t.endswith("."), F.concat(t, F.lit("0"))).otherwise(t)
    # from 1e16 on and below 1e-4 Python writes an exponent of two digits or more
    java = F.split(x.cast("string"), "E")
    power = F.try_element_at(java, F.lit(2)).cast("int")
    scientific = F.concat(F.regexp_replace(java[0], r"\.0$", ""), F.lit("e"),
                          F.when(power < 0, F.lit("-")).otherwise(F.lit("+")),
                          F.when(F.abs(power) < 10, F.lit("0")).otherwise(F.lit("")),
                          F.abs(power).cast("string"))
    large = (F.abs(x) >= 1e16) | ((F.abs(x) < 1e-4) & (x != 0))
    return F.coalesce(F.when(large, scientific).otherwise(plain), F.lit("nan"))


def js_number_text(c) -> Column:
    """JavaScript ``String(x)`` for money-sized values: '12.5', '3', '-0.1'."""
    t = _plain_text(c)
    return F.regexp_replace(t, r"\.$", "")


def iso_timestamp_text(c) -> Column:
    """Python ``Timestamp.isoformat()``: seconds always, microseconds only if non-zero."""
    ts = _col(c)
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.when(micros == "000000", base).otherwise(F.concat(base, F.lit("."), micros))
