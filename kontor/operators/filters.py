"""Row filters over the ledger.

Literal lists become ``IN`` predicates (pushed to the parquet scan when they
touch a stored column); lists given as DataFrames become semi/anti joins with
a size-checked broadcast.
"""

from __future__ import annotations

import datetime as dt
import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kontor.functions.text import js_number_text
from kontor.operators.fixed_values import TRANSFER_CATEGORIES
from kontor.plans.joins import join_small


def date_range(df: DataFrame, start: dt.date | str, end: dt.date | str,
               col: str = "date") -> DataFrame:
    """Calendar day of ``col`` within [start, end]; null dates fail."""
    d = F.to_date(F.col(col))
    return df.filter(d.between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def hide_transfers(df: DataFrame, categories: list[str] = TRANSFER_CATEGORIES,
                   col: str = "category") -> DataFrame:
    """Drop transfers between accounts; a null category is kept."""
    return df.filter(~F.coalesce(F.col(col).isin(categories), F.lit(False)))


def income(df: DataFrame, col: str = "amount") -> DataFrame:
    """Strictly positive amounts."""
    return df.filter(F.col(col) > 0)


def expenses(df: DataFrame, col: str = "amount") -> DataFrame:
    """Strictly negative amounts (zero is neither)."""
    return df.filter(F.col(col) < 0)


def notebook_expenses(df: DataFrame, col: str = "amount") -> DataFrame:
    """C4: the notebook's split, where zero counts as an expense."""
    return df.filter(F.col(col) <= 0)


def notebook_income(df: DataFrame, col: str = "amount") -> DataFrame:
    """C4: positive amounts in the notebook's split."""
    return df.filter(F.col(col) > 0)


def in_selection(df: DataFrame, categories: list[str] | DataFrame | None = None,
                 years: list[str] | DataFrame | None = None,
                 category_col: str = "category", date_col: str = "date") -> DataFrame:
    """Category IN selection and year (as text) IN selection.

    ``None`` means "not filtered"; an empty list means "nothing selected" and
    gives no rows, as a cleared checklist does.
    """
    if categories is not None:
        df = _member(df, F.col(category_col), categories, "category")
    if years is not None:
        df = _member(df, F.year(date_col).cast("string"), years, "year")
    return df


def _member(df: DataFrame, key: Column, values, name: str) -> DataFrame:
    if isinstance(values, DataFrame):
        tmp = f"_{name}_key"
        out = join_small(df.withColumn(tmp, key),
                         values.select(F.col(values.columns[0]).alias(tmp)).distinct(),
                         tmp, "left_semi")
        return out.drop(tmp)
    return df.filter(key.isin(list(values)))


def search(df: DataFrame, terms: dict[str, str]) -> DataFrame:
    """Per-column, case-insensitive "contains", all terms ANDed.

    ``terms`` maps a column to its search text.  Numbers are searched in their
    JavaScript text form (12.5 -> '12.5', 3.0 -> '3'); dates as yyyy-MM-dd.
    """
    conds = []
    for col, term in terms.items():
        if term is None or term == "":
            continue
        dtype = df.schema[col].dataType.typeName()
        if dtype in ("decimal", "double", "float", "integer", "long"):
            text = js_number_text(F.col(col))
        elif dtype in ("timestamp_ntz", "timestamp", "date"):
            text = F.date_format(F.col(col), "yyyy-MM-dd")
        else:
            text = F.col(col).cast("string")
        conds.append(F.coalesce(F.lower(text).contains(term.lower()), F.lit(False)))
    if not conds:
        return df
    return df.filter(functools.reduce(lambda a, b: a & b, conds))


def drop_nulls(df: DataFrame, subset: list[str]) -> DataFrame:
    """C8."""
    return df.dropna(subset=subset)


def completed_months(df: DataFrame, as_of: dt.date | str, col: str = "date") -> DataFrame:
    """Rows dated before the first day of ``as_of``'s month."""
    start = F.trunc(F.lit(as_of).cast("date"), "MM")
    return df.filter(F.to_date(F.col(col)) < start)


def exclude_labels(df: DataFrame, labels: list[str], col: str = "concept") -> DataFrame:
    """Drop exact labels."""
    return df.filter(~F.coalesce(F.col(col).isin(labels), F.lit(False)))


def text_contains(df: DataFrame, text: str, col: str = "concept") -> DataFrame:
    """Substring lookup (case-sensitive, literal)."""
    return df.filter(F.col(col).contains(text))


def one_bank(df: DataFrame, bank: str, col: str = "bank") -> DataFrame:
    """C14."""
    return df.filter(F.col(col) == bank)


def not_overridden(df: DataFrame, overrides: DataFrame, key: str = "tx_id") -> DataFrame:
    """Rows whose id has no override yet."""
    return join_small(df, overrides.select(key).distinct(), key, "left_anti")
