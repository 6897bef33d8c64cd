"""Workbook layouts over ``raw_cells(path, row_no, cells array<string>)``.

Decoding xls/xlsx bytes is left to whatever produces ``raw_cells`` (one row
per sheet row, cells as text).  Each layout is a small aggregate per file
(its header row and role positions) joined back to one pass over the rows,
where every step is a column expression:

* yearly layout (A4-A7): header searched in rows 0..6 by column-role
  keywords, positional fallback when no row has all four roles, per-file date
  order (stem ``2020`` is month-first);
* wide layout (A8-A10): header = first of rows 0..5 with a date word; split
  income/expense columns; description assembled from two text columns;
* old layout (A11): no header in rows 0..5; fixed six columns after 3 rows.

Role tables are parameters; the defaults below are the keywords the layouts
are recognised by.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kontor.functions.dates import parse_timestamp
from kontor.functions.money import plain_money
from kontor.functions.text import strip
from kontor.operators.categorize import Rules, categorize
from kontor.operators.fixed_values import DEFAULT_RULES
from kontor.operators.identity import dedup
from kontor.plans.joins import join_small
from kontor.schema import LEDGER_COLUMNS, MONEY
from kontor.sources.files import counted

# ---- FIXED VALUES: header keywords of the workbook layouts ----
YEARLY_DATE_WORDS = ["fecha", "date", "f. operaci", "operaci"]
YEARLY_DATE_EXCLUDED = ["valor", "value"]
YEARLY_CONCEPT_NAMES = ["concepto", "descripcion", "descripción", "description", "concept",
                        "movimiento"]
YEARLY_AMOUNT_WORDS = ["importe", "amount"]
YEARLY_BALANCE_WORDS = ["saldo", "balance"]
YEARLY_HEADER_ROWS = 7            # rows 0..6 are tried as the header
YEARLY_MONTH_FIRST_STEM = "2020"
YEARLY_POSITIONS = {"date": 0, "concept": 2, "amount": 3, "balance": 4}
YEARLY_MIN_COLUMNS = 5

WIDE_HEADER_PROBE_ROWS = 6        # rows 0..5 are probed for the header
WIDE_HEADER_WORDS = ["operaci", "fecha", "operation", "operation date"]
WIDE_DATE_WORDS = ["f. operaci", "operaci", "operation date", "operation", "fecha"]
WIDE_INCOME_WORDS = ["ingreso", "income"]
WIDE_EXPENSE_WORDS = ["gasto", "expense"]
WIDE_AMOUNT_WORDS = ["importe", "cantidad", "amount"]
WIDE_BALANCE_WORDS = ["saldo (+)", "balance (+)", "saldo", "balance"]
WIDE_DESC1_WORDS = ["complementario 1", "description 1", "movimiento"]
WIDE_DESC3_WORDS = ["complementario 3", "description 3", "más datos", "mas datos", "details"]
WIDE_OPERATION_PREFIX = "fecha de operaci"
WIDE_OPERATION_WORDS_DROPPED = 4
NO_DESCRIPTION = "no description"
OLD_SKIP_ROWS = 3
# ---- end of fixed values ----

DAY_FIRST = ["d/M/yyyy", "d/M/yyyy H:mm:ss", "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss",
             "yyyy-MM-dd'T'HH:mm:ss", "d-M-yyyy", "M/d/yyyy"]
MONTH_FIRST = ["M/d/yyyy", "M/d/yyyy H:mm:ss", "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss",
               "yyyy-MM-dd'T'HH:mm:ss"]
STRICT_MONTH_FIRST = ["M/d/yyyy"]


# ------------------------------------------------------------------ helpers
def number(c: Column) -> Column:
    """``pd.to_numeric(errors='coerce')`` for text cells: plain numbers only."""
    return plain_money(c)


def _any_word(text: Column, words: list[str]) -> Column:
    low = F.lower(text)
    return functools.reduce(lambda a, b: a | b, [low.contains(w) for w in words])


def first_index(cells: Column, pred) -> Column:
    """0-based position of the first cell satisfying ``pred`` (null if none)."""
    hits = F.filter(F.transform(cells, lambda x, i: F.struct(i.alias("i"), x.alias("v"))),
                    lambda s: F.coalesce(pred(s["v"]), F.lit(False)))
    return F.try_element_at(hits, F.lit(1))["i"]


def cell(cells: Column, idx: Column) -> Column:
    """Cell at a 0-based position (null when out of range or no position)."""
    return F.when(idx.isNotNull(), F.try_element_at(cells, idx + 1))


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


# ----------------------------------------------------------- yearly
def yearly_roles(cells: Column) -> dict[str, Column]:
    """A5: role positions if this row were the header."""
    return {
        "date": first_index(cells, lambda v: _any_word(v, YEARLY_DATE_WORDS)
                            & ~_any_word(v, YEARLY_DATE_EXCLUDED)),
        "concept": first_index(cells, lambda v: F.lower(v).isin(YEARLY_CONCEPT_NAMES)),
        "amount": first_index(cells, lambda v: _any_word(v, YEARLY_AMOUNT_WORDS)),
        "balance": first_index(cells, lambda v: _any_word(v, YEARLY_BALANCE_WORDS)),
    }


def _yearly_files(raw: DataFrame) -> DataFrame:
    """Per file: the first header-like row in 0..6 with its role positions (from those
    rows only), and the file's width (a plain maximum over all rows)."""
    roles = yearly_roles(F.col("cells"))
    is_header = functools.reduce(lambda a, b: a & b, [r.isNotNull() for r in roles.values()])
    heads = (raw.filter(F.col("row_no") < YEARLY_HEADER_ROWS).filter(is_header)
             .groupBy("path").agg(
                 F.min_by(F.struct(*[r.alias(k) for k, r in roles.items()]), "row_no")
                 .alias("roles"),
                 F.min("row_no").alias("header_row")))
    widths = raw.groupBy("path").agg(F.max(F.size("cells")).alias("_width"))
    return widths.join(heads, "path", "left").select("path", "roles", "header_row", "_width")


def parse_yearly(raw: DataFrame) -> DataFrame:
    """Per file, the header is the first of rows 0..6 where date,
    concept, amount and balance all resolve; rows below it are data.  With no
    such row, columns are positional (0 date, 2 concept, 3 amount, 4 balance)
    over all rows, and a file narrower than 5 columns is rejected (see
    ``yearly_rejects``).  Returns (date, concept, amount, balance, src_file,
    src_row); amounts may be null (S7).
    """
    files, few = counted(_yearly_files(raw), "yearly-files")
    rows = join_small(raw, files, "path", "inner", few)
    positional = F.col("header_row").isNull()
    rows = rows.filter((positional & (F.col("_width") >= YEARLY_MIN_COLUMNS)) |
                       (F.col("row_no") > F.col("header_row")))

    def pick(role: str) -> Column:
        idx = F.when(positional, F.lit(YEARLY_POSITIONS[role])).otherwise(F.col(f"roles.{role}"))
        return cell(F.col("cells"), idx)

    month_first = _stem(F.col("path")) == YEARLY_MONTH_FIRST_STEM
    date = (F.when(positional, parse_timestamp(pick("date"), ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss",
                                                             "M/d/yyyy", "d/M/yyyy"]))
            .when(month_first, parse_timestamp(pick("date"), STRICT_MONTH_FIRST))
            .otherwise(parse_timestamp(pick("date"), DAY_FIRST)))
    return rows.select(
        date.alias("date"),
        strip(F.coalesce(pick("concept"), F.lit("nan"))).alias("concept"),
        number(pick("amount")).alias("amount"),
        number(pick("balance")).alias("balance"),
        F.col("path").alias("src_file"),
        F.col("row_no").cast("long").alias("src_row"))


def yearly_rejects(raw: DataFrame) -> DataFrame:
    """Files with neither a header nor 5 columns (an error in the original)."""
    files = _yearly_files(raw)
    return files.filter(F.col("header_row").isNull() &
                        (F.col("_width") < YEARLY_MIN_COLUMNS)).select("path")


# --------------------------------------------------------- wide
def _wide_roles(cells: Column) -> dict[str, Column]:
    return {
        "date": first_index(cells, lambda v: _any_word(v, WIDE_DATE_WORDS)),
        "income": first_index(cells, lambda v: _any_word(v, WIDE_INCOME_WORDS)),
        "expense": first_index(cells, lambda v: _any_word(v, WIDE_EXPENSE_WORDS)),
        "amount": first_index(cells, lambda v: _any_word(v, WIDE_AMOUNT_WORDS)),
        "balance": first_index(cells, lambda v: _any_word(v, WIDE_BALANCE_WORDS)),
        "desc1": first_index(cells, lambda v: _any_word(v, WIDE_DESC1_WORDS)),
        "desc3": first_index(cells, lambda v: _any_word(v, WIDE_DESC3_WORDS)),
    }


def _header_rows(raw: DataFrame) -> DataFrame:
    """First of rows 0..5 with any cell containing a date word, per file."""
    probe = raw.filter(F.col("row_no") < WIDE_HEADER_PROBE_ROWS)
    hit = probe.filter(F.exists("cells", lambda v: F.coalesce(_any_word(v, WIDE_HEADER_WORDS),
                                                              F.lit(False))))
    return hit.groupBy("path").agg(F.min_by("cells", "row_no").alias("hdr"),
                                   F.min("row_no").alias("header_row"))


def concept_from_descriptions(c1: Column, c3: Column) -> Column:
    """A10: description 1 (minus a 'fecha de operación <date>' lead) plus
    description 3 when it is not already part of it; default text if both empty."""
    def without_lead(p: Column) -> Column:
        words = F.split(p["c1"], r"\s+")
        tail = strip(F.array_join(F.slice(words, WIDE_OPERATION_WORDS_DROPPED + 1,
                                          F.greatest(F.size(words), F.lit(1))), " "))
        led = F.lower(p["c1"]).startswith(WIDE_OPERATION_PREFIX)
        return F.struct(F.when(led, tail).otherwise(p["c1"]).alias("c1"), p["c3"].alias("c3"))

    def first_filled(p: Column) -> Column:
        return F.struct(F.when(p["c1"] != "", p["c1"]).otherwise(p["c3"]).alias("text"),
                        p["c3"].alias("c3"))

    def with_details(p: Column) -> Column:
        return F.when((p["c3"] != "") & ~p["text"].contains(p["c3"]),
                      strip(F.concat(p["text"], F.lit(" "), p["c3"]))).otherwise(p["text"])

    # each step names its input several times; a lambda computes it once
    value = F.array(F.struct(F.coalesce(strip(c1), F.lit("")).alias("c1"),
                             F.coalesce(strip(c3), F.lit("")).alias("c3")))
    for step in (without_lead, first_filled, with_details,
                 lambda text: F.when(text == "", F.lit(NO_DESCRIPTION)).otherwise(text)):
        value = F.transform(value, step)
    return F.get(value, F.lit(0))


def _wide_files(raw: DataFrame) -> DataFrame:
    """Per wide-layout file: header row, role positions, and whether the file
    is usable (date, balance and some amount column found)."""
    hdr = _header_rows(raw)
    roles = _wide_roles(F.col("hdr"))
    files = hdr.select("path", "header_row", *[r.alias(f"_{k}") for k, r in roles.items()])
    return files.withColumn("_usable", F.col("_date").isNotNull() & F.col("_balance").isNotNull() &
                            (F.col("_income").isNotNull() | F.col("_expense").isNotNull() |
                             F.col("_amount").isNotNull()))


def parse_multi_layout(raw: DataFrame) -> DataFrame:
    """A8-A11 in one pass over the cells: each file is wide (a header in rows
    0..5) or old (no header), decided per file; the row expressions pick the
    layout's columns.  Adds ``layout`` ('wide' / 'old').

    Wide: rows below the header that are not entirely empty.  Amount:
    income - expense (missing as 0) when both columns exist, the one column
    as is when only one does (S21), else the amount column.  Balance: the
    first balance column, i.e. the positive one (S20).  Files lacking a date
    or balance column, or any amount column, give no rows (``wide_rejects``).
    Old: rows from row 3; date, value date, concept, details, amount, balance;
    details appended to the concept when present.
    """
    files, few = counted(_wide_files(raw), "wide-files")
    rows = join_small(raw, files, "path", "left", few)
    wide = F.col("header_row").isNotNull()
    rows = rows.filter(
        (wide & F.col("_usable") & (F.col("row_no") > F.col("header_row"))
         & F.exists("cells", lambda v: v.isNotNull()))
        | (~wide & (F.col("row_no") >= OLD_SKIP_ROWS)))

    def at(role: str) -> Column:
        return cell(F.col("cells"), F.col(f"_{role}"))

    def pos(i: int) -> Column:
        return F.try_element_at(F.col("cells"), F.lit(i + 1))

    inc, exp = number(at("income")), number(at("expense"))
    has_inc, has_exp = F.col("_income").isNotNull(), F.col("_expense").isNotNull()
    wide_amount = (F.when(has_inc & has_exp, F.coalesce(inc, F.lit(0)) - F.coalesce(exp, F.lit(0)))
                   .when(has_inc, inc).when(has_exp, exp)
                   .otherwise(number(at("amount")))).cast(MONEY)
    details = pos(3)
    old_text = F.coalesce(pos(2), F.lit("nan"))
    old_concept = F.when(details.isNotNull(), strip(F.concat(old_text, F.lit(" "), details))) \
        .otherwise(old_text)
    return rows.select(
        F.when(wide, parse_timestamp(at("date"), DAY_FIRST))
         .otherwise(parse_timestamp(pos(0), MONTH_FIRST)).alias("date"),
        F.when(wide, concept_from_descriptions(at("desc1"), at("desc3")))
         .otherwise(old_concept).alias("concept"),
        F.when(wide, wide_amount).otherwise(number(pos(4))).alias("amount"),
        F.when(wide, number(at("balance"))).otherwise(number(pos(5))).alias("balance"),
        F.col("path").alias("src_file"),
        F.col("row_no").cast("long").alias("src_row"),
        F.when(wide, F.lit("wide")).otherwise(F.lit("old")).alias("layout"))


def parse_wide(raw: DataFrame) -> DataFrame:
    """The wide-layout files' movements."""
    return parse_multi_layout(raw).filter(F.col("layout") == "wide").drop("layout")


def parse_old(raw: DataFrame) -> DataFrame:
    """The old-layout files' movements."""
    return parse_multi_layout(raw).filter(F.col("layout") == "old").drop("layout")


def wide_rejects(raw: DataFrame) -> DataFrame:
    """Wide-layout files missing a date, balance or amount column."""
    return _wide_files(raw).filter(~F.col("_usable")).select("path")


# ------------------------------------------------------------- loaders
def finish_bank(parsed: DataFrame, bank: str, required: list[str],
                rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Tag the account, strip the concept, categorise (D1), drop rows
    missing a required column (C8), remove duplicates keeping the first (G1)."""
    df = (parsed.withColumn("bank", F.lit(bank))
          .withColumn("concept", strip(F.coalesce(F.col("concept"), F.lit("nan")))))
    df = categorize(df, "concept", "category", rules).dropna(subset=required)
    return dedup(df.select(*LEDGER_COLUMNS))


def load_yearly_bank(raw: DataFrame, bank: str, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """One-file-per-year account: only the date is required."""
    return finish_bank(parse_yearly(raw), bank, ["date"], rules)


def load_multi_layout_bank(raw: DataFrame, bank: str, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Wide or old layout per file: date and amount required."""
    return finish_bank(parse_multi_layout(raw).drop("layout"), bank, ["date", "amount"], rules)


def head_rows(raw: DataFrame, n: int, first_cols: int = 6) -> DataFrame:
    """The first ``n`` rows and first ``first_cols`` columns of a sheet
    (``read_excel(nrows=n, usecols='A:F')``)."""
    return raw.filter(F.col("row_no") < n).withColumn("cells", F.slice("cells", 1, first_cols))
