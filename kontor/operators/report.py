"""Reports over the ledger: totals, category and calendar breakdowns, balances
(F1-F21), the movements view (B5) and the orderings the charts use (H*).

Every aggregate is a plain ``groupBy`` (partial aggregation before the
shuffle, so a hot account or category is pre-reduced on the map side) over
exact DECIMAL money, cast to double at the end.  Like pandas' ``groupby``,
null group keys are dropped and a sum over nothing is 0 (S29).
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kontor.functions.dates import day_of, month_of, year_text
from kontor.functions.money import money_out
from kontor.operators import filters
from kontor.operators.categorize import Rewrite, RewriteRule
from kontor.operators.fixed_values import DEFAULT_CATEGORY, DEFAULT_VOCABULARY
from kontor.plans.joins import join_small


def _sum_money(c: str = "amount") -> Column:
    return money_out(F.coalesce(F.sum(c), F.lit(0)))


def _keys_present(df: DataFrame, keys: list[Column]) -> DataFrame:
    return df.filter(functools.reduce(lambda a, b: a & b, [k.isNotNull() for k in keys]))


def _grouped_sum(df: DataFrame, keys: dict[str, Column], out: str = "amount",
                 absolute: bool = False) -> DataFrame:
    df = df.select(*[c.alias(n) for n, c in keys.items()], "amount")
    df = _keys_present(df, [F.col(n) for n in keys])
    total = _sum_money("amount")
    return df.groupBy(*keys).agg((F.abs(total) if absolute else total).alias(out))


# ---------------------------------------------------------------- totals (F1)
def totals_in_out(df: DataFrame) -> DataFrame:
    """total income and total expenses (as a positive number), one pass."""
    return df.agg(
        money_out(F.coalesce(F.sum(F.when(F.col("amount") > 0, F.col("amount"))), F.lit(0)))
        .alias("total_income"),
        money_out(F.abs(F.coalesce(F.sum(F.when(F.col("amount") < 0, F.col("amount"))),
                                   F.lit(0)))).alias("total_expenses"),
    )


# ------------------------------------------------------- categories
def expenses_by_category(df: DataFrame, by: list[str] = ("bank",)) -> DataFrame:
    """``abs(sum(amount))`` of negative movements per category."""
    keys = {b: F.col(b) for b in by} | {"category": F.col("category")}
    return _grouped_sum(filters.expenses(df), keys, absolute=True)


def income_by_category(df: DataFrame, by: list[str] = ("bank",)) -> DataFrame:
    """sum of positive movements per category, ascending by amount (H3)."""
    keys = {b: F.col(b) for b in by} | {"category": F.col("category")}
    return _grouped_sum(filters.income(df), keys).orderBy(*by, "amount", "category")


def category_share(df: DataFrame, by: list[str] = ("bank",)) -> DataFrame:
    """each category's part of the expenses (the pie's percentages).

    The whole is a second, tiny aggregate joined back on ``by`` — not a
    window over everything.
    """
    exp = filters.expenses(df).filter(F.col("category").isNotNull())
    # exact (decimal) sums on both levels, so the ratio does not depend on
    # the order in which partial sums arrive
    cats = exp.groupBy(*by, "category").agg(F.abs(F.sum("amount")).alias("_cat"))
    whole = cats.groupBy(*by).agg(F.sum("_cat").alias("_whole"))
    return (cats.join(whole, list(by), "inner")
            .select(*by, "category", money_out("_cat").alias("amount"),
                    F.when(F.col("_whole") != 0,
                           money_out("_cat") / money_out("_whole")).alias("share")))


# ------------------------------------------------- calendar
def monthly_net(df: DataFrame) -> DataFrame:
    """net cash flow per month (one account: filter first, C14)."""
    return _grouped_sum(df, {"month": month_of("date")})


def monthly_net_by_bank(df: DataFrame) -> DataFrame:
    """net cash flow per account and month."""
    return _grouped_sum(df, {"bank": F.col("bank"), "month": month_of("date")})


def expenses_by_category_year(df: DataFrame) -> DataFrame:
    """``abs(sum)`` of expenses per category and year (year as text)."""
    return _grouped_sum(filters.expenses(df),
                        {"category": F.col("category"), "year": year_text("date")},
                        absolute=True)


def income_by_category_year(df: DataFrame) -> DataFrame:
    """income per category and year (year as text)."""
    return _grouped_sum(filters.income(df),
                        {"category": F.col("category"), "year": year_text("date")})


def _rewritten_totals(df: DataFrame, keys: dict[str, Column], label_col: str,
                      rewrites: list[RewriteRule]) -> DataFrame:
    """Sums per key and rewritten label: summed per original label and amount class first
    (combined on the map side), so that only these few rows are rewritten."""
    rewrite = Rewrite(rewrites)
    sums = df.groupBy(*[c.alias(n) for n, c in keys.items()], F.col(label_col).alias("_text"),
                      rewrite.amount_class(F.col("amount")).alias("_place")).agg(
        F.sum("amount").alias("amount"))
    return _grouped_sum(rewrite.fold(sums, "_text", "_place", "label"),
                        {n: F.col(n) for n in [*keys, "label"]})


def label_totals(df: DataFrame, label_col: str = "concept",
                 rewrites: list[RewriteRule] | None = None) -> DataFrame:
    """sum of amounts per label, after D3/D4's rewrites if given."""
    if rewrites:
        return _rewritten_totals(df, {}, label_col, rewrites)
    return _grouped_sum(df, {"label": F.col(label_col)})


def year_label_totals(df: DataFrame, label_col: str = "concept",
                      exclude: list[str] | None = None,
                      rewrites: list[RewriteRule] | None = None) -> DataFrame:
    """sum per year and label, after D3/D4's rewrites if given; C12 drops listed
    labels afterwards."""
    year = {"year": year_text("date")}
    if rewrites:
        out = _rewritten_totals(df, year, label_col, rewrites)
    else:
        out = _grouped_sum(df, year | {"label": F.col(label_col)})
    return filters.exclude_labels(out, exclude, "label") if exclude else out


def category_rank(df: DataFrame) -> DataFrame:
    """H4: expenses per category and year, with categories ordered by their
    total over all years (the stacked bars' axis order).

    Both levels are exact sums; the ranking window runs over one row per
    category (the vocabulary size), never over ledger rows.
    """
    exp = filters.expenses(df).filter(F.col("category").isNotNull() & F.col("date").isNotNull())
    by = exp.groupBy("category", year_text("date").alias("year")).agg(
        F.abs(F.sum("amount")).alias("_amt"))
    totals = by.groupBy("category").agg(F.sum("_amt").alias("_tot"))
    ranked = totals.withColumn(
        "category_rank",
        F.dense_rank().over(Window.orderBy(F.desc("_tot"), "category")).cast("int"))
    return (by.join(ranked, "category", "inner")
            .select("category", "year", money_out("_amt").alias("amount"),
                    money_out("_tot").alias("category_total"), "category_rank")
            .orderBy("category_rank", "year"))


# ------------------------------------------------------ balances
def _with_balance(df: DataFrame) -> DataFrame:
    """Rows with a balance, an account and a date (null group keys are dropped)."""
    return df.filter(F.col("balance").isNotNull() & F.col("bank").isNotNull()
                     & F.col("date").isNotNull())


def _last_balance(df: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Balance of the last movement in ledger order (date, src_file, src_row) per key.

    First per key and file, by time and row packed into one number (a fixed-width
    order that Spark aggregates by hashing, without sorting the ledger), then
    over the files.
    """
    day = F.unix_date(F.to_date("date")).cast("decimal(38,0)")
    seconds = F.hour("date") * 3600 + F.minute("date") * 60
    micros = (F.date_format("date", "ssSSSSSS").cast("long") + seconds.cast("long") * 1_000_000)
    # 86,400,000,000 microseconds a day; rows take the last 19 digits
    time = (day * F.lit(86_400_000_000) + micros).cast("decimal(19,0)")
    packed = (time * F.lit("1" + "0" * 19).cast("decimal(20,0)")
              + F.coalesce("src_row", F.lit(0))).cast("decimal(38,0)")
    per_file = (_with_balance(df).groupBy(*[c.alias(k) for k, c in keys.items()], "src_file")
                .agg(F.max_by("balance", packed).alias("balance"), F.max(time).alias("_time"),
                     F.max(packed).alias("_at")))
    return per_file.groupBy(*keys).agg(
        money_out(F.max_by("balance", F.struct("_time", "src_file", "_at"))).alias("balance"))


def eod_balance(df: DataFrame) -> DataFrame:
    """F8: balance at the end of each day per account: the last movement of the
    day in ledger order (date, src_file, src_row)."""
    return _last_balance(df, {"bank": F.col("bank"), "date": day_of("date")})


def eod_balance_chart(df: DataFrame) -> DataFrame:
    """the single-account chart's variant.  Rows there are sorted by date
    descending and balance ascending, and the day's *last* row is taken: the
    earliest movement of the day, and of those the highest balance."""
    highest = (_with_balance(df).groupBy("bank", day_of("date").alias("day"), "date")
               .agg(F.max("balance").alias("balance")))
    return (highest.groupBy("bank", "day")
            .agg(money_out(F.min_by("balance", "date")).alias("balance"))
            .withColumnRenamed("day", "date"))


def latest_balance(df: DataFrame) -> DataFrame:
    """last known balance per account (all rows, any currency)."""
    return _last_balance(df, {"bank": F.col("bank")})


# ------------------------------------------------------------ summary
def movement_summary(df: DataFrame, by: list[str] = ("bank",)) -> DataFrame:
    """the movements table footer: total, average per active month and per
    active year, for income (amount >= 0) and expenses (amount < 0, shown
    positive).  Averages divide by months/years with a movement of that side.
    """
    side = F.when(F.col("amount") >= 0, F.lit("income")).otherwise(F.lit("expenses"))
    # a row without a date still counts in the totals, just not as an active
    # month or year (count_distinct skips nulls)
    rows = df.filter(F.col("amount").isNotNull()
                     & functools.reduce(lambda a, b: a & b,
                                        [F.col(b).isNotNull() for b in by])).select(
        *by, side.alias("side"), F.abs("amount").alias("amount"),
        F.date_format("date", "yyyy-MM").alias("_ym"), year_text("date").alias("_y"))
    agg = rows.groupBy(*by, "side").agg(
        _sum_money("amount").alias("total"),
        F.count_distinct("_ym").cast("long").alias("n_months"),
        F.count_distinct("_y").cast("long").alias("n_years"))
    return (agg
            .withColumn("monthly_avg", F.col("total") / F.col("n_months").cast("double"))
            .withColumn("yearly_avg", F.col("total") / F.col("n_years").cast("double")))


# -------------------------------------------------------- calendar
def date_bounds(df: DataFrame) -> DataFrame:
    """first and last calendar day (the default date range)."""
    return df.agg(F.min(day_of("date")).alias("start_date"),
                  F.max(day_of("date")).alias("end_date"))


def distinct_banks(df: DataFrame) -> DataFrame:
    """Account names, sorted."""
    return df.select("bank").filter(F.col("bank").isNotNull()).distinct().orderBy("bank")


def distinct_years(df: DataFrame, by: list[str] = ("bank",)) -> DataFrame:
    """Years with movements (text), newest first."""
    return (df.select(*by, year_text("date").alias("year")).filter(F.col("year").isNotNull())
            .distinct().orderBy(*by, F.desc("year")))


# ----------------------------------------------------------- movements
def vocabulary_category(category: Column, vocabulary: list[str] | None) -> Column:
    """A category outside the vocabulary shows as 'other' (null too)."""
    vocab = DEFAULT_VOCABULARY if vocabulary is None else vocabulary
    return F.when(F.coalesce(category.isin(vocab), F.lit(False)), category) \
        .otherwise(F.lit(DEFAULT_CATEGORY))


def movements_view(df: DataFrame, vocabulary: list[str] | None = None,
                   sort: bool = True) -> DataFrame:
    """The editable table: day as yyyy-MM-dd, money rounded half-even
    to cents, unknown categories as 'other'; newest first, then by balance."""
    out = df.select(
        "bank", "tx_id",
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        "concept",
        money_out(F.bround("amount", 2)).alias("amount"),
        money_out(F.bround("balance", 2)).alias("balance"),
        vocabulary_category(F.col("category"), vocabulary).alias("category"),
        F.col("date").alias("_ts"))
    if sort:
        out = out.orderBy("bank", F.desc_nulls_last("_ts"), F.asc_nulls_last("balance"))
    return out.drop("_ts")


def sort_by(df: DataFrame, col: str, ascending: bool = True) -> DataFrame:
    """H8: a user-chosen column sort (header click)."""
    return df.orderBy(F.asc_nulls_last(col) if ascending else F.desc_nulls_last(col))


# ----------------------------------------------------------- banks
def with_currency(df: DataFrame, bank_currency: DataFrame, default: str = "€") -> DataFrame:
    """Attach each account's currency from the bank table (default €)."""
    dim = bank_currency.select("bank", F.col("currency").alias("_cur"))
    return (join_small(df, dim, "bank", "left")
            .withColumn("currency", F.coalesce("_cur", F.lit(default))).drop("_cur"))


def base_currency_only(df: DataFrame, bank_currency: DataFrame, base: str = "€") -> DataFrame:
    """C11: keep accounts in the base currency (cross-account totals mix none)."""
    other = bank_currency.filter(F.col("currency") != base).select("bank")
    return join_small(df, other, "bank", "left_anti")



# ------------------------------------------------------- batch report (Entry 3)
def report_tables(ledger: DataFrame, as_of, bank_currency: DataFrame | None = None
                  ) -> dict[str, DataFrame]:
    """The static report's content as tables (the charts themselves are not
    drawn): overview balances, monthly net per account, expenses and income by
    category and year, per-account balance / expense pie / monthly flow,
    next-month forecasts, and the headline metrics.  Transfers are hidden in
    the flow tables, as in the report; balances use every row."""
    from kontor.operators.forecast import forecast_next_month

    flow = filters.hide_transfers(ledger)
    if bank_currency is not None:
        flow_base = base_currency_only(flow, bank_currency)
    else:
        flow_base = flow
    return {
        "overview_balance": eod_balance(ledger),
        "overview_monthly_net": monthly_net_by_bank(flow_base),
        "overview_expenses": expenses_by_category_year(flow_base),
        "overview_income": income_by_category_year(flow_base),
        "bank_balance": eod_balance(flow),
        "bank_expense_share": category_share(flow),
        "bank_monthly_net": monthly_net_by_bank(flow),
        "bank_forecast": forecast_next_month(ledger, as_of),
        "metric_latest_balance": latest_balance(ledger),
        "metric_totals": totals_in_out(flow_base),
    }


def write_report_tables(ledger: DataFrame, as_of, path: str,
                        bank_currency: DataFrame | None = None, mode: str = "overwrite") -> list[str]:
    """Write every report table under ``path/<name>`` (parquet); returns the names."""
    tables = report_tables(ledger, as_of, bank_currency)
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{path.rstrip('/')}/{name}")
    return list(tables)
