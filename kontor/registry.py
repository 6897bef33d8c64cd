"""The registered queries: each takes (spark, tables_dir) and returns a DataFrame.

Every query reads the given tables (through the stand-in shapers of
``sources.standin``) and runs the library's operators on all of their rows.
Column names match ``kontor.oracle_sql`` one for one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kontor.functions.money import money_out
from kontor.operators import filters, forecast, identity, learning, overrides, report
from kontor.operators.balance import running_balance
from kontor.operators.categorize import (categorize, categorize_by_table,
                                          sequential_rewrite)
from kontor.operators.fixed_values import DEFAULT_VOCABULARY
from kontor.operators.ledger import build_ledger
from kontor.sources import card_csv
from kontor.sources import standin as S
from kontor.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(fn: Query | None = None, *, name: str | None = None):
    """Add a query under its function name (or ``name``)."""
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        return f
    return add(fn) if fn is not None else add


def ledger(spark: SparkSession, d: str, with_balance: bool = True) -> DataFrame:
    """The stand-in ledger: orders as movements, stand-in rules, running balance."""
    return build_ledger(S.orders_movements(spark, d), S.STANDIN_RULES,
                        with_balance=with_balance)


def _money_cols(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, money_out(c))
    return df


# ------------------------------------------------------------ step 0-1: reports
@register
def monthly_net_by_bank(spark, d):
    """F5 after C2: net cash flow per account and month, transfers hidden."""
    return report.monthly_net_by_bank(filters.hide_transfers(ledger(spark, d, False)))


@register
def totals_in_out(spark, d):
    """F1 over base-currency accounts (C11), transfers hidden."""
    lg = filters.hide_transfers(ledger(spark, d, False))
    return report.totals_in_out(report.base_currency_only(lg, S.bank_currency(spark)))


@register
def expenses_by_category(spark, d):
    """F2 per account, transfers hidden."""
    return report.expenses_by_category(filters.hide_transfers(ledger(spark, d, False)))


@register
def income_by_category(spark, d):
    """F3 per account, transfers hidden, ascending."""
    return report.income_by_category(filters.hide_transfers(ledger(spark, d, False)))


@register
def monthly_net(spark, d):
    """F4 for one account (C14), transfers hidden."""
    lg = filters.one_bank(filters.hide_transfers(ledger(spark, d, False)), S.STANDIN_CHART_BANK)
    return report.monthly_net(lg)


@register
def expenses_by_category_year(spark, d):
    """F6 over base-currency accounts, transfers hidden."""
    lg = report.base_currency_only(filters.hide_transfers(ledger(spark, d, False)),
                                   S.bank_currency(spark))
    return report.expenses_by_category_year(lg)


@register
def income_by_category_year(spark, d):
    """F7 over base-currency accounts, transfers hidden."""
    lg = report.base_currency_only(filters.hide_transfers(ledger(spark, d, False)),
                                   S.bank_currency(spark))
    return report.income_by_category_year(lg)


@register
def eod_balance(spark, d):
    """F8: end-of-day balance per account (unfiltered ledger)."""
    return report.eod_balance(ledger(spark, d))


@register
def eod_balance_chart(spark, d):
    """the account chart's end-of-day balance: categories in the vocabulary
    (C7), every year selected (C5)."""
    lg = filters.in_selection(ledger(spark, d), categories=report.DEFAULT_VOCABULARY)
    return report.eod_balance_chart(lg)


@register
def eod_balance_static(spark, d):
    """F9, static-report form: end-of-day balance with transfers removed."""
    return report.eod_balance(filters.hide_transfers(ledger(spark, d)))


@register
def latest_balance(spark, d):
    """last known balance per account."""
    return report.latest_balance(ledger(spark, d))


@register
def movement_summary(spark, d):
    """income/expense totals and per-active-month/year averages per account."""
    return report.movement_summary(ledger(spark, d, False))


@register
def category_share(spark, d):
    """each category's share of the account's expenses, transfers hidden."""
    return report.category_share(filters.hide_transfers(ledger(spark, d, False)))


@register
def date_bounds(spark, d):
    """first and last day of the ledger."""
    return report.date_bounds(ledger(spark, d, False))


@register
def banks_years(spark, d):
    """distinct (account, year) pairs, years as text."""
    return report.distinct_years(ledger(spark, d, False))


@register
def label_totals(spark, d):
    """D3/D4 sequential label rewrite, then F12 totals per label."""
    lg = sequential_rewrite(ledger(spark, d, False), S.standin_rewrites(), "concept")
    return report.label_totals(lg)


@register
def year_label_totals(spark, d):
    """D3/D4, then F13 totals per year and label, C12 excluded labels."""
    lg = sequential_rewrite(ledger(spark, d, False), S.standin_rewrites(), "concept")
    return report.year_label_totals(lg, exclude=S.STANDIN_EXCLUDED_LABELS)


@register
def purchase_labels(spark, d):
    """D3/D4 with 125 rules, exact amounts among them: each purchase's final label."""
    lines = sequential_rewrite(S.purchases(spark, d), S.purchase_rewrites(), "concept", out="label")
    return lines.select("order_key", "line", "concept", "label")


@register
def purchase_label_totals(spark, d):
    """D3/D4 with 125 rules, then F12 totals per label."""
    return report.label_totals(S.purchases(spark, d), rewrites=S.purchase_rewrites())


@register
def purchase_year_label_totals(spark, d):
    """D3/D4 with 125 rules, then F13 totals per year and label without C12's labels."""
    return report.year_label_totals(S.purchases(spark, d), exclude=S.STANDIN_EXCLUDED_PURCHASES,
                                    rewrites=S.purchase_rewrites())


# ------------------------------------------------------- step 2: filters, views
@register
def movements_view(spark, d):
    """B5/H2 with B3 ids: the editable movements table of every account."""
    return report.movements_view(identity.with_tx_id(ledger(spark, d)))


@register
def ledger_by_date(spark, d):
    """H1: the whole ledger in date order (ties in source order)."""
    from kontor.sources.files import ledger_order
    return _money_cols(ledger_order(ledger(spark, d)), "amount", "balance")


@register
def search_movements(spark, d):
    """The table's per-column search boxes, ANDed."""
    view = report.movements_view(identity.with_tx_id(ledger(spark, d)), sort=False)
    return filters.search(view, S.STANDIN_SEARCH)


@register
def category_year_filter(spark, d):
    """Category and year checklists."""
    lg = filters.in_selection(ledger(spark, d, False), S.STANDIN_CATEGORY_SELECTION,
                              S.STANDIN_YEAR_SELECTION)
    return _money_cols(lg.select("bank", "src_row", "category", "amount",
                                 F.year("date").cast("string").alias("year")), "amount")


@register
def date_range(spark, d):
    """Movements whose calendar day is within the sidebar range."""
    lg = filters.date_range(ledger(spark, d, False), *S.STANDIN_DATE_RANGE)
    return _money_cols(lg.select("bank", "src_row", "date", "amount"), "amount")


@register
def hide_transfers(spark, d):
    """Movements that are not transfers between own accounts."""
    return filters.hide_transfers(ledger(spark, d, False)).select("bank", "src_row", "category")


@register
def base_currency_only(spark, d):
    """Per-account currency from the bank table, totals over the
    base-currency accounts only."""
    bc = S.bank_currency(spark)
    lg = report.with_currency(ledger(spark, d, False), bc)
    lg = report.base_currency_only(lg, bc)
    return (lg.groupBy("bank", "currency")
            .agg(money_out(F.coalesce(F.sum(F.when(F.col("amount") > 0, F.col("amount"))),
                                      F.lit(0))).alias("total_income"),
                 money_out(F.abs(F.coalesce(F.sum(F.when(F.col("amount") < 0, F.col("amount"))),
                                            F.lit(0)))).alias("total_expenses")))


@register
def category_rank(spark, d):
    """H4: expense categories ordered by their total over all years."""
    lg = report.base_currency_only(filters.hide_transfers(ledger(spark, d, False)),
                                   S.bank_currency(spark))
    return report.category_rank(lg)


# -------------------------------------------------------------- step 3: identity
@register
def tx_id(spark, d):
    """The stable id of every movement."""
    return identity.with_tx_id(ledger(spark, d, False)).select("bank", "src_row", "tx_id")


@register
def dedup(spark, d):
    """G1 over two exports of the same history (the re-export has shifted times
    and no balance on some rows): first copy in ledger order is kept."""
    lg = ledger(spark, d)
    both = lg.unionByName(S.reexport(lg))
    return _money_cols(identity.dedup(both), "amount", "balance")


@register(name="running_balance")
def running_balance_q(spark, d):
    """Balance after each movement from the signed amounts."""
    mv = S.orders_movements(spark, d)
    return _money_cols(running_balance(mv).select("bank", "src_row", "balance"), "balance")



# ------------------------------------------------------- step 4: categorisation
@register
def categorize_ledger(spark, d):
    """Ordered keyword rules over every movement's concept."""
    mv = S.orders_movements(spark, d)
    return categorize(mv, "concept", "category", S.STANDIN_RULES).select(
        "bank", "src_row", "category")


@register
def categorize_text(spark, d):
    """D1 with the default merchant rules over whole documents."""
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    return categorize(docs, "text", "category").select("doc_id", "category")


@register
def categorize_rule_table(spark, d):
    """D1 from a rule table that grows with the data: one rule for each of two thirds of the
    customers, then one for each market segment; the rules stay a table."""
    rows = S.card_rows(spark, d).select("src_row", F.col("Description").alias("concept"))
    return categorize_by_table(rows, S.customer_rules(spark, d)).select("src_row", "category")


@register
def type_override(spark, d):
    """A1 + D1 + D2: card-export rows, completed only, typed, categorised,
    with the transaction type deciding the category where it applies."""
    rows = card_csv.parse_card_rows(S.card_rows(spark, d), "Card")
    return _money_cols(rows.select("src_row", "date", "concept", "amount", "category"), "amount")


@register(name="sequential_rewrite")
def sequential_rewrite_q(spark, d):
    """The label each movement ends with after the ordered rewrites."""
    lg = sequential_rewrite(ledger(spark, d, False), S.standin_rewrites(), "concept", out="label")
    return lg.select("bank", "src_row", "label")



# ------------------------------------------------------------- step 5: overrides
def _ledger_ids(spark, d):
    return identity.with_tx_id(ledger(spark, d, False))


@register
def apply_overrides(spark, d):
    """D12 then D8/B7: the stored overrides are migrated (retired category to
    'other', as at session start), then replace the automatic categories."""
    lg = _ledger_ids(spark, d)
    ov = overrides.migrate_legacy(S.overrides_table(spark, d, lg))
    return overrides.apply_overrides(lg, ov).select("bank", "src_row", "category")


@register
def apply_overrides_by_id(spark, d):
    """E1/D8/D10 over tables stored by id: bulk edits merged into the stored overrides, which
    then replace the categories of the stored ledger; no ledger row is moved.  Overrides and
    edits are made from the stored ledger, so its ids are worked out once."""
    import uuid
    from kontor.operators.ledger import merge_overrides_by_id, write_by_id
    from kontor.sources.files import scratch_path
    folder, name = scratch_path(spark, "by-id"), f"kontor_{uuid.uuid4().hex}"
    buckets = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    write_by_id(_ledger_ids(spark, d), f"{name}_ledger", buckets, folder + "/ledger")
    lg = spark.table(f"{name}_ledger")
    write_by_id(S.overrides_table(spark, d, lg), f"{name}_old", buckets, folder + "/old")
    new = overrides.bulk_apply(lg, S.edits_table(spark, d, lg))
    merge_overrides_by_id(spark, f"{name}_old", new, f"{name}_overrides", buckets, folder + "/new")
    return overrides.apply_overrides(lg, spark.table(f"{name}_overrides")).select(
        "bank", "src_row", "category")


@register
def overview_after_overrides(spark, d):
    """The page's flow: ids (B3), overrides applied (D8/B7), transfers hidden
    (C2), base-currency accounts (C11), expenses per category and year (F6)."""
    lg = _ledger_ids(spark, d)
    lg = overrides.apply_overrides(lg, S.overrides_table(spark, d, lg))
    lg = report.base_currency_only(filters.hide_transfers(lg), S.bank_currency(spark))
    return report.expenses_by_category_year(lg)


@register
def learn_prefix_rules(spark, d):
    """Unambiguous concept prefixes (5..30 chars) from the overrides."""
    lg = _ledger_ids(spark, d)
    return overrides.learn_prefix_rules(lg, S.overrides_table(spark, d, lg))


@register
def auto_classify(spark, d):
    """Rows without an override take their longest learned prefix's category."""
    lg = _ledger_ids(spark, d)
    ov = S.overrides_table(spark, d, lg)
    rules = overrides.learn_prefix_rules(lg, ov)
    return overrides.auto_classify(lg, ov, rules)


@register
def auto_classify_count(spark, d):
    """F16: how many ids the learned prefixes classified."""
    lg = _ledger_ids(spark, d)
    ov = S.overrides_table(spark, d, lg)
    return overrides.bulk_count(overrides.auto_classify(lg, ov, overrides.learn_prefix_rules(lg, ov)))


@register
def bulk_apply(spark, d):
    """Edits spread to same-account rows sharing the 20-char concept prefix."""
    lg = _ledger_ids(spark, d)
    return overrides.bulk_apply(lg, S.edits_table(spark, d, lg))


@register
def merge_overrides(spark, d):
    """The bulk edits merged over the existing overrides (new wins)."""
    lg = _ledger_ids(spark, d)
    old = S.overrides_table(spark, d, lg)
    new = overrides.bulk_apply(lg, S.edits_table(spark, d, lg))
    return overrides.merge_overrides(old, new)


@register
def overrides_asof(spark, d):
    """Overrides in force at a past version of the log (undo)."""
    lg = _ledger_ids(spark, d)
    return overrides.overrides_as_of(S.override_log(spark, d, lg), S.STANDIN_LOG_VERSION)


@register
def intervals_asof(spark, d):
    """D11/A20 on the stored interval table: overrides in force at a past version."""
    from kontor.sources.files import scratch_path
    path = scratch_path(spark, "intervals")
    log = S.override_log(spark, d, _ledger_ids(spark, d))
    overrides.write_intervals(overrides.log_intervals(log), path)
    stored = overrides.read_intervals(spark, path)
    return overrides.intervals_as_of(stored, S.STANDIN_LOG_VERSION)


@register
def prefix_counts_from_changes(spark, d):
    """D5 kept up to date: how many overrides speak for each prefix and category at a past
    version of the log, updated by what the log's later entries change."""
    lg = _ledger_ids(spark, d)
    log = S.override_log(spark, d, lg)
    before = overrides.overrides_as_of(log, S.STANDIN_LOG_VERSION)
    later = log.filter(F.col("version") > S.STANDIN_LOG_VERSION)
    last = later.groupBy("tx_id").agg(F.max("version").alias("version"))
    entries = later.join(last, ["tx_id", "version"])
    counts = learning.prefix_counts(lg, before)
    delta = learning.count_changes(learning.override_changes(
        before, entries, overrides.concepts_of(lg, entries)))
    return learning.merge_counts(counts, delta)


@register
def override_retention(spark, d):
    """The newest 200 versions of the log, and the older ones folded into one."""
    lg = _ledger_ids(spark, d)
    return overrides.retain_versions(S.override_log(spark, d, lg))


@register
def vocabulary_merge(spark, d):
    """Names typed into the editor merged into the vocabulary."""
    vocab = spark.createDataFrame([(c,) for c in DEFAULT_VOCABULARY], "category string")
    return overrides.vocabulary_merge(vocab, S.new_category_names(spark, d))


# -------------------------------------------------------------- step 6: forecast
@register
def forecast_next_month(spark, d):
    """M1-M4: next month's income and expenses per account and category."""
    return forecast.forecast_next_month(ledger(spark, d, False), S.STANDIN_AS_OF)


@register
def monthly_by_category(spark, d):
    """The forecast's training table (net per month and category)."""
    m = forecast.monthly_by_category(ledger(spark, d, False), S.STANDIN_AS_OF)
    return _money_cols(m, "net")


# ------------------------------------------------------ step 7: layouts, statements
def _ledger_out(df: DataFrame) -> DataFrame:
    return _money_cols(df, "amount", "balance")


@register
def grid_yearly(spark, d):
    """One-file-per-year sheets (header search, positional file)."""
    from kontor.sources import grids
    return _ledger_out(grids.load_yearly_bank(S.yearly_cells(spark, d), "Bank1", S.STANDIN_RULES))


@register
def grid_wide(spark, d):
    """25-column sheets (split amounts, assembled descriptions)."""
    from kontor.sources import grids
    return _ledger_out(grids.load_multi_layout_bank(S.wide_cells(spark, d), "Bank2",
                                                    S.STANDIN_RULES))


@register
def grid_old(spark, d):
    """Six-column sheets without a header."""
    from kontor.sources import grids
    return _ledger_out(grids.load_multi_layout_bank(S.old_cells(spark, d), "Bank2",
                                                    S.STANDIN_RULES))


def _staged_lines(spark, d):
    """The statement text as a stored stmt_lines table (written once)."""
    from kontor.sources.files import stage_table
    return stage_table(S.statement_lines(spark, d), "stmt-lines")


@register
def statement_parse(spark, d):
    """Statement text lines parsed into movements (blocked FSM scan)."""
    from kontor.sources import statements
    lines = _staged_lines(spark, d)
    return _ledger_out(statements.load_statements(lines, "BNCR", S.STANDIN_RULES))


@register
def statement_continuity(spark, d):
    """Consecutive statements whose balances do not join up (the June
    statements open with a correction)."""
    from kontor.sources import statements
    return statements.continuity_gaps(
        S.statement_lines(spark, d, corrected_month=S.STATEMENT_CORRECTED_MONTH))


@register
def statement_previous_year(spark, d):
    """A12-A15 over statements from July to June: A14's dates of the year before."""
    from kontor.sources import statements
    from kontor.sources.files import stage_table
    lines = stage_table(S.statement_lines(spark, d, fiscal=True), "fiscal-lines")
    return _ledger_out(statements.load_statements(lines, "BNCR", S.STANDIN_RULES))


@register
def grid_month_first(spark, d):
    """Yearly sheets of the stem 2020, whose dates stand month first."""
    from kontor.sources import grids
    return _ledger_out(grids.load_yearly_bank(S.month_first_cells(spark, d), "Bank1",
                                              S.STANDIN_RULES))


@register
def grid_one_column(spark, d):
    """Wide sheets with only an income or only an expense column."""
    from kontor.sources import grids
    return _ledger_out(grids.load_multi_layout_bank(S.one_column_cells(spark, d), "Bank2",
                                                    S.STANDIN_RULES))


@register
def sheet_head(spark, d):
    """The first 1,000 rows and four columns of every old sheet."""
    from kontor.sources import grids
    head = grids.head_rows(S.old_cells(spark, d), 1000, 4)
    return head.select("path", "row_no", *[F.get("cells", F.lit(i)).alias(f"c{i}")
                                           for i in range(4)])


@register
def movements_sorted(spark, d):
    """H8 over B5: the movements table sorted by a column that the user chose."""
    view = report.movements_view(identity.with_tx_id(ledger(spark, d)), sort=False)
    return report.sort_by(view, "amount", ascending=False)


# ------------------------------------------------------------ step 8: files, stream
def _sources(spark, d):
    """The configured exports: a real account per slot when it has files,
    else its demo stand-in.  The real yearly and card folders are empty here."""
    from kontor.sources import grids, statements
    from kontor.sources.files import Source, stage_table
    empty_cells = spark.createDataFrame([], "path string, row_no long, cells array<string>")
    empty_card = spark.createDataFrame([], "Type string, `Started Date` string, Description string,"
                                           " Amount string, State string, Balance string,"
                                           " src_file string, src_row long")
    rules = S.STANDIN_RULES
    # the exports are made from one join, stored
    joined = stage_table(S.joined_orders(spark, d), "joined-orders")
    return [
        Source("yearly", 0, "Rural", empty_cells, "path",
               lambda r: grids.load_yearly_bank(r, "Rural", rules)),
        Source("yearly", 1, "Bank1", S.yearly_cells(spark, d, joined), "path",
               lambda r: grids.load_yearly_bank(r, "Bank1", rules)),
        Source("multi", 0, "Caixa", S.wide_cells(spark, d, joined), "path",
               lambda r: grids.load_multi_layout_bank(r, "Caixa", rules)),
        Source("multi", 1, "Bank2", S.old_cells(spark, d, joined), "path",
               lambda r: grids.load_multi_layout_bank(r, "Bank2", rules)),
        Source("card", 0, "Revo", empty_card, "src_file",
               lambda r: card_csv.load_card_bank(r, "Revo", rules)),
        Source("card", 1, "Bank3", S.card_rows(spark, d, joined), "src_file",
               lambda r: card_csv.load_card_bank(r, "Bank3", rules)),
        Source("statements", 0, "BNCR", S.statement_lines(spark, d, joined=joined), "doc",
               lambda r: statements.load_statements(stage_table(r, "stmt-lines"), "BNCR", rules)),
    ]


@register
def source_preference(spark, d):
    """Per slot, the preferred source that has files."""
    from kontor.sources.files import choose_sources
    return choose_sources(spark, _sources(spark, d))


@register
def load_all(spark, d):
    """A17 + A16 + I1 + B2: the unified ledger of the chosen sources."""
    from kontor.sources.files import load_all as load
    return _ledger_out(load(spark, _sources(spark, d)))


@register
def card_csv_files(spark, d):
    """Card exports written as CSV files (per year, each with its
    header, plus a file of another kind without a State column) and read back
    by header group."""
    from kontor.sources.files import scratch_path
    folder = scratch_path(spark, "card-csv")
    rows = S.card_rows(spark, d).drop("src_file", "src_row")
    (rows.withColumn("year", F.substring("Started Date", 1, 4))
     .write.option("header", True).partitionBy("year").csv(folder + "/exports"))
    read_table(spark, d, "nation").write.option("header", True).csv(folder + "/exports/rates")
    # Only *.csv files, found by Spark's own listing (no driver-side list)
    raw = card_csv.read_card_csv(spark, [folder + "/exports/*/*.csv"])
    led = card_csv.load_card_bank(raw, "Bank3", S.STANDIN_RULES)
    return _ledger_out(led.drop("src_file", "src_row"))


@register
def card_csv_multiline(spark, d):
    """A2/A3: exports whose descriptions are quoted texts of two lines with commas and
    quotes, and whose columns stand in another order each year."""
    from kontor.sources.files import scratch_path
    folder = scratch_path(spark, "card-multiline")
    rows = S.multiline_card_rows(spark, d)
    for k in range(S.MULTILINE_ORDERS):
        part = rows.filter(F.col("year") % S.MULTILINE_ORDERS == k)
        columns = part.columns[k + 1:] + part.columns[1:k + 1]       # the year is the folder
        (part.select(*columns, part.columns[0]).write.partitionBy("year")
         .option("header", True).option("quoteAll", True).option("escape", '"')
         .csv(f"{folder}/order={k}"))
    raw = card_csv.read_card_csv(spark, [folder + "/*/*/*.csv"])
    led = card_csv.load_card_bank(raw, "Bank3", S.STANDIN_RULES)
    return _ledger_out(led.drop("src_file", "src_row"))


@register
def json_sources(spark, d):
    """The overrides written as a JSON-lines table and read back (the
    JSON array / object document forms are covered by unit tests)."""
    from kontor.sources import json_io
    from kontor.sources.files import scratch_path
    lg = _ledger_ids(spark, d)
    folder = scratch_path(spark, "json")
    json_io.write_overrides_table(S.overrides_table(spark, d, lg), folder + "/overrides")
    return json_io.read_overrides_table(spark, folder + "/overrides")


@register
def file_inventory(spark, d):
    """The documents exported as text files, one folder per source, and a file
    of another kind; KB of the text files per folder."""
    from kontor.sources.files import folder_sizes, scratch_path
    folder = scratch_path(spark, "inventory")
    docs = read_table(spark, d, "documents")
    (docs.select(F.concat(F.lit("from-"), "source").alias("source"),
                 F.coalesce("text", F.lit("")).alias("value"))
     .write.partitionBy("source").text(folder + "/export"))
    read_table(spark, d, "nation").write.option("header", True).csv(folder + "/export/source=nations")
    sizes = folder_sizes(spark, folder + "/export", ["txt", "text"])
    return sizes.select(F.regexp_replace("folder", "^source=", "").alias("folder"), "size_kb")


@register
def json_documents(spark, d):
    """The vocabulary as a JSON array and the overrides as a JSON object, written
    and read back; every name, and every override under its id."""
    from kontor.sources import json_io
    from kontor.sources.files import scratch_path
    folder = scratch_path(spark, "json-documents")
    names = S.new_category_names(spark, d).select(
        F.lower(F.trim(F.col("name"))).alias("category")).distinct()
    json_io.write_vocabulary(names, folder + "/categories")
    lg = _ledger_ids(spark, d)
    json_io.write_overrides_document(S.overrides_table(spark, d, lg), folder + "/overrides")
    vocabulary = json_io.read_vocabulary(spark, folder + "/categories")
    stored = json_io.read_overrides_document(spark, folder + "/overrides")
    return stored.select("tx_id", "category").unionByName(
        vocabulary.select(F.lit(None).cast("string").alias("tx_id"), "category"))


@register
def notebook_split(spark, d):
    """C4: totals of the notebook's sides (zero is an expense), per account."""
    lg = ledger(spark, d, False)
    sides = None
    for name, part in (("income", filters.notebook_income(lg)),
                       ("expenses", filters.notebook_expenses(lg))):
        one = part.groupBy("bank").agg(money_out(F.sum("amount")).alias("total"),
                                       F.count(F.lit(1)).alias("n"))
        one = one.select("bank", F.lit(name).alias("side"), "total", "n")
        sides = one if sides is None else sides.unionByName(one)
    return sides


@register
def text_lookup(spark, d):
    """Movements whose concept holds a text, in its own case."""
    found = filters.text_contains(ledger(spark, d, False), "MACHINERY 2-")
    return _money_cols(found.select("bank", "src_row", "concept", "amount"), "amount")


@register
def search_summary(spark, d):
    """F11 after C6: the summary of the movements that the search boxes leave."""
    return report.movement_summary(filters.search(ledger(spark, d), {"concept": "high",
                                                                     "category": "e"}))


@register
def bulk_count(spark, d):
    """F16 on D7: how many ids the spread edits set."""
    lg = _ledger_ids(spark, d)
    return overrides.bulk_count(overrides.bulk_apply(lg, S.edits_table(spark, d, lg)))


@register
def vocabulary_changed(spark, d):
    """Whether merging the typed names changes the vocabulary, and whether merging
    the result once more does."""
    vocab = spark.createDataFrame([(c,) for c in DEFAULT_VOCABULARY], "category string")
    names = S.new_category_names(spark, d)
    once = overrides.vocabulary_merge(vocab, names)
    twice = overrides.vocabulary_merge(once.select("category"), names)
    return spark.createDataFrame(
        [("once", overrides.vocabulary_changed(vocab, once)),
         ("twice", overrides.vocabulary_changed(once, twice))], "merge string, changed boolean")


@register
def incremental_ingest(spark, d):
    """K1: two exports arrive one after the other (the second a re-export
    with shifted times); the stream appends only rows new to the ledger."""
    from kontor.sources.files import scratch_path
    from kontor.streaming.ingest import run_until_caught_up, start_ingest
    folder = scratch_path(spark, "ingest")
    first = ledger(spark, d).drop("category")
    schema = first.schema
    rules = S.STANDIN_RULES

    def parse(batch):
        return categorize(batch, "concept", "category", rules)

    first.write.parquet(folder + "/inbox/export-1")
    run_until_caught_up(start_ingest(spark, folder + "/inbox/*", schema, folder + "/ledger",
                                     folder + "/ckpt", parse))
    # the same history again, from the first export: its balances are worked out once
    second = S.reexport(spark.read.schema(schema).parquet(folder + "/inbox/export-1"))
    second.write.parquet(folder + "/inbox/export-2")
    run_until_caught_up(start_ingest(spark, folder + "/inbox/*", schema, folder + "/ledger",
                                     folder + "/ckpt", parse))
    out = spark.read.parquet(folder + "/ledger")
    return _ledger_out(out.select(*[c for c in ("date", "concept", "amount", "balance", "bank",
                                                "category", "src_file", "src_row")]))
