"""Stand-in inputs shaped from the driver's TPC-H-like tables.

These functions only reshape rows into the schemas the jobs expect (account
movements, card-export text rows, override tables, edit logs).  They do none
of a job's work: categories, balances, ids, dedup and every report are
computed afterwards by the library's operators, which work on any data of
that schema.

Movements from ``orders`` joined to ``customer``:

=========  ==========================================================
bank       'Bank' || (o_custkey % 3 + 1)   (three accounts: each holds
           about a third of all rows, the skew the operators must take)
date       o_orderdate
concept    c_mktsegment || ' ' || o_orderpriority
amount     +o_totalprice when o_orderstatus = 'F', else -o_totalprice
src_file   'orders'
src_row    o_orderkey
=========  ==========================================================
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kontor.plans.joins import join_grown
from kontor.schema import MONEY
from kontor.sources.tables import read_table

# Rules for the stand-in concepts (market segment + order priority).  They are
# user data like any rule table; the operator is the same one that runs the
# default merchant rules.
STANDIN_RULES: list[tuple[list[str], str]] = [
    (["5-low"], "own transfer"),
    (["4-not specified"], "transfer"),
    (["furniture"], "dept. store"),
    (["building"], "rent"),
    (["auto"], "fuel"),
    (["household 1-urgent", "household 2-high"], "supermarket"),
]


def orders_movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
        "o_orderpriority")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    j = o.join(c, o.o_custkey == c.c_custkey, "inner")
    return j.select(
        F.col("o_orderdate").cast("timestamp_ntz").alias("date"),
        F.concat_ws(" ", "c_mktsegment", "o_orderpriority").alias("concept"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))
         .otherwise(-F.col("o_totalprice")).cast(MONEY).alias("amount"),
        F.concat(F.lit("Bank"), (F.col("o_custkey") % 3 + 1).cast("string")).alias("bank"),
        F.lit("orders").alias("src_file"),
        F.col("o_orderkey").cast("long").alias("src_row"),
    )


# ---- stand-in parameters (user choices in the app: filters, selections, tables) ----
STANDIN_AS_OF = "2001-08-01"              # "today" for the forecast (C9)
STANDIN_BANK_CURRENCY = {"Bank3": "₡"}     # bank table: Bank3 keeps another currency
STANDIN_DATE_RANGE = ("1996-03-01", "1998-06-30")
STANDIN_CATEGORY_SELECTION = ["rent", "fuel", "other"]
STANDIN_YEAR_SELECTION = ["1996", "1997", "2000"]
STANDIN_SEARCH = {"date": "-0", "concept": "high", "amount": "5", "category": "e"}
STANDIN_CHART_BANK = "Bank1"
STANDIN_EXCLUDED_LABELS = ["urgent"]


def bank_currency(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(STANDIN_BANK_CURRENCY.items()),
                                 "bank string, currency string")


def reexport(ledger: DataFrame) -> DataFrame:
    """A second export of the same account history, as banks produce when a
    period is downloaded twice: times shifted by two hours, another file name,
    and no balance column for the '3-MEDIUM' rows (a layout without balances).
    """
    return (ledger
            .withColumn("date", F.col("date") + F.expr("INTERVAL 2 HOURS"))
            .withColumn("src_file", F.lit("orders_reexport"))
            .withColumn("balance", F.when(~F.col("concept").contains("3-MEDIUM"),
                                          F.col("balance"))))


def standin_rewrites():
    """Invented label rewrites for the notebook-style totals (D3/D4): regexes,
    case-sensitive, each seeing the labels left by the ones before it."""
    from kontor.operators.categorize import RewriteRule
    return [
        RewriteRule("urgent orders", pattern="URGENT"),
        RewriteRule("big high", pattern="HIGH", min_abs=300000.0),
        RewriteRule("urgent", pattern="^urgent"),
        RewriteRule("industrial", pattern="BUILDING|MACHINERY"),
        RewriteRule("cars", pattern="AUTO.OBILE"),
        RewriteRule("small low", pattern="LOW", min_abs=0.0, eq_abs=None),
    ]


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as small purchases: the part's name and brand as concept, the quantity
    as a negative amount (whole numbers, so that rules on exact amounts meet some)."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    return li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("l_shipdate").alias("date"),
        F.concat_ws(" ", "p_name", "p_brand").alias("concept"),
        (-F.col("l_quantity")).cast(MONEY).alias("amount"),
        F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"))


def purchase_rewrites():
    """125 invented rewrites of purchases: substrings, regexes, least and exact amounts, and
    rules on labels that earlier rules left."""
    from kontor.operators.categorize import RewriteRule as R
    rules = [R(f"standing order {n}", eq_abs=float(n)) for n in (7, 19, 31)]
    rules += [R(f"house {k % 9}", pattern=f"Brand#{k}$", min_abs=float(2 * k)) for k in range(1, 26)]
    rules += [R("large house", pattern="^house [0-4]$", min_abs=40.0),
              R("house of standing orders", pattern="^standing order [0-9]$"),
              R("lease", pattern="^large house$", eq_abs=48.0)]
    rules += [R(f"ring {k}", pattern=f"ring Brand#{k}", min_abs=5.0) for k in range(1, 26)]
    rules += [R("red things", pattern="^red "), R("small things", pattern="^small "),
              R("odd red", pattern="red th.ngs", eq_abs=3.0)]
    rules += [R(f"shelf {k % 5}", pattern=f"t Brand#{k}$") for k in range(1, 26)]
    rules += [R("shelves", pattern="^shelf [123]"), R("rings", pattern="ring 1[0-9]|ring 2")]
    rules += [R(f"brand {k}", pattern=f"Brand#{k}$", min_abs=float(k)) for k in range(25, 0, -1)]
    rules += [R("brands", pattern="^brand ", min_abs=30.0), R("fees", eq_abs=1.0)]
    rules += [R(f"rest {k}", pattern=f"[a-z] Brand#.*{k}$") for k in range(10)]
    rules += [R("house", pattern="house"), R("rest", pattern="^rest [0-8]$")]
    return rules


STANDIN_EXCLUDED_PURCHASES = ["fees", "lease", "rest", "red things"]


# Card-export text rows from orders (what spark.read.csv gives: all strings).
# Order priority picks the transaction type, order status the state.
_CARD_TYPE_BY_PRIORITY = {
    "1-URGENT": "Card Payment", "2-HIGH": "Topup", "3-MEDIUM": "ATM",
    "4-NOT SPECIFIED": "Card Refund", "5-LOW": "Exchange",
}


def card_rows(spark: SparkSession, sf_dir: str, joined: DataFrame | None = None) -> DataFrame:
    """``joined``: the orders with their customers (``joined_orders``), if they are at hand."""
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
        "o_orderpriority")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_name")
    j = join_grown(o, c, o.o_custkey == c.c_custkey) if joined is None else joined
    type_map = F.create_map(*[F.lit(x) for kv in _CARD_TYPE_BY_PRIORITY.items() for x in kv])
    signed = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")) \
        .otherwise(-F.col("o_totalprice")).cast(MONEY)
    return j.select(
        F.element_at(type_map, F.col("o_orderpriority")).alias("Type"),
        F.lit("Current").alias("Product"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("Started Date"),
        F.date_format(F.date_add(F.to_date("o_orderdate"), 1), "yyyy-MM-dd 14:00:00")
        .alias("Completed Date"),
        F.concat_ws(" ", "c_mktsegment", "c_name").alias("Description"),
        signed.cast("string").alias("Amount"),
        F.lit("0.0").alias("Fee"),
        F.lit("EUR").alias("Currency"),
        F.when(F.col("o_orderstatus") == "P", F.lit("REVERTED"))
         .otherwise(F.lit("COMPLETED")).alias("State"),
        F.lit(None).cast("string").alias("Balance"),
        F.lit("orders.csv").alias("src_file"),
        F.col("o_orderkey").cast("long").alias("src_row"),
    )


def customer_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule table over card descriptions: the names of two thirds of the customers, and
    behind them the market segments."""
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    named = c.filter(F.col("c_custkey") % 3 != 0).select(
        F.col("c_custkey").cast("int").alias("ordinal"), F.array("c_name").alias("keywords"),
        F.concat(F.lit("group "), F.col("c_custkey") % 50).alias("category"))
    segments = c.groupBy("c_mktsegment").agg((F.lit(1_000_000_000) + F.min("c_custkey")).cast("int")
                                             .alias("ordinal"))
    return named.unionByName(segments.select(
        "ordinal", F.array(F.lit("zz"), F.substring("c_mktsegment", 1, 3)).alias("keywords"),
        F.lower("c_mktsegment").alias("category")))


MULTILINE_ORDERS = 3               # column orders among the exports


def multiline_card_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card rows whose description is the segment, then on a second line the customer in
    quotes and a word after a comma; ``year`` first, without file and row."""
    rows = card_rows(spark, sf_dir).drop("src_file", "src_row")
    parts = F.split("Description", " ")
    return rows.select(
        F.substring("Started Date", 1, 4).cast("int").alias("year"), "Type", "Product",
        "Started Date", "Completed Date",
        F.concat(parts[0], F.lit('\n"'), parts[1], F.lit('", again')).alias("Description"),
        "Amount", "Fee", "Currency", "State", "Balance")


def _returned_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    return li.filter(F.col("l_returnflag") == "R").select(
        F.col("l_orderkey").alias("src_row")).distinct()


def overrides_table(spark: SparkSession, sf_dir: str, ledger_ids: DataFrame) -> DataFrame:
    """Overrides a user made on orders with a returned item (by tx_id): urgent
    ones are refunds, high ones the retired 'accommodation', medium ones
    'other', the rest named after the market segment."""
    rows = ledger_ids.join(_returned_orders(spark, sf_dir), "src_row", "left_semi")
    cat = (F.when(F.col("concept").contains("1-URGENT"), F.lit("refund"))
           .when(F.col("concept").contains("2-HIGH"), F.lit("accommodation"))
           .when(F.col("concept").contains("3-MEDIUM"), F.lit("other"))
           .otherwise(F.lower(F.split("concept", " ")[0])))
    return rows.select("tx_id", cat.alias("category")).distinct()


def _big_quantity_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").filter(F.col("l_quantity") >= 50).select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return li.join(p, li.l_partkey == p.p_partkey, "inner")


def edits_table(spark: SparkSession, sf_dir: str, ledger_ids: DataFrame) -> DataFrame:
    """Category edits a user made in the movements table, in edit order: each
    order with a 50-unit line was re-labelled after the part's type, on the
    day the line shipped."""
    lines = _big_quantity_lines(spark, sf_dir)
    j = lines.join(ledger_ids.select("src_row", "bank", "tx_id"),
                   lines.l_orderkey == F.col("src_row"), "inner")
    return j.select(
        F.struct(F.col("l_shipdate").alias("at"), F.col("l_orderkey").alias("order"),
                 F.col("l_linenumber").alias("line")).alias("edit_seq"),
        "bank", "tx_id", F.lower("p_type").alias("category"))


def override_log(spark: SparkSession, sf_dir: str, ledger_ids: DataFrame) -> DataFrame:
    """The saved history of those edits: one version per shipping day
    (yyyyMMdd), one entry per id and version.  Entries of standard parts undo
    the id's override (there may be none)."""
    lines = _big_quantity_lines(spark, sf_dir)
    j = lines.join(ledger_ids.select("src_row", "tx_id"),
                   lines.l_orderkey == F.col("src_row"), "inner")
    return (j.groupBy(F.date_format("l_shipdate", "yyyyMMdd").cast("long").alias("version"),
                      "tx_id")
            .agg(F.max(F.lower("p_type")).alias("category"))
            .withColumn("deleted", F.col("category").startswith("standard")))


STANDIN_LOG_VERSION = 19990101


def new_category_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names typed into the category editor: part types and market segments,
    as typed (upper case, padded) — the merge normalises them."""
    p = read_table(spark, sf_dir, "part").select(F.concat(F.lit(" "), "p_type").alias("name"))
    c = read_table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name"))
    return p.unionByName(c)


# ---------------------------------------------------------------- workbook grids
# Orders rendered as the sheets the workbook layouts read: one file per year.
# Cells are text, as a sheet decoder would give them.

YEARLY_POSITIONAL_YEAR = 1998          # this year's file has no header at all
_YEARLY_HEADERS = {
    0: ["Fecha", "Fecha valor", "Concepto", "Importe", "Saldo", "Nº apunte"],
    1: ["Date", "Value Date", "Description", "Amount", "Balance", "Entry No."],
}
_WIDE_HEADER = ([None, "Account Number", "Branch", "Currency", "Operation Date", "Value Date",
                 "Income (+)", "Expense (-)", "Balance (+)", "Balance (-)", "Category",
                 "Sub-category", "Reference 1", "Reference 2"]
                + [f"Description {i}" for i in range(1, 11)] + [None])


def joined_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customers, for exports that are all made from them."""
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
        "o_orderpriority")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal",
                                                     "c_name")
    return o.join(c, o.o_custkey == c.c_custkey, "inner")


def _orders_customers(spark: SparkSession, sf_dir: str,
                      joined: DataFrame | None = None) -> DataFrame:
    j = joined_orders(spark, sf_dir) if joined is None else joined
    return j.withColumn("y", F.year("o_orderdate")).withColumn(
        "amt", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))
        .otherwise(-F.col("o_totalprice")).cast(MONEY)).withColumn(
        "bal", F.col("c_acctbal").cast(MONEY))


def _lit_cells(values: list) -> DataFrame:
    return F.array(*[F.lit(v).cast("string") for v in values])


def _per_file_rows(files: DataFrame, rows: list[tuple[int, list]]) -> DataFrame:
    """Constant rows (preambles, headers) for every file in ``files(path, ...)``."""
    arr = F.array(*[F.struct(F.lit(n).alias("row_no"), _lit_cells(v).alias("cells"))
                    for n, v in rows])
    return files.select("path", F.explode(arr).alias("r")).select(
        "path", F.col("r.row_no").cast("long").alias("row_no"), "r.cells")


def yearly_cells(spark: SparkSession, sf_dir: str, joined: DataFrame | None = None) -> DataFrame:
    """Yearly sheets: the header sits after (year % 3) * 2 preamble rows, in
    Spanish for even years and English for odd ones; 1998 has no header and
    five positional columns with ISO dates."""
    oc = _orders_customers(spark, sf_dir, joined)
    path = F.concat(F.lit("Bank1/"), F.col("y").cast("string"), F.lit(".xlsx"))
    offset = (F.col("y") % 3) * 2
    positional = F.col("y") == YEARLY_POSITIONAL_YEAR
    dmy = F.date_format("o_orderdate", "dd/MM/yyyy")
    data = oc.select(
        path.alias("path"),
        F.when(positional, F.col("o_orderkey"))
         .otherwise(offset + 1 + F.col("o_orderkey")).cast("long").alias("row_no"),
        F.when(positional, F.array(
            F.date_format("o_orderdate", "yyyy-MM-dd"),
            F.date_format(F.date_add(F.to_date("o_orderdate"), 1), "yyyy-MM-dd"),
            F.concat_ws(" ", "c_mktsegment", "o_orderpriority"),
            F.col("amt").cast("string"), F.col("bal").cast("string")))
         .otherwise(F.array(
            dmy, F.date_format(F.date_add(F.to_date("o_orderdate"), 1), "dd/MM/yyyy"),
            F.concat_ws(" ", "c_mktsegment", "o_orderpriority"),
            F.col("amt").cast("string"), F.col("bal").cast("string"),
            F.col("o_orderkey").cast("string"))).alias("cells"))
    files = oc.filter(~positional).select(path.alias("path"), "y").distinct()
    off = (F.col("y") % 3) * 2
    header = F.when(F.col("y") % 2 == 0, _lit_cells(_YEARLY_HEADERS[0])) \
        .otherwise(_lit_cells(_YEARLY_HEADERS[1]))
    preamble = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(4)), lambda i: i < off),
        lambda i: F.struct(i.cast("long").alias("row_no"),
                           F.when(i == 0, _lit_cells(["Extracto de cuenta", None, None]))
                           .otherwise(_lit_cells(["Titular", None, None])).alias("cells")))
    fixed = F.concat(preamble, F.array(F.struct(off.cast("long").alias("row_no"),
                                                header.alias("cells"))))
    heads = files.select("path", F.explode(fixed).alias("r")).select("path", "r.row_no", "r.cells")
    return data.unionByName(heads)


def wide_cells(spark: SparkSession, sf_dir: str, joined: DataFrame | None = None) -> DataFrame:
    """25-column sheets: three preamble rows (one blank), the header in row 3,
    an empty row 4, data from row 5.  Income/expense split by sign, the
    balance in the (+) or (-) column by its sign; descriptions vary with the
    order priority (operation-date lead, empty first description, details
    already contained, details appended)."""
    oc = _orders_customers(spark, sf_dir, joined)
    path = F.concat(F.lit("Bank2/"), F.col("y").cast("string"), F.lit(".xlsx"))
    dmy = F.date_format("o_orderdate", "dd/MM/yyyy")
    concept = F.concat_ws(" ", "c_mktsegment", "o_orderpriority")
    prio = F.col("o_orderpriority")
    d1 = (F.when(prio == "1-URGENT", F.concat(F.lit("Fecha de operación "), dmy, F.lit(" "), concept))
          .when(prio == "5-LOW", F.lit(None)).otherwise(concept))
    d3 = (F.when(prio.isin("2-HIGH", "5-LOW"), F.col("c_name"))
          .when(prio == "3-MEDIUM", F.col("c_mktsegment")))
    none = F.lit(None).cast("string")
    cells = F.array(
        none, F.lit("ES00 0000 0000"), F.lit("0001"), F.lit("EUR"), dmy,
        F.date_format(F.date_add(F.to_date("o_orderdate"), 1), "dd/MM/yyyy"),
        F.when(F.col("amt") > 0, F.col("amt").cast("string")),
        F.when(F.col("amt") < 0, (-F.col("amt")).cast("string")),
        F.when(F.col("bal") >= 0, F.col("bal").cast("string")),
        F.when(F.col("bal") < 0, (-F.col("bal")).cast("string")),
        none, none, F.col("o_orderkey").cast("string"), none,
        d1.cast("string"), none, d3.cast("string"), *[none] * 7, none)
    data = oc.select(path.alias("path"), (F.col("o_orderkey") + 5).cast("long").alias("row_no"),
                     cells.alias("cells"))
    files = oc.select(path.alias("path")).distinct()
    blank = [None] * 25
    fixed = _per_file_rows(files, [(0, ["Consulta de movimientos"] + [None] * 24),
                                   (1, ["Cuenta", "ES00 0000 0000"] + [None] * 23),
                                   (3, _WIDE_HEADER), (4, blank)])
    return data.unionByName(fixed)


def month_first_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly sheets with the stem whose dates stand month first (2020.xlsx), one in a folder
    for each year: the header in row 0."""
    oc = _orders_customers(spark, sf_dir)
    path = F.concat(F.lit("Bank1-"), F.col("y").cast("string"), F.lit("/2020.xlsx"))
    mdy = F.date_format("o_orderdate", "MM/dd/yyyy")
    cells = F.array(mdy, mdy, F.concat_ws(" ", "c_mktsegment", "o_orderpriority"),
                    F.col("amt").cast("string"), F.col("bal").cast("string"),
                    F.col("o_orderkey").cast("string"))
    data = oc.select(path.alias("path"), (F.col("o_orderkey") + 1).cast("long").alias("row_no"),
                     cells.alias("cells"))
    files = oc.select(path.alias("path")).distinct()
    return data.unionByName(_per_file_rows(files, [(0, _YEARLY_HEADERS[0])]))


def one_column_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide sheets with signed amounts in one column: only the income column in even
    years, only the expense column in odd ones."""
    income, expense = 6, 7
    even = F.regexp_extract("path", r"(\d+)[.]", 1).cast("int") % 2 == 0
    signed = F.coalesce(F.col("cells")[income], F.concat(F.lit("-"), F.col("cells")[expense]))
    title = F.col("row_no") <= 3

    def value(x, i):
        kept = F.when(title, x).otherwise(signed)
        return (F.when(i == income, F.when(even, kept))
                .when(i == expense, F.when(~even, kept)).otherwise(x))

    return wide_cells(spark, sf_dir).withColumn("cells", F.transform("cells", value))


def old_cells(spark: SparkSession, sf_dir: str, joined: DataFrame | None = None) -> DataFrame:
    """Six-column sheets with three title rows and no header: ISO dates,
    segment as concept, priority as details (none for 5-LOW)."""
    oc = _orders_customers(spark, sf_dir, joined)
    path = F.concat(F.lit("Bank2old/"), F.col("y").cast("string"), F.lit(".xls"))
    cells = F.array(
        F.date_format("o_orderdate", "yyyy-MM-dd"),
        F.date_format(F.date_add(F.to_date("o_orderdate"), 1), "yyyy-MM-dd"),
        F.col("c_mktsegment"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")),
        F.col("amt").cast("string"), F.col("bal").cast("string"))
    data = oc.select(path.alias("path"), (F.col("o_orderkey") + 3).cast("long").alias("row_no"),
                     cells.alias("cells"))
    files = oc.select(path.alias("path")).distinct()
    fixed = _per_file_rows(files, [(0, ["Extracto", None]), (1, ["Periodo", None]),
                                   (2, [None, None])])
    return data.unionByName(fixed)


# ------------------------------------------------------------ statement lines
STATEMENT_CORRECTED_MONTH = 6      # June statements open with a correction that no other lists


def statement_lines(spark: SparkSession, sf_dir: str, corrected_month: int | None = None,
                    fiscal: bool = False, joined: DataFrame | None = None) -> DataFrame:
    """Orders rendered as monthly statements per account (text lines).

    Per document: title lines with the previous/this statement dates and the
    closing balance, the column titles ending in 'SALDO DIARIO', one record
    per order (date dd/MM, reference, description, amount, balance with
    thousands separators), then the opening balance line that ends the list
    and a page footer.  Urgent orders carry a date-shaped reference, high
    ones a description wrapped over two lines, medium ones a dd-MM-yy
    purchase-date lead.  Balances on records are the customer's balance;
    opening/closing balances are the account's cumulative monthly nets (a
    table of accounts x months).  Statements of ``corrected_month`` print an opening
    balance 25.00 above the one before closed with (the continuity check's scenario);
    their records and closing balances are like others.  ``fiscal`` statements run from
    July to June, so half of their records belong to the year before the statement's.
    """
    from pyspark.sql import Window
    oc = _orders_customers(spark, sf_dir, joined).withColumn(
        "bank", F.concat(F.lit("Bank"), (F.col("o_custkey") % 3 + 1).cast("string"))
    )
    day = F.to_date("o_orderdate")
    if fiscal:
        oc = oc.withColumn("m", F.add_months(F.trunc(F.add_months(day, -6), "YEAR"), 6))
        end, name = F.date_sub(F.add_months("m", 12), 1), F.lit("fiscal-")
        name = F.concat(name, F.year(end).cast("string"))
    else:
        oc = oc.withColumn("m", F.trunc(day, "MM"))
        end, name = F.last_day("m"), F.date_format("m", "yyyy-MM")
    doc = F.concat(F.col("bank"), F.lit("/"), name, F.lit(".pdf"))

    monthly = oc.groupBy("bank", "m").agg(F.sum("amt").alias("net"),
                                          F.max("o_orderkey").alias("_last_key"))
    before = Window.partitionBy("bank").orderBy("m").rowsBetween(Window.unboundedPreceding, -1)
    monthly = (monthly.withColumn("opening", F.coalesce(F.sum("net").over(before), F.lit(0)))
               .withColumn("closing", F.col("opening") + F.col("net")))
    if corrected_month:
        monthly = monthly.withColumn("opening", F.when(
            F.month("m") == corrected_month, F.col("opening") + 25).otherwise(F.col("opening")))

    prio = F.col("o_orderpriority")
    concept = F.concat_ws(" ", "c_mktsegment", "o_orderpriority")
    desc = (F.when(prio == "2-HIGH", F.array(F.col("c_mktsegment"), prio))
            .when(prio == "3-MEDIUM",
                  F.array(F.concat(F.date_format("o_orderdate", "dd-MM-yy"), F.lit(" "), concept)))
            .otherwise(F.array(concept)))
    ref = F.when(prio == "1-URGENT", F.lit("01/02")).otherwise(F.col("o_orderkey").cast("string"))
    rec_lines = F.concat(
        F.array(F.date_format("o_orderdate", "dd/MM"), ref), desc,
        F.array(F.format_number("amt", 2), F.format_number("bal", 2)))
    recs = (oc.select(doc.alias("doc"), F.col("o_orderkey"),
                    F.posexplode(rec_lines).alias("k", "line"))
            .select("doc", (F.lit(100) + F.col("o_orderkey") * 8 + F.col("k")).cast("long")
                    .alias("line_no"), "line"))

    dmy = "dd/MM/yyyy"
    fixed = F.array(
        F.lit("BANCO DE EJEMPLO"), F.lit("ESTADO DE CUENTA"),
        F.concat(F.lit("Fecha último estado: "),
                 F.date_format(F.date_sub(F.col("m"), 1), dmy)),
        F.concat(F.lit("Fecha de este estado: "), F.date_format(end, dmy)),
        F.concat(F.lit("Saldo actual: "), F.format_number("closing", 2)),
        F.lit("FECHA"), F.lit("NÚMERO"), F.lit("DESCRIPCIÓN"), F.lit("MONTO"), F.lit("SALDO DIARIO"))
    head = monthly.select(doc.alias("doc"), F.posexplode(fixed).alias("line_no", "line")) \
        .withColumn("line_no", F.col("line_no").cast("long"))
    tail = monthly.select(doc.alias("doc"), "_last_key", F.posexplode(F.array(
        F.concat(F.lit("Saldo anterior: "), F.format_number("opening", 2)),
        F.lit("Página 1"))).alias("k", "line")).select(
        "doc", (F.lit(100) + (F.col("_last_key") + 1) * 8 + F.col("k")).cast("long")
        .alias("line_no"), "line")
    return recs.unionByName(head.select("doc", "line_no", "line")).unionByName(tail)
