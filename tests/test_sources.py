"""Hand-made fixtures for the export layouts (cases listed in FIXTURES.md)."""

import datetime as dt
import os
import tempfile

from kontor.sources import card_csv, grids, statements

D = dt.datetime
HDR = "Type,Product,Started Date,Completed Date,Description,Amount,Fee,Currency,State,Balance"


def _write(folder, name, text):
    p = os.path.join(folder, name)
    with open(p, "w", encoding="utf-8") as f:
        f.write(text)
    return p


# ---------------------------------------------------------------- card CSV
def test_card_csv_cases(spark):
    folder = tempfile.mkdtemp(prefix="kontor-card-")
    a = _write(folder, "a.csv", "\n".join([
        HDR,
        "Card Payment,Current,2024-01-02 10:00:00,2024-01-03 10:00:00,  Lidl Centro ,-12.50,0,EUR,COMPLETED,87.50",
        "Topup,Current,2024-01-03 09:00:00,2024-01-03 09:00:00,Payment from X,100,0,EUR,COMPLETED,187.50",
        "Card Payment,Current,2024-01-04 09:00:00,,Cafe Sol,-3.20,0,EUR,PENDING,184.30",
        "Card Payment,Current,not a date,,Shell,-40,0,EUR,COMPLETED,144.30",
        "Card Payment,Current,2024-01-05 09:00:00,,Shell,abc,0,EUR,COMPLETED,144.30",
        "ATM,Current,2024-01-06 09:00:00,,Cash,-20,0,EUR,COMPLETED,",
        "Card Refund,Current,2024-01-07 09:00:00,,,5.00,0,EUR,COMPLETED,129.30",
    ]) + "\n")
    b = _write(folder, "b.csv", "Date,Rate\n2024-01-01,1.1\n")            # no State column
    c = _write(folder, "c.csv", HDR + "\n" +                              # re-export of one row
               "Card Payment,Current,2024-01-02 10:00:05,,Lidl Centro,-12.50,0,EUR,COMPLETED,87.50\n")
    raw = card_csv.read_card_csv(spark, [a, b, c])
    led = card_csv.load_card_bank(raw, "Card").orderBy("date").collect()
    got = [(r.date, r.concept, float(r.amount), r.balance and float(r.balance), r.category)
           for r in led]
    assert got == [
        (D(2024, 1, 2, 10), "Lidl Centro", -12.5, 87.5, "supermarket"),
        (D(2024, 1, 3, 9), "Payment from X", 100.0, 187.5, "own transfer"),
        (D(2024, 1, 6, 9), "Cash", -20.0, None, "atm"),
        (D(2024, 1, 7, 9), "nan", 5.0, 129.3, "refund"),
    ]


def test_card_rows_without_state_give_nothing(spark):
    rows = spark.createDataFrame([("x", "1")], "Description string, Amount string")
    assert card_csv.parse_card_rows(rows, "B").count() == 0


# -------------------------------------------------------------- yearly grid
def _cells(spark, rows):
    return spark.createDataFrame(rows, "path string, row_no long, cells array<string>")


def test_yearly_header_positions_and_fallbacks(spark):
    es = ["Fecha", "Fecha valor", "Concepto", "Importe", "Saldo", "Nº apunte"]
    en = ["Date", "Value Date", "Description", "Amount", "Balance"]
    rows = [
        # header at row 0, Spanish, day-first dates
        ("b/2021.xlsx", 0, es), ("b/2021.xlsx", 1, ["05/03/2021", "06/03/2021", "Lidl", "-10.5", "90", "1"]),
        # header at row 3 after a preamble, English, ISO date, null amount kept
        ("b/2022.xlsx", 0, ["Account statement", None]), ("b/2022.xlsx", 3, en),
        ("b/2022.xlsx", 4, ["2022-07-01", "2022-07-02", "Shell", None, "80"]),
        # header at row 6
        ("b/2023.xlsx", 6, en), ("b/2023.xlsx", 7, ["13/01/2023", None, " Uber ", "-7", "73"]),
        # stem 2020: month first
        ("b/2020.xlsx", 0, es), ("b/2020.xlsx", 1, ["03/05/2020", None, "Aldi", "-1", "99"]),
        # no header, 6 columns: positional
        ("b/2024.xls", 0, ["2024-02-01", "2024-02-01", "Repsol", "-30", "43", "9"]),
        # no header, 5 columns
        ("b/2025.xls", 0, ["2025-02-01", None, "Bar Pepe", "-2", "41"]),
        # fewer than 5 columns: rejected
        ("b/bad.xls", 0, ["2025-02-01", "x", "y", "-2"]),
        # a header and no movements: not a reject
        ("b/empty.xlsx", 0, es),
    ]
    raw = _cells(spark, rows)
    got = {(r.src_file, r.date, r.concept, r.amount and float(r.amount), float(r.balance))
           for r in grids.parse_yearly(raw).filter("date is not null").collect()}
    assert got == {
        ("b/2021.xlsx", D(2021, 3, 5), "Lidl", -10.5, 90.0),
        ("b/2022.xlsx", D(2022, 7, 1), "Shell", None, 80.0),
        ("b/2023.xlsx", D(2023, 1, 13), "Uber", -7.0, 73.0),
        ("b/2020.xlsx", D(2020, 3, 5), "Aldi", -1.0, 99.0),
        ("b/2024.xls", D(2024, 2, 1), "Repsol", -30.0, 43.0),
        ("b/2025.xls", D(2025, 2, 1), "Bar Pepe", -2.0, 41.0),
    }
    assert [r.path for r in grids.yearly_rejects(raw).collect()] == ["b/bad.xls"]
    led = grids.load_yearly_bank(raw, "Bank1")
    assert led.filter("amount is null").count() == 1            # S7: date only is required


# ---------------------------------------------------------------- wide grid
WIDE = ([None, "Account Number", "Branch", "Currency", "Operation Date", "Value Date",
         "Income (+)", "Expense (-)", "Balance (+)", "Balance (-)", "Category", "Sub-category",
         "Reference 1", "Reference 2"] + [f"Description {i}" for i in range(1, 11)] + [None])


def _wide_row(date, inc, exp, bal_pos, bal_neg, d1, d3):
    r = [None] * 25
    r[4], r[6], r[7], r[8], r[9], r[14], r[16] = date, inc, exp, bal_pos, bal_neg, d1, d3
    return r


def test_wide_layout_cases(spark):
    rows = [
        ("w/1.xlsx", 0, ["Consulta"]), ("w/1.xlsx", 3, WIDE),
        ("w/1.xlsx", 4, _wide_row("01/02/2024", "100", "30", "500", None, "Nomina", None)),
        ("w/1.xlsx", 5, _wide_row("02/02/2024", None, "20", "480", None,
                                  "Fecha de operación 01/02/2024 Mercadona Centro", "Centro")),
        ("w/1.xlsx", 6, _wide_row("03/02/2024", None, "600", None, "120", "Hipoteca", "Cuota marzo")),
        ("w/1.xlsx", 7, _wide_row("04/02/2024", "5", None, "5", None, None, None)),
        ("w/1.xlsx", 8, [None] * 25),
        # only an expense column -> taken unsigned
        ("w/2.xlsx", 0, ["Fecha", "Gasto", "Saldo", "Movimiento"]),
        ("w/2.xlsx", 1, ["05/02/2024", "12", "7", "Taxi "]),
        # no balance column -> rejected
        ("w/3.xlsx", 0, ["Fecha", "Importe", "Movimiento"]),
        ("w/3.xlsx", 1, ["05/02/2024", "12", "x"]),
    ]
    raw = _cells(spark, rows)
    got = sorted((r.src_file, r.date, r.concept, float(r.amount),
                  None if r.balance is None else float(r.balance))
                 for r in grids.parse_wide(raw).collect())
    assert got == [
        ("w/1.xlsx", D(2024, 2, 1), "Nomina", 70.0, 500.0),
        ("w/1.xlsx", D(2024, 2, 2), "Mercadona Centro", -20.0, 480.0),
        ("w/1.xlsx", D(2024, 2, 3), "Hipoteca Cuota marzo", -600.0, None),
        ("w/1.xlsx", D(2024, 2, 4), "no description", 5.0, 5.0),
        ("w/2.xlsx", D(2024, 2, 5), "Taxi", 12.0, 7.0),
    ]
    assert [r.path for r in grids.wide_rejects(raw).collect()] == ["w/3.xlsx"]


def test_old_layout_details(spark):
    rows = [("o/1.xls", 0, ["Extracto"]), ("o/1.xls", 1, []), ("o/1.xls", 2, [None]),
            ("o/1.xls", 3, ["2019-05-01", "2019-05-01", "RECIBO", "Luz", "-40", "60"]),
            ("o/1.xls", 4, ["2019-05-02", "2019-05-02", "BIZUM", None, "10", "70"])]
    got = sorted((r.concept, float(r.amount)) for r in grids.parse_old(_cells(spark, rows)).collect())
    assert got == [("BIZUM", 10.0), ("RECIBO Luz", -40.0)]


# ---------------------------------------------------------------- statements
def _doc(name, this_stmt, last_stmt, opening, closing, body):
    head = ["BANCO", f"Fecha último estado: {last_stmt}", f"Fecha de este estado: {this_stmt}",
            f"Saldo actual: {closing}", "FECHA", "SALDO DIARIO"]
    lines = head + body + [f"Saldo anterior: {opening}", "Página 1"]
    return [(name, i, ln) for i, ln in enumerate(lines)]


def test_statement_cases(spark):
    a = _doc("s/2024-01.pdf", "15/01/2024", "15/12/2023", "1,000.00", "900.00", [
        "20/12", "77", "SUPER", "ABC", "-50.00", "950.00",          # December row, wrapped text
        "03/01", "12/34", "10-01-24 KIOSKO", "-50.00", "900.00",     # date-shaped ref, dd-MM-yy lead
        "05/01", "88", "CUT", "-1.00", "not money",                  # cut after its amount: stop
        "06/01", "99", "NEVER", "-1.00", "899.00"])
    b = _doc("s/2024-02.pdf", "15/02/2024", "15/01/2024", "899.99", "899.99", [])
    c = _doc("s/2024-03.pdf", "15/03/2024", "15/02/2024", "900.00", "900.00", [])
    lines = spark.createDataFrame(a + b + c, "doc string, line_no int, line string")
    got = sorted((r.date, r.concept, float(r.amount), float(r.balance))
                 for r in statements.parse_statement_lines(lines, block_rows=4).collect())
    assert got == [(D(2023, 12, 20), "SUPER ABC", -50.0, 950.0),
                   (D(2024, 1, 3), "KIOSKO", -50.0, 900.0)]
    gaps = [(r.after_file, r.before_file, round(r.difference, 2))
            for r in statements.continuity_gaps(lines).collect()]
    assert gaps == []            # 900.00 -> 899.99 and back: float differences below 0.01
    meta = {r.doc: r for r in statements.statement_meta(lines).collect()}
    assert float(meta["s/2024-01.pdf"].opening) == 1000.0
    assert meta["s/2024-02.pdf"].last_stmt == dt.date(2024, 1, 15)


def test_statement_gap_threshold(spark):
    docs = (_doc("t/1.pdf", "31/01/2024", "31/12/2023", "0.00", "100.00", [])
            + _doc("t/2.pdf", "29/02/2024", "31/01/2024", "100.02", "100.02", [])
            + _doc("t/3.pdf", "31/03/2024", "29/02/2024", "100.02", "1.00", []))
    lines = spark.createDataFrame(docs, "doc string, line_no int, line string")
    got = [(r.after_file, r.before_file) for r in statements.continuity_gaps(lines).collect()]
    assert got == [("t/1.pdf", "t/2.pdf")]
