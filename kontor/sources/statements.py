"""Account statements given as text lines: A12-A15 and the continuity check G2.

Input ``stmt_lines(doc, line_no, line)``: the trimmed, non-blank text lines
of each statement, in order (text extraction from PDF is outside).  The
grammar of the movement list, after the first ``SALDO DIARIO`` title line and
until a ``Saldo anterior:`` line met while looking for a record:

    date (dd/MM) · reference (any one line) · description (1..n lines) ·
    amount (money) · balance (money)

A record whose amount is not followed by a money line ends the document;
a record cut off by the end of the document is dropped.  This is a
sequential parse, run as a finite-state scan (``plans.fsm``) of the sorted lines, so
a long document is spread over many tasks; the scan puts out records, not lines.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kontor.functions.money import parse_money
from kontor.functions.text import strip
from kontor.operators.categorize import Rules, categorize
from kontor.operators.fixed_values import BALANCE_GAP_TOLERANCE, DEFAULT_RULES
from kontor.operators.identity import dedup
from kontor.plans.fsm import fsm_scan
from kontor.plans.joins import join_small
from kontor.schema import LEDGER_COLUMNS
from kontor.sources.files import counted, stage_table

# ---- FIXED VALUES: statement text patterns ----
MONEY_RE = r"^-?[\d,]+\.\d{2}$"
DATE_RE = r"^\d{2}/\d{2}$"
LAST_STMT_RE = r"Fecha último estado:\s*(\d{2}/\d{2}/\d{4})"
THIS_STMT_RE = r"Fecha de este estado:\s*(\d{2}/\d{2}/\d{4})"
OPENING_RE = r"Saldo anterior:\s*(-?[\d,]+\.\d{2})"
CLOSING_RE = r"Saldo actual:\s*(-?[\d,]+\.\d{2})"
TABLE_TITLE = "SALDO DIARIO"
STOP_PREFIX = "Saldo anterior:"
PURCHASE_DATE_LEAD_RE = r"^\d{2}-\d{2}-\d{2}\s+"
STATEMENT_BANK = "BNCR"
# ---- end of fixed values ----

# line symbols and parser states
OTHER, DATE, MONEY_LINE, STOP = 0, 1, 2, 3
SEEK, AFTER_DATE, DESC, AFTER_AMOUNT, STOPPED = 0, 1, 2, 3, 4
#               OTHER          DATE          MONEY          STOP
TRANSITIONS = [
    [SEEK,         AFTER_DATE,   SEEK,          STOPPED],   # SEEK
    [DESC,         DESC,         DESC,          DESC],      # AFTER_DATE: the reference line
    [DESC,         DESC,         AFTER_AMOUNT,  DESC],      # DESC
    [STOPPED,      STOPPED,      SEEK,          STOPPED],   # AFTER_AMOUNT: balance or stop
    [STOPPED,      STOPPED,      STOPPED,       STOPPED],   # STOPPED
]
RECORD_START = {(SEEK, DATE)}


def _money_text(c: Column) -> Column:
    return parse_money(c)


def _ddmmyyyy(c: Column) -> Column:
    return F.when(F.try_to_timestamp(c, F.lit("dd/MM/yyyy")).isNotNull(),
                  F.to_date(c, "dd/MM/yyyy"))


def statement_meta(lines: DataFrame) -> DataFrame:
    """Per document, the last match of each header pattern."""
    def last(pattern: str) -> Column:
        hit = F.col("line").rlike(pattern)
        return F.max_by(F.regexp_extract("line", pattern, 1), F.when(hit, F.col("line_no")))

    # the patterns stand in a few header lines; only those are aggregated
    any_hit = functools.reduce(lambda a, b: a | b, [
        F.col("line").rlike(p) for p in (LAST_STMT_RE, THIS_STMT_RE, OPENING_RE, CLOSING_RE)])
    found = lines.filter(any_hit).groupBy("doc").agg(
        last(LAST_STMT_RE).alias("_last"), last(THIS_STMT_RE).alias("_this"),
        last(OPENING_RE).alias("_open"), last(CLOSING_RE).alias("_close"))
    m = lines.select("doc").distinct().join(found, "doc", "left")
    return m.select("doc", _ddmmyyyy(F.col("_last")).alias("last_stmt"),
                    _ddmmyyyy(F.col("_this")).alias("this_stmt"),
                    _money_text(F.col("_open")).alias("opening"),
                    _money_text(F.col("_close")).alias("closing"))


def _symbol(line: Column) -> Column:
    return (F.when(line.startswith(STOP_PREFIX), F.lit(STOP))
            .when(line.rlike(DATE_RE), F.lit(DATE))
            .when(line.rlike(MONEY_RE), F.lit(MONEY_LINE))
            .otherwise(F.lit(OTHER)))


GATHERED = ("doc string, mark long, role string, line_no long, line string, _ddmm string, "
            "_desc string, _amount string, _balance string")
_GATHERED_TYPES = [("doc", pa.string()), ("mark", pa.int64()), ("role", pa.string()),
                   ("line_no", pa.int64()), *((c, pa.string()) for c in (
                       "line", "_ddmm", "_desc", "_amount", "_balance"))]


def _gathered(n: int, **columns: pa.Array) -> pa.Table:
    return pa.table({name: columns[name].cast(kind) if name in columns else pa.nulls(n, kind)
                     for name, kind in _GATHERED_TYPES})


def gather_records(rows: pa.Table, syms: np.ndarray, before: np.ndarray, mark: np.ndarray,
                   whole: bool) -> pa.Table:
    """The records of consecutive lines of one document, a row each: of ``whole`` runs those
    with a balance.  Lines that may not be all of their record's (``not whole``), or whose
    line numbers repeat, come out one by one with their roles."""
    money = syms == MONEY_LINE
    roles = np.select([(before == SEEK) & (syms == DATE), (before == DESC) & money, before == DESC,
                       (before == AFTER_AMOUNT) & money], [1, 2, 3, 4], 0)
    used = np.flatnonzero((roles > 0) & (mark >= 0) if whole else roles > 0)
    roles, mark = roles[used], mark[used]
    line, line_no = rows["line"].take(used).combine_chunks(), rows["line_no"].take(used)
    doc = rows["doc"].take(used)
    if whole:
        first = np.flatnonzero(np.diff(mark, prepend=-1))       # a record's first line
        record = np.cumsum(np.diff(mark, prepend=-1) != 0) - 1  # each line's record
        n = len(first)
        has = [np.bincount(record[roles == r], minlength=n) for r in (1, 2, 4)]
        numbers = line_no.to_numpy().astype(np.int64)
        repeats = np.zeros(n, bool)
        repeats[record[1:][(np.diff(numbers) == 0) & (np.diff(record) == 0)]] = True
        plain = (has[0] == 1) & (has[1] == 1) & (has[2] == 1) & ~repeats
        odd = (has[2] > 0) & ~plain
    else:
        plain, odd, record = np.zeros(0, bool), np.ones(1, bool), np.zeros(len(used), np.int64)
    out = []
    if plain.any():
        chosen = plain[record]
        words = np.flatnonzero(chosen & (roles == 3) & line.is_valid().to_numpy(False))
        ends = np.cumsum(np.bincount(record[words], minlength=n)[plain])
        texts = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), line.take(words))
        each = {name: line.take(np.flatnonzero(chosen & (roles == r)))
                for name, r in (("_ddmm", 1), ("_amount", 2), ("_balance", 4))}
        out.append(_gathered(int(plain.sum()), doc=doc.take(first[plain]),
                             mark=pa.array(mark[first[plain]]),
                             _desc=pc.binary_join(texts, " "), **each))
    if odd.any() and len(used):
        kept = np.flatnonzero(odd[record])
        names = pa.array(["date", "amount", "desc", "balance"]).take(pa.array(roles[kept] - 1))
        out.append(_gathered(len(kept), doc=doc.take(kept), role=names,
                             mark=pa.array(mark[kept], mask=mark[kept] < 0),
                             line_no=line_no.take(kept), line=line.take(kept)))
    return pa.concat_tables(out) if out else _gathered(0)


def parse_statement_lines(lines: DataFrame, block_rows: int | None = None) -> DataFrame:
    """A12 + A14: movements ``(doc, line_no, date, concept, amount, balance)``.

    ``line_no`` is the record's first line.  The year comes from the
    statement date; a dd/MM that would fall after it belongs to the year
    before.  An impossible date (29/02 in a common year) gives a null date.
    """
    lines = lines.select("doc", F.col("line_no").cast("long").alias("line_no"), "line")
    this_hit = F.col("line").rlike(THIS_STMT_RE)
    info = lines.filter(this_hit | (F.col("line") == TABLE_TITLE)).groupBy("doc").agg(
        (F.min(F.when(F.col("line") == TABLE_TITLE, F.col("line_no"))) + 1).alias("_start"),
        F.max_by(F.regexp_extract("line", THIS_STMT_RE, 1), F.when(this_hit, F.col("line_no")))
        .alias("_this"))
    info = info.select("doc", "_start", _ddmmyyyy(F.col("_this")).alias("this_stmt"))
    info, few = counted(info, "stmt-info")
    body = (join_small(lines, info.select("doc", "_start"), "doc", "left", few)
            .filter(F.col("line_no") >= F.coalesce("_start", F.lit(0)))
            .select("doc", "line_no", "line"))

    def dated(rows: DataFrame) -> DataFrame:
        # stored: read several times, and scanned once
        return stage_table(join_small(rows, info.select("doc", "this_stmt"), "doc", "left", few),
                           "stmt-parts")

    scanned = fsm_scan(body, "doc", "line_no", _symbol(F.col("line")), TRANSITIONS, SEEK,
                       RECORD_START, gather=gather_records, gathered=GATHERED, store=dated,
                       **({"block_rows": block_rows} if block_rows else {}))
    scanned = scanned.filter(F.col("mark").isNotNull())
    whole = scanned.filter(F.col("role").isNull()).select(
        "doc", F.col("mark").alias("line_no"), "_ddmm", "_desc", "_amount", "_balance",
        "this_stmt")
    # lines of records that a cut between tasks parts, or of which the scan holds no more
    parts = scanned.filter(F.col("role").isNotNull())
    # only complete records (those with a balance line) gather their lines: a
    # record cut off by the end of a document never collects its text
    complete = parts.filter(F.col("role") == "balance").select("doc", "mark")
    parts = parts.join(complete, ["doc", "mark"], "left_semi")
    rec = parts.groupBy("doc", F.col("mark").alias("line_no")).agg(
        F.max(F.when(F.col("role") == "date", F.col("line"))).alias("_ddmm"),
        F.array_join(F.sort_array(F.collect_list(F.when(
            F.col("role") == "desc", F.struct("line_no", "line"))))["line"], " ").alias("_desc"),
        F.max(F.when(F.col("role") == "amount", F.col("line"))).alias("_amount"),
        F.max(F.when(F.col("role") == "balance", F.col("line"))).alias("_balance"),
        F.max("this_stmt").alias("this_stmt"))
    rec = whole.unionByName(rec.filter(F.col("_balance").isNotNull()))

    day = F.substring("_ddmm", 1, 2)
    month = F.substring("_ddmm", 4, 2)

    def on_year(y: Column) -> Column:
        return F.try_to_date(F.concat_ws("-", y.cast("string"), month, day), "yyyy-M-dd")

    this_year = on_year(F.year("this_stmt"))
    date = F.when(this_year > F.col("this_stmt"), on_year(F.year("this_stmt") - 1)) \
        .otherwise(this_year)
    desc = strip(F.col("_desc"))
    return rec.select(
        "doc", "line_no",
        date.cast("timestamp_ntz").alias("date"),
        F.regexp_replace(desc, PURCHASE_DATE_LEAD_RE, "").alias("concept"),
        _money_text(F.col("_amount")).alias("amount"),
        _money_text(F.col("_balance")).alias("balance"))


def load_statements(lines: DataFrame, bank: str = STATEMENT_BANK, rules: Rules = DEFAULT_RULES,
                    block_rows: int | None = None) -> DataFrame:
    """Every document, tagged, categorised, rows without date or amount
    dropped, duplicates removed (first in ledger order)."""
    p = parse_statement_lines(lines, block_rows)
    df = p.select("date", strip(F.coalesce("concept", F.lit("nan"))).alias("concept"), "amount", "balance", F.lit(bank).alias("bank"),
                  F.col("doc").alias("src_file"), F.col("line_no").alias("src_row"))
    df = categorize(df, "concept", "category", rules).dropna(subset=["date", "amount"])
    return dedup(df.select(*LEDGER_COLUMNS))


def continuity_gaps(lines: DataFrame, account: Column | None = None) -> DataFrame:
    """Consecutive statements (by file name, per account folder) whose
    closing and next opening balance differ by more than 0.01 — a statement
    is missing in between.  The difference is computed on doubles, as the
    statements' numbers are floats in the original check."""
    meta = statement_meta(lines)
    acct = account if account is not None else F.regexp_extract("doc", r"^(.*)/[^/]*$", 1)
    w = Window.partitionBy("_acct").orderBy("doc")
    pairs = (meta.withColumn("_acct", acct)
             .select("_acct",
                     F.col("doc").alias("after_file"),
                     F.lead("doc").over(w).alias("before_file"),
                     F.col("this_stmt").alias("after_date"),
                     F.lead("last_stmt").over(w).alias("before_date"),
                     F.col("closing").cast("double").alias("balance_after"),
                     F.lead("opening").over(w).cast("double").alias("balance_before")))
    diff = F.col("balance_before") - F.col("balance_after")
    return (pairs.filter(F.col("before_file").isNotNull() & (F.abs(diff) > BALANCE_GAP_TOLERANCE))
            .select("after_file", "before_file", "after_date", "before_date",
                    "balance_after", "balance_before", diff.alias("difference")))
