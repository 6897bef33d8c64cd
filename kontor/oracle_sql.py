"""DuckDB SQL for each registered query, over the same parquet tables.

The SQL is written independently of the Spark code: window functions where
Spark uses the block scan, ``arg_max``/``arg_min`` where Spark uses max_by,
plain CASE chains for the rule tables.  Only the rule tables themselves (data)
are shared, turned into CASE text by ``rules_case``.
"""

from __future__ import annotations

from kontor.sources.standin import STANDIN_RULES


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rules_case(rules, text_sql: str, default: str = "other") -> str:
    low = f"lower(coalesce({text_sql}, 'nan'))"
    whens = []
    for keywords, category in rules:
        kws = [k.lower() for k in keywords if k]
        if kws:
            cond = " OR ".join(f"contains({low}, {_lit(k)})" for k in kws)
            whens.append(f"WHEN {cond} THEN {_lit(category)}")
    return "CASE " + " ".join(whens) + f" ELSE {_lit(default)} END"


MOVEMENTS = """
movements AS (
  SELECT CAST(o_orderdate AS TIMESTAMP) AS "date",
         concat_ws(' ', c_mktsegment, o_orderpriority) AS concept,
         CAST(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE -o_totalprice END
              AS DECIMAL(18,2)) AS amount,
         'Bank' || CAST(o_custkey % 3 + 1 AS VARCHAR) AS bank,
         'orders' AS src_file,
         CAST(o_orderkey AS BIGINT) AS src_row
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

LEDGER = MOVEMENTS + f""",
ledger AS (
  SELECT "date", concept, amount, bank, src_file, src_row,
         {rules_case(STANDIN_RULES, 'concept')} AS category,
         CAST(SUM(amount) OVER (PARTITION BY bank ORDER BY "date", src_file, src_row
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
              AS DECIMAL(18,2)) AS balance
  FROM movements)"""

NO_TRANSFERS = "coalesce(category IN ('own transfer', 'transfer'), false) = false"


def with_ledger(body: str) -> str:
    return "WITH " + LEDGER + "\n" + body


SQL: dict[str, str] = {}

SQL["monthly_net_by_bank"] = with_ledger(f"""
SELECT bank, CAST(date_trunc('month', "date") AS DATE) AS month,
       CAST(coalesce(sum(amount), 0) AS DOUBLE) AS amount
FROM ledger WHERE {NO_TRANSFERS} AND "date" IS NOT NULL
GROUP BY ALL""")

BASE_ONLY = "bank NOT IN ('Bank3')"   # the stand-in bank table gives Bank3 another currency
VOCAB = ", ".join(_lit(c) for c in __import__(
    "kontor.operators.fixed_values", fromlist=["x"]).DEFAULT_VOCABULARY)

SQL["totals_in_out"] = with_ledger(f"""
SELECT CAST(coalesce(sum(amount) FILTER (WHERE amount > 0), 0) AS DOUBLE) AS total_income,
       CAST(abs(coalesce(sum(amount) FILTER (WHERE amount < 0), 0)) AS DOUBLE) AS total_expenses
FROM ledger WHERE {NO_TRANSFERS} AND {BASE_ONLY}""")

SQL["expenses_by_category"] = with_ledger(f"""
SELECT bank, category, CAST(abs(sum(amount)) AS DOUBLE) AS amount
FROM ledger WHERE {NO_TRANSFERS} AND amount < 0 GROUP BY bank, category""")

SQL["income_by_category"] = with_ledger(f"""
SELECT bank, category, CAST(sum(amount) AS DOUBLE) AS amount
FROM ledger WHERE {NO_TRANSFERS} AND amount > 0 GROUP BY bank, category""")

SQL["monthly_net"] = with_ledger(f"""
SELECT CAST(date_trunc('month', "date") AS DATE) AS month, CAST(sum(amount) AS DOUBLE) AS amount
FROM ledger WHERE {NO_TRANSFERS} AND bank = 'Bank1' GROUP BY 1""")

SQL["expenses_by_category_year"] = with_ledger(f"""
SELECT category, CAST(year("date") AS VARCHAR) AS year, CAST(abs(sum(amount)) AS DOUBLE) AS amount
FROM ledger WHERE {NO_TRANSFERS} AND {BASE_ONLY} AND amount < 0 GROUP BY 1, 2""")

SQL["income_by_category_year"] = with_ledger(f"""
SELECT category, CAST(year("date") AS VARCHAR) AS year, CAST(sum(amount) AS DOUBLE) AS amount
FROM ledger WHERE {NO_TRANSFERS} AND {BASE_ONLY} AND amount > 0 GROUP BY 1, 2""")

SQL["eod_balance"] = with_ledger("""
SELECT bank, CAST("date" AS DATE) AS "date",
       CAST(arg_max(balance, row("date", src_file, src_row)) AS DOUBLE) AS balance
FROM ledger WHERE balance IS NOT NULL GROUP BY bank, CAST("date" AS DATE)""")

SQL["eod_balance_chart"] = with_ledger(f"""
SELECT bank, CAST("date" AS DATE) AS "date",
       CAST(arg_min(balance, row("date", -balance)) AS DOUBLE) AS balance
FROM ledger WHERE balance IS NOT NULL AND category IN ({VOCAB})
GROUP BY bank, CAST("date" AS DATE)""")

SQL["latest_balance"] = with_ledger("""
SELECT bank, CAST(arg_max(balance, row("date", src_file, src_row)) AS DOUBLE) AS balance
FROM ledger WHERE balance IS NOT NULL GROUP BY bank""")

SQL["movement_summary"] = with_ledger("""
, sides AS (
  SELECT bank, CASE WHEN amount >= 0 THEN 'income' ELSE 'expenses' END AS side,
         abs(amount) AS a, strftime("date", '%Y-%m') AS ym, CAST(year("date") AS VARCHAR) AS y
  FROM ledger WHERE amount IS NOT NULL)
SELECT bank, side, CAST(sum(a) AS DOUBLE) AS total,
       count(DISTINCT ym) AS n_months, count(DISTINCT y) AS n_years,
       CAST(sum(a) AS DOUBLE) / CAST(count(DISTINCT ym) AS DOUBLE) AS monthly_avg,
       CAST(sum(a) AS DOUBLE) / CAST(count(DISTINCT y) AS DOUBLE) AS yearly_avg
FROM sides GROUP BY bank, side""")

SQL["category_share"] = with_ledger(f"""
, cats AS (SELECT bank, category, abs(sum(amount)) AS c FROM ledger
           WHERE {NO_TRANSFERS} AND amount < 0 GROUP BY bank, category)
SELECT bank, category, CAST(c AS DOUBLE) AS amount,
       CAST(c AS DOUBLE) / CAST(sum(c) OVER (PARTITION BY bank) AS DOUBLE) AS share
FROM cats""")

SQL["date_bounds"] = with_ledger("""
SELECT CAST(min("date") AS DATE) AS start_date, CAST(max("date") AS DATE) AS end_date FROM ledger""")

SQL["banks_years"] = with_ledger("""
SELECT DISTINCT bank, CAST(year("date") AS VARCHAR) AS year FROM ledger""")


def _rewrite_sql(src: str) -> str:
    """Nested subqueries, one per rewrite rule (each reads the previous label)."""
    from kontor.sources.standin import standin_rewrites
    q = f"SELECT *, concept AS label FROM {src}"
    for r in standin_rewrites():
        conds = []
        if r.pattern is not None:
            conds.append(f"coalesce(regexp_matches(label, {_lit(r.pattern)}), false)")
        if r.min_abs is not None:
            conds.append(f"coalesce(abs(amount) >= {r.min_abs}, false)")
        if r.eq_abs is not None:
            conds.append(f"coalesce(abs(amount) = {r.eq_abs}, false)")
        if conds:
            q = (f"SELECT * REPLACE (CASE WHEN {' AND '.join(conds)} THEN {_lit(r.label)} "
                 f"ELSE label END AS label) FROM ({q})")
    return q


SQL["label_totals"] = with_ledger(f"""
SELECT label, CAST(sum(amount) AS DOUBLE) AS amount FROM ({_rewrite_sql('ledger')})
WHERE label IS NOT NULL GROUP BY label""")

SQL["year_label_totals"] = with_ledger(f"""
SELECT * FROM (
  SELECT CAST(year("date") AS VARCHAR) AS year, label, CAST(sum(amount) AS DOUBLE) AS amount
  FROM ({_rewrite_sql('ledger')}) WHERE label IS NOT NULL GROUP BY 1, 2)
WHERE label NOT IN ('urgent')""")

def _purchases_sql(body: str) -> str:
    """Rules as rows, applied one after the other to every distinct (concept, amount)."""
    from kontor.sources.standin import purchase_rewrites

    def value(x):
        return "NULL" if x is None else _lit(x) if isinstance(x, str) else repr(x)

    rows = ", ".join(f"({n}, {value(r.label)}, {value(r.pattern)}, {value(r.min_abs)}, "
                     f"{value(r.eq_abs)})" for n, r in enumerate(purchase_rewrites(), 1))
    return f"""
WITH RECURSIVE rules(n, new_label, pattern, min_abs, eq_abs) AS (VALUES {rows}),
purchases AS (
  SELECT l_shipdate AS "date", concat_ws(' ', p_name, p_brand) AS concept, -l_quantity AS amount,
         l_orderkey AS order_key, l_linenumber AS line
  FROM lineitem JOIN part ON l_partkey = p_partkey),
step(n, concept, amount, label) AS (
  SELECT 0, concept, amount, concept FROM (SELECT DISTINCT concept, amount FROM purchases)
  UNION ALL
  SELECT r.n, concept, amount,
         CASE WHEN (pattern IS NULL OR regexp_matches(label, pattern))
               AND (min_abs IS NULL OR abs(amount) >= min_abs)
               AND (eq_abs IS NULL OR abs(amount) = eq_abs) THEN new_label ELSE label END
  FROM step s JOIN rules r ON r.n = s.n + 1),
labelled AS (
  SELECT p.*, s.label FROM purchases p
  JOIN step s ON s.concept = p.concept AND s.amount = p.amount
  AND s.n = (SELECT max(n) FROM rules))
{body}"""


SQL["purchase_labels"] = _purchases_sql("SELECT order_key, line, concept, label FROM labelled")

SQL["purchase_label_totals"] = _purchases_sql("""
SELECT label, CAST(sum(amount) AS DOUBLE) AS amount FROM labelled GROUP BY label""")

SQL["purchase_year_label_totals"] = _purchases_sql("""
SELECT CAST(year("date") AS VARCHAR) AS year, label, CAST(sum(amount) AS DOUBLE) AS amount
FROM labelled WHERE label NOT IN ('fees', 'lease', 'rest', 'red things') GROUP BY 1, 2""")

TX_ID = """md5(bank || '|' || strftime("date", '%Y-%m-%dT%H:%M:%S')
    || CASE WHEN strftime("date", '%f') = '000000' THEN '' ELSE '.' || strftime("date", '%f') END
    || '|' || concept || '|' || CAST(CAST(amount AS DOUBLE) AS VARCHAR))"""

VIEW = f"""
, view AS (
  SELECT bank, {TX_ID} AS tx_id, strftime("date", '%Y-%m-%d') AS "date", concept,
         CAST(amount AS DOUBLE) AS amount, CAST(balance AS DOUBLE) AS balance,
         CASE WHEN category IN ({VOCAB}) THEN category ELSE 'other' END AS category
  FROM ledger)"""

SQL["movements_view"] = with_ledger(VIEW + "\nSELECT * FROM view")

SQL["search_movements"] = with_ledger(VIEW + """
SELECT * FROM view
WHERE contains(lower("date"), '-0') AND contains(lower(concept), 'high')
  AND contains(regexp_replace(CAST(amount AS VARCHAR), '\\.0$', ''), '5')
  AND contains(lower(category), 'e')""")

SQL["category_year_filter"] = with_ledger("""
SELECT bank, src_row, category, CAST(amount AS DOUBLE) AS amount,
       CAST(year("date") AS VARCHAR) AS year
FROM ledger WHERE category IN ('rent', 'fuel', 'other')
  AND CAST(year("date") AS VARCHAR) IN ('1996', '1997', '2000')""")

SQL["date_range"] = with_ledger("""
SELECT bank, src_row, "date", CAST(amount AS DOUBLE) AS amount FROM ledger
WHERE CAST("date" AS DATE) BETWEEN DATE '1996-03-01' AND DATE '1998-06-30'""")

SQL["hide_transfers"] = with_ledger(f"""
SELECT bank, src_row, category FROM ledger WHERE {NO_TRANSFERS}""")

SQL["base_currency_only"] = with_ledger("""
, dim AS (SELECT 'Bank3' AS bank, '₡' AS currency)
SELECT l.bank, coalesce(dim.currency, '€') AS currency,
       CAST(coalesce(sum(amount) FILTER (WHERE amount > 0), 0) AS DOUBLE) AS total_income,
       CAST(abs(coalesce(sum(amount) FILTER (WHERE amount < 0), 0)) AS DOUBLE) AS total_expenses
FROM ledger l LEFT JOIN dim USING (bank)
WHERE coalesce(dim.currency, '€') = '€'
GROUP BY l.bank, coalesce(dim.currency, '€')""")

SQL["category_rank"] = with_ledger(f"""
, by_cy AS (SELECT category, CAST(year("date") AS VARCHAR) AS year, abs(sum(amount)) AS a
            FROM ledger WHERE {NO_TRANSFERS} AND {BASE_ONLY} AND amount < 0 GROUP BY 1, 2),
tot AS (SELECT category, sum(a) AS t FROM by_cy GROUP BY 1)
SELECT category, year, CAST(a AS DOUBLE) AS amount, CAST(t AS DOUBLE) AS category_total,
       CAST(dense_rank() OVER (ORDER BY t DESC, category) AS INTEGER) AS category_rank
FROM by_cy JOIN tot USING (category)""")

SQL["tx_id"] = with_ledger(f"SELECT bank, src_row, {TX_ID} AS tx_id FROM ledger")

SQL["dedup"] = with_ledger("""
, both_exports AS (
  SELECT "date", concept, amount, balance, bank, category, src_file, src_row FROM ledger
  UNION ALL
  SELECT "date" + INTERVAL 2 HOUR, concept, amount,
         CASE WHEN NOT contains(concept, '3-MEDIUM') THEN balance END,
         bank, category, 'orders_reexport', src_row FROM ledger),
keyed AS (
  SELECT *, row_number() OVER (
      PARTITION BY bank, balance IS NOT NULL, amount,
                   CASE WHEN balance IS NOT NULL THEN balance END,
                   CASE WHEN balance IS NULL THEN "date" END,
                   CASE WHEN balance IS NULL THEN concept END
      ORDER BY "date", src_file, src_row) AS rn
  FROM both_exports)
SELECT "date", concept, CAST(amount AS DOUBLE) AS amount, CAST(balance AS DOUBLE) AS balance,
       bank, category, src_file, src_row
FROM keyed WHERE rn = 1""")

SQL["running_balance"] = with_ledger("""
SELECT bank, src_row, CAST(balance AS DOUBLE) AS balance FROM ledger""")

# ------------------------------------------------------------ categorisation
from kontor.operators.fixed_values import DEFAULT_RULES  # noqa: E402

SQL["categorize_ledger"] = "WITH " + MOVEMENTS + f"""
SELECT bank, src_row, {rules_case(STANDIN_RULES, 'concept')} AS category FROM movements"""

SQL["categorize_text"] = f"""
SELECT doc_id, {rules_case(DEFAULT_RULES, 'text')} AS category FROM documents"""

def _type_override_sql(rules) -> str:
    return f"""
WITH card AS (
  SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'Card Payment' WHEN '2-HIGH' THEN 'Topup'
              WHEN '3-MEDIUM' THEN 'ATM' WHEN '4-NOT SPECIFIED' THEN 'Card Refund'
              WHEN '5-LOW' THEN 'Exchange' END AS typ,
         strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS started,
         concat_ws(' ', c_mktsegment, c_name) AS description,
         CAST(CAST(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE -o_totalprice END
                   AS DECIMAL(18,2)) AS VARCHAR) AS amount_txt,
         CASE WHEN o_orderstatus = 'P' THEN 'REVERTED' ELSE 'COMPLETED' END AS state,
         CAST(o_orderkey AS BIGINT) AS src_row
  FROM orders JOIN customer ON o_custkey = c_custkey),
parsed AS (
  SELECT src_row, typ,
         coalesce(try_strptime(trim(started), '%Y-%m-%d %H:%M:%S'),
                  try_strptime(trim(started), '%Y-%m-%dT%H:%M:%S'),
                  try_strptime(trim(started), '%Y-%m-%d %H:%M'),
                  try_strptime(trim(started), '%Y-%m-%d')) AS "date",
         trim(coalesce(description, 'nan')) AS concept,
         TRY_CAST(replace(trim(amount_txt), ',', '') AS DECIMAL(18,2)) AS amount
  FROM card WHERE state = 'COMPLETED')
SELECT src_row, "date", concept, CAST(amount AS DOUBLE) AS amount,
       CASE typ WHEN 'Topup' THEN 'own transfer' WHEN 'ATM' THEN 'atm'
                WHEN 'Card Refund' THEN 'refund' WHEN 'Exchange' THEN 'exchange'
                ELSE {rules_case(rules, 'concept')} END AS category
FROM parsed"""


SQL["type_override"] = _type_override_sql(DEFAULT_RULES)

SQL["sequential_rewrite"] = with_ledger(
    f"SELECT bank, src_row, label FROM ({_rewrite_sql('ledger')})")

# ----------------------------------------------------------------- overrides
IDS = f"""
, ids AS (SELECT *, {TX_ID} AS tx_id FROM ledger),
ov AS (
  SELECT DISTINCT tx_id,
         CASE WHEN contains(concept, '1-URGENT') THEN 'refund'
              WHEN contains(concept, '2-HIGH') THEN 'accommodation'
              WHEN contains(concept, '3-MEDIUM') THEN 'other'
              ELSE lower(split_part(concept, ' ', 1)) END AS category
  FROM ids WHERE src_row IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')),
learned AS (
  SELECT prefix, min(category) AS category FROM (
    SELECT substr(ck, 1, L) AS prefix, category
    FROM (SELECT lower(trim(coalesce(c.concept, 'nan'))) AS ck, ov.category
          FROM (SELECT tx_id, max(concept) AS concept FROM ids GROUP BY tx_id) c
          JOIN ov USING (tx_id)
          WHERE ov.category IS NULL OR ov.category <> 'other'),
         generate_series(5, 30) AS t(L)
    WHERE L <= length(ck))
  GROUP BY prefix HAVING count(DISTINCT category) = 1 AND count(*) = count(category)),
edits AS (
  SELECT l_shipdate AS at_, l_orderkey AS ord, l_linenumber AS line, ids.bank, ids.tx_id,
         lower(p_type) AS category
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN ids ON l_orderkey = ids.src_row
  WHERE l_quantity >= 50),
bulk AS (
  SELECT tx_id, arg_max(category, row(at_, ord, line)) AS category FROM (
    SELECT r.tx_id, e.at_, e.ord, e.line, e.category
    FROM (SELECT bank, tx_id, lower(trim(coalesce(concept, 'nan'))) AS ck FROM ids) r
    JOIN (SELECT edits.*, substr(lower(trim(coalesce(c.concept, 'nan'))), 1, 20) AS prefix
          FROM edits JOIN (SELECT tx_id, max(concept) AS concept FROM ids GROUP BY tx_id) c
          USING (tx_id)) e
      ON r.bank = e.bank AND length(e.prefix) > 0 AND starts_with(r.ck, e.prefix)
    UNION ALL
    SELECT tx_id, at_, ord, line, category FROM edits)
  GROUP BY tx_id),
log AS (
  SELECT CAST(strftime(l_shipdate, '%Y%m%d') AS BIGINT) AS version, ids.tx_id,
         max(lower(p_type)) AS category, starts_with(max(lower(p_type)), 'standard') AS deleted
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN ids ON l_orderkey = ids.src_row
  WHERE l_quantity >= 50 GROUP BY 1, 2)"""

SQL["apply_overrides"] = with_ledger(IDS + """
SELECT bank, src_row,
       CASE WHEN coalesce(ov.category, ids.category, 'other') = 'accommodation' THEN 'other'
            ELSE coalesce(ov.category, ids.category, 'other') END AS category
FROM ids LEFT JOIN ov USING (tx_id)""")

SQL["apply_overrides_by_id"] = with_ledger(IDS + """
, merged AS (
  SELECT tx_id, arg_max(category, p) AS category FROM (
    SELECT tx_id, category, 0 AS p FROM ov UNION ALL SELECT tx_id, category, 1 FROM bulk)
  GROUP BY tx_id)
SELECT bank, src_row,
       CASE WHEN coalesce(m.category, ids.category, 'other') = 'accommodation' THEN 'other'
            ELSE coalesce(m.category, ids.category, 'other') END AS category
FROM ids LEFT JOIN merged m USING (tx_id)""")

SQL["learn_prefix_rules"] = with_ledger(IDS + "\nSELECT prefix, category FROM learned")

SQL["auto_classify"] = with_ledger(IDS + """
, cand AS (SELECT tx_id, lower(trim(coalesce(concept, 'nan'))) AS ck FROM ids
           WHERE tx_id NOT IN (SELECT tx_id FROM ov)),
best AS (
  SELECT ck, arg_max(l.category, L) AS category
  FROM (SELECT DISTINCT ck FROM cand), generate_series(5, 30) AS t(L)
  JOIN learned l ON l.prefix = substr(ck, 1, L)
  WHERE L <= length(ck) GROUP BY ck)
SELECT tx_id, max(best.category) AS category FROM cand JOIN best USING (ck) GROUP BY tx_id""")

SQL["bulk_apply"] = with_ledger(IDS + "\nSELECT tx_id, category FROM bulk")

SQL["merge_overrides"] = with_ledger(IDS + """
SELECT tx_id, arg_max(category, p) AS category FROM (
  SELECT tx_id, category, 0 AS p FROM ov UNION ALL SELECT tx_id, category, 1 FROM bulk)
GROUP BY tx_id""")

SQL["overrides_asof"] = with_ledger(IDS + """
SELECT tx_id, category FROM (
  SELECT tx_id, arg_max(category, version) AS category, arg_max(deleted, version) AS deleted
  FROM log WHERE version <= 19990101 GROUP BY tx_id)
WHERE NOT deleted""")

SQL["intervals_asof"] = SQL["overrides_asof"]

SQL["prefix_counts_from_changes"] = with_ledger(IDS + """
, final AS (
  SELECT tx_id, category FROM (
    SELECT tx_id, arg_max(category, version) AS category, arg_max(deleted, version) AS deleted
    FROM log GROUP BY tx_id)
  WHERE NOT deleted)
SELECT prefix, category, count(*) AS n FROM (
  SELECT substr(ck, 1, L) AS prefix, category
  FROM (SELECT lower(trim(coalesce(c.concept, 'nan'))) AS ck, final.category
        FROM (SELECT tx_id, max(concept) AS concept FROM ids GROUP BY tx_id) c
        JOIN final USING (tx_id) WHERE final.category <> 'other'),
       generate_series(5, 30) AS t(L)
  WHERE L <= length(ck))
GROUP BY prefix, category""")

SQL["override_retention"] = with_ledger(IDS + """
, kept AS (SELECT min(version) AS first FROM (
  SELECT DISTINCT version FROM log ORDER BY version DESC LIMIT 200))
SELECT version, tx_id, category, deleted FROM log WHERE version >= (SELECT first FROM kept)
UNION ALL
SELECT (SELECT max(version) FROM log WHERE version < (SELECT first FROM kept)) AS version,
       tx_id, category, false AS deleted
FROM (SELECT tx_id, arg_max(category, version) AS category, arg_max(deleted, version) AS deleted
      FROM log WHERE version < (SELECT first FROM kept) GROUP BY tx_id)
WHERE NOT deleted""")

SQL["vocabulary_merge"] = f"""
WITH vocab AS (SELECT unnest([{VOCAB}]) AS category),
names AS (SELECT ' ' || p_type AS name FROM part UNION ALL SELECT c_mktsegment FROM customer),
cand AS (SELECT DISTINCT lower(trim(name)) AS category FROM names
         WHERE name IS NOT NULL AND lower(trim(name)) <> '')
SELECT category, false AS is_new FROM vocab
UNION ALL
SELECT category, true AS is_new FROM cand
WHERE category NOT IN (SELECT lower(category) FROM vocab)"""

# ------------------------------------------------------------------ forecast
MONTHLY = """
, hist AS (
  SELECT bank, CAST(date_trunc('month', "date") AS DATE) AS month, category, amount
  FROM ledger
  WHERE coalesce(category IN ('own transfer', 'transfer'), false) = false
    AND CAST("date" AS DATE) < DATE '2001-08-01'),
monthly AS (SELECT bank, month, category, coalesce(sum(amount), 0) AS net
            FROM hist GROUP BY bank, month, category),
lat AS (SELECT bank, max(month) AS latest FROM monthly GROUP BY bank),
win AS (SELECT m.bank, m.month, m.category, m.net FROM monthly m JOIN lat USING (bank)
        WHERE m.month >= lat.latest - INTERVAL 23 MONTH AND m.category IS NOT NULL)"""

SQL["monthly_by_category"] = with_ledger(MONTHLY + """
SELECT bank, month, category, CAST(net AS DOUBLE) AS net FROM win""")

SQL["forecast_next_month"] = with_ledger(MONTHLY + """
, sided AS (
  SELECT bank, category, month, CASE WHEN net > 0 THEN 'income' ELSE 'expenses' END AS side,
         CAST(abs(net) * 100 AS HUGEINT) AS y
  FROM win WHERE net <> 0),
idx AS (SELECT *, CAST(row_number() OVER (PARTITION BY bank, side, category ORDER BY month) - 1
                       AS HUGEINT) AS x FROM sided),
g AS (SELECT bank, side, category, count(*) AS n, CAST(count(*) AS HUGEINT) AS h,
             CAST(sum(y) AS HUGEINT) AS sy, CAST(sum(x * y) AS HUGEINT) AS sxy
      FROM idx GROUP BY bank, side, category HAVING count(*) >= 2),
pq AS (SELECT *,
         CASE WHEN n >= 4
              THEN (h * sxy - (h * (h - 1) // 2) * sy) * (h * (h + 1) // 2)
                   + sy * (h * h * (h * h - 1) // 12)
              ELSE sy END AS p,
         CASE WHEN n >= 4 THEN h * (h * h * (h * h - 1) // 12) ELSE h END AS q
       FROM g),
r AS (SELECT *, p // q AS d, 2 * (p - (p // q) * q) AS r2 FROM pq)
SELECT bank, side, category, n AS n_months,
       CAST(CASE WHEN p <= 0 THEN 0
                 ELSE d + CASE WHEN r2 > q OR (r2 = q AND d % 2 = 1) THEN 1 ELSE 0 END END
            AS DOUBLE) / 100.0 AS predicted,
       strftime(DATE '2001-08-01' + INTERVAL 1 MONTH, '%B %Y') AS forecast_month
FROM r""")

# ---------------------------------------------------------- workbook grids
# Round trip: the sheets are orders rendered as cells, so the parsed ledger is
# computed here straight from orders (what each layout should recover).
GRID_BASE = """
base AS (
  SELECT o_orderkey, o_orderpriority, c_mktsegment, c_name, year(o_orderdate) AS y,
         CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS "date",
         concat_ws(' ', c_mktsegment, o_orderpriority) AS concept0,
         CAST(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE -o_totalprice END
              AS DECIMAL(18,2)) AS amount,
         CAST(c_acctbal AS DECIMAL(18,2)) AS bal
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _dedup_sql(src: str) -> str:
    return f"""
SELECT "date", concept, CAST(amount AS DOUBLE) AS amount, CAST(balance AS DOUBLE) AS balance,
       bank, category, src_file, src_row
FROM (
  SELECT *, row_number() OVER (
      PARTITION BY bank, balance IS NOT NULL, amount,
                   CASE WHEN balance IS NOT NULL THEN balance END,
                   CASE WHEN balance IS NULL THEN "date" END,
                   CASE WHEN balance IS NULL THEN concept END
      ORDER BY "date", src_file, src_row) AS rn
  FROM (SELECT *, {rules_case(STANDIN_RULES, 'concept')} AS category FROM ({src})))
WHERE rn = 1"""


SQL["grid_yearly"] = "WITH " + GRID_BASE + _dedup_sql("""
  SELECT "date", concept0 AS concept, amount, bal AS balance, 'Bank1' AS bank,
         'Bank1/' || CAST(y AS VARCHAR) || '.xlsx' AS src_file,
         CAST(CASE WHEN y = 1998 THEN o_orderkey ELSE (y % 3) * 2 + 1 + o_orderkey END
              AS BIGINT) AS src_row
  FROM base""")

SQL["grid_wide"] = "WITH " + GRID_BASE + _dedup_sql("""
  SELECT "date",
         CASE WHEN o_orderpriority = '5-LOW' THEN c_name
              WHEN o_orderpriority = '2-HIGH' THEN concept0 || ' ' || c_name
              ELSE concept0 END AS concept,
         amount, CASE WHEN bal >= 0 THEN bal END AS balance, 'Bank2' AS bank,
         'Bank2/' || CAST(y AS VARCHAR) || '.xlsx' AS src_file,
         CAST(o_orderkey + 5 AS BIGINT) AS src_row
  FROM base""")

SQL["grid_old"] = "WITH " + GRID_BASE + _dedup_sql("""
  SELECT "date",
         CASE WHEN o_orderpriority <> '5-LOW' THEN concept0 ELSE c_mktsegment END AS concept,
         amount, bal AS balance, 'Bank2' AS bank,
         'Bank2old/' || CAST(y AS VARCHAR) || '.xls' AS src_file,
         CAST(o_orderkey + 3 AS BIGINT) AS src_row
  FROM base""")

# ------------------------------------------------------------- statements
# Round trip: statements are orders rendered as text (every month).
SQL["statement_parse"] = "WITH " + GRID_BASE + f"""
, stmt AS (
  SELECT "date", concept0 AS concept, amount, bal AS balance, 'BNCR' AS bank,
         'Bank' || CAST(o_custkey % 3 + 1 AS VARCHAR) || '/' || strftime("date", '%Y-%m') || '.pdf'
           AS src_file,
         CAST(100 + o_orderkey * 8 AS BIGINT) AS src_row
  FROM base JOIN orders USING (o_orderkey))
""" + _dedup_sql("SELECT * FROM stmt")

SQL["statement_previous_year"] = "WITH " + GRID_BASE + f"""
, stmt AS (
  SELECT "date", concept0 AS concept, amount, bal AS balance, 'BNCR' AS bank,
         'Bank' || CAST(o_custkey % 3 + 1 AS VARCHAR) || '/fiscal-'
           || CAST(year("date") + CASE WHEN month("date") >= 7 THEN 1 ELSE 0 END AS VARCHAR)
           || '.pdf' AS src_file,
         CAST(100 + o_orderkey * 8 AS BIGINT) AS src_row
  FROM base JOIN orders USING (o_orderkey))
""" + _dedup_sql("SELECT * FROM stmt")

SQL["grid_month_first"] = "WITH " + GRID_BASE + _dedup_sql("""
  SELECT "date", concept0 AS concept, amount, bal AS balance, 'Bank1' AS bank,
         'Bank1-' || CAST(y AS VARCHAR) || '/2020.xlsx' AS src_file,
         CAST(o_orderkey + 1 AS BIGINT) AS src_row
  FROM base""")

SQL["grid_one_column"] = SQL["grid_wide"]

SQL["sheet_head"] = """
WITH rows AS (
  SELECT 'Bank2old/' || CAST(year(o_orderdate) AS VARCHAR) || '.xls' AS path,
         CAST(o_orderkey + 3 AS BIGINT) AS row_no, strftime(o_orderdate, '%Y-%m-%d') AS c0,
         strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') AS c1, c_mktsegment AS c2,
         CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS c3
  FROM orders JOIN customer ON o_custkey = c_custkey),
files AS (SELECT DISTINCT path FROM rows)
SELECT * FROM rows WHERE row_no < 1000
UNION ALL SELECT path, CAST(0 AS BIGINT), 'Extracto', NULL, NULL, NULL FROM files
UNION ALL SELECT path, CAST(1 AS BIGINT), 'Periodo', NULL, NULL, NULL FROM files
UNION ALL SELECT path, CAST(2 AS BIGINT), NULL, NULL, NULL, NULL FROM files"""

SQL["movements_sorted"] = SQL["movements_view"]

SQL["statement_continuity"] = """
WITH mv AS (
  SELECT 'Bank' || CAST(o_custkey % 3 + 1 AS VARCHAR) AS bank,
         CAST(date_trunc('month', o_orderdate) AS DATE) AS m,
         CAST(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE -o_totalprice END
              AS DECIMAL(18,2)) AS amt
  FROM orders JOIN customer ON o_custkey = c_custkey),
monthly AS (SELECT bank, m, sum(amt) AS net FROM mv GROUP BY bank, m),
bal AS (SELECT bank, m,
               coalesce(sum(net) OVER (PARTITION BY bank ORDER BY m
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                 AS opening, net FROM monthly),
docs AS (SELECT bank, bank || '/' || strftime(m, '%Y-%m') || '.pdf' AS doc,
                CAST(m - INTERVAL 1 DAY AS DATE) AS last_stmt, last_day(m) AS this_stmt,
                opening + CASE WHEN month(m) = 6 THEN 25 ELSE 0 END AS opening,
                opening + net AS closing
         FROM bal),
pairs AS (
  SELECT doc AS after_file, lead(doc) OVER w AS before_file, this_stmt AS after_date,
         lead(last_stmt) OVER w AS before_date, CAST(closing AS DOUBLE) AS balance_after,
         CAST(lead(opening) OVER w AS DOUBLE) AS balance_before
  FROM docs WINDOW w AS (PARTITION BY bank ORDER BY doc))
SELECT *, balance_before - balance_after AS difference FROM pairs
WHERE before_file IS NOT NULL AND abs(balance_before - balance_after) > 0.01"""

# ------------------------------------------------------------ files, stream
def _card_ledger_sql(bank: str) -> str:
    body = _type_override_sql(STANDIN_RULES)
    body = body.replace("SELECT src_row, \"date\", concept, CAST(amount AS DOUBLE) AS amount,",
                        "SELECT src_row, \"date\", concept, amount,")
    return f"""
SELECT "date", concept, amount, CAST(NULL AS DECIMAL(18,2)) AS balance, {_lit(bank)} AS bank,
       category, 'orders.csv' AS src_file, src_row
FROM ({body}) WHERE "date" IS NOT NULL AND amount IS NOT NULL"""


def _dedup_given_category(src: str) -> str:
    return f"""
SELECT "date", concept, CAST(amount AS DOUBLE) AS amount, CAST(balance AS DOUBLE) AS balance,
       bank, category, src_file, src_row
FROM (
  SELECT *, row_number() OVER (
      PARTITION BY bank, balance IS NOT NULL, amount,
                   CASE WHEN balance IS NOT NULL THEN balance END,
                   CASE WHEN balance IS NULL THEN "date" END,
                   CASE WHEN balance IS NULL THEN concept END
      ORDER BY "date", src_file, src_row) AS rn
  FROM ({src}))
WHERE rn = 1"""


SQL["card_csv_files"] = f"""
SELECT "date", concept, amount, balance, bank, category
FROM ({_dedup_given_category(_card_ledger_sql('Bank3'))})"""

SQL["card_csv_multiline"] = f"""
SELECT "date", split_part(concept, ' ', 1) || chr(10) || '"' || split_part(concept, ' ', 2)
       || '", again' AS concept, amount, balance, bank, category
FROM ({_dedup_given_category(_card_ledger_sql('Bank3'))})"""

SQL["source_preference"] = """
SELECT 'yearly' AS slot, 1 AS priority, 'Bank1' AS source,
       CAST(count(DISTINCT year(o_orderdate)) AS BIGINT) AS n_files FROM orders
UNION ALL
SELECT 'multi', 0, 'Caixa', CAST(count(DISTINCT year(o_orderdate)) AS BIGINT) FROM orders
UNION ALL
SELECT 'card', 1, 'Bank3', CAST(count(DISTINCT 'orders.csv') AS BIGINT)
FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL
SELECT 'statements', 0, 'BNCR',
       CAST(count(DISTINCT CAST(o_custkey % 3 AS VARCHAR) || strftime(o_orderdate, '%Y-%m'))
            AS BIGINT)
FROM orders JOIN customer ON o_custkey = c_custkey"""

SQL["load_all"] = "\nUNION ALL\n".join([
    f"SELECT * FROM ({SQL['grid_yearly']})",
    f"SELECT * FROM ({SQL['grid_wide'].replace(chr(39) + 'Bank2' + chr(39) + ' AS bank', chr(39) + 'Caixa' + chr(39) + ' AS bank')})",
    f"SELECT * FROM ({_dedup_given_category(_card_ledger_sql('Bank3'))})",
    f"SELECT * FROM ({SQL['statement_parse']})",
])

SQL["json_sources"] = with_ledger(IDS + "\nSELECT tx_id, category FROM ov")

SQL["incremental_ingest"] = SQL["dedup"]

SQL["auto_classify_count"] = SQL["auto_classify"].replace(
    "SELECT tx_id, max(best.category) AS category FROM cand JOIN best USING (ck) GROUP BY tx_id",
    "SELECT count(DISTINCT tx_id) AS n FROM cand JOIN best USING (ck)")

SQL["eod_balance_static"] = with_ledger(f"""
SELECT bank, CAST("date" AS DATE) AS "date",
       CAST(arg_max(balance, row("date", src_file, src_row)) AS DOUBLE) AS balance
FROM ledger WHERE balance IS NOT NULL AND {NO_TRANSFERS}
GROUP BY bank, CAST("date" AS DATE)""")

SQL["overview_after_overrides"] = with_ledger(IDS + f"""
, applied AS (
  SELECT ids.bank, ids."date", ids.amount,
         CASE WHEN coalesce(ov.category, ids.category, 'other') = 'accommodation' THEN 'other'
              ELSE coalesce(ov.category, ids.category, 'other') END AS category
  FROM ids LEFT JOIN ov USING (tx_id))
SELECT category, CAST(year("date") AS VARCHAR) AS year, CAST(abs(sum(amount)) AS DOUBLE) AS amount
FROM applied
WHERE coalesce(category IN ('own transfer', 'transfer'), false) = false AND {BASE_ONLY}
  AND amount < 0
GROUP BY 1, 2""")

SQL["ledger_by_date"] = with_ledger("""
SELECT "date", concept, CAST(amount AS DOUBLE) AS amount, CAST(balance AS DOUBLE) AS balance,
       bank, category, src_file, src_row
FROM ledger ORDER BY "date", src_file, src_row""")

SQL["file_inventory"] = """
SELECT 'from-' || source AS folder, CAST(sum(strlen(coalesce(text, '')) + 1) AS DOUBLE) / 1024 AS size_kb
FROM documents GROUP BY source"""

SQL["json_documents"] = with_ledger(IDS + """
, names AS (SELECT ' ' || p_type AS name FROM part UNION ALL SELECT c_mktsegment FROM customer)
SELECT tx_id, category FROM ov
UNION ALL SELECT DISTINCT CAST(NULL AS VARCHAR) AS tx_id, lower(trim(name)) AS category FROM names""")

SQL["notebook_split"] = with_ledger("""
SELECT bank, CASE WHEN amount > 0 THEN 'income' ELSE 'expenses' END AS side,
       CAST(sum(amount) AS DOUBLE) AS total, count(*) AS n
FROM ledger WHERE amount IS NOT NULL GROUP BY 1, 2""")

SQL["text_lookup"] = with_ledger("""
SELECT bank, src_row, concept, CAST(amount AS DOUBLE) AS amount FROM ledger
WHERE contains(concept, 'MACHINERY 2-')""")

SQL["search_summary"] = SQL["movement_summary"].replace(
    "FROM ledger WHERE amount IS NOT NULL)",
    "FROM ledger WHERE amount IS NOT NULL AND contains(lower(concept), 'high')"
    " AND contains(lower(category), 'e'))")

SQL["bulk_count"] = with_ledger(IDS + "\nSELECT count(DISTINCT tx_id) AS n FROM bulk")

SQL["vocabulary_changed"] = f"""
WITH vocab AS (SELECT unnest([{VOCAB}]) AS category),
names AS (SELECT ' ' || p_type AS name FROM part UNION ALL SELECT c_mktsegment FROM customer),
added AS (SELECT count(*) AS n FROM names
          WHERE lower(trim(name)) <> '' AND lower(trim(name)) NOT IN
                (SELECT lower(category) FROM vocab))
SELECT 'once' AS merge, n > 0 AS changed FROM added
UNION ALL SELECT 'twice' AS merge, false AS changed"""

SQL["categorize_rule_table"] = """
WITH rules AS (
  SELECT c_custkey AS ordinal, lower(c_name) AS keyword,
         'group ' || CAST(c_custkey % 50 AS VARCHAR) AS category
  FROM customer WHERE c_custkey % 3 <> 0
  UNION ALL
  SELECT 1000000000 + min(c_custkey), lower(substring(c_mktsegment, 1, 3)), lower(c_mktsegment)
  FROM customer GROUP BY c_mktsegment),
texts AS (SELECT DISTINCT lower(c_mktsegment || ' ' || c_name) AS t, c_custkey FROM customer),
hits AS (SELECT c_custkey, min(ordinal) AS ordinal
         FROM texts JOIN rules ON contains(t, keyword) GROUP BY c_custkey)
SELECT CAST(o_orderkey AS BIGINT) AS src_row, coalesce(category, 'other') AS category
FROM orders JOIN customer ON o_custkey = c_custkey
LEFT JOIN hits USING (c_custkey) LEFT JOIN rules USING (ordinal)"""
