"""kontor — bank-ledger analytics as Spark DataFrame operators.

Sub-packages:

* ``sources``   — readers that turn exports (card CSVs, workbook cell grids,
  statement text lines, JSON lists/maps, file listings) into the ledger shape.
* ``operators`` — categorisation, overrides, identity/dedup, filters, reports,
  balances and the forecast; each is a function ``DataFrame -> DataFrame``.
* ``functions`` — column-expression helpers (money, dates, number text).
* ``plans``     — physical-plan helpers: size-checked broadcast joins,
  the distributed running total, checkpoint location.
* ``streaming`` — incremental ingest with Structured Streaming.
"""

from kontor.schema import LEDGER_COLUMNS, MONEY  # noqa: F401
from kontor.session import get_spark  # noqa: F401
