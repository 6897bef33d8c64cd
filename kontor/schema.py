"""The ledger table: one row per account movement, whatever the source layout."""

from __future__ import annotations

from pyspark.sql import types as T

# Money is exact inside the engine: sums do not depend on partitioning and the
# same query gives the same cents on 1 or 1000 executors.  Outputs are doubles.
# Ten decimals and 28 digits before them hold what exchange and non-euro exports give.
MONEY = T.DecimalType(38, 10)

LEDGER_SCHEMA = T.StructType([
    T.StructField("date", T.TimestampNTZType(), True),
    T.StructField("concept", T.StringType(), True),
    T.StructField("amount", MONEY, True),
    T.StructField("balance", MONEY, True),
    T.StructField("bank", T.StringType(), True),
    T.StructField("category", T.StringType(), True),
    # lineage: which export and which row of it; makes "first"/"last" total orders
    T.StructField("src_file", T.StringType(), True),
    T.StructField("src_row", T.LongType(), True),
])

LEDGER_COLUMNS = [f.name for f in LEDGER_SCHEMA.fields]

# The total order used wherever the reference says "first" or "last" after a
# sort by date (pandas leaves ties undefined; we break them by source position).
ROW_ORDER = ["date", "src_file", "src_row"]

# raw workbook cells: one row per sheet row, cells as strings (see sources.grids)
RAW_CELLS_SCHEMA = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("row_no", T.LongType(), False),
    T.StructField("cells", T.ArrayType(T.StringType(), True), True),
])

# statement text: one row per non-blank, trimmed text line (see sources.statements)
STMT_LINES_SCHEMA = T.StructType([
    T.StructField("doc", T.StringType(), False),
    T.StructField("line_no", T.LongType(), False),
    T.StructField("line", T.StringType(), True),
])

OVERRIDES_SCHEMA = T.StructType([
    T.StructField("tx_id", T.StringType(), False),
    T.StructField("category", T.StringType(), True),
])

OVERRIDE_LOG_SCHEMA = T.StructType([
    T.StructField("version", T.LongType(), False),
    T.StructField("tx_id", T.StringType(), False),
    T.StructField("category", T.StringType(), True),
    T.StructField("deleted", T.BooleanType(), False),
])
