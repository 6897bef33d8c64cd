"""Column-expression helpers built only from ``pyspark.sql.functions``."""

from kontor.functions.money import money, money_out, parse_money, plain_money  # noqa: F401
from kontor.functions.text import (  # noqa: F401
    concept_key, iso_timestamp_text, js_number_text, py_float_text, strip,
)
from kontor.functions.dates import (  # noqa: F401
    day_of, month_of, parse_timestamp, year_of, year_text,
)
