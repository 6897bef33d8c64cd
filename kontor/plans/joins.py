"""Joins whose small side is broadcast only when its size is known.

Dimension-like inputs (rules, overrides, vocabularies, bank tables, learned
prefixes) are usually tiny, but nothing stops a user from passing millions of
rows.  Two ways to know the size:

* bounded by construction (a fixed rule list, a top-200 list, one row per
  block): ``known_small=True`` puts a broadcast hint on it;
* anything else: no hint.  Adaptive query execution measures the side once
  its stage has run and turns the join into a broadcast join only below
  ``spark.sql.adaptive.autoBroadcastJoinThreshold``; otherwise it stays a
  shuffle join, with AQE splitting skewed partitions.  This costs no extra
  job, unlike counting the side up front;
* a side that grows with the data (customers, rules, texts): ``join_grown``.  Its file may
  be smaller than the broadcast threshold while its rows are not: compressed columns
  become many times their bytes in the driver's hash table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner",
               known_small: bool = False) -> DataFrame:
    """``big.join(small, on, how)``; broadcast hint only if ``known_small``
    (size bounded by construction), else the runtime size decides (AQE)."""
    if known_small:
        small = F.broadcast(small)
    return big.join(small, on, how)


def join_grown(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """``left.join(right, on, how)`` without a broadcast, whatever the size estimate says."""
    return left.join(right.hint("merge"), on, how)
