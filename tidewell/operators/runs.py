"""Every row of one table with every row of a second one, where the result is meant to hold all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the second table that are sent to every executor at once.
BROADCAST_ROWS = 100_000


def each_with(left: DataFrame, right: DataFrame, key: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of left beside all of right, which is counted first and sent in runs of about `rows`, split by a hash of `key`.

    The left side is never shuffled; it is read once for each run.
    """
    runs = -(-right.count() // rows) or 1
    out = None
    for k in range(runs):
        part = right if runs == 1 else right.where(F.pmod(F.xxhash64(key), F.lit(runs)) == k)
        both = left.crossJoin(F.broadcast(part))
        out = both if out is None else out.unionByName(both)
    return out
