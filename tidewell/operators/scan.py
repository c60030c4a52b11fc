"""Running values over long detectors in two levels: blocks in parallel, then a short scan over blocks.

A window over a whole detector is one task.  Here rows are cut into blocks of
about ``ROWS`` places of the order column; whatever runs along (a sum, a maximum,
the last value seen) is taken inside each block by a window of that block, added
up once a block, carried over the blocks of a key by a window over one row a
block, and joined back by key and block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of a block.
ROWS = 1 << 16
WHOLE = ("tinyint", "smallint", "int", "bigint")


def attached(rows: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """rows with the table's other columns; null keys meet null keys, and rows that meet none stay."""
    named = table.select(*[F.col(c).alias(f"{c} of table") if c in on else F.col(c) for c in table.columns])
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"{c} of table"))
    return rows.join(named, same, "left").drop(*[f"{c} of table" for c in on])


def blocked(rows: DataFrame, keys: list[str], x: str, size: int = ROWS, of: DataFrame | None = None) -> DataFrame:
    """rows with blk, a number that grows with x within a key.

    Whole numbers are cut at multiples of `size`.  Other values are cut evenly
    between the ends of their key in `of` (rows themselves, unless given), into
    as many blocks as its count asks for; values beyond the ends are in the end blocks.
    """
    if dict(rows.dtypes)[x] in WHOLE:
        return rows.withColumn("blk", F.floor(F.col(x) / size))
    wide = F.col(x).cast("double")
    told = (of if of is not None else rows).groupBy(*keys).agg(F.min(wide).alias("blk lo"), F.max(wide).alias("blk hi"), F.ceil(F.count(x) / size).alias("blk n"))
    span = F.col("blk hi") - F.col("blk lo")
    at = F.when((span > 0) & (span < float("inf")), F.floor((wide - F.col("blk lo")) / span * F.col("blk n"))).otherwise(F.lit(0))
    return attached(rows, told, keys).withColumn("blk", F.greatest(F.lit(0), F.least(at, F.col("blk n") - 1)).cast("long")).drop("blk lo", "blk hi", "blk n")


# looking ahead is looking back from the other end: a window that runs on to its end starts anew at every row
HOW = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, True), "first": lambda c: F.last(c, True)}


def carried(rows: DataFrame, keys: list[str], parts: dict[str, tuple[Column, str]]) -> DataFrame:
    """keys, blk and for each name what the blocks before add up to: parts names a block's own value and how values go together.

    `first` looks ahead instead, to the nearest later block that has a value.
    """
    totals = rows.groupBy(*keys, "blk").agg(*[c.alias(name) for name, (c, _) in parts.items()])
    back, ahead = (Window.partitionBy(*keys).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col("blk"), F.desc("blk")))
    return totals.select(*keys, "blk", *[HOW[how](F.col(name)).over(ahead if how == "first" else back).alias(name) for name, (_, how) in parts.items()])


def running_sum(rows: DataFrame, keys: list[str], order: str, value: Column, name: str, size: int = ROWS) -> DataFrame:
    """rows with the sum of `value` over all rows of the key up to this one (null counts as nothing, 0 before the first)."""
    cut = blocked(rows.withColumn("scan value", value), keys, order, size)
    inside = F.sum("scan value").over(Window.partitionBy(*keys, "blk").orderBy(order))
    both = attached(cut.withColumn("scan inside", inside), carried(cut, keys, {"scan before": (F.sum("scan value"), "sum")}), [*keys, "blk"])
    total = F.coalesce("scan before", F.lit(0.0)) + F.coalesce("scan inside", F.lit(0.0))
    return both.withColumn(name, total).drop("scan value", "scan inside", "scan before", "blk")
