"""Linear interpolation per detector, as an ordered union with carried knots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scan


def interp1d_linear(knots: DataFrame, targets: DataFrame, size: int = scan.ROWS) -> DataFrame:
    """det, k, x, y of the targets (det, k, x) from knots (det, x, y); beyond the ends the end segments go on.

    Knots and targets are cut into the same blocks of x; a block's first targets
    take the last knot of an earlier block.
    """
    keys = ["det"]
    cut = scan.blocked(knots.select("det", F.col("x").cast("double").alias("x"), "y"), keys, "x", size)
    after = Window.partitionBy("det", "blk").orderBy("x")
    near = {"x1": F.lead("x"), "y1": F.lead("y"), "xp": F.lag("x"), "yp": F.lag("y")}
    seg = cut.select("*", *[f.over(after).alias(name) for name, f in near.items()])
    # across a block's edges: the last knot before it and the first one behind it
    edge = scan.carried(cut, keys, {"before": (F.max(F.struct("x", "y")), "last"), "behind": (F.min(F.struct("x", "y")), "first")})
    seg = scan.attached(seg, edge, ["det", "blk"])
    pick = lambda inner, outer, c: F.when(F.col(inner).isNull(), F.col(f"{outer}.{c}"))
    ends = [F.coalesce(c, pick("x1" if c in ("x1", "y1") else "xp", "behind" if c in ("x1", "y1") else "before", c[0])).alias(c) for c in ("xp", "yp", "x1", "y1")]
    seg = seg.select("det", "blk", "x", *ends, F.col("x").alias("x0"), F.col("y").alias("y0"))
    # the last knot stands for the last segment, so that targets behind it follow that
    seg = seg.select("det", "blk", "x", F.struct("xp", "yp", "x0", "y0", "x1", "y1").alias("seg"), F.lit(None).cast("long").alias("k"), F.lit(0).alias("q"))
    # the first knot comes before everything, so that targets in front of it follow the first segment
    seg = seg.withColumn("at", F.when(F.col("seg.xp").isNull(), F.lit(float("-inf"))).otherwise(F.col("x")))
    ask = targets.select("det", F.col("x").cast("double").alias("x"), F.lit(None).cast(seg.schema["seg"].dataType).alias("seg"), "k", F.lit(1).alias("q"))
    ask = scan.blocked(ask, keys, "x", size, of=knots).withColumn("at", F.col("x")).withColumn("blk", F.coalesce("blk", F.lit(0).cast("long")))
    both = seg.unionByName(ask)
    last = scan.carried(both, keys, {"earlier": (F.max_by("seg", F.when(F.col("q") == 0, F.col("x"))), "last")})
    order = Window.partitionBy("det", "blk").orderBy("at", "q").rowsBetween(Window.unboundedPreceding, 0)
    got = both.withColumn("here", F.last("seg", True).over(order)).where("q = 1")
    got = scan.attached(got, last, ["det", "blk"]).withColumn("here", F.coalesce("here", "earlier"))
    inside = F.col("here.x1").isNotNull()
    xa, ya = F.when(inside, F.col("here.x0")).otherwise(F.coalesce("here.xp", "here.x0")), F.when(inside, F.col("here.y0")).otherwise(F.coalesce("here.yp", "here.y0"))
    xb, yb = F.when(inside, F.col("here.x1")).otherwise(F.col("here.x0")), F.when(inside, F.col("here.y1")).otherwise(F.col("here.y0"))
    return got.select("det", "k", "x", F.when(xa == xb, ya).otherwise(ya + (yb - ya) * (F.col("x") - xa) / F.when(xa == xb, 1.0).otherwise(xb - xa)).alias("y"))
