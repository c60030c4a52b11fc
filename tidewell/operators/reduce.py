"""Per-detector reductions and flags as windows and aggregations.

Block operators partition by (det, block), so a long detector is spread over
many tasks.  Running sums within a block are windows of one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..model import by_samp
from . import ranges, scan


def block(size: int, shift: int = 0) -> Column:
    """Number of the block of a sample; -1 before the shift."""
    return F.when(F.col("samp") < shift, -1).otherwise(F.floor((F.col("samp") - shift) / size)).cast("int")


def _blocks(tod: DataFrame, size: int, shift: int) -> DataFrame:
    if size < 1 or shift < 0:
        raise ValueError("block size and shift must be positive")
    return tod.withColumn("blk", block(size, shift))


def block_moment(tod: DataFrame, size: int, moment: int = 1, central: bool = False, shift: int = 0) -> DataFrame:
    """tod with v: mean of the sample's block, or mean of (y - c)**moment, c the mean if central, else 0."""
    whole = Window.partitionBy("det", "blk")
    mean = F.avg("y").over(whole)
    out = _blocks(tod, size, shift)
    if moment == 1:
        return out.withColumn("v", mean)
    out = out.withColumn("c", mean if central else F.lit(0.0))
    power = F.lit(1.0)
    for _ in range(moment):
        power = power * (F.col("y") - F.col("c"))
    return out.withColumn("v", F.avg(power).over(whole)).drop("c")


def block_minmax(tod: DataFrame, size: int, mode: str = "ptp", shift: int = 0) -> DataFrame:
    """tod with v: min, max or their difference over the sample's block."""
    whole = Window.partitionBy("det", "blk")
    low, high = F.min("y").over(whole), F.max("y").over(whole)
    return _blocks(tod, size, shift).withColumn("v", {"min": low, "max": high}.get(mode, high - low))


def block_summary(tod: DataFrame, size: int, shift: int = 0) -> DataFrame:
    """One row a block: partial aggregation before the shuffle, for long detectors."""
    return _blocks(tod, size, shift).groupBy("det", "blk").agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.var_pop("y").alias("var"), F.min("y").alias("low"), F.max("y").alias("high"))


def clean_flag(flags: DataFrame, width: int, dets: DataFrame) -> DataFrame:
    """Ranges of a flag without runs shorter than width; a run at the end of the data stays."""
    return flags.join(dets, "det").where((F.col("e") - F.col("s") >= width) | (F.col("e") == F.col("n"))).select("det", "s", "e")


def _in_order(*keys: str) -> WindowSpec:
    """The whole of a block with its samples in order, so that a sum over it is rounded in one way, however rows arrive."""
    return Window.partitionBy(*keys).orderBy("samp").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def matched_filter(tod: DataFrame, size: int, shift: int = 0) -> DataFrame:
    """tod with m: running sum of y minus its block mean."""
    run = by_samp("blk")
    mean = _blocks(tod, size, shift).withColumn("v", F.avg("y").over(_in_order("det", "blk")))
    return mean.withColumn("m", F.sum(F.col("y") - F.col("v")).over(run))


def _over_threshold(tod: DataFrame, size: int, shift: Column, factor: float, uncertain: bool) -> Column:
    """Whether the filter exceeds `factor` of its response to the detector's smallest jump.

    For a unit step the running sum peaks at the step, by the samples of its block up to
    the step times those after it over their sum.
    """
    begin = size * F.floor((F.col("samp") - shift) / size) + shift
    length = F.least(F.lit(size), F.col("n") - begin).cast("double")
    left = (F.col("samp") + 1 - begin).cast("double")
    right = length - left
    # a filter may meet its threshold exactly, so the terms are taken in the written order
    least = factor * F.col("min_size") * left * right / (left + right)
    if uncertain:
        # the step may lie up to half a sample nearer to the end
        least = least * (1 - (F.abs(left - right) - 0.5) / F.when(right > 0, 2 * left * right))
    # too close to an end of the block (or before the first one) nothing can be told
    told = (F.col("samp") >= shift) & (F.least(left, right) + 0.5 >= size / 4.0)
    return told & (F.abs("m") > least)


def matched_jumps(tod: DataFrame, sizes: DataFrame, size: int) -> DataFrame:
    """Ranges where a step filter passes the detector's smallest jump (sizes: det, min_size), over two block grids.

    Both grids go through the same windows, and no sample is joined to another.
    """
    # one row a detector: its length and smallest jump
    dets = tod.groupBy("det").agg((F.max("samp") + 1).alias("n")).join(sizes.select("det", "min_size"), "det")
    grid = tod.select("det", "samp", "y").join(dets, "det").withColumn("shift", F.explode(F.array(F.lit(0), F.lit(size // 2))))
    grid = grid.withColumn("cell", F.when(F.col("samp") < F.col("shift"), -1).otherwise(F.floor((F.col("samp") - F.col("shift")) / size)))
    per = ["det", "shift", "cell"]
    grid = grid.withColumn("v", F.avg("y").over(_in_order(*per))).withColumn("m", F.sum(F.col("y") - F.col("v")).over(by_samp(*per[1:])))
    sure = _over_threshold(grid, size, F.col("shift"), 1.0, True)
    rough = grid.where(_over_threshold(grid, size, F.col("shift"), 0.5, False)).select("det", "shift", "samp", "n", sure.alias("sure"))
    # a step filter peaks at the jump, so only runs of rough flags that are long enough are looked at again
    least = max(1, size // 4)
    rows = max(scan.ROWS, least)
    # a block also sees the samples next to it, as many as tell whether a run is long enough
    near = [F.floor((F.col("samp") + d) / rows) for d in (1 - least, 0, least - 1)]
    cut = rough.withColumn("home", near[1]).withColumn("blk", F.explode(F.array_distinct(F.array(*near))))
    run = cut.withColumn("run", F.col("samp") - F.row_number().over(Window.partitionBy("det", "shift", "blk").orderBy("samp")))
    of_run = Window.partitionBy("det", "shift", "blk", "run")
    kept = run.withColumn("count", F.count("*").over(of_run)).withColumn("stop", F.max("samp").over(of_run) + 1)
    kept = kept.where(F.col("sure") & (F.col("blk") == F.col("home")) & ((F.col("count") >= least) | (F.col("stop") == F.col("n"))))
    return ranges.from_mask(kept.select("det", "samp").distinct(), ["det"], F.lit(True))


def quantized_jumps(tod: DataFrame, tolerance: DataFrame, window: int, scale: float) -> DataFrame:
    """tod with jump: the step over `window` samples if it is a multiple of scale within atol (tolerance: det, atol)."""
    order = by_samp()
    # up to and with sample `window` the step is taken from sample 0
    back = F.when(F.col("samp") > window, F.lag("y", window).over(order)).otherwise(F.first("y").over(order))
    ratio = (F.col("y") - back) / scale
    joined = tod.withColumn("ratio", ratio).join(tolerance, "det").withColumn("whole", F.round("ratio"))
    hit = (F.abs("ratio") >= 0.5) & (F.abs(F.col("ratio") - F.col("whole")) <= F.col("atol"))
    return joined.withColumn("jump", F.when(hit, F.col("whole") * scale).otherwise(0.0)).drop("ratio", "whole", "atol")


def subtract_jump_heights(tod: DataFrame, heights: DataFrame, jumps: DataFrame) -> DataFrame:
    """tod with z: y less the signed extreme height of every jump range begun so far (heights: det, samp, h)."""
    inside = jumps.select("det", "s", F.explode(F.sequence("s", F.col("e") - 1)).alias("samp")).join(heights, ["det", "samp"])
    ext = inside.groupBy("det", "s").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    step = ext.select("det", F.col("s").alias("samp"), F.when(F.abs("low") > F.abs("high"), F.col("low")).otherwise(F.col("high")).alias("step"))
    total = scan.running_sum(tod.join(step, ["det", "samp"], "left"), ["det"], "samp", F.col("step"), "total")
    return total.withColumn("z", F.col("y") - F.col("total")).drop("step", "total")


def detrend(tod: DataFrame, method: str = "median", count: int = -1) -> DataFrame:
    """tod with z: y without its mean, median or the line through the means of both ends.

    Linear: the ends are `count` samples each (-1: half; between 1 and half).
    """
    if method == "mean":
        center = tod.groupBy("det").agg(F.avg("y").alias("c"))
        return tod.join(center, "det").withColumn("z", F.col("y") - F.col("c")).drop("c")
    if method == "median":
        center = tod.groupBy("det").agg(F.median("y").alias("c"))
        return tod.join(center, "det").withColumn("z", F.col("y") - F.col("c")).drop("c")
    if method != "linear":
        raise ValueError(f"no such method: {method}")
    dets = tod.groupBy("det").agg((F.max("samp") + 1).alias("n"))
    half = F.floor(F.col("n") / 2)
    dets = dets.withColumn("k", F.greatest(F.lit(1), half if count < 0 else F.least(F.lit(count), half)))
    wide = tod.join(dets, "det")
    x = F.when(F.col("n") > 1, F.col("samp") / (F.col("n") - 1)).otherwise(0.0)
    ends = wide.groupBy("det").agg(
        (F.sum(F.when(F.col("samp") >= F.col("n") - F.col("k"), F.col("y"))) / F.max("k") - F.sum(F.when(F.col("samp") < F.col("k"), F.col("y"))) / F.max("k")).alias("slope"),
        F.avg("y").alias("mean_y"),
        F.avg(x).alias("mean_x"),
    )
    return wide.join(ends, "det").withColumn("z", F.col("y") - F.col("slope") * x - (F.col("mean_y") - F.col("slope") * F.col("mean_x"))).drop("n", "k", "slope", "mean_y", "mean_x")
