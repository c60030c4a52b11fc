"""Compressed time streams: quantising, calibration and slices over Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scan

#: Steps of the coarse branch that a sample is split into.
BRANCH = 1 << 24


def check(stream: DataFrame) -> DataFrame:
    """Whole numbers come without a quantum, floats with one; other types are a ValueError."""
    kinds = dict(stream.dtypes)
    if kinds.get("y") not in ("int", "bigint", "float", "double"):
        raise ValueError("Forbidden dtype.")
    if (kinds["y"] in ("float", "double")) != ("quantum" in kinds):
        raise ValueError("quantum goes with floats, and only with them")
    return stream


def quantise(stream: DataFrame, quantum: str = "quantum") -> DataFrame:
    """stream with q: y in whole quanta, halves away from zero."""
    return stream.withColumn("q", F.round(F.col("y") / F.col(quantum)).cast("long"))


def restore(stream: DataFrame, quantum: str = "quantum") -> DataFrame:
    return stream.withColumn("y", F.col("q") * F.col(quantum))


def calibrate(stream: DataFrame, factors: DataFrame) -> DataFrame:
    """y (and the quantum, if any) scaled by detector; a detector without a factor is a ValueError."""
    if not stream.select("det").distinct().join(factors, "det", "left_anti").isEmpty():
        raise ValueError("calibration factors do not cover all detectors")
    scaled = stream.join(factors.select("det", "k"), "det").withColumn("y", F.col("y") * F.col("k"))
    return (scaled.withColumn("quantum", F.col("quantum") * F.col("k")) if "quantum" in stream.columns else scaled).drop("k")


def extract(stream: DataFrame, start: int, stop: int, picks: DataFrame | None = None) -> DataFrame:
    """Samples [start, stop) of some channels, renumbered; picks(det, dest) names channels and their new numbers."""
    if start < 0 or stop < start:
        raise ValueError("sample bounds out of range")
    part = stream.where((F.col("samp") >= start) & (F.col("samp") < stop)).withColumn("samp", F.col("samp") - start)
    if picks is None:
        return part
    return part.join(picks, "det").drop("det").withColumnRenamed("dest", "det")


def split_branches(stream: DataFrame) -> DataFrame:
    """stream with base and rest: q = base + rest, base a multiple of BRANCH that moves when q strays half of it away.

    A base within half a BRANCH of q is the multiple nearest to q (the upper one
    in the middle), whatever stood before, so this is a matter of single samples.
    """
    base = F.shiftleft(F.shiftright(F.col("q").cast("long") + BRANCH // 2, BRANCH.bit_length() - 1), BRANCH.bit_length() - 1)
    return stream.select("det", "samp", base.alias("base"), (F.col("q") - base).cast("long").alias("rest"))


def branch_counts(stream: DataFrame, size: int = scan.ROWS) -> DataFrame:
    """det and branches: how many times the base is set, at the first sample and whenever it moves."""
    cut = scan.blocked(split_branches(stream), ["det"], "samp", size)
    order = Window.partitionBy("det", "blk").orderBy("samp")
    moves = cut.withColumn("moved", (F.lag("base").over(order) != F.col("base")).cast("long"))
    # a block may begin on another base than the one before it ended on
    blocks = moves.groupBy("det", "blk").agg(F.sum("moved").alias("inside"), F.min_by("base", "samp").alias("first"), F.max_by("base", "samp").alias("last"))
    along = Window.partitionBy("det").orderBy("blk")
    edge = F.when(F.lag("last").over(along) == F.col("first"), 0).otherwise(1)
    return blocks.withColumn("edge", edge).groupBy("det").agg((F.sum(F.coalesce("inside", F.lit(0))) + F.sum("edge")).alias("branches"))


def save(stream: DataFrame, path: str, codec: str = "zstd") -> None:
    """Writes by detector and sample, so that row groups can be skipped and deltas are small."""
    stream.repartitionByRange("det", "samp").sortWithinPartitions("det", "samp").write.option("compression", codec).option("parquet.writer.version", "v2").option("parquet.enable.dictionary", "false").parquet(path)


def load(spark: SparkSession, path: str, dets: list[int] | None = None, start: int | None = None, stop: int | None = None) -> DataFrame:
    """A saved stream; channels and sample bounds reach the scan, so only row groups that hold them are read."""
    stream = spark.read.parquet(path)
    if dets is not None:
        stream = stream.where(F.col("det").isin(dets))
    if start is not None:
        stream = stream.where(F.col("samp") >= start)
    return stream.where(F.col("samp") < stop) if stop is not None else stream
