"""Values under cuts: measure, extract, insert, clear and translate.

A cut is a range (det, s, e).  Cut samples meet the data by equality on
(det, samp) after the ranges are spread, never by a range condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def n_poly(length: Column, resolution: int, most: int) -> Column:
    """Number of Legendre terms for a cut of some length."""
    terms = F.when(length <= 1, 1).when(length <= 3, 2).when(length <= 6, 3).when(length <= 20, 4).otherwise(5 + F.floor(length / resolution))
    return F.least(terms, F.lit(max(most, 1))).cast("int")


def measure(cuts: DataFrame, model: str = "full", resolution: int = 100, most: int = 20) -> DataFrame:
    """Values needed per detector: cut samples, or Legendre terms."""
    length = F.col("e") - F.col("s")
    return cuts.groupBy("det").agg(F.sum(length if model == "full" else n_poly(length, resolution, most)).alias("n"))


def spread(cuts: DataFrame) -> DataFrame:
    """det, s, samp, i (place in the cut), len."""
    at = cuts.where("s < e").select("det", "s", (F.col("e") - F.col("s")).alias("len"), F.explode(F.sequence("s", F.col("e") - 1)).alias("samp"))
    return at.withColumn("i", F.col("samp") - F.col("s"))


def extract_full(tod: DataFrame, cuts: DataFrame) -> DataFrame:
    """Cut samples with their place among the detector's values."""
    got = tod.join(spread(cuts).select("det", "samp"), ["det", "samp"])
    return got.withColumn("k", F.row_number().over(Window.partitionBy("det").orderBy("samp")) - 1)


def offsets(counts: DataFrame, width: int = 4096) -> DataFrame:
    """counts(det, n) with the detector-major start of each detector's values, as a two-level prefix sum."""
    block = counts.withColumn("g", F.floor(F.col("det") / width))
    sums = block.groupBy("g").agg(F.sum("n").alias("gn"))
    # one row for every `width` detectors goes through the unpartitioned window
    base = sums.withColumn("base", F.coalesce(F.sum("gn").over(Window.partitionBy(F.lit(0)).orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("det").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return block.join(base.select("g", "base"), "g").withColumn("start", own + F.col("base")).select("det", "n", "start")


def insert_full(tod: DataFrame, values: DataFrame) -> DataFrame:
    """tod with the values (det, samp, v) put in place of y."""
    return tod.join(values.select("det", "samp", "v"), ["det", "samp"], "left").withColumn("y", F.coalesce("v", "y")).drop("v")


def clear(tod: DataFrame, cuts: DataFrame) -> DataFrame:
    """tod with zeros under the cuts."""
    return insert_full(tod, spread(cuts).select("det", "samp", F.lit(0.0).alias("v")))


def legendre(x: Column, terms: int) -> list[Column]:
    """Values of the first Legendre polynomials."""
    out = [F.lit(1.0), x][:terms]
    for k in range(1, terms - 1):
        out.append(((2 * k + 1) * x * out[k] - k * out[k - 1]) / (k + 1))
    return out


def _terms(cuts: DataFrame, resolution: int, most: int) -> DataFrame:
    at = spread(cuts).withColumn("np", n_poly(F.col("len"), resolution, most))
    return at.withColumn("x", F.when(F.col("len") > 1, -1 + 2 * F.col("i") / (F.col("len") - 1)).otherwise(0.0))


def extract_poly(tod: DataFrame, cuts: DataFrame, resolution: int = 100, most: int = 5) -> DataFrame:
    """Projection of each cut's samples on its Legendre terms: det, s, p, c."""
    at = _terms(cuts, resolution, most).join(tod.select("det", "samp", "y"), ["det", "samp"])
    for k, p in enumerate(legendre(F.col("x"), max(most, 1))):
        at = at.withColumn(f"p{k}", p)
    sums = at.groupBy("det", "s").agg(F.max("np").alias("np"), *[F.sum(F.col("y") * F.col(f"p{k}")).alias(f"c{k}") for k in range(max(most, 1))])
    return sums.select("det", "s", "np", F.posexplode(F.array(*[f"c{k}" for k in range(max(most, 1))])).alias("p", "c")).where("p < np").select("det", "s", "p", "c")


def insert_poly(tod: DataFrame, cuts: DataFrame, coefficients: DataFrame, resolution: int = 100, most: int = 5) -> DataFrame:
    """tod with the sums of Legendre terms in place of y under the cuts (coefficients: det, s, p, c)."""
    wide = coefficients.groupBy("det", "s").agg(*[F.coalesce(F.max(F.when(F.col("p") == k, F.col("c"))), F.lit(0.0)).alias(f"c{k}") for k in range(max(most, 1))])
    at = _terms(cuts, resolution, most).join(wide, ["det", "s"])
    for k, p in enumerate(legendre(F.col("x"), max(most, 1))):
        at = at.withColumn(f"p{k}", p)
    total = sum((F.col(f"c{k}") * F.col(f"p{k}") for k in range(1, max(most, 1))), F.col("c0") * F.col("p0"))
    return insert_full(tod, at.select("det", "samp", total.alias("v")))


def translate_full(values: DataFrame, sizes: DataFrame) -> DataFrame:
    """Cut values at another rate; values: det, cut, i, v; sizes: det, cut, n_in, n_out.

    More samples repeat the nearest earlier value, fewer take means.
    """
    up = sizes.where("n_out >= n_in").select("det", "cut", F.explode(F.sequence(F.lit(0), F.col("n_out") - 1)).alias("o"), "n_in", "n_out")
    up = up.withColumn("i", F.floor(F.col("o") * F.col("n_in") / F.col("n_out"))).join(values, ["det", "cut", "i"]).select("det", "cut", "o", "v")
    down = values.join(sizes.where("n_out < n_in"), ["det", "cut"]).groupBy("det", "cut", F.floor(F.col("i") * F.col("n_out") / F.col("n_in")).alias("o")).agg(F.avg("v").alias("v"))
    return up.unionByName(down)


def translate_poly(coefficients: DataFrame, sizes: DataFrame) -> DataFrame:
    """Coefficients cut off or filled with zeros to np_out terms (sizes: det, s, np_out)."""
    every = sizes.where("np_out > 0").select("det", "s", F.explode(F.sequence(F.lit(0), F.col("np_out") - 1)).alias("p"))
    return every.join(coefficients, ["det", "s", "p"], "left").fillna(0.0, ["c"])
