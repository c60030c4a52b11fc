"""Maps as dense tiles: one row a tile, one array a component, pixels in order.

Long maps (tile, inner, components) hold only what was hit; dense ones hold
every pixel of the tiles that are active, so a tile is one contiguous read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def dense(sky_map: DataFrame, size: int, components: list[str]) -> DataFrame:
    """tile and an array of `size` values for each component, 0 where the map has no row (sky_map: tile, inner, components)."""

    def fill(key, table):
        at = table.column("inner").to_numpy()
        if len(at) and not (0 <= at.min() and at.max() < size):
            raise ValueError("a pixel outside its tile")
        arrays = []
        for c in components:
            plane = np.zeros(size)
            np.add.at(plane, at, table.column(c).to_numpy())
            arrays.append(pa.array([plane], pa.list_(pa.float64())))
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int64()), *arrays], ["tile", *components])

    # summed up before the tiles are gathered, so a tile has `size` rows at most
    rows = sky_map.groupBy(F.col("tile").cast("long").alias("tile"), F.col("inner").cast("long").alias("inner")).agg(*[F.sum(F.col(c).cast("double")).alias(c) for c in components])
    return rows.groupBy("tile").applyInArrow(fill, "tile long, " + ", ".join(f"{c} array<double>" for c in components))


def untile(tiles: DataFrame, components: list[str], size: int | None = None) -> DataFrame:
    """tile, inner (and pix, if the tile size is told) and components of every pixel of the tiles that are there."""
    rows = tiles.select("tile", F.posexplode(F.arrays_zip(*components)).alias("inner", "z"))
    out = rows.select("tile", F.col("inner").cast("long").alias("inner"), *[F.col(f"z.{c}").alias(c) for c in components])
    return out if size is None else out.withColumn("pix", F.col("tile") * size + F.col("inner"))


def compressed(tiles: DataFrame) -> DataFrame:
    """tiles with place, their number among the active ones (one row a tile goes through one window)."""
    return tiles.join(tiles.select("tile", (F.row_number().over(Window.orderBy("tile")) - 1).cast("long").alias("place")), "tile")


def decompressed(tiles: DataFrame, count: int, size: int, components: list[str]) -> DataFrame:
    """All `count` tiles; those that are not active are zeros."""
    every = tiles.sparkSession.range(count).select(F.col("id").alias("tile"))
    zeros = F.array_repeat(F.lit(0.0), size)
    return every.join(tiles, "tile", "left").select("tile", *[F.coalesce(c, zeros).alias(c) for c in components])


def save(tiles: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Writes by tile, so that a reader skips files and row groups by their tiles."""
    tiles.repartitionByRange("tile").sortWithinPartitions("tile").write.mode(mode).option("compression", "zstd").parquet(path)


def load(spark: SparkSession, path: str, tiles: list[int] | None = None) -> DataFrame:
    """Saved tiles; a list of tiles reaches the scan."""
    got = spark.read.parquet(path)
    return got if tiles is None else got.where(F.col("tile").isin([int(t) for t in tiles]))
