"""Schemas and the canonical long form of time-ordered data: tod(det, samp, t, y).

``samp`` is dense from 0 for every detector.  ``dets(det, n)`` is the spine of
detectors with their sample counts; every range operator that can meet a
detector without ranges takes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TICKS_PER_SECOND = 100_000_000

TOD = T.StructType([T.StructField("det", T.LongType()), T.StructField("samp", T.IntegerType()), T.StructField("t", T.DoubleType()), T.StructField("y", T.DoubleType())])


def require(df: DataFrame, **kinds: str) -> DataFrame:
    """Checks columns and their types: a missing column or wrong type is a ValueError."""
    have = dict(df.dtypes)
    for name, kind in kinds.items():
        if name not in have:
            raise ValueError(f"column {name} is missing")
        if kind and have[name] not in kind.split("|"):
            raise ValueError(f"column {name} is {have[name]}, not {kind}")
    return df


def micros(ts: str = "ts") -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone is."""
    return F.expr(f"(datediff({ts}, date'1970-01-01') * 86400L + hour({ts}) * 3600 + minute({ts}) * 60) * 1000000L + cast(extract(second from {ts}) * 1000000 as bigint)")


def unix_seconds(ticks: Column) -> Column:
    """Seconds from ticks of 10 ns."""
    return ticks / F.lit(float(TICKS_PER_SECOND))


def ticks(seconds: Column) -> Column:
    """Ticks of 10 ns, cut towards zero."""
    return (seconds * F.lit(float(TICKS_PER_SECOND))).cast("long")


def by_samp(*more: str) -> "Window":
    return Window.partitionBy("det", *more).orderBy("samp")


def tod_from_events(events: DataFrame) -> DataFrame:
    """One detector a user; samples in time order, ties by event_id."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(F.col("user_id").alias("det"), (F.row_number().over(order) - 1).alias("samp"), (micros() / 1e6).alias("t"), F.col("value").alias("y"), "event_type", "event_id")


def tod_from_embeddings(embeddings: DataFrame) -> DataFrame:
    """One detector a vector; its components are the samples."""
    return embeddings.select(F.col("vec_id").alias("det"), F.posexplode("embedding").alias("samp", "y")).withColumn("y", F.col("y").cast("double"))


def spine(tod: DataFrame) -> DataFrame:
    """dets(det, n)."""
    return tod.groupBy("det").agg((F.max("samp") + 1).alias("n"))
