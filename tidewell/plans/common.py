"""Inputs of the registered queries, in Spark and as SQL preludes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..operators import ranges
from .registry import table

TOD = """tod as (select user_id det, (row_number() over (partition by user_id order by ts, event_id) - 1)::bigint samp,
  epoch_us(ts) / 1e6 t, value y, event_type, event_id from events),
dets as (select det, (max(samp) + 1)::bigint n from tod group by det)"""


def runs_sql(name: str, condition: str, source: str = "tod", keys: str = "det") -> str:
    """Runs of samples where a condition holds, as a common table expression."""
    return f"""{name} as (select {keys}, min(samp) s, max(samp) + 1 e from (
  select {keys}, samp, samp - row_number() over (partition by {keys} order by samp) g from {source} where {condition}) group by {keys}, g)"""


def merge_sql(name: str, source: str, keys: str = "det", gap: str = "0") -> str:
    """Sorted, disjoint ranges of a table (keys, s, e), as a common table expression."""
    return f"""{name} as (select {keys}, min(s) s, max(e) e from (
  select *, sum(case when pe is null or s > pe + {gap} then 1 else 0 end) over (partition by {keys} order by s, e range unbounded preceding) isl from (
    select *, max(e) over (partition by {keys} order by s, e rows between unbounded preceding and 1 preceding) pe from {source} where s < e)) group by {keys}, isl)"""


A_IF, B_IF = "y > 60", "event_type in ('error', 'click')"
A, B = runs_sql("a", A_IF), runs_sql("b", B_IF)


def tod(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.tod_from_events(table(spark, sf_dir, "events"))


def flag_ranges(data: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ranges of two flags and the spine of detectors."""
    keys = ["det"]
    return ranges.from_mask(data, keys, F.expr(A_IF)), ranges.from_mask(data, keys, F.expr(B_IF)), model.spine(data)


def out(df: DataFrame, *columns: str) -> DataFrame:
    """Chosen columns, whole numbers as long."""
    picked = df.select(*columns) if columns else df
    return picked.select(*[F.col(c).cast("long").alias(c) if k in ("int", "smallint", "tinyint", "boolean") else F.col(c) for c, k in picked.dtypes])


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded, with no negative zero."""
    return F.round(c, digits) + F.lit(0.0)
