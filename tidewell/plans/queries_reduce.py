"""Queries over blocks, jumps and trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model
from ..operators import ranges, reduce
from .common import A, TOD, flag_ranges, merge_sql, out, rounded, runs_sql, tod
from .registry import query

K = ["det"]
BLK = "case when samp < {shift} then -1 else (samp - {shift}) // {size} end"


def _block_sql(value: str, size: int, shift: int, digits: int = 6) -> str:
    return f"with {TOD}, b as (select *, {BLK.format(size=size, shift=shift)} blk from tod), c as (select *, avg(y) over (partition by det, blk) c from b) select det, samp, round({value}, {digits}) + 0.0 v from c"


def _result(df, digits: int = 6):
    return out(df.select("det", "samp", rounded("v", digits).alias("v")))


@query(_block_sql("c", 8, 0))
def block_mean(spark, sf):
    return _result(reduce.block_moment(tod(spark, sf), 8))


@query(_block_sql("avg((y - c) * (y - c)) over (partition by det, blk)", 7, 3))
def block_var_central(spark, sf):
    return _result(reduce.block_moment(tod(spark, sf), 7, 2, True, 3))


@query(_block_sql("avg(y * y * y) over (partition by det, blk)", 10, 0, 3))
def block_moment3_raw(spark, sf):
    return _result(reduce.block_moment(tod(spark, sf), 10, 3), 3)


@query(_block_sql("max(y) over (partition by det, blk) - min(y) over (partition by det, blk)", 8, 3))
def block_ptp(spark, sf):
    return _result(reduce.block_minmax(tod(spark, sf), 8, "ptp", 3))


@query(_block_sql("min(y) over (partition by det, blk)", 8, 0))
def block_min(spark, sf):
    return _result(reduce.block_minmax(tod(spark, sf), 8, "min"))


@query(_block_sql("max(y) over (partition by det, blk)", 8, 5))
def block_max(spark, sf):
    return _result(reduce.block_minmax(tod(spark, sf), 8, "max", 5))


@query(f"with {TOD}, b as (select *, samp // 15 blk from tod) select det, blk::bigint blk, count(*)::bigint n, round(avg(y), 6) + 0.0 mean, round(var_pop(y), 10) + 0.0 var, min(y) low, max(y) high from b group by det, blk")
def block_summary(spark, sf):
    s = reduce.block_summary(tod(spark, sf), 15)
    return out(s.select("det", "blk", "n", rounded("mean").alias("mean"), rounded("var", 10).alias("var"), "low", "high"))


@query(f"with {TOD}, {A} select det, s::bigint s, e::bigint e from a join dets using (det) where e - s >= 2 or e = n")
def clean_flag(spark, sf):
    a, _, dets = flag_ranges(tod(spark, sf))
    return out(reduce.clean_flag(a, 2, dets), "det", "s", "e")


MFILT = "b{k} as (select *, {blk} blk from tod), m{k} as (select det, samp, sum(y - c) over (partition by det, blk order by samp) m from (select *, avg(y) over (partition by det, blk) c from b{k}))"


@query(f"with {TOD}, {MFILT.format(k=0, blk=BLK.format(size=12, shift=6))} select det, samp, round(m, 6) + 0.0 m from m0")
def matched_filter(spark, sf):
    return out(reduce.matched_filter(tod(spark, sf), 12, 6).select("det", "samp", rounded("m").alias("m")))


def _jump_sql(k: int, size: int, shift: int) -> str:
    nl = f"(((samp - {shift}) % {size}) + 1)::double"
    nr = f"(least(n - {shift}, {size} * (1 + (samp - {shift}) // {size})) - (samp - {shift}) - 1)::double"
    return f"""{MFILT.format(k=k, blk=BLK.format(size=size, shift=shift))},
t{k} as (select det, samp, n, abs(m) m, {nl} nl, {nr} nr, 15.0 + det % 3 sz from m{k} join dets using (det)),
u{k} as (select *, samp >= {shift} and nl + 0.5 >= {size / 4} and nr + 0.5 >= {size / 4} inner_ from t{k}),
{runs_sql(f"r{k}", "inner_ and m > 0.5 * sz * nl * nr / (nl + nr)", f"u{k}")},
q{k} as (select u.* from u{k} u join r{k} r on u.det = r.det and u.samp >= r.s and u.samp < r.e where r.e - r.s >= {size // 4} or r.e = u.n),
{runs_sql(f"f{k}", "inner_ and m > sz * nl * nr / (nl + nr) * (1 - (abs(nl - nr) - 0.5) / (2 * nl * nr))", f"q{k}")}"""


@query(f"with {TOD}, {_jump_sql(0, 12, 0)}, {_jump_sql(1, 12, 6)}, both_ as (select * from f0 union all select * from f1), {merge_sql('z', 'both_')} select det, s::bigint s, e::bigint e from z")
def matched_jumps(spark, sf):
    data = tod(spark, sf)
    sizes = model.spine(data).select("det", (15.0 + F.col("det") % 3).alias("min_size"))
    return out(reduce.matched_jumps(data, sizes, 12), "det", "s", "e")


@query(
    f"with {TOD}, r as (select det, samp, (y - case when samp > 5 then lag(y, 5) over (partition by det order by samp) else first_value(y) over (partition by det order by samp) end) / 10.0 q from tod) select det, samp, (case when abs(q) >= 0.5 and abs(q - round(q)) <= 0.2 then round(q) * 10.0 else 0 end) + 0.0 jump from r"
)
def quantized_jumps(spark, sf):
    data = tod(spark, sf)
    tolerance = model.spine(data).select("det", F.lit(0.2).alias("atol"))
    return out(reduce.quantized_jumps(data, tolerance, 5, 10.0).select("det", "samp", (F.col("jump") + 0.0).alias("jump")))


@query(
    f"with {TOD}, {runs_sql('j', 'y > 60')}, h as (select det, samp, y - 70 h from tod), x as (select j.det, j.s samp, case when abs(min(h)) > abs(max(h)) then min(h) else max(h) end step from j join h on h.det = j.det and h.samp >= j.s and h.samp < j.e group by 1, 2) select tod.det, tod.samp, round(y - coalesce(sum(step) over (partition by tod.det order by tod.samp), 0), 6) + 0.0 z from tod left join x using (det, samp)"
)
def subtract_jump_heights(spark, sf):
    data = tod(spark, sf)
    heights = data.select("det", "samp", (F.col("y") - 70).alias("h"))
    jumps = ranges.from_mask(data, K, F.col("y") > 60)
    return out(reduce.subtract_jump_heights(data, heights, jumps).select("det", "samp", rounded("z").alias("z")))


@query(f"with {TOD} select det, samp, round(y - avg(y) over (partition by det), 9) + 0.0 z from tod")
def detrend_mean(spark, sf):
    return out(reduce.detrend(tod(spark, sf), "mean").select("det", "samp", rounded("z", 9).alias("z")))


@query(f"with {TOD} select det, samp, round(y - median(y) over (partition by det), 6) + 0.0 z from tod")
def detrend_median(spark, sf):
    return out(reduce.detrend(tod(spark, sf), "median").select("det", "samp", rounded("z").alias("z")))


@query(
    f"with {TOD}, w as (select *, greatest(1, least(10, n // 2)) k, samp / (n - 1)::double x from tod join dets using (det)), s as (select det, (sum(y) filter (samp >= n - k) - sum(y) filter (samp < k)) / max(k) slope from w group by det), d as (select w.det, samp, y - slope * x v from w join s using (det)) select det, samp, round(v - avg(v) over (partition by det), 9) + 0.0 z from d"
)
def detrend_linear(spark, sf):
    return out(reduce.detrend(tod(spark, sf), "linear", 10).select("det", "samp", rounded("z", 9).alias("z")))
