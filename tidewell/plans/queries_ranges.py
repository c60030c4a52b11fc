"""Queries over sample ranges and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model
from ..operators import ranges
from .common import A, B, B_IF, TOD, flag_ranges, merge_sql, out, runs_sql, tod
from .registry import query, table

K = ["det"]


@query(f"with {TOD}, {A} select det, s::bigint s, e::bigint e from a")
def ranges_from_mask(spark, sf):
    return out(flag_ranges(tod(spark, sf))[0], "det", "s", "e")


@query(f"with {TOD} select det, samp, (y > 60)::bigint flag from tod")
def ranges_mask_roundtrip(spark, sf):
    a, _, dets = flag_ranges(tod(spark, sf))
    return out(ranges.to_mask(a, dets, K), "det", "samp", "flag")


@query(f"with {TOD}, {A}, {B}, u as (select * from a union all select * from b), {merge_sql('m', 'u')} select det, s::bigint s, e::bigint e from m")
def ranges_merge(spark, sf):
    a, b, _ = flag_ranges(tod(spark, sf))
    return out(ranges.union(a, b, K), "det", "s", "e")


@query(f"with {TOD}, {A}, {B} select a.det, greatest(a.s, b.s)::bigint s, least(a.e, b.e)::bigint e from a join b on a.det = b.det and a.s < b.e and b.s < a.e")
def ranges_intersect(spark, sf):
    a, b, _ = flag_ranges(tod(spark, sf))
    return out(ranges.intersection(a, b, K), "det", "s", "e")


@query(f"with {TOD}, {runs_sql('c', 'not (y > 60)')} select det, s::bigint s, e::bigint e from c")
def ranges_complement(spark, sf):
    a, _, dets = flag_ranges(tod(spark, sf))
    return out(ranges.complement(a, dets, K), "det", "s", "e")


@query(f"with {TOD}, {runs_sql('c', f'y > 60 and not ({B_IF})')} select det, s::bigint s, e::bigint e from c")
def ranges_difference(spark, sf):
    a, b, _ = flag_ranges(tod(spark, sf))
    return out(ranges.difference(a, b, K), "det", "s", "e")


@query(f"with {TOD}, {runs_sql('c', f'y > 60 or not ({B_IF})')} select det, s::bigint s, e::bigint e from c")
def ranges_minus_compat(spark, sf):
    a, b, dets = flag_ranges(tod(spark, sf))
    return out(ranges.minus_compat(a, b, dets, K), "det", "s", "e")


@query(f"with {TOD}, {A}, w as (select det, greatest(s - 2, 0) s, least(e + 2, n) e from a join dets using (det)), {merge_sql('m', 'w')} select det, s::bigint s, e::bigint e from m")
def ranges_buffer(spark, sf):
    a, _, dets = flag_ranges(tod(spark, sf))
    return out(ranges.buffered(a, dets, K, 2), "det", "s", "e")


@query(
    f"with {TOD}, {A}, {merge_sql('m', 'a', gap='3')} select det, (case when s <= 3 then 0 else s end)::bigint s, (case when n - e <= 3 then n else e end)::bigint e from m join dets using (det)"
)
def ranges_close_gaps(spark, sf):
    a, _, dets = flag_ranges(tod(spark, sf))
    return out(ranges.close_gaps(a, dets, K, 3), "det", "s", "e")


@query(f"with {TOD}, p as (select det, samp - 5 samp, y from tod join dets using (det) where samp >= 5 and samp < n - 10), {runs_sql('c', 'y > 60', 'p')} select det, s::bigint s, e::bigint e from c")
def ranges_slice(spark, sf):
    a, _, dets = flag_ranges(tod(spark, sf))
    return out(ranges.sliced(a, dets, K, 5, -10)[0], "det", "s", "e")


@query(f"with {TOD}, {A} select det, coalesce(sum(e - s), 0)::bigint samples, count(s)::bigint intervals from dets left join a using (det) group by det")
def ranges_stats(spark, sf):
    a, _, dets = flag_ranges(tod(spark, sf))
    return out(ranges.stats(a, dets, K), "det", "samples", "intervals")


@query(f"with {TOD}, {A}, {B}, u as (select * from a union all select b.det, s + n, e + n from b join dets using (det)), {merge_sql('m', 'u')} select det, s::bigint s, e::bigint e from m")
def ranges_concat(spark, sf):
    a, b, dets = flag_ranges(tod(spark, sf))
    return out(ranges.concatenated([(a, dets), (b, dets)], K)[0], "det", "s", "e")


@query(f"with {TOD} select det, samp, ((case when y > 60 then 1 else 0 end) + (case when {B_IF} then 4096 else 0 end))::bigint mask from tod")
def ranges_bitmask(spark, sf):
    a, b, dets = flag_ranges(tod(spark, sf))
    both = a.withColumn("bit", F.lit(0)).unionByName(b.withColumn("bit", F.lit(12)))
    return out(ranges.to_bitmask(both, dets, K, 13), "det", "samp", "mask")


@query(
    "with "
    + TOD
    + ", bits as (select det, samp, bit from (select det, samp, (floor(y)::bigint % 16) mask from tod), (select unnest(range(4)) bit) where (mask >> bit) & 1 = 1), "
    + runs_sql("c", "true", "bits", "det, bit")
    + " select det, bit::bigint bit, s::bigint s, e::bigint e from c"
)
def ranges_from_bitmask(spark, sf):
    masks = tod(spark, sf).select("det", "samp", F.pmod(F.floor("y").cast("long"), F.lit(16)).alias("mask"))
    return out(ranges.from_bitmask(masks, K, 4), "det", "bit", "s", "e")


@query(f"with {TOD}, {A} select (det // 2)::bigint new, s::bigint s, e::bigint e from a where det % 2 = 0")
def ranges_select(spark, sf):
    data = tod(spark, sf)
    a, _, dets = flag_ranges(data)
    picks = dets.where("det % 2 = 0").select("det", F.expr("det div 2").alias("new"))
    return out(ranges.selected(a, picks, "det").withColumnRenamed("det", "new"), "new", "s", "e")


@query(f"with {TOD}, {A}, {B}, k as (select unnest([0, 1]) k), x as (select det, k, samp, case when k = 0 then y > 60 else {B_IF} end f, y > 40 g from tod, k), {runs_sql('c', 'f and g', 'x', 'det, k')} select det, k::bigint k, s::bigint s, e::bigint e from c")
def ranges_matrix_broadcast(spark, sf):
    data = tod(spark, sf)
    a, b, _ = flag_ranges(data)
    grid = a.withColumn("k", F.lit(0)).unionByName(b.withColumn("k", F.lit(1)))
    row = ranges.from_mask(data, K, F.col("y") > 40)
    return out(ranges.broadcast_op(grid, row, ["det", "k"], K, lambda x, y: x & y), "det", "k", "s", "e")


# ---- intervals on a time domain: shipments of a supplier, in days ----

SHIP = """ship as (select l_suppkey k, epoch(l_shipdate)::bigint // 86400 s, epoch(l_shipdate)::bigint // 86400 + 1 + l_linenumber e from lineitem where l_quantity > 45),
dom as (select k, min(s) + 30 lo, max(e) - 30 hi from ship group by k),
cut as (select k, greatest(s, lo) s, least(e, hi) e from ship join dom using (k))"""
ODD = "odd as (select k, greatest(s, lo) s, least(e, hi) e from (select l_suppkey k, epoch(l_shipdate)::bigint // 86400 s, epoch(l_shipdate)::bigint // 86400 + 5 e from lineitem where l_discount > 0.08) join dom using (k))"
REST = """gaps as (select k, coalesce(lag(e) over (partition by k order by s), lo) s, s e from {m} join dom using (k)
  union all select k, max(e), max(hi) from {m} join dom using (k) group by k
  union all select k, lo, hi from dom where k not in (select k from {m}))"""


def _ship(spark, sf):
    day = F.expr("datediff(l_shipdate, date'1970-01-01')").cast("long")
    items = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), day.alias("s"), "l_linenumber", "l_quantity", "l_discount")
    a = items.where("l_quantity > 45").select("k", "s", (F.col("s") + 1 + F.col("l_linenumber")).alias("e"))
    dom = a.groupBy("k").agg((F.min("s") + 30).alias("lo"), (F.max("e") - 30).alias("hi"))
    b = items.where("l_discount > 0.08").select("k", "s", (F.col("s") + 5).alias("e"))
    return a, b, dom


@query(f"with {SHIP}, {merge_sql('m', 'cut', 'k')} select k, s, e from m")
def intervals_cleanup(spark, sf):
    a, _, dom = _ship(spark, sf)
    return ranges.cleanup(a, dom, ["k"], "lo", "hi")


@query(f"with {SHIP}, {ODD}, u as (select * from cut union all select * from odd), {merge_sql('m', 'u', 'k')} select k, s, e from m")
def intervals_union(spark, sf):
    a, b, dom = _ship(spark, sf)
    return ranges.add(a, b, dom, ["k"], "lo", "hi")


@query(
    f"with {SHIP}, {ODD}, {merge_sql('m', 'cut', 'k')}, {merge_sql('o', 'odd', 'k')}, x as (select m.k, greatest(m.s, o.s) s, least(m.e, o.e) e from m join o on m.k = o.k and m.s < o.e and o.s < m.e), {merge_sql('r', 'x', 'k')} select k, s, e from r"
)
def intervals_intersect(spark, sf):
    a, b, dom = _ship(spark, sf)
    return ranges.intersection(ranges.cleanup(a, dom, ["k"], "lo", "hi"), ranges.cleanup(b, dom, ["k"], "lo", "hi"), ["k"])


@query(f"with {SHIP}, {merge_sql('m', 'cut', 'k')}, {REST.format(m='m')} select k, s, e from gaps where s < e")
def intervals_complement(spark, sf):
    a, _, dom = _ship(spark, sf)
    return ranges.complement(a, dom, ["k"], "lo", "hi")


@query(f"with {SHIP}, {ODD}, {merge_sql('o', 'odd', 'k')}, {REST.format(m='o')}, u as (select * from cut union all select * from gaps where s < e), {merge_sql('m', 'u', 'k')} select k, s, e from m")
def intervals_minus_compat(spark, sf):
    a, b, dom = _ship(spark, sf)
    return ranges.minus_compat(ranges.cleanup(a, dom, ["k"], "lo", "hi"), b, dom, ["k"], "lo", "hi")


@query(
    f"with {SHIP}, d2 as (select l_suppkey k, min(epoch(l_shipdate)::bigint // 86400) lo2, max(epoch(l_shipdate)::bigint // 86400) - 400 hi2 from lineitem group by 1) select k, greatest(lo, lo2) lo, greatest(greatest(lo, lo2), least(hi, hi2)) hi from dom join d2 using (k)"
)
def intervals_domain(spark, sf):
    _, _, dom = _ship(spark, sf)
    day = F.expr("datediff(l_shipdate, date'1970-01-01')").cast("long")
    other = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.min(day).alias("lo"), (F.max(day) - 400).alias("hi"))
    return ranges.meet_domains(dom, other, ["k"])


@query(f"with {SHIP}, sl as (select k, greatest(s, lo + 100) s, least(e, lo + 300) e from cut join dom using (k)), {merge_sql('m', 'sl', 'k')} select k, s, e from m")
def intervals_slice(spark, sf):
    a, _, dom = _ship(spark, sf)
    sub = dom.select("k", F.greatest("lo", F.col("lo") + 100).alias("lo"), F.least("hi", F.col("lo") + 300).alias("hi"))
    return ranges.cleanup(a, sub, ["k"], "lo", "hi")
