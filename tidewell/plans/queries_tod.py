"""Queries over cuts, gaps, interpolation, noise, filters and storage."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model
from ..operators import cuts, gapfill, iir, interp, noise, ranges, storage
from .common import A, TOD, out, rounded, runs_sql, tod
from .registry import query, table

K = ["det"]
GAP_IF = "event_type = 'signup'"
GAPS = runs_sql("g", GAP_IF)


def _gaps(data):
    return ranges.from_mask(data, K, F.expr(GAP_IF))


def _above(data):
    return ranges.from_mask(data, K, F.col("y") > 60)


NPOLY = "least(case when len <= 1 then 1 when len <= 3 then 2 when len <= 6 then 3 when len <= 20 then 4 else 5 + len // 100 end, 5)"


@query(f"with {TOD}, {A} select det, sum(e - s)::bigint n from a group by det")
def cuts_measure(spark, sf):
    return out(cuts.measure(_above(tod(spark, sf))))


@query(f"with {TOD}, {A}, l as (select det, e - s len from a) select det, sum({NPOLY})::bigint n from l group by det")
def cuts_measure_poly(spark, sf):
    return out(cuts.measure(_above(tod(spark, sf)), "poly", 100, 5))


@query(f"with {TOD} select det, samp, (row_number() over (partition by det order by samp) - 1)::bigint k, y from tod where y > 60")
def cuts_extract_full(spark, sf):
    data = tod(spark, sf)
    return out(cuts.extract_full(data, _above(data)), "det", "samp", "k", "y")


@query(f"with {TOD} select det, count(*)::bigint n, (sum(count(*)) over (order by det) - count(*))::bigint start from tod where y > 60 group by det")
def cuts_offsets(spark, sf):
    return out(cuts.offsets(cuts.measure(_above(tod(spark, sf)))), "det", "n", "start")


@query(f"with {TOD} select det, samp, case when y > 60 then -y else y end y from tod")
def cuts_insert_full(spark, sf):
    data = tod(spark, sf)
    values = cuts.extract_full(data, _above(data)).select("det", "samp", (-F.col("y")).alias("v"))
    return out(cuts.insert_full(data, values), "det", "samp", "y")


@query(f"with {TOD} select det, samp, case when y > 60 then 0 else y end y from tod")
def cuts_clear(spark, sf):
    data = tod(spark, sf)
    return out(cuts.clear(data, _above(data)), "det", "samp", "y")


PROJ = f"""{A}, w as (select a.det, a.s, a.e - a.s len, t.samp, t.y, case when a.e - a.s > 1 then -1 + 2 * (t.samp - a.s) / (a.e - a.s - 1)::double else 0 end x from a join tod t on t.det = a.det and t.samp >= a.s and t.samp < a.e),
v as (select *, {NPOLY} np from w),
l as (select *, unnest([0, 1, 2, 3, 4]) p, unnest([1.0, x, (3*x*x-1)/2, (5*x*x*x-3*x)/2, (35*x*x*x*x-30*x*x+3)/8]) f from v)"""


@query(f"with {TOD}, {PROJ} select det, s::bigint s, p::bigint p, round(sum(y * f), 7) + 0.0 c from l where p < np group by det, s, p")
def cuts_extract_poly(spark, sf):
    data = tod(spark, sf)
    c = cuts.extract_poly(data, _above(data), 100, 5)
    return out(c.select("det", "s", "p", rounded("c", 7).alias("c")))


@query(
    f"with {TOD}, {PROJ}, c as (select det, s, p, sum(y * f) c from l where p < np group by det, s, p), z as (select l.det, l.samp, sum(c.c * l.f) v from l join c on l.det = c.det and l.s = c.s and l.p = c.p group by 1, 2) select tod.det, tod.samp, round(coalesce(v, y), 6) + 0.0 y from tod left join z using (det, samp)"
)
def cuts_insert_poly(spark, sf):
    data = tod(spark, sf)
    cut = _above(data)
    filled = cuts.insert_poly(data, cut, cuts.extract_poly(data, cut, 100, 5), 100, 5)
    return out(filled.select("det", "samp", rounded("y").alias("y")))


def _translate_sql(n_out: str) -> str:
    return f"""with {TOD}, {A}, v as (select a.det, a.s cut, t.samp - a.s i, t.y v, a.e - a.s n_in, {n_out} n_out from a join tod t on t.det = a.det and t.samp >= a.s and t.samp < a.e),
up as (select det, cut, n_in, n_out, unnest(range(n_out::bigint)) o from (select distinct det, cut, n_in, n_out from v where n_out >= n_in))
select det, cut::bigint cut, o::bigint o, round(v, 7) + 0.0 v from (
  select up.det, up.cut, up.o, v.v from up join v on v.det = up.det and v.cut = up.cut and v.i = up.o * up.n_in // up.n_out
  union all select det, cut, i * n_out // n_in, avg(v) from v where n_out < n_in group by all)"""


@query(_translate_sql("case when a.det % 2 = 0 then 2 * (a.e - a.s) else greatest(1, (a.e - a.s) // 2) end"))
def cuts_translate_full(spark, sf):
    data = tod(spark, sf)
    a = _above(data)
    values = cuts.spread(a).join(data, ["det", "samp"]).select("det", F.col("s").alias("cut"), "i", F.col("y").alias("v"))
    size = F.col("e") - F.col("s")
    sizes = a.select("det", F.col("s").alias("cut"), size.alias("n_in"), F.when(F.col("det") % 2 == 0, 2 * size).otherwise(F.greatest(F.lit(1), F.floor(size / 2))).alias("n_out"))
    t = cuts.translate_full(values, sizes)
    return out(t.select("det", "cut", "o", rounded("v", 7).alias("v")))


@query(f"with {TOD}, {PROJ}, c as (select det, s, p, sum(y * f) c from l where p < np group by det, s, p), x as (select det, s, unnest(range(3)) p from a) select x.det, x.s::bigint s, x.p::bigint p, round(coalesce(c, 0), 7) + 0.0 c from x left join c using (det, s, p)")
def cuts_translate_poly(spark, sf):
    data = tod(spark, sf)
    a = _above(data)
    t = cuts.translate_poly(cuts.extract_poly(data, a, 100, 5), a.select("det", "s", F.lit(3).alias("np_out")))
    return out(t.select("det", "s", "p", rounded("c", 7).alias("c")))


CONTEXT = f"""{GAPS}, near_ as (select g.det, g.s, g.e, t.samp, t.y, (t.samp - g.s)::double x from g join tod t on t.det = g.det and t.samp >= g.s - 8 and t.samp < g.e + 8 where not ({GAP_IF}))"""


@query(
    f"with {TOD}, {CONTEXT}, f as (select det, s, count(*) cnt, regr_slope(y, x) a, regr_intercept(y, x) b, avg(y) mean from near_ group by det, s) select t.det, t.samp, round(coalesce(case when cnt < 10 then mean else a * (t.samp - g.s) + b end, 0), 6) + 0.0 v from g join tod t on t.det = g.det and t.samp >= g.s and t.samp < g.e left join f on f.det = g.det and f.s = g.s"
)
def gap_fill_linear(spark, sf):
    data = tod(spark, sf)
    return out(gapfill.fill_linear(data, _gaps(data), 8).select("det", "samp", rounded("v").alias("v")))


@query(
    f"""with {TOD}, {CONTEXT},
m as (select det, s, count(*) n, sum(x) s1, sum(x*x) s2, sum(x*x*x) s3, sum(x*x*x*x) s4, sum(y) t0, sum(x*y) t1, sum(x*x*y) t2 from near_ group by det, s),
d as (select *, n*(s2*s4-s3*s3) - s1*(s1*s4-s2*s3) + s2*(s1*s3-s2*s2) q from m),
c as (select det, s, n, case when n < 10 then t0/n when n < 20 then (t0*s2-s1*t1)/(n*s2-s1*s1) else (t0*(s2*s4-s3*s3) - s1*(t1*s4-s3*t2) + s2*(t1*s3-s2*t2))/q end c0,
  case when n < 10 then 0 when n < 20 then (n*t1-s1*t0)/(n*s2-s1*s1) else (n*(t1*s4-s3*t2) - t0*(s1*s4-s2*s3) + s2*(s1*t2-t1*s2))/q end c1,
  case when n < 20 then 0 else (n*(s2*t2-t1*s3) - s1*(s1*t2-t1*s2) + t0*(s1*s3-s2*s2))/q end c2 from d)
select t.det, t.samp, round(coalesce(c0 + c1 * (t.samp - g.s) + c2 * (t.samp - g.s) * (t.samp - g.s), 0), 5) + 0.0 v
from g join tod t on t.det = g.det and t.samp >= g.s and t.samp < g.e left join c on c.det = g.det and c.s = g.s""".replace("samp >= g.s - 8 and t.samp < g.e + 8", "samp >= g.s - 12 and t.samp < g.e + 12")
)
def gap_fill_poly2(spark, sf):
    data = tod(spark, sf)
    return out(gapfill.fill(data, _gaps(data), 12, 2).select("det", "samp", rounded("v", 5).alias("v")))


def _targets(data):
    return data.select("det", F.col("samp").cast("long").alias("k"), (F.col("samp") * 1.1 - 3.05).alias("x"))


@query(
    f"""with {TOD}, k as (select det, samp::double x, y, lead(samp::double) over w x1, lead(y) over w y1, lag(samp::double) over w xp, lag(y) over w yp, row_number() over w i, count(*) over (partition by det) n from tod window w as (partition by det order by samp)),
t as (select det, samp k, samp * 1.1 - 3.05 x from tod),
j as (select t.det, t.k, t.x, least(greatest(floor(t.x)::bigint, 0), n - 2) a from t join dets using (det))
select j.det, j.k, round(k.y + (k.y1 - k.y) * (j.x - k.x), 6) + 0.0 y from j join k on k.det = j.det and k.x = j.a"""
)
def interp1d_linear(spark, sf):
    data = tod(spark, sf)
    knots = data.select("det", F.col("samp").cast("double").alias("x"), "y")
    return out(interp.interp1d_linear(knots, _targets(data)).select("det", "k", rounded("y").alias("y")))


NM = """ft as (select vec_id det, (i - 1)::bigint mode, embedding[i]::double v from (select vec_id, embedding, unnest(range(1, len(embedding) + 1)) i from embeddings)),
bins as (select * from (values (0, 2, 10), (1, 12, 30)) t(bin, b0, b1)),
mb as (select bin, unnest(range(2 * b0, least(2 * b1, 64))) mode from bins),
vecs as (select bin, det, vec, cos(det * 0.01 * (vec + 1) + bin) w from (select distinct det from ft), (values (0), (1)) b(bin), (values (0), (1), (2)) v(vec))"""


@query(
    f"with {NM}, q as (select mb.bin, vec, ft.mode, sum(w * v) q from ft join mb using (mode) join vecs on vecs.bin = mb.bin and vecs.det = ft.det group by 1, 2, 3), b as (select vecs.det, q.mode, sum(w * q) low from vecs join q on q.bin = vecs.bin and q.vec = vecs.vec group by 1, 2) select ft.det, ft.mode, round(case when mb.bin is null then v else (2.0 + ft.det % 5) / 1.2 * v + 1 / 1.2 * low end, 6) + 0.0 v from ft left join mb using (mode) left join b on b.det = ft.det and b.mode = ft.mode"
)
def nmat_apply(spark, sf):
    ft = model.tod_from_embeddings(table(spark, sf, "embeddings")).select("det", F.col("samp").cast("long").alias("mode"), F.col("y").alias("v"))
    bins = spark.createDataFrame([(0, 2, 10), (1, 12, 30)], "bin int, b0 long, b1 long")
    dets = ft.select("det").distinct()
    every = dets.select("det", F.explode(F.array(F.lit(0), F.lit(1))).alias("bin"))
    diag = every.select("bin", "det", (2.0 + F.col("det") % 5).alias("d"))
    vecs = every.select("bin", "det", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("vec"))
    vecs = vecs.withColumn("w", F.cos(F.col("det") * 0.01 * (F.col("vec") + 1) + F.col("bin")))
    return out(noise.nmat_apply(ft, bins, diag, vecs, 1.0, 1.2).select("det", "mode", rounded("v").alias("v")))


@query()
def fit_noise(spark, sf):
    """Spectra built from the events' values as scatter around a known model."""
    data = tod(spark, sf)
    f = 0.01 + F.col("samp") * 0.5
    knee = (2.0 / f) ** 2
    psd = data.select("det", f.alias("f"), ((10.0 + F.col("det")) * (1 + knee) * (1 + 0.1 * F.sin(F.col("y")))).alias("pxx"))
    got = noise.fit_noise(psd, 1.0, 10.0, 30.0)
    return out(got.select("det", *[F.round(c, 3).alias(c) for c in ("knee", "white", "alpha")]))


STAGES = [iir.Biquad(32092, 15750, 14, 3, 5), iir.Biquad(31238, 14895, 14, 3, 12)]


def biquads_sql(samples: str) -> str:
    """The stages walked sample by sample, all detectors side by side (samples: det, samp, i from 0, y)."""
    step, x = "select b.det, b.samp, b.i, b.y, w.u0, w.v0, w.u1, w.v1 from w join b on b.det = w.det and b.i = w.i + 1", "y"
    for k, p in enumerate(STAGES):
        # the delays move on: (u, v) becomes (v, n), and the output is v + 2 n + n
        step = f"select *, {x} * {1 << p.p_bits} - (({p.b1} * u{k} - {p.b0} * v{k}) >> {p.b_bits}) n{k} from ({step})"
        step, x = f"select *, ((v{k} + 2 * n{k} + n{k}) >> {p.shift}) x{k} from ({step})", f"x{k}"
    return f"""with recursive b as ({samples}),
w(det, samp, i, u0, v0, u1, v1, z) as (select distinct det, null::bigint, -1::bigint, 0::bigint, 0::bigint, 0::bigint, 0::bigint, 0::bigint from b
  union all select det, samp::bigint, i, v0, n0, v1, n1, x1 from ({step}))
select det, samp::bigint samp, z from w where i >= 0"""


@query(biquads_sql("select user_id det, row_number() over (partition by user_id order by ts, event_id) - 1 samp, row_number() over (partition by user_id order by ts, event_id) - 1 i, round(value * 100)::bigint y from events"))
def butterworth(spark, sf):
    data = tod(spark, sf).withColumn("y", F.round(F.col("y") * 100).cast("long"))
    return out(iir.filtered(data, STAGES))


@query(f"with {TOD} select det, samp, round(y / 0.25)::bigint q, round(y / 0.25)::bigint * 0.25 back from tod")
def quantize(spark, sf):
    q = storage.quantise(tod(spark, sf).withColumn("quantum", F.lit(0.25)))
    return out(storage.restore(q).select("det", "samp", "q", F.col("y").alias("back")))


@query(f"with {TOD} select det, samp, round(y * (1 + det % 7) * 0.5, 6) y, (1 + det % 7) * 0.5 * 0.25 quantum from tod")
def calibrate(spark, sf):
    data = tod(spark, sf).withColumn("quantum", F.lit(0.25))
    factors = data.select("det").distinct().withColumn("k", (1 + F.col("det") % 7) * 0.5)
    c = storage.calibrate(data, factors)
    return out(c.select("det", "samp", F.round("y", 6).alias("y"), "quantum"))


@query(f"with {TOD} select (det // 3)::bigint det, samp - 10 samp, y from tod where det % 3 = 1 and samp >= 10 and samp < 40")
def extract_slice(spark, sf):
    data = tod(spark, sf)
    picks = data.where("det % 3 = 1").select("det", F.expr("det div 3").alias("dest")).distinct()
    return out(storage.extract(data, 10, 40, picks), "det", "samp", "y")


@query(
    f"""with recursive {TOD}, b as (select det, samp, round(y * 1e6)::bigint q from tod),
w(det, samp, base, rest) as (select distinct det, -1::bigint, 0::bigint, 0::bigint from b
  union all select det, samp, base, q - base from (select b.det, b.samp, b.q, case when abs(b.q - w.base) >= {1 << 23} then floor((b.q + {1 << 23}) / {1 << 24}.0)::bigint * {1 << 24} else w.base end base from w join b on b.det = w.det and b.samp = w.samp + 1))
select det, samp, base, rest from w where samp >= 0"""
)
def rebranch(spark, sf):
    data = tod(spark, sf).withColumn("q", F.round(F.col("y") * 1e6).cast("long"))
    return out(storage.split_branches(data))


@query(
    f"""with {TOD}, b as (select det, samp, floor((round(y * 1e6)::bigint + {1 << 23}) / {1 << 24}.0)::bigint base from tod),
m as (select det, case when lag(base) over (partition by det order by samp) = base then 0 else 1 end moved from b)
select det, sum(moved)::bigint branches from m group by det"""
)
def branch_counts(spark, sf):
    data = tod(spark, sf).withColumn("q", F.round(F.col("y") * 1e6).cast("long"))
    return out(storage.branch_counts(data, 16))
