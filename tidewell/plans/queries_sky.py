"""Queries over pointing, projections and maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import healpix, quat, sky
from ..functions.steps import Steps
from . import pointing, projection
from .common import out, rounded
from .registry import query, table

PIX = sky.FlatPixels(110, 160, 0.02, 0.02, 55.5, 80.5)
CAR = projection.Geometry("CAR", 0.0, 0.0, PIX)
TILED = projection.Geometry("CAR", 0.0, 0.0, PIX, (40, 50))
BORE = """bore as (select event_id samp, value / 500 * 3 - 1.5 lon, (user_id % 100) / 100.0::double * 2 - 1 lat, event_id * 0.01::double psi, value sig from events),
bq as (select *, cos((pi()/2 - lat)/2) * cos((lon + psi)/2) a, sin((pi()/2 - lat)/2) * sin((psi - lon)/2) b, sin((pi()/2 - lat)/2) * cos((psi - lon)/2) c, cos((pi()/2 - lat)/2) * sin((lon + psi)/2) d from bore),
fp as (select det, xi, eta, g, asin(sqrt(xi*xi + eta*eta)) / 2 th, atan2(-xi, -eta) / 2 ph, (g - atan2(-xi, -eta)) / 2 ps from (
  select det, (det - 1) * 0.01::double xi, det * 0.005::double eta, det * 0.3::double g from (select unnest(range(3)) det))),
fq as (select det, cos(th) * cos(ph + ps) a, sin(th) * sin(ps - ph) b, sin(th) * cos(ps - ph) c, cos(th) * sin(ph + ps) d from fp),
q as (select f.det, p.samp, p.sig + f.det y,
  p.a*f.a - p.b*f.b - p.c*f.c - p.d*f.d a, p.a*f.b + p.b*f.a + p.c*f.d - p.d*f.c b,
  p.a*f.c - p.b*f.d + p.c*f.a + p.d*f.b c, p.a*f.d + p.b*f.c - p.c*f.b + p.d*f.a d from bq p, fq f)"""
Z = "(a*a - b*b - c*c + d*d)"
XY = {
    "CAR": ("atan2(c*d - a*b, c*a + d*b)", f"asin({Z})"),
    "CEA": ("atan2(c*d - a*b, c*a + d*b)", Z),
    "SIN": ("2*(a*b - c*d)", "2*(c*a + d*b)"),
    "TAN": ("2*(a*b - c*d) / (2*(a*a + d*d) - 1)", "2*(c*a + d*b) / (2*(a*a + d*d) - 1)"),
    "ZEA": ("2*(a*b - c*d) / sqrt(a*a + d*d)", "2*(c*a + d*b) / sqrt(a*a + d*d)"),
    "ARC": ("(a*b - c*d) / sqrt((a*b-c*d)**2 + (c*a+d*b)**2) * 2 * atan2(sqrt(b*b + c*c), sqrt(a*a + d*d))", "(c*a + d*b) / sqrt((a*b-c*d)**2 + (c*a+d*b)**2) * 2 * atan2(sqrt(b*b + c*c), sqrt(a*a + d*d))"),
}
PSI_CYL = (f"(a*c - b*d) / (0.5*sqrt(1 - {Z}*{Z}))", f"(c*d + a*b) / (0.5*sqrt(1 - {Z}*{Z}))")
PSI_ZEN = ("(a*a - d*d) / (a*a + d*d)", "2*a*d / (a*a + d*d)")
PTS = f"""{BORE}, xy as (select det, samp, y sig, {XY['CAR'][0]} x, {XY['CAR'][1]} y, {PSI_CYL[0]} cp, {PSI_CYL[1]} sp from q),
pl as (select *, x / 0.02 + 80.0 px, y / 0.02 + 55.0 py, 1.0::double ft, 0.9 * (cp*cp - sp*sp) fq, 0.9 * 2 * cp * sp fu from xy)"""
NEAR = f"{PTS}, pt as (select *, floor(py)::bigint iy, floor(px)::bigint ix, 1.0::double w from pl where px >= 0 and px < 160 and py >= 0 and py < 110)"
LINES = f"""{PTS}, pt as (select * from (select * exclude (py, px), (floor(py - 0.5) + j)::bigint iy, (floor(px - 0.5) + i)::bigint ix,
  (case when j = 0 then 1 - (py - 0.5 - floor(py - 0.5)) else py - 0.5 - floor(py - 0.5) end) * (case when i = 0 then 1 - (px - 0.5 - floor(px - 0.5)) else px - 0.5 - floor(px - 0.5) end) w
  from pl, (values (0), (1)) a(j), (values (0), (1)) b(i)) where iy >= 0 and iy < 110 and ix >= 0 and ix < 160)"""
MAP = "m as (select iy, ix, sum(sig * ft * w) t, sum(sig * fq * w) q, sum(sig * fu * w) u from pt group by iy, ix)"
WTS = "wt as (select iy, ix, sum(ft*ft*w*w) tt, sum(ft*fq*w*w) tq, sum(ft*fu*w*w) tu, sum(fq*fq*w*w) qq, sum(fq*fu*w*w) qu, sum(fu*fu*w*w) uu from pt group by iy, ix)"


def boresight(spark, sf):
    """Sight lines inside the map's footprint, from the events."""
    e = table(spark, sf, "events")
    scan = e.select(F.col("event_id").alias("samp"), (F.col("value") / 500 * 3 - 1.5).alias("lon"), ((F.col("user_id") % 100) / 100.0 * 2 - 1).alias("lat"), (F.col("event_id") * 0.01).alias("psi"), F.col("value").alias("sig"))
    return pointing.for_lonlat(scan).drop("lon", "lat", "psi")


def assembly(spark, sf):
    dets = spark.range(3).select(F.col("id").alias("det"), ((F.col("id") - 1) * 0.01).alias("xi"), (F.col("id") * 0.005).alias("eta"), (F.col("id") * 0.3).alias("gamma"), F.lit(0.9).alias("P"))
    return pointing.assembly(boresight(spark, sf), pointing.focal_plane(dets))


def signal(asm):
    return asm.select("det", "samp", (F.col("sig") + F.col("det")).alias("y"))


def valued(spark, sf):
    """The assembly with each sample's value in `signal`."""
    return assembly(spark, sf).withColumn("signal", F.col("sig") + F.col("det"))

@query(f"with {BORE} select det, samp, round(a, 9) + 0.0 qa, round(b, 9) + 0.0 qb, round(c, 9) + 0.0 qc, round(d, 9) + 0.0 qd from q")
def quat_compose(spark, sf):
    return out(assembly(spark, sf).select("det", "samp", *[rounded(f"q{n}", 9).alias(f"q{n}") for n in "abcd"]))


@query(f"with {BORE} select samp, round(lon, 8) + 0.0 lon, round(lat, 8) + 0.0 lat, round(cos(psi), 8) + 0.0 cpsi from bore")
def decompose_lonlat(spark, sf):
    lon, lat, psi = quat.decompose_lonlat(quat.read())
    return out(boresight(spark, sf).select("samp", rounded(lon, 8).alias("lon"), rounded(lat, 8).alias("lat"), rounded(F.cos(psi), 8).alias("cpsi")))


@query("select p_partkey det, round((p_partkey % 61 - 30) * 0.002, 9) + 0.0 xi, round(p_size * 0.001, 9) + 0.0 eta, round(cos((p_partkey % 10) * 0.3), 9) + 0.0 cg from part")
def xieta_offsets(spark, sf):
    """A focal plane with a detector for each part, and its offsets read back from the quaternions."""
    dets = table(spark, sf, "part").select(F.col("p_partkey").alias("det"), ((F.col("p_partkey") % 61 - 30) * 0.002).alias("xi"), (F.col("p_size") * 0.001).alias("eta"), ((F.col("p_partkey") % 10) * 0.3).alias("gamma"))
    xi, eta, gamma = quat.decompose_xieta(quat.read("d"))
    return out(pointing.focal_plane(dets).select("det", rounded(xi, 9).alias("xi"), rounded(eta, 9).alias("eta"), rounded(F.cos(gamma), 9).alias("cg")))


SCAN = "s as (select event_id samp, epoch_us(ts) / 1e6 t, radians(180 + value / 10) az, radians(40 + user_id % 40) el from events)"


@query(
    f"""with {SCAN}, h as (select samp, az, el, 6.300387486754831 * ((t - 946728000.0) / 86400.0) + 4.894961212823756 + radians(-(67 + 47/60.0::double + 15.68/3600)) lst, radians(-(22 + 57/60.0::double + 39.47/3600)) phi from s),
v as (select samp, lst, phi, cos(el)*cos(az) n, cos(el)*sin(az) e, sin(el) u from h)
select samp, round(sin(phi)*u + cos(phi)*n, 6) + 0.0 z,
  round((cos(phi)*u - sin(phi)*n) * cos(lst) - e * sin(lst), 6) + 0.0 x,
  round((cos(phi)*u - sin(phi)*n) * sin(lst) + e * cos(lst), 6) + 0.0 y from v"""
)
def naive_az_el(spark, sf):
    """Direction of the boresight on the sky, against spherical trigonometry."""
    from ..model import micros

    e = table(spark, sf, "events")
    scan = e.select(F.col("event_id").alias("samp"), (micros() / 1e6).alias("t"), F.radians(180 + F.col("value") / 10).alias("az"), F.radians(40 + F.col("user_id") % 40).alias("el"))
    s = Steps(pointing.naive_az_el(scan))
    lon, lat = s.keep(*quat.decompose_lonlat(quat.read())[:2])
    x, y, z = healpix.ang2vec(lon, lat)
    return out(s.done(x=rounded(x, 6), y=rounded(y, 6), z=rounded(z, 6)).select("samp", "x", "y", "z"))


@query(f"with {SCAN} select samp, round(cos(el)*cos(az), 8) + 0.0 x, round(cos(el)*sin(az), 8) + 0.0 y, round(sin(el), 8) + 0.0 z from s")
def horizon_direction(spark, sf):
    e = table(spark, sf, "events")
    scan = e.select(F.col("event_id").alias("samp"), F.radians(180 + F.col("value") / 10).alias("az"), F.radians(40 + F.col("user_id") % 40).alias("el"))
    s = Steps(pointing.for_horizon(scan))
    lon, lat = s.keep(*quat.decompose_lonlat(quat.read(), azel=True)[:2])
    x, y, z = healpix.ang2vec(lon, lat)
    return out(s.done(x=rounded(x, 8), y=rounded(y, 8), z=rounded(z, 8)).select("samp", "x", "y", "z"))


@query(
    "with s as (select event_id samp, (event_id * (0.1::double * 0.5::double)) % 4.0::double p from events) select samp, round(1654041600 + samp * 0.1, 6) t, round(case when p < 2 then p - 1 else 3 - p end + 60, 6) + 0.0 az, 50.0::double el from s"
)
def scan_ces(spark, sf):
    """A constant-elevation scan with a sample for each event."""
    s = pointing.swept(table(spark, sf, "events").select(F.col("event_id").alias("samp")), 0.1, 1654041600.0, 60.0, 1.0, 0.5, 50.0)
    return out(s.select("samp", F.round("t", 6).alias("t"), rounded("az").alias("az"), "el"))


@query(
    "with s as (select event_id samp, event_id * 0.05::double t, (select min(event_id) from events where event_id % 40 = 0) * 0.05::double lo, (select max(event_id) from events where event_id % 40 = 0) * 0.05::double hi from events) select samp, round(cos(least(greatest(t, lo), hi) * 0.02), 8) + 0.0 clon, round(sin(least(greatest(t, lo), hi) * 0.02), 8) + 0.0 slon, 0.3::double lat from s"
)
def pointing_between(spark, sf):
    """Sight lines at every event from a table with a fortieth of them: a steady turn about the pole is met exactly."""
    s = table(spark, sf, "events").select(F.col("event_id").alias("samp"), (F.col("event_id") * 0.05).alias("t"))
    coarse = pointing.for_lonlat(s.where("samp % 40 = 0").withColumns({"lon": F.col("t") * 0.02, "lat": F.lit(0.3)})).select("t", "qa", "qb", "qc", "qd")
    lon, lat, _ = quat.decompose_lonlat(quat.read())
    return out(pointing.az_el(s, coarse).select("samp", rounded(F.cos(lon), 8).alias("clon"), rounded(F.sin(lon), 8).alias("slon"), rounded(lat, 8).alias("lat")))


def _coords_query(system: str):
    psi = PSI_CYL if system in ("CAR", "CEA") else PSI_ZEN
    x, y = XY[system]
    sql = f"with {BORE} select det, samp, round({x}, 7) + 0.0 x, round({y}, 7) + 0.0 y, round({psi[0]}, 7) + 0.0 cpsi, round({psi[1]}, 7) + 0.0 spsi from q"

    def run(spark, sf):
        got = projection.with_coords(assembly(spark, sf), system)
        return out(got.select("det", "samp", *[rounded(c, 7).alias(c) for c in ("x", "y", "cpsi", "spsi")]))

    run.__name__ = f"coords_{system.lower()}"
    return query(sql)(run)


for _system in XY:
    _coords_query(_system)


@query(f"with {BORE} select samp, round(lon + 0.01, 9) + 0.0 x, round(lat - 0.02, 9) + 0.0 y, round(cos(psi + 0.5), 7) + 0.0 cpsi, round(sin(psi + 0.5), 7) + 0.0 spsi from bore")
def coords_flat(spark, sf):
    """A flat system takes x, y and the angle's cosine and sine in place of a quaternion."""
    e = table(spark, sf, "events")
    psi = F.col("event_id") * 0.01
    at = e.select(F.col("event_id").alias("samp"), (F.col("value") / 500 * 3 - 1.5).alias("a"), ((F.col("user_id") % 100) / 100.0 * 2 - 1).alias("b"), F.cos(psi).alias("c"), F.sin(psi).alias("d"))
    got = sky.coords("FLAT", tuple(F.col(n) for n in "abcd"), (F.lit(0.01), F.lit(-0.02), F.cos(F.lit(0.5)), F.sin(F.lit(0.5))))
    return out(at.select("samp", *[rounded(c, 9 if n in ("x", "y") else 7).alias(n) for c, n in zip(got, ("x", "y", "cpsi", "spsi"))]))


@query(f"with {PTS} select det, samp, case when px >= 0 and px < 160 and py >= 0 and py < 110 then floor(py)::bigint else -1 end iy, case when px >= 0 and px < 160 and py >= 0 and py < 110 then floor(px)::bigint else -1 end ix from pl")
def pixels_flat(spark, sf):
    s = Steps(projection.with_coords(assembly(spark, sf), "CAR"))
    iy, ix = s.keep(*PIX.pixel(F.col("x"), F.col("y")))
    return out(s.done(iy=iy, ix=ix).select("det", "samp", "iy", "ix"))


@query(f"with {NEAR} select det, samp, (iy // 40 * 4 + ix // 50)::bigint tile, (iy % 40)::bigint ty, (ix % 50)::bigint tx from pt")
def pixels_tiled(spark, sf):
    p = projection.pointing(assembly(spark, sf), TILED, "T")
    ty, tx = PIX.in_tile(F.col("iy"), F.col("ix"), 40, 50)
    return out(p.select("det", "samp", "tile", ty.alias("ty"), tx.alias("tx")))


@query(f"with {LINES} select det, samp, iy, ix, round(w, 7) + 0.0 w from pt")
def pixels_bilinear(spark, sf):
    p = projection.pointing(assembly(spark, sf), CAR, "T", "bilinear")
    return out(p.select("det", "samp", "iy", "ix", rounded("w", 7).alias("w")))


@query(f"with {NEAR} select det, samp, iy, ix, round(ft, 7) + 0.0 ft, round(fq, 7) + 0.0 fq, round(fu, 7) + 0.0 fu from pt")
def pointing_matrix(spark, sf):
    p = projection.pointing(assembly(spark, sf), CAR, "TQU")
    return out(p.select("det", "samp", "iy", "ix", rounded("fT", 7).alias("ft"), rounded("fQ", 7).alias("fq"), rounded("fU", 7).alias("fu")))


def ring_sql(nside: int, source: str, keep: str) -> str:
    """Ring numbers of cells (face, hx, hy), from the pixels on the rings before and the middle's longitude."""
    return f"""select {keep}, (2*a*(a+1) + {4 * nside} * belt + {2 * nside * (nside + 1)} - 2*b*(b+1) + ((mid * wd + hx - hy + 8*wd) % (8*wd)) // 2)::bigint ring from (
  select *, least(r - 1, {nside}) a, least({nside}, {4 * nside} - r) b, least(greatest(r - 1 - {nside}, 0), {2 * nside - 1}) belt, least(r, {nside}, {4 * nside} - r) wd, 2 * (face % 4) + (case when face between 4 and 7 then 0 else 1 end) mid from (
  select *, (face // 4) * {nside} + 1 + {2 * (nside - 1)} - hx - hy r from {source}))"""


def _healpix_sql(nside: int, ring: bool) -> str:
    """Pixels by the twelve diamonds in the plane of longitude (eighths of a turn) and height (units of a face)."""
    spread = "+".join(f"((({{v}} >> {k}) & 1) << {2 * k})" for k in range(5))
    nest = f"face * {nside * nside} + {spread.format(v='hx')} + 2 * ({spread.format(v='hy')})"
    tail = f"select det, samp, ring pix from ({ring_sql(nside, 'cell', 'det, samp')})" if ring else f"select det, samp, ({nest})::bigint pix from cell"
    clamp = lambda v: f"greatest(least(floor(({v}) / 2 * {nside}), {nside - 1}), 0)::bigint"
    return f"""with {PTS}, plane as (select det, samp, sin(y) z, x * 4 / pi() - 8 * floor(x / (2 * pi())) eighth, cos(y) * sqrt(3 / (1 + abs(sin(y)))) pole from pl),
high as (select *, case when abs(z) <= 2/3.0::double then 1 else pole end width, case when abs(z) <= 2/3.0::double then 1.5 * z else sign(z) * (2 - pole) end height, floor(eighth / 2 + 0.5)::bigint near, least(floor(eighth / 2), 3)::bigint fourth from plane),
belt as (select *, abs(eighth - 2 * near) + abs(height) < 1 middle from high),
placed as (select *, case when middle then 4 + near % 4 when z >= 0 then fourth else 8 + fourth end face, case when middle then eighth - 2 * near else (eighth - 2 * fourth - 1) * width end across, height + case when middle then 1 when z >= 0 then 0 else 2 end rise from belt),
cell as (select det, samp, face, {clamp('rise + across')} hx, {clamp('rise - across')} hy from placed)
{tail}"""


@query(_healpix_sql(16, False))
def pixels_healpix_nest(spark, sf):
    return out(projection.healpix_pointing(assembly(spark, sf), 16, "T").select("det", "samp", "pix"))


@query(_healpix_sql(16, True))
def pixels_healpix_ring(spark, sf):
    return out(projection.healpix_pointing(assembly(spark, sf), 16, "T", nest=False).select("det", "samp", "pix"))


@query(f"with p as ({_healpix_sql(16, False)}), y as (select event_id samp, value from events) select pix // 64 tile, (pix % 64)::bigint inner_pix, count(*)::bigint hits, round(sum(y.value + p.det), 5) + 0.0 t from p join y using (samp) group by 1, 2")
def healpix_map_tiled(spark, sf):
    p = projection.healpix_pointing(valued(spark, sf), 16, "T", nside_tile=2)
    m = p.groupBy("tile", F.pmod("pix", F.lit(64)).alias("inner_pix")).agg(F.count("*").alias("hits"), F.sum(F.col("signal") * F.col("fT")).alias("t"))
    return out(m.select("tile", "inner_pix", "hits", rounded("t", 5).alias("t")))


def _map(spark, sf, components, interpolation="nearest", weights=None):
    return projection.to_map(projection.pointing(valued(spark, sf), CAR, components, interpolation), components, weights)


@query(f"with {NEAR}, {MAP} select iy, ix, round(t, 5) + 0.0 t from m")
def to_map_t(spark, sf):
    return out(_map(spark, sf, "T").select("iy", "ix", rounded("T", 5).alias("t")))


@query(f"with {NEAR}, {MAP} select iy, ix, round(q, 5) + 0.0 q, round(u, 5) + 0.0 u from m")
def to_map_qu(spark, sf):
    return out(_map(spark, sf, "QU").select("iy", "ix", rounded("Q", 5).alias("q"), rounded("U", 5).alias("u")))


@query(f"with {NEAR}, {MAP} select iy, ix, round(t, 5) + 0.0 t, round(q, 5) + 0.0 q, round(u, 5) + 0.0 u from m")
def to_map_tqu(spark, sf):
    return out(_map(spark, sf, "TQU").select("iy", "ix", rounded("T", 5).alias("t"), rounded("Q", 5).alias("q"), rounded("U", 5).alias("u")))


@query(f"with {NEAR} select iy, ix, round(sum(sig * ft * (0.5 * det)), 5) + 0.0 t from pt where det > 0 group by iy, ix")
def to_map_weighted(spark, sf):
    weights = spark.range(3).select(F.col("id").alias("det"), (F.col("id") * 0.5).alias("wt"))
    return out(_map(spark, sf, "T", weights=weights).select("iy", "ix", rounded("T", 5).alias("t")))


@query(f"with {LINES}, {MAP} select iy, ix, round(t, 5) + 0.0 t, round(q, 5) + 0.0 q, round(u, 5) + 0.0 u from m")
def map_bilinear(spark, sf):
    return out(_map(spark, sf, "TQU", "bilinear").select("iy", "ix", rounded("T", 5).alias("t"), rounded("Q", 5).alias("q"), rounded("U", 5).alias("u")))


@query(f"with {NEAR}, {WTS} select iy, ix, round(tt, 6) + 0.0 wtt, round(tq, 6) + 0.0 wtq, round(tu, 6) + 0.0 wtu, round(qq, 6) + 0.0 wqq, round(qu, 6) + 0.0 wqu, round(uu, 6) + 0.0 wuu from wt")
def to_weights_tqu(spark, sf):
    w = projection.to_weights(projection.pointing(assembly(spark, sf), CAR, "TQU"), "TQU")
    return out(w.select("iy", "ix", *[rounded(f"w{n}").alias(f"w{n.lower()}") for n in ("TT", "TQ", "TU", "QQ", "QU", "UU")]))


@query(f"with {NEAR}, {MAP} select q.det, q.samp, round(q.y + coalesce(pt.ft*m.t + pt.fq*m.q + pt.fu*m.u, 0), 4) + 0.0 y from q left join pt on pt.det = q.det and pt.samp = q.samp left join m on m.iy = pt.iy and m.ix = pt.ix")
def from_map_tqu(spark, sf):
    p = projection.pointing(valued(spark, sf), CAR, "TQU", off_map=True)
    m = projection.to_map(p.where("iy >= 0"), "TQU")
    return out(projection.from_map(p, m, "TQU", CAR).select("det", "samp", rounded("y", 4).alias("y")))


@query(
    f"""with {NEAR}, {MAP}, {WTS}, k as (select *, qq*uu - qu*qu k0, tu*qu - tq*uu k1, tq*qu - tu*qq k2, tt*uu - tu*tu k3, tq*tu - tt*qu k4, tt*qq - tq*tq k5 from m join wt using (iy, ix)),
d as (select *, tt*k0 + tq*k1 + tu*k2 det from k)
select iy, ix, round((k0*t + k1*q + k2*u) / det, 4) + 0.0 t, round((k1*t + k3*q + k4*u) / det, 4) + 0.0 q, round((k2*t + k4*q + k5*u) / det, 4) + 0.0 u from d where det > 0.01"""
)
def map_solve_tqu(spark, sf):
    """Flagship: samples to a TQU map and its weights, solved pixel by pixel."""
    p = projection.pointing(valued(spark, sf), CAR, "TQU")
    m = projection.solve_tqu(projection.to_map_and_weights(p, "TQU"), least=0.01)
    return out(m.select("iy", "ix", rounded("T", 4).alias("t"), rounded("Q", 4).alias("q"), rounded("U", 4).alias("u")))


@query(
    f"""with {NEAR}, few as (select * exclude (fq, fu), case when ix % 3 = 0 then 0.6 else fq end fq, case when ix % 3 = 0 then 0.3 when ix % 3 = 1 then fq / 2 else fu end fu from pt),
{MAP.replace('from pt', 'from few')}, {WTS.replace('from pt', 'from few')}, k as (select *, qq*uu - qu*qu k0, tu*qu - tq*uu k1, tq*qu - tu*qq k2, tt*uu - tu*tu k3, tq*tu - tt*qu k4, tt*qq - tq*tq k5 from m join wt using (iy, ix)),
d as (select *, tt*k0 + tq*k1 + tu*k2 det, tt + qq + uu e1, k0 + k3 + k5 e2, tt*t + tq*q + tu*u x, tq*t + qq*q + qu*u y, tu*t + qu*q + uu*u z from k),
r as (select *, case when det > 1e-5 * e1**3 then 3 when e2 > 1e-5 * e1**2 then 2 else 1 end r, tt*x + tq*y + tu*z xx, tq*x + qq*y + qu*z yy, tu*x + qu*y + uu*z zz from d)
select iy, ix, r::bigint as rank, round(case r when 3 then (k0*t + k1*q + k2*u) / det when 2 then ((e1*e1 - e2) * x - e1 * xx) / (e2*e2) else x / (e1*e1) end, 3) + 0.0 t,
  round(case r when 3 then (k1*t + k3*q + k4*u) / det when 2 then ((e1*e1 - e2) * y - e1 * yy) / (e2*e2) else y / (e1*e1) end, 3) + 0.0 q,
  round(case r when 3 then (k2*t + k4*q + k5*u) / det when 2 then ((e1*e1 - e2) * z - e1 * zz) / (e2*e2) else z / (e1*e1) end, 3) + 0.0 u from r"""
)
def map_pinv_tqu(spark, sf):
    """Pixels seen from one angle only, from angles on a line, and from many: each keeps what its weights can tell."""
    p = projection.pointing(valued(spark, sf), CAR, "TQU")
    column = F.col("ix") % 3
    p = p.withColumn("fU", F.when(column == 0, 0.3).when(column == 1, F.col("fQ") / 2).otherwise(F.col("fU"))).withColumn("fQ", F.when(column == 0, 0.6).otherwise(F.col("fQ")))
    m = projection.pinv_tqu(projection.to_map_and_weights(p, "TQU"), least=1e-5)
    return out(m.select("iy", "ix", F.col("rank").cast("long").alias("rank"), rounded("T", 3).alias("t"), rounded("Q", 3).alias("q"), rounded("U", 3).alias("u")))


@query(f"with {BORE} select 0::bigint pair, a.samp, round((a.y + b.y) / 2, 6) + 0.0 total, round((a.y - b.y) / 2, 6) + 0.0 diff from q a join q b on a.samp = b.samp and a.det = 0 and b.det = 1")
def pair_difference_map(spark, sf):
    p = projection.pair_difference(signal(assembly(spark, sf)))
    return out(p.select("pair", "samp", rounded("total").alias("total"), rounded("diff").alias("diff")))


@query(f"with {NEAR} select (iy // 40 * 4 + ix // 50)::bigint tile, count(*)::bigint hits from pt group by 1")
def tile_hits(spark, sf):
    return out(projection.tile_hits(projection.pointing(assembly(spark, sf), TILED, "T")))


@query(
    f"""with recursive {NEAR}, h as (select *, row_number() over (order by hits desc, tile) rn from (select (iy // 40 * 4 + ix // 50)::bigint tile, count(*)::bigint hits from pt group by 1)),
g as (select 0::bigint rn, 0::bigint tile, 0::bigint hits, 0::bigint grp, 0::bigint l0, 0::bigint l1, 0::bigint l2
  union all select rn, tile, hits, gr, l0 + if(gr = 0, hits, 0), l1 + if(gr = 1, hits, 0), l2 + if(gr = 2, hits, 0) from (
    select h.rn, h.tile, h.hits, l0, l1, l2, case when l0 <= l1 and l0 <= l2 then 0 when l1 <= l2 then 1 else 2 end::bigint gr from g join h on h.rn = g.rn + 1))
select tile, hits, grp from g where rn > 0"""
)
def active_tiles(spark, sf):
    return out(projection.active_tiles(projection.tile_hits(projection.pointing(assembly(spark, sf), TILED, "T")), 3))


@query(
    f"with {NEAR}, d as (select det, samp, (ix * 4 // 160)::bigint domain from pt), r as (select det, domain, min(samp) s, max(samp) + 1 e from (select *, samp - row_number() over (partition by det, domain order by samp) g from d) group by det, domain, g) select det, domain, s, e from r"
)
def domain_ranges(spark, sf):
    p = projection.pointing(assembly(spark, sf), CAR, "T")
    return out(projection.domain_ranges(p, PIX.stripe(F.col("ix"), 4)).select("det", "domain", "s", "e"))


@query(
    f"with {NEAR}, d as (select det, samp, ((iy // 40 * 4 + ix // 50) % 2)::bigint domain from pt where (iy // 40 * 4 + ix // 50) <> 3), r as (select det, domain, min(samp) s, max(samp) + 1 e from (select *, samp - row_number() over (partition by det, domain order by samp) g from d) group by det, domain, g) select det, domain, s, e from r"
)
def tile_ranges(spark, sf):
    p = projection.pointing(assembly(spark, sf), TILED, "T")
    groups = spark.range(12).where("id <> 3").select(F.col("id").alias("tile"), (F.col("id") % 2).alias("grp"))
    return out(projection.tile_ranges(p, groups).select("det", "domain", "s", "e"))


@query(
    f"""with {NEAR}, d as (select det, samp, iy * sin(0.3::double) - ix * cos(0.3::double) d from pt), e as (select min(d) lo, max(d) hi from d),
b as (select det, samp, least(floor((d - lo) / ((hi - lo) / 200)), 199)::bigint bin from d, e), h as (select bin, count(*) n from b group by bin),
s as (select bin, least(floor((sum(n) over (order by bin) / sum(n) over ()::double - 1e-5) * 4), 3)::bigint domain from h) select det, samp, domain from b join s using (bin)"""
)
def domdir_bins(spark, sf):
    return out(projection.direction_bins(projection.pointing(assembly(spark, sf), CAR, "T"), 0.3, 4))


@query(
    f"with pt as ({_healpix_sql(16, False)}), d as (select det, samp, (pix * 4 // {12 * 16 * 16})::bigint domain from pt), r as (select det, domain, min(samp) s, max(samp) + 1 e from (select *, samp - row_number() over (partition by det, domain order by samp) g from d) group by det, domain, g) select det, domain, s, e from r"
)
def threads_healpix(spark, sf):
    p = projection.healpix_pointing(assembly(spark, sf), 16, "T")
    return out(projection.assign_threads(p, "simple", 4, nside=16).select("det", "domain", "s", "e"))


@query(
    f"""with p as ({_healpix_sql(16, False)}), y as (select event_id samp, value from events), m as (select pix // 64 tile, (pix % 64)::bigint inner_pix, count(*) hits, sum(y.value + p.det) t from p join y using (samp) group by 1, 2),
a as (select distinct tile from m where tile % 2 = 0)
select z.tile, i::bigint inner_pix, (z.tile * 64 + i)::bigint pix, coalesce(hits, 0)::bigint hits, round(coalesce(t, 0), 5) + 0.0 t from (select tile, unnest(range(64)) i from a) z left join m on m.tile = z.tile and inner_pix = i"""
)
def healpix_tile_blocks(spark, sf):
    """A tiled map stored as dense tiles; every second tile is read and laid out again."""
    from ..streaming.live import shared_folder
    from . import tiles

    p = projection.healpix_pointing(valued(spark, sf), 16, "T", nside_tile=2)
    m = p.groupBy("tile", F.pmod("pix", F.lit(64)).alias("inner")).agg(F.count("*").alias("hits"), F.sum(F.col("signal") * F.col("fT")).alias("T"))
    path = f"{shared_folder(spark)}/tiles"
    tiles.save(tiles.dense(m, 64, ["hits", "T"]), path)
    got = tiles.untile(tiles.load(spark, path, list(range(0, 48, 2))), ["hits", "T"], 64)
    return out(got.select("tile", F.col("inner").alias("inner_pix"), "pix", F.col("hits").cast("long").alias("hits"), rounded("T", 5).alias("t")))


@query(f"with {NEAR}, b as (select case when samp % 100 < 40 then 0 else 1 end bunch, det domain, * from pt where samp % 100 < 40 or samp % 100 >= 60) select bunch::bigint bunch, domain::bigint as domain, iy, ix, count(*)::bigint hits, round(sum(sig), 5) + 0.0 t from b group by 1, 2, 3, 4")
def map_bunches(spark, sf):
    """A map of two bunches of samples, with a domain for each detector."""
    asm = valued(spark, sf)
    hundreds = asm.select("det", (F.floor(F.col("samp") / 100) * 100).alias("at")).distinct()
    dets = asm.groupBy("det").agg((F.max("samp") + 100).alias("n"))
    nested = None
    for bunch, (a, z) in enumerate(((0, 40), (60, 100))):
        part = hundreds.select(F.lit(bunch).alias("bunch"), F.col("det").alias("domain"), "det", (F.col("at") + a).alias("s"), (F.col("at") + z).alias("e"))
        nested = part if nested is None else nested.unionByName(part)
    p = projection.bunched(projection.pointing(asm, CAR, "T"), projection.promoted(nested, dets))
    m = p.groupBy("bunch", "domain", "iy", "ix").agg(F.count("*").alias("hits"), F.sum("signal").alias("t"))
    return out(m.select("bunch", "domain", "iy", "ix", "hits", rounded("t", 5).alias("t")))
