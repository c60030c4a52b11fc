"""Sight lines and focal planes as tables."""

from __future__ import annotations

from dataclasses import dataclass
from math import pi, radians

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quat
from ..functions.steps import Steps
from ..operators import scan
from ..operators.runs import each_with


@dataclass(frozen=True)
class Site:
    """A place on Earth: degrees and metres."""

    lon: float
    lat: float
    elev: float
    weather: str = "toco"


def _degrees(d: int, minutes: int, seconds: float) -> float:
    return d + minutes / 60 + seconds / 3600


# fixed values: observing sites (west and south), their height, and weather as humidity, pressure in mbar and degrees C
SITES = {
    "act": Site(-67.7876, -22.9585, 5188.0),
    "lat": Site(-_degrees(67, 47, 15.68), -_degrees(22, 57, 39.47), 5188.0),
    "sat1": Site(-_degrees(67, 47, 18.11), -_degrees(22, 57, 36.38), 5188.0),
    "sat2": Site(-_degrees(67, 47, 17.28), -_degrees(22, 57, 36.35), 5188.0),
    "sat3": Site(-_degrees(67, 47, 16.53), -_degrees(22, 57, 35.97), 5188.0),
}
DEFAULT_SITE = "lat"
WEATHER = {"vacuum": (0.0, 0.0, 0.0), "toco": (0.2, 550.0, 0.0)}


def site(name: str | Site | None = None) -> Site:
    if isinstance(name, Site):
        return name
    if (name or DEFAULT_SITE) not in SITES:
        raise ValueError(f"no such site: {name}")
    return SITES[name or DEFAULT_SITE]


def _bore(df: DataFrame, make) -> DataFrame:
    s = Steps(df)
    q = make(s)
    return s.done(**{f"q{n}": c for n, c in zip("abcd", q)})


def naive_az_el(scan: DataFrame, where: str | Site | None = None) -> DataFrame:
    """scan(t, az, el[, roll]) with the boresight qa..qd; good to a degree, with no refraction, aberration or nutation."""
    p = site(where)

    def make(s):
        # Earth's turn since 2000-01-01 12:00 UT, from the published rate
        day = (F.col("t") - 946728000.0) / 86400.0
        lst, az, el, roll = s.keep(6.300387486754831 * day + 4.894961212823756 + radians(p.lon), F.col("az"), F.col("el"), F.col("roll") if "roll" in scan.columns else F.lit(0.0))
        # two z-y-z rotations: the horizon on the sky, then the telescope on the horizon
        sky = s.keep(*quat.rotation_iso(pi / 2 - radians(p.lat), lst, pi))
        return quat.mul(tuple(sky), tuple(s.keep(*quat.rotation_lonlat(az, el, roll, azel=True))))

    return _bore(scan, make)


def az_el(scan: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """High-precision pointing from a table computed elsewhere, by sample (samp, qa..qd) or in time (t, qa..qd); there is no ephemeris here."""
    if table is None:
        raise NotImplementedError("high-precision pointing needs a table of quaternions")
    return scan.join(table, "samp") if "samp" in table.columns else between(table, scan)


def for_lonlat(scan: DataFrame) -> DataFrame:
    """scan(lon, lat[, psi]) with qa..qd."""
    return _bore(scan, lambda s: quat.rotation_lonlat(*s.keep(F.col("lon"), F.col("lat"), F.col("psi") if "psi" in scan.columns else F.lit(0.0))))


def for_horizon(scan: DataFrame) -> DataFrame:
    """scan(az, el[, roll]) with qa..qd in horizon coordinates."""
    return _bore(scan, lambda s: quat.rotation_lonlat(*s.keep(F.col("az"), F.col("el"), F.col("roll") if "roll" in scan.columns else F.lit(0.0)), azel=True))


def swept(samples: DataFrame, dt: float, t0: float, az0: float, throw: float, speed: float, el: float) -> DataFrame:
    """samples(samp) with t, az, el: azimuth going to and fro by `throw` around az0 at a steady speed."""
    phase = F.pmod(F.col("samp") * (dt * speed), F.lit(4.0 * throw))
    az = F.when(phase < 2 * throw, phase - throw).otherwise(3 * throw - phase) + az0
    return samples.withColumns({"t": t0 + F.col("samp") * dt, "az": az, "el": F.lit(el)})


def constant_elevation_scan(spark, n: int, dt: float, t0: float, az0: float, throw: float, speed: float, el: float) -> DataFrame:
    """samp, t, az, el of n samples."""
    return swept(spark.range(n).select(F.col("id").cast("int").alias("samp")), dt, t0, az0, throw, speed, el)


def between(table: DataFrame, scan_: DataFrame, size: int = scan.ROWS) -> DataFrame:
    """scan(samp, t) with qa..qd from a coarser table (t, qa..qd), turned steadily from one row to the next.

    Before the first and behind the last row that row holds.  Both sides are cut
    into the same blocks of t, by the rows of both; what a block lacks is carried
    from its neighbours.  Windows only look back, in either direction of t: one that
    looks ahead to its end starts anew at every row.
    """
    q = F.struct("t", *[f"q{n}" for n in "abcd"])
    every = table.select("t").unionByName(scan_.select("t"))
    knots = scan.blocked(table.select("t", *[f"q{n}" for n in "abcd"]), [], "t", size, of=every).select("blk", "t", q.alias("knot"))
    asks = scan.blocked(scan_.withColumn("ask", F.struct(*scan_.columns)).select("t", "ask"), [], "t", size, of=every)
    rows = knots.withColumn("ask", F.lit(None).cast(asks.schema["ask"].dataType)).unionByName(asks.withColumn("knot", F.lit(None).cast(knots.schema["knot"].dataType)))
    isask = F.col("ask").isNotNull()
    order, back = Window.partitionBy("blk").orderBy("t", isask), Window.partitionBy("blk").orderBy(F.desc("t"), isask.desc())
    so_far = lambda w: F.last("knot", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("a", so_far(order)).withColumn("b", so_far(back))
    # blocks without a row of the table need their neighbours too
    blocks = asks.select("blk").unionByName(knots.select("blk")).distinct()
    own = knots.groupBy("blk").agg(F.max("knot").alias("top"), F.min("knot").alias("low"))
    before = lambda c, w: F.last(c, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    # one row a block
    edge = blocks.join(own, "blk", "left").select("blk", before("top", Window.orderBy("blk")).alias("earlier"), before("low", Window.orderBy(F.desc("blk"))).alias("later"))
    got = rows.where("ask is not null").join(edge, "blk", "left")
    got = got.select("ask.*", F.coalesce("a", "earlier", "b", "later").alias("a"), F.coalesce("b", "later", "a", "earlier").alias("b"))
    s = Steps(got)
    part, dot = s.keep(F.when(F.col("b.t") > F.col("a.t"), (F.col("t") - F.col("a.t")) / (F.col("b.t") - F.col("a.t"))).otherwise(0.0), sum((F.col(f"a.q{n}") * F.col(f"b.q{n}") for n in "abcd"), F.lit(0.0)))
    # q and -q are one turn; the short way
    (angle,) = s.keep(F.acos(F.least(F.abs(dot), F.lit(1.0))))
    near = angle < 1e-9
    wa, wb = s.keep(F.when(near, 1 - part).otherwise(F.sin((1 - part) * angle) / F.sin(angle)), F.when(dot < 0, -1.0).otherwise(1.0) * F.when(near, part).otherwise(F.sin(part * angle) / F.sin(angle)))
    return s.done(**{f"q{n}": wa * F.col(f"a.q{n}") + wb * F.col(f"b.q{n}") for n in "abcd"}).select(*scan_.columns, *[f"q{n}" for n in "abcd"])


def focal_plane(dets: DataFrame, hwp: bool = False) -> DataFrame:
    """det, da..dd, resp_t, resp_p from dets(det, xi, eta[, gamma, T, P, Q, U]); a position that is not finite is a ValueError."""
    have = set(dets.columns)
    get = lambda c, v: F.coalesce(F.col(c).cast("double"), F.lit(v)) if c in have else F.lit(v)
    if not dets.where("xi is null or eta is null or isnan(xi) or isnan(eta) or abs(xi) = double('Infinity') or abs(eta) = double('Infinity')").isEmpty():
        raise ValueError("detector positions must be finite")
    s = Steps(dets)
    q, u = get("Q", 1.0), get("U", 0.0)
    gamma = get("gamma", 0.0) + F.atan2(u, q) / 2
    power = get("P", 1.0) * F.sqrt(q * q + u * u)
    xi, eta, gamma = s.keep(F.col("xi"), F.col("eta"), -gamma if hwp else gamma)
    d = quat.rotation_xieta(xi, eta, gamma)
    return s.done(**{f"d{n}": c for n, c in zip("abcd", d)}, resp_t=get("T", 1.0), resp_p=power).select("det", "da", "db", "dc", "dd", "resp_t", "resp_p")


def assembly(bore: DataFrame, fplane: DataFrame, turned: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Every sample of every detector: the boresight's columns, det, resp_t, resp_p and the product qa..qd.

    turned: a fixed rotation put before the boresight, once a sample.  The focal
    plane is counted and sent to the samples in runs of bounded size.
    """
    s = Steps(bore)
    if turned is not None:
        q = s.keep(*quat.mul(tuple(F.lit(float(v)) for v in turned), quat.read()))
        bore = s.done(**{f"q{n}": c for n, c in zip("abcd", q)})
    s = Steps(each_with(bore, fplane, "det"))
    out = s.keep(*quat.mul(quat.read(), quat.read("d")))
    return s.done(**{f"q{n}": c for n, c in zip("abcd", out)}).drop("da", "db", "dc", "dd")
