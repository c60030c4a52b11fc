"""Map making: samples to maps and back, weights, tiles and work domains.

A pointed table has one row for each detector and sample: det, samp, pixel
columns and spin factors f0.. (f_T, f_Q, f_U as the components ask).  Maps are
sparse tables keyed by pixel; an absent pixel is zero.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, cos, log2, pi, radians, sin, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import healpix, sky
from ..functions.steps import Steps
from ..operators import ranges


@dataclass(frozen=True)
class Geometry:
    """A flat map: projection, native pole (radians) and pixels; tile (ty, tx) if it is tiled."""

    system: str
    lon0: float
    lat0: float
    pixels: sky.FlatPixels
    tile: tuple[int, int] | None = None

    def native(self) -> tuple[float, float, float, float]:
        """Rotation from the sky to the map's own frame."""
        if self.system in ("CAR", "CEA"):
            parts = [(1, self.lat0), (2, -self.lon0)]
        elif self.system in ("TAN", "SIN", "ARC", "ZEA"):
            parts = [(2, pi), (1, self.lat0 - pi / 2), (2, -self.lon0)]
        else:
            raise ValueError(f"no rotation for {self.system}")
        q = (1.0, 0.0, 0.0, 0.0)
        for axis, angle in parts:
            r = [cos(angle / 2), 0.0, 0.0, 0.0]
            r[axis + 1] = sin(angle / 2)
            q = (
                q[0] * r[0] - q[1] * r[1] - q[2] * r[2] - q[3] * r[3],
                q[0] * r[1] + q[1] * r[0] + q[2] * r[3] - q[3] * r[2],
                q[0] * r[2] - q[1] * r[3] + q[2] * r[0] + q[3] * r[1],
                q[0] * r[3] + q[1] * r[2] - q[2] * r[1] + q[3] * r[0],
            )
        return q


    @classmethod
    def from_header(cls, header: str | dict, tile: tuple[int, int] | None = None) -> Geometry:
        """From FITS cards (text of 80-character cards or lines, or a dict); degrees become radians.

        Longitude may be either axis.  The native pole must stand where it stands
        by default, as the rotations here have no other; else ValueError.
        """
        cards = header if isinstance(header, dict) else read_cards(header)
        kinds = [str(cards[f"CTYPE{k}"]).strip() for k in (1, 2)]
        system = kinds[0][-3:]
        if kinds[1][-3:] != system or system not in ("CAR", "CEA", "TAN", "SIN", "ARC", "ZEA"):
            raise ValueError(f"no such system: {kinds[0]}, {kinds[1]}")
        lat = [k for k, v in enumerate(kinds, 1) if v.startswith(("DEC", "GLAT", "ELAT"))]
        if len(lat) != 1:
            raise ValueError("one axis must be latitude")
        lat = lat[0]
        lon = 3 - lat
        get = lambda name, k, v=0.0: float(cards.get(f"{name}{k}", v))
        lon0, lat0 = get("CRVAL", lon), get("CRVAL", lat)
        cylinder = system in ("CAR", "CEA")
        usual = {180.0} if not cylinder else {180.0} if lat0 > 0 else {0.0} if lat0 < 0 else {0.0, 180.0}
        default = 0.0 if cylinder and lat0 >= 0 or not cylinder and lat0 >= 90 else 180.0
        if float(cards.get("LONPOLE", 0.0 if cylinder and not lat0 else default)) not in usual:
            raise ValueError("the native pole is turned")
        pixels = sky.FlatPixels(int(cards[f"NAXIS{lat}"]), int(cards[f"NAXIS{lon}"]), radians(get("CDELT", lat, 1.0)), radians(get("CDELT", lon, 1.0)), get("CRPIX", lat), get("CRPIX", lon))
        return cls(system, radians(lon0), radians(lat0), pixels, tile)


def read_cards(text: str) -> dict:
    """Values of FITS cards by keyword: quoted text, numbers (also with D exponents) and logical values; comments are left out."""
    lines = text.splitlines() if "\n" in text else [text[k : k + 80] for k in range(0, len(text), 80)]
    out = {}
    for line in lines:
        key, mark, rest = line.partition("=")
        if not mark or not key.strip() or len(key) > 8:
            continue
        rest = rest.strip()
        if rest.startswith("'"):
            out[key.strip()] = rest[1:].replace("''", "\0").partition("'")[0].replace("\0", "'").rstrip()
            continue
        value = rest.partition("/")[0].strip()
        out[key.strip()] = value == "T" if value in ("T", "F") else float(value.replace("D", "E").replace("d", "e")) if value else None
    return out


KEY = ["iy", "ix"]
#: A flat map up to this size may be broadcast.
BROADCAST_BYTES = 32 << 20


def with_coords(asm: DataFrame, system: str) -> DataFrame:
    """Assembly with x, y, cpsi, spsi in place of its quaternion."""
    s = Steps(asm)
    got = s.keep(*sky.coords(system, tuple(F.col(f"q{n}") for n in "abcd")))
    return s.done(**dict(zip(("x", "y", "cpsi", "spsi"), got))).drop("qa", "qb", "qc", "qd")


def factors(components: str) -> list[str]:
    return [f"f{c}" for c in sky.COMPONENTS[components]]


def with_spin(df: DataFrame, components: str) -> DataFrame:
    got = sky.spin(components, (F.col("cpsi"), F.col("spsi")), (F.col("resp_t"), F.col("resp_p")))
    return df.select("*", *[c.alias(n) for c, n in zip(got, factors(components))])


def pointing(asm: DataFrame, geom: Geometry, components: str, interpolation: str = "nearest", off_map: bool = False) -> DataFrame:
    """The pointing matrix: det, samp, iy, ix, w and the factors; off-map samples are left out, or kept without a pixel of the map.

    Persist it to use it more than once.
    """
    at = with_spin(with_coords(asm, geom.system), components)
    if interpolation in ("nn", "nearest"):
        s = Steps(at)
        iy, ix = geom.pixels.pixel(F.col("x"), F.col("y"))
        if off_map:
            iy, ix = s.keep(iy, ix)
            at = s.done(iy=iy, ix=ix, w=F.lit(1.0))
        else:
            # a filter on iy would be moved below the coordinates, written out in full, into the join with the detectors
            on = F.explode(F.when(iy >= 0, F.array(F.struct(iy.alias("iy"), ix.alias("ix")))))
            at = at.select("*", on.alias("p")).select("*", "p.iy", "p.ix", F.lit(1.0).alias("w")).drop("p")
    elif interpolation in ("lin", "bilinear"):
        at = at.select("*", (F.explode_outer if off_map else F.explode)(geom.pixels.bilinear(F.col("x"), F.col("y"))).alias("p")).select("*", "p.iy", "p.ix", "p.w").drop("p")
    else:
        raise ValueError(f"no such interpolation: {interpolation}")
    if geom.tile:
        at = at.withColumn("tile", geom.pixels.tile(F.col("iy"), F.col("ix"), *geom.tile))
    return at.drop("x", "y", "cpsi", "spsi", "resp_t", "resp_p")


def healpix_pointing(asm: DataFrame, nside: int, components: str, nest: bool = True, nside_tile: int | None = None) -> DataFrame:
    """The pointing matrix on HEALPix pixels (pix; tile too, if tiled, which needs nest)."""
    if nside_tile and (not nest or nside_tile > nside):
        raise ValueError("tiles need nested order and nside_tile <= nside")
    at = with_spin(with_coords(asm, "CAR"), components)
    at = healpix.ang2pix(at, "x", "y", nside, nest).withColumn("w", F.lit(1.0))
    if nside_tile:
        at = at.withColumn("tile", F.floor(F.col("pix") / (nside // nside_tile) ** 2).cast("long"))
    return at.drop("x", "y", "cpsi", "spsi", "resp_t", "resp_p")


def _weighted(pointed: DataFrame, weights: DataFrame | None) -> DataFrame:
    """Detector weights (det, wt); none: 1.  Detectors of weight zero are left out."""
    if weights is None:
        return pointed.withColumn("wt", F.lit(1.0))
    return pointed.join(weights.select("det", "wt").where("wt <> 0"), "det")


def to_map(pointed: DataFrame, components: str, weights: DataFrame | None = None, onto: DataFrame | None = None, key: list[str] | None = None, signal: DataFrame | None = None) -> DataFrame:
    """Adds the samples' values into a map: a column `signal` of the pointed samples, or signal(det, samp, y); onto is a map to add to."""
    key = key or KEY
    rows = _weighted(pointed, weights)
    if signal is not None:
        rows = rows.join(signal.select("det", "samp", F.col("y").alias("signal")), ["det", "samp"])
    names = sky.COMPONENTS[components]
    part = rows.groupBy(*key).agg(*[F.sum(F.col("signal") * F.col(f"f{c}") * F.col("w") * F.col("wt")).alias(c) for c in names])
    if onto is None:
        return part
    return part.unionByName(onto.select(*part.columns)).groupBy(*key).agg(*[F.sum(c).alias(c) for c in names])


def to_weights(pointed: DataFrame, components: str, weights: DataFrame | None = None, key: list[str] | None = None) -> DataFrame:
    """Upper triangle of the weight matrix of each pixel: wTT, wTQ, ..."""
    names = sky.COMPONENTS[components]
    rows = _weighted(pointed, weights)
    value = lambda a, b: F.sum(F.col(f"f{a}") * F.col(f"f{b}") * F.col("w") * F.col("w") * F.col("wt"))
    return rows.groupBy(*(key or KEY)).agg(*[value(a, b).alias(f"w{a}{b}") for i, a in enumerate(names) for b in names[i:]])


def to_map_and_weights(pointed: DataFrame, components: str, weights: DataFrame | None = None, key: list[str] | None = None) -> DataFrame:
    """Map and weight matrix in one pass over pointed samples that carry their value in a column `signal`."""
    names = sky.COMPONENTS[components]
    rows = _weighted(pointed, weights)
    sums = [F.sum(F.col("signal") * F.col(f"f{c}") * F.col("w") * F.col("wt")).alias(c) for c in names]
    value = lambda a, b: F.sum(F.col(f"f{a}") * F.col(f"f{b}") * F.col("w") * F.col("w") * F.col("wt"))
    return rows.groupBy(*(key or KEY)).agg(*sums, *[value(a, b).alias(f"w{a}{b}") for i, a in enumerate(names) for b in names[i:]])


def small_map(geom: Geometry, components: str) -> bool:
    """Whether a whole map of this geometry is small enough to be sent to all executors."""
    return geom.pixels.ny * geom.pixels.nx * 8 * (2 + len(components)) <= BROADCAST_BYTES


def from_map(pointed: DataFrame, sky_map: DataFrame, components: str, geom: Geometry | None = None, interpolation: str = "nearest", key: list[str] | None = None) -> DataFrame:
    """det, samp, y: the samples' column `signal` plus what each sees of the map; off-map samples (pointing with off_map) see nothing.

    A map that its geometry proves small is sent to the samples; otherwise
    samples meet it by pixel, where hot pixels can be split.
    """
    names = sky.COMPONENTS[components]
    if geom is not None and small_map(geom, components):
        sky_map = F.broadcast(sky_map)
    seen = pointed.join(sky_map, key or KEY, "left")
    total = sum((F.col(f"f{c}") * F.col(c) for c in names[1:]), F.col(f"f{names[0]}") * F.col(names[0])) * F.col("w")
    if interpolation in ("lin", "bilinear"):
        return seen.groupBy("det", "samp").agg((F.first("signal") + F.coalesce(F.sum(total), F.lit(0.0))).alias("y"))
    return seen.select("det", "samp", (F.col("signal") + F.coalesce(total, F.lit(0.0))).alias("y"))


def solve_tqu(sky_map: DataFrame, weights: DataFrame | None = None, key: list[str] | None = None, least: float = 1e-6) -> DataFrame:
    """Map divided by its 3x3 weights through the adjugate; pixels with a determinant below `least` are left out.

    Without `weights` the map carries its weights itself.
    """
    s = Steps(sky_map if weights is None else sky_map.join(weights, key or KEY))
    a, b, c, d, e, f = (F.col(f"w{n}") for n in ("TT", "TQ", "TU", "QQ", "QU", "UU"))
    k0, k1, k2 = s.keep(d * f - e * e, c * e - b * f, b * e - c * d)
    k3, k4, k5 = s.keep(a * f - c * c, b * c - a * e, a * d - b * b)
    (det,) = s.keep(a * k0 + b * k1 + c * k2)
    t, q, u = F.col("T"), F.col("Q"), F.col("U")
    s.df = s.df.where(det > least)
    return s.done(T=(k0 * t + k1 * q + k2 * u) / det, Q=(k1 * t + k3 * q + k4 * u) / det, U=(k2 * t + k4 * q + k5 * u) / det).select(*(key or KEY), "T", "Q", "U")


def pinv_tqu(sky_map: DataFrame, weights: DataFrame | None = None, key: list[str] | None = None, least: float = 1e-6) -> DataFrame:
    """Map times the pseudo-inverse of its 3x3 weights: pixels seen from too few angles keep what can be told.

    The rank is judged by the invariants of the weights against their trace:
    eigenvalues whose product is below `least` of it (cubed, squared) count as
    missing ones.  With two of them, W+ = ((e1^2 - e2) W - e1 W^2) / e2^2, which
    follows from W's characteristic polynomial on its range, and with one W / e1^2.
    """
    s = Steps(sky_map if weights is None else sky_map.join(weights, key or KEY))
    a, b, c, d, e, f = (F.col(f"w{n}") for n in ("TT", "TQ", "TU", "QQ", "QU", "UU"))
    k0, k1, k2 = s.keep(d * f - e * e, c * e - b * f, b * e - c * d)
    k3, k4, k5 = s.keep(a * f - c * c, b * c - a * e, a * d - b * b)
    det, e1, e2 = s.keep(a * k0 + b * k1 + c * k2, a + d + f, k0 + k3 + k5)
    rank = F.when(det > least * e1 * e1 * e1, 3).when(e2 > least * e1 * e1, 2).when(e1 > 0, 1).otherwise(0)
    (rank,) = s.keep(rank)
    t, q, u = F.col("T"), F.col("Q"), F.col("U")
    w1 = s.keep(a * t + b * q + c * u, b * t + d * q + e * u, c * t + e * q + f * u)
    w2 = s.keep(a * w1[0] + b * w1[1] + c * w1[2], b * w1[0] + d * w1[1] + e * w1[2], c * w1[0] + e * w1[1] + f * w1[2])
    full = (k0 * t + k1 * q + k2 * u, k1 * t + k3 * q + k4 * u, k2 * t + k4 * q + k5 * u)
    solved = [F.when(rank == 3, x / det).when(rank == 2, ((e1 * e1 - e2) * y - e1 * z) / (e2 * e2)).when(rank == 1, y / (e1 * e1)).otherwise(0.0) for x, y, z in zip(full, w1, w2)]
    return s.done(rank=rank, T=solved[0], Q=solved[1], U=solved[2]).select(*(key or KEY), "rank", "T", "Q", "U")


def pair_difference(signal: DataFrame) -> DataFrame:
    """Sums and differences of detectors 2k and 2k + 1: pair, samp, total, diff."""
    by = F.floor(F.col("det") / 2).cast("long")
    even = F.col("det") % 2 == 0
    pairs = signal.groupBy(by.alias("pair"), "samp").agg(F.max(F.when(even, F.col("y"))).alias("a"), F.max(F.when(~even, F.col("y"))).alias("b"))
    return pairs.where("a is not null and b is not null").select("pair", "samp", ((F.col("a") + F.col("b")) / 2).alias("total"), ((F.col("a") - F.col("b")) / 2).alias("diff"))


def restricted(pointed: DataFrame, keep: DataFrame) -> DataFrame:
    """Only samples inside ranges (det, s, e)."""
    return ranges.inside(pointed, keep, ["det"], ["det"], "left_semi")


def promoted(ranges_: DataFrame | None, dets: DataFrame) -> DataFrame:
    """bunch, domain, det, s, e from ranges with one, two or three of those levels (dets: det, n); None is everything.

    Bunches are worked one after the other and the domains of a bunch side by side;
    a level that is missing has the one number 0.  A detector that is not there, or
    a range beyond its samples, is a ValueError.
    """
    if ranges_ is None:
        ranges_ = dets.select("det", F.lit(0).alias("s"), F.col("n").alias("e"))
    for level in ("domain", "bunch"):
        if level not in ranges_.columns:
            ranges_ = ranges_.withColumn(level, F.lit(0))
    out = ranges_.select("bunch", "domain", "det", "s", "e").where("s < e")
    if not out.join(dets.select("det", "n"), "det", "left").where("n is null or s < 0 or e > n").limit(1).isEmpty():
        raise ValueError("ranges do not agree with the detectors' samples")
    return out


def bunched(pointed: DataFrame, nested: DataFrame) -> DataFrame:
    """Pointed samples with the bunch and domain that they are worked in; a sample in several of them comes once for each."""
    return ranges.inside(pointed, nested, ["bunch", "domain", "det"], ["det"])


def components_of(maps: int) -> str:
    """Components of a map with so many planes."""
    names = {len(v): k for k, v in sky.COMPONENTS.items()}
    if maps not in names:
        raise ValueError(f"no components for {maps} maps")
    return names[maps]


def map_like(spark, geom: Geometry, components: str) -> DataFrame:
    """A map of zeros: every pixel with its tile, if tiled, and one column for each component."""
    out = blank(spark, geom).select("*", *[F.lit(0.0).alias(c) for c in sky.COMPONENTS[components]])
    return out.withColumn("tile", geom.pixels.tile(F.col("iy"), F.col("ix"), *geom.tile)) if geom.tile else out


def for_source_at(lon: float, lat: float, gamma: float, pixels: sky.FlatPixels, system: str = "TAN") -> tuple[Geometry, tuple[float, float, float, float]]:
    """A map around a source at (lon, lat): its geometry about (0, 0), and the rotation (for `assembly`) that brings the source there and turns by gamma about it."""
    if system not in ("TAN", "SIN", "ARC", "ZEA", "CAR", "CEA"):
        raise ValueError(f"no such system: {system}")
    turn = [1.0, 0.0, 0.0, 0.0]
    for axis, angle in ((0, gamma), (1, lat), (2, -lon)):
        r = [cos(angle / 2), 0.0, 0.0, 0.0]
        r[axis + 1] = sin(angle / 2)
        turn = [
            turn[0] * r[0] - turn[1] * r[1] - turn[2] * r[2] - turn[3] * r[3],
            turn[0] * r[1] + turn[1] * r[0] + turn[2] * r[3] - turn[3] * r[2],
            turn[0] * r[2] - turn[1] * r[3] + turn[2] * r[0] + turn[3] * r[1],
            turn[0] * r[3] + turn[1] * r[2] - turn[2] * r[1] + turn[3] * r[0],
        ]
    return Geometry(system, 0.0, 0.0, pixels), tuple(turn)


def check_signal(signal: DataFrame, pointed: DataFrame) -> DataFrame:
    """signal, if it has one number for each pointed sample; else a ValueError."""
    kinds = dict(signal.dtypes)
    if kinds.get("y") not in ("float", "double") or "det" not in kinds or "samp" not in kinds:
        raise ValueError("a signal has det, samp and a float y")
    if not signal.groupBy("det", "samp").count().where("count > 1").isEmpty():
        raise ValueError("a sample has two values")
    if not pointed.select("det", "samp").join(signal, ["det", "samp"], "left_anti").isEmpty():
        raise ValueError("a pointed sample has no value")
    return signal


def blank(spark, geom: Geometry) -> DataFrame:
    """Every pixel of a flat map."""
    nx = geom.pixels.nx
    return spark.range(geom.pixels.ny * nx).select(F.floor(F.col("id") / nx).cast("long").alias("iy"), (F.col("id") % nx).alias("ix"))


# ---- tiles and work domains ----


def only_active(pointed: DataFrame, tiles: DataFrame) -> DataFrame:
    """pointed, if all its tiles are among the active ones (tiles: tile); a sample on another tile is a RuntimeError."""
    lost = pointed.select("tile").distinct().join(tiles.select("tile"), "tile", "left_anti").limit(1).collect()
    if lost:
        raise RuntimeError(f"tile {lost[0]['tile']} is not active")
    return pointed


def tile_hits(pointed: DataFrame) -> DataFrame:
    """Samples (times interpolation points) that fall into each tile."""
    if "tile" not in pointed.columns:
        raise RuntimeError("the map is not tiled")
    return pointed.groupBy("tile").agg(F.count("*").alias("hits"))


def active_tiles(hits: DataFrame, groups: int) -> DataFrame:
    """Tiles with their group: largest first, each to the group with least so far (one row a tile; decided on the driver)."""
    load, rows = [0] * groups, []
    for r in hits.orderBy(F.desc("hits"), "tile").collect():
        g = load.index(min(load))
        load[g] += r["hits"]
        rows.append((r["tile"], r["hits"], g))
    return hits.sparkSession.createDataFrame(rows, "tile long, hits long, grp long")


def domain_ranges(pointed: DataFrame, domain: Column) -> DataFrame:
    """Ranges of consecutive samples of each detector in one work domain; samples that touch several are in domain -1."""
    one = pointed.withColumn("domain", domain).groupBy("det", "samp").agg(F.min("domain").alias("lo"), F.max("domain").alias("hi"))
    one = one.select("det", "samp", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(-1).alias("domain"))
    return ranges.from_mask(one, ["det", "domain"], F.lit(True))


def tile_ranges(pointed: DataFrame, groups: DataFrame) -> DataFrame:
    """domain_ranges by the group of each sample's tile (groups: tile, grp); samples of unlisted tiles are left out."""
    listed = pointed.join(groups.select("tile", "grp"), "tile")
    return domain_ranges(listed, F.col("grp"))


def mapped_ranges(pointed: DataFrame, domain_map: DataFrame, key: list[str] | None = None) -> DataFrame:
    """domain_ranges by a map of domains (key..., domain)."""
    return domain_ranges(pointed.join(domain_map.withColumnRenamed("domain", "dom"), key or KEY), F.col("dom"))


def dominant_direction(hits: DataFrame) -> float:
    """Angle of the scan in the map: half the angle of the summed Q and U of unit hits."""
    r = hits.agg(F.sum("Q").alias("q"), F.sum("U").alias("u")).first()
    from math import atan2

    return 0.5 * atan2(r["u"] or 0.0, r["q"] or 0.0)


def direction_bins(pointed: DataFrame, angle: float, n: int, bins: int = 200) -> DataFrame:
    """Domains of about equal hits, as bands along a direction: det, samp, domain.

    The distance from the band axis is cut into `bins` steps; their running share
    of all hits gives the domain.
    """
    s = Steps(pointed)
    (d,) = s.keep(F.col("iy") * sin(angle) - F.col("ix") * cos(angle))
    placed = s.done(d=d)
    ends = placed.agg(F.min("d").alias("lo"), F.max("d").alias("hi")).first()
    if ends["lo"] is None:
        return placed.select("det", "samp", F.lit(0).cast("long").alias("domain"))
    width = (ends["hi"] - ends["lo"]) / bins or 1.0
    placed = placed.withColumn("bin", F.least(F.floor((F.col("d") - ends["lo"]) / width), F.lit(bins - 1)))
    # `bins` rows at most
    hist = placed.groupBy("bin").agg(F.count("*").alias("hits"))
    order = Window.partitionBy(F.lit(0)).orderBy("bin")
    share = F.sum("hits").over(order) / F.sum("hits").over(Window.partitionBy(F.lit(0)))
    hist = hist.withColumn("domain", F.least(F.floor((share - 1e-5) * n), F.lit(n - 1)).cast("long"))
    return placed.join(F.broadcast(hist.select("bin", "domain")), "bin").select("det", "samp", "domain")


def assign_threads(pointed: DataFrame, method: str, n: int, geom: Geometry | None = None, angle: float | None = None, nside: int | None = None) -> DataFrame:
    """Sample ranges of n domains by stripes of columns (of pixel numbers on HEALPix: nside), bands along the scan, or tiles."""
    if method == "simple":
        if geom is None and nside is None:
            raise ValueError("stripes need a flat geometry or nside")
        return domain_ranges(pointed, geom.pixels.stripe(F.col("ix"), n) if geom else F.floor(F.col("pix") * n / healpix.n_pixels(nside)).cast("long"))
    if method == "domdir":
        return domain_ranges(direction_bins(pointed, angle or 0.0, n), F.col("domain"))
    if method == "tiles":
        return tile_ranges(pointed, active_tiles(tile_hits(pointed), n))
    raise ValueError(f"no such method: {method}")


def compute_nside_tile(active: int, active_nside: int, threads: int, nside: int, per_thread: int = 5) -> int:
    """Smallest power of 2 (nside at most) with `per_thread` active tiles for each thread, from the tiles hit at a coarse size."""
    sky_share = active / (12 * active_nside**2)
    return min(nside, int(2 ** ceil(0.5 * log2(per_thread * threads / (12 * sky_share)))))


def pixel_side(nside: int) -> float:
    return sqrt(4 * pi / (12 * nside * nside))
