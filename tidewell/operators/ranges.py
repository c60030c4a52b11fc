"""Algebra of half-open ranges s <= x < e per key, on tables (keys..., s, e).

The same functions serve sample ranges (domain 0..n from a spine keys..., n),
interval sets on any ordered domain (spine keys..., lo, hi) and grids of ranges
(more key columns).  Set operations sweep the sorted boundaries of both sides
once, so nothing is compared pairwise.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan
from .runs import BROADCAST_ROWS

#: Samples of a piece of a range that rows are looked up in.
PIECE = 64


def merged(ranges: DataFrame, keys: list[str], gap: int = 0, size: int = scan.ROWS) -> DataFrame:
    """Sorted, disjoint ranges; ranges at most `gap` apart become one, touching ones always do.

    Blocks of a key are merged apart and then stitched, so a long detector is not one task.
    """
    cut = scan.blocked(ranges.select(*keys, "s", "e").where(F.col("s") < F.col("e")), keys, "s", size)
    order = Window.partitionBy(*keys, "blk").orderBy("s", "e")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(before.isNull() | (F.col("s") > F.col("before") + gap), 1).otherwise(0)).over(order)
    inside = cut.withColumn("before", before).withColumn("island", island).groupBy(*keys, "blk", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return _stitched(inside, keys, gap)


def _stitched(inside: DataFrame, keys: list[str], gap: int = 0) -> DataFrame:
    """Ranges from those of single blocks (keys, blk, s, e), which are disjoint within their block."""
    return rooted(inside, keys, gap).groupBy(*keys, "root").agg(F.max("e").alias("e")).select(*keys, F.col("root").alias("s"), "e")


def rooted(inside: DataFrame, keys: list[str], gap: int = 0) -> DataFrame:
    """inside with root, where the range begins that a block's range is part of.

    A block's first ranges may lie within reach of what an earlier block's ranges
    cover; they belong to the last range that began before without being reached.
    """
    # one row a block; the blocks are read twice, by one exchange
    order = Window.partitionBy(*keys).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    edges = inside.groupBy(*keys, "blk").agg(F.max("s").alias("last"), F.max("e").alias("top")).withColumn("reach", F.max("top").over(order))
    begun = F.when(F.col("reach").isNull() | (F.col("last") > F.col("reach") + gap), F.col("last"))
    edges = edges.withColumn("own", begun).withColumn("begun", F.max("own").over(order)).select(*keys, "blk", "reach", "begun")
    both = attached_blocks(inside, edges, keys)
    root = F.when(F.col("reach").isNull() | (F.col("s") > F.col("reach") + gap), F.col("s")).otherwise(F.col("begun"))
    return both.withColumn("root", root).drop("reach", "begun")


def attached_blocks(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    return scan.attached(rows, table, [*keys, "blk"])


def clipped(ranges: DataFrame, domain: DataFrame, keys: list[str], lo: str = "0", hi: str = "n") -> DataFrame:
    """Ranges cut to their key's domain; keys outside the domain table go."""
    joined = ranges.join(domain, keys).withColumn("s", F.greatest("s", F.expr(lo))).withColumn("e", F.least("e", F.expr(hi)))
    return joined.where("s < e").select(*keys, "s", "e")


def cleanup(ranges: DataFrame, domain: DataFrame, keys: list[str], lo: str = "0", hi: str = "n") -> DataFrame:
    return merged(clipped(ranges, domain, keys, lo, hi), keys)


def add(ranges: DataFrame, new: DataFrame, domain: DataFrame, keys: list[str], lo: str = "0", hi: str = "n") -> DataFrame:
    return cleanup(ranges.unionByName(new), domain, keys, lo, hi)


def union(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return merged(a.select(*keys, "s", "e").unionByName(b.select(*keys, "s", "e")), keys)


def combined(a: DataFrame, b: DataFrame, keys: list[str], rule, size: int = scan.ROWS) -> DataFrame:
    """Where rule(in a, in b) holds, by one sweep over all boundaries; rule must be false outside both."""

    def edges(r: DataFrame, da: int, db: int) -> DataFrame:
        up = r.select(*keys, F.col("s").alias("x"), F.lit(da).alias("da"), F.lit(db).alias("db"))
        return up.unionByName(r.select(*keys, F.col("e").alias("x"), F.lit(-da).alias("da"), F.lit(-db).alias("db")))

    steps = edges(a, 1, 0).unionByName(edges(b, 0, 1)).groupBy(*keys, "x").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    cut = scan.blocked(steps, keys, "x", size)
    order = Window.partitionBy(*keys, "blk").orderBy("x")
    walked = cut.select(*keys, "blk", F.col("x").alias("s"), F.lead("x").over(order).alias("e"), F.sum("da").over(order).alias("na"), F.sum("db").over(order).alias("nb"))
    edge = scan.carried(cut, keys, {"pa": (F.sum("da"), "sum"), "pb": (F.sum("db"), "sum"), "next": (F.min("x"), "first")})
    both = attached_blocks(walked, edge, keys).withColumn("e", F.coalesce("e", "next"))
    inside = rule(F.coalesce("pa", F.lit(0)) + F.col("na") > 0, F.coalesce("pb", F.lit(0)) + F.col("nb") > 0)
    return _stitched(_glued(both.where(F.col("e").isNotNull() & inside).select(*keys, "blk", "s", "e"), keys), keys)


def _glued(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Touching pieces of one block as one range (pieces: keys, blk, s, e, disjoint)."""
    order = Window.partitionBy(*keys, "blk").orderBy("s")
    first = F.when(F.col("s") == F.lag("e").over(order), 0).otherwise(1)
    return pieces.withColumn("first", first).withColumn("island", F.sum("first").over(order)).groupBy(*keys, "blk", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))


def intersection(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return combined(a, b, keys, lambda x, y: x & y)


def difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Set difference."""
    return combined(a, b, keys, lambda x, y: x & ~y)


def complement(ranges: DataFrame, domain: DataFrame, keys: list[str], lo: str = "0", hi: str = "n") -> DataFrame:
    """The rest of every key's domain, keys without ranges included."""
    whole = domain.select(*keys, F.expr(lo).alias("s"), F.expr(hi).alias("e")).where("s < e")
    return difference(whole, clipped(ranges, domain, keys, lo, hi), keys)


def minus_compat(a: DataFrame, b: DataFrame, domain: DataFrame, keys: list[str], lo: str = "0", hi: str = "n") -> DataFrame:
    """The operator written a - b: a united with the complement of b."""
    return union(a, complement(b, domain, keys, lo, hi), keys)


def meet_domains(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Domain of a merged set: the overlap of both, never inverted."""
    both = a.join(b.select(*keys, F.col("lo").alias("lo2"), F.col("hi").alias("hi2")), keys)
    low = F.greatest("lo", "lo2")
    return both.select(*keys, low.alias("lo"), F.greatest(low, F.least("hi", "hi2")).alias("hi"))


def buffered(ranges: DataFrame, domain: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Widened on both sides (narrowed, if negative)."""
    return cleanup(ranges.select(*keys, (F.col("s") - width).alias("s"), (F.col("e") + width).alias("e")), domain, keys)


def close_gaps(ranges: DataFrame, domain: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Merges ranges at most `gap` apart, and draws ends within `gap` of the domain's edge to it."""
    joined = merged(ranges, keys, gap).join(domain, keys)
    return joined.select(*keys, F.when(F.col("s") <= gap, F.lit(0)).otherwise(F.col("s")).alias("s"), F.when(F.col("n") - F.col("e") <= gap, F.col("n")).otherwise(F.col("e")).alias("e"))


def sliced(ranges: DataFrame, domain: DataFrame, keys: list[str], start: int | None, stop: int | None) -> tuple[DataFrame, DataFrame]:
    """Ranges and domain of samples [start, stop), moved to a new origin; negatives count from the end."""
    edge = lambda v, default: F.expr(default) if v is None else F.least(F.greatest(F.lit(v) + (F.col("n") if v < 0 else 0), F.lit(0)), F.col("n"))
    cut = domain.withColumn("a", edge(start, "0")).withColumn("z", F.greatest(F.col("a"), edge(stop, "n")))
    moved = ranges.join(cut, keys).select(*keys, (F.greatest("s", "a") - F.col("a")).alias("s"), (F.least("e", "z") - F.col("a")).alias("e")).where("s < e")
    return moved, cut.select(*keys, (F.col("z") - F.col("a")).alias("n"))


def stats(ranges: DataFrame, domain: DataFrame, keys: list[str]) -> DataFrame:
    """Samples flagged and number of ranges of every key."""
    sums = ranges.groupBy(*keys).agg(F.sum(F.col("e") - F.col("s")).alias("samples"), F.count("*").alias("intervals"))
    return domain.select(*keys).join(sums, keys, "left").fillna(0, ["samples", "intervals"])


def from_mask(flags: DataFrame, keys: list[str], flag: Column, order: str = "samp", size: int = scan.ROWS) -> DataFrame:
    """Runs of consecutive samples where the flag holds; blocks of samples are looked at apart and then stitched."""
    on = flags.where(flag).select(*keys, order)
    if dict(on.dtypes)[order] not in scan.WHOLE:
        on = on.withColumn(order, F.col(order).cast("long"))
    cut = scan.blocked(on, keys, order, size)
    run = F.col(order) - F.row_number().over(Window.partitionBy(*keys, "blk").orderBy(order))
    inside = cut.withColumn("run", run).groupBy(*keys, "blk", "run").agg(F.min(order).alias("s"), (F.max(order) + 1).alias("e"))
    return _stitched(inside, keys)


def flagged_samples(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """keys..., samp of every sample inside a range."""
    return ranges.where("s < e").select(*keys, F.explode(F.sequence("s", F.col("e") - 1)).alias("samp")).distinct()


def inside(rows: DataFrame, ranges: DataFrame, keys: list[str], on: list[str], how: str = "inner", size: int = PIECE) -> DataFrame:
    """rows(on..., samp, ...) joined (inner or left_semi) to the keys of the ranges that hold their sample, once for each key.

    Ranges are cut at multiples of `size` samples and meet the rows of the same
    piece, so a range is never spread to its samples.  How many pieces there are
    can't be told from the ranges' bytes: the join is sorted, never broadcast.
    """
    cut = merged(ranges, keys).withColumn("piece", F.explode(F.sequence(F.floor(F.col("s") / size), F.floor((F.col("e") - 1) / size))))
    cut = cut.select(*[F.col(k).alias(f"{k} of range") if k in on else F.col(k) for k in keys], F.col("piece").alias("piece of range"), "s", "e").hint("merge")
    here = rows.withColumn("piece", F.floor(F.col("samp") / size))
    same = (F.col("piece") == F.col("piece of range")) & (F.col("samp") >= F.col("s")) & (F.col("samp") < F.col("e"))
    for k in on:
        same = same & (F.col(k) == F.col(f"{k} of range"))
    return here.join(cut, same, how).drop("piece", "piece of range", "s", "e", *[f"{k} of range" for k in on])


def to_mask(ranges: DataFrame, domain: DataFrame, keys: list[str]) -> DataFrame:
    """Every sample of the domain with its flag; ranges are spread to samples and joined on equality."""
    spread = domain.where("n > 0").select(*keys, F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("samp"))
    on = flagged_samples(ranges, keys).withColumn("flag", F.lit(1))
    return spread.join(on, [*keys, "samp"], "left").fillna(0, ["flag"])


def from_bitmask(masks: DataFrame, keys: list[str], bits: int, mask: str = "mask") -> DataFrame:
    """Ranges of every set bit (column bit)."""
    spread = masks.select(*keys, "samp", mask, F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("bit"))
    return from_mask(spread.where(F.expr(f"getbit({mask}, bit) = 1")), [*keys, "bit"], F.lit(True))


def to_bitmask(ranges: DataFrame, domain: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """Every sample with its mask; a bit column names the bit of each range.

    Bit 63 is the sign bit of the result.
    """
    if bits > 64:
        raise ValueError("at most 64 bits")
    on = flagged_samples(ranges, [*keys, "bit"]).groupBy(*keys, "samp").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("mask"))
    spread = domain.where("n > 0").select(*keys, F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("samp"))
    return spread.join(on, [*keys, "samp"], "left").fillna(0, ["mask"])


def zeros_like(domain: DataFrame, keys: list[str]) -> DataFrame:
    return domain.where(F.lit(False)).select(*keys, F.lit(0).alias("s"), F.col("n").alias("e"))


def ones_like(domain: DataFrame, keys: list[str]) -> DataFrame:
    return domain.where("n > 0").select(*keys, F.lit(0).alias("s"), F.col("n").alias("e"))


def concatenated(parts: list[tuple[DataFrame, DataFrame]], keys: list[str], axis: str = "samp") -> tuple[DataFrame, DataFrame]:
    """Joins (ranges, domain) pairs along the sample axis, or along a key column numbered from 0.

    Along the sample axis all parts need the same keys, else ValueError.
    """
    out, domain = parts[0]
    for ranges, more in parts[1:]:
        if axis == "samp":
            a, b = domain.select(*keys), more.select(*keys)
            if not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty():
                raise ValueError("shapes differ")
            moved = ranges.join(domain, keys).select(*keys, (F.col("s") + F.col("n")).alias("s"), (F.col("e") + F.col("n")).alias("e"))
            out = union(out, moved, keys)
            domain = domain.join(more.withColumnRenamed("n", "n2"), keys).select(*keys, (F.col("n") + F.col("n2")).alias("n"))
        else:
            shift = (domain.agg(F.max(axis)).first()[0] or 0) + 1 if not domain.isEmpty() else 0
            move = lambda d: d.withColumn(axis, F.col(axis) + shift)
            out, domain = out.unionByName(move(ranges)), domain.unionByName(move(more))
    return out, domain


def selected(ranges: DataFrame, picks: DataFrame, key: str) -> DataFrame:
    """Advanced indexing along one key: picks(key, new) lists old indices and the new ones they get."""
    return ranges.join(F.broadcast(picks) if picks.count() <= 100_000 else picks, key).drop(key).withColumnRenamed("new", key)


def broadcast_op(a: DataFrame, b: DataFrame, keys: list[str], shared: list[str], rule) -> DataFrame:
    """A set operation where b lacks some key columns and applies to all their values."""
    full = a.select(*keys).distinct().join(b, shared)
    return combined(a, full.select(*keys, "s", "e"), keys, rule)


def appended(ranges: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new behind ranges as it stands, without cleaning up."""
    return ranges.select(*keys, "s", "e").unionByName(new.select(*keys, "s", "e"))


def to_arrays(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key: its ranges as a sorted array of (s, e)."""
    return ranges.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("ranges"))


def from_arrays(arrays: DataFrame, keys: list[str], domain: DataFrame | None = None) -> DataFrame:
    """Ranges from arrays of (s, e); with a domain they are cleaned up, without it taken as they are."""
    rows = arrays.select(*keys, F.explode("ranges").alias("r")).select(*keys, "r.s", "r.e")
    return rows if domain is None else cleanup(rows, domain, keys)


class Grid:
    """Ranges on a regular grid: key columns number its outer axes, samples are the last axis.

    Every cell has `n` samples.  Indexing follows numpy on the outer axes: whole
    numbers, slices, Ellipsis, None, lists and arrays of whole numbers or booleans
    of any dimension; several arrays are broadcast against each other.  Samples are
    taken by slices of step 1.
    """

    def __init__(self, ranges: DataFrame, keys: list[str], shape: tuple[int, ...], n: int):
        if len(keys) != len(shape):
            raise ValueError("one key column for each outer axis")
        self.ranges, self.keys, self.outer, self.n = ranges.select(*keys, "s", "e"), keys, tuple(shape), n

    @property
    def shape(self) -> tuple[int, ...]:
        return (*self.outer, self.n)

    def __len__(self) -> int:
        return self.shape[0]

    def check(self) -> Grid:
        """A cell or range outside the shape is a ValueError."""
        bad = (F.col("s") < 0) | (F.col("e") > self.n)
        for k, size in zip(self.keys, self.outer):
            bad = bad | (F.col(k) < 0) | (F.col(k) >= size)
        if not self.ranges.where(bad).isEmpty():
            raise ValueError("ranges do not agree with the shape")
        return self

    def __getitem__(self, index) -> Grid:
        spark, out, keys, outer, n = self.ranges.sparkSession, self.ranges, [], [], self.n
        parts, at, arrays = self._read(index)
        if any(v.ndim for v in arrays.values()):
            # index arrays (and whole numbers beside them) go together: one table of the cells they pick, over all their keys
            both = np.broadcast_arrays(*arrays.values())
            places = np.indices(both[0].shape).reshape(both[0].ndim, -1)
            olds, news = [self.keys[a] for a in arrays], self._axis_names(both[0].ndim, [self.keys[a] for a in arrays])
            columns = [*(b.reshape(-1) for b in both), *places]
            fields = [*(f"`{k}` int" for k in olds), *(f"`at {k}` int" for k in news)]
            picks = spark.createDataFrame([tuple(int(v) for v in row) for row in zip(*columns)], ", ".join(fields))
            # as large as the index
            out = out.join(F.broadcast(picks) if both[0].size <= BROADCAST_ROWS else picks, olds).drop(*olds)
            arrived = (news, list(both[0].shape))
        else:
            for a, v in arrays.items():
                out = out.where(F.col(self.keys[a]) == int(v)).drop(self.keys[a])
            arrived, at = ([], []), None
        renamed = [(f"at {k}", k) for k in arrived[0]]
        for k, (kind, axis, what) in enumerate(parts):
            if k == at:
                keys, outer = keys + arrived[0], outer + arrived[1]
            if kind == "new":
                out = out.withColumn(what, F.lit(0))
                keys, outer = [*keys, what], [*outer, 1]
            elif kind == "slice" and axis == len(self.keys):
                if what.step not in (None, 1):
                    raise IndexError("samples are taken by slices of step 1")
                a, z, _ = what.indices(n)
                z = max(a, z)
                out = out.withColumn("s", F.greatest("s", F.lit(a)) - a).withColumn("e", F.least("e", F.lit(z)) - a).where("s < e")
                n = z - a
            elif kind == "slice":
                key, picked = self.keys[axis], range(*what.indices(self.outer[axis]))
                new = F.floor((F.col(key) - picked.start) / picked.step).cast("int")
                inside = F.col(key).between(min(picked), max(picked)) if len(picked) else F.lit(False)
                out = out.where(inside & (F.pmod(F.col(key) - picked.start, F.lit(abs(picked.step))) == 0)).withColumn(key, new)
                keys, outer = [*keys, key], [*outer, len(picked)]
        if at == len(parts):
            keys, outer = keys + arrived[0], outer + arrived[1]
        for old, new in renamed:
            out = out.withColumnRenamed(old, new)
        return Grid(out, keys, tuple(outer), n)

    def _read(self, index) -> tuple[list[tuple], int | None, dict[int, np.ndarray]]:
        """Parts of an index in order (kind, axis, what), where the axes of index arrays come to stand among them, and those arrays by axis."""
        index = list(index) if isinstance(index, tuple) else [index]
        index = [x if x is None or x is Ellipsis or isinstance(x, slice) else np.asarray(x) for x in index]
        for k, x in enumerate(index):
            if isinstance(x, np.ndarray):
                if not x.size and x.dtype == float:
                    index[k] = x = x.astype(int)  # an empty list
                if x.dtype.kind not in "biu" or (x.dtype == bool and not x.ndim):
                    raise IndexError("indices are whole numbers, slices, arrays of either whole numbers or booleans, Ellipsis and None")
        used = sum(x.ndim if isinstance(x, np.ndarray) and x.dtype == bool else x is not None and x is not Ellipsis for x in index)
        if used > len(self.shape) or sum(x is Ellipsis for x in index) > 1:
            raise IndexError("too many indices")
        if not any(x is Ellipsis for x in index):
            index.append(Ellipsis)
        parts, arrays, places, axis = [], {}, [], 0
        for x in index:
            if x is None:
                parts.append(("new", None, self._fresh(parts)))
            elif x is Ellipsis:
                parts.append(("gap", None, None))
                for _ in range(len(self.shape) - used):
                    parts.append(("slice", axis, slice(None)))
                    axis += 1
            elif isinstance(x, slice):
                parts.append(("slice", axis, x))
                axis += 1
            else:
                mask = x.dtype == bool
                if mask and x.shape != self.shape[axis : axis + x.ndim]:
                    raise IndexError("a mask has the shape of the axes that it stands for")
                for v in x.nonzero() if mask else (x,):
                    if axis >= len(self.keys):
                        raise IndexError("samples are taken by slices of step 1")
                    size = self.outer[axis]
                    if ((v < -size) | (v >= size)).any():
                        raise IndexError("index out of range")
                    arrays[axis] = np.where(v < 0, v + size, v)
                    places.append(len(parts))
                    parts.append(("array", axis, None))
                    axis += 1
        # side by side they stay where they are, else they come first
        together = places and places[-1] - places[0] == len(places) - 1
        return parts, (places[0] if together else 0) if places else None, arrays

    def _fresh(self, parts: list[tuple]) -> str:
        taken = {*self.keys, *(p[2] for p in parts if p[0] == "new")}
        return next(f"new{k}" for k in range(len(taken) + 1) if f"new{k}" not in taken)

    def _axis_names(self, count: int, olds: list[str]) -> list[str]:
        """Key columns for the axes of index arrays: the key's own name, if one is enough."""
        return [olds[0]] if count == 1 else [f"{olds[0]}_{k}" for k in range(count)]
