"""Two-level scans, stitched ranges and numpy indexing of grids against plain loops and numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import iir, interp, ranges, scan, storage

KEYS = ["det"]


def joined_up(rows, gap=0):
    out = []
    for k in sorted({r[0] for r in rows}, key=str):
        own = []
        for _, s, e in sorted((r for r in rows if r[0] == k and r[1] < r[2]), key=lambda r: r[1:]):
            if own and s <= own[-1][1] + gap:
                own[-1][1] = max(own[-1][1], e)
            else:
                own.append([s, e])
        out += [(k, s, e) for s, e in own]
    return sorted(out, key=str)


@pytest.mark.parametrize("kind,size", [("int", 8), ("int", 1), ("int", 1 << 16), ("double", 4)])
def test_merged_over_blocks(spark, kind, size):
    """Ranges that reach over many blocks, touch at their edges or lie alone in one."""
    rng = random.Random(size)
    rows = [(rng.choice([1, 2, None]), s, s + rng.choice([0, 1, 3, 40])) for s in (rng.randrange(300) for _ in range(120))]
    if kind == "double":
        rows = [(k, s / 7, e / 7) for k, s, e in rows]
    df = spark.createDataFrame(rows, f"det long, s {kind}, e {kind}")
    for gap in (0, 2):
        got = sorted((tuple(r) for r in ranges.merged(df, KEYS, gap, size).collect()), key=str)
        assert got == joined_up(rows, gap)


@pytest.mark.parametrize("size", [5, 1 << 16])
def test_masks_and_set_operations_over_blocks(spark, size):
    rng = random.Random(4)
    flags = [(d, k, rng.random() < p, rng.random() < 0.8) for d, p in ((1, 0.9), (2, 0.3)) for k in range(120)]
    df = spark.createDataFrame(flags, "det long, samp int, a boolean, b boolean")
    a, b = (ranges.from_mask(df, KEYS, F.col(c), size=size) for c in "ab")

    def samples(r):
        return sorted((x["det"], k) for x in r.collect() for k in range(x["s"], x["e"]))

    assert samples(a) == sorted((d, k) for d, k, x, _ in flags if x)
    assert sorted((tuple(r) for r in a.collect()), key=str) == joined_up([(d, k, k + 1) for d, k, x, _ in flags if x])
    for rule, want in ((lambda x, y: x & y, lambda x, y: x and y), (lambda x, y: x & ~y, lambda x, y: x and not y), (lambda x, y: x != y, lambda x, y: x != y)):
        got = ranges.combined(a, b, KEYS, rule, size)
        on = [(d, k, k + 1) for d, k, x, y in flags if want(x, y)]
        assert sorted((tuple(r) for r in got.collect()), key=str) == joined_up(on)


def test_running_sum_over_blocks(spark):
    rows = [(d, k, float(k % 7) if k % 3 else None) for d in (1, 2) for k in range(200)]
    df = spark.createDataFrame(rows, "det long, samp int, v double")
    got = {(r["det"], r["samp"]): r["total"] for r in scan.running_sum(df, KEYS, "samp", F.col("v"), "total", 16).collect()}
    for d in (1, 2):
        total = np.cumsum([v or 0 for k, _, v in rows if k == d])
        assert [got[d, k] for k in range(200)] == total.tolist()


@pytest.mark.parametrize("size", [3, 1 << 16])
def test_interpolation_over_blocks(spark, size):
    rng = random.Random(2)
    x = sorted(rng.uniform(0, 50) ** 1.5 for _ in range(60))
    knots = [(1, v, rng.random()) for v in x] + [(2, 5.0, 7.0), (3, 1.0, 2.0), (3, 2.0, 4.0)]
    asks = [(d, k, rng.uniform(-20, 400)) for k in range(80) for d in (1, 2, 3)] + [(1, 100, x[7]), (1, 101, x[0]), (1, 102, x[-1]), (4, 0, 1.0)]
    got = interp.interp1d_linear(spark.createDataFrame(knots, "det long, x double, y double"), spark.createDataFrame(asks, "det long, k long, x double"), size)
    y = {(r["det"], r["k"]): r["y"] for r in got.collect()}
    assert len(y) == len(asks)
    for d, k, at in asks:
        own = [(a, b) for e, a, b in knots if e == d]
        if not own:
            assert y[d, k] is None
            continue
        i = min(max(np.searchsorted([a for a, _ in own], at, side="right") - 1, 0), max(len(own) - 2, 0))
        (xa, ya), (xb, yb) = own[i], own[min(i + 1, len(own) - 1)]
        assert y[d, k] == pytest.approx(ya if xa == xb else ya + (yb - ya) * (at - xa) / (xb - xa))


SHAPE, N = (4, 3, 5), 200


@pytest.fixture(scope="module")
def grid(spark):
    """Every cell has one range, which begins at the cell's own number."""
    rows = [(a, b, c, (a * 3 + b) * 5 + c, 100) for a in range(4) for b in range(3) for c in range(5)]
    return ranges.Grid(spark.createDataFrame(rows, "a int, b int, c int, s int, e int"), ["a", "b", "c"], SHAPE, N).check()


def cells(g):
    out = np.full(g.outer, -1)
    for r in g.ranges.collect():
        out[tuple(r[k] for k in g.keys)] = r["s"]
    return out


INDICES = [
    ([0, 1], [1, 2]),
    ([[0, 1], [3, -1]], slice(None), [[4], [0]]),
    (np.int64(1),),
    (slice(None), np.int64(2), np.array([True, False, True, False, True])),
    (np.arange(60).reshape(SHAPE) % 7 == 0,),
    (slice(None), (np.arange(15).reshape(3, 5) % 4 == 1)),
    (np.array([0, 2])[:, None], [0, 1, 2]),
    ([1, 2], None, [0, 1]),
    (None, [1, 2], Ellipsis),
    (slice(3, None, -2), slice(None, None, 2), [4, 4, 0]),
    (0, slice(None), [1, 2]),
    (slice(None), 0, [1, 2]),
    ([], slice(None)),
    (slice(5, 9), slice(None), [0]),
    (-1, -1, -1),
    (Ellipsis, [1], slice(20, 90)),
]


@pytest.mark.parametrize("k", range(len(INDICES)))
def test_grid_index_follows_numpy(grid, k):
    index = INDICES[k]
    samples = np.broadcast_to(np.arange(60).reshape(SHAPE)[..., None], (*SHAPE, N))
    got, want = grid[index], samples[index]
    assert got.shape == want.shape
    shift = 20 if k == len(INDICES) - 1 else 0
    assert cells(got).tolist() == (np.maximum(want[..., 0] - shift, 0) if shift else want[..., 0]).tolist()


def test_random_grid_indices(grid):
    rng = np.random.default_rng(7)
    plain = np.broadcast_to(np.arange(60).reshape(SHAPE)[..., None], (*SHAPE, N))
    for _ in range(12):
        shape = (2,) if rng.random() < 0.5 else (2, 3)
        index = []
        for size in SHAPE:
            index.append([slice(None, None, int(rng.choice([1, 2, -1]))), rng.integers(-size, size, shape), int(rng.integers(size)), rng.integers(0, size, (1,) * len(shape))][rng.integers(4)])
            if rng.random() < 0.2:
                index.append(None)
        got, want = grid[tuple(index)], plain[tuple(index)]
        assert got.shape == want.shape and cells(got).tolist() == want[..., 0].tolist()


def test_grid_index_errors(grid):
    for index in ([7], (0, 0, 0, 0, 0), np.array([True, False]), (Ellipsis, Ellipsis), [0.5], (0, 0, 0, [1]), (0, 0, 0, slice(0, 9, 2))):
        with pytest.raises(IndexError):
            grid[index]


def test_filter_of_many_detectors(spark):
    """The steps over many lanes against the bank that takes one sample after the other."""
    rng = random.Random(6)
    stages = [iir.Biquad(32092, 15750, 14, 3, 5), iir.Biquad(31238, 14895, 14, 3, 12)]
    rows = [(d, k, rng.uniform(-1e6, 1e6)) for d in range(40) for k in range(rng.randint(1, 60)) if k % (d + 1) != 3]
    got = iir.filtered(spark.createDataFrame(rows, "det long, samp int, y double").repartition(7), stages).collect()
    for d in range(40):
        z = [r["z"] for r in sorted((r for r in got if r["det"] == d), key=lambda r: r["samp"])]
        assert z == iir.Bank(stages).apply([y for e, _, y in rows if e == d])


@pytest.mark.parametrize("size", [4, 1 << 16])
def test_branches(spark, size):
    rng = random.Random(9)
    q = {d: [rng.randrange(-3, 4) * (1 << 23) + rng.choice([0, 0, -1, 1, 5000]) for _ in range(60)] for d in (1, 2)} | {3: [1 << 60, 0]}
    stream = spark.createDataFrame([(d, k, v) for d, values in q.items() for k, v in enumerate(values)], "det long, samp int, q long")
    got = {(r["det"], r["samp"]): (r["base"], r["rest"]) for r in storage.split_branches(stream).collect()}
    count = {r["det"]: r["branches"] for r in storage.branch_counts(stream, size).collect()}
    for d, values in q.items():
        base, moves = None, 0
        for k, v in enumerate(values):
            if base is None or not -storage.BRANCH // 2 <= v - base < storage.BRANCH // 2:
                base, moves = (v + storage.BRANCH // 2) // storage.BRANCH * storage.BRANCH, moves + 1
            assert got[d, k] == (base, v - base)
        assert count[d] == moves
