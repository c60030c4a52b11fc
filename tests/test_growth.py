"""Steps whose work must not grow faster than their input, on small tables with blocks cut small."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidewell.sources import detector


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_load_lists_blocks_of_channels(spark, monkeypatch):
    """Channels beyond those with counts are listed out after the last join, so the dense table meets no join."""
    monkeypatch.setattr(detector, "BLOCK_CHANNELS", 3)
    channels = [*range(8), 5, None]
    samples = [(1.0, 2, 7), (1.0, 2, 8), (1.0, 5, None), (2.0, None, 4), (3.0, 99, 1), (9.0, 1, 1)]
    got = detector.load(spark.createDataFrame(samples, "t double, channel long, counts long"), spark.createDataFrame([(c,) for c in channels], "channel long"), 0.0, 5.0)
    want = []
    for t in (1.0, 2.0, 3.0):
        for c in channels:
            met = [k or 0 for u, d, k in samples if u == t and d == c and c is not None] or [0]
            want += [(t, c, k * detector.PHASE) for k in met]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    lines = plan_of(got).splitlines()
    generate = next(k for k, line in enumerate(lines) if "Generate explode(array_except" in line)
    assert not any("Join" in line for line in lines[:generate] if line.index(line.lstrip(" :+-")) < lines[generate].index("Generate") and "Union" not in line)


def test_between_looks_back_only(spark):
    """Windows that run on to their end cost the square of a block; rows of both sides cut the blocks."""
    from math import cos, sin

    from tidewell.plans import pointing

    knots = [(k * 7.0, cos(k * 0.1), 0.0, 0.0, sin(k * 0.1)) for k in range(6)]
    asks = [(k, k * 0.5 - 3.0) for k in range(100)]
    got = pointing.between(spark.createDataFrame(knots, "t double, qa double, qb double, qc double, qd double"), spark.createDataFrame(asks, "samp long, t double"), 10)
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedfollowing" not in text.lower()
    rows = {r["samp"]: r for r in got.collect()}
    assert len(rows) == len(asks)
    for k, t in asks:
        angle = min(max(t, 0.0), 35.0) / 7.0 * 0.1
        assert rows[k]["qa"] == pytest.approx(cos(angle), abs=1e-12) and rows[k]["qd"] == pytest.approx(sin(angle), abs=1e-12)


def test_samples_inside_ranges(spark):
    """Nested ranges over piece edges, overlapping and repeated: each sample once for each bunch and domain, by a sorted join."""
    from tidewell.plans import projection

    rnd = random.Random(3)
    nested = [(b, d, det, s, s + rnd.choice((0, 1, 5, 64, 200))) for b in (0, 1) for d in (0, 1) for det in (0, 1, 2) for s in (rnd.randrange(500) for _ in range(6))]
    nested += nested[:5]
    pointed = [(det, samp, samp * 10 + det) for det in (0, 1, 3) for samp in range(0, 700, 1)]
    want = sorted({(b, d, det, samp, v) for b, d, det, s, e in nested for p, samp, v in pointed if p == det and s <= samp < e})
    p = spark.createDataFrame(pointed, "det long, samp long, v long")
    r = spark.createDataFrame(nested, "bunch int, domain int, det long, s long, e long")
    got = projection.bunched(p, r)
    assert sorted(map(tuple, got.select("bunch", "domain", "det", "samp", "v").collect())) == want
    kept = projection.restricted(p, r.select("det", "s", "e"))
    assert kept.columns == p.columns
    assert sorted(map(tuple, kept.collect())) == sorted({w[2:] for w in want})
    for df in (got, kept):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "explode(sequence(s" not in text and "SortMergeJoin" in text and "BroadcastHashJoin [det" not in text


def test_on_map_test_stays_above_coordinates(spark):
    """Leaving out off-map samples does not put the coordinates' expressions into the join with the detectors."""
    from tidewell.plans import projection, queries_sky

    asm = queries_sky.assembly(spark, "/root/testdata/sf0.001")
    got = projection.pointing(asm, queries_sky.CAR, "T")
    assert not any("Join" in line and "ATAN2" in line.upper() for line in plan_of(got).splitlines())
    every = projection.pointing(asm, queries_sky.CAR, "T", off_map=True)
    assert got.columns == every.columns
    assert sorted(map(tuple, got.select("det", "samp", "iy", "ix", "w").collect())) == sorted(map(tuple, every.where("iy >= 0").select("det", "samp", "iy", "ix", "w").collect()))


def test_grid_as_large_as_its_detectors(spark, tmp_path):
    """Detectors beyond 10000 and samples beyond 10000 are part of the grid."""
    from tidewell import catalog

    busy, far = 57, 123_457
    rows = [(k, busy, 90.0) for k in range(10_050)] + [(20_000 + k, far, 90.0) for k in range(3)]
    e = spark.createDataFrame(rows, "event_id long, user_id long, value double").withColumns({"ts": F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, event_id)"), "event_type": F.lit("view"), "props": F.lit("{}")})
    e.write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in catalog.QUERIES["ranges_grid_index"](spark, str(tmp_path)).select("a", "b", "s", "e").sort("a").collect()] == [(0, 3, 0, 37), (2, 3, 0, 37)]
    assert catalog.QUERIES["ranges_grid_pairs"](spark, str(tmp_path)).collect() == []


def test_jump_that_meets_its_threshold(spark):
    """Half the response met exactly at sample 7 is not passed, in whatever order the samples come (values of sf0.1, detector 776)."""
    from tidewell.operators import reduce

    y = [59.8, 51.53, 57.6, 16.56, 1.54, 43.45, 33.59, 63.03, 4.38, 10.33, 148.46, 34.38]
    rows = [(det, samp, v) for det in range(40) for samp, v in enumerate(y)]
    random.Random(1).shuffle(rows)
    tod = spark.createDataFrame(rows, "det long, samp long, y double").repartition(7)
    grid = reduce.matched_filter(tod, 12).withColumn("n", F.lit(12)).withColumn("min_size", F.lit(17.0))
    over = reduce._over_threshold(grid, 12, F.lit(0), 0.5, False)
    got = grid.where("samp = 7").select("m", over.alias("over")).collect()
    assert len(got) == 40 and all(abs(abs(r["m"]) - 0.5 * 17 * 8 / 3) < 1e-9 and not r["over"] for r in got)


def test_validate_reads_frames_once(spark):
    from tidewell.sources import hk

    frame = lambda k, kind, prov, t, blocks: ("f", k, k, kind, 2, 7 + prov % 2, prov, t, [], blocks)
    rows = [
        frame(0, hk.SESSION, 0, 0.0, []),
        frame(1, hk.STATUS, 0, 0.0, []),
        frame(2, hk.DATA, 0, 10.0, [("a", [10.0], {"x": ["1"], "y": ["1", "2"]}), ("b", [], {"z": []})]),
        frame(3, hk.DATA, 0, 10.0, [("b", [99.0], {"x": ["1"]}), ("b", [9.0], {"x": []})]),
        frame(4, hk.DATA, 1, 500.0, [("a", [1.0], {"x": ["1"]}), ("a", [1.0], {"w": ["1"]})]),
        frame(5, hk.DATA, 1, 501.0, None),
        frame(6, hk.DATA, 1, 1.0, [("c", [1.0], {"x": ["1"], "w": ["3"]})]),
    ]
    frames = spark.createDataFrame(rows, hk.FRAMES)
    got = hk.validate(frames)
    assert got.first().asDict() == {"frames": 7, "session_frames": 1, "status_frames": 1, "data_frames": 5, "sessions": 2, "time_errors": 2, "length_errors": 2, "drift_warnings": 3, "moved_fields": 3}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") + plan_of(got).count("LogicalRDD") + plan_of(got).count("ExistingRDD") == 1
    empty = hk.validate(frames.where("frame_idx < 0")).first()
    assert set(empty.asDict().values()) == {0}


def test_sessions_at_once_as_one_by_one(spark):
    from tidewell.sources import hk

    rows, want = [], []
    for pid in (3, 4):
        s = hk.Session(f"user{pid}", f"obs.{pid}", 1000.0, pid)
        p = s.add_provider(f"obs.{pid}.feeds.main")
        want += [s.session_frame(), s.status_frame(1000.0)]
        for k in range(3 * pid):
            block = ("b", [float(k)], {"v": [str(k)]})
            want.append(s.data_frame(p, k + 0.5, {"b": block[1:]}))
            rows.append((f"user{pid}", f"obs.{pid}", pid, f"obs.{pid}.feeds.main", k, k + 0.5, [block]))
    random.Random(2).shuffle(rows)
    given = spark.createDataFrame(rows, "filename string, description string, pid long, provider string, place long, timestamp double, blocks array<struct<block_name string, t array<double>, fields map<string, array<string>>>>")
    got = hk.session_frames(given, 1000.0)
    expected = spark.createDataFrame(want, hk.FRAMES)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [(f.name, f.dataType.simpleString()) for f in expected.schema]
    assert [tuple(r) for r in got.sort("filename", "frame_idx").collect()] == [tuple(r) for r in expected.sort("filename", "frame_idx").collect()]


def test_load_written_takes_little_room(spark, tmp_path):
    """A dense table of 1.2 million rows, dealt out to several tasks, takes under half a byte a row when it is written."""
    samples = [(float(t), 331 * t, t) for t in range(60)]
    channels = spark.range(20000).select(F.col("id").alias("channel"))
    got = detector.load(spark.createDataFrame(samples, "t double, channel long, counts long"), channels, 0.0, 60.0)
    got.write.parquet(f"{tmp_path}/out")
    files = list((tmp_path / "out").glob("*.parquet"))
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == back.select("t", "channel").distinct().count() == 1_200_000
    assert sorted(tuple(r) for r in back.where("phase <> 0").collect()) == [(t, c, k * detector.PHASE) for t, c, k in samples if k]
    assert sum(f.stat().st_size for f in files) < 600_000


def test_load_by_cells_of_any_size(spark, monkeypatch):
    """Cells, lists and tasks cut small give the same rows, also for channels listed twice, null counts and times that all channels have."""
    for name, size in (("BLOCK_CHANNELS", 4), ("BLOCK_TIMES", 3), ("LIST_CHANNELS", 2), ("SENT_CHANNELS", 8), ("TASK_ROWS", 16)):
        monkeypatch.setattr(detector, name, size)
    r = random.Random(4)
    channels = [*range(23), 5, 5, None, None]
    samples = [(float(r.randrange(12)), r.choice([*range(26), None]), r.choice([None, 0, 3])) for _ in range(60)] + [(12.0, c, 2) for c in range(23)]
    got = detector.load(spark.createDataFrame(samples, "t double, channel long, counts long"), spark.createDataFrame([(c,) for c in channels], "channel long"), 1.0, 13.0)
    want = []
    for t in sorted({t for t, _, _ in samples if t >= 1}):
        for c in channels:
            want += [(t, c, k * detector.PHASE) for k in [k or 0 for u, d, k in samples if u == t and d == c and c is not None] or [0]]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    share = got.rdd.glom().map(len).collect()
    assert max(share) < len(want) / 4


def test_jump_at_its_threshold_as_sums_in_order_decide(spark):
    """A filter at its threshold is decided by sums in sample order, as plain loops and the SQL's terms have them (values of sf0.1, detectors 802 and 776)."""
    from tidewell.operators import reduce

    blocks = {  # smallest jump, samples up to the tie, values
        0: (15.0, 7, [58.98, 68.93, 42.11, 87.19, 18.93, 58.47, 22.74, 162.66, 15.87, 37.32, 55.67, 21.23]),
        1: (17.0, 8, [59.8, 51.53, 57.6, 16.56, 1.54, 43.45, 33.59, 63.03, 4.38, 10.33, 148.46, 34.38]),
    }
    rows, want = [], []
    for det in range(40):
        size, left, y = blocks[det % 2]
        rows += [(det, samp, v, size) for samp, v in enumerate(y)]
        mean = m = 0.0
        for v in y:
            mean += v
        for v in y[:left]:
            m += v - mean / 12
        want.append((det, abs(m) > 0.5 * size * left * (12 - left) / 12))
    assert {w for _, w in want} == {True, False}
    random.Random(2).shuffle(rows)
    grid = reduce.matched_filter(spark.createDataFrame(rows, "det long, samp long, y double, min_size double").repartition(7), 12).withColumn("n", F.lit(12))
    over = reduce._over_threshold(grid, 12, F.lit(0), 0.5, False)
    got = grid.where("(det % 2 = 0 and samp = 6) or (det % 2 = 1 and samp = 7)").select("det", over.alias("over")).collect()
    assert sorted(map(tuple, got)) == want
