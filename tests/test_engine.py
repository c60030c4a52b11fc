"""Goldens, invariants and second implementations of the engine's operators."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell import catalog
from tidewell.functions import healpix, quat, sky
from tidewell.operators import cuts, gapfill, iir, interp, noise, ranges, reduce, storage
from tidewell.plans import pointing, projection, tiles
from tidewell.sources import detector, hk
from tidewell.sources.frames import FrameSource, read_at
from tidewell.streaming import live

K = ["det"]


def table(spark, rows, ddl="det long, s int, e int"):
    return spark.createDataFrame(rows, ddl)


def pairs(df, *cols):
    return sorted(tuple(r) for r in df.select(*(cols or ("det", "s", "e"))).collect())


def tod(spark, *signals):
    return table(spark, [(d, i, float(v)) for d, y in enumerate(signals) for i, v in enumerate(y)], "det long, samp int, y double")


def mask_of(runs, n):
    m = np.zeros(n, bool)
    for s, e in runs:
        m[s:e] = True
    return m


def runs_of(m):
    d = np.flatnonzero(np.diff(np.concatenate(([0], np.asarray(m, int), [0]))))
    return list(zip(d[::2].tolist(), d[1::2].tolist()))


def test_range_algebra_against_masks(spark):
    rng = np.random.default_rng(3)
    n = 60
    a = [rng.random(n) < p for p in (0.3, 0.7, 0.0, 1.0)]
    b = [rng.random(n) < p for p in (0.5, 0.2, 0.5, 0.5)]
    make = lambda ms: table(spark, [(d, s, e) for d, m in enumerate(ms) for s, e in runs_of(m)])
    ra, rb, dets = make(a), make(b), table(spark, [(d, n) for d in range(4)], "det long, n int")
    want = lambda f: sorted((d, s, e) for d in range(4) for s, e in runs_of(f(a[d], b[d])))
    assert pairs(ranges.union(ra, rb, K)) == want(lambda x, y: x | y)
    assert pairs(ranges.intersection(ra, rb, K)) == want(lambda x, y: x & y)
    assert pairs(ranges.difference(ra, rb, K)) == want(lambda x, y: x & ~y)
    assert pairs(ranges.complement(ra, dets, K)) == want(lambda x, y: ~x)
    assert pairs(ranges.complement(ranges.complement(ra, dets, K), dets, K)) == want(lambda x, y: x)
    assert pairs(ranges.minus_compat(ra, rb, dets, K)) == want(lambda x, y: x | ~y)
    got = ranges.to_mask(ra, dets, K)
    assert sorted((r["det"], r["samp"]) for r in got.where("flag = 1").collect()) == sorted((d, i) for d in range(4) for i in np.flatnonzero(a[d]).tolist())
    assert pairs(ranges.from_mask(got, K, F.col("flag") == 1)) == want(lambda x, y: x)
    moved, left = ranges.sliced(ra, dets, K, 10, -5)
    assert pairs(moved) == sorted((d, s, e) for d in range(4) for s, e in runs_of(a[d][10:-5])) and left.first()["n"] == 45


def test_close_gaps_golden(spark):
    dets = table(spark, [(0, 1000)], "det long, n int")
    for g in (0, 10):
        r = table(spark, [(0, 10, 20), (0, 20 + g, 30 + g)])
        assert len(pairs(ranges.close_gaps(r, dets, K, 0))) == (1 if g == 0 else 2)
        assert len(pairs(ranges.close_gaps(r, dets, K, 10))) == 1


def test_interval_goldens(spark):
    dom = table(spark, [(0, 0.0, 10.0)], "det long, lo double, hi double")
    iv = lambda *v: table(spark, [(0, float(s), float(e)) for s, e in v], "det long, s double, e double")
    a, b = iv((0, 1), (2, 3), (4, 5)), iv((1, 2.5))
    count = lambda df: df.count()
    assert count(ranges.union(a, b, K)) == 2 and count(ranges.intersection(a, b, K)) == 1
    assert count(ranges.minus_compat(a, b, dom, K, "lo", "hi")) == 2
    assert count(ranges.complement(iv(), dom, K, "lo", "hi")) == 1
    assert pairs(ranges.add(iv((1, 2), (3, 4)), iv((2, 3)), dom, K, "lo", "hi")) == [(0, 1.0, 4.0)]


def test_bitmask_and_concat(spark):
    dets = table(spark, [(0, 20)], "det long, n int")
    for bits, want in (({19}, 1), ({19, 0}, 2), ({19, 0, 10, 11}, 3)):
        m = table(spark, [(0, i, 4096 if i in bits else 0) for i in range(20)], "det long, samp int, mask long")
        r = ranges.from_bitmask(m, K, 13)
        assert r.count() == want
        assert pairs(ranges.to_bitmask(r, dets, K, 13), "samp", "mask") == sorted((i, 4096 if i in bits else 0) for i in range(20))
    d10, d20 = (table(spark, [(i, n) for i in range(10)], "det long, n int") for n in (100, 200))
    out, dom = ranges.concatenated([(ranges.zeros_like(d10, K), d10), (ranges.ones_like(d20, K), d20)], K)
    assert pairs(ranges.stats(out, dom, K), "det", "samples", "intervals") == [(i, 200, 1) for i in range(10)]
    with pytest.raises(ValueError):
        ranges.concatenated([(ranges.zeros_like(d10, K), d10), (ranges.zeros_like(dets, K), dets)], K)
    with pytest.raises(ValueError):
        ranges.to_bitmask(out, dom, K, 65)


def test_flag_and_jump_goldens(spark):
    dets = table(spark, [(0, 100)], "det long, n int")
    flags = table(spark, [(0, s, e) for s, e in ((0, 8), (10, 11), (47, 48), (50, 60), (95, 100))])
    assert pairs(reduce.clean_flag(flags, 5, dets)) == [(0, 0, 8), (0, 50, 60), (0, 95, 100)]
    step = tod(spark, np.arange(100) >= 50)
    sizes = table(spark, [(0, 0.5)], "det long, min_size double")
    assert pairs(reduce.matched_jumps(step, sizes, 10)) == [(0, 46, 53)]
    tol = table(spark, [(0, 0.0)], "det long, atol double")
    got = reduce.quantized_jumps(step, tol, 10, 0.5).where("jump <> 0")
    assert [r["samp"] for r in got.orderBy("samp").collect()] == list(range(50, 60))
    y = np.zeros(100)
    y[25:] += 1
    y[75:] -= 1
    h = table(spark, [(0, i, 1.0 if i < 50 else -1.0) for i in range(100)], "det long, samp int, h double")
    z = reduce.subtract_jump_heights(tod(spark, y), h, table(spark, [(0, 25, 26), (0, 75, 76)]))
    assert all(abs(r["z"]) < 1e-12 for r in z.collect())


def test_blocks_and_trends(spark):
    y = np.arange(100.0)
    t = tod(spark, y)
    v = lambda df: [r["v"] for r in df.orderBy("samp").collect()]
    assert v(reduce.block_moment(t, 10)) == [b * 10 + 4.5 for b in range(10) for _ in range(10)]
    assert np.allclose(v(reduce.block_moment(t, 10, 2, True)), np.var(np.arange(10)))
    assert set(v(reduce.block_minmax(t, 10))) == {9.0}
    with pytest.raises(ValueError):
        reduce.block_moment(t, 0)
    rng = np.random.default_rng(0)
    noisy = rng.normal(size=101) + np.linspace(0, 5, 101)
    for method, want in (("mean", noisy - noisy.mean()), ("median", noisy - np.median(noisy))):
        assert np.allclose([r["z"] for r in reduce.detrend(tod(spark, noisy), method).orderBy("samp").collect()], want)
    flat = [r["z"] for r in reduce.detrend(t, "linear", 1).orderBy("samp").collect()]
    assert np.allclose(flat, 0)
    with pytest.raises(ValueError):
        reduce.detrend(t, "cubic")


def test_gap_fill_polynomial(spark):
    x = np.arange(400) * 0.1
    y = 1 + 0.2 * x - 0.14 * x**2
    broken = y.copy()
    broken[200:220] = 99
    gaps = table(spark, [(0, 200, 220)])
    got = {r["samp"]: r["v"] for r in gapfill.fill(tod(spark, broken), gaps, 10, 2).collect()}
    assert np.allclose([got[i] for i in range(200, 220)], y[200:220], rtol=1e-8)
    filled, old = gapfill.replaced(tod(spark, broken), gapfill.fill(tod(spark, broken), gaps, 10, 2))
    assert old.count() == 20 and filled.where("y = 99").isEmpty()


def test_interpolation_with_extrapolation(spark):
    x = np.linspace(0, 99, 50) ** 1.1
    y = np.sin(x / 10)
    at = np.linspace(-10, 180, 97)
    knots = table(spark, [(0, float(a), float(b)) for a, b in zip(x, y)], "det long, x double, y double")
    asks = table(spark, [(0, k, float(a)) for k, a in enumerate(at)], "det long, k long, x double")
    got = np.array([r["y"] for r in interp.interp1d_linear(knots, asks).orderBy("k").collect()])
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, 48)
    want = y[k] + (y[k + 1] - y[k]) * (at - x[k]) / (x[k + 1] - x[k])
    assert np.allclose(got, want)


def test_cut_values(spark):
    y = np.random.default_rng(1).normal(size=60)
    t = tod(spark, y)
    c = table(spark, [(0, 5, 6), (0, 10, 13), (0, 20, 45)])
    assert cuts.measure(c).first()["n"] == 29
    assert cuts.measure(c, "poly", 100, 5).first()["n"] == 1 + 2 + 5
    got = {(r["s"], r["p"]): r["c"] for r in cuts.extract_poly(t, c, 100, 5).collect()}
    u = -1 + 2 * np.arange(25) / 24
    for p in range(5):
        leg = np.polynomial.legendre.Legendre.basis(p)(u)
        assert np.isclose(got[(20, p)], (y[20:45] * leg).sum())
    values = cuts.extract_full(t, c)
    back = cuts.insert_full(cuts.clear(t, c), values.select("det", "samp", F.col("y").alias("v")))
    assert np.allclose([r["y"] for r in back.orderBy("samp").collect()], y)


def test_filter_golden_and_state(spark):
    stages = [iir.Biquad(32092, 15750, 14, 3, 5), iir.Biquad(31238, 14895, 14, 3, 12)]
    want = [0, 5, 45, 151, 329, 560, 809, 1042, 1230, 1357]
    whole = iir.Bank(stages).apply([1000] * 100)
    assert iir.Bank(stages).apply([1000.4] * 100) == whole
    halves = iir.Bank(stages)
    assert halves.apply([1000] * 50) + halves.apply([1000] * 50) == whole
    got = iir.filtered(tod(spark, 1000 * np.ones(100)), stages)
    assert [r["z"] for r in got.orderBy("samp").collect()] == whole
    assert iir.Bank(stages).apply([1] * 100)[::10] == want


def test_noise_fit_recovers_parameters(spark):
    f = np.linspace(0.01, 200, 513)
    rng = np.random.default_rng(5)
    rows = [(d, float(a), float(2 * (1 + (10 / a) ** 0.7) * rng.chisquare(40) / 40)) for d in range(2) for a in f]
    got = noise.fit_noise(table(spark, rows, "det long, f double, pxx double"), 1.0, 10.0, 100.0).collect()
    for r in got:
        assert abs(r["white"] - 2) < 0.2 and abs(r["alpha"] - 0.7) < 0.2 and abs(r["knee"] - 10) < 4 and r["white_err"] > 0
    with pytest.raises(ValueError):
        noise.fit_one(f, f, 10.0, 5.0, 8.0)


def test_noise_query_fits_every_detector(spark, tmp_path):
    rows = spark.range(50 * 80).selectExpr("id as event_id", "timestamp_micros(1704067200000000 + id * 1000000) as ts", "id % 50 as user_id", "'view' as event_type", "cast(id * 7 % 101 as double) as value", "'{}' as props")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    got = {r["det"]: r for r in catalog.QUERIES["fit_noise"](spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(50))
    for d, r in got.items():
        assert abs(r["white"] / (10 + d) - 1) < 0.1 and abs(r["knee"] - 2) < 0.4 and abs(r["alpha"] - 2) < 0.2


def test_storage_rules(spark):
    t = tod(spark, [1.26, -1.25, 0.1]).withColumn("quantum", F.lit(0.5))
    assert [r["q"] for r in storage.quantise(t).orderBy("samp").collect()] == [3, -3, 0]
    with pytest.raises(ValueError):
        storage.check(t.drop("quantum"))
    with pytest.raises(ValueError):
        storage.calibrate(t, table(spark, [(5, 1.0)], "det long, k double"))
    big = tod(spark, np.arange(40) * 1e6).withColumn("q", F.col("y").cast("long"))
    for r in storage.split_branches(big).join(big, ["det", "samp"]).collect():
        assert r["base"] + r["rest"] == r["q"] and abs(r["rest"]) < storage.BRANCH // 2 and r["base"] % storage.BRANCH == 0


def test_quaternion_round_trips(spark):
    one = spark.range(1)
    for make, take in ((quat.rotation_iso, quat.decompose_iso), (quat.rotation_lonlat, quat.decompose_lonlat), (quat.rotation_xieta, quat.decompose_xieta), (lambda *a: quat.rotation_lonlat(*a, azel=True), lambda q: quat.decompose_lonlat(q, True))):
        q = one.select(*quat.named(make(0.1, 0.2, 0.3)))
        got = q.select(*[c.alias(n) for c, n in zip(take(quat.read()), "xyz")]).first()
        assert np.allclose(tuple(got), (0.1, 0.2, 0.3), atol=1e-3 if make is quat.rotation_xieta else 1e-7)
    with pytest.raises(ValueError):
        quat.euler(3, 0.1)


def test_healpix_numbers(spark):
    for nside in (1, 4, 16):
        p = spark.range(healpix.n_pixels(nside)).select(F.col("id").alias("n"))
        p = healpix.ring2nest(healpix.nest2ring(p, "n", nside), "ring", nside, "back")
        p = healpix.pix2ang(p, "n", nside)
        p = healpix.ang2pix(healpix.ang2pix(p, "lon", "lat", nside, True, "n2"), "lon", "lat", nside, False, "r2")
        rows = sorted(p.collect(), key=lambda r: r["ring"])
        assert [r["ring"] for r in rows] == list(range(12 * nside * nside))
        assert all(r["n"] == r["back"] == r["n2"] and r["ring"] == r["r2"] for r in rows)
        lat = [r["lat"] for r in rows]
        assert all(a >= b - 1e-9 for a, b in zip(lat, lat[1:]))
    with pytest.raises(ValueError):
        healpix.check_nside(8192)


def small_assembly(spark, system="CAR"):
    scan = pointing.constant_elevation_scan(spark, 200, 0.1, 0.0, 0.0, 0.5, 0.3, 0.1).select("samp", (F.col("az")).alias("lon"), (F.col("el") + F.col("samp") * 0.002).alias("lat"), (F.col("samp") * 0.05).alias("psi"))
    dets = table(spark, [(0, 0.0, 0.0, 0.0), (1, 0.01, -0.02, 0.7)], "det long, xi double, eta double, gamma double")
    return pointing.assembly(pointing.for_lonlat(scan), pointing.focal_plane(dets))


def test_map_and_back_are_adjoint(spark):
    pix = sky.FlatPixels(60, 120, 0.02, 0.02, 20.5, 60.5)
    geom = projection.Geometry("CAR", 0.0, 0.0, pix, (25, 40))
    asm = small_assembly(spark).persist()
    rng = np.random.default_rng(2)
    signal = table(spark, [(d, i, float(rng.normal())) for d in range(2) for i in range(200)], "det long, samp int, signal double")
    asm = asm.join(signal, ["det", "samp"]).persist()
    for interpolation in ("nearest", "bilinear"):
        p = projection.pointing(asm, geom, "TQU", interpolation).persist()
        m = projection.to_map(p, "TQU")
        some = projection.blank(spark, geom).select("iy", "ix", *[F.sin(F.col("iy") * k + F.col("ix")).alias(c) for k, c in ((1, "T"), (2, "Q"), (3, "U"))])
        left = m.join(some.toDF("iy", "ix", "T2", "Q2", "U2"), ["iy", "ix"]).agg(F.sum(F.expr("T*T2+Q*Q2+U*U2"))).first()[0]
        every = projection.pointing(asm.withColumn("signal", F.lit(0.0)), geom, "TQU", interpolation, off_map=True)
        for small in (geom, None):
            back = projection.from_map(every, some, "TQU", small, interpolation)
            assert back.count() == 400
            right = back.join(signal, ["det", "samp"]).agg(F.sum(F.expr("y*signal"))).first()[0]
            assert np.isclose(left, right)
        p.unpersist()
    p = projection.pointing(asm, geom, "TQU")
    assert projection.tile_hits(p).agg(F.sum("hits")).first()[0] == p.count()
    for method in ("simple", "domdir", "tiles"):
        spans = projection.assign_threads(p, method, 3, geom, 0.2)
        assert spans.agg(F.sum(F.col("e") - F.col("s"))).first()[0] == p.count()
    with pytest.raises(ValueError):
        projection.assign_threads(p, "other", 3)
    with pytest.raises(RuntimeError):
        projection.tile_hits(p.drop("tile"))


def test_native_rotation_puts_the_pole_at_the_middle(spark):
    for system in ("TAN", "SIN", "ARC", "ZEA", "CAR"):
        geom = projection.Geometry(system, 0.4, 0.3, sky.FlatPixels(3, 3, 0.1, 0.1, 2.0, 2.0))
        bore = pointing.for_lonlat(table(spark, [(0, 0.4, 0.3)], "samp int, lon double, lat double"))
        asm = pointing.assembly(bore, pointing.focal_plane(table(spark, [(0, 0.0, 0.0)], "det long, xi double, eta double")), geom.native())
        got = projection.with_coords(asm, system).first()
        assert abs(got["x"]) < 1e-7 and abs(got["y"]) < 1e-7
    with pytest.raises(ValueError):
        pointing.focal_plane(table(spark, [(0, float("nan"), 0.0)], "det long, xi double, eta double"))
    with pytest.raises(NotImplementedError):
        pointing.az_el(bore)


def frame_lines():
    status = {"frame_idx": 0, "hkagg_type": 1, "hkagg_version": 2, "session_id": 5, "prov_id": 1, "timestamp": 100.0, "providers": [{"prov_id": 1, "description": "observatory.agent-a.feeds.feed"}], "blocks": []}
    data = [{"frame_idx": k + 1, "hkagg_type": 2, "hkagg_version": 2, "session_id": 5, "prov_id": 1, "timestamp": 100.0 + 10 * k, "providers": [], "blocks": [{"block_name": "position", "t": [100.0 + 10 * k + i for i in range(5)], "fields": {"az": [str(i) for i in range(5)], "mode": ["x"] * 5}}]} for k in range(3)]
    return [status, *data]


def test_frame_files(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text("".join(json.dumps(f) + "\n" for f in frame_lines()) + "broken\n")
    spark.dataSource.register(FrameSource)
    for split in (64, 1 << 20):
        frames = spark.read.format("hk_frames").option("splitBytes", split).load(str(path))
        rows = frames.orderBy("byte_offset").collect()
        assert [r["frame_idx"] for r in rows] == [0, 1, 2, 3]
    assert read_at(str(path), rows[2]["byte_offset"])["frame_idx"] == 2
    names = hk.provider_names(frames)
    samples = hk.samples(frames, names)
    assert samples.count() == 30
    assert hk.validate(frames).first()["time_errors"] == 0
    index = hk.block_index(frames)
    assert index.agg(F.max("t1")).first()[0] == 124.0 + hk.PAD_SECONDS
    assert hk.finalized_until(hk.get_data(samples, None, 100, 112)) == 111.0
    tree = hk.Tree(samples)
    assert tree.children() == ["agent_a"] and tree.agent_a.feed.az.load().count() == 15
    with pytest.raises(ValueError):
        hk.resolve(hk.fields(samples), ["feed"], True)
    with pytest.raises(ValueError):
        hk.load_range(hk.with_folder(samples), 100, 200, {"x": "none"}, strict=True).count()
    old = frames.where("hkagg_type = 2").withColumn("hkagg_version", F.lit(0)).withColumn("blocks", F.transform("blocks", lambda b: b.withField("block_name", F.lit(None).cast("string"))))
    new = hk.translate(old)
    assert new.first()["blocks"][0]["block_name"] == "block_for_az" and new.first()["hkagg_version_orig"] == 0
    assert hk.session_id_of("x", 1.0, 2) == spark.range(1).select(hk.session_id(F.lit("x"), F.lit(1.0), F.lit(2))).first()[0]
    assert "az" in hk.text_table(hk.fields(samples).select("field"))


def test_streams_match_batch(spark, tmp_path):
    rows = [(d, i, float(i * (d + 1))) for i in range(40) for d in range(2)]
    for part in range(2):
        table(spark, rows[part * 40 : part * 40 + 40], "det long, samp int, y double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("det long, samp int, y double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = live.block_stats(source, 8).writeStream.outputMode("complete").format("memory").queryName("blocks").trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = live.block_stats(table(spark, rows, "det long, samp int, y double"), 8)
    assert pairs(spark.table("blocks"), "det", "blk", "n", "mean") == pairs(want, "det", "blk", "n", "mean")
    stages = [iir.Biquad(32092, 15750, 14, 3, 5)]
    query = live.filtered(source, stages).writeStream.outputMode("append").format("memory").queryName("iir").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert pairs(spark.table("iir"), "det", "samp", "z") == pairs(iir.filtered(table(spark, rows, "det long, samp int, y double"), stages), "det", "samp", "z")


def test_ingest_stream(spark, tmp_path):
    src = tmp_path / "frames"
    spark.createDataFrame([("a", 0, f["frame_idx"], f["hkagg_type"], 2, 5, 1, f["timestamp"], [tuple(p.values()) for p in f["providers"]], [(b["block_name"], b["t"], b["fields"]) for b in f["blocks"]]) for f in frame_lines()], hk.FRAMES).write.parquet(str(src))
    stream = spark.readStream.schema(hk.FRAMES).parquet(str(src))
    live.ingest(live.translated(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert live.ingested(spark, str(tmp_path / "out")).count() == 30


def test_detector_archive(spark):
    counter = table(spark, [(0, i, float((i * 1_500_000_000) % (1 << 32)), 10.0) for i in range(8)], "frame long, i int, counter double, start double")
    got = [r["t"] for r in detector.unwrapped_clock(counter).orderBy("i").collect()]
    assert np.allclose(got, 10 + 1.5 * np.arange(8))
    starts = table(spark, [(0.0,), (10.0,)], "t double")
    updates = table(spark, [(1.0, "a", "1"), (11.0, "a", "2"), (12.0, "b", "3"), (15.0, "a", "9")], "t double, entry string, value string")
    assert pairs(detector.status_at(starts, updates, 13.0), "entry", "value") == [("a", "2"), ("b", "3")]
    status = detector.parse_status(table(spark, [("x.channelMask", "[3, 5]"), ("x.flux_ramp_max_cnt", "9")], "entry string, value string"))
    assert status["inverse"] == {3: 0, 5: 1} and np.isclose(status["flux_ramp_rate_hz"], 1e6 * 614.4 / 2 / 10)
    samples = table(spark, [(0.5, 1, 2), (0.25, 1, 1)], "t double, channel long, counts long")
    assert detector.to_arrays(samples).first()["counts"] == [1, 2]


def test_session_frames_refuse_what_does_not_fit(spark):
    s = hk.Session("a", "observatory", 1e9, 7)
    p = s.add_provider("x")
    assert s.add_provider("y") == p + 1
    s.remove_provider(p)
    assert s.add_provider("z") == p
    with pytest.raises(ValueError):
        s.data_frame(9, 1e9, {})
    with pytest.raises(ValueError):
        s.data_frame(p, 1e9, {"b": ([1.0, 2.0], {"v": [1]})})
    frames = spark.createDataFrame([s.session_frame(), s.status_frame(1e9), s.data_frame(p, 1e9, {"b": ([1e9], {"v": [1]})})], hk.FRAMES)
    assert {r["provider"] for r in hk.provider_names(frames).collect()} == {"y", "z"}
    assert hk.session_id_of("observatory", 1e9, 7) == frames.first()["session_id"]


def test_config_and_folders():
    config = hk.read_config("# archive\ndata_dir: '/data'\nfield_list:\n    t1: a.b.c\n    't2': a.b.d\nother: 3\n")
    assert config == {"data_dir": "/data", "field_list": {"t1": "a.b.c", "t2": "a.b.d"}, "other": "3"}
    assert hk.folders(1_600_000_000, 1_600_100_000) == [15999, 16000, 16001]


def test_grid_indexing_follows_numpy(spark):
    rng = np.random.default_rng(4)
    full = rng.random((3, 4, 20)) < 0.4
    rows = table(spark, [(a, b, s, s + 1) for a, b, s in np.argwhere(full).tolist()], "a int, b int, s int, e int")
    grid = ranges.Grid(ranges.merged(rows, ["a", "b"]), ["a", "b"], (3, 4), 20).check()
    for index in (1, (slice(None), -1), ([2, 0, 2], slice(None, None, -1)), (Ellipsis, slice(5, 12)), (0, 1, slice(-6, None)), (None, slice(1, 3)), (slice(0, 0),), ([True, False, True], 2)):
        got, want = grid[index], full[index]
        assert got.shape == want.shape
        out = np.zeros(want.shape, bool)
        for r in got.ranges.collect():
            out[tuple(r[k] for k in got.keys)][r["s"] : r["e"]] = True
        assert (out == want).all()
    assert len(grid) == 3
    for index in (3, (0, 0, 0), (0, 0, slice(0, 9, 2)), (0, 0, slice(None), 0), [True, False]):
        with pytest.raises(IndexError):
            grid[index]
    with pytest.raises(ValueError):
        ranges.Grid(rows, ["a", "b"], (2, 4), 20).check()


def test_maps_refuse_what_does_not_fit(spark):
    assert [projection.components_of(n) for n in (1, 2, 3)] == ["T", "QU", "TQU"]
    with pytest.raises(ValueError):
        projection.components_of(4)
    pointed = table(spark, [(0, 0, 1), (0, 1, 2)], "det long, samp int, tile long")
    assert projection.only_active(pointed, table(spark, [(1,), (2,)], "tile long")).count() == 2
    with pytest.raises(RuntimeError):
        projection.only_active(pointed, table(spark, [(1,)], "tile long"))
    good = table(spark, [(0, 0, 1.0), (0, 1, 2.0)], "det long, samp int, y double")
    assert projection.check_signal(good, pointed).count() == 2
    for bad in (good.where("samp = 0"), good.unionByName(good), good.withColumn("y", F.lit("x"))):
        with pytest.raises(ValueError):
            projection.check_signal(bad, pointed)


def test_interpolation_takes_linear_time(spark):
    knots = spark.range(25_000).select(F.lit(0).alias("det"), F.col("id").cast("double").alias("x"), F.sin(F.col("id") * 0.01).alias("y"))
    asked = spark.range(25_000).select(F.lit(0).alias("det"), F.col("id").alias("k"), (F.col("id") * 1.01 - 50.5).alias("x"))
    got = {r["k"]: r["y"] for r in interp.interp1d_linear(knots, asked).collect()}
    x, y = np.arange(25_000.0), np.sin(np.arange(25_000) * 0.01)
    at = np.arange(25_000) * 1.01 - 50.5
    inside = (at >= 0) & (at <= 24_999)
    assert np.allclose(np.array([got[k] for k in range(25_000)])[inside], np.interp(at, x, y)[inside])
    assert np.isclose(got[0], y[0] + (y[1] - y[0]) * at[0]) and np.isclose(got[24_999], y[-1] + (y[-1] - y[-2]) * (at[-1] - x[-1]))


def test_sequential_walks_pass_batch_after_batch(spark):
    """The filter's delays live on from Arrow batch to Arrow batch."""
    rows = spark.range(30_000).select((F.col("id") % 2).alias("det"), F.floor(F.col("id") / 2).cast("int").alias("samp"), (F.col("id") % 977 * 1000).alias("y"))
    stages = [iir.Biquad(32092, 15750, 14, 3, 5)]
    got = iir.filtered(rows, stages).orderBy("det", "samp").toPandas()
    for det in (0, 1):
        want = iir.Bank(stages).apply([(2 * k + det) % 977 * 1000 for k in range(15_000)])
        assert got[got.det == det].z.tolist() == want


def test_every_row_with_every_row_in_runs(spark):
    from tidewell.operators.runs import each_with

    left, right = spark.range(30).withColumnRenamed("id", "a"), spark.range(25).withColumnRenamed("id", "b")
    got = each_with(left, right, "b", rows=4)
    assert got.distinct().count() == got.count() == 750


def test_pseudo_inverse_of_weights(spark):
    """Weights of rank 0 to 3 against numpy."""
    rng = np.random.default_rng(5)
    rows, want = [], []
    for k in range(40):
        rank = k % 4
        v = rng.normal(size=(rank, 3))
        w, m = v.T @ v, rng.normal(size=3)
        rows.append((0, k, *(float(x) for x in m), *(float(w[i, j]) for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)))))
        want.append((rank, np.linalg.pinv(w, rcond=1e-9, hermitian=True) @ m))
    sky_map = spark.createDataFrame(rows, "iy long, ix long, T double, Q double, U double, wTT double, wTQ double, wTU double, wQQ double, wQU double, wUU double")
    for r in projection.pinv_tqu(sky_map, least=1e-9).collect():
        rank, m = want[r["ix"]]
        assert r["rank"] == rank and np.allclose([r["T"], r["Q"], r["U"]], m, rtol=1e-5, atol=1e-7)


@pytest.mark.parametrize("size", [2, 1 << 16])
def test_quaternions_between_rows(spark, size):
    """A coarse table against the turn that it was taken from; both signs, gaps without a row, and times beyond the ends."""
    turn = lambda t: (np.cos(0.15 * t), np.sin(0.15 * t) * 0.6, 0.0, np.sin(0.15 * t) * 0.8)
    times = [0.0, 1.0, 2.5, 9.0, 9.5, 12.0]
    table_ = spark.createDataFrame([(t, *(float(v) * (-1) ** k for v in turn(t))) for k, t in enumerate(times)], "t double, qa double, qb double, qc double, qd double")
    asks = [(k, -1 + 0.37 * k) for k in range(40)]
    got = pointing.az_el(spark.createDataFrame(asks, "samp long, t double"), table_) if size == 1 << 16 else pointing.between(table_, spark.createDataFrame(asks, "samp long, t double"), size)
    q = {r["samp"]: np.array([r["qa"], r["qb"], r["qc"], r["qd"]]) for r in got.collect()}
    assert len(q) == 40
    for k, t in asks:
        assert abs(q[k] @ np.array(turn(min(max(t, 0), 12)))) == pytest.approx(1, abs=1e-12)


CARD = "{:<8}= {:>20} / a comment, with a '/' and a quote"
HEADERS = [
    # system, axes, crval, lonpole (None: not given)
    ("CAR", ("RA---", "DEC--"), (0.0, 0.0), None),
    ("CAR", ("GLON-", "GLAT-"), (12.5, 0.0), 0.0),
    ("CEA", ("RA---", "DEC--"), (180.0, 0.0), 180.0),
    ("CAR", ("RA---", "DEC--"), (10.0, -20.0), 0.0),
    ("TAN", ("RA---", "DEC--"), (83.0, 22.0), None),
    ("ZEA", ("DEC--", "RA---"), (-5.0, 40.0), 180.0),
    ("ARC", ("RA---", "DEC--"), (1.0, -89.0), None),
    ("SIN", ("ELON-", "ELAT-"), (0.0, 45.0), 180.0),
]


@pytest.mark.parametrize("system,axes,at,pole", HEADERS)
def test_map_headers(system, axes, at, pole):
    """Headers as cards, as lines and as a dict, against geometries made by hand."""
    swapped = axes[0].startswith("DEC")
    numbers = {"NAXIS1": 300, "NAXIS2": 200, "CRPIX1": 10.5, "CRPIX2": 20.0, "CRVAL1": at[0], "CRVAL2": at[1]}
    cards = {k: str(v) for k, v in numbers.items()} | {"CDELT1": "-5D-2", "CDELT2": "2.5E-2", "CTYPE1": f"'{axes[0]}{system}'", "CTYPE2": f"'{axes[1]}{system}'"}
    if pole is not None:
        cards["LONPOLE"] = str(pole)
    lines = [CARD.format(k, v)[:80].ljust(80) for k, v in cards.items()] + ["END".ljust(80)]
    lon, lat = (at[1], at[0]) if swapped else at
    one = dict(ny=300, nx=200, dy=np.radians(-0.05), dx=np.radians(0.025), iy0=10.5, ix0=20.0) if swapped else dict(ny=200, nx=300, dy=np.radians(0.025), dx=np.radians(-0.05), iy0=20.0, ix0=10.5)
    want = projection.Geometry(system, np.radians(lon), np.radians(lat), sky.FlatPixels(**one))
    given = {k: v.strip("'").replace("D", "E") if k.startswith("CDELT") else v.strip("'") for k, v in cards.items()}
    for header in ("".join(lines), "\n".join(lines), given):
        got = projection.Geometry.from_header(header)
        assert got.system == want.system and np.allclose(got.native(), want.native())
        assert np.allclose([getattr(got.pixels, f) for f in one], list(one.values()))


def test_map_headers_that_do_not_fit():
    good = {"NAXIS1": 3, "NAXIS2": 2, "CRPIX1": 1, "CRPIX2": 1, "CRVAL1": 0, "CRVAL2": 30, "CTYPE1": "RA---TAN", "CTYPE2": "DEC--TAN"}
    for change in ({"CTYPE1": "RA---CAR"}, {"CTYPE1": "RA---AIT", "CTYPE2": "DEC--AIT"}, {"CTYPE2": "RA---TAN"}, {"LONPOLE": 0.0}, {"CTYPE1": "RA---CAR", "CTYPE2": "DEC--CAR", "LONPOLE": 0.0}):
        with pytest.raises(ValueError):
            projection.Geometry.from_header(good | change)


def test_dense_tiles(spark, tmp_path):
    rows = [(3, 0, 1.0, 2.0), (3, 7, 3.0, 4.0), (1, 5, 5.0, 6.0), (6, 2, 7.0, 8.0)]
    long = spark.createDataFrame(rows, "tile long, inner int, T double, Q double")
    d = tiles.dense(long, 8, ["T", "Q"])
    tiles.save(d, str(tmp_path / "tiles"))
    back = tiles.untile(tiles.load(spark, str(tmp_path / "tiles"), [1, 3]), ["T", "Q"], 8)
    got = {(r["tile"], r["inner"]): (r["T"], r["Q"], r["pix"]) for r in back.collect()}
    assert len(got) == 16 and all(got[t, i] == (a, b, 8 * t + i) for t, i, a, b in rows if t != 6) and sum(v[0] for v in got.values()) == 9
    assert [(r["place"], r["tile"]) for r in tiles.compressed(d).orderBy("place").collect()] == [(0, 1), (1, 3), (2, 6)]
    full = tiles.decompressed(d, 8, 8, ["T", "Q"]).orderBy("tile").collect()
    assert [sum(r["T"]) for r in full] == [0, 5, 0, 4, 0, 0, 7, 0] and all(len(r["Q"]) == 8 for r in full)
    assert tiles.dense(long.limit(0), 8, ["T", "Q"]).isEmpty()
    with pytest.raises(Exception, match="outside its tile"):
        tiles.dense(long, 7, ["T"]).collect()


def test_nested_ranges(spark):
    dets = spark.createDataFrame([(0, 10), (1, 10)], "det long, n long")
    flat = spark.createDataFrame([(0, 2, 4), (1, 0, 10)], "det long, s long, e long")
    assert {(r["bunch"], r["domain"]) for r in projection.promoted(flat, dets).collect()} == {(0, 0)}
    assert projection.promoted(None, dets).agg(F.sum(F.col("e") - F.col("s"))).first()[0] == 20
    threads = flat.withColumn("domain", F.col("det") + 5)
    both = threads.withColumn("bunch", F.lit(0)).unionByName(threads.withColumn("bunch", F.lit(1)))
    assert {(r["bunch"], r["domain"]) for r in projection.promoted(threads, dets).collect()} == {(0, 5), (0, 6)}
    pointed = spark.createDataFrame([(d, k) for d in (0, 1) for k in range(10)], "det long, samp long")
    got = projection.bunched(pointed, projection.promoted(both, dets)).groupBy("bunch", "domain").count().collect()
    assert {(r["bunch"], r["domain"]): r["count"] for r in got} == {(b, d): n for b in (0, 1) for d, n in ((5, 2), (6, 10))}
    for bad in ([(2, 0, 1)], [(0, -1, 3)], [(0, 5, 11)]):
        with pytest.raises(ValueError):
            projection.promoted(spark.createDataFrame(bad, "det long, s long, e long"), dets)
