"""Search on planted events, kernels, filters, archives, streams, clusters, fits."""

import json
import math
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackwave.functions import attenuation, codes, geo, signal
from stackwave.functions.statistics import detection_density, emr_fit, gaussian_density
from stackwave.operators import cluster, ingest, magnitude, octree, stack, traveltime
from stackwave.plans import catalog_queries, pipeline_queries, registry, signal_queries
from stackwave.sources import archives, mseed, sinks
from stackwave.streaming import live

def test_trace_functions_over_a_table(spark, data):
    e = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()}
    got = {r.vec_id: r for r in signal_queries.filtered_traces(spark, data).collect()}
    assert set(got) == set(e)
    for k in sorted(e)[:20]:
        y = signal.band_filter(e[k], 100.0, 2.0, 20.0)
        assert np.allclose(got[k].samples, signal.resample(y, 0.01, 0.02)) and got[k].trigger == pytest.approx(signal.sta_lta(y, 4, 16).max())


def test_layered_times_are_those_of_the_rays(spark, data):
    got = signal_queries.layered_travel_times(spark, data).where("phase = 'cake:P'").join(signal_queries._pairs(spark, data), ["node_id", "sta_idx"]).limit(300).collect()
    for r in got[::10]:
        assert r.tt == pytest.approx(traveltime.ray_table(traveltime.layers(), "vp", np.array([r.offset]), np.array([r.depth]))[0, 0], rel=2e-3)


def test_magnitude_fit_is_the_likeliest(spark, data):
    r = pipeline_queries.magnitude_fit(spark, data).first()
    assert r.b > 0 and r.sigma > 0 and math.isfinite(r.mu) and r.log_likelihood < 0


@pytest.mark.parametrize("incremental", [False, True])
def test_planted_events_are_found(spark, incremental):
    e, images = pipeline_queries._images(spark, 5)
    found = sorted(pipeline_queries.srch.search(images, pipeline_queries.network(), pipeline_queries.settings(incremental=incremental)).collect(), key=lambda r: r.time_us)
    want = sorted(e.collect(), key=lambda r: r.time_us)
    assert len(found) == len(want)
    for f, w in zip(found, want):
        assert abs(f.time_us - w.time_us) < 150_000
        assert math.dist((f.east, f.north, f.depth), (w.east, w.north, w.depth)) < 700
        assert f.n_stations == 16 and f.in_bounds


@pytest.mark.parametrize("incremental", [False, True])
def test_weak_event_beside_a_strong_one_is_found(spark, incremental):
    # both lie at a corner of root nodes; the weak one passes the threshold only at the finer nodes split for the strong one
    where, origins, rate, n = np.array([0.0, 0.0, 4_000.0]), ((8.0, 1.0), (20.0, 0.4)), 50.0, 1500
    rows = []
    for i, e, no, h in pipeline_queries.network():
        for p, v in pipeline_queries.VELOCITIES.items():
            tt = math.dist(where, (e, no, -h)) / v
            x = sum(a * np.exp(-((np.arange(n) / rate - t - tt) ** 2) / (2 * 0.1**2)) for t, a in origins)
            rows.append((0, i, p, pipeline_queries.START, rate, x.tolist()))
    images = spark.createDataFrame(rows, "batch_id long, sta_idx long, phase string, tmin_us long, rate_hz double, samples array<double>")
    found = sorted(pipeline_queries.srch.search(images, pipeline_queries.network(), pipeline_queries.settings(incremental=incremental)).collect(), key=lambda r: r.time_us)
    assert len(found) == 2
    for f, (t, a) in zip(found, origins):
        assert abs((f.time_us - pipeline_queries.START) / 1e6 - t) < 0.15 and math.dist((f.east, f.north, f.depth), where) < 700 and f.semblance > 1.5 * a
        assert f.node_size == 250


def test_true_model_scores_best(spark, data):
    s = {r.model: r.score or 0 for r in pipeline_queries.velocity_model_scores(spark, data).collect()}
    assert s["true"] > s["slow"] and s["true"] > s["fast"]


def test_kernel_against_rows():
    r = np.random.RandomState(0)
    x = [r.rand(50) for _ in range(6)]
    off, sh, w = r.randint(0, 5, 6), r.randint(-20, -2, (9, 6)), r.rand(9, 6)
    w[2, 3] = 0
    full = np.zeros((9, 80))
    for n in range(9):
        for k in range(6):
            for i, v in enumerate(x[k]):
                full[n, off[k] + sh[n, k] + i + 20] += w[n, k] * v
    best, idx = stack.kernel(x, off, sh, w, -20, 60)
    assert np.allclose(best, full.max(0)) and (idx == full.argmax(0)).all()
    a = stack.kernel(x, off, sh[:4], w[:4], -20, 60)
    skip = np.zeros(9, bool)
    skip[:4] = True
    b = stack.kernel(x, off, sh, w, -20, 60, skip=skip, best=a[0], index=a[1])
    assert np.allclose(b[0], best) and (b[1] == idx).all()


def test_peaks_and_prominence():
    x = np.array([0, 2, 0, 5, 5, 5, 1, 3, 0, 4, 3.5, 4, 0])
    assert signal.find_peaks(x).tolist() == [1, 4, 7, 9, 11]
    assert signal.find_peaks(x, height=3).tolist() == [4, 7, 9, 11]
    assert signal.find_peaks(x, distance=4).tolist() == [4, 11]
    assert signal.find_peaks(x, prominence=1).tolist() == [1, 4, 7, 9, 11][:3] + [9, 11]
    assert signal.peak_prominence(x, 7) == 2


def test_filters_and_resampling():
    t = np.arange(4000) / 100
    low, high = np.sin(2 * np.pi * 0.5 * t), np.sin(2 * np.pi * 20 * t)
    y = signal.band_filter(low + high, 100, 5, None)
    assert np.abs(y - high)[500:-500].max() < 0.05
    y = signal.band_filter(low + high, 100, None, 5)
    assert np.abs(y - low)[500:-500].max() < 0.05
    y = signal.band_filter(low + high + np.sin(2 * np.pi * 5 * t), 100, 2, 10)
    assert np.abs(y - np.sin(2 * np.pi * 5 * t))[500:-500].max() < 0.06
    assert (signal.band_filter(low, 100, None, 50) == low).all()
    z = signal.resample(low, 0.01, 0.04)
    assert len(z) == 1000 and np.abs(z - np.sin(2 * np.pi * 0.5 * np.arange(1000) / 25))[20:-20].max() < 0.01
    z = signal.resample(low, 0.01, 0.004)
    assert np.abs(z - np.sin(2 * np.pi * 0.5 * np.arange(len(z)) / 250))[60:-60].max() < 0.01
    h = signal.pole_zero(*signal.WOOD_ANDERSON)
    back = signal.restitute(signal.restitute(high, 100, h, low=1), 100, lambda f: np.ones(len(f)), low=0, then=h)
    assert np.corrcoef(back[500:-500], high[500:-500])[0, 1] > 0.99


def test_travel_times():
    model = [(0.0, float("inf"), 5000.0, 3000.0, 0.0, 0.0)]
    xs, zs = np.arange(0, 20_001, 500.0), np.arange(500, 10_001, 500.0)
    t = traveltime.ray_table(model, "vp", xs, zs)
    want = np.sqrt(xs[None] ** 2 + zs[:, None] ** 2) / 5000
    assert np.nanmax(np.abs(t - want)) < 0.01
    two = traveltime.ray_table(traveltime.layers(), "vp", np.array([0.0, 100_000.0, 200_000.0]), np.array([2000.0]))
    assert two[0, 0] == pytest.approx(1000 / 5500 + 1000 / 6000, abs=0.01)
    assert two[0, 2] < 200_000 / 6500
    g = traveltime.eikonal(np.full((41, 41), 1 / 5000.0), 100.0, (20, 20))
    i, j = np.meshgrid(np.arange(41) - 20, np.arange(41) - 20, indexing="ij")
    assert np.abs(g - np.hypot(i, j) * 100 / 5000).max() < 0.03 * np.sqrt(800) * 100 / 5000  # a first-order scheme at 20 cells, converged
    cube = traveltime.eikonal(np.full((15, 15, 15), 1 / 3000.0), 100.0, (7, 7, 7))
    assert cube[14, 7, 7] == pytest.approx(700 / 3000, rel=1e-6)
    assert traveltime.parse_nd("0 5 3 2.7\nmantle\n1 6 3.5 2.7 # x") == ((0.0, 5.0, 3.0), (1.0, 6.0, 3.5))


def test_octree_is_complete(spark):
    b = octree.Bounds((-2.0, 2.0), (-2.0, 2.0), (0.0, 2.0))
    r = octree.roots(spark, b, 1.0)
    assert r.count() == 32 and octree.level_set(spark, b, 1.0, 2).count() == 32 * 64
    ids = [x.node_id for x in r.unionByName(octree.split(r, 3)).collect()]
    assert len(set(ids)) == len(ids)
    with pytest.raises(ValueError):
        octree.roots(spark, b, 1.5)


def test_geo(spark):
    df = spark.createDataFrame([(10.0, 10.0, 0.0, 0.0), (10.0, 10.0, 3000.0, -4000.0)], "lat double, lon double, east double, north double")
    d = dict(lat="lat", lon="lon", east="east", north="north")
    origin = dict(lat=F.lit(10.0), lon=F.lit(10.0), east=F.lit(0.0), north=F.lit(0.0))
    assert [round(x[0], 6) for x in df.select(geo.surface_distance(d, origin)).collect()] == [0.0, 5000.0]
    x = spark.range(1).select(geo.ellipsoid_distance(0.0, 0.0, 0.0, 1.0).alias("d"), geo.azimuth(1.0, 0.0).alias("a"), geo.ellipsoid_distance(0.0, 0.0, 1.0, 0.0).alias("n")).first()
    assert x.d == pytest.approx(111319.54, abs=60) and x.a == 90 and x.n == pytest.approx(110574, abs=60)
    m = df.select(geo.effective_lat(east="east", north="north").alias("a"), geo.effective_lon(east="east", north="north").alias("o")).collect()
    assert (m[0].a, m[0].o) == (10.0, 10.0) and m[1].a < 10 < m[1].o


def test_codes_and_models(spark):
    df = spark.createDataFrame([("6E.TE.00",), ("6E.TEST1.",), ("GE.TE.",)], "c string")
    hit = lambda p: [x[0] for x in df.where(codes.nsl_matches(F.col("c"), p)).collect()]
    assert hit("6E") == ["6E.TE.00", "6E.TEST1."] and hit("*.TE") == ["6E.TE.00", "GE.TE."] and hit("6E.TE*.") == hit("6E") and hit("6E.TEST?") == ["6E.TEST1."]
    line = "ZB VOSXX 00 HHZ D 2021/10/08 04:20:36.4200  -  2021/10/08 11:31:00.2200"
    s = spark.createDataFrame([(line,)], "line string").select(codes.station_line(F.col("line")).alias("s")).first().s
    assert (s.nsl, s.channel, s.dataquality) == ("ZB.VOSXX.00", "HHZ", "D") and s.starttime.microsecond == 420000 and s.endtime.hour == 11
    rows = spark.range(1).select(*[attenuation.magnitude_of(m, F.lit(1e-4), F.lit(50_000.0), F.lit(49_000.0)).alias(n) for n, m in attenuation.MODELS.items()]).first().asDict()
    assert rows["SouthernCalifornia"] == pytest.approx(-1 + 1.11 * math.log10(0.5) - 0.00189 * 50 + 3)
    assert rows["EasternNorthAmerica"] is None and rows["CampiFlegrei"] is None and rows["CaliforniaIntegratedSeismicNetwork"] is not None
    assert len(attenuation.MODELS) == 19


def test_records_round_trip(spark, tmp_path):
    r = np.random.RandomState(3)
    whole = np.cumsum(r.choice([0, 1, -3, 200, -40_000, 5_000_000], 3000)).astype(float)
    whole = np.clip(whole, -(2**29), 2**29)
    part = r.normal(size=700)
    for x, rate in ((whole, 100.0), (part, 0.5), (np.array([7.0]), 1.0)):
        got = list(mseed.records(mseed.encode("XX", "STA", "", "HHZ", 1_700_000_000_123_456, rate, x)))
        assert np.array_equal(np.concatenate([g[-1] for g in got]), x)
        assert got[0][:6] == ("XX", "STA", "", "HHZ", 1_700_000_000_123_456, rate)
    seg = spark.createDataFrame([("XX", "STA", "00", "HHZ", 1_700_000_000_000_000, 100.0, whole.tolist()), ("XX", "STA", "00", "LHZ", 1_700_000_000_000_000, 1.0, [1.0, 2.0]), ("XX", "STB", "", "HHE", 1_700_090_000_000_000, 100.0, part.tolist())], "network string, station string, location string, channel string, tmin_us long, rate_hz double, samples array<double>")
    assert sinks.write_traces(seg, str(tmp_path / "sds")).count() == 3
    (tmp_path / "sds" / "junk.bin").write_bytes(b"no record at all")
    back = archives.read_traces(spark, str(tmp_path / "sds"))
    assert {(x.station, x.channel) for x in back.collect()} == {("STA", "HHZ"), ("STB", "HHE")}
    day = archives.read_traces(spark, str(tmp_path / "sds"), layout="sds", startday="2023-11-15", channels="HH")
    assert {x.station for x in day.collect()} == {"STB"}
    assert archives.parse_path("/a/XX.STA.00.HHZ.D.2023.318") == ("XX", "STA", "00", "HHZ", 2023, 318)
    q = archives.watch_traces(spark, str(tmp_path / "sds"), settle_s="0").writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("seen").count() == back.count()
    merged = ingest.merge_gaps(back.select(F.concat_ws(".", "network", "station", "location", "channel").alias("nslc"), "rate_hz", "tmin_us", "samples"))
    got = {x.nslc: x.samples for x in merged.collect()}
    assert got["XX.STA.00.HHZ"] == whole.tolist()


def test_gap_merge_policies(spark):
    s = spark.createDataFrame([("a", 1.0, 0, [1.0, 2.0]), ("a", 1.0, 2_000_000, [3.0]), ("a", 1.0, 5_000_000, [6.0, 7.0]), ("a", 1.0, 6_000_000, [9.0, 9.0]), ("a", 1.0, 50_000_000, []), ("a", 2.0, 0, [4.0])], "nslc string, rate_hz double, tmin_us long, samples array<double>")
    got = lambda **k: sorted((x.rate_hz, x.tmin_us, x.samples) for x in ingest.merge_gaps(s, **k).collect())
    assert got() == [(1.0, 0, [1.0, 2.0, 3.0]), (1.0, 5_000_000, [6.0, 7.0, 9.0]), (2.0, 0, [4.0])]
    assert got(max_gap_samples=2, overlap="last")[0] == (1.0, 0, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 9.0, 9.0])


def test_merging_over_midnight_and_in_long_runs(spark):
    day, r = 86_400_000_000, np.random.RandomState(4)
    x = r.normal(size=4000)
    cuts = [0, 300, 1000, 1900, 2600, 4000]
    rows = [("a", 0.01, i * 100_000_000, x[i:j].tolist()) for i, j in zip(cuts, cuts[1:])]  # 4000 samples of 100 s are over four days
    rows += [("a", 0.01, 950 * 100_000_000, x[950:1300].tolist()), ("b", 1.0, day - 2_000_000, [1.0, 2.0]), ("b", 1.0, day, [3.0, 4.0]), ("b", 1.0, day + 3_000_000, [5.0])]
    s = spark.createDataFrame(rows, "nslc string, rate_hz double, tmin_us long, samples array<double>")
    got = {(m.nslc, m.tmin_us): m.samples for m in ingest.merge_gaps(s).collect()}
    assert got == {("a", 0): x.tolist(), ("b", day - 2_000_000): [1.0, 2.0, 3.0, 4.0], ("b", day + 3_000_000): [5.0]}
    cut = sorted((m.tmin_us, m.samples) for m in ingest.merge_gaps(s, longest_us=day).where("nslc = 'a'").collect())
    assert len(cut) == 5 and sum((v for _, v in cut), []) == x.tolist()
    assert all(t % day == 0 for t, _ in cut)
    assert ingest.merge_gaps(s.where("false")).count() == 0


def test_chopping_padding_and_batches(spark):
    s = spark.createDataFrame([("a", 10.0, 1_000_000, [float(i) for i in range(40)]), ("b", 10.0, 0, [1.0])], "nslc string, rate_hz double, tmin_us long, samples array<double>")
    x = ingest.chop(s, F.lit(1_250_000), F.lit(1_500_000)).collect()
    assert [(r.nslc, r.tmin_us, r.samples) for r in x] == [("a", 1_300_000, [3.0, 4.0])]
    y = {r.nslc: (r.tmin_us, r.samples) for r in ingest.extend(s, F.lit(800_000), F.lit(5_200_000)).collect()}
    assert y["a"] == (800_000, [0.0, 0.0, *[float(i) for i in range(40)], 0.0, 0.0]) and y["b"] == (0, [1.0] + [0.0] * 51)
    b = ingest.trace_batches(s, 1_000_000, 200_000)
    got = {(r.nslc, r.batch_id): (r.tmin_us, len(r.samples)) for r in b.collect()}
    assert got[("a", 1)] == (1_000_000, 12) and got[("a", 2)] == (1_800_000, 14) and got[("b", 0)] == (0, 1)
    assert {r.batch_id for r in ingest.long_enough(b, 1_200_000).collect()} == {2, 3, 4} - ({4} if got[("a", 4)][1] < 13 else set())
    assert ingest.padding_us(1.0, 4.5, 0.5, 2.0) == 6_000_000


def test_channels_combine_within_one_sample(spark):
    rows = [("s", "HHE", 10.0, 0, [3.0, 3.0, 3.0]), ("s", "HHN", 10.0, 100_000, [4.0, 4.0]), ("t", "HHE", 10.0, 0, [1.0, 1.0]), ("t", "HHN", 10.0, 300_000, [1.0, 1.0]), ("u", "HHE", 10.0, 0, [1.0])]
    t = spark.createDataFrame(rows, "nsl string, channel string, rate_hz double, tmin_us long, samples array<double>")
    got = [(r.nsl, r.tmin_us, r.samples) for r in ingest.combine_channels(t, ["nsl"], "EN", 2).collect()]
    assert got == [("s", 100_000, [5.0, 5.0])]
    assert ingest.combine_channels(t, ["nsl"], "EN", 2, "avg").first().samples == [3.5, 3.5]


def test_watched_archive_reads_every_file(spark, tmp_path):
    import os
    import time

    root = tmp_path / "sds"
    root.mkdir()
    now = time.time() - 1000

    def put(name, at):
        (root / name).write_bytes(mseed.encode("XX", name, "", "HHZ", 0, 1.0, np.array([1.0])))
        os.utime(root / name, (at, at))

    def seen():
        q = archives.watch_traces(spark, str(root), settle_s="30").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r.station for r in spark.read.schema(archives.SEGMENTS).parquet(str(tmp_path / "out")).collect())

    put("A", now)
    put("B", now + 1)
    put("NEW", time.time())  # not settled
    assert seen() == ["A", "B"]
    put("C", now + 2)
    put("A", now + 3)  # written again
    assert seen() == ["A", "A", "B", "C"]
    assert seen() == ["A", "A", "B", "C"]


def test_damaged_records_are_passed_over():
    a, b = mseed.encode("XX", "A", "", "HHZ", 0, 1.0, np.arange(900.0)), mseed.encode("XX", "B", "", "HHZ", 0, 1.0, np.array([5.0]))
    bad = bytearray(a[:512])
    bad[64:68] = b"\xff\xff\xff\xff"
    bad[128:132] = b"\x00\x00\x00\x00"
    skipped = []
    got = list(mseed.records(a + b"?" * 512 + b + bytes(bad[:40]), skipped=skipped))
    assert [g[1] for g in got][-1] == "B" and len(skipped) >= 1
    with pytest.raises(ValueError):
        list(mseed.records(a + b"?" * 512 + b, strict=True))


def test_options_narrow_the_archive(spark, tmp_path):
    day = 86_400_000_000
    seg = spark.createDataFrame([("XX", s, "", "HHZ", k * day + 1, 1.0, [1.0, 2.0]) for s in ("A", "B") for k in range(6)], "network string, station string, location string, channel string, tmin_us long, rate_hz double, samples array<double>")
    sinks.write_traces(seg, str(tmp_path / "sds")).collect()
    t = archives.read_traces(spark, str(tmp_path / "sds"), filespertask="1")
    one = archives.read_traces(spark, str(tmp_path / "sds"), filespertask="1", stations="XX.A.", tmin_us=str(2 * day), tmax_us=str(3 * day))
    assert t.where("station = 'A'").count() == 6 and t.count() == 12
    assert [(r.station, r.tmin_us) for r in one.collect()] == [("A", 2 * day + 1)]
    assert one.rdd.getNumPartitions() < t.rdd.getNumPartitions() == 12


def test_downsampled_and_image_traces():
    t = np.arange(6000) / 100
    slow = np.sin(2 * np.pi * 0.5 * t)
    y = signal.downsample(slow + np.sin(2 * np.pi * 23 * t), 10)
    assert len(y) == 600 and np.abs(y - slow[::10])[20:-20].max() < 0.02
    assert len(signal.downsample(slow, 3, repeat=2)) == 4000
    x = np.exp(-((t - 30) ** 2))
    z = signal.resample_image(x, 100.0, 40.0)
    assert len(z) == 2400 and z.max() == pytest.approx(x.max()) and abs(z.argmax() / 40 - 30) < 0.05


def test_block_filter_is_the_recursion():
    r = np.random.RandomState(5)
    sos = signal.butterworth(4, (2.0, 20.0), "band", 100.0)
    x = r.normal(size=(2, 777))
    want = x.copy()
    for b0, b1, b2, _, a1, a2 in sos:
        s1 = s2 = np.zeros(2)
        for i in range(777):
            v = want[:, i]
            o = b0 * v + s1
            s1, s2 = b1 * v - a1 * o + s2, b2 * v - a2 * o
            want[:, i] = o
    assert np.allclose(signal.sos_filter(sos, x), want, atol=1e-10)


def test_swarm_alerts_wait_for_the_watermark(spark, tmp_path):
    r = np.random.RandomState(6)
    rows = sorted({int(t) for t in np.r_[r.uniform(0, 10**9, 60), 5 * 10**8 + r.uniform(0, 10**7, 40)]})
    rows = list(enumerate(rows))
    r.shuffle(rows)
    rows.append((1000, 3 * 10**9))
    for k in range(8):  # in any order over eight batches
        spark.createDataFrame([("x", int(i), int(t)) for i, t in (rows[k::8] if k < 7 else rows[7::8])], "source string, seq long, time_us long").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = live.read_table(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in/0")).schema, 1)
    live.drive(live.swarm_alerts(stream, 10**7, 4, "4000 seconds"), str(tmp_path / "ck"), live.idempotent_writer(str(tmp_path / "out")))
    spark.createDataFrame([("x", 2000, 9 * 10**9)], "source string, seq long, time_us long").coalesce(1).write.parquet(str(tmp_path / "in/9"))
    live.drive(live.swarm_alerts(live.read_table(spark, str(tmp_path / "in"), stream.schema, 1), 10**7, 4, "4000 seconds"), str(tmp_path / "ck"), live.idempotent_writer(str(tmp_path / "out")))
    got = sorted(x.time_us for x in spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out")).collect())
    times, want, above = sorted(t for _, t in rows), [], False
    for i, t in enumerate(times):
        n = sum(t - 10**7 <= u <= t for u in times[: i + 1])
        if n >= 4 and not above:
            want.append(t)
        above = n >= 4
    assert len(want) > 1 and got == want


def test_last_state_of_streams(spark):
    rows = spark.createDataFrame([("a", 1, 0), ("b", 1, 0), ("a", 2, 1)], "k string, n long, batch long")
    key = lambda m: sorted((r.k, r.n) for r in live.last_state(rows, m, ["k"]).collect())
    assert key("append") == [("a", 1), ("a", 2), ("b", 1)] and key("complete") == [("a", 2)] and key("update") == [("a", 2), ("b", 1)]


def test_a_rewrite_that_was_cut_off_is_mended(spark, tmp_path):
    at = str(tmp_path / "t")
    spark.range(5).write.parquet(f"{at}.old")
    spark.range(9).write.parquet(f"{at}.new")
    sinks.restore(spark, at)
    assert spark.read.parquet(at).count() == 5 and sorted(x.name for x in tmp_path.iterdir() if not x.name.startswith(".")) == ["t"]


def test_search_takes_cores_and_refuses_mixed_images(spark):
    e, images = pipeline_queries._images(spark, 2)
    mixed = images.withColumn("rate_hz", F.when(F.col("sta_idx") == 3, 25.0).otherwise(F.col("rate_hz")))
    for bad, text in ((mixed, "differ in rate"), (images.unionByName(images.where("sta_idx = 1")), "more than one image")):
        with pytest.raises(Exception, match=text):
            pipeline_queries.srch.search(bad, pipeline_queries.network(), pipeline_queries.settings()).collect()


def test_inventories_and_catalogs(spark, tmp_path):
    (tmp_path / "s.xml").write_text('<FDSNStationXML><Network code="XX"><Station code="STA"><Latitude>1.5</Latitude><Longitude>2.5</Longitude><Elevation>10</Elevation><Channel code="HHZ" locationCode="00"><Latitude>1.6</Latitude><Longitude>2.6</Longitude><Elevation>11</Elevation><Depth>2</Depth></Channel></Station><Station code="STB"><Latitude>3</Latitude><Longitude>4</Longitude><Elevation>0</Elevation></Station></Network></FDSNStationXML>')
    got = {(x.station, x.location): (x.lat, x.depth) for x in archives.read_station_xml(spark, str(tmp_path / "s.xml")).collect()}
    assert got == {("STA", "00"): (1.6, 2.0), ("STB", ""): (3.0, 0.0)}
    (tmp_path / "s.yaml").write_text("stations:\n- network: XX\n  station: STA\n  lat: 1.5\n  lon: 2\n- network: XX\n  station: STB\n  location: '00'\n  lat: 3\n")
    assert [(x.station, x.location, x.lat) for x in archives.read_station_yaml(spark, str(tmp_path / "s.yaml")).collect()] == [("STA", "", 1.5), ("STB", "00", 3.0)]
    lines = [json.dumps({"uid": "a", "time": "2024-01-01T00:00:00Z", "semblance": 0.5, "magnitudes": [{"magnitude": "ml", "average": 1.0}]}), "{broken", json.dumps({"time": "2024-01-01T00:00:00Z"})]
    (tmp_path / "events.json").write_text("\n".join(lines))
    good, bad = archives.read_catalog(spark, str(tmp_path / "events.json"))
    assert [x.uid for x in good.collect()] == ["a"] and bad.count() == 2
    (tmp_path / "r.json").write_text(json.dumps({"event_uid": "a", "receivers": [{"network": "XX", "station": "STA", "location": "", "phase_arrivals": {"cake:P": {"model": {"time": "2024-01-01T00:00:01Z"}, "station_delay": 0.1}}}]}))
    x = archives.read_receivers(spark, str(tmp_path / "r.json")).first()
    assert (x.phase, x.observed_time, x.station_delay_s) == ("cake:P", None, 0.1)
    (tmp_path / "c.json").write_text('{"XX.STA.": {"cake:P": 0.25}}')
    assert [tuple(r) for r in archives.read_corrections(spark, str(tmp_path / "c.json")).collect()] == [("XX.STA.", "cake:P", 0.25)]
    (tmp_path / "run1").mkdir()
    (tmp_path / "run1" / "search.json").write_text("{}")
    assert archives.find_runs(str(tmp_path)) == [str(tmp_path / "run1")]
    made = []
    for _ in range(2):
        assert archives.table_of_hash(spark, str(tmp_path / "tt"), "abc", lambda: made.append(1) or spark.range(3)).count() == 3
    assert len(made) == 1


def test_sinks(spark, data, tmp_path):
    e = catalog_queries.ev(spark, data).where("lat is not null and not isnan(lat) and lon is not null").limit(50)
    n = sinks.write_geopackage(e, str(tmp_path / "e.gpkg"))
    con = sqlite3.connect(tmp_path / "e.gpkg")
    assert con.execute("select count(*) from events").fetchone()[0] == n == e.count()
    sinks.write_csv(e, str(tmp_path / "csv"), ["event_time"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == n
    sinks.append_events(e, str(tmp_path / "json"))
    sinks.append_events(e, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2 * n
    sinks.write_simple(catalog_queries.ev(spark, data), spark.read.parquet(f"{data}/picks.parquet"), str(tmp_path / "simple"), 0.5, 0.5)
    assert spark.read.option("header", True).csv(str(tmp_path / "simple/picks")).where("confidence <= 0.5").count() == 0
    e.write.parquet(str(tmp_path / "t"))
    sinks.rewrite(spark.read.parquet(str(tmp_path / "t")).limit(3), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3
    assert sinks.velocity_lines(traveltime.layers())[0].split() == ["5.50", "-1.00", "3.59"]


def test_stream_resumes_and_survives_callbacks(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(5).write.parquet(f"{src}/a")
    calls, said = [], []
    hooks = [lambda df, k: calls.append(k), lambda df, k: 1 / 0]
    go = lambda: live.drive(live.read_table(spark, src, spark.range(1).schema, 10), str(tmp_path / "ck"), live.idempotent_writer(out, hooks, said.append))
    go()
    spark.range(5, 8).write.parquet(f"{src}/b")
    go()
    go()
    assert sorted(r.id for r in spark.read.option("recursiveFileLookup", "true").parquet(out).collect()) == list(range(8))
    assert len(calls) == 2 and len(said) == 2


def brute_dbscan(p, eps, least):
    d = np.linalg.norm(p[:, None] - p[None], axis=2) <= eps
    core = d.sum(1) >= least
    label = np.full(len(p), -1)
    for i in np.flatnonzero(core):
        if label[i] == -1:
            todo, label[i] = [i], i
            while todo:
                k = todo.pop()
                for j in np.flatnonzero(d[k] & core & (label == -1)):
                    label[j] = i
                    todo.append(j)
    for i in np.flatnonzero(~core):
        near = np.flatnonzero(d[i] & core)
        if len(near):
            dist = np.linalg.norm(p[near] - p[i], axis=1)
            label[i] = label[near[np.lexsort((near, dist))[0]]]
    return label


@pytest.mark.parametrize("seed", [0, 1])
def test_dbscan(spark, seed):
    r = np.random.RandomState(seed)
    p = np.concatenate([r.normal((0, 0, 0), 0.6, (150, 3)), r.normal((4, 0, 0), 0.5, (80, 3)), r.uniform(-6, 8, (70, 3)), np.tile([[9.0, 9.0, 9.0]], (40, 1)), np.stack([np.arange(30) * 0.3, np.full(30, -5.0), np.zeros(30)], 1)])
    rows = [(i, *map(float, x)) for i, x in enumerate(p)] + [(999, None, 1.0, 1.0)]
    got = {x.id: x.label for x in cluster.dbscan(spark.createDataFrame(rows, "id long, e double, n double, d double"), "id", ["e", "n", "d"], 0.7, 5).collect()}
    want = brute_dbscan(p, 0.7, 5)
    assert got.pop(999) == -1
    assert {k: int(v) for k, v in got.items()} == dict(enumerate(want.tolist()))


def test_fits():
    m = np.arange(0, 4, 0.1)
    n = 5000 * detection_density(m, 2.3, 1.0, 0.25)
    beta, mu, sigma, _ = emr_fit(m, n)
    assert beta == pytest.approx(2.3, rel=0.05) and mu == pytest.approx(1.0, abs=0.1) and sigma == pytest.approx(0.25, abs=0.1)
    x = np.linspace(-3, 3, 200)
    d = gaussian_density(x, np.exp(-x * x / 2), x)
    assert np.trapezoid(d, x) == pytest.approx(1, abs=0.05)


def test_registry(tmp_path):
    @registry.register("preprocess", "at_least")
    def at_least(df, column, value=0):
        return [x for x in df if x[column] >= value]

    run = registry.chain("preprocess", [{"use": "at_least", "column": "a", "value": 2}])
    assert run([{"a": 1}, {"a": 2}]) == [{"a": 2}]
    for bad in ({"use": "none"}, {"use": "at_least", "other": 1}):
        with pytest.raises(ValueError):
            registry.build("preprocess", bad)
    (tmp_path / "x.py").write_text("def load():\n    return [1]\n")
    assert registry.load_script(str(tmp_path / "x.py")) == [1]
    said = []

    class Hook:
        def start(self):
            raise RuntimeError("no")

    registry.run_hooks([Hook()], "start", log=said.append)
    registry.run_hooks([Hook()], "stop", log=said.append)
    assert said == ["Hook.start: no"]


def test_travel_times_and_weights_take_every_station(spark, tmp_path):
    at = str(tmp_path)
    s = spark.read.parquet("/root/testdata/sf0.01/stations.parquet")  # the last ids as large as at scale 2
    s.withColumn("sta_idx", F.when(F.col("sta_idx") > 200, F.col("sta_idx") + 48_000).otherwise(F.col("sta_idx"))).write.parquet(f"{at}/stations.parquet")
    ids = np.array(sorted(r.sta_idx for r in catalog_queries.sts(spark, at).collect()))
    assert (ids > 60).sum() > 50
    nodes = sorted(octree.roots(spark, signal_queries.B, signal_queries.SIZE).collect(), key=lambda r: r.node_id)
    xyz = np.array([(r.east, r.north, r.depth) for r in nodes])
    d = np.sqrt((xyz[:, :1] - (ids * 7919 % 20000 - 10000.0)) ** 2 + (xyz[:, 1:2] - (ids * 104729 % 20000 - 10000.0)) ** 2 + xyz[:, 2:] ** 2)
    span = signal_queries.travel_time_span(spark, at).toPandas().set_index("node_id").sort_index()
    assert np.allclose(span["first"], d.min(1) / 5000, atol=1e-6) and np.allclose(span["last"], d.max(1) / 5000, atol=1e-6)
    dk = np.sort(d, axis=1)[:, 4:5]
    w = 0.9 * np.where(d <= dk, 1, np.exp(-((d - dk) ** 2) / (2 * (20_000 / 2.355) ** 2))) + 0.1
    w /= w.sum(1, keepdims=True)
    got = signal_queries.distance_weights(spark, at).toPandas().pivot(index="node_id", columns="sta_idx", values="weight").sort_index()
    assert got.columns.tolist() == ids.tolist() and np.allclose(got.to_numpy(), np.where(w < 1e-3, 0, w), atol=1e-6)
    tt = signal_queries.layered_travel_times(spark, at)
    assert sorted(r[0] for r in tt.select("sta_idx").distinct().collect()) == ids.tolist() and tt.count() == 2 * d.size


def test_rays_in_gradients_are_the_closed_form():
    model = traveltime.layers(((0.0, 5.0, 3.0), (30.0, 8.0, 4.8)))
    x, z = np.array([0.0, 10e3, 60e3, 100e3]), np.array([0.0, 1e3, 7.7e3, 20e3])
    for phase, v0, g in (("vp", 5.0, 0.1), ("vs", 3.0, 0.06)):
        want = np.arccosh(1 + g * g * ((x / 1e3) ** 2 + (z[:, None] / 1e3) ** 2) / (2 * v0 * (v0 + g * z[:, None] / 1e3))) / g
        assert np.allclose(traveltime.ray_table(model, phase, x, z), want, rtol=1e-6, atol=1e-9)


def test_rays_agree_with_the_eikonal_equation():
    profile = ((0, 4.0, 2.0), (2, 5.0, 2.5), (2, 6.0, 3.0), (6, 5.5, 2.8), (6, 6.5, 3.5), (20, 7.5, 4.0))
    model = traveltime.layers(profile)
    n, h = 151, 200.0
    depth, v = np.array([p[0] for p in profile], float), np.array([p[1] for p in profile])
    at = np.interp(np.arange(n) * h / 1e3 + 1e-6, depth + np.arange(6) * 1e-9, v)
    t = traveltime.eikonal(np.repeat((1e-3 / at)[None], n, 0), h, (0, 25))
    rays = traveltime.ray_table(model, "vp", np.arange(n) * h, np.array([5000.0]))[0]
    assert np.abs(t[20:, 0] / rays[20:] - 1).max() < 0.03
    assert traveltime.least_velocity(model, "vp") == 4000 and traveltime.least_velocity(model, "vs", 1000.0) == 2000


def test_modelled_amplitudes_of_every_row(spark):
    r = np.random.RandomState(5)
    rows = [(i, int(min(r.geometric(0.5), 4)), float(r.choice([r.randint(0, 40) * 10.0, r.uniform(0, 400)])), None if r.rand() < 0.1 else math.nan if r.rand() < 0.1 else float(r.lognormal())) for i in range(700)]
    rows += [(700 + i, 5, 70.0, float(i + 1)) for i in range(90)] + [(800, 6, 1.0, None), (801, 7, 3.0, 2.0)]
    got = {x.amp_id: x for x in magnitude.modelled_for_all(spark.createDataFrame(rows, "amp_id long, collection_id long, distance_epi double, peak_horizontal double"), "peak_horizontal").collect()}
    assert set(got) == {i for i, *_ in rows} - {800}
    for i, c, dist, _ in rows:
        if i != 800:
            v = np.array([x[3] for x in sorted((x for x in rows if x[1] == c and x[3] is not None and not math.isnan(x[3])), key=lambda x: (abs(x[2] - dist), x[0]))[:25]])
            m = np.median(v)
            assert (got[i].q_id, got[i].n) == (c, len(v))
            assert np.allclose([got[i].log_mean, got[i].log_median, got[i].rel_mad], [math.log10(v.mean()), math.log10(m), np.median(abs(v - m)) / m], atol=2e-6)


def test_kernel_leaves_absent_samples_out(spark):
    images = spark.createDataFrame([(0, 0, 0, [-1.0, -2.0]), (0, 1, 0, [-4.0, -3.0])], "batch_id long, trace_id long, offset long, samples array<double>")
    shifts = spark.createDataFrame([(0, 0, 0, 1.0), (0, 1, 0, 1.0), (1, 0, 1, 1.0), (1, 1, 5, 1.0)], "node_id long, trace_id long, shift long, weight double")
    got, want = (sorted(map(tuple, x.select("t", "v", "node_id").collect())) for x in (stack.stack_kernel(images, shifts), stack.reduce_max(stack.stack_rows(images, shifts))))
    assert got == want == [(0, -5.0, 0), (1, -1.0, 1), (2, -2.0, 1), (5, -4.0, 1), (6, -3.0, 1)]
