"""Magnitudes from traces, libraries, receivers, look-ups that must not miss."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackwave.functions import attenuation, geo, signal
from stackwave.operators import ingest, local_magnitude, magnitude, octree, picks, stations, synthetic, traveltime
from stackwave.plans import registry
from stackwave.sources import archives, sinks
from stackwave.streaming import live

RATE, N = 100.0, 6000
POLES, ZEROS, GAIN = [-4.44, 4.44, -4.44, -4.44], [0.0, 0.0, 0.0, 0.0], 4e8


def ground(amp, at, f0=5.0):
    t = np.arange(N) / RATE - at
    return amp * np.exp(-((t / 0.8) ** 2)) * np.cos(2 * np.pi * f0 * t)


def raw(x):
    """What a seismometer of poles and zeros writes of a displacement."""
    f = np.fft.rfftfreq(N, 1 / RATE)
    h = signal.pole_zero(np.array([-4.44 + 4.44j, -4.44 - 4.44j]), np.zeros(2), GAIN)
    return np.fft.irfft(np.fft.rfft(x) * h(f), N)


def test_local_magnitudes_from_traces(spark):
    r = np.random.RandomState(1)
    rows, arrivals, want = [], [], {}
    model = attenuation.MODELS["SouthernCalifornia"]
    wa = abs(signal.pole_zero(*signal.WOOD_ANDERSON)(np.array([5.0]))[0])
    for i, (amp, noise, km) in enumerate([(1e-6, 1e-10, 30.0), (3e-5, 1e-9, 80.0), (1e-8, 9e-9, 50.0), (1e-6, 1e-10, 5.0)]):
        for c, part in (("HHN", 1.0), ("HHE", 0.4), ("HHZ", 2.0)):
            x = ground(amp * part, 32.0) + noise * np.cos(2 * np.pi * 3.0 * np.arange(N) / RATE + r.rand())
            rows.append(("ev", f"XX.S{i}.", c, RATE, 1_000_000_000, raw(x).tolist()))
        arrivals.append(("ev", f"XX.S{i}.", 1_030_000_000, km * 1000, km * 1000))
        want[f"XX.S{i}."] = math.log10(amp * wa * 1000) + 1.11 * math.log10(km / 100) + 0.00189 * (km - 100) + 3
    rows.append(("ev", "XX.S9.", "HHN", RATE, 0, [0.0] * N))
    traces = spark.createDataFrame(rows, local_magnitude._SHAPED)
    resp = [(f"XX.S{i}.", c, 0, 10**13, POLES, ZEROS, GAIN) for i in range(4) for c in ("HHN", "HHE", "HHZ")] + [("XX.S0.", "HHN", -(10**9), 1, POLES, ZEROS, 1.0), ("XX.S0.", "HHN", -5, None, POLES, ZEROS, 1.0)]
    responses = spark.createDataFrame(resp, "nsl string, channel string, start_us long, end_us long, poles array<double>, zeros array<double>, constant double")
    arr = spark.createDataFrame(arrivals, "event_uid string, nsl string, p_us long, distance_hypo double, distance_epi double")
    got = {x.nsl: x for x in local_magnitude.station_magnitudes(traces, responses, arr, model).collect()}
    assert set(got) == {"XX.S0.", "XX.S1.", "XX.S2."}  # the last is nearer than the model reaches
    for k in ("XX.S0.", "XX.S1."):
        assert abs(got[k].magnitude - want[k]) < 0.02 and got[k].flag == "valid" and got[k].snr > 50
    assert got["XX.S2."].flag == "low_snr" and got["XX.S2."].error > got["XX.S0."].error
    vertical = local_magnitude.station_magnitudes(traces, responses, arr, attenuation.MODELS["SouthWestGermany"]).where("nsl = 'XX.S0.'").first()
    assert vertical.peak_amp == pytest.approx(2e-6 * wa, rel=0.03)
    fast = local_magnitude.station_magnitudes(traces, responses, arr, attenuation.MODELS["WebnetWesternBohemia"]).where("nsl = 'XX.S0.'").first()
    assert fast.peak_amp == pytest.approx(1e-6 * math.sqrt(1 + 0.16 + 4) * 2 * math.pi * 5, rel=0.05)
    assert {m.instrument for m in attenuation.MODELS.values()} == {None, "wood-anderson", "wood-anderson-old", "wood-anderson-2800"}
    net = magnitude.network_magnitude(local_magnitude.station_magnitudes(traces, responses, arr, model).drop("noise"), 2.0, 2).first()
    assert net.n == 2 and min(want["XX.S0."], want["XX.S1."]) - 0.1 < net.average < max(want["XX.S0."], want["XX.S1."]) + 0.1


def test_reference_search(spark):
    cases = [({-1: 9.0, 0: 2.4, 1: 2.2, 2: 2.1, 3: 2.6}, 2.1), ({1: 4.2, 3: 3.4, 4: 3.3, 5: 3.2, 2: 3.1}, 3.4), ({1: 2.2, 2: 2.0}, None)]
    df = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(cases)], "i int, m map<int,double>")
    got = {r.i: r.v for r in df.select("i", magnitude.reference_search(F.col("m")).alias("v")).collect()}
    for i, (m, w) in enumerate(cases):
        assert got[i] == w


def test_library_and_suitability(spark, tmp_path):
    site = {"magnitude": 1.0, "distance_epi": 5.0, "peak_horizontal": 1.0, "peak_vertical": 2.0, "peak_absolute": 3.0}
    (tmp_path / "a.json").write_text(json.dumps({"uuid": "u", "gf_store_id": "g", "quantity": "displacement", "reference_magnitude": 1.0, "max_distance": 100.0, "amplitude_collections": [{"source_depth": 2000.0, "quantity": "displacement", "site_amplitudes": [site, site]}]}, indent=1))
    lib = archives.read_amplitude_library(spark, str(tmp_path))
    assert [(x.uuid, x.source_depth, x.peak_absolute) for x in lib.collect()] == [("u", 2000.0, 3.0)] * 2
    assert magnitude.suited(lib, {"gf_store_id": "g", "reference_magnitude": 1.0}, 100.0).count() == 2
    assert magnitude.suited(lib, {"gf_store_id": "h"}, 1.0).count() == 0 == magnitude.suited(lib, {"gf_store_id": "g"}, 101.0).count()


def test_local_against_moment(spark):
    rows = spark.createDataFrame([("a", "LocalMagnitude", 2.0), ("a", "MomentMagnitude", 1.5), ("b", "LocalMagnitude", 1.0)], "event_uid string, magnitude string, average double")
    assert [tuple(r) for r in magnitude.local_and_moment(rows).collect()] == [("a", 2.0, 1.5, 0.5)]


def test_models_by_code(spark):
    df = spark.createDataFrame([("Q0.HUB1.",), ("W5.A.00",), ("X1.B.",), (None,)], "nsl string")
    got = [r[0] for r in df.select(attenuation.model_by_code(F.col("nsl"), [("Q0.HUB*", "a"), ("Q0", "b"), ("W?", "c")])).collect()]
    assert got == ["a", "c", None, None]


def test_lookups_do_not_miss(spark):
    s = spark.createDataFrame([("a", 1.0)], "nsl string, lat double")
    assert stations.looked_up(spark.createDataFrame([("a", 5)], "nsl string, x int"), s).first().lat == 1.0
    with pytest.raises(KeyError, match="no station b"):
        stations.looked_up(spark.createDataFrame([("b", 5)], "nsl string, x int"), s)
    with pytest.raises(ValueError, match="no station is left"):
        stations.remaining(s.where("false"))
    assert picks.one_or_error(s, F.col("nsl") == "a", "receiver a").lat == 1.0
    with pytest.raises(KeyError, match="receiver z"):
        picks.one_or_error(s, F.col("nsl") == "z", "receiver z")


def test_receivers_merge_with_clashes(spark):
    p = spark.createDataFrame([(i, "e", "N", "S", None, ph, None, None, c, None) for i, (ph, c) in enumerate([("x:P", 0.1), ("x:P", 0.9), ("x:S", 0.5)])], "pick_id long, event_uid string, network string, station string, location string, phase string, model_time timestamp, observed_time timestamp, confidence double, station_delay_s double")
    a, b = picks.merge_receivers(p.where("phase = 'x:P'")), picks.merge_receivers(p.withColumn("confidence", F.lit(0.7)))
    got = picks.add_phase(a, b).first().arrivals
    assert got["x:P"].confidence == 0.7 and got["x:S"].confidence == 0.7
    assert picks.add_phase(b, a).first().arrivals["x:P"].confidence == 0.1
    assert picks.add_phase(a.where("false"), a).first().arrivals == a.first().arrivals == picks.add_phase(a, a.where("false")).first().arrivals


def test_small_helpers(spark):
    assert octree.axis_through_zero(-250.0, 1030.0, 100.0) == [float(x) for x in range(-300, 1101, 100)]
    assert len(octree.corners(octree.Bounds((0.0, 1.0), (0.0, 1.0), (0.0, 2.0)))) == 8
    p = live.progress(60_000_000, 0, 120_000_000, 1000, 2.0)
    assert p == {"bytes_per_s": 500.0, "speed": 30.0, "percent": 50.0, "remaining_s": 2.0}
    assert live.progress(0, 0, 0, 0, 0.0)["remaining_s"] == float("inf")
    b = ingest.blinded(spark.createDataFrame([(10.0, [1.0] * 6)], "rate_hz double, samples array<double>"), 0.2).first().samples
    assert b == [0.0, 0.0, 1.0, 1.0, 0.0, 0.0]
    assert live.magnitude_alerts(spark.createDataFrame([(1.0,), (None,), (math.nan,), (3.0,)], "m double"), "m", 1.0).count() == 2


def test_small_sinks(spark, tmp_path):
    s = spark.createDataFrame([("B", "S2", None, 1.0, 2.0, 3.0, 0.0), ("A", "S1", "00", 1.0, 2.0, None, 0.0)], "network string, station string, location string, lat double, lon double, elevation double, depth double")
    sinks.write_stations(s, str(tmp_path / "st"))
    back = archives.read_station_yaml(spark, next(str(p) for p in (tmp_path / "st/yaml").glob("part-*")))
    assert [(r.network, r.station, r.location, r.lat) for r in back.collect()] == [("A", "S1", "00", 1.0), ("B", "S2", "", 1.0)]
    t = spark.createDataFrame([(1, 0, 10.0, [0.1234, 0.5])], "batch_id long, tmin_us long, rate_hz double, samples array<double>")
    for _ in range(2):
        sinks.append_trace(t, str(tmp_path / "tr"))
        sinks.append_csv(s, str(tmp_path / "csv"))
    rows = spark.read.parquet(str(tmp_path / "tr")).collect()
    assert len(rows) == 2 and rows[0].samples == [123, 500]
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 4
    sinks.write_synthetic(s, t, str(tmp_path / "syn"))
    assert spark.read.json(str(tmp_path / "syn/json")).count() == 2


def test_more_helpers(spark):
    assert registry.tracer_for("S", [({"P"}, min), ({"P", "S"}, max)]) is max
    with pytest.raises(ValueError, match="no tracer offers X"):
        registry.tracer_for("X", [({"P"}, min)])
    a = spark.createDataFrame([(5,), (3,), (9,)], "time_us long")
    assert tuple(synthetic.spans(a).first()) == (3, 3, 9)
    assert [r.time_us for r in live.latest(a, "time_us", "time_us", 2).collect()] == [9, 5]
    assert [r.due_us for r in live.replay(a, "time_us", 3, 2.0).orderBy("time_us").collect()] == [0, 1, 3]
    x = np.sin(np.arange(50))
    p = spark.createDataFrame([("a", k, x.tolist()) for k in (1, 0)], "nslc string, k int, samples array<double>")
    assert np.allclose(synthetic.concatenated(p, ["k"]).first().samples, signal.overlap_concat([x, x], 0.2))
    assert traveltime.velocity_least_at(traveltime.layers(((0.0, 5.0, 3.0), (10.0, 6.0, 3.5))), 5000.0) == 3250.0
    c = spark.createDataFrame([(10.0, 20.0, 1000.0, 0.0, 5.0)], "lat double, lon double, e double, n double, d double")
    assert tuple(c.select(*geo.shifted("lat", "lon", "e", "n", "d", 1.0, 2.0, 3.0)).first()) == (10.0, 20.0, 1001.0, 2.0, 8.0)
    assert tuple(c.select(*geo.origin("lat", "lon")).first()) == (10.0, 20.0, 0.0, 0.0)
    moved = c.select(*geo.to_origin("lat", "lon", "e", "n")).first()
    assert moved[0] == pytest.approx(10.0, abs=1e-3) and moved[1] > 20.0 and moved[2:] == (0.0, 0.0)
