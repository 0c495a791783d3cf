"""The large-scale operators against brute force, and their defined cases."""

import math
import random
from datetime import datetime
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackwave.functions.timetext import interpret, interpret_all
from stackwave.operators import anomalies, intervals, ordered, proximity, timestamps
from stackwave.plans import problems

# -- intervals


def cover(rows):
    out = {}
    for k, s, e in rows:
        if k is not None and s is not None and e is not None and e > s:
            out.setdefault(k, []).append((s, e))
    periods, gaps = [], []
    for k, v in out.items():
        v.sort()
        a, b = v[0]
        for s, e in v[1:]:
            if s > b:
                periods.append((k, a, b))
                gaps.append((k, b, s))
                a = s
            b = max(b, e)
        periods.append((k, a, b))
    return sorted(periods), sorted(gaps)


@pytest.mark.parametrize("seed", [1, 7, 8])
def test_intervals(spark, monkeypatch, seed):
    r = random.Random(seed)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(seed == 7).lower())  # an entity in many cells, or in few, or whole
    monkeypatch.setattr(ordered, "WHOLE", 0 if seed < 8 else ordered.WHOLE)
    rows = [(r.choice("aaaaab") if i % 50 else None, r.randrange(3000), None) for i in range(800)]
    rows = [(k, s, s + r.randrange(-1, 6) if r.random() > 0.02 else None) for k, s, _ in rows] + [("a", 5, 9)] * 3 + [("b", -(10**15), -(10**15) + 1), ("b", 10**17, 10**17 + 5), ("c", 1, 2), ("c", 2, 3)]
    df = spark.createDataFrame([(k, s, e, "x") for k, s, e in rows], "ent string, s long, e long, t string")
    periods, gaps = cover(rows)
    assert sorted(map(tuple, intervals.coverage_gaps(df, "ent", "s", "e").collect())) == gaps
    assert sorted(map(tuple, intervals.coverage_periods(df, "ent", "s", "e").collect())) == periods
    assert intervals.coverage_gaps(df.where("false"), "ent", "s", "e").count() == 0
    assert intervals.coverage_periods(df.where("false"), "ent", "s", "e").count() == 0
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# -- proximity


@pytest.mark.parametrize("block", [25, 100_000])
def test_near_pairs(spark, block):
    r = np.random.RandomState(1)
    pts = [(i, float(a), float(o)) for i, (a, o) in enumerate(zip(r.normal(80, 4, 400), r.uniform(-400, 400, 400)))]
    pts += [(1000 + i, 10.0, 20.0) for i in range(120)] + [(2000, None, 1.0), (2001, 5.0, math.nan), (2002, 95.0, 1.0), (2003, 1.0, math.inf)]
    pts = [(k, min(a, 90.0) if a is not None and a < 94 else a, o) for k, a, o in pts]
    df = spark.createDataFrame(pts, "id long, lat double, lon double")
    u = proximity.unit_vectors(df, "id", "lat", "lon")
    got = {(x[0], x[1]) for x in proximity.near_pairs(u, u, 200_000.0, block).collect()}
    ok = [(k, a, o) for k, a, o in pts if a is not None and abs(a) <= 90 and o is not None and math.isfinite(o)]
    v = np.array([(math.cos(math.radians(a)) * math.cos(math.radians(o)), math.cos(math.radians(a)) * math.sin(math.radians(o)), math.sin(math.radians(a))) for _, a, o in ok])
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    want = {(ok[i][0], ok[j][0]) for i, j in zip(*np.nonzero(d <= proximity.chord(200_000.0)))}
    assert got == want
    named = proximity.unit_vectors(df.withColumn("nsl", F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("string"))), "id", "lat", "lon", [F.col("nsl")])
    got = sorted((x[0], x[1]) for x in proximity.near_pairs(named, named, 200_000.0, block, once=True, apart="nsl").collect())
    assert got == sorted((a, b) for a, b in want if a < b and a % 3 != b % 3)
    assert proximity.near_pairs(u.where("false"), u, 1.0).count() == 0


@pytest.mark.parametrize("block", [20, 100_000])
def test_in_regions(spark, block):
    r = np.random.RandomState(2)
    pts = [(i, float(a), float(o)) for i, (a, o) in enumerate(zip(r.uniform(-60, 60, 500), r.uniform(-180, 540, 500)))] + [(900 + i, 0.5, 179.5) for i in range(60)] + [(999, None, None)]
    rings = [(1, [170.0, 200.0, 200.0, 170.0, 170.0], [-40.0, -40.0, 40.0, 40.0, -40.0]), (2, [0.0, 50.0, 25.0, 0.0], [0.0, 10.0, 50.0, 0.0]), (3, [-200.0, -150.0, -170.0, -200.0], [10.0, 12.0, 50.0, 10.0]), (4, [1.0], [1.0]), (5, None, None), (6, [0.0, 60.0, 60.0, 0.0, 0.0], [-50.0, 50.0, -50.0, 50.0, -50.0])]
    p = spark.createDataFrame(pts, "id long, lat double, lon double")
    z = spark.createDataFrame(rings, "zone long, rx array<double>, ry array<double>")
    got = {tuple(x) for x in proximity.in_regions(p, "id", "lat", "lon", z, "zone", "rx", "ry", block).collect()}
    want = set()
    for k, a, o in pts[:-1]:
        for zone, xs, ys in rings[:3] + rings[5:]:
            for turn in (-720, -360, 0, 360):
                inside = False
                for i in range(len(xs) - 1):
                    if (xs[i] <= o + turn) != (xs[i + 1] <= o + turn) and a < ys[i] + (ys[i + 1] - ys[i]) * (o + turn - xs[i]) / (xs[i + 1] - xs[i]):
                        inside = not inside
                if inside:
                    want.add((k, zone))
    assert got == want
    assert proximity.in_regions(p.where("false"), "id", "lat", "lon", z, "zone", "rx", "ry").count() == 0


def test_sweep_over_a_ring_of_many_edges():
    r = np.random.RandomState(3)
    w = np.linspace(0, 2 * np.pi, 20_000, endpoint=False)
    rad = 10 + 3 * np.sin(7 * w) + r.uniform(-1, 1, len(w))
    xs, ys = rad * np.cos(w), rad * np.sin(w)
    x2, y2 = np.roll(xs, -1), np.roll(ys, -1)
    flip = xs > x2
    a = [np.where(flip, x2, xs), np.where(flip, y2, ys), np.where(flip, xs, x2), np.where(flip, ys, y2)]
    px, py = r.uniform(-15, 15, (2, 3000))
    got = set(proximity.sweep(px, py, *a, np.full(len(w), 5))[0].tolist())
    want = {i for i in range(len(px)) if (((a[0] <= px[i]) & (px[i] < a[2])) & (a[1] + (a[3] - a[1]) / (a[2] - a[0]) * (px[i] - a[0]) > py[i])).sum() % 2}
    assert got == want


# -- anomalies


def anomaly_rows():
    r = random.Random(5)
    rows, i = [], 0
    for src, level, n in (("a", 1e-6, 900), ("b", 1e-3, 120), ("c", 5.0, 20)):
        for k in range(n):
            i += 1
            rows.append([i, src, k * 7_000_000_000 + r.randrange(1000), level * 10 ** r.gauss(0, 0.25), "valid"])
    by = {s: [x for x in rows if x[1] == s] for s in "abc"}
    for k, f in ((3, 5e3), (400, 1e4), (880, 2e-4)):
        by["a"][k][3] = 1e-6 * f
    by["b"][50][3] = 1e2
    by["c"][5][3] = 1e5  # too few rows for a spike
    for k in range(495, 503):
        by["a"][k][3] = 3e-6
    for k in range(10, 14):
        by["b"][k][3] = 2e-3  # four only
    by["b"][70][3], by["b"][71][3], by["b"][72][3], by["b"][73][3] = -1.0, 0.0, math.inf, 1e31
    by["b"][80][3], by["b"][81][3] = None, math.nan
    rows.append([9000, None, 5, -4.0, "x"])
    rows.append([*by["a"][400]])
    rows[-1][0] = 9001  # delivered twice
    want = {(by["a"][k][0], "spike") for k in (3, 400, 880)} | {(9001, "spike"), (by["b"][50][0], "spike"), (9000, "impossible")}
    want |= {(by["a"][k][0], "stuck") for k in range(495, 503)} | {(by["b"][k][0], "impossible") for k in (70, 71, 72, 73)}
    return [tuple(x) for x in rows], want


@pytest.mark.parametrize("part_rows", [7, 37, 100, 100_000])
def test_station_anomalies(spark, part_rows):
    rows, want = anomaly_rows()
    df = spark.createDataFrame(rows, "row_id long, nsl string, t long, amp double, field string")
    got = {(x.row_id, x.reason) for x in anomalies.station_anomalies(df, "row_id", "nsl", F.col("t"), {"amp": True}, part_rows=part_rows).collect()}
    assert got == want
    assert anomalies.station_anomalies(df.where("false"), "row_id", "nsl", F.col("t"), {"amp": True}).count() == 0


@pytest.mark.parametrize("part_rows", [60, 100_000])
def test_site_anomalies(spark, part_rows):
    r = random.Random(6)
    rows = []
    for i in range(300):
        d = 10 ** r.uniform(3, 5.3)
        a = 1e3 / d**1.8 * 10 ** r.uniform(-0.2, 0.2)
        rows.append([i, 7, d, a, a / 2, a / 3])
    rows[40][3], rows[41][3], rows[200][3] = rows[40][3] * 500, rows[41][3] / 500, None
    rows[41][4] = rows[41][5] = None
    rows[60][4] = rows[60][3] * 2
    rows[61][2] = None
    df = spark.createDataFrame([tuple(x) for x in rows], "amp_id long, cid long, dist double, peak double, h double, v double")
    got = {(x.row_id, x.reason) for x in anomalies.site_anomalies(df, "amp_id", "cid", "peak", "dist", ["h", "v"], part_rows=part_rows).collect()}
    assert got == {(40, "spike"), (41, "spike"), (60, "impossible")}


@pytest.mark.parametrize("part_rows", [40, 100_000])
def test_the_edge_of_the_distance_window_is_exact(spark, part_rows):
    r = random.Random(13)
    for beyond in (False, True):
        rows = [[i, 3, 1000.0 * 1.5 ** (r.random() * 2), 10 ** r.uniform(-0.1, 0.1), 0.0, 0.0] for i in range(400)]
        rows = [x for x in rows if not 1490 < x[2] < 1510]
        rows.append([500, 3, 1000.0, 30.0, 0.0, 0.0])
        rows.append([501, 3, 1500.0 + (0.5 if beyond else -0.5), 6.0, 0.0, 0.0])  # a tenth of it is too much, if it is near enough
        df = spark.createDataFrame([tuple(x) for x in rows], "amp_id long, cid long, dist double, peak double, h double, v double")
        got = {(x.row_id, x.reason) for x in anomalies.site_anomalies(df, "amp_id", "cid", "peak", "dist", ["h", "v"], part_rows=part_rows).collect()}
        assert got == ({(500, "spike")} if beyond else set())


def two_levels():
    r = random.Random(9)
    rows = [[i, "d", i * 10_800_000_000, 1e-6 * (40 if i % 8 >= 6 else 1) * 10 ** r.gauss(0, 0.1)] for i in range(600)]
    rows[300][3] = 1e-2
    return [tuple(x) for x in rows]


@pytest.mark.parametrize("part_rows", [80, 100_000])
def test_a_daily_profile_of_two_levels_is_normal(spark, part_rows):
    df = spark.createDataFrame(two_levels(), "row_id long, nsl string, t long, amp double")
    got = anomalies.station_anomalies(df, "row_id", "nsl", F.col("t"), {"amp": True}, part_rows=part_rows).collect()
    assert [(x.row_id, x.reason) for x in got] == [(300, "spike")]


@pytest.mark.parametrize("part", ["all of it", "the low-rank part"])
def test_spikes_hang_on_the_principal_components(spark, monkeypatch, part):
    def without(m, seen, x=None, steps=0):
        offset, slope, low = fit(m, seen, x)
        return (offset, slope, low * 0) if part == "the low-rank part" else (offset * 0, slope * 0, low * 0)

    fit = anomalies.pursuit
    rows = two_levels() if part == "the low-rank part" else anomaly_rows()[0]
    df = spark.createDataFrame([x[:4] for x in rows], "row_id long, nsl string, t long, amp double")
    found = lambda: sorted((x.row_id, x.reason) for x in anomalies.station_anomalies(df, "row_id", "nsl", F.col("t"), {"amp": True}).collect())
    kept = found()
    monkeypatch.setattr(anomalies, "pursuit", without)
    assert found() != kept


def test_pursuit_splits_profile_and_spikes():
    r = np.random.RandomState(10)
    day, part = r.normal(0, 0.3, 40), np.array([-0.6, 0.1, 0.8, -0.2])
    m = -6 + np.outer(1 + day, part) + r.normal(0, 0.02, (40, 4))
    seen = r.rand(40, 4) < 0.9
    spikes = seen & (r.rand(40, 4) < 0.05)
    offset, slope, low = anomalies.pursuit((m + 3 * spikes)[None], seen[None])
    assert slope[0] == 0
    off = np.abs(m + 3 * spikes - offset[0] - low[0])
    assert (off > 0.9)[spikes].all() and np.mean((off < 0.9)[seen & ~spikes]) > 0.95 and np.median(off[seen & ~spikes]) < 0.1


def test_settling_near_is_the_plain_check():
    r = np.random.RandomState(11)
    for _ in range(20):
        n = r.randint(1, 60)
        d = np.where(r.rand(n) < 0.1, np.nan, 10 ** r.uniform(3, 4, n))
        v = 10 ** r.normal(0, 0.8, n)
        cand = r.rand(n) < 0.3
        case = cand & ~np.isnan(d)
        while True:
            still = case.copy()
            for i in np.flatnonzero(case):
                near = v[~case & (d * 1.5 >= d[i]) & (d <= d[i] * 1.5)]
                still[i] = len(near) > 0 and (v[i] >= 10 * near.max() or v[i] <= near.min() / 10)
            if (still == case).all():
                break
            case = still
        assert (anomalies.settle_near(v, v, d, d, cand, 10.0, 1.5) == case).all()


# -- time texts


def us(*a, tz="UTC"):
    return round(datetime(*a, tzinfo=ZoneInfo(tz)).timestamp() * 1e6)


CASES = [
    ("2021-03-04T05:06:07Z", "x", us(2021, 3, 4, 5, 6, 7)),
    ("  2021/03/04 05:06:07,5\r", "utc", us(2021, 3, 4, 5, 6, 7, 500000)),
    ("2021-03-04T05:06:07.123456789+05:45", "x", us(2021, 3, 3, 23, 21, 7, 123456)),
    ("1614834367", "x", 1614834367000000), ("1614834367123", "x", 1614834367123000), ("1614834367.25", "x", 1614834367250000),
    ("20210304050607", "utc", us(2021, 3, 4, 5, 6, 7)), ("2021,063,05:06:07", "utc", us(2021, 3, 4, 5, 6, 7)),
    ("2020-12-31 24:00:00", "utc", us(2021, 1, 1)), ("Thu, 04 Mar 2021 05:06:07 +0200", "x", us(2021, 3, 4, 3, 6, 7)),
    ("Mar 4, 2021 12:06:07 AM", "utc", us(2021, 3, 4, 0, 6, 7)), ("04 Mar 2021 05:06:07", "utc", us(2021, 3, 4, 5, 6, 7)),
    ("04/03/2021 05:06:07", "berlin", us(2021, 3, 4, 4, 6, 7)), ("04/03/2021 05:06:07", "york", us(2021, 4, 3, 9, 6, 7)),
    ("25/03/2021 05:06:07", "york", us(2021, 3, 25, 9, 6, 7)), ("2021-07-01 12:00:00 CEST", "berlin", us(2021, 7, 1, 10)),
    ("2021-10-31 02:30:00 CET", "berlin", us(2021, 10, 31, 1, 30)), ("2021-10-31 02:30:00 CEST", "berlin", us(2021, 10, 31, 0, 30)),
    ("2021-10-31 02:30:00", "berlin", None), ("2021-03-28 02:30:00", "berlin", None), ("2021-02-30 01:01:01", "utc", None),
    ("2021-02-03", "utc", None), ("unknown", "utc", None), ("", "utc", None), (None, "utc", None), ("2021-03-04 05:06", "utc", us(2021, 3, 4, 5, 6)),
    ("2021-03-04 25:00:00", "utc", None), ("13:00 2021", "utc", None), ("2021-11-13T10:09:32-05:00[America/New_York]", "x", us(2021, 11, 13, 15, 9, 32)),
    ("2024-01-01" + 75 * " " + "10:00:00", "utc", us(2024, 1, 1, 10)), ("2021-03-04T10:00:00.123456789012", "utc", us(2021, 3, 4, 10, 0, 0, 123456)),
    ("86400000", "x", us(1972, 9, 27)), ("20210304", "utc", None), ("2021", "utc", None), ("-1.5", "x", -1500000), ("1614834367123.9", "x", 1614834367123900), ("1614834367123456789", "x", 1614834367123456),
    ("20210304050607.25", "utc", us(2021, 3, 4, 5, 6, 7, 250000)), ("9" * 5000, "utc", None), ("7" * 21, "utc", None), ("1 " * 50_000, "utc", None),
    ("2021-03-04 05:06:07", "nowhere", None), ("2021-03-04 05:06:07", "odd", None), ("2021/03/04 05:06:07 EST", "berlin", None),
]


def test_time_texts(spark):
    servers = spark.createDataFrame([("utc", "UTC", "ymd", None, None), ("berlin", "Europe/Berlin", "dmy", "CET", "CEST"), ("york", "America/New_York", "mdy", "EST", "EDT"), ("odd", "No/Zone", "dmy", None, None)], "sid string, tz_name string, date_order string, std_abbr string, dst_abbr string")
    rows = spark.createDataFrame([(i, s, t, "q") for i, (t, s, _) in enumerate(CASES)], "rid long, sid string, text string, source string")
    out = timestamps.normalise_times(rows, servers, "rid", "sid", ["text"], block=10).collect()
    got = {x.rid: x.epoch_us if not x.repeated and not x.against else None for x in out}
    assert {i: got[i] for i in range(len(CASES))} == {i: w for i, (_, _, w) in enumerate(CASES)}
    assert timestamps.normalise_times(rows.where("false"), servers, "rid", "sid", ["text"]).count() == 0


def test_texts_of_one_shape_are_read_as_single_ones():
    r = random.Random(12)
    some = [t for t, _, _ in CASES if t and len(t) < 200] + ["3/4/2021 1:02:03 pm", "2021-03-04 05:06:07 +05", "20210304T050607.5Z", "4 Mar 2021 05:06:07", "2021-03-04 05:06:07 (CET)", "2021-03-04T05:06:07[Etc/GMT+5]", "29/02/2020 24:00:00"]
    texts = [None] + ["".join(r.choice("0123456789") if c.isdecimal() and r.random() < 0.3 else c for c in t) for t in some for _ in range(60)]
    got = [[] for _ in texts]
    for at, layout, order, kind, v, zone in interpret_all(texts):
        for i, x in zip(at.tolist(), v.tolist()):
            got[i].append((layout, order, kind, x, zone))
    for t, g in zip(texts, got):
        assert sorted(g) == sorted(interpret(t)), t
        assert [x for x in g if x[1]] == [x for x in interpret(t) if x[1]]


NO_ORDER = ([("s", "UTC", None, None, None)], "sid string, tz_name string, date_order string, std_abbr string, dst_abbr string")


def test_neighbours_decide_where_no_order_is_known(spark):
    servers = spark.createDataFrame(*NO_ORDER)
    texts = ["13/02/2021 00:00:00", "2020-01-01T00:00:00Z", "03/04/2021 00:00:00", "2022-01-01 00:00:00", "15/04/2021 00:00:00"]
    rows = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "rid long, sid string, text string")
    for block in (1, 2, 100):
        got = {x.rid: x.epoch_us for x in timestamps.normalise_times(rows, servers, "rid", "sid", ["text"], block=block).collect()}
        assert got[2] == us(2021, 4, 3)
    assert len(interpret(texts[2])) == 2


def _least(chain):
    return min(timestamps._costs(chain, [x[2] for x in chain[0]]))


@pytest.mark.parametrize("block", [1, 3, 17])
def test_the_path_is_that_of_the_whole_chain(spark, block):
    r = random.Random(block)
    servers = spark.createDataFrame(*NO_ORDER)
    some = lambda hi: f"{r.randint(1, 12):02}/{r.randint(1, hi):02}/2021 00:00:00" if r.random() < 0.5 else f"{r.randint(1, hi):02}/{r.randint(1, 12):02}/2021 00:00:00"
    texts = [some(13) if r.random() < 0.8 else f"2021-{r.randint(1, 12):02}-05 00:00:00" if r.random() < 0.7 else "none" for _ in range(400)]
    rows = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "rid long, sid string, text string")
    got = {x.rid: (x.epoch_us, x.layout) for x in timestamps.normalise_times(rows, servers, "rid", "sid", ["text"], block=block).collect()}
    chain, bound = [], []
    for i, t in enumerate(texts):
        found = interpret(t)
        if found:
            order = [("dmy", "mdy").index(x[0][-3:]) if x[0][-3:] in ("dmy", "mdy") else -1 for x in found]
            chain.append(timestamps.states([x[3] for x in found], [x[0] for x in found], [0.0] * len(found), order))
            bound.append([x for x in chain[-1] if (x[0], x[1]) == got[i]])
    assert all(bound) and sum(len(x) > 1 for x in chain) > 200
    assert _least(bound) == _least(chain)


def test_p5_hangs_on_the_path(spark, monkeypatch):
    at = "/root/testdata/sf0.001"
    found = lambda: set(map(tuple, problems.p5_found(spark, at).collect()))
    kept = found()
    monkeypatch.setattr(timestamps, "viterbi", lambda chain, entry=None, leave=None: [x[-1][4] for x in chain])
    assert found() != kept


def test_the_chain_finds_orders_that_are_withheld(spark):
    rows = problems.p5_without_order(spark, "/root/testdata/sf0.01").collect()
    n, right = sum(x.n_open for x in rows), sum(x.n_right for x in rows)
    assert n > 50 and right >= 0.9 * n


def test_viterbi_is_the_cheapest_path():
    from itertools import product

    r = random.Random(8)
    for _ in range(60):
        chain = []
        for _ in range(r.randrange(1, 6)):
            m = r.randrange(1, 4)
            chain.append(timestamps.states([r.randrange(9) for _ in range(m)], [r.choice("xy") for _ in range(m)], [r.choice([0.0, 16.0]) for _ in range(m)], [r.choice([-1, 0, 1]) for _ in range(m)]))

        def cost(path):
            return sum(x[2] for x in path) + sum((a[1] != b[1]) + (b[0] < a[0]) + 2 * (a[3] != b[3]) for a, b in zip(path, path[1:]))

        best = min(cost(p) for p in product(*chain))
        got = timestamps.viterbi(chain)
        assert min(cost(p) for p in product(*[[x for x in c if x[4] == j] for c, j in zip(chain, got)])) == best
        assert _least(chain) == best
