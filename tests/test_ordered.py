"""Ordered operations over cells against plain loops."""

import random

import numpy as np
import pytest

from stackwave.operators import ingest, magnitude, ordered, stations


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    out = [(i, r.choice(["hot"] * 6 + ["b", "c", None]), r.randrange(200) if r.random() < 0.95 else None, r.choice([None, 1.0, 2.5, -3.0, float(r.randrange(9))])) for i in range(600)]
    return out


@pytest.fixture(scope="module", params=[0, ordered.WHOLE], ids=["in cells", "whole"])
def df(spark, rows, request):
    # small partitions, so that a key lies in many cells
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before, ordered.WHOLE = ordered.WHOLE, request.param
    yield spark.createDataFrame(rows, "id long, k string, t long, v double").repartition(3)
    ordered.WHOLE = before
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def in_order(rows):
    by = {}
    for x in sorted(rows, key=lambda x: ((x[2] is not None, x[2] or 0), x[0])):
        by.setdefault(x[1], []).append(x)
    return by


def test_keys_lie_in_several_cells(df):
    x = ordered.cells(df, ["k"], ["t", "id"])
    if not ordered.WHOLE:
        assert x.where("k = 'hot'").select("_cell").distinct().count() > 3


def test_numbers_sums_maxima_and_rows_before(df, rows):
    from pyspark.sql import functions as F

    x = ordered.cells(df, ["k"], ["t", "id"])
    for name, how, before in (("s", "sum", False), ("sb", "sum", True), ("m", "max", False), ("mb", "max", True), ("p", "last", True)):
        x = ordered.running(x, ["k"], ["t", "id"], name, F.col("v"), how, before)
    got = {r.id: r for r in x.collect()}
    n = {r.id: r.n for r in ordered.numbered(df, ["k"], ["t", "id"]).collect()}
    for group in in_order(rows).values():
        for i, row in enumerate(group):
            g = got[row[0]]
            assert n[row[0]] == i + 1
            upto, ahead = [y[3] for y in group[: i + 1] if y[3] is not None], [y[3] for y in group[:i] if y[3] is not None]
            assert (g.s, g.sb) == (sum(upto) if upto else None, sum(ahead) if ahead else None)
            assert (g.m, g.mb) == (max(upto, default=None), max(ahead, default=None))
            assert g.p == (group[i - 1][3] if i else None)
    assert ordered.numbered(df.where("false"), ["k"], ["t"]).count() == 0


def test_quantiles_are_exact(df, rows):
    for by in (["k"], []):
        got = {tuple(r[: len(by)]): r for r in ordered.quantiles(df, by, "v", {"a": 0.02, "b": 0.5, "c": 1.0}).collect()}
        groups = {}
        for x in rows:
            if x[3] is not None:
                groups.setdefault((x[1],) if by else (), []).append(x[3])
        assert set(got) == set(groups)
        for k, v in groups.items():
            assert got[k].n == len(v) and np.allclose([got[k].a, got[k].b, got[k].c], np.quantile(v, [0.02, 0.5, 1.0]))
    assert ordered.quantiles(df.where("false"), [], "v", {"a": 0.5}).count() == 0


def test_rolling_counts_and_edges(df, rows):
    x = df.where("t is not null")
    got = {r.id: r.n for r in ingest.rolling_count(x, ["k"], "t", 7, "id").collect()}
    edges = {r.id for r in ingest.rising_edges(x, ["k"], "t", 7, 5, "id").collect()}
    want = set()
    for group in in_order([r for r in rows if r[2] is not None]).values():
        last = 0
        for row in group:
            n = sum(row[2] - 7 <= y[2] <= row[2] for y in group)
            assert got[row[0]] == n
            if n >= 5 > last:
                want.add(row[0])
            last = n
    assert edges == want


def test_sessions(df, rows):
    from pyspark.sql import functions as F

    x = df.where("t is not null").withColumn("e", F.col("t") + 1)
    got = {r.id: r.session for r in ingest.session_ids(x, ["k"], "t", "e", 1, "id").collect()}
    for group in in_order([r for r in rows if r[2] is not None]).values():
        reach, n = None, 0
        for row in group:
            n += reach is None or row[2] - reach > 1
            reach = max(reach if reach is not None else row[2], row[2] + 1)
            assert got[row[0]] == n


def test_mean_distance_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ordered, "WHOLE", 0)
    monkeypatch.setattr(stations, "BLOCK", 7)
    r = random.Random(2)
    pts = [(r.choice("xxxy"), f"s{i % 37}", r.uniform(-80, 80), r.uniform(-180, 180)) for i in range(50)] + [("z", "a", 1.0, 1.0)]
    got = {x.net: x.mean_km for x in stations.mean_distance(spark.createDataFrame(pts, "net string, nsl string, lat double, lon double"), "net").collect()}
    for net in "xy":
        p = [x for x in pts if x[0] == net]
        d = []
        for a in p:
            for b in p:
                if a[1] != b[1]:
                    la, lb = np.radians(a[2]), np.radians(b[2])
                    d.append(2 * 6371 * np.arcsin(np.sqrt(np.sin((la - lb) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin(np.radians(a[3] - b[3]) / 2) ** 2)))
        assert abs(got[net] - np.mean(d)) < 2e-3
    assert set(got) == {"x", "y"}


def test_nearest_depths_is_the_plain_search(spark):
    r = random.Random(3)
    rows = [(i, float(r.randrange(8)), r.choice("qqp")) for i in range(40)] + [(99, 1.0, "alone"), (98, None, "q")]
    got = {x.id: (x.z1, x.z2) for x in magnitude.nearest_depths(spark.createDataFrame(rows, "id long, z double, q string"), "id", "z", "q").collect()}
    want = {}
    for i, z, q in rows:
        near = sorted((abs(b - z), j, b) for j, b, p in rows if z is not None and b is not None and p == q and j != i)[:2]
        if len(near) == 2:
            want[i] = (min(x[2] for x in near), max(x[2] for x in near))
    assert got == want
