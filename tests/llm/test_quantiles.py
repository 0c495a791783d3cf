"""Percentile sketches: the stated bound, merging, and workers without a copy of the package."""

import math

import numpy as np
import pytest

from stackwave.llm import quantiles
from tests.test_workers import run_elsewhere


def test_collapsing_bound():
    r = np.random.RandomState(3)
    for data in (r.normal(size=60_000), np.sort(r.rand(60_000)), r.randint(0, 7, 60_000).astype(float)):
        s = quantiles.Sketch(64)
        for part in np.array_split(data, 37):
            s.add(part)
        qs = [0.0, 0.01, 0.5, 0.77, 1.0]
        n, v = s.query(qs)
        assert n == len(data) and 0 < s.err < 0.08 * n
        d = np.sort(data)
        for q, x in zip(qs, v):
            lo, hi = np.searchsorted(d, x, "left") + 1, np.searchsorted(d, x, "right")
            want = max(1, math.ceil(q * n))
            assert max(0, lo - want, want - hi) <= s.err


def test_percentiles_and_merge(spark):
    r = np.random.RandomState(4)
    rows = [("hot", float(x), int(i % 5)) for i, x in enumerate(r.lognormal(size=6000))] + [("cold", float(i), 0) for i in range(9)] + [(None, 2.0, 1), ("hot", None, 1), ("hot", math.nan, 2), ("none", None, 0)]
    df = spark.createDataFrame(rows, "grp string, v double, day int").repartition(7)
    whole = quantiles.percentiles(quantiles.sketch(df, ["grp"], "v", k=256), ["grp"], [0.5, 0.9]).collect()
    days = quantiles.sketch(df, ["grp", "day"], "v", k=256)
    joined = quantiles.percentiles(quantiles.merge_sketches(days, ["grp"], 5, k=256), ["grp"], [0.5, 0.9]).collect()
    hot = np.sort([v for g, v, _ in rows if g == "hot" and v is not None and v == v])
    for got in (whole, joined):
        assert {x.grp for x in got} == {"hot", "cold", None}
        for x in got:
            d = hot if x.grp == "hot" else np.arange(9.0) if x.grp == "cold" else np.array([2.0])
            assert x.n == len(d)
            assert x.grp == "hot" or x.rank_error == 0
            lo, hi, want = np.searchsorted(d, x.value, "left") + 1, np.searchsorted(d, x.value, "right"), math.ceil(x.q * len(d))
            assert max(0, lo - want, want - hi) <= x.rank_error
    assert quantiles.percentiles(quantiles.sketch(df.where("false"), ["grp"], "v"), ["grp"], [0.5]).count() == 0


@pytest.mark.parametrize("pieces", [None, 500])
def test_merging_in_rounds_keeps_the_error(spark, pieces):
    rows = [("a", [float(i), i + 0.5], 1, 0.5, i) for i in range(200)]
    s = spark.createDataFrame(rows, "grp string, vals array<double>, w long, err double, part long").select("grp", "part", "w", "vals", "err")
    merged = quantiles.merge_sketches(s, ["grp"], pieces).collect()
    assert sum(x.err for x in merged) == 100 and sum(x.w * len(x.vals) for x in merged) == 400


def test_a_thousand_days_of_one_group_meet_in_rounds(spark):
    r = np.random.RandomState(6)
    v = r.normal(size=40_000)
    df = spark.createDataFrame([("a", float(x), i % 1000) for i, x in enumerate(v)], "grp string, v double, day int")
    days = quantiles.sketch(df, ["grp", "day"], "v", k=32)
    assert days.select("day").distinct().count() == 1000
    got = quantiles.percentiles(quantiles.merge_sketches(days, ["grp"], k=32), ["grp"], [0.1, 0.5, 0.9]).collect()
    d = np.sort(v)
    for x in got:
        assert x.n == len(v) and 0 < x.rank_error < 0.1 * len(v)
        assert abs(np.searchsorted(d, x.value, "right") - math.ceil(x.q * len(v))) <= x.rank_error


def test_percentiles_from_another_folder(tmp_path):
    run_elsewhere(tmp_path, """
from stackwave.llm import queries
assert queries.p2_percentiles(spark, "/root/testdata/sf0.001").count() > 0
""")
