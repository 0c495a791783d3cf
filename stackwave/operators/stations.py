"""Station inventories: sanitising, black lists, distances, centroid."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackwave.functions import codes, geo
from stackwave.operators import ordered
from stackwave.operators.catalog import first_by


def sanitise(stations: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows with valid coordinates off the axes (0 means unknown), the first of each key."""
    ok = "lat is not null and lon is not null and not isnan(lat) and not isnan(lon) and lat between -90 and 90 and lat <> 0 and lon <> 0"
    return first_by(stations.where(ok), key, [order])


def blacklist(stations: DataFrame, patterns: list[str]) -> DataFrame:
    """Without the stations that match any glob pattern of a code."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | codes.nsl_matches(F.col("nsl"), p)
    return stations.where(~hit)


def looked_up(traces: DataFrame, stations: DataFrame) -> DataFrame:
    """Traces with their station's columns; codes of no station are an error."""
    missing = [r.nsl for r in traces.select("nsl").distinct().join(stations, "nsl", "left_anti").limit(5).collect()]
    if missing:
        raise KeyError(f"no station {', '.join(map(str, missing))}")
    return traces.join(stations, "nsl")


def remaining(stations: DataFrame) -> DataFrame:
    """The stations, or an error where a black list has left none."""
    if stations.isEmpty():
        raise ValueError("no station is left")
    return stations


def within(stations: DataFrame, lat: float, lon: float, metres: float) -> DataFrame:
    return stations.where(geo.sphere_distance("lat", "lon", lat, lon) <= metres)


def centroid(stations: DataFrame) -> DataFrame:
    return stations.agg(F.count("*").alias("n"), F.count_distinct("network").alias("networks"), *[F.round(F.avg(c), 6).alias(c) for c in ("lat", "lon", "elevation")])


BLOCK = 1_000  # stations of a block


def mean_distance(stations: DataFrame, by: str) -> DataFrame:
    """Mean distance in km over ordered pairs of stations of a group with different nsl.

    A group is cut into blocks of stations; a task meets two blocks and gives
    their sum, so no pair becomes a row and a large group spreads over tasks.
    """
    rows = ordered.numbered(stations.select(F.col(by).alias("_by"), "nsl", F.radians("lat").alias("la"), F.radians("lon").alias("lo")), ["_by"], ["nsl", "la", "lo"])
    blocks = rows.withColumn("x", F.struct("nsl", "la", "lo")).groupBy("_by", F.floor((F.col("n") - 1) / BLOCK).alias("b")).agg(F.collect_list("x").alias("x"))
    side = lambda i: blocks.select("_by", F.col("b").alias(f"b{i}"), *[F.col(f"x.{k}").alias(f"{k}{i}") for k in ("nsl", "la", "lo")])
    a, b = side(1), side(2)
    same = F.col("p._by").eqNullSafe(F.col("q._by"))
    pairs = a.alias("p").join(b.alias("q"), same & (F.col("b1") <= F.col("b2"))).select(F.col("p._by").alias("_by"), (F.col("b1") < F.col("b2")).alias("apart"), "nsl1", "la1", "lo1", "nsl2", "la2", "lo2").repartition("_by", F.rand(7))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            c = {n: t.column(n) for n in t.schema.names}
            for i in range(t.num_rows):
                get = lambda n, i=i: np.array(c[n][i].as_py())
                la1, lo1, la2, lo2 = get("la1")[:, None], get("lo1")[:, None], get("la2")[None], get("lo2")[None]
                h = np.sin((la1 - la2) / 2) ** 2 + np.cos(la1) * np.cos(la2) * np.sin((lo1 - lo2) / 2) ** 2
                d = 2 * 6_371_000.0 * np.arcsin(np.sqrt(np.minimum(1, h)))
                other = get("nsl1")[:, None] != get("nsl2")[None]
                times = 2 if c["apart"][i].as_py() else 1
                yield pa.RecordBatch.from_arrays([c["_by"].slice(i, 1), pa.array([float(d[other].sum()) * times]), pa.array([int(other.sum()) * times])], names=["_by", "total", "n"])

    got = pairs.mapInArrow(sums, "_by string, total double, n long").groupBy("_by").agg(F.sum("total").alias("t"), F.sum("n").alias("n")).where("n > 0")
    return got.select(F.col("_by").alias(by), F.round(F.col("t") / F.col("n") / 1000, 3).alias("mean_km"))
