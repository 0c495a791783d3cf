"""Queries over traces, nodes, stacks, windows and clusters, with their SQL where SQL can say it.

The 64 values of each vector stand for a trace of 64 samples.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stackwave.operators import analytics
from stackwave.operators import catalog as cat
from stackwave.operators import cluster, ingest, magnitude, octree, stack, traveltime
from stackwave.functions import codes, geo, signal
from stackwave.plans.catalog_queries import STS, sts
from stackwave.plans.dist import micros, partitions, table

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


B = octree.Bounds((-10_000.0, 10_000.0), (-10_000.0, 10_000.0), (0.0, 10_000.0))
SIZE = 2_000.0
_ROOT = "root as (select i as node_id, 0 as level, -10000 + (i % 10 + 0.5) * 2000.0 as east, -10000 + (i // 10 % 10 + 0.5) * 2000.0 as north, (i // 100 + 0.5) * 2000.0 as depth, 2000.0 as size from (select unnest(generate_series(0, 499)) as i))"
_KIDS = f"{_ROOT}, kids as (select node_id * 8 + k + 10000000 as node_id, node_id as parent_id, 1 as level, east + (k // 4 * 2 - 1) * size / 4 as east, north + (k // 2 % 2 * 2 - 1) * size / 4 as north, depth + (k % 2 * 2 - 1) * size / 4 as depth, size / 2 as size from root, (select unnest(generate_series(0, 7)) as k))"


def _split_some(spark: SparkSession) -> DataFrame:
    """Roots, and the children of every seventh root."""
    r = octree.roots(spark, B, SIZE)
    return r.unionByName(octree.split(r.where("node_id % 7 = 0"), 3))


@query(f"with {_ROOT} select node_id::bigint as node_id, east::double as east, north::double as north, depth::double as depth from root")
def octree_roots(spark: SparkSession, d: str) -> DataFrame:
    return octree.roots(spark, B, SIZE).select("node_id", "east", "north", "depth")


@query(f"with {_KIDS} select node_id::bigint as node_id, parent_id::bigint as parent_id, east::double as east, north::double as north, depth::double as depth, size::double as size from kids")
def octree_split(spark: SparkSession, d: str) -> DataFrame:
    return octree.split(octree.roots(spark, B, SIZE), 3).select("node_id", "parent_id", "east", "north", "depth", "size")


@query(f"with {_ROOT} select node_id::bigint as node_id, least(east + 10000, 10000 - east, north + 10000, 10000 - north, 10000 - depth)::double as border from root where least(east + 10000, 10000 - east, north + 10000, 10000 - north, 10000 - depth) > 2500")
def octree_border(spark: SparkSession, d: str) -> DataFrame:
    return octree.inside_border(octree.roots(spark, B, SIZE), B, 2_500.0).select("node_id", octree.border_distance(B).alias("border"))


@query(f"with {_KIDS}, n as (select node_id from root union all select node_id from kids where parent_id % 7 = 0), p as (select distinct parent_id from kids where parent_id % 7 = 0) select node_id::bigint as node_id from n where node_id not in (select parent_id from p)")
def octree_leaves(spark: SparkSession, d: str) -> DataFrame:
    return octree.leaves(_split_some(spark)).select("node_id")


_LEAF = "leaf as (select node_id, east, north, depth, size from root where node_id % 7 <> 0 union all select node_id, east, north, depth, size from kids where parent_id % 7 = 0)"


@query(f"with {_KIDS}, {_LEAF} select a.node_id::bigint as node_id, count(*) as n from leaf a join leaf b on a.node_id <> b.node_id and abs(a.east - b.east) <= (a.size + b.size) / 2 and abs(a.north - b.north) <= (a.size + b.size) / 2 and abs(a.depth - b.depth) <= (a.size + b.size) / 2 group by 1")
def octree_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return octree.touching(octree.leaves(_split_some(spark)), SIZE).groupBy("node_id").agg(F.count("*").alias("n"))


_SEMB = "lf as (select *, row_number() over (order by node_id) - 1 as place, count(*) over () as places from leaf), s as (select lf.node_id, east, north, depth, size, max(v.x) as semblance from lf join (select vec_id, embedding[1]::double as x from embeddings) v on v.vec_id % lf.places = lf.place group by all)"


def _semblance(spark: SparkSession, d: str) -> DataFrame:
    """The greatest first component of the embeddings that fall on each leaf; all embeddings are spread over the leaves."""
    w = W.partitionBy(F.lit(1))  # a fixed tree of about a thousand leaves
    leaf = octree.leaves(_split_some(spark)).withColumn("place", F.row_number().over(w.orderBy("node_id")) - 1).withColumn("places", F.count("*").over(w))
    n = leaf.select("places").limit(1)
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x")).crossJoin(F.broadcast(n))  # one row
    best = e.groupBy((F.col("vec_id") % F.col("places")).alias("place")).agg(F.max("x").alias("semblance"))
    return leaf.drop("places").join(best, "place").drop("place")


@query(f"with {_KIDS}, {_LEAF}, {_SEMB} select east::double as east, north::double as north, size::double as size, max(semblance) as semblance from s group by all")
def octree_reduce_axis(spark: SparkSession, d: str) -> DataFrame:
    return octree.reduce_axis(_semblance(spark, d), "east", "north", F.max("semblance").alias("semblance"))


@query(f"with {_KIDS}, {_LEAF}, {_SEMB} select node_id::bigint as node_id, (semblance / pow(size, 3))::double as density from s order by semblance / pow(size, 3) desc, node_id limit 1")
def octree_densest(spark: SparkSession, d: str) -> DataFrame:
    return octree.densest(_semblance(spark, d))


@query(f"with {_KIDS}, {_LEAF}, {_SEMB}, m as (select semblance as ms, east as me, north as mn, depth as md from s order by semblance desc, node_id limit 1) select min(east - me)::double as east_min, max(east - me)::double as east_max, min(north - mn)::double as north_min, max(north - mn)::double as north_max, min(depth - md)::double as depth_min, max(depth - md)::double as depth_max from s, m where semblance >= 0.6 * ms")
def octree_uncertainty(spark: SparkSession, d: str) -> DataFrame:
    return octree.uncertainty(_semblance(spark, d), 0.4).select("east_min", "east_max", "north_min", "north_max", "depth_min", "depth_max")


@query(f"with {_KIDS}, n as (select node_id, level, east, north, depth, size from root union all select node_id, level, east, north, depth, size from kids where parent_id % 7 = 0) select node_id::bigint as node_id, level + 1 < 2 as splits, round(sqrt(3.0) / 2 * size, 6) as radius, round(sqrt(pow(east - 500, 2) + pow(north + 500, 2) + pow(depth - 1000, 2)), 6) as distance, round(12.5 + degrees(north / 6371000), 9) as lat, round(44.5 + degrees(east / (6371000 * cos(radians(12.5)))), 9) as lon, depth + 300.0 as effective_depth from n")
def octree_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Place, reach and distance of nodes, and whether they may split."""
    n = octree.with_location(_split_some(spark), 12.5, 44.5, 300.0)
    return n.select("node_id", octree.can_split(2).alias("splits"), F.round(octree.radius(), 6).alias("radius"), F.round(octree.node_distance(500.0, -500.0, 1000.0), 6).alias("distance"), F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"), "effective_depth")


@query(f"with {_KIDS}, {_LEAF}, {_SEMB} select node_id::bigint as node_id from s where semblance >= 0.1")
def octree_above(spark: SparkSession, d: str) -> DataFrame:
    return octree.above(_semblance(spark, d), 0.1).select("node_id")


@query(f"with {_ROOT} select node_id::bigint as node_id, 0.0::double as semblance from root")
def octree_reset(spark: SparkSession, d: str) -> DataFrame:
    return octree.reset(_split_some(spark).withColumn("semblance", F.lit(1.0))).select("node_id", "semblance")


# -- travel times and weights ---------------------------------------------------------

_PAIR = f"{_ROOT}, {STS}, sx as (select sta_idx, (sta_idx::bigint * 7919 % 20000) - 10000.0 as se, (sta_idx::bigint * 104729 % 20000) - 10000.0 as sn from st), pr as (select node_id, sta_idx, sqrt(pow(east - se, 2) + pow(north - sn, 2) + pow(depth, 2)) as distance from root, sx)"


def _places(stations: DataFrame) -> DataFrame:
    i = F.col("sta_idx").cast("long")
    return stations.select("sta_idx", (i * 7919 % 20000 - 10000.0).alias("se"), (i * 104729 % 20000 - 10000.0).alias("sn"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """All nodes x all sanitised stations: the stations are spread over tasks, the fixed 500 nodes go to each."""
    s = _places(sts(spark, d)).repartition(partitions(spark), "sta_idx")
    n = octree.roots(spark, B, SIZE)
    dist = F.sqrt(F.pow(F.col("east") - F.col("se"), 2.0) + F.pow(F.col("north") - F.col("sn"), 2.0) + F.pow("depth", F.lit(2.0)))
    return s.crossJoin(F.broadcast(n)).select("node_id", "sta_idx", "depth", F.sqrt(F.pow(F.col("east") - F.col("se"), 2.0) + F.pow(F.col("north") - F.col("sn"), 2.0)).alias("offset"), dist.alias("distance"))


def _span(p: DataFrame) -> DataFrame:
    return traveltime.span(p.withColumn("tt", traveltime.constant(F.col("distance"), 5000.0)), ["node_id"]).select("node_id", F.round("first", 6).alias("first"), F.round("last", 6).alias("last"))


@query(f"with {_PAIR} select node_id::bigint as node_id, round(min(distance / 5000.0), 6) as first, round(max(distance / 5000.0), 6) as last from pr group by 1")
def travel_time_span(spark: SparkSession, d: str) -> DataFrame:
    return _span(_pairs(spark, d))


_LAYERS = "ly as (select * from (values " + ", ".join(f"({t}, {b if np.isfinite(b) else 1e30}, {p}, {s})" for t, b, p, s, _, _ in traveltime.layers()) + ") as t(top, bottom, vp, vs))"


@query(f"with {_LAYERS} select seq, vp::double as velocity, round(vp / vs, 6) as vp_vs from detections join ly on depth >= top and depth < bottom where depth is not null and not isnan(depth)")
def layer_velocity(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "detections").where("depth is not null and not isnan(depth)").select("seq", "depth")
    return traveltime.velocity_at(x, "depth", traveltime.layers()).where("top is not null").select("seq", "velocity", F.round("vp_vs", 6).alias("vp_vs"))


@query()
def layered_travel_times(spark: SparkSession, d: str) -> DataFrame:
    """First arrivals of P and S through the default layers."""
    p = _pairs(spark, d).select("node_id", "sta_idx", F.col("offset").alias("distance"), "depth")
    return traveltime.travel_times(p, traveltime.layers(), {"cake:P": "vp", "cake:S": "vs"})


GRADIENT = ((0.0, 5.0, 3.0), (30.0, 8.0, 4.8))


@query(f"with {_PAIR} select node_id::bigint as node_id, sta_idx::bigint as sta_idx, phase, true as exact from pr, (select unnest(['cake:P', 'cake:S']) as phase)")
def gradient_travel_times(spark: SparkSession, d: str) -> DataFrame:
    """First arrivals where velocities rise with depth, held against their closed form: whether they are within 0.1 percent."""
    p = _pairs(spark, d).select("node_id", "sta_idx", F.col("offset").alias("distance"), "depth")
    t = traveltime.travel_times(p, traveltime.layers(GRADIENT), {"cake:P": "vp", "cake:S": "vs"}).join(F.broadcast(octree.roots(spark, B, SIZE).select("node_id", "depth")), "node_id")  # 500 nodes
    s = _places(sts(spark, d))
    g = F.when(F.col("phase") == "cake:P", 0.1).otherwise(0.06)
    v0 = F.when(F.col("phase") == "cake:P", 5000.0).otherwise(3000.0)
    n = octree.roots(spark, B, SIZE).select(F.col("node_id").alias("n"), "east", "north")
    t = t.join(F.broadcast(n), F.col("node_id") == F.col("n")).join(s, "sta_idx")  # 500 nodes
    far = F.pow(F.col("east") - F.col("se"), 2.0) + F.pow(F.col("north") - F.col("sn"), 2.0) + F.pow("depth", F.lit(2.0))
    want = F.acosh(1 + g * g * far / (2 * v0 * (v0 + g * F.col("depth")))) / g
    return t.select("node_id", "sta_idx", "phase", (F.abs(F.col("tt") / want - 1) < 1e-3).alias("exact"))


def _weights(p: DataFrame) -> DataFrame:
    w = traveltime.gaussian_weights(p, "node_id", 5, 20_000.0, 0.1).withColumn("tt", F.col("distance") / 5000.0)
    return traveltime.normalise_weights(w, ["node_id"]).select("node_id", "sta_idx", F.round("weight", 6).alias("weight"))


@query(f"with {_PAIR}, k as (select *, row_number() over (partition by node_id order by distance, sta_idx) as k from pr), dk as (select *, max(case when k = 5 then distance end) over (partition by node_id) as dk from k), w as (select node_id, sta_idx, 0.9 * (case when distance <= dk then 1.0 else exp(-pow(distance - dk, 2) / (2 * pow(20000.0 / 2.355, 2))) end) + 0.1 as w from dk), n as (select node_id, sta_idx, w / sum(w) over (partition by node_id) as w from w) select node_id::bigint as node_id, sta_idx, round(case when w < 0.001 then 0 else w end, 6) as weight from n")
def distance_weights(spark: SparkSession, d: str) -> DataFrame:
    return _weights(_pairs(spark, d))


@query(f"with {_PAIR}, w as (select node_id, sta_idx, 0.9 / (1 + pow(distance / 5000.0, 2.0)) + 0.1 as w from pr) select node_id::bigint as node_id, sta_idx, round(w / (select max(w) from w), 6) as weight from w")
def exponential_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights that fall with distance, against the greatest of all pairs."""
    return traveltime.exponential_weights(_pairs(spark, d), 5_000.0, 2.0, 0.1).select("node_id", "sta_idx", F.round("weight", 6).alias("weight"))


@query(f"with {_ROOT} select node_id::bigint as node_id, sta_idx::bigint as sta_idx, round((east + 2 * north - 3 * depth) * sta_idx, 3) as tt from root, (select unnest([1, 2]) as sta_idx)")
def grid_travel_times(spark: SparkSession, d: str) -> DataFrame:
    """Times of nodes between the places of a grid, where the field is linear."""
    ax = tuple(octree.axis_through_zero(*b, 1_500.0) for b in (B.east, B.north, B.depth))
    e, n, z = np.meshgrid(*ax, indexing="ij")
    t = traveltime.fill_from_grid(octree.roots(spark, B, SIZE), {k: (e + 2 * n - 3 * z) * k for k in (1, 2)}, ax)
    return t.select("node_id", "sta_idx", F.round("tt", 3).alias("tt"))


@query(f"with {STS} select sta_idx, round(6371000.0 * 0.0 + (300.0 - (elevation - depth)), 6) as down, round(sqrt(pow(1000.0, 2) + pow(depth, 2)), 6) as old_distance from st where not isnan(elevation - depth)")
def station_offsets(spark: SparkSession, d: str) -> DataFrame:
    """How far stations lie below a reference, and the distance that leaves elevations out."""
    s = sts(spark, d).where("elevation - depth is not null and not isnan(elevation - depth)")
    _, _, down = geo.offset_3d(F.lit(12.5), F.lit(44.5), F.lit(300.0), "lat", "lon", F.col("elevation") - F.col("depth"))
    return s.select("sta_idx", F.round(down, 6).alias("down"), F.round(geo.distance_without_elevation(F.lit(1000.0), "depth"), 6).alias("old_distance"))


@query(f"with {STS} select sta_idx, round(2 * 6371000 * asin(sqrt(least(1, pow(sin((radians(lat) - radians(12.5)) / 2), 2) + cos(radians(lat)) * cos(radians(12.5)) * pow(sin(radians(lon - 44.5) / 2), 2)))) / 1000, 4) as km, round(degrees(atan2(sin(radians(lon - 44.5)) * cos(radians(lat)), cos(radians(12.5)) * sin(radians(lat)) - sin(radians(12.5)) * cos(radians(lat)) * cos(radians(lon - 44.5)))), 5) as azimuth from st")
def distances_and_azimuths(spark: SparkSession, d: str) -> DataFrame:
    return sts(spark, d).select("sta_idx", F.round(geo.sphere_distance("lat", "lon", 12.5, 44.5) / 1000, 4).alias("km"), F.round(geo.sphere_azimuth(12.5, 44.5, "lat", "lon"), 5).alias("azimuth"))


@query(f"with {STS}, n as (select *, 6378137.0 / sqrt(1 - 0.0066943799901413165 * pow(sin(radians(lat)), 2)) as n from st) select sta_idx, round((n + elevation - depth) * cos(radians(lat)) * cos(radians(lon)), 2) as x, round((n + elevation - depth) * cos(radians(lat)) * sin(radians(lon)), 2) as y, round((n * (1 - 0.0066943799901413165) + elevation - depth) * sin(radians(lat)), 2) as z from n where elevation is not null and depth is not null")
def earth_centred(spark: SparkSession, d: str) -> DataFrame:
    x, y, z = geo.ecef("lat", "lon", geo.effective_elevation())
    return sts(spark, d).where("elevation is not null and depth is not null").select("sta_idx", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"), F.round(z, 2).alias("z"))


# -- stacking ---------------------------------------------------------------------------

_TR = "tr as (select vec_id as trace_id, label as batch_id, 0 as \"offset\", embedding as samples from embeddings), nd as (select unnest(generate_series(0, 19)) as node_id), sh as (select node_id, trace_id, (node_id * 3 + trace_id * 5) % 16 as shift, 0.125 as weight from nd, tr), st as (select batch_id, node_id, k - 1 + shift as t, sum(weight * samples[k]::double) as v from tr join sh using (trace_id), (select unnest(generate_series(1, 64)) as k) group by all)"


def _traces(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    tr = table(spark, d, "embeddings").select(F.col("vec_id").alias("trace_id"), F.col("label").cast("long").alias("batch_id"), F.lit(0).cast("long").alias("offset"), F.col("embedding").alias("samples"))
    nodes = spark.range(20).withColumnRenamed("id", "node_id")
    sh = tr.select("trace_id").crossJoin(F.broadcast(nodes)).select("node_id", "trace_id", ((F.col("node_id") * 3 + F.col("trace_id") * 5) % 16).alias("shift"), F.lit(0.125).alias("weight"))  # 20 nodes
    return tr, sh


@query(f"with {_TR} select batch_id::bigint as batch_id, node_id::bigint as node_id, round(v, 6) as v from st where t = 40")
def stack_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return stack.snapshot(stack.stack_rows(*_traces(spark, d)), 40).select("batch_id", "node_id", F.round("v", 6).alias("v"))


@query(f"with {_TR}, r as (select *, row_number() over (partition by batch_id, t order by v desc, node_id) as k from st) select batch_id::bigint as batch_id, t::bigint as t, round(v, 6) as v, node_id::bigint as node_id from r where k = 1")
def stack_maximum(spark: SparkSession, d: str) -> DataFrame:
    return stack.reduce_max(stack.stack_rows(*_traces(spark, d))).select("batch_id", "t", F.round("v", 6).alias("v"), "node_id")


@query(f"with {_TR}, r as (select *, row_number() over (partition by batch_id, t order by v desc, node_id) as k from st) select batch_id::bigint as batch_id, t::bigint as t, round(v, 6) as v, node_id::bigint as node_id from r where k = 1")
def stack_by_kernel(spark: SparkSession, d: str) -> DataFrame:
    """The array kernel, where every node has every trace."""
    return stack.stack_kernel(*_traces(spark, d), tile=8).select("batch_id", "t", F.round("v", 6).alias("v"), "node_id")


@query(f"with {_TR}, r as (select *, row_number() over (partition by batch_id, t order by v desc, node_id) as k from st) select batch_id::bigint as batch_id, t::bigint as t, round(v, 6) as v, node_id::bigint as node_id from r where k = 1")
def stack_resumed(spark: SparkSession, d: str) -> DataFrame:
    """The running maximum of the first ten nodes, resumed with the rest."""
    tr, sh = _traces(spark, d)
    a, b = (stack.reduce_max(stack.stack_rows(tr, sh.where(w))) for w in ("node_id < 10", "node_id >= 10"))
    return stack.resume(a, b).select("batch_id", "t", F.round("v", 6).alias("v"), "node_id")


@query(f"with {_TR} select batch_id::bigint as batch_id, min(shift)::bigint as first, (max(shift) + 64)::bigint as last from tr join sh using (trace_id) group by 1")
def stack_extent(spark: SparkSession, d: str) -> DataFrame:
    return stack.extent(*_traces(spark, d))


@query(f"with {_TR} select batch_id::bigint as batch_id, (min(\"offset\") - 20)::bigint as first, (max(\"offset\" + 64) + 5)::bigint as last from tr group by 1")
def stack_extent_of_range(spark: SparkSession, d: str) -> DataFrame:
    return stack.extent(*_traces(spark, d), shift_range=(-20, 5))


@query(f"with {_TR} select batch_id::bigint as batch_id, node_id::bigint as node_id, round(v, 6) as v from st where t = 40 and node_id % 3 = 0")
def stack_snapshot_of_leaves(spark: SparkSession, d: str) -> DataFrame:
    leaves = spark.range(20).withColumnRenamed("id", "node_id").where("node_id % 3 = 0")
    return stack.snapshot(stack.stack_rows(*_traces(spark, d)), 40, leaves).select("batch_id", "node_id", F.round("v", 6).alias("v"))


@query(f"with {_TR}, m as (select batch_id, t, max(v) as v from st group by 1, 2), w as (select *, lag(v) over (partition by batch_id order by t) as p, lead(v) over (partition by batch_id order by t) as n from m) select batch_id::bigint as batch_id, t::bigint as t, round(v, 6) as v from w where (p is null or v > p) and (n is null or v > n)")
def stack_peaks(spark: SparkSession, d: str) -> DataFrame:
    return stack.local_maxima(stack.reduce_max(stack.stack_rows(*_traces(spark, d)))).select("batch_id", "t", F.round("v", 6).alias("v"))


# -- trace functions --------------------------------------------------------------------


@query("select vec_id, round((list_max(embedding[33:]) - list_min(embedding[33:])) / 2, 6)::double as peak, round((list_max(embedding[:32]) - list_min(embedding[:32])) / 2, 6)::double as noise from (select vec_id, list_transform(embedding, lambda x: x::double) as embedding from embeddings)")
def peak_and_noise(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    p, n, _ = magnitude.peak_and_noise(F.col("x"), F.lit(32))
    return e.select("vec_id", F.round(p, 6).alias("peak"), F.round(n, 6).alias("noise"))


@query("select a.label, round(max(sqrt(pow(a.x, 2) + pow(b.x, 2))), 6) as motion from (select vec_id, label, generate_subscripts(embedding, 1) as k, unnest(embedding)::double as x from embeddings) a join (select vec_id, generate_subscripts(embedding, 1) as k, unnest(embedding)::double as x from embeddings) b on b.vec_id = a.vec_id + 1 and b.k = a.k where a.vec_id % 2 = 0 group by 1")
def ground_motion(spark: SparkSession, d: str) -> DataFrame:
    """Greatest vector norm of two components (neighbouring traces) per group."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    j = e.where("vec_id % 2 = 0").join(b, "vec_id")
    return j.groupBy("label").agg(F.round(F.max(F.array_max(F.zip_with("x", "y", lambda p, q: F.sqrt(p * p + q * q)))), 6).alias("motion"))


@query("select vec_id from embeddings where len(embedding) > 0 and not list_bool_or(list_transform(embedding, lambda x: x is null or isnan(x) or isinf(x)))")
def clean_traces(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("samples"))
    return ingest.clean(e, ["vec_id"], ["vec_id"]).select("vec_id")


@query()
def filtered_traces(spark: SparkSession, d: str) -> DataFrame:
    """Zero-phase band-pass, resampling and a trigger on every trace, batch by batch."""

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            x = np.stack(pdf.embedding.to_list()).astype(float)
            y = signal.band_filter(x, 100.0, 2.0, 20.0)
            r = [signal.resample(v, 0.01, 0.02) for v in y]
            s = [signal.sta_lta(v, 4, 16) for v in y]
            yield pdf[["vec_id"]].assign(samples=[v.tolist() for v in r], trigger=[float(v.max()) for v in s], n_peaks=[int(len(signal.find_peaks(v, 0.3, 4, 0.1))) for v in s])

    return table(spark, d, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, samples array<double>, trigger double, n_peaks int")


@query("select label::bigint as batch_id, count(*) as n_traces, sum(len(embedding))::bigint * 8 as n_bytes, round(sum(len(embedding)) / 50.0, 6) as cumulative_s from embeddings group by 1")
def batch_sizes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("batch_id"), F.col("embedding").alias("samples"), F.lit(50.0).alias("rate_hz"))
    return ingest.batch_sizes(e)


@query("select vec_id, list_sum(list_transform(embedding[9:56], lambda x: x::double)) as total from embeddings")
def blinded_images(spark: SparkSession, d: str) -> DataFrame:
    """Sums of image traces without the blinding at both ends."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("samples"), F.lit(50.0).alias("rate_hz"))
    return ingest.blinded(e, 0.16).select("vec_id", F.aggregate("samples", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("select vec_id, 10 as n, embedding[11]::double as first, embedding[20]::double as last from embeddings")
def chopped_traces(spark: SparkSession, d: str) -> DataFrame:
    """Ten samples of each trace, by time."""
    e = table(spark, d, "embeddings").select("vec_id", F.lit(0).cast("long").alias("tmin_us"), F.lit(50.0).alias("rate_hz"), F.col("embedding").alias("samples"))
    return ingest.chop(e, F.lit(200_000), F.lit(400_000)).select("vec_id", F.size("samples").alias("n"), F.get("samples", F.lit(0)).cast("double").alias("first"), F.get("samples", F.lit(9)).cast("double").alias("last"))


# -- windows ----------------------------------------------------------------------------

_EVT = "(select seq, epoch_us(event_time) as t from detections where event_time is not null)"


@query(f"select seq, b as batch_id, t >= b * 3600000000 and t < (b + 1) * 3600000000 as in_core from (select seq, t, unnest(generate_series((t - 60000000) // 3600000000, (t + 60000000) // 3600000000)) as b from {_EVT}) where t < (b + 1) * 3600000000 + 60000000 and t >= b * 3600000000 - 60000000")
def padded_batches(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "detections").where("event_time is not null").select("seq", micros("event_time").alias("t"))
    return ingest.batch_windows(x, "t", "t", 3_600_000_000, 60_000_000).select("seq", "batch_id", "in_core")


@query("with x as (select row_id, nsl, epoch_us(starttime) as s, epoch_us(endtime) as e from seedlink_stations where nsl is not null and endtime > starttime), w as (select *, max(e) over (partition by nsl order by s, e, row_id rows between unbounded preceding and 1 preceding) as r from x) select row_id, (sum(case when r is null or s - r > 60000000 then 1 else 0 end) over (partition by nsl order by s, e, row_id rows unbounded preceding))::bigint as session from w")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "seedlink_stations").where("nsl is not null and endtime > starttime").select("row_id", "nsl", micros("starttime").alias("s"), micros("endtime").alias("e"))
    return ingest.session_ids(x, ["nsl"], "s", "e", 60_000_000, "row_id").select("row_id", "session")


@query("with b as (select epoch_us(p.model_time) // 86400000000 as batch_id, network || '.' || station as sta, pick_id from picks p), n as (select batch_id from b group by 1 having count(distinct sta) >= 10) select pick_id from b where batch_id in (select batch_id from n)")
def healthy_batches(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "picks").select("pick_id", F.concat_ws(".", "network", "station").alias("sta"), F.floor(micros("model_time") / 86_400_000_000).alias("batch_id"))
    return ingest.healthy_batches(x, "sta", 10).select("pick_id")


@query("with d as (select seq, epoch_us(event_time) as t from detections where semblance >= 0.5 and not isnan(semblance)), n as (select *, count(*) over (order by t range between 86400000000 preceding and current row) as n from d), l as (select *, lag(n) over (order by t, seq) as b from n) select seq, n from l where n >= 5 and coalesce(b, 0) < 5")
def swarm_alerts(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "detections").where("semblance >= 0.5 and not isnan(semblance)").select("seq", micros("event_time").alias("t"))
    return ingest.rising_edges(x, [], "t", 86_400_000_000, 5, "seq").select("seq", "n")


@query("with r as (select row_id, nsl, channel, starttime::date as day, case when starts_with(channel, 'HH') then 0 when starts_with(channel, 'EH') then 1 when starts_with(channel, 'BH') then 2 end as k from seedlink_stations where nsl is not null and starttime is not null and left(channel, 1) not in ('L', 'V', 'U', 'R', 'P', 'T', 'Q')), f as (select *, row_number() over (partition by nsl, day, right(channel, 1) order by k, channel, row_id) as n from r where k is not null) select nsl, day::varchar as day, right(channel, 1) as orientation, channel from f where n = 1")
def channel_choice(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "seedlink_stations").where("nsl is not null and starttime is not null").select("row_id", "nsl", "channel", F.to_date("starttime").alias("day"))
    return ingest.select_channels(x, ["HH?", "EH?", "BH?"], ["nsl", "day"]).select("nsl", F.col("day").cast("string").alias("day"), "orientation", "channel")


@query("select m.event_uid, s.row_id from (select event_uid, network || '.' || station || '.' || coalesce(location, '') as nsl, min(epoch_us(model_time)) - 5000000 as a, max(epoch_us(model_time)) + 5000000 as b from picks group by 1, 2) m join (select row_id, nsl, epoch_us(starttime) as s, epoch_us(endtime) as e from seedlink_stations where endtime > starttime) s on m.nsl = s.nsl and s.s < m.b and s.e > m.a")
def event_segments(spark: SparkSession, d: str) -> DataFrame:
    """Range join of event windows with the segments of the receiver that they overlap, over time cells."""
    cell = 86_400_000_000
    t = micros("model_time")
    a = table(spark, d, "picks").withColumn("nsl", codes.nsl(F.col("network"), F.col("station"), F.col("location"))).groupBy("event_uid", "nsl").agg((F.min(t) - 5_000_000).alias("a"), (F.max(t) + 5_000_000).alias("b"))
    s = table(spark, d, "seedlink_stations").where("endtime > starttime").select("row_id", "nsl", micros("starttime").alias("s"), micros("endtime").alias("e"))
    a = a.withColumn("c", F.explode(F.sequence(F.floor(F.col("a") / cell), F.floor(F.col("b") / cell))))
    s = s.withColumn("c", F.explode(F.sequence(F.floor(F.col("s") / cell), F.floor(F.col("e") / cell))))
    # a pair that shares several cells counts in the first of them
    j = a.join(s, ["nsl", "c"]).where((F.col("s") < F.col("b")) & (F.col("e") > F.col("a")) & (F.col("c") == F.greatest(F.floor(F.col("a") / cell), F.floor(F.col("s") / cell))))
    return j.select("event_uid", "row_id")


# -- clusters ------------------------------------------------------------------------


_CLUSTERS = """
with recursive e as (select seq, depth, lat, lon from (select *, row_number() over (partition by event_uid order by seq) as n from detections) where n = 1 and lat is not null and lon is not null and depth is not null and not isnan(lat) and not isnan(lon) and abs(lat) <= 90),
a as (select seq, depth, 2 * 6378137.0 * asin(sqrt(least(1, pow(sin((radians(lat) - radians(12.5)) / 2), 2) + cos(radians(12.5)) * cos(radians(lat)) * pow(sin(radians(lon - 44.5) / 2), 2)))) as d, atan2(sin(radians(lon - 44.5)) * cos(radians(lat)), cos(radians(12.5)) * sin(radians(lat)) - sin(radians(12.5)) * cos(radians(lat)) * cos(radians(lon - 44.5))) as z from e),
p as (select seq, d * sin(z) as x, d * cos(z) as y, depth as w from a where not isnan(depth)),
g as (select a.seq as a, b.seq as b, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.w - b.w, 2)) as d from p a join p b on abs(a.x - b.x) <= 1000 and abs(a.y - b.y) <= 1000 and abs(a.w - b.w) <= 1000 and sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.w - b.w, 2)) <= 1000),
core as (select a as id from g group by a having count(*) >= 30),
link as (select g.* from g join core c on c.id = g.a join core k on k.id = g.b),
cc(id, root) using key (id) as (select id, id from core union select l.b, min(cc.root) from cc join link l on cc.id = l.a join recurring.cc as r on r.id = l.b where cc.root < r.root group by l.b),
border as (select g.a as id, arg_min(g.b, (g.d, g.b)) as k from g join core c on c.id = g.b where g.a not in (select id from core) group by 1),
named as (select id, root from cc union all select border.id, cc.root from border join cc on cc.id = border.k),
labels as (select e.seq, coalesce(named.root, -1)::bigint as label from e left join named on named.id = e.seq)
"""


@query(_CLUSTERS + "select seq, label from labels")
def clusters(spark: SparkSession, d: str) -> DataFrame:
    """Density clusters of the first exports of all located detections; metres around a reference."""
    e = cat.first_by(table(spark, d, "detections"), ["event_uid"], ["seq"]).where("lat is not null and lon is not null and depth is not null and not isnan(lat) and not isnan(lon) and abs(lat) <= 90")
    east, north = geo.offset_from(12.5, 44.5, "lat", "lon")
    return cluster.dbscan(e.select("seq", east.alias("east"), north.alias("north"), "depth"), "seq", ["east", "north", "depth"], 1_000.0, 30)


@query(_CLUSTERS + "select count(distinct case when label >= 0 then label end) as clusters, count(case when label < 0 then 1 end) as noise, count(case when label >= 0 then 1 end) as clustered from labels")
def cluster_counts(spark: SparkSession, d: str) -> DataFrame:
    c = clusters(spark, d)
    return c.agg(F.count_distinct(F.when(F.col("label") >= 0, F.col("label"))).alias("clusters"), F.count_if(F.col("label") < 0).alias("noise"), F.count_if(F.col("label") >= 0).alias("clustered"))


_EVENT_SIZE = "sz as (select event_uid, median(magnitude) as m from station_magnitudes where magnitude is not null and not isnan(magnitude) group by 1), lm as (select l.label, d.seq, d.event_time, sz.m from labels l join detections d using (seq) join sz using (event_uid))"


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "station_magnitudes").where("magnitude is not null and not isnan(magnitude)").groupBy("event_uid").agg(F.median("magnitude").alias("m"))
    return clusters(spark, d).join(table(spark, d, "detections").select("seq", "event_uid", "event_time"), "seq").join(m, "event_uid").select("label", "seq", "event_time", "m")


@query(_CLUSTERS.rstrip() + f", {_EVENT_SIZE} select label, count(*) as n, round(min(m), 6) as least, round(median(m), 6) as med, round(max(m), 6) as most, round(any_value(a), 6) as all_least, round(any_value(b), 6) as all_most, (label < 0)::int as last from lm, (select min(m) as a, max(m) as b from lm) group by 1")
def magnitude_by_cluster(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the events of each cluster; noise last."""
    return analytics.by_label(_labelled(spark, d), "label", "m")


@query(_CLUSTERS.rstrip() + f", {_EVENT_SIZE}, x as (select label, m - lag(m) over (partition by label order by event_time, seq) as diff from lm), ag as (select label, count(*) as n_values, count(case when diff >= 0.5 then 1 end) as n, avg(case when diff >= 0.5 then diff - 0.5 end) as m from x group by 1) select label, n_values, n, round(case when n >= 10 and n_values >= 5 and m > 0 then 1 / (ln(10) * m) end, 6) as b, round(case when n >= 10 and n_values >= 5 and m > 0 then 1 / (ln(10) * m) / sqrt(n) end, 6) as error from ag")
def b_value_by_cluster(spark: SparkSession, d: str) -> DataFrame:
    x = analytics.differences(_labelled(spark, d), "m", ["event_time", "seq"], ["label"])
    return analytics.b_positive(x, ["label"], 0.5, 5, 10)
