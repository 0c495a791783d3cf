"""Points near points, and points in regions, on a sphere.

near_pairs: locations become unit vectors; k-d splits fitted on a bounded
sample of both sides cut space into leaves; each left point goes to its leaf,
each right point to its leaf and, as a halo copy, to every leaf within the
chord radius. A leaf joins by a local k-d tree over its right points, queried
by chord. Each pair is found in exactly one leaf, that of its left point. A
leaf with more points than `block` on a side is cut into sub-blocks that meet
pairwise, so a place with a third of all points spreads over many tasks.

in_regions: points are cut into strips of longitude; each strip gets the edges
that cross it, and a sweep over the edge ends keeps the active edges. Between
two ends the edges of a region lie one above the other, so a search in their
order counts those above a point, and parity decides; where edges of a region
cross there, each is compared.

Defined cases: points lacking a coordinate, or with latitude outside -90..90
or a coordinate that isn't finite, take no part; longitudes 360 apart are the
same; repeated points all count; a point exactly on an edge belongs to the
region on one side only (the sweep is half-open); regions with fewer than
three vertices or a missing one hold nothing; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackwave.plans.dist import arrow_schema, grouped_map

EARTH_M = 6_371_000.0
SAMPLE = 100_000  # bound of the sample that the k-d splits and the strips are fitted on
MAX_LEAVES = 16_384
BLOCK = 20_000
BUCKET = 16


def chord(distance_m: float) -> float:
    return 2 * math.sin(min(distance_m / EARTH_M, math.pi) / 2)


def valid_point(lat: Column, lon: Column) -> Column:
    top = F.lit(float(np.finfo(np.float64).max))
    return lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon) & lat.between(-90.0, 90.0) & (F.abs(lon) <= top)


def unit_vectors(df: DataFrame, key: str, lat: str, lon: str, extra: list[Column] = []) -> DataFrame:  # noqa: B006
    la, lo = F.radians(F.col(lat)), F.radians(F.pmod(F.col(lon), F.lit(360.0)))
    return df.where(valid_point(F.col(lat), F.col(lon))).select(
        F.col(key).cast("long").alias("key"), (F.cos(la) * F.cos(lo)).alias("x"), (F.cos(la) * F.sin(lo)).alias("y"), F.sin(la).alias("z"), *extra
    )


class Splits:
    """A balanced k-d cut of space: heap-ordered axes and values, leaves 0..2^depth-1."""

    def __init__(self, points: np.ndarray, leaves: int) -> None:
        self.depth = max(0, math.ceil(math.log2(max(1, min(leaves, MAX_LEAVES)))))
        n = 2**self.depth - 1
        self.axis, self.value = np.zeros(n, np.int8), np.zeros(n)
        parts = {0: points}
        for i in range(n):
            p = parts.pop(i)
            if len(p):
                self.axis[i] = int(np.argmax(p.max(0) - p.min(0)))
                self.value[i] = np.median(p[:, self.axis[i]])
            low = p[:, self.axis[i]] <= self.value[i]
            parts[2 * i + 1], parts[2 * i + 2] = p[low], p[~low]

    def home(self, p: np.ndarray) -> np.ndarray:
        at = np.zeros(len(p), np.int64)
        for _ in range(self.depth):
            at = 2 * at + np.where(p[np.arange(len(p)), self.axis[at]] <= self.value[at], 1, 2)
        return at - (2**self.depth - 1)

    def within(self, p: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of each leaf that a box of half-width r around a point meets."""
        row, at = np.arange(len(p)), np.zeros(len(p), np.int64)
        for _ in range(self.depth):
            v, s = p[row, self.axis[at]], self.value[at]
            low, high = v - r <= s, v + r > s
            row, at = np.concatenate([row[low], row[high]]), np.concatenate([2 * at[low] + 1, 2 * at[high] + 2])
        return row, at - (2**self.depth - 1)


class LocalTree:
    """An implicit balanced k-d tree over an array of points, for ball queries by chord."""

    def __init__(self, points: np.ndarray) -> None:
        n = len(points)
        self.depth = max(0, math.ceil(math.log2(max(1, n / BUCKET))))
        order = np.arange(n)
        bounds = [(0, n)]
        self.lo, self.hi = [], []
        for level in range(self.depth + 1):
            self.lo.append(np.array([points[order[a:b]].min(0) if b > a else [np.inf] * 3 for a, b in bounds]))
            self.hi.append(np.array([points[order[a:b]].max(0) if b > a else [-np.inf] * 3 for a, b in bounds]))
            if level == self.depth:
                break
            nxt = []
            for a, b in bounds:
                m = (a + b) // 2
                if b - a > 1:
                    seg = order[a:b]
                    ax = int(np.argmax(self.hi[-1][len(nxt) // 2] - self.lo[-1][len(nxt) // 2]))
                    order[a:b] = seg[np.argpartition(points[seg, ax], m - a)]
                nxt += [(a, m), (m, b)]
            bounds = nxt
        self.order, self.points = order, points[order]
        self.start = np.array([a for a, _ in bounds])
        self.count = np.array([b - a for a, b in bounds])

    def query(self, q: np.ndarray, r: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pieces of (query row, point row, squared chord) of all pairs within chord r."""
        for s in range(0, len(q), 2048):
            row, at = np.arange(s, min(s + 2048, len(q))), np.zeros(min(2048, len(q) - s), np.int64)
            for level in range(self.depth + 1):
                d = np.maximum(np.maximum(self.lo[level][at] - q[row], q[row] - self.hi[level][at]), 0)
                near = (d * d).sum(1) <= r * r
                row, at = row[near], at[near]
                if level < self.depth:
                    row, at = np.repeat(row, 2), np.stack([2 * at, 2 * at + 1], 1).ravel()
            for c in range(0, len(row), 65536):  # about a million candidate pairs at a time
                ro, n = row[c : c + 65536], self.count[at[c : c + 65536]]
                pr = np.repeat(ro, n)
                pt = np.repeat(self.start[at[c : c + 65536]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                d2 = ((q[pr] - self.points[pt]) ** 2).sum(1)
                hit = d2 <= r * r
                yield pr[hit], self.order[pt[hit]], d2[hit]


def _xyz(t) -> np.ndarray:
    return np.stack([np.asarray(t.column(c)) for c in ("x", "y", "z")], 1)


def _leaves(splits: Splits, r: float, right: bool, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = _xyz(b)
            row, leaf = splits.within(p, r) if right else (np.arange(len(p)), splits.home(p))
            t = b.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array(leaf)], schema=schema)

    return run


def bounded_sample(df: DataFrame, n: int, bound: int = SAMPLE) -> DataFrame:
    """About `bound` rows at most, by a fixed seed."""
    return df.sample(min(1.0, bound / max(n, 1)), seed=7).limit(2 * bound)


def near_pairs(left: DataFrame, right: DataFrame, radius_m: float, block: int = BLOCK, once: bool = False, apart: str | None = None) -> DataFrame:
    """(left_key, right_key, distance_m) of all pairs within radius_m on the sphere.

    left and right come from unit_vectors. Splits are fitted on at most
    2 * SAMPLE points of each side; every point is indexed. With once only
    pairs with left_key < right_key count (a table with itself); apart names a
    text column of both sides that must differ (null equals null).
    """
    spark, r = left.sparkSession, chord(radius_m)
    nl, nr = left.count(), right.count()
    pts = [np.array([tuple(x) for x in bounded_sample(d.select("x", "y", "z"), n).collect()], float).reshape(-1, 3) for d, n in ((left, nl), (right, nr))]
    splits = Splits(np.concatenate(pts), max(1, -(-(nl + nr) // block)))
    tag = F.col(apart).cast("string") if apart else F.lit(None).cast("string")
    left, right = (d.select("key", "x", "y", "z", tag.alias("name")) for d in (left, right))
    ddl = "key long, x double, y double, z double, name string, leaf long"
    sch = arrow_schema(ddl)
    reach = r * (1 + 1e-9) + 1e-15
    cols = ["key", "x", "y", "z", "name"]
    a = left.select(*cols).mapInArrow(_leaves(splits, reach, False, sch), ddl).withColumn("side", F.lit(0))
    b = right.select(*cols).mapInArrow(_leaves(splits, reach, True, sch), ddl).withColumn("side", F.lit(1))
    both = a.unionByName(b)
    # at most two counts of each of MAX_LEAVES leaves
    sizes: dict[int, list[int]] = {}
    for x in both.groupBy("leaf", "side").count().collect():
        sizes.setdefault(x["leaf"], [0, 0])[x["side"]] = x["count"]
    cuts = {k: (-(-v[0] // block), -(-v[1] // block)) for k, v in sizes.items() if all(v)}
    if not cuts:
        return spark.createDataFrame([], "left_key long, right_key long, distance_m double")
    m = spark.createDataFrame([(k, *v) for k, v in cuts.items()], "leaf long, ml long, mr long")
    both = both.join(F.broadcast(m), "leaf")  # MAX_LEAVES rows at most
    mine, other = F.when(F.col("side") == 0, F.col("ml")).otherwise(F.col("mr")), F.when(F.col("side") == 0, F.col("mr")).otherwise(F.col("ml"))
    both = both.withColumn("i", F.pmod(F.xxhash64("key", "x", "y", "z"), mine)).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), (other - 1).cast("long"))))
    both = both.select(
        "leaf", F.when(F.col("side") == 0, F.col("i")).otherwise(F.col("o")).cast("long").alias("bl"),
        F.when(F.col("side") == 0, F.col("o")).otherwise(F.col("i")).cast("long").alias("br"), "side", *cols,
    )
    out = "left_key long, right_key long, distance_m double"
    schema = arrow_schema(out)

    def join(_: tuple, t: pa.Table) -> Iterator[pa.Table]:
        side, p, key = np.asarray(t["side"]), _xyz(t), np.asarray(t["key"])
        le, ri = side == 0, side == 1
        if not le.any() or not ri.any():
            return
        lk, rk = key[le], key[ri]
        code = pc.fill_null(t["name"].combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False) if apart else side
        lc, rc = code[le], code[ri]
        for qi, pi, d2 in LocalTree(p[ri]).query(p[le], r):
            keep = (lk[qi] < rk[pi]) | (not once)
            if apart:
                keep &= lc[qi] != rc[pi]
            qi, pi, d2 = qi[keep], pi[keep], d2[keep]
            yield pa.Table.from_arrays([pa.array(lk[qi]), pa.array(rk[pi]), pa.array(2 * EARTH_M * np.arcsin(np.minimum(np.sqrt(d2) / 2, 1)))], schema=schema)

    return grouped_map(both, ["leaf", "bl", "br"], join, out)


def region_edges(regions: DataFrame, key: str, ring_lon: str, ring_lat: str) -> DataFrame:
    """(region, x1, y1, x2, y2) with x1 < x2: the edges of each closed ring, also shifted by a turn either way, that meet -180..180."""
    ok = F.expr(f"size({ring_lon}) = size({ring_lat}) and size({ring_lon}) >= 3") & ~F.exists(ring_lon, lambda v: v.isNull() | F.isnan(v)) & ~F.exists(ring_lat, lambda v: v.isNull() | F.isnan(v))
    e = regions.where(ok).select(
        F.col(key).cast("long").alias("region"),
        F.explode(F.arrays_zip(F.col(ring_lon).alias("a"), F.col(ring_lat).alias("b"), F.concat(F.slice(ring_lon, 2, F.size(ring_lon)), F.slice(ring_lon, 1, 1)).alias("c"), F.concat(F.slice(ring_lat, 2, F.size(ring_lat)), F.slice(ring_lat, 1, 1)).alias("d"))).alias("e"),
    ).select("region", *[F.col(f"e.{k}").alias(n) for k, n in (("a", "ax"), ("b", "ay"), ("c", "bx"), ("d", "by"))])
    e = e.withColumn("turn", F.explode(F.array(*[F.lit(x) for x in (-360.0, 0.0, 360.0)]))).where("ax <> bx")
    flip = F.col("ax") > F.col("bx")
    e = e.select(
        "region", (F.least("ax", "bx") + F.col("turn")).alias("x1"), F.when(flip, F.col("by")).otherwise(F.col("ay")).alias("y1"),
        (F.greatest("ax", "bx") + F.col("turn")).alias("x2"), F.when(flip, F.col("ay")).otherwise(F.col("by")).alias("y2"),
    )
    return e.where("x2 > -180 and x1 <= 180")


def sweep(px: np.ndarray, py: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, region: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(point row, region) of each containment: a sweep along x with the active edges."""
    order = np.argsort(px, kind="stable")
    stops = np.unique(np.concatenate([x1, x2]))
    begin, end = np.argsort(x1, kind="stable"), np.argsort(x2, kind="stable")
    cut = np.searchsorted(px[order], stops, side="left")
    active: set[int] = set()
    bi = ei = 0
    rows, regs = [], []
    for k, s in enumerate(stops):
        while ei < len(end) and x2[end[ei]] <= s:
            active.discard(int(end[ei]))
            ei += 1
        while bi < len(begin) and x1[begin[bi]] <= s:
            if x2[begin[bi]] > s:
                active.add(int(begin[bi]))
            bi += 1
        lo, hi = cut[k], cut[k + 1] if k + 1 < len(stops) else len(px)
        if hi <= lo or not active:
            continue
        e = np.fromiter(active, np.int64)
        until = stops[k + 1] if k + 1 < len(stops) else s
        at = lambda i, x: y1[i] + (y2[i] - y1[i]) / (x2[i] - x1[i]) * (x - x1[i])
        e = e[np.lexsort((at(e, until), at(e, s), region[e]))]
        edges = np.r_[np.flatnonzero(np.r_[True, np.diff(region[e]) != 0]), len(e)]
        pts = order[lo:hi]
        for a, b in zip(edges[:-1], edges[1:]):
            mine = e[a:b]
            if (np.diff(at(mine, until)) >= 0).all():
                low, high = np.zeros(len(pts), np.int64), np.full(len(pts), b - a)
                while (low < high).any():  # the first edge above each point
                    mid = (low + high) // 2
                    above = at(mine[np.minimum(mid, b - a - 1)], px[pts]) > py[pts]
                    go = low < high
                    low, high = np.where(go & ~above, mid + 1, low), np.where(go & above, mid, high)
                n = b - a - low
            else:
                n = np.zeros(len(pts), np.int64)
                for c in range(0, len(pts), max(1, 2_000_000 // len(mine))):
                    u = slice(c, c + max(1, 2_000_000 // len(mine)))
                    n[u] = (at(mine, px[pts[u]][:, None]) > py[pts[u]][:, None]).sum(1)
            hit = pts[n % 2 == 1]
            rows.append(hit)
            regs.append(np.full(len(hit), region[mine[0]]))
    none = np.zeros(0, np.int64)
    return np.concatenate(rows or [none]), np.concatenate(regs or [none])


def in_regions(points: DataFrame, key: str, lat: str, lon: str, regions: DataFrame, region_key: str, ring_lon: str, ring_lat: str, block: int = BLOCK) -> DataFrame:
    """(key, region) for each point inside each region; rings have straight edges in the lon/lat plane and may run past 180."""
    p = points.where(valid_point(F.col(lat), F.col(lon))).select(F.col(key).cast("long").alias("key"), (F.pmod(F.col(lon) + 180.0, F.lit(360.0)) - 180.0).alias("x"), F.col(lat).cast("double").alias("y"))
    n = p.count()
    xs = np.sort([r[0] for r in bounded_sample(p.select("x"), n).collect()])
    strips = max(1, min(MAX_LEAVES, -(-n // block)))
    bounds = np.unique(np.quantile(xs, np.arange(1, strips) / strips)) if len(xs) else np.zeros(0)
    lows, highs = [-180.0, *bounds.tolist()], [*bounds.tolist(), 180.0]
    ddl = "key long, x double, y double, strip long"
    sch, edge_ddl = arrow_schema(ddl), "region long, x1 double, y1 double, x2 double, y2 double, strip long"

    def strip_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.searchsorted(bounds, np.asarray(b.column("x")), side="right"))], schema=sch)

    def strips_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo = np.searchsorted(highs, np.asarray(b.column("x1")), side="left")
            hi = np.searchsorted(lows, np.asarray(b.column("x2")), side="right")
            n = np.maximum(hi - lo, 0)
            row = np.repeat(np.arange(b.num_rows), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            t = b.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array(at.astype(np.int64))], schema=arrow_schema(edge_ddl))

    placed = p.mapInArrow(strip_of, ddl)
    sizes = {x["strip"]: -(-x["count"] // block) for x in placed.groupBy("strip").count().collect()}  # MAX_LEAVES rows at most
    if not sizes:
        return p.sparkSession.createDataFrame([], "key long, region long")
    parts = p.sparkSession.createDataFrame(list(sizes.items()), "strip long, parts long")
    edges = region_edges(regions, region_key, ring_lon, ring_lat).mapInArrow(strips_of, edge_ddl).join(F.broadcast(parts), "strip")
    zero = F.lit(None).cast("double")
    a = placed.join(F.broadcast(parts), "strip").select(
        "strip", F.pmod(F.xxhash64("key", "x", "y"), F.col("parts")).alias("part"), "key", F.lit(0).alias("side"), F.col("x").alias("x1"), F.col("y").alias("y1"), zero.alias("x2"), zero.alias("y2")
    )
    b = edges.select("strip", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("region").alias("key"), F.lit(1).alias("side"), "x1", "y1", "x2", "y2")
    out = "key long, region long"
    schema = arrow_schema(out)

    def join(_: tuple, t: pa.Table) -> Iterator[pa.Table]:
        side = np.asarray(t["side"])
        pt, ed = side == 0, side == 1
        if not pt.any() or not ed.any():
            return
        c = {k: t[k].to_numpy() for k in ("key", "x1", "y1", "x2", "y2")}
        i, region = sweep(c["x1"][pt], c["y1"][pt], *(c[k][ed] for k in ("x1", "y1", "x2", "y2", "key")))
        yield pa.Table.from_arrays([pa.array(c["key"][pt][i]), pa.array(region)], schema=schema)

    return grouped_map(a.unionByName(b), ["strip", "part"], join, out)
