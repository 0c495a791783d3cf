"""Octrees of candidate places as tables: grid, split, borders, neighbours, reductions.

A node is (node_id, parent_id, level, east, north, depth, size); depth is down,
the coordinates are the cube's centre. node_id is parent * 8 + octant + 1 below
the roots, roots count from 0 with east fastest, in steps of ROOTS per level.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwave.functions import geo


@dataclass(frozen=True)
class Bounds:
    east: tuple[float, float]
    north: tuple[float, float]
    depth: tuple[float, float]

    def counts(self, size: float) -> tuple[int, int, int]:
        out = []
        for lo, hi in (self.east, self.north, self.depth):
            n = (hi - lo) / size
            if abs(n - round(n)) > 1e-9 or n < 1:
                raise ValueError("an octree's extent must be a multiple of its root size")
            out.append(round(n))
        return tuple(out)

    @property
    def volume(self) -> float:
        return (self.east[1] - self.east[0]) * (self.north[1] - self.north[0]) * (self.depth[1] - self.depth[0])


def roots(spark: SparkSession, b: Bounds, size: float) -> DataFrame:
    ne, nn, nd = b.counts(size)
    i = F.col("id")
    return spark.range(ne * nn * nd).select(
        i.alias("node_id"), F.lit(None).cast("long").alias("parent_id"), F.lit(0).alias("level"),
        (b.east[0] + (i % ne + 0.5) * size).alias("east"), (b.north[0] + (F.floor(i / ne) % nn + 0.5) * size).alias("north"), (b.depth[0] + (F.floor(i / (ne * nn)) + 0.5) * size).alias("depth"),
        F.lit(float(size)).alias("size"),
    )


def split(nodes: DataFrame, levels: int) -> DataFrame:
    """The eight children of each node that may split (level + 1 < levels); east slowest, depth fastest."""
    octants = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(e).alias("e"), F.lit(n).alias("n"), F.lit(d).alias("d")) for k, (e, n, d) in enumerate([(e, n, d) for e in (-1, 1) for n in (-1, 1) for d in (-1, 1)])])
    c = nodes.where(F.col("level") + 1 < levels).withColumn("o", F.explode(octants))
    q = F.col("size") / 4
    return c.select(
        (F.col("node_id") * 8 + F.col("o.k") + 10_000_000).alias("node_id"), F.col("node_id").alias("parent_id"), (F.col("level") + 1).alias("level"), (F.col("east") + F.col("o.e") * q).alias("east"),
        (F.col("north") + F.col("o.n") * q).alias("north"), (F.col("depth") + F.col("o.d") * q).alias("depth"), (F.col("size") / 2).alias("size"),
    )


def level_set(spark: SparkSession, b: Bounds, size: float, level: int) -> DataFrame:
    n = roots(spark, b, size)
    for _ in range(level):
        n = split(n, level + 2)
    return n


def leaves(nodes: DataFrame) -> DataFrame:
    return nodes.join(nodes.select(F.col("parent_id").alias("node_id")).where("node_id is not null").distinct(), "node_id", "left_anti")


def border_distance(b: Bounds, with_surface: bool = False) -> Column:
    d = [F.col("east") - b.east[0], b.east[1] - F.col("east"), F.col("north") - b.north[0], b.north[1] - F.col("north"), b.depth[1] - F.col("depth")]
    return F.least(*d, *([F.col("depth") - b.depth[0]] if with_surface else []))


def inside_border(nodes: DataFrame, b: Bounds, width: float, with_surface: bool = False) -> DataFrame:
    return nodes.where(border_distance(b, with_surface) > width)


def density() -> Column:
    return F.col("semblance") / F.pow(F.col("size"), 3.0)


def densest(nodes: DataFrame) -> DataFrame:
    """The leaf of greatest density, the least id of equals."""
    return nodes.agg(F.max(F.struct(density().alias("density"), (-F.col("node_id")).alias("k"))).alias("x")).select((-F.col("x.k")).alias("node_id"), F.col("x.density").alias("density"))


def reduce_axis(nodes: DataFrame, a: str, b: str, how: Column, level: int | None = None) -> DataFrame:
    """Group leaves by two axes and size, by any aggregate column."""
    n = nodes if level is None else nodes.where(F.col("level") <= level)
    return n.groupBy(a, b, "size").agg(how)


def touching(nodes: DataFrame, root: float) -> DataFrame:
    """(node_id, other_id) of different cubes that touch, faces, edges and corners alike.

    Cubes meet in the cells of a root-size grid that they touch, so a node
    is compared with those near it only.
    """
    eps, half = 1e-9 * root, F.col("size") / 2
    axes = ("east", "north", "depth")
    cells = lambda x: F.sequence(F.floor((F.col(x) - half - eps) / root), F.floor((F.col(x) + half + eps) / root))
    spread = nodes.select("node_id", *axes, "size")
    for i, x in enumerate(axes):
        spread = spread.withColumn(f"c{i}", F.explode(cells(x)))
    keys = ["c0", "c1", "c2"]
    o = spread.select(F.col("node_id").alias("other_id"), *[F.col(x).alias(f"o_{x}") for x in (*axes, "size")], *keys)
    hit = F.lit(True)
    for x in axes:
        hit = hit & (F.abs(F.col(x) - F.col(f"o_{x}")) <= (F.col("size") + F.col("o_size")) / 2 + eps)
    return spread.join(o, keys).where((F.col("node_id") != F.col("other_id")) & hit).select("node_id", "other_id").distinct()


def uncertainty(nodes: DataFrame, width: float = 0.02) -> DataFrame:
    """Box of the leaves with semblance of at least (1 - width) of the greatest one: offsets from that node, true and signed extents."""
    best = nodes.agg(F.max(F.struct("semblance", (-F.col("node_id")).alias("k"), "east", "north", "depth")).alias("m"))
    j = nodes.crossJoin(F.broadcast(best)).where(F.col("semblance") >= (1 - width) * F.col("m.semblance"))  # one row
    out = j.agg(*[f(F.col(x) - F.col(f"m.{x}")).alias(f"{x}_{n}") for x in ("east", "north", "depth") for n, f in (("min", F.min), ("max", F.max))])
    return out.withColumn("horizontal_signed", F.col("east_min") + F.col("east_max") + F.col("north_min") + F.col("north_max")).withColumn("horizontal", F.sqrt(F.pow(F.col("east_max") - F.col("east_min"), 2.0) + F.pow(F.col("north_max") - F.col("north_min"), 2.0))).withColumn("vertical", F.col("depth_max") - F.col("depth_min"))


def identity(*columns: str) -> Column:
    return F.sha1(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]))


def can_split(levels: int) -> Column:
    return F.col("level") + 1 < levels


def reset(nodes: DataFrame) -> DataFrame:
    """The roots alone, their semblance zero."""
    r = nodes.where("level = 0")
    return r.withColumn("semblance", F.lit(0.0)) if "semblance" in nodes.columns else r


def radius() -> Column:
    """Of the sphere around a node's cube."""
    return F.sqrt(F.lit(3.0)) / 2 * F.col("size")


def node_distance(east: float, north: float, depth: float) -> Column:
    return F.sqrt(F.pow(F.col("east") - east, 2.0) + F.pow(F.col("north") - north, 2.0) + F.pow(F.col("depth") - depth, 2.0))


def corners(b: Bounds) -> list[tuple[float, float, float]]:
    return [(e, n, d) for e in b.east for n in b.north for d in b.depth]


def with_location(nodes: DataFrame, lat: float, lon: float, depth: float = 0.0) -> DataFrame:
    """Adds lat, lon (on a sphere, by the reference's local plane) and effective_depth of each node."""
    up = F.degrees(F.col("north") / geo.EARTH_M)
    out = nodes.withColumn("lat", lat + up).withColumn("lon", lon + F.degrees(F.col("east") / (geo.EARTH_M * F.cos(F.radians(F.lit(lat))))))
    return out.withColumn("effective_depth", F.col("depth") + depth)


def above(nodes: DataFrame, threshold: float) -> DataFrame:
    """Nodes of at least the threshold; zero keeps all."""
    return nodes.where(F.col("semblance") >= threshold) if threshold else nodes


def axis_through_zero(lo: float, hi: float, step: float) -> list[float]:
    """Grid places from at most lo to at least hi with zero among them where it lies between."""
    first, last = math.floor(lo / step), math.ceil(hi / step)
    return [i * step for i in range(first, last + 1)]
