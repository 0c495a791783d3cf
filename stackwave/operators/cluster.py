"""Density clustering: neighbours on a grid, core points, components by star contraction.

Points within eps of a core point (one with at least least_points neighbours,
itself included) belong to its cluster; a border point goes to the cluster of
its nearest core point (the least id of equals). The label is the least core id
of the cluster, -1 is noise. Null or NaN coordinates are noise.

Dense places never form their pairs. Core points of one cell (side eps / sqrt
of the axes) are mutually near and enter the components as one node. Whether
cells link, how many neighbours a point of a thin cell has, and which core
point is nearest is decided on sub-cells with their bounds: a sub-cell wholly
inside or outside eps needs none of its points; only the sub-cells that eps cuts
are opened, and only where they decide. A cell has at most FINE ** axes of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackwave.plans.dist import checkpointed

FINE = 12
FEW = 200_000  # links up to which one task unites them; beyond, rounds over tables do


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, root) of links (u, v), by union and find."""
    up: dict[int, int] = {}

    def find(k: int) -> int:
        root = k
        while up.setdefault(root, root) != root:
            root = up[root]
        while up[k] != root:
            up[k], k = root, up[k]
        return root

    for b in batches:
        for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist()):
            x, y = find(u), find(v)
            up[max(x, y)] = min(x, y)
    ids = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([find(k) for k in ids], pa.int64())], names=["id", "root"])


def components(links: DataFrame) -> DataFrame:
    """(id, root): the least id of each component of links(a, b); large-star and small-star rounds on checkpointed tables."""
    e = checkpointed(links.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).where("u > v").distinct())
    if e.count() <= FEW:
        return e.repartition(1).mapInArrow(_united, "id long, root long")
    while True:
        # large star: each node's greater neighbours go to its least neighbour (or itself)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        # small star: each node and its lesser neighbours go to the least of them
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(m.select("u", F.col("m").alias("v"))).distinct()
        e = checkpointed(small)
        # done when every node but the roots hangs on one root: then no round changes anything
        roots = e.groupBy("u").agg(F.count("*").alias("n")).withColumnRenamed("u", "k")
        if e.join(roots, e["v"] == roots["k"], "left_semi").isEmpty() and roots.where("n > 1").isEmpty():
            break
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def dbscan(points: DataFrame, key: str, axes: list[str], eps: float, least_points: int) -> DataFrame:
    """(key, label) of every row of points; key is unique."""
    n = len(axes)
    xs, cs = [f"x{i}" for i in range(n)], [f"c{i}" for i in range(n)]
    side = eps / n**0.5 * (1 - 1e-12)
    p = points.select(F.col(key).cast("long").alias("id"), *[F.col(a).cast("double").alias(x) for a, x in zip(axes, xs)])
    p = checkpointed(p.where(" and ".join(f"{x} is not null and not isnan({x})" for x in xs)))  # read a dozen times below
    ks = [f"k{i}" for i in range(n)]
    # cells, coarse cells of side eps, and sub-cells (each in one cell and one coarse cell)
    p = p.select("*", *[F.floor(F.col(x) / side).alias(c) for x, c in zip(xs, cs)], *[F.floor(F.col(x) / (eps * (1 + 1e-12))).alias(k) for x, k in zip(xs, ks)])
    p = p.withColumn("sub", F.concat_ws(",", *[F.floor(F.col(x) / (side / FINE)).cast("string") for x in xs], *ks))

    def subs(q: DataFrame) -> DataFrame:
        """Sub-cells with their number and bounds, keyed by n<cell>, n<coarse cell> and sub."""
        a = q.groupBy(*cs, *ks, "sub").agg(F.count("*").alias("n"), *[f(x).alias(f"{h}_{x}") for x in xs for h, f in (("lo", F.min), ("hi", F.max))])
        for c in (*cs, *ks):
            a = a.withColumnRenamed(c, f"n{c}")
        return a

    def around(q: DataFrame) -> DataFrame:
        """Each row once for every coarse cell that it may reach into, as n<coarse cell>."""
        for k in ks:
            q = q.withColumn(f"n{k}", F.explode(F.array(*[F.col(k) + i for i in (-1, 0, 1)])))
        return q

    def beside(cells: DataFrame) -> DataFrame:
        """The coarse cells (side eps) in and around the given ones, with what they carry."""
        for k in ks:
            cells = cells.withColumn(k, F.explode(F.array(*[F.col(k) + i for i in (-1, 0, 1)])))
        return cells

    busy = beside(p.groupBy(*ks).agg(F.count("*").alias("n"))).groupBy(*ks).agg(F.sum("n").alias("n")).where(F.col("n") >= least_points).select(*ks)
    ncs, nks = [f"n{c}" for c in cs], [f"n{k}" for k in ks]
    root = lambda parts: F.sqrt(sum(parts, F.lit(0.0)))
    zero = F.lit(0.0)
    nearest: Column = root(F.pow(F.greatest(F.col(f"lo_{x}") - F.col(x), F.col(x) - F.col(f"hi_{x}"), zero), 2.0) for x in xs)
    farthest: Column = root(F.pow(F.greatest(F.abs(F.col(x) - F.col(f"lo_{x}")), F.abs(F.col(f"hi_{x}") - F.col(x))), 2.0) for x in xs)

    def opened(q: DataFrame, of: DataFrame, more: list[str]) -> DataFrame:
        """Pairs of q's rows with the points of the sub-cell that each names."""
        o = of.select(F.col("id").alias("o_id"), *[F.col(x).alias(f"o_{x}") for x in xs], *[F.col(c).alias(f"n{c}") for c in cs], "sub", *more)
        return q.join(o, [*ncs, "sub"]).withColumn("d", root(F.pow(F.col(x) - F.col(f"o_{x}"), 2.0) for x in xs))

    # core points: all of a full cell; else by sub-cells inside eps, then by the points of those that eps cuts
    full = p.groupBy(*cs).agg(F.count("*").alias("n")).where(F.col("n") >= least_points).select(*cs)
    dense = p.join(full, cs, "left_semi")
    thin = p.join(full, cs, "left_anti")
    seen = around(thin.join(busy, ks, "left_semi").drop("sub")).join(subs(p), nks).where(nearest <= eps).withColumn("sure", farthest <= eps)
    bounds = seen.groupBy("id").agg(F.sum(F.when(F.col("sure"), F.col("n")).otherwise(0)).alias("least"), F.sum("n").alias("most"))
    bounds = checkpointed(bounds.where(F.col("most") >= least_points))
    open_ = seen.where("not sure").drop("n").join(bounds.where(F.col("least") < least_points).select("id", "least"), "id")
    counted = opened(open_, p, []).where(F.col("d") <= eps).groupBy("id").agg((F.count("*") + F.first("least")).alias("k")).where(F.col("k") >= least_points)
    ids = bounds.where(F.col("least") >= least_points).select("id").unionByName(counted.select("id"))
    core = checkpointed(dense.unionByName(thin.join(ids, "id", "left_semi")))

    # links of cells: two sub-cells wholly within eps, else a pair of points of two that eps cuts
    heads = core.groupBy(*cs).agg(F.min("id").alias("head"))
    boxes = subs(core)
    mine = boxes
    for c in (*cs, *ks):
        mine = mine.withColumnRenamed(f"n{c}", c)
    mine = around(mine.select(*cs, *ks, F.col("sub").alias("a_sub"), *[F.col(f"{h}_{x}").alias(f"{h}2_{x}") for x in xs for h in ("lo", "hi")]))
    once = (" or ".join(f"(n{c} > {c}" + "".join(f" and n{d} = {d}" for d in cs[:i]) + ")" for i, c in enumerate(cs)))
    b = mine.join(boxes, nks).where(once)
    gap = root(F.pow(F.greatest(F.col(f"lo_{x}") - F.col(f"hi2_{x}"), F.col(f"lo2_{x}") - F.col(f"hi_{x}"), zero), 2.0) for x in xs)
    width = root(F.pow(F.greatest(F.col(f"hi_{x}") - F.col(f"lo2_{x}"), F.col(f"hi2_{x}") - F.col(f"lo_{x}")), 2.0) for x in xs)
    b = b.withColumn("gap", gap).where(F.col("gap") <= eps).withColumn("sure", width <= eps)
    sure = checkpointed(b.where("sure").select(*cs, *ncs).distinct())
    cut = b.where("not sure").join(sure, [*cs, *ncs], "left_anti").select(*cs, *ncs, "a_sub", "sub")
    a = core.select(*cs, F.col("sub").alias("a_sub"), *xs)
    exact = opened(cut.join(a, [*cs, "a_sub"]), core, []).where(F.col("d") <= eps).select(*cs, *ncs).distinct()
    other = heads.withColumnRenamed("head", "o_head")
    for c in cs:
        other = other.withColumnRenamed(c, f"n{c}")
    links = sure.unionByName(exact).join(heads, cs).join(other, ncs).select(F.col("head").alias("a"), F.col("o_head").alias("b"))
    roots = components(links)
    named = core.join(heads, cs).join(roots.withColumnRenamed("id", "head"), "head", "left").withColumn("label", F.coalesce("root", "head"))

    # border points: the nearest core point, looked for in the sub-cells that may hold it
    rest = thin.join(beside(core.select(*ks).distinct()).distinct(), ks, "left_semi").join(core.select("id"), "id", "left_anti")
    may = around(rest.drop("sub")).join(boxes.drop("n"), nks).withColumn("near", nearest).where(F.col("near") <= eps).withColumn("far", farthest)
    best = may.groupBy("id").agg(F.min("far").alias("far_best"))
    may = may.join(best, "id").where("near <= far_best")
    border = opened(may, named, ["label"]).where(F.col("d") <= eps).groupBy("id").agg(F.min(F.struct("d", "o_id", "label")).alias("m")).select("id", F.col("m.label").alias("label"))
    found = named.select("id", "label").unionByName(border).withColumnRenamed("id", key)
    return points.select(F.col(key).cast("long").alias(key)).join(found, key, "left").withColumn("label", F.coalesce("label", F.lit(-1).cast("long")))


def colour_index(label: str, n: int = 10) -> Column:
    """0..n-1 by label, -1 for noise."""
    return F.when(F.col(label) < 0, F.lit(-1)).otherwise(F.pmod(F.col(label), F.lit(n)).cast("int"))
