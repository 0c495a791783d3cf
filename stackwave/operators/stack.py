"""Delay-and-sum stacking: a relational form and an array kernel of the same contract.

images: (batch_id, trace_id, offset, samples): sample k of a trace lies at
offset + k. shifts: (node_id, trace_id, shift, weight): the trace counts for
the node at sample offset + k + shift. Zero weights are skipped. The stack's
maximum over nodes keeps the least node id of equals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stackwave.plans.dist import arrow_schema, grouped_map


def stack_rows(images: DataFrame, shifts: DataFrame) -> DataFrame:
    """(batch_id, node_id, t, v): the full stack, exploded; for small data and as a check."""
    s = images.select("batch_id", "trace_id", "offset", F.posexplode("samples").alias("k", "x"))
    j = s.join(shifts.where("weight <> 0"), "trace_id")
    return j.groupBy("batch_id", "node_id", (F.col("offset") + F.col("k") + F.col("shift")).alias("t")).agg(F.sum(F.col("weight") * F.col("x").cast("double")).alias("v"))


def reduce_max(stack: DataFrame) -> DataFrame:
    """(batch_id, t, v, node_id): the greatest node per sample, the least id of equals; a mergeable aggregate."""
    m = stack.groupBy("batch_id", "t").agg(F.max(F.struct("v", (-F.col("node_id")).alias("k"))).alias("m"))
    return m.select("batch_id", "t", F.col("m.v").alias("v"), (-F.col("m.k")).alias("node_id"))


def resume(before: DataFrame, after: DataFrame) -> DataFrame:
    """Unite the running maxima of two sets of nodes."""
    return reduce_max(before.unionByName(after))


def snapshot(stack: DataFrame, t: int, leaves: DataFrame | None = None) -> DataFrame:
    """The value of every node at one sample; of the given leaves alone where there are any."""
    out = stack.where(F.col("t") == t).select("batch_id", "node_id", "v")
    return out if leaves is None else out.join(leaves.select("node_id"), "node_id", "left_semi").select("batch_id", "node_id", "v")


def extent(images: DataFrame, shifts: DataFrame, shift_range: tuple[int, int] | None = None) -> DataFrame:
    """(batch_id, first, last): the samples that any pair of trace and node reaches, or that shifts in a given range would reach."""
    if shift_range is not None:
        lo, hi = shift_range
        return images.groupBy("batch_id").agg((F.min("offset") + lo).alias("first"), (F.max(F.col("offset") + F.size("samples")) + hi).alias("last"))
    j = images.join(shifts, "trace_id")
    return j.groupBy("batch_id").agg(F.min(F.col("offset") + F.col("shift")).alias("first"), F.max(F.col("offset") + F.col("shift") + F.size("samples")).alias("last"))


def local_maxima(maxima: DataFrame, height: float | None = None) -> DataFrame:
    """Samples strictly above both neighbours (a neighbour that is absent counts as lower)."""
    w = W.partitionBy("batch_id").orderBy("t")
    p, n = F.lag("v").over(w), F.lead("v").over(w)
    out = maxima.withColumn("_p", p).withColumn("_n", n).where("(_p is null or v > _p) and (_n is null or v > _n)").drop("_p", "_n")
    return out if height is None else out.where(F.col("v") >= height)


SHORT = 4096  # samples of a stack up to which windows are taken at once


def kernel(samples: list[np.ndarray], offsets: np.ndarray, shifts: np.ndarray, weights: np.ndarray, first: int, last: int, skip: np.ndarray | None = None, best: np.ndarray | None = None, index: np.ndarray | None = None, floor: float = -np.inf, absent: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(best, index) over [first, last) for nodes x traces shifts and weights: never holds node x sample.

    skip leaves nodes out; absent is a node's value where none of its traces reaches; best and index resume from earlier nodes. Strictly
    greater wins, so the least node number of equals stays.
    """
    n = last - first
    best = np.full(n, floor) if best is None else best.copy()
    index = np.zeros(n, np.int64) if index is None else index.copy()
    nodes = np.arange(len(shifts)) if skip is None else np.flatnonzero(~skip)
    if absent == 0 and 0 < n <= SHORT and len(samples):
        # short stacks: all traces side by side, a node's windows taken at once and summed as a product
        at = np.asarray(offsets)[None] + shifts - first
        pad = int(max(0, at.max(initial=0)))
        wide = np.zeros((len(samples), max(pad - int(min(0, at.min(initial=0))) + n, pad + max(map(len, samples)))))
        for k, x in enumerate(samples):
            wide[k, pad : pad + len(x)] = x
        windows = np.lib.stride_tricks.sliding_window_view(wide, n, axis=1)
        for node in nodes:
            use = np.flatnonzero(weights[node])
            row = weights[node, use] @ windows[use, pad - at[node, use]]
            up = row > best
            best[up] = row[up]
            index[up] = node
        return best, index
    row, met = np.empty(n), np.empty(n, bool)
    for node in nodes:
        row[:], met[:] = 0.0, False
        for k, x in enumerate(samples):
            w = weights[node, k]
            if w == 0:
                continue
            a = int(offsets[k] + shifts[node, k]) - first
            lo, hi = max(a, 0), min(a + len(x), n)
            if lo < hi:
                row[lo:hi] += w * x[lo - a : hi - a]
                met[lo:hi] = True
        if absent != 0:
            row[~met] = absent
        up = row > best
        best[up] = row[up]
        index[up] = node
    return best, index


_MAX = "batch_id long, tile long, first long, node_ids array<long>, v array<double>"


def stack_kernel(images: DataFrame, shifts: DataFrame, tile: int = 64) -> DataFrame:
    """(batch_id, t, v, node_id) by the array kernel: one task per batch and tile of nodes, then the maximum over tiles.

    Samples that no shifted trace of any node reaches are absent, and a node
    with no trace at a sample does not count there.
    """
    spans = extent(images, shifts.where("weight <> 0"))
    s = shifts.withColumn("tile", F.floor(F.col("node_id") / tile)).groupBy("tile", "trace_id").agg(F.sort_array(F.collect_list(F.struct("node_id", "shift", "weight"))).alias("s"))
    j = images.join(s, "trace_id").join(spans, "batch_id")
    j = j.select("batch_id", "tile", "trace_id", "offset", F.col("samples").cast("array<double>").alias("samples"), F.transform("s", lambda x: x["node_id"]).alias("nodes"), F.transform("s", lambda x: x["shift"].cast("long")).alias("shift"), F.transform("s", lambda x: x["weight"].cast("double")).alias("weight"), "first", "last")
    schema = arrow_schema(_MAX)

    def run(key: tuple, t: pa.Table) -> Iterator[pa.Table]:
        names = np.unique(np.concatenate([np.array(x) for x in t["nodes"].to_pylist()]))
        tr = t.num_rows
        sh, we = np.zeros((len(names), tr), np.int64), np.zeros((len(names), tr))
        for k, (n, s_, w) in enumerate(zip(t["nodes"].to_pylist(), t["shift"].to_pylist(), t["weight"].to_pylist())):
            at = np.searchsorted(names, n)
            sh[at, k], we[at, k] = s_, w
        first, last = int(t["first"][0].as_py()), int(t["last"][0].as_py())
        best, index = kernel([np.array(x) for x in t["samples"].to_pylist()], t["offset"].to_numpy(), sh, we, first, last, absent=-np.inf)
        yield pa.Table.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([first], pa.int64()), pa.array([names[index].tolist()], pa.list_(pa.int64())), pa.array([best.tolist()], pa.list_(pa.float64()))], schema=schema)

    tiles = grouped_map(j, ["batch_id", "tile"], run, _MAX, order=["trace_id"])
    rows = tiles.select("batch_id", "first", F.posexplode(F.arrays_zip("v", "node_ids")).alias("k", "x"))
    rows = rows.where(F.col("x.v") > float("-inf"))
    return reduce_max(rows.select("batch_id", (F.col("first") + F.col("k")).alias("t"), F.col("x.v").alias("v"), F.col("x.node_ids").alias("node_id")))


def shift_samples(tt: str, rate: float):  # noqa: ANN201
    """Round half to even of -tt * rate; a missing travel time shifts by 0 (and must weigh 0)."""
    return F.coalesce(F.rint(-F.when(~F.isnan(tt), F.col(tt)) * rate), F.lit(0.0)).cast("int")
