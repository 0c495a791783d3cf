"""Network magnitudes, residuals, modelled amplitudes, moments, peaks of windows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stackwave.operators import ordered
from stackwave.plans.dist import arrow_schema, checkpointed, partitions


def network_magnitude(stations: DataFrame, k: float = 2.0, least: int = 3) -> DataFrame:
    """(event_uid, n, average, error): valid stations within k population deviations of the mean, median of at least `least`.

    error = sqrt((MAD / sqrt n)^2 + (median error / sqrt n)^2).
    """
    v = stations.where("flag = 'valid' and magnitude is not null and not isnan(magnitude)")
    w = W.partitionBy("event_uid")
    kept = v.where("true").withColumn("mu", F.avg("magnitude").over(w)).withColumn("sd", F.stddev_pop("magnitude").over(w)).where(F.abs(F.col("magnitude") - F.col("mu")) <= k * F.col("sd"))
    kept = kept.withColumn("med", F.median("magnitude").over(w))
    root = F.sqrt(F.count("*").cast("double"))
    err = F.sqrt(F.pow(F.median(F.abs(F.col("magnitude") - F.col("med"))) / root, 2.0) + F.pow(F.median("error") / root, 2.0))
    return kept.groupBy("event_uid").agg(F.count("*").alias("n"), F.round(F.first("med"), 6).alias("average"), F.round(err, 6).alias("error")).where(F.col("n") >= least)


def station_residuals(stations: DataFrame, least: int = 5) -> DataFrame:
    """Median of event minus station magnitude for stations with at least `least` finite ones."""
    v = stations.where("magnitude is not null and not isnan(magnitude) and abs(magnitude) < double('Infinity')")
    j = v.join(v.groupBy("event_uid").agg(F.median("magnitude").alias("avg_m")), "event_uid").withColumn("residual", F.col("avg_m") - F.col("magnitude"))
    return ordered.quantiles(j, ["nsl"], "residual", {"residual": 0.5}).where(F.col("n") >= least).select("nsl", "n", F.round("residual", 6).alias("residual"))


def nearest_depths(collections: DataFrame, key: str, depth: str, by: str) -> DataFrame:
    """(key, z1, z2): least and greatest depth of the two other rows of by that are nearest in depth, the lesser keys of equals first; rows with fewer than two others have none.

    Equal depths are one row with its two least keys, so that neighbours in
    depth order are all that a row needs.
    """
    c = collections.select(F.col(key).alias("_k"), F.col(depth).cast("double").alias("_z"), F.col(by).alias("_b")).where("_z is not null and not isnan(_z)")
    z = c.groupBy("_b", "_z").agg(F.count("*").alias("_c"), F.min("_k").alias("_first"))
    second = c.join(z, ["_b", "_z"]).where(F.col("_k") != F.col("_first")).groupBy("_b", "_z").agg(F.min("_k").alias("_second"))
    z = z.join(second, ["_b", "_z"], "left")
    w = W.partitionBy("_b").orderBy("_z")
    # the depths of a catalogue of collections: one row each
    for name, f in (("l1", F.lag("n_", 1)), ("l2", F.lag("n_", 2)), ("h1", F.lead("n_", 1)), ("h2", F.lead("n_", 2))):
        z = z.withColumn("n_", F.struct(F.col("_z").alias("z"), F.col("_first").alias("a"), F.col("_second").alias("b"))).withColumn(name, f.over(w))
    one = lambda s, k: F.struct(F.abs(s["z"] - F.col("_z")).alias("d"), s[k].alias("k"), s["z"].alias("z"))
    other = F.array(*[one(F.col(n), k) for n in ("l1", "l2", "h1", "h2") for k in ("a", "b")])
    own = F.transform(F.sequence(F.lit(1), F.lit(2)), lambda i: F.when(F.col("_c") > i, F.struct(F.lit(0.0).alias("d"), F.lit(None).cast(c.schema["_k"].dataType).alias("k"), F.col("_z").alias("z"))))
    best = F.slice(F.array_sort(F.filter(F.concat(own, other), lambda x: x.isNotNull() & x["z"].isNotNull() & ((x["d"] == 0) | x["k"].isNotNull()))), 1, 2)
    z = z.select("_b", "_z", F.transform(best, lambda x: x["z"]).alias("_best")).where(F.size("_best") == 2)
    return c.join(z, ["_b", "_z"]).select(F.col("_k").alias(key), F.array_min("_best").alias("z1"), F.array_max("_best").alias("z2"))


def network_moment(stations: DataFrame, k: float = 3.0) -> DataFrame:
    """(event_uid, n, average, error): median and its absolute deviation of the station magnitudes within k population deviations of their mean."""
    v = stations.where("magnitude is not null and not isnan(magnitude)")
    w = W.partitionBy("event_uid")
    kept = v.withColumn("_mu", F.avg("magnitude").over(w)).withColumn("_sd", F.stddev_pop("magnitude").over(w)).where(F.abs(F.col("magnitude") - F.col("_mu")) <= k * F.col("_sd"))
    kept = kept.withColumn("_med", F.median("magnitude").over(w))
    return kept.groupBy("event_uid").agg(F.count("*").alias("n"), F.round(F.first("_med"), 6).alias("average"), F.round(F.median(F.abs(F.col("magnitude") - F.col("_med"))), 6).alias("error"))


def reference_search(estimates: Column, initial: float = 1.0, rounds: int = 3) -> Column:
    """The estimate that agrees with the reference magnitude it came from.

    estimates maps a whole reference magnitude to the magnitude that it gives.
    From the initial one, its rounded estimate and the two beside it are tried;
    the middle one ends the search when it agrees best, else the best one is
    next. Null where a reference that is needed is missing.
    """
    at = lambda m: F.try_element_at(estimates, m.cast("int"))
    out, ref, done = F.lit(None).cast("double"), F.lit(int(initial)), F.lit(False)
    for k in range(rounds):
        near = F.rint(at(ref))
        off = [F.abs(at(near + d) - (near + d)) for d in (-1, 0, 1)]
        none = off[0].isNull() | off[1].isNull() | off[2].isNull()
        best = F.when(none, F.lit(None)).when((off[0] <= off[1]) & (off[0] <= off[2]), near - 1).when(off[1] <= off[2], near).otherwise(near + 1)
        hit = ~done & ((best == near) | F.lit(k == rounds - 1))
        out = F.when(hit, at(best)).otherwise(out)
        done = done | F.coalesce(hit, F.lit(True))
        ref = best.cast("int")
    return out


def local_and_moment(events: DataFrame, kind: str = "magnitude", average: str = "average") -> DataFrame:
    """(event_uid, local, moment, difference) of events that have both; rows are (event_uid, kind, average)."""
    one = lambda k: F.max(F.when(F.col(kind).startswith(k), F.col(average)))
    g = events.groupBy("event_uid").agg(one("Local").alias("local"), one("Moment").alias("moment")).where("local is not null and moment is not null")
    return g.withColumn("difference", F.round(F.col("local") - F.col("moment"), 6))


def suited(collections: DataFrame, wanted: dict[str, object], max_distance: float) -> DataFrame:
    """Libraries with equal parameters that reach at least max_distance."""
    ok = F.col("max_distance") >= max_distance
    for c, v in wanted.items():
        ok = ok & (F.col(c) == F.lit(v))
    return collections.where(ok)


_NEAR = "amp_id long, q_id long, n long, mean double, med double, mad double"
_EDGE = "part long, side long, q_id long, distance double, amp_id long, v double"


def modelled_for_all(library: DataFrame, value: str, k: int = 25) -> DataFrame:
    """Statistics of the k amplitudes nearest in distance within its collection, for every amplitude of the library: (amp_id, q_id, n, log_mean, log_median, rel_mad).

    The rows are sorted by collection and distance over all tasks, and each task
    sees 2 k candidates beyond its ends, so a large collection is cut into many.
    Of equal distances only the k least amp_ids can be among the nearest. Rows
    without a distance neither ask nor answer; a collection without values has no row.
    """
    has = F.col("v").isNotNull()
    r = library.select(F.col("collection_id").cast("long").alias("q_id"), F.col("distance_epi").cast("double").alias("distance"), F.col("amp_id").cast("long").alias("amp_id"), F.nanvl(F.col(value).cast("double"), F.lit(None)).alias("v")).where("distance is not null and not isnan(distance)")
    r = r.withColumn("v", F.when(has & (F.row_number().over(W.partitionBy("q_id", "distance", has).orderBy("amp_id")) <= k), F.col("v")))
    # fixed by the checkpoint, as the ends must be those of the very parts that are read again
    r = checkpointed(r.repartitionByRange(partitions(library.sparkSession), "q_id", "distance", "amp_id").sortWithinPartitions("q_id", "distance", "amp_id"))
    reach = 2 * k
    edge, near = arrow_schema(_EDGE), arrow_schema(_NEAR)

    def whole(batches: Iterator[pa.RecordBatch]) -> tuple[int, list[np.ndarray]]:
        from pyspark import TaskContext

        t = pa.Table.from_batches(list(batches), schema=pa.schema([("q_id", pa.int64()), ("distance", pa.float64()), ("amp_id", pa.int64()), ("v", pa.float64())]))
        q, d, a, v = (t[c].to_numpy() for c in ("q_id", "distance", "amp_id", "v"))
        return TaskContext.get().partitionId(), [q, d, a, v]

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, x = whole(batches)
        x = [c[~np.isnan(x[3])] for c in x]
        for side, cut in ((0, slice(0, reach)), (1, slice(-reach, None))):
            n = len(x[0][cut])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part)), pa.array(np.full(n, side)), *[pa.array(c[cut]) for c in x]], schema=edge)

    # 4 k rows a task
    e = {(int(p), int(s)): g.to_numpy() for (p, s), g in r.mapInArrow(ends, _EDGE).toPandas().groupby(["part", "side"])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, (q, d, a, v) = whole(batches)
        if not len(q):
            return
        before, after, at = [], [], part
        for found, side, step, order in ((before, 1, -1, lambda x: x[::-1]), (after, 0, 1, lambda x: x)):
            at = part + step
            while sum(map(len, found)) < reach and any(x == at or (x - at) * step > 0 for x, _ in e):
                if (at, side) in e:
                    found.append(e[at, side])
                at += step
        none = np.zeros((0, 6))
        before, after = np.concatenate([none, *before[::-1]]), np.concatenate([none, *after])
        ok = ~np.isnan(v)
        cq, cd, ca, cv = (np.concatenate([before[:, i].astype(c.dtype), c[ok], after[:, i].astype(c.dtype)]) for i, c in ((2, q), (3, d), (4, a), (5, v)))
        # the first candidate not before each row
        here = len(before) + np.r_[0, np.cumsum(ok)][np.arange(len(q))]
        for lo in range(0, len(q), 4096):
            s = slice(lo, lo + 4096)
            at = here[s, None] + np.arange(-reach, reach)
            inside = (at >= 0) & (at < len(cq))
            at = np.clip(at, 0, max(0, len(cq) - 1))
            if not len(cq):
                return
            inside &= cq[at] == q[s, None]
            diff = np.where(inside, np.abs(cd[at] - d[s, None]), np.inf)
            best = np.lexsort((ca[at], diff, ~inside), axis=1)[:, :k]
            there = np.take_along_axis(inside, best, 1)
            n = there.sum(1)
            got, n = np.where(there, cv[np.take_along_axis(at, best, 1)], np.nan)[n > 0], n[n > 0]
            row = np.arange(len(n))

            def median(x: np.ndarray, n: np.ndarray = n, row: np.ndarray = row) -> np.ndarray:
                x = np.sort(x, axis=1)  # NaN at the end
                return (x[row, (n - 1) // 2] + x[row, n // 2]) / 2

            med = median(got)
            keep = there.any(1)
            yield pa.RecordBatch.from_arrays([pa.array(a[s][keep]), pa.array(q[s][keep]), pa.array(n), pa.array(np.nansum(got, axis=1) / n), pa.array(med), pa.array(median(np.abs(got - med[:, None])))], schema=near)

    j = r.mapInArrow(run, _NEAR)
    return j.select("amp_id", "q_id", "n", F.round(F.log10("mean"), 6).alias("log_mean"), F.round(F.log10("med"), 6).alias("log_median"), F.round(F.try_divide("mad", "med"), 6).alias("rel_mad"))


def moment_magnitude(reference: Column, observed: Column, modelled: Column) -> Column:
    return reference + F.log10(observed / modelled)


def scalar_moment(m: Column) -> Column:
    return F.pow(F.lit(10.0), 1.5 * (m + 10.7)) * 1e-7


def between_depths(depth: Column, d1: Column, v1: Column, d2: Column, v2: Column) -> Column:
    """Linear between two depths; null outside them."""
    w = F.when(d1 == d2, F.lit(0.0)).otherwise((depth - d1) / (d2 - d1))
    return F.when(w.between(0.0, 1.0), v1 + (v2 - v1) * w)


def brune(frequency: Column, duration: Column) -> Column:
    return 1 / (1 + F.pow(frequency * duration, 2.0))


def peak_and_noise(samples: Column, arrival: Column, kind: str = "peak-to-peak") -> tuple[Column, Column, Column]:
    """(peak, noise, snr) of an array split at a sample; snr is infinite over silent noise and 0 for a silent signal."""
    noise, signal = F.slice(samples, 1, arrival), F.slice(samples, arrival + 1, F.size(samples))
    if kind == "peak-to-peak":
        size = lambda a: (F.array_max(a) - F.array_min(a)) / 2
    else:
        size = lambda a: F.array_max(F.transform(a, F.abs))
    p, n = size(signal), size(noise)
    return p, n, F.when(p == 0, F.lit(0.0)).when(n == 0, F.lit(math.inf)).otherwise(p / n)
