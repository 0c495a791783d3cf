"""Trace segments: cleaning, batches with padding, gap merging, channel choice, clipping.

segments: (network, station, location, channel, tmin_us, rate_hz, samples). Time
is integer microseconds. "First" is by tmin_us, then by a row id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stackwave.operators import ordered
from stackwave.operators.catalog import first_by
from stackwave.plans.dist import arrow_schema, grouped_map


def finite(samples: str) -> Column:
    """Not empty and without null, NaN and infinite samples."""
    bad = F.exists(samples, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return (F.size(samples) > 0) & ~bad


def clean(segments: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return first_by(segments.where(finite("samples")), key, order)


def batch_windows(rows: DataFrame, start: str, end: str, length_us: int, pad_us: int, origin_us: int = 0) -> DataFrame:
    """Each row once for every batch whose padded window [k*length - pad, (k+1)*length + pad) it overlaps: adds batch_id and in_core."""
    lo = F.floor((F.col(start) - origin_us - pad_us) / length_us)
    hi = F.floor((F.col(end) - origin_us + pad_us) / length_us)
    x = rows.withColumn("batch_id", F.explode(F.sequence(lo, hi)))
    at = F.col("batch_id") * length_us + origin_us
    x = x.where((F.col(start) < at + length_us + pad_us) & (F.col(end) >= at - pad_us))
    return x.withColumn("in_core", (F.col(start) >= at) & (F.col(start) < at + length_us))


def healthy_batches(rows: DataFrame, station: str, least: int) -> DataFrame:
    """Rows of the batches with at least `least` different stations."""
    ok = rows.groupBy("batch_id").agg(F.count_distinct(station).alias("n")).where(F.col("n") >= least)
    return rows.join(ok.select("batch_id"), "batch_id", "left_semi")


def session_ids(rows: DataFrame, key: list[str], start: str, end: str, gap_us: int, tie: str) -> DataFrame:
    """Adds session: the number (from 1) of the run of rows of a key without a gap of more than gap_us."""
    order = [start, end, tie]
    x = ordered.running(ordered.cells(rows, key, order), key, order, "_reach", F.col(end), "max", before=True)
    new = F.when(F.col("_reach").isNull() | (F.col(start) - F.col("_reach") > gap_us), 1).otherwise(0).cast("long")
    return ordered.running(x, key, order, "session", new, "sum").drop("_reach", ordered.CELL)


_SEGMENTS = "nslc string, rate_hz double, tmin_us long, samples array<double>"


def last_sample(start: str = "tmin_us", samples: str = "samples") -> Column:
    """Time of the last sample in microseconds."""
    return (F.col(start) + F.round((F.size(samples) - 1) * 1e6 / F.col("rate_hz"))).cast("long")


def chop(rows: DataFrame, start: Column | str, end: Column | str) -> DataFrame:
    """Samples at times in [start, end) only; traces without any are dropped."""
    at = lambda c: F.ceil(((F.col(c) if isinstance(c, str) else c) - F.col("tmin_us")) * F.col("rate_hz") / 1e6 - 1e-6)
    lo, hi = F.greatest(F.lit(0), at(start)), F.least(F.size("samples"), at(end))
    x = rows.withColumn("_lo", lo.cast("int")).withColumn("_hi", hi.cast("int")).where("_hi > _lo")
    x = x.withColumn("samples", F.slice("samples", F.col("_lo") + 1, F.col("_hi") - F.col("_lo"))).withColumn("tmin_us", (F.col("tmin_us") + F.round(F.col("_lo") * 1e6 / F.col("rate_hz"))).cast("long"))
    return x.drop("_lo", "_hi")


def extend(rows: DataFrame, start: Column, end: Column, fill: float = 0.0) -> DataFrame:
    """Whole samples of a fill value before and after, so that traces reach from start up to end (exclusive); longer ones stay."""
    before = F.greatest(F.lit(0), F.floor((F.col("tmin_us") - start) * F.col("rate_hz") / 1e6 + 1e-6)).cast("int")
    after = F.greatest(F.lit(0), F.ceil((end - last_sample()) * F.col("rate_hz") / 1e6 - 1e-6).cast("int") - 1)
    pad = lambda n: F.array_repeat(F.lit(float(fill)), n)
    x = rows.withColumn("_b", before).withColumn("_a", after)
    x = x.withColumn("samples", F.concat(pad(F.col("_b")), F.col("samples").cast("array<double>"), pad(F.col("_a"))))
    return x.withColumn("tmin_us", (F.col("tmin_us") - F.round(F.col("_b") * 1e6 / F.col("rate_hz"))).cast("long")).drop("_a", "_b")


def padding_us(least_travel_s: float, most_travel_s: float, image_blinding_s: float = 0.0, detection_blinding_s: float = 0.0) -> int:
    """Padding of a batch: the span of travel times and both blindings."""
    return round((most_travel_s - least_travel_s + image_blinding_s + detection_blinding_s) * 1e6)


def trace_batches(segments: DataFrame, length_us: int, pad_us: int, origin_us: int = 0) -> DataFrame:
    """segments(..., rate_hz, tmin_us, samples) cut to each batch's window with padding: adds batch_id."""
    x = batch_windows(segments.withColumn("_e", last_sample()), "tmin_us", "_e", length_us, pad_us, origin_us).drop("_e", "in_core")
    at = F.col("batch_id") * length_us + origin_us
    return chop(x, at - pad_us, at + length_us + pad_us)


def long_enough(batches: DataFrame, least_us: int) -> DataFrame:
    """Rows of the batches whose traces span at least least_us from first to last sample."""
    span = batches.groupBy("batch_id").agg((F.max(last_sample()) - F.min("tmin_us")).alias("n")).where(F.col("n") >= least_us)
    return batches.join(span.select("batch_id"), "batch_id", "left_semi")


def batch_sizes(batches: DataFrame) -> DataFrame:
    """(batch_id, n_traces, n_bytes, cumulative_s): size at 8 bytes a sample, and the summed duration of the traces."""
    n = F.size("samples")
    return batches.groupBy("batch_id").agg(F.count("*").alias("n_traces"), (F.sum(n.cast("long")) * 8).alias("n_bytes"), F.round(F.sum(n / F.col("rate_hz")), 6).alias("cumulative_s"))


def blinded(image: DataFrame, blinding_s: float) -> DataFrame:
    """Image traces with the blinding at both ends set to zero."""
    k = F.floor(F.col("rate_hz") * blinding_s)
    n = F.size("samples")
    return image.withColumn("samples", F.transform("samples", lambda x, i: F.when((i >= k) & (i < n - k), x.cast("double")).otherwise(0.0)))


def merge_gaps(segments: DataFrame, max_gap_samples: int = 0, overlap: str = "first", longest_us: int = 10 * 86_400_000_000) -> DataFrame:
    """Merge segments(nslc, rate_hz, tmin_us, samples) of a code and rate that touch or overlap, over midnight too.

    Gaps of up to max_gap_samples are filled on a line; of overlapping samples
    the first or last segment's count. Runs of touching segments longer than
    longest_us are cut at multiples of it, so that no task holds a code whole;
    the pieces touch, only a gap that lies across such a cut stays unfilled.
    """
    key = ["nslc", "rate_hz"]
    s = segments.select("nslc", F.col("rate_hz").cast("double").alias("rate_hz"), F.col("tmin_us").cast("long").alias("tmin_us"), F.col("samples").cast("array<double>").alias("samples")).where(finite("samples"))
    meta = s.groupBy(*key, "tmin_us").agg(F.max(last_sample()).alias("_e"))
    x = ordered.running(ordered.cells(meta, key, ["tmin_us"]), key, ["tmin_us"], "_reach", F.col("_e"), "max", before=True)
    apart = F.round((F.col("tmin_us") - F.col("_reach")) * F.col("rate_hz") / 1e6) - 1 > max_gap_samples
    x = ordered.running(x, key, ["tmin_us"], "_run", F.when(F.col("_reach").isNull() | apart, 1).otherwise(0).cast("long"), "sum")
    runs = x.groupBy(*key, "_run").agg((F.max("_e") - F.min("tmin_us") > longest_us).alias("_long"))
    x = x.join(runs, [*key, "_run"]).select(*key, "tmin_us", "_run", "_long")
    s = s.join(x, [*key, "tmin_us"])
    cell = F.when(F.col("_long"), F.sequence(F.floor(F.col("tmin_us") / longest_us), F.floor(last_sample() / longest_us))).otherwise(F.array(F.lit(0).cast("long")))
    s = s.withColumn("_cell", F.explode(cell))
    whole, cut = s.where("not _long"), s.where("_long")
    s = whole.unionByName(chop(cut, F.col("_cell") * longest_us, (F.col("_cell") + 1) * longest_us)).drop("_long")
    schema = arrow_schema(_SEGMENTS)

    def run(key: tuple, t: pa.Table) -> Iterator[pa.Table]:
        code, rate, *_ = key
        out: list[tuple[int, np.ndarray]] = []
        for t0, x in zip(t["tmin_us"].to_pylist(), (np.array(v) for v in t["samples"].to_pylist())):
            if out:
                at = round((t0 - out[-1][0]) * rate / 1e6)
                have = len(out[-1][1])
                if at - have <= max_gap_samples:
                    y = out[-1][1]
                    if at > have:
                        y = np.r_[y, np.interp(np.arange(have, at), [have - 1, at], [y[-1], x[0]])]
                    if at + len(x) > len(y) or overlap == "last":
                        full = np.empty(max(len(y), at + len(x)))
                        full[: len(y)] = y
                        lo = at if overlap == "last" else min(len(y), at + len(x))
                        full[lo : at + len(x)] = x[lo - at :]
                        y = full
                    out[-1] = (out[-1][0], y)
                    continue
            out.append((t0, x))
        yield pa.Table.from_arrays([pa.array([code] * len(out)), pa.array([rate] * len(out)), pa.array([a for a, _ in out], pa.int64()), pa.array([b.tolist() for _, b in out], pa.list_(pa.float64()))], schema=schema)

    return grouped_map(s, ["nslc", "rate_hz", "_run", "_cell"], run, _SEGMENTS, order=["tmin_us", "samples"])


def select_channels(rows: DataFrame, priorities: list[str], key: list[str], exclude_bands: str = "LVURPTQ") -> DataFrame:
    """One channel per key and orientation: the first priority that its first two letters match; excluded bands never."""
    rank = F.lit(None).cast("int")
    for i, p in reversed(list(enumerate(priorities))):
        rank = F.when(F.startswith(F.col("channel"), F.lit(p[:2])), F.lit(i)).otherwise(rank)
    x = rows.where(~F.substring("channel", 1, 1).isin(*exclude_bands)).withColumn("_r", rank).where("_r is not null").withColumn("orientation", F.right("channel", F.lit(1)))
    return first_by(x, [*key, "orientation"], ["_r", "channel"]).drop("_r")


def combine_channels(traces: DataFrame, key: list[str], orientations: str, n: int, how: str = "abs") -> DataFrame:
    """Traces of exactly n chosen orientations of equal rate: their Euclidean norm ("abs") or mean ("avg").

    Starts and ends may differ by one sample; what only some have is trimmed.
    A key holds the traces of one station in one batch.
    """
    x = traces.where(F.right("channel", F.lit(1)).isin(*orientations))
    w = W.partitionBy(*key, "rate_hz").orderBy("tmin_us", "channel")
    new = F.coalesce((F.col("tmin_us") - F.lag("tmin_us").over(w)) * F.col("rate_hz") > 1.5e6, F.lit(True)).cast("int")
    x = x.withColumn("_new", new).withColumn("_g", F.sum("_new").over(w))
    g = x.groupBy(*key, "rate_hz", "_g").agg(F.array_sort(F.collect_list(F.struct("channel", "tmin_us", "samples"))).alias("t"), F.max("tmin_us").alias("tmin_us"), F.count_distinct("channel").alias("_n")).where((F.size("t") == n) & (F.col("_n") == n))
    skip = lambda c: F.round((F.col("tmin_us") - c["tmin_us"]) * F.col("rate_hz") / 1e6).cast("int")
    sizes = F.transform("t", lambda c: F.size(c["samples"]) - skip(c))
    size = F.array_min(sizes)
    g = g.where((size > 0) & (F.array_max(sizes) - size <= 1) & (F.array_max(F.transform("t", skip)) <= 1))
    at = lambda c, i: F.get(c["samples"], i + skip(c)).cast("double")
    idx = F.sequence(F.lit(0), size - 1)
    if how == "abs":
        value = F.transform(idx, lambda i: F.sqrt(F.aggregate("t", F.lit(0.0), lambda a, c: a + at(c, i) * at(c, i))))
    else:
        value = F.transform(idx, lambda i: F.aggregate("t", F.lit(0.0), lambda a, c: a + at(c, i)) / n)
    return g.select(*key, "tmin_us", "rate_hz", value.alias("samples"))


def clipped(traces: DataFrame, key: list[str], bits: tuple[int, ...] = (24, 32), margin: int = 20) -> DataFrame:
    """Without all orientations of a channel's band of which one trace peaks within margin counts of full scale."""
    top = F.array_max(F.transform("samples", lambda x: F.abs(x.cast("double"))))
    hit = F.lit(False)
    for b in bits:
        hit = hit | (F.abs(top - float(2 ** (b - 1) - 1)) <= margin)
    w = W.partitionBy(*key, F.substring("channel", 1, 2))
    return traces.withColumn("_c", F.bool_or(hit).over(w)).where(~F.coalesce("_c", F.lit(False))).drop("_c")


def stations_by_dates(stations: DataFrame, first: str, last: str) -> DataFrame:
    """Each station on each day, first and last included."""
    return stations.withColumn("day", F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))))


def complete(rows: DataFrame, start: str, end: str, want_start: int, want_end: int, rate: Column) -> DataFrame:
    """Rows whose ends miss the request by half a sample at most."""
    half = 0.5e6 / rate
    return rows.where((F.abs(F.col(start) - want_start) <= half) & (F.abs(F.col(end) - want_end) <= half))


def rolling_count(rows: DataFrame, key: list[str], time_us: str, window_us: int, tie: str) -> DataFrame:
    """Adds n: rows of the key in the last window_us up to each row's time; tie is unique."""
    return ordered.counted_within(rows, key, time_us, tie, window_us)


def rising_edges(rows: DataFrame, key: list[str], time_us: str, window_us: int, threshold: int, tie: str) -> DataFrame:
    """Rows at which the rolling count reaches the threshold after being below."""
    x = ordered.previous(rolling_count(rows, key, time_us, window_us, tie), key, [time_us, tie], "_b", F.col("n"))
    return x.where((F.col("n") >= threshold) & (F.coalesce("_b", F.lit(0)) < threshold)).drop("_b")
