"""Histograms, rates, b-values, residuals, Wadati and coverage over catalogues.

Every statistic skips null and NaN. Ties are broken as each function says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stackwave.operators import ordered
from stackwave.operators.catalog import number_rows
from stackwave.plans.dist import micros

DAY = 86_400.0
# Longest duration in days of each bin width in seconds.
RATE_BINS = ((1 / 24, 60), (0.25, 600), (2, 3600), (14, 21_600), (60, 43_200))


def real(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c.cast("double")), c.cast("double"))


def rate_bin(duration_days: float) -> int:
    return next((s for d, s in RATE_BINS if duration_days <= d), 86_400)


def event_rate(events: DataFrame, time: str, seconds: int) -> DataFrame:
    """(bin_start_us, n, cumulative): aligned bins from the first to the last event, empty ones too."""
    width = seconds * 1_000_000
    n = events.where(F.col(time).isNotNull()).groupBy((F.floor(micros(time) / width) * width).alias("bin_start_us")).agg(F.count("*").alias("n"))
    ends = n.agg(F.min("bin_start_us").alias("a"), F.max("bin_start_us").alias("b"))
    all_ = ends.where("a is not null").select(F.explode(F.sequence("a", "b", F.lit(width))).alias("bin_start_us"))
    full = all_.join(n, "bin_start_us", "left").fillna(0, ["n"])
    # one row a bin, so the running total over all bins is small
    return full.withColumn("cumulative", F.sum("n").over(W.partitionBy(F.lit(1)).orderBy("bin_start_us").rowsBetween(W.unboundedPreceding, W.currentRow)))


def equal_bins(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, lower, n): equal bins from least to greatest, the last one closed, empty ones too."""
    v = df.select(real(value).alias("v")).where("v is not null")
    lim = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = F.when(F.col("hi") == F.col("lo"), F.lit(bins // 2)).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)))
    n = v.crossJoin(F.broadcast(lim)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))  # one row
    all_ = lim.where("lo is not null").select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", "hi")
    return all_.join(n, "bin", "left").fillna(0, ["n"]).select("bin", F.round(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("bin") / bins, 9).alias("lower"), "n")


def counts_from_zero(df: DataFrame, count: str) -> DataFrame:
    """(value, n) for 0..greatest, values that do not occur too."""
    n = df.where(F.col(count).isNotNull()).groupBy(F.col(count).cast("long").alias("value")).agg(F.count("*").alias("n"))
    return n.agg(F.max("value").alias("m")).where("m is not null").select(F.explode(F.sequence(F.lit(0).cast("long"), "m")).alias("value")).join(n, "value", "left").fillna(0, ["n"])


def magnitude_bins(df: DataFrame, value: str, width: float = 0.1) -> DataFrame:
    """(bin, n) counted from the least magnitude in steps of width, by rounding to whole steps."""
    v = df.select(real(value).alias("v")).where("v is not null")
    lim = v.agg(F.min("v").alias("lo"))
    return v.crossJoin(F.broadcast(lim)).groupBy(F.floor((F.col("v") - F.col("lo")) / width + 1e-9).cast("long").alias("bin")).agg(F.count("*").alias("n"), F.round(F.min("lo"), 9).alias("lo"))  # one row


def maximum_curvature(df: DataFrame, value: str, width: float = 0.1) -> DataFrame:
    """One row: mc, the left edge of the fullest bin (the first of equals), and its count."""
    best = magnitude_bins(df, value, width).agg(F.max(F.struct("n", (-F.col("bin")).alias("b"), "lo")).alias("x"))
    return best.select(F.round(F.col("x.lo") - F.col("x.b") * width, 6).alias("mc"), F.col("x.n").alias("n"))


def differences(df: DataFrame, value: str, order: list[str], by: list[str] = [], bounded: bool = False) -> DataFrame:  # noqa: B006
    """Adds diff: to the value before in the order (within by); bounded where by's groups are known to be small."""
    if bounded:
        return df.withColumn("diff", F.col(value) - F.lag(value).over(W.partitionBy(*by).orderBy(*order)))
    return ordered.previous(df, by, order, "_p", F.col(value)).withColumn("diff", F.col(value) - F.col("_p")).drop("_p")


def b_positive(diffs: DataFrame, by: list[str] = [], dmc: float = 0.5, least_values: int = 0, least_diffs: int = 1) -> DataFrame:  # noqa: B006
    """b, its error and the number of differences at or above dmc; null below the least numbers."""
    ok = F.when(F.col("diff") >= dmc, F.col("diff") - dmc)
    agg = diffs.groupBy(*by).agg(F.count("*").alias("n_values"), F.count(ok).alias("n"), F.avg(ok).alias("m"))
    b = F.when((F.col("n") >= least_diffs) & (F.col("n_values") >= least_values) & (F.col("m") > 0), 1 / (F.log(F.lit(10.0)) * F.col("m")))
    return agg.select(*by, "n_values", "n", F.round(b, 6).alias("b"), F.round(b / F.sqrt(F.col("n").cast("double")), 6).alias("error"))


def sliding_windows(df: DataFrame, order: list[str], size: int = 500, step: int = 10) -> DataFrame:
    """Each row once for every count window (window = its first row number, from 1) that holds it."""
    n = number_rows(df, order, "r")
    last = df.agg((F.count("*") - size + 1).alias("_last"))
    lo = F.greatest(F.lit(0), F.ceil((F.col("r") - size) / step))
    hi = F.floor((F.least(F.col("r"), F.col("_last")) - 1) / step)
    x = n.crossJoin(F.broadcast(last)).where(lo <= hi)  # one row
    return x.withColumn("_w", F.explode(F.sequence(lo.cast("long"), hi.cast("long")))).withColumn("window", F.col("_w") * step + 1).drop("_last", "_w")


def running_sum(df: DataFrame, value: Column, order: list[str], name: str) -> DataFrame:
    """Running total over the whole order; nulls add nothing."""
    x = ordered.running(ordered.cells(df, [], order), [], order, name, value.cast("double"), "sum").drop(ordered.CELL)
    return x.withColumn(name, F.coalesce(name, F.lit(0.0)))


def mad(df: DataFrame, value: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by..., med, mad): median and median absolute deviation, exact at any size of a group."""
    v = df.select(*by, real(value).alias("v")).where("v is not null")
    med = ordered.median(v, by, "v", "med")
    j = v.join(med, by) if by else v.crossJoin(F.broadcast(med))  # one row
    off = ordered.median(j.withColumn("v", F.abs(F.col("v") - F.col("med"))), [*by, "med"], "v", "mad")
    return off.select(*by, F.round("med", 9).alias("med"), F.round("mad", 9).alias("mad"))


def weighted_median(df: DataFrame, value: str, weight: str, by: list[str], tie: list[str]) -> DataFrame:
    """(by..., wmedian): a weight above half wins; else the least value whose cumulative weight passes half, on exactly half the mean with the next."""
    v = df.where(F.col(value).isNotNull() & (F.col(weight) > 0))
    w = W.partitionBy(*by).orderBy(value, *tie)
    x = v.withColumn("_c", F.sum(weight).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("_t", F.sum(weight).over(W.partitionBy(*by))).withColumn("_next", F.lead(value).over(w))
    half = F.col("_t") / 2
    pick = F.when(F.col("_c") == half, (F.col(value) + F.col("_next")) / 2).otherwise(F.col(value))
    return x.where(F.col("_c") >= half).groupBy(*by).agg(F.min(F.struct(F.col("_c"), pick.alias("p"))).alias("m")).select(*by, F.round("m.p", 6).alias("wmedian"))


def clipped_residuals(df: DataFrame, value: str, by: list[str], group: str, lo: float = 0.02, hi: float = 0.98) -> DataFrame:
    """Rows within the [lo, hi] percentiles of their group over all sources."""
    v = df.withColumn("_v", real(value)).where("_v is not null")
    lim = ordered.quantiles(v, [group], "_v", {"_lo": lo, "_hi": hi}).drop("n").withColumnRenamed(group, "_g")
    return v.join(lim, F.col(group) == F.col("_g")).where("_v between _lo and _hi").drop("_g", "_lo", "_hi", "_v")


def event_magnitudes(stations: DataFrame) -> DataFrame:
    """(event_uid, nsl, magnitude, snr_share, mean, med): snr_share is where log snr lies between the event's least and greatest."""
    w = W.partitionBy("event_uid")
    log = F.when(F.col("snr") > 0, F.log("snr"))
    x = stations.withColumn("_l", log).withColumn("_lo", F.min("_l").over(w)).withColumn("_hi", F.max("_l").over(w))
    share = F.when(F.col("_hi") > F.col("_lo"), (F.col("_l") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return x.select("event_uid", "nsl", "magnitude", F.round(share, 6).alias("snr_share"), F.round(F.avg("magnitude").over(w), 6).alias("mean"), F.round(F.median("magnitude").over(w), 6).alias("med"))


def confidence_over_time(picks: DataFrame, events: DataFrame) -> DataFrame:
    """(nsl, phase, month, n, confidence): median confidence of a station's observed picks of each phase and month of their events."""
    p = picks.where("observed_time is not null and confidence is not null and not isnan(confidence)").join(events.select("event_uid", "event_time"), "event_uid")
    p = p.withColumn("month", F.date_format("event_time", "yyyy-MM"))
    return ordered.quantiles(p, ["nsl", "phase", "month"], "confidence", {"confidence": 0.5}).select("nsl", "phase", "month", "n", F.round("confidence", 6).alias("confidence"))


def model_wadati(picks: DataFrame, events: DataFrame) -> DataFrame:
    """(event_uid, ratio): the median over receivers of modelled S over P travel time."""
    kind = F.right("phase", F.lit(1))
    t = micros("model_time") - micros("event_time")
    g = picks.join(events.select("event_uid", "event_time"), "event_uid").groupBy("event_uid", "network", "station", "location").agg(F.min(F.when(kind == "P", t)).alias("p"), F.min(F.when(kind == "S", t)).alias("s"))
    return g.where("p > 0 and s is not null").groupBy("event_uid").agg(F.round(F.median(F.col("s") / F.col("p")), 6).alias("ratio"))


def by_label(events: DataFrame, label: str, value: str) -> DataFrame:
    """(label, n, least, med, most, all_least, all_most) of a value in each cluster, noise (-1) last by place."""
    v = events.where(F.col(value).isNotNull() & ~F.isnan(value))
    g = ordered.quantiles(v, [label], value, {"least": 0.0, "med": 0.5, "most": 1.0})
    all_ = v.agg(F.min(value).alias("all_least"), F.max(value).alias("all_most"))
    place = F.when(F.col(label) < 0, F.lit(1)).otherwise(F.lit(0))
    return g.crossJoin(F.broadcast(all_)).select(label, "n", *[F.round(c, 6).alias(c) for c in ("least", "med", "most", "all_least", "all_most")], place.alias("last"))  # one row
