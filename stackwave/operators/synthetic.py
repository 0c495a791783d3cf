"""Planted events: origins, arrivals and image traces with known answers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwave.functions import signal
from stackwave.operators.octree import Bounds


def events(spark: SparkSession, n: int, b: Bounds, margin: float, start_us: int, every_us: int, seed: int) -> DataFrame:
    """n origins at fixed time steps, uniform inside the bounds less a margin, repeatable by seed."""
    u = lambda k, lo, hi: lo + margin + (hi - lo - 2 * margin) * (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 30)) / float(1 << 30))
    return spark.range(n).select(
        F.col("id").alias("event_id"), (F.lit(start_us) + F.col("id") * every_us).alias("time_us"), u("e", *b.east).alias("east"), u("n", *b.north).alias("north"), u("d", *b.depth).alias("depth")
    )


def arrivals(ev: DataFrame, stations: DataFrame, velocities: dict[str, float]) -> DataFrame:
    """(event_id, sta_idx, phase, time_us) at constant velocities; stations(sta_idx, east, north, elevation) is an inventory of up to thousands of rows."""
    s = stations.select("sta_idx", F.col("east").alias("_e"), F.col("north").alias("_n"), F.col("elevation").alias("_h"))
    j = ev.crossJoin(s)  # every event reaches every station
    d = F.sqrt(F.pow(F.col("east") - F.col("_e"), 2.0) + F.pow(F.col("north") - F.col("_n"), 2.0) + F.pow(F.col("depth") + F.col("_h"), 2.0))
    ph = F.explode(F.array(*[F.struct(F.lit(p).alias("phase"), F.lit(v).alias("v")) for p, v in velocities.items()])).alias("x")
    return j.select("event_id", "sta_idx", "time_us", d.alias("d"), ph).select("event_id", "sta_idx", F.col("x.phase").alias("phase"), (F.col("time_us") + F.round(F.col("d") / F.col("x.v") * 1e6)).cast("long").alias("time_us"))


def images(arr: DataFrame, start_us: int, length_us: int, rate: float, width_s: float) -> DataFrame:
    """(batch_id, sta_idx, phase, tmin_us, rate_hz, samples): Gaussian pulses of all arrivals near each batch, as a closed form."""
    reach = int(5 * width_s * 1e6)
    lo, hi = F.floor((F.col("time_us") - reach - start_us) / length_us), F.floor((F.col("time_us") + reach - start_us) / length_us)
    a = arr.withColumn("batch_id", F.explode(F.sequence(lo, hi))).where("batch_id >= 0")
    g = a.groupBy("batch_id", "sta_idx", "phase").agg(F.sort_array(F.collect_list(((F.col("time_us") - start_us) / 1e6 - F.col("batch_id") * (length_us / 1e6)).cast("double"))).alias("t"))
    n = int(length_us / 1e6 * rate)
    k = F.sequence(F.lit(0), F.lit(n - 1))
    s = F.transform(k, lambda i: F.aggregate("t", F.lit(0.0), lambda acc, t: acc + F.exp(-F.pow(i / rate - t, 2.0) / (2 * width_s**2))))
    return g.select("batch_id", "sta_idx", "phase", (F.lit(start_us) + F.col("batch_id") * length_us).alias("tmin_us"), F.lit(float(rate)).alias("rate_hz"), s.alias("samples"))


def perturb(model: list[tuple], factors: list[float]) -> list[tuple]:
    """Scale each layer's velocities by a factor, so vp / vs stays."""
    return [(t, b, vp * f, vs * f, gp * f, gs * f) for (t, b, vp, vs, gp, gs), f in zip(model, factors)]


def spans(arr: DataFrame) -> DataFrame:
    """(first_arrival_us, start_us, end_us): the least arrival, and the span of all."""
    return arr.agg(F.min("time_us").alias("first_arrival_us"), F.min("time_us").alias("start_us"), F.max("time_us").alias("end_us"))


def concatenated(pieces: DataFrame, order: list[str], taper: float = 0.2) -> DataFrame:
    """(nslc, samples): selected pieces of each trace joined in order, detrended and tapered into each other. A selection is a few events."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pd.DataFrame({"nslc": [pdf.nslc.iloc[0]], "samples": [signal.overlap_concat([np.asarray(x, float) for x in pdf.samples], taper).tolist()]})

    return pieces.groupBy("nslc").applyInPandas(run, "nslc string, samples array<double>")
