"""Local magnitudes from traces: response, instrument, filter, peak and noise, station magnitudes with flags.

traces: (event_uid, nsl, channel, rate_hz, tmin_us, samples), each around one
event's arrivals with `taper_s` more on both sides; responses: (nsl, channel,
start_us, end_us, poles, zeros, constant) to displacement in metres, complex
numbers as flat arrays of real and imaginary parts; arrivals: (event_uid, nsl,
p_us, distance_hypo, distance_epi) in metres.

Defined cases: a trace without a response, a receiver without arrivals, without
the model's components, outside its distances or with a magnitude that isn't
finite has no station magnitude; a low ratio to noise is flagged, not dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stackwave.functions import attenuation, signal
from stackwave.plans.dist import arrow_schema

# The orientations and the number of traces of each component.
COMPONENTS = {
    "vertical": ("Z0", 1, None), "north-east-separate": ("NE", 2, None), "horizontal-separate": ("EN123RT", 2, None), "horizontal-avg": ("EN123RT", 2, "avg"),
    "horizontal-abs": ("EN123RT", 2, "abs"), "all-abs": ("ENZ0123RT", 3, "abs"), "all": ("ENZ0123RT", 3, None),
}
_SHAPED = "event_uid string, nsl string, channel string, rate_hz double, tmin_us long, samples array<double>"


def with_responses(traces: DataFrame, responses: DataFrame) -> DataFrame:
    """Each trace with the response of its code that holds at its start, the latest of several; traces without one go."""
    r = responses.select("nsl", "channel", "start_us", F.coalesce("end_us", F.lit((1 << 63) - 1)).alias("end_us"), "poles", "zeros", "constant")
    j = traces.join(r, ["nsl", "channel"]).where("tmin_us >= start_us and tmin_us < end_us")
    w = W.partitionBy("event_uid", "nsl", "channel", "tmin_us").orderBy(F.desc("start_us"))
    return j.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "start_us", "end_us")


def shaped(traces: DataFrame, model: attenuation.Model, taper_s: float = 10.0) -> DataFrame:
    """Traces with responses as the model's instrument would have written them, tapers cut off and demeaned."""
    schema = arrow_schema(_SHAPED)
    instrument = signal.INSTRUMENTS.get(model.instrument or "")
    highpass = model.highpass_hz

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, starts = [], []
            cols = [b.column(c).to_pylist() for c in ("rate_hz", "tmin_us", "samples", "poles", "zeros", "constant")]
            for rate, t, x, poles, zeros, constant in zip(*cols):
                cplx = lambda v: np.array(v[::2]) + 1j * np.array(v[1::2])
                n, k = len(x), round(taper_s * rate)
                then = signal.pole_zero(*instrument) if instrument else lambda f: 2j * np.pi * f
                y = signal.restitute(np.array(x, float), rate, signal.pole_zero(cplx(poles), cplx(zeros), constant), taper=min(1.0, 2 * k / max(n, 1)), low=0.1, then=then)
                if highpass and highpass < rate / 2:
                    y = signal.zero_phase(signal.butterworth(4, (highpass,), "high", rate), y)
                y = y[k : n - k] if n > 2 * k else y[:0]
                out.append((y - y.mean()).tolist() if len(y) else [])
                starts.append(t + round(k / rate * 1e6))
            head = [b.column(c) for c in ("event_uid", "nsl", "channel", "rate_hz")]
            yield pa.RecordBatch.from_arrays([*head, pa.array(starts, pa.int64()), pa.array(out, pa.list_(pa.float64()))], schema=schema)

    x = traces.select("event_uid", "nsl", "channel", F.col("rate_hz").cast("double"), F.col("tmin_us").cast("long"), F.col("samples").cast("array<double>"), "poles", "zeros", F.col("constant").cast("double"))
    return x.mapInArrow(run, _SHAPED).where(F.size("samples") > 0)


def station_magnitudes(traces: DataFrame, responses: DataFrame, arrivals: DataFrame, model: attenuation.Model, taper_s: float = 10.0, least_snr: float = 3.0, margin_s: float = 0.5) -> DataFrame:
    """(event_uid, nsl, magnitude, error, peak_amp, noise, snr, distance_epi, distance_hypo, flag)."""
    letters, n, how = COMPONENTS[model.component]
    x = shaped(with_responses(traces, responses), model, taper_s).where(F.right("channel", F.lit(1)).isin(*letters))
    # noise ends, and the signal begins, margin_s before the first arrival
    x = x.join(arrivals, ["event_uid", "nsl"])
    at = F.least(F.greatest(F.floor((F.col("p_us") - margin_s * 1e6 - F.col("tmin_us")) * F.col("rate_hz") / 1e6), F.lit(0)), F.size("samples")).cast("int")
    g = x.groupBy("event_uid", "nsl").agg(
        F.sort_array(F.collect_list(F.struct("channel", "samples"))).alias("t"), F.first("distance_hypo").alias("distance_hypo"), F.first("distance_epi").alias("distance_epi"), F.min(at).alias("at")
    ).where(F.size("t") == n)
    rows = F.transform("t", lambda c: c["samples"])
    if how is not None:
        size = F.array_min(F.transform("t", lambda c: F.size(c["samples"])))
        one = lambda i: F.transform("t", lambda c: F.get(c["samples"], i))
        total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, v: s + f(v))
        joint = (lambda i: F.sqrt(total(one(i), lambda v: v * v))) if how == "abs" else (lambda i: total(one(i), lambda v: v) / n)
        rows = F.array(F.transform(F.sequence(F.lit(0), size - 1), joint))
    span = (lambda a: (F.array_max(a) - F.array_min(a)) / 2) if model.peak == "peak-to-peak" else (lambda a: F.array_max(F.transform(a, F.abs)))
    g = g.withColumn("rows", rows)
    peak = F.array_max(F.transform("rows", lambda a: span(F.slice(a, F.col("at") + 1, F.size(a)))))
    noise = F.array_max(F.transform("rows", lambda a: span(F.slice(a, F.lit(1), F.col("at")))))
    g = g.withColumn("peak_amp", peak).withColumn("noise", F.coalesce(noise, F.lit(0.0)))
    mag = lambda a: attenuation.magnitude_of(model, a, F.col("distance_hypo"), F.col("distance_epi"))
    up, mid, low = mag(F.col("peak_amp") + F.col("noise")), mag(F.col("peak_amp")), mag(F.col("peak_amp") - F.col("noise"))
    error = (F.abs(up - mid) + F.coalesce(F.abs(mid - low), F.abs(up - mid))) / 2
    snr = F.when(F.col("peak_amp") == 0, F.lit(0.0)).when(F.col("noise") == 0, F.lit(float("inf"))).otherwise(F.col("peak_amp") / F.col("noise"))
    out = g.select("event_uid", "nsl", mid.alias("magnitude"), error.alias("error"), "peak_amp", "noise", snr.alias("snr"), "distance_epi", "distance_hypo")
    return out.where("magnitude is not null and not isnan(magnitude)").withColumn("flag", F.when(F.col("snr") < least_snr, "low_snr").otherwise("valid"))
