"""Queries over whole pipelines: synthetic events, search, streams, exports, fits."""

from __future__ import annotations

import math
import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackwave.functions import attenuation, codes, signal
from stackwave.functions.statistics import emr_fit, gaussian_density
from stackwave.operators import analytics as an
from stackwave.operators import catalog as cat
from stackwave.operators import local_magnitude, magnitude, octree, ordered, synthetic
from stackwave.operators import search as srch
from stackwave.operators import traveltime
from stackwave.plans.catalog_queries import EV, PK, STS, ev, pks, sts
from stackwave.plans import pipeline
from stackwave.plans.dist import checkpointed, micros, scratch, table
from stackwave.sources import sinks
from stackwave.streaming import live

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


BOUNDS = octree.Bounds((-10_000.0, 10_000.0), (-10_000.0, 10_000.0), (0.0, 10_000.0))
START = 1_704_067_200_000_000
VELOCITIES = {"cake:P": 5000.0, "cake:S": 2900.0}


def network(n: int = 16) -> list[tuple[int, float, float, float]]:
    """A ring of stations around the centre and one in it."""
    return [(0, 0.0, 0.0, 0.0)] + [(i, 9_000 * math.cos(i * 2 * math.pi / (n - 1)) * (0.5 + 0.5 * (i % 2)), 9_000 * math.sin(i * 2 * math.pi / (n - 1)) * (0.5 + 0.5 * (i % 2)), 100.0 * (i % 4)) for i in range(1, n)]


def _images(spark: SparkSession, n: int) -> tuple[DataFrame, DataFrame]:
    e = synthetic.events(spark, n, BOUNDS, 2_500.0, START + 15_000_000, 30_000_000, 11)
    s = spark.createDataFrame(network(), "sta_idx long, east double, north double, elevation double")
    return e, synthetic.images(synthetic.arrivals(e, s, VELOCITIES), START, 30_000_000, 50.0, 0.1)


def settings(**more) -> srch.Settings:  # noqa: ANN003
    return srch.Settings(BOUNDS, 2_000.0, 4, VELOCITIES, threshold=0.6, blinding_s=2.0, required_stations=6, **more)


@query()
def synthetic_search(spark: SparkSession, d: str) -> DataFrame:
    """Twelve planted events through images, stacking, peaks, refinement and location."""
    return srch.search(_images(spark, 12)[1], network(), settings())


@query()
def synthetic_search_incremental(spark: SparkSession, d: str) -> DataFrame:
    return srch.search(_images(spark, 12)[1], network(), settings(incremental=True))


@query()
def velocity_model_scores(spark: SparkSession, d: str) -> DataFrame:
    """The summed semblance of three velocity models over the same images."""
    _, images = _images(spark, 6)
    out = None
    for name, f in (("slow", 0.92), ("true", 1.0), ("fast", 1.08)):
        s = settings()
        s.velocities = {p: v * f for p, v in VELOCITIES.items()}
        x = srch.search(images, network(), s).agg(F.lit(name).alias("model"), F.sum("semblance").alias("score"), F.count("*").alias("n"))
        out = x if out is None else out.unionByName(x)
    return out


@query("with e as (select unnest(generate_series(0, 11)) as event_id) select event_id::bigint as event_id, (1704067215000000 + event_id * 30000000)::bigint as time_us from e")
def synthetic_events(spark: SparkSession, d: str) -> DataFrame:
    return synthetic.events(spark, 12, BOUNDS, 2_500.0, START + 15_000_000, 30_000_000, 11).select("event_id", "time_us")


def _matched(events: DataFrame, found: DataFrame) -> DataFrame:
    """(event_id, n_found, n_false): detections at the time and place of each planted event, and those at none."""
    near = (F.abs(F.col("f.time_us") - F.col("e.time_us")) < 150_000) & (F.sqrt(sum((F.pow(F.col(f"f.{a}") - F.col(f"e.{a}"), 2.0) for a in ("east", "north", "depth")), F.lit(0.0))) < 700)
    j = checkpointed(found).alias("f").join(events.alias("e"), near, "full")
    false = j.agg(F.count_if(F.col("event_id").isNull()).alias("n_false"))
    return j.where("event_id is not null").groupBy("event_id").agg(F.count("f.time_us").alias("n_found")).crossJoin(F.broadcast(false))  # one row


@query("select mode, event_id::bigint as event_id, 1::bigint as n_found, 0::bigint as n_false from (select unnest(['exact', 'incremental']) as mode), (select unnest(generate_series(0, 11)) as event_id)")
def synthetic_found(spark: SparkSession, d: str) -> DataFrame:
    """Each planted event comes out once, at its time and place, in both modes."""
    e, images = _images(spark, 12)
    out = [_matched(e, srch.search(images, network(), settings(incremental=i))).select(F.lit(m).alias("mode"), "event_id", "n_found", "n_false") for m, i in (("exact", False), ("incremental", True))]
    return out[0].unionByName(out[1])


@query("select 'true' as model, 6::bigint as n")
def velocity_model_best(spark: SparkSession, d: str) -> DataFrame:
    """The velocity model of most semblance is the one that the images were made with."""
    return velocity_model_scores(spark, d).orderBy(F.desc_nulls_last("score")).limit(1).select("model", "n")


MIDNIGHT = START + 5 * 86_400_000_000
PLANTED = 8


def planted_archive(spark: SparkSession, root: str, rate: float = 50.0) -> DataFrame:
    """Day files of image traces of events every 30 s around a midnight, each at an edge of a batch of 30 s; gives the events."""
    start = MIDNIGHT - 120_000_000
    e = synthetic.events(spark, PLANTED, BOUNDS, 2_500.0, start, 30_000_000, 5)
    s = spark.createDataFrame(network(), "sta_idx long, east double, north double, elevation double")
    x = synthetic.images(synthetic.arrivals(e, s, VELOCITIES), start - 45_000_000, 30_000_000, rate, 0.1)
    sta = F.concat(F.lit("S"), F.lpad(F.col("sta_idx").cast("string"), 2, "0"))
    t = x.select(F.lit("SY").alias("network"), sta.alias("station"), F.lit("").alias("location"), F.concat(F.lit("IM"), F.right("phase", F.lit(1))).alias("channel"), "tmin_us", "rate_hz", "samples")
    sinks.write_traces(t, root).collect()
    return e


def archive_config(root: str) -> dict:
    return {
        "source": {"use": "archive", "path": root, "layout": "sds"}, "image": {"use": "as_is", "phases": {"P": "cake:P", "S": "cake:S"}}, "tracer": {"use": "constant", "velocities": VELOCITIES},
        "batch_s": 30, "origin_us": MIDNIGHT, "stations": [{"nsl": f"SY.S{i:02}.", "at": at} for i, *at in network()],
        "search": {"bounds": [list(BOUNDS.east), list(BOUNDS.north), list(BOUNDS.depth)], "root_size": 2_000.0, "levels": 4, "threshold": 0.6, "blinding_s": 2.0, "required_stations": 6},
    }


@query(f"select unnest(generate_series(0, {PLANTED - 1}))::bigint as event_id, 1::bigint as n_found, 0::bigint as n_false")
def archive_search(spark: SparkSession, d: str) -> DataFrame:
    """A configured run over day files: archive, merging over midnight, padded batches, images, search. Each planted event comes out once, at its time and place."""
    root = scratch(spark, "archive")
    e = planted_archive(spark, root)
    return _matched(e, pipeline.run(spark, archive_config(root)))


# -- streams -------------------------------------------------------------------------


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    at = f"{d}/{name}.parquet"
    reader = spark.readStream.schema(schema)
    return reader.parquet(at) if os.path.isdir(at) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(d)


def _collected(spark: SparkSession, out: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Run a stream over what is there into a folder beside the checkpoints; the rows of its last state."""
    root = scratch(spark, "stream")
    live.drive(out, f"{root}/state", live.idempotent_writer(f"{root}/rows"), mode)
    rows = spark.read.schema(T.StructType([*out.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{root}/rows")
    return live.last_state(rows, mode, keys)


@query("with w as (select epoch_us(ts) // 3600000000 as h, event_type, epoch_us(ts) as t, value from events) select (h * 3600000000)::bigint as start_us, event_type, count(*) as n, max(value) as most from w group by 1, 2")
def streaming_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hourly windows of a stream, in complete mode."""
    s = _stream(spark, d, "events").withColumn("start_us", F.floor(micros("ts") / 3_600_000_000) * 3_600_000_000)
    return _collected(spark, s.groupBy("start_us", "event_type").agg(F.count("*").alias("n"), F.max("value").alias("most")), "complete")


@query("with e as (select epoch_us(ts) as t, event_type from events), w as (select t // 300000000 * 300000000 as start_us, event_type, count(*) as n from e group by 1, 2) select start_us::bigint as start_us, event_type, n from w where start_us + 300000000 <= (select max(t) // 1000 * 1000 - 20000000 from e)")
def streaming_late_data(spark: SparkSession, d: str) -> DataFrame:
    """Five-minute windows behind a watermark of 20 seconds; windows not passed yet are withheld."""
    s = _stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return _collected(spark, live.windowed_counts(s, "ts", "5 minutes", "20 seconds", ["event_type"]).select(F.unix_micros("window.start").alias("start_us"), "event_type", "n"), "append")


@query("with x as (select nsl || '.' || channel as nslc, epoch_us(starttime) as s, epoch_us(endtime) as e from seedlink_stations where nsl is not null and endtime > starttime), w as (select *, max(e) over (partition by nslc order by s, e rows between unbounded preceding and 1 preceding) as r, row_number() over (partition by nslc order by s, e) as i from x), k as (select *, max(case when r is null or s - r > 1000000 then i end) over (partition by nslc) as first from w) select nslc, greatest(min(s), max(e) - 86400000000)::bigint as tmin_us, max(e)::bigint as tmax_us, count(*)::bigint as n from k where i >= first group by 1")
def streaming_buffers(spark: SparkSession, d: str) -> DataFrame:
    """The rolling buffer of each code after the stream."""
    s = _stream(spark, d, "seedlink_stations").where("nsl is not null and endtime > starttime")
    s = s.select(F.concat_ws(".", "nsl", "channel").alias("nslc"), F.col("polled_at").cast("timestamp").alias("ts"), micros("starttime").alias("tmin_us"), micros("endtime").alias("tmax_us"))
    return _collected(spark, live.rolling_buffers(s, 86_400_000_000, 1_000_000), "update", ["nslc"])


@query("with d as (select seq, epoch_us(event_time) as t from detections where semblance >= 0.5 and not isnan(semblance)), n as (select *, count(*) over (order by t, seq rows unbounded preceding) - (select count(*) from d x where x.t < d.t - 86400000000) as n from d), l as (select *, lag(n) over (order by t, seq) as b from n) select seq, t as time_us from l where n >= 5 and coalesce(b, 0) < 5 and t < (select max(t) // 1000 * 1000 from d)")
def streaming_swarm_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Alerts of keyed state over a stream: the daily count reaches five. What the watermark has not passed is withheld."""
    s = _stream(spark, d, "detections").where("semblance >= 0.5 and not isnan(semblance)").select(F.lit("all").alias("source"), "seq", micros("event_time").alias("time_us"))
    return _collected(spark, live.swarm_alerts(s, 86_400_000_000, 5), "append").select("seq", "time_us")


# -- exports --------------------------------------------------------------------------


_HEAD = "strftime(event_time, '%y%m%d %H%M %S') || '.' || lpad((epoch_us(event_time) // 10000 % 100)::varchar, 2, '0') || ' ' || printf('%8.4f', abs(lat)::varchar::decimal(18, 4)::double) || case when lat >= 0 then 'N' else 'S' end || ' ' || printf('%9.4f', abs(lon)::varchar::decimal(18, 4)::double) || case when lon >= 0 then 'E' else 'W' end || printf('%8.3f', ((depth - elevation) / 1000)::varchar::decimal(18, 3)::double)"
_PICK_LINE = "printf('  %-6s%s%d%6.2f', station, right(phase, 1), case when confidence >= 1 or confidence >= 0.8 then 0 when confidence >= 0.6 then 1 when confidence >= 0.4 then 2 when confidence >= 0 then 3 end, ((epoch_us(observed_time) - epoch_us(event_time)) / 1e6)::varchar::decimal(18, 2)::double)"


@query(f"with {EV}, p as (select * from picks where observed_time is not null and confidence > 0.2 and not isnan(confidence) and abs(epoch_us(observed_time) - epoch_us(model_time)) / 1e6 <= 5), ok as (select event_uid from p where right(phase, 1) = 'P' group by 1 having count(*) >= 2), e as (select * from ev where not isnan(lat) and not isnan(lon) and not isnan(depth - elevation) and semblance >= 0.3 and not isnan(semblance) and distance_border >= 0 and not isnan(distance_border) and event_uid in (select event_uid from ok)), l as (select event_uid, 0 as pick_id, {_HEAD} as line from e union all select p.event_uid, pick_id, {_PICK_LINE} from p join e using (event_uid)) select event_uid, (row_number() over (partition by event_uid order by pick_id) - 1)::int as line_no, line from l")
def velest_export(spark: SparkSession, d: str) -> DataFrame:
    return sinks.velest_lines(ev(spark, d), table(spark, d, "picks"), 0.3, 2, 0.0, 0.2, 5.0)


@query(f"with {PK} select pick_id, 'phase: ' || strftime(coalesce(observed_time, model_time), '%Y-%m-%d %H:%M:%S.%g') || ' ' || nsl || ' ' || event_uid || ' ' || phase || ' ' || case when observed_time is null then 'modelled' else 'automatic' end as line from pk")
def phase_markers(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "picks")
    at = F.coalesce("observed_time", "model_time")
    return p.select("pick_id", F.concat_ws(" ", F.lit("phase:"), F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSS"), codes.nsl(F.col("network"), F.col("station"), F.col("location")), "event_uid", "phase", F.when(F.col("observed_time").isNotNull(), F.lit("automatic")).otherwise(F.lit("modelled"))).alias("line"))


@query("select event_uid, network, station, phase, observed_time, confidence from picks where observed_time is not null and confidence > 0.5 and not isnan(confidence) and event_uid in (select event_uid from detections where semblance >= 0.4 and not isnan(semblance))")
def simple_export(spark: SparkSession, d: str) -> DataFrame:
    keep = cat.ranges(table(spark, d, "detections"), {"semblance": (0.4, None)}).select("event_uid").distinct()
    p = table(spark, d, "picks").where("observed_time is not null and confidence > 0.5 and not isnan(confidence)")
    return p.join(keep, "event_uid", "left_semi").select("event_uid", "network", "station", "phase", "observed_time", "confidence")


# -- fits, densities, moments ------------------------------------------------------------


@query()
def magnitude_fit(spark: SparkSession, d: str) -> DataFrame:
    """Maximum-likelihood detection and recurrence parameters over the histogram of all magnitudes."""
    h = an.magnitude_bins(table(spark, d, "station_magnitudes").where("magnitude is not null and not isnan(magnitude)"), "magnitude", 0.1)

    def fit(pdf):  # noqa: ANN001, ANN202
        import pandas as pd

        m = pdf.lo.iloc[0] + (pdf.bin.to_numpy() + 0.5) * 0.1
        beta, mu, sigma, ll = emr_fit(m, pdf.n.to_numpy())
        return pd.DataFrame({"b": [beta / math.log(10)], "mu": [mu], "sigma": [sigma], "log_likelihood": [ll]})

    # one row per occupied bin: a few hundred
    return h.withColumn("k", F.lit(1)).groupBy("k").applyInPandas(fit, "b double, mu double, sigma double, log_likelihood double")


@query("with v as (select semblance as v from detections where semblance is not null and not isnan(semblance)), l as (select min(v) as lo, max(v) as hi from v), b as (select round(lo + (hi - lo) * k / 500, 9) as x, count(v) as n from (select least(floor((v - lo) / (hi - lo) * 500), 499)::int as k, v, lo, hi from v, l) group by 1), t as (select sum(n) as n, sum(x * n) / sum(n) as mu from b), h as (select t.n, sqrt(sum(pow(x - mu, 2) * b.n) / (any_value(t.n) - 1)) * pow(t.n, -0.2) as h from b, t group by t.n), g as (select round(lo + (hi - lo) * 499 / 500, 9) as last, round(lo, 9) as first from l), a as (select first + (last - first) * i / 49 as x from g, (select unnest(generate_series(0, 49)) as i)) select round(a.x, 6) as x, round(sum(exp(-pow(a.x - b.x, 2) / (2 * h.h * h.h)) * b.n) / (any_value(h.n) * any_value(h.h) * sqrt(2 * pi())), 6) as density from a, b, h group by 1")
def semblance_density(spark: SparkSession, d: str) -> DataFrame:
    """Gaussian kernel density of semblances at 50 places, over counts in 500 bins."""
    b = an.equal_bins(table(spark, d, "detections"), "semblance", 500)

    def run(pdf):  # noqa: ANN001, ANN202
        import pandas as pd

        pdf = pdf.sort_values("bin")
        x, n = pdf["lower"].to_numpy(), pdf["n"].to_numpy()
        at = np.linspace(x[0], x[-1], 50)
        return pd.DataFrame({"x": at, "density": gaussian_density(x, n, at)})

    return b.withColumn("k", F.lit(1)).groupBy("k").applyInPandas(run, "x double, density double").select(F.round("x", 6).alias("x"), F.round("density", 6).alias("density"))


@query("select row_id, round(log10(pow(10, 1.5 * (magnitude + 10.7)) * 1e-7), 6) as log_m0 from station_magnitudes where magnitude is not null and not isnan(magnitude)")
def scalar_moments(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "station_magnitudes").where("magnitude is not null and not isnan(magnitude)")
    return m.select("row_id", F.round(F.log10(magnitude.scalar_moment(F.col("magnitude"))), 6).alias("log_m0"))


@query("with s as (select amp_id, peak_horizontal as v, collection_id from site_amplitudes where peak_horizontal > 0 and not isnan(peak_horizontal)), m as (select collection_id, avg(v) as mean, any_value(ref_magnitude) as ref from (select s.*, a.ref_magnitude from s join site_amplitudes a using (amp_id)) group by 1) select amp_id, round(ref + log10(v / mean), 6) as m from s join m using (collection_id)")
def moment_magnitudes(spark: SparkSession, d: str) -> DataFrame:
    """The magnitude that each library amplitude would give against its collection's mean."""
    s = table(spark, d, "site_amplitudes").where("peak_horizontal > 0 and not isnan(peak_horizontal)")
    m = s.groupBy("collection_id").agg(F.avg("peak_horizontal").alias("mean"), F.first("ref_magnitude").alias("ref"))
    return s.join(m, "collection_id").select("amp_id", F.round(magnitude.moment_magnitude(F.col("ref"), F.col("peak_horizontal"), F.col("mean")), 6).alias("m"))


@query("with c as (select distinct on (collection_id) collection_id, source_depth as z, quantity, ref_magnitude from site_amplitudes order by collection_id, amp_id), q as (select collection_id, z, quantity, ref_magnitude from c), k as (select a.collection_id, b.z, row_number() over (partition by a.collection_id order by abs(b.z - a.z), b.collection_id) as k from q a join q b on a.collection_id <> b.collection_id and a.quantity = b.quantity) select collection_id, min(z) as z1, max(z) as z2 from k where k <= 2 group by 1 having count(*) = 2")
def nearest_depths(spark: SparkSession, d: str) -> DataFrame:
    """The two nearest other collections in depth of the same quantity."""
    c = cat.first_by(table(spark, d, "site_amplitudes"), ["collection_id"], ["amp_id"])
    return magnitude.nearest_depths(c, "collection_id", "source_depth", "quantity")


SENSOR = ([-4.44, 4.44, -4.44, -4.44], [0.0, 0.0, 0.0, 0.0], 4e8)  # poles, zeros and constant of the planted traces' seismometer


def planted_ground_motion(spark: SparkSession, events: int = 6, stations: int = 8, rate: float = 100.0, n: int = 6000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(traces, responses, arrivals) of 5 Hz pulses of known amplitudes, as a seismometer writes them."""
    cplx = lambda v: np.array(v[::2]) + 1j * np.array(v[1::2])
    sensor = signal.pole_zero(cplx(SENSOR[0]), cplx(SENSOR[1]), SENSOR[2])

    def write(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        t = np.arange(n) / rate - 32.0
        spectrum = np.fft.rfft(np.exp(-((t / 0.8) ** 2)) * np.cos(2 * np.pi * 5.0 * t)) * sensor(np.fft.rfftfreq(n, 1 / rate))
        unit = np.fft.irfft(spectrum, n)
        for pdf in batches:
            out = pdf[["event_uid", "nsl"]].assign(rate_hz=rate, tmin_us=1_000_000_000)
            yield pd.concat([out.assign(channel=c, samples=[(a * part * unit).tolist() for a in pdf.amp]) for c, part in (("HHN", 1.0), ("HHE", 0.4), ("HHZ", 0.2))])[["event_uid", "nsl", "channel", "rate_hz", "tmin_us", "samples"]]

    pairs = spark.range(events * stations).select(
        F.concat(F.lit("e"), F.floor(F.col("id") / stations)).alias("event_uid"), F.concat(F.lit("PL.S"), F.col("id") % stations, F.lit(".")).alias("nsl"),
        F.pow(F.lit(10.0), F.floor(F.col("id") / stations) / 2 - 7).alias("amp"), (20_000.0 + 10_000.0 * (F.col("id") % stations)).alias("distance"),
    )
    traces = pairs.mapInPandas(write, local_magnitude._SHAPED)
    codes_ = pairs.select("nsl").distinct()
    real = lambda v: F.array(*[F.lit(x) for x in v])
    responses = codes_.select("nsl", F.explode(F.array(*[F.lit(c) for c in ("HHN", "HHE", "HHZ")])).alias("channel"), F.lit(0).cast("long").alias("start_us"), F.lit(None).cast("long").alias("end_us"), real(SENSOR[0]).alias("poles"), real(SENSOR[1]).alias("zeros"), F.lit(SENSOR[2]).alias("constant"))
    arrivals = pairs.select("event_uid", "nsl", F.lit(1_030_000_000).cast("long").alias("p_us"), F.col("distance").alias("distance_hypo"), F.col("distance").alias("distance_epi"), "amp")
    return traces, responses, arrivals


@query("select 'e' || (i // 8)::int as event_uid, 'PL.S' || (i % 8) || '.' as nsl, true as close, 'valid' as flag from (select unnest(generate_series(0, 47)) as i)")
def local_magnitudes_from_traces(spark: SparkSession, d: str) -> DataFrame:
    """Station magnitudes of planted ground motions: whether they are those of the known amplitudes on the model's instrument."""
    traces, responses, arrivals = planted_ground_motion(spark)
    model = attenuation.MODELS["SouthernCalifornia"]
    got = local_magnitude.station_magnitudes(traces, responses, arrivals.drop("amp"), model)
    gain = float(abs(signal.pole_zero(*signal.INSTRUMENTS[model.instrument])(np.array([5.0]))[0]))
    want = attenuation.magnitude_of(model, F.col("amp") * gain, F.col("a.distance_hypo"), F.col("a.distance_epi"))
    j = got.alias("g").join(arrivals.alias("a"), ["event_uid", "nsl"])
    return j.select("event_uid", "nsl", (F.abs(F.col("magnitude") - want) < 0.03).alias("close"), "flag")


# -- streams of stations, coverage, corrections --------------------------------------------


@query("select nsl, max(epoch_us(endtime)) as last_us, (1700000000000000 - max(epoch_us(endtime)))::bigint as lag_us, 1700000000000000 - max(epoch_us(endtime)) <= 86400000000 as online from seedlink_stations where nsl is not null and endtime is not null group by 1")
def stations_online(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "seedlink_stations").where("nsl is not null and endtime is not null").select("nsl", micros("endtime").alias("t"))
    return live.online(s, "nsl", "t", 1_700_000_000_000_000, 86_400_000_000)


@query("select distinct nsl from seedlink_stations where (regexp_matches(nsl, '^Q0[.]HUB.*[.].*$') and regexp_matches(channel, '^HH.$')) or nsl in ('X3.10047.00', 'W6.10053.')")
def stream_selection(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "seedlink_stations").select("nsl", "channel")
    by_glob = s.where(codes.nsl_matches(F.col("nsl"), "Q0.HUB*") & F.col("channel").rlike(codes.glob_regex("HH?")))
    named = s.where(F.col("nsl").isin("X3.10047.00", "W6.10053."))
    return by_glob.select("nsl").union(named.select("nsl")).distinct()


_DELAY = "dl as (select network || '.' || station || '.' || coalesce(location, '') as nsl, phase, median(station_delay_s) as delay_s from picks where station_delay_s is not null and not isnan(station_delay_s) group by 1, 2)"


@query(f"with {_DELAY}, {PK} select pick_id, round(coalesce(dl.delay_s, 0), 6) as delay_s from pk left join dl using (nsl, phase)")
def station_delays(spark: SparkSession, d: str) -> DataFrame:
    """The median delay of each station and phase joined to the picks, 0 where none is known."""
    p = pks(spark, d)
    dl = ordered.median(p, ["nsl", "phase"], "station_delay_s", "delay_s")
    out = traveltime.with_delays(p.withColumn("tt", F.lit(0.0)), dl)
    return out.select("pick_id", F.round("tt", 6).alias("delay_s"))


@query(f"with {STS}, d as (select unnest(generate_series(date '2023-03-01', date '2023-03-07', interval 1 day))::date as day) select nsl, day::varchar as day from st, d")
def stations_by_dates(spark: SparkSession, d: str) -> DataFrame:
    from stackwave.operators.ingest import stations_by_dates as by_dates

    return by_dates(sts(spark, d), "2023-03-01", "2023-03-07").select("nsl", F.col("day").cast("string").alias("day"))

