"""A run named by a configuration: archive, merging, batches, preprocessing, images, search.

    {"source": {"use": "archive", "path": ...}, "preprocess": [{"use": "bandpass", "low": 2, "high": 20}],
     "image": {"use": "sta_lta", ...}, "tracer": {...}, "batch_s": 60, "stations": [...], "search": {...}}

Steps are looked up in the registry, where the built-in ones below register
themselves; a user's script may add more before the run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwave.functions import codes, signal
from stackwave.operators import ingest, search
from stackwave.operators.octree import Bounds
from stackwave.plans import registry
from stackwave.plans.dist import arrow_schema
from stackwave.sources import archives

_TRACES = "batch_id long, nslc string, rate_hz double, tmin_us long, samples array<double>"
_IMAGES = "batch_id long, nslc string, phase string, rate_hz double, tmin_us long, samples array<double>"


def per_trace(df: DataFrame, f: Callable[[np.ndarray, float], tuple[np.ndarray, float]], only: str | None = None) -> DataFrame:
    """f(samples, rate) -> (samples, rate) on each trace, those of equal rate and length at once; `only` is a code pattern, other traces stay."""
    schema = arrow_schema(_TRACES)
    hit = codes.nsl_matches(F.regexp_extract("nslc", r"^(.*)\.[^.]*$", 1), only) if only else F.lit(True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, rate, mine = b.column("samples").to_pylist(), b.column("rate_hz").to_pylist(), b.column("_hit").to_pylist()
            groups: dict[tuple[float, int], list[int]] = {}
            for i in range(len(x)):
                if mine[i]:
                    groups.setdefault((rate[i], len(x[i])), []).append(i)
            for (r, _), at in groups.items():
                y, new = f(np.array([x[i] for i in at], float), r)
                for i, v in zip(at, y):
                    x[i], rate[i] = v.tolist(), new
            cols = [b.column("batch_id"), b.column("nslc"), pa.array(rate, pa.float64()), b.column("tmin_us"), pa.array(x, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return df.select("batch_id", "nslc", "rate_hz", "tmin_us", "samples", F.coalesce(hit, F.lit(False)).alias("_hit")).mapInArrow(run, _TRACES)


@registry.register("source", "archive")
def archive(spark: SparkSession, path: str, **options: str) -> DataFrame:
    t = archives.read_traces(spark, path, **options)
    return t.select(F.concat_ws(".", "network", "station", "location", "channel").alias("nslc"), "rate_hz", "tmin_us", "samples")


@registry.register("preprocess", "bandpass")
def bandpass(df: DataFrame, low: float | None = None, high: float | None = None, order: int = 4, only: str | None = None) -> DataFrame:
    return per_trace(df, lambda x, r: (signal.band_filter(x, r, low, high, order), r), only)


@registry.register("preprocess", "resample")
def resample(df: DataFrame, rate_hz: float, only: str | None = None) -> DataFrame:
    return per_trace(df, lambda x, r: (np.array([signal.resample(v, 1 / r, 1 / rate_hz) for v in x]), rate_hz), only)


@registry.register("preprocess", "downsample")
def downsample(df: DataFrame, factor: int, only: str | None = None) -> DataFrame:
    return per_trace(df, lambda x, r: (np.array([signal.downsample(v, factor) for v in x]), r / factor), only)


@registry.register("image", "as_is")
def as_is(df: DataFrame, phases: dict[str, str]) -> DataFrame:
    """Traces that are images already: the last letter of a channel names the phase."""
    names = F.create_map(*[F.lit(x) for kv in phases.items() for x in kv])
    return df.withColumn("phase", F.element_at(names, F.right("nslc", F.lit(1)))).where("phase is not null")


@registry.register("image", "sta_lta")
def sta_lta(df: DataFrame, phases: dict[str, str], short_s: float = 0.5, long_s: float = 5.0) -> DataFrame:
    """Short over long-term energy of each channel, as an image of the phase that its last letter names."""
    return as_is(per_trace(df, lambda x, r: (np.array([signal.sta_lta(v, max(1, int(short_s * r)), max(2, int(long_s * r))) for v in x]), r)), phases)


@registry.register("tracer", "constant")
def constant(velocities: dict[str, float]) -> tuple[dict[str, float], None]:
    return velocities, None


def assemble(images: DataFrame, stations: DataFrame) -> DataFrame:
    """Images(batch_id, nslc, phase, ...) with their station's index; an image of no known station, and a station's second image of a phase, go."""
    s = images.withColumn("nsl", F.regexp_extract("nslc", r"^(.*)\.[^.]*$", 1)).join(F.broadcast(stations), "nsl")  # an inventory of thousands
    return ingest.first_by(s, ["batch_id", "sta_idx", "phase"], ["nslc", "tmin_us"]).select("batch_id", "sta_idx", "phase", "rate_hz", "tmin_us", "samples")


def run(spark: SparkSession, config: dict) -> DataFrame:
    """Detections of a configured run; config as at the top."""
    source = registry.build("source", config["source"])(spark)
    places = [(x["nsl"], i, *map(float, x["at"])) for i, x in enumerate(config["stations"])]
    where = [(i, e, n, h) for _, i, e, n, h in places]
    known = spark.createDataFrame([(nsl, i) for nsl, i, *_ in places], "nsl string, sta_idx long")
    velocities, tracer = registry.build("tracer", config["tracer"])()
    b = Bounds(*[tuple(x) for x in config["search"]["bounds"]])
    length, origin = round(config["batch_s"] * 1e6), int(config.get("origin_us", 0))
    far = float(np.linalg.norm([max(abs(v) for v in axis) for axis in (b.east, b.north, b.depth)])) + max(float(np.linalg.norm(x[1:])) for x in where)
    blind = float(config["search"].get("blinding_s", 1.0))
    pad = ingest.padding_us(0.0, far / min(velocities.values()), float(config.get("image_blinding_s", 0.0)), blind)
    merged = ingest.merge_gaps(source, int(config.get("max_gap_samples", 0)))
    batches = ingest.trace_batches(merged, length, pad, origin)
    batches = ingest.long_enough(batches, round(float(config.get("least_s", 0.0)) * 1e6))
    if config.get("least_stations"):
        nsl = F.regexp_extract("nslc", r"^(.*)\.[^.]*$", 1)
        batches = ingest.healthy_batches(batches.withColumn("nsl", nsl), "nsl", int(config["least_stations"])).drop("nsl")
    traces = registry.chain("preprocess", config.get("preprocess", []))(batches)
    images = assemble(registry.build("image", config["image"])(traces), known)
    more = {k: v for k, v in config["search"].items() if k not in ("bounds", "root_size", "levels")}
    settings = search.Settings(b, float(config["search"]["root_size"]), int(config["search"]["levels"]), velocities, **more)
    return search.search(images, where, replace(settings, core_us=length, origin_us=origin), tracer)
