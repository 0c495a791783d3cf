"""Sources: waveform archives, inventories, catalogues, models and runs.

Archives are folders of `year/network/station/channel.D/net.sta.loc.cha.D.year.day`
files (SDS), or any tree of record files. The file listing is planned on the
driver; decoding runs in tasks, one per file group.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from datetime import date, timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from stackwave.sources.mseed import records

DAY_US = 86_400_000_000
SEGMENTS = "network string, station string, location string, channel string, tmin_us long, tmax_us long, rate_hz double, samples array<double>"


def parse_path(path: str) -> tuple[str, str, str, str, int, int] | None:
    """(network, station, location, channel, year, julian day) of an archive file's name, or None."""
    p = os.path.basename(path).split(".")
    if len(p) != 7 or p[4] != "D" or not (p[5].isdigit() and p[6].isdigit()):
        return None
    return p[0], p[1], p[2], p[3], int(p[5]), int(p[6])


def path_columns(path) -> list:  # noqa: ANN001
    """The same as columns of a path column."""
    p = F.split(F.element_at(F.split(path, "/"), -1), r"\.")
    day = F.date_add(F.make_date(F.get(p, F.lit(5)).cast("int"), F.lit(1), F.lit(1)), F.get(p, F.lit(6)).cast("int") - 1)
    return [F.get(p, F.lit(i)).alias(n) for i, n in enumerate(("network", "station", "location", "channel"))] + [day.alias("day")]


class _Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


def _list(root: str) -> list[str]:
    return sorted(str(p) for p in Path(root).rglob("*") if p.is_file() and not p.name.startswith((".", "_")))


def _wanted(path: str, options: dict) -> bool:
    """Names that tell their day and codes are skipped where these are outside the request."""
    got = parse_path(path)
    if got is None:
        return options.get("layout", "any") != "sds"
    if options.get("stations") and ".".join(got[:3]) not in options["stations"].split(","):
        return False
    day = date(got[4], 1, 1) + timedelta(days=got[5] - 1)
    lo, hi = options.get("startday"), options.get("endday")
    if (lo and day < date.fromisoformat(lo)) or (hi and day > date.fromisoformat(hi)):
        return False
    # a day's file may begin before it and end after it
    start = (day - date(1970, 1, 1)).days * DAY_US
    if start + 2 * DAY_US < int(options.get("tmin_us", -(1 << 62))) or start - DAY_US > int(options.get("tmax_us", 1 << 62)):
        return False
    codes = options.get("channels")
    if got[3][:1] in options.get("excludebands", "LVURPTQ"):
        return False
    return not codes or any(got[3].startswith(c) for c in codes.split(","))


def _decode(paths: list[str], options: dict) -> Iterator[tuple]:
    lo, hi = int(options.get("tmin_us", -(1 << 62))), int(options.get("tmax_us", 1 << 62))
    for path in paths:
        try:
            data = Path(path).read_bytes()
            for net, sta, loc, cha, t, rate, x in records(data, strict=options.get("ignorecorrupt", "true") != "true"):
                end = t + round((len(x) - 1) / rate * 1e6) if rate else t
                if end >= lo and t <= hi:
                    yield net, sta, loc, cha, t, end, float(rate), x.tolist()
        except Exception:  # noqa: BLE001
            if options.get("ignorecorrupt", "true") != "true":
                raise


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        files = [p for p in _list(self.options["path"]) if _wanted(p, self.options)]
        n = int(self.options.get("filespertask", 8))
        return [_Files(files[i : i + n]) for i in range(0, len(files), n)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        yield from _decode(partition.paths, self.options)


class _Watcher(DataSourceStreamReader):
    """A growing archive: the offset is a time of modification, files of later times are new.

    Files that changed within the last settle_s seconds wait. A file that
    changes after it was read is read again; merging drops what it repeats.
    """

    def __init__(self, options: dict) -> None:
        self.options = options

    def _files(self) -> list[tuple[int, str]]:
        out = []
        for p in _list(self.options["path"]):
            if _wanted(p, self.options):
                try:
                    out.append((os.stat(p).st_mtime_ns, p))
                except FileNotFoundError:  # moved since it was listed
                    continue
        return sorted(out)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"upto_ns": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        settled = time.time_ns() - int(float(self.options.get("settle_s", "30")) * 1e9)
        return {"upto_ns": max((t for t, _ in self._files() if t <= settled), default=0)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Files([p]) for t, p in self._files() if start["upto_ns"] < t <= end["upto_ns"]]

    def read(self, partition: _Files) -> Iterator[tuple]:
        yield from _decode(partition.paths, self.options)


class TraceArchive(DataSource):
    """format("traces"): options path, layout (any, sds), startday, endday, stations (network.station.location), channels, tmin_us, tmax_us, filespertask, ignorecorrupt, settle_s (streams). Paths are of a folder that all nodes share.

    Files and records are narrowed by options, not by pushed filters: Spark keeps
    a Python source's pushed filters with the DataFrame, so that another query
    of the same DataFrame would lose rows.
    """

    @classmethod
    def name(cls) -> str:
        return "traces"

    def schema(self) -> str:
        return SEGMENTS

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001, N802
        return _Watcher(dict(self.options))


def read_traces(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(TraceArchive)
    return spark.read.format("traces").options(**options).load(path)


def watch_traces(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(TraceArchive)
    return spark.readStream.format("traces").options(**options).load(path)


def time_span(segments: DataFrame) -> DataFrame:
    return segments.agg(F.min("tmin_us").alias("start_us"), F.max("tmax_us").alias("end_us"))


_STATION = "struct<_code:string,Latitude:string,Longitude:string,Elevation:string,Channel:array<struct<_code:string,_locationCode:string,Latitude:string,Longitude:string,Elevation:string,Depth:string>>>"


def read_station_xml(spark: SparkSession, path: str) -> DataFrame:
    """(network, station, location, lat, lon, elevation, depth): one row per station and location code of FDSN StationXML."""
    x = spark.read.format("xml").option("rowTag", "Network").schema(f"_code string, Station array<{_STATION}>").load(path)
    s = x.select(F.col("_code").alias("network"), F.explode("Station").alias("s"))
    c = s.select("network", F.col("s._code").alias("station"), F.col("s").alias("s"), F.explode_outer("s.Channel").alias("c"))
    num = lambda a, b: F.coalesce(F.col(f"c.{a}"), F.col(f"s.{a}")).cast("double").alias(b)
    return c.select("network", "station", F.coalesce(F.trim("c._locationCode"), F.lit("")).alias("location"), num("Latitude", "lat"), num("Longitude", "lon"), num("Elevation", "elevation"), F.coalesce(F.col("c.Depth").cast("double"), F.lit(0.0)).alias("depth")).dropDuplicates(["network", "station", "location"])


def read_station_yaml(spark: SparkSession, path: str) -> DataFrame:
    """Flat lists of `- key: value` blocks of stations; other keys are ignored."""
    rows: list[dict] = []
    for line in Path(path).read_text().splitlines():
        body = line.strip()
        if body.startswith("- "):
            rows.append({})
            body = body[2:]
        if ":" in body and rows:
            k, v = body.split(":", 1)
            rows[-1][k.strip()] = v.strip().strip("'\"")
    num = lambda r, k: float(r[k]) if r.get(k) not in (None, "", "null") else 0.0
    data = [(r.get("network", ""), r.get("station", ""), r.get("location", ""), *[num(r, k) for k in ("lat", "lon", "east_shift", "north_shift", "elevation", "depth")]) for r in rows if "station" in r]
    return spark.createDataFrame(data, "network string, station string, location string, lat double, lon double, east_shift double, north_shift double, elevation double, depth double")


EVENT_SCHEMA = "uid string, time timestamp, lat double, lon double, east_shift double, north_shift double, elevation double, depth double, semblance double, n_stations int, distance_border double, in_bounds boolean, magnitudes array<struct<magnitude:string,average:double,error:double>>, _bad string"


def read_catalog(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """(events, bad lines) of line-delimited JSON with one detection a line; a line without uid is bad."""
    raw = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    raw = raw.withColumn("changed", F.col("_metadata.file_modification_time"))
    return raw.where("_bad is null and uid is not null").drop("_bad"), raw.where("_bad is not null or uid is null").select("_bad")


RECEIVER_SCHEMA = "event_uid string, receivers array<struct<network:string,station:string,location:string,lat:double,lon:double,phase_arrivals:map<string,struct<model:struct<time:timestamp>,observed:struct<time:timestamp,detection_value:double>,station_delay:double>>>>"


def read_receivers(spark: SparkSession, path: str) -> DataFrame:
    """The receivers' side file, one row for each event, receiver and phase."""
    r = spark.read.schema(RECEIVER_SCHEMA).json(path).select("event_uid", F.explode("receivers").alias("r"))
    p = r.select("event_uid", "r.network", "r.station", "r.location", F.explode("r.phase_arrivals").alias("phase", "a"))
    return p.select("event_uid", "network", "station", "location", "phase", F.col("a.model.time").alias("model_time"), F.col("a.observed.time").alias("observed_time"), F.col("a.observed.detection_value").alias("confidence"), F.col("a.station_delay").alias("station_delay_s"))


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    """(nsl, phase, delay_s) from JSON {"nsl": {"phase": seconds}}."""
    m = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, map<string, double>>").alias("m"))
    return m.select(F.explode("m").alias("nsl", "d")).select("nsl", F.explode("d").alias("phase", "delay_s"))


_SITE = "struct<magnitude:double,distance_epi:double,peak_horizontal:double,peak_vertical:double,peak_absolute:double>"
STORE_SCHEMA = f"uuid string, gf_store_id string, quantity string, reference_magnitude double, max_distance double, stress_drop array<double>, rupture_velocities array<double>, frequency_range array<double>, amplitude_collections array<struct<source_depth:double,quantity:string,site_amplitudes:array<{_SITE}>>>"


def read_amplitude_library(spark: SparkSession, path: str) -> DataFrame:
    """One row for each amplitude of the stores' JSON files: the store's parameters, source_depth and the peaks."""
    s = spark.read.schema(STORE_SCHEMA).option("multiLine", True).json(path).where("uuid is not null")
    c = s.select("uuid", "gf_store_id", "quantity", "reference_magnitude", "max_distance", F.explode("amplitude_collections").alias("c"))
    return c.select(*[x for x in c.columns if x != "c"], F.col("c.source_depth").alias("source_depth"), F.explode("c.site_amplitudes").alias("a")).select("*", "a.*").drop("a")


def find_runs(root: str) -> list[str]:
    """Folders that hold a search.json, by name."""
    return sorted(str(p.parent) for p in Path(root).glob("*/search.json"))


def table_of_hash(spark: SparkSession, root: str, model_hash: str, build) -> DataFrame:  # noqa: ANN001
    """A travel-time or amplitude table kept under its model's hash: read if there, else built and written."""
    path = f"{root}/model={model_hash}"
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
