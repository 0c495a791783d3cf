"""Sinks: catalogues, exports, archives."""

from __future__ import annotations

import sqlite3
import struct
from datetime import date, timedelta
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwave.functions import codes
from stackwave.sources.mseed import encode


def append_events(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


def restore(spark: SparkSession, path: str) -> None:
    """Finish a rewrite that was cut off: the table is the old one until the new one has its name."""
    fs, at = _fs(spark, path)
    if not fs.exists(at(path)) and fs.exists(at(f"{path}.old")):
        fs.rename(at(f"{path}.old"), at(path))
    for leftover in (f"{path}.new", f"{path}.old"):
        fs.delete(at(leftover), True)


def rewrite(df: DataFrame, path: str) -> None:
    """Overwrite a stored table, also one that df reads: a new folder is written whole and takes its name by renaming; restore() mends a crash between."""
    spark = df.sparkSession
    fs, at = _fs(spark, path)
    restore(spark, path)
    df.write.mode("overwrite").parquet(f"{path}.new")
    if fs.exists(at(path)) and not fs.rename(at(path), at(f"{path}.old")):
        raise OSError(f"cannot move {path}")
    if not fs.rename(at(f"{path}.new"), at(path)):
        fs.rename(at(f"{path}.old"), at(path))
        raise OSError(f"cannot move {path}.new")
    fs.delete(at(f"{path}.old"), True)
    spark.catalog.refreshByPath(path)


def write_csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Header and empty text for missing values; one sorted file where an order is given (an export for people)."""
    if order:
        df = df.orderBy(*order).coalesce(1)
    df.write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def write_simple(events: DataFrame, picks: DataFrame, path: str, min_semblance: float, min_confidence: float) -> None:
    """Events of at least a semblance, and one CSV folder per event of picks above a confidence."""
    keep = events.where(F.col("semblance") >= min_semblance)
    write_csv(keep, f"{path}/events")
    p = picks.join(keep.select("event_uid"), "event_uid", "left_semi").where((F.col("confidence") > min_confidence) & F.col("observed_time").isNotNull())
    p.repartition("event_uid").write.mode("overwrite").option("header", True).partitionBy("event_uid").csv(f"{path}/picks")


def velest_lines(events: DataFrame, picks: DataFrame, min_semblance: float = 0.0, min_p_picks: int = 4, min_border: float = 0.0, min_confidence: float = 0.0, max_delay_s: float = 1e9) -> DataFrame:
    """(event_uid, line_no, line): an event's header and its picks in fixed width, with quality classes by confidence.

    Events lacking a coordinate have no line; a missing or NaN measure passes no bound.
    """
    for c in ("lat", "lon", "depth", "elevation", "semblance", "distance_border"):
        events = events.where(F.col(c).isNotNull() & ~F.isnan(c))
    picks = picks.where(~F.isnan("confidence"))
    delay = F.abs((F.unix_micros(F.col("observed_time").cast("timestamp")) - F.unix_micros(F.col("model_time").cast("timestamp"))) / 1e6)
    p = picks.where(F.col("observed_time").isNotNull() & (F.col("confidence") > min_confidence) & (delay <= max_delay_s))
    kind = F.right("phase", F.lit(1))
    enough = p.where(kind == "P").groupBy("event_uid").agg(F.count("*").alias("n")).where(F.col("n") >= min_p_picks)
    e = events.where((F.col("semblance") >= min_semblance) & (F.col("distance_border") >= min_border)).join(enough, "event_uid", "left_semi")
    head = F.concat(F.date_format("event_time", "yyMMdd HHmm ss.SS"), F.lit(" "), codes.hemisphere(F.col("lat"), "N", "S"), F.lit(" "), codes.hemisphere(F.col("lon"), "E", "W", 9), F.format_string("%8.3f", (F.col("depth") - F.col("elevation")) / 1000))
    first = e.select("event_uid", F.lit(0).cast("long").alias("pick_id"), head.alias("line"))
    t = (F.unix_micros(F.col("observed_time").cast("timestamp")) - F.unix_micros(F.col("event_time").cast("timestamp"))) / 1e6
    rest = p.join(e.select("event_uid", "event_time"), "event_uid").select("event_uid", "pick_id", F.format_string("  %-6s%s%d%6.2f", "station", kind, codes.quality_class(F.col("confidence")), t).alias("line"))
    from pyspark.sql import Window as W

    return first.unionByName(rest).withColumn("line_no", F.row_number().over(W.partitionBy("event_uid").orderBy("pick_id")) - 1).select("event_uid", "line_no", "line")


def markers(picks: DataFrame) -> DataFrame:
    """Phase marker lines: time, code, phase, event."""
    at = F.coalesce("observed_time", "model_time")
    return picks.select(F.concat_ws(" ", F.lit("phase:"), F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSS"), codes.nsl(F.col("network"), F.col("station"), F.col("location")), "event_uid", "phase", F.when(F.col("observed_time").isNotNull(), F.lit("automatic")).otherwise(F.lit("modelled"))).alias("line"))


def write_stations(stations: DataFrame, path: str) -> None:
    """An inventory as CSV with fixed columns and as a YAML list, by code; an inventory is thousands of rows."""
    cols = ["network", "station", "location", "lat", "lon", "elevation", "depth"]
    s = stations.select(*cols).orderBy(*cols[:3])
    write_csv(s, f"{path}/csv", cols[:3])
    text = lambda c: F.concat(F.lit(f"  {c}: "), F.coalesce(F.col(c).cast("string"), F.lit("")))
    line = F.concat_ws("\n", F.concat(F.lit("- network: "), F.col("network")), F.concat(F.lit("  station: "), F.col("station")), F.concat(F.lit("  location: '"), F.coalesce("location", F.lit("")), F.lit("'")), *[text(c) for c in cols[3:]])
    s.select(line.alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/yaml")


def station_lines(stations: DataFrame) -> DataFrame:
    """(nsl, line): fixed-width station lines of the location exporter."""
    return stations.select("nsl", F.concat(F.format_string("%-6s", "station"), codes.hemisphere(F.col("lat"), "N", "S"), F.lit(" "), codes.hemisphere(F.col("lon"), "E", "W", 9), F.format_string(" %5d", F.round(F.col("elevation") - F.col("depth")).cast("int"))).alias("line"))


def append_trace(df: DataFrame, path: str) -> None:
    """Append semblance traces (batch_id, tmin_us, rate_hz, samples) as whole numbers, one folder a day."""
    x = df.select("batch_id", "tmin_us", "rate_hz", scaled("samples").alias("samples"), F.to_date(F.timestamp_micros("tmin_us")).alias("day"))
    x.write.mode("append").partitionBy("day").parquet(path)


def append_csv(df: DataFrame, path: str) -> None:
    """Append rows to a folder of CSV files, each with its header; missing is empty text."""
    df.write.mode("append").option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def event_markers(events: DataFrame) -> DataFrame:
    """(event_uid, line): event marker lines of time, place and semblance."""
    at = F.date_format("event_time", "yyyy-MM-dd HH:mm:ss.SSS")
    return events.select("event_uid", F.concat_ws(" ", F.lit("event:"), at, F.format_string("%.5f", "lat"), F.format_string("%.5f", "lon"), F.format_string("%.1f", "depth"), F.format_string("%.5f", "semblance")).alias("line"))


def write_synthetic(events: DataFrame, images: DataFrame, path: str) -> None:
    """Planted events as CSV and JSON, their image traces as a table."""
    write_csv(events, f"{path}/csv")
    events.write.mode("overwrite").json(f"{path}/json")
    images.write.mode("overwrite").parquet(f"{path}/traces")


def velocity_lines(model: list[tuple]) -> list[str]:
    """Fixed-width model lines, the first row of each depth."""
    seen: set[float] = set()
    out = []
    for top, _, vp, vs, *_ in model:
        if top not in seen:
            seen.add(top)
            out.append(f"{vp / 1000:5.2f}     {top / 1000:7.2f}  {vs / 1000:5.2f}")
    return out


def write_geopackage(events: DataFrame, path: str, limit_rows: int = 1_000_000) -> int:
    """Points (x, y, z) as a GeoPackage file, written by the driver in batches as rows arrive; raises beyond limit_rows, which is for maps."""
    if events.count() > limit_rows:
        raise ValueError(f"a GeoPackage file is written by one process and may hold {limit_rows} rows")
    Path(path).unlink(missing_ok=True)
    con = sqlite3.connect(path)
    con.executescript("""
        pragma application_id = 1196444487; pragma user_version = 10300;
        create table gpkg_spatial_ref_sys (srs_name text not null, srs_id integer primary key, organization text not null, organization_coordsys_id integer not null, definition text not null, description text);
        insert into gpkg_spatial_ref_sys values ('WGS 84', 4326, 'EPSG', 4326, 'GEOGCS["WGS 84"]', null), ('Undefined', -1, 'NONE', -1, 'undefined', null), ('Undefined geographic', 0, 'NONE', 0, 'undefined', null);
        create table gpkg_contents (table_name text primary key, data_type text not null, identifier text unique, description text default '', last_change datetime not null default (strftime('%Y-%m-%dT%H:%M:%fZ', 'now')), min_x double, min_y double, max_x double, max_y double, srs_id integer);
        create table gpkg_geometry_columns (table_name text not null, column_name text not null, geometry_type_name text not null, srs_id integer not null, z tinyint not null, m tinyint not null, primary key (table_name, column_name));
        create table events (fid integer primary key autoincrement, geom blob, uid text, time text, semblance double);
        insert into gpkg_contents (table_name, data_type, identifier, srs_id) values ('events', 'features', 'events', 4326);
        insert into gpkg_geometry_columns values ('events', 'geom', 'POINT', 4326, 1, 0);
    """)
    n = 0
    for r in events.select("event_uid", F.col("event_time").cast("string").alias("t"), "lat", "lon", (F.col("elevation") - F.col("depth")).alias("z"), "semblance").toLocalIterator():
        if r["lat"] is None or r["lon"] is None:
            continue
        geom = b"GP\x00\x01" + struct.pack("<i", 4326) + struct.pack("<BIddd", 1, 1001, r["lon"], r["lat"], r["z"] or 0.0)
        con.execute("insert into events (geom, uid, time, semblance) values (?, ?, ?, ?)", (geom, r["event_uid"], r["t"], r["semblance"]))
        n += 1
    con.commit()
    con.close()
    return n


def write_traces(segments: DataFrame, root: str) -> DataFrame:
    """Archive files of a day per channel, each written whole by one task; gives (path, n_records). Root is a shared folder."""
    day = F.floor(F.col("tmin_us") / 86_400_000_000)

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tmin_us")
        r = pdf.iloc[0]
        d = date(1970, 1, 1) + timedelta(days=int(r.day))
        name = f"{r.network}.{r.station}.{r.location}.{r.channel}.D.{d.year}.{d.timetuple().tm_yday:03d}"
        folder = Path(root, str(d.year), r.network, r.station, f"{r.channel}.D")
        folder.mkdir(parents=True, exist_ok=True)
        data = b"".join(encode(r.network, r.station, r.location, r.channel, int(t), float(h), np.array(x)) for t, h, x in zip(pdf.tmin_us, pdf.rate_hz, pdf.samples))
        tmp = folder / f".{name}.part"
        tmp.write_bytes(data)
        tmp.rename(folder / name)
        return pd.DataFrame({"path": [str(folder / name)], "n_records": [len(data) // 512]})

    return segments.withColumn("day", day).groupBy("network", "station", "location", "channel", "day").applyInPandas(write, "path string, n_records long")


def scaled(samples: str, factor: float = 1000.0):  # noqa: ANN201
    """Semblance samples as whole numbers for storage."""
    return F.transform(samples, lambda x: F.rint(x * factor).cast("int"))

