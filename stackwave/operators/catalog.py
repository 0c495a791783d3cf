"""Event catalogues: filters, repair, projections, updates, limits and statistics.

"First wins" always names its order, ties are broken by an id, and NaN counts
as missing where the text says so. Null bounds switch a filter off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stackwave.operators import ordered


def first_by(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each group of keys; null keys form a group."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def between_times(df: DataFrame, time: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Inclusive bounds, both hold; an empty result stays empty."""
    for bound, keep in ((start, lambda b: F.col(time) >= b), (end, lambda b: F.col(time) <= b)):
        if bound is not None:
            df = df.where(keep(F.lit(bound).cast("timestamp_ntz")))
    return df


def between_dates(df: DataFrame, time: str, first: str, last: str) -> DataFrame:
    """Dates; the last one counts whole, its following midnight included."""
    return df.where(F.col(time).between(F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz") + F.expr("interval 1 day")))


def ranges(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Inclusive ranges on columns; null and NaN are outside an active range."""
    for c, (lo, hi) in bounds.items():
        if lo is not None or hi is not None:
            df = df.where(~F.isnan(F.col(c).cast("double")))
        if lo is not None:
            df = df.where(F.col(c) >= lo)
        if hi is not None:
            df = df.where(F.col(c) <= hi)
    return df


def filter_limits(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: least and greatest of each column without NaN."""
    ok = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    return df.agg(*[f(ok(c)).alias(f"{c}_{n}") for c in columns for n, f in (("min", F.min), ("max", F.max))])


def repair(events: DataFrame, receivers: DataFrame, uid: str, seq: str) -> DataFrame:
    """Events with receivers, the first row of each uid."""
    return first_by(events.join(receivers.select(uid).distinct(), uid, "left_semi"), [uid], [seq])


def search_text(events: DataFrame, uid: str, time: str, text: str, n: int = 10) -> DataFrame:
    """The first n in time whose uid begins with text or whose time holds it."""
    hit = F.col(uid).startswith(text) | F.contains(F.date_format(time, "yyyy-MM-dd HH:mm:ss"), F.lit(text))
    return events.where(hit).orderBy(time, "seq").limit(n)


def upsert(base: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """base with the rows of changes (the last of each key) in place of those of equal key."""
    last = first_by(changes, [key], [F.desc(order)])
    return base.join(last.select(key), key, "left_anti").unionByName(last)


def top_by(df: DataFrame, by: str, where: Column | str, n: int, tie: str) -> DataFrame:
    """The n greatest of those that hold the condition; ties by least id."""
    return df.where(where).orderBy(F.desc_nulls_last(by), tie).limit(n)


def tail(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def number_rows(df: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """Global row numbers 1.. in the order given, nulls first, without one task sorting all rows."""
    return ordered.numbered(df, [], order, name)


def chunks(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """Adds chunk: 0.. in groups of size rows in order."""
    return number_rows(df, order, "_r").withColumn("chunk", F.floor((F.col("_r") - 1) / size).cast("long")).drop("_r")


def flat(events: DataFrame) -> DataFrame:
    """The flat export projection, NaN as null."""
    r = lambda c, d: F.round(F.when(~F.isnan(c), F.col(c)), d).alias(c)
    wkt = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon"), F.format_string("POINT Z(%.5f %.5f %.1f)", "lon", "lat", F.col("elevation") - F.col("depth")))
    return events.select("event_uid", "seq", "event_time", r("lat", 5), r("lon", 5), r("elevation", 1), r("depth", 1), r("semblance", 5), "n_stations", r("distance_border", 1), "in_bounds", wkt.alias("wkt"))


def statistics(events: DataFrame) -> DataFrame:
    ok = F.when(~F.isnan("semblance"), F.col("semblance"))
    return events.agg(F.count("*").alias("n_events"), F.max(ok).alias("max_semblance"), F.round(F.avg(ok), 6).alias("mean_semblance"), F.min("event_time").alias("first_time"), F.max("event_time").alias("last_time"))


def with_magnitude(events: DataFrame, magnitudes: DataFrame) -> DataFrame:
    """Magnitude, or the semblance in its place, with its kind."""
    j = events.join(magnitudes, "event_uid", "left")
    return j.withColumn("size", F.coalesce("average", "semblance")).withColumn("size_type", F.when(F.col("average").isNotNull(), F.lit("magnitude")).when(F.col("semblance").isNotNull(), F.lit("semblance")))


def replace_in_list(items: str, kind: str, new: Column) -> Column:
    """Array of structs with a type field: replace those of the type by new, at the end."""
    return F.concat(F.filter(F.col(items), lambda x: x["type"] != kind), F.array(new))


def number_in(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Row numbers from 1 within each group."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))
