"""Arrivals: pick counts, delays, RMS, pairs, nearest picks, azimuthal gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stackwave.functions import codes, geo
from stackwave.plans.dist import micros


def arrival(observed_only: bool = False) -> Column:
    """Observed time, or the modelled one in its place."""
    return F.col("observed_time") if observed_only else F.coalesce("observed_time", "model_time")


def delay_s() -> Column:
    """Observed minus modelled seconds; null if unobserved."""
    return F.round((micros("observed_time") - micros("model_time")) / 1e6, 6)


def pick_counts(picks: DataFrame, by: list[str]) -> DataFrame:
    return picks.groupBy(*by).agg(F.count("observed_time").alias("n_picks"), F.count("*").alias("n_arrivals"))


def phase_rms(picks: DataFrame) -> DataFrame:
    d = delay_s()
    return picks.where("observed_time is not null").groupBy("event_uid", "phase").agg(F.sqrt(F.avg(d * d)).alias("rms"))


def event_rms(picks: DataFrame) -> DataFrame:
    """The unweighted mean of the per-phase RMS values."""
    return phase_rms(picks).groupBy("event_uid").agg(F.round(F.avg("rms"), 9).alias("rms"))


def arrival_windows(picks: DataFrame) -> DataFrame:
    return picks.groupBy("event_uid", "network", "station", "location").agg(F.min(arrival()).alias("first_arrival"), F.max(arrival()).alias("last_arrival"))


def complete_receivers(picks: DataFrame) -> DataFrame:
    """Receivers with every phase of their event observed."""
    phases = picks.groupBy("event_uid").agg(F.count_distinct("phase").alias("n"))
    got = picks.where("observed_time is not null").groupBy("event_uid", "network", "station", "location").agg(F.count_distinct("phase").alias("k"))
    return got.join(phases, "event_uid").where("k = n").drop("k", "n")


def phase_pairs(picks: DataFrame) -> DataFrame:
    """Per receiver with both: P and S observed times and the lesser confidence; of repeats the first pick_id."""
    seen = picks.where("observed_time is not null").withColumn("kind", F.right("phase", F.lit(1))).where("kind in ('P', 'S')")
    key = ["event_uid", "network", "station", "location"]
    one = lambda k: F.min(F.when(F.col("kind") == k, F.struct("pick_id", "observed_time", "confidence")))
    both = seen.groupBy(*key).agg(one("P").alias("p"), one("S").alias("s")).where("p is not null and s is not null")
    return both.select(*key, F.col("p.observed_time").alias("p_time"), F.col("s.observed_time").alias("s_time"), F.least("p.confidence", "s.confidence").alias("weight"))


def nearest(left: DataFrame, right: DataFrame, keys: list[str], lt: str, rt: str, within_us: int, rid: str) -> DataFrame:
    """As-of join: for each left row the right row nearest in time (longs) within within_us; the earlier of equals, then the lesser rid.

    Time cells of twice the reach bound the join; each left row visits the two cells that its reach meets.
    """
    cell = 2 * within_us
    at = F.explode(F.array_distinct(F.array(F.floor((F.col(lt) - within_us) / cell), F.floor((F.col(lt) + within_us) / cell)))).alias("_cell")
    a = left.select("*", at)
    b = right.withColumn("_cell", F.floor(F.col(rt) / cell))
    j = a.join(b, [*keys, "_cell"]).withColumn("_d", F.abs(F.col(rt) - F.col(lt))).where(F.col("_d") <= within_us)
    cols = [c for c in left.columns]
    return j.groupBy(*cols).agg(F.min(F.struct("_d", rt, rid)).alias("x")).select(*cols, F.col(f"x.{rt}").alias(rt), F.col(f"x.{rid}").alias(rid))


def azimuthal_gap(az: DataFrame, by: str, azimuth: str) -> DataFrame:
    """(by, gap, coverage) of the azimuths in degrees; no azimuth at all gives a gap of 360."""
    a = az.withColumn("_z", F.pmod(F.col(azimuth), F.lit(360.0)))
    w = W.partitionBy(by)
    g = a.withColumn("_n", F.lead("_z").over(w.orderBy("_z"))).withColumn("_first", F.min("_z").over(w))
    gap = F.max(F.when(F.col("_z").isNotNull(), F.coalesce(F.col("_n"), F.col("_first") + 360.0) - F.col("_z")))
    return g.groupBy(by).agg(F.round(F.coalesce(gap, F.lit(360.0)), 6).alias("gap")).withColumn("coverage", F.round(360.0 - F.col("gap"), 6))


def receiver_azimuths(events: DataFrame, picks: DataFrame, stations: DataFrame) -> DataFrame:
    """One azimuth for each event and receiver with an observed arrival; stations unique by nsl."""
    seen = picks.where("observed_time is not null").select("event_uid", "nsl").distinct()
    j = events.select("event_uid", F.col("lat").alias("elat"), F.col("lon").alias("elon")).join(seen, "event_uid").join(stations.select("nsl", "lat", "lon"), "nsl")
    return j.select("event_uid", "nsl", geo.sphere_azimuth("elat", "elon", "lat", "lon").alias("azimuth"), geo.sphere_distance("elat", "elon", "lat", "lon").alias("distance"))


RECEIVER = ["event_uid", "network", "station", "location"]


def merge_receivers(picks: DataFrame) -> DataFrame:
    """One row a receiver with its arrivals as a map phase -> (model_time, observed_time, confidence, station_delay_s); of repeats the first pick_id."""
    first = picks.where("phase is not null").groupBy(*RECEIVER, "phase").agg(F.min_by(F.struct("model_time", "observed_time", "confidence", "station_delay_s"), "pick_id").alias("a"))
    return first.groupBy(*RECEIVER).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("phase", "a")))).alias("arrivals"))


def add_phase(receivers: DataFrame, more: DataFrame) -> DataFrame:
    """Full outer merge of two receiver tables: arrivals of both; those of `more` win."""
    m = more.withColumnRenamed("arrivals", "_more")
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"m.{c}")) for c in RECEIVER]
    j = receivers.alias("r").join(m.alias("m"), on[0] & on[1] & on[2] & on[3], "full")
    keep = F.map_filter("arrivals", lambda k, _: F.col("_more").isNull() | ~F.map_contains_key("_more", k))
    empty = lambda c: F.coalesce(F.col(c), F.when(F.lit(False), F.col(c)))
    both = F.when(F.col("arrivals").isNull(), F.col("_more")).when(F.col("_more").isNull(), empty("arrivals")).otherwise(F.map_concat(keep, F.col("_more")))
    return j.select(*[F.coalesce(f"r.{c}", f"m.{c}").alias(c) for c in RECEIVER], both.alias("arrivals"))


def one_or_error(rows: DataFrame, where: Column, what: str) -> Row:
    """The first row that holds a condition; an error where none does."""
    got = rows.where(where).limit(1).collect()
    if not got:
        raise KeyError(f"no {what}")
    return got[0]


def repeated_phases(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that name a phase more than once; a run demands that there are none."""
    return rows.groupBy(*key, "phase").agg(F.count("*").alias("n")).where("n > 1")


def within_epicentral(receivers: DataFrame, distance: str, least: float, most: float, nsl: list[str] | None = None) -> DataFrame:
    """Receivers at a distance in [least, most], and, where given, of codes that match."""
    ok = F.col(distance).between(least, most)
    if nsl is not None:
        hit = F.lit(False)
        for p in nsl:
            hit = hit | codes.nsl_matches(F.col("nsl"), p)
        ok = ok & hit
    return receivers.where(ok)
