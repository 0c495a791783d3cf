"""Queries over event catalogues, picks, stations and magnitudes, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwave.functions import attenuation, codes, geo
from stackwave.operators import analytics as an
from stackwave.operators import catalog as cat
from stackwave.operators import magnitude as mag
from stackwave.operators import ordered
from stackwave.operators import picks as pk
from stackwave.operators import stations as sta
from stackwave.plans.dist import micros, table
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


def ev(spark: SparkSession, d: str) -> DataFrame:
    """Detections, the first export of each event."""
    return cat.first_by(table(spark, d, "detections"), ["event_uid"], ["seq"])


EV = "ev as (select * exclude (_n) from (select *, row_number() over (partition by event_uid order by seq) as _n from detections) where _n = 1)"
NSL = "network || '.' || station || '.' || coalesce(location, '')"


def pks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "picks").withColumn("nsl", codes.nsl(F.col("network"), F.col("station"), F.col("location")))


def sts(spark: SparkSession, d: str) -> DataFrame:
    return sta.sanitise(table(spark, d, "stations").withColumn("nsl", codes.nsl(F.col("network"), F.col("station"), F.col("location"))), ["nsl"], "sta_idx")


STS = f"st as (select * exclude (_n) from (select *, {NSL} as nsl, row_number() over (partition by {NSL} order by sta_idx) as _n from stations where lat is not null and lon is not null and not isnan(lat) and not isnan(lon) and lat between -90 and 90 and lat <> 0 and lon <> 0) where _n = 1)"
PK = f"pk as (select *, {NSL} as nsl, (epoch_us(observed_time) - epoch_us(model_time)) / 1e6 as delay from picks)"

# -- catalogue filters and projections --------------------------------------------


@query("select seq, event_uid, event_time from detections where event_time >= timestamp '2023-03-01' and event_time <= timestamp '2023-09-01 12:00:00'")
def catalog_time_filter(spark: SparkSession, d: str) -> DataFrame:
    return cat.between_times(table(spark, d, "detections"), "event_time", "2023-03-01 00:00:00", "2023-09-01 12:00:00").select("seq", "event_uid", "event_time")


@query("select seq from detections where semblance between 0.3 and 0.8 and not isnan(semblance) and depth between 1000 and 8000 and not isnan(depth) and n_stations >= 3")
def catalog_range_filter(spark: SparkSession, d: str) -> DataFrame:
    return cat.ranges(table(spark, d, "detections"), {"semblance": (0.3, 0.8), "depth": (1000.0, 8000.0), "n_stations": (3, None)}).select("seq")


@query("select seq from detections where event_time between timestamp '2023-01-01' and timestamp '2023-06-30' + interval 1 day")
def catalog_date_filter(spark: SparkSession, d: str) -> DataFrame:
    return cat.between_dates(table(spark, d, "detections"), "event_time", "2023-01-01", "2023-06-30").select("seq")


@query("select min(case when not isnan(semblance) then semblance end) as semblance_min, max(case when not isnan(semblance) then semblance end) as semblance_max, min(case when not isnan(depth) then depth end) as depth_min, max(case when not isnan(depth) then depth end) as depth_max from detections")
def catalog_filter_reset(spark: SparkSession, d: str) -> DataFrame:
    return cat.filter_limits(table(spark, d, "detections"), ["semblance", "depth"])


@query(f"with {EV} select seq, event_uid from ev")
def catalog_dedup(spark: SparkSession, d: str) -> DataFrame:
    return ev(spark, d).select("seq", "event_uid")


@query(f"with {EV} select seq, event_uid from ev where event_uid in (select event_uid from picks)")
def catalog_repair(spark: SparkSession, d: str) -> DataFrame:
    return cat.repair(table(spark, d, "detections"), table(spark, d, "picks"), "event_uid", "seq").select("seq", "event_uid")


@query("select seq, event_uid from detections where starts_with(event_uid, '1d8') or strftime(event_time, '%Y-%m-%d %H:%M:%S') like '%2023-05-1%' order by event_time, seq limit 10")
def catalog_search_text(spark: SparkSession, d: str) -> DataFrame:
    return cat.search_text(table(spark, d, "detections"), "event_uid", "event_time", "2023-05-1").unionByName(cat.search_text(table(spark, d, "detections"), "event_uid", "event_time", "1d8")).dropDuplicates(["seq"]).orderBy("event_time", "seq").limit(10).select("seq", "event_uid")


@query(f"with {EV} select event_uid, seq, event_time, round(case when not isnan(lat) then lat end, 5) as lat, round(case when not isnan(lon) then lon end, 5) as lon, round(case when not isnan(elevation) then elevation end, 1) as elevation, round(case when not isnan(depth) then depth end, 1) as depth, round(case when not isnan(semblance) then semblance end, 5) as semblance, n_stations, round(case when not isnan(distance_border) then distance_border end, 1) as distance_border, in_bounds from ev")
def catalog_flat_export(spark: SparkSession, d: str) -> DataFrame:
    return cat.flat(ev(spark, d)).drop("wkt")


@query(f"with {EV} select event_uid, case when lat is not null and lon is not null and not isnan(lat) and not isnan(lon) then printf('POINT Z(%.5f %.5f %.1f)', lon, lat, elevation - depth) end as wkt from ev")
def catalog_wkt(spark: SparkSession, d: str) -> DataFrame:
    return cat.flat(ev(spark, d)).select("event_uid", "wkt")


@query("select count(*) as n_events, max(case when not isnan(semblance) then semblance end) as max_semblance, round(avg(case when not isnan(semblance) then semblance end), 6) as mean_semblance, min(event_time) as first_time, max(event_time) as last_time from detections")
def catalog_statistics(spark: SparkSession, d: str) -> DataFrame:
    return cat.statistics(table(spark, d, "detections"))


@query("select seq, event_uid, event_time from detections order by event_time desc, seq desc limit 1")
def catalog_latest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "detections").agg(F.max(F.struct("event_time", "seq", "event_uid")).alias("x")).select("x.seq", "x.event_uid", "x.event_time")


@query("select seq, semblance from detections where in_bounds and not isnan(semblance) and semblance is not null order by semblance desc, seq limit 25")
def catalog_top_semblance(spark: SparkSession, d: str) -> DataFrame:
    return cat.top_by(table(spark, d, "detections"), "semblance", "in_bounds and semblance is not null and not isnan(semblance)", 25, "seq").select("seq", "semblance")


@query("select seq, event_time from detections order by event_time desc, seq desc limit 1000")
def catalog_tail(spark: SparkSession, d: str) -> DataFrame:
    return cat.tail(table(spark, d, "detections"), ["event_time", "seq"], 1000).select("seq", "event_time")


@query("select seq, ((row_number() over (order by event_time, seq)) - 1) // 250 as chunk from detections")
def catalog_chunks(spark: SparkSession, d: str) -> DataFrame:
    return cat.chunks(table(spark, d, "detections").select("seq", "event_time"), ["event_time", "seq"], 250).select("seq", "chunk")


@query("select event_uid, max(seq) as seq from detections group by event_uid")
def catalog_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The first export as the base, all later exports as updates: the last row of each uid remains."""
    base = ev(spark, d)
    return cat.upsert(base, table(spark, d, "detections").join(base.select("seq"), "seq", "left_anti"), "event_uid", "seq").select("event_uid", "seq")


@query("select d.seq, d.event_uid, x.n as extra from detections d left join (select event_uid, count(*) as n from picks group by 1) x using (event_uid)")
def catalog_extra_columns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "detections").join(table(spark, d, "picks").groupBy("event_uid").agg(F.count("*").alias("extra")), "event_uid", "left").select("seq", "event_uid", "extra")


_NETMAG = "nm as (select event_uid, median(magnitude) as average from station_magnitudes where not isnan(magnitude) group by 1)"


@query(f"with {EV}, {_NETMAG} select event_uid, coalesce(average, semblance) as size, case when average is not null then 'magnitude' when semblance is not null then 'semblance' end as size_type from ev left join nm using (event_uid)")
def catalog_event_rows(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "station_magnitudes").where("magnitude is not null and not isnan(magnitude)").groupBy("event_uid").agg(F.median("magnitude").alias("average"))
    return cat.with_magnitude(ev(spark, d), m).select("event_uid", "size", "size_type")


@query(f"with {EV}, p as (select event_uid, count(observed_time) as n from picks group by 1), e as (select e.*, coalesce(n, 0) as n_picks from ev e left join p using (event_uid)) select count(*) as n_events, round((max(epoch_us(event_time)) - min(epoch_us(event_time))) / 86400e6, 6) as days, round(count(*) / ((max(epoch_us(event_time)) - min(epoch_us(event_time))) / 86400e6), 6) as per_day, median(n_picks)::double as median_picks, min(n_picks) as min_picks, max(n_picks) as max_picks from e")
def catalog_overview(spark: SparkSession, d: str) -> DataFrame:
    e = ev(spark, d).join(table(spark, d, "picks").groupBy("event_uid").agg(F.count("observed_time").alias("n_picks")), "event_uid", "left").fillna(0, ["n_picks"])
    days = (F.max(micros("event_time")) - F.min(micros("event_time"))) / 86_400e6
    one = e.agg(F.count("*").alias("n_events"), F.round(days, 6).alias("days"), F.round(F.count("*") / days, 6).alias("per_day"), F.min("n_picks").alias("min_picks"), F.max("n_picks").alias("max_picks"))
    return one.crossJoin(ordered.median(e, [], "n_picks", "median_picks"))  # one row each


@query(f"with {EV}, {_NETMAG}, {PK}, r as (select event_uid, avg(rms) as rms from (select event_uid, phase, sqrt(avg(delay * delay)) as rms from pk where observed_time is not null group by 1, 2) group by 1) select round(avg(case when not isnan(semblance) then semblance end), 6) as mean_semblance, count(average) as n_magnitudes, round(min(average), 6) as least_magnitude, round(max(average), 6) as most_magnitude, round(median(rms), 6) as median_rms, round(max(rms), 6) as most_rms from ev left join nm using (event_uid) left join r using (event_uid)")
def catalog_measures(spark: SparkSession, d: str) -> DataFrame:
    """Magnitudes, residuals and semblance of a catalogue."""
    m = table(spark, d, "station_magnitudes").where("magnitude is not null and not isnan(magnitude)").groupBy("event_uid").agg(F.median("magnitude").alias("average"))
    e = ev(spark, d).join(m, "event_uid", "left").join(pk.phase_rms(table(spark, d, "picks")).groupBy("event_uid").agg(F.avg("rms").alias("rms")), "event_uid", "left")
    one = e.agg(F.round(F.avg(an.real("semblance")), 6).alias("mean_semblance"), F.count("average").alias("n_magnitudes"), F.round(F.min("average"), 6).alias("least_magnitude"), F.round(F.max("average"), 6).alias("most_magnitude"), F.round(F.max("rms"), 6).alias("most_rms"))
    return one.crossJoin(ordered.median(e, [], "rms", "m").select(F.round("m", 6).alias("median_rms")))  # one row each


@query(f"with {EV}, {_NETMAG} select event_uid, seq, list_filter([case when average is not null then struct_pack(magnitude := 'LocalMagnitude', average := round(average, 6)) end], lambda x: x is not null)[1].average as magnitude, count(*) over () as n_rows from ev join nm using (event_uid)")
def catalog_with_magnitudes(spark: SparkSession, d: str) -> DataFrame:
    """The flat export's magnitude column: the first of an event's list; events without one are left out."""
    m = table(spark, d, "station_magnitudes").where("magnitude is not null and not isnan(magnitude)").groupBy("event_uid").agg(F.median("magnitude").alias("average"))
    e = ev(spark, d).join(m, "event_uid").withColumn("magnitudes", F.array(F.struct(F.lit("LocalMagnitude").alias("magnitude"), F.round("average", 6).alias("average"))))
    n = e.agg(F.count("*").alias("n_rows"))
    return e.crossJoin(F.broadcast(n)).select("event_uid", "seq", F.get("magnitudes", F.lit(0))["average"].alias("magnitude"), "n_rows")  # one row


@query(f"with {EV} select event_uid, 'event: ' || strftime(event_time, '%Y-%m-%d %H:%M:%S.%g') || ' ' || printf('%.5f', lat::varchar::decimal(18, 5)::double) || ' ' || printf('%.5f', lon::varchar::decimal(18, 5)::double) || ' ' || printf('%.1f', depth::varchar::decimal(18, 1)::double) || ' ' || printf('%.5f', semblance::varchar::decimal(18, 5)::double) as line from ev where not isnan(lat) and not isnan(lon) and not isnan(depth) and not isnan(semblance)")
def event_markers(spark: SparkSession, d: str) -> DataFrame:
    """Marker lines of the events with a place and a semblance."""
    e = ev(spark, d).where(" and ".join(f"{c} is not null and not isnan({c})" for c in ("lat", "lon", "depth", "semblance")))
    return sinks.event_markers(e)


@query(f"with {STS} select nsl, printf('%-6s', station) || printf('%8.4f', abs(lat)::varchar::decimal(18, 4)::double) || case when lat >= 0 then 'N' else 'S' end || ' ' || printf('%9.4f', abs(lon)::varchar::decimal(18, 4)::double) || case when lon >= 0 then 'E' else 'W' end || printf(' %5d', round(elevation - depth)::int) as line from st where not isnan(elevation - depth)")
def station_lines(spark: SparkSession, d: str) -> DataFrame:
    return sinks.station_lines(sts(spark, d).where("not isnan(elevation - depth) and elevation - depth is not null"))


@query("with g as (select nsl, min(epoch_us(starttime)) as s, max(epoch_us(endtime)) as e from seedlink_stations where nsl is not null and endtime is not null and starttime is not null group by 1) select min(s)::bigint as start_us, min(1700000000000000 - e)::bigint as delay_us, count(*) as n_online from g where 1700000000000000 - e <= 86400000000")
def stream_state(spark: SparkSession, d: str) -> DataFrame:
    """Start, delay and number of the online sources."""
    s = table(spark, d, "seedlink_stations").where("nsl is not null and endtime is not null and starttime is not null").select("nsl", micros("starttime").alias("s"), micros("endtime").alias("e"))
    return live.stream_state(s, "nsl", "s", "e", 1_700_000_000_000_000, 86_400_000_000)


@query("select seq, event_uid from detections where event_time < timestamp '2023-06-01'")
def catalog_resumed(spark: SparkSession, d: str) -> DataFrame:
    """What a run keeps that goes on from a time."""
    x = table(spark, d, "detections").withColumn("t", micros("event_time"))
    return live.resumed(x, "t", 1_685_577_600_000_000).select("seq", "event_uid")


@query(f"with {PK}, a as (select nsl, sum(confidence) as total, count(*) as n from pk where observed_time is not null and not isnan(confidence) group by 1) select nsl, n, round(total, 6) as total, row_number() over (order by round(total, 6) desc, nsl) as place from a")
def pick_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Stations by the summed confidence of their picks; one row a station."""
    p = pks(spark, d).where("observed_time is not null and not isnan(confidence)").groupBy("nsl").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 6).alias("total"))
    return ordered.numbered(p.withColumn("_m", -F.col("total")), [], ["_m", "nsl"], "place").select("nsl", "n", "total", "place")


@query("with c as (select event_uid, count(observed_time) as v from picks group by 1) select median(v)::double as median, count(*) as n from c")
def pick_count_median(spark: SparkSession, d: str) -> DataFrame:
    return ordered.quantiles(pk.pick_counts(table(spark, d, "picks"), ["event_uid"]), [], "n_picks", {"median": 0.5}).select("median", "n")


# -- histograms, rates, b-values ----------------------------------------------------

_SIZE = "sz as (select seq, event_time, magnitude as m from (select row_id as seq, event_time, magnitude from station_magnitudes where magnitude is not null and not isnan(magnitude)))"


def sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "station_magnitudes").where("magnitude is not null and not isnan(magnitude)").select(F.col("row_id").alias("seq"), "event_time", "nsl", F.col("magnitude").alias("m"))


@query("with w as (select case when d <= 1 / 24 then 60 when d <= 0.25 then 600 when d <= 2 then 3600 when d <= 14 then 21600 when d <= 60 then 43200 else 86400 end * 1000000::bigint as w from (select (max(epoch_us(event_time)) - min(epoch_us(event_time))) / 86400e6 as d from detections)), n as (select epoch_us(event_time) // w * w as b, count(*) as n from detections, w where event_time is not null group by 1), a as (select unnest(generate_series((select min(b) from n), (select max(b) from n), (select w from w))) as b) select a.b::bigint as bin_start_us, coalesce(n.n, 0) as n, (sum(coalesce(n.n, 0)) over (order by a.b))::bigint as cumulative from a left join n using (b)")
def event_rate(spark: SparkSession, d: str) -> DataFrame:
    """Events in bins whose width follows the catalogue's duration."""
    e = table(spark, d, "detections")
    span = e.agg((F.max(micros("event_time")) - F.min(micros("event_time"))).alias("us")).first()["us"]
    return an.event_rate(e, "event_time", an.rate_bin((span or 0) / 86_400e6))


@query(f"with {EV}, c as (select event_uid, count(observed_time) as v from picks group by 1), n as (select v, count(*) as n from c group by 1), a as (select unnest(generate_series(0, (select max(v) from n))) as v) select a.v as value, coalesce(n.n, 0) as n from a left join n using (v)")
def pick_count_histogram(spark: SparkSession, d: str) -> DataFrame:
    return an.counts_from_zero(pk.pick_counts(table(spark, d, "picks"), ["event_uid"]), "n_picks")


@query("with v as (select semblance as v from detections where semblance is not null and not isnan(semblance)), l as (select min(v) as lo, max(v) as hi from v), n as (select least(floor((v - lo) / (hi - lo) * 50), 49)::int as b, count(*) as n from v, l group by 1), a as (select unnest(generate_series(0, 49))::int as b) select a.b as bin, round(lo + (hi - lo) * a.b / 50, 9) as lower, coalesce(n.n, 0) as n from a cross join l left join n using (b)")
def semblance_histogram(spark: SparkSession, d: str) -> DataFrame:
    return an.equal_bins(table(spark, d, "detections"), "semblance", 50)


@query(f"with {_SIZE}, l as (select min(m) as lo from sz) select floor((m - lo) / 0.1 + 1e-9)::bigint as bin, count(*) as n, round(min(lo), 9) as lo from sz, l group by 1")
def magnitude_histogram(spark: SparkSession, d: str) -> DataFrame:
    return an.magnitude_bins(sizes(spark, d), "m")


@query(f"with {_SIZE}, l as (select min(m) as lo from sz), h as (select floor((m - lo) / 0.1 + 1e-9)::bigint as b, count(*) as n, min(lo) as lo from sz, l group by 1) select round(lo + b * 0.1, 6) as mc, n from h order by n desc, b limit 1")
def maximum_curvature(spark: SparkSession, d: str) -> DataFrame:
    return an.maximum_curvature(sizes(spark, d), "m")


@query(f"with {_SIZE}, x as (select nsl, magnitude - lag(magnitude) over (partition by nsl order by event_time, row_id) as diff from station_magnitudes where magnitude is not null and not isnan(magnitude)), a as (select nsl, count(*) as n_values, count(case when diff >= 0.5 then 1 end) as n, avg(case when diff >= 0.5 then diff - 0.5 end) as m from x group by 1) select nsl, n_values, n, round(case when n >= 10 and n_values >= 5 and m > 0 then 1 / (ln(10) * m) end, 6) as b, round(case when n >= 10 and n_values >= 5 and m > 0 then 1 / (ln(10) * m) / sqrt(n) end, 6) as error from a")
def b_value_by_station(spark: SparkSession, d: str) -> DataFrame:
    x = an.differences(sizes(spark, d), "m", ["event_time", "seq"], ["nsl"])
    return an.b_positive(x, ["nsl"], 0.5, 5, 10)


@query(f"with {EV}, {_NETMAG}, e as (select seq, event_time, average as m from ev join nm using (event_uid)), r as (select *, row_number() over (order by event_time, seq) as r, count(*) over () as t from e), w as (select r.*, unnest(generate_series(1, t - 499, 10)) as win from r), x as (select win, m, m - lag(m) over (partition by win order by event_time, seq) as diff from w where r between win and win + 499), a as (select win, count(*) as n_values, count(case when diff >= 0.5 then 1 end) as n, avg(case when diff >= 0.5 then diff - 0.5 end) as m from x group by 1) select win as \"window\", n_values, n, round(case when n >= 1 and m > 0 then 1 / (ln(10) * m) end, 6) as b, round(case when n >= 1 and m > 0 then 1 / (ln(10) * m) / sqrt(n) end, 6) as error from a")
def sliding_b_value(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "station_magnitudes").where("magnitude is not null and not isnan(magnitude)").groupBy("event_uid").agg(F.median("magnitude").alias("m"))
    e = ev(spark, d).join(m, "event_uid").select("seq", "event_time", "m")
    return an.b_positive(an.differences(an.sliding_windows(e, ["event_time", "seq"], 500, 10), "m", ["event_time", "seq"], ["window"], bounded=True), ["window"])


@query(f"with {EV}, {_NETMAG} select seq, round(log10(sum(pow(10, 1.5 * average + 9.1)) over (order by event_time, seq rows unbounded preceding)), 6) as log_moment from ev join nm using (event_uid)")
def cumulative_moment(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "station_magnitudes").where("magnitude is not null and not isnan(magnitude)").groupBy("event_uid").agg(F.median("magnitude").alias("m"))
    e = ev(spark, d).join(m, "event_uid").select("seq", "event_time", "m")
    return an.running_sum(e, F.pow(F.lit(10.0), 1.5 * F.col("m") + 9.1), ["event_time", "seq"], "moment").select("seq", F.round(F.log10("moment"), 6).alias("log_moment"))


@query("select round(median(semblance), 9) as med, round(median(abs(semblance - (select median(semblance) from detections where not isnan(semblance)))), 9) as mad from detections where semblance is not null and not isnan(semblance)")
def semblance_mad(spark: SparkSession, d: str) -> DataFrame:
    return an.mad(table(spark, d, "detections"), "semblance")


# -- picks ---------------------------------------------------------------------------


@query("select event_uid, phase, count(observed_time) as n_picks, count(*) as n_arrivals from picks group by 1, 2")
def picks_per_phase(spark: SparkSession, d: str) -> DataFrame:
    return pk.pick_counts(table(spark, d, "picks"), ["event_uid", "phase"])


@query("select pick_id, coalesce(observed_time, model_time) as arrival, round((epoch_us(observed_time) - epoch_us(model_time)) / 1e6, 6) as delay from picks")
def pick_delays(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "picks").select("pick_id", pk.arrival().alias("arrival"), pk.delay_s().alias("delay"))


@query(f"with {PK}, r as (select event_uid, phase, sqrt(avg(delay * delay)) as rms from pk where observed_time is not null group by 1, 2) select event_uid, round(avg(rms), 9) as rms from r group by 1")
def event_rms(spark: SparkSession, d: str) -> DataFrame:
    return pk.event_rms(table(spark, d, "picks"))


@query("select event_uid, network, station, location, min(coalesce(observed_time, model_time)) as first_arrival, max(coalesce(observed_time, model_time)) as last_arrival from picks group by all")
def receiver_windows(spark: SparkSession, d: str) -> DataFrame:
    return pk.arrival_windows(table(spark, d, "picks"))


@query("with n as (select event_uid, count(distinct phase) as n from picks group by 1) select event_uid, network, station, location from picks join n using (event_uid) where observed_time is not null group by event_uid, network, station, location, n having count(distinct phase) = n")
def complete_receivers(spark: SparkSession, d: str) -> DataFrame:
    return pk.complete_receivers(table(spark, d, "picks"))


_PAIRS = "pr as (select event_uid, network, station, location, first(observed_time order by pick_id) filter (where right(phase, 1) = 'P') as p_time, first(observed_time order by pick_id) filter (where right(phase, 1) = 'S') as s_time, first(confidence order by pick_id) filter (where right(phase, 1) = 'P') as pc, first(confidence order by pick_id) filter (where right(phase, 1) = 'S') as sc from picks where observed_time is not null group by all)"


@query(f"with {_PAIRS} select event_uid, network, station, location, p_time, s_time, least(pc, sc) as weight from pr where p_time is not null and s_time is not null")
def phase_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pk.phase_pairs(table(spark, d, "picks"))


@query(f"with {_PAIRS}, {EV}, x as (select event_uid, (epoch_us(s_time) - epoch_us(p_time)) / (epoch_us(p_time) - epoch_us(event_time)) + 1.0 as v, least(pc, sc) as w, station, network, location from pr join ev using (event_uid) where p_time is not null and s_time is not null and epoch_us(p_time) > epoch_us(event_time)), c as (select *, sum(w) over (partition by event_uid order by v, network, station, location rows unbounded preceding) as c, sum(w) over (partition by event_uid) as t, lead(v) over (partition by event_uid order by v, network, station, location) as nx from x where w > 0) select event_uid, round(first(case when c = t / 2 then (v + nx) / 2 else v end order by c), 6) as wmedian from c where c >= t / 2 group by 1")
def wadati_vp_vs(spark: SparkSession, d: str) -> DataFrame:
    x = pk.phase_pairs(table(spark, d, "picks")).join(ev(spark, d).select("event_uid", "event_time"), "event_uid")
    p, s, o = micros("p_time"), micros("s_time"), micros("event_time")
    x = x.where(p > o).withColumn("v", (s - p) / (p - o) + 1.0)
    return an.weighted_median(x, "v", "weight", ["event_uid"], ["network", "station", "location"])


@query(f"with {PK} select nsl, round(sum(case when right(phase, 1) = 'P' then confidence end), 6) as sum_p, round(median(case when right(phase, 1) = 'P' then confidence end), 6) as median_p, round(sum(case when right(phase, 1) = 'S' then confidence end), 6) as sum_s, round(median(case when right(phase, 1) = 'S' then confidence end), 6) as median_s from pk where observed_time is not null and not isnan(confidence) group by 1")
def pick_performance(spark: SparkSession, d: str) -> DataFrame:
    p = pks(spark, d).where("observed_time is not null and not isnan(confidence)").withColumn("k", F.right("phase", F.lit(1)))
    c = lambda k: F.when(F.col("k") == k, F.col("confidence"))
    out = p.groupBy("nsl").agg(*[F.round(F.sum(c(k)), 6).alias(f"sum_{k.lower()}") for k in "PS"])
    for k in "PS":
        out = out.join(ordered.median(p.where(F.col("k") == k), ["nsl"], "confidence", f"median_{k.lower()}"), "nsl", "left")
    return out.select("nsl", *[x for k in "ps" for x in (f"sum_{k}", F.round(f"median_{k}", 6).alias(f"median_{k}"))])


@query(f"with {PK}, v as (select * from pk where delay is not null), l as (select phase, quantile_cont(delay, 0.02) as lo, quantile_cont(delay, 0.98) as hi from v group by 1), u as (select nsl, median(abs(delay)) as all_abs from v group by 1) select v.nsl, v.phase, count(*) as n, round(median(v.delay), 9) as med, round(any_value(u.all_abs), 9) as unclipped from v join l using (phase) join u using (nsl) where v.delay between lo and hi group by 1, 2")
def residual_statistics(spark: SparkSession, d: str) -> DataFrame:
    v = pks(spark, d).withColumn("delay", pk.delay_s()).where("delay is not null")
    u = ordered.median(v.withColumn("delay", F.abs("delay")), ["nsl"], "delay", "unclipped")
    kept = ordered.quantiles(an.clipped_residuals(v, "delay", [], "phase"), ["nsl", "phase"], "delay", {"med": 0.5}, sized=v)
    return kept.join(u, "nsl").select("nsl", "phase", "n", F.round("med", 9).alias("med"), F.round("unclipped", 9).alias("unclipped"))


@query(f"with {PK}, v as (select * from pk where nsl = 'Q0.HUB00.00' and delay is not null), l as (select phase, quantile_cont(delay, 0.02) as lo, quantile_cont(delay, 0.98) as hi from v group by 1) select phase, count(*) as n, round(median(delay), 9) as med from v join l using (phase) where delay between lo and hi group by 1")
def station_residuals(spark: SparkSession, d: str) -> DataFrame:
    v = pks(spark, d).where("nsl = 'Q0.HUB00.00'").withColumn("delay", pk.delay_s()).where("delay is not null")
    kept = ordered.quantiles(an.clipped_residuals(v, "delay", [], "phase"), ["phase"], "delay", {"med": 0.5}, sized=v)
    return kept.select("phase", "n", F.round("med", 9).alias("med"))


@query(f"with {PK}, c as (select event_uid, count(distinct nsl) as n from pk group by 1) select median(n)::double as median_receivers, min(n) as least, max(n) as most from c")
def station_coverage(spark: SparkSession, d: str) -> DataFrame:
    n = pks(spark, d).groupBy("event_uid").agg(F.count_distinct("nsl").alias("n"))
    return n.agg(F.min("n").alias("least"), F.max("n").alias("most")).crossJoin(ordered.median(n, [], "n", "median_receivers"))  # one row each


@query("select distinct phase from picks where phase is not null")
def phases_available(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "picks").select("phase").where("phase is not null").distinct()


@query("with a as (select pick_id, network, station, location, epoch_us(model_time) as t from picks where phase = 'cake:P'), b as (select pick_id as other_id, network, station, location, epoch_us(observed_time) as o from picks where phase = 'cake:S' and observed_time is not null), j as (select a.*, other_id, o, row_number() over (partition by pick_id order by abs(o - t), o, other_id) as k from a join b on a.network = b.network and a.station = b.station and a.location is not distinct from b.location and abs(o - t) <= 8000000) select pick_id, o, other_id from j where k = 1")
def nearest_pick(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "picks").withColumn("location", F.coalesce("location", F.lit("")))
    a = p.where("phase = 'cake:P'").select("pick_id", "network", "station", "location", micros("model_time").alias("t"))
    b = p.where("phase = 'cake:S' and observed_time is not null").select(F.col("pick_id").alias("other_id"), "network", "station", "location", micros("observed_time").alias("o"))
    return pk.nearest(a, b, ["network", "station", "location"], "t", "o", 8_000_000, "other_id").select("pick_id", "o", "other_id")


_AZ = f"{EV}, {PK}, {STS}, az as (select distinct e.event_uid, p.nsl, e.lat as a, e.lon as o, s.lat as b, s.lon as u from ev e join pk p using (event_uid) join st s using (nsl) where p.observed_time is not null), z as (select event_uid, nsl, degrees(atan2(sin(radians(u - o)) * cos(radians(b)), cos(radians(a)) * sin(radians(b)) - sin(radians(a)) * cos(radians(b)) * cos(radians(u - o)))) as azimuth from az where a is not null and o is not null and not isnan(a) and not isnan(o))"


@query(f"with {_AZ}, p as (select event_uid, azimuth - 360 * floor(azimuth / 360) as z from z), q as (select event_uid, coalesce(lead(z) over (partition by event_uid order by z), min(z) over (partition by event_uid) + 360) - z as gap from p) select event_uid, round(coalesce(max(gap), 360), 6) as gap, round(360 - round(coalesce(max(gap), 360), 6), 6) as coverage from q group by 1")
def azimuthal_gap(spark: SparkSession, d: str) -> DataFrame:
    e = ev(spark, d).where("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)")
    return pk.azimuthal_gap(pk.receiver_azimuths(e, pks(spark, d), sts(spark, d)), "event_uid", "azimuth")


@query(f"with {_AZ} select event_uid, nsl, round(azimuth, 6) as azimuth from z")
def receiver_azimuths(spark: SparkSession, d: str) -> DataFrame:
    e = ev(spark, d).where("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)")
    return pk.receiver_azimuths(e, pks(spark, d), sts(spark, d)).select("event_uid", "nsl", F.round("azimuth", 6).alias("azimuth"))


@query("select pick_id, case when confidence >= 1 or confidence >= 0.8 then 0 when confidence >= 0.6 then 1 when confidence >= 0.4 then 2 when confidence >= 0 then 3 end as quality from picks where observed_time is not null and confidence > 0.2 and not isnan(confidence)")
def pick_export_quality(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "picks").where("observed_time is not null and confidence > 0.2 and not isnan(confidence)")
    return p.select("pick_id", codes.quality_class(F.col("confidence")).alias("quality"))


@query(f"with {EV}, p as (select {NSL} as nsl, phase, strftime(event_time, '%Y-%m') as month, confidence from picks join ev using (event_uid) where observed_time is not null and confidence is not null and not isnan(confidence)) select nsl, phase, month, count(*) as n, round(median(confidence), 6) as confidence from p group by 1, 2, 3")
def confidence_over_time(spark: SparkSession, d: str) -> DataFrame:
    """Median confidence of each station's picks by phase and month."""
    return an.confidence_over_time(pks(spark, d), ev(spark, d))


@query(f"with {EV}, t as (select event_uid, network, station, location, min(case when right(phase, 1) = 'P' then epoch_us(model_time) - epoch_us(event_time) end) as p, min(case when right(phase, 1) = 'S' then epoch_us(model_time) - epoch_us(event_time) end) as s from picks join ev using (event_uid) group by all) select event_uid, round(median(s / p), 6) as ratio from t where p > 0 and s is not null group by 1")
def model_wadati(spark: SparkSession, d: str) -> DataFrame:
    """The modelled ratio of S to P travel times of each event."""
    return an.model_wadati(table(spark, d, "picks"), ev(spark, d))


@query("with f as (select *, row_number() over (partition by event_uid, network, station, location, phase order by pick_id) as n from picks where phase is not null) select event_uid, network, station, location, count(*) as n_phases, count(observed_time) as n_picks, any_value(model_time) filter (where phase = 'cake:P') as p_model from f where n = 1 group by event_uid, network, station, location")
def receivers_merged(spark: SparkSession, d: str) -> DataFrame:
    """Receivers of two phases, each read apart, merged to one row a receiver."""
    p = table(spark, d, "picks")
    r = pk.add_phase(pk.merge_receivers(p.where("phase like '%P'")), pk.merge_receivers(p.where("phase not like '%P'")))
    a = F.map_values("arrivals")
    return r.select(*pk.RECEIVER, F.size("arrivals").cast("long").alias("n_phases"), F.size(F.filter(a, lambda x: x["observed_time"].isNotNull())).cast("long").alias("n_picks"), F.col("arrivals")["cake:P"]["model_time"].alias("p_model"))


@query(f"with {PK} select event_uid, nsl, count(distinct case when observed_time is not null then phase end) as n_picks from pk group by 1, 2")
def picks_per_receiver(spark: SparkSession, d: str) -> DataFrame:
    return pks(spark, d).groupBy("event_uid", "nsl").agg(F.count_distinct(F.when(F.col("observed_time").isNotNull(), F.col("phase"))).alias("n_picks"))


@query("select seq, event_uid, semblance, round(sum(coalesce(case when not isnan(semblance) then semblance end, 0)) over (order by event_time, seq rows unbounded preceding), 5) as cumulative from detections")
def cumulative_semblance(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "detections").select("seq", "event_uid", "event_time", "semblance")
    return an.running_sum(x, an.real("semblance"), ["event_time", "seq"], "cumulative").select("seq", "event_uid", "semblance", F.round("cumulative", 5).alias("cumulative"))


@query("select event_uid, phase, network, station, coalesce(location, '') as location, count(*) as n from picks group by all having count(*) > 1")
def phases_repeated(spark: SparkSession, d: str) -> DataFrame:
    """Receivers that name a phase more than once."""
    return pk.repeated_phases(table(spark, d, "picks").withColumn("location", F.coalesce("location", F.lit(""))), pk.RECEIVER)


@query(f"with {_AZ}, d as (select event_uid, nsl, 2 * 6371000 * asin(sqrt(least(1, pow(sin((radians(a) - radians(b)) / 2), 2) + cos(radians(a)) * cos(radians(b)) * pow(sin(radians(o - u) / 2), 2)))) as dist from az where a is not null and o is not null and not isnan(a) and not isnan(o)) select event_uid, nsl from d where dist between 1000 and 100000 and nsl like 'Q0.HUB%'")
def receivers_in_range(spark: SparkSession, d: str) -> DataFrame:
    """Receivers of a code pattern between 1 and 100 km from their event."""
    e = ev(spark, d).where("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)")
    return pk.within_epicentral(pk.receiver_azimuths(e, pks(spark, d), sts(spark, d)), "distance", 1_000.0, 100_000.0, ["Q0.HUB*"]).select("event_uid", "nsl")


@query("select seq, event_uid from detections where semblance >= 0.9 and not isnan(semblance)")
def magnitude_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Events whose size reaches a threshold."""
    return live.magnitude_alerts(table(spark, d, "detections"), "semblance", 0.9).select("seq", "event_uid")


@query("with g as (select nsl, sum(epoch_us(endtime) - epoch_us(starttime)) as a, max(epoch_us(polled_at)) - min(epoch_us(polled_at)) as b from seedlink_stations where nsl is not null and endtime > starttime and polled_at is not null group by 1) select nsl, round(case when b > 0 then a / b end, 6) as fill_rate, coalesce(case when b > 0 then a / b end > 2, false) as backfill from g")
def stream_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Sources whose data came in faster than it was written."""
    x = table(spark, d, "seedlink_stations").where("nsl is not null and endtime > starttime and polled_at is not null").select("nsl", micros("starttime").alias("s"), micros("endtime").alias("e"), micros("polled_at").alias("r"))
    return live.backfilled(x, "nsl", "s", "e", "r")


# -- stations -------------------------------------------------------------------------


@query(f"with {STS} select sta_idx, nsl from st")
def stations_sanitised(spark: SparkSession, d: str) -> DataFrame:
    return sts(spark, d).select("sta_idx", "nsl")


@query(f"with {STS} select sta_idx from st where not (network = 'Q0' and station like 'HUB%') and not (network = 'W4')")
def stations_blacklist(spark: SparkSession, d: str) -> DataFrame:
    return sta.blacklist(sts(spark, d), ["Q0.HUB*", "W4"]).select("sta_idx")


@query(f"with {STS} select sta_idx from st where 2 * 6371000 * asin(sqrt(least(1, pow(sin((radians(lat) - radians(12.5)) / 2), 2) + cos(radians(lat)) * cos(radians(12.5)) * pow(sin(radians(lon - 44.5) / 2), 2)))) <= 300000")
def stations_within(spark: SparkSession, d: str) -> DataFrame:
    return sta.within(sts(spark, d), 12.5, 44.5, 300_000.0).select("sta_idx")


@query(f"with {STS} select count(*) as n, count(distinct network) as networks, round(avg(lat), 6) as lat, round(avg(lon), 6) as lon, round(avg(elevation), 6) as elevation from st")
def station_centroid(spark: SparkSession, d: str) -> DataFrame:
    return sta.centroid(sts(spark, d))


@query(f"with {STS}, {PK} select sta_idx from st where nsl in (select nsl from pk)")
def stations_with_data(spark: SparkSession, d: str) -> DataFrame:
    return sts(spark, d).join(pks(spark, d).select("nsl").distinct(), "nsl", "left_semi").select("sta_idx")


@query(f"with {STS}, {PK} select distinct nsl from pk where nsl not in (select nsl from st)")
def stations_missing(spark: SparkSession, d: str) -> DataFrame:
    return pks(spark, d).select("nsl").distinct().join(sts(spark, d), "nsl", "left_anti")


@query(f"with {STS}, s as (select nsl, network, lat, lon from st) select a.network, round(avg(2 * 6371000 * asin(sqrt(least(1, pow(sin((radians(a.lat) - radians(b.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(a.lon - b.lon) / 2), 2))))) / 1000, 3) as mean_km from s a join s b on a.network = b.network and a.nsl <> b.nsl group by 1")
def mean_station_distance(spark: SparkSession, d: str) -> DataFrame:
    return sta.mean_distance(sts(spark, d), "network")


@query(f"with {STS} select nsl, round(lat, 3) as lat, round(lon, 3) as lon, round(elevation - depth, 1) as eff_elevation, printf('%11.7f', abs(lat)) || case when lat >= 0 then 'N' else 'S' end as lat_text from st")
def station_table(spark: SparkSession, d: str) -> DataFrame:
    return sts(spark, d).select("nsl", F.round("lat", 3).alias("lat"), F.round("lon", 3).alias("lon"), F.round(geo.effective_elevation(), 1).alias("eff_elevation"), codes.hemisphere(F.col("lat"), "N", "S", 11, 7).alias("lat_text"))


@query(f"select sta_idx, {NSL} as nsl, len(network) <= 2 and len(station) <= 5 and len(coalesce(location, '')) <= 2 as valid from stations")
def station_codes(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "stations")
    n = codes.nsl_parse(codes.nsl(F.col("network"), F.col("station"), F.col("location")))
    s = s.withColumn("n", n)
    return s.select("sta_idx", codes.nsl(F.col("n.network"), F.col("n.station"), F.col("n.location")).alias("nsl"), codes.nsl_valid(F.col("network"), F.col("station"), F.col("location")).alias("valid"))


# -- magnitudes --------------------------------------------------------------------


@query("with v as (select event_uid, magnitude as m, error as e from station_magnitudes where flag = 'valid' and magnitude is not null and not isnan(magnitude)), s as (select *, avg(m) over (partition by event_uid) as mu, stddev_pop(m) over (partition by event_uid) as sd from v), k as (select * from s where abs(m - mu) <= 2 * sd), c as (select event_uid, median(m) as med, count(*) as n, median(e) as me from k group by 1 having count(*) >= 3) select event_uid, any_value(c.n) as n, round(any_value(c.med), 6) as average, round(sqrt(pow(median(abs(k.m - c.med)) / sqrt(any_value(c.n)), 2) + pow(any_value(c.me) / sqrt(any_value(c.n)), 2)), 6) as error from k join c using (event_uid) group by 1")
def network_magnitude(spark: SparkSession, d: str) -> DataFrame:
    return mag.network_magnitude(table(spark, d, "station_magnitudes"), 2.0, 3)


@query("with v as (select event_uid, nsl, magnitude as m from station_magnitudes where magnitude is not null and not isnan(magnitude) and not isinf(magnitude)), n as (select event_uid, median(m) as avg_m from v group by 1) select nsl, count(*) as n, round(median(avg_m - m), 6) as residual from v join n using (event_uid) group by 1 having count(*) >= 5")
def station_magnitude_residuals(spark: SparkSession, d: str) -> DataFrame:
    return mag.station_residuals(table(spark, d, "station_magnitudes"), 5)


def _terms() -> str:
    r, e, mm = "(distance_hypo / 1000)", "(distance_epi / 1000)", "log10(peak_amp * 1000)"
    at17 = lambda k, g: f"{k} * log10({r} / 17) + {g} * ({r} - 17) + 2"
    z = f"(1.11366 * log10({r}) - 2.00574)"
    cisn = f"1.11 * log10({r}) + 0.00189 * {r} + 0.591 + " + " + ".join(f"({t}) * cos({i} * acos({z}))" for i, t in enumerate(attenuation.TCHEBYCHEV, 1))
    t = {
        "WebnetWesternBohemia": (f"{r} between 0 and 100", "log10(peak_amp * 1e6)", f"2.1 * log10({r}) - log10(pi()) - 1.7"),
        "IaspeiSouthernCalifornia": (f"{r} between 10 and 700", "log10(peak_amp * 1e9 / 2080)", f"1.11 * log10({r}) + 0.00189 * {r} - 2.09"),
        "SouthernCalifornia": (f"{r} between 10 and 700", mm, f"1.11 * log10({r} / 100) + 0.00189 * ({r} - 100) + 3"),
        "CentralCalifornia": (f"{e} between 0 and 400", mm, f"log10({r}) + 0.00301 * {r} + 0.7"),
        "CaliforniaIntegratedSeismicNetwork": (f"{e} between 0 and 450 and abs({z}) <= 1", mm, cisn),
        "EasternNorthAmerica": (f"{e} between 100 and 800", mm, f"1.55 * log10({e}) - 0.22"),
        "ArgentiereGlacier": (f"{r} between 0 and 100", mm, f"-6.0 * log10({r}) - 1.2"),
        "Albania": (f"{e} between 10 and 600", mm, f"1.6627 * log10({e}) + 0.0008 * {e} - 0.433"),
        "SouthWestGermany": (f"{r} between 10 and 1000", mm, f"1.11 * log10({r}) + 0.00095 * {r} + 0.69"),
        "SouthAustralia": (f"{e} between 40 and 700", mm, f"1.1 * log10({e}) + 0.0013 * {e} + 0.7"),
        "NorwayFennoscandia": (f"{r} between 0 and 1500", mm, f"0.91 * log10({r}) + 0.00087 * {r} + 1.01"),
        "IcelandAskja": (f"{r} between 0 and 150", mm, at17(1.4406, 0.003)),
        "IcelandBardabunga": (f"{r} between 0 and 150", mm, at17(1.2534, -0.0032)),
        "IcelandAskjaBardabungaCombined": (f"{r} between 0 and 150", mm, at17(1.1999, -0.0016)),
        "IcelandReykjanes": (f"{r} between 0 and 40", mm, at17(0.6902, 0.0318)),
        "Azores": (f"{e} between 10 and 800", mm, f"0.89 * log10({e} / 100) + 0.00256 * ({e} - 100) + 3"),
        "ArgentinaVolcanoes": (f"{e} between 0 and 100", mm, f"2.76 * log10({e}) - 2.48"),
        "NetherlandsGroningen": (f"{e} between 0 and 80", mm, f"1.33 * log10({r}) + 0.00139 * {r} + 0.424"),
        "CampiFlegrei": (f"{e} between 0.2 and 8", mm, f"0.95 * log10({r}) + 0.09 * {r} - 0.1"),
    }
    return " ".join(f"when '{k}' then case when {g} then {a} + {f} end" for k, (g, a, f) in t.items())


@query(f"select row_id, round(case when peak_amp > 0 and r > 0 and e > 0 then case model {_terms()} end end, 6) as m from (select *, distance_hypo / 1000 as r, distance_epi / 1000 as e from station_magnitudes where not isinf(peak_amp) and not isnan(peak_amp))")
def attenuation_magnitudes(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "station_magnitudes").where("peak_amp is not null and not isnan(peak_amp) and abs(peak_amp) < double('Infinity')")
    return t.select("row_id", F.round(attenuation.magnitude(F.col("model"), F.col("peak_amp"), F.col("distance_hypo"), F.col("distance_epi")), 6).alias("m"))


@query(f"select row_id, model, round(case when peak_amp > 0 and r > 0 and e > 0 then case model {_terms()} end end, 6) as m from (select row_id, peak_amp, distance_hypo, distance_epi, distance_hypo / 1000 as r, distance_epi / 1000 as e, unnest([{', '.join(repr(k) for k in attenuation.MODELS if k != 'CaliforniaIntegratedSeismicNetwork')}]) as model from station_magnitudes where not isinf(peak_amp) and not isnan(peak_amp))")
def attenuation_of_every_model(spark: SparkSession, d: str) -> DataFrame:
    """Every reading by every model but the one whose series holds on a part of distances only."""
    t = table(spark, d, "station_magnitudes").where("peak_amp is not null and not isnan(peak_amp) and abs(peak_amp) < double('Infinity')")
    each = F.array(*[F.struct(F.lit(n).alias("model"), F.round(attenuation.magnitude_of(m, F.col("peak_amp"), F.col("distance_hypo"), F.col("distance_epi")), 6).alias("m")) for n, m in attenuation.MODELS.items() if n != "CaliforniaIntegratedSeismicNetwork"])
    return t.select("row_id", F.explode(each).alias("x")).select("row_id", "x.model", "x.m")


MODEL_RULES = [("Q0.HUB*", "SouthWestGermany"), ("W?", "IcelandAskja"), ("*", "Albania")]


@query(f"select row_id, case when nsl like 'Q0.HUB%' then 'SouthWestGermany' when regexp_matches(nsl, '^W.[.]') then 'IcelandAskja' else 'Albania' end as model from station_magnitudes where nsl is not null")
def model_of_code(spark: SparkSession, d: str) -> DataFrame:
    """The attenuation model of each reading's code: the first pattern that matches."""
    t = table(spark, d, "station_magnitudes").where("nsl is not null")
    return t.select("row_id", attenuation.model_by_code(F.col("nsl"), MODEL_RULES).alias("model"))


@query("with v as (select event_uid, magnitude as m from station_magnitudes where magnitude is not null and not isnan(magnitude)), s as (select *, avg(m) over (partition by event_uid) as mu, stddev_pop(m) over (partition by event_uid) as sd from v), k as (select * from s where abs(m - mu) <= 3 * sd), c as (select event_uid, count(*) as n, median(m) as med from k group by 1) select event_uid, any_value(n) as n, round(any_value(med), 6) as average, round(median(abs(m - med)), 6) as error from k join c using (event_uid) group by 1")
def network_moment(spark: SparkSession, d: str) -> DataFrame:
    """The moment magnitude's network value: median and its absolute deviation."""
    return mag.network_moment(table(spark, d, "station_magnitudes"))


@query("with e as (select event_uid, magnitude_type as k, median(magnitude) as a from station_magnitudes where magnitude is not null and not isnan(magnitude) group by 1, 2), p as (select event_uid, max(case when starts_with(k, 'Local') then a end) as l, max(case when starts_with(k, 'Moment') then a end) as m from e group by 1) select event_uid, l as local, m as moment, round(l - m, 6) as difference from p where l is not null and m is not null")
def local_against_moment(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "station_magnitudes").where("magnitude is not null and not isnan(magnitude)")
    return mag.local_and_moment(v.groupBy("event_uid", F.col("magnitude_type").alias("magnitude")).agg(F.median("magnitude").alias("average")))


@query("select event_uid, nsl, magnitude, round(case when snr > 0 and hi > lo then (ln(snr) - lo) / (hi - lo) end, 6) as snr_share, round(mean, 6) as mean, round(med, 6) as med from (select *, min(case when snr > 0 and not isinf(snr) then ln(snr) end) over w as lo, max(case when snr > 0 and not isinf(snr) then ln(snr) end) over w as hi, avg(magnitude) over w as mean, median(magnitude) over w as med from station_magnitudes where magnitude is not null and not isnan(magnitude) and not isnan(snr) and not isinf(snr) window w as (partition by event_uid))")
def event_station_magnitudes(spark: SparkSession, d: str) -> DataFrame:
    """Station magnitudes of each event with the place of their log ratio to noise in the event's range, the mean and the median."""
    t = table(spark, d, "station_magnitudes").where("magnitude is not null and not isnan(magnitude) and snr is not null and not isnan(snr) and abs(snr) < double('Infinity')")
    return an.event_magnitudes(t)


@query("with j as (select q.amp_id, q.collection_id as q_id, s.peak_horizontal as v, row_number() over (partition by q.amp_id order by abs(s.distance_epi - q.distance_epi), s.amp_id) as n from site_amplitudes q join site_amplitudes s on s.collection_id = q.collection_id where s.peak_horizontal is not null and not isnan(s.peak_horizontal)), m as (select *, median(v) over (partition by amp_id) as med from j where n <= 25) select amp_id, any_value(q_id) as q_id, count(*) as n, round(log10(avg(v)), 6) as log_mean, round(log10(any_value(med)), 6) as log_median, round(median(abs(v - med)) / any_value(med), 6) as rel_mad from m group by 1")
def modelled_amplitudes(spark: SparkSession, d: str) -> DataFrame:
    """Mean, median and spread of the 25 nearest of its collection, for every amplitude."""
    return mag.modelled_for_all(table(spark, d, "site_amplitudes"), "peak_horizontal", 25)
