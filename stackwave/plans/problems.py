"""The queries of the general large-scale problems p1, p3, p4 and p5 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwave.operators import anomalies, intervals, proximity, timestamps
from stackwave.plans.dist import micros, table

QUERIES = {}
SQL = {}
NSL = "concat_ws('.', network, station, coalesce(location, ''))"


def query(sql: str | None = None):
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""
with s as (select sta_idx, network || '.' || station || '.' || coalesce(location, '') as nsl, radians(lat) as la, radians(lon) as lo, lat, (lon + 540) - 360 * floor((lon + 540) / 360) - 180 as x
           from stations where lat between -90 and 90 and lon is not null and isfinite(lon)),
d as (select seq, radians(lat) as la, radians(lon) as lo from detections where lat between -90 and 90 and lon is not null and isfinite(lon)),
e as (select zone_id, unnest(ring_lon[:-2]) as ax, unnest(ring_lat[:-2]) as ay, unnest(ring_lon[2:]) as bx, unnest(ring_lat[2:]) as by_ from zones),
t as (select zone_id, ax + turn as ax, ay, bx + turn as bx, by_ from e, (select unnest([-360, 0, 360]) as turn))
select a.sta_idx::bigint as low_id, b.sta_idx::bigint as high_id from s a join s b on a.sta_idx < b.sta_idx and a.nsl <> b.nsl
where 2 * 6371000 * asin(sqrt(pow(sin((a.la - b.la) / 2), 2) + cos(a.la) * cos(b.la) * pow(sin((a.lo - b.lo) / 2), 2))) <= 500
union all
select s.sta_idx::bigint, d.seq from s, d
where abs(s.la - d.la) < 0.0002 and 2 * 6371000 * asin(sqrt(pow(sin((s.la - d.la) / 2), 2) + cos(s.la) * cos(d.la) * pow(sin((s.lo - d.lo) / 2), 2))) <= 1000
union all
select s.sta_idx::bigint, t.zone_id from s join t on (t.ax <= s.x) <> (t.bx <= s.x) and s.lat < t.ay + (t.by_ - t.ay) * (s.x - t.ax) / (t.bx - t.ax)
group by 1, 2 having count(*) % 2 = 1
""")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations near stations, detections near stations, zones around stations."""
    stations = table(spark, sf_dir, "stations").withColumn("nsl", F.expr(NSL))
    at = proximity.unit_vectors(stations, "sta_idx", "lat", "lon", [F.col("nsl")])
    near = proximity.near_pairs(at, at, 500.0, once=True, apart="nsl")
    seen = proximity.near_pairs(at, proximity.unit_vectors(table(spark, sf_dir, "detections"), "seq", "lat", "lon"), 1000.0)
    inside = proximity.in_regions(stations, "sta_idx", "lat", "lon", table(spark, sf_dir, "zones"), "zone_id", "ring_lon", "ring_lat")
    pairs = [x.select(F.col(x.columns[i]).alias("low_id"), F.col(x.columns[j]).alias("high_id")) for x, i, j in ((near, 0, 1), (seen, 0, 1), (inside, 0, 1))]
    return pairs[0].unionByName(pairs[1]).unionByName(pairs[2])


_VALID = "v as (select distinct nsl, epoch_us(starttime) as s, epoch_us(endtime) as e from seedlink_stations where endtime > starttime and nsl is not null), m as (select nsl, s, e, max(e) over (partition by nsl order by s, e rows between unbounded preceding and 1 preceding) as pe from v)"


@query(f"with {_VALID} select nsl, pe as gap_start_us, s as gap_end_us from m where s > pe")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gaps in the coverage of each nsl."""
    df = table(spark, sf_dir, "seedlink_stations").select("nsl", micros("starttime").alias("s"), micros("endtime").alias("e"))
    return intervals.coverage_gaps(df, "nsl", "s", "e").toDF("nsl", "gap_start_us", "gap_end_us")


@query(f"with {_VALID}, b as (select *, sum(case when pe is null or s > pe then 1 else 0 end) over (partition by nsl order by s, e rows unbounded preceding) as k from m) select nsl, min(s) as period_start_us, max(e) as period_end_us from b group by nsl, k")
def p3_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The continuous periods of coverage of each nsl."""
    df = table(spark, sf_dir, "seedlink_stations").select("nsl", micros("starttime").alias("s"), micros("endtime").alias("e"))
    return intervals.coverage_periods(df, "nsl", "s", "e").toDF("nsl", "period_start_us", "period_end_us")


# The definition in SQL. Stations: beyond the first gap of a factor of ten on either side of a source's median. Amplitudes: a decade from
# the median of those near in distance, then checked against the near ones that aren't.
_ANOMALIES = """
with raw as (
  select 'peak_amp' as field, row_id, nsl as source, event_time as t, case when not isnan(peak_amp) then peak_amp end as v, true as zero, null as d, false as below from station_magnitudes
  union all select 'snr', row_id, nsl, event_time, case when not isnan(snr) and snr <> 0 then snr end, false, null, false from station_magnitudes
  union all select 'peak_absolute', amp_id, collection_id::varchar, timestamp '1970-01-01' + to_microseconds(amp_id), case when not isnan(peak_absolute) then peak_absolute end, true,
    case when distance_epi > 0 and distance_epi < 1e30 then distance_epi end, coalesce(peak_absolute < case when not isnan(peak_horizontal) then peak_horizontal end, false) or coalesce(peak_absolute < case when not isnan(peak_vertical) then peak_vertical end, false) from site_amplitudes),
r as (select *, v is not null and (v < 0 or v >= 1e30 or (zero and v = 0) or below) as bad from raw),
tm as (select field, source, t, row_number() over (partition by field, source order by t) as k from (select distinct field, source, t from r where source is not null and t is not null)),
vk as (select distinct r.field, r.source, v, tm.k from r join tm on r.field = tm.field and r.source = tm.source and r.t = tm.t where v is not null),
isl as (select *, k - row_number() over (partition by field, source, v order by k) as g from vk),
runs as (select field, source, v, g, min(k) as a, max(k) as b from isl group by all having count(*) >= 5),
m as (select r.*, tm.k, exists (select 1 from runs u where u.field = r.field and u.source = r.source and u.v = r.v and tm.k between u.a and u.b) as stuck, count(*) over (partition by r.field, r.source) as n from r join tm on r.field = tm.field and r.source = tm.source and r.t = tm.t),
snd as (select * from m where v is not null and not bad and not stuck and n >= 30),
st as (select *, row_number() over w as i, count(*) over (partition by field, source) as c, lag(v) over w as p, lead(v) over w as q from snd where field <> 'peak_absolute' window w as (partition by field, source order by v, row_id)),
lim as (select field, source, min(case when i > c / 2 and v >= 10 * p then v end) as high, max(case when i < (c + 1) / 2 and q >= 10 * v and field <> 'snr' then v end) as low from st group by 1, 2),
near as (select a.row_id, a.source, a.v, median(log10(b.v)) as med from snd a join snd b on a.field = b.field and a.source = b.source and b.d between a.d / 1.5 and a.d * 1.5 where a.field = 'peak_absolute' group by all),
cand as (select *, abs(log10(v) - med) > 0.9 as c from near),
site as (select a.row_id from cand a join snd x on x.field = 'peak_absolute' and x.row_id = a.row_id join snd b on b.field = 'peak_absolute' and b.source = x.source and b.d between x.d / 1.5 and x.d * 1.5 join cand k on k.row_id = b.row_id where a.c and not k.c group by a.row_id, a.v having a.v >= 10 * max(b.v) or a.v <= min(b.v) / 10),
found as (
  select field, row_id, 1 as why from r where bad
  union all select field, row_id, 2 from m where stuck
  union all select st.field, st.row_id, 3 from st join lim using (field, source) where v >= high or v <= low
  union all select 'peak_absolute', row_id, 3 from site)
"""


def _implausible(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = anomalies.station_anomalies(table(spark, sf_dir, "station_magnitudes"), "row_id", "nsl", micros("event_time"), {"peak_amp": True, "snr": False})
    site = anomalies.site_anomalies(table(spark, sf_dir, "site_amplitudes"), "amp_id", "collection_id", "peak_absolute", "distance_epi", ["peak_horizontal", "peak_vertical"])
    return at.unionByName(site)


@query(_ANOMALIES + "select distinct field, row_id from found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings that do not fit their own source."""
    return _implausible(spark, sf_dir).select("field", "row_id")


@query(_ANOMALIES + "select field, ['impossible', 'stuck', 'spike'][why] as reason, count(*) as n from (select field, row_id, min(why) as why from found group by 1, 2) group by 1, 2")
def p4_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many readings each test of p4 found."""
    return _implausible(spark, sf_dir).groupBy("field", "reason").agg(F.count("*").alias("n"))


_TIMES = r"""
with t as (select line_id, server_id, 'starttime' as field, starttime as s from stream_lines union all select line_id, server_id, 'endtime', endtime from stream_lines),
x as (select line_id, field, regexp_replace(s, '^[\s\x{00a0}]+|[\s\x{00a0}]+$', '', 'g') as s, tz_name as tz, date_order as o, std_abbr, dst_abbr from t left join servers using (server_id) where s is not null),
n as (select *, regexp_full_match(s, '-?[0-9]{1,20}([.][0-9]+)?') as num,
  regexp_extract(s, '^([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})(?:T|\s+)(.*)$', ['y', 'm', 'd', 'r']) as a,
  regexp_extract(s, '^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4})(?:T|,?\s+)(.*)$', ['p', 'q', 'y', 'r']) as b,
  regexp_extract(s, '^([0-9]{4})[-,.]([0-9]{3})(?:[T,]|\s+)(.*)$', ['y', 'j', 'r']) as c,
  regexp_extract(s, '^(?:[A-Za-z]{3,9},?\s+)?([0-9]{1,2})[ -]([A-Za-z]{3,9})[ -]([0-9]{4})\s+(.*)$', ['d', 'm', 'y', 'r']) as e,
  regexp_extract(s, '^([A-Za-z]{3,9})\s+([0-9]{1,2}),?\s+([0-9]{4})\s+(.*)$', ['m', 'd', 'y', 'r']) as f,
  regexp_extract(s, '^([0-9]{4})([0-9]{2})([0-9]{2})(?:T|\s)?([0-9]{2})([0-9]{2})([0-9]{2})(.*)$', ['y', 'm', 'd', 'h', 'n', 's', 'r']) as g from x),
d as (select *, case when a.y <> '' then try_cast(a.y || '-' || a.m || '-' || a.d as date)
    when b.y <> '' then case when o = 'mdy' then coalesce(try_cast(b.y || '-' || b.p || '-' || b.q as date), try_cast(b.y || '-' || b.q || '-' || b.p as date)) else coalesce(try_cast(b.y || '-' || b.q || '-' || b.p as date), try_cast(b.y || '-' || b.p || '-' || b.q as date)) end
    when c.y <> '' then case when try_cast(c.j as int) >= 1 and year(try_cast(c.y || '-01-01' as date) + (try_cast(c.j as int) - 1)) = try_cast(c.y as int) then try_cast(c.y || '-01-01' as date) + (try_cast(c.j as int) - 1) end
    when e.y <> '' then try_cast(try_strptime(e.y || ' ' || left(e.m, 3) || ' ' || e.d, '%Y %b %d') as date)
    when f.y <> '' then try_cast(try_strptime(f.y || ' ' || left(f.m, 3) || ' ' || f.d, '%Y %b %d') as date)
    when g.y <> '' then try_cast(g.y || '-' || g.m || '-' || g.d as date) end as day,
  case when a.y <> '' then a.r when b.y <> '' then b.r when c.y <> '' then c.r when e.y <> '' then e.r when f.y <> '' then f.r when g.y <> '' then g.h || ':' || g.n || ':' || g.s || g.r end as r from n),
h as (select *, regexp_extract(r, '^([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]+))?)?(?:\s*([AaPp][Mm]))?(?:\s*([+-][0-9]{2}(?::?[0-9]{2})?)|\s*[(]?([A-Za-z]{1,5})[)]?)?(?:\[([A-Za-z0-9_/+-]+)\])?$', ['h', 'm', 's', 'f', 'ap', 'off', 'ab', 'id']) as k from d),
v as (select *, case when k.ap <> '' then try_cast(k.h as int) % 12 + 12 * (lower(k.ap) = 'pm')::int else try_cast(k.h as int) end as hh, coalesce(try_cast(k.s as int), 0) as ss, coalesce(try_cast(rpad(left(k.f, 6), 6, '0') as bigint), 0) * (k.f <> '')::int as us from h where day is not null and k.h <> ''),
w as (select *, day::timestamp + to_microseconds(((hh * 60 + try_cast(k.m as bigint)) * 60 + ss) * 1000000 + us) as ts from v
  where try_cast(k.m as int) <= 59 and ss <= 59 and case when k.ap <> '' then try_cast(k.h as int) between 1 and 12 else hh <= 23 or (hh = 24 and try_cast(k.m as int) = 0 and ss = 0 and us = 0) end),
z as (select *, replace(k.off, ':', '') as off, case when k.off <> '' or k.ab <> '' then null when k.id <> '' then k.id else tz end as zone from w),
y as (select line_id, field, ts, zone, case
    when off <> '' then epoch_us(ts) - (case when left(off, 1) = '+' then 1 else -1 end) * (try_cast(off[2:3] as bigint) * 60 + coalesce(try_cast(off[4:5] as bigint), 0)) * 60000000
    when k.ab in ('Z', 'UTC', 'GMT') then epoch_us(ts)
    when k.ab = std_abbr then epoch_us(ts) - least(epoch_us(jan) - epoch_us(timezone(tz, jan)), epoch_us(jul) - epoch_us(timezone(tz, jul)))
    when k.ab = dst_abbr then epoch_us(ts) - greatest(epoch_us(jan) - epoch_us(timezone(tz, jan)), epoch_us(jul) - epoch_us(timezone(tz, jul)))
    when zone is not null then epoch_us(timezone(zone, ts)) end as e from (select *, make_timestamp(year(ts), 1, 15, 12, 0, 0) as jan, make_timestamp(year(ts), 7, 15, 12, 0, 0) as jul from z)),
u as (select *, make_timestamptz(e) as i from y where e is not null),
one as (select line_id, field, e from u where zone is null or (timezone(zone, i) = ts and not (timezone(zone, i + to_minutes(30)) = ts or timezone(zone, i - to_minutes(30)) = ts or timezone(zone, i + to_minutes(60)) = ts or timezone(zone, i - to_minutes(60)) = ts))),
cnt as (select line_id, field, case when abs(try_cast(split_part(s, '.', 1) as double)) < 1e11 then try_cast(s as decimal(38, 9)) * 1000000 when abs(try_cast(split_part(s, '.', 1) as double)) < 1e14 then try_cast(s as decimal(38, 9)) * 1000 when abs(try_cast(split_part(s, '.', 1) as double)) < 1e17 then try_cast(s as decimal(38, 9)) else try_cast(s as decimal(38, 9)) / 1000 end as e
  from n where num and not regexp_full_match(s, '[0-9]{4}') and not (regexp_full_match(s, '[0-9]{8}') and try_strptime(s, '%Y%m%d') is not null) and not exists (select 1 from w where w.line_id = n.line_id and w.field = n.field))
select line_id, field, e as epoch_us from one union all select line_id, field, trunc(e)::bigint from cnt
"""


def _times(spark: SparkSession, sf_dir: str, servers: DataFrame | None = None) -> DataFrame:
    servers = table(spark, sf_dir, "servers") if servers is None else servers
    return timestamps.normalise_times(table(spark, sf_dir, "stream_lines"), servers, "line_id", "server_id", ["starttime", "endtime"])


@query(_TIMES)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one instant of each time text that denotes exactly one."""
    return _times(spark, sf_dir).where("epoch_us is not null and not repeated and not against").select(F.col("rid").alias("line_id"), "field", "epoch_us")


@query()
def p5_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts of each server were read in each layout."""
    return _times(spark, sf_dir).groupBy(F.col("source").alias("server_id"), "layout", "repeated").agg(F.count("*").alias("n"))


@query()
def p5_without_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The servers' date order withheld: how many texts that leave it open the chain alone reads as it states."""
    servers = table(spark, sf_dir, "servers")
    t = _times(spark, sf_dir, servers.withColumn("date_order", F.lit(None).cast("string"))).where("n_readings > 1 and not repeated and layout is not null")
    stated = servers.select(F.col("server_id").alias("source"), F.when(F.col("date_order") == "mdy", "mdy").otherwise("dmy").alias("stated")).dropDuplicates(["source"])
    return t.join(stated, "source").groupBy(F.col("source").alias("server_id")).agg(F.count("*").alias("n_open"), F.count_if(F.col("layout").endswith(F.col("stated"))).alias("n_right"))
