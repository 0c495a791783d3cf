"""Station codes, glob patterns, dates and fixed-width texts as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bounds of the quality classes, best first.
QUALITY_BOUNDS = (1.0, 0.8, 0.6, 0.4, 0.0)
# Layouts of station lines' times.
STATION_TIME_FORMATS = ("yyyy/MM/dd HH:mm:ss.SSSS", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSS", "yyyy-MM-dd HH:mm:ss")


def nsl(network: Column, station: Column, location: Column) -> Column:
    return F.concat_ws(".", network, station, F.coalesce(location, F.lit("")))


def nsl_parse(code: Column) -> Column:
    """network.station.location (a channel after it is dropped; missing parts are empty)."""
    p = F.split(code, r"\.")
    part = lambda i: F.coalesce(F.get(p, F.lit(i)), F.lit(""))
    return F.struct(part(0).alias("network"), part(1).alias("station"), part(2).alias("location"))


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression that Spark and DuckDB both read."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in pattern[i + 1 :]:
            j = pattern.index("]", i + 1)
            inner = pattern[i + 1 : j]
            out += "[" + ("^" + inner[1:] if inner[:1] == "!" else inner) + "]"
            i = j
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def nsl_matches(code: Column, pattern: str) -> Column:
    """Glob per component; components missing from the pattern match anything."""
    parts = (pattern.split(".") + ["*", "*", "*"])[:3]
    parts = [p or "*" for p in parts[:2]] + [parts[2] or "*"]
    s = nsl_parse(code)
    return s["network"].rlike(glob_regex(parts[0])) & s["station"].rlike(glob_regex(parts[1])) & s["location"].rlike(glob_regex(parts[2]))


def nsl_valid(network: Column, station: Column, location: Column) -> Column:
    return (F.length(network) <= 2) & (F.length(station) <= 5) & (F.length(F.coalesce(location, F.lit(""))) <= 2)


def parse_date(text: Column) -> Column:
    """now, today, yesterday or an ISO date."""
    t = F.lower(F.trim(text))
    return (
        F.when(t == "now", F.current_timestamp())
        .when(t == "today", F.current_date().cast("timestamp"))
        .when(t == "yesterday", F.date_sub(F.current_date(), 1).cast("timestamp"))
        .otherwise(F.try_to_timestamp(text))
    )


def time_path(ts: Column) -> Column:
    return F.replace(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit(":"), F.lit(""))


def quality_class(confidence: Column) -> Column:
    """0 (best) to 3 by the fixed bounds, at the lower edge inclusive; null stays null."""
    out = F.when(confidence >= QUALITY_BOUNDS[0], F.lit(0))
    for i, bound in enumerate(QUALITY_BOUNDS[1:]):
        out = out.when(confidence >= bound, F.lit(i))
    return out


def hemisphere(value: Column, positive: str, negative: str, width: int = 8, digits: int = 4) -> Column:
    return F.concat(F.format_string(f"%{width}.{digits}f", F.abs(value)), F.when(value >= 0, F.lit(positive)).otherwise(F.lit(negative)))


def station_line(line: Column) -> Column:
    """A fixed-width station line: codes, channel, quality and the time range behind them."""
    rest = F.substring(line, 18, 200)
    both = lambda i: F.coalesce(*[F.try_to_timestamp(F.regexp_extract(rest, r"^\s*([0-9/-]+ [0-9:.]+)\s+-\s+([0-9/-]+ [0-9:.]+)\s*$", i), F.lit(f)) for f in STATION_TIME_FORMATS])
    sub = lambda a, n: F.trim(F.substring(line, a, n))
    return F.struct(
        F.concat_ws(".", sub(1, 2), sub(4, 5), sub(10, 3)).alias("nsl"), sub(13, 3).alias("channel"), F.substring(line, 17, 1).alias("dataquality"), both(1).alias("starttime"), both(2).alias("endtime")
    )
