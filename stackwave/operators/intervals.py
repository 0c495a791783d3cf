"""Continuous periods and gaps of overlapping intervals, by independent ranking.

The starts and the ends of an entity are ranked independently. A gap lies
between the end of rank r and the start of rank r + 1 where that start is
later than that end; the bounds of successive gaps, paired by their own rank,
give the continuous periods.

Starts and ends are counted per time first. One pass over cells of a bounded
number of times ranks both: ranks run inside a cell and are shifted by the
counts of the earlier ones, so a third of all rows in one entity, or in one
short burst, spreads over many tasks.

Defined cases: rows with a null entity, a missing bound or end <= start cover
nothing; intervals that touch leave no gap; repeated rows change nothing; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackwave.operators import ordered
from stackwave.plans.dist import checkpointed

def valid_intervals(df: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """Columns _k, _s, _e (start and end are longs) of the rows that cover anything."""
    rows = df.select(F.col(entity).alias("_k"), F.col(start).cast("long").alias("_s"), F.col(end).cast("long").alias("_e"))
    return rows.where("_k is not null and _s is not null and _e is not null and _e > _s")


def ranked(bounds: DataFrame, rows: DataFrame) -> DataFrame:
    """bounds(_k, t, _starts, _ends) of rows, unique in (_k, t): adds _sr and _er, the ranks of the last start and the last end up to t."""
    return ordered.running_sums(ordered.cells(bounds, ["_k"], ["t"], rows), ["_k"], ["t"], {"_sr": F.col("_starts"), "_er": F.col("_ends")})


def _counts(pairs: DataFrame) -> DataFrame:
    """(_k, t, _starts, _ends) of pairs(_k, _s, _e); either bound may be null."""
    one = lambda c, s, e: F.struct(F.col(c).alias("t"), F.lit(s).alias("s"), F.lit(e).alias("e"))
    x = pairs.select("_k", F.explode(F.array(one("_s", 1, 0), one("_e", 0, 1))).alias("x")).select("_k", "x.*").where("t is not null")
    return x.groupBy("_k", "t").agg(F.sum("s").alias("_starts"), F.sum("e").alias("_ends"))


def coverage_gaps(df: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """(entity, gap_start, gap_end): stretches between first start and last end that no interval covers."""
    return _gaps(valid_intervals(df, entity, start, end)).select(F.col("_k").alias(entity), "gap_start", "gap_end")


def _paired(x: DataFrame, start_rank: Column, start: str, end: str) -> DataFrame:
    """(_k, start, end) of the start and the end that share a rank, each from one row of x(_k, t, ...)."""
    one = lambda r, s, e: F.struct(r.alias("r"), s.cast("long").alias("s"), e.cast("long").alias("e"))
    none = F.lit(None)
    each = F.array(F.when(F.col("_starts") > 0, one(start_rank, F.col("t"), none)), F.when(F.col("_ends") > 0, one(F.col("_er"), none, F.col("t"))))
    x = x.select("_k", F.explode(each).alias("x")).where("x is not null").select("_k", "x.*")
    return x.groupBy("_k", "r").agg(F.max("s").alias(start), F.max("e").alias(end))


def _gaps(rows: DataFrame) -> DataFrame:
    # the start of rank r + 1 beside the end of rank r; rank 0 has no end
    pairs = _paired(ranked(_counts(rows), rows), F.col("_sr") - F.col("_starts"), "gap_end", "gap_start")
    return pairs.where("gap_end > gap_start").select("_k", "gap_start", "gap_end")


def coverage_periods(df: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """(entity, period_start, period_end): the maximal continuous periods of cover."""
    rows = valid_intervals(df, entity, start, end)
    outer = rows.groupBy("_k").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"))
    bounds = checkpointed(_gaps(rows)).select("_k", F.col("gap_end").alias("_s"), F.col("gap_start").alias("_e")).unionByName(outer)
    return _paired(ranked(_counts(bounds), bounds), F.col("_sr"), "period_start", "period_end").select(F.col("_k").alias(entity), "period_start", "period_end")
