"""Ordered operations without one task for a key: ranks, running values, the value before, exact quantiles.

Rows are spread over cells by range of (keys, order), so that a key of any size
lies in several cells and a cell holds about the same number of rows. What a
cell needs of the cells before it, a count, a sum, a maximum or a last value,
is carried over a table of one row for each key and cell. Cells are written to
the checkpoint folder first, so both passes see the same ones.

Where no key has more than WHOLE rows, keys stay whole and nothing is carried;
the results are the same.

Defined cases: a null key is a key; null order values come first; rows equal in
the whole order share a cell or not, in no defined order; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stackwave.plans.dist import checkpointed

CELL = "_cell"
WHOLE = 200_000


def largest(df: DataFrame, by: list[str]) -> int:
    """Rows of the largest key; pre-aggregated where they are read."""
    return df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def cells(df: DataFrame, by: list[str], order: list[str], sized: DataFrame | None = None) -> DataFrame:
    """df with _cell, rising with (by, order), or df as it is where each key is small. sized has the keys and at least the rows of df, if it is cheaper to count."""
    if largest(df if sized is None else sized, by) <= WHOLE:
        return df
    return checkpointed(df.repartitionByRange(*by, *order).withColumn(CELL, F.spark_partition_id()))


def _same(by: list[str]) -> list[Column]:
    return [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*by, CELL]]


def carried(celled: DataFrame, totals: DataFrame, by: list[str], names: dict[str, str]) -> DataFrame:
    """celled with columns of totals, one row for each key and cell, under new names."""
    on = _same(by)
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return celled.alias("l").join(totals.alias("r"), cond).select("l.*", *[F.col(f"r.{a}").alias(b) for a, b in names.items()])


def running(celled: DataFrame, by: list[str], order: list[str], name: str, value: Column, how: str, before: bool = False) -> DataFrame:
    """Adds name: the running sum, max or last of value over all earlier rows of the key, and the row itself unless `before`; null where there is none."""
    fn = {"sum": F.sum, "max": F.max, "last": F.last}[how]
    if CELL not in celled.columns:
        return celled.withColumn(name, fn(value).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1 if before else W.currentRow)))
    local = W.partitionBy(*by, CELL).orderBy(*order)
    x = celled.withColumn("_v", value)
    x = x.withColumn("_in", fn("_v").over(local.rowsBetween(W.unboundedPreceding, -1 if before else W.currentRow)))
    ahead = W.partitionBy(*by).orderBy(CELL).rowsBetween(W.unboundedPreceding, -1)
    if how == "last":
        x = x.withColumn("_first", F.row_number().over(local) == 1)
        total = celled.withColumn("_v", value).groupBy(*by, CELL).agg(F.max(F.struct(*order, F.col("_v").alias("_last")))["_last"].alias("_t"))
    else:
        total = celled.withColumn("_v", value).groupBy(*by, CELL).agg(fn("_v").alias("_t"))
    total = total.withColumn("_ahead", F.last("_t").over(ahead) if how == "last" else fn("_t").over(ahead))
    x = carried(x, total, by, {"_ahead": "_ahead"})
    if how == "last":
        out = F.when(F.col("_first") & F.lit(before), F.col("_ahead")).otherwise(F.col("_in"))
        return x.withColumn(name, out).drop("_v", "_in", "_first", "_ahead")
    both = F.greatest("_in", "_ahead") if how == "max" else F.when(F.col("_in").isNotNull() | F.col("_ahead").isNotNull(), F.coalesce("_in", F.lit(0)) + F.coalesce("_ahead", F.lit(0)))
    return x.withColumn(name, both).drop("_v", "_in", "_ahead")


def running_sums(celled: DataFrame, by: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Adds several running sums, each row's own value included, in one pass; order is unique within the key."""
    if CELL not in celled.columns:
        w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
        return celled.select("*", *[F.sum(v).over(w).alias(n) for n, v in sums.items()])
    local = W.partitionBy(*by, CELL).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    ahead = W.partitionBy(*by).orderBy(CELL).rowsBetween(W.unboundedPreceding, -1)
    total = celled.groupBy(*by, CELL).agg(*[F.sum(v).alias(f"_t_{n}") for n, v in sums.items()])
    total = total.select(*by, CELL, *[F.coalesce(F.sum(f"_t_{n}").over(ahead), F.lit(0)).alias(f"_a_{n}") for n in sums])
    x = carried(celled.select("*", *[F.sum(v).over(local).alias(f"_in_{n}") for n, v in sums.items()]), total, by, {f"_a_{n}": f"_a_{n}" for n in sums})
    return x.select("*", *[(F.col(f"_in_{n}") + F.col(f"_a_{n}")).alias(n) for n in sums]).drop(*[f"{a}{n}" for n in sums for a in ("_in_", "_a_")])


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "n") -> DataFrame:
    """Adds the row's number from 1 within its key."""
    x = cells(df, by, order)
    return running(x, by, order, name, F.lit(1).cast("long"), "sum").drop(CELL)


def previous(df: DataFrame, by: list[str], order: list[str], name: str, value: Column) -> DataFrame:
    """Adds the value of the row before within its key."""
    return running(cells(df, by, order), by, order, name, value, "last", before=True).drop(CELL)


def quantiles(df: DataFrame, by: list[str], value: str, qs: dict[str, float], sized: DataFrame | None = None) -> DataFrame:
    """(by..., n, one column a quantile): exact, on a line between the two values beside position q * (n - 1); null and NaN do not count."""
    v = F.col(value).cast("double")
    x = cells(df.select(*by, F.when(~F.isnan(v), v).alias("_q")).where("_q is not null"), by, ["_q"], sized)
    if CELL not in x.columns:
        p = F.percentile("_q", F.array(*[F.lit(float(q)) for q in qs.values()]))
        out = x.groupBy(*by).agg(F.count("*").alias("n"), p.alias("_p")).where("n > 0")
        return out.select(*by, "n", *[F.col("_p")[i].alias(k) for i, k in enumerate(qs)])
    per = x.groupBy(*by, CELL).agg(F.count("*").alias("_c"))
    whole = W.partitionBy(*by)
    per = per.withColumn("n", F.sum("_c").over(whole)).withColumn("_ahead", F.coalesce(F.sum("_c").over(whole.orderBy(CELL).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    spots = {k: q * (F.col("n") - 1) for k, q in qs.items()}
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p), F.ceil(p)) for p in spots.values()])))
    per = per.withColumn("_w", F.filter(wanted, lambda r: (r >= F.col("_ahead")) & (r < F.col("_ahead") + F.col("_c")))).where(F.size("_w") > 0)
    # only cells that hold a wanted rank are sorted
    x = carried(x, per, by, {"_ahead": "_ahead", "_w": "_w", "n": "n"})
    x = x.withColumn("_r", F.row_number().over(W.partitionBy(*by, CELL).orderBy("_q")) - 1 + F.col("_ahead")).where(F.array_contains("_w", F.col("_r")))
    at = lambda p: F.max(F.when(F.col("_r") == p, F.col("_q")))
    out = x.groupBy(*by, "n").agg(*[at(g(p)).alias(f"{k}{s}") for k, p in spots.items() for s, g in (("_lo", F.floor), ("_hi", F.ceil))])
    line = lambda k, p: F.when(F.floor(p) == F.ceil(p), F.col(f"{k}_lo")).otherwise((F.ceil(p) - p) * F.col(f"{k}_lo") + (p - F.floor(p)) * F.col(f"{k}_hi"))
    return out.select(*by, "n", *[line(k, p).alias(k) for k, p in spots.items()])


def median(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """(by..., name)."""
    return quantiles(df, by, value, {name: 0.5}).drop("n")


def counted_within(df: DataFrame, by: list[str], time_us: str, tie: str, window_us: int, name: str = "n") -> DataFrame:
    """Adds the number of the key's rows within window_us up to each row's time, rows of equal time included; tie is unique."""
    t = F.col(time_us)
    # beside the rows, two probes of each: just before its window and at the end of its own time
    each = F.explode(F.array(*[F.struct(F.lit(kind).alias("_kind"), at.alias("_t"), F.lit(w).cast("long").alias("_w")) for kind, at, w in ((0, t - window_us, 0), (1, t, 1), (2, t, 0))])).alias("x")
    rows = df.select(*by, tie, each).select(*by, tie, "x.*")
    got = running(cells(rows, by, ["_t", "_kind", tie]), by, ["_t", "_kind", tie], "_sum", F.col("_w"), "sum").where("_kind <> 1")
    n = got.groupBy(tie).agg(F.sum(F.when(F.col("_kind") == 2, F.col("_sum")).otherwise(-F.col("_sum"))).alias(name))
    return df.join(n, tie)
