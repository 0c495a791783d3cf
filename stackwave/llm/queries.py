"""The queries of the problems p2 and p6 to p8 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwave.llm import mixing, packing, quantiles, splitting
from stackwave.plans.dist import table

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


NSL = "concat_ws('.', network, station, coalesce(location, ''))"
QS = [0.05, 0.25, 0.5, 0.75, 0.95]
BY = ["measure", "dim", "grp"]
SMALL = 64  # values of a buffer in p2_small_buffers, so that small groups collapse too


def _measures(spark: SparkSession, sf_dir: str, day: bool = False) -> DataFrame:
    one = lambda measure, value, when, *dims: [F.struct(F.lit(measure).alias("measure"), F.lit(d).alias("dim"), F.expr(e).alias("grp"), F.col(value).alias("value"), F.date_format(when, "yyyy-MM-dd").alias("day") if day else F.lit("").alias("day")) for d, e in dims]
    p = table(spark, sf_dir, "picks").select(F.explode(F.array(*one("station_delay_s", "station_delay_s", "model_time", ("station", NSL), ("phase", "phase")))).alias("x"))
    m = table(spark, sf_dir, "station_magnitudes").select(F.explode(F.array(*one("magnitude", "magnitude", "event_time", ("station", "nsl"), ("model", "model")))).alias("x"))
    return p.unionByName(m).select("x.*")


_PERCENTILES = """
with x as (
  select 'station_delay_s' as measure, 'station' as dim, network || '.' || station || '.' || coalesce(location, '') as grp, station_delay_s as value from picks
  union all select 'station_delay_s', 'phase', phase, station_delay_s from picks
  union all select 'magnitude', 'station', nsl, magnitude from station_magnitudes
  union all select 'magnitude', 'model', model, magnitude from station_magnitudes),
g as (select measure, dim, grp, count(*) as n, list_sort(list(value)) as v from x where value is not null and not isnan(value) group by all),
q as (select unnest([0.05, 0.25, 0.5, 0.75, 0.95])::double as q)
"""
_EXACT = _PERCENTILES + "select measure, dim, grp, n, q, v[greatest(1, ceil(q * n))::bigint] as value, 0.0::double as rank_error from g, q"


@query(_EXACT)
def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of delays and magnitudes per station, phase and model, with their rank error."""
    return quantiles.percentiles(quantiles.sketch(_measures(spark, sf_dir), BY, "value"), BY, QS)


@query(_EXACT)
def p2_days_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the sketches of all days of all groups, united."""
    days = quantiles.sketch(_measures(spark, sf_dir, day=True), [*BY, "day"], "value")
    return quantiles.percentiles(quantiles.merge_sketches(days, BY), BY, QS)


@query(_PERCENTILES + f"select measure, dim, grp, n, q, n >= {8 * SMALL} as collapsed, true as within from g, q")
def p2_small_buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bound put to the test: small buffers collapse, and each value's exact rank lies within its stated error."""
    rows = _measures(spark, sf_dir).where("value is not null and not isnan(value)")
    got = quantiles.percentiles(quantiles.sketch(rows, BY, "value", k=SMALL), BY, QS).withColumnRenamed("value", "v")
    same = [F.col(f"r.{b}").eqNullSafe(F.col(f"g.{b}")) for b in BY]
    j = rows.alias("r").join(got.alias("g"), same[0] & same[1] & same[2])
    ranks = j.groupBy(*[F.col(f"g.{b}").alias(b) for b in BY], "n", "q", "rank_error").agg(F.count_if(F.col("value") < F.col("v")).alias("below"), F.count_if(F.col("value") <= F.col("v")).alias("upto"))
    want = F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("n")))
    off = F.greatest(F.lit(0), F.col("below") + 1 - want, want - F.col("upto"))
    return ranks.select(*BY, "n", "q", (F.col("rank_error") > 0).alias("collapsed"), (off <= F.col("rank_error")).alias("within"))


@query()
def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of 8,192 tokens with their texts."""
    return packing.fill_containers(table(spark, sf_dir, "documents"), "doc_id", "text", 8192)


@query("""select sum(strlen(text))::bigint as n_tokens, count(*)::bigint as n_docs, true as within, true as whole from documents where strlen(text) > 0""")
def p6_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the containers hold: all tokens, all documents, none overfull, none cut needlessly."""
    rows = p6_containers(spark, sf_dir)
    full = rows.groupBy("container").agg(F.sum("n_tokens").alias("size")).agg(F.max("size").alias("most"))
    sums = rows.groupBy("doc_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("parts")).agg(
        F.sum("t").cast("long").alias("n_tokens"), F.count("*").alias("n_docs"), F.min((F.col("parts") == 1) | (F.col("t") > 8192)).alias("whole")
    )
    return sums.crossJoin(F.broadcast(full)).select("n_tokens", "n_docs", (F.col("most") <= 8192).alias("within"), "whole")  # one row each


@query()
def p7_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts drawn for the target mix, with their number of copies."""
    docs = table(spark, sf_dir, "documents")
    drawn = mixing.mix(docs, "doc_id", "source", "text", table(spark, sf_dir, "mix_targets"))
    return docs.select("doc_id", "source", "text").join(drawn, ["doc_id", "source"])


@query()
def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that the drawn texts really have."""
    targets = table(spark, sf_dir, "mix_targets")
    return mixing.shares(mixing.mix(table(spark, sf_dir, "documents"), "doc_id", "source", "text", targets), targets)


@query("select t.source, true as within, true as capped from mix_targets t where t.source in (select source from documents where strlen(text) > 0)")
def p7_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares held against the targets (over those of sources that have records): within a hundredth of a percent or two texts, and no text too often."""
    s = p7_shares(spark, sf_dir).where("tokens > 0 or docs > 0")
    all_ = s.agg(F.sum("target_share").alias("t"), F.sum("tokens").alias("n"))
    most = table(spark, sf_dir, "documents").where("octet_length(text) > 0").groupBy("source").agg(F.max(F.octet_length("text")).alias("longest"))
    off = F.abs(F.col("actual_share") - F.col("target_share") / F.col("t"))
    j = s.crossJoin(F.broadcast(all_)).join(most, "source")  # one row
    return j.select("source", (off <= F.greatest(F.lit(1e-4), 2 * F.col("longest") / F.col("n"))).alias("within"), (F.col("most_copies") <= F.col("max_repeats")).alias("capped"))


@query()
def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the documents of more than 4,096 tokens."""
    return splitting.split_oversized(table(spark, sf_dir, "documents"), "doc_id", "text", 4096, 256)


@query("select doc_id from documents where strlen(text) > 4096")
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that were cut."""
    return p8_pieces(spark, sf_dir).where("piece = 0").select("doc_id")


@query("select doc_id, strlen(text)::bigint as n_bytes, true as within, true as whole, true as shared from documents where strlen(text) > 4096")
def p8_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pieces hold: the whole text in order, none over the limit, 256 tokens (to a character) in common with the one before."""
    p = p8_pieces(spark, sf_dir)
    rows = p.groupBy("doc_id").agg(
        F.max("byte_end").alias("n_bytes"), F.max("n_tokens").alias("most"), F.sum(F.col("byte_end") - F.col("byte_start")).alias("own"), F.count("*").alias("n"), F.max("piece").alias("last"),
        F.min(F.when(F.col("piece") > 0, F.col("shared_bytes"))).alias("least_shared"), F.max("shared_bytes").alias("most_shared"), F.min("byte_start").alias("first"),
    )
    whole = (F.col("own") == F.col("n_bytes")) & (F.col("first") == 0) & (F.col("n") == F.col("last") + 1)
    return rows.select("doc_id", "n_bytes", (F.col("most") <= 4096).alias("within"), whole.alias("whole"), ((F.col("least_shared") >= 256) & (F.col("most_shared") <= 259)).alias("shared"))
