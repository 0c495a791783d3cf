"""Mix sources to target shares of the total size, by cube-method sampling.

Each source gets its share of the total. A source needing r times its size is
taken floor(r) times whole, and the rest with inclusion probability r - floor(r)
for each record. The cube method moves the vector of these probabilities
through the null space of the balance constraints (tokens and documents of the
source), three records at a time, until each is 0 or 1 but for at most two.

Blocks of a source fly on their own; what each leaves open flies again in the
next round, the last one with about RESERVE records of each source held back so
far. There the records fly and land class by class of size, the largest first,
and what a class misses is laid on the smaller ones.

Defined cases: records without source, of a source without target, or without
tokens are never drawn; sources with a target but without records, a null or
a negative share cannot contribute, and the others' shares are taken of their
sum; rows of one key and source are drawn together; the default total is the
largest that the repeat limits allow; a larger one is met as far as they allow.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackwave.plans.dist import arrow_schema, checkpointed, grouped_map

BLOCK = 20_000
RESERVE = 1_000
_ROWS = "source string, doc_id long, tokens long, x double"
EPS = 1e-9


def fly(x: list[float], sizes: list[int], rng: random.Random) -> None:
    """The flight phase, in place: sums of x and of sizes * x stay, all but at most two entries become 0 or 1."""
    active: list[int] = []
    for i in range(len(x)):
        if EPS < x[i] < 1 - EPS:
            active.append(i)
        else:
            x[i] = float(round(x[i]))
        while len(active) == 3:
            a, b, c = active
            u = (sizes[c] - sizes[b], sizes[a] - sizes[c], sizes[b] - sizes[a])
            if u == (0, 0, 0):
                u = (1, -1, 0)
            up = min((1 - x[i] if d > 0 else x[i]) / abs(d) for i, d in zip(active, u) if d)
            down = min((x[i] if d > 0 else 1 - x[i]) / abs(d) for i, d in zip(active, u) if d)
            step = up if rng.random() * (up + down) < down else -down
            left = []
            for j, d in zip(active, u):
                x[j] += step * d
                if x[j] <= EPS or x[j] >= 1 - EPS:
                    x[j] = float(round(x[j]))
                else:
                    left.append(j)
            active = left


def land(x: list[float], sizes: list[int]) -> None:
    """The landing phase, in place: the few open entries go to the whole values nearest in tokens, then in count."""
    fractional = [i for i in range(len(x)) if 0 < x[i] < 1]
    want, count = sum(sizes[i] * x[i] for i in fractional), sum(x[i] for i in fractional)
    best = min(range(1 << len(fractional)), key=lambda m: (abs(sum(sizes[i] for k, i in enumerate(fractional) if m >> k & 1) - want), abs(bin(m).count("1") - count), m))
    for k, i in enumerate(fractional):
        x[i] = float(best >> k & 1)


def settle(x: list[float], sizes: list[int], rng: random.Random) -> None:
    """Flight and landing, in place, of everything still open: size class by size class, the large ones first.

    What a class misses of its tokens when it lands is laid on the smaller
    records' probabilities, so the whole misses its tokens by no more than a
    small record's size where there are small records.
    """
    order = sorted(range(len(x)), key=lambda i: -sizes[i])
    rest = float(sum(sizes))
    missed, at = 0.0, 0
    while at < len(order):
        end = at
        while end < len(order) and 2 * sizes[order[end]] > sizes[order[at]]:
            end += 1
        cls = order[at:end]
        rng.shuffle(cls)
        shift = missed / rest if rest else 0.0
        y, s = [min(1.0, max(0.0, x[i] + shift)) for i in cls], [sizes[i] for i in cls]
        want = sum(sizes[i] * x[i] for i in cls)
        fly(y, s, rng)
        land(y, s)
        missed += want - sum(a * b for a, b in zip(y, s))
        rest -= sum(s)
        for i, v in zip(cls, y):
            x[i] = v
        at = end


def _round(seed: int, last: bool):
    schema = arrow_schema(_ROWS)

    def run(key: tuple, t: pa.Table) -> Iterator[pa.Table]:
        x, sizes = t["x"].to_pylist(), t["tokens"].to_pylist()
        order = list(range(len(x)))
        rng = random.Random(f"{seed}/{key}")
        rng.shuffle(order)
        y, s = [x[i] for i in order], [sizes[i] for i in order]
        if last:
            settle(y, s, rng)
        else:
            fly(y, s, rng)
        out = [0.0] * len(x)
        for i, v in zip(order, y):
            out[i] = v
        yield pa.Table.from_arrays([t["source"], t["doc_id"], t["tokens"], pa.array(out)], schema=schema)

    return run


def plan(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> list[dict]:
    """Per usable source: share (of usable ones), tokens there are, times to take. targets has a row a source, 10,000 at most."""
    have = {r["source"]: (r["tokens"], r["docs"]) for r in sizes.join(targets.select("source").distinct(), "source", "left_semi").groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")).collect()}
    rows = targets.select("source", "target_share", "max_repeats").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10,000 target sources")
    use = [dict(source=r["source"], share=r["target_share"], cap=max(0, r["max_repeats"] or 0), tokens=have[r["source"]][0], docs=have[r["source"]][1]) for r in rows if r["source"] in have and (r["target_share"] or 0) > 0 and have[r["source"]][0]]
    scale = sum(u["share"] for u in use)
    for u in use:
        u["share"] /= scale
    most = min((u["tokens"] * u["cap"] / u["share"] for u in use), default=0)
    goal = most if total is None else float(total)
    for u in use:
        u["times"] = min(float(u["cap"]), u["share"] * goal / u["tokens"])
        if abs(u["times"] - round(u["times"])) < 1e-9:
            u["times"] = float(round(u["times"]))
    return use


def mix(docs: DataFrame, key: str, source: str, text: str, targets: DataFrame, total: int | None = None, seed: int = 17, block: int = BLOCK) -> DataFrame:
    """(source, doc_id, tokens, copies) of each record drawn at least once; see plan for the amounts."""
    spark = docs.sparkSession
    sizes = (
        docs.where(F.col(source).isNotNull() & (F.octet_length(text) > 0))
        .groupBy(F.col(source).cast("string").alias("source"), F.col(key).cast("long").alias("doc_id"))
        .agg(F.sum(F.octet_length(text).cast("long")).alias("tokens"))
    )
    sizes = checkpointed(sizes)
    use = plan(sizes, targets, total)
    if not use:
        return spark.createDataFrame([], "source string, doc_id long, tokens long, copies int")
    amounts = spark.createDataFrame(
        [(u["source"], int(u["times"]), u["times"] - int(u["times"]), -(-u["docs"] // RESERVE)) for u in use], "source string, whole int, x double, one_in long"
    )
    rows = sizes.join(F.broadcast(amounts), "source")  # at most 10,000 rows
    open_ = rows.where("x > 0").withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit("held")), "one_in") == 0).select("source", "doc_id", "tokens", "x", "held")
    held = open_.where("held").drop("held")
    n = max(u["docs"] for u in use)
    decided: list[DataFrame] = []
    level = 0
    now = open_.drop("held") if n <= block else open_.where("not held").drop("held")
    while n > block:
        blocks = -(-n // block)
        cut = now.withColumn("blk", F.pmod(F.xxhash64("doc_id", F.lit(level)), F.lit(blocks)))
        done = checkpointed(grouped_map(cut, ["source", "blk"], _round(seed + level, False), _ROWS, order=["doc_id"]))
        decided.append(done.where("x = 1").select("source", "doc_id"))
        now = done.where("x > 0 and x < 1")
        n, level = 2 * blocks, level + 1
    if level:
        now = now.unionByName(held)
    last = checkpointed(grouped_map(now, ["source"], _round(seed + level, True), _ROWS, order=["doc_id"]))
    decided.append(last.where("x = 1").select("source", "doc_id"))
    drawn = decided[0]
    for d in decided[1:]:
        drawn = drawn.unionByName(d)
    drawn = drawn.withColumn("one", F.lit(1))
    out = rows.join(drawn, ["source", "doc_id"], "left").withColumn("copies", F.col("whole") + F.coalesce("one", F.lit(0)))
    return out.where("copies > 0").select("source", "doc_id", "tokens", "copies")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, docs, draws, tokens, actual_share, most_copies) for every target."""
    got = mixed.groupBy("source").agg(F.count("*").alias("docs"), F.sum("copies").alias("draws"), F.sum(F.col("copies") * F.col("tokens")).alias("tokens"), F.max("copies").alias("most_copies"))
    full = targets.select("source", "target_share", "max_repeats").join(got, "source", "left").fillna(0, ["docs", "draws", "tokens", "most_copies"])
    total = got.agg(F.sum("tokens").alias("all"))
    return full.crossJoin(F.broadcast(total)).withColumn("actual_share", F.coalesce(F.try_divide(F.col("tokens").cast("double"), F.col("all").cast("double")), F.lit(0.0))).drop("all")  # one row
