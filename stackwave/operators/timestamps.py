"""Mixed timestamp texts to instants: all interpretations, then Viterbi over record order.

Each value becomes an array of valid interpretations (layout, order of day and
month, zone, occurrence of a repeated clock reading). A source's values in
record order form a chain. Its state is an interpretation and the order of day
and month last in use, which values without such an order hand on. The path of
least cost is chosen: changes of layout and backward jumps cost 1, a change of
order costs 2, and a reading against the source's stated order costs more than
its neighbours can save.

Scale. Values of one interpretation need no path; they enter it only where
they stand beside an open value or show an order. Chains are cut into blocks
of record ids. Each block states the least costs from its first states to its
last ones; where a value with one state lies between, both ends part. A pass
over these statements (one row a block, and only from one such value to the
next) fixes the states at all edges, so the path is that of the whole chain.

Defined cases: null, empty or unparsable text has no instant; a source without
date order is decided by its neighbours, ties by the earlier reading; one without a known zone has no clock
readings; equal record ids are ordered by text; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackwave.functions.timetext import KINDS, interpret_all, offsets_at, standard_offset
from stackwave.plans.dist import arrow_schema, checkpointed, grouped_map

AGAINST_ORDER = 16.0  # more than the switches, jumps and changes of order on both sides together
SWITCH = 1.0
BACKWARD = 1.0
REORDER = 2.0
ORDERS = ("dmy", "mdy")
NONE = np.iinfo(np.int64).min
AT_ONCE = 50_000  # texts that a task reads together

_CANDS = "rid long, field string, source string, epochs array<long>, layouts array<string>, costs array<double>, folds array<boolean>, orders array<int>"
_CHOSEN = "rid long, field string, source string, epoch_us long, layout string, n_readings int, repeated boolean, against boolean"


def _codes(c: pa.Array) -> tuple[np.ndarray, list]:
    """Codes and vocabulary of a text column; a null is -1."""
    d = c.dictionary_encode()
    return pc.fill_null(d.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.to_pylist()


def _instants(kind: np.ndarray, v: np.ndarray, zone: np.ndarray, zones: list[str], row: np.ndarray, col: dict) -> tuple[np.ndarray, np.ndarray]:
    """Earlier and later instant of each reading; NONE where its zone has none."""
    early, late = np.full(len(v), NONE), np.full(len(v), NONE)
    utc = kind == 0
    early[utc] = late[utc] = v[utc]
    (tz, tzs), (std, stds), (dst, dsts) = (_codes(col[c]) for c in ("tz", "std", "dst"))
    keys = np.stack([kind, np.where(kind == 3, -1, tz[row]), np.where(kind >= 2, zone, -1), np.where(kind == 2, std[row], -1), np.where(kind == 2, dst[row], -1)], 1)
    at = np.flatnonzero(~utc)
    kinds, which = np.unique(keys[at], axis=0, return_inverse=True)
    order = np.argsort(which, kind="stable")
    for (k, t, z, s, d), u in zip(kinds, np.split(at[order], np.searchsorted(which[order], np.arange(1, len(kinds))))):
        name = tzs[t] if t >= 0 else None
        if k == 2:
            first = s >= 0 and stds[s] == zones[z]
            if name and (first or (d >= 0 and dsts[d] == zones[z])):
                off = standard_offset(name, v[u], not first)
                if off is not None:
                    early[u] = late[u] = v[u] - off
            continue
        name = zones[z] if k == 3 else name
        if name:
            early[u], late[u] = offsets_at(name, v[u], True), offsets_at(name, v[u], False)
    return early, late


def _readings(t: pa.Table, schema: pa.Schema) -> pa.RecordBatch:
    col = {k: t[k].combine_chunks() for k in t.schema.names}
    names: dict[str, int] = {}
    zones: dict[str, int] = {}
    parts = [
        (at, np.full(len(at), names.setdefault(layout, len(names))), np.full(len(at), ("", *ORDERS).index(order)), np.full(len(at), KINDS.index(kind)), v, np.full(len(at), zones.setdefault(zone, len(zones))))
        for at, layout, order, kind, v, zone in interpret_all(col["text"].to_pylist())
    ]
    row, name, order, kind, v, zone = (np.concatenate(x).astype(np.int64) for x in zip(*parts)) if parts else np.zeros((6, 0), np.int64)
    o = np.argsort(row, kind="stable")
    row, name, order, kind, v, zone = (x[o] for x in (row, name, order, kind, v, zone))
    early, late = _instants(kind, v, zone, list(zones), row, col)
    want, wants = _codes(col["date_order"])
    wanted = np.array([*[{"dmy": 1, "ymd": 1, "mdy": 2}.get(x, 0) for x in wants], 0])[want[row]]
    against = np.where((order > 0) & (wanted > 0) & (order != wanted), AGAINST_ORDER, 0.0)
    ok = early != NONE
    twice = early != late
    again = np.repeat(np.flatnonzero(ok), 1 + twice[ok])  # a repeated clock reading is two
    second = np.r_[False, again[1:] == again[:-1]] if len(again) else np.zeros(0, bool)
    shows = np.array([next((i for i, x in enumerate(ORDERS) if x in n.split()), -1) for n in names] or [0])
    offsets = pa.array(np.searchsorted(row[again], np.arange(t.num_rows + 1)).astype(np.int32))
    lists = [np.where(second, late[again], early[again]), None, against[again], twice[again], shows[name[again]].astype(np.int32)]
    values = [pa.array(list(names), pa.string()).take(pa.array(name[again])) if x is None else pa.array(x) for x in lists]
    return pa.RecordBatch.from_arrays([col["rid"], col["field"], col["source"], *[pa.ListArray.from_arrays(offsets, x) for x in values]], schema=schema)


def _interpretations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema(_CANDS)
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= AT_ONCE:
            yield _readings(pa.Table.from_batches(held), schema)
            held, n = [], 0
    if n:
        yield _readings(pa.Table.from_batches(held), schema)


State = tuple[int, str, float, int, int]  # epoch, layout, cost, order in use, number of the reading


def states(epochs: list[int], layouts: list[str], costs: list[float], orders: list[int]) -> list[State]:
    return [(e, lay, c, o, j) for j, (e, lay, c, shows) in enumerate(zip(epochs, layouts, costs, orders)) for o in ((0, 1) if shows < 0 else (shows,))]


def _step(best: list[float], a: list[State], b: list[State]) -> tuple[list[float], list[int]]:
    """Least cost of each state of b after those of a, and where it comes from (the first of equals)."""
    cost, back = [], []
    for e, lay, c, o, _ in b:
        options = [p + (lay != x[1]) * SWITCH + (e < x[0]) * BACKWARD + (o != x[3]) * REORDER for p, x in zip(best, a)]
        j = options.index(min(options))
        cost.append(options[j] + c)
        back.append(j)
    return cost, back


def _costs(chain: list[list[State]], start: list[float]) -> list[float]:
    best = start
    for a, b in zip(chain, chain[1:]):
        best, _ = _step(best, a, b)
    return best


def viterbi(chain: list[list[State]], entry: int | None = None, leave: int | None = None) -> list[int]:
    """Number of the chosen reading at each place of a chain; entry and leave fix its first and last state."""
    best = [x[2] if entry is None or k == entry else np.inf for k, x in enumerate(chain[0])]
    backs: list[list[int]] = []
    for a, b in zip(chain, chain[1:]):
        best, back = _step(best, a, b)
        backs.append(back)
    k = best.index(min(best)) if leave is None else leave
    at = [k]
    for back in reversed(backs):
        k = back[k]
        at.append(k)
    return [chain[i][k][4] for i, k in enumerate(reversed(at))]


def _chain(t: pa.Table) -> list[list[State]]:
    return [states(*x) for x in zip(*(t[c].to_pylist() for c in ("epochs", "layouts", "costs", "orders")))]


_ENDS = (
    "source string, field string, blk long, parted boolean, epochs array<long>, layouts array<string>, costs array<double>, orders array<int>, "
    "epochs2 array<long>, layouts2 array<string>, costs2 array<double>, orders2 array<int>, between array<double>"
)
_EDGES = "source string, field string, blk long, entry int, leave int"


def _ends(key: tuple, t: pa.Table) -> Iterator[pa.Table]:
    """What a block costs from each first state to each last one; parted: to and from the single states between."""
    chain = _chain(t)
    single = [k for k, x in enumerate(chain) if len(x) == 1]
    unit = lambda x, k: [x[i][2] if i == k else np.inf for i in range(len(x))]
    if single:
        head, tail = chain[: single[0] + 1], chain[single[-1] :]
        between = [_costs(head, unit(head[0], k))[0] for k in range(len(head[0]))] + _costs(tail, [0.0])
    else:
        between = [x for k in range(len(chain[0])) for x in _costs(chain, unit(chain[0], k))]
    first, last = ([list(c) for c in list(zip(*x))[:4]] for x in (chain[0], chain[-1]))
    schema = arrow_schema(_ENDS)
    yield pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip([*key, bool(single), *first, *last, between], schema)], schema=schema)


def _link(key: tuple, t: pa.Table) -> Iterator[pa.Table]:
    """The states at the edges between blocks, from one parted block to the next."""
    rows = t.to_pylist()
    side = lambda r, n: [(*x, 0) for x in zip(*(r[c + n] for c in ("epochs", "layouts", "costs", "orders")))]
    first, last = [side(r, "") for r in rows], [side(r, "2") for r in rows]
    best: list[float] = []
    trail: list[tuple[list[int], list[list[int]]]] = []  # of each block: where its entries come from, which entry each last state has
    for k, r in enumerate(rows):
        na, nz = len(first[k]), len(last[k])
        if k:
            cost, back = _step(best, last[k - 1], first[k])
            cost = [c - x[2] for c, x in zip(cost, first[k])]  # an entry's own cost lies in `between`
        else:
            cost, back = [0.0] * na, []
        if r["parted"] and k == 0:
            best, entry = r["between"][na:], [-1] * nz
        elif r["parted"]:
            best, entry = [min(c + x for c, x in zip(cost, r["between"]))], [min(range(na), key=lambda i: cost[i] + r["between"][i])]
        else:
            grid = np.array(r["between"]).reshape(na, nz) + np.array(cost)[:, None]
            best, entry = grid.min(0).tolist(), grid.argmin(0).tolist()
        trail.append((back, entry))
    z = best.index(min(best))
    out = []
    for k in range(len(rows) - 1, -1, -1):
        back, entry = trail[k]
        a = entry[z]
        out.append((rows[k]["source"], rows[k]["field"], rows[k]["blk"], a if k else None, z if k < len(rows) - 1 else None))
        if k:
            z = back[a]
    schema = arrow_schema(_EDGES)
    yield pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def _choose(key: tuple, t: pa.Table) -> Iterator[pa.Table]:
    edge = t.filter(pc.is_null(t["rid"]))
    t = t.filter(pc.is_valid(t["rid"]))
    fixed = [next((v for v in edge[c].to_pylist() if v is not None), None) for c in ("entry", "leave")]
    n = pc.list_value_length(t["epochs"]).to_numpy()
    chain = _chain(t)
    # a value of one state parts the path
    cuts = [0, *[k for k in range(1, len(chain) - 1) if len(chain[k]) == 1], len(chain) - 1]
    chosen = [0] * len(chain)
    for a, b in zip(cuts, cuts[1:] or cuts):
        chosen[a : b + 1] = viterbi(chain[a : b + 1], fixed[0] if a == 0 else None, fixed[1] if b == len(chain) - 1 else None)
    own = pa.array(n > 1)
    at = [(x[j], lay[j], f[j], c[j]) for x, lay, f, c, j in zip(*(t[c].to_pylist() for c in ("epochs", "layouts", "folds", "costs")), chosen)]
    schema = arrow_schema(_CHOSEN)
    e, lay, f, c = (list(x) for x in zip(*at))
    yield pa.Table.from_arrays(
        [t["rid"], t["field"], t["source"], pa.array(e, pa.int64()), pa.array(lay, pa.string()), pa.array(n.astype(np.int32)), pa.array(f, pa.bool_()), pa.array(np.array(c) >= AGAINST_ORDER)], schema=schema
    ).filter(own)


def normalise_times(rows: DataFrame, sources: DataFrame, rid: str, source: str, fields: list[str], block: int = 20_000) -> DataFrame:
    """(rid, field, source, epoch_us, layout, n_readings, repeated, against) for each text.

    rows holds the record id (long), the source and the text fields; sources
    has tz_name, date_order, std_abbr and dst_abbr of each source. repeated
    marks a clock reading that its zone has twice (epoch_us is then the one
    the chain chose). A chain runs over one field of one source.
    """
    s = sources.select(F.col(source).alias("source"), F.col("tz_name").alias("tz"), "date_order", F.col("std_abbr").alias("std"), F.col("dst_abbr").alias("dst")).dropDuplicates(["source"])
    long = rows.select(
        F.col(rid).cast("long").alias("rid"), F.col(source).alias("source"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("x"),
    ).select("rid", "source", "x.field", "x.text")
    cands = checkpointed(long.join(s, "source", "left").mapInArrow(_interpretations, _CANDS))
    n = F.size("epochs")
    one = lambda c: F.element_at(c, 1)
    plain = cands.where(n < 2).select(
        "rid", "field", "source", F.get("epochs", F.lit(0)).alias("epoch_us"), F.get("layouts", F.lit(0)).alias("layout"), n.alias("n_readings"), F.lit(False).alias("repeated"), F.coalesce(F.get("costs", F.lit(0)) >= AGAINST_ORDER, F.lit(False)).alias("against"),
    )
    blk = ["source", "field", "blk"]
    w = Window.partitionBy(*blk).orderBy("rid", "epochs", "layouts")
    open_ = F.col("open")
    live = cands.where(n > 0).withColumn("blk", F.floor(F.col("rid") / block).cast("long")).withColumn("open", n > 1)
    path = checkpointed(
        live.withColumn("keep", open_ | (one("orders") >= 0) | F.coalesce(F.lag(open_).over(w), F.lit(True)) | F.coalesce(F.lead(open_).over(w), F.lit(True))).where("keep").drop("keep", "open")
    )
    order = ["rid", "epochs", "layouts"]
    ends = grouped_map(path, blk, _ends, _ENDS, order=order)
    # a parted block ends one stretch of blocks and begins the next
    upto = F.sum(F.col("parted").cast("long")).over(Window.partitionBy("source", "field").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.withColumn("s", F.coalesce(upto, F.lit(0))).withColumn("stretch", F.explode(F.when(F.col("parted"), F.array("s", F.col("s") + 1)).otherwise(F.array("s")))).drop("s")
    edges = grouped_map(ends, ["source", "field", "stretch"], _link, _EDGES, order=["blk"]).where("entry is not null or leave is not null")
    both = path.withColumn("entry", F.lit(None).cast("int")).withColumn("leave", F.lit(None).cast("int")).unionByName(edges, allowMissingColumns=True)
    return plain.unionByName(grouped_map(both, blk, _choose, _CHOSEN, order=order))
