"""Percentiles of very large columns by deterministic buffer collapsing.

A sketch is a set of sorted buffers of at most K values, each value standing
for `w` values. FAN full buffers of one weight collapse into one of FAN times
the weight: of their merged values every FAN-th is kept, beginning at the
middle of the first FAN. Such a collapse moves no rank by more than FAN * w / 2;
the sum of these over all collapses is the sketch's stated rank error. As
buffers of equal weight collapse first, the collapses form a tree: N values
take log_FAN(N / K) levels of N / (2 K) each, about 0.06 % of N at a billion
values. Sketches of parts, days or files are united and merged by the same rule.

Scale: each task sketches its rows before the shuffle; partial sketches meet
in rounds of at most MEET input partitions, so no group gathers in one task.

Defined cases: null and NaN values do not count, infinities do; a null group
is a group; a group without values has no row; percentile q of n values is
the value of rank ceil(q * n), at least 1; up to K values of a group are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackwave.plans.dist import arrow_schema, checkpointed, chunked_map, starts

K = 8192
FAN = 8
CHUNK = 400_000
HELD = 256
MEET = 64


class Sketch:
    """Buffers by weight; all full but those of weight 1 that are still open."""

    def __init__(self, k: int = K) -> None:
        self.k, self.err, self.levels = k, 0.0, {}
        self.open: list[np.ndarray] = []
        self.n_open = 0

    def add(self, values: np.ndarray) -> None:
        self.open.append(values)
        self.n_open += len(values)
        if self.n_open >= self.k:
            all_ = np.concatenate(self.open)
            cut = len(all_) // self.k * self.k
            for i in range(0, cut, self.k):
                self.add_full(1, np.sort(all_[i : i + self.k]))
            self.open, self.n_open = [all_[cut:]], len(all_) - cut

    def add_full(self, w: int, values: np.ndarray) -> None:
        held = self.levels.setdefault(w, [])
        held.append(values)
        if len(held) == FAN:
            merged = np.sort(np.concatenate(held), kind="stable")
            self.levels[w] = []
            self.err += FAN * w / 2
            self.add_full(FAN * w, merged[FAN // 2 - 1 :: FAN])

    def merge(self, w: int, values: np.ndarray, err: float) -> None:
        self.err += err
        if w == 1 and len(values) < self.k:
            self.add(values)
        else:
            self.add_full(w, values)

    def buffers(self) -> Iterator[tuple[int, np.ndarray]]:
        if self.n_open:
            yield 1, np.sort(np.concatenate(self.open))
        for w in sorted(self.levels):
            for v in self.levels[w]:
                yield w, v

    def query(self, qs: list[float]) -> tuple[int, np.ndarray]:
        parts = list(self.buffers())
        v = np.concatenate([x for _, x in parts])
        w = np.concatenate([np.full(len(x), w) for w, x in parts])
        o = np.argsort(v, kind="stable")
        cum = np.cumsum(w[o])
        n = int(cum[-1])
        ranks = np.clip(np.ceil(np.array(qs) * n), 1, n)
        return n, v[o][np.searchsorted(cum, ranks, side="left")]


def _ddl(by: list[str]) -> str:
    return ", ".join([f"{b} string" for b in by] + ["part long", "w long", "vals array<double>", "err double"])


def _emit(schema: pa.Schema, by: list[str], rows: list[tuple], part: int) -> pa.Table:
    """rows: (group tuple, sketch)."""
    flat = [(g, w, v, s.err if i == 0 else 0.0) for g, s in rows for i, (w, v) in enumerate(s.buffers())]
    lens = np.cumsum([0, *[len(v) for _, _, v, _ in flat]]).astype(np.int32)
    vals = pa.ListArray.from_arrays(pa.array(lens), pa.array(np.concatenate([v for _, _, v, _ in flat] or [np.zeros(0)])))
    cols = [pa.array([g[i] for g, *_ in flat], pa.string()) for i in range(len(by))]
    return pa.Table.from_arrays([*cols, pa.array([part] * len(flat), pa.int64()), pa.array([w for _, w, _, _ in flat], pa.int64()), vals, pa.array([e for *_, e in flat], pa.float64())], schema=schema)


def _scan(by: list[str], k: int):
    schema = arrow_schema(_ddl(by))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: dict[tuple, Sketch] = {}

        def flush(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(rows).combine_chunks()
            code = np.zeros(t.num_rows, np.int64)
            for b in by:
                d = t[b].combine_chunks().dictionary_encode(null_encoding="encode")
                d = d if isinstance(d, pa.DictionaryArray) else d.combine_chunks()
                _, code = np.unique(code * max(1, len(d.dictionary)) + d.indices.to_numpy(zero_copy_only=False), return_inverse=True)
            v = t["value"].to_numpy()
            o = np.lexsort((v, code))
            code, v = code[o], v[o]
            first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            ends = np.r_[first[1:], len(v)]
            names = [t[b].combine_chunks().take(pa.array(o[first])) for b in by]
            big = np.flatnonzero(ends - first >= k)
            for i in big:
                g = tuple(c[int(i)].as_py() for c in names)
                if g not in held and len(held) >= HELD:
                    old = next(iter(held))
                    yield from _emit(schema, by, [(old, held.pop(old))], part).to_batches()
                held.setdefault(g, Sketch(k)).add(v[first[i] : ends[i]])
            small = np.flatnonzero(ends - first < k)
            if len(small):
                n = (ends - first)[small]
                keep = np.repeat(ends - first < k, ends - first)
                vals = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(v[keep]))
                m = len(small)
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(small)) for c in names], pa.array(np.full(m, part)), pa.array(np.ones(m, np.int64)), vals, pa.array(np.zeros(m))], schema=schema)

        rows: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            if b.num_rows:
                rows.append(b)
                n += b.num_rows
            if n >= CHUNK:
                yield from flush(rows)
                rows, n = [], 0
        if n:
            yield from flush(rows)
        for g, s in held.items():
            yield from _emit(schema, by, [(g, s)], part).to_batches()

    return run


def _groups(t: pa.Table, by: list[str]) -> tuple[np.ndarray, np.ndarray]:
    first = starts(t.to_batches()[0], by)
    return first, np.r_[first[1:], t.num_rows]


def _merge(by: list[str], keys: list[str], k: int):
    """Unite the sketches of each group of keys into one."""
    schema = arrow_schema(_ddl(by))

    def run(t: pa.Table) -> Iterator[pa.Table]:
        t = t.combine_chunks()
        first, ends = _groups(t, keys)
        lists = t["vals"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        off, vals = lists.offsets.to_numpy(), lists.values.to_numpy()
        w, err, part = t["w"].to_numpy(), t["err"].to_numpy(), t["part"].to_numpy()
        tops = np.maximum.reduceat(w, first)
        n = off[ends] - off[first]
        small = (tops == 1) & (n < k)
        at = np.flatnonzero(small)
        if len(at):
            row = np.repeat(np.arange(len(first)), ends - first)
            g = np.repeat(row, np.diff(off))
            v = vals[off[0] : off[-1]]
            keep = small[g]
            g, v = g[keep], v[keep]
            v = v[np.lexsort((v, g))]
            sizes = np.r_[0, np.cumsum(n[at])].astype(np.int32)
            head = t.take(pa.array(first[at]))
            m = len(at)
            yield pa.Table.from_arrays([*[head[b] for b in by], head["part"], pa.array(np.ones(m, np.int64)), pa.ListArray.from_arrays(pa.array(sizes), pa.array(v)), pa.array(np.add.reduceat(err, first)[at])], schema=schema)
        for i in np.flatnonzero(~small):
            s = Sketch(k)
            for r in range(first[i], ends[i]):
                s.merge(int(w[r]), vals[off[r] : off[r + 1]], float(err[r]))
            g = tuple(t[b][int(first[i])].as_py() for b in by)
            yield _emit(schema, by, [(g, s)], int(part[first[i]]))

    return run


def _meet(parts: DataFrame, by: list[str], n: int, k: int) -> DataFrame:
    while n > MEET:
        parts = parts.withColumn("part", F.floor(F.col("part") / MEET).cast("long"))
        parts = chunked_map(parts, [*by, "part"], _merge(by, [*by, "part"], k), _ddl(by), order=["w", "vals"])
        n = -(-n // MEET)
    return chunked_map(parts, by, _merge(by, by, k), _ddl(by), order=["part", "w", "vals"])


def sketch(df: DataFrame, by: list[str], value: str, k: int = K) -> DataFrame:
    """The sketch of each group: rows (by..., part, w, vals, err), storable as a table."""
    rows = df.select(*[F.col(b).cast("string").alias(b) for b in by], F.col(value).cast("double").alias("value")).where("value is not null and not isnan(value)")
    return _meet(rows.mapInArrow(_scan(by, k), _ddl(by)), by, max(1, rows.rdd.getNumPartitions()), k)


def merge_sketches(sketches: DataFrame, by: list[str], pieces: int | None = None, k: int = K) -> DataFrame:
    """Unite stored sketches (of days, files, finer groups) into one for each group of by; pieces: how many buffers a group may have, counted where it is not given.

    A task meets about MEET buffers of a group, so groups of more than that
    unite in rounds.
    """
    if pieces is None:
        sketches = checkpointed(sketches)
        pieces = sketches.groupBy(*by).count().agg(F.max("count")).first()[0] or 1
    # buffers of one sketch may part: its error stays on one of them, and errors add up
    parts = sketches.select(*by, F.pmod(F.xxhash64(*[c for c in sketches.columns if c not in by]), F.lit(max(1, pieces))).alias("part"), "w", "vals", "err")
    return _meet(parts, by, pieces, k)


def percentiles(sketches: DataFrame, by: list[str], qs: list[float]) -> DataFrame:
    """(by..., n, q, value, rank_error): rank_error bounds the distance from rank ceil(q * n)."""
    out = ", ".join([f"{b} string" for b in by] + ["n long", "q double", "value double", "rank_error double"])
    schema = arrow_schema(out)

    def run(t: pa.Table) -> Iterator[pa.Table]:
        t = t.combine_chunks()
        first, ends = _groups(t, by)
        lists = t["vals"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        off, vals = lists.offsets.to_numpy(), lists.values.to_numpy()
        w, err = t["w"].to_numpy(), t["err"].to_numpy()
        ns, vs = np.zeros(len(first), np.int64), np.zeros((len(first), len(qs)))
        for i, (a, b) in enumerate(zip(first, ends)):
            if b - a == 1 and w[a] == 1:
                n = off[b] - off[a]
                ns[i], vs[i] = n, vals[off[a] + np.clip(np.ceil(np.array(qs) * n), 1, n).astype(np.int64) - 1]
            else:
                s = Sketch(1 << 62)
                s.levels = {0: []}
                parts = [(int(w[r]), vals[off[r] : off[r + 1]]) for r in range(a, b)]
                s.buffers = lambda parts=parts: iter(parts)  # type: ignore[method-assign]
                ns[i], vs[i] = s.query(qs)
        row = np.repeat(np.arange(len(first)), len(qs))
        head = t.take(pa.array(first))
        e = np.add.reduceat(err, first)
        yield pa.Table.from_arrays([*[head[b].take(pa.array(row)) for b in by], pa.array(ns[row]), pa.array(np.tile(qs, len(first))), pa.array(vs.ravel()), pa.array(e[row])], schema=schema)

    return chunked_map(sketches, by, run, out, order=["w", "vals"])
