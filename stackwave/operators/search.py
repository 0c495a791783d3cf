"""Detect and locate: stack images over an octree, find peaks, refine, interpolate.

images(batch_id, sta_idx, phase, tmin_us, rate_hz, samples) hold probabilities.
Each batch is one group; its state is the stack's maximum per sample and the
batch's tree, split around its peaks, so a batch runs in one task and batches
run apart. A batch's size is bounded by its length, not by the data.

After every split the threshold, the peaks of the whole batch and the nodes to
split next are sought anew: each peak's node, the densest leaf at its sample
and the leaves that touch them, until all of these are smallest.

With core_us given, images are read with padding on both sides of a batch's
core [batch_id * core_us + origin_us, + core_us); only peaks in the core count,
so an event near an edge comes out of one batch. Images of a batch agree in
rate, and a station has one image of a phase; else the batch is an error.

Exact mode takes the maximum over all leaves; incremental mode compares only
new nodes with the value before, as cheaper pipelines do.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stackwave.functions.signal import find_peaks, refine_maximum
from stackwave.operators.octree import Bounds
from stackwave.operators.stack import kernel
from stackwave.plans.dist import arrow_schema, grouped_map

_FOUND = "batch_id long, time_us long, east double, north double, depth double, semblance double, n_stations int, distance_border double, node_size double, in_bounds boolean"


@dataclass
class Settings:
    bounds: Bounds
    root_size: float
    levels: int
    velocities: dict[str, float]
    weights: dict[str, float] = field(default_factory=dict)
    threshold: float | str = "MAD"
    blinding_s: float = 1.0
    required_stations: int = 4
    taper: float = 20_000.0
    waterlevel: float = 0.0
    border: float = 0.0
    incremental: bool = False
    core_us: int | None = None
    origin_us: int = 0


def _tt(nodes: np.ndarray, stations: np.ndarray, v: float) -> tuple[np.ndarray, np.ndarray]:
    d = np.sqrt(((nodes[:, None, :2] - stations[None, :, :2]) ** 2).sum(2) + (nodes[:, None, 2] + stations[None, :, 2]) ** 2)
    return d, d / v


def station_weights(d: np.ndarray, required: int, taper: float, waterlevel: float) -> np.ndarray:
    k = min(required, d.shape[1]) - 1
    dk = np.sort(d, axis=1)[:, k : k + 1]
    x = np.where(d <= dk, 1.0, np.exp(-((d - dk) ** 2) / (2 * (taper / 2.355) ** 2)))
    x = (1 - waterlevel) * x + waterlevel
    x /= x.sum(1, keepdims=True)
    return np.where(x < 1e-3, 0.0, x)


def root_nodes(b: Bounds, size: float) -> np.ndarray:
    ne, nn, nd = b.counts(size)
    i = np.arange(ne * nn * nd)
    return np.stack([b.east[0] + (i % ne + 0.5) * size, b.north[0] + (i // ne % nn + 0.5) * size, b.depth[0] + (i // (ne * nn) + 0.5) * size], 1)


def children(nodes: np.ndarray, size: float) -> np.ndarray:
    o = np.array([(e, n, d) for e in (-1, 1) for n in (-1, 1) for d in (-1, 1)], float) * size / 4
    return (nodes[:, None] + o[None]).reshape(-1, 3)


def _border(p: np.ndarray, b: Bounds) -> float:
    return float(min(p[0] - b.east[0], b.east[1] - p[0], p[1] - b.north[0], b.north[1] - p[1], b.depth[1] - p[2]))


def search(images: DataFrame, stations: list[tuple[int, float, float, float]], s: Settings, tracer: Callable | None = None) -> DataFrame:
    """Detections of every batch. stations: (sta_idx, east, north, elevation), a run's inventory; tracer(nodes, stations, phase) may replace constant velocities, NaN where nothing arrives."""
    schema = arrow_schema(_FOUND)
    where = {i: np.array([e, n, h]) for i, e, n, h in stations}
    b = s.bounds

    def run(key: tuple, t: pa.Table) -> Iterator[pa.Table]:
        rates = set(t["rate_hz"].to_pylist())
        if len(rates) > 1:
            raise ValueError(f"images of batch {key[0]} differ in rate: {sorted(rates)}")
        rate, t0 = float(rates.pop()), min(t["tmin_us"].to_pylist())
        twice = [k for k, n in Counter(zip(t["sta_idx"].to_pylist(), t["phase"].to_pylist())).items() if n > 1]
        if twice:
            raise ValueError(f"batch {key[0]} has more than one image of {twice[0]}")
        core = (-np.inf, np.inf) if s.core_us is None else (key[0] * s.core_us + s.origin_us, (key[0] + 1) * s.core_us + s.origin_us)
        slack = 1e6 * (s.root_size / min(s.velocities.values()) + s.blinding_s)
        rows = [(i, p, round((m - t0) * rate / 1e6), np.array(x, float)) for i, p, m, x in zip(t["sta_idx"].to_pylist(), t["phase"].to_pylist(), t["tmin_us"].to_pylist(), t["samples"].to_pylist()) if i in where and p in s.velocities]
        if not rows:
            return
        st = np.array([where[i] for i, *_ in rows])
        n = max(o + len(x) for _, _, o, x in rows)
        samples, offsets = [x for *_, x in rows], np.array([o for _, _, o, _ in rows])
        phases = np.array([p for _, p, _, _ in rows])

        def shifts(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            sh, we = np.zeros((len(nodes), len(rows)), np.int64), np.zeros((len(nodes), len(rows)))
            for p in np.unique(phases):
                k = np.flatnonzero(phases == p)
                d, tt = _tt(nodes, st[k], s.velocities[p])
                if tracer is not None:
                    tt = tracer(nodes, st[k], p)
                w = np.where(np.isnan(tt), 0.0, station_weights(d, s.required_stations, s.taper, s.waterlevel))
                sh[:, k] = np.rint(-np.nan_to_num(tt) * rate).astype(np.int64)
                we[:, k] = w * s.weights.get(p, 1.0)
            return sh, we

        def snapshot(at: int, nodes: np.ndarray) -> np.ndarray:
            """The stack of some nodes at one sample."""
            out = np.zeros(len(nodes))
            for r, x in enumerate(samples):
                i = at - offsets[r] - sh[nodes, r]
                ok = (i >= 0) & (i < len(x))
                out[ok] += we[nodes[ok], r] * x[i[ok]]
            return out

        def touching(k: int) -> np.ndarray:
            """The other leaves that share a face, edge or corner with a node."""
            far = np.abs(nodes - nodes[k]).max(1) - (sizes + sizes[k]) / 2
            near = leaf & (far <= 1e-6 * s.root_size)
            near[k] = False
            return np.flatnonzero(near)

        nodes = root_nodes(b, s.root_size)
        sizes, level, leaf = np.full(len(nodes), float(s.root_size)), np.zeros(len(nodes), int), np.ones(len(nodes), bool)
        sh, we = shifts(nodes)
        best, index = kernel(samples, offsets, sh, we, 0, n, floor=0.0)
        while True:
            gate = 10 * float(np.median(np.abs(best - np.median(best)))) if s.threshold == "MAD" else float(s.threshold)
            peaks = find_peaks(best, max(gate, 1e-9), max(1, int(s.blinding_s * rate)), gate)
            times = t0 + peaks / rate * 1e6
            peaks = peaks[(times >= core[0] - slack) & (times < core[1] + slack)]  # times still move while nodes are coarse
            wanted: set[int] = set()
            for at in peaks:
                k = int(index[at])
                if not leaf[k]:  # incremental only: a split node keeps its value
                    continue
                leaves = np.flatnonzero(leaf)
                dense = int(leaves[np.argmax(snapshot(int(at), leaves) / sizes[leaves] ** 3)])
                for c in {k, dense}:
                    wanted.update([c, *touching(c).tolist()])
            parents = np.array(sorted(k for k in wanted if level[k] + 1 < s.levels), int)
            if not len(parents):
                break
            old = len(nodes)
            kids = np.concatenate([children(nodes[k : k + 1], sizes[k]) for k in parents])
            leaf[parents] = False
            ksh, kwe = shifts(kids)
            nodes, sh, we = np.concatenate([nodes, kids]), np.concatenate([sh, ksh]), np.concatenate([we, kwe])
            sizes, level, leaf = np.r_[sizes, np.repeat(sizes[parents] / 2, 8)], np.r_[level, np.repeat(level[parents] + 1, 8)], np.r_[leaf, np.ones(len(kids), bool)]
            if s.incremental:
                got, which = kernel(samples, offsets, ksh, kwe, 0, n, best=best)
                index, best = np.where(got > best, old + which, index), got
            else:
                # samples that a split node held are stacked anew over all leaves, the others compare with the new ones
                lost = np.isin(index, parents)
                got, which = kernel(samples, offsets, ksh, kwe, 0, n, best=best)
                index, best = np.where(got > best, old + which, index), got
                edge = np.flatnonzero(np.diff(np.r_[False, lost, False]))
                for a, b_ in zip(edge[::2], edge[1::2]):
                    best[a:b_], index[a:b_] = kernel(samples, offsets, sh, we, a, b_, skip=~leaf, floor=0.0)
        out = []
        for at in map(int, peaks):
            k, time = int(index[at]), t0 + round(at / rate * 1e6)
            if not core[0] <= time < core[1]:
                continue
            near = np.r_[k, touching(k)]
            place, size = nodes[k], float(sizes[k])
            if len(near) > 4:
                place, _ = refine_maximum(nodes[near], snapshot(at, near), place, size / 1.5)
            edge = _border(place, b)
            out.append((key[0], time, *map(float, place), float(best[at]), len({i for i, *_ in rows}), edge, size, edge > s.border))
        yield pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out else [pa.nulls(0, f.type) for f in schema], schema=schema)

    return grouped_map(images, ["batch_id"], run, _FOUND, order=["sta_idx", "phase"])
