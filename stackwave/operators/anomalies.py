"""Implausible readings per source: ranges, stuck runs, and spikes by robust principal components.

Spikes. The readings of a source that are neither impossible nor stuck form a
daily profile matrix: rows are days (or equal groups of days, united further
where they hold few readings), columns the parts of a day, entries the median
log10 reading. Where levels follow distance, rows are distances and columns
groups of records. Robust principal components split it into an offset (and a
line of decay with distance), a low-rank part, the source's normal behaviour,
and a sparse part. Readings further than OFF from the level of their entry are
candidates. An exact check follows: a candidate stays a spike only
while it is at least `factor` times every sound reading it is compared with
(or, two-sided, at most 1 / factor of each); one that isn't becomes sound.

Scale. A source goes to one task whole; the few with more than PART_ROWS rows
are cut by time, into parts of equal size. Each of their parts gives counts, minima and maxima per matrix
entry and value bin, a bounded number, and the readings at its first and last
times, where runs across parts are settled. Where such bins leave open whether
a reading lies in the distance window of another, the readings of the open bins
are checked by their own distances, against the few sound ones that can decide.
Only ids of cases leave a task.

Defined cases: null and NaN are neither cases nor sound and end a run, as does
a time at which the source lacks the value; a source of fewer than `least`
rows has no spikes; without a comparable sound reading there is no spike; a
null source or time takes part in the range test only; repeated rows count
each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackwave.plans.dist import arrow_schema, checkpointed, chunked_map, grouped_map, sorted_chunks

ROWS, SLOTS = 64, 4  # of a daily profile matrix
SITE_ROWS, SITE_SLOTS = 16, 24
VBINS = 20  # value bins per decade
FINE = 32  # fine distance bins per factor of the distance window
OFF = 0.9  # decades from the normal level that make a candidate
HUGE = 1e30
PART_ROWS = 50_000  # rows beyond which a source is cut by time
BUCKETS = 1 << 20
MOST_PARTS = 100_000
RUN = 5


def usable(v: Column, zero_is_missing: bool = False) -> Column:
    ok = v.isNotNull() & ~F.isnan(v)
    return ok & (v != 0.0) if zero_is_missing else ok


def impossible(v: Column, zero: bool) -> Column:
    return usable(v) & ((v < 0.0) | (v >= HUGE) | ((v == 0.0) if zero else F.lit(False)))


def pursuit(m: np.ndarray, seen: np.ndarray, x: np.ndarray | None = None, steps: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Robust principal components of each matrix of m (batch, rows, columns): m = offset + slope * x + low + sparse.

    low is of low rank, sparse of few entries; the offset (and the slope, where
    x is given) are of no cost. Alternating multipliers from a least absolute
    deviation fit; unseen entries are free. Returns offset, slope and low.
    """
    k, rows, columns = m.shape
    lam = (1 / np.sqrt(np.maximum(seen.any(2).sum(1), columns)))[:, None, None]
    w0 = seen.astype(float)
    m = np.where(seen, m, 0.0)
    x = np.zeros_like(m) if x is None else np.where(seen, x, 0.0)
    offset, slope = np.zeros((2, k, 1, 1))

    def line(y: np.ndarray, w: np.ndarray) -> None:
        nonlocal offset, slope
        total = np.maximum(w.sum((1, 2), keepdims=True), 1e-12)
        mx, my = (w * x).sum((1, 2), keepdims=True) / total, (w * y).sum((1, 2), keepdims=True) / total
        dx = x - mx
        slope = (w * dx * (y - my)).sum((1, 2), keepdims=True) / np.maximum((w * dx * dx).sum((1, 2), keepdims=True), 1e-9)
        offset = my - slope * mx

    line(m, w0)
    for _ in range(12):
        line(m, w0 / np.maximum(np.abs(m - offset - slope * x), 0.05))
    d = np.where(seen, m - offset - slope * x, 0.0)
    norm = np.sqrt(np.maximum(np.linalg.eigvalsh(np.swapaxes(d, 1, 2) @ d)[:, -1], 1e-12))[:, None, None]
    y = d / np.maximum(norm, np.abs(d).max((1, 2), keepdims=True) / lam)
    mu, s, low = 1.25 / norm, np.zeros_like(m), np.zeros_like(m)
    for _ in range(steps):
        a = m - offset - slope * x - s + y / mu
        w, v = np.linalg.eigh(np.swapaxes(a, 1, 2) @ a)
        sv = np.sqrt(np.maximum(w, 1e-24))
        keep = np.maximum(sv - 1 / mu[:, 0], 0) / sv
        low = ((a @ v) * keep[:, None, :]) @ np.swapaxes(v, 1, 2)
        line(m - low - s + y / mu, w0)
        r = m - offset - slope * x - low + y / mu
        s = np.where(seen, np.sign(r) * np.maximum(np.abs(r) - lam / mu, 0), r)
        y = y + mu * (m - offset - slope * x - low - s)
        mu = mu * 1.5
    return offset[:, 0, 0], slope[:, 0, 0], low


def _weighted_rank(v: np.ndarray, n: np.ndarray, group: np.ndarray, q: float) -> tuple[np.ndarray, np.ndarray]:
    """(group, value at share q) for groups of weighted values."""
    o = np.lexsort((v, group))
    g, cum = group[o], np.cumsum(n[o])
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    base = np.r_[0, cum][first]
    total = np.r_[cum[first[1:] - 1], cum[-1]] - base
    at = np.searchsorted(cum, base + np.maximum(q * total, 0.5), side="left")
    return g[first], v[o][np.minimum(at, len(o) - 1)]


def grouped_rows(source: np.ndarray, row: np.ndarray, n: np.ndarray, rows: int, fill: int = 8) -> np.ndarray:
    """Rows of each source's matrix, neighbours united until each holds about `fill` readings."""
    k = int(source[-1]) + 1
    held = np.bincount(source * rows + row, n, k * rows).reshape(k, rows)
    each = np.maximum(fill, held.sum(1, keepdims=True) / rows)
    return ((np.cumsum(held, 1) - held) // each).astype(np.int64)[source, row]


def candidates(source: np.ndarray, row: np.ndarray, slot: np.ndarray, logv: np.ndarray, n: np.ndarray, rows: int, slots: int, x: np.ndarray | None = None) -> np.ndarray:
    """Which readings lie in the sparse part: further than OFF from their entry's low-rank level; source is 0..k-1, sorted.

    x is what levels fall with (log distance). A level that less than a fifth
    of a source's readings share, on either side, is no normal behaviour: the
    low-rank part is taken within those bounds.
    """
    k = int(source[-1]) + 1
    out = np.zeros(len(source), bool)
    per = max(1, 2_000_000 // (rows * slots))
    cut = np.searchsorted(source, np.arange(0, k + per, per))
    for a, b in zip(cut[:-1], cut[1:]):
        if a == b:
            continue
        s0, s1 = int(source[a]), int(source[b - 1]) + 1
        s, v, w = source[a:b] - s0, logv[a:b], n[a:b]
        r = row[a:b] if x is not None else grouped_rows(s, row[a:b], w, rows)
        cell = (s * rows + r) * slots + slot[a:b]
        at, med = _weighted_rank(v, w, cell, 0.5)
        m, seen = np.zeros((s1 - s0) * rows * slots), np.zeros((s1 - s0) * rows * slots, bool)
        m[at], seen[at] = med, True
        shape = (-1, rows, slots)
        if x is None:
            offset, _, low = pursuit(m.reshape(shape), seen.reshape(shape))
            base = offset[s]
        else:
            xs = x[a:b]
            mx = np.bincount(cell, w * xs, len(m)) / np.maximum(np.bincount(cell, w, len(m)), 1e-12)
            offset, slope, low = pursuit(m.reshape(shape), seen.reshape(shape), mx.reshape(shape))
            base = offset[s] + slope[s] * xs
        low = low.ravel()[cell]
        least, most = np.zeros((2, s1 - s0))
        for bound, q in ((least, 0.2), (most, 0.8)):
            g, value = _weighted_rank(low, w, s, q)
            bound[g] = value
        out[a:b] = np.abs(v - base - np.clip(low, least[s], most[s])) > OFF
    return out


def settle(vmin: np.ndarray, vmax: np.ndarray, cand: np.ndarray, factor: float, both: bool) -> np.ndarray:
    """Exact check where all readings of a source compare: the candidates that are spikes."""
    case = cand.copy()
    while case.any():
        sound = ~case
        if not sound.any():
            return np.zeros_like(case)
        top, bottom = vmax[sound].max(), vmin[sound].min()
        still = case & ((vmin >= factor * top) | ((vmax <= bottom / factor) & both))
        if (still == case).all():
            break
        case = still
    return case


def _range_max(v: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Greatest of v[lo:hi] for each pair of bounds (lo < hi), over a table of doubling spans."""
    table = [v]
    while 2 << (len(table) - 1) <= len(v):
        step = 1 << (len(table) - 1)
        table.append(np.maximum(table[-1][:-step], table[-1][step:]))
    level = np.frexp((hi - lo).astype(float))[1] - 1
    out = np.empty(len(lo))
    for k in np.unique(level):
        u = np.flatnonzero(level == k)
        out[u] = np.maximum(table[k][lo[u]], table[k][hi[u] - (1 << k)])
    return out


def settle_near(vmin, vmax, dmin, dmax, cand, factor: float, width: float, sure: bool = False) -> np.ndarray:  # noqa: ANN001
    """The same where readings compare at distances within a factor of width (those without distance with none).

    For entries of several readings the result is the cases whatever lies where:
    partly overlapping entries count as near. With sure it is those that may be
    cases: only entries near for all readings of both count, and one reading of
    an entry is enough.
    """
    case = cand & ~np.isnan(dmin)
    o = np.flatnonzero(~np.isnan(dmin))
    o = o[np.argsort(dmin[o], kind="stable")]
    low, high = dmin[o], np.maximum.accumulate(dmax[o])
    while case.any():
        at = np.flatnonzero(case)
        if sure:  # each surely near entry begins late enough and ends early enough; as ends follow starts up to a bin, the last ones are tried
            lo, hi = np.searchsorted(low * width, dmax[at], "left"), np.searchsorted(high, dmin[at] * width, "right")
        else:
            lo, hi = np.searchsorted(high * width, dmin[at], "left"), np.searchsorted(low, dmax[at] * width, "right")
        sound = ~case[o]
        some = hi > lo
        top, bottom = np.full(len(at), -np.inf), np.full(len(at), np.inf)
        top[some] = _range_max(np.where(sound, vmax[o], -np.inf), lo[some], hi[some])
        bottom[some] = -_range_max(np.where(sound, -vmin[o], -np.inf), lo[some], hi[some])
        still = case.copy()
        v1, v2 = (vmax[at], vmin[at]) if sure else (vmin[at], vmax[at])
        off = (v1 >= factor * top) | (v2 <= bottom / factor)
        still[at] = (off | ~np.isfinite(top)) if sure else (np.isfinite(top) & off)
        if (still == case).all():
            break
        case = still
    return case


# What one task finds out: 0 a case (id, reason), 1 an entry of a source that is cut
# into parts, 2 a reading beside a part's border, 3 a stuck value at a time.
_NOTES = (
    "kind int, field string, source string, id long, reason int, part long, head int, tail int, t long, value double, "
    "row int, slot int, fbin int, vbin int, n long, rows long, vmin double, vmax double, dmin double, dmax double"
)
_NOTE_TYPES = arrow_schema(_NOTES)


def _column(v, f: pa.Field, size: int) -> pa.Array:  # noqa: ANN001
    if v is None:
        return pa.nulls(size, f.type)
    if isinstance(v, (pa.Array, pa.ChunkedArray)):
        return v.cast(f.type)
    return pa.array(np.full(size, v) if np.ndim(v) == 0 else v, f.type, from_pandas=True)  # NaN becomes null


def _notes(size_: int, **given) -> pa.Table:  # noqa: ANN003
    return pa.Table.from_arrays([_column(given.get(f.name), f, size_) for f in _NOTE_TYPES], schema=_NOTE_TYPES)


def runs_of(group: np.ndarray, rank: np.ndarray, v: np.ndarray, run: int) -> np.ndarray:
    """Which readings lie in a run: one value at `run` or more consecutive ranks of its group; NaN never does."""
    at = np.flatnonzero(~np.isnan(v))
    at = at[np.lexsort((rank[at], v[at], group[at]))]
    out = np.zeros(len(v), bool)
    if not len(at):
        return out
    new = np.r_[True, (group[at][1:] != group[at][:-1]) | (v[at][1:] != v[at][:-1]) | (np.diff(rank[at]) > 1)]
    first = np.flatnonzero(new)
    length = rank[at][np.r_[first[1:], len(at)] - 1] - rank[at][first] + 1
    out[at] = (length >= run)[np.cumsum(new) - 1]
    return out


def spikes_of(source, total, row, slot, v1, v2, d1, d2, n, least: int, factor: float, both: bool, width: float | None) -> np.ndarray:  # noqa: ANN001
    """(row numbers, whether open) of the entries that are spikes or, where distances of several readings leave it open, may be; source sorted, total its number of rows, v1..v2 and d1..d2 the values and distances of an entry."""
    use = np.flatnonzero(total >= least)
    if not len(use):
        return use, np.zeros(0, bool)
    _, s = np.unique(source[use], return_inverse=True)
    logv = (np.log10(v1[use]) + np.log10(v2[use])) / 2
    row, slot = row[use].astype(np.int64), slot[use].astype(np.int64)
    if width is None:
        cand = candidates(s, row, slot, logv, n[use].astype(float), ROWS, SLOTS)
    else:  # matrix rows are distances, counted from the nearest one; readings without distance compare with none
        none = np.isnan(d1[use])
        _, nearest = _weighted_rank(np.where(none, np.inf, slot), np.ones(len(slot)), s, 0.0)
        step = np.clip(slot - np.where(np.isfinite(nearest), nearest, 0).astype(np.int64)[s], 0, SITE_SLOTS - 1)
        x = (np.log10(np.where(none, 1.0, d1[use])) + np.log10(np.where(none, 1.0, d2[use]))) / 2
        cand = np.zeros(len(use), bool)
        if not none.all():
            u = np.flatnonzero(~none)
            _, su = np.unique(s[u], return_inverse=True)
            cand[u] = candidates(su, step[u], row[u], logv[u], n[use][u].astype(float), SITE_SLOTS, SITE_ROWS, x[u])
    out: list[np.ndarray] = []
    unsure: list[np.ndarray] = []
    edges = np.r_[np.flatnonzero(np.r_[True, s[1:] != s[:-1]]), len(s)]
    some = np.add.reduceat(cand, edges[:-1]) > 0
    for a, b in zip(edges[:-1][some], edges[1:][some]):
        u = use[a:b]
        if width is None:
            hit = may = settle(v1[u], v2[u], cand[a:b], factor, both)
        else:
            hit = settle_near(v1[u], v2[u], d1[u], d2[u], cand[a:b], factor, width)
            may = hit if (d1[u] == d2[u])[~np.isnan(d1[u])].all() else hit | settle_near(v1[u], v2[u], d1[u], d2[u], cand[a:b], factor, width, sure=True)
        out.append(u[may])
        unsure.append(~hit[may])
    return np.concatenate(out or [use[:0]]), np.concatenate(unsure or [np.zeros(0, bool)])


def _entries(field: str, t: pa.Table, src: np.ndarray, at: np.ndarray, c: dict, v: np.ndarray, vb: np.ndarray) -> pa.Table:
    """Counts and bounds per source, matrix entry and value bin of the readings `at`."""
    key = [vb[at], c["fbin"][at], c["slot"][at], c["row"][at], src[at]]
    o = np.lexsort(key)
    at, key = at[o], [k[o] for k in key]
    new = np.zeros(len(at), bool)
    for k in key:
        new[1:] |= k[1:] != k[:-1]
    new[:1] = True
    first = np.flatnonzero(new)
    f = lambda u, x: u.reduceat(x[at], first) if len(first) else x[:0]
    pick = at[first]
    return _notes(
        len(first), kind=1, field=field, source=t["source"].take(pa.array(pick)), row=c["row"][pick], slot=c["slot"][pick], fbin=c["fbin"][pick], vbin=vb[pick],
        n=np.diff(np.r_[first, len(at)]), rows=0, vmin=f(np.minimum, v), vmax=f(np.maximum, v), dmin=f(np.fmin, c["d"]), dmax=f(np.fmax, c["d"]),
    )


def _bins(v: np.ndarray) -> np.ndarray:
    ok = (v > 0) & np.isfinite(v)
    return np.where(ok, np.floor(np.log10(np.where(ok, v, 1.0)) * VBINS), 0).astype(np.int64)


def _first_pass(fields: list[str], two_sided: tuple[str, ...], least: int, factor: float, width: float | None, run: int):
    def analyse(t: pa.Table) -> Iterator[pa.Table]:
        t = t.combine_chunks()
        c = {k: t[k].to_numpy(zero_copy_only=False) for k in ("part", "parts", "t", "d", "row", "slot", "fbin")}
        ids = t["id"].to_numpy()
        name = t["source"].combine_chunks().dictionary_encode()
        src = (name if isinstance(name, pa.DictionaryArray) else name.combine_chunks()).indices.to_numpy().astype(np.int64)
        src = np.cumsum(np.r_[0, src[1:] != src[:-1]])
        group = np.cumsum(np.r_[0, (src[1:] != src[:-1]) | (np.diff(c["part"]) != 0)])
        rank = np.cumsum(np.r_[0, (group[1:] != group[:-1]) | (np.diff(c["t"]) != 0)])
        begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        end = np.r_[begin[1:], len(group)] - 1
        head, tail = rank - rank[begin][group], rank[end][group] - rank
        total = np.bincount(src)[src]
        cut = c["parts"] > 1
        edge = cut & ((head < run - 1) | (tail < run - 1))
        for f in fields:
            v, bad = t[f].to_numpy(zero_copy_only=False).astype(float), t[f"bad_{f}"].to_numpy(zero_copy_only=False).astype(bool)
            stuck = runs_of(group, rank, v, run)
            # beside a border a run may go on; it is settled there
            sound = ~np.isnan(v) & ~bad & ~stuck
            hit = np.flatnonzero(stuck)
            yield _notes(len(hit), kind=0, field=f, id=ids[hit], reason=2)
            whole = np.flatnonzero(sound & ~cut)
            if len(whole):
                w, _ = spikes_of(src[whole], total[whole], c["row"][whole], c["slot"][whole], v[whole], v[whole], c["d"][whole], c["d"][whole], np.ones(len(whole)), least, factor, f in two_sided, width)
                yield _notes(len(w), kind=0, field=f, id=ids[whole[w]], reason=3)
            if not cut.any():
                continue
            vb = _bins(v)
            yield _entries(f, t, src, np.flatnonzero(sound & cut & ~edge), c, v, vb)
            first = np.flatnonzero(np.r_[True, src[1:] != src[:-1]] & cut)  # rows of a source, whatever they hold
            yield _notes(len(first), kind=1, field=f, source=t["source"].take(pa.array(first)), row=0, slot=0, fbin=0, vbin=0, n=0, rows=np.bincount(src)[src[first]])
            # equal values at one time (and place) beside a border need one note; every time beside one needs a note
            b = np.flatnonzero(edge)
            o = b[np.lexsort((c["fbin"][b], v[b], c["t"][b], group[b]))]
            keep = np.r_[True, (group[o][1:] != group[o][:-1]) | (np.diff(c["t"][o]) != 0) | ~((v[o][1:] == v[o][:-1]) | (np.isnan(v[o][1:]) & np.isnan(v[o][:-1]))) | (np.diff(c["fbin"][o]) != 0)] if len(o) else np.zeros(0, bool)
            first, n = np.flatnonzero(keep), np.diff(np.r_[np.flatnonzero(keep), len(o)])
            k = o[first]
            yield _notes(
                len(k), kind=2, field=f, source=t["source"].take(pa.array(k)), reason=np.where(stuck[k], 2, np.where(bad[k], 1, 0)), part=c["part"][k], head=head[k], tail=tail[k], t=c["t"][k], value=v[k],
                row=c["row"][k], slot=c["slot"][k], fbin=c["fbin"][k], vbin=vb[k], n=n, rows=0, dmin=c["d"][k], dmax=c["d"][k],
            )

    return analyse


def _border_pass(run: int):
    """Runs across the borders of parts; the readings beside a border that are in none become entries."""

    def analyse(key: tuple, t: pa.Table) -> Iterator[pa.Table]:
        t = t.combine_chunks()
        c = {k: t[k].to_numpy(zero_copy_only=False) for k in ("part", "head", "tail", "t", "value", "row", "slot", "fbin", "vbin", "n", "reason", "own", "dmin")}
        o = np.lexsort((c["t"], c["part"]))
        t, c = t.take(pa.array(o)), {k: v[o] for k, v in c.items()}
        step = np.r_[0, (np.diff(c["part"]) != 0) | (np.diff(c["t"]) != 0)]
        # inside a part, what lies between its first and last times is absent: no run goes over it
        step[1:] += (np.diff(c["part"]) == 0) & (np.diff(c["head"]) > 1)
        rank = np.cumsum(step)
        stuck = runs_of(np.zeros(len(rank), np.int64), rank, c["value"], run)
        own = c["own"].astype(bool)
        k = np.flatnonzero(stuck & own & (c["reason"] != 2))
        yield _notes(len(k), kind=3, field=key[0], source=key[1], t=c["t"][k], value=c["value"][k])
        k = np.flatnonzero(~stuck & own & (c["reason"] == 0) & ~np.isnan(c["value"]))
        v = c["value"][k]
        yield _notes(len(k), kind=1, field=key[0], source=key[1], row=c["row"][k], slot=c["slot"][k], fbin=c["fbin"][k], vbin=c["vbin"][k], n=c["n"][k], rows=0, vmin=v, vmax=v, dmin=c["dmin"][k], dmax=c["dmin"][k])

    return analyse


_SPIKES = "field string, source string, fbin int, vbin int, open boolean"


def _cut_sources(two_sided: tuple[str, ...], least: int, factor: float, width: float | None):
    """The spikes' bins of sources that were cut into parts, from their united entries."""
    schema = arrow_schema(_SPIKES)

    def run(t: pa.Table) -> Iterator[pa.Table]:
        t = t.combine_chunks()
        c = {k: t[k].to_numpy(zero_copy_only=False) for k in ("row", "slot", "fbin", "vbin", "n", "rows", "vmin", "vmax", "dmin", "dmax")}
        field, src = t["field"].to_numpy(zero_copy_only=False), t["source"].to_numpy(zero_copy_only=False)
        source = np.cumsum(np.r_[0, (field[1:] != field[:-1]) | (src[1:] != src[:-1])])
        total = np.bincount(source, c["rows"])[source]
        for f in np.unique(field):
            u = np.flatnonzero((field == f) & (c["n"] > 0))
            if not len(u):
                continue
            k, unsure = spikes_of(source[u], total[u], c["row"][u], c["slot"][u], c["vmin"][u], c["vmax"][u], c["dmin"][u], c["dmax"][u], c["n"][u], least, factor, f in two_sided, width)
            k = u[k]
            yield pa.Table.from_arrays([t["field"].take(pa.array(k)), t["source"].take(pa.array(k)), pa.array(c["fbin"][k].astype(np.int32)), pa.array(c["vbin"][k].astype(np.int32)), pa.array(unsure)], schema=schema)

    return run


_POINTS = "source string, fbin int, id long, d double, value double, open boolean"


def _frontier(key: tuple, t: pa.Table) -> Iterator[pa.Table]:
    """Of the sound readings of a distance bin those that can be the greatest or least up to, or from, some distance in it."""
    d, v = t["d"].to_numpy(), t["value"].to_numpy()
    keep = np.zeros(len(d), bool)
    for o in (np.lexsort((v, d)), np.lexsort((v, d))[::-1]):
        for x in (v[o], -v[o]):
            keep[o] |= x > np.r_[-np.inf, np.maximum.accumulate(x)[:-1]]
    yield t.select(arrow_schema(_POINTS).names).filter(pa.array(keep))


def _settle_open(factor: float, width: float):
    """The open readings of a source against its frontier points and each other: which are spikes."""

    def run(key: tuple, t: pa.Table) -> Iterator[pa.Table]:
        d, v, unsure = t["d"].to_numpy(), t["value"].to_numpy(), t["open"].to_numpy(zero_copy_only=False).astype(bool)
        hit = settle_near(v, v, d, d, unsure, factor, width)
        yield pa.table({"id": t["id"].filter(pa.array(hit))})

    return run


def _open_spikes(flat: DataFrame, bins: DataFrame, known: DataFrame, factor: float, width: float) -> DataFrame:
    """(field, id) of the spikes among the readings of open bins, by their own distances.

    Sound readings go by the bins that can't hold spikes, less what is known;
    a distance bin passes on only its frontier, in two rounds, so that neither
    a bin nor a source gathers in one task.
    """
    keys = ["field", "source", "fbin", "vbin"]
    mine = flat.where("d is not null").join(bins.where("open").select("field", "source").distinct(), ["field", "source"], "left_semi")
    open_ = mine.join(bins.where("open").select(*keys), keys, "left_semi")
    sound = mine.join(bins.select(*keys), keys, "left_anti").join(known.select("field", "id"), ["field", "id"], "left_anti")
    cols = ["field", "source", "fbin", "id", "d", "value"]
    sound = sound.select(*cols, F.lit(False).alias("open"))
    for by in (["field", "source", "fbin", "salt"], ["field", "source", "fbin"]):
        sound = _reduced(sound, by)
    both = sound.unionByName(open_.select(*cols, F.lit(True).alias("open")))
    found = grouped_map(both, ["field", "source"], _settle_open(factor, width), "id long", order=["d", "value", "id"])
    return open_.select("field", "id").join(found.distinct(), "id", "left_semi")


SALTS = 64


def _reduced(points: DataFrame, by: list[str]) -> DataFrame:
    out = f"field string, {_POINTS}"
    names = arrow_schema(out).names

    def run(key: tuple, t: pa.Table) -> Iterator[pa.Table]:
        for x in _frontier(key, t):
            yield x.append_column("field", pa.array([key[0]] * x.num_rows, pa.string())).select(names)

    return grouped_map(points.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))), by, run, out).select(*names)


SMALL = 100_000  # rows up to which a set of found keys is broadcast


def _rows_with(rows: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """rows whose keys occur in found (a checkpointed table): broadcast if it is small, else shuffled."""
    return rows.join(F.broadcast(found) if found.count() <= SMALL else found, keys, "left_semi")


def _anomalies(rows: DataFrame, fields: list[str], two_sided: tuple[str, ...], least: int, factor: float, width: float | None, part_rows: int, run: int = RUN) -> DataFrame:
    """rows(id, source, t, d, row, slot, fbin, fields, bad_fields): (field, row_id, reason).

    Sources enter one task whole, but for those in a bucket of more than
    part_rows rows, which are cut by time into parts of about that size.
    """
    placed = rows.where("source is not null and t is not null").withColumn("bucket", F.pmod(F.xxhash64("source"), F.lit(BUCKETS)))
    big = checkpointed(placed.groupBy("bucket").agg(F.count("*").alias("c")).where(F.col("c") > part_rows))
    cut_rows = big.agg(F.sum("c")).first()[0] or 0
    placed = placed.join(F.broadcast(big.select("bucket", F.lit(True).alias("cut"))), "bucket", "left").drop("bucket")  # a row for part_rows rows, BUCKETS at most
    first, order = _first_pass(fields, two_sided, least, factor, width, run), ["t", "id"]
    one = F.lit(1).cast("long")
    notes = chunked_map(placed.where("cut is null").drop("cut").withColumn("part", F.lit(0).cast("long")).withColumn("parts", one), ["source", "part"], first, _NOTES, order=order)
    if cut_rows:
        # parts of equal size in order of time, whatever the times' distribution; equal times of a source stay together
        parts = placed.where("cut").drop("cut").repartitionByRange(min(MOST_PARTS, -(-cut_rows // part_rows)), "source", "t").withColumn("part", F.spark_partition_id().cast("long")).withColumn("parts", one + 1)
        notes = notes.unionByName(sorted_chunks(parts, ["source", "part"], first, _NOTES, order=order))
    notes = checkpointed(notes)
    out = notes.where("kind = 0").select("field", "id", "reason")
    for f in fields:
        out = out.unionByName(rows.where(F.col(f"bad_{f}")).select(F.lit(f).alias("field"), "id", F.lit(1).alias("reason")))
    # parts that hold anything, counted per source, so that the parts beside a block are those of the times beside it
    numbers = notes.where("kind = 2").select("field", "source", "part").distinct().withColumn("_i", F.row_number().over(Window.partitionBy("field", "source").orderBy("part")))
    home = F.floor(F.col("part") / 1000)
    edges = notes.where("kind = 2").join(numbers, ["field", "source", "part"]).withColumn("part", F.col("_i").cast("long")).drop("_i").withColumn("blk", F.explode(F.array_distinct(F.array(home, F.floor((F.col("part") - 10) / 1000), F.floor((F.col("part") + 10) / 1000)))))
    edges = edges.withColumn("own", F.col("blk") == home).withColumn("blk", F.col("blk").cast("long"))
    beside = checkpointed(grouped_map(edges, ["field", "source", "blk"], _border_pass(run), _NOTES))
    entries = notes.where("kind = 1").unionByName(beside.where("kind = 1")).groupBy("field", "source", "row", "slot", "fbin", "vbin").agg(
        F.sum("n").alias("n"), F.sum("rows").alias("rows"), F.min("vmin").alias("vmin"), F.max("vmax").alias("vmax"), F.min("dmin").alias("dmin"), F.max("dmax").alias("dmax")
    )
    bins = chunked_map(entries, ["field", "source"], _cut_sources(two_sided, least, factor, width), _SPIKES)
    bins = checkpointed(bins.groupBy("field", "source", "fbin", "vbin").agg(F.max("open").alias("open")))
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.when(~F.col(f"bad_{f}"), F.col(f)).alias("value")) for f in fields])).alias("x")
    flat = rows.where("source is not null and t is not null").select("id", "source", "t", "d", "fbin", each).select("id", "source", "t", "d", "fbin", "x.*").where("value is not null").withColumn("vbin", vbin(F.col("value")))
    held = beside.where("kind = 3").select("field", "source", "t", "value").distinct()
    out = out.unionByName(_rows_with(flat, held, ["field", "source", "t", "value"]).select("field", "id", F.lit(2).alias("reason")))
    if width is not None and not bins.where("open").isEmpty():
        out = out.unionByName(_open_spikes(flat, bins, out, factor, width).withColumn("reason", F.lit(3)))
    out = out.unionByName(_rows_with(flat, bins.where("not open"), ["field", "source", "fbin", "vbin"]).select("field", "id", F.lit(3).alias("reason")))
    why = F.element_at(F.array(*[F.lit(x) for x in ("impossible", "stuck", "spike")]), F.min("reason"))
    return out.groupBy("field", F.col("id").alias("row_id")).agg(why.alias("reason"))


def vbin(v: Column) -> Column:
    return F.when((v > 0) & (v < float("inf")), F.floor(F.log10(v) * VBINS)).otherwise(0).cast("int")


def station_anomalies(rows: DataFrame, rid: str, source: str, time_us: Column, fields: dict[str, bool], least: int = 30, factor: float = 10.0, part_rows: int = PART_ROWS) -> DataFrame:
    """(field, row_id, reason) of the implausible readings of each source over time.

    fields names the columns; True where zero is impossible and a reading may
    also be too low, False where zero means missing and only high ones count.
    reason is impossible, stuck or spike, the first that holds.
    """
    base = rows.select(F.col(rid).cast("long").alias("id"), F.col(source).cast("string").alias("source"), time_us.alias("t"), *[F.col(f).cast("double").alias(f) for f in fields])
    span = base.agg(F.min("t").alias("lo"), F.max("t").alias("hi")).first()
    day = 86_400_000_000
    first = (span["lo"] or 0) // day
    stride = max(1, -(-((span["hi"] or 0) // day - first + 1) // ROWS))
    base = base.select(
        "id", "source", "t", F.lit(None).cast("double").alias("d"),
        F.coalesce(((F.floor(F.col("t") / day) - first) / stride).cast("int"), F.lit(0)).alias("row"), F.coalesce(F.floor(F.pmod(F.col("t"), F.lit(day)) / (day // SLOTS)).cast("int"), F.lit(0)).alias("slot"),
        F.lit(0).alias("fbin"), *[F.when(usable(F.col(f), not z), F.col(f)).alias(f) for f, z in fields.items()], *[F.coalesce(impossible(F.col(f), z), F.lit(False)).alias(f"bad_{f}") for f, z in fields.items()],
    )
    return _anomalies(base, list(fields), tuple(f for f, z in fields.items() if z), least, factor, None, part_rows)


def site_anomalies(rows: DataFrame, rid: str, source: str, field: str, distance: str, parts: list[str], least: int = 30, factor: float = 10.0, width: float = 1.5, part_rows: int = PART_ROWS) -> DataFrame:
    """(field, row_id, reason) for readings whose normal level follows distance; record ids are the order of time.

    A reading below one of its parts is impossible. Matrix columns are groups
    of eight records, rows distances in steps of `width`.
    """
    d, v = F.col(distance).cast("double"), F.col(field).cast("double")
    below = F.lit(False)
    for p in parts:
        below = below | (usable(F.col(p)) & (v < F.col(p)))
    base = rows.select(
        F.col(rid).cast("long").alias("id"), F.col(source).cast("string").alias("source"), F.col(rid).cast("long").alias("t"), F.when(usable(d) & (d > 0) & (d < HUGE), d).alias("d"),
        F.when(usable(v), v).alias(field), F.coalesce(impossible(v, True) | (usable(v) & below), F.lit(False)).alias(f"bad_{field}"),
    )
    fine = F.coalesce(F.floor(F.log(F.col("d")) / float(np.log(width) / FINE)), F.lit(0)).cast("int")
    base = base.withColumn("fbin", fine).withColumn("slot", F.floor(F.col("fbin") / FINE).cast("int")).withColumn("row", F.coalesce(F.pmod(F.floor(F.col("id") / 8), F.lit(SITE_ROWS)).cast("int"), F.lit(0)))
    return _anomalies(base, [field], (field,), least, factor, width, part_rows)
