"""Travel times from nodes to stations: constant velocity, layers, tables, eikonal grids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The default model as depth km, vp km/s, vs km/s.
DEFAULT_MODEL = (
    (-1.00, 5.50, 3.59), (0.00, 5.50, 3.59), (1.00, 5.50, 3.59), (1.00, 6.00, 3.92), (4.00, 6.00, 3.92), (4.00, 6.20, 4.05), (8.00, 6.20, 4.05),
    (8.00, 6.30, 4.12), (13.00, 6.30, 4.12), (13.00, 6.40, 4.18), (17.00, 6.40, 4.18), (17.00, 6.50, 4.25), (22.00, 6.50, 4.25), (22.00, 6.60, 4.31),
    (26.00, 6.60, 4.31), (26.00, 6.80, 4.44), (30.00, 6.80, 4.44), (30.00, 8.10, 5.29), (45.00, 8.10, 5.29),
)


def layers(profile: tuple[tuple[float, float, float], ...] = DEFAULT_MODEL) -> list[tuple[float, float, float, float, float, float]]:
    """(top, bottom, vp, vs, gradient_vp, gradient_vs) in metres: between the profile's successive depths; the last goes on."""
    out = []
    for (z0, p0, s0), (z1, p1, s1) in zip(profile, profile[1:]):
        if z1 > z0:
            h = (z1 - z0) * 1000
            out.append((z0 * 1000, z1 * 1000, p0 * 1000, s0 * 1000, (p1 - p0) * 1000 / h, (s1 - s0) * 1000 / h))
    z, p, s = profile[-1]
    out.append((z * 1000, float("inf"), p * 1000, s * 1000, 0.0, 0.0))
    return out


def parse_nd(text: str) -> tuple[tuple[float, float, float], ...]:
    """Profile lines of depth, vp, vs and more; words such as `mantle` and comments are skipped."""
    rows = []
    for line in text.splitlines():
        p = line.split("#")[0].split()
        if len(p) >= 3:
            rows.append((float(p[0]), float(p[1]), float(p[2])))
    return tuple(rows)


def velocity_at(df: DataFrame, depth: str, model: list[tuple], phase: str = "vp") -> DataFrame:
    """Interval join of a depth in metres with the layers, closed at their tops: velocity = v + gradient * (depth - top)."""
    t = df.sparkSession.createDataFrame(model, "top double, bottom double, vp double, vs double, gradient_vp double, gradient_vs double")
    j = df.join(F.broadcast(t), (F.col(depth) >= F.col("top")) & (F.col(depth) < F.col("bottom")), "left")  # a model's few layers
    return j.withColumn("velocity", F.col(phase) + F.col(f"gradient_{phase}") * (F.col(depth) - F.col("top"))).withColumn("vp_vs", F.col("vp") / F.col("vs"))


def constant(distance: Column, velocity: float) -> Column:
    return distance / velocity


def span(tt: DataFrame, by: list[str]) -> DataFrame:
    """Least and greatest travel time without NaN and null."""
    ok = F.when(~F.isnan("tt"), F.col("tt"))
    return tt.groupBy(*by).agg(F.min(ok).alias("first"), F.max(ok).alias("last"))


class Layers:
    """Flat layers of linear velocity: what a ray of parameter p crosses between two depths, or until it turns."""

    def __init__(self, model: list[tuple], phase: str) -> None:
        k, g = (2, 4) if phase == "vp" else (3, 5)
        self.top, self.v, self.g = (np.array([m[i] for m in model], float) for i in (0, k, g))
        self.bottom = np.r_[self.top[1:], np.inf]

    def velocity(self, n: int, z: float) -> float:
        """In layer n at a depth; above the first layer its top's velocity holds."""
        return self.v[n] + self.g[n] * max(z - self.top[n], 0.0)

    def pieces(self, z0: float, z1: float):  # noqa: ANN201
        """(thickness, upper and lower velocity, gradient) of each layer between two depths."""
        lo, hi = min(z0, z1), max(z0, z1)
        if lo < self.top[0]:
            yield min(hi, self.top[0]) - lo, self.v[0], self.v[0], 0.0
        for n in range(len(self.top)):
            a, b = max(lo, self.top[n]), min(hi, self.bottom[n])
            if b > a:
                yield b - a, self.velocity(n, a), self.velocity(n, b), self.g[n]

    def fastest(self, z0: float, z1: float) -> float:
        return max((max(a, b) for _, a, b, _ in self.pieces(z0, z1)), default=0.0)

    def cross(self, p: np.ndarray, z0: float, z1: float) -> tuple[np.ndarray, np.ndarray]:
        """Distance and time of rays between two depths."""
        x, t = np.zeros(len(p)), np.zeros(len(p))
        for h, va, vb, g in self.pieces(z0, z1):
            ca, cb = (np.sqrt(np.maximum(1 - (p * v) ** 2, 1e-20)) for v in (va, vb))
            if abs(vb - va) < 1e-9 * va:
                x, t = x + h * p * va / ca, t + h / (va * ca)
            else:
                # (ca - cb) / (p g), without cancellation at small p
                x = x + p * (vb * vb - va * va) / (g * (ca + cb))
                t = t + np.log(vb * (1 + ca) / (va * (1 + cb))) / g
        return x, t

    def turn(self, p: np.ndarray, n: int, z: float) -> tuple[np.ndarray, np.ndarray]:
        """Distance and time from a depth down to the turning point inside layer n."""
        at = max(z, self.top[n])
        x, t = self.cross(p, z, at)
        v, g = self.velocity(n, at), self.g[n]
        c = np.sqrt(np.maximum(1 - (p * v) ** 2, 0))
        return x + c / (p * g), t + np.log((1 + c) / (p * v)) / g


def _along(distances: np.ndarray, p: np.ndarray, x: np.ndarray, t: np.ndarray) -> np.ndarray:
    """First time at each distance of a family of rays: every branch of rising or falling x, cubic between rays as dt/dx = p."""
    out = np.full(len(distances), np.nan)
    d = np.sign(np.diff(x))
    cut = np.r_[0, np.flatnonzero(d[1:] != d[:-1]) + 1, len(x) - 1]
    for a, b in zip(cut[:-1], cut[1:]):
        u = slice(a, b + 1)
        xs, ts, ps = (v[u] if x[b] >= x[a] else v[u][::-1] for v in (x, t, p))
        inside = np.flatnonzero((distances >= xs[0]) & (distances <= xs[-1]))
        if not len(inside) or xs[-1] <= xs[0]:
            continue
        i = np.clip(np.searchsorted(xs, distances[inside], side="right") - 1, 0, len(xs) - 2)
        h = np.maximum(xs[i + 1] - xs[i], 1e-12)
        w = (distances[inside] - xs[i]) / h
        y = (1 + 2 * w) * (1 - w) ** 2 * ts[i] + w * (1 - w) ** 2 * h * ps[i] + w * w * (3 - 2 * w) * ts[i + 1] - w * w * (1 - w) * h * ps[i + 1]
        out[inside] = np.fmin(out[inside], y)
    return out


def ray_table(model: list[tuple], phase: str, distances: np.ndarray, depths: np.ndarray, receiver: float = 0.0, rays: int = 400) -> np.ndarray:
    """First arrivals (depths x distances, seconds) through flat layers of linear velocity; NaN where none.

    The ray between source and receiver, the rays that turn in a layer whose
    velocity rises, and the head waves along layers faster than all above.
    """
    m = Layers(model, phase)
    out = np.full((len(depths), len(distances)), np.nan)
    near = np.sort(np.r_[np.linspace(1e-6, 1, rays, endpoint=False), 1 - np.logspace(-2, -10, rays)])
    for i, z in enumerate(depths):
        low, rows = max(z, receiver), []
        if z != receiver:
            p = near / m.fastest(z, receiver)
            rows.append(_along(distances, p, *m.cross(p, z, receiver)))
            rows.append(np.where(distances <= 0, m.cross(np.zeros(1), z, receiver)[1][0], np.nan))
            # beyond the last of them, along the fastest place on the way
            x, t = (v[0] for v in m.cross(p[-1:], z, receiver))
            rows.append(np.where(distances >= x, t + (distances - x) * p[-1], np.nan))
        else:
            n = max(0, int(np.searchsorted(m.top, z, side="right")) - 1)
            if m.g[n] <= 0:
                rows.append(distances / m.velocity(n, z))
            rows.append(np.where(distances <= 0, 0.0, np.nan))
        above = m.fastest(z, receiver)
        for n in range(len(m.top)):
            if m.bottom[n] <= low:
                continue
            start = max(low, m.top[n])
            above = max(above, m.fastest(min(z, receiver), start))
            slow = max(above, m.velocity(n, start))
            if m.g[n] > 0 and np.isfinite(m.bottom[n]) and m.velocity(n, m.bottom[n]) > slow:
                fast = m.velocity(n, m.bottom[n])
                grid = np.sort(np.r_[np.linspace(0, 1, rays), np.logspace(-10, -2, rays), 1 - np.logspace(-8, -2, rays)])
                p = 1 / (slow + (fast - slow) * grid)
                (x1, t1), (x2, t2) = m.turn(p, n, z), m.turn(p, n, receiver)
                rows.append(_along(distances, p, x1 + x2, t1 + t2))
            if m.top[n] > low and (m.v[n] > above or (m.v[n] == above and m.g[n] <= 0)):
                p = np.array([1 / m.v[n]])
                (x1, t1), (x2, t2) = m.cross(p, z, m.top[n]), m.cross(p, receiver, m.top[n])
                rows.append(np.where(distances >= x1 + x2, t1 + t2 + (distances - x1 - x2) * p, np.nan))
        for row in rows:
            out[i] = np.fmin(out[i], row)
    return out


def least_velocity(model: list[tuple], phase: str, upto: float = float("inf")) -> float:
    """The least velocity anywhere from the top down to a depth."""
    m = Layers(model, phase)
    return min(v for n in range(len(m.top)) if m.top[n] <= upto for v in (m.v[n], m.velocity(n, min(m.bottom[n], upto)) if np.isfinite(min(m.bottom[n], upto)) else m.v[n]))


def from_table(table: np.ndarray, distances: np.ndarray, depths: np.ndarray, x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Bilinear interpolation on a regular grid; NaN outside or where a corner is NaN."""
    i = np.clip(np.searchsorted(distances, x, side="right") - 1, 0, len(distances) - 2)
    j = np.clip(np.searchsorted(depths, z, side="right") - 1, 0, len(depths) - 2)
    a = (x - distances[i]) / (distances[i + 1] - distances[i])
    b = (z - depths[j]) / (depths[j + 1] - depths[j])
    v = (1 - b) * ((1 - a) * table[j, i] + a * table[j, i + 1]) + b * ((1 - a) * table[j + 1, i] + a * table[j + 1, i + 1])
    return np.where((x < distances[0]) | (x > distances[-1]) | (z < depths[0]) | (z > depths[-1]), np.nan, v)


def travel_times(pairs: DataFrame, model: list[tuple], phases: dict[str, str], step: float = 200.0, reach: float = 60_000.0, deep: float = 30_000.0) -> DataFrame:
    """pairs(node_id, sta_idx, distance, depth) with tt for each phase (name -> vp or vs) from a table made once on the driver; NULL where no ray arrives.

    Slowness along the straight line is what the table holds and is
    interpolated: it bends far less than time does near the source.
    """
    xs, zs = np.arange(0, reach + step, step), np.arange(0, deep + step, step)
    far = np.hypot(xs[None], zs[:, None])
    tables = {}
    for name, k in phases.items():
        with np.errstate(invalid="ignore"):
            tables[name] = ray_table(model, k, xs, zs) / far
        tables[name][0, 0] = tables[name][0, 1]
    names = list(phases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, z = b.column("distance").to_numpy(zero_copy_only=False), b.column("depth").to_numpy(zero_copy_only=False)
            for n in names:
                t = from_table(tables[n], xs, zs, d, z) * np.hypot(d, z)
                yield pa.RecordBatch.from_arrays([b.column("node_id"), b.column("sta_idx"), pa.array([n] * len(d)), pa.array(t, from_pandas=True)], names=["node_id", "sta_idx", "phase", "tt"])

    return pairs.select(F.col("node_id").cast("long"), F.col("sta_idx").cast("long"), F.col("distance").cast("double"), F.col("depth").cast("double")).mapInArrow(run, "node_id long, sta_idx long, phase string, tt double")


def eikonal(slowness: np.ndarray, h: float, source: tuple[int, ...], sweeps: int = 100) -> np.ndarray:
    """First-order travel times over a 2-d or 3-d grid by fast sweeping until nothing changes; straight rays within three cells of the source."""
    far = np.sqrt(sum((np.arange(n).reshape([-1 if a == b else 1 for b in range(slowness.ndim)]) - source[a]) ** 2.0 for a, n in enumerate(slowness.shape)))
    t = np.where(far <= 3, far * h * slowness[source], 1e20)
    nd = slowness.ndim
    for _ in range(sweeps):
        before = t.copy()
        # planes along each axis in turn, both ways
        for axis in range(nd):
            for way in (1, -1):
                u, s = np.moveaxis(t, axis, 0)[::way], np.moveaxis(slowness, axis, 0)[::way]
                for i in range(u.shape[0]):
                    near = [np.minimum(u[i - 1] if i else 1e20, u[i + 1] if i + 1 < u.shape[0] else 1e20)]
                    for a in range(nd - 1):
                        p = np.pad(u[i], [(1, 1) if b == a else (0, 0) for b in range(nd - 1)], constant_values=1e20)
                        near.append(np.minimum(np.take(p, range(0, u[i].shape[a]), a), np.take(p, range(2, u[i].shape[a] + 2), a)))
                    m = np.sort(np.broadcast_arrays(*near), axis=0)
                    f = s[i] * h
                    v = m[0] + f
                    for k in range(2, nd + 1):
                        sm, sq = m[:k].sum(0), (m[:k] ** 2).sum(0)
                        disc = sm**2 - k * (sq - f**2)
                        w = (sm + np.sqrt(np.maximum(disc, 0))) / k
                        v = np.where((disc >= 0) & (v > m[k - 1]), w, v)
                    u[i] = np.minimum(u[i], v)
        if np.allclose(before, t, rtol=0, atol=1e-9):
            break
    return t


def fill_missing(wanted: DataFrame, cache: DataFrame, keys: list[str], compute) -> DataFrame:  # noqa: ANN001
    """Rows of the cache for what is wanted, and computed ones for the rest."""
    hit = cache.join(wanted.select(*keys).distinct(), keys, "left_semi")
    return hit.unionByName(compute(wanted.join(cache.select(*keys), keys, "left_anti")))


def with_delays(tt: DataFrame, delays: DataFrame) -> DataFrame:
    """Adds the station delay of (nsl, phase), 0 where none is known."""
    return tt.join(delays, ["nsl", "phase"], "left").withColumn("tt", F.col("tt") + F.coalesce("delay_s", F.lit(0.0))).drop("delay_s")


def _beside(d: DataFrame, by: list[str], groups: DataFrame) -> DataFrame:
    """d with the columns of its group; groups are nodes, few beside the rows, so d is not shuffled."""
    g = groups.select(*[F.col(b).alias(f"_g{i}") for i, b in enumerate(by)], *[c for c in groups.columns if c not in by])
    same = [F.col(b).eqNullSafe(F.col(f"_g{i}")) for i, b in enumerate(by)]
    return d.join(F.broadcast(g), same).drop(*[f"_g{i}" for i in range(len(by))])


def gaussian_weights(d: DataFrame, by: str, required: int, taper: float, waterlevel: float = 0.0) -> DataFrame:
    """Adds weight: 1 up to the required-th least distance of the group, then a Gaussian of full width `taper`, lifted by the water level."""
    w = W.partitionBy(by).orderBy("distance", "sta_idx")
    near = d.select(by, "distance", "sta_idx").withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= required)
    n = _beside(d, [by], near.groupBy(by).agg(F.max("distance").alias("_dk")))
    x = F.when(F.col("distance") <= F.col("_dk"), F.lit(1.0)).otherwise(F.exp(-F.pow(F.col("distance") - F.col("_dk"), 2.0) / (2 * (taper / 2.355) ** 2)))
    return n.withColumn("weight", (1 - waterlevel) * x + waterlevel).drop("_dk")


def exponential_weight(distance: Column, radius: float, exponent: float, waterlevel: float) -> Column:
    return (1 - waterlevel) / (1 + F.pow(distance / radius, F.lit(float(exponent)))) + waterlevel


def exponential_weights(d: DataFrame, radius: float, exponent: float, waterlevel: float = 0.0) -> DataFrame:
    """Adds weight, divided by the greatest of all rows."""
    x = d.withColumn("weight", exponential_weight(F.col("distance"), radius, exponent, waterlevel))
    top = x.agg(F.max("weight").alias("_top"))
    return x.crossJoin(F.broadcast(top)).withColumn("weight", F.try_divide(F.col("weight"), F.col("_top"))).drop("_top")  # one row


def velocity_least_at(model: list[tuple], depth: float) -> float:
    """The lesser of vp and vs at a depth, on the profile's lines."""
    out = []
    for phase in ("vp", "vs"):
        m = Layers(model, phase)
        n = max(0, int(np.searchsorted(m.top, depth, side="right")) - 1)
        out.append(m.velocity(n, depth))
    return min(out)


def fill_from_grid(nodes: DataFrame, grids: dict[int, np.ndarray], axes: tuple[list[float], list[float], list[float]]) -> DataFrame:
    """(node_id, sta_idx, tt): each station's grid of times (east, north, depth) at every node, linear between grid places; NULL outside. A run's few hundred grids travel with the tasks."""
    ax = [np.asarray(a, float) for a in axes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = [b.column(c).to_numpy(zero_copy_only=False) for c in ("east", "north", "depth")]
            inside = np.all([(v >= a[0]) & (v <= a[-1]) for v, a in zip(p, ax)], axis=0)
            at = [np.clip(np.searchsorted(a, v, side="right") - 1, 0, len(a) - 2) for v, a in zip(p, ax)]
            w = [(v - a[i]) / (a[i + 1] - a[i]) for v, a, i in zip(p, ax, at)]
            for sta, g in grids.items():
                t = np.zeros(b.num_rows)
                for e in (0, 1):
                    for n in (0, 1):
                        for d in (0, 1):
                            part = [x if k else 1 - x for x, k in zip(w, (e, n, d))]
                            t += part[0] * part[1] * part[2] * g[at[0] + e, at[1] + n, at[2] + d]
                yield pa.RecordBatch.from_arrays([b.column("node_id"), pa.array(np.full(b.num_rows, sta)), pa.array(np.where(inside, t, np.nan), from_pandas=True)], names=["node_id", "sta_idx", "tt"])

    return nodes.select(F.col("node_id").cast("long"), *[F.col(c).cast("double") for c in ("east", "north", "depth")]).mapInArrow(run, "node_id long, sta_idx long, tt double")


def normalise_weights(d: DataFrame, by: list[str], least: float = 1e-3) -> DataFrame:
    """Zero where the travel time is missing, divided by the group's sum, zero below `least` (not normalised again)."""
    x = d.withColumn("weight", F.when(F.col("tt").isNull() | F.isnan("tt"), F.lit(0.0)).otherwise(F.col("weight")))
    x = _beside(x, by, x.groupBy(*by).agg(F.sum("weight").alias("_s")))
    y = F.coalesce(F.try_divide(F.col("weight"), F.col("_s")), F.lit(0.0))
    return x.withColumn("_w", y).withColumn("weight", F.when(F.col("_w") < least, F.lit(0.0)).otherwise(F.col("_w"))).drop("_w", "_s")
