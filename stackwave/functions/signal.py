"""Array signal functions on numpy: filters, resampling, peaks, triggers, pulses, restitution."""

from __future__ import annotations

from fractions import Fraction

import numpy as np

# Wood-Anderson poles, zeros and gains.
WOOD_ANDERSON = (np.array([-5.49779 + 5.60886j, -5.49779 - 5.60886j]), np.zeros(2), 2080.0)
WOOD_ANDERSON_OLD = (np.array([-6.283 + 4.7124j, -6.283 - 4.7124j]), np.zeros(2), 2080.0)
WOOD_ANDERSON_2800 = (np.array([-6.283 + 4.7124j, -6.283 - 4.7124j]), np.zeros(2), 2800.0)
INSTRUMENTS = {"wood-anderson": WOOD_ANDERSON, "wood-anderson-old": WOOD_ANDERSON_OLD, "wood-anderson-2800": WOOD_ANDERSON_2800}


def butterworth(order: int, freqs: tuple[float, ...], kind: str, rate: float) -> np.ndarray:
    """Second-order sections (n, 6) of a Butterworth filter by the bilinear transform; kind is low, high or band."""
    k = np.arange(order)
    poles = np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order))
    warp = [2 * rate * np.tan(np.pi * f / rate) for f in freqs]
    if kind == "low":
        p, zeros_at, gain = poles * warp[0], [-1.0] * order, warp[0] ** order
        z = np.zeros(0)
    elif kind == "high":
        p, z, zeros_at, gain = warp[0] / poles, np.zeros(order), [], 1.0
    else:
        bw, w0 = warp[1] - warp[0], np.sqrt(warp[0] * warp[1])
        half = poles * bw / 2
        root = np.sqrt(half**2 - w0**2)
        p, z, zeros_at, gain = np.r_[half + root, half - root], np.zeros(order), [-1.0] * order, bw**order
    fs2 = 2 * rate
    pd = (fs2 + p) / (fs2 - p)
    zd = np.r_[(fs2 + z) / (fs2 - z), zeros_at]
    gain = gain * np.real(np.prod(fs2 - z) / np.prod(fs2 - p))
    cplx = pd[np.imag(pd) > 1e-12]
    real = np.sort(np.real(pd[np.abs(np.imag(pd)) <= 1e-12]))
    pairs = [(x, np.conj(x)) for x in cplx] + [(real[i], real[i + 1] if i + 1 < len(real) else 0.0) for i in range(0, len(real), 2)]
    zs = list(np.sort(np.real(zd)))
    sos = []
    for a, b in pairs:
        take = [zs.pop(0), zs.pop()] if len(zs) >= 2 else [zs.pop()] if zs else []
        num = np.real(np.poly(take)) if take else np.array([1.0])
        den = np.real(np.array([1.0, -(a + b), a * b]))
        sos.append(np.r_[num, np.zeros(3 - len(num)), den])
    sos[0][:3] *= gain
    return np.array(sos)


BLOCK = 256  # samples that a section filters at once


def _responses(section: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n outputs, 2 states after each of n steps) of a unit impulse and of each unit state: arrays (3, n), (3, n, 2)."""
    b0, b1, b2, _, a1, a2 = section
    x = np.zeros((3, n))
    x[0, 0] = 1
    s = np.array([[0.0, 0.0], [1.0, 0.0], [0.0, 1.0]])
    out, after = np.empty((3, n)), np.empty((3, n, 2))
    for i in range(n):
        o = b0 * x[:, i] + s[:, 0]
        s = np.stack([b1 * x[:, i] - a1 * o + s[:, 1], b2 * x[:, i] - a2 * o], 1)
        out[:, i], after[:, i] = o, s
    return out, after


def sos_filter(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Apply sections one way to each row of x (rows, samples), block by block as matrix products."""
    y = np.atleast_2d(x).astype(float).copy()
    for section in sos:
        n = min(BLOCK, y.shape[1])
        if n == 0:
            break
        out, after = _responses(section, n)
        lag = np.arange(n)[None] - np.arange(n)[:, None]
        impulse = np.where(lag >= 0, out[0][np.maximum(lag, 0)], 0.0)  # input sample x output sample
        state = np.zeros((len(y), 2))
        for i in range(0, y.shape[1], n):
            v = y[:, i : i + n].copy()
            m = v.shape[1]
            y[:, i : i + m] = v @ impulse[:m, :m] + state @ out[1:, :m]
            state = v @ after[0][m - 1 - np.arange(m)] + state @ after[1:, m - 1]
    return y.reshape(np.shape(x))


def zero_phase(sos: np.ndarray, x: np.ndarray, pad: int = 64) -> np.ndarray:
    """Both ways, with odd extension at the ends."""
    y = np.atleast_2d(x).astype(float)
    n = min(pad, y.shape[1] - 1)
    if n > 0:
        y = np.c_[2 * y[:, :1] - y[:, n:0:-1], y, 2 * y[:, -1:] - y[:, -2 : -n - 2 : -1]]
    y = sos_filter(sos, y)
    y = sos_filter(sos, y[:, ::-1])[:, ::-1]
    return y[:, n : y.shape[1] - n].reshape(np.shape(x)) if n > 0 else y.reshape(np.shape(x))


def band_filter(x: np.ndarray, rate: float, low: float | None, high: float | None, order: int = 4, phase: str = "zero") -> np.ndarray:
    """Demean, then band-, high- or low-pass; a corner at or above Nyquist leaves the traces as they are."""
    if max(f for f in (low, high) if f is not None) >= rate / 2:
        return np.array(x, float)
    kind, f = ("band", (low, high)) if low and high else ("high", (low,)) if low else ("low", (high,))
    sos = butterworth(order, f, kind, rate)
    y = x - np.mean(x, axis=-1, keepdims=True)
    return zero_phase(sos, y) if phase == "zero" else sos_filter(sos, y)


def resample(x: np.ndarray, dt_in: float, dt_out: float, beta: float = 10.0, demean: bool = False) -> np.ndarray:
    """Polyphase resampling by a rational ratio of denominator up to 1000 with a Kaiser-windowed sinc."""
    r = Fraction(dt_in / dt_out).limit_denominator(1000)
    up, down = r.numerator, r.denominator
    if up == down:
        return np.array(x, float)
    mean = np.mean(x) if demean else 0.0
    m = max(up, down)
    half = 10 * m
    k = np.arange(-half, half + 1)
    taps = np.sinc(k / m) * np.kaiser(2 * half + 1, beta)
    taps *= up / taps.sum()
    n = -(-len(x) * up // down)
    out = np.empty(n)
    y = np.asarray(x, float) - mean
    for phase in range(up):
        # output i uses input samples j with |i * down - j * up| <= half
        i = np.arange(n)[(np.arange(n) * down) % up == phase] if up > 1 else np.arange(n)
        if not len(i):
            continue
        at = i * down
        first = -(-(at - half) // up)
        width = 2 * half // up + 1
        j = first[:, None] + np.arange(width)
        t = at[:, None] - j * up + half
        ok = (j >= 0) & (j < len(y)) & (t >= 0) & (t <= 2 * half)
        out[i] = (np.where(ok, y[np.clip(j, 0, len(y) - 1)], 0.0) * np.where(ok, taps[np.clip(t, 0, 2 * half)], 0.0)).sum(1)
        if up == 1:
            break
    return out + mean


def downsample(x: np.ndarray, factor: int, taps: int = 20, repeat: int = 1) -> np.ndarray:
    """Every factor-th sample after a windowed-sinc low-pass at the new Nyquist; factors of many primes in turn; repeat says each sample so often first."""
    y = np.repeat(np.asarray(x, float), repeat)
    for q in _primes(factor):
        k = np.arange(-taps * q, taps * q + 1)
        h = np.sinc(k / q) * np.hamming(len(k))
        padded = np.pad(y, taps * q, mode="edge")
        y = np.convolve(padded, h / h.sum(), mode="valid")[::q]
    return y


def _primes(n: int) -> list[int]:
    out, p = [], 2
    while n > 1:
        while n % p == 0:
            out.append(p)
            n //= p
        p += 1
    return out


def resample_image(x: np.ndarray, rate_in: float, rate_out: float, normalise: bool = True) -> np.ndarray:
    """An image trace at another rate, with its greatest value kept where normalise is set."""
    y = resample(x, 1 / rate_in, 1 / rate_out)
    top = float(np.max(x, initial=0.0))
    if normalise and len(y) and y.max() > 0:
        y = y * (top / y.max())
    return y


def sta_lta(x: np.ndarray, short: int, long: int) -> np.ndarray:
    """Ratio of the mean energy of the last `short` to that of the last `long` samples, in 0..1; 0 before `long` samples are there."""
    e = np.cumsum(np.r_[0.0, np.asarray(x, float) ** 2])
    out = np.zeros(len(x))
    i = np.arange(long, len(x) + 1)
    s, n = (e[i] - e[i - short]) / short, (e[i] - e[i - long]) / long
    r = np.divide(s, n, out=np.zeros(len(i)), where=n > 0)
    out[i - 1] = np.clip(r * short / long, 0, 1)
    return out


def find_peaks(x: np.ndarray, height: float | None = None, distance: int | None = None, prominence: float | None = None) -> np.ndarray:
    """Local maxima (the middle of plateaus), by height, then distance (the greater wins, the later of equals), then prominence."""
    x = np.asarray(x, float)
    change = np.r_[True, x[1:] != x[:-1]] if len(x) else np.zeros(0, bool)
    start = np.flatnonzero(change)
    end = np.r_[start[1:], len(x)] - 1
    v = x[start]
    inner = np.zeros(len(v), bool)
    inner[1:-1] = (v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])
    p = ((start + end) // 2)[inner]
    if height is not None:
        p = p[x[p] >= height]
    if distance is not None and len(p):
        keep = np.ones(len(p), bool)
        for i in np.argsort(x[p], kind="stable")[::-1]:
            if keep[i]:
                near = (np.abs(p - p[i]) < distance) & (np.arange(len(p)) != i)
                keep[near] = False
        p = p[keep]
    if prominence is not None:
        p = p[np.array([peak_prominence(x, int(i)) >= prominence for i in p], bool)] if len(p) else p
    return p


def peak_prominence(x: np.ndarray, i: int) -> float:
    left, right = x[: i + 1][::-1], x[i:]
    a = np.argmax(left > x[i]) if (left > x[i]).any() else len(left)
    b = np.argmax(right > x[i]) if (right > x[i]).any() else len(right)
    return float(x[i] - max(left[:a].min(), right[:b].min()))


def gaussian_pulses(n: int, rate: float, times: np.ndarray, width: float) -> np.ndarray:
    """Sum of unit pulses of standard deviation width (s) at times."""
    t = np.arange(n) / rate
    return np.exp(-((t[None, :] - np.asarray(times)[:, None]) ** 2) / (2 * width**2)).sum(0)


def detrend(x: np.ndarray) -> np.ndarray:
    t = np.arange(len(x)) - (len(x) - 1) / 2
    return x - x.mean() - t * (t @ x) / max(t @ t, 1e-12)


def overlap_concat(parts: list[np.ndarray], taper: float) -> np.ndarray:
    """Join detrended, tapered pieces that overlap by half their taper."""
    out = np.zeros(0)
    for x in parts:
        n = len(x)
        k = int(n * taper / 2)
        w = np.ones(n)
        if k:
            r = 0.5 * (1 - np.cos(np.pi * np.arange(k) / k))
            w[:k], w[n - k :] = r, r[::-1]
        y = detrend(np.asarray(x, float)) * w
        if len(out) and k:
            m = min(k, len(out), n)
            out[-m:] += y[:m]
            y = y[m:]
        out = np.r_[out, y]
    return out


def restitute(x: np.ndarray, rate: float, response, taper: float = 0.1, low: float = 0.01, then=None) -> np.ndarray:  # noqa: ANN001
    """Divide by a response(frequencies) with a water level below low Hz, optionally multiply by another."""
    n = len(x)
    k = int(n * taper / 2)
    w = np.ones(n)
    if k:
        r = 0.5 * (1 - np.cos(np.pi * np.arange(k) / k))
        w[:k], w[n - k :] = r, r[::-1]
    f = np.fft.rfftfreq(n, 1 / rate)
    s = np.fft.rfft((x - np.mean(x)) * w)
    h = response(f)
    s = np.where((f >= low) & (np.abs(h) > 0), s / np.where(h == 0, 1, h), 0)
    if then is not None:
        s = s * then(f)
    return np.fft.irfft(s, n)


def pole_zero(poles: np.ndarray, zeros: np.ndarray, constant: float):  # noqa: ANN201
    def h(f: np.ndarray) -> np.ndarray:
        w = 2j * np.pi * f
        return constant * np.prod([w - z for z in zeros], axis=0) / np.prod([w - p for p in poles], axis=0)

    return h


def refine_maximum(points: np.ndarray, values: np.ndarray, start: np.ndarray, bound: float, steps: int = 60) -> tuple[np.ndarray, float]:
    """Maximum of a cubic radial-basis interpolation near start, within +-bound on each axis, by a shrinking pattern search."""
    d = np.linalg.norm(points[:, None] - points[None], axis=2)
    a = np.block([[d**3, np.c_[np.ones(len(points)), points]], [np.c_[np.ones(len(points)), points].T, np.zeros((4, 4))]])
    c = np.linalg.lstsq(a, np.r_[values, np.zeros(4)], rcond=None)[0]
    f = lambda p: float((np.linalg.norm(points - p, axis=1) ** 3) @ c[: len(points)] + c[len(points)] + p @ c[len(points) + 1 :])
    best, v, h = np.array(start, float), f(np.array(start, float)), bound / 2
    for _ in range(steps):
        moves = [best + h * s * e for e in np.eye(3) for s in (-1, 1)]
        moves = [np.clip(m, start - bound, start + bound) for m in moves]
        got = [f(m) for m in moves]
        k = int(np.argmax(got))
        if got[k] > v:
            best, v = moves[k], got[k]
        else:
            h /= 2
            if h < bound * 1e-4:
                break
    return best, v
