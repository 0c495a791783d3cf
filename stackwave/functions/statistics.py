"""Likelihoods and densities over small summaries (histograms)."""

from __future__ import annotations

import math

import numpy as np


def log_likelihood(p: np.ndarray, n: np.ndarray) -> float:
    return float((n * np.log(np.maximum(p, 1e-300))).sum())


def detection_density(m: np.ndarray, beta: float, mu: float, sigma: float) -> np.ndarray:
    """Exponential recurrence times the normal probability of detection, normalised."""
    cdf = 0.5 * (1 + np.array([math.erf((x - mu) / (sigma * math.sqrt(2))) for x in np.ravel(m)]).reshape(np.shape(m)))
    return beta * np.exp(-beta * (m - mu) - (beta * sigma) ** 2 / 2) * cdf


def minimise(f, start: np.ndarray, step: float = 0.3, rounds: int = 400) -> tuple[np.ndarray, float]:  # noqa: ANN001
    """Downhill simplex."""
    n = len(start)
    pts = [np.array(start, float)] + [np.array(start, float) + step * e for e in np.eye(n)]
    val = [f(p) for p in pts]
    for _ in range(rounds):
        o = np.argsort(val)
        pts, val = [pts[i] for i in o], [val[i] for i in o]
        if abs(val[-1] - val[0]) < 1e-9 * (1 + abs(val[0])):
            break
        c = np.mean(pts[:-1], axis=0)
        r = c + (c - pts[-1])
        fr = f(r)
        if fr < val[0]:
            e = c + 2 * (c - pts[-1])
            fe = f(e)
            pts[-1], val[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < val[-2]:
            pts[-1], val[-1] = r, fr
        else:
            k = c + 0.5 * (pts[-1] - c)
            fk = f(k)
            if fk < val[-1]:
                pts[-1], val[-1] = k, fk
            else:
                pts = [pts[0]] + [pts[0] + 0.5 * (p - pts[0]) for p in pts[1:]]
                val = [val[0]] + [f(p) for p in pts[1:]]
    i = int(np.argmin(val))
    return pts[i], val[i]


def emr_fit(m: np.ndarray, n: np.ndarray) -> tuple[float, float, float, float]:
    """(beta, mu, sigma, log likelihood) by maximum likelihood on counts at magnitudes; parameters are squares, so none is negative."""
    mean = float((m * n).sum() / n.sum())
    start = np.sqrt([2.0, max(mean, 1e-3), 0.3])
    p, v = minimise(lambda q: -log_likelihood(detection_density(m, *(q**2 + 1e-9)), n), start)
    return (*map(float, p**2), -v)


def gaussian_density(x: np.ndarray, n: np.ndarray, at: np.ndarray, factor: float = 1.0) -> np.ndarray:
    """Kernel density of counts n at x, with Scott's bandwidth times factor."""
    total = n.sum()
    mean = (x * n).sum() / total
    sd = math.sqrt(max(((x - mean) ** 2 * n).sum() / max(total - 1, 1), 1e-18))
    h = factor * sd * total ** (-1 / 5)
    return (np.exp(-((at[:, None] - x[None]) ** 2) / (2 * h * h)) * n).sum(1) / (total * h * math.sqrt(2 * math.pi))
