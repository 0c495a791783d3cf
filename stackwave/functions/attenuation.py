"""Local magnitudes: a table of attenuation models as column expressions.

Amplitudes are metres (or metres a second for the first model), distances
metres; R and E are hypocentral and epicentral kilometres. Outside a model's
distance gate the magnitude is null.
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from stackwave.functions import codes

# Tchebychev terms of the integrated California network.
TCHEBYCHEV = (0.056, -0.031, -0.053, -0.080, -0.028, 0.015)


@dataclass(frozen=True)
class Model:
    name: str
    gate: tuple[str, float, float]  # kind of distance, least and most km
    component: str
    term: Callable[[Column, Column], Column]
    amplitude: Callable[[Column], Column] = lambda a: F.log10(a * 1000.0)
    peak: str = "peak-to-peak"
    instrument: str | None = "wood-anderson"  # what the traces are simulated as; without one they are velocities
    highpass_hz: float | None = None


def _log(k: float, x: Column, ref: float = 1.0) -> Column:
    return k * F.log10(x / ref)


def _cisn(r: Column, e: Column) -> Column:
    z = 1.11366 * F.log10(r) - 2.00574
    out = _log(1.11, r) + 0.00189 * r + 0.591
    for i, t in enumerate(TCHEBYCHEV, 1):
        out = out + t * F.cos(i * F.acos(z))
    return out


def _reference(k: float, g: float, ref: float, base: float) -> Callable[[Column, Column], Column]:
    return lambda r, e: _log(k, r, ref) + g * (r - ref) + base


# Published coefficients and distance gates of each model.
MODELS = {
    m.name: m
    for m in (
        Model("WebnetWesternBohemia", ("hypo", 0, 100), "all-abs", lambda r, e: _log(2.1, r) - F.log10(F.pi()) - 1.7, lambda a: F.log10(a * 1e6), "max-amplitude", None, 1.0),
        Model("IaspeiSouthernCalifornia", ("hypo", 10, 700), "north-east-separate", lambda r, e: _log(1.11, r) + 0.00189 * r - 2.09, lambda a: F.log10(a * 1e9 / 2080.0)),
        Model("SouthernCalifornia", ("hypo", 10, 700), "north-east-separate", _reference(1.11, 0.00189, 100.0, 3.0)),
        Model("CentralCalifornia", ("epi", 0, 400), "horizontal-avg", lambda r, e: _log(1.0, r) + 0.00301 * r + 0.7),
        Model("CaliforniaIntegratedSeismicNetwork", ("epi", 0, 450), "horizontal-separate", _cisn, peak="max-amplitude", instrument="wood-anderson-old"),
        Model("EasternNorthAmerica", ("epi", 100, 800), "north-east-separate", lambda r, e: _log(1.55, e) - 0.22),
        Model("ArgentiereGlacier", ("hypo", 0, 100), "north-east-separate", lambda r, e: _log(-6.0, r) - 1.2, instrument="wood-anderson-2800"),
        Model("Albania", ("epi", 10, 600), "north-east-separate", lambda r, e: _log(1.6627, e) + 0.0008 * e - 0.433),
        Model("SouthWestGermany", ("hypo", 10, 1000), "vertical", lambda r, e: _log(1.11, r) + 0.00095 * r + 0.69),
        Model("SouthAustralia", ("epi", 40, 700), "vertical", lambda r, e: _log(1.1, e) + 0.0013 * e + 0.7),
        Model("NorwayFennoscandia", ("hypo", 0, 1500), "vertical", lambda r, e: _log(0.91, r) + 0.00087 * r + 1.01),
        Model("IcelandAskja", ("hypo", 0, 150), "north-east-separate", _reference(1.4406, 0.003, 17.0, 2.0)),
        Model("IcelandBardabunga", ("hypo", 0, 150), "north-east-separate", _reference(1.2534, -0.0032, 17.0, 2.0)),
        Model("IcelandAskjaBardabungaCombined", ("hypo", 0, 150), "north-east-separate", _reference(1.1999, -0.0016, 17.0, 2.0)),
        Model("IcelandReykjanes", ("hypo", 0, 40), "north-east-separate", _reference(0.6902, 0.0318, 17.0, 2.0)),
        Model("Azores", ("epi", 10, 800), "north-east-separate", lambda r, e: _log(0.89, e, 100.0) + 0.00256 * (e - 100.0) + 3.0),
        Model("ArgentinaVolcanoes", ("epi", 0, 100), "north-east-separate", lambda r, e: _log(2.76, e) - 2.48),
        Model("NetherlandsGroningen", ("epi", 0, 80), "horizontal-avg", lambda r, e: _log(1.33, r) + 0.00139 * r + 0.424),
        Model("CampiFlegrei", ("epi", 0.2, 8), "horizontal-avg", lambda r, e: _log(0.95, r) + 0.09 * r - 0.1, instrument="wood-anderson-2800"),
    )
}


def custom(name: str, a: float, b: float, c: float, kind: str = "hypo", least: float = 0.0, most: float = 1e9) -> Model:
    """log10 A + a log10 d + b d + c over the chosen distance."""
    return Model(name, (kind, least, most), "all", lambda r, e: _log(a, r if kind == "hypo" else e) + b * (r if kind == "hypo" else e) + c)


def magnitude_of(model: Model, amp: Column, hypo_m: Column, epi_m: Column) -> Column:
    r, e = hypo_m / 1000.0, epi_m / 1000.0
    kind, least, most = model.gate
    gate = (r if kind == "hypo" else e).between(least, most)
    return F.when(gate & (amp > 0) & (r > 0) & (e > 0) & ~F.isnan(amp), model.amplitude(amp) + model.term(r, e))


def magnitude(model: Column, amp: Column, hypo_m: Column, epi_m: Column) -> Column:
    """By the model named in each row; unknown names give null."""
    out = F.lit(None).cast("double")
    for m in MODELS.values():
        out = F.when(model == m.name, magnitude_of(m, amp, hypo_m, epi_m)).otherwise(out)
    return out


def magnitude_error(model: Column, amp: Column, noise: Column, hypo_m: Column, epi_m: Column) -> Column:
    """Half the spread of the magnitude at amp +- noise; a lower bound that isn't finite mirrors the upper one."""
    mid, up, low = (magnitude(model, a, hypo_m, epi_m) for a in (amp, amp + noise, amp - noise))
    return (F.abs(up - mid) + F.coalesce(F.abs(mid - low), F.abs(up - mid))) / 2


def model_by_code(nsl: Column, rules: list[tuple[str, str]]) -> Column:
    """Name of the model of the first rule (code pattern, model name) that matches; null where none does."""
    return F.coalesce(*[F.when(codes.nsl_matches(nsl, pattern), F.lit(name)) for pattern, name in rules], F.lit(None).cast("string"))
