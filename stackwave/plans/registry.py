"""Names to functions: the plug-in surface, and configurations that name them.

Kinds: source, preprocess, image, tracer, magnitude, feature, exporter,
callback. A configuration is a list of {"use": name, ...parameters}; unknown
names and parameters are errors.
"""

from __future__ import annotations

import importlib.util
import inspect
from collections.abc import Callable
from pathlib import Path

KINDS = ("source", "preprocess", "image", "tracer", "magnitude", "feature", "exporter", "callback")
_known: dict[str, dict[str, Callable]] = {k: {} for k in KINDS}


def register(kind: str, name: str) -> Callable[[Callable], Callable]:
    def add(f: Callable) -> Callable:
        if name in _known[kind]:
            raise ValueError(f"{kind} {name!r} is there already")
        _known[kind][name] = f
        return f

    return add


def known(kind: str) -> dict[str, Callable]:
    return dict(_known[kind])


def build(kind: str, config: dict) -> Callable:
    """The named function with its parameters bound; they are checked against its signature."""
    given = {k: v for k, v in config.items() if k != "use"}
    if config.get("use") not in _known[kind]:
        raise ValueError(f"no {kind} named {config.get('use')!r}; known: {sorted(_known[kind])}")
    f = _known[kind][config["use"]]
    parameters = inspect.signature(f).parameters
    unknown = set(given) - set(parameters)
    if unknown and not any(p.kind is p.VAR_KEYWORD for p in parameters.values()):
        raise ValueError(f"{config['use']} takes no {sorted(unknown)}")
    return lambda *a: f(*a, **given)


def chain(kind: str, configs: list[dict]) -> Callable:
    """DataFrame -> DataFrame through all named steps in order."""
    steps = [build(kind, c) for c in configs]

    def run(df):  # noqa: ANN001, ANN202
        for s in steps:
            df = s(df)
        return df

    return run


def tracer_for(phase: str, tracers: list[tuple[set[str], Callable]]) -> Callable:
    """The first tracer (phases it offers, function) that offers a phase; an error where none does."""
    for phases, f in tracers:
        if phase in phases:
            return f
    raise ValueError(f"no tracer offers {phase}")


def load_script(path: str) -> object:
    """A user's script that offers load()."""
    spec = importlib.util.spec_from_file_location(Path(path).stem, path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not callable(getattr(module, "load", None)):
        raise ValueError(f"{path} has no load()")
    return module.load()


def run_hooks(hooks: list[object], event: str, *args: object, log: Callable[[str], None] = print) -> None:
    """start, stop, batch_start, batch_end or new_detection on every hook; a failing one is logged and the rest run."""
    for h in hooks:
        f = getattr(h, event, None)
        if f is None:
            continue
        try:
            f(*args)
        except Exception as e:  # noqa: BLE001
            log(f"{type(h).__name__}.{event}: {e}")
