"""All valid interpretations of a time text.

`interpret(text)` names every reading a text allows. A reading is
(layout, order, kind, micros, zone): kind 'utc' is an instant, 'clock' a
reading of the source's own clock, 'abbr' a clock reading with a zone
abbreviation. order is 'dmy' or 'mdy' where day and month are open, else ''.

Where only one of both orders names a day, the layout's name holds it.

Defined cases: surrounding white space of any kind (also no-break spaces) does
not matter; a date alone, an impossible date or time and any other text has no
reading; 24:00:00 is the end of its day; fractions of any length are cut to
microseconds. A bare number counts from 1970, in seconds below 10^11 in size,
else in milliseconds below 10^14, microseconds below 10^17 and nanoseconds
below 10^20; but four digits are a year and eight that name a day are a date
alone, and fourteen that name a day and time are that. Instants lie in the
years 1 to 9999. Texts may have any length.
"""

from __future__ import annotations

import re
from datetime import date

import numpy as np

DAY = 86_400_000_000
EPOCH = date(1970, 1, 1).toordinal()
# English month names as the servers write them.
MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12}
# Names of universal time.
UNIVERSAL = ("Z", "UTC", "GMT")

_CLOCK = r"(?P<H>\d{1,2}):(?P<M>\d{2})(?::(?P<S>\d{2})(?:[.,](?P<f>\d+))?)?(?:\s*(?P<ap>[AaPp][Mm]))?"
_ZONE = r"(?:\s*(?P<off>[+-]\d{2}(?::?\d{2})?)|\s*\(?(?P<abbr>[A-Za-z]{1,5})\)?)?(?:\[(?P<id>[\w/+-]+)\])?"
_END = _CLOCK + _ZONE + r"$"
_LAYOUTS = [
    ("y-m-d", re.compile(r"(?P<y>\d{4})(?P<sep>[-/.])(?P<m>\d{1,2})(?P=sep)(?P<d>\d{1,2})(?:T|\s+)" + _END)),
    ("a/b/y", re.compile(r"(?P<a>\d{1,2})(?P<sep>[-/.])(?P<b>\d{1,2})(?P=sep)(?P<y>\d{4})(?:T|,?\s+)" + _END)),
    ("y-day", re.compile(r"(?P<y>\d{4})[-,.](?P<j>\d{3})(?:[T,]|\s+)" + _END)),
    ("d mon y", re.compile(r"(?:[A-Za-z]{3,9},?\s+)?(?P<d>\d{1,2})[ -](?P<mon>[A-Za-z]{3,9})[ -](?P<y>\d{4})\s+" + _END)),
    ("mon d, y", re.compile(r"(?P<mon>[A-Za-z]{3,9})\s+(?P<d>\d{1,2}),?\s+(?P<y>\d{4})\s+" + _END)),
    ("compact", re.compile(r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})(?:T|\s)?(?P<H>\d{2})(?P<M>\d{2})(?P<S>\d{2})(?:[.,](?P<f>\d+))?(?P<ap>)" + _ZONE + r"$")),
]
_COUNT = re.compile(r"(-?)(\d{1,20})(?:\.(\d+))?$", re.ASCII)
_BY_LETTER, _BY_DIGIT = [x for x in _LAYOUTS if "mon" in x[0]], [x for x in _LAYOUTS if x[0] != "mon d, y"]
FIRST, LAST = -62_135_596_800_000_000, 253_402_300_799_999_999


def _date(y: int, m: int, d: int) -> int | None:
    try:
        return (date(y, m, d).toordinal() - EPOCH) * DAY
    except ValueError:
        return None


def _time(g: dict) -> int | None:
    h, m, s = int(g["H"]), int(g["M"]), int(g["S"] or 0)
    f = int((g["f"] or "0")[:6].ljust(6, "0"))
    if g["ap"]:
        if not 1 <= h <= 12:
            return None
        h = h % 12 + 12 * (g["ap"] in ("PM", "pm", "Pm", "pM"))
    if h == 24 and (m, s, f) == (0, 0, 0) and not g["ap"]:
        return DAY
    if h > 23 or m > 59 or s > 59:
        return None
    return ((h * 60 + m) * 60 + s) * 1_000_000 + f


def _count(sign: str, digits: str, fraction: str) -> int | None:
    n = int(digits)
    if not sign and not fraction and (len(digits) == 4 or (len(digits) == 8 and _date(int(digits[:4]), int(digits[4:6]), int(digits[6:])) is not None)):
        return None
    if n < 10**17:
        unit = 1_000_000 if n < 10**11 else 1000 if n < 10**14 else 1
        v = n * unit + int((fraction or "0")[:6].ljust(6, "0")) * unit // 1_000_000
    else:
        v = n // 1000
    v = -v if sign else v
    return v if FIRST <= v <= LAST else None


def interpret(text: str | None) -> list[tuple[str, str, str, int, str]]:
    if text is None:
        return []
    s = text.strip()
    if not s:
        return []
    out: list[tuple[str, str, str, int, str]] = []
    if m := _COUNT.match(s):
        v = _count(*m.groups())
        if len(m[2]) == 14 and not m[1]:
            out = _dated(s, _BY_DIGIT)
        return out or ([("count", "", "utc", v, "")] if v is not None else [])
    return _dated(s, _BY_DIGIT if s[0].isdecimal() else _BY_LETTER)


def _dated(s: str, layouts: list) -> list[tuple[str, str, str, int, str]]:
    out: list[tuple[str, str, str, int, str]] = []
    for layout, pattern in layouts:
        m = pattern.match(s)
        if not m:
            continue
        g = m.groupdict()
        t = _time(g)
        if t is None:
            continue
        y, name = int(g["y"]), layout
        days: list[tuple[str, int | None]]
        if name in ("y-m-d", "compact"):
            days = [("", _date(y, int(g["m"]), int(g["d"])))]
        elif name == "a/b/y":
            a, b = int(g["a"]), int(g["b"])
            days = [("dmy", _date(y, b, a)), ("mdy", _date(y, a, b))]
        elif name == "y-day":
            first, j = _date(y, 1, 1), int(g["j"])
            leap = (y % 4 == 0 and y % 100 != 0) or y % 400 == 0
            days = [("", first + (j - 1) * DAY if first is not None and 1 <= j <= 365 + leap else None)]
        else:
            mon = MONTHS.get(g["mon"][:3].lower())
            days = [("", _date(y, mon, int(g["d"])) if mon else None)]
        days = [(o, d) for o, d in days if d is not None]
        if len({d for _, d in days}) < len(days):
            days = [("", days[0][1])]  # both orders name the same day
        for order, d in days:
            name = f"{layout} {order}".rstrip()
            order = order if len(days) > 1 else ""
            if g["off"]:
                o = g["off"].replace(":", "")
                mins = int(o[1:3]) * 60 + int(o[3:5] or 0)
                if mins <= 18 * 60 and int(o[3:5] or 0) < 60:
                    out.append((f"{name} offset", order, "utc", d + t - (mins if o[0] == "+" else -mins) * 60_000_000, ""))
            elif g["abbr"] in UNIVERSAL:
                out.append((f"{name} zone", order, "utc", d + t, ""))
            elif g["abbr"]:
                out.append((f"{name} zone", order, "abbr", d + t, g["abbr"]))
            elif g["id"]:
                out.append((f"{name} id", order, "named", d + t, g["id"]))
            else:
                out.append((name, order, "clock", d + t, ""))
    return out


KINDS = ("utc", "clock", "abbr", "named")
_SHAPE = {ord(c): "9" for c in "0123456789"}
_FEW = 6  # texts of one shape that are read one by one


def _shape(shape: str) -> list[tuple] | None:
    """Layouts that texts of a shape (digits as 9) fit, with the places of their parts; None where digits beyond these parts matter."""
    found = []
    for layout, pattern in _BY_DIGIT if shape[0] == "9" else _BY_LETTER:
        m = pattern.match(shape)
        if m:
            g = m.groupdict()
            if g["id"] and "9" in g["id"]:
                return None
            found.append((layout, {k: m.span(k) for k, v in g.items() if v}, g))
    return found


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether the date exists, its days since 1970)."""
    ok = (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1)
    month = (np.where(ok, y, 1970) - 1970) * 12 + np.where(ok, m, 1) - 1
    first = month.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    after = (month + 1).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    return ok & (d <= after - first), first + d - 1


def _alike(texts: list[str], layout: str, at: dict, g: dict):  # noqa: ANN202
    """The readings of texts of one shape in one layout: (places, name, order, kind, micros, zone)."""
    digits = np.array(texts, f"S{len(texts[0])}").view(np.uint8).reshape(len(texts), -1).astype(np.int64) - 48

    def num(key: str) -> np.ndarray:
        v = np.zeros(len(texts), np.int64)
        for k in range(*at[key]) if key in at else ():
            v = v * 10 + digits[:, k]
        return v

    h, mi, s = num("H"), num("M"), num("S")
    f = np.zeros(len(texts), np.int64)
    if "f" in at:
        a, b = at["f"]
        b = min(b, a + 6)
        for k in range(a, b):
            f = f * 10 + digits[:, k]
        f = f * 10 ** (6 - (b - a))
    ok = (mi <= 59) & (s <= 59)
    if g["ap"]:
        ok &= (h >= 1) & (h <= 12)
        h = h % 12 + 12 * (g["ap"].lower() == "pm")
    else:
        ok &= (h <= 23) | ((h == 24) & (mi == 0) & (s == 0) & (f == 0))
    t = ((h * 60 + mi) * 60 + s) * 1_000_000 + f
    y = num("y")
    if layout == "a/b/y":
        a, b = num("a"), num("b")
        (v1, d1), (v2, d2) = _days(y, b, a), _days(y, a, b)
        same = v1 & v2 & (d1 == d2)
        days = [(v1 & v2 & ~same, "a/b/y dmy", "dmy", d1), (v1 & v2 & ~same, "a/b/y mdy", "mdy", d2), (same, layout, "", d1), (v1 & ~v2, "a/b/y dmy", "", d1), (v2 & ~v1, "a/b/y mdy", "", d2)]
    elif layout == "y-day":
        v, first = _days(y, np.ones_like(y), np.ones_like(y))
        j = num("j")
        leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
        days = [(v & (j >= 1) & (j <= 365 + leap), layout, "", first + j - 1)]
    else:
        m = num("m") if "m" in at else np.full(len(texts), MONTHS.get(g["mon"][:3].lower(), 0))
        days = [(*_days(y, m, num("d")), layout, "")]
        days = [(v, name, order, d) for v, d, name, order in days]
    kind, zone, east = "clock", "", 0
    if g["off"]:
        a, b = at["off"]
        two = lambda k: digits[:, k] * 10 + digits[:, k + 1]
        minutes = two(b - 2) if b - a > 3 else np.zeros(len(texts), np.int64)
        east = two(a + 1) * 60 + minutes
        ok &= (east <= 18 * 60) & (minutes < 60)
        kind, east, suffix = "utc", np.where(digits[:, a] == ord("+") - 48, east, -east) * 60_000_000, " offset"
    elif g["abbr"] in UNIVERSAL:
        kind, suffix = "utc", " zone"
    elif g["abbr"]:
        kind, zone, suffix = "abbr", g["abbr"], " zone"
    elif g["id"]:
        kind, zone, suffix = "named", g["id"], " id"
    else:
        suffix = ""
    for v, name, order, d in days:
        hit = np.flatnonzero(v & ok)
        if len(hit):
            yield hit, name + suffix, order, kind, (d * DAY + t - east)[hit], zone


def interpret_all(texts: list[str | None]):  # noqa: ANN201
    """interpret() of many texts, those of one shape at once: yields (places, layout, order, kind, micros, zone); a text's readings come in order."""
    groups: dict[str, list[int]] = {}
    held: list[str] = []
    for i, text in enumerate(texts):
        x = text.strip() if text is not None else ""
        held.append(x)
        if x:
            groups.setdefault(x.translate(_SHAPE), []).append(i)
    rest: list[int] = []
    for shape, places in groups.items():
        if len(places) < _FEW or not shape.isascii() or len(shape) > 80 or not shape.strip("9.-"):
            rest.extend(places)  # counts, rare and odd ones
            continue
        found = _shape(shape)
        if found is None:
            rest.extend(places)
            continue
        at = np.array(places)
        for layout, spans, g in found:
            for hit, *more in _alike([held[i] for i in places], layout, spans, g):
                yield at[hit], *more
    single: dict[tuple, tuple[list[int], list[int]]] = {}
    for i in rest:
        for layout, order, kind, v, zone in interpret(held[i]):
            places, values = single.setdefault((layout, order, kind, zone), ([], []))
            places.append(i)
            values.append(v)
    for (layout, order, kind, zone), (places, values) in single.items():
        yield np.array(places), layout, order, kind, np.array(values), zone


def offsets_at(tz: str, clock: np.ndarray, dst: bool) -> np.ndarray:
    """UTC micros of clock readings in tz; for one that occurs twice the earlier (dst) or later instant; NaT (min long) if skipped or the zone is unknown."""
    import pandas as pd

    s = pd.DatetimeIndex(clock.astype("datetime64[us]"))
    try:
        u = s.tz_localize(tz, ambiguous=np.full(len(s), dst), nonexistent="NaT").tz_convert("UTC").tz_localize(None)
    except Exception:  # noqa: BLE001 - unknown zone names are data, not faults
        return np.full(len(s), np.iinfo(np.int64).min)
    return u.to_numpy().astype("datetime64[us]").astype(np.int64)


def standard_offset(tz: str, clock: np.ndarray, dst: bool) -> np.ndarray | None:
    """Micros east of UTC that an abbreviation of standard (or daylight) time of tz means around the given clock readings."""
    from datetime import UTC, datetime, timedelta
    from zoneinfo import ZoneInfo

    try:
        z = ZoneInfo(tz)
    except Exception:  # noqa: BLE001
        return None
    years = (clock.astype("datetime64[us]").astype("datetime64[Y]").astype(int) + 1970).astype(int)
    out = np.zeros(len(clock), np.int64)
    for y in np.unique(years):
        found = {bool(x.dst()): x.utcoffset() for m in range(1, 13) for x in [datetime(int(min(max(y, 1), 9998)), m, 15, tzinfo=UTC).astimezone(z)]}
        raw = found.get(dst)
        if raw is None:
            return None
        out[years == y] = raw // timedelta(microseconds=1)
    return out
