"""MiniSEED version 2 records: decode and encode on numpy.

Encodings: 16- and 32-bit integers, 32- and 64-bit floats, Steim 1 and 2.
"""

from __future__ import annotations

import struct
from datetime import datetime, timedelta, timezone

import numpy as np

# Encoding numbers of the format.
INT16, INT32, FLOAT32, FLOAT64, STEIM1, STEIM2 = 1, 3, 4, 5, 10, 11
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def _rate(factor: int, mult: int) -> float:
    f = float(factor) if factor > 0 else -1.0 / factor if factor else 0.0
    return f * mult if mult > 0 else -f / mult if mult else 0.0


def _signed(words: np.ndarray, bits: int, count: int) -> np.ndarray:
    """count fields of `bits` each from the low end of 32-bit words, highest first."""
    shifts = np.arange(count - 1, -1, -1) * bits
    v = (words[:, None].astype(np.int64) >> shifts) & ((1 << bits) - 1)
    return np.where(v >= 1 << (bits - 1), v - (1 << bits), v)


# Bits and number of differences of a word by its code (and, in version 2, its top two bits).
_STEIM1_WORDS = {(1, None): (8, 4), (2, None): (16, 2), (3, None): (32, 1)}
_STEIM2_WORDS = {(1, None): (8, 4), (2, 1): (30, 1), (2, 2): (15, 2), (2, 3): (10, 3), (3, 0): (6, 5), (3, 1): (5, 6), (3, 2): (4, 7)}


def _steim(data: bytes, n: int, version: int) -> np.ndarray:
    """All words of one kind are unpacked at once and put where the words before them end."""
    w = np.frombuffer(data[: len(data) // 64 * 64], ">u4").reshape(-1, 16)
    first = np.int64(np.int32(w[0, 1].astype(np.uint32).view(np.int32)))
    code = (w[:, :1].astype(np.int64) >> (30 - 2 * np.arange(16))) & 3
    code[:, 0] = 0
    code, words = code.ravel(), w.ravel().astype(np.int64)
    kinds, count = [], np.zeros(len(words), np.int64)
    for (c, top), (bits, each) in (_STEIM1_WORDS if version == 1 else _STEIM2_WORDS).items():
        at = np.flatnonzero((code == c) & ((words >> 30 == top) if top is not None else True))
        count[at] = each
        kinds.append((at, bits, each))
    if (count[code > 0] == 0).any():
        raise ValueError("bad Steim word")
    begin = np.cumsum(count) - count
    d = np.zeros(int(count.sum()), np.int64)
    for at, bits, each in kinds:
        d[begin[at][:, None] + np.arange(each)] = _signed(words[at], bits, each)
    if len(d) < n:
        raise ValueError("too few samples in a record")
    d = d[:n]
    d[0] = first
    return np.cumsum(d)


STEP = 128  # bytes; the least length of a record


def _is_header(h: bytes) -> bool:
    return len(h) >= 48 and h[:6].replace(b" ", b"0").isdigit() and h[6:7] in (b"D", b"R", b"Q", b"M")


def records(data: bytes, strict: bool = False, skipped: list[int] | None = None):  # noqa: ANN201
    """(network, station, location, channel, tmin_us, rate_hz, samples) of each record.

    Where a record is damaged the search goes on at the next place that can
    begin one; skipped collects such places. With strict they are errors.
    """
    at = 0
    while at + 48 <= len(data):
        try:
            if not _is_header(data[at : at + 48]):
                raise ValueError(f"no record at byte {at}")
            length, found = _record(data, at)
        except (ValueError, IndexError, struct.error, UnicodeDecodeError, OverflowError, KeyError) as e:
            if strict:
                raise ValueError(str(e)) from e
            if skipped is not None:
                skipped.append(at)
            at += STEP
            while at + 48 <= len(data) and not _is_header(data[at : at + 48]):
                at += STEP
            continue
        if found is not None:
            yield found
        at += length


def _record(data: bytes, at: int) -> tuple[int, tuple | None]:
    """Length of the record at a place, and what it holds."""
    h = data[at : at + 48]
    sta, loc, cha, net = (h[a:b].decode("ascii").strip() for a, b in ((8, 13), (13, 15), (15, 18), (18, 20)))
    year, day, hour, minute, sec, _, frac, n, factor, mult = struct.unpack(">HHBBBBHHhh", h[20:36])
    correction, begin, block = struct.unpack(">iHH", h[40:48])
    t = _EPOCH.replace(year=year) + timedelta(days=day - 1, hours=hour, minutes=minute, seconds=sec, microseconds=frac * 100)
    tmin = round((t - _EPOCH) / timedelta(microseconds=1)) + (correction * 100 if not h[36] & 2 else 0)
    encoding, length, rate, micro = STEIM1, 512, _rate(factor, mult), 0
    before = 0
    while block:
        if block <= before:
            raise ValueError("blockettes go in a circle")
        before = block
        kind, nxt = struct.unpack(">HH", data[at + block : at + block + 4])
        if kind == 1000:
            encoding, length = data[at + block + 4], 1 << data[at + block + 6]
        elif kind == 1001:
            micro = struct.unpack(">b", data[at + block + 5 : at + block + 6])[0]
        elif kind == 100:
            rate = struct.unpack(">f", data[at + block + 4 : at + block + 8])[0]
        block = nxt
    body = data[at + begin : at + length]
    if not n or not begin:
        return length, None
    if encoding in (STEIM1, STEIM2):
        x = _steim(body, n, 1 if encoding == STEIM1 else 2)
    else:
        kind = {INT16: ">i2", INT32: ">i4", FLOAT32: ">f4", FLOAT64: ">f8"}[encoding]
        x = np.frombuffer(body, kind, n)
    return length, (net, sta, loc, cha, tmin + micro, rate, x.astype(float))


def _steim1(x: np.ndarray, frames: int, before: int) -> tuple[bytes, int]:
    """Steim-1 frames from the front of x, and how many samples they hold."""
    d = np.diff(np.r_[before, x]).astype(np.int64)
    words: list[tuple[int, int]] = []
    i = 0
    room = frames * 15 - 2
    while i < len(d) and len(words) < room:
        if i + 4 <= len(d) and np.abs(d[i : i + 4]).max() < 128:
            words.append((1, struct.unpack(">I", struct.pack(">4b", *d[i : i + 4].tolist()))[0]))
            i += 4
        elif i + 2 <= len(d) and np.abs(d[i : i + 2]).max() < 32768:
            words.append((2, struct.unpack(">I", struct.pack(">2h", *d[i : i + 2].tolist()))[0]))
            i += 2
        else:
            words.append((3, int(d[i]) & 0xFFFFFFFF))
            i += 1
    words = [(0, int(x[0]) & 0xFFFFFFFF), (0, int(x[i - 1]) & 0xFFFFFFFF), *words]
    out = b""
    for f in range(frames):
        part = (words[f * 15 : f * 15 + 15] + [(0, 0)] * 15)[:15]
        head = 0
        for c, _ in part:
            head = head << 2 | c
        out += struct.pack(">16I", head, *[w for _, w in part])
    return out, i


def encode(network: str, station: str, location: str, channel: str, tmin_us: int, rate_hz: float, samples: np.ndarray, length: int = 512) -> bytes:
    """Integer samples as Steim-1 records, others as 64-bit floats."""
    x = np.asarray(samples, float)
    whole = len(x) > 0 and bool(np.all(x == np.round(x)) and np.abs(x).max() < 2**30)
    factor, mult = (round(rate_hz), 1) if rate_hz >= 1 and rate_hz == round(rate_hz) else (round(rate_hz * 1000), -1000)
    out, i, seq = b"", 0, 1
    while i < len(x):
        if whole:
            body, n = _steim1(x[i:].astype(np.int64), (length - 64) // 64, int(x[i - 1]) if i else int(x[0]))
        else:
            n = min(len(x) - i, (length - 64) // 8)
            body = x[i : i + n].astype(">f8").tobytes()
        t = _EPOCH + timedelta(microseconds=int(tmin_us + round(i / rate_hz * 1e6)))
        frac, micro = divmod(t.microsecond, 100)
        if micro > 49:
            frac, micro = frac + 1, micro - 100
        if frac == 10_000:
            t, frac = t + timedelta(seconds=1), 0
        head = f"{seq % 1_000_000:06d}D ".encode() + f"{station:<5}{location:<2}{channel:<3}{network:<2}".encode("ascii")
        head += struct.pack(">HHBBBBHHhh", t.year, t.timetuple().tm_yday, t.hour, t.minute, t.second, 0, frac, n, factor, mult)
        head += struct.pack(">BBBBiHH", 0, 0, 0, 2, 0, 64, 48)
        head += struct.pack(">HHBBBB", 1000, 56, STEIM1 if whole else FLOAT64, 1, length.bit_length() - 1, 0)
        head += struct.pack(">HHBbBB", 1001, 0, 0, micro, 0, 0)
        out += (head + body).ljust(length, b"\0")
        i, seq = i + n, seq + 1
    return out
