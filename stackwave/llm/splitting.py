"""Cut oversized texts at natural boundaries by agglomerative merging.

A text begins as atomic segments. Adjacent pairs lie in a heap by the strength
of the boundary between them (inside a word, word, sentence, line, cue), then by
combined size, then by position; the weakest boundary merges first while the
combined size plus the overlap fits the limit. Each piece but the first also
holds the end of the one before it.

Segments inside a cue that fits always merge before any cue boundary comes up,
so a cue that fits enters as one atom; only longer cues are cut to lines,
longer lines to sentences, longer sentences to words, longer words between
characters.

Defined cases: null texts and texts within the limit give no pieces; the shared
part starts at a character, so it may exceed the overlap by up to three bytes
and never falls short of it, except before a shorter text; pieces never exceed
the limit; repeated rows are cut each; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackwave.plans.dist import arrow_schema

INSIDE, WORD, SENTENCE, LINE, CUE = range(5)
_CUE = re.compile(rb"(?:\r\n|\n|\r)(?:[ \t]*(?:\r\n|\n|\r))+")
_LINE = re.compile(rb"\r\n|\n|\r")
_SENTENCE = re.compile("(?:[.!?]+|…|。|！|？|؟|।)[\"')\\]]*[ \t]+".encode())
_WORD = re.compile(rb"[ \t]+")
_LEVELS = ((CUE, _CUE), (LINE, _LINE), (SENTENCE, _SENTENCE), (WORD, _WORD))


def floor_char(b: bytes, at: int) -> int:
    """The last character start at or before byte `at`."""
    while 0 < at < len(b) and b[at] & 0xC0 == 0x80:
        at -= 1
    return at


def atoms(b: bytes, room: int) -> list[tuple[int, int, int]]:
    """(start, end, strength of the boundary at end) of segments of at most room bytes."""
    out: list[tuple[int, int, int]] = []

    def cut(start: int, end: int, level: int, strength: int) -> None:
        if end - start <= room:
            out.append((start, end, strength))
            return
        if level == len(_LEVELS):
            while end - start > room:
                mid = floor_char(b, start + room)
                out.append((start, mid, INSIDE))
                start = mid
            out.append((start, end, strength))
            return
        name, pattern = _LEVELS[level]
        at = start
        for m in pattern.finditer(b, start, end):
            if m.end() < end:
                cut(at, m.end(), level + 1, name)
                at = m.end()
        cut(at, end, level + 1, strength)

    # The outermost level always cuts, so that cues are atoms also in texts that nearly fit
    at = 0
    for m in _CUE.finditer(b):
        if m.end() < len(b):
            cut(at, m.end(), 1, CUE)
            at = m.end()
    cut(at, len(b), 1, CUE)
    return out


def merge(b: bytes, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(shared start, start, end) of each piece; the piece is b[shared start:end]."""
    shared = lambda s: floor_char(b, max(0, s - overlap))
    a = atoms(b, limit - overlap - 3)
    n = len(a)
    start, end, strength = [x[0] for x in a], [x[1] for x in a], [x[2] for x in a]
    right = list(range(1, n + 1))
    left = list(range(-1, n - 1))
    alive = [True] * n
    base = [shared(s) for s in start]
    heap = [(strength[i], end[i + 1] - start[i], i, i + 1) for i in range(n - 1) if end[i + 1] - base[i] <= limit]
    heapq.heapify(heap)
    while heap:
        _, size, i, j = heapq.heappop(heap)
        if not alive[i] or not alive[j] or right[i] != j or end[j] - start[i] != size:
            continue
        end[i], strength[i], right[i] = end[j], strength[j], right[j]
        alive[j] = False
        k = right[i]
        if k < n:
            left[k] = i
            if end[k] - base[i] <= limit:
                heapq.heappush(heap, (strength[i], end[k] - start[i], i, k))
        h = left[i]
        if h >= 0 and end[i] - base[h] <= limit:
            heapq.heappush(heap, (strength[h], end[i] - start[h], h, i))
    return [(base[i], start[i], end[i]) for i in range(n) if alive[i]]


_PIECES = "doc_id long, piece int, byte_start long, byte_end long, shared_bytes int, n_tokens int, text string"


def _cut(limit: int, overlap: int):
    schema = arrow_schema(_PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for key, text in zip(batch.column("doc_id"), batch.column("text")):
                b = text.as_buffer().to_pybytes()
                for k, (s, a, e) in enumerate(merge(b, limit, overlap)):
                    rows.append((key.as_py(), k, a, e, a - s, e - s, b[s:e].decode("utf-8", "replace")))
                    size += e - s
                if size > 16_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def split_oversized(docs: DataFrame, key: str, text: str, limit: int = 4096, overlap: int = 256) -> DataFrame:
    """(doc_id, piece, byte_start, byte_end, shared_bytes, n_tokens, text): the pieces of each text of more than limit tokens.

    byte_start and byte_end bound the piece's own part; shared_bytes of the
    text before it repeat the end of the piece before.
    """
    if limit <= 2 * (overlap + 8):
        raise ValueError("the limit must leave room beside the overlap")
    long = docs.where(F.octet_length(text) > limit).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return long.mapInArrow(_cut(limit, overlap), _PIECES)
