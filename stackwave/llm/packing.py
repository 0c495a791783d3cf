"""Fill fixed-capacity containers by multiway differencing.

Largest differencing (Karmarkar and Karp) over k windows: every item begins as
a partial partition of k sums; the two partial partitions with the largest
spread merge so that the largest sums of one meet the smallest of the other.
The result is k near-equal windows. k starts at the least count that could do
and rises while a window exceeds the capacity.

Texts are packed where they are read, in blocks of at most BLOCK items, so no
text moves between tasks; only the last block of a task is smaller.

Defined cases: null and empty texts hold no tokens and are in no container; a
text larger than a container is cut into full parts at characters and a rest,
no other text is cut; repeated rows are packed each; other columns are ignored.
The input must be a deterministic scan (a stored table), as the container's
name holds its task and block.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackwave.llm.splitting import floor_char
from stackwave.plans.dist import arrow_schema

BLOCK = 2048
BLOCK_BYTES = 64_000_000


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """k windows (lists of item numbers) of near-equal sums; k >= 1."""
    n = len(sizes)
    order = sorted(range(n), key=lambda i: (-sizes[i], i))
    if n <= k:
        return [[i] for i in order]
    # A partial partition: sums in descending order and the items' tree of each; absent sums are 0.
    kids: list[tuple[int, int]] = []  # of inner tree nodes, numbered from n
    sums: dict[int, list[int]] = {}
    trees: dict[int, list[int]] = {}
    heap: list[tuple[int, int]] = []
    nxt = 0
    at = 0  # items of order that are not yet in a partition; each alone spreads by its size

    def push(v: list[int], t: list[int]) -> None:
        nonlocal nxt
        sums[nxt], trees[nxt] = v, t
        heapq.heappush(heap, (-(v[0] - (v[-1] if len(v) == k else 0)), nxt))
        nxt += 1

    def node(a: int, b: int) -> int:
        kids.append((a, b))
        return n + len(kids) - 1

    def take() -> tuple[list[int], list[int]]:
        nonlocal at
        if at < n and (not heap or sizes[order[at]] >= -heap[0][0]):
            at += 1
            return [sizes[order[at - 1]]], [order[at - 1]]
        _, i = heapq.heappop(heap)
        return sums.pop(i), trees.pop(i)

    while at < n or len(heap) > 1:
        v, t = take()
        if at >= n and not heap:
            push(v, t)
            break
        # While a sum is absent the spread is the largest sum, so single items follow in order
        if len(v) < k and at < n and (not heap or sizes[order[at]] >= -heap[0][0]) and sizes[order[at]] <= v[-1]:
            while len(v) < k and at < n and (not heap or sizes[order[at]] >= -heap[0][0]):
                v.append(sizes[order[at]])
                t.append(order[at])
                at += 1
            push(v, t)
            continue
        w, u = take()
        if len(w) == 1 and len(v) == k:
            x, c = v.pop() + w[0], node(t.pop(), u[0])
            lo, hi = 0, len(v)
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (mid + 1, hi) if v[mid] >= x else (lo, mid)
            v.insert(lo, x)
            t.insert(lo, c)
            push(v, t)
            continue
        both = max(0, len(v) + len(w) - k)
        # the last `both` sums of v meet the last `both` of w in reverse order
        pairs = [(v[len(v) - both + i] + w[len(w) - 1 - i], node(t[len(v) - both + i], u[len(w) - 1 - i])) for i in range(both)]
        pairs += [*zip(v[: len(v) - both], t[: len(v) - both]), *zip(w[: len(w) - both], u[: len(w) - both])]
        pairs.sort(key=lambda p: -p[0])
        push([p[0] for p in pairs], [p[1] for p in pairs])
    (_, last) = heap[0]
    out = []
    for root in trees[last]:
        stack, items = [root], []
        while stack:
            x = stack.pop()
            if x < n:
                items.append(x)
            else:
                stack += kids[x - n]
        out.append(sorted(items))
    return out


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most capacity: the count rises from the least possible one while it is exceeded."""
    if not sizes:
        return []
    least = max(1, -(-sum(sizes) // capacity))
    fits = lambda w: all(sum(sizes[i] for i in x) <= capacity for x in w)
    low, k, step = least - 1, least, 1
    while True:
        got = differencing(sizes, k)
        if fits(got):
            break
        low, k, step = k, min(k + step, len(sizes)), step * 2
    best = got
    high = k
    while high - low > 1:  # the least count between the last that failed and the first that fits
        mid = (low + high) // 2
        got = differencing(sizes, mid)
        if fits(got):
            best, high = got, mid
        else:
            low = mid
    return best


_OUT = "container string, position int, doc_id long, part int, byte_start long, byte_end long, n_tokens int, text string"


def _fill(capacity: int, block: int):
    schema = arrow_schema(_OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        made = 0
        items: list[tuple[int, int, int, int, bytes]] = []  # doc, part, start, end, bytes
        held = 0

        def emit(windows: list[list[tuple]], tag: str) -> pa.RecordBatch:
            rows = [(f"{task}-{tag}-{w}", p, d, part, s, e, e - s, b.decode("utf-8", "replace")) for w, win in enumerate(windows) for p, (d, part, s, e, b) in enumerate(win)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal items, held, made
            if items:
                yield emit([[items[i] for i in w] for w in pack([x[3] - x[2] for x in items], capacity)], f"{made}")
                made += 1
            items, held = [], 0

        for batch in batches:
            for key, text in zip(batch.column("doc_id"), batch.column("text")):
                b = text.as_buffer().to_pybytes()
                key, part, start = key.as_py(), 0, 0
                full: list[list[tuple]] = []
                while len(b) - start > capacity:
                    end = floor_char(b, start + capacity)
                    full.append([(key, part, start, end, b[start:end])])
                    part, start = part + 1, end
                    if len(full) == 2000:
                        yield emit(full, f"{made}f")
                        made, full = made + 1, []
                if full:
                    yield emit(full, f"{made}f")
                    made += 1
                items.append((key, part, start, len(b), b[start:]))
                held += len(b) - start
                if len(items) >= block or held >= BLOCK_BYTES:
                    yield from close()
        yield from close()

    return run


def fill_containers(docs: DataFrame, key: str, text: str, capacity: int = 8192, block: int = BLOCK) -> DataFrame:
    """(container, position, doc_id, part, byte_start, byte_end, n_tokens, text): every token of every text in one container."""
    rows = docs.where(F.octet_length(text) > 0).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_fill(capacity, block), _OUT)
