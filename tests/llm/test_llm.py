"""Containers, mixing and splitting against brute force, round trips and defined cases."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from stackwave.llm import mixing, packing, queries, splitting
from tests.oracle import connect, form


@pytest.mark.parametrize("name", list(queries.SQL))
def test_same_rows(spark, data, name):
    got, want = form(queries.QUERIES[name](spark, data).toPandas()), form(connect(data).execute(queries.SQL[name]).df())
    assert got == want


def text_of(r, n):
    words = ["an", "wörter", "да", "日本", "x" * r.randrange(1, 40)]
    out = ""
    while len(out.encode()) < n:
        out += r.choice(words) + r.choice([" ", ". ", "\n", "\n\n", "\r\n", "! "])
    return out


# -- splitting


@pytest.mark.parametrize("limit,overlap", [(100, 20), (400, 64)])
def test_pieces_round_trip(limit, overlap):
    r = random.Random(limit)
    for t in [text_of(r, r.randrange(limit, 9000)) for _ in range(30)] + ["é" * 5000, "a" * 999, "日" * 700 + "\n\n" + "b" * 50]:
        b = t.encode()
        pieces = splitting.merge(b, limit, overlap)
        assert pieces[0][:2] == (0, 0) and pieces[-1][2] == len(b)
        for s, a, e in pieces:
            assert 0 < e - s <= limit
            b[s:e].decode()
            assert a == 0 or min(overlap, a) <= a - s <= overlap + 3
        for (_, _, e), (_, a, _) in itertools.pairwise(pieces):
            assert e == a
        # maximal: no two neighbours would still fit together
        for (s, _, _), (_, _, e) in itertools.pairwise(pieces):
            assert e - s > limit


def test_cuts_at_the_strongest_boundary():
    cue = ("word " * 8).strip() + ".\n"
    t = "".join(f"{i}\n{cue}\n" for i in range(60))
    ends = [t.encode()[:e] for _, _, e in splitting.merge(t.encode(), 300, 40)]
    assert all(x.endswith(b"\n\n") for x in ends)


def test_split_table(spark):
    rows = [(1, "a b. " * 100, "q"), (2, None, "q"), (3, "", "q"), (4, "x" * 100, "q"), (5, "y" * 101, "q"), (5, "y" * 101, "q")]
    df = spark.createDataFrame(rows, "id long, body string, text string")
    out = splitting.split_oversized(df, "id", "body", 100, 20).collect()
    assert {x.doc_id for x in out} == {1, 5}
    assert sum(x.byte_end - x.byte_start for x in out if x.doc_id == 5) == 202
    assert max(x.n_tokens for x in out) <= 100 and all(len(x.text.encode()) == x.n_tokens for x in out)
    assert splitting.split_oversized(df.where("false"), "id", "body", 100, 20).count() == 0
    with pytest.raises(ValueError):
        splitting.split_oversized(df, "id", "body", 100, 60)


# -- containers


def reference_differencing(sizes, k):
    """The plain form: full tuples, largest spread first."""
    parts = [sorted([s] + [0] * (k - 1), reverse=True) for s in sorted(sizes, reverse=True)]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[0] - p[-1], reverse=True)
        a, b = parts.pop(0), parts.pop(0)
        parts.append(sorted((x + y for x, y in zip(a, reversed(b))), reverse=True))
    return parts[0]


def test_differencing():
    r = random.Random(1)
    for n, k in ((1, 1), (5, 2), (12, 3), (40, 7), (200, 60), (30, 40)):
        sizes = [r.choice([1, 5, 5, r.randrange(1, 100)]) for _ in range(n)]
        w = packing.differencing(sizes, k)
        assert sorted(i for x in w for i in x) == list(range(n)) and len(w) <= k
        sums = [sum(sizes[i] for i in x) for x in w]
        want = reference_differencing(sizes, k)
        assert max(sums) <= max(want) * 1.05 + 1
        assert max(sums) - (min(sums) if len(w) == k else 0) <= max(want) - min(want) + 5


def test_pack_is_tight():
    r = random.Random(2)
    for _ in range(10):
        sizes = [min(100, 1 + int(r.expovariate(1 / 20))) for _ in range(400)]
        w = packing.pack(sizes, 100)
        assert all(sum(sizes[i] for i in x) <= 100 for x in w)
        assert len(w) <= sum(sizes) / 100 * 1.03 + 2
    assert packing.pack([], 10) == [] and packing.pack([10, 10], 10) == [[0], [1]]


def test_containers_round_trip(spark):
    r = random.Random(3)
    rows = [(i, text_of(r, r.choice([0, 5, 300, 2500])), "q") for i in range(300)] + [(900, None, "q"), (901, "", "q"), (902, "ü" * 1500, "q"), (902, "ü" * 1500, "q")]
    df = spark.createDataFrame(rows, "id long, body string, text string")
    out = packing.fill_containers(df, "id", "body", 1000, block=64).collect()
    by = {}
    for x in out:
        by.setdefault(x.container, []).append(x)
        assert len(x.text.encode()) == x.n_tokens == x.byte_end - x.byte_start
    assert max(sum(y.n_tokens for y in v) for v in by.values()) <= 1000
    for k, t, _ in rows[:300]:
        parts = sorted((x for x in out if x.doc_id == k), key=lambda x: x.part)
        assert "".join(p.text for p in parts) == t
        assert len(parts) <= 1 or len(t.encode()) > 1000
    assert sum(x.n_tokens for x in out if x.doc_id == 902) == 6000
    assert packing.fill_containers(df.where("false"), "id", "body").count() == 0


# -- mixing


def test_flight_keeps_its_sums():
    r = random.Random(4)
    for _ in range(20):
        n = r.randrange(1, 200)
        sizes, x = [r.choice([3, 3, r.randrange(1, 1000)]) for _ in range(n)], [r.random() for _ in range(n)]
        y = list(x)
        mixing.fly(y, sizes, r)
        assert abs(sum(x) - sum(y)) < 1e-6 and abs(sum(a * b for a, b in zip(x, sizes)) - sum(a * b for a, b in zip(y, sizes))) < 1e-4
        assert sum(0 < v < 1 for v in y) <= 2
        mixing.land(y, sizes)
        assert set(y) <= {0.0, 1.0}


def test_flight_draws_as_probable():
    hits = [0] * 30
    for k in range(2000):
        x = [0.3] * 30
        mixing.settle(x, [5 + i % 4 for i in range(30)], random.Random(k))
        hits = [h + v for h, v in zip(hits, x)]
    assert all(0.22 < h / 2000 < 0.38 for h in hits)


@pytest.mark.parametrize("block", [40, 20_000])
def test_mix(spark, block):
    r = random.Random(5)
    rows = [(i, s, "w" * r.randrange(1, 90), "q") for i, s in enumerate(["big"] * 900 + ["mid"] * 150 + ["small"] * 30 + ["other"] * 20)]
    rows += [(5000, None, "w", "q"), (5001, "big", None, "q"), (5002, "big", "", "q"), (1, "big", "w" * 7, "q")]
    df = spark.createDataFrame(rows, "id long, src string, body string, text string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.1, 4), ("absent", 0.1, 3)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(df, "id", "src", "body", targets, block=block)
    out = {x.source: x for x in mixing.shares(mixed, targets).collect()}
    assert out["absent"].tokens == 0 and "other" not in out
    total = sum(x.tokens for x in out.values())
    for s, w in (("big", 5 / 9), ("mid", 3 / 9), ("small", 1 / 9)):
        assert abs(out[s].tokens - w * total) < 100
        assert out[s].most_copies <= out[s].max_repeats
    size = {}
    for i, s, t, _ in rows:
        if s and t:
            size[i, s] = size.get((i, s), 0) + len(t)
    got = mixed.collect()
    assert len({(x.doc_id, x.source) for x in got}) == len(got) and all(size[x.doc_id, x.source] == x.tokens for x in got)
    assert mixing.mix(df.where("false"), "id", "src", "body", targets).count() == 0
    small = mixing.shares(mixing.mix(df, "id", "src", "body", targets, total=3000, block=block), targets)
    assert abs(small.agg(F.sum("tokens")).first()[0] - 3000) < 200
