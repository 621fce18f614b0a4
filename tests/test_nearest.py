"""The nearest bit vectors against all pairs, and the plan without a nested loop."""

import random

import pytest

from tidemark.operators import nearest


def brute(queries, candidates, n):
    out = {}
    for q, bits in queries:
        found = sorted((sum(bin(a ^ b).count("1") for a, b in zip(bits, other)), c, day) for c, day, other in candidates if c != q)
        days = [f for i, f in enumerate(found) if f[2] not in {x[2] for x in found[:i]}]
        out[q] = (found[:n], [d[:2] for d in days[:2]], len(found))
    return out


def vectors(seed, n, words, bits, spread):
    """Some near copies of a few centres, some anything, some equal, a few all zeros."""
    rng = random.Random(seed)
    centres = [[rng.getrandbits(bits) for _ in range(words)] for _ in range(5)]
    for i in range(n):
        base = list(rng.choice(centres)) if rng.random() < 0.7 else [rng.getrandbits(bits) for _ in range(words)]
        for _ in range(rng.randrange(spread)):
            base[rng.randrange(words)] ^= 1 << rng.randrange(bits)
        yield i, rng.choice("abc"), base if i % 29 else [0] * words


@pytest.mark.parametrize(("n", "words", "bits", "spread", "top"), [(300, 2, 32, 6, 5), (60, 1, 16, 20, 3), (4, 4, 63, 3, 5), (200, 1, 8, 3, 150)])
def test_nearest_equals_all_pairs(spark, n, words, bits, spread, top):
    rows = list(vectors(n, n, words, bits, spread))
    queries = [(i, b) for i, _, b in rows if i % 7 == 0] + [(1000, rows[1][2]), (1001, [(1 << bits) - 1] * words)]
    found = nearest.nearest(spark.createDataFrame(queries, "query long, bits array<long>"), spark.createDataFrame(rows, "candidate long, day string, bits array<long>"), top, words, bits, rival=True).collect()
    want = brute(queries, rows, top)
    for q, (best, days, total) in want.items():
        mine = [r for r in found if r["query"] == q]
        assert [(r.distance, r.candidate, r.day) for r in sorted((r for r in mine if r.place), key=lambda r: r.place)] == best
        assert [(r.distance, r.candidate) for r in sorted((r for r in mine if r.day_place), key=lambda r: r.day_place)] == days
        assert {r.compared for r in mine} == {total}


def test_no_rival_and_no_candidates(spark):
    rows = [(i, "a", [i * 37]) for i in range(40)]
    candidates = spark.createDataFrame(rows, "candidate long, day string, bits array<long>")
    queries = spark.createDataFrame([(3, [3 * 37])], "query long, bits array<long>")
    found = nearest.nearest(queries, candidates, 2, 1, 16, rival=True).collect()
    assert [r.place for r in sorted(found, key=lambda r: r.distance)] == [1, 2] and not [r for r in found if r.day_place == 2]
    assert nearest.nearest(queries, candidates.filter("false"), 2, 1, 16).count() == 0
    assert nearest.nearest(queries.filter("false"), candidates, 2, 1, 16).count() == 0


def test_plans_have_equi_joins_only(spark, monkeypatch):
    plans = []
    keep = nearest.written
    monkeypatch.setattr(nearest, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, name))
    rows = [(i, "ab"[i % 2], [i * 7919 % 65536]) for i in range(60)]
    candidates = spark.createDataFrame(rows, "candidate long, day string, bits array<long>")
    nearest.nearest(candidates.selectExpr("candidate AS query", "bits"), candidates, 3, 1, 16, rival=True).collect()
    assert len(plans) > 4 and not [p for p in plans if "NestedLoop" in p or "Cartesian" in p]


def test_bands_cover_every_bit():
    for n in (0, 1, 10, 10**4, 10**9):
        cut = nearest.bands(3, 64, n)
        assert sorted(b for word, a, w in cut if word == 1 for b in range(a, a + w)) == list(range(64))


def random_vectors(n):
    rng = random.Random(n)
    return [(i, "abc"[i % 3], [rng.getrandbits(32) for _ in range(2)]) for i in range(n)]


def test_far_vectors_take_no_broadcast_of_probes(spark, monkeypatch):
    plans = {}
    keep = nearest.written
    monkeypatch.setattr(nearest, "written", lambda df, name: plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, name))
    rows = random_vectors(200)
    candidates = spark.createDataFrame(rows, "candidate long, day string, bits array<long>")
    nearest.nearest(candidates.selectExpr("candidate AS query", "bits"), candidates, 5, 2, 32).collect()
    assert not [p for p in plans["pairs"] if "Broadcast" in p]
    # words at a distance are listed as long as they cost less than all pairs, which is one step here
    assert len(plans["pairs"]) == 2 and "FlatMapCoGroupsInArrow" in plans["pairs"][1]


@pytest.mark.parametrize(("name", "value"), [("BLOCK", 32), ("PAIRS_A_PROBE", 0)])
def test_rivals_of_far_vectors(spark, monkeypatch, name, value):
    """In several blocks of queries and candidates, and by probes alone."""
    plans = []
    keep = nearest.written
    monkeypatch.setattr(nearest, "written", lambda df, name: (name == "pairs" and plans.append(df._jdf.queryExecution().executedPlan().toString())) or keep(df, name))
    monkeypatch.setattr(nearest, name, value, raising=False)
    rows = random_vectors(100)
    candidates = spark.createDataFrame(rows, "candidate long, day string, bits array<long>")
    found = nearest.nearest(candidates.selectExpr("candidate AS query", "bits"), candidates, 5, 2, 32, rival=True).collect()
    for q, (best, days, total) in brute([(i, b) for i, _, b in rows], rows, 5).items():
        mine = [r for r in found if r["query"] == q]
        assert [(r.distance, r.candidate, r.day) for r in sorted((r for r in mine if r.place), key=lambda r: r.place)] == best
        assert [(r.distance, r.candidate) for r in sorted((r for r in mine if r.day_place), key=lambda r: r.day_place)] == days
        assert {r.compared for r in mine} == {total}
    assert not [p for p in plans if "Broadcast" in p]


def test_probes_that_meet_many_are_left_to_blocks(spark, monkeypatch):
    """Words that many candidates share: the probes are few, the candidates that they meet are most of all."""
    plans = []
    keep = nearest.written
    monkeypatch.setattr(nearest, "written", lambda df, name: (name == "pairs" and plans.append(df._jdf.queryExecution().executedPlan().toString())) or keep(df, name))
    rng = random.Random(7)
    rows = [(i, "abc"[i % 3], [rng.getrandbits(4)]) for i in range(700)]
    candidates = spark.createDataFrame(rows, "candidate long, day string, bits array<long>")
    queries = [(i, b) for i, _, b in rows if i % 100 == 0]
    found = nearest.nearest(spark.createDataFrame(queries, "query long, bits array<long>"), candidates, 300, 1, 4, rival=True).collect()
    for q, (best, _, _) in brute(queries, rows, 300).items():
        assert [(r.distance, r.candidate, r.day) for r in sorted((r for r in found if r["query"] == q and r.place), key=lambda r: r.place)] == best
    assert len(plans) == 2 and "FlatMapCoGroupsInArrow" in plans[1]


def test_margin_decide_broadcasts_nothing(spark, monkeypatch):
    """Neither the search nor the decision collects a table on the driver."""
    from tidemark.queries import grouping

    plans = []
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    keep = nearest.written
    monkeypatch.setattr(nearest, "written", lambda df, name: plan(df) or keep(df, name))
    found = grouping.margin_decide(spark, "/root/testdata/sf0.001")
    assert found.count() == 10
    plan(found)
    assert len(plans) > 4 and not [p for p in plans if "Broadcast" in p]
