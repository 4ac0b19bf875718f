import random
from collections import defaultdict

import pytest

from corpusloom.llm.components import components
from corpusloom.llm import splitting
from corpusloom.llm.splitting import assign_splits, balance_splits, difference_bins, related_groups


def brute(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, p, e in rows:
        for node in ([("p", p)] if p else []) + ([("e", e)] if e else []):
            parent[find(("i", i))] = find(node)
    groups = defaultdict(set)
    for i, p, e in rows:
        groups[find(("i", i))].add((i, p))
    return {i: (min(x for x, _ in g), len({p for _, p in g if p})) for g in groups.values() for i, _ in g}


def test_groups_match_union_find(spark):
    draw = random.Random(4)
    rows = [(f"c{k:03}", draw.choice([None, *[f"p{j}" for j in range(60)]]), draw.choice([None, *[f"e{j}" for j in range(70)]])) for k in range(150)]
    rows += [(f"z{k:02}", f"q{k}", f"f{k // 2}") for k in range(30)] + [(f"y{k:02}", f"q{k}", f"f{(k + 1) // 2}") for k in range(30)]  # a long chain
    dirty = {None: [None, "", "N/A", "-", "unknown"]}
    df = spark.createDataFrame([(i, draw.choice(dirty[None]) if p is None else p.upper(), draw.choice(dirty[None]) if e is None else " " + e, 1) for i, p, e in rows + rows[:9]], "clip_id string, speaker_id string, session_id string, root int")
    got = {r.id: (r.group_id, r.speakers) for r in related_groups(df).records.collect()}
    assert got == brute(rows)
    split = {r.clip_id: (r.group_id, r.split) for r in assign_splits(df, {"train": 0.6, "validation": 0.2, "test": 0.2}, bins=10).collect()}
    assert set(split) == set(got) and len({g for g, _ in split.values()}) == len(set(split.values()))


def test_empty_and_lonely(spark):
    df = spark.createDataFrame([("a", None, None), ("b", "", "-")], "clip_id string, speaker_id string, session_id string")
    assert {(r.id, r.group_id, r.speakers) for r in related_groups(df).records.collect()} == {("a", "a", 0), ("b", "b", 0)}
    assert related_groups(df.limit(0)).records.count() == 0 and assign_splits(df.limit(0)).count() == 0
    nameless = spark.createDataFrame([(None, "p", "e"), (None, None, "e")], "clip_id string, speaker_id string, session_id string")
    assert {r.group_id for r in related_groups(nameless).records.collect()} == {None}


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(f"{k:03}", f"{k + 1:03}") for k in range(200)] + [("x", "x"), (None, "y")], "a string, b string")
    assert {r.root for r in components(edges).collect()} == {"000"}


def test_differencing():
    draw = random.Random(2)
    for n, bins in ((0, 3), (2, 5), (200, 7), (1000, 100)):
        weights = [draw.randrange(1, 50) for _ in range(n)]
        parts = difference_bins(weights, bins)
        assert len(parts) == bins and sorted(k for p in parts for k in p) == list(range(n))
        if n >= 200:
            sums = [sum(weights[k] for k in p) for p in parts]
            assert max(sums) - min(sums) <= 5


@pytest.mark.parametrize("shard", [60, 200, 5000])
def test_balance(spark, monkeypatch, shard):
    draw = random.Random(5)
    rows = [(f"g{k}", draw.randrange(1, 30)) for k in range(800)] + [("huge", 900)]
    monkeypatch.setattr(splitting, "FAN", 3)
    out = balance_splits(spark.createDataFrame(rows, "group_id string, records int"), {"train": 0.8, "validation": 0.1, "test": 0.1}, shard=shard).collect()
    sums = defaultdict(int)
    for r in out:
        sums[r.split] += r.weight
    total = sum(w for _, w in rows)
    assert sum(sums.values()) == total and len(out) == len(rows)
    assert all(abs(sums[s] / total - f) < 0.012 for s, f in (("train", 0.8), ("validation", 0.1), ("test", 0.1)))
