import random
from collections import defaultdict

import pytest

from corpusloom.llm.capping import cap_contributors
from corpusloom.llm.mixing import bisect_exponent, entropy, mix_sources, plan_weights, tempered

CLIP = "clip_id string, speaker_id string, duration_seconds double, metadata struct<quality_score: double>, g string, order int, s string, b0 int"


def clips(spark, rows):
    return spark.createDataFrame([(*r[:3], (r[3],), "x", 1, "y", 2) for r in rows], CLIP)


def some(n=400, seed=3):
    draw = random.Random(seed)
    names = ["a-1", "A 1", "ａ-１", "b.2", "B2 ", "c", None, "", "N/A", "unknown"]
    weights = [30, 20, 5, 20, 5, 5, 5, 3, 3, 4]
    rows = []
    for k in range(n):
        q = draw.choice([None, float("nan"), 0.5, 0.5, round(draw.random(), 3)])
        d = draw.choice([None, float("nan"), 0.0, -1.0, round(draw.random() * 9, 3)])
        rows.append((f"c{k:04}", draw.choices(names, weights)[0], d, q))
    return rows + rows[:20]


@pytest.mark.parametrize("scale,limit", [(1.0, 100_000), (1e15, 100_000), (-3.0, 1)])
def test_the_best_are_kept_on_any_scale(spark, scale, limit):
    draw = random.Random(1)
    values = [scale * k for k in range(1, 21)] + [None, float("nan"), 0.0, -0.0, float("inf"), float("-inf")]
    draw.shuffle(values)
    rows = [(f"c{k:02}", "a", 1.0, q) for k, q in enumerate(values)]
    for cap in (5, 24) if limit > 1 else (5,):
        kept = {r.clip_id for r in cap_contributors(clips(spark, rows), max_count=cap, max_size=None, rank_limit=limit).kept.collect()}
        known = lambda q: float("-inf") if q is None or q != q else q
        order = sorted(rows, key=lambda r: (not (r[3] is None or r[3] != r[3]), known(r[3])), reverse=True)
        ties = {r[0] for r in rows if r[3] == 0.0} | {r[0] for r in rows if r[3] is None or r[3] != r[3]}
        assert len(kept) == cap and {r[0] for r in order[:cap]} - ties == kept - ties


@pytest.mark.parametrize("limit", [2, 100_000])
def test_caps_hold_and_the_best_stay(spark, limit):
    rows = some()
    out = cap_contributors(clips(spark, rows), max_count=25, max_size=60.0, rank_limit=limit)
    kept = {r.clip_id: r.contributor for r in out.kept.collect()}
    canon = {"a-1": "a1", "A 1": "a1", "ａ-１": "a1", "b.2": "b2", "B2 ": "b2", "c": "c"}
    groups = defaultdict(list)
    for i, sp, d, q in set(rows):
        good = -1.0 if q is None or q != q else q
        groups[canon.get(sp)].append((good, 0.0 if d is None or d != d or d < 0 else d, i))
    assert {i for _, _, i in groups.pop(None)} <= set(kept)
    for name, items in groups.items():
        mine = [x for x in items if x[2] in kept]
        assert len(mine) <= 25 and sum(x[1] for x in mine) <= 60.0
        lost = [x for x in items if x[2] not in kept]
        assert not lost or min(x[0] for x in mine) >= max(x[0] for x in lost)
        if lost:  # one more of the next best would pass a cap
            best = max(x[0] for x in lost)
            assert len(mine) == 25 or any(sum(x[1] for x in mine) + x[1] > 60.0 for x in lost if x[0] == best)
    over = {r.contributor for r in out.contributors.where("over_cap").collect()}
    assert over == {n for n, items in groups.items() if len(items) > 25 or sum(x[1] for x in items) > 60.0}
    spelled = {r.spelling for r in out.spellings.where("over_cap").collect()}
    assert spelled == {s for s, c in canon.items() if c in over}


def test_refined_and_direct_ranks_agree(spark):
    df = clips(spark, [(f"t{k}", "one", 1.0, 0.5) for k in range(300)])
    a, b = ({r.clip_id for r in cap_contributors(df, max_count=70, max_size=None, rank_limit=n).kept.collect()} for n in (1, 10**6))
    assert a == b and len(a) == 70


def test_share_empty_and_no_cap(spark):
    df = clips(spark, [(f"t{k}", "one" if k < 30 else f"s{k}", 1.0, k / 60) for k in range(60)])
    assert cap_contributors(df, max_count=None, max_size=None, max_share=0.2).kept.where("contributor = 'one'").count() == 12
    assert cap_contributors(df, max_count=None, max_size=None).kept.count() == 60
    empty = cap_contributors(df.limit(0))
    assert empty.kept.count() == empty.contributors.count() == empty.spellings.count() == 0


def test_weights():
    assert tempered([1, 3], [0.5, 0.5], 0) == pytest.approx([0.25, 0.75])
    assert tempered([1, 3], [0.5, 0.5], 1) == pytest.approx([0.5, 0.5])
    assert tempered([0, 3], [0.5, 0.5], 1) == [0.0, 1.0]
    assert bisect_exponent(lambda e: e <= 0.3) == pytest.approx(0.3)
    e, b, amounts = plan_weights([10, 100], [0.5, 0.5], [2, 1], None)
    assert (e, b) == (1.0, 40.0) and amounts == [20.0, 20.0]
    e, b, amounts = plan_weights([10, 100], [0.5, 0.5], [2, 1], 60)
    assert 0 < e < 1 and amounts[0] == pytest.approx(20) and sum(amounts) == pytest.approx(60)
    e, b, amounts = plan_weights([10, 20], [0.5, 0.5], [1, 1], 100)
    assert amounts == pytest.approx([10, 20])
    e, b, amounts = plan_weights([10, 1000], [0.02, 0.98], [9, 9], None, least_entropy=entropy([0.5, 0.5]) * 0.1)
    assert b > 0
    assert plan_weights([0, 0], [0.5, 0.5], [1, 1], None)[2] == [0.0, 0.0]


def test_mix(spark):
    draw = random.Random(1)
    rows = [(f"a{k}", draw.choice(["src-a", "SRC A"]), round(draw.random() * 5, 3)) for k in range(300)]
    rows += [(f"b{k}", "src_b", round(draw.random() * 5, 3)) for k in range(40)] + [("x", "other", 900.0), ("n", None, 50.0), ("z", "src-a", None), ("y", "src-b", float("nan"))]
    rows += rows[:15]
    df = spark.createDataFrame([(*r, "q") for r in rows], "clip_id string, source_dataset string, duration_seconds double, g string")
    targets = spark.createDataFrame([("src-a", 0.5, 1), ("src-b", 0.4, 3), ("src-c", 0.1, 2), (None, 0.3, 1)], "source_dataset string, target_share double, max_repeats int")
    mix = mix_sources(df, targets)
    rep = {r.source_dataset: r for r in mix.sources.collect()}
    assert set(rep) == {"src-a", "src-b", "src-c"} and rep["src-c"].mix_seconds == 0
    assert rep["src-a"].actual_share == pytest.approx(5 / 9, abs=0.01) and rep["src-b"].actual_share == pytest.approx(4 / 9, abs=0.01)
    used = mix.records.collect()
    assert max(r.uses for r in used if r.source_dataset == "src-b") <= 3 and max(r.uses for r in used if r.source_dataset == "src-a") == 1
    assert len({r.clip_id for r in used}) == len(used)
    short = {r.source_dataset for r in mix_sources(df, targets, budget="all").sources.where("short").collect()}
    total = sum({r[0]: r[2] for r in rows if r[2] and r[2] == r[2]}.values())
    own = {s: sum({r[0]: r[2] for r in rows if r[1] and r[1].lower().replace(" ", "-").replace("_", "-") == s and r[2] and r[2] == r[2]}.values()) for s in ("src-a", "src-b", "src-c")}
    assert short == {s for s, t, m in (("src-a", 0.5, 1), ("src-b", 0.4, 3), ("src-c", 0.1, 2)) if own[s] * m < t * total}
    warm = mix_sources(df, targets, budget="targets")
    shares = {r.source_dataset: r for r in warm.sources.collect()}
    e = shares["src-a"].exponent
    weight = {s: own[s] ** (1 - e) * t**e for s, t in (("src-a", 0.5), ("src-b", 0.4))}
    assert 0 < e < 1 and all(shares[s].actual_share == pytest.approx(weight[s] / sum(weight.values()), abs=0.01) for s in weight)
    most = max(shares[s].mix_seconds / (own[s] * m) for s, m in (("src-a", 1), ("src-b", 3)))
    assert most == pytest.approx(1, abs=0.01) and sum(r.mix_seconds for r in shares.values()) == pytest.approx(sum(own.values()), rel=0.01)
    assert all(r.uses <= (1 if r.source_dataset == "src-a" else 3) for r in warm.records.collect())
    fine = {r.clip_id for r in mix_sources(df, targets, rank_limit=1).records.collect()}
    assert fine == {r.clip_id for r in used}
    assert mix_sources(df.limit(0), targets).records.count() == 0
    assert mix_sources(df, targets.limit(0)).sources.count() == 0
