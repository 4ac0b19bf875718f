"""Queries over whole tables, on small tables with what the narrower ones leave out."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import joins, sampling
from corpusloom.queries import all_queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clips of every source, spelling and kind of session, in one folder of tables."""
    path = tmp_path_factory.mktemp("whole")
    spellings = ["sy-1", " SY-1", "sy_1", "ka-2", "unknown", None]
    sessions = ["s-2031-1", "S_2031-1", "s-2031-2", "unknown", "", None]
    rows = [
        (f"c{k:03}", ["haber-spiker", "Haber Spiker", "kitap-anlatim", "masal-kosesi"][k % 4], spellings[k % 6], sessions[k // 3 % 6], [2.5, 4.0, 7.0, 1.0, 13.0, None, float("nan")][k % 7], "x" * (k % 5 * 80), None, (f"c{k // 8 * 8:03}" if k % 3 else None,))
        for k in range(96)
    ]
    rows += rows[:9]
    names = "clip_id string, source_dataset string, speaker_id string, session_id string, duration_seconds double, normalized_transcript string, transcript string, metadata struct<parent_clip_id: string>"
    spark.createDataFrame(rows, names).write.parquet(f"{path}/clip_records.parquet")
    return str(path), {r[0]: r for r in rows}


def canonical(text):
    key = "".join(c for c in (text or "").lower() if c.isalnum())
    return None if key in ("", "unknown") else key


def test_theta_pairs_whole(spark, folder):
    path, clips = folder
    want = set()
    for t in clips.values():
        for r in clips.values():
            known = canonical(t[2]) and t[4] is not None and r[4] is not None
            if known and canonical(t[2]) == canonical(r[2]) and (t[7][0] or t[0]) != (r[7][0] or r[0]) and 2 <= r[4] <= 12 and t[4] + r[4] <= 12 and len(t[5]) + len(r[5]) + 1 <= 512:
                want.add((t[0], r[0]))
    got = [(x.target, x.reference) for x in all_queries()["theta_pairs"](spark, path).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert any(clips[t][3] != clips[r][3] and clips[t][2] != clips[r][2] for t, r in got)


def test_cross_parent_pairs_of_a_hot_speaker(spark):
    rows = [(f"i{k}", "hot", f"p{k % 7}", 1.0 + k % 3, 10) for k in range(1200)] + [("a", "few", None, 2.0, 300), ("b", "few", None, 2.0, 211), ("c", "few", "a", 2.0, 1)]
    got = joins.cross_parent_pairs(spark.createDataFrame(rows, "i string, s string, p string, d double, n int"), "s", "p", "i", "d", "n", 2.0, 3.0, 4.0, 512)
    want = {(t[0], r[0]) for t in rows for r in rows if t[1] == r[1] and (t[2] or t[0]) != (r[2] or r[0]) and r[3] >= 2 and t[3] + r[3] <= 4 and t[4] + r[4] + 1 <= 512}
    out = [(x.target, x.reference) for x in got.collect()]
    assert len(out) == len(want) and set(out) == want and ("a", "b") in want and ("a", "c") not in want


def test_theta_pairs_of_a_clip_in_two_spellings(spark, tmp_path):
    rows = [("a", "SY-1", 3.0, "x", (None,)), ("a", "sy_1", 3.0, "x", (None,)), ("a", "sy_1", 3.0, "x", ("a",)), ("b", "sy-1", 4.0, "y", (None,))]
    names = "clip_id string, speaker_id string, duration_seconds double, transcript string, metadata struct<parent_clip_id: string>"
    spark.createDataFrame(rows, names).withColumn("normalized_transcript", F.lit("")).write.parquet(f"{tmp_path}/clip_records.parquet")
    got = all_queries()["theta_pairs"](spark, str(tmp_path))
    assert sorted((x.target, x.reference) for x in got.collect()) == [("a", "b"), ("b", "a")]


def test_pairs_of_a_hot_speaker_take_few_bits_each(spark, tmp_path):
    n = 2000
    key = F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 24)
    rows = spark.range(n).select(key.alias("i"), F.lit("hot").alias("s"), key.alias("p"), (2 + F.pmod(F.xxhash64("id"), F.lit(300)) / 100).alias("d"), F.lit(10).alias("n"))
    joins.cross_parent_pairs(rows, "s", "p", "i", "d", "n", 2.0, 12.0, 12.0, 512).write.parquet(f"{tmp_path}/pairs")
    assert spark.read.parquet(f"{tmp_path}/pairs").distinct().count() == n * (n - 1)
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.8 * n * n


def outputs_of_join(plan):
    """Rows that the merge join of a plan that ran has given."""
    name = plan.getClass().getSimpleName()
    if name == "SortMergeJoinExec":
        return plan.metrics().apply("numOutputRows").value()
    below = [plan.executedPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if name.endswith("QueryStageExec") else [plan.children().apply(k) for k in range(plan.children().size())]
    return sum(outputs_of_join(x) for x in below)


def test_pairs_of_a_hot_speaker_come_without_those_of_a_whole_block(spark):
    rows = spark.range(4000).select(F.col("id").cast("string").alias("i"), F.lit("hot").alias("s"), F.col("id").cast("string").alias("p"), F.lit(3.0).alias("d"), F.lit(10).alias("n"))
    run = joins.cross_parent_pairs(rows, "s", "p", "i", "d", "n", 2.0, 12.0, 12.0, 512)._jdf.queryExecution()
    assert run.toRdd().toJavaRDD().take(1).size() == 1
    assert 1 <= outputs_of_join(run.executedPlan()) <= 64


def test_pairs_of_a_speaker_in_many_tiles_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(joins, "BLOCK", 4)
    monkeypatch.setattr(joins, "TILE", 24)
    draw = random.Random(5)
    rows = [(f"i{k}" if k % 50 else None, draw.choice(["hot", "hot", "hot", "few", None]), draw.choice([None, "p1", "p2", f"i{k // 2}"]), draw.choice([0.5, 1.0, 2.0, 3.3, 6.0, 8.7, 10.0, 11.0, float("nan"), None]), draw.choice([1, 200, 255, 256, 400])) for k in range(400)]
    got = joins.cross_parent_pairs(spark.createDataFrame(rows, "i string, s string, p string, d double, n int"), "s", "p", "i", "d", "n", 2.0, 12.0, 12.0, 512).collect()
    known = [r for r in rows if r[0] and r[1] and r[3] is not None]
    want = {(t[0], r[0]) for t in known for r in known if t[1] == r[1] and (t[2] or t[0]) != (r[2] or r[0]) and t[0] != r[0] and 2 <= r[3] <= 12 and t[3] + r[3] <= 12 and t[4] + r[4] + 1 <= 512}
    assert len(got) == len(want) > 1000 and {(x.target, x.reference) for x in got} == want


def test_ratings_whole(spark, tmp_path):
    events = [(k, k * 7 % 90) for k in range(9000)]
    spark.createDataFrame(events, "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    last = {}
    for k, user in events:
        last[user, k % 30 + 1] = k
    catches = {u: sum(t % 10 == 0 and k % 7 != 3 for (v, t), k in last.items() if v == u) for u in range(90)}
    kept = {(u, t): k for (u, t), k in last.items() if catches[u] <= 1 and t % 10}
    score = {x: (3 - k % 7 if x[1] % 3 == 0 else k % 7 - 3) for x, k in kept.items()}
    report = {(r.level, r.name): r for r in all_queries()["ratings_score"](spark, str(tmp_path)).collect()}
    assert report["all", "*"].n == len(score) > 0 and max(u for u, _ in kept) >= 40 and max(t for _, t in kept) > 25
    assert report["all", "*"].mean == pytest.approx(sum(score.values()) / len(score), abs=1e-6)
    for n in range(4):
        mine = [s for (_, t), s in score.items() if t % 4 == n]
        assert ("category", f"c{n}") not in report if not mine else report["category", f"c{n}"].mean == pytest.approx(sum(mine) / len(mine), abs=1e-6)
    assert all_queries()["ratings_verdict"](spark, str(tmp_path)).first().pooled == report["all", "*"].mean


def test_siblings_and_ranks_whole(spark, folder):
    path, clips = folder
    run = lambda name: all_queries()[name](spark, path).collect()
    others = {i: {j for j, y in clips.items() if j != i and canonical(x[3]) and canonical(y[3]) == canonical(x[3])} for i, x in clips.items()}
    drawn = {i: [] for i in clips}
    for r in run("per_row_sample"):
        drawn[r.target].append(r.choice)
    assert all(len(set(d)) == len(d) == min(2, len(others[i])) and set(d) <= others[i] for i, d in drawn.items())
    assert len({clips[i][1] for i, d in drawn.items() if d}) == 4 and any(clips[i][3] != clips[j][3] for i, d in drawn.items() for j in d)
    fit = {i: sorted((abs(clips[j][4] - 8), j) for j in o if clips[j][4] is not None and 2 <= clips[j][4] <= 12) for i, o in others.items()}
    want = {(i, f[0][1] if f else None, not f) for i, f in fit.items()}
    got = [tuple(r) for r in run("paired_references")]
    assert len(got) == len(clips) and set(got) == want
    assert {(r.clip_id, r.worker) for r in run("rank_strided")} == {(i, k % 8) for k, i in enumerate(sorted(clips))}
    assert [tuple(r) for r in sorted(run("speaker_vocabulary_query"))] == [(s, k) for k, s in enumerate(sorted({x[2] for x in clips.values() if x[2]}), 1)]
    spark.createDataFrame([("c001",), ("c002",), (None,)], "clip_id string").write.mode("overwrite").parquet(f"{path}/asr_results.parquet")
    assert {r.clip_id for r in run("pending_anti")} == set(clips) - {"c001", "c002"}


def test_drawn_siblings_are_even(spark):
    rows = [(f"i{k}", "big") for k in range(2000)] + [("a", "two"), ("b", "two"), ("c", "one"), ("d", None)]
    got = [tuple(r) for r in sampling.drawn_siblings(spark.createDataFrame(rows, "i string, g string"), "g", "i", 3, "7").collect()]
    assert len(got) == len(set(got)) == 6002 and all(t != c for t, c in got) and {x for x in got if len(x[0]) == 1} == {("a", "b"), ("b", "a")}
    assert 1850 < len({c for _, c in got}) < 1950  # 1 - e^-3 of them are drawn at least once


def batched(rows, budget, most):
    """(group, id, batch) by one walk; rows: group, id, size."""
    out, state = set(), {}
    for g, n, i in sorted(((g, n, i) for g, i, n in rows), key=lambda x: (x[0] or "", x[1], x[2])):
        total, count, batch = state.get(g, (0, 0, 0))
        if count and (total + n > budget or count >= most):
            total, count, batch = 0, 0, batch + 1
        state[g] = (total + n, count + 1, batch)
        out.add((g, i, batch))
    return out


def test_duration_batches_of_hot_groups(spark):
    draw = random.Random(5)
    rows = [(draw.choice(["hot", "hot", "hot", None, f"g{k % 40}"]), f"i{k:05}", draw.choice([0, 1, 3, 7, 12, draw.randrange(200)])) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, i string, n long")
    for block in (8, 50, 20_000):
        got = [tuple(r) for r in sampling.duration_batches(df, "g", "i", F.col("n"), 30, 8, block).collect()]
        assert len(got) == len(rows) and set(got) == batched(rows, 30, 8)


def test_sessions_whole(spark, folder):
    path, clips = folder
    size = lambda d: round(d * 1000) if d and d == d else 0
    got = [(r.session_id, r.clip_id, r.batch) for r in all_queries()["duration_batches"](spark, path).collect()]
    assert len(got) == len(clips) and set(got) == batched([(canonical(x[3]), i, size(x[4])) for i, x in clips.items()], 30_000, 8)
    near = {r.clip_id: r.sibling for r in all_queries()["nearest_sibling"](spark, path).collect()}
    fit = {i: [(abs(y[4] - 8), j) for j, y in clips.items() if j != i and canonical(x[3]) and canonical(y[3]) == canonical(x[3]) and y[4] is not None and 2 <= y[4] <= 12] for i, x in clips.items()}
    assert near == {i: min(f)[1] if f else None for i, f in fit.items()} and None in near.values()
