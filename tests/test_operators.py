import json
import math
import random
import struct
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import dedup, joins, listening, reports, sampling, select, splits
from corpusloom.plans.joins import bounded, hot_keys, salted_join
from corpusloom.sources import files
from corpusloom.streaming import incremental


def test_salted_join_equals_join(spark):
    left = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    right = spark.createDataFrame([(k, f"r{k}") for k in range(40)] + [(1, "again")], "k long, w string")
    hot = hot_keys(left.groupBy("k").count(), "k", "count", share=0.1, least=10)
    assert [r.k for r in hot.collect()] == [1]
    for how in ("inner", "left"):
        a = salted_join(left, right, "k", hot, F.xxhash64("v"), how, 7).select("k", "v", "w")
        b = left.join(right, "k", how).select("k", "v", "w")
        assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0
    assert bounded(right, 41) and not bounded(right, 40)


def test_greedy_is_no_prefix_sum(spark):
    df = spark.createDataFrame([("g", f"r{k}", n, k) for k, n in enumerate([5, 7, 4, 2])] + [("g", "big", 99, 9), ("h", None, 1, 0)], "g string, i string, n int, o int")
    kept = {(r.g, r.i) for r in sampling.greedy_cap(df, "g", "i", F.col("n"), [F.col("o")], 11).collect()}
    assert kept == {("g", "r0"), ("g", "r2"), ("g", "r3"), ("h", None)}


@pytest.mark.parametrize("bound", [3, 10_000])
def test_greedy_cap_equals_a_fold(spark, bound):
    draw = random.Random(4)
    rows = [(draw.choice(["hot", "hot", "hot", "b", "c", None]), f"r{k:03}", draw.choice([1, 2, 3, 5, 8, 13, 60, None]), draw.randrange(9)) for k in range(260)]
    df = spark.createDataFrame(rows, "g string, i string, n int, o int")
    want = set()
    for g in {r[0] for r in rows}:
        used = 0
        for _, i, n, _ in sorted((r for r in rows if r[0] == g), key=lambda r: (r[3], r[1])):
            if n is not None and used + n <= 50:
                used += n
                want.add((g, i))
    assert {tuple(r) for r in sampling.greedy_cap(df, "g", "i", F.col("n"), [F.col("o")], 50, bound).collect()} == want


def test_running_totals_ranks_and_holdouts(spark):
    rows = [("hot" if k % 3 else None, f"i{k:03}", k % 7) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, i string, n int")
    got = {r.i: r.run for r in sampling.running(df, "g", ["i"], "n").collect()}
    for g in ("hot", None):
        total = 0
        for _, i, n in sorted(r for r in rows if r[0] == g) if g else sorted((r for r in rows if r[0] is None), key=lambda r: r[1]):
            total += n
            assert got[i] == total
    held = splits.stratified_holdout(df, "g", "i", 0.1, "s").where("held").groupBy("g").count().collect()
    assert {(r.g, r["count"]) for r in held} == {("hot", 20), (None, 10)}
    batches = spark.createDataFrame([(f"r{k}", k // 2) for k in range(42)], "i string, batch int")  # 21 batches
    out = sampling.ranked_batches(batches, "batch", 8, "x").collect()
    per = {k: {(r.batch, r.step) for r in out if r.rank == k} for k in range(8)}
    assert all(len(v) == 2 for v in per.values()) and len({b for v in per.values() for b, _ in v}) == 16
    every = sampling.ranked_batches(batches, "batch", 8, "x", 1, drop_remainder=False)
    assert every.select("batch").distinct().count() == 21 and {(r.batch, r["rank"]) for r in every.collect()} != {(r.batch, r["rank"]) for r in out}


def test_batches(spark):
    df = spark.createDataFrame([("g", f"r{k}", 5) for k in range(6)], "g string, i string, n int")
    out = sampling.duration_batches(df, "g", "i", F.col("n"), 10, 8).collect()
    assert sorted(r.batch for r in out) == [0, 0, 1, 1, 2, 2]


def test_duplicates_and_order(spark):
    rows = [("b", "x"), ("a", "x"), ("c", None), ("d", None), ("e", "y")]
    for order in (rows, rows[::-1]):
        out = {r.clip_id: r.duplicate_of for r in dedup.mark_duplicates(spark.createDataFrame(order, "clip_id string, sha string"), "sha", ["clip_id"]).collect()}
        assert out == {"a": None, "b": "a", "c": None, "d": None, "e": None}
    last = dedup.last_wins(spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (2, 1, "only")], "t int, o int, v string"), ["t"], "o")
    assert {r.v for r in last.collect()} == {"new", "only"}


def test_splits(spark):
    df = spark.createDataFrame([("abc",), ("def",)], "s string").select(splits.hash_bucket(F.concat(F.lit("common-voice-split-v1:"), "s"), 10_000).alias("b"))
    assert df.first().b == 3491
    parents = spark.createDataFrame([(f"p{k}",) for k in range(8)], "p string")
    assert sorted(r.split for r in splits.ranked_split(parents, "p", 0.1, 0.1).collect()) == ["test"] + ["train"] * 6 + ["validation"]
    assert {r.split for r in splits.ranked_split(parents.limit(2), "p").collect()} == {"train"}
    bad = splits.crossing(spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "train"), (None, "test")], "k string, s string"), "k", "s").collect()
    assert [(r.value, r.splits) for r in bad] == [("a", ["test", "train"])]


def test_percentiles(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4)] + [("b", None)], "g string, v double")
    assert [r.nearest_rank for r in reports.nearest_rank(df, "v", 0.5, "g").collect()] == [3.0]
    assert df.agg(reports.linear_percentiles(F.col("v"), 0.5).alias("p")).first().p == [2.5]


def test_joins(spark):
    a = spark.createDataFrame([(1,), (2,), (2,)], "k int")
    b = spark.createDataFrame([(2,), (3,)], "k int")
    assert joins.strict_pairs(a, b, "k").first().asDict() == {"left_only": 1, "right_only": 1, "both": 1, "repeated": 1}
    with pytest.raises(ValueError):
        joins.same_schema_union(a, b.withColumn("x", F.lit(1)))
    c = spark.createDataFrame([("p", "a", 8.0), ("p", "b", 7.0), ("p", "c", 9.0), ("q", "d", 8.0), ("p", "e", 50.0)], "p string, i string, d double")
    out = {r.i: r.sibling for r in joins.nearest_sibling(c, "p", "i", "d", 8.0, 2.0, 12.0).collect()}
    assert out == {"a": "b", "b": "a", "c": "a", "d": None, "e": "a"}
    ring = joins.ring(spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), "k").collect()
    assert [(r.k, r.next_k) for r in ring] == [(1, 2), (2, 1)]


def test_selection(spark):
    df = spark.createDataFrame([("p", 0, 1.0), ("p", 1, 1.0), ("p", 2, 0.5)], "k string, run int, s double")
    assert [r.run for r in select.best_of(df, "k", F.col("s"), "run").collect()] == [0]
    chain = select.worst_chain(spark.range(10), "id", [("high", [F.col("id").desc()]), ("low", [F.col("id")]), ("next", [F.col("id").desc()])], 2).collect()
    assert [r.id for r in sorted(chain, key=lambda r: (r.list, r.rank))] == [9, 8, 0, 1, 7, 6]


def test_listening_test_by_hand(spark):
    # trials 1 and 2 compare systems (the candidate is B, then A), 3 and 4 have an anchor, 5 is a catch
    key = [(1, "ab", "gated"), (2, "ab", "plain"), (3, "anchored", "synth"), (4, "anchored", "plain"), (5, "catch", "plain"), (6, "catch", "plain")]
    kinds = [(1, "general"), (2, "long"), (3, "general"), (4, "long")]
    ratings = [("one", t, c, s) for t, c, s in ((1, 2, None), (2, -1, None), (3, -1, "E"), (4, 3, "H"), (5, 0, None), (6, 1, None))]
    ratings += [("two", t, c, s) for t, c, s in ((1, 3, None), (2, 3, None), (3, 3, "E"), (4, 3, "E"), (5, 1, None), (6, -1, None))]  # rated two catches
    rows = listening.oriented(spark.createDataFrame(ratings, "listener string, trial int, cmos int, same_person string"), spark.createDataFrame(key, "trial int, type string, B string"), spark.createDataFrame(kinds, "trial int, category string"))
    report = listening.listening_report(rows)
    got = {(r.level, r.name): (r.mean, r.half_interval, r.n) for r in report.collect()}
    # scores of listener one, towards the candidate: 2, 1, -1, -3
    assert got[("all", "*")] == (-0.25, round(1.96 * math.sqrt((5.0625 + 1.5625 + 0.5625 + 7.5625) / 3 / 4), 6), 4)
    assert got[("pool", "ab")][0] == 1.5 and got[("pool", "anchored")][0] == -2.0 and got[("same_person", "anchored")] == (0.5, None, 2)
    assert got[("category", "general")][0] == 0.5 and got[("category", "long")][0] == -1.0
    v = listening.verdict(report).first()
    assert not v.promote and v.worst_category == "long" and v.worst_mean == -1.0
    with pytest.raises(Exception, match="unknown trial"):
        listening.oriented(spark.createDataFrame([("one", 99, 0, "E")], "listener string, trial int, cmos int, same_person string"), spark.createDataFrame(key, "trial int, type string, B string"), spark.createDataFrame(kinds, "trial int, category string")).collect()


def test_manifest_round_trip(spark, tmp_path):
    rec = {"clip_id": "a", "source_dataset": "s", "source_version": "1", "audio_path": "/x/a.wav", "license_id": "l", "duration_seconds": 1.5, "metadata": {"k": "v"}}
    path = tmp_path / "m.jsonl"
    path.write_text(json.dumps(rec) + "\n\n" + json.dumps(rec | {"clip_id": "b"}) + "\n")
    df = files.read_manifest(spark, str(path))
    assert {r.clip_id: r.metadata for r in df.collect()} == {"a": {"k": "v"}, "b": {"k": "v"}}
    assert files.write_lines(df.select("clip_id", "duration_seconds"), str(tmp_path / "out"), ["clip_id"]) == 2
    path.write_text(json.dumps(rec | {"extra": 1}) + "\n{broken\n" + json.dumps(rec | {"clip_id": " "}) + "\n" + json.dumps(rec) + "\n")
    with pytest.raises(Exception, match="bad record"):
        files.read_manifest(spark, str(path)).collect()
    assert files.read_manifest(spark, str(path), strict=False).where("_bad is null").count() == 1


def test_table_file_and_values(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("client_id\tpath\tsentence\tup_votes\nc1\tp.mp3\t Merhaba \t\nc2\tq.ogg\tiki\t3\n")
    df = files.read_table_file(spark, str(tmp_path / "t.tsv"), ("client_id", "path", "sentence"))
    out = df.select("sentence", files.optional_int(F.col("up_votes")).alias("v"), files.audio_suffix(F.col("path")).alias("x")).collect()
    assert [tuple(r) for r in out] == [("Merhaba", None, ".mp3"), ("iki", 3, ".ogg")]
    with pytest.raises(ValueError, match="lacks"):
        files.read_table_file(spark, str(tmp_path / "t.tsv"), ("client_id", "nothing"))


def test_waves(spark, tmp_path):
    data = b"\0\0" * 16000
    head = b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16000, 32000, 2, 16) + b"data" + struct.pack("<I", len(data))
    (tmp_path / "a.wav").write_bytes(head + data)
    (tmp_path / "b.wav").write_bytes(b"no wave")
    out = {Path(r.path).name: (r.channels, r.sample_rate_hz, r.duration_seconds, r.error) for r in files.probe_waves(spark, str(tmp_path)).collect()}
    assert out == {"a.wav": (1, 16000, 1.0, None), "b.wav": (None, None, None, "audio_decode_failed")}


def test_resume(spark, tmp_path):
    seen = []

    def step(df):
        seen.append(df.count())
        return df.withColumn("text", F.concat(F.lit("t"), "clip_id"))

    rows = spark.createDataFrame([(f"c{k}",) for k in range(5)], "clip_id string")
    incremental.resume(rows.limit(3), str(tmp_path / "ck"), "clip_id", step)
    out = incremental.resume(rows, str(tmp_path / "ck"), "clip_id", step)
    assert sorted(r.text for r in out.collect()) == [f"tc{k}" for k in range(5)] and seen == [3, 2]


def test_streams(spark, tmp_path):
    src, dst = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (["a", "b"], ["b", "c"]):
        spark.createDataFrame([(x,) for x in part], "clip_id string").coalesce(1).write.mode("append").parquet(src)
        q = incremental.resume_stream(spark, src, "clip_id string", dst, str(tmp_path / "ck"), lambda d: d.withColumn("n", F.length("clip_id")), "clip_id")
        q.awaitTermination(120)
    assert sorted(r.clip_id for r in spark.read.parquet(dst).collect()) == ["a", "b", "c"]


def test_guard_stream_equals_batch(spark, tmp_path):
    rows = [("m", k, v) for k, v in enumerate([5.0, 4.0, 4.9, 5.0, 3.9, 9.0])]
    src = str(tmp_path / "in")
    for half in (rows[:3], rows[3:]):
        spark.createDataFrame(half, "name string, step long, value double").coalesce(1).write.mode("append").parquet(src)
        q = incremental.guard_stream(spark.readStream.schema("name string, step long, value double").parquet(src)).writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(180)
    stream = sorted((r.step, r.streak) for r in spark.read.parquet(str(tmp_path / "o")).collect())
    batch = incremental.degradation_streaks(spark.createDataFrame(rows, "name string, step long, value double"), "name", "step", "value", 1.1)
    assert stream == sorted((r.step, r.streak) for r in batch.collect()) == [(0, 0), (1, 0), (2, 1), (3, 2), (4, 0), (5, 1)]
