"""Gates on evidence, contracts, data sets, models and signals, on small rows with known answers."""

import json

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import phonemes, signal, spelling
from corpusloom.models import stages
from corpusloom.models.protocols import Finding, Recognition, TimedWord, Transcript
from corpusloom.operators import evidence, joins
from corpusloom.plans import datasets, scripted, synthesis
from corpusloom.queries import all_queries
from corpusloom.sources import files, suites
from corpusloom.streaming import incremental


def test_signal_gate_codes_and_limits(spark):
    rows = [(0.5, 2, -60.0, 0.5, 0.1, 1.0), (1.0, 1, -45.0, 0.01, 0.25, 6.0), (20.5, 1, -20.0, 0.0, 1.0, 9.0), (None,) * 6]
    df = spark.createDataFrame(rows, "d double, c int, l double, k double, a double, s double")
    out = [r.x for r in df.select(evidence.signal_gate(*map(F.col, "dclkas")).alias("x")).collect()]
    assert out[0] == ["duration_too_short", "not_mono", "level_too_low", "excessive_clipping", "insufficient_active_audio", "low_estimated_snr"]
    assert out[1] == [] and out[2] == ["duration_too_long"] and out[3] == []
    assert df.select(evidence.audited(F.array(F.lit("x")), F.lit("OSError")).alias("x")).first().x == ["audio_decode_failed"]


def test_agreement_gate(spark):
    limits = evidence.LabelLimits(0.8, 0.2, 5.0, 25.0, 0.6, 0.1, 0.1)
    rows = [("merhaba dünya", "merhaba dünya", 0.9, 1.0, 0.9, 0.0, 0.0), ("merhaba", "", 0.1, 10.0, None, None, None), ("bir iki", "üç beş yedi", 0.9, 1.0, 0.1, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "a string, b string, c double, d double, p double, l double, t double")
    out = [r.x for r in df.select(evidence.agreement_gate(*map(F.col, "abcdplt"), limits).alias("x")).collect()]
    assert out[0] == []
    assert out[1] == ["ctc_empty", "ctc_low_confidence", "dual_asr_disagreement", "implausible_transcript_rate", "forced_alignment_failed"]
    assert out[2] == ["dual_asr_disagreement", "low_alignment_probability", "speech_before_transcript", "speech_after_transcript"]
    table = spark.createDataFrame([tuple(vars(limits).values())], list(vars(limits)))
    joined = df.crossJoin(F.broadcast(table))
    assert [r.x for r in joined.select(evidence.agreement_gate(*map(F.col, "abcdplt"), {n: F.col(n) for n in vars(limits)}).alias("x")).collect()] == out


def test_metadata_and_redaction(spark):
    kind = "id string, transcript string, reasons array<string>, metadata struct<q:double,ctc:struct<text:string,confidence:double>>"
    df = spark.createDataFrame([("a", "metin", ["z", "b"], (1.0, ("metin", 0.5))), ("b", "öteki", None, (2.0, None))], kind)
    out = {r.id: r for r in evidence.with_evidence(df, F.array(F.lit("a"), F.lit("b")), "gate", "v2", acoustics=F.struct(F.lit(1).alias("rms"))).collect()}
    assert out["a"].reasons == ["a", "b", "z"] and out["a"].metadata.quality_stage == "gate" and out["a"].metadata.acoustics.rms == 1 and out["a"].metadata.q == 1.0
    assert evidence.with_evidence(df, F.array(F.lit("n"), F.lit("n")), "gate", "v2", overwrite=True).first().reasons == ["n"]
    red = {r.id: r for r in evidence.redacted(df, F.col("id") == "a", ["transcript"], inner={"ctc": ["text"]}).collect()}
    assert red["a"].transcript is None and red["a"].metadata.ctc.text is None and red["a"].metadata.ctc.confidence == 0.5
    assert red["b"].transcript == "öteki" and red["b"].metadata.ctc is None


def test_trainable_rows(spark):
    kind = "text array<string>, duration double, reference_audio_path string, reference_text string, reference_duration double"
    rows = [(list("abc"), 2.0, None, None, None), ([], 2.0, None, None, None), (list("abc"), 50.0, None, None, None), (list("ab"), 2.0, "r.wav", "de", 3.0), (list("ab"), 9.0, "r.wav", "de", 3.0), (list("abcdefgh"), 2.0, "r.wav", "de", 3.0)]
    out = evidence.trainable(spark.createDataFrame(rows, kind), 10.0, 10, 4.0).collect()
    assert [(r.text, r.reference_text) for r in out] == [("abc", None), ("ab", "de")]
    with pytest.raises(Exception, match="together"):
        evidence.trainable(spark.createDataFrame([(["a"], 1.0, "r.wav", None, None)], kind), 10.0, 10, 4.0).collect()


CLIP = "clip_id string, source_dataset string, source_split string, audio_path string, transcript string, speaker_id string, rights_state string, license_id string, duration_seconds double, metadata struct<parent_clip_id:string,voice:boolean>"


def records(spark, *more):
    rows = [(f"c{k}", "cv" if k % 2 else "vd", ["train", "validation", "test"][k % 3], f"{k}.wav", f"metin {k}", None if k == 4 else f"s{k}", "allowed", "l", 3600.0, (f"p{k}", k % 2 == 0)) for k in range(9)]
    return spark.createDataFrame([*rows, *more], CLIP)


def test_data_sets(spark):
    prompts = spark.createDataFrame([("q1", "METİN 3!"), ("q2", "başka")], "id string, text string")
    f = datasets.foundation(records(spark), "vd", prompts=prompts)
    assert {r.clip_id for r in f.manifest.collect()} == {"c1", "c3", "c5", "c7"}
    assert {(r.fault, r.value) for r in f.faults.collect()} == {("contaminated", "q1")}
    assert sum(r.hours for r in f.report.collect()) == 4.0
    crossing = ("c9", "cv", "test", "", "metin 9", "s9", "denied", None, None, ("p1", None))
    bad = datasets.foundation(records(spark, crossing), "vd").faults.collect()
    assert {(r.fault, r.value) for r in bad} == {("parent", "p1"), ("no_training_rights", "c9"), ("no_licence", "c9"), ("no_duration", "c9"), ("no_audio", "c9")}
    t = datasets.target_voice(records(spark), F.col("metadata.voice"), "target")
    assert {r.clip_id for r in t.manifest.collect()} == {"c0", "c2", "c4", "c6", "c8"} and {r.speaker for r in t.manifest.collect()} == {"target"}
    a = datasets.adaptation(records(spark), "vd", spark.createDataFrame([("p0", "test"), ("p2", "validation")], "parent string, split string"))
    got = {r.clip_id: (r.split, r.speaker) for r in a.manifest.collect()}
    assert got["c0"] == ("test", "s0") and got["c2"][0] == "validation" and got["c4"][1] == "vd-unknown"
    with pytest.raises(Exception, match="lacks rights"):
        evidence.usable_records(records(spark).withColumn("reasons", F.array(F.lit("x"))), "cv", []).collect()


def test_references_and_candidates(spark):
    rows = spark.createDataFrame([(f"c{k}", "s" if k < 8 else "t", f"p{k // 2}", 3.0, 5) for k in range(10)] + [("lone", "u", "p", 3.0, 5)], "i string, s string, p string, d double, n int")
    out = datasets.cross_parent_references(rows, "s", "p", "i", "d", "n", 2, "x", 0.1).collect()
    drawn = [r for r in out if not r.replay]
    assert len(drawn) == 16 and all(int(r.clip[1:]) // 2 != int(r.reference[1:]) // 2 for r in drawn)
    assert len([r for r in out if r.replay]) == 2 and {r.clip for r in out if r.replay} <= {"c8", "c9", "lone"}
    samples = spark.createDataFrame([("a", 0, 1.0, 0.0), ("a", 1, 1.5, 0.2), ("b", 0, 2.0, 0.0), ("b", 1, 2.0, 0.0)], "id string, run int, raw double, pen double")
    best, summary = datasets.best_candidates(samples, "id", "run", F.col("raw"), [F.col("pen")])
    assert {(r.id, r.run) for r in best.collect()} == {("a", 1), ("b", 0)} and summary.first().n == 2
    with pytest.raises(ValueError, match="every run"):
        datasets.best_candidates(samples.limit(3), "id", "run", F.col("raw"), [])
    prompts = spark.createDataFrame([(f"q{k}", "x") for k in range(5)], "id string, category string")
    cer = spark.createDataFrame([(f"q{k}", k / 10) for k in range(5)], "id string, cer double")
    g = datasets.gallery(prompts, cer, cer, cer.unionByName(cer.withColumn("cer", F.lit(0.9))), 2, 2).collect()
    assert {(r.id, r.list) for r in g} == {("q0", "best"), ("q1", "best"), ("q4", "worst"), ("q3", "worst")} and {r.most_cer for r in g} == {0.9}


def test_conditioned_vectors(spark):
    rows = spark.createDataFrame([(f"c{k}", f"s{k % 2}") for k in range(40)] + [("none", "s0")], "clip_id string, speaker string")
    f = spark.createDataFrame([(f"c{k}", [float(k), 5.0]) for k in range(40)], "clip_id string, v array<double>")
    out = datasets.conditioned(rows, f, "speaker", "clip_id", "v", 0.1, "x").collect()
    fit = [r.v for r in out if not r.held]
    assert len(out) == 40 and len(fit) == 36 and abs(np.mean([v[0] for v in fit])) < 1e-9 and abs(np.std([v[0] for v in fit]) - 1) < 1e-9 and {v[1] for v in fit} == {0.0}
    with pytest.raises(Exception, match="finite"):
        evidence.finite_vectors(spark.createDataFrame([([float("inf")],)], "v array<double>"), "v").collect()


def test_models_fail_row_by_row(spark):
    def transcriber():
        def run(rows):
            if any(r["clip_id"] == "bad" for r in rows):
                raise RuntimeError
            return [Transcript(r["clip_id"].upper(), "tr", 0.9, 1.0) for r in rows]

        return run

    df = spark.createDataFrame([("a", []), ("bad", []), ("c", ["x"]), ("d", None)], "clip_id string, reasons array<string>").coalesce(1)
    out = {r.clip_id: r for r in stages.transcribed(df, transcriber, ["clip_id"], size=3).collect()}
    assert out["a"].text == "A" and out["a"].model_error is None and out["d"].text == "D"
    assert out["bad"].reasons == ["asr_failed"] and out["bad"].model_error == "RuntimeError" and out["c"].text is None and out["c"].reasons == ["x"]
    short = stages.recognised(df.withColumn("t", F.lit("hedef")), lambda: lambda rows, targets: [Recognition("x", 0.5)], ["clip_id"], "t", size=2).collect()
    assert sorted((r.clip_id, r.model_error) for r in short) == [("a", "ValueError"), ("bad", "ValueError"), ("c", None), ("d", None)]
    vectors = stages.embedded(df, lambda: lambda rows: [[3.0, 4.0]] * len(rows), ["clip_id"]).first().embedding
    assert vectors == [0.6, 0.8]
    words = stages.timed_words(df, lambda: lambda path: [TimedWord(path, 0.0, 1.0, 0.5)], "clip_id").where("clip_id = 'a'").first().words
    assert [tuple(w) for w in words] == [("a", 0.0, 1.0, 0.5)]
    texts = spark.createDataFrame([("1", "ara ali@ornek.com"), ("2", "Ankara sokağı"), ("3", "Ankara güzel"), ("4", None)], "id string, text string")
    found = {r.id: r.categories for r in stages.scanned(texts, "text", lambda: lambda t: [Finding("location", "ner"), Finding("person", "ner")]).collect()}
    assert found == {"1": ["email"], "2": ["location", "person"], "3": ["person"], "4": []}


def test_checkpoints(spark, tmp_path):
    rows = spark.createDataFrame([(f"c{k}", k) for k in range(4)], "clip_id string, n int")
    step = lambda df: df.select("clip_id", F.lit("m1").alias("model"), F.array().cast("array<string>").alias("reasons"), F.lit("asr").alias("quality_stage"))
    path = str(tmp_path / "ck")
    assert incremental.resume(rows.limit(2), path, "clip_id", step, incremental.of_model("m1", "model")).count() == 2
    done = incremental.resume(rows, path, "clip_id", step, incremental.of_model("m1", "model"))
    assert [r.clip_id for r in incremental.in_input_order(rows, done, "clip_id", "n").collect()] == ["c0", "c1", "c2", "c3"]
    with pytest.raises(ValueError, match="another model"):
        incremental.resume(rows, path, "clip_id", step, incremental.of_model("m2", "model"))
    with pytest.raises(ValueError, match="another model or stage"):
        incremental.resume(rows, path, "clip_id", step, incremental.of_stage("whisper_pseudolabel"))
    with pytest.raises(Exception, match="no result"):
        incremental.in_input_order(rows, done.limit(1), "clip_id", "n").collect()
    asked = spark.createDataFrame([("c0", "m1", "h0"), ("c1", "m1", "other")], "clip_id string, model string, sha string")
    cache = spark.createDataFrame([("c0", "m1", "h0", "t0"), ("c1", "m1", "h1", "t1")], "clip_id string, model string, sha string, text string")
    assert {(r.clip_id, r.text, r.hit) for r in incremental.cached(asked, cache, "clip_id", "model", "sha", ["text"]).collect()} == {("c0", "t0", True), ("c1", None, False)}
    made = []
    feature = lambda df: (made.append(1), df)[1]
    for print_ in ("f1", "f1", "f2"):
        assert incremental.feature_cache(rows, str(tmp_path / "fc"), print_, feature).count() == 4
    assert len(made) == 2


def test_signals(spark):
    rate = 16_000
    t = np.arange(rate * 2) / rate
    tone = (0.5 * np.sin(2 * np.pi * 440 * t)).astype(np.float32)
    quiet = np.concatenate([tone, np.zeros(rate, np.float32), tone[: rate // 2]])
    assert signal.fingerprint(tone, rate) == signal.fingerprint(tone * 0.5, rate) != signal.fingerprint(quiet, rate)
    spans = signal.speech_spans(quiet, rate)
    assert len(spans) == 2 and spans[0][0] == 0 and abs(spans[0][1] - rate * 2.1) < rate * 0.05
    bands = signal.timbre(tone, rate, [0, 300, 600, 8000])
    assert np.argmax(bands) == 1 and abs(sum(bands)) < 1e-6 and signal.timbre(tone * 0, rate, [0, 300]) is None
    assert len(signal.resampled(tone, rate, 8000)) == rate and signal.mono(np.ones((4, 2))).tolist() == [1.0] * 4
    mel = signal.log_mel(tone, rate)
    assert mel.shape == (len(tone) // 256 + 1, 100) and mel.min() >= np.log(1e-5) - 1e-9
    df = spark.createDataFrame([("p", quiet.tolist(), rate), ("q", (tone * 0).tolist(), rate)], "id string, x array<float>, hz int")
    got = signal.segments(df, "id", "x", "hz").collect()
    assert [(r.parent, r.segment) for r in got] == [("p", 0), ("p", 1)] and got[0].clip_id.startswith("p-seg-") and len(got[0].audio) == got[0].end - got[0].start
    again = signal.segments(df, "id", "x", "hz").collect()
    assert [r.clip_id for r in again] == [r.clip_id for r in got]
    row = df.select(signal.fingerprint_of("x", "hz").alias("f"), signal.timbre_of(F.col("x"), F.col("hz"), [0, 300, 600, 8000]).alias("t"), signal.pitch_features(F.col("x"), F.col("hz"), lambda: lambda x, hz: np.array([0.0, 100.0, 100.0, 0.0]) if np.abs(x).max() > 0 else np.zeros(4)).alias("p")).collect()
    assert row[0].f == signal.fingerprint(quiet, rate) and row[1].t is None and row[0].p == pytest.approx([np.log(100), 0.0, 0.5]) and row[1].p is None
    one = spark.createDataFrame([([1.0, 2.0, 3.0], [0.0, 0.0, 0.0], [1.0, 1.0, 1.0], {"a": [9.0]}, [-1.0, 5.0, -7.0, 5.0])], "f array<double>, m array<double>, d array<double>, p map<string,array<double>>, x array<double>")
    c = one.select(signal.envelope_penalty(F.col("f"), F.col("m"), F.col("d"), F.col("m"), F.col("d")).alias("e"), signal.smoothed(F.col("f"), 0.999).alias("s"), signal.resolved_style(F.col("p"), F.lit("zz"), F.col("m")).alias("r"), signal.largest_bands(F.col("x"), 3).alias("b"), signal.warped(F.lit(0.5), -1.0).alias("w")).first()
    assert c.e == pytest.approx(np.sqrt(14 / 3)) and c.r == [0.0] * 3 and c.b == [2, 1, 3] and c.w == pytest.approx(0.5 - (np.cos(np.pi / 4) - 0.5))
    ema, values = None, [1.0, 2.0, 3.0]
    for n, v in enumerate(values):
        d = min(0.999, (1 + n) / (10 + n))
        ema = v if ema is None else d * ema + (1 - d) * v
    assert c.s == pytest.approx(ema)


def test_suites(spark, tmp_path):
    lines = [{"id": "a", "category": "x", "text": "bir"}, {"id": "b", "category": "y", "text": "iki"}]
    path = tmp_path / "p.jsonl"
    path.write_text("\n".join(map(json.dumps, lines)))
    assert suites.read_prompts(spark, str(path), ("x", "y")).count() == 2
    with pytest.raises(ValueError, match="no prompt of z"):
        suites.read_prompts(spark, str(path), ("z",))
    path.write_text("\n".join(map(json.dumps, [*lines, lines[0]])))
    with pytest.raises(ValueError, match="repeated"):
        suites.read_prompts(spark, str(path))
    (tmp_path / "r.csv").write_text("trial,cmos,same_person\n1,2,e\n2,-3,H\n1,-1,h\n")
    assert {tuple(r) for r in suites.read_ratings(spark, str(tmp_path / "r.csv")).collect()} == {(1, -1, "H"), (2, -3, "H")}
    (tmp_path / "r.csv").write_text("trial,cmos,same_person\n1,9,E\n")
    with pytest.raises(Exception, match="bad rating"):
        suites.read_ratings(spark, str(tmp_path / "r.csv")).collect()
    plan = {"scenarios": [{"id": k, "target_seconds": s, "expect_success": ok} for k, s, ok in (("a", 5, True), ("b", 30, True), ("c", 90, True), ("d", 200, False))], "concurrency": {"scenario_id": "a", "levels": [1, 4]}}
    suites.write_json(plan, str(tmp_path / "plan.json"))
    assert suites.read_plan(str(tmp_path / "plan.json")) == plan
    suites.write_json(plan | {"concurrency": {"scenario_id": "d", "levels": [True]}}, str(tmp_path / "plan.json"))
    with pytest.raises(ValueError, match="must succeed; levels"):
        suites.read_plan(str(tmp_path / "plan.json"))
    suites.write_json({"feature_order": ["f"], "global_mean": [0.0], "presets": {"calm": {"prosody": [1.0]}}}, str(tmp_path / "s.json"))
    assert suites.read_presets(str(tmp_path / "s.json"), ("f",)) == {"": [0.0], "calm": [1.0]}
    with pytest.raises(ValueError, match="features differ"):
        suites.read_presets(str(tmp_path / "s.json"))
    with pytest.raises(ValueError, match="s.json: extra"):
        suites.read_json(str(tmp_path / "s.json"), ("feature_order", "global_mean", "presets", "extra"))
    (tmp_path / "one.json").write_text(json.dumps({"samples": [{"id": "a", "wave": "w"}]}))
    (tmp_path / "two.json").write_text(json.dumps({"samples": [{"id": "a", "cer": 0.5}]}))
    (tmp_path / "three.json").write_text(json.dumps({"samples": [{"id": "b", "cer": 0.5}]}))
    assert suites.read_reports(spark, str(tmp_path / "one.json"), str(tmp_path / "two.json")).first().cer == 0.5
    with pytest.raises(ValueError, match="ids differ"):
        suites.read_reports(spark, str(tmp_path / "one.json"), str(tmp_path / "three.json"))


def test_arrow_hub_blobs_and_views(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x", "y"], 1.5), ("b", None, None)], "id string, text array<string>, d double")
    suites.write_arrow(df, str(tmp_path / "arrow"))
    files = sorted(map(str, (tmp_path / "arrow").glob("*.arrow")))
    assert not list((tmp_path / "arrow").glob("*.part"))
    full = [f for f in files if pa.ipc.open_file(f).num_record_batches]
    assert {(r.id, tuple(r.text or ()), r.d) for r in suites.read_arrow(spark, full).collect()} == {("a", ("x", "y"), 1.5), ("b", (), None)}
    with pa.OSFile(str(tmp_path / "s.arrow"), "wb") as sink, pa.ipc.new_stream(sink, pa.schema([("k", pa.int64())])) as w:
        w.write_table(pa.table({"k": [1, 2]}))
    assert suites.read_arrow(spark, [str(tmp_path / "s.arrow")]).count() == 2
    for s, n in (("train", 3), ("validation", 1), ("test", 1)):
        spark.range(n).select("id", (F.col("id") * 16000).alias("num_samples"), F.lit(" metin ").alias("transcription")).write.parquet(str(tmp_path / "hub" / s))
    rows = suites.hub_records(suites.read_hub(spark, str(tmp_path / "hub")), F.col("id"), F.col("num_samples"), F.col("transcription")).collect()
    assert {(r.source_row_id, r.duration_seconds, r.transcript) for r in rows} == {("train:0", None, "metin"), ("train:1", 1.0, "metin"), ("train:2", 2.0, "metin"), ("validation:0", None, "metin"), ("test:0", None, "metin")}
    with pytest.raises(ValueError, match="unknown splits"):
        suites.read_hub(spark, str(tmp_path / "hub"), ("train", "dev"))
    blobs = spark.createDataFrame([("x/a.bin", bytearray(b"12")), ("b.bin", bytearray(b"3"))], "name string, content binary")
    for first in (True, False):
        assert {tuple(r) for r in suites.write_blobs(blobs, "name", "content", str(tmp_path / "blobs")).collect()} == {("x/a.bin", 2, first), ("b.bin", 1, first)}
    assert (tmp_path / "blobs" / "x" / "a.bin").read_bytes() == b"12" and not list((tmp_path / "blobs").rglob("*.part"))
    with pytest.raises(Exception, match="no content"):
        suites.write_blobs(spark.createDataFrame([("e", bytearray())], "name string, content binary"), "name", "content", str(tmp_path / "blobs")).collect()
    (tmp_path / "ref.jsonl").write_text("\n".join(map(json.dumps, [{"audio_filepath": "/a.wav", "text": "bir", "duration": 1.0}, {"clip_id": "c", "audio_path": "/b.wav", "transcript": "İki", "normalized_transcript": "iki", "duration_seconds": 2.0}])))
    refs = suites.read_references(spark, str(tmp_path / "ref.jsonl")).collect()
    assert [(r.audio_path, r.text, r.duration) for r in refs] == [("/a.wav", "bir", 1.0), ("/b.wav", "iki", 2.0)] and refs[1].clip_id == "c" and refs[0].clip_id.startswith("ref.jsonl-")
    rec = spark.createDataFrame([("c", "/x/y.wav", "s1", ("st", 7))], "clip_id string, audio_path string, speaker_id string, metadata struct<quality_stage:string,up_votes:int>")
    assert suites.public_view(rec).first().asDict() == {"clip_id": "c", "source_file": "y.wav", "quality_stage": "st"}
    fan = spark.createDataFrame([("a", [], "train"), ("b", ["x"], "train"), ("c", None, None)], "id string, reasons array<string>, split string")
    assert suites.write_fan_out(fan, str(tmp_path / "fan"), "reasons", "split") == {"accepted/train": 1, "rejected/train": 1, "accepted/none": 1}


def test_suites_of_a_synthesiser(spark):
    def factory():
        def run(text, seed):
            if "bozuk" in text:
                raise ValueError(text)
            t = np.arange(16_000 * len(text.split()))
            return np.sin(t / 20) * np.where(t % 16_000 < 11_000, 0.5, 0.001), text.lower(), 80  # a pause in every second

        return run

    asked = synthesis.suite(spark.createDataFrame([("a", "Bir iki"), ("b", "Bozuk bozuk")], "id string, text string"), 2)
    assert asked.count() == 4 and synthesis.suite(spark.createDataFrame([("a", "x"), ("b", "y")], "id string, text string"), 1, 1).first().id == "a"
    asked = asked.withColumns({"expect_success": F.col("id") == "a", "target_seconds": F.lit(2.0)})
    out = {(r.id, r.seed): r for r in synthesis.measured(synthesis.synthesised(asked, factory, 16_000), 0.2).collect()}
    assert {k: r.status for k, r in out.items()} == {("a", 0): "passed", ("a", 1): "passed", ("b", 0): "rejected", ("b", 1): "rejected"}
    a = out["a", 0]
    assert a.audio_seconds == 2.0 and a.duration_error == 0.0 and a.signal_stable and a.normalized_text == "bir iki" and a.real_time_factor > 0 and out["b", 0].error == "ValueError"
    levels = synthesis.level_summary(spark.createDataFrame([(1, 0.0, 1.0, 0.0, True), (1, 1.0, 1.0, 0.5, False)], "level int, started double, latency double, queued double, expectation_met boolean")).first()
    assert (levels.requests, levels.per_second, levels.failures, levels.service_p50, levels.queue_p50) == (2, 1.0, 1, 1.0, 0.25)


def test_scripted_recordings(spark):
    text = "İlk cümle burada bitti. İkinci cümle, biraz daha uzun sürüyor."
    said = "ilk cümle burada biti ikinci cümle biraz daha uzun sürüyor".split()
    words = [(w, k * 1.0, k + 0.9) for k, w in enumerate(said)]
    df = spark.createDataFrame([("p", text, words), ("none", text, []), ("null", None, None)], "id string, script string, words array<struct<text:string,start:double,end:double>>")
    out = scripted.with_script_reasons(scripted.scripted_segments(df, "id", "script", "words", 3.0, 8.0)).orderBy("segment").collect()
    assert [(r.parent, r.text, r.start, r.end, r.words, r.exact, r.reasons) for r in out] == [("p", "İlk cümle burada bitti.", 0.0, 3.9, 4, 3, []), ("p", "İkinci cümle, biraz daha uzun sürüyor.", 4.0, 9.9, 6, 6, [])]
    report = scripted.parent_reports(scripted.with_script_reasons(scripted.scripted_segments(df, "id", "script", "words", 3.0, 8.0))).first()
    assert (report.words, report.exact, report.ratio, report.accepted, report.accepted_seconds) == (10, 9, 0.9, 2, 9.8)


def test_small_ones(spark, tmp_path):
    assert phonemes.inventory() == sorted(set(phonemes.inventory())) and {"ɫ", "ɟ", "ː", "tʃ"} <= set(phonemes.inventory())
    assert spelling.spoken_in("tr", "3. gün") == "üçüncü gün" and {"ğ", " ", "?"} <= set(spelling.trainer_symbols()) and len(set(spelling.trainer_symbols())) == len(spelling.trainer_symbols())
    with pytest.raises(ValueError, match="no spoken form"):
        spelling.spoken_in("xx", "a")
    rows = spark.createDataFrame([("a", 1.0), ("b", 5.0), ("c", 9.0), (None, 5.0)], "k string, d double")
    assert {r.k for r in joins.unused(rows, spark.createDataFrame([("c",), (None,)], "k string"), "k", d=(2.0, 9.0)).collect()} == {"b", None}
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.txt").write_text("1")
    (tmp_path / "m" / "b.txt").write_text("22")
    files_, digest = files.provenance(spark, str(tmp_path / "m"))
    assert {(r.path, r.bytes) for r in files_.collect()} == {("a.txt", 1), ("b.txt", 2)} and len(digest) == 64 and digest == files.provenance(spark, str(tmp_path / "m"))[1]


def test_public_manifest_rounds_durations_as_its_sql(spark, tmp_path):
    values = [4.0712565, 64.2273915, 67.57625349999999, 2.5, -3.0000005, 1e303, float("inf"), float("nan"), None]
    rows = [(f"c{k}", v, f"a/{k}.wav", (1,)) for k, v in enumerate(values)]
    spark.createDataFrame(rows, "clip_id string, duration_seconds double, audio_path string, metadata struct<up_votes: int>").write.parquet(f"{tmp_path}/clip_records.parquet")
    got = {r.clip_id: r.duration_seconds for r in all_queries()["public_manifest"](spark, str(tmp_path)).collect()}
    want = dict(duckdb.sql(f"SELECT clip_id, round(duration_seconds, 6) FROM '{tmp_path}/clip_records.parquet/*.parquet'").fetchall())
    assert {k: repr(v) for k, v in got.items()} == {k: repr(v) for k, v in want.items()}
