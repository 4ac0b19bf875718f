import math

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import alignment, arrays, phonemes, spelling, text
from corpusloom.functions.identity import canonical_digest, canonical_id, canonical_split, micros
from corpusloom.operators import gates


def test_spelling():
    assert spelling.lower("IĞDIR İZMİR") == "ığdır izmir"
    assert spelling.comparable("İzmir'de saat 14.30.") == "izmir'de saat 14 30"
    assert spelling.scorable("3700") == "üç bin yedi yüz"
    assert spelling.scorable("1.499 lira") == "bin dört yüz doksan dokuz lira"
    assert spelling.scorable("%5,07") == "yüzde beş virgül sıfır yedi"
    assert spelling.spoken("₺1.275,50") == "bin iki yüz yetmiş beş lira elli kuruş"
    assert spelling.spoken("A4 kağıt") == "a dört kağıt"
    assert spelling.spoken("29.10.1923 günü saat 09:05") == "yirmi dokuz ekim bin dokuz yüz yirmi üç günü saat dokuz sıfır beş"
    assert spelling.spoken("Dr. Kaya 3. katta 2/5") == "doktor Kaya üçüncü katta iki beş"
    assert spelling.spoken("GPS ile 12345 km") == "ge pe se ile bir iki üç dört beş kilometre"
    assert spelling.alignable("IĞDIR'da QWX") == "ığdır da qwx"


@pytest.mark.parametrize("number,words", [(0, "sıfır"), (-7, "eksi yedi"), (1000, "bin"), (1100, "bin yüz"), (2001, "iki bin bir"), (10**6, "bir milyon"), (10**12, "bir trilyon"), (1_001_000, "bir milyon bin")])
def test_numbers(number, words):
    assert spelling.words_of(number) == words


@pytest.mark.parametrize("sentence", ["A4 ve 5G, %12,5 ile 1.250.000 TL!", "Saat 14:00 'te 3. gün ₺0,05", "TBMM 23.04.1920 2/3 kg", "", "düz metin"])
def test_spoken_form_is_stable(sentence):
    once = spelling.spoken(sentence)
    assert spelling.spoken(once) == once


def test_too_large():
    with pytest.raises(ValueError):
        spelling.words_of(10**15)


@pytest.mark.parametrize("word,symbols", [("kedi", "cedi"), ("dağ", "daː"), ("kalp", "kaɫp"), ("göl", "ɟœl"), ("Iğdır'da", "ɯːdɯɾda"), ("çiğ, şu", "tʃiː, ʃu"), ("taksi box", "taksi boks")])
def test_phonemes(word, symbols):
    assert phonemes.phonetic(word) == symbols


def test_identity(spark):
    rows = [("SY-1 İ", " Dev ", "SHA256:" + "AB" * 32, 1.5), ("ｓｙ_1ı", "TRAINING", "ab" * 32 + " ", float("nan")), ("n/A", "invalidated", "0" * 64, None), ("", None, "", -2.0)]
    df = spark.createDataFrame(rows, "i string, s string, d string, t double")
    out = df.select(canonical_id(F.col("i")), canonical_split(F.col("s")), canonical_digest(F.col("d")), micros(F.col("t"))).collect()
    assert [tuple(r) for r in out] == [("sy1i", "validation", "ab" * 32, 1_500_000), ("sy1i", "train", "ab" * 32, 0), (None, None, None, 0), (None, None, None, 0)]


def test_text_columns(spark):
    mail = "Bana ali@ornek.com.tr yaz, TR12 0001 0002 0003 0004 0005 06, 0532 123 45 67, kimlik 10000000146"
    df = spark.createDataFrame([(mail, "a b c d", "a x c d e"), ("", "", "a"), (None, None, None)], "t string, r string, h string")
    out = df.select(text.pii_categories(F.col("t")).alias("p"), text.word_error_rate(F.col("r"), F.col("h")).alias("w"), text.character_error_rate(F.col("r"), F.col("h")).alias("c")).collect()
    assert out[0].p == ["email", "iban", "phone_number", "turkish_identity_number"] and out[0].w == 0.5
    assert out[1].p == [] and out[1].w == 1.0 == out[1].c
    chunk = "Bir cümle burada. İkinci cümle, biraz daha uzun, virgüllü. " * 4
    parts = spark.createDataFrame([(chunk,), ("kısa",), ("kesilemezuzun" * 12,)], "t string").select(text.clause_chunks(F.col("t"), 90).alias("c")).collect()
    assert all(len(x) <= 90 for x in parts[0].c) and " ".join(parts[0].c) == " ".join(chunk.split())
    assert parts[1].c == ["kısa"] and parts[2].c == ["kesilemezuzun" * 12]


def test_alignment():
    assert alignment.align("a b c d".split(), "a c d e".split()) == [0, None, 1, 2]
    assert alignment.align(["x"], []) == [None] and alignment.align([], ["x"]) == []
    assert alignment.align("bir iki üç".split(), "bir bin üç".split()) == [0, 1, 2]
    tokens = alignment.word_tokens("İlk cümle bitti. İkinci, uzun olan sürüyor.")
    times = [(k * 2.0, k * 2.0 + 1.5) for k in range(len(tokens))]
    assert alignment.speech_chunks("İlk cümle bitti. İkinci, uzun olan sürüyor.", tokens, times, 3.0, 8.0) == [(0, 2), (3, 6)]


def test_word_timings(spark):
    letters = [("a", 0.0, 0.1, 0.5), ("b", 0.1, 0.2, 1.0), ("|", 0.2, 0.3, 1.0), ("|", 0.3, 0.4, 1.0), ("c", 0.4, 0.5, 0.25)]
    df = spark.createDataFrame([(letters,), ([],)], "t array<struct<grapheme:string,start:double,end:double,probability:double>>")
    out = df.select(alignment.word_timings(F.col("t")).alias("w")).collect()
    assert [tuple(w) for w in out[0].w] == [("ab", 0.0, 0.2, 0.75), ("c", 0.4, 0.5, 0.25)] and out[1].w == []


def test_arrays(spark):
    df = spark.createDataFrame([([0.0, 3.0, 4.0, 0.0],)], "x array<double>")
    r = df.select(arrays.norm(F.col("x")).alias("n"), arrays.percentile_of(F.col("x"), 0.5).alias("p"), arrays.signal_metrics(F.col("x"), 2).alias("m"), arrays.static_share(F.col("x"), 2).alias("s")).first()
    assert r.n == 5 and r.p == 1.5 and r.m.peak == 4 and r.m.clipping == 0.5 and r.s == 0
    assert math.isclose(r.m.rms_db, 20 * math.log10(2.5))


def test_gates(spark):
    df = spark.createDataFrame([(0.5, 3.0), (1.0, 6.0), (None, None)], "d double, s double")
    out = df.select(gates.clip_reasons(F.col("d"), F.col("s")).alias("c")).collect()
    assert [r.c for r in out] == [["duration_too_short", "low_estimated_snr"], [], ["duration_too_short"]]
    lists = spark.createDataFrame([(["b", "a"], None), (None, ["a"])], "x array<string>, y array<string>").select(gates.merged(F.col("x"), F.col("y")).alias("m"), gates.accepted(F.col("x")).alias("a"), gates.strictly_accepted(F.col("x")).alias("s")).collect()
    assert [tuple(r) for r in lists] == [(["a", "b"], False, False), (["a"], True, False)]
    with pytest.raises(Exception, match="wanted"):
        gates.require(df, F.col("d") > 0, "wanted").collect()
