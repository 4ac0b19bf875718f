import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from corpusloom.llm.lookalikes import consistent_forms, same_looking_pairs
from corpusloom.llm.minhash import band_keys, may_be_near, profiles
from corpusloom.llm.overlap import cross_split_overlap, overlap_report


def test_forms_and_pairs(spark):
    same = ["Şeker köyü geldi.", "Şeker köyü geldi.".replace("Ş", "S̨".replace("̨", "̧")), "Ş­eker köyü​ geldi.", "Şeker köyü geldi.", " Şeker köyü  geldi.", "Şeker köyü gеldi.", "Şеkеr köyü geldi.", "Ｓ̧ｅｋｅｒ köyü geldi．"]
    apart = ["şeker köyü geldi.", "Seker köyü geldi.", "Şeker koyu geldi.", "Şeker köyü geldı.", "Şeker köyü geldi!", "молоко geldi", "moloko geldi", "x² oldu", "x2 oldu", "“a” b", '"a" b']
    texts = [*same, *apart, "", "​", None, same[0], "y" * 50_000 + "​", "y" * 50_000]
    rows = [(f"k{n:02}", t, "clash", 1) for n, t in enumerate(texts)] + [("k00", same[0], "clash", 1)]
    df = spark.createDataFrame(rows, "id string, text string, form string, token int")
    out = consistent_forms(df)
    form = {r.key: r.form for r in out.forms.collect()}
    assert {form[f"k{n:02}"] for n in range(len(same))} == {"Şeker köyü geldi."}
    assert len({form[f"k{len(same) + n:02}"] for n in range(len(apart))}) == len(apart)
    assert out.forms.count() == len(rows)
    want = {(a, b) for (a, x), (b, y) in combinations([(f"k{n:02}", t) for n, t in enumerate(texts)], 2) if x and y and x != y and form[a] and form[a] == form[b]}
    got = {(r.id_a, r.id_b) for r in same_looking_pairs(out.forms).collect()}
    assert got == want and ("k23", "k24") in want
    assert same_looking_pairs(consistent_forms(df.limit(0)).forms).count() == 0


def test_repairs_are_words_of_the_corpus(spark):
    rows = [("a", "Vаzıvü geldi"), ("b", "Vаzıvüѕ oldu"), ("c", "Kоruca durdu"), ("d", "Kοruca durdu"), ("e", "KORUCA"), ("f", "аlt о kаdar"), ("g", "o Alt, kadar")]
    form = {r.key: r.form for r in consistent_forms(spark.createDataFrame(rows, "id string, text string")).forms.collect()}
    assert form["a"] == "Vаzıvü geldi"  # nowhere written in Latin
    assert form["c"] == form["d"] == "Koruca durdu"  # known in another case
    assert form["f"] == "alt o kadar"  # a wholly Cyrillic letter in a Latin text


def test_dominant_script(spark):
    rows = [("a", "молоко тут"), ("b", "молoко тут"), ("c", "καλος!"), ("d", "καλoς!"), ("e", "дрoва"), ("f", "moloko"), ("i", "мοлοко"), ("j", "жfжж")]
    form = {r.key: r.form for r in consistent_forms(spark.createDataFrame(rows, "id string, text string")).forms.collect()}
    assert form["a"] == form["b"] == "молоко тут" and form["c"] == form["d"] == "καλος!" and form["i"] == "молоко"
    assert form["e"] == "дрoва" and form["f"] == "moloko" and form["j"] == "жfжж"  # known nowhere, true Latin, and no look-alike


def test_true_words_of_other_scripts_stay(spark):
    rows = [("a", "Где сор и сок рос"), ("b", "cop, poc ve cok"), ("c", "Рост сна, сон и нос."), ("d", "το νερο και ο τονος"), ("e", "o, to, nepo, tovoc"), ("f", "«сок» dedi"), ("g", "Toc poc ce ho, coh")]
    form = {r.key: r.form for r in consistent_forms(spark.createDataFrame(rows, "id string, text string")).forms.collect()}
    assert all(form[k] == t for k, t in rows if k in "abcdeg")


def test_hot_forms_pair_by_texts_not_by_rows(spark):
    rows = [(f"k{n:05}", "tek cümle") for n in range(3000)] + [("z1", "tek\u200b cümle"), ("z2", "tek\u200b cümle")]
    forms = consistent_forms(spark.createDataFrame(rows, "id string, text string")).forms
    assert same_looking_pairs(forms).count() == 6000


def test_ligatures(spark):
    same = [("haﬁfçe", "hafifçe"), ("kuﬂa", "kufla"), ("oﬃs", "ofis".replace("f", "ff")), ("eﬀaﬄ", "effaffl"), ("baﬅ", "baſt"), ("poﬆa", "posta"), ("ĳs", "ijs"), ("ǆep", "džep"), ("Ⅳ. bölüm", "IV. bölüm"), ("ﻻ", "لا")]
    apart = ["x²", "x2", "½", "1⁄2", "ª", "a", "№", "No", "½ ﬁ²", "½ fi2"]
    rows = [(f"s{n}{side}", t) for n, pair in enumerate(same) for side, t in zip("ab", pair)] + [(f"t{n}", t) for n, t in enumerate(apart)]
    forms = consistent_forms(spark.createDataFrame(rows, "id string, text string")).forms
    form = {r.key: r.form for r in forms.collect()}
    assert all(form[f"s{n}a"] == form[f"s{n}b"] == b for n, (_, b) in enumerate(same))
    assert len({form[f"t{n}"] for n in range(len(apart))}) == len(apart)
    assert {(r.id_a, r.id_b) for r in same_looking_pairs(forms).collect()} == {(f"s{n}a", f"s{n}b") for n in range(len(same))}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_overlap_matches_brute_force(spark):
    draw = random.Random(8)
    letters = "abcdefghıijklmnoöprsştuüvyz "
    base = ["".join(draw.choice(letters) for _ in range(draw.randrange(32, 110))).strip().ljust(31, "x") for _ in range(60)]
    rows = []
    for k, t in enumerate(base):
        rows.append((f"t{k}", draw.choice(["train", "TRAINING", "Train "]), t, f"{k:064x}"))
        for j in range(3):
            s = list(t)
            for _ in range(draw.randrange(0, max(1, len(t) // 14))):
                s[draw.randrange(len(s))] = draw.choice(letters)
            rows.append((f"e{k}{j}", draw.choice(["dev", "test", "Validation", "other"]), "".join(s).upper().replace("İ", "İ") if j == 9 else "".join(s) + "!", None))
    rows += [("h1", "train", "kısa", "SHA256:" + "ab" * 32), ("h2", "test", None, "AB" * 32 + " "), ("h3", "test", "", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"), ("h4", "train", "", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"), ("h5", None, base[0], None), (None, "test", base[0], None)]
    df = spark.createDataFrame([(*r[:2], "src", *r[2:], 1) for r in rows + rows[:7]], "clip_id string, source_split string, source_dataset string, normalized_transcript string, sha256 string, side int")
    out = cross_split_overlap(df)
    got = {(r.id_a, r.id_b) for r in out.pairs.collect()}
    plain = lambda t: " ".join("".join(c for c in t.lower() if c not in "!").split())
    train = [(i, plain(t)) for i, s, t, _ in rows if i and s and s.strip().lower().startswith("train") and t and len(plain(t)) >= 30]
    held = [(i, plain(t)) for i, s, t, _ in rows if i and s in ("dev", "test", "Validation") and t and len(plain(t)) >= 30]
    want = {tuple(sorted((a, b))) for a, x in train for b, y in held if abs(len(x) - len(y)) <= 11 and edits(x, y) * 10 <= max(len(x), len(y))} | {("h1", "h2")}
    assert not got - want and len(want - got) <= 0.02 * len(want)
    report = {(r.held_split, r.held_source): (r.pairs, r.held_records, r.train_records) for r in overlap_report(out).collect()}
    spelled = out.pairs.collect()
    assert report == {(s, "src"): (len(x), len({r.held_id for r in x}), len({r.train_id for r in x})) for s in ("validation", "test") if (x := [r for r in spelled if r.held_split == s])}
    near = cross_split_overlap(df, least_jaccard=0.8)
    assert near.pairs.count() > 0
    none = cross_split_overlap(df.limit(0))
    assert none.pairs.count() == 0 and overlap_report(none).count() == 0


def edited(draw, text, mode):
    """text with exactly a tenth of its characters edited."""
    letters, out, count = "abcçdefgğhıijklmnoöprsştuüvyz ", list(text), len(text) // 10
    spots = [int((j + 0.5) * len(text) / count) for j in range(count)] if mode == "spread" else draw.sample(range(len(text)), count)
    if mode != "mixed":
        for p in spots:
            out[p] = draw.choice([c for c in letters if c != out[p]])
        return "".join(out)
    for _ in range(count):
        p = draw.randrange(len(out))
        if (kind := draw.randrange(3)) == 0:
            out[p] = draw.choice(letters)
        elif kind == 1:
            del out[p]
        else:
            out.insert(p, draw.choice(letters))
    return "".join(out)


@pytest.mark.parametrize("mode", ["spread", "random", "mixed"])
@pytest.mark.parametrize("length", [30, 60, 100, 150])
def test_recall_at_the_limit_of_edits(mode, length):
    draw = random.Random(length)
    texts = ["".join(draw.choices("abcçdefgğhıijklmnoöprsştuüvyz ", k=length)) for _ in range(1200)]
    found = [set(), set()]
    for k, (side, reach) in enumerate(((texts, 0.1), ([edited(draw, t, mode) for t in texts], 0.0))):
        found[k] = set(zip(*(x.tolist() for x in band_keys(side, reach))))
    assert len({i for i, _ in found[0] & found[1]}) >= 0.99 * len(texts)


def test_profiles_never_rule_out_a_near_text(spark):
    draw = random.Random(2)
    texts = ["".join(draw.choices("aeiknrlıdtmy ", k=draw.randrange(30, 700))) for _ in range(300)]
    near = [edited(draw, t, "mixed") for t in texts]
    a, b = profiles(texts).tolist(), profiles(near).tolist()
    rows = [(*x, *y, True) for x, y in zip(a, b)] + [(*x, *y, False) for x, y in zip(a, b[1:])]
    out = spark.createDataFrame(rows, "a0 long, a1 long, b0 long, b1 long, near boolean")
    out = out.withColumn("kept", may_be_near((F.col("a0"), F.col("a1")), (F.col("b0"), F.col("b1")), 0.112)).collect()
    assert all(r.kept for r in out if r.near) and sum(r.kept for r in out if not r.near) < 200


def test_band_keys():
    at, keys = band_keys(["abc", "", "aynı metin burada", "aynı metin burada", "bambaşka bir şey", "u" * 500], 0.0, 4, 8, 2)
    keys = keys.reshape(6, 8)
    assert at.tolist() == [k for k in range(6) for _ in range(8)] and (keys[2] == keys[3]).all() and not (keys[2] == keys[4]).any()
    at, again = band_keys(["aynı metin burada", "u" * 500], 0.1, 4, 8, 2)
    assert (again[:8] == keys[2]).all() and set(keys[5].tolist()) < set(again[at == 1].tolist())
