import pytest

from corpusloom.llm.disclosure import find_personal, folded, sanitise, sanitised, scan, spoken_digits, valid_identity

NAMES = frozenset(["deniz", "yağmur", "elif", "kerem", "bahar"])


def kinds(text):
    return sorted({s[0] for s in scan(text, NAMES)[0]})


@pytest.mark.parametrize(
    "text,want",
    [
        ("bana ayca_ulver77@mektup.test yazın", ["email"]),
        ("ayca-ulver @ mektup.test olur", ["email"]),
        ("ayca＠mektup.test", ["email"]),
        ("adresim elif alt çizgi tan80 et işareti hat nokta test olarak", ["email"]),
        ("bana levent-dere (et) hat.kutu nokta test yazın", ["email"]),
        ("esra_19 [at] hat [dot] kutu [dot] example", ["email"]),
        ("salonda (at) resmi ve (et) yemeği vardı", []),
        ("tanesi 2 adet @ 96 lira yazıyordu", []),
        ("kasaptan et ve yağmur alıp son nokta olarak bıraktık", []),
        ("beni 0 (597) 169 23 54 arayın", ["phone_number"]),
        ("+90 (523) 524-74-22", ["phone_number"]),
        ("90.521.405.63.43 yeterli", ["phone_number"]),
        ("299 938 26 78", ["phone_number"]),
        ("0 5 2 2 9 7 2 5 8 3 2", ["phone_number"]),
        ("sıfır beş yüz yirmi dört altı yüz yetmiş sekiz otuz sekiz kırk iki hattı", ["phone_number"]),
        ("telefonum sıfır iki dokuz dokuz iki beş sekiz beş beş beş sekiz", ["phone_number"]),
        ("barkod 8524375554489 okutuldu", []),
        ("10.11.2031 günü saat 16.44 ve 4.698,70 lira", []),
        ("kimlik 87250336554", ["identity_number"]),
        ("kimlik 813 095 033 24", ["identity_number"]),
        ("９１０８１９６０７３４ numaralı", ["identity_number"]),
        ("sekiz iki iki iki bir altı iki iki altı bir iki", ["identity_number"]),
        ("fatura 94183667718", []),
        ("Dolutepe Mahallesi Çatı Sokak No: 131 Daire: 19", ["street_address"]),
        ("evimiz masal sokak yirmi sekiz numara daire on iki üzerinde", ["street_address"]),
        ("MUM CADDESİ NO 164 KAT 4", ["street_address"]),
        ("Harita Caddesi 113/11 üzerinde", ["street_address"]),
        ("sokakta 55 eldiven vardı", []),
        ("bulvar boyunca 44 fırtına vardı", []),
        ("", []),
    ],
)
def test_forms(text, want):
    assert kinds(text) == want


def test_parts():
    assert spoken_digits("sıfır beş yüz yirmi dört altı yüz altmış on elli beş".split()) == "0524660" + "1055"
    assert valid_identity("87250336554") and not valid_identity("87250336555") and not valid_identity("07250336554")
    assert folded("Ａ​b") == ("Ab", [0, 2]) and folded("ab") == ("ab", None)
    text = "x a­@b.test y"
    assert sanitised("ara: 0597 412 58 96.", [("phone_number", 5, 19)]) == "ara: [PHONE]."
    assert sanitised(text, scan("x ab@c.test y", NAMES)[0]).startswith("x ")


def test_names(spark):
    sure = [f"Hesap sahibi {g} {s}, tamam." for g in ("Elif", "Kerem", "Deniz") for s in ("Ulvörmez", "Balıksoy", "Doruğlu", "Çelavan")]
    sure += [f"Görüşmeyi {g} {s} yaptı." for g in ("Bahar", "Yağmur") for s in ("Ulvörmez", "Balıksoy", "Doruğlu")]
    plain = [f"{a} {g} {w} hepimize iyi geldi" for a in ("dün", "bugün", "sonra") for g in ("yağmur", "bahar", "deniz") for w in ("sesi", "kokusu", "rengi", "ile", "sokakta")]
    ask = ["hesap sahibi elif ulvörmez, tamam", "görüşmeyi yağmur balıksoy yaptı", "HESAP SAHİBİ KEREM ÇELAVAN", "deniz.ulvörmez@hat.test yazdı", None, "", "Elif Ulvörmez " + "ses " * 20_000]
    rows = [(f"a{k}", t) for k, t in enumerate(sure)] + [(f"b{k}", t) for k, t in enumerate(plain)] + [(f"c{k}", t) for k, t in enumerate(ask)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + rows[:3]], "id string, text string, spans string, start int")
    names = spark.createDataFrame([(n,) for n in ("Deniz", "Yağmur", "Elif", "Kerem", "Bahar", None, "")], "given_name string")
    found = find_personal(df, names)
    got = {r.id: {s.type for s in r.spans} for r in found.found.collect()}
    assert {k for k, v in got.items() if "person_name" in v} == {f"a{k}" for k in range(len(sure))} | {"c0", "c1", "c2", "c6"}
    assert got["c3"] == {"email"}
    clean = {r.id: r.text for r in sanitise(df, names).collect()}
    assert clean["c0"] == "hesap sahibi [NAME], tamam" and clean["c4"] is None and clean["b0"] == plain[0] and clean["c3"] == "[EMAIL] yazdı"
    assert len(clean) == len(rows)
    assert find_personal(df.limit(0), names).found.count() == find_personal(df, names.limit(0)).found.where("exists(spans, s -> s.type = 'person_name')").count() == 0
