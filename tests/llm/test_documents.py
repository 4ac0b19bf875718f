import random
from random import Random

import pytest

from corpusloom.llm.leakage import leaked_prompts, tokens
from corpusloom.llm.packing import best_fit, crossed, encoder, evolve, mutated, pack, packing_report, tightened
from corpusloom.llm.stuffing import find_stuffed, passages


def test_packing_is_whole_and_tight(spark):
    draw = random.Random(3)
    words = "ses kayıt mikrofon oda metin konuşma sabah akşam dinleme not".split()
    rows = [(k, " ".join(draw.choice(words) for _ in range(draw.randrange(1, 90)))) for k in range(300)]
    rows += [(900, " ".join(words * 90)), (901, None), (902, ""), (903, "a"), (903, "a")]
    df = spark.createDataFrame([(*r, 7, "k") for r in rows], "doc_id long, text string, size int, key string")
    out = pack(df, capacity=256, block=100).collect()
    fill, parts = {}, {}
    for r in out:
        parts.setdefault(r.doc_id, []).append(r)
        if r.container is not None:
            fill[r.container] = fill.get(r.container, 0) + r.tokens
    assert max(fill.values()) <= 256 and set(parts) == {r[0] for r in rows}
    count = encoder("/opt/tokenizers/byte_bpe_multi_50k.tiktoken").encode_ordinary
    for k, t in rows[:301]:
        n = len(count(t))
        assert sum(p.tokens for p in parts[k]) == n
        assert len(parts[k]) == 1 or n > 256
    assert [p.container for p in parts[901] + parts[902]] == [None, None] and len(parts[903]) == 2
    assert sum(fill.values()) / (len(fill) * 256) > 0.97
    assert packing_report(spark.createDataFrame(out), 256).first().containers == len(fill)
    assert pack(df.limit(0)).count() == 0 and packing_report(pack(df.limit(0))).first().fill == 1.0


def triplets(seed, n=20, capacity=1000):
    """3 n items that fill n bins exactly, three to a bin."""
    draw, sizes = Random(seed), []
    for _ in range(n):
        a = draw.randrange(380, 490)
        b = draw.randrange(250, (capacity - a) // 2 + 1)
        sizes += [a, b, capacity - a - b]
    draw.shuffle(sizes)
    return [(s, k) for k, s in enumerate(sizes)]


def test_evolution_needs_fewer_containers_than_best_fit():
    fewer = 0
    for seed in range(4):
        items = triplets(seed)
        start = best_fit(sorted(items, reverse=True), 1000)
        end = evolve(items, 1000, 1, population=10, generations=60)
        assert sorted(i for b in end for _, i in b[1]) == list(range(60)) and all(b[0] == 1000 - sum(s for s, _ in b[1]) >= 0 for b in end)
        assert 20 <= len(end) <= len(start)
        fewer += len(start) - len(end)
    assert fewer >= 6
    assert evolve([], 100, 0) == []


def test_crossover_and_exchange_keep_all_items():
    draw = Random(6)
    items = [(draw.randrange(20, 70), k) for k in range(200)]
    a, b = best_fit(sorted(items, reverse=True), 100), best_fit(sorted(items), 100)
    for bins in (crossed(a, b, 100, draw), mutated(a, 100, draw)):
        assert sorted(i for x in bins for _, i in x[1]) == list(range(200)) and all(x[0] == 100 - sum(s for s, _ in x[1]) >= 0 for x in bins)
    bins = [[10, [(50, 0), (40, 1)]]]
    assert tightened(bins, [(49, 2), (5, 3)], 100, draw) == [(5, 3), (40, 1)] and bins[0][0] == 1


def test_packing_does_not_depend_on_partitions(spark):
    rows = [(k % 70, "ses kayıt " * (k % 23 + 1)) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = (sorted(map(tuple, pack(df.repartition(n), capacity=128, block=60).collect()), key=str) for n in (1, 7))
    assert one == two


def longest(doc, prompt):
    """Words of the longest run of a prompt in a document, by brute force."""
    a, best = tokens(doc), 0
    words = [tokens(w) for w in prompt.split()]
    for i in range(len(words)):
        for j in range(len(words), i + best, -1):
            run = [t for w in words[i:j] for t in w]
            if any(a[k : k + len(run)] == run for k in range(len(a) - len(run) + 1)):
                best = max(best, j - i)
                break
    return best


def test_leaks(spark):
    draw = random.Random(9)
    words = "deniz kenarında güneşli bir sabah çocuklar ıslak kumda büyük kaleler yaptı ve annelerine şarkı söyledi sonra hep birlikte öğle yemeği için İstanbul yoluna çıktılar".split()
    prompts = [(f"p{k}", " ".join(draw.sample(words, draw.randrange(8, 16)))) for k in range(12)] + [("null", None), ("empty", ""), ("num", "Toplam 12 kg elma ve 7 adet kavun 45 lira tuttu bugün pazarda")]
    docs = []
    for k in range(60):
        p = draw.choice(prompts[:12])[1].split()
        a = draw.randrange(0, len(p))
        cut = p[a : a + draw.randrange(3, 14)]
        body = " ".join(["Başka", "sözler,", *cut, "devam", "etti."])
        docs.append((k, draw.choice([body, body.upper(), body.replace("ş", "s").replace("ı", "i"), body.replace(" ", "  \n"), "<p>" + body.replace(" ", " <b>", 1) + "</b></p>", body.replace("e", "е", 2), body.replace("a", "a​", 1)])))
    docs += [(100, None), (101, ""), (102, "x " * 30_000 + prompts[0][1] + " y" * 10), (103, "Toplam 99 kg elma ve 3 adet kavun 80 lira tuttu bugün pazarda"), (0, docs[0][1])]
    d = spark.createDataFrame([(*r, "clash") for r in docs], "doc_id long, text string, id string")
    q = spark.createDataFrame([(*r, 1) for r in prompts], "id string, text string, doc_id int")
    names = spark.createDataFrame([("İstanbul",), (None,)], "given_name string")
    out = leaked_prompts(d, q, names)
    got = {(int(r.doc_id), r.id) for r in out.where("run_words >= 6 and 2 * run_words >= prompt_words").collect()}
    want = {(k, i) for k, t in docs if t for i, p in prompts if p and len(p.split()) >= 10 and longest(t, p) >= max(6, -(-len(p.split()) // 2))}
    assert got == want and len(want) > 10
    odd = {(int(r.doc_id), r.id, r.slots) for r in out.collect() if r.doc_id == "103"}
    assert odd == {(103, "num", "consistent")}
    assert {tuple(r) for r in leaked_prompts(d, q, names, block_bytes=300).collect()} == {tuple(r) for r in out.collect()}
    assert leaked_prompts(d.limit(0), q, names).count() == leaked_prompts(d, q.limit(0)).count() == 0


def test_names_in_templates_do_not_depend_on_other_prompts(spark):
    asked = [("a", "Dün akşam Ayşe pazardan üç kilo elma aldı ve eve kadar yürüdü")]
    more = [("b", "Sabah Mehmet limana indi, Kerem orada onu uzun uzun bekledi durdu")]
    docs = [(1, "dün akşam Kerem pazardan üç kilo elma aldı ve eve kadar yürüdü"), (2, "dün akşam Zibidos pazardan üç kilo elma aldı ve eve kadar yürüdü"), (3, "dün akşam 7 pazardan üç kilo elma sattı"), (4, "sabah Ali limana indi, Ali orada onu uzun uzun bekledi durdu"), (5, "sabah Ali limana indi, Can orada onu uzun uzun bekledi durdu")]
    d = spark.createDataFrame(docs, "doc_id int, text string")
    names = spark.createDataFrame([("Ayşe",), ("Mehmet",), ("Kerem",), ("Ali",)], "given_name string")
    one, two = ({(r.doc_id, r.id, r.template_words, r.slots) for r in leaked_prompts(d, spark.createDataFrame(q, "id string, text string"), names).collect()} for q in (asked, asked + more))
    assert one == {("1", "a", 12, "consistent"), ("2", "a", 12, "consistent")}
    assert two == one | {("4", "b", 11, "consistent"), ("5", "b", 11, "consistent")}


SENTENCES = ["Sabah erkenden ıslak kumda büyük kaleler yaptılar ve sonra eve döndüler.", "Bu akşam öğretmen yeni kitabı dikkatle okudu, çünkü sınav yakındı.", "Yağmur dinince çocuklar bahçede uzun uzun top oynadı.", "Kayıt biterken mikrofonu kapattı ve notlarını masaya bıraktı."]


def pages():
    draw = random.Random(2)
    text = lambda n: " ".join(draw.choice(SENTENCES) for _ in range(n))
    good = [("\n".join(text(3) for _ in range(4)), lang) for lang in ["tr"] * 150 + ["tur"] * 50 + ["en"] * 20 + [None] * 5]
    drill = "Okuma alıştırması.\n" + "\n".join(" ".join(draw.choice("bir iki üç dört beş yüz kırk elli".split()) for _ in range(14)) + "." for _ in range(10))
    words = "Söyleyiş listesi\n" + "\n".join(f"{w} → /{w}/, vurgu {n}. hecede" for n, w in enumerate("deniz kum kale sabah akşam kitap sınav bahçe kayıt masa".split()))
    lists = "Malzemeler\n" + "\n".join(f"- {n} tane {w}" for n, w in enumerate("elma armut kavun ceviz nane biber".split())) + "\n" + text(2)
    fair = [(drill, "tr"), (words, "tr"), (lists, "tr"), (text(8) + "\n" + "ucuz ses kartı, " * 6, "tr"), (None, "tr"), ("", None), ("...", "tr")]
    spam = ["ucuz seslendirme " * 40, "\n".join(f"{c} ses kartı" for c in "Bursa Konya Van Rize Ordu Sivas Muğla".split() * 3), "\n".join(f"https://kayit{n}.example/ses-{n}" for n in range(30)), " ".join(f"#{w}satınal" for w in "nane elma ses kart oda kum".split() * 5), " / ".join(f"Kablo TR-{n} siyah" for n in range(100, 130)), "Etiketler: " + ", ".join(["ses klonlama", "ceket indir", "şair ucuz", "havlu bedava"] * 9)]
    return good, fair, [(s, "tr") for s in spam] + [(SENTENCES[0] + "\n" + "mikrofon fiyatları " * 60, "tr")]


def test_stuffed_pages(spark):
    good, fair, spam = pages()
    rows = [(k, t, lang, 1.0) for k, (t, lang) in enumerate(good + fair + spam)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, f0 double")
    out = find_stuffed(df).documents
    assert {r.doc_id for r in out.where("stuffed").collect()} == set(range(len(good + fair), len(rows)))
    assert out.count() == len(rows)
    assert find_stuffed(df.limit(0)).documents.count() == 0
    assert find_stuffed(df.where("text is null or text = ''")).documents.where("stuffed or words > 0").count() == 0


@pytest.mark.parametrize("text,n", [("", 0), ("\n\n", 0), ("a b", 1), ("\n".join(["bir iki"] * 100), 5), ("kelime " * 400, 10)])
def test_passages_keep_all_words(text, n):
    parts = passages(text)
    assert len(parts) == n and sum(len(w) for _, w in parts) == len(text.split())
