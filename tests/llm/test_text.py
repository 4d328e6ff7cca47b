import random

import pytest
from pyspark.sql import functions as F

from newsloom.llm import boilerplate, encoding, language, pii, pii_train, residue, truncation

PROSE = ["Late on Monday, the vendor doubled the quota for batch scheduling, and the bill rose.", "In the second week, nobody could explain why the router slowed down.", "According to the changelog, a reviewer flagged many answers about tool calling."]


@pytest.fixture(scope="module")
def index():
    return residue.Index().weigh({"the": 900, "page": 300, "text": 200, "is": 900, "to": 900, "and": 900, "a": 900}, 1000)


def test_residue(index):
    for bad, kind in (("Hello {{ user.name }}, welcome.", "placeholder"), ("Text with %%TITLE%% inside.", "placeholder"), ("By [INSERT QUOTE HERE]", "placeholder"), ("Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "filler"), ("404 Not Found\nnginx", "error"), ("Please enable JavaScript to read this page.", "gate"), ("页面不存在\n您访问的内容可能已被删除。", "error")):
        assert index.judge(bad)[0] == kind, bad
    for good in (None, "", PROSE[0], "The template uses `{{ user }}` here.", "```\nx = '{{ y }}'\n```\n" + PROSE[1], "The crawler saw a 404 page in 61 visits and a “please enable JavaScript” notice in 20 more, which the authors removed by hand.", "x" * 100_000):
        assert index.judge(good) is None, good


def test_residue_table(spark):
    df = spark.createDataFrame([(1, "{{ x }}", "k"), (2, None, "k"), (3, PROSE[0], "k"), (1, "{{ x }}", "k")], "article_no long, body string, kind string")
    assert [r["article_no"] for r in residue.residue(df, "article_no", "body").collect()] == [1, 1]
    assert residue.residue(df.where("false"), "article_no", "body").count() == 0


def test_garbling_round_trip(spark):
    clean = ["Le modèle a été réentraîné après l’été — déjà vu.", "Für größere Prüfungen genügt die Übersetzung völlig."] * 4 + ["测试显示，日志分析的准确率提高了，但在更长的输入上优势有所缩小。"] * 6
    bad = {100: encoding.garble(clean[0], ("utf-8", "windows")), 101: encoding.garble(clean[1], ("utf-8", "cp437")), 102: encoding.garble(clean[-1], ("gbk", "latin-1")), 103: encoding.garble(clean[0], ("utf-8", "windows", "utf-8", "windows")), 104: "Le mod�le a chang�."}
    ok = {200: "The bug turned `é` into `Ã©` in code.", 201: "Scored 10×, ≥ 3σ, at ±7.3 °C – see §4 ¶2.", 202: None, 203: "", 204: "plain ascii"}
    df = spark.createDataFrame([(i, t, 0) for i, t in [*enumerate(clean), *bad.items(), *ok.items()]], "article_no long, body string, restored int")
    got = {r["article_no"]: r for r in encoding.restore(df, "article_no", "body").collect()}
    assert set(got) == set(bad)
    assert got[100]["restored"] == clean[0] and got[101]["restored"] == clean[1] and got[102]["restored"] == clean[-1] and not got[104]["complete"]
    assert encoding.restore(df.where("false"), "article_no", "body").count() == 0


SENTENCES = {
    "en": "The team measured a gain in chart reading, but the gap closed on longer inputs. Nobody outside has repeated the result so far.",
    "de": "Das Ergebnis wurde bisher von niemandem außerhalb der Gruppe überprüft. Die Leitung hat das Budget für die Prüfung gekürzt.",
    "fr": "Après deux semaines, les opérateurs ont remplacé le modèle par un autre plus petit. Personne n’a encore reproduit ce résultat.",
    "es": "Los operadores sustituyeron el modelo por otro más pequeño, aunque todavía quedan muchas solicitudes abiertas en la lista.",
    "zh": "测试显示，日志分析的准确率有所提高，但在更长的输入上优势有所缩小。报告指出，大多数错误都与文档解析有关。",
}


def test_language(spark):
    train = spark.createDataFrame([(s, k) for k, s in SENTENCES.items()] + [(None, "en"), ("x", None)], "text string, lang string")
    profiles = language.train(train, "text", "lang")
    mixed = SENTENCES["en"] + "\n" + SENTENCES["fr"]
    df = spark.createDataFrame([(1, mixed), (2, SENTENCES["zh"]), (3, None), (4, ""), (5, "OK"), (6, "```\n" + SENTENCES["de"] + "\n```")], "n long, body string")
    seg = language.label_segments(df, ["n"], "body", profiles)
    got = {}
    for r in seg.collect():
        got.setdefault(r["n"], []).append(r["lang"])
    assert got == {1: ["en", "fr"], 2: ["zh"]}
    assert language.document_language(seg, ["n"]).where("n = 2").first()["lang"] == "zh"
    assert language.stated("en-US") == language.stated("ENG") == language.stated("English") == "en" and language.stated("und") is None and language.stated("zh_Hans") == "zh"
    assert df.select(language.stated_column(F.lit("pt-BR"))).first()[0] == "pt"


def page(r, k):
    body = [" ".join(r.choices(" ".join(PROSE).lower().replace(",", "").replace(".", "").split(), k=14)).capitalize() + "." for _ in range(2)]
    return "\n".join(["Home", "Search", "Jobs", "We use cookies to keep Site One running. Accept all or manage your choices.", *body, "Related reading", f"Acme opens Model {k} to partners without retraining", f"Can Model {k + 1} fix document parsing at a lower price", "© 2015 Site One. All rights reserved. Privacy · Terms"])


def test_boilerplate(spark):
    r = random.Random(7)
    rows = [(k, page(r, k), "one.test", "Site One", "T") for k in range(60)] + [(900, None, "one.test", "Site One", "T"), (901, "", None, None, None), (902, "# Own heading\n- own item\n" + PROSE[0], "two.test", None, None)]
    df = spark.createDataFrame(rows, "article_no long, body string, host string, site string, title string")
    got = {}
    for x in boilerplate.main_body(df, "article_no", "body", "host", "site", "title").collect():
        got.setdefault(x["article_no"], set()).add(x["line_no"])
    assert set(got) == set(range(60)) and all(v == {1, 2, 3, 4, 7, 8, 9, 10} for v in got.values())
    assert boilerplate.main_body(df.where("false"), "article_no", "body", "host", "site", "title").count() == 0


def test_wrappers_merge():
    a, b = boilerplate.Wrapper(), boilerplate.Wrapper()
    a.align([11, 12, 19], [3, 3, 3], [0, 0, 3], 3)
    b.align([11, 15, 19], [2, 2, 2], [0, 0, 2], 2)
    a.merge(b)
    assert a.pages == 5 and sorted(x[:2] for x in a.nodes) == [[11, 5], [12, 3], [15, 2], [19, 5]]
    assert a.heading() == {19} and -1 not in a.match([12, 19]) and a.match([19, 11]).count(-1) == 1


def varied(r):
    return " ".join(r.choices("vendor quota batch bill router week review answer tool model team score tests night early weights".split(), k=12)).capitalize() + "."


def test_lines_are_read_by_alignment(spark):
    notice = "Members of the club read every issue"
    r = random.Random(5)
    rows = [(k, f"{notice}\n{varied(r)}\nCopyright of the house\n{varied(r)}") for k in range(40)]
    # the same words where no other page of the host has them, at the end of the article's own text
    rows.append((99, f"{notice}\n{varied(r)}\nCopyright of the house\n{varied(r)}\n{notice}"))
    df = spark.createDataFrame([(*x, "one.test", None, None) for x in rows], "article_no long, body string, host string, site string, title string")
    got = {(x["article_no"], x["line_no"]) for x in boilerplate.main_body(df, "article_no", "body", "host", "site", "title").collect()}
    assert got == {(k, n) for k, _ in rows for n in (1, 3)}


def test_teasers_below_their_heading(spark):
    r = random.Random(2)
    tease = lambda m: m + " ".join(r.choices("release of many small models for quiet offices".split(), k=7)).capitalize()
    rows = [(k, "\n".join([varied(r), "Related reading", *(tease(m) for m in (("", "- ", "1. ")[k % 3],) * 2), varied(r), "- own entry of the list"])) for k in range(30)]
    df = spark.createDataFrame([(*x, "one.test", None, None) for x in rows], "article_no long, body string, host string, site string, title string")
    got = {(x["article_no"], x["line_no"]) for x in boilerplate.main_body(df, "article_no", "body", "host", "site", "title").collect()}
    assert {n for _, n in got} == {2, 3, 4} and len(got) == 90


def test_boilerplate_counts_lines_over_hosts(spark):
    r = random.Random(12)
    prose = lambda: " ".join(r.choices(" ".join(PROSE).lower().replace(",", "").replace(".", "").split(), k=14)).capitalize() + "."
    notice, lone, code, cut = "3 comments - log in to join the discussion", "Members of the club read every issue on paper", "bench = run(seed)", "Two of the reviewers"
    rows = []
    for h in range(4):
        for k in range(500):
            put = [notice] * (k < 2) + [code] * (2 <= k < 4) + [cut] * (k == 4 and h < 3)
            rows.append((len(rows), "\n".join([prose(), *put, prose()]), f"h{h}.test"))
    for k in range(1500):  # a line of one large host, on 20 of its 2,000 pages
        rows.append((len(rows), "\n".join([prose(), *[lone] * (k < 20), prose()]), "h0.test"))
    df = spark.createDataFrame([(*x, None, None) for x in rows], "article_no long, body string, host string, site string, title string")
    got = {(x["article_no"], x["line_no"]) for x in boilerplate.main_body(df, "article_no", "body", "host", "site", "title").collect()}
    assert got == {(n, 2) for n, body, _ in rows if body.split("\n")[1] in (notice, lone)}


def test_wrappers_lose_no_literal():
    r = random.Random(11)
    parts, count = [], {}
    for _ in range(3):
        w = boilerplate.Wrapper()
        for k in range(700):
            line = r.sample(range(100, 140), 12)
            if k % 60 == 0:  # a literal of small support, never in the same place
                line.insert(r.randrange(12), 900 + k // 60 % 3)
            for t in line:
                count[t] = count.get(t, 0) + 1
            w.align(line, [1] * len(line), [0] * len(line), 1)
        parts.append(w)
    whole = boilerplate.Wrapper.load(parts[0].dump())
    for w in parts[1:]:
        whole.merge(w)
    assert whole.pages == 2100 and len(whole.nodes) <= boilerplate.NODES
    total = {}
    for t, n, _ in whole.nodes:
        total[t] = total.get(t, 0) + n
    assert total == count


def test_truncation(spark):
    r = random.Random(8)
    words = "the vendor doubled quota for batch scheduling while operators replaced router with a smaller model before anyone had read comments".split()
    sentence = lambda: (" ".join(r.choices(words, k=12))).capitalize() + "."
    bodies = ["\n".join([" ".join(sentence() for _ in range(4)), f"- Notes on {r.choice(['caching', 'decoding'])}", " ".join(sentence() for _ in range(3))]) for _ in range(150)]
    cut = {1000 + k: bodies[k][: -r.randrange(5, 30)] for k in range(20)}
    rows = [("articles", i, "en", b) for i, b in [*enumerate(bodies), *cut.items(), (3000, None), (3001, ""), (3002, "A whole text that ends in an ellipsis…")]]
    rows += [("items", 1, "en", "Notes on caching"), ("items", 2, "en", sentence())]
    values = spark.createDataFrame([(*x, "s") for x in rows], "tbl string, rec_no long, lang string, text string, source string")
    found = truncation.cut_values(values)
    got = {(x["tbl"], x["rec_no"]) for x in found.collect()}
    assert ("articles", 3002) in got and ("items", 1) not in got and ("items", 2) not in got
    assert len(got & {("articles", k) for k in cut}) >= 19 and not got & {("articles", k) for k in range(150)}
    rate = {x["tbl"]: x for x in truncation.rates(values, found).collect()}
    assert rate["articles"]["n_values"] == 171 and rate["items"]["n_cut"] == 0
    assert truncation.cut_values(values.where("false")).count() == 0


def test_pii_held_out(spark):
    tagger = pii.load()
    assert tagger is not None
    texts = pii_train.labelled(["Anna", "Boris"], ["Keller", "Novakson"], [" ".join(PROSE)], 250, seed=77)
    right = wanted = found = 0
    for (t, gold), s in zip(texts, pii.spans(tagger, [t for t, _ in texts])):
        a, b = {(x, k) for x, _, k in gold}, {(x, k) for x, _, k in pii.check(t, s)}
        right, wanted, found = right + len(a & b), wanted + len(a), found + len(b)
    assert right >= 0.75 * wanted and right >= 0.85 * found
    df = spark.createDataFrame([(1, "Questions can be sent to Anna Keller at anna.keller@mailbox.example.", "c"), (2, None, "c"), (3, "", "c"), (4, "plain " * 3000, "c")], "doc_id long, text string, clean string")
    got = {r["doc_id"]: r for r in pii.find(df, "doc_id", "text", tagger).collect()}
    assert got[2]["clean"] is None and got[3]["clean"] == "" and got[4]["clean"] == "plain " * 3000 and "[EMAIL]" in got[1]["clean"]
    assert pii.find(df.where("false"), "doc_id", "text", tagger).count() == 0


#: Carriers that training never sees, neither word for word nor in these turns.
UNSEEN = [
    "Deliveries for {P} should go to {A} before noon.", "You can reach our colleague {P} via {E}, or by phone: {F}.", "The clerk typed {I} into the wrong field of the form.", "Yesterday {P} resigned, and {P} took over the desk.", "Her mail is {E} and her mobile is {F}.", "We met at {A} last week.",
    "Gestern hat {P} die Leitung übernommen.", "Bitte rufen Sie uns unter {F} zurück oder schreiben Sie an {E}.", "Die Lieferung ging an {P}, {A}.", "Hier, {P} a pris la parole.", "Vous pouvez joindre {P} au {F} ou par {E}.", "Ayer {P} dejó el equipo.", "Puede llamar a {P} al {F}.", "Ontem {P} deixou a equipe.",
    "昨天{C}离开了团队。", "包裹寄往{A}，由{C}领取。", "有问题可以打{F}或写信到{E}。",
]


def test_pii_on_unseen_carriers():
    """Recall per kind on turns that training has not seen: reported by the assertion, bounded from below."""
    assert not set(UNSEEN) & set(pii_train.CARRIERS)
    make = pii_train.Maker(["Anna", "Boris", "Clara"], ["Keller", "Novakson", "Brandberg"], 31)
    tagger, right, wanted, found = pii.load(), {}, {}, 0
    texts = [make.carrier(c) for _ in range(14) for c in UNSEEN]
    texts = [(f"{PROSE[k % 3]} {t}", [(a + len(PROSE[k % 3]) + 1, b + len(PROSE[k % 3]) + 1, kind) for a, b, kind in spans]) for k, (t, spans) in enumerate(texts)]
    for (t, gold), s in zip(texts, pii.spans(tagger, [t for t, _ in texts])):
        got = {(x, k) for x, _, k in pii.check(t, s)}
        found += len(got)
        for x, _, k in gold:
            wanted[k] = wanted.get(k, 0) + 1
            right[k] = right.get(k, 0) + ((x, k) in got)
    recall = {k: round(right[k] / n, 2) for k, n in wanted.items()}
    print(recall, sum(right.values()) / found)
    assert sum(right.values()) >= 0.5 * sum(wanted.values()) and sum(right.values()) >= 0.8 * found, recall


def test_pii_training_learns():
    texts = pii_train.labelled(["Anna"], ["Keller"], [" ".join(PROSE)], 64, seed=1)
    a = pii.Tagger()
    import numpy as np

    x = [pii.encode(t[:80]) for t, _ in texts]
    width = max(map(len, x))
    ids = np.zeros((len(x), width), np.int32)
    for n, v in enumerate(x):
        ids[n, : len(v)] = v
    y, mask = np.zeros_like(ids, dtype=np.int64), (ids > 0).astype(np.float32)
    g = a._gradient(ids, y, mask)

    def loss(t):
        e = t.emissions(ids)
        tr = t.p["tr"] + t.ban
        s = e[0] + t.p["st"]
        for k in range(1, len(e)):
            new = np.log(np.exp(s[:, :, None] + tr[None] - s.max(1)[:, None, None]).sum(1)) + s.max(1)[:, None] + e[k]
            s = np.where(mask[:, k : k + 1] > 0, new, s)
        z = np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1)
        gold = e[0, :, 0] + t.p["st"][0] + sum((e[k, :, 0] + tr[0, 0]) * mask[:, k] for k in range(1, len(e)))
        return float((z - gold).sum() / len(x))

    for name in ("out", "whf", "emb", "tr"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        eps = 1e-2
        keep = a.p[name][at]
        a.p[name][at] = keep + eps
        up = loss(a)
        a.p[name][at] = keep - eps
        down = loss(a)
        a.p[name][at] = keep
        assert abs((up - down) / (2 * eps) - g[name][at]) < 0.05 * abs(g[name][at]) + 0.02
