import base64
import json
import random

import pytest

from newsloom.functions import repair
from newsloom.operators.pacing import paced
from newsloom.sources import landed, sinks


def test_fences():
    f = repair.block_fences
    assert f("a\n```py\nx\n```\nb") == "a\n```py\nx\n```\nb"
    assert f("say ```x = 1``` now") == "say\n```\nx = 1\n```\nnow"
    assert f("text ``` x\ny ``` tail") == "text\n```\nx\ny\n```\ntail"
    assert f("```\nopen") == "```\nopen\n```" and f("") == "" and f("a\r\nb") == "a\nb"


def test_markup():
    assert repair.plain_markup(r"\textbf{Big \emph{news}} costs $5\%$ of \alpha") == "Big news costs 5% of α"
    assert repair.plain_markup(r"\frac{a}{b} and \sqrt{x}^2 &amp; x_{i}") == "(a)/(b) and sqrt(x)2 & xi"
    assert repair.normal_body("a \\textbf{b}\n```\n\\textbf{c}\n```") == "a b\n```\n\\textbf{c}\n```" and repair.normal_body("") == ""


def test_collapsed_code():
    b = repair.broken_up
    assert b("apiVersion: v1 kind: Pod metadata: name: x spec: y") == "apiVersion: v1\nkind: Pod\nmetadata:\nname: x\nspec: y"
    assert b("pip install x git clone y") == "pip install x \ngit clone y"
    assert "a = ';';\n" in b("const a = ';'; let b = 2;") and b("plain words only") == "plain words only" and b("") == ""
    long = "```\n" + "x = 1; " * 50 + "\n```"
    assert repair.flattened(long) and not repair.flattened("```\nx\n```") and repair.flattened("run def f(x) now") and not repair.flattened("")
    assert repair.repaired("fine text") is None and repair.repaired("a ```b``` c") == "a\n```\nb\n```\nc" and repair.repaired("") is None


def test_repairs_keep_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a ```b``` c")], "n int, body string")
    got = {r["n"]: r["b"] for r in df.select("n", repair.each_text(repair.block_fences, df["body"]).alias("b")).collect()}
    assert got == {1: None, 2: "", 3: "a\n```\nb\n```\nc"}


def test_entry_images():
    entry = """<item xmlns:media="m"><description>&lt;img src="/a.png"&gt; &lt;img srcset="b.jpg 1x, c.jpg 2x"&gt;</description><enclosure url="https://x.test/d" type="image/png"/><enclosure url="https://x.test/e.mp3" type="audio/mpeg"/>
    <media:thumbnail url="https://x.test/f"/><media:content url="https://x.test/g.webp"/><media:content url="https://x.test/h"/><media:thumbnail url="https://x.test/f"/><image>ftp://x/i.png</image></item>"""
    assert landed.entry_images(entry, "https://b.test/p/") == ["https://b.test/a.png", "https://b.test/p/c.jpg", "https://x.test/d", "https://x.test/f", "https://x.test/g.webp"]
    assert landed.entry_images("<broken") == [] and landed.entry_images("") == [] and len(landed.entry_images("<i>" + "".join(f'<thumbnail url="https://x.test/{k}"/>' for k in range(30)) + "</i>")) == 12


def test_forum_posts(spark):
    body = "word " * 80
    rows = [(1, json.dumps([{"data": {"children": [{"data": {"selftext": body}}]}}])), (2, json.dumps({"post_stream": {"posts": [{"cooked": f"<p>{body}</p>"}]}})), (3, json.dumps([{"data": {"children": []}}])), (4, "{"), (5, None), (6, json.dumps({"post_stream": {"posts": [{"cooked": "short"}]}}))]
    got = {r["n"]: r["body"] for r in landed.forum_posts(spark.createDataFrame(rows, "n int, payload string"), "payload").collect()}
    assert got[1] == got[2] == body.strip() and got[3] is got[4] is got[5] is got[6] is None


def test_tokens():
    pack = lambda u: base64.urlsafe_b64encode(b"\x08\x13\x22" + (bytes([len(u)]) if len(u) < 128 else bytes([len(u) & 127 | 128, len(u) >> 7])) + u.encode() + b"\xd2\x01\x00").decode().rstrip("=")
    for url in ("https://a.test/x", "http://b.test/" + "y" * 200):
        assert landed.token_address(pack(url)) == url and landed.redirect_target(f"https://agg.test/rss/articles/{pack(url)}?oc=5") == url
    assert landed.redirect_target("https://agg.test/r?url=https%3A%2F%2Fa.test%2F1") == "https://a.test/1"
    assert landed.token_address(None) is None and landed.token_address("!!") is None and landed.redirect_target(None) is None and landed.redirect_target("https://a.test/p") is None


def test_snapshots_and_sizes(spark, tmp_path):
    (tmp_path / "ab").mkdir()
    (tmp_path / "ab/1.json").write_text('{\n"id": "1"}')
    (tmp_path / "2.json").write_text('{"id": ')
    got = landed.snapshots(spark, str(tmp_path), "id string").cache()
    assert [r["id"] for r in got.collect()] == ["1"]
    assert sorted(r["bytes"] for r in landed.file_sizes(spark, str(tmp_path)).collect()) == [7, 12]


def test_answers():
    asked = {"b0001": "x", "b0002": "y"}
    good, bad = landed.answer_blocks('```json\n{"translations": [{"id": "b0001", "translationZh": "一 二"}, {"id": "b0002", "translation": "no"}]}\n```', asked)
    assert good == {"b0001": "一 二"} and bad == {"b0002": "not Chinese"}
    assert landed.answer_blocks('Here: {"b0001": "一", "b0002": {"zh": "二"}} done', asked)[0] == {"b0001": "一", "b0002": "二"}
    assert landed.answer_blocks('{"items": {"b0001": "一"}}', asked) == ({"b0001": "一"}, {"b0002": "missing or duplicate block id"})
    assert landed.answer_blocks('{"data": [{"id": "b0001", "zh": "一"}, {"id": "b0001", "zh": "一"}]}', asked)[0] == {} and set(landed.answer_blocks(None, asked)[1]) == set(asked) == set(landed.answer_blocks("[1]", asked)[1])


def test_sinks(spark, tmp_path):
    index = str(tmp_path / "index")
    sinks.write_index(spark.createDataFrame([(1, "a", None), (2, "", "z")], "n int, t string, u string").coalesce(1), index)
    assert sorted(line for f in (tmp_path / "index").glob("*.json") for line in f.read_text().split()) == ['{"n":1,"t":"a"}', '{"n":2,"u":"z"}']
    for name in "abc":
        (tmp_path / name).write_text(name)
    present = spark.createDataFrame([(f"file:{tmp_path}/{n}",) for n in "abc"], "path string")
    with pytest.raises(ValueError):
        sinks.prune(present, present.where("false"))
    assert sinks.prune(present, present.where("path like '%a'")) == 2 and (tmp_path / "a").exists() and not (tmp_path / "b").exists()
    m = spark.createDataFrame([("d1", 5)], "day string, bytes int")
    for _ in range(2):
        sinks.append_measure(m, str(tmp_path / "m"), ["day"])
    assert spark.read.parquet(str(tmp_path / "m")).count() == 1


def test_rewritten_paths(spark):
    docs = spark.createDataFrame([(1, 'see "m/a.png" and "m/b.png", m/a.png'), (2, "none"), (3, None), (4, '""')], "n int, body string")
    moved = spark.createDataFrame([("m/a.png", "m/z.png"), ("m/a.png", "m/z.png")], "old string, new string")
    got = {r["n"]: r["body"] for r in sinks.rewrite_paths(docs, "n", "body", moved).collect()}
    assert got == {1: 'see "m/z.png" and "m/b.png", m/a.png', 2: "none", 3: None, 4: '""'}


def test_pacing(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), i, r.choice([True, False, False, False, False, None])) for i in range(300)]
    want, state = {}, {}
    for scope, at, bad in rows:
        interval, good = state.get(scope, (1.0, 0))
        interval, good = (min(60.0, interval * 2), 0) if bad else (interval, good + 1)
        if good == 10:
            interval, good = max(1.0, interval / 2), 0
        state[scope] = interval, good
        want[at] = interval
    got = paced(spark.createDataFrame(rows, "scope string, at int, bad boolean").repartition(4), "scope", "at", "bad", 1.0)
    assert {x["at"]: x["interval"] for x in got.collect()} == want


def test_post_images():
    hosts = {"i.pics.test": 0, "preview.pics.test": 1}
    post = {
        "url_overridden_by_dest": "https://a.test/x.JPG?s=1",
        "preview": {"images": [{"source": {"url": "https://preview.pics.test/u.png?width=1&amp;h=2"}}, {"source": {}}, "odd"]},
        "media_metadata": {"m": {"s": {"u": "https://i.pics.test/u.png"}}, "n": {"s": {"u": "https://i.pics.test/v.png"}}, "o": 3},
    }
    assert landed.post_images(json.dumps(post), hosts) == ["https://a.test/x.JPG?s=1", "https://i.pics.test/u.png", "https://i.pics.test/v.png"]
    assert landed.post_images(json.dumps(post), hosts, 1) == ["https://a.test/x.JPG?s=1"]
    assert landed.post_images(None, hosts) == landed.post_images("[]", hosts) == landed.post_images('{"preview": 3}', hosts) == []
