import random

import pytest
from pyspark.sql import functions as F

from newsloom.functions import releases, reviews, text
from newsloom.operators import dedupe
from newsloom.session import Scratch, exists


def values(spark, rows, schema, **columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*[c.alias(n) for n, c in columns.items()]).collect()]


def test_secrets_are_redacted_beside_signs_and_underscores(spark):
    key = "a1B2c3D4e5" * 3
    cases = [
        (f"密钥sk-{key}。", "密钥sk-[REDACTED]。"), (f"x_sk-{key}", "x_sk-[REDACTED]"), (f"_hf_{key}", "_hf_[REDACTED]"), (f"Xsk-{key}", f"Xsk-{key}"), (f"github_pat_{key}_x y", "github_pat_[REDACTED] y"), (f"ghp_{key},", "gh_[REDACTED],"),
        ("AKIA" + "A1" * 8 + ".", "AKIA[REDACTED]."), ("AKIA" + "A1" * 9, "AKIA" + "A1" * 9), (f"sk-{key} sk-{key}", "sk-[REDACTED] sk-[REDACTED]"), ("sk-short", "sk-short"), ("", ""), (None, None),
    ]
    got = values(spark, cases, "a string, b string", a=text.redact(F.col("a")), b=F.col("b"))
    assert all(a == b for a, b in got), got


def test_limit_lines(spark):
    cases = [("ab\ncd", "ab\ncd"), ("  \n ", ""), ("aaaa\nbbbb\ncccc", "aaaa\nbbbb"), ("```\naa\nbbbbbb\n```", "```\naa\n```"), ("x" * 50, ""), (None, None)]
    got = values(spark, cases, "a string, b string", a=text.limit_lines(F.col("a"), 11), b=F.col("b"))
    assert got == [(b, b) for _, b in cases]


def test_release_rules(spark):
    cases = [
        ("v1.2.3", True, True), ("1.2.0", False, False), ("v0.32.0", True, True), ("v2.0-rc1", True, True), ("Claude Tool v2.1.303", False, True), ("Tool 3.0", False, False), ("Introducing Qwen1.5", False, False), ("v0.35.0", True, True), ("v3", False, False),
        ("Tool v0.9", False, True), ("", False, False), (None, None, None),
    ]
    got = values(spark, cases, "t string, v boolean, f boolean", v=releases.routine_version(F.col("t")).eqNullSafe(F.col("v")), f=releases.routine_feed_tag(F.col("t")).eqNullSafe(F.col("f")))
    assert got == [(True, True)] * len(cases), list(zip(cases, got))
    cases = [("pkg==1.2.3", False, True), ("Fix it (#18720)", False, True), ("b11434: hexagon", False, True), ("b12", False, False), ("build-123 ok", False, True), ("Tool v1.0.1", False, False), ("Tool v1.0.1", True, True), ("A story", None, False), (None, True, False)]
    got = values(spark, cases, "t string, f boolean, e boolean", r=releases.routine_release(F.col("t"), F.col("f")) == F.col("e"))
    assert got == [(True,)] * len(cases), list(zip(cases, got))


def test_review_ceilings(spark):
    dims = {"relevance": 30, "impact": 25, "novelty": 15, "credibility": 15, "usefulness": 10, "timeliness": None}
    schema = "n int, relevant boolean, information string, evidence string, forum boolean, routine boolean"
    rows = [(0, True, "original", "clear", False, False), (1, True, "original", "odd", False, False), (2, False, "original", "clear", False, False), (3, True, "Rumor ", "clear", False, False), (4, True, "original", "none", True, False), (5, True, None, "clear", False, True), (6, None, "rehash", "clear", False, False)]
    c = F.col
    got = reviews.review(spark.createDataFrame(rows, schema), ["n"], {n: F.lit(v).cast("int") for n, v in dims.items()}, c("relevant"), c("information"), c("evidence"), c("forum"), c("routine"))
    assert [r["score"] for r in got.orderBy("n").collect()] == [90, 84, 29, 69, 59, 49, 29] and "timeliness" in got.columns


def test_glossary_and_tags(spark):
    schema = "g array<struct<term:string,explanationZh:string>>, l int, t array<string>, o array<string>"
    rows = [([("LLM", "大模型"), ("llm", "又一次"), ("模型", "中文"), ("RAG", "only"), (None, None), ("Agent", "智能体")], 4, ["a", "News ", "News"], ["x"]), (None, 5, None, ["x", " ", "y"]), ([("LLM", "大模型")], 3, [], None)]
    got = spark.createDataFrame(rows, schema).select(reviews.glossary(F.col("g"), F.col("l")).alias("g"), reviews.review_tags(F.col("t"), F.col("o")).alias("t")).collect()
    assert [[x["term"] for x in r["g"]] for r in got] == [["LLM", "Agent"], [], []] and [r["t"] for r in got] == [["News"], ["x", "y"], []]


@pytest.mark.parametrize("few", [0, 500_000])
def test_greedy_like_the_loop(spark, monkeypatch, few):
    monkeypatch.setattr(dedupe, "FEW", few)
    r = random.Random(4)
    rows = [(i, r.choice([*"abcdefghij", None]), r.choice([*"klmnopqrst", None]), r.randrange(-5, 5)) for i in range(120)]
    seen, want = set(), set()
    for i, a, b, at in sorted(rows, key=lambda x: (x[3], x[0])):
        mine = {k for k in ((0, a), (1, b)) if k[1] is not None}
        if not mine & seen:
            seen |= mine
            want.add(i)
    df = spark.createDataFrame([(*x, "c") for x in rows], "i long, a string, b string, at long, hub string").repartition(3)
    got = dedupe.greedy_first(df, ["a", "b"], F.struct("at", "i"), "i")
    assert {x["i"] for x in got.collect()} == want and got.columns == df.columns
    assert dedupe.greedy_first(df.where("false"), ["a", "b"], F.struct("at", "i"), "i").count() == 0


def test_scratch_is_removed(spark):
    with Scratch(spark, "t") as s:
        assert s.write(spark.range(3)).count() == 3 and exists(spark, s.path)
    assert not exists(spark, s.path)


def test_canonical_addresses():
    from newsloom.functions.urls import canonical_url as c

    assert c("HTTPS://Www.A.test:443//x//y/?b=2&utm_source=q&a=1#f") == "https://www.a.test/x/y?a=1&b=2"
    assert c("http://a.test") == c("http://a.test/") == "http://a.test/" and c("http://a.test:8080/x/") == "http://a.test:8080/x"
    assert c(None) is c("") is c("ftp://a.test/x") is c("mailto:x") is c("http://[broken") is None


def test_filters(spark):
    from newsloom.operators import filters as f

    c = F.col
    rows = [("My Forum", "x.test", "https://a.b.test/2015/x"), (None, None, None), ("s", "b.test", "ftp://b.test/2015")]
    df = spark.createDataFrame(rows, "s string, d string, u string")
    got = df.select(f.from_community(c("s"), c("d"), ["FORUM"]), f.under(f.host_of(c("u")), ["b.test"]), f.allowed(c("u"), ["/2015/"], []), f.allowed(c("u"), [], ["x"]), f.from_community(c("s"), c("d"), [])).collect()
    assert [tuple(r) for r in got] == [(True, True, True, False, False), (False,) * 5, (False,) * 5]
    texts = spark.createDataFrame([("Sparse attention beats attention; caching",), ("attention and sparse attention",), ("",), (None,)], "t string")
    found = [[(x["term"], x["at"]) for x in r[0] or ()] for r in texts.select(f.terms_in(c("t"), ["attention", "sparse attention", "caching"])).collect()]
    assert found == [[("sparse attention", 1), ("caching", 35)], [("attention", 1), ("sparse attention", 15)], [], []]
    items = spark.createDataFrame([(1, "a", "d1", "T open"), (2, "a", "d1", "x"), (3, "b", "d1", None)], "n int, id string, day string, title string")
    assert [r["n"] for r in f.day_lookup(items, "d1", "id").collect()] == [3]
    assert [r["n"] for r in f.feed(items, F.lit(3), least_level=3, words="OPEN t", text=["title"]).collect()] == [1] and f.feed(items, F.lit(1), least_level=2).count() == 0


@pytest.mark.parametrize("rows", [7, 1000])
def test_ranking_over_parts(spark, rows):
    from newsloom.operators.ranking import last_before, row_numbers

    r = random.Random(6)
    data = [(i, r.choice(["a", "a", "a", "b", "", None]), r.choice([None, 1, 2, 3]), r.choice([None, None, "x", "y"])) for i in range(60)]
    df = spark.createDataFrame(data, "i int, g string, s int, v string").repartition(5)
    want, last = {}, {}
    for g in {x[1] for x in data}:
        mine = sorted((x for x in data if x[1] == g), key=lambda x: (x[2] is None, -(x[2] or 0), x[0]))
        want |= {x[0]: k for k, x in enumerate(mine, 1)}
        said = None
        for x in sorted((x for x in data if x[1] == g), key=lambda x: x[0]):
            last[x[0]], said = said, x[3] or said
    got = row_numbers(df, ["g"], [F.desc_nulls_last("s"), F.col("i")], "n", rows)
    assert {x["i"]: x["n"] for x in got.collect()} == want and got.columns == [*df.columns, "n"]
    assert {x["i"]: x["p"] for x in last_before(df, ["g"], [F.col("i")], "v", "p", rows).collect()} == last
    assert row_numbers(df.where("false"), ["g"], [F.col("i")]).count() == 0
