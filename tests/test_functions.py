from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.functions.blocks import blocks
from newsloom.functions.catalogue import resolve_entry
from newsloom.functions.urls import page_key
from newsloom.operators.relational import diff, merge_newer, rolling, streaks


def test_page_key_spellings():
    one = "https://Host.example/a/b?x=1&y=2"
    for other in ("http://host.example/a/b/?y=2&x=1", "https://www.host.example//a/b?x=1&y=2&utm_source=z#top", "https://host.example:443/a/b?x=1&y=2&fbclid=q", "https://hop.test/r?u=https%3A%2F%2Fhost.example%2Fa%2Fb%3Fx%3D1%26y%3D2&src=a"):
        assert page_key(other) == page_key(one)
    assert page_key(None) is None and page_key("  ") is None and page_key("http://[bad") is not None


def test_cap_dimensions(spark):
    rows = spark.createDataFrame([(10, 20, 30, 20, 10, 10), (1, 1, 1, 1, 1, 1), (0, 0, 0, 0, 0, 0)], "a int, b int, c int, d int, e int, f int")
    out = rows.select(*[c.alias(n) for n, c in zip("abcdef", text.cap_to([F.col(x) for x in "abcdef"], F.lit(49)))]).collect()
    assert sum(out[0]) == 49 and sum(out[1]) == 6 and sum(out[2]) == 0


def test_shorten_and_redact(spark):
    df = spark.createDataFrame([("word " * 40,), ("short",), (None,)], "t string")
    got = [r[0] for r in df.select(text.shorten(F.col("t"))).collect()]
    assert got[0].endswith("…") and len(got[0]) <= 121 and got[1] == "short" and got[2] is None
    secret = spark.createDataFrame([("key sk-" + "a" * 24 + " end",)], "t string")
    assert secret.select(text.redact(F.col("t"))).first()[0] == "key sk-[REDACTED] end"


def test_resolve_entry(spark):
    sources = spark.createDataFrame([("Alpha Wire", "alpha.test", ["ALP"], 3), ("Beta Blog", "beta.test", None, None)], "source string, sourceDomain string, aliases array<string>, n int")
    rows = spark.createDataFrame([(1, " ALPHA  wire", None), (2, "alp", "beta.test"), (3, "", "WWW.BETA.TEST."), (4, None, None), (5, "Ｂｅｔａ Ｂｌｏｇ (RSS)", None), (6, "Alpha", "x.test")], "i int, source string, sourceDomain string")
    got = {r["i"]: (r["entry"], r["entry_n"]) for r in resolve_entry(rows, sources).collect()}
    assert got == {1: ("Alpha Wire", 3), 2: ("Alpha Wire", 3), 3: ("Beta Blog", None), 4: (None, None), 5: ("Beta Blog", None), 6: (None, None)}


def test_blocks():
    body = "# Head\n\nfirst line\nsecond line\n- item\n> quote\n```\ncode\n```\nlast"
    assert [(b, k) for b, k, _ in blocks(body)] == [("b0001", "heading"), ("b0002", "paragraph"), ("b0003", "list-item"), ("b0004", "blockquote"), ("b0005", "paragraph")]
    assert blocks(None) == [] and blocks("") == []


def test_merge_streaks_rolling_diff(spark):
    new = spark.createDataFrame([("a", "n", 1), ("b", "n", 2)], "id string, title string, score int")
    old = spark.createDataFrame([("a", "o", 9), ("c", "o", 8)], "id string, title string, score int")
    got = {r["id"]: (r["title"], r["score"]) for r in merge_newer(new, old, "id", ["score"]).collect()}
    assert got == {"a": ("n", 9), "b": ("n", 2), "c": ("o", 8)}
    df = spark.createDataFrame([("u", i, b) for i, b in enumerate([1, 1, 0, 1, 1, 1])], "k string, i int, bad int")
    assert [r["streak"] for r in streaks(df, ["k"], [F.col("i")], F.col("bad") == 1).orderBy("i").collect()] == [1, 2, 0, 1, 2, 3]
    assert [r["n"] for r in rolling(df, ["k"], F.col("i"), 2, {"n": F.count("*")}).orderBy("i").collect()] == [1, 2, 3, 3, 3, 3]
    assert sorted(tuple(r) for r in diff(new, old, ["id"]).collect()) == [("b", "missing"), ("c", "extra")]


def test_chunks_equal_a_loop(spark):
    import random

    from newsloom.operators.chunks import chunks

    r = random.Random(9)
    rows = [(g, i, r.randrange(0, 400)) for g in range(5) for i in range(30)] + [(9, 0, None)]
    got = {(x["g"], x["i"]): x["chunk_no"] for x in chunks(spark.createDataFrame(rows, "g int, i int, n int"), "g", "i", "n", 500, 4).collect()}
    for g in (*range(5), 9):
        no = chars = held = 0
        for _, i, n in sorted(x for x in rows if x[0] == g):
            if held == 0 or held >= 4 or chars + (n or 0) > 500:
                no, chars, held = no + 1, 0, 0
            chars, held = chars + (n or 0), held + 1
            assert got[g, i] == no
