import json

import pytest

from newsloom.sources.feeds import card_entries, feed_entries, json_lines, page_metadata, parse_date, scan, sitemap_entries
from newsloom.sources.sinks import write_changed
from newsloom.streaming.ingest import COLUMNS, deduplicated, merge_stream, read_landed, tumbling

ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>New &amp; good</title><updated>2026-10-01T00:00:00Z</updated><link href="https://a.test/1"/><summary>&lt;b&gt;Text&lt;/b&gt;</summary></entry><entry><title>No link</title></entry></feed>"""
RSS = """<rss><channel><item><title>One</title><link>https://a.test/2</link><pubDate>Mon, 05 Oct 2026 10:00:00 GMT</pubDate><description>Short</description></item></channel></rss>"""
CARDS = """<div><div role="listitem"><div><a href="/p/1"><h3>First card</h3></a><span>June 18, 2026</span></div></div><div role="listitem"><a href="/p/1">Again</a></div></div>"""
SITEMAP = """<urlset><url><loc>https://a.test/blog/some-post</loc><lastmod>2026-06-18</lastmod></url><url><loc>https://a.test/about</loc></url></urlset>"""


def test_feed():
    (one,) = feed_entries(ATOM)
    assert one["title"] == "New & good" and one["summary"] == "Text" and one["published"].isoformat() == "2026-10-01T00:00:00+00:00"
    (two,) = feed_entries(RSS)
    assert two["url"] == "https://a.test/2" and two["published"].hour == 10
    assert list(feed_entries("<broken")) == [] and list(feed_entries("")) == []


def test_cards_sitemap_metadata():
    (card,) = card_entries(CARDS, "https://a.test")
    assert card["url"] == "https://a.test/p/1" and card["title"] == "First card" and card["published"].isoformat() == "2026-06-18T00:00:00+00:00"
    (page,) = sitemap_entries(SITEMAP, ("/blog/",))
    assert page["title"] == "Some post" and page["published"].day == 18
    meta = page_metadata('<head><title>Story | Site</title><meta name="description" content="About"></head><script>{"datePublished": "2026-01-02"}</script>')
    assert meta["title"] == "Story" and meta["summary"] == "About" and meta["published"].day == 2
    assert parse_date("nonsense") is None and parse_date(None) is None


def test_scan(spark):
    landed = spark.createDataFrame([("a", "feed", ATOM), ("b", "sitemap", SITEMAP), ("c", "feed", None), ("d", "html-cards", CARDS)], "source string, form string, payload string")
    got = scan(landed).collect()
    assert sorted(r["source"] for r in got) == ["a", "b", "b", "d"]


def test_json_lines(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"measuredAt": "2026-01-01", "n": 1}\n\nbroken\n{"n": 2}\n')
    assert json_lines(spark, str(p), "measuredAt string, n long", "measuredAt").count() == 1


def test_write_changed(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", "d1"), (2, "y", "d2")], "id int, t string, day string")
    path = str(tmp_path / "t")
    assert write_changed(df, path) == 2
    assert write_changed(df, path) == 0
    assert write_changed(spark.createDataFrame([(1, "z", "d1"), (2, "y", "d2")], "id int, t string, day string"), path) == 1
    assert {tuple(r) for r in spark.read.parquet(path).select("id", "t").collect()} == {(1, "z"), (2, "y")}


def test_stream_merge_and_windows(spark, tmp_path):
    landed = tmp_path / "in"
    landed.mkdir()
    row = {"title": "A story", "url": "u1", "source": "s", "published": "2026-01-02", "score": 5, "signal": "low"}
    (landed / "1.json").write_text(json.dumps(row) + "\n" + json.dumps(row | {"url": "u2", "published": "2026-01-01"}))
    schema = "title string, url string, source string, published string, score int, signal string"
    go = lambda: merge_stream(read_landed(spark, str(landed), schema, 1), str(tmp_path / "table"), str(tmp_path / "cp")).awaitTermination()
    go()
    (landed / "2.json").write_text(json.dumps(row | {"title": "A story", "url": "u3", "published": "2026-02-01", "score": 9}) + "\n" + json.dumps(row | {"title": "Other"}))
    go()
    got = {r["title"]: r for r in spark.read.parquet(str(tmp_path / "table")).collect()}
    assert got["A story"]["published"] == "2026-01-02" and got["A story"]["score"] == 5 and got["A story"]["url"] == "u3" and "Other" in got
    # a table that can't be read stops the stream and stays as it is
    (part,) = {f.parent for f in (tmp_path / "table").rglob("*.parquet") if "Other" in str(spark.read.parquet(str(f)).collect())}
    next(part.glob("*.parquet")).write_bytes(b"broken")
    (landed / "3.json").write_text(json.dumps(row | {"title": "Other", "url": "u9"}))
    with pytest.raises(Exception):
        go()
    assert b"broken" in b"".join(f.read_bytes() for f in part.glob("*.parquet"))
    events = spark.readStream.format("rate").load()
    assert deduplicated(events, "value", "timestamp").isStreaming and tumbling(events, "timestamp").isStreaming and len(COLUMNS) == 7


def test_pages(spark):
    from newsloom.functions.markup import largest, page_blocks, read_pages

    page = "<html><head><title>x</title></head><body><nav>Menu</nav><h2>Head</h2><p>One <b>two</b>&amp; three</p><ul><li>item</li></ul><blockquote><p>said</p></blockquote><pre>a = 1\nb = 2</pre><img src='i.png' alt='pic'><script>no()</script></body></html>"
    body, images = page_blocks(page)
    assert body == "## Head\n\nOne two& three\n\n- item\n\n> said\n\n```\na = 1\nb = 2\n```" and images == [("i.png", "pic")]
    assert page_blocks(None) == ("", []) and largest("a.png 1x, b.png 2x") == "b.png"
    got = {r["n"]: r for r in read_pages(spark.createDataFrame([(1, page), (2, None)], "n int, html string"), "n", "html").collect()}
    assert got[1]["images"][0]["alt"] == "pic" and got[2]["body"] == ""
