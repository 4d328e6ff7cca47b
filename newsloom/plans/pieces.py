"""Smaller queries: chunks, addresses, durations, markdown images, catalogue and state lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.urls import canonical_urls, page_keys
from ..operators import filters
from ..operators.chunks import chunks
from ..operators.ranking import last_before
from ..session import table
from .registry import query


@query()
def w09_chunks(spark, d):
    """Lines of a body in chunks of at most 800 characters and 6 lines. Tested against a plain loop."""
    lines = table(spark, d, "articles").where("body is not null").select("article_no", F.posexplode(F.split("body", "\n")).alias("pos", "line"))
    return chunks(lines.where(F.trim("line") != "").withColumn("size", F.length("line")), "article_no", "pos", "size", 800, 6)


@query()
def x04_page_keys(spark, d):
    """One spelling per page address. Tested on pairs of spellings."""
    return table(spark, d, "items").select("row_id", page_keys(F.col("url")).alias("page_key"))


@query()
def x04_canonical(spark, d):
    """Addresses in their one spelling that still leads there. Tested on pairs of spellings."""
    return table(spark, d, "items").select("row_id", canonical_urls(F.col("url")).alias("url"))


@query("select source, sourceDomain, lang, coalesce(feed_max_age_days, 120) as age_days, len(coalesce(aliases, [])) as n_aliases from sources")
def s26_catalogue(spark, d):
    n = F.size(F.coalesce("aliases", F.array().cast("array<string>")))
    return table(spark, d, "sources").select("source", "sourceDomain", "lang", F.coalesce("feed_max_age_days", F.lit(120)).alias("age_days"), n.alias("n_aliases"))


@query("select row_id, id from items where day = date '2015-10-02' and id in (select id from items where day = date '2015-10-02' group by id having count(*) = 1)")
def s24_day_lookup(spark, d):
    return filters.day_lookup(table(spark, d, "items").select("row_id", "id", "day"), "2015-10-02", "id").select("row_id", "id")


@query("select row_id, last_value(nullif(summary, '') ignore nulls) over (partition by source order by row_id rows between unbounded preceding and 1 preceding) as previous_summary from items")
def w05_previous_text(spark, d):
    """The last summary of the same source before each row; a source may be of any size."""
    df = table(spark, d, "items").select("row_id", "source", F.when(F.col("summary") != "", F.col("summary")).alias("said"))
    return last_before(df, ["source"], [F.col("row_id")], "said", "previous_summary").select("row_id", "previous_summary")


@query("with t as (select l_orderkey, l_linenumber, l_partkey % 5 || 'h' || l_suppkey % 60 || 'm' || l_linenumber || '.5s' as t from lineitem) select l_orderkey, l_linenumber, 3600 * regexp_extract(t, '(\\d+)h', 1)::int + 60 * regexp_extract(t, '(\\d+)m', 1)::int + regexp_extract(t, '([\\d.]+)s', 1)::double as seconds from t")
def x31_durations(spark, d):
    t = F.concat((F.col("l_partkey") % 5).cast("string"), F.lit("h"), (F.col("l_suppkey") % 60).cast("string"), F.lit("m"), F.col("l_linenumber").cast("string"), F.lit(".5s"))
    part = lambda p: F.regexp_extract(F.col("t"), p, 1).cast("double")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", t.alias("t")).select("l_orderkey", "l_linenumber", (part(r"(\d+)h") * 3600 + part(r"(\d+)m") * 60 + part(r"([\d.]+)s")).alias("seconds"))


@query("select article_no, unnest(list_distinct(regexp_extract_all(body, '!\\[[^\\]\n]*\\]\\(([^)\\s]+)', 1))[1:12]) as src from articles")
def x37_markdown_images(spark, d):
    found = F.slice(F.array_distinct(F.regexp_extract_all("body", F.lit(r"!\[[^\]\n]*\]\(([^)\s]+)"), F.lit(1))), 1, 12)
    return table(spark, d, "articles").select("article_no", F.explode(found).alias("src"))


@query("select a.article_no, b.id is not null as current from articles a left join (select id, url, max(\"bodyFormatVersion\") as v from articles group by 1, 2) b on a.id = b.id and a.url = b.url and a.\"bodyFormatVersion\" = b.v")
def h01_valid_records(spark, d):
    a = table(spark, d, "articles").select("article_no", "id", "url", F.col("bodyFormatVersion").alias("v"))
    best = a.groupBy("id", "url").agg(F.max("v").alias("v")).withColumn("current", F.lit(True))
    return a.join(best, ["id", "url", "v"], "left").select("article_no", F.coalesce("current", F.lit(False)).alias("current"))


@query("select row_id, coalesce(nullif(trim(title), ''), 'untitled') as title, coalesce(nullif(trim(source), ''), 'unknown') as source, least(5, greatest(1, coalesce(score, 0) // 20)) as stars from items")
def h19_history_entries(spark, d):
    some = lambda c, other: F.coalesce(F.when(F.trim(c) != "", F.trim(c)), F.lit(other)).alias(c)
    return table(spark, d, "items").select("row_id", some("title", "untitled"), some("source", "unknown"), F.least(F.lit(5), F.greatest(F.lit(1), F.floor(F.coalesce("score", F.lit(0)) / 20))).cast("int").alias("stars"))


@query("select count(*) filter (where stale) as n_stale, count(*) as n, round(100.0 * count(*) filter (where stale) / count(*), 2) as percent from (select polled_at < (select max(polled_at) from batches) - interval 1 hour as stale from batches)")
def h20_staleness(spark, d):
    b = table(spark, d, "batches").select("polled_at")
    stale = F.col("polled_at") < F.col("newest") - F.expr("interval 1 hour")
    g = b.join(F.broadcast(b.agg(F.max("polled_at").alias("newest"))), F.lit(True)).agg(F.count_if(stale).alias("n_stale"), F.count("*").alias("n"))
    return g.withColumn("percent", F.round(F.col("n_stale") * 100.0 / F.col("n"), 2))
