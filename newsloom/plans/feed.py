"""Queries over the feed: items, their sources and their reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules, text
from ..functions.urls import canonical_urls
from ..operators import filters
from ..operators.dedupe import greedy_first
from ..operators.ranking import row_numbers
from ..operators.relational import diff, first_per_key, lookup_two_keys, merge_newer
from ..session import join_small, table
from .registry import query

# one spelling of the rules in SQL, for the checks
_HITS = {c: " + ".join(f"(contains(t, '{w}'))::int" for w in ws) for c, ws in rules.CATEGORY_KEYWORDS.items()}
_LEVEL = "case when {0} >= 85 then 5 when {0} >= 70 then 4 when {0} >= 50 then 3 when {0} >= 30 then 2 else 1 end"
_KEY = r"regexp_replace(regexp_replace(replace(lower(title), 'ß', 'ss'), '\s+-\s+[^-]{2,40}$', ''), '[^\p{L}\p{N}_]+', '', 'g')"
_SCORE = 'coalesce("aiReview".importanceScore, score, 0)'
_LVL = f'coalesce("aiReview".importanceLevel, {_LEVEL.format(_SCORE)})'


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "items")


def scored(df: DataFrame) -> DataFrame:
    """Items with the review's score and level where there is one, else their own."""
    score = F.coalesce("aiReview.importanceScore", "score", F.lit(0))
    return df.withColumn("eff_score", score).withColumn("eff_level", F.coalesce("aiReview.importanceLevel", text.level(score)))


@query("select day, count(*) as n_items, max(score) as top_score from items group by day")
def a01_items_per_day(spark, d):
    return items(spark, d).groupBy("day").agg(F.count("*").alias("n_items"), F.max("score").alias("top_score"))


@query("select substr(id, 1, 2) as prefix, count(distinct id) as n_ids, min(id) as first_id, max(id) as last_id from items group by 1")
def a02_locator_prefixes(spark, d):
    return items(spark, d).groupBy(F.substring("id", 1, 2).alias("prefix")).agg(F.countDistinct("id").alias("n_ids"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("select tag, count(*) as n from (select unnest(tags) as tag from items) where length(tag) > 1 group by tag order by n desc, tag")
def a03_topic_counts(spark, d):
    tags = items(spark, d).select(F.explode("tags").alias("tag")).where(F.length("tag") > 1)
    return tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag")


@query(f"with t as (select tag, count(*) as k from (select unnest(tags) as tag from items) where length(tag) > 1 group by 1) select count(*) as n, count(*) filter (where {_LVL} = 5) as n_top, count(*) filter (where {_LVL} = 1) as n_low, count(distinct source) as n_sources, " + ", ".join(f"count(*) filter (where {_LVL} = {k}) as level_{k}" for k in range(1, 6)) + ", (select tag from t order by k desc, tag limit 1) as top_topic from items")
def a04_feed_metrics(spark, d):
    """The feed in one row: sizes, levels as a histogram, the topic with most rows."""
    of = lambda k: F.count_if(F.col("eff_level") == k)
    m = scored(items(spark, d)).agg(F.count("*").alias("n"), of(5).alias("n_top"), of(1).alias("n_low"), F.countDistinct("source").alias("n_sources"), *[of(k).alias(f"level_{k}") for k in range(1, 6)])
    topics = items(spark, d).select(F.explode("tags").alias("tag")).where(F.length("tag") > 1).groupBy("tag").count()
    return m.join(topics.orderBy(F.desc("count"), "tag").limit(1).select(F.col("tag").alias("top_topic")), F.lit(True), "left")


@query("with c as (select k.category, count(i.row_id) as n from (values ('agent'), ('benchmark'), ('release'), ('industry')) k(category) left join items i on i.category = k.category group by 1) select category, n, greatest(5, floor(100 * n / greatest(1, max(n) over ())))::int as bar from c")
def a05_category_bars(spark, d):
    kinds = spark.createDataFrame([(c,) for c in ("agent", "benchmark", "release", "industry")], "category string")
    c = kinds.join(items(spark, d).groupBy("category").count(), "category", "left").select("category", F.coalesce("count", F.lit(0)).alias("n"))
    top = F.greatest(F.lit(1), F.max("n").over(Window.partitionBy()))
    return c.withColumn("bar", F.greatest(F.lit(5), F.floor(F.lit(100) * F.col("n") / top)).cast("int"))


@query("select s.source, coalesce(n, 0) as n_items from sources s full join (select source, count(*) as n from items where source in (select source from sources) group by 1) i on i.source = s.source")
def a06_source_counts(spark, d):
    s = table(spark, d, "sources").select("source")
    n = items(spark, d).groupBy("source").agg(F.count("*").alias("n"))
    return s.join(n, "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("n_items"))


@query("with d as (select day, count(*) as n from items where day is not null group by 1) select 'year' as span, substr(day::varchar, 1, 4) as name, sum(n)::bigint as n_items, count(*) as n_days from d group by 2 union all select 'month', substr(day::varchar, 1, 7), sum(n)::bigint, count(*) from d group by 2 union all select 'day', day::varchar, n, 1 from d")
def a07_calendar_rollup(spark, d):
    """Rows per year, month and day: days are counted once, the longer spans from them."""
    days = items(spark, d).where("day is not null").groupBy("day").count().withColumn("t", F.col("day").cast("string"))
    spans = F.explode(F.array(*[F.struct(F.lit(n).alias("span"), F.substring("t", 1, k).alias("name")) for n, k in (("year", 4), ("month", 7), ("day", 10))]))
    return days.select(spans.alias("s"), "count").groupBy("s.span", "s.name").agg(F.sum("count").alias("n_items"), F.count("*").alias("n_days"))


@query("select batch_no, count(*) as n_rows, count(distinct source) as n_sources, count(*) filter (where summary is null or summary = '') as n_no_summary from items group by 1")
def a08_rows_per_batch(spark, d):
    return items(spark, d).groupBy("batch_no").agg(F.count("*").alias("n_rows"), F.countDistinct("source").alias("n_sources"), F.count_if(F.col("summary").isNull() | (F.col("summary") == "")).alias("n_no_summary"))


@query(f"select category, level, n from (select category, {_LVL} as level, count(*) as n from items group by grouping sets ((category, {_LVL}), (category)))")
def a11_subtotals(spark, d):
    df = scored(items(spark, d)).select("category", F.col("eff_level").alias("level"))
    return df.groupingSets([["category", "level"], ["category"]], "category", "level").agg(F.count("*").alias("n"))


@query("select id, count(*) as n_rows, min(row_id) as first_row, max(row_id) as last_row from items group by id having count(*) > 1")
def a21_repeated_ids(spark, d):
    return items(spark, d).groupBy("id").agg(F.count("*").alias("n_rows"), F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row")).where("n_rows > 1")


@query("select coalesce(\"articleKind\", 'none') as kind, count(*) as n, sum(case when \"releaseFeed\" then 1 else 0 end)::bigint as n_release_feed from items group by 1")
def a22_kind_counts(spark, d):
    return items(spark, d).groupBy(F.coalesce("articleKind", F.lit("none")).alias("kind")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("releaseFeed"), 1).otherwise(0)).alias("n_release_feed"))


@query(f"select row_id, id, title, url, source, category, score, signal, level, evidence from (select *, {_LVL} as level, \"aiReview\".evidenceLevel as evidence, row_number() over (partition by id order by row_id) as r from items) where r = 1")
def proj02_index_rows(spark, d):
    df = scored(items(spark, d)).select("row_id", "id", "title", "url", "source", "category", "score", "signal", F.col("eff_level").alias("level"), F.col("aiReview.evidenceLevel").alias("evidence"))
    return first_per_key(df, ["id"], [F.col("row_id")])


@query(f"select row_id, title, coalesce(nullif(category, ''), 'industry') as category, {_SCORE} as score, {_LVL} as level, substr(coalesce(nullif(\"summaryZh\", ''), summary, ''), 1, 160) as summary from items")
def proj03_search_entries(spark, d):
    df = scored(items(spark, d))
    pick = F.coalesce(F.when(F.col("summaryZh") != "", F.col("summaryZh")), "summary", F.lit(""))
    return df.select("row_id", "title", F.coalesce(F.when(F.col("category") != "", F.col("category")), F.lit("industry")).alias("category"), F.col("eff_score").alias("score"), F.col("eff_level").alias("level"), F.substring(pick, 1, 160).alias("summary"))


_COMPACT = r"substr(trim(regexp_replace(coalesce({0}, ''), '[\s\x{{a0}}\x{{3000}}]+', ' ', 'g')), 1, {1})"


@query(f"select row_id, {_COMPACT.format('title', 300)} as title, {_COMPACT.format('source', 80)} as source, {_COMPACT.format('summary', 700)} as summary from items")
def proj04_model_input(spark, d):
    return items(spark, d).select("row_id", text.compact(F.col("title"), 300).alias("title"), text.compact(F.col("source"), 80).alias("source"), text.compact(F.col("summary"), 700).alias("summary"))


@query(f"select row_id, {_SCORE} as score, least(5, greatest(1, {_LVL})) as level, coalesce(nullif(\"aiReview\".category, ''), category) as category, coalesce(nullif(\"summaryZh\", ''), summary, '') as summary, array_to_string(coalesce(tags, [])[1:5], '|') as tags from items")
def proj06_effective_fields(spark, d):
    shown = F.coalesce(F.when(F.col("summaryZh") != "", F.col("summaryZh")), "summary", F.lit(""))
    tags = F.array_join(F.slice(F.coalesce("tags", F.array().cast("array<string>")), 1, 5), "|")
    return scored(items(spark, d)).select("row_id", F.col("eff_score").alias("score"), F.least(F.lit(5), F.greatest(F.lit(1), "eff_level")).alias("level"), F.coalesce(F.when(F.col("aiReview.category") != "", F.col("aiReview.category")), "category").alias("category"), shown.alias("summary"), tags.alias("tags"))


@query("select row_id, substr('From ' || coalesce(nullif(source, ''), 'a public source') || ': ' || title || case when len(coalesce(tags, [])) > 0 then ' (' || array_to_string(tags[1:3], ', ') || ')' else '' end, 1, 260) as summary from items where summary is null or summary = ''")
def proj11_fallback_summary(spark, d):
    df = items(spark, d).where(F.col("summary").isNull() | (F.col("summary") == ""))
    source = F.coalesce(F.when(F.col("source") != "", F.col("source")), F.lit("a public source"))
    topics = F.when(F.size(F.coalesce("tags", F.array().cast("array<string>"))) > 0, F.concat(F.lit(" ("), F.array_join(F.slice("tags", 1, 3), ", "), F.lit(")"))).otherwise("")
    return df.select("row_id", F.substring(F.concat(F.lit("From "), source, F.lit(": "), "title", topics), 1, 260).alias("summary"))


@query("select i.row_id from items i join batches b using (batch_no) left join sources s on s.source = i.source where i.published_ts is not null and (s.source is not null and s.feed_max_age_days is null or i.published_ts >= b.polled_at - to_days(coalesce(s.feed_max_age_days, 120)))")
def f01_age_cutoff(spark, d):
    s = table(spark, d, "sources").select("source", "feed_max_age_days", F.lit(True).alias("known"))
    df = join_small(items(spark, d).select("row_id", "batch_no", "source", "published_ts").join(table(spark, d, "batches").select("batch_no", "polled_at"), "batch_no"), s, ["source"])
    age = F.coalesce("feed_max_age_days", F.lit(120))
    fresh = F.col("published_ts") >= F.col("polled_at") - F.make_interval(days=age)
    return df.where(F.col("published_ts").isNotNull() & ((F.col("known") & F.col("feed_max_age_days").isNull()) | fresh)).select("row_id")


@query("select row_id from items where regexp_matches(lower(url), '^https?://') and (contains(lower(url), '/2015/') or contains(lower(url), '/blog/')) and not contains(lower(url), 'release')")
def f02_address_filter(spark, d):
    return items(spark, d).where(filters.allowed(F.col("url"), ["/2015/", "/blog/"], ["release"])).select("row_id")


@query(r"select row_id, regexp_extract(title, '\d+(?:\.\d+)+') as version, case when regexp_matches(title, '(^| )v?0\.\d') then 'pre' when regexp_matches(title, ' \d+\.\d+\.[1-9]\d*') then 'patch' when regexp_matches(title, '\d+\.0( |:|$)') then 'major' else 'minor' end as step from items where regexp_matches(title, '\d+(?:\.\d+)+')")
def f03_version_kind(spark, d):
    t = F.col("title")
    step = F.when(t.rlike(r"(^| )v?0\.\d"), "pre").when(t.rlike(r" \d+\.\d+\.[1-9]\d*"), "patch").when(t.rlike(r"\d+\.0( |:|$)"), "major").otherwise("minor")
    return items(spark, d).where(t.rlike(r"\d+(?:\.\d+)+")).select("row_id", F.regexp_extract(t, r"\d+(?:\.\d+)+", 0).alias("version"), step.alias("step"))


@query("select row_id from items where contains(lower(concat_ws(' ', coalesce(source, ''), coalesce(\"sourceDomain\", ''))), 'forum') or contains(lower(concat_ws(' ', coalesce(source, ''), coalesce(\"sourceDomain\", ''))), 'blog')")
def f07_community(spark, d):
    return items(spark, d).where(filters.from_community(F.col("source"), F.col("sourceDomain"), ["forum", "Blog"])).select("row_id")


@query(f"select row_id, {_LVL} as level from items where category in ('agent', 'release') and {_LVL} >= 3 and contains(lower(concat_ws(' ', coalesce(title, ''), coalesce(summary, ''), coalesce(source, ''))), 'open') and contains(lower(concat_ws(' ', coalesce(title, ''), coalesce(summary, ''), coalesce(source, ''))), 'weights') and day between date '2015-10-01' and date '2015-10-31'")
def f30_feed_filter(spark, d):
    df = scored(items(spark, d))
    return filters.feed(df, F.col("eff_level"), ["agent", "release"], None, 3, "Open weights", ("2015-10-01", "2015-10-31")).select("row_id", F.col("eff_level").alias("level"))


@query("select row_id from items where source in (select source from sources where official) and day between date '2015-10-01' and date '2015-10-31'")
def f30_curated(spark, d):
    """The curated view: sources picked by the catalogue, within a range of days."""
    picked = table(spark, d, "sources").where("official").select("source")
    return filters.feed(items(spark, d), F.lit(0), days=("2015-10-01", "2015-10-31")).join(picked, "source", "left_semi").select("row_id")


@query("select row_id, day from items where day between date '2015-10-02' and date '2015-10-08'")
def f31_calendar_range(spark, d):
    return items(spark, d).where(F.col("day").between("2015-10-02", "2015-10-08")).select("row_id", "day")


@query("select row_id, \"sourceDomain\" from items where lower(\"sourceDomain\") = 'trokovareleases.invalid' or suffix(lower(\"sourceDomain\"), '.trokovareleases.invalid') or lower(\"sourceDomain\") = 'deminotes.test' or suffix(lower(\"sourceDomain\"), '.deminotes.test')")
def f32_domain_match(spark, d):
    return items(spark, d).where(filters.under(F.lower("sourceDomain"), ["trokovareleases.invalid", "deminotes.test"])).select("row_id", "sourceDomain")


@query("with h as (select id, url, row_id from items where batch_no <= 3), n as (select row_id, id, url from items where batch_no > 3), a as (select id, min(row_id) as r from h group by id), b as (select url, min(row_id) as r from h group by url) select n.row_id, coalesce(a.r, b.r) as known_row from n left join a using (id) left join b using (url) where coalesce(a.r, b.r) is not null")
def j01_history_lookup(spark, d):
    rows = items(spark, d).select("row_id", "id", "url", "batch_no")
    history = rows.where("batch_no <= 3").select("id", "url", F.col("row_id").alias("known_row"))
    return lookup_two_keys(rows.where("batch_no > 3"), history, "id", "url", "known_row").where("known_row is not null").select("row_id", "known_row")


@query("with f as (select *, row_number() over (partition by id, batch_no > 3 order by row_id) as r from items), n as (select * from f where r = 1 and batch_no > 3), o as (select * from f where r = 1 and batch_no <= 3) select coalesce(n.id, o.id) as id, coalesce(n.title, o.title) as title, coalesce(n.url, o.url) as url, coalesce(o.score, n.score) as score, coalesce(o.signal, n.signal) as signal from n full join o on n.id = o.id")
def j02_merge_history(spark, d):
    cols = ["id", "title", "url", "score", "signal"]
    rows = items(spark, d).select(*cols, "row_id", "batch_no")
    new = first_per_key(rows.where("batch_no > 3"), ["id"], [F.col("row_id")]).select(*cols)
    old = first_per_key(rows.where("batch_no <= 3"), ["id"], [F.col("row_id")]).select(*cols)
    return merge_newer(new, old, "id", ["score", "signal"])


@query("select i.row_id, a.article_no from items i join (select id, min(article_no) as article_no from articles group by id) a using (id)")
def j03_hydrate(spark, d):
    records = table(spark, d, "articles").groupBy("id").agg(F.min("article_no").alias("article_no"))
    return items(spark, d).select("row_id", "id").join(records, "id").select("row_id", "article_no")


@query("select row_id from items where url not in (select url from articles where url is not null)")
def j04_block_list(spark, d):
    return items(spark, d).select("row_id", "url").join(table(spark, d, "articles").select("url"), "url", "left_anti").select("row_id")


@query()
def j04_blocked_addresses(spark, d):
    """Rows whose address, in its one spelling on both sides, is not among the archived ones. Tested on spellings."""
    gone = table(spark, d, "articles").select(canonical_urls(F.col("url")).alias("c")).where("c is not null").distinct()
    return items(spark, d).select("row_id", canonical_urls(F.col("url")).alias("c")).join(gone, "c", "left_anti").select("row_id")


@query()
def j01_canonical_lookup(spark, d):
    """The row of history with the same id, else with the same address in its one spelling. Tested on spellings."""
    rows = items(spark, d).select("row_id", "id", canonical_urls(F.col("url")).alias("u"), "batch_no")
    history = rows.where("batch_no <= 3").select("id", "u", F.col("row_id").alias("known_row"))
    return lookup_two_keys(rows.where("batch_no > 3"), history, "id", "u", "known_row").where("known_row is not null").select("row_id", "known_row")


@query("with s as (select id, bool_or(coalesce(body, '') <> '') as has_body, count(*) as n from articles group by id) select i.row_id, case when s.id is null then 'none' when s.n > 1 and has_body then 'complete' when has_body then 'partial' else 'none' end as status from items i left join s using (id)")
def j05_status_join(spark, d):
    s = table(spark, d, "articles").groupBy("id").agg(F.bool_or(F.coalesce("body", F.lit("")) != "").alias("has_body"), F.count("*").alias("n"))
    status = F.when(F.col("has_body").isNull(), "none").when((F.col("n") > 1) & F.col("has_body"), "complete").when(F.col("has_body"), "partial").otherwise("none")
    return items(spark, d).select("row_id", "id").join(s, "id", "left").select("row_id", status.alias("status"))


@query("select coalesce(i.id, a.id) as id, i.id is not null as in_feed, a.id is not null as in_archive from (select distinct id from items) i full join (select distinct id from articles) a on i.id = a.id")
def j07_feed_and_archive(spark, d):
    i = items(spark, d).select("id").distinct().withColumn("in_feed", F.lit(True))
    a = table(spark, d, "articles").select("id").distinct().withColumn("in_archive", F.lit(True))
    return i.join(a, "id", "full").select("id", F.coalesce("in_feed", F.lit(False)).alias("in_feed"), F.coalesce("in_archive", F.lit(False)).alias("in_archive"))


@query("with u as (select lower(title) as k, min(row_id) as row_id from items group by 1 having count(*) = 1) select a.article_no, u.row_id from articles a join u on lower(a.title) = u.k")
def j10_unique_match(spark, d):
    once = items(spark, d).groupBy(F.lower("title").alias("k")).agg(F.count("*").alias("n"), F.min("row_id").alias("row_id")).where("n = 1")
    return table(spark, d, "articles").select("article_no", F.lower("title").alias("k")).join(once, "k").select("article_no", "row_id")


@query("select row_id, id, coalesce(published_ts, polled_at) >= polled_at - interval 7 day as recent from items join batches using (batch_no)")
def j13_date_fallback(spark, d):
    df = items(spark, d).select("row_id", "id", "batch_no", "published_ts").join(table(spark, d, "batches").select("batch_no", "polled_at"), "batch_no")
    return df.select("row_id", "id", (F.coalesce("published_ts", "polled_at") >= F.col("polled_at") - F.expr("interval 7 days")).alias("recent"))


@query("select side, count(*) as n from (select 'missing' as side, id from items where id not in (select id from articles) group by id union all select 'extra', id from articles where id not in (select id from items) group by id) group by side")
def j15_orphans(spark, d):
    return diff(items(spark, d), table(spark, d, "articles"), ["id"]).groupBy("side").agg(F.count("*").alias("n"))


@query("select l.source, l.batch_no as left_batch, r.batch_no as right_batch from (select distinct source, batch_no from items where source <> '') l join (select distinct source, batch_no from items where source <> '') r on l.source = r.source and r.batch_no = l.batch_no + 1")
def j18_adjacent_pairs(spark, d):
    one = items(spark, d).where("source <> ''").select("source", "batch_no").distinct()
    two = one.select("source", (F.col("batch_no") - 1).alias("batch_no"), F.col("batch_no").alias("right_batch"))
    return one.join(two, ["source", "batch_no"]).select("source", F.col("batch_no").alias("left_batch"), "right_batch")


@query("select row_id, last_value(score ignore nulls) over (partition by batch_no order by row_id rows between unbounded preceding and 1 preceding) as before, first_value(score ignore nulls) over (partition by batch_no order by row_id rows between 1 following and unbounded following) as after from items")
def j19_neighbours(spark, d):
    by = Window.partitionBy("batch_no").orderBy("row_id")
    before = F.last("score", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("score", ignorenulls=True).over(by.rowsBetween(1, Window.unboundedFollowing))
    return items(spark, d).select("row_id", before.alias("before"), after.alias("after"))


@query()
def w01_greedy(spark, d):
    """The greedy loop of an ingest, newest first: a row is taken unless a taken one has its headline or its page. Tested
    against the loop."""
    df = items(spark, d).select("row_id", text.normalized_title(F.col("title")).alias("k"), canonical_urls(F.col("url")).alias("u"), F.unix_micros(F.col("published_ts").cast("timestamp")).alias("at"))
    return greedy_first(df.where("k <> ''"), ["k", "u"], F.struct((-F.coalesce("at", F.lit(0))).alias("at"), "row_id"), "row_id").select("row_id")


@query(f"select row_id, k from (select row_id, {_KEY} as k, row_number() over (partition by {_KEY} order by row_id) as r from items) where r = 1")
def w01_first_headline(spark, d):
    """The case of one key: the first row of each headline."""
    df = items(spark, d).select("row_id", text.normalized_title(F.col("title")).alias("k"))
    return df.groupBy("k").agg(F.min("row_id").alias("row_id"))


@query("select row_id, r from (select row_id, row_number() over (partition by batch_no order by coalesce(summary, '') = '' desc, row_id) as r from items) where r <= 5")
def w04_budget(spark, d):
    by = Window.partitionBy("batch_no").orderBy(F.desc(F.coalesce("summary", F.lit("")) == ""), "row_id")
    return items(spark, d).select("row_id", F.row_number().over(by).alias("r")).where("r <= 5")


@query("select row_id, 'b' || lpad(row_number() over (partition by batch_no order by row_id)::varchar, 4, '0') as block_id from items where summary <> ''")
def w06_ordinals(spark, d):
    by = Window.partitionBy("batch_no").orderBy("row_id")
    return items(spark, d).where("summary <> ''").select("row_id", F.concat(F.lit("b"), F.lpad(F.row_number().over(by).cast("string"), 4, "0")).alias("block_id"))


@query("select row_id, row_number() over (partition by category, summary is null order by score desc nulls last, row_id) as position from items")
def w07_queue_position(spark, d):
    """The place of each row in its queue: queues are few and large, so none is sorted by one task."""
    df = items(spark, d).select("row_id", "category", "score", F.col("summary").isNull().alias("no_summary"))
    return row_numbers(df, ["category", "no_summary"], [F.desc_nulls_last("score"), F.col("row_id")]).select("row_id", "position")


@query("select source, id, first_row from (select source, id, min(row_id) as first_row from items where source <> '' group by 1, 2)")
def w10_ordered_distinct(spark, d):
    return items(spark, d).where("source <> ''").groupBy("source", "id").agg(F.min("row_id").alias("first_row"))


@query("select source, row_id, score from (select source, row_id, score, row_number() over (partition by source order by score desc nulls last, published_ts desc nulls last, length(coalesce(summary, '')) desc, row_id) as r from items where source <> '') where r = 1")
def w11_best_per_source(spark, d):
    df = items(spark, d).where("source <> ''").select("source", "row_id", "score", "published_ts", F.length(F.coalesce("summary", F.lit(""))).alias("n"))
    return first_per_key(df, ["source"], [F.desc_nulls_last("score"), F.desc_nulls_last("published_ts"), F.desc("n"), F.col("row_id")]).select("source", "row_id", "score")


@query("select id, max(row_id) as newest_row, count(*) as n from items group by id")
def w12_newest_per_id(spark, d):
    return items(spark, d).groupBy("id").agg(F.max("row_id").alias("newest_row"), F.count("*").alias("n"))


@query("select url, min(row_id) as row_id, max_by(summary, row_id) filter (where summary <> '') as summary, min_by(score, row_id) filter (where score is not null) as score from items group by url having count(*) > 1")
def w15_backfill_group(spark, d):
    some = lambda c, ok: F.when(ok, F.col("row_id"))
    g = items(spark, d).groupBy("url").agg(
        F.count("*").alias("n"), F.min("row_id").alias("row_id"), F.max_by("summary", some("summary", F.col("summary") != "")).alias("summary"), F.min_by("score", some("score", F.col("score").isNotNull())).alias("score")
    )
    return g.where("n > 1").drop("n")


@query("select row_id, published_ts, score from items order by published_ts desc nulls last, score desc nulls last, row_id limit 50")
def t01_newest(spark, d):
    return items(spark, d).select("row_id", "published_ts", "score").orderBy(F.desc_nulls_last("published_ts"), F.desc_nulls_last("score"), "row_id").limit(50)


@query(f"select row_id, {_LVL} as level, {_SCORE} as score from items order by level desc, score desc, \"publishedAt\" desc nulls last, row_id limit 24")
def t02_hot(spark, d):
    df = scored(items(spark, d)).orderBy(F.desc("eff_level"), F.desc("eff_score"), F.desc_nulls_last("publishedAt"), "row_id").limit(24)
    return df.select("row_id", F.col("eff_level").alias("level"), F.col("eff_score").alias("score"))


@query("select row_id from items order by day desc, row_id limit 8 offset 16")
def t03_page(spark, d):
    return items(spark, d).select("row_id", "day").orderBy(F.desc("day"), "row_id").offset(16).limit(8).select("row_id")


@query("select tag, count(*) as n from (select unnest(tags) as tag from items) group by tag order by n desc, tag limit 10")
def t04_top_topics(spark, d):
    return items(spark, d).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(10)


@query("select day, count(*) as n from items group by day order by day desc")
def t05_days_descending(spark, d):
    return items(spark, d).groupBy("day").agg(F.count("*").alias("n")).orderBy(F.desc("day"))


@query("select row_id from items where \"aiReview\" is null order by published_ts desc nulls last, row_id limit 120")
def t06_review_candidates(spark, d):
    return items(spark, d).where(F.col("aiReview").isNull()).select("row_id", "published_ts").orderBy(F.desc_nulls_last("published_ts"), "row_id").limit(120).select("row_id")


@query("select source, row_id from (select source, row_id, row_number() over (partition by source order by row_id desc) as r from items where source <> '') where r <= 500")
def t11_history_cap(spark, d):
    by = Window.partitionBy("source").orderBy(F.desc("row_id"))
    return items(spark, d).where("source <> ''").select("source", "row_id", F.row_number().over(by).alias("r")).where("r <= 500").drop("r")


@query("select string_agg(source, ',' order by source) as listed from (select distinct source from items where source <> '' order by source limit 100000)")
def t12_sorted_list(spark, d):
    return items(spark, d).where("source <> ''").agg(F.array_join(F.slice(F.sort_array(F.collect_set("source")), 1, 100_000), ",").alias("listed"))


@query("select id from items union all select id from articles")
def u01_union_all(spark, d):
    return items(spark, d).select("id").unionByName(table(spark, d, "articles").select("id"))


@query("select id from items except select id from articles")
def u02_except(spark, d):
    return items(spark, d).select("id").subtract(table(spark, d, "articles").select("id"))


@query("select id from items intersect select id from articles")
def u03_intersect(spark, d):
    return items(spark, d).select("id").intersect(table(spark, d, "articles").select("id"))


@query("select (select count(*) from (select id from articles except select id from items)) = 0 as archive_in_feed, (select count(*) from (select id from items except select id from articles)) = 0 as feed_in_archive")
def u04_set_equality(spark, d):
    gaps = diff(items(spark, d), table(spark, d, "articles"), ["id"])
    return gaps.agg((F.count_if(F.col("side") == "extra") == 0).alias("archive_in_feed"), (F.count_if(F.col("side") == "missing") == 0).alias("feed_in_archive"))


@query("select row_id, len(list_filter(tags, lambda x: x not in ('Agent', 'MCP', 'RAG'))) = 0 as only_core from items where tags is not null")
def u05_subset(spark, d):
    return items(spark, d).where("tags is not null").select("row_id", filters.only(F.col("tags"), ["Agent", "MCP", "RAG"]).alias("only_core"))


@query("select tag, min(row_id) as first_row from (select row_id, unnest(tags) as tag from items) group by tag order by first_row, tag limit 24")
def u07_union_first_wins(spark, d):
    return items(spark, d).select("row_id", F.explode("tags").alias("tag")).groupBy("tag").agg(F.min("row_id").alias("first_row")).orderBy("first_row", "tag").limit(24)


@query(f"select row_id, {_KEY} as title_key, substr(sha1({_KEY}), 1, 12) as computed_id from items")
def x02_title_key(spark, d):
    return items(spark, d).select("row_id", text.normalized_title(F.col("title")).alias("title_key"), text.item_id(F.col("title")).alias("computed_id"))


@query("""with h as (select row_id, trim(title) as t, substr(trim(title), 1, 60) as s from items), c as (select *, length(s) - instr(reverse(s), ' ') as cut from h)
select row_id, case when length(t) <= 60 then t else rtrim(case when instr(s, ' ') > 0 and cut >= 30 then substr(s, 1, cut) else s end, ' ,.;:!?-–—') || '…' end as title from c""")
def x03_shorten(spark, d):
    return items(spark, d).select("row_id", text.shorten(F.col("title"), 60).alias("title"))


@query("with t as (select row_id, hint, lower(title || ' ' || coalesce(summary, '')) as t from (select i.row_id, i.title, i.summary, s.hint from items i left join sources s on s.source = i.source)), s as (select row_id, hint, " + ", ".join(f"{_HITS[c]} + coalesce((hint = '{c}')::int, 0) as {c}" for c in ("agent", "benchmark", "release", "industry")) + ") from t)".replace(")", "", 1) + ", b as (select *, greatest(agent, benchmark, release, industry) as best from s) select row_id, case when best = 0 then coalesce(hint, 'industry') when agent = best then 'agent' when benchmark = best then 'benchmark' when release = best then 'release' else 'industry' end as category from b")
def x05_classify(spark, d):
    df = join_small(items(spark, d).select("row_id", "title", "summary", "source"), table(spark, d, "sources").select("source", "hint"), ["source"])
    df = df.select("row_id", "hint", F.lower(F.concat("title", F.lit(" "), F.coalesce("summary", F.lit("")))).alias("low"))
    return text.with_category(df, "low", "hint").select("row_id", "category")


@query("with t as (select row_id, category, list_filter([" + ", ".join(f"case when regexp_matches(lower(title), '{p}') then '{t}' end" for t, p in rules.TAG_PATTERNS.items()) + "], lambda x: x is not null) as l, case category when 'industry' then '行业应用' when 'agent' then 'Agent' when 'release' then '模型发布' else 'Benchmark' end as own from items where category in ('industry', 'agent', 'release', 'benchmark')) select row_id, array_to_string((case when list_contains(l, own) then l else list_append(l, own) end)[1:5], '|') as tags from t")
def x06_extract_tags(spark, d):
    df = items(spark, d).where(F.col("category").isin(*rules.CATEGORY_TAG))
    return df.select("row_id", F.array_join(text.tags(F.col("title"), F.col("category")), "|").alias("tags"))


@query(r"select row_id, coalesce(try_strptime(\"publishedAt\", '%Y-%m-%dT%H:%M:%SZ'), try_strptime(\"publishedAt\", '%Y-%m-%dT%H:%M:%S.%fZ'))::date::varchar as day from items".replace('\\"', '"'))
def x07_parse_date(spark, d):
    t = F.col("publishedAt")
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"), F.try_to_timestamp(t))
    return items(spark, d).select("row_id", F.date_format(iso, "yyyy-MM-dd").alias("day"))


@query("with t as (select row_id, lower(title || ' ' || coalesce(summary, '')) as t, greatest(0, epoch(polled_at - published_ts) / 3600) as h, coalesce(official, false) as o, len(coalesce(tags, [])) as n from items join batches using (batch_no) left join sources using (source) where published_ts is not null) select row_id, least(100, 48 + greatest(0, 18 - floor(h / 8)) + case when o then 18 else 0 end + least(14, (n - 1) * 4) + case when contains(t, 'release') or contains(t, 'launch') or contains(t, 'benchmark') or contains(t, '发布') or contains(t, '开源') then 6 else 0 end)::int as score from t")
def x08_rule_score(spark, d):
    df = items(spark, d).where("published_ts is not null").select("row_id", "batch_no", "source", "published_ts", "tags", "title", "summary").join(table(spark, d, "batches").select("batch_no", "polled_at"), "batch_no")
    df = join_small(df, table(spark, d, "sources").select("source", "official"), ["source"])
    hours = (F.unix_micros(F.col("polled_at").cast("timestamp")) - F.unix_micros(F.col("published_ts").cast("timestamp"))) / 1e6 / 3600
    n = F.size(F.coalesce("tags", F.array().cast("array<string>")))
    return df.select("row_id", text.rule_score(hours, F.coalesce("official", F.lit(False)), n, F.concat("title", F.lit(" "), F.coalesce("summary", F.lit("")))).alias("score"))


@query("select row_id, substr(sha1(title), 1, 12) as short_id, sha256(url) as url_hash, substr(sha256(url), 1, 16) as media_key from items")
def x09_hash_ids(spark, d):
    return items(spark, d).select("row_id", F.substring(F.sha1("title"), 1, 12).alias("short_id"), F.sha2("url", 256).alias("url_hash"), F.substring(F.sha2("url", 256), 1, 16).alias("media_key"))


@query(r"select row_id, length(regexp_replace(coalesce(summary, ''), '\s+', '', 'g')) as visible, regexp_matches(coalesce(summary, ''), '[\x{4e00}-\x{9fff}]') as has_han from items")
def x19_visible_length(spark, d):
    s = F.coalesce("summary", F.lit(""))
    return items(spark, d).select("row_id", text.visible_length(s).alias("visible"), s.rlike("[一-鿿]").alias("has_han"))


@query("select row_id, greatest(0, least(100, coalesce(score, 0))) as clamped, " + _LEVEL.format("coalesce(score, 0)") + " as level, case when coalesce(score, 0) >= 82 then 'high' when coalesce(score, 0) >= 68 then 'medium' else 'normal' end as signal from items")
def x25_levels(spark, d):
    s = F.coalesce("score", F.lit(0))
    return items(spark, d).select("row_id", F.greatest(F.lit(0), F.least(F.lit(100), s)).alias("clamped"), text.level(s).alias("level"), text.signal(s).alias("signal"))


_DIMS = ", ".join(f'"aiReview".dimensions.{x} as d{i}' for i, x in enumerate(rules.DIMENSIONS))
_SUM = "+".join(f"d{i}" for i in range(6))
_LOW = ", ".join(f"floor(d{i} * 49 / greatest(1, s))::int as l{i}" for i in range(6))


@query(
    f"with a as (select row_id, {_DIMS} from items where \"aiReview\" is not null), b as (select *, {_SUM} as s from a), c as (select *, {_LOW} from b), r as (select *, 49 - ({'+'.join(f'l{i}' for i in range(6))}) as rest from c) select row_id, "
    + ", ".join(f"case when s <= 49 then d{i} else l{i} + case when l{i} < d{i} and {'+'.join(f'(l{j} < d{j})::int' for j in range(i + 1))} <= rest then 1 else 0 end end as {x}" for i, x in enumerate(rules.DIMENSIONS))
    + " from r where s is not null"
)
def x24_cap_dimensions(spark, d):
    df = items(spark, d).where(F.col("aiReview").isNotNull())
    dims = [F.col(f"aiReview.dimensions.{x}") for x in rules.DIMENSIONS]
    total = sum(dims[1:], dims[0])
    return df.where(total.isNotNull()).select("row_id", *[c.alias(x) for c, x in zip(text.cap_to(dims, F.lit(49)), rules.DIMENSIONS)])


@query("select row_id, substr(\"publishedAt\", 1, 4) as y, substr(\"publishedAt\", 6, 2) as m, substr(\"publishedAt\", 9, 2) as d from items")
def x29_date_parts(spark, d):
    p = F.col("publishedAt")
    return items(spark, d).select("row_id", F.substring(p, 1, 4).alias("y"), F.substring(p, 6, 2).alias("m"), F.substring(p, 9, 2).alias("d"))


@query("with c as (select unnest(generate_series(date_trunc('week', date '2015-10-01'), date_trunc('week', date '2015-10-01') + interval 41 day, interval 1 day))::date as day) select c.day, count(i.row_id) as n from c left join items i on i.day = c.day group by 1")
def x30_calendar_grid(spark, d):
    cells = spark.sql("select explode(sequence(date_trunc('WEEK', date'2015-10-01'), date_trunc('WEEK', date'2015-10-01') + interval 41 days, interval 1 day)) as t").select(F.to_date("t").alias("day"))
    n = items(spark, d).groupBy("day").count()
    return cells.join(n, "day", "left").select("day", F.coalesce("count", F.lit(0)).alias("n"))


@query("select row_id, case when h < 1 then 'now' when h < 24 then floor(h)::int || ' h' when h < 168 then floor(h / 24)::int || ' d' else 'older' end as label from (select row_id, epoch(polled_at - published_ts) / 3600 as h from items join batches using (batch_no) where published_ts <= polled_at)")
def x42_relative_time(spark, d):
    df = items(spark, d).join(table(spark, d, "batches").select("batch_no", "polled_at"), "batch_no").where("published_ts <= polled_at")
    h = (F.unix_micros(F.col("polled_at").cast("timestamp")) - F.unix_micros(F.col("published_ts").cast("timestamp"))) / 1e6 / 3600
    label = F.when(h < 1, "now").when(h < 24, F.concat(F.floor(h).cast("string"), F.lit(" h"))).when(h < 168, F.concat(F.floor(h / 24).cast("string"), F.lit(" d"))).otherwise("older")
    return df.select("row_id", label.alias("label"))


@query("select 'duplicate_id_in_batch' as problem, count(*) as n from (select batch_no, id from items group by 1, 2 having count(*) > 1) union all select 'bad_id', count(*) from items where not regexp_full_match(id, '[0-9a-f]{12}') union all select 'no_title', count(*) from items where coalesce(title, '') = '' union all select 'batch_size', count(*) from (select b.batch_no from batches b left join items i using (batch_no) group by b.batch_no, b.n_rows having count(i.row_id) <> b.n_rows) union all select 'archive_without_item', count(*) from (select distinct id from articles where id not in (select id from items))")
def v01_violations(spark, d):
    df = items(spark, d)
    count = lambda name, x: x.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
    sizes = table(spark, d, "batches").select("batch_no", "n_rows").join(df.groupBy("batch_no").count(), "batch_no", "left").where(F.coalesce("count", F.lit(0)) != F.col("n_rows"))
    out = count("duplicate_id_in_batch", df.groupBy("batch_no", "id").count().where("count > 1"))
    for name, rows in (("bad_id", df.where(~F.col("id").rlike("^[0-9a-f]{12}$"))), ("no_title", df.where(F.coalesce("title", F.lit("")) == "")), ("batch_size", sizes), ("archive_without_item", table(spark, d, "articles").select("id").distinct().join(df.select("id"), "id", "left_anti"))):
        out = out.unionByName(count(name, rows))
    return out


@query("select row_id, id, title from items where title <> trim(title) or regexp_matches(title, '  ')")
def g01_title_trim_plan(spark, d):
    return items(spark, d).where((F.col("title") != F.trim("title")) | F.contains("title", F.lit("  "))).select("row_id", "id", "title")


@query("select row_id, (published_ts at time zone 'UTC' at time zone 'Asia/Shanghai')::date as shanghai_day, (published_ts at time zone 'UTC' at time zone 'America/Los_Angeles')::date as pacific_day, published_ts::date as utc_day from items where published_ts is not null")
def m04_days_in_zone(spark, d):
    at = F.col("published_ts").cast("timestamp")
    zone = lambda z: F.to_date(F.from_utc_timestamp(at, z))
    return items(spark, d).where("published_ts is not null").select("row_id", zone("Asia/Shanghai").alias("shanghai_day"), zone("America/Los_Angeles").alias("pacific_day"), F.to_date(at).alias("utc_day"))


@query("with r as (select *, row_number() over (partition by id order by row_id desc) as z from items) select r.id, r.title, f.published as first_published from r join (select id, min_by(\"publishedAt\", row_id) filter (where \"publishedAt\" is not null) as published from items group by id) f using (id) where z = 1")
def m03_late_update(spark, d):
    g = items(spark, d).groupBy("id").agg(F.max_by("title", "row_id").alias("title"), F.min_by("publishedAt", F.when(F.col("publishedAt").isNotNull(), F.col("row_id"))).alias("first_published"))
    return g.select("id", "title", "first_published")


@query("select id, batch_no, row_id from (select *, row_number() over (partition by id order by batch_no desc, row_id desc) as r from items) where r = 1 and id not in (select id from articles)")
def m11_not_yet_done(spark, d):
    newest = items(spark, d).groupBy("id").agg(F.max(F.struct("batch_no", "row_id")).alias("x")).select("id", "x.batch_no", "x.row_id")
    return newest.join(table(spark, d, "articles").select("id"), "id", "left_anti")
