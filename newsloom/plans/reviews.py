"""Queries over releases and reviews: routine releases, checked reviews, records as an ingest finishes them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import releases, reviews, rules, text
from ..session import join_small, table
from .feed import _LEVEL, items
from .registry import query

_SQ = releases.in_sql
_COMMUNITY = "(" + " or ".join(f"contains(lower(concat_ws(' ', coalesce(source, ''), coalesce(\"sourceDomain\", ''))), '{w}')" for w in rules.COMMUNITY) + ")"
_FLAG = '"releaseFeed"'


@query(f"select row_id, {_SQ(releases.SQL_FEED_TAG, 'title')} as routine from items where title is not null")
def f04_routine_feed_tag(spark, d):
    return items(spark, d).where("title is not null").select("row_id", releases.routine_feed_tag(F.col("title")).alias("routine"))


@query(f"select row_id, {_SQ(releases.SQL_BUILD, 'title')} as build, {_SQ(releases.SQL_BUILD, 'title')} or {_SQ(releases.SQL_FEED_TAG, 'title')} as dropped from items where title is not null")
def f05_bare_build(spark, d):
    t = F.col("title")
    return items(spark, d).where("title is not null").select("row_id", releases.bare_build(t).alias("build"), (releases.bare_build(t) | releases.routine_feed_tag(t)).alias("dropped"))


@query(f"select row_id from items where {_SQ(releases.SQL_RELEASE, 'title', _FLAG)}")
def f06_routine_release(spark, d):
    return items(spark, d).where(releases.routine_release(F.col("title"), F.col("releaseFeed"))).select("row_id")


# the tests' headlines hold few tags, so the rules are also asked of the versions that headlines name
_TAGS = r"(select row_id, v, unnest(['v' || v, 'Tool ' || v, v || '-rc1', 'pkg==' || v, 'Fix build (#12)', 'b4521', 'Introducing ' || v || ' today']) as t, generate_subscripts([1, 2, 3, 4, 5, 6, 7], 1) as k from (select row_id, regexp_extract(title, '\d+(?:\.\d+)+') as v from items) where v <> '')"


@query(f"select row_id, k, {_SQ(releases.SQL_VERSION, 't')} as version, {_SQ(releases.SQL_FEED_TAG, 't')} as feed_tag, {_SQ(releases.SQL_BUILD, 't')} as build, {_SQ(releases.SQL_RELEASE, 't', 'k % 2 = 0')} as routine from {_TAGS}")
def f03_release_rules(spark, d):
    v = F.col("v")
    made = F.array(F.concat(F.lit("v"), v), F.concat(F.lit("Tool "), v), F.concat(v, F.lit("-rc1")), F.concat(F.lit("pkg=="), v), F.lit("Fix build (#12)"), F.lit("b4521"), F.concat(F.lit("Introducing "), v, F.lit(" today")))
    df = items(spark, d).select("row_id", F.regexp_extract("title", r"\d+(?:\.\d+)+", 0).alias("v")).where("v <> ''").select("row_id", F.posexplode(made).alias("p", "t"))
    t, k = F.col("t"), F.col("p") + 1
    return df.select("row_id", k.alias("k"), releases.routine_version(t).alias("version"), releases.routine_feed_tag(t).alias("feed_tag"), releases.bare_build(t).alias("build"), releases.routine_release(t, k % 2 == 0).alias("routine"))


_REASON = f"case when \"aiReview\".importanceLevel = 1 then 'importance-1' when {_SQ(releases.SQL_RELEASE, 'title', _FLAG)} or (coalesce(source, '') like '%Releases' and coalesce({_SQ(releases.SQL_FEED_TAG, 'title')}, false)) then 'routine-release' end"


@query(f"select row_id, reason from (select row_id, {_REASON} as reason from items) where reason is not null")
def f09_purge_reason(spark, d):
    reason = releases.purge_reason(F.col("title"), F.col("source"), F.col("releaseFeed"), F.col("aiReview.importanceLevel"))
    return items(spark, d).select("row_id", reason.alias("reason")).where("reason is not null")


@query(f"select row_id from items where {_SQ(releases.SQL_RELEASE, 'title', _FLAG)} and (\"aiReview\".importanceScore > 49 or \"aiReview\".importanceLevel > 2)")
def f38_recap_needed(spark, d):
    over = (F.col("aiReview.importanceScore") > 49) | (F.col("aiReview.importanceLevel") > 2)
    return items(spark, d).where(releases.routine_release(F.col("title"), F.col("releaseFeed")) & over).select("row_id")


_D = {n: f"least({m}, greatest(0, coalesce(\"aiReview\".dimensions.{n}, 0)))" for n, m in rules.DIMENSION_LIMITS.items()}


def _in(value: str, allowed: list[str], other: str) -> str:
    low = f"lower(trim(coalesce({value}, '')))"
    return f"case when {low} in ({', '.join(repr(a) for a in allowed)}) then {low} else '{other}' end"


def _capped_sql(source: str, keep: str) -> str:
    names = list(rules.DIMENSION_LIMITS)
    total = " + ".join(names)
    steps = "".join(f", ({n} * most // tot)::int as f_{n}" for n in names)
    used = {}
    for i, n in enumerate(names):
        used[n] = " + ".join(f"(f_{x} < {x})::int" for x in names[: i + 1])
    out = ", ".join(f"(case when tot <= most or tot = 0 then {n} else f_{n} + (f_{n} < {n} and {used[n]} <= most - ({' + '.join('f_' + x for x in names)}))::int end)::int as {n}" for n in names)
    return f"(select {keep}, {out} from (select *{steps} from (select *, {total} as tot from {source})))"


_RAW = f"""(select row_id, {', '.join(f'{x} as {n}' for n, x in _D.items())}, {_in('"aiReview".evidenceLevel', rules.EVIDENCE, 'partial')} as evidence, {_in('"aiReview".informationType', rules.INFORMATION, 'analysis')} as information,
coalesce("aiReview".isRelevant, false) as relevant, coalesce("articleKind" = 'community', false) or {_COMMUNITY} as forum, {_SQ(releases.SQL_RELEASE, 'title', _FLAG)} as routine from items where "aiReview" is not null)"""
_MOST = f"""(select *, least(100, case when not relevant then 29 else 100 end, case when information = 'rehash' then 49 else 100 end, case when information = 'rumor' then 69 else 100 end, case when impact < 20 or evidence <> 'clear' then 84 else 100 end, case when forum and evidence <> 'clear' then 59 else 100 end, case when routine then 49 else 100 end) as most from {_RAW})"""
_SUM = " + ".join(rules.DIMENSION_LIMITS)


@query(f"select *, ({_SUM})::int as score, {_LEVEL.format('(' + _SUM + ')')} as level from {_capped_sql(_MOST, 'row_id, evidence, information')}")
def x26_reviews(spark, d):
    """Reviews as they are stored: values checked, dimensions capped to the least ceiling that applies."""
    r = lambda f: F.col(f"aiReview.{f}")
    df = items(spark, d).where(F.col("aiReview").isNotNull())
    forum = F.coalesce(F.col("articleKind") == "community", F.lit(False)) | text.community(F.col("source"), F.col("sourceDomain"))
    dims = {n: r(f"dimensions.{n}") for n in rules.DIMENSION_LIMITS}
    return reviews.review(df, ["row_id"], dims, r("isRelevant"), r("informationType"), r("evidenceLevel"), forum, releases.routine_release(F.col("title"), F.col("releaseFeed")))


_C = r"trim(regexp_replace(coalesce({0}, ''), '[\s\x{{a0}}\x{{3000}}]+', ' ', 'g'))"
_OWN = f"substr({_C.format('summary')}, 1, 360)"
_S = "coalesce(\"summaryZh\", '')"
_LV = _LEVEL.format("coalesce(score, 0)")


@query(
    f"select row_id, case when {_LV} < 4 or length(regexp_replace({_S}, '\\s+', '', 'g')) >= 100 then {_S} else substr(trim(concat_ws('。', nullif(rtrim({_S}, '。； '), ''), case when {_OWN} <> '' and not contains({_S}, {_OWN}) then '原始信息显示：' || rtrim({_OWN}, '。； ') end, "
    f"'该消息由' || coalesce(nullif(substr({_C.format('source')}, 1, 60), ''), '原始信息源') || '发布，主题为“' || substr({_C.format('title')}, 1, 180) || '”', '建议结合原文核对关键数据、适用条件、技术限制与后续更新，以判断其对实际产品和研发决策的影响') || '。'), 1, 700) end as summary from items"
)
def x20_long_summaries(spark, d):
    """Summaries of important records, filled up where they are short."""
    c = F.col
    return items(spark, d).select("row_id", reviews.long_summary(c("summaryZh"), c("title"), c("source"), c("summary"), F.lit(None).cast("string"), text.level(F.coalesce("score", F.lit(0)))).alias("summary"))


@query("with t as (select row_id, unnest(tags) as tag, generate_subscripts(tags, 1) as k from items where score >= 70), v as (select row_id, lower(trim(tag)) as f, min(k) as k, arg_min(trim(tag), k) as term from t where regexp_matches(tag, '[A-Za-z]') group by 1, 2), r as (select *, row_number() over (partition by row_id order by k) as n from v) select row_id, n::int as n, term from r where n <= 8")
def x21_glossary(spark, d):
    """Terms of important records, each once, with an explanation (here the same for all, as the tables hold none)."""
    terms = F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.struct(t.alias("term"), F.lit("说明").alias("explanationZh")))
    got = items(spark, d).select("row_id", F.posexplode(reviews.glossary(terms, text.level(F.coalesce("score", F.lit(0))))).alias("p", "g"))
    return got.select("row_id", (F.col("p") + 1).alias("n"), F.col("g.term").alias("term"))


@query(
    "with b as (select row_id, title, summary, trim(lower(title || ' ' || coalesce(summary, ''))) as t, hint, coalesce(official, false) as o, greatest(0, epoch(polled_at - published_ts) / 3600) as h from items join batches using (batch_no) left join sources using (source) where published_ts is not null), k as (select *, "
    + ", ".join("(" + " + ".join(f"contains(t, '{w}')::int" for w in rules.CATEGORY_KEYWORDS[c]) + f" + coalesce((hint = '{c}')::int, 0)) as n_{c}" for c in ("agent", "benchmark", "release", "industry"))
    + " from b), c as (select *, case when greatest(n_agent, n_benchmark, n_release, n_industry) = 0 then coalesce(hint, 'industry') when n_agent = greatest(n_agent, n_benchmark, n_release, n_industry) then 'agent' when n_benchmark = greatest(n_benchmark, n_release, n_industry) then 'benchmark' when n_release >= n_industry then 'release' else 'industry' end as category from k), g as (select *, list_filter(["
    + ", ".join(f"case when regexp_matches(t, '{p}') then '{n}' end" for n, p in rules.TAG_PATTERNS.items())
    + "], lambda x: x is not null) as l, case category when 'industry' then '行业应用' when 'agent' then 'Agent' when 'release' then '模型发布' else 'Benchmark' end as own from c), s as (select *, (case when list_contains(l, own) then l else list_append(l, own) end)[1:5] as tags from g), p as (select *, least(100, 48 + greatest(0, 18 - floor(h / 8)) + case when o then 18 else 0 end + least(14, (len(tags) - 1) * 4) + case when contains(t, 'release') or contains(t, 'launch') or contains(t, 'benchmark') or contains(t, '发布') or contains(t, '开源') then 6 else 0 end)::int as score from s)"
    + f" select row_id, category, array_to_string(tags, '|') as tags, score, case when score >= 82 then 'high' when score >= 68 then 'medium' else 'normal' end as signal, coalesce(nullif(summary, ''), '{rules.DEFAULT_SUMMARY}') as summary from p"
)
def proj01_finalized(spark, d):
    """Rows as an ingest finishes them: category, tags, score, signal, summary."""
    df = items(spark, d).where("published_ts is not null").select("row_id", "batch_no", "title", "summary", "source", "published_ts").join(table(spark, d, "batches").select("batch_no", "polled_at"), "batch_no")
    df = join_small(df, table(spark, d, "sources").select("source", "hint", "official"), ["source"])
    hours = (F.unix_micros(F.col("polled_at").cast("timestamp")) - F.unix_micros(F.col("published_ts").cast("timestamp"))) / 3.6e9
    both = F.trim(F.concat("title", F.lit(" "), F.coalesce("summary", F.lit(""))))
    df = df.withColumn("both", F.lower(both))
    both = F.col("both")
    df = text.with_category(df, "both", "hint").withColumn("tags", text.tags(both, F.col("category"), True))
    df = df.withColumn("score", text.rule_score(hours, F.coalesce("official", F.lit(False)), F.size("tags"), both))
    shown = F.when(F.coalesce("summary", F.lit("")) != "", F.col("summary")).otherwise(rules.DEFAULT_SUMMARY)
    return df.select("row_id", "category", F.array_join("tags", "|").alias("tags"), "score", text.signal(F.col("score")).alias("signal"), shown.alias("summary"))


_PLAN = f"(select *, {_SQ(releases.SQL_RELEASE, 'title', _FLAG)} and (\"aiReview\".importanceScore > 49 or \"aiReview\".importanceLevel > 2) as due, 49 as most, {', '.join(f'coalesce(\"aiReview\".dimensions.{n}, 0) as {n}' for n in rules.DIMENSION_LIMITS)} from items where \"aiReview\" is not null)"


@query(f"select row_id, ({_SUM})::int as score, {_LEVEL.format('(' + _SUM + ')')} as level from {_capped_sql('(select * from ' + _PLAN + ' where due)', 'row_id')}")
def g04_recapped(spark, d):
    """Reviews of routine releases above the ceiling, capped."""
    dims = [F.coalesce(F.col(f"aiReview.dimensions.{n}"), F.lit(0)).alias(n) for n in rules.DIMENSION_LIMITS]
    over = (F.col("aiReview.importanceScore") > 49) | (F.col("aiReview.importanceLevel") > 2)
    due = items(spark, d).where(F.col("aiReview").isNotNull() & releases.routine_release(F.col("title"), F.col("releaseFeed")) & over).select("row_id", *dims, F.lit(49).alias("_most"))
    return reviews.capped(due, ["row_id"], "_most").select("row_id", "score", text.level(F.col("score")).alias("level"))


@query(f"with gone as (select id, min({_REASON.replace('title', 'items.title')}) as reason from items group by id having count({_REASON}) = count(*)) select a.article_no, g.reason from articles a join gone g using (id)")
def g03_purge_dependents(spark, d):
    """Archived records all of whose feed rows leave, with the reason."""
    reason = releases.purge_reason(F.col("title"), F.col("source"), F.col("releaseFeed"), F.col("aiReview.importanceLevel"))
    gone = items(spark, d).select("id", reason.alias("reason")).groupBy("id").agg(F.min("reason").alias("reason"), F.count("reason").alias("k"), F.count("*").alias("n")).where("k = n")
    return table(spark, d, "articles").select("article_no", "id").join(gone.select("id", "reason"), "id").select("article_no", "reason")

