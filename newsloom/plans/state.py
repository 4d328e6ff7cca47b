"""Queries over the state of records: blocks and their completion, lookups between stores, maintenance plans, validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import repair, rules
from ..operators.pacing import paced
from ..session import table
from .archive import articles
from .feed import _LVL, items, scored
from .registry import query


def newest(df: DataFrame, key: str, order: str, *fields: str) -> DataFrame:
    """The fields of the row with the highest ``order`` per key, without moving whole rows."""
    got = df.groupBy(key).agg(F.max_by(F.struct(order, *fields), order).alias("_s"))
    return got.select(key, "_s.*")


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """Lines of archived bodies with the hash of what they say: article_no, id, block_no, hash."""
    lines = articles(spark, d).select("article_no", "id", F.posexplode(F.split("body", "\n")).alias("p", "t")).where(F.trim("t") != "")
    return lines.select("article_no", "id", (F.col("p") + 1).alias("block_no"), F.sha2("t", 256).alias("hash"))


_BLOCKS = "b as (select article_no, id, block_no, sha256(t) as hash from (select article_no, id, unnest(string_split(body, chr(10))) as t, generate_subscripts(string_split(body, chr(10)), 1) as block_no from articles) where trim(t) <> ''), n as (select id, max(article_no) as newest from articles group by id)"


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Blocks of each record's newest snapshot, and the distinct (id, hash) of its older ones."""
    last = articles(spark, d).groupBy("id").agg(F.max("article_no").alias("newest"))
    b = blocks(spark, d).join(last, "id")
    return b.where("article_no = newest").drop("newest"), b.where("article_no < newest").select("id", "hash").distinct()


@query(f"with {_BLOCKS}, cur as (select b.* from b join n on b.id = n.id and article_no = newest), old as (select distinct b.id, hash from b join n on b.id = n.id and article_no < newest) select cur.article_no, count(*) as n_blocks, count(old.hash) as n_done from cur left join old on cur.id = old.id and cur.hash = old.hash group by 1")
def j09_completed_blocks(spark, d):
    """Blocks of the newest snapshots, and how many of them an older snapshot of the record has completed, by id and hash."""
    cur, old = _halves(spark, d)
    return cur.join(old.withColumn("done", F.lit(True)), ["id", "hash"], "left").groupBy("article_no").agg(F.count("*").alias("n_blocks"), F.count("done").alias("n_done"))


@query(f"with {_BLOCKS}, cur as (select b.* from b join n on b.id = n.id and article_no = newest), old as (select distinct b.id, hash from b join n on b.id = n.id and article_no < newest) select cur.article_no, block_no from cur join articles a using (article_no) where (cur.id, cur.hash) not in (select id, hash from old) and not (coalesce(a.note, '') = 'retry-later' and a.\"fetchedAt\" > (select max(\"fetchedAt\") from articles where \"fetchedAt\" < '2015-10-04'))")
def f25_pending_blocks(spark, d):
    """Blocks that are not completed and whose next attempt is due."""
    cur, old = _halves(spark, d)
    now = articles(spark, d).where(F.col("fetchedAt") < "2015-10-04").agg(F.max("fetchedAt").alias("now"))
    state = articles(spark, d).select("article_no", "note", "fetchedAt").join(F.broadcast(now), F.lit(True), "left")
    due = state.where(~F.coalesce((F.col("note") == "retry-later") & (F.col("fetchedAt") > F.col("now")), F.lit(False))).select("article_no")
    return cur.join(old, ["id", "hash"], "left_anti").join(due, "article_no", "left_semi").select("article_no", "block_no")


@query(f"with {_BLOCKS}, cur as (select b.* from b join n on b.id = n.id and article_no = newest), old as (select distinct b.id, hash from b join n on b.id = n.id and article_no < newest) select cur.article_no, count(*) filter (where old.hash is null) as n_open, count(*) filter (where old.hash is null) > 0 and any_value(a.\"contentKind\") <> 'summary' as claimable from cur join articles a using (article_no) left join old on cur.id = old.id and cur.hash = old.hash group by 1")
def f26_claimable(spark, d):
    """Records with work left that may be claimed."""
    cur, old = _halves(spark, d)
    left = cur.join(old.withColumn("done", F.lit(True)), ["id", "hash"], "left").groupBy("article_no").agg(F.count_if(F.col("done").isNull()).alias("n_open"))
    return left.join(articles(spark, d).select("article_no", "contentKind"), "article_no").select("article_no", "n_open", ((F.col("n_open") > 0) & (F.col("contentKind") != "summary")).alias("claimable"))


@query("select coalesce(s.source, i.source) as source, s.source is not null as known, coalesce(n, 0) as n_items from sources s full join (select source, count(*) as n from items where source is not null group by 1) i on i.source = s.source")
def j06_catalogue_outer(spark, d):
    """Every source of the catalogue or of the feed, with its rows."""
    s = table(spark, d, "sources").select("source", F.lit(True).alias("known"))
    n = items(spark, d).where("source is not null").groupBy("source").agg(F.count("*").alias("n"))
    return s.join(n, "source", "full").select("source", F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("n", F.lit(0)).alias("n_items"))


@query("select row_id, kind, version from items join (select id, arg_max(\"contentKind\", article_no) as kind, arg_max(\"archiveVersion\", article_no) as version from articles group by id) using (id)")
def j11_updates_by_id(spark, d):
    """Updates applied by id: the last one wins, unknown ids are ignored."""
    last = newest(articles(spark, d), "id", "article_no", F.col("contentKind").alias("kind"), F.col("archiveVersion").alias("version"))
    return items(spark, d).select("row_id", "id").join(last, "id").select("row_id", "kind", "version")


@query("select row_id, article_no from items join (select id, arg_max(article_no, (length(body), article_no)) as article_no, max(length(body)) as n from articles group by id) using (id) where coalesce(summary, '') = '' and n >= 280")
def j12_without_summary(spark, d):
    """Rows without a summary whose record has a body to summarise."""
    size = F.length("body")
    best = articles(spark, d).groupBy("id").agg(F.max_by("article_no", F.struct(size, "article_no")).alias("article_no"), F.max(size).alias("n")).where("n >= 280")
    return items(spark, d).where(F.coalesce("summary", F.lit("")) == "").select("row_id", "id").join(best, "id").select("row_id", "article_no")


@query("with r as (select id from articles union select substr(sha1(source), 1, 12) from sources union select id from items) select id, case when id in (select id from items) then 'item' when id in (select id from articles) then 'archive' else 'not_found' end as found from r")
def j14_requests(spark, d):
    """Where a requested id is found: among the feed's rows, else in the archive, else nowhere."""
    i, a = items(spark, d).select("id").distinct(), articles(spark, d).select("id").distinct()
    asked = a.unionByName(table(spark, d, "sources").select(F.substring(F.sha1("source"), 1, 12).alias("id"))).unionByName(i).distinct()
    out = asked.join(i.withColumn("i", F.lit(True)), "id", "left").join(a.withColumn("a", F.lit(True)), "id", "left")
    return out.select("id", F.when(F.col("i"), "item").when(F.col("a"), "archive").otherwise("not_found").alias("found"))


@query("select row_id, coalesce(m.r, i.url) as url from items i left join (select \"originalUrl\" as o, min(\"resolvedUrl\") as r from articles where coalesce(\"resolvedUrl\", '') <> '' group by 1) m on m.o = i.url")
def j16_redirects(spark, d):
    """Addresses through the table of resolved ones, themselves where it has none."""
    m = articles(spark, d).where(F.coalesce("resolvedUrl", F.lit("")) != "").groupBy(F.col("originalUrl").alias("url")).agg(F.min("resolvedUrl").alias("r"))
    return items(spark, d).select("row_id", "url").join(m, "url", "left").select("row_id", F.coalesce("r", "url").alias("url"))


@query("select row_id, h.id is not null as seen, h.at from items i left join (select id, max(\"fetchedAt\") as at from articles group by id) h using (id)")
def j20_seen(spark, d):
    h = articles(spark, d).groupBy("id").agg(F.max("fetchedAt").alias("at"), F.lit(True).alias("seen"))
    return items(spark, d).select("row_id", "id").join(h, "id", "left").select("row_id", F.coalesce("seen", F.lit(False)).alias("seen"), "at")


_MEDIA = "m as (select article_no, i.id as id, i.src as src, lower(regexp_extract(i.src, '\\.([A-Za-z0-9]+)(?:\\?|$)', 1)) as t, lower(regexp_extract(i.\"originalUrl\", '\\.([A-Za-z0-9]+)(?:\\?|$)', 1)) as o from (select article_no, unnest(images) as i from articles))"


def media(spark: SparkSession, d: str) -> DataFrame:
    kind = lambda c: F.lower(F.regexp_extract(c, r"\.([A-Za-z0-9]+)(?:\?|$)", 1))
    return articles(spark, d).select("article_no", F.explode("images").alias("i")).select("article_no", "i.id", "i.src", kind("i.src").alias("t"), kind("i.originalUrl").alias("o"))


@query(f"with {_MEDIA}, r as (select id, t, min(src) as src from m where id is not null group by 1, 2) select m.article_no, m.id, r.src from m join r on r.id = m.id and r.t = m.t")
def j21_media_by_type(spark, d):
    """Media by id and type: a resource of another type doesn't serve."""
    m = media(spark, d)
    r = m.where("id is not null").groupBy("id", "t").agg(F.min("src").alias("src"))
    return m.select("article_no", "id", "t").join(r, ["id", "t"]).select("article_no", "id", "src")


_RULES = {"version": r"\d+\.\d+", "question": r"\?|？", "cites": "Institute|Labs|Research", "numbers": r"\d{2,}"}


@query("select * from (" + " union all ".join(f"select '{n}' as rule, count(*) as n, count(*) filter (where regexp_matches(title, '{p}')) as passed from items where title is not null" for n, p in _RULES.items()) + ")")
def j22_graded(spark, d):
    """Every headline against a table of rules, in one pass."""
    t = items(spark, d).where("title is not null").select("title")
    hit = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col("title").rlike(p).cast("long").alias("ok")) for n, p in _RULES.items()]))
    return t.select(hit.alias("h")).groupBy("h.rule").agg(F.count("*").alias("n"), F.sum("h.ok").alias("passed"))


@query("select article_no, (length(body) - length(replace(body, '```', ''))) // 3 % 2 = 1 or (\"archiveVersion\" < 2 and \"fetchedAt\" < '2015-10-08') as needs from articles where body is not null")
def f19_needs_refresh(spark, d):
    """Bodies with an open fence, and records of an old version whose last fetch is old enough."""
    fences = (F.length("body") - F.length(F.replace("body", F.lit("```")))) / 3
    return articles(spark, d).where("body is not null").select("article_no", ((fences.cast("int") % 2 == 1) | ((F.col("archiveVersion") < 2) & (F.col("fetchedAt") < "2015-10-08"))).alias("needs"))


@query("with s as (select id, article_no, length(coalesce(body, '')) as n, (length(coalesce(body, '')) - length(replace(coalesce(body, ''), '```', ''))) // 3 % 2 = 1 as damaged from articles), o as (select id, arg_min(n, article_no) as old_n, arg_max(n, article_no) as new_n, arg_max(damaged, article_no) as damaged, count(*) as k from s group by id) select id, new_n >= greatest(280, 0.55 * old_n) and not damaged as acceptable from o where k > 1")
def f20_acceptable_refresh(spark, d):
    """Whether a newer snapshot may replace the older one: long enough and not damaged."""
    body = F.coalesce("body", F.lit(""))
    s = articles(spark, d).select("id", "article_no", F.length(body).alias("n"), (((F.length(body) - F.length(F.replace(body, F.lit("```")))) / 3).cast("int") % 2 == 1).alias("damaged"))
    g = s.groupBy("id").agg(F.min_by("n", "article_no").alias("old_n"), F.max_by("n", "article_no").alias("new_n"), F.max_by("damaged", "article_no").alias("damaged"), F.count("*").alias("k"))
    return g.where("k > 1").select("id", ((F.col("new_n") >= F.greatest(F.lit(280.0), F.col("old_n") * 0.55)) & ~F.col("damaged")).alias("acceptable"))


_PRIVATE = r"^(localhost|127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2\d|3[01])\.|0\.|\[)"


@query(f"select row_id, regexp_matches(url, '^https?://[^/]+', 'i') and not regexp_matches(lower(regexp_extract(url, '^https?://([^/]+)', 1, 'i')), '{_PRIVATE}') as public from items where url is not null")
def f28_public_address(spark, d):
    """Addresses of the web that don't name a private host; names aren't resolved."""
    host = F.lower(F.regexp_extract("url", "(?i)^https?://([^/]+)", 1))
    return items(spark, d).where("url is not null").select("row_id", (F.col("url").rlike("(?i)^https?://[^/]+") & ~host.rlike(_PRIVATE)).alias("public"))


@query("select a.article_no, a.\"bodyFormatVersion\" = n.v and sha256(coalesce(a.body, '')) = sha256(coalesce(n.body, '')) and n.kind <> 'summary' as current from articles a join (select id, arg_max(\"bodyFormatVersion\", article_no) as v, arg_max(coalesce(body, ''), article_no) as body, arg_max(\"contentKind\", article_no) as kind from articles group by id) n using (id)")
def f35_layout_current(spark, d):
    """Whether what was laid out is what the newest snapshot shows: version, hash of the body, status."""
    a = articles(spark, d).select("article_no", "id", F.col("bodyFormatVersion").alias("v"), F.sha2(F.coalesce("body", F.lit("")), 256).alias("h"), F.col("contentKind").alias("kind"))
    n = newest(a, "id", "article_no", F.col("v").alias("nv"), F.col("h").alias("nh"), F.col("kind").alias("nkind")).drop("article_no")
    return a.join(n, "id").select("article_no", ((F.col("v") == F.col("nv")) & (F.col("h") == F.col("nh")) & (F.col("nkind") != "summary")).alias("current"))


@query("select batch_no, count(*) as n_providers, coalesce(bool_or(n >= 5), false) as continues from (select batch_no, \"aiReview\".provider as p, count(*) as n from items where \"aiReview\" is not null group by 1, 2) group by 1")
def f36_continues(spark, d):
    """Batches in which a provider was productive up to its budget, so that a further run would go on."""
    per = items(spark, d).where(F.col("aiReview").isNotNull()).groupBy("batch_no", F.col("aiReview.provider").alias("p")).agg(F.count("*").alias("n"))
    return per.groupBy("batch_no").agg(F.count("*").alias("n_providers"), F.coalesce(F.bool_or(F.col("n") >= 5), F.lit(False)).alias("continues"))


@query("select id, max(row_id) as row_id from items where regexp_matches(title, '^(Release|Inside|How) ') and source in (select source from sources where official) group by id")
def f37_authorised(spark, d):
    """The newest request per id among those whose title asks for it and whose sender may ask."""
    may = table(spark, d, "sources").where("official").select("source")
    return items(spark, d).where(F.col("title").rlike("^(Release|Inside|How) ")).join(may, "source", "left_semi").groupBy("id").agg(F.max("row_id").alias("row_id"))


@query(f"select row_id from items left join sources using (source) order by case when official then 0 else 1 end, case when coalesce(\"summaryZh\", '') <> '' then 0 else 1 end, {_LVL} desc, \"published_ts\" desc nulls last, row_id limit 200")
def t08_candidates(spark, d):
    """The next candidates: official ones first, then those in progress, then by level and date."""
    df = scored(items(spark, d).select("row_id", "source", "summaryZh", "published_ts", "score", "aiReview"))
    s = table(spark, d, "sources").select("source", "official")
    df = df.join(s, "source", "left")
    order = [F.when(F.col("official"), 0).otherwise(1), F.when(F.coalesce("summaryZh", F.lit("")) != "", 0).otherwise(1), F.desc("eff_level"), F.desc_nulls_last("published_ts"), F.col("row_id")]
    return df.orderBy(*order).limit(200).select("row_id")


_LABELS = {"Filed under": "分类", "Share this": "分享", "Related reading": "相关阅读", "Listen to this article": "收听本文"}
_LSQL = reduce(lambda s, kv: f"regexp_replace({s}, '(?m)^{kv[0]}([:：]|$)', '{kv[1]}\\1', 'g')", _LABELS.items(), "body")


@query(f"select article_no, {_LSQL} as body from articles where body is not null")
def x47_localised_labels(spark, d):
    """Labels at the start of a line in the reader's language."""
    body = reduce(lambda c, kv: F.regexp_replace(c, f"(?m)^{kv[0]}([:：]|$)", f"{kv[1]}$1"), _LABELS.items(), F.col("body"))
    return articles(spark, d).where("body is not null").select("article_no", body.alias("body"))


def tally(checks: dict[str, DataFrame]) -> DataFrame:
    """One row per check with the number of its violations."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n") for name, df in checks.items()])


_CATS = ", ".join(f"'{c}'" for c in rules.CATEGORIES)
_V01 = {
    "bad_category": f"from items where category is not null and category not in ({_CATS})",
    "bad_signal": "from items where signal is not null and signal not in ('high', 'medium', 'normal')",
    "score_range": "from items where score < 0 or score > 100",
    "bad_address": "from items where not regexp_matches(coalesce(url, ''), '^https?://')",
    "level_range": 'from items where "aiReview".importanceLevel < 1 or "aiReview".importanceLevel > 5',
    "no_date": "from items where published_ts is null",
    "ahead_of_poll": "from items join batches using (batch_no) where published_ts > polled_at",
    "unknown_batch": "from items where batch_no not in (select batch_no from batches)",
    "no_body": "from articles where coalesce(body, '') = ''",
    "repeated_address": "from (select url from articles group by url having count(*) > 1)",
    "image_without_source": "from (select unnest(images) as i from articles) where i.src is null or i.src = ''",
    "repeated_row": "from (select row_id from items group by 1 having count(*) > 1)",
    "ids_in_disagreement": "from (select id from items group by id having count(distinct title) > 1)",
}


@query(" union all ".join(f"select '{n}' as problem, count(*) as n {q}" for n, q in _V01.items()))
def v01_store_checks(spark, d):
    """Further checks of the stores: values, ranges, dates, duplicates, references."""
    i, a, b = items(spark, d), articles(spark, d), table(spark, d, "batches")
    level = F.col("aiReview.importanceLevel")
    img = a.select(F.explode("images").alias("i"))
    return tally(
        {
            "bad_category": i.where(F.col("category").isNotNull() & ~F.col("category").isin(*rules.CATEGORIES)), "bad_signal": i.where(F.col("signal").isNotNull() & ~F.col("signal").isin("high", "medium", "normal")), "score_range": i.where("score < 0 or score > 100"),
            "bad_address": i.where(~F.coalesce("url", F.lit("")).rlike("^https?://")), "level_range": i.where((level < 1) | (level > 5)), "no_date": i.where("published_ts is null"), "ahead_of_poll": i.select("batch_no", "published_ts").join(b, "batch_no").where("published_ts > polled_at"),
            "unknown_batch": i.select("batch_no").where("batch_no is not null").join(b.select("batch_no"), "batch_no", "left_anti"), "no_body": a.where(F.coalesce("body", F.lit("")) == ""), "repeated_address": a.groupBy("url").count().where("count > 1"),
            "image_without_source": img.where("i.src is null or i.src = ''"), "repeated_row": i.groupBy("row_id").count().where("count > 1"), "ids_in_disagreement": i.groupBy("id").agg(F.count_distinct("title").alias("k")).where("k > 1"),
        }
    )


_Z = "coalesce(\"summaryZh\", '')"
_V02 = {
    "not_chinese": f"from items where {_Z} <> '' and not regexp_matches({_Z}, '[一-鿿]')",
    "too_long": f"from items where length({_Z}) > 700",
    "no_record": f"from items where {_Z} <> '' and id not in (select id from articles)",
    "several_per_record": f"from (select id from items where {_Z} <> '' group by id having count(distinct \"summaryZh\") > 1)",
    "same_as_original": f"from items where {_Z} <> '' and \"summaryZh\" = summary",
    "untrimmed": f"from items where {_Z} <> trim({_Z})",
    "missing_for_important": f"from items where score >= 70 and {_Z} = ''",
}


@query(" union all ".join(f"select '{n}' as problem, count(*) as n {q}" for n, q in _V02.items()))
def v02_translation_checks(spark, d):
    """Checks of translated summaries: language, length, references, agreement, copies."""
    i = items(spark, d).withColumn("z", F.coalesce("summaryZh", F.lit("")))
    some = i.where("z <> ''")
    return tally(
        {
            "not_chinese": some.where(~F.col("z").rlike("[一-鿿]")), "too_long": i.where(F.length("z") > 700), "no_record": some.select("id").join(articles(spark, d).select("id"), "id", "left_anti"),
            "several_per_record": some.groupBy("id").agg(F.count_distinct("summaryZh").alias("k")).where("k > 1"), "same_as_original": some.where("z = summary"), "untrimmed": i.where(F.col("z") != F.trim("z")), "missing_for_important": i.where("score >= 70 and z = ''"),
        }
    )


@query("with l as (select article_no, trim(unnest(string_split(body, chr(10)))) as t from articles), s as (select article_no, count(*) as n, count(*) filter (where length(t) <= 24 and not regexp_matches(t, '[.!?。！？]$')) as m from l where t <> '' group by 1) select article_no, n, m from s where n >= 5 and m * 10 >= n * 6")
def g02_navigation_shells(spark, d):
    """Records to demote: most of their lines are entries of a menu."""
    t = articles(spark, d).select("article_no", F.explode(F.split("body", "\n")).alias("t")).select("article_no", F.trim("t").alias("t")).where("t <> ''")
    s = t.groupBy("article_no").agg(F.count("*").alias("n"), F.count_if((F.length("t") <= 24) & ~F.col("t").rlike("[.!?。！？]$")).alias("m"))
    return s.where("n >= 5 and m * 10 >= n * 6")


@query("select row_id, day as from_day, published_ts::date as to_day from items where published_ts is not null and day is distinct from published_ts::date")
def g05_moved_rows(spark, d):
    """Rows that lie in the partition of another day than they were published."""
    to = F.to_date("published_ts")
    return items(spark, d).where("published_ts is not null").select("row_id", F.col("day").alias("from_day"), to.alias("to_day")).where(~F.col("from_day").eqNullSafe(F.col("to_day")))


@query(f"with {_MEDIA} select src, count(*) as n_uses, count(distinct article_no) as n_records, min(id) as kept from m where coalesce(src, '') <> '' group by 1 having count(*) > 1")
def g06_identical_media(spark, d):
    """Media that several records hold: one id is kept."""
    g = media(spark, d).where(F.coalesce("src", F.lit("")) != "").groupBy("src").agg(F.count("*").alias("n_uses"), F.count_distinct("article_no").alias("n_records"), F.min("id").alias("kept"))
    return g.where("n_uses > 1")


@query(f"with {_MEDIA}, v as (select article_no, src, regexp_replace(src, '[?].*$', '') as name, coalesce(try_cast(nullif(regexp_extract(src, '[?&](?:w|width)=([0-9]+)', 1), '') as int), 0) as w from m where coalesce(src, '') <> '') select article_no, name, arg_max(src, (w, src)) as kept, count(*) as n from v group by 1, 2")
def g07_preview_variants(spark, d):
    """Variants of one picture in a record: the widest is kept."""
    m = media(spark, d).where(F.coalesce("src", F.lit("")) != "")
    w = F.coalesce(F.regexp_extract("src", "[?&](?:w|width)=([0-9]+)", 1).try_cast("int"), F.lit(0))
    v = m.select("article_no", "src", F.regexp_replace("src", "[?].*$", "").alias("name"), w.alias("w"))
    return v.groupBy("article_no", "name").agg(F.max_by("src", F.struct("w", "src")).alias("kept"), F.count("*").alias("n"))


@query(f"with {_MEDIA}, v as (select article_no, regexp_extract(src, '([^/?]+)(?:[?].*)?$', 1) as name, length(src) as w from m where coalesce(src, '') <> '') select name, min(w) as least, count(distinct article_no) as n_records from v group by 1")
def s21_previews(spark, d):
    """Per picture's name its least size over all records, and how many records use it."""
    m = media(spark, d).where(F.coalesce("src", F.lit("")) != "")
    v = m.select("article_no", F.regexp_extract("src", r"([^/?]+)(?:[?].*)?$", 1).alias("name"), F.length("src").alias("w"))
    return v.groupBy("name").agg(F.min("w").alias("least"), F.count_distinct("article_no").alias("n_records"))


@query("select event_id, case when event_type = 'error' then ts + to_microseconds((value * 1000000)::bigint) when event_type = 'purchase' then date_trunc('day', ts) + interval 1 day else ts + interval 30 minute end as resume_at from events where value is not null")
def h02_pauses(spark, d):
    """When work goes on after an event: after the wait it names, on the next day, or in half an hour."""
    ts = F.col("ts")
    named = F.timestamp_micros(F.unix_micros(ts.cast("timestamp")) + (F.col("value") * 1_000_000).cast("decimal(20,0)").cast("long")).cast("timestamp_ntz")
    day = (F.date_trunc("day", ts.cast("timestamp")) + F.expr("interval 1 day")).cast("timestamp_ntz")
    at = F.when(F.col("event_type") == "error", named).when(F.col("event_type") == "purchase", day).otherwise(ts + F.expr("interval 30 minutes"))
    return table(spark, d, "events").where("value is not null").select("event_id", at.alias("resume_at"))


@query("select article_no, coalesce(nullif(note, ''), 'none') as state, case when note = 'retry-later' then 'failed: ' || note else note end as note, case when note = 'retry-later' then 1 else 0 end as attempts from articles")
def h15_failures(spark, d):
    """Records with their failure marked."""
    failed = F.coalesce(F.col("note") == "retry-later", F.lit(False))
    state = F.coalesce(F.when(F.col("note") != "", F.col("note")), F.lit("none"))
    return articles(spark, d).select("article_no", state.alias("state"), F.when(failed, F.concat(F.lit("failed: "), "note")).otherwise(F.col("note")).alias("note"), failed.cast("int").alias("attempts"))


@query("select a.article_no, b.article_no as other from articles a join articles b on a.id = b.id and a.article_no < b.article_no and sha256(a.body) = sha256(b.body) and a.lang is not distinct from b.lang")
def h16_usable(spark, d):
    """Pairs of snapshots of which what was made for one serves the other: same record, language and body."""
    a = articles(spark, d).select("article_no", "id", F.sha2("body", 256).alias("h"), F.coalesce("lang", F.lit("\0")).alias("l"))
    b = a.withColumnRenamed("article_no", "other")
    return a.join(b, ["id", "h", "l"]).where("article_no < other").select("article_no", "other")


@query("with i as (select id, arg_max(title, row_id) as title, arg_max(coalesce(category, ''), row_id) as category, max(row_id) as row_id from items group by id), a as (select id, arg_max(title, article_no) as title, arg_max(length(coalesce(body, '')), article_no) as n_body, max(article_no) as article_no from articles group by id) select coalesce(i.id, a.id) as id, coalesce(i.title, a.title) as title, coalesce(nullif(i.category, ''), 'industry') as category, coalesce(a.n_body, 0) as n_body, i.row_id is not null and a.article_no is not null as updated from i full join a on i.id = a.id")
def k03_upserted(spark, d):
    """The archive after an upsert: the feed's fields win, the archive's others survive, defaults are filled in."""
    i = newest(items(spark, d), "id", "row_id", "title", F.coalesce("category", F.lit("")).alias("category"))
    a = newest(articles(spark, d), "id", "article_no", F.col("title").alias("old_title"), F.length(F.coalesce("body", F.lit(""))).alias("n_body"))
    out = i.join(a, "id", "full")
    kind = F.coalesce(F.when(F.col("category") != "", F.col("category")), F.lit("industry"))
    return out.select("id", F.coalesce("title", "old_title").alias("title"), kind.alias("category"), F.coalesce("n_body", F.lit(0)).alias("n_body"), (F.col("row_id").isNotNull() & F.col("article_no").isNotNull()).alias("updated"))


@query("select row_id, \"aiReview\".importanceScore as score, \"aiReview\".importanceLevel as level, \"aiReview\".dimensions.impact as impact, coalesce(\"aiReview\".evidenceLevel, 'partial') as evidence from items where \"aiReview\" is not null")
def proj05_expanded(spark, d):
    """Flat entries with their review built again as a nested value, and read back."""
    r = F.col("aiReview")
    flat = items(spark, d).where(r.isNotNull()).select("row_id", r["importanceScore"].alias("s"), r["importanceLevel"].alias("l"), r["dimensions"]["impact"].alias("i"), r["evidenceLevel"].alias("e"))
    nested = flat.select("row_id", F.struct(F.col("s").alias("score"), F.col("l").alias("level"), F.struct(F.col("i").alias("impact")).alias("dimensions"), F.coalesce("e", F.lit("partial")).alias("evidence")).alias("review"))
    return nested.select("row_id", "review.score", "review.level", "review.dimensions.impact", "review.evidence")


@query("select article_no, id, 'zh' as language, 'pending' as status, 0 as attempts, sha256(coalesce(body, '')) as body_hash, length(coalesce(body, '')) as n_chars from articles")
def proj07_skeletons(spark, d):
    """A translation's empty record for every snapshot."""
    body = F.coalesce("body", F.lit(""))
    return articles(spark, d).select("article_no", "id", F.lit("zh").alias("language"), F.lit("pending").alias("status"), F.lit(0).alias("attempts"), F.sha2(body, 256).alias("body_hash"), F.length(body).alias("n_chars"))


@query("select \"aiReview\".provider as provider, count(*) as n, count(distinct \"aiReview\".model) as n_models, max(\"aiReview\".reviewedAt) as last_at from items where \"aiReview\".provider is not null group by 1")
def proj12_provider_state(spark, d):
    r = F.col("aiReview")
    return items(spark, d).where(r["provider"].isNotNull()).groupBy(r["provider"].alias("provider")).agg(F.count("*").alias("n"), F.count_distinct(r["model"]).alias("n_models"), F.max(r["reviewedAt"]).alias("last_at"))


@query("select id, length(id) = 12 and regexp_matches(id, '^[0-9a-f]+$') as valid, substr(id, 1, 2) || '/' || id || '.json' as path from (select distinct id from articles)")
def proj08_index_paths(spark, d):
    """Where a record's file lies in a sharded index, and whether its id may name one."""
    ids = articles(spark, d).select("id").distinct()
    return ids.select("id", ((F.length("id") == 12) & F.col("id").rlike("^[0-9a-f]+$")).alias("valid"), F.concat(F.substring("id", 1, 2), F.lit("/"), F.col("id"), F.lit(".json")).alias("path"))


@query()
def x12_block_fences(spark, d):
    """Bodies with every code fence on a line of its own. Tested on golden cases."""
    return articles(spark, d).where("body is not null").select("article_no", repair.each_text(repair.block_fences, F.col("body")).alias("body"))


@query()
def x13_plain_markup(spark, d):
    """Bodies without the mark-up of papers, code untouched. Tested on golden cases."""
    return articles(spark, d).where("body is not null").select("article_no", repair.each_text(repair.normal_body, F.col("body")).alias("body"))


@query()
def x15_broken_up(spark, d):
    """Code blocks of bodies, broken into lines again where they lost them. Tested on golden cases."""
    code = articles(spark, d).select("article_no", F.posexplode(F.regexp_extract_all("body", F.lit(r"```[^\r\n]*\r?\n([\s\S]*?)\r?\n```"), F.lit(1))).alias("p", "code"))
    return code.select("article_no", (F.col("p") + 1).alias("k"), repair.each_text(repair.broken_up, F.col("code")).alias("code"))


@query()
def x46_repaired(spark, d):
    """Damaged bodies put right. Tested on golden cases."""
    return articles(spark, d).where("body is not null").select("article_no", repair.each_text(repair.repaired, F.col("body")).alias("body")).where("body is not null")


@query()
def f15_flattened(spark, d):
    """Bodies with code that lost its line breaks. Tested on golden cases."""
    flat = repair.each_text(repair.flattened, F.col("body"), "boolean")
    return articles(spark, d).where("body is not null").select("article_no", flat.alias("flat")).where("flat").select("article_no")


@query()
def m07_pacing(spark, d):
    """The interval between requests per user after each event, replayed. Tested against a loop."""
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("bad"))
    return paced(e, "user_id", "event_id", "bad", 1.0)


@query(f"with {_MEDIA}, v as (select article_no, id, src, regexp_replace(src, '[?].*$', '') as name, coalesce(try_cast(nullif(regexp_extract(src, '[?&](?:w|width)=([0-9]+)', 1), '') as int), 0) as w from m where coalesce(src, '') <> ''), k as (select article_no, name, arg_max(id, (w, src, id)) as kept from v group by 1, 2), s as (select v.article_no, v.id, k.kept, row_number() over (partition by v.article_no, k.kept order by v.id) as r from v join k on k.article_no = v.article_no and k.name = v.name) select article_no, id as slot, kept, r = 1 as placed from s")
def x40_slots(spark, d):
    """Slots of a layout after variants were collapsed: each shows the variant kept, a medium that is there already stays out."""
    m = media(spark, d).where(F.coalesce("src", F.lit("")) != "")
    w = F.coalesce(F.regexp_extract("src", "[?&](?:w|width)=([0-9]+)", 1).try_cast("int"), F.lit(0))
    v = m.select("article_no", "id", "src", F.regexp_replace("src", "[?].*$", "").alias("name"), w.alias("w"))
    k = v.groupBy("article_no", "name").agg(F.max_by("id", F.struct("w", "src", "id")).alias("kept"))
    first = Window.partitionBy("article_no", "kept").orderBy("id")
    return v.join(k, ["article_no", "name"]).select("article_no", F.col("id").alias("slot"), "kept", (F.row_number().over(first) == 1).alias("placed"))
