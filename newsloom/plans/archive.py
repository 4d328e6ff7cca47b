"""Queries over the archive: stored bodies, their blocks, media and state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules, text
from ..functions.blocks import blocks_udtf_rows, line_blocks
from ..operators import filters
from ..session import table
from .registry import query

_READABLE = ["community", "feed", "page", "reader"]


def articles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles")


@query("select id, count(*) as n_versions, max(article_no) as newest, max(length(coalesce(body, ''))) as longest from articles group by id")
def k03_versions_per_record(spark, d):
    return articles(spark, d).groupBy("id").agg(F.count("*").alias("n_versions"), F.max("article_no").alias("newest"), F.max(F.length(F.coalesce("body", F.lit("")))).alias("longest"))


@query("select id, article_no, coalesce(nullif(\"resolvedUrl\", ''), nullif(\"originalUrl\", ''), url) as address from (select *, row_number() over (partition by id order by length(coalesce(body, '')) desc, article_no) as r from articles) where r = 1")
def k04_best_snapshot(spark, d):
    # bodies are measured before anything is moved
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    slim = articles(spark, d).select("id", "article_no", F.coalesce(some("resolvedUrl"), some("originalUrl"), "url").alias("address"), F.length(F.coalesce("body", F.lit(""))).alias("n"))
    return slim.groupBy("id").agg(F.max_by(F.struct("article_no", "address"), F.struct("n", -F.col("article_no"))).alias("k")).select("id", "k.article_no", "k.address")


@query("select article_no, 'img-' || substr(sha256(i.src), 1, 16) as media_key from (select article_no, unnest(images) as i from articles) where i.src is not null")
def k09_media_keys(spark, d):
    return articles(spark, d).select("article_no", F.explode("images").alias("i")).where("i.src is not null").select("article_no", F.concat(F.lit("img-"), F.substring(F.sha2("i.src", 256), 1, 16)).alias("media_key"))


@query("with o as (select id, min_by(article_no, article_no) as a, min_by(length(coalesce(body, '')), article_no) as n from articles group by id), w as (select id, max(article_no) as b, max_by(length(coalesce(body, '')), article_no) as m from articles group by id having count(*) > 1) select id, a as old_no, b as new_no, m >= greatest(280, 0.55 * n) as accepted from o join w using (id)")
def k11_compare_snapshots(spark, d):
    size = F.length(F.coalesce("body", F.lit("")))
    g = articles(spark, d).groupBy("id").agg(F.count("*").alias("k"), F.min("article_no").alias("old_no"), F.max("article_no").alias("new_no"), F.min_by(size, "article_no").alias("n"), F.max_by(size, "article_no").alias("m"))
    return g.where("k > 1").select("id", "old_no", "new_no", (F.col("m") >= F.greatest(F.lit(280), F.col("n") * 0.55)).alias("accepted"))


@query("select article_no, regexp_extract(url, '^https?://([^/?#:]+)', 1) as host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) as path from articles where url is not null")
def proj10_address_parts(spark, d):
    return articles(spark, d).where("url is not null").select("article_no", F.regexp_extract("url", "^https?://([^/?#:]+)", 1).alias("host"), F.regexp_extract("url", "^https?://[^/?#]+([^?#]*)", 1).alias("path"))


@query("select article_no from articles where (\"contentKind\" = 'summary' and coalesce(note, '') <> 'archive:not attempted') or length(trim(coalesce(body, ''))) < 600")
def f08_thin_records(spark, d):
    thin = ((F.col("contentKind") == "summary") & (F.coalesce("note", F.lit("")) != "archive:not attempted")) | (F.length(F.trim(F.coalesce("body", F.lit("")))) < 600)
    return articles(spark, d).where(thin).select("article_no")


@query("select article_no from articles where not (regexp_extract(lower(url), '^https?://([^/?#:]+)', 1) in ('kefiblog.invalid', 'deminotes.test') or suffix(regexp_extract(lower(url), '^https?://([^/?#:]+)', 1), '.kefiblog.invalid') or suffix(regexp_extract(lower(url), '^https?://([^/?#:]+)', 1), '.deminotes.test')) and length(trim(title)) > 0")
def f10_removed_domain(spark, d):
    gone = filters.under(filters.host_of(F.col("url")), ["kefiblog.invalid", "deminotes.test"])
    return articles(spark, d).where(~gone & F.col("url").isNotNull() & (F.length(F.trim("title")) > 0)).select("article_no")


@query("select article_no, (contains(b, 'search'))::int + (contains(b, 'sign in'))::int + (contains(b, 'archive'))::int + (contains(b, 'about us'))::int as marks from (select article_no, lower(body) as b from articles where length(trim(body)) between 1 and 1500) where (contains(b, 'search'))::int + (contains(b, 'sign in'))::int + (contains(b, 'archive'))::int + (contains(b, 'about us'))::int >= 2")
def f11_menu_shell(spark, d):
    b = F.lower("body")
    marks = reduce(lambda x, y: x + y, [F.contains(b, F.lit(w)).cast("int") for w in ("search", "sign in", "archive", "about us")])
    return articles(spark, d).where(F.length(F.trim("body")).between(1, 1500)).select("article_no", marks.alias("marks")).where("marks >= 2")


@query("select article_no from articles where regexp_matches(lower(url), '^https?://([^/]+\\.)?(mopawire\\.example|zitrireview\\.test)(/|$)')")
def f12_script_hosts(spark, d):
    return articles(spark, d).where(filters.under(filters.host_of(F.col("url")), ["mopawire.example", "zitrireview.test"])).select("article_no")


_LOST = "length(body) - length(replace(body, chr(65533), ''))"
_CONTROL = "length(body) - length(regexp_replace(body, '[\\x{0}-\\x{8}\\x{b}-\\x{1f}]', '', 'g'))"


@query(f"select article_no, {_LOST} as lost, {_CONTROL} as control from articles where {_LOST} >= 3 or {_CONTROL} >= 3")
def f13_corrupted(spark, d):
    lost = F.length("body") - F.length(F.replace("body", F.lit("�"), F.lit("")))
    control = F.length("body") - F.length(F.regexp_replace("body", r"[\x00-\x08\x0b-\x1f]", ""))
    return articles(spark, d).select("article_no", lost.alias("lost"), control.alias("control")).where("lost >= 3 or control >= 3")


@query("select article_no from articles where ((length(body) - length(replace(body, '```', ''))) // 3) % 2 = 1 or regexp_matches(body, '(?m)^.*\\S[ \\t]+```[^\\r\\n`]*')")
def f14_open_fence(spark, d):
    """Bodies with a code fence that is left open or stands within a line."""
    n = (F.length("body") - F.length(F.replace("body", F.lit("```"), F.lit("")))) / 3
    return articles(spark, d).where((n % 2 == 1) | F.col("body").rlike(r"(?m)^.*\S[ \t]+```[^\r\n`]*")).select("article_no")


_MARKUP = r"\\[A-Za-z]{2,}(?:\s*\{|\s|$)|(?:^|[^\\])\$"
_FENCED = r"```[^\r\n]*\r?\n[\s\S]*?\r?\n```"


@query(f"select article_no from articles where regexp_matches(regexp_replace(body, '{_FENCED}', '', 'g'), '{_MARKUP}')")
def f16_markup_left(spark, d):
    """Bodies that show mark-up of papers outside their code."""
    return articles(spark, d).where(F.regexp_replace("body", _FENCED, "").rlike(_MARKUP)).select("article_no")


_NOW = "2015-10-31T00:00:00Z"


@query(f"""with a as (select id, arg_max("contentKind", article_no) as kind, arg_max(coalesce(note, ''), article_no) as note, arg_max("archiveVersion", article_no) as v, arg_max("fetchedAt", article_no) as at from articles group by id)
select i.row_id, case when a.id is null then true when kind <> 'summary' then false when note = 'archive:not attempted' or coalesce(v, 0) < 2 then true else coalesce(i.published_ts >= timestamp '2015-10-01' and try_strptime(a.at, '%Y-%m-%dT%H:%M:%SZ') <= timestamp '2015-10-24', false) end as needs from items i left join a using (id)""")
def f17_needs_archive(spark, d):
    """Rows whose body should be fetched: never stored, or only a summary that was not attempted, is of an old version, or is
    due again (published within 30 days, last attempt 7 days ago)."""
    now = F.lit(_NOW).cast("timestamp")
    a = articles(spark, d).select("id", "article_no", "contentKind", F.coalesce("note", F.lit("")).alias("note"), "archiveVersion", "fetchedAt")
    a = a.groupBy("id").agg(F.max_by(F.struct(F.col("contentKind").alias("kind"), "note", F.col("archiveVersion").alias("v"), F.col("fetchedAt").alias("at")), "article_no").alias("s"))
    df = table(spark, d, "items").select("row_id", "id", "published_ts").join(a, "id", "left")
    due = (F.col("published_ts").cast("timestamp") >= now - F.expr("interval 30 days")) & (F.try_to_timestamp("s.at") <= now - F.expr("interval 7 days"))
    needs = F.when(F.col("s").isNull(), True).when(F.col("s.kind") != "summary", False).when((F.col("s.note") == "archive:not attempted") | (F.coalesce("s.v", F.lit(0)) < 2), True).otherwise(F.coalesce(due, F.lit(False)))
    return df.select("row_id", needs.alias("needs"))


@query("select article_no, note from articles where contains(note, 'Error')")
def f18_failed_notes(spark, d):
    return articles(spark, d).where(F.contains("note", F.lit("Error"))).select("article_no", "note")


@query("select article_no, regexp_count(body, '[A-Za-z]') as latin, regexp_count(body, '[\\x{4e00}-\\x{9fff}]') as han from articles where regexp_count(body, '[A-Za-z]') >= 240 and regexp_count(body, '[\\x{4e00}-\\x{9fff}]') < greatest(80, 0.15 * regexp_count(body, '[A-Za-z]'))".replace("regexp_count(body, ", "len(regexp_extract_all(body, ").replace(")')", ")'))").replace("]')", "]'))"))
def f21_mostly_latin(spark, d):
    df = articles(spark, d).where("body is not null").select("article_no", text.latin(F.col("body")).alias("latin"), text.han(F.col("body")).alias("han"))
    return df.where((F.col("latin") >= 240) & (F.col("han") < F.greatest(F.lit(80), F.col("latin") * 0.15)))


@query("select article_no from (select article_no, len(regexp_extract_all(body, '[A-Za-z]')) as l, len(regexp_extract_all(body, '[\\x{4e00}-\\x{9fff}]')) as h from articles) where l + h > 0 and h >= 0.35 * (l + h)")
def f22_is_chinese(spark, d):
    df = articles(spark, d).select("article_no", text.latin(F.col("body")).alias("l"), text.han(F.col("body")).alias("h"))
    return df.where((F.col("l") + F.col("h") > 0) & (F.col("h") >= (F.col("l") + F.col("h")) * 0.35)).select("article_no")


@query("select article_no from articles where regexp_matches(title, '[\\x{4e00}-\\x{9fff}]')")
def f23_has_han(spark, d):
    return articles(spark, d).where(F.col("title").rlike("[一-鿿]")).select("article_no")


@query("select article_no, i.src from (select article_no, unnest(images) as i from articles) where regexp_matches(lower(i.src), '(logo|icon|avatar|sprite|pixel|badge)') or suffix(lower(i.src), '.svg')")
def f27_chrome_images(spark, d):
    src = F.lower("i.src")
    return articles(spark, d).select("article_no", F.explode("images").alias("i")).where(src.rlike("(logo|icon|avatar|sprite|pixel|badge)") | src.endswith(".svg")).select("article_no", F.col("i.src").alias("src"))


@query("select article_no from articles where regexp_matches(lower(url), '^https?://[^@/]+(/|$|\\?)') and not regexp_matches(lower(url), '[?&](token|key|secret|password|sig)=') and not regexp_matches(lower(url), '^https?://(localhost|127\\.|10\\.|192\\.168\\.)')")
def f29_safe_address(spark, d):
    u = F.lower("url")
    ok = u.rlike(r"^https?://[^@/]+(/|$|\?)") & ~u.rlike(r"[?&](token|key|secret|password|sig)=") & ~u.rlike(r"^https?://(localhost|127\.|10\.|192\.168\.)")
    return articles(spark, d).where(ok).select("article_no")


@query("select article_no, len(list_filter(coalesce(images, []), lambda x: coalesce(trim(x.alt), '') = '')) as no_text, len(list_filter(coalesce(images, []), lambda x: coalesce(x.src, '') = '')) as no_source from articles where len(coalesce(images, [])) > 0 and len(list_filter(images, lambda x: coalesce(trim(x.alt), '') = '' or coalesce(x.src, '') = '')) > 0")
def f34_images_without_text(spark, d):
    bad = lambda c: F.size(F.filter("images", lambda x: F.coalesce(F.trim(x[c]), F.lit("")) == ""))
    return articles(spark, d).where("images is not null").select("article_no", bad("alt").alias("no_text"), bad("src").alias("no_source")).where("no_text + no_source > 0")


@query("with n as (select id, max_by(sha256(coalesce(body, '')), article_no) as h from articles group by id) select a.article_no from articles a join n using (id) where sha256(coalesce(a.body, '')) <> n.h")
def j08_stale_versions(spark, d):
    h = F.sha2(F.coalesce("body", F.lit("")), 256)
    df = articles(spark, d).select("article_no", "id", h.alias("h"))
    newest = df.groupBy("id").agg(F.max_by("h", "article_no").alias("newest"))
    return df.join(newest, "id").where("h <> newest").select("article_no")


@query("select h as body_hash, count(*) as n, min(article_no) as survivor, (count(*) - 1) * max(size) as chars_saved from (select article_no, sha256(body) as h, length(body) as size from articles where body <> '') group by h having count(*) > 1")
def a14_duplicate_bodies(spark, d):
    df = articles(spark, d).where("body <> ''").select("article_no", F.sha2("body", 256).alias("body_hash"), F.length("body").alias("size"))
    return df.groupBy("body_hash").agg(F.count("*").alias("n"), F.min("article_no").alias("survivor"), ((F.count("*") - 1) * F.max("size")).alias("chars_saved")).where("n > 1")


@query("select n_orphans, n_all, round(100.0 * n_orphans / n_all, 2) as share from (select count(*) filter (where id not in (select id from items)) as n_orphans, count(*) as n_all from articles)")
def a15_orphan_share(spark, d):
    known = table(spark, d, "items").select("id").distinct().withColumn("known", F.lit(True))
    g = articles(spark, d).select("id").join(known, "id", "left").agg(F.count_if(F.col("known").isNull()).alias("n_orphans"), F.count("*").alias("n_all"))
    return g.select("n_orphans", "n_all", F.round(F.col("n_orphans") * 100.0 / F.col("n_all"), 2).alias("share"))


@query("select \"contentKind\" as kind, sum(length(body))::bigint as chars, count(*) as n, round(100.0 * sum(length(body)) / sum(sum(length(body))) over (), 3) as share from articles where body is not null group by 1")
def a16_size_shares(spark, d):
    g = articles(spark, d).where("body is not null").groupBy(F.col("contentKind").alias("kind")).agg(F.sum(F.length("body")).alias("chars"), F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("chars") * 100.0 / F.sum("chars").over(Window.partitionBy()), 3))


@query("select regexp_extract(url, '^https?://([^/?#:]+)', 1) as host, count(*) as n, count(*) filter (where coalesce(body, '') = '') as n_empty from articles group by 1")
def a17_plan_counters(spark, d):
    return articles(spark, d).groupBy(F.regexp_extract("url", "^https?://([^/?#:]+)", 1).alias("host")).agg(F.count("*").alias("n"), F.count_if(F.coalesce("body", F.lit("")) == "").alias("n_empty"))


@query("select \"contentKind\" as kind, sum(strlen(coalesce(body, '')))::bigint as bytes, count(*) as files from articles group by 1")
def a19_tree_sizes(spark, d):
    return articles(spark, d).groupBy(F.col("contentKind").alias("kind")).agg(F.sum(F.octet_length(F.coalesce("body", F.lit("")))).cast("long").alias("bytes"), F.count("*").alias("files"))


@query("select state, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 2) as percent from (select case when coalesce(body, '') = '' then 'awaitingBody' when \"bodyFormatVersion\" < 3 then 'pending' when \"contentKind\" = 'summary' then 'partial' else 'complete' end as state from articles) group by state")
def a09_coverage(spark, d):
    state = F.when(F.coalesce("body", F.lit("")) == "", "awaitingBody").when(F.col("bodyFormatVersion") < 3, "pending").when(F.col("contentKind") == "summary", "partial").otherwise("complete")
    g = articles(spark, d).groupBy(state.alias("state")).agg(F.count("*").alias("n"))
    return g.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 2))


@query("select article_no, strlen(body) as bytes from articles where body is not null order by bytes desc, article_no limit 20")
def t10_largest(spark, d):
    return articles(spark, d).where("body is not null").select("article_no", F.octet_length("body").cast("long").alias("bytes")).orderBy(F.desc("bytes"), "article_no").limit(20)


@query("select article_no from articles where \"bodyFormatVersion\" < 3 order by contains(body, '```') desc nulls last, \"publishedAt\" desc nulls last, article_no limit 40")
def t07_refresh_candidates(spark, d):
    df = articles(spark, d).where("bodyFormatVersion < 3").select("article_no", "publishedAt", F.contains("body", F.lit("```")).alias("code"))
    return df.orderBy(F.desc_nulls_last("code"), F.desc_nulls_last("publishedAt"), "article_no").limit(40).select("article_no")


@query("select article_no from articles order by \"fetchedAt\" nulls last, article_no limit 40")
def t09_oldest_first(spark, d):
    return articles(spark, d).select("article_no", "fetchedAt").orderBy(F.asc_nulls_last("fetchedAt"), "article_no").limit(40).select("article_no")


@query("select article_no from articles where coalesce(body, '') <> '' order by \"fetchedAt\" desc nulls last, article_no limit 60")
def t13_newest_fetched(spark, d):
    return articles(spark, d).where(F.coalesce("body", F.lit("")) != "").select("article_no", "fetchedAt").orderBy(F.desc_nulls_last("fetchedAt"), "article_no").limit(60).select("article_no")


@query("select article_no from articles order by note is not null, article_no limit 30")
def t14_untried_first(spark, d):
    return articles(spark, d).select("article_no", "note").orderBy(F.col("note").isNotNull(), "article_no").limit(30).select("article_no")


_RED = "body"
for _p, _l in rules.SECRETS:
    # SQL's patterns have no look-arounds: what stands before is taken along and put back
    _before, _core = _p[3:].split(")", 1)
    _RED = f"regexp_replace({_RED}, '(^|[^{_before[2:-1]}]){_core.rsplit('(?!', 1)[0]}', '\\1{_l}', 'g')"


@query(f"select article_no, {_RED} as body from articles where body is not null")
def x10_redacted(spark, d):
    return articles(spark, d).where("body is not null").select("article_no", text.redact(F.col("body")).alias("body"))


_NOISE = " or ".join(f"contains(lower(l), '{w}')" for w in rules.NOISE_PHRASES)


@query(f"with s as (select article_no, unnest(string_split(body, chr(10))) as l, generate_subscripts(string_split(body, chr(10)), 1) as n from articles), c as (select article_no, n, trim(l) as l from s where length(trim(l)) >= 24 and not ({_NOISE})), f as (select *, row_number() over (partition by article_no, lower(l) order by n) as r from c) select article_no, n::int as line_no, l as block from f where r = 1")
def x11_clean_blocks(spark, d):
    df = articles(spark, d).select("article_no", F.posexplode(F.split("body", "\n")).alias("p", "l")).withColumn("block", F.trim("l"))
    noise = reduce(lambda a, b: a | b, [F.contains(F.lower("l"), F.lit(w)) for w in rules.NOISE_PHRASES])
    kept = df.where((F.length("block") >= 24) & ~noise)
    return kept.groupBy("article_no", F.lower("block").alias("k")).agg(F.min("p").alias("p"), F.min_by("block", "p").alias("block")).select("article_no", (F.col("p") + 1).alias("line_no"), "block")


_LIMIT = 1500


@query(f"""with b as (select article_no, trim(replace(replace(body, chr(13) || chr(10), chr(10)), chr(13), chr(10)), ' ' || chr(9) || chr(10)) as b from articles where body is not null),
l as (select article_no, unnest(string_split(b, chr(10))) as l, generate_subscripts(string_split(b, chr(10)), 1) as k from b where length(b) > {_LIMIT}),
u as (select *, sum(length(l) + 1) over (partition by article_no order by k) as used, (ltrim(l) like '```%')::int as f from l),
k as (select article_no, string_agg(l, chr(10) order by k) || case when sum(f) % 2 = 1 then chr(10) || '```' else '' end as t from u where used <= {_LIMIT} group by 1)
select b.article_no, case when length(b) <= {_LIMIT} then b else coalesce(trim(t, ' ' || chr(9) || chr(10)), '') end as body from b left join k on b.article_no = k.article_no""")
def x14_limited(spark, d):
    """Bodies cut at a line's end, an open code fence closed."""
    return articles(spark, d).where("body is not null").select("article_no", text.limit_lines(F.col("body"), _LIMIT).alias("body"))


@query("with s as (select article_no, unnest(string_split(body, chr(10))) as l, generate_subscripts(string_split(body, chr(10)), 1)::int as line_no from articles) select article_no, line_no, case when regexp_matches(trim(l), '^#{1,6} ') then 'heading' when regexp_matches(trim(l), '^([-*+]|\\d+[.)]) ') then 'list-item' when regexp_matches(trim(l), '^>') then 'blockquote' when regexp_matches(trim(l), '^```') then 'fence' else 'text' end as kind from s where trim(l) <> ''")
def x18_line_kinds(spark, d):
    return line_blocks(articles(spark, d), "article_no", "body")


@query()
def x18_blocks(spark, d):
    """Numbered prose blocks with their hashes; code has none. Tested against the fixtures."""
    return blocks_udtf_rows(articles(spark, d), "article_no", "body")


@query("with s as (select article_no, unnest(string_split(body, chr(10))) as l from articles) select article_no, count(*) as n_lines, count(*) filter (where regexp_matches(l, '[A-Za-z]') and not regexp_full_match(trim(l), '(https?://|www\\.)\\S+') and not regexp_matches(lower(l), '^(tags?|标签)\\s*[:：]')) as n_translatable from s where trim(l) <> '' group by 1")
def f24_translatable(spark, d):
    lines = articles(spark, d).select("article_no", F.explode(F.split("body", "\n")).alias("l")).where(F.trim("l") != "")
    ok = F.col("l").rlike("[A-Za-z]") & ~F.trim("l").rlike(r"^(https?://|www\.)\S+$") & ~F.lower("l").rlike(r"^(tags?|标签)\s*[:：]")
    return lines.groupBy("article_no").agg(F.count("*").alias("n_lines"), F.count_if(ok).alias("n_translatable"))


@query("select article_no, array_to_string(regexp_extract_all(body, '[A-Z][^.!?\n]{34,}[.!?]')[1:3], ' ') as summary from articles where len(regexp_extract_all(body, '[A-Z][^.!?\n]{34,}[.!?]')) > 0")
def x27_extractive(spark, d):
    found = F.regexp_extract_all("body", F.lit(r"[A-Z][^.!?\n]{34,}[.!?]"), F.lit(0))
    return articles(spark, d).where(F.size(found) > 0).select("article_no", F.array_join(F.slice(found, 1, 3), " ").alias("summary"))


@query("select article_no, len(list_distinct(list_transform(coalesce(images, []), lambda x: x.src))) as n_sources, coalesce(list_aggregate(list_transform(coalesce(images, []), lambda x: length(x.src)), 'max'), 0) as longest from articles")
def x34_image_sources(spark, d):
    src = F.array_compact(F.transform("images", lambda x: x["src"]))
    return articles(spark, d).select("article_no", F.coalesce(F.size(F.array_distinct(src)), F.lit(0)).alias("n_sources"), F.coalesce(F.array_max(F.transform(src, F.length)), F.lit(0)).alias("longest"))


@query("select article_no, regexp_extract(lower(i.src), '\\.(png|jpe?g|gif|webp|svg|avif)(\\?|$)', 1) as kind from (select article_no, unnest(images) as i from articles)")
def x35_image_kinds(spark, d):
    return articles(spark, d).select("article_no", F.explode("images").alias("i")).select("article_no", F.regexp_extract(F.lower("i.src"), r"\.(png|jpe?g|gif|webp|svg|avif)(\?|$)", 1).alias("kind"))


@query("select article_no, unnest(regexp_extract_all(body, '`([^`\n]+)`', 1)) as code from articles")
def x41_inline_code(spark, d):
    return articles(spark, d).select("article_no", F.explode(F.regexp_extract_all("body", F.lit(r"`([^`\n]+)`"), F.lit(1))).alias("code"))


@query("select article_no, substr('failed: ' || coalesce(note, 'unknown'), 1, 120) as message from articles where coalesce(note, '') <> ''")
def x44_error_note(spark, d):
    return articles(spark, d).where(F.coalesce("note", F.lit("")) != "").select("article_no", F.substring(F.concat(F.lit("failed: "), "note"), 1, 120).alias("message"))


@query("select article_no, ceil(strlen(coalesce(body, '')) / 3.0)::bigint + 400 as reserved from articles")
def x45_token_reserve(spark, d):
    return articles(spark, d).select("article_no", (F.ceil(F.octet_length(F.coalesce("body", F.lit(""))) / 3.0) + 400).alias("reserved"))


@query("select article_no, regexp_replace(lower(\"resolvedUrl\"), '[?#].*$', '') as canonical from articles where \"resolvedUrl\" is not null")
def h11_media_address(spark, d):
    return articles(spark, d).where("resolvedUrl is not null").select("article_no", F.regexp_replace(F.lower("resolvedUrl"), "[?#].*$", "").alias("canonical"))


@query("select content_hash, count(*) as n, min(doc_id) as first_doc from (select doc_id, sha256(text) as content_hash from documents where text is not null) group by 1")
def h12_content_hash(spark, d):
    return table(spark, d, "documents").where("text is not null").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query("select article_no, i.id as image_id, pos, row_number() over (partition by article_no order by pos) as ordinal from (select article_no, unnest(images) as i, generate_subscripts(images, 1)::int as pos from articles) where i.src is not null")
def h18_image_order(spark, d):
    df = articles(spark, d).select("article_no", F.posexplode("images").alias("p", "i")).where("i.src is not null").withColumn("pos", F.col("p") + 1)
    return df.select("article_no", F.col("i.id").alias("image_id"), "pos", F.row_number().over(Window.partitionBy("article_no").orderBy("pos")).alias("ordinal"))


@query("with f as (select article_no, term, instr(lower(body), term) as pos, length(term) as n from articles, (values ('attention'), ('sparse attention'), ('caching'), ('prompt caching'), ('decoding'), ('tokenizer')) t(term) where contains(lower(body), term)) select article_no, term, pos from f where not exists (select 1 from f g where g.article_no = f.article_no and g.n > f.n and g.pos <= f.pos and g.pos + g.n >= f.pos + f.n)")
def j17_terms_in_text(spark, d):
    """Terms at their first occurrence, the longest at a place, each once. The terms travel in the plan, so texts are never joined with them."""
    found = filters.terms_in(F.col("body"), ["attention", "sparse attention", "caching", "prompt caching", "decoding", "tokenizer"])
    return articles(spark, d).select("article_no", F.explode(found).alias("t")).select("article_no", "t.term", F.col("t.at").alias("pos"))


@query("select id, max(article_no) as article_no, count(distinct \"contentKind\") as kinds from articles where \"contentKind\" in ('community', 'feed', 'page', 'reader') group by id")
def s25_readable_lookup(spark, d):
    return articles(spark, d).where(F.col("contentKind").isin(*_READABLE)).groupBy("id").agg(F.max("article_no").alias("article_no"), F.countDistinct("contentKind").alias("kinds"))


@query("select source, count(distinct host) as n_hosts, count(*) as n_refs from (select source, regexp_extract(u, '^https?://([^/?#:]+)', 1) as host from (select source, unnest(regexp_extract_all(body, 'https?://[^ )\n\"`]+')) as u from articles)) group by source")
def s20_references(spark, d):
    refs = articles(spark, d).select("source", F.explode(F.regexp_extract_all("body", F.lit('https?://[^ )\n"`]+'), F.lit(0))).alias("u"))
    return refs.groupBy("source").agg(F.countDistinct(F.regexp_extract("u", "^https?://([^/?#:]+)", 1)).alias("n_hosts"), F.count("*").alias("n_refs"))
