"""The queries of the training-data operators, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.catalogue import resolve_entry
from ..session import join_small, materialize, table
from . import boilerplate, capping, encoding, history, language, mixing, packing, pii, truncation
from . import residue as residue_


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows of ``items`` beyond the best ``max_per_batch`` of their entry and batch."""
    rows = table(spark, d, "items").select("row_id", "batch_no", "score", "source", "sourceDomain")
    rows = resolve_entry(rows, table(spark, d, "sources").select("source", "aliases", "sourceDomain", "max_per_batch"))
    rows = rows.where(F.col("entry_max_per_batch").isNotNull())
    return capping.rank_rows(rows, ["entry", "batch_no"], "entry_max_per_batch", "score", "row_id").where("over_limit").select("row_id").distinct()


def p1_share(spark: SparkSession, d: str) -> DataFrame:
    """Rows of ``items`` beyond a twentieth of all rows that one source may give, the best by score kept."""
    rows = table(spark, d, "items").select("row_id", "score", "source").where(F.col("source").isNotNull())
    rows = join_small(rows, capping.share_limits(rows, ["source"], 0.05), ["source"])
    return capping.rank_rows(rows, ["source"], "share_limit", "score", "row_id").where("over_limit").select("row_id").distinct()


def site_names(spark: SparkSession, d: str) -> frozenset[str]:
    """Names and aliases of the catalogue, a dimension of bounded size."""
    rows = table(spark, d, "sources").select("source", "aliases").collect()
    return frozenset(n for r in rows for n in [r["source"], *(r["aliases"] or [])] if n)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows of ``items`` that repeat an accepted row, with that row."""
    items = table(spark, d, "items").select("row_id", "batch_no", "title", "url")
    return history.repeats(spark, items, "batch_no", site_names(spark, d))


def sizes(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, source and tokens of all documents; a missing size is the number of bytes, one token each."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", "source", F.coalesce(F.col("n_tokens").cast("long"), F.octet_length("text").cast("long")).alias("tokens"))


def articles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles")


def p4_residue(spark: SparkSession, d: str) -> DataFrame:
    """Articles that hold template residue or are no article, with the kind."""
    return residue_.residue(articles(spark, d), "article_no", "body")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Articles that hold template residue or are no article."""
    return p4_residue(spark, d).select("article_no").distinct()


def sound_articles(spark: SparkSession, d: str) -> DataFrame:
    """The articles without those that ``p4_found`` lists, which is worked out once."""
    return articles(spark, d).join(materialize(p4_found(spark, d), "residue"), "article_no", "left_anti")


def without_residue(spark: SparkSession, d: str, found: DataFrame) -> DataFrame:
    """``found`` (tbl, rec_no, ...) without the articles that ``p4_found`` lists; only the articles in ``found`` are judged."""
    found = materialize(found, "found")
    asked = found.where("tbl = 'articles'").select(F.col("rec_no").alias("article_no")).distinct()
    all_ = articles(spark, d).select("article_no", "body")
    bad = residue_.residue(all_, "article_no", "body", among=all_.join(asked, "article_no", "left_semi"))
    return found.join(bad.select(F.lit("articles").alias("tbl"), F.col("article_no").alias("rec_no")).distinct(), ["tbl", "rec_no"], "left_anti")


def _segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments of all article bodies and of ``summaryZh``; garbled bodies are read in their restored form."""
    profiles = language.train(table(spark, d, "documents"), "text", "lang")
    rows = articles(spark, d).select("article_no", "body")
    rows = rows.join(p6_restored(spark, d).select("article_no", "restored"), "article_no", "left")
    texts = rows.select(F.lit("articles").alias("tbl"), F.col("article_no").alias("rec_no"), F.coalesce("restored", "body").alias("text"))
    summaries = table(spark, d, "items").where(F.col("summaryZh") != "").select(F.lit("items").alias("tbl"), F.col("row_id").alias("rec_no"), F.col("summaryZh").alias("text"))
    return language.label_segments(texts.unionByName(summaries), ["tbl", "rec_no"], "text", profiles)


def p2_segments(spark: SparkSession, d: str) -> DataFrame:
    """Languages of the segments of sound article bodies and of ``summaryZh``."""
    return without_residue(spark, d, _segments(spark, d))


def p2_documents(spark: SparkSession, d: str) -> DataFrame:
    """The main language of every sound article body and ``summaryZh``, with its confidence."""
    return language.document_language(p2_segments(spark, d), ["tbl", "rec_no"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Languages of a text that its label (zh for ``summaryZh``) does not state."""
    found = _segments(spark, d).where("n_whole > 0").select("tbl", "rec_no", "lang").distinct()
    stated = articles(spark, d).select(F.lit("articles").alias("tbl"), F.col("article_no").alias("rec_no"), language.stated_column(F.col("lang")).alias("_stated"))
    out = found.join(stated, ["tbl", "rec_no"], "left")
    said = F.when(F.col("tbl") == "items", F.lit("zh")).otherwise(F.col("_stated"))
    return without_residue(spark, d, out.where(said.isNull() | (F.col("lang") != said)).select("tbl", "rec_no", "lang"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines of article bodies that are the site's, not the article's own."""
    rows = sound_articles(spark, d).select("article_no", "body", "url", "sourceDomain", "title")
    rows = boilerplate.with_host(rows, table(spark, d, "sources").select("source", "sourceDomain"))
    return boilerplate.main_body(rows, "article_no", "body", "host", "site", "title").distinct()


def p6_restored(spark: SparkSession, d: str) -> DataFrame:
    """Garbled articles with the text as far as it could be restored."""
    return encoding.restore(articles(spark, d), "article_no", "body")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Articles with garbled text."""
    return p6_restored(spark, d).select("article_no").distinct()


def _values(spark: SparkSession, d: str) -> DataFrame:
    sources = table(spark, d, "sources").select("source", "aliases", "sourceDomain", "lang")
    bodies = articles(spark, d).withColumn("label", language.stated_column(F.col("lang"))).select("source", "sourceDomain", F.lit("articles").alias("tbl"), F.col("article_no").alias("rec_no"), "label", F.col("body").alias("text"))
    summaries = table(spark, d, "items").select("source", "sourceDomain", F.lit("items").alias("tbl"), F.col("row_id").alias("rec_no"), F.lit(None).cast("string").alias("label"), F.col("summary").alias("text"))
    rows = resolve_entry(bodies.unionByName(summaries), sources)
    return rows.select("tbl", "rec_no", F.coalesce("label", "entry_lang").alias("lang"), F.coalesce("entry", "source").alias("source"), "text").where(F.col("text") != "")


def p7_cut(spark: SparkSession, d: str) -> DataFrame:
    """Bodies and summaries that were cut off, with the log-odds and the reason."""
    return without_residue(spark, d, truncation.cut_values(_values(spark, d), articles(spark, d).select(F.col("title").alias("text"))))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Bodies and summaries that were cut off."""
    return p7_cut(spark, d).select("tbl", "rec_no").distinct()


def p7_rates(spark: SparkSession, d: str) -> DataFrame:
    """The share of cut bodies and summaries per source."""
    return truncation.rates(_values(spark, d), p7_cut(spark, d))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every document with its container, for each capacity."""
    return packing.pack(sizes(spark, d).select("doc_id", "tokens"), table(spark, d, "containers"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that had to be split, for each capacity."""
    return p8_containers(spark, d).where("pieces > 1").select("capacity_tokens", "doc_id").distinct()


def p8_checked(spark: SparkSession, d: str) -> DataFrame:
    """Per capacity what the containers hold: documents and tokens (as the sizes say), pieces that are there twice, containers
    over their capacity, and whether at least nine tenths of the space is used (or a container is left over)."""
    packed = p8_containers(spark, d)
    per = packed.groupBy("capacity_tokens", "doc_id").agg(F.count("*").alias("k"), F.max("pieces").alias("pieces"), F.sum("tokens").alias("tokens"))
    docs = per.groupBy("capacity_tokens").agg(F.count("*").alias("n_docs"), F.sum("tokens").alias("tokens"), F.count_if(F.col("k") != F.col("pieces")).alias("n_wrong_pieces"))
    bins = packed.groupBy("capacity_tokens", "bin_id").agg(F.sum("tokens").alias("held"), F.max("bin_tokens").alias("said"))
    full = bins.groupBy("capacity_tokens").agg(F.count_if((F.col("held") > F.col("capacity_tokens")) | (F.col("held") != F.col("said"))).alias("n_over"), F.count("*").alias("n_bins"))
    out = docs.join(full, "capacity_tokens")
    filled = F.col("tokens") >= F.lit(0.9) * (F.col("n_bins") - 1) * F.col("capacity_tokens")
    return out.select("capacity_tokens", "n_docs", "tokens", "n_wrong_pieces", "n_over", filled.alias("well_filled"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """Copies of each document of the target sources."""
    docs = resolve_entry(sizes(spark, d).withColumn("sourceDomain", F.lit(None).cast("string")), table(spark, d, "mix_targets").select("source", F.array().cast("array<string>").alias("aliases"), F.lit(None).cast("string").alias("sourceDomain")))
    return mixing.mix(docs.select("doc_id", F.col("entry").alias("source"), "tokens"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares that the mixture really reaches."""
    return mixing.shares(p9_mix(spark, d), table(spark, d, "mix_targets"))


def p9_checked(spark: SparkSession, d: str) -> DataFrame:
    """Per source that is present: its documents, copies beyond the most allowed, and whether its share is within a hundredth
    of its weight over the sources present."""
    got = p9_shares(spark, d).where("n_docs > 0")
    all_ = got.agg(F.sum("target_weight").alias("_w"))
    out = got.join(all_, F.lit(True))
    near = F.abs(F.col("actual_share") - F.col("target_weight") / F.col("_w")) <= 0.01
    return out.select("source", "n_docs", (F.col("most_copies") > F.col("max_repeats")).alias("over"), near.alias("on_target"))


def p10_clean(spark: SparkSession, d: str) -> DataFrame:
    """Documents with placeholders for personal information, and the pieces."""
    docs = table(spark, d, "documents")
    tagger = pii.load() or pii.trained(docs, "text", table(spark, d, "person_names"))
    return pii.find(docs, "doc_id", "text", tagger)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of personal information in documents."""
    pieces = p10_clean(spark, d).select("doc_id", F.explode("pieces").alias("p"))
    return pieces.select("doc_id", F.col("p.start_pos").alias("start_pos"), F.col("p.kind").alias("kind")).distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_share": p1_share,
    "p2_found": p2_found,
    "p2_segments": p2_segments,
    "p2_documents": p2_documents,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_residue": p4_residue,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_restored": p6_restored,
    "p7_found": p7_found,
    "p7_cut": p7_cut,
    "p7_rates": p7_rates,
    "p8_found": p8_found,
    "p8_containers": p8_containers,
    "p8_checked": p8_checked,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p9_checked": p9_checked,
    "p10_found": p10_found,
    "p10_clean": p10_clean,
}
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_FOLD = "nullif(trim(regexp_replace(regexp_replace(lower(translate(COL, '" + _WIDE + "', '" + "".join(chr(ord(c) - 0xFEE0) for c in _WIDE).replace("'", "''") + "')), '[\\s\\x{a0}\\x{3000}]+', ' ', 'g'), ' *[(\\[]?\\b(rss|atom|feed)\\b[)\\]]? *$', '')), '')"
_HOST = "nullif(regexp_replace(regexp_replace(lower(trim({0})), '^(www\\d?|m|amp|mobile)\\.', ''), '\\.+$', ''), '')"
#: The rules of the operators that SQL can say, for the checks.
SQL: dict[str, str] = {
    "p1_found": f"""with names as (select {_FOLD.replace("COL", "unnest(list_append(coalesce(aliases, []), source))")} as n, source as entry, max_per_batch from sources),
hosts as (select {_HOST.format('"sourceDomain"')} as h, source as entry, max_per_batch from sources),
told as (select i.row_id, i.batch_no, i.score, coalesce(n.entry, h.entry) as entry, case when n.entry is not null then n.max_per_batch else h.max_per_batch end as m from (select *, {_FOLD.replace("COL", "source")} as fn, {_HOST.format('"sourceDomain"')} as fh from items) i left join names n on n.n = i.fn left join hosts h on h.h = i.fh),
ranked as (select row_id, m, row_number() over (partition by entry, batch_no order by score desc nulls last, row_id) as r from told where m is not null)
select row_id from ranked where r > m""",
    "p1_share": "with r as (select row_id, row_number() over (partition by source order by score desc nulls last, row_id) as r, (select floor(count(*) * 0.05) from items where source is not null) as m from items where source is not null) select row_id from r where r > m",
    "p8_checked": "select capacity_tokens, count(*) as n_docs, sum(coalesce(n_tokens, strlen(text)))::bigint as tokens, 0 as n_wrong_pieces, 0 as n_over, true as well_filled from documents, containers group by 1",
    "p9_checked": f"""with t as (select source as entry, {_FOLD.replace("COL", "source")} as f from mix_targets where target_weight > 0)
select entry as source, count(*) as n_docs, false as over, true as on_target from documents join t on f = {_FOLD.replace("COL", "source")} group by 1""",
    "p8_found": "select capacity_tokens, doc_id from documents, containers where coalesce(n_tokens, strlen(text)) > capacity_tokens",
}
