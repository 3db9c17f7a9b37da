"""Whole runs: gathering candidates into ranked sources, searching a corpus, merging runs, brainstorming."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.hashing import simhash
from siftline.functions.html import html_title, html_to_text, junk_reason, main_html
from siftline.functions.terms import distinct_tokens
from siftline.functions.text import query_tokens, title_from_text, top_sentences
from siftline.functions.url import identity_key, in_domains
from siftline.operators import dedup, fusion, ranking, sources_table

from .modes import DEPTHS


@dataclass
class Options:
    depth: str = "standard"
    exclude: tuple[str, ...] = ()
    seeds: tuple[str, ...] = ()
    max_sources: int | None = None
    diversify: bool = True
    rounds: int = 1


def corpus(pages: DataFrame) -> DataFrame:
    """Pages (url, html and, where known, pos) as documents (url, title, text of the main region, junk, pos); hydrating candidates is a join with it."""
    place = [c for c in pages.columns if c == "pos"]
    rows = pages.select("url", "html", *place, main_html(F.col("html")).alias("main"))
    rows = rows.select("url", *place, html_to_text(F.col("main")).alias("text"), html_title(F.col("html")).alias("html_title"))
    return rows.select("url", F.coalesce("html_title", title_from_text(F.col("text"))).alias("title"), "text", junk_reason(F.col("text")).alias("junk"), *place)


def hydrate(candidates: DataFrame, documents: DataFrame) -> DataFrame:
    """Fills missing texts: a candidate's own, else its page's unless junk, else its snippet; says by which."""
    pages = documents.filter("junk is null").groupBy(identity_key(F.col("url")).alias("identity_key")).agg(F.min_by("text", "url").alias("page"))
    rows = candidates.join(pages, "identity_key", "left")
    own, page = F.nullif("text", F.lit("")), F.nullif("page", F.lit(""))
    via = F.when(own.isNotNull(), "own").when(page.isNotNull(), "page").otherwise("snippet")
    return rows.withColumn("text_via", via).withColumn("text", F.coalesce(own, page, "snippet")).drop("page")


def gather(candidates: DataFrame, question: str, documents: DataFrame | None = None, options: Options | None = None) -> DataFrame:
    """Ranked, numbered sources of one question.

    ``candidates`` has list_no, pos, url, title, snippet, text, backend, doi, arxiv_id, year. The order is: fuse by
    identity, exclude, keep within the budget, hydrate, score, floor, collapse near-duplicates, diversify.
    The budget bounds the pool, so what follows works on few rows.
    """
    options = options or Options()
    limits = DEPTHS[options.depth]
    meta = F.map_filter(F.create_map(*[x for n in ("backend", "snippet", "year") for x in (F.lit(n), F.col(n).cast("string"))]), lambda k, v: v.isNotNull())
    rows = candidates.filter(~in_domains(F.col("url"), list(options.exclude)))
    rows = rows.select("list_no", "pos", "url", "title", "text", meta.alias("meta"), identity_key(F.col("url"), F.col("doi"), F.col("arxiv_id")).alias("identity_key"))
    pool = fusion.fuse(rows, "identity_key").withColumnRenamed("score", "rrf")
    budget = (options.max_sources or limits["max_sources"]) + limits["overshoot"]
    pool = pool.orderBy(F.desc("rrf"), *ranking.by_locale("url")).limit(budget)
    pool = pool.select("*", F.col("meta")["snippet"].alias("snippet"), F.col("meta")["backend"].alias("backend"), F.col("meta")["year"].cast("int").alias("year"))
    if documents is not None:
        pool = hydrate(pool, documents)
    pool = pool.withColumn("text", F.coalesce("text", "snippet", F.lit(""))).filter(F.trim("text") != "")
    content = ranking.bm25(pool, "identity_key", question, F.coalesce("title", F.lit("")), F.col("text")).withColumnRenamed("score", "content")
    seeded = in_domains(F.col("url"), list(options.seeds)) if options.seeds else None
    scored = ranking.blend(pool.join(content, "identity_key").withColumn("trust", ranking.trust(F.col("backend"), seeded)))
    ranked = scored.withColumn("place", F.row_number().over(Window.orderBy(F.desc("blended"), *ranking.by_locale("url"))))  # a pool within the budget
    kept = ranking.relevance_floor(ranked, query_tokens(question), limits["floor"], pos="place")
    kept = dedup.dedupe_near(kept.withColumn("fp", simhash(F.col("text"))), "fp", "place", F.length("text") >= dedup.MIN_CHARS)
    if options.diversify:
        sets = kept.select(F.lit(1).alias("pool"), F.col("url").alias("id"), F.col("blended").alias("score"), distinct_tokens(F.col("text")).alias("tokens"))
        kept = kept.join(dedup.diversify(sets, "pool").select(F.col("id").alias("url"), F.col("mmr_pos").alias("final")), "url")
    else:
        kept = kept.withColumn("final", F.col("place"))
    named = kept.withColumn("snippet", top_sentences(F.col("text"), question)).withColumn("score", F.col("blended"))
    return sources_table.build_sources(named, F.asc("final"))


def search(documents: DataFrame, question: str, n: int = 10) -> DataFrame:
    """The ``n`` best documents (url, title, text) for a question."""
    scored = ranking.bm25(documents, "url", question, F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")))
    top = scored.filter(F.col("score") > 0).orderBy(F.desc("score"), "url").limit(n)
    return documents.join(F.broadcast(top), "url").withColumn("snippet", top_sentences(F.col("text"), question)).select("url", "title", "score", "matched", "snippet")


def merge(runs: DataFrame) -> DataFrame:
    """Runs (run_dir, sub_question, pos, url, title, text) as one table, with the runs and sub-questions of each source."""
    rows = runs.withColumn("identity_key", identity_key(F.col("url")))
    merged = sources_table.merge_runs(rows)
    best = rows.groupBy("identity_key").agg(F.min(F.struct((F.coalesce("text", F.lit("")) == "").alias("bare"), "run_dir", "pos", "url", "title", "text")).alias("b"))
    pool = merged.join(best.select("identity_key", "b.url", "b.title", "b.text"), "identity_key")
    pool = sources_table.number(pool, "", 0, F.desc("score"), F.asc("url")).withColumn("rank", F.col("id").cast("long")).drop("id")
    kept = dedup.dedupe_near(pool.withColumn("fp", simhash(F.col("text"))), "fp", "rank", F.length("text") >= dedup.MIN_CHARS)
    return sources_table.number(kept.drop("fp"), "S", 0, F.asc("rank"))


def brainstorm(candidates: DataFrame) -> DataFrame:
    """cluster, label, titles of the ten best candidates (pos, url, title) by what their titles share."""
    top = candidates.orderBy("pos").limit(10)
    pool = top.select(F.lit(1).alias("pool"), F.col("url").alias("id"), "pos", distinct_tokens(F.col("title")).alias("tokens"))
    clusters = dedup.cluster_titles(pool, "pool").filter("cluster >= 0").select(F.col("id").alias("url"), "cluster")
    rows = top.join(clusters, "url").withColumn("token", F.explode(distinct_tokens(F.col("title"))))
    labels = dedup.angle_labels(rows, "cluster")
    titles = rows.groupBy("cluster").agg(F.array_sort(F.collect_set("title")).alias("titles"))  # ten titles at most
    return labels.join(titles, "cluster").orderBy("cluster")
