"""Queries of gathering over tables of questions: all benchmark items against all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.operators import dedup, ranking
from siftline.sources import responses
from siftline.streaming import ingest

from . import gather, modes, questions
from . import sqltext as sql
from .catalog import PAGE_TITLE, query, table
from .catalog_rules import parts

PER_LIST = 10
OPTIONS = gather.Options(depth="standard")


def asked(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def page_documents(spark, sf_dir) -> DataFrame:
    return dedup._cut(gather.corpus(table(spark, sf_dir, "pages").select("url", "html", F.col("page_id").alias("pos"))))


def _first_pass(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Terms, hydrated pools and what the floor leaves, each question searched as it stands."""
    documents, own = page_documents(spark, sf_dir), asked(spark, sf_dir)
    terms = dedup._cut(questions.question_terms(own))
    search = questions.corpus_search(documents, PER_LIST)
    candidates = dedup._cut(search(own.select("question_id", F.lit(0).alias("list_no"), F.col("question").alias("query"), F.lit(None).cast("string").alias("site"))))
    return terms, *questions.assemble(candidates, terms, documents, OPTIONS)


_DISTINCT = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_IDF = "CASE WHEN n < 3 THEN 1 ELSE ln(1 + (n - df + 0.5) / (df + 0.5)) END"
_POOL = f"""pt AS MATERIALIZED (SELECT url, {sql.canonical('url')} AS key, title, {sql.html_text('main')} AS body FROM (SELECT url, {PAGE_TITLE} AS title, {sql.main_html('html')} AS main FROM pages)),
q AS MATERIALIZED (SELECT qid, {_DISTINCT.format('t')} AS q FROM (SELECT item_id AS qid, {sql.tokens("coalesce(text, '')")} AS t FROM benchmark)),
post AS MATERIALIZED (SELECT DISTINCT 0 AS l, url, unnest({sql.tokens("title || ' ' || body")}) AS term FROM pt UNION ALL SELECT DISTINCT 1, url, unnest({sql.tokens('title')}) FROM pt),
nd AS (SELECT l, count(DISTINCT url) AS n FROM post GROUP BY l), dt AS (SELECT l, term, count(*) AS df FROM post GROUP BY l, term),
hit AS (SELECT qid, l, url, round(sum({_IDF}), 6) AS s FROM (SELECT qid, unnest(q) AS term FROM q) JOIN post USING (term) JOIN dt USING (l, term) JOIN nd USING (l) GROUP BY qid, l, url),
cand AS (SELECT * FROM (SELECT qid, l, url, row_number() OVER (PARTITION BY qid, l ORDER BY s DESC, url) AS pos FROM hit) WHERE pos <= {PER_LIST}),
pool AS (SELECT qid, key, arg_min(url, (l, pos)) AS url, round(sum(1.0::DOUBLE / (60 + pos)), 12) AS rrf, count(DISTINCT l) AS found_by FROM cand JOIN pt USING (url) GROUP BY qid, key),
best AS (SELECT key, arg_min(body, (NOT usable, url)) AS body, bool_or(usable) AS usable FROM (SELECT *, trim(body) <> '' AND {sql.junk('body')} IS NULL AS usable FROM pt) GROUP BY key),
doc AS MATERIALIZED (SELECT url, key, title, text, list_concat({sql.tokens('text')}, list_concat(list_concat(hh, hh), list_concat(tt, list_concat(tt, tt)))) AS t, {sql.tokens('text')} AS own
  FROM (SELECT *, {sql.tokens("array_to_string(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '^#{1,6}\\s')), chr(10))")} AS hh, {sql.tokens('title')} AS tt
  FROM (SELECT pt.url, pt.key, pt.title, CASE WHEN usable THEN best.body ELSE substr(pt.body, 1, 160) END AS text FROM pt JOIN best USING (key)))),
rows AS (SELECT qid, key, url, rrf, found_by, q, t, own, text FROM pool JOIN doc USING (url, key) JOIN q USING (qid) WHERE trim(text) <> ''),
spot AS (SELECT qid, key, x.term AS term, x.pos AS pos FROM (SELECT qid, key, q, unnest(list_transform(t, lambda x, i: {{'term': x, 'pos': i}})) AS x FROM rows) WHERE list_contains(q, x.term)),
stat AS (SELECT qid, count(*) AS n, avg(len(t)) AS avgdl FROM rows GROUP BY qid), df AS (SELECT qid, term, count(DISTINCT key) AS df FROM spot GROUP BY qid, term), tf AS (SELECT qid, key, term, count(*) AS f FROM spot GROUP BY qid, key, term),
near AS (SELECT qid, key, count(*) FILTER (term <> pt AND pos - pp <= 6) AS close, count(*) AS hits FROM (SELECT *, lag(term) OVER w AS pt, lag(pos) OVER w AS pp FROM spot WINDOW w AS (PARTITION BY qid, key ORDER BY pos)) GROUP BY qid, key),
part AS (SELECT qid, key, sum({_IDF} * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(t) / avgdl))) AS s FROM tf JOIN df USING (qid, term) JOIN rows USING (qid, key) JOIN stat USING (qid) GROUP BY qid, key),
bm AS (SELECT rows.*, coalesce(s * (1 + CASE WHEN hits >= 2 AND len(q) >= 2 THEN least(0.1, 0.1 * close / greatest(1, len(q) - 1)) ELSE 0 END), 0) AS content FROM rows LEFT JOIN part USING (qid, key) LEFT JOIN near USING (qid, key)),
bl AS (SELECT *, round(0.45 * rrf / greatest(1e-9, max(rrf) OVER w) + 0.35 * content / greatest(1e-9, max(content) OVER w) + 0.15 * 0.5 + 0.05 * 0.5, 6) AS blended FROM bm WINDOW w AS (PARTITION BY qid)),
tp AS (SELECT *, len(q) < 2 OR len(list_filter(q, lambda x: regexp_matches(x, '\\p{{L}}'))) = 0 OR (len(list_filter(q, lambda x: regexp_matches(x, '\\p{{L}}') AND list_contains(t, x))) > 0 AND NOT regexp_matches(trim(text), '(?i)^.{{0,80}}?\\bmay (also )?refer to\\b')) AS topic FROM bl),
fl AS (SELECT *, count(*) FILTER (topic) OVER (PARTITION BY qid) AS n_on, row_number() OVER (PARTITION BY qid, topic ORDER BY blended DESC, url COLLATE en, url) AS turn FROM tp),
kept AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY NOT topic, blended DESC, url COLLATE en, url) AS place FROM fl WHERE topic OR turn <= 6 - n_on)"""


@query(f"WITH {_POOL} SELECT qid AS question_id, place, url, found_by, round(rrf, 9) AS rrf, round(content, 6) AS content, blended, NOT topic AS readmitted FROM kept")
def gather_questions(spark, sf_dir):
    """Every benchmark item as a question: two lists, fused, hydrated with main regions, scored in its own pool, blended, and floored."""
    _, _, kept = _first_pass(spark, sf_dir)
    return kept.select("question_id", "place", "url", "found_by", F.round("rrf", 9).alias("rrf"), F.round("content", 6).alias("content"), "blended", "readmitted")


@query(
    f"""WITH {_POOL}, c AS (SELECT qid, term, i, count(*) FILTER (list_contains(own, term)) AS sources FROM (SELECT qid, own, unnest(q) AS term, unnest(range(1, len(q) + 1)) AS i FROM kept WHERE place <= 10) GROUP BY qid, term, i)
SELECT qid AS question_id, list(term ORDER BY i) AS missing FROM c WHERE sources < 2 GROUP BY qid"""
)
def question_gaps(spark, sf_dir):
    """The terms of each question that fewer than two of its ten best sources have."""
    _, _, kept = _first_pass(spark, sf_dir)
    return questions.gaps(kept)


@query()
def gather_rounds(spark, sf_dir):
    """The whole run for every benchmark item: variants, a seed domain, a second round for what is missing, near-duplicates, diversification."""
    documents = page_documents(spark, sf_dir)
    found = questions.gather_questions(asked(spark, sf_dir), questions.corpus_search(documents, PER_LIST), documents, gather.Options(depth="standard", seeds=("example.com",), rounds=2))
    return found.select("question_id", "id", "final", "url", "text_via", F.length("text").alias("n_chars"), "blended", "found_by", "readmitted", "round")


# --- planning -------------------------------------------------------------------------------------


@query(
    """WITH c AS (SELECT p_partkey // 12 AS qid, p_partkey % 12 AS ord, CASE p_partkey % 12 WHEN 5 THEN ' ABOUT 2 ' WHEN 7 THEN ' ' ELSE 'about ' || (p_partkey % 12) END AS question,
  CASE p_partkey % 12 WHEN 4 THEN ['ask 0', 'Ask 1'] ELSE ['Ask ' || (p_partkey % 5), 'ask ' || (p_partkey % 3), 'own ' || (p_partkey % 12), 'OWN ' || (p_partkey % 12)] END AS queries FROM part),
f AS (SELECT qid, lower(trim(question)) AS low, min(ord) AS ord FROM c WHERE trim(question) <> '' GROUP BY qid, low), k AS (SELECT qid, ord, row_number() OVER (PARTITION BY qid ORDER BY ord) AS n FROM f),
r AS (SELECT c.qid, n, trim(question) AS question, queries FROM k JOIN c USING (qid, ord) WHERE n <= 6), u AS (SELECT qid, n, unnest(queries) AS query, unnest(range(1, len(queries) + 1)) AS i FROM r),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, lower(query) ORDER BY n, i) AS t FROM u) WHERE t = 1), g AS (SELECT qid, n, list(query ORDER BY i) AS fresh FROM o GROUP BY qid, n)
SELECT r.qid AS question_id, 'Q' || n AS id, question, coalesce(fresh, queries[1:1]) AS queries FROM r LEFT JOIN g USING (qid, n)"""
)
def settled_facets(spark, sf_dir):
    """Twelve sub-questions a question, some repeated or blank, with queries that others have too: first wins, six stay."""
    i = F.col("i")
    ord_ = i % 12
    asked = F.when(ord_ == 5, F.lit(" ABOUT 2 ")).when(ord_ == 7, F.lit(" ")).otherwise(F.concat(F.lit("about "), ord_.cast("string")))
    own = [F.concat(F.lit("Ask "), (i % 5).cast("string")), F.concat(F.lit("ask "), (i % 3).cast("string")), F.concat(F.lit("own "), ord_.cast("string")), F.concat(F.lit("OWN "), ord_.cast("string"))]
    queries = F.when(ord_ == 4, F.array(F.lit("ask 0"), F.lit("Ask 1"))).otherwise(F.array(*own))
    rows = parts(spark, sf_dir).select(F.floor(i / 12).alias("question_id"), ord_.alias("ord"), asked.alias("question"), F.lit("made").alias("facet"), queries.alias("queries"))
    return modes.settle_facets(rows).drop("facet")


@query()
def planned_questions(spark, sf_dir):
    """Sub-questions of every benchmark item, in one of the five modes each."""
    rows = asked(spark, sf_dir)
    mode = F.element_at(F.array(*[F.lit(m) for m in modes.MODES]), (F.col("question_id") % len(modes.MODES) + 1).cast("int"))
    return modes.plan_questions(rows.withColumn("mode", mode))


# --- the hydration ladder on made pages -----------------------------------------------------------

_EFETCH = "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/efetch.fcgi?db=pubmed&id={}&rettype=abstract&retmode=text"


def _ladder(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Candidates of eight kinds, forty a question, and the pages that can be read."""
    i = F.col("i")
    kind, number = i % 8, (100000 + i).cast("string")
    plain, pubmed = F.concat(F.lit("https://x.org/"), "k"), F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), number, F.lit("/"))
    absolute = F.concat(F.lit("https://abs.org/"), "k")
    rows = parts(spark, sf_dir).withColumns({"kind": kind, "url": F.when(kind == 2, pubmed).otherwise(plain), "abs_url": F.when(kind == 3, absolute)})
    pool = rows.select(
        F.floor(i / 40).alias("question_id"), F.concat(F.lit("k"), "k").alias("identity_key"), "url", "abs_url", F.lit("a title").alias("title"),
        F.when(kind == 0, F.concat(F.lit("own text "), "k")).alias("text"), F.concat(F.lit("snippet "), "k").alias("snippet"), (i % 40).alias("rank"),
    )
    wall, page = F.lit("We use cookies"), F.concat(F.lit("page text "), "k")
    own = rows.filter(kind != 7).select(
        "url", F.lit("page").alias("title"), F.when(kind.isin(2, 3, 6), wall).when(kind.isin(4, 5), F.lit("")).otherwise(page).alias("text"),
        F.when(kind.isin(2, 3, 6), F.lit("cookie/consent wall")).alias("junk"), F.when(kind == 4, 404).when(kind == 5, 500).otherwise(200).alias("status"), F.when(kind == 4, F.concat(F.lit("saved "), "k")).alias("archived"),
    )
    text = F.concat(F.lit("abstract "), "k")
    provider = rows.filter(kind == 2).select(F.format_string(_EFETCH.replace("{}", "%s"), number).alias("url"), F.lit("p").alias("title"), text.alias("text"))
    alternate = rows.filter(kind == 3).select(absolute.alias("url"), F.lit("a").alias("title"), text.alias("text"))
    others = provider.unionByName(alternate).withColumns({"junk": F.lit(None).cast("string"), "status": F.lit(200), "archived": F.lit(None).cast("string")})
    return pool, own.unionByName(others)


@query(
    f"""WITH p AS (SELECT p_partkey AS i, p_partkey % 8 AS kind, p_partkey % 40 AS rank, p_partkey // 40 AS qid FROM part), t AS (SELECT *, row_number() OVER (PARTITION BY qid, kind = 4 ORDER BY rank) AS turn FROM p)
SELECT qid AS question_id, rank, CASE kind WHEN 0 THEN 'own' WHEN 1 THEN 'page' WHEN 2 THEN 'provider' WHEN 3 THEN 'alternate' WHEN 4 THEN CASE WHEN turn <= 3 THEN 'archive' ELSE 'snippet' END ELSE 'snippet' END AS text_via,
 CASE kind WHEN 0 THEN 'own text ' WHEN 1 THEN 'page text ' WHEN 2 THEN 'abstract ' WHEN 3 THEN 'abstract ' WHEN 4 THEN CASE WHEN turn <= 3 THEN 'saved ' ELSE 'snippet ' END ELSE 'snippet ' END || i AS text,
 CASE kind WHEN 2 THEN '{_EFETCH.split("{}")[0]}' || (100000 + i) || '{_EFETCH.split("{}")[1]}' WHEN 3 THEN 'https://abs.org/' || i END AS text_from FROM t"""
)
def hydration_ladder(spark, sf_dir):
    """Own text, page, text endpoint of the archive, abstract page, snapshot (three of five dead pages of a question), snippet."""
    pool, documents = _ladder(spark, sf_dir)
    return questions.hydrate(pool, documents, rescues=3).select("question_id", "rank", "text_via", "text", "text_from")


_SPELT = "CASE i % 4 WHEN 0 THEN n WHEN 1 THEN upper(n) WHEN 2 THEN replace(n, 'e', 'é') ELSE replace(n, 'i', 'Í') END"


@query(f"WITH p AS (SELECT p_partkey AS i, coalesce(p_name, '') AS n FROM part), s AS (SELECT i % 25 AS pool, i, {_SPELT} AS name FROM p) SELECT pool, i, name, pos FROM (SELECT *, CAST(row_number() OVER (PARTITION BY pool ORDER BY name COLLATE en, name, i) AS INTEGER) AS pos FROM s) WHERE pos <= 12")
def locale_order(spark, sf_dir):
    """The first twelve names of each pool in a reader's order: accents and case do not part equal letters."""
    rows = parts(spark, sf_dir).withColumn("n", F.coalesce("n", F.lit(""))).select((F.col("i") % 25).alias("pool"), "i", F.expr(_SPELT).alias("name"))
    order = Window.partitionBy("pool").orderBy(*ranking.by_locale("name"), "i")
    return rows.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= 12)


# --- the cache and saved result pages -------------------------------------------------------------


@query(
    f"""WITH p AS (SELECT page_id, {sql.canonical('url')} AS k, page_id % 50 AS age FROM pages), e AS (SELECT k, 'new ' || page_id AS text, age FROM p WHERE page_id % 3 <> 0 UNION ALL SELECT k, 'old ' || page_id, age + 1 FROM p WHERE page_id % 5 <> 0),
b AS (SELECT k, arg_max(text, (-age, text)) AS text FROM e WHERE age <= 24 GROUP BY k) SELECT page_id, b.text, b.text IS NOT NULL AS hit FROM p LEFT JOIN b USING (k)"""
)
def cached_pages(spark, sf_dir):
    """Pages asked of a cache that has two entries of some and none of others, from now to two days old; a day is the time to live."""
    now = F.to_timestamp(F.lit("2024-05-01 12:00:00"))
    page = F.col("page_id")
    pages = table(spark, sf_dir, "pages").select("page_id", ingest.cache_key(F.col("url")).alias("key"), (page % 50).alias("age"))
    entries = F.array(
        F.struct(F.when(page % 3 != 0, F.concat(F.lit("new "), page.cast("string"))).alias("text"), F.col("age").alias("age")),
        F.struct(F.when(page % 5 != 0, F.concat(F.lit("old "), page.cast("string"))).otherwise(F.lit(" ")).alias("text"), (F.col("age") + 1).alias("age")),
    )
    cache = pages.select("key", F.explode(entries).alias("e")).select("key", "e.text", (now - F.make_dt_interval(hours=F.col("e.age").cast("int"))).alias("cached_at"))
    return ingest.cache_lookup(pages.select("page_id", "key"), cache, now).select("page_id", "text", "hit")


@query(
    """WITH r AS (SELECT p_partkey // 40 AS q, p_partkey % 40 AS i, p_partkey % 40 // 8 AS page, p_partkey AS k FROM part), u AS (SELECT *, CASE WHEN page = 2 AND q % 3 = 0 OR page = 1 AND q % 3 = 1 THEN q * 40 + i % 8 ELSE k END AS link FROM r),
n AS (SELECT q, page, count(*) FILTER (fresh) AS fresh FROM (SELECT *, row_number() OVER (PARTITION BY q, link ORDER BY page, i) = 1 AS fresh FROM u) GROUP BY q, page), s AS (SELECT q, coalesce(min(page) FILTER (fresh = 0), 5) AS stop FROM n GROUP BY q),
f AS (SELECT q, link, min((page, i)) AS place FROM u JOIN s USING (q) WHERE page < stop GROUP BY q, link)
SELECT CAST(q AS VARCHAR) AS query, CAST(row_number() OVER (PARTITION BY q ORDER BY place) AS INTEGER) AS pos, 'https://x.org/' || link AS url FROM f"""
)
def read_searxng_pages(spark, sf_dir):
    """Five saved pages a query; pages behind the first without a new URL are not read."""
    return responses.read_searxng_pages(_saved_pages(spark, sf_dir))[0].select("query", "pos", "url")


@query(
    """WITH q AS (SELECT DISTINCT p_partkey // 40 AS q FROM part) SELECT CAST(q AS VARCHAR) AS query, 'brave' AS engine, 'Suspended: too many requests' AS reason FROM q UNION ALL SELECT CAST(q AS VARCHAR), 'qwant', 'CAPTCHA' FROM q WHERE q % 3 <> 1 AND EXISTS (SELECT 1 FROM part WHERE p_partkey // 40 = q AND p_partkey % 40 // 8 = 2) UNION ALL SELECT CAST(q AS VARCHAR), 'late', 'last reason' FROM q WHERE q % 3 = 2"""
)
def suspended_engines(spark, sf_dir):
    """Engines that a page which was read calls unresponsive, with the last reason given; the late pages of most queries are not read."""
    return responses.read_searxng_pages(_saved_pages(spark, sf_dir))[1]


def _saved_pages(spark, sf_dir) -> DataFrame:
    """Pages of eight results; of a third of the queries the second, of another the third repeats the first."""
    i = F.col("i")
    q, page, own = F.floor(i / 40), F.floor(i % 40 / 8), i % 40 % 8
    link = F.when(((page == 2) & (q % 3 == 0)) | ((page == 1) & (q % 3 == 1)), q * 40 + own).otherwise(i)
    item = F.to_json(F.struct(F.concat(F.lit("https://x.org/"), link.cast("string")).alias("url"), F.lit("").alias("title"), F.lit("s").alias("content")))
    rows = parts(spark, sf_dir).select(q.cast("string").alias("query"), page.cast("int").alias("page"), i.alias("i"), item.alias("item"))
    saved = rows.groupBy("query", "page").agg(F.array_sort(F.collect_list(F.struct("i", "item"))).alias("x"))  # eight items
    items = F.array_join(F.transform("x", lambda y: y["item"]), ",")
    engines = F.when(F.col("page") == 0, '[["brave","timeout"]]').when(F.col("page") == 1, '[["brave","Suspended: too many requests"]]').when(F.col("page") == 2, '["qwant",["qwant","CAPTCHA"]]').otherwise('[["late","last reason"]]')
    return saved.select("query", "page", F.concat(F.lit('{"results":['), items, F.lit('],"unresponsive_engines":'), engines, F.lit("}")).alias("payload"))
