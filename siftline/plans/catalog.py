"""The query catalogue: each operator over whole tables, beside its reference SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.functions import claims, hashing, html, terms, text, url
from siftline.operators import dedup, fusion, grounding, ranking, sources_table

from . import gather
from . import sqltext as sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(reference: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if reference:
            SQL[f.__name__] = reference
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The question of the ranking queries: the first benchmark passage.
QUESTION_SQL = "(SELECT coalesce(text, '') FROM benchmark ORDER BY item_id LIMIT 1)"


def question(spark: SparkSession, sf_dir: str) -> str:
    row = table(spark, sf_dir, "benchmark").orderBy("item_id").select("text").first()
    return (row and row["text"]) or ""


# --- URLs and pages -------------------------------------------------------------------------------


@query(f"SELECT page_id, {sql.canonical('url')} AS canonical FROM pages")
def url_canonical(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", url.canonical_url(F.col("url")).alias("canonical"))


@query(f"SELECT page_id, {sql.domain('url')} AS domain FROM pages")
def url_domain(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", url.domain_of(F.col("url")).alias("domain"))


@query(f"SELECT page_id, {sql.canonical('url')} AS identity FROM pages")
def url_identity(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", url.identity_key(F.col("url")).alias("identity"))


@query(
    f"""SELECT canonical, arg_max(page_id, (length(html), -page_id)) AS page_id, count(*) AS copies
FROM (SELECT page_id, html, {sql.canonical('url')} AS canonical FROM pages) GROUP BY canonical"""
)
def dedupe_by_url(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", url.canonical_url(F.col("url")).alias("canonical"), F.length("html").alias("size"))
    return fusion.dedupe_by_url(pages, "canonical", "size", "page_id").select("canonical", "page_id", "copies")


EXCLUDED = ["example.com", "test.org"]


@query(f"SELECT page_id FROM (SELECT page_id, {sql.domain('url')} AS d FROM pages) WHERE NOT (d IN ('example.com', 'test.org') OR d LIKE '%.example.com' OR d LIKE '%.test.org')")
def exclude_domains(spark, sf_dir):
    return table(spark, sf_dir, "pages").filter(~url.in_domains(F.col("url"), EXCLUDED)).select("page_id")


@query(
    f"""SELECT page_id, regexp_matches(url, '^https?://') AND NOT (regexp_matches(regexp_extract(trim(url), '^[^/]*//[^/?#]*([^?#]*)', 1), '(?i)^/api/|\\.(fcgi|cgi)$')
OR regexp_matches(url, '(?i)[?&](format|retmode|rettype|output)=(json|xml|text|atom|csv|bibtex)\\b')) AS citable FROM pages"""
)
def citable_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", url.is_citable(F.col("url")).alias("citable"))


@query(f"SELECT page_id, md5({sql.html_text('html')}) AS digest FROM pages")
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(html.html_to_text(F.col("html"))).alias("digest"))


@query(f"""SELECT page_id, nullif({sql.entities("trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g'))")}, '') AS title FROM pages""")
def html_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.html_title(F.col("html")).alias("title"))


@query(f"SELECT page_id, length(main) AS n_chars, md5(main) AS digest FROM (SELECT page_id, {sql.main_html('html')} AS main FROM pages)")
def main_region(spark, sf_dir):
    """Pages of the table have one article each, which the SQL relies on; tests have nested and broken ones."""
    pages = table(spark, sf_dir, "pages").select("page_id", html.main_html("html").alias("main"))
    return pages.select("page_id", F.length("main").alias("n_chars"), F.md5("main").alias("digest"))


@query(f"""SELECT page_id, coalesce(len(list_distinct(list_filter(list_transform(regexp_extract_all(html, '(?i)https?://[a-z0-9.-]+'), lambda h: {sql.domain('h')}), lambda h: h <> '' AND h <> {sql.domain('url')}))), 0) AS hosts FROM pages""")
def external_hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.size(html.external_hosts(F.col("url"), F.col("html"))).cast("long").alias("hosts"))


@query(f"SELECT doc_id, {sql.junk('text')} AS reason FROM documents")
def junk_reason(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", html.junk_reason(F.col("text")).alias("reason"))


@query(
    """SELECT doc_id, CASE WHEN length(t) = 0 THEN 'empty' WHEN (length(t) - length(regexp_replace(t, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F]', '', 'g'))) / length(t) > 0.005 THEN 'binary'
WHEN (length(t) - length(replace(t, chr(65533), ''))) / length(t) > 0.005 THEN 'map'
WHEN length(t) >= 200 AND list_max(list_transform(regexp_split_to_array(t, '\\s+'), lambda w: length(w))) > 300
 AND length(regexp_replace(t, '[^\\p{L}\\p{N}]', '', 'g')) / length(regexp_replace(t, '\\s+', '', 'g')) < 0.5 THEN 'garbled' END AS fault
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM documents)"""
)
def extraction_fault(spark, sf_dir):
    short = F.create_map(*[F.lit(x) for x in (html.EMPTY, "empty", html.BINARY, "binary", html.WRONG_MAP, "map", html.GARBLED, "garbled")])
    return table(spark, sf_dir, "documents").select("doc_id", short[html.extraction_fault(F.col("text"))].alias("fault"))


# --- words ----------------------------------------------------------------------------------------


@query(f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, {sql.tokens('text')} AS t FROM documents)")
def tokenize_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", terms.token_counts(F.col("text")).alias("t")).select("doc_id", "t.*")


@query(
    f"""WITH t AS (SELECT unnest(list_distinct({sql.tokens('text')})) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents)
SELECT term, count(*) AS df, round(CASE WHEN any_value(n) < 3 THEN 1 ELSE ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) END, 6) AS idf FROM t, n GROUP BY term"""
)
def term_idf(spark, sf_dir):
    found = ranking.document_frequencies(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))
    return found.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"SELECT item_id, {sql.keywords('text')} AS keywords FROM benchmark")
def keywords(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", text.keywords(F.col("text")).alias("keywords"))


_WEIGHT = "CASE WHEN regexp_matches(k, '[0-9]') THEN 3.0 ELSE 0 END + CASE WHEN regexp_matches(k, '[A-Z]') AND NOT regexp_matches(k, '^[A-Z0-9]+$') THEN 2.0 ELSE 0 END + CASE WHEN contains(k, '_') THEN 2.0 ELSE 0 END + CASE WHEN length(k) >= 8 THEN 1.5 WHEN length(k) >= 5 THEN 0.5 ELSE 0 END"


@query(
    f"""WITH r AS (SELECT item_id, list(k ORDER BY w DESC, i) AS ranked FROM (SELECT item_id, k, i, {_WEIGHT} AS w
FROM (SELECT item_id, unnest(kw) AS k, unnest(range(1, len(kw) + 1)) AS i FROM (SELECT item_id, {sql.keywords('text')} AS kw FROM benchmark))) GROUP BY item_id)
SELECT item_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(ranked, CAST([] AS VARCHAR[])) END AS ranked FROM benchmark LEFT JOIN r USING (item_id)"""
)
def ranked_keywords(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", text.ranked_keywords(F.col("text")).alias("ranked"))


@query(f"SELECT doc_id, {sql.identifiers('text')} AS ids FROM documents")
def identifiers(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.identifiers(F.col("text")).alias("ids"))


@query(
    f"""WITH k AS (SELECT item_id, trim(text) AS base, {sql.keywords('text')} AS kw, {sql.identifiers('text')} AS ids FROM benchmark),
r AS (SELECT item_id, list(k ORDER BY {_WEIGHT} DESC, i) AS ranked FROM (SELECT item_id, unnest(kw) AS k, unnest(range(1, len(kw) + 1)) AS i FROM k) GROUP BY item_id),
c AS (SELECT item_id, base, list_filter([base, array_to_string(ranked[1:8], ' '), array_to_string(ids, ' '), CASE WHEN len(kw) >= 2 THEN '"' || array_to_string(kw[1:4], ' ') || '"' END,
 CASE WHEN len(ids) > 0 AND len(kw) > 0 THEN kw[1] || ' ' || array_to_string(ids, ' ') END], lambda v: v IS NOT NULL AND v <> '') AS c FROM k LEFT JOIN r USING (item_id))
SELECT item_id, CASE WHEN len(c) = 0 THEN [base] ELSE list_filter(c, lambda v, i: list_position(list_transform(c, lambda w: lower(w)), lower(v)) = i)[1:3] END AS variants FROM c"""
)
def plan_variants(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", text.plan_variants(F.col("text"), "deep").alias("variants"))


@query("SELECT p_partkey, CASE WHEN s = '' THEN 'run' ELSE s END AS slug FROM (SELECT p_partkey, substr(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80) AS s FROM part)")
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.slug(F.col("p_name")).alias("slug"))


@query(
    """SELECT doc_id, md5(CASE WHEN length(text) <= 4000 THEN text ELSE CASE WHEN strpos(h, chr(10)) > 0 AND length(h) - strpos(reverse(h), chr(10)) > 2400
THEN substr(h, 1, length(h) - strpos(reverse(h), chr(10))) ELSE h END || chr(10) || chr(10) || '… [truncated]' END) AS digest FROM (SELECT doc_id, text, substr(text, 1, 4000) AS h FROM documents)"""
)
def cap_extract(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.cap_extract(F.col("text"), "summary")).alias("digest"))


@query(
    """SELECT doc_id, substr(coalesce(nullif(trim(regexp_replace(string_split_regex(text, '\\n\\s*\\n')[1], '\\s+', ' ', 'g')), ''), ''), 1, 200) AS title FROM documents
WHERE NOT regexp_matches(text, '\\n\\s*\\n') AND NOT regexp_matches(text, '(?m)^\\s*#{1,6}\\s+\\S')"""
)
def titles_from_text(spark, sf_dir):
    """All documents. The SQL states only those without blank lines and headings; tests hold the others against brute force."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.title_from_text(F.coalesce("text", F.lit(""))).alias("title"))


@query()
def top_sentences(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.top_sentences(F.coalesce("text", F.lit("")), question(spark, sf_dir)).alias("snippet"))


@query(f"SELECT doc_id, {sql.numerals('text')} AS numerals FROM documents")
def numerals(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", claims.numerals(F.col("text")).alias("numerals"))


# --- ranking --------------------------------------------------------------------------------------

_TITLE = "string_split(text, chr(10))[1]"
_TOKENS_SQL = f"""docs AS (SELECT doc_id, source, list_concat({sql.tokens('text')}, list_concat(tt, list_concat(tt, tt))) AS t FROM (SELECT doc_id, source, text, {sql.tokens(_TITLE)} AS tt FROM documents)),
q AS (SELECT list_filter(t, lambda x, i: list_position(t, x) = i) AS q FROM (SELECT {sql.tokens(QUESTION_SQL)} AS t)),
hit AS (SELECT doc_id, t.term, t.pos FROM (SELECT doc_id, unnest(list_transform(docs.t, lambda x, i: {{'term': x, 'pos': i}})) AS t FROM docs), q WHERE list_contains(q, t.term)),
stat AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM docs),
df AS (SELECT term, count(DISTINCT doc_id) AS df FROM hit GROUP BY term),
tf AS (SELECT doc_id, term, count(*) AS f FROM hit GROUP BY doc_id, term),
near AS (SELECT doc_id, count(*) FILTER (term <> pt AND pos - pp <= 6) AS close, count(*) AS hits FROM (SELECT *, lag(term) OVER w AS pt, lag(pos) OVER w AS pp FROM hit WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) GROUP BY doc_id),
part AS (SELECT doc_id, sum((CASE WHEN n < 3 THEN 1 ELSE ln(1 + (n - df + 0.5) / (df + 0.5)) END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(t) / avgdl))) AS s FROM tf JOIN df USING (term) JOIN docs USING (doc_id), stat GROUP BY doc_id),
bm AS (SELECT doc_id, coalesce(s, 0) AS plain, coalesce(s * (1 + CASE WHEN hits >= 2 AND len(q) >= 2 THEN least(0.1, 0.1 * close / greatest(1, len(q) - 1)) ELSE 0 END), 0) AS score FROM docs LEFT JOIN part USING (doc_id) LEFT JOIN near USING (doc_id), q)"""


_PAGE_HEADINGS = "array_to_string(list_filter(string_split(body, chr(10)), lambda l: regexp_matches(l, '^#{1,6}\\s')), chr(10))"
PAGE_TITLE = f"""nullif({sql.entities("trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g'))")}, '')"""
_PAGES_SQL = _TOKENS_SQL.replace(
    _TOKENS_SQL[: _TOKENS_SQL.index("\nq AS")],
    f"""pt AS (SELECT doc_id, title, {sql.html_text('main')} AS body FROM (SELECT page_id AS doc_id, {PAGE_TITLE} AS title, {sql.main_html('html')} AS main FROM pages)),
docs AS (SELECT doc_id, title, list_concat({sql.tokens('body')}, list_concat(list_concat(hh, hh), list_concat(tt, list_concat(tt, tt)))) AS t FROM (SELECT *, {sql.tokens(_PAGE_HEADINGS)} AS hh, {sql.tokens("coalesce(title, '')")} AS tt FROM pt)),""",
)


@query(f"WITH {_PAGES_SQL} SELECT CAST(doc_id AS VARCHAR) AS url, title, round(score, 6) AS score FROM bm JOIN docs USING (doc_id) WHERE score > 0 ORDER BY score DESC, CAST(doc_id AS VARCHAR) LIMIT 10")
def search_pages(spark, sf_dir):
    """The ten best pages for the question: HTML to text, fields, BM25F, top-k."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("url"), "html")
    return gather.search(gather.corpus(pages), question(spark, sf_dir)).select("url", "title", F.round("score", 6).alias("score"))


def _scored(spark, sf_dir, proximity=True):
    docs = table(spark, sf_dir, "documents")
    first_line = F.get(F.split(F.coalesce("text", F.lit("")), "\n", -1), F.lit(0))
    return ranking.bm25(docs, "doc_id", question(spark, sf_dir), first_line, F.col("text"), proximity)


@query(f"WITH {_TOKENS_SQL} SELECT doc_id, round(plain, 6) AS score FROM bm")
def bm25_scores(spark, sf_dir):
    return _scored(spark, sf_dir, proximity=False).select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {_TOKENS_SQL} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY round(score, 6) DESC, doc_id LIMIT 20")
def bm25_proximity_top20(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


@query(f"WITH {_TOKENS_SQL} SELECT doc_id, list_filter(q, lambda x: list_contains(t, x)) AS matched FROM docs, q")
def matched_terms(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", "matched")


@query(
    f"""WITH {_TOKENS_SQL}, r AS (SELECT doc_id, round(score, 6) AS score, len(list_filter(q, lambda x: regexp_matches(x, '\\p{{L}}') AND list_contains(t, x))) > 0 AS topic FROM bm JOIN docs USING (doc_id), q),
k AS (SELECT count(*) FILTER (topic) AS n FROM r)
SELECT doc_id, NOT topic AS readmitted FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, doc_id) AS rn FROM r), k WHERE topic OR rn <= 600 - n"""
)
def relevance_floor(spark, sf_dir):
    scored = _scored(spark, sf_dir).withColumn("score", F.round("score", 6))
    ranked = scored.withColumn("rank", F.struct((-F.col("score")).alias("a"), F.col("doc_id").alias("b")))
    kept = ranking.relevance_floor(ranked, text.query_tokens(question(spark, sf_dir)), 600, pos="rank")
    return kept.select("doc_id", "readmitted")


_LISTS = """lists AS (SELECT doc_id, 1 AS list_no, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS pos FROM documents
UNION ALL SELECT doc_id, 2, row_number() OVER (ORDER BY quality DESC, doc_id) FROM labels UNION ALL SELECT doc_id, 3, row_number() OVER (ORDER BY doc_id) FROM documents)"""


def _numbered(df: DataFrame, list_no: int, *order) -> DataFrame:
    """A whole table as one ranked list: numbers come from ranges of the order, not from one task."""
    rows = sources_table.number(df.select("doc_id", *[o for o in ("n_chars", "quality") if o in df.columns]), "", 0, *order)
    return rows.select("doc_id", F.lit(list_no).alias("list_no"), F.col("id").cast("long").alias("pos"))


def _three_lists(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return (
        _numbered(docs, 1, F.desc("n_chars"), F.asc("doc_id"))
        .unionByName(_numbered(labels, 2, F.desc("quality"), F.asc("doc_id")))
        .unionByName(_numbered(docs.select("doc_id"), 3, F.asc("doc_id")))
    )


@query(f"WITH {_LISTS} SELECT doc_id, round(sum(1.0 / (60 + pos)), 6) AS score, count(DISTINCT list_no) AS found_by FROM lists GROUP BY doc_id")
def rrf_fuse(spark, sf_dir):
    return fusion.rrf(_three_lists(spark, sf_dir), "doc_id", list_no="list_no").withColumn("score", F.round("score", 6))


@query(
    """WITH l AS (SELECT page_id % 3 AS list_no, row_number() OVER (PARTITION BY page_id % 3 ORDER BY page_id) AS pos, page_id, length(html) > 900 AS full_text, """
    + sql.canonical("url")
    + """ AS k FROM pages)
SELECT k AS identity_key, arg_min(page_id, (NOT full_text, list_no, pos)) AS page_id, round(sum(1.0 / (60 + pos)), 6) AS score, count(DISTINCT list_no) AS found_by,
 arg_min(page_id, (NOT full_text, list_no, pos)) AS meta_page FROM l GROUP BY k"""
)
def fuse_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select((F.col("page_id") % 3).alias("list_no"), "page_id", "url", "html")
    lists = fusion.ranked(pages, "list_no", F.asc("page_id")).select(
        "list_no",
        "pos",
        "url",
        F.col("page_id").cast("string").alias("title"),
        F.when(F.length("html") > 900, F.substring("html", 1, 20)).alias("text"),
        F.create_map(F.lit("page"), F.col("page_id").cast("string")).alias("meta"),
        url.identity_key(F.col("url")).alias("identity_key"),
    )
    out = fusion.fuse(lists, "identity_key")
    return out.select("identity_key", F.col("title").cast("long").alias("page_id"), F.round("score", 6).alias("score"), "found_by", F.col("meta")["page"].cast("long").alias("meta_page"))


@query(
    f"""WITH {_TOKENS_SQL}, {_LISTS}, r AS (SELECT doc_id, sum(1.0 / (60 + pos)) AS rrf FROM lists GROUP BY doc_id),
p AS (SELECT doc_id, rrf, score AS content, greatest(0.5, CASE WHEN source = 'src1' THEN 0.9 WHEN source = 'src2' THEN 0.85 ELSE 0 END) AS trust, CASE WHEN doc_id % 5 > 0 THEN 2000 + doc_id % 25 END AS year FROM r JOIN bm USING (doc_id) JOIN docs USING (doc_id)),
e AS (SELECT max(content) AS mc, max(rrf) AS mr, min(year) AS y0, max(year) AS y1 FROM p)
SELECT doc_id, round(0.45 * rrf / greatest(1e-9, mr) + 0.35 * content / greatest(1e-9, mc) + 0.15 * trust + 0.05 * CASE WHEN year IS NULL OR y1 <= y0 THEN 0.5 ELSE (year - y0) / (y1 - y0) END, 6) AS blended FROM p, e"""
)
def blend_scores(spark, sf_dir):
    rrf = fusion.rrf(_three_lists(spark, sf_dir), "doc_id").withColumnRenamed("score", "rrf")
    content = _scored(spark, sf_dir).select("doc_id", F.col("score").alias("content"))
    docs = table(spark, sf_dir, "documents")
    backend = F.when(F.col("source") == "src1", "arxiv").when(F.col("source") == "src2", "wikipedia").otherwise("web")
    pool = rrf.join(content, "doc_id").join(docs.select("doc_id", ranking.trust(backend).alias("trust"), F.when(F.col("doc_id") % 5 > 0, 2000 + F.col("doc_id") % 25).alias("year")), "doc_id")
    return ranking.blend(pool).select("doc_id", "blended")


@query("WITH y AS (SELECT o_orderkey, year(o_orderdate) AS y FROM orders), e AS (SELECT min(y) AS a, max(y) AS b FROM y) SELECT o_orderkey, CASE WHEN b <= a THEN 0.5 ELSE round((y - a) / (b - a), 6) END AS recency FROM y, e")
def recency_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    ends = F.broadcast(rows.agg(F.min("y").alias("a"), F.max("y").alias("b")))
    return rows.crossJoin(ends).select("o_orderkey", F.round(ranking.recency(F.col("y"), F.col("a"), F.col("b")), 6).alias("recency"))


_TOP10 = "top AS (SELECT doc_id FROM bm ORDER BY round(score, 6) DESC, doc_id LIMIT 10)"


def _top(spark, sf_dir, n):
    return _scored(spark, sf_dir).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "doc_id").limit(n)


@query(f"WITH {_TOKENS_SQL}, {_TOP10}, x AS (SELECT unnest(q) AS term FROM q) SELECT term, (SELECT count(*) FROM top JOIN docs USING (doc_id) WHERE list_contains(t, term)) AS sources FROM x")
def term_coverage(spark, sf_dir):
    return ranking.term_coverage(_top(spark, sf_dir, 10), text.query_tokens(question(spark, sf_dir)), "matched")


@query(f"WITH {_TOKENS_SQL}, {_TOP10}, x AS (SELECT unnest(q) AS term FROM q), c AS (SELECT term, (SELECT count(*) FROM top JOIN docs USING (doc_id) WHERE list_contains(t, term)) AS sources FROM x) SELECT term, sources FROM c WHERE sources < 2")
def under_covered(spark, sf_dir):
    return ranking.under_covered(term_coverage(spark, sf_dir))


# --- near-duplicates ------------------------------------------------------------------------------

_FNV = "list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split(g, ''), lambda c: unicode(c)::HUGEINT)), lambda h, c: (xor(h, c) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"
_SIMHASH_SQL = f"""tok AS (SELECT doc_id, length(coalesce(text, '')) AS n, {sql.tokens('text')} AS t FROM documents),
gram AS (SELECT doc_id, unnest(CASE WHEN len(t) < 3 THEN t ELSE list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) END) AS g FROM tok),
one AS (SELECT g, {_FNV} AS h FROM (SELECT DISTINCT g FROM gram)),
bit AS (SELECT doc_id, b, 2 * sum((h // (1::HUGEINT << b)) % 2) > count(*) AS up FROM gram JOIN one USING (g), range(64) AS r(b) GROUP BY doc_id, b),
fp AS (SELECT doc_id, sum(CASE WHEN up THEN 1::HUGEINT << b ELSE 0 END)::HUGEINT AS u FROM bit GROUP BY doc_id),
sim AS (SELECT doc_id, n, (CASE WHEN coalesce(u, 0) >= 9223372036854775808::HUGEINT THEN u - 18446744073709551616::HUGEINT ELSE coalesce(u, 0) END)::BIGINT AS fp FROM tok LEFT JOIN fp USING (doc_id))"""


def _prints(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n"), hashing.simhash(F.col("text")).alias("fp"))


@query(f"WITH {_SIMHASH_SQL} SELECT doc_id, fp FROM sim")
def simhash64(spark, sf_dir):
    return _prints(spark, sf_dir).select("doc_id", "fp")


@query(f"WITH {_SIMHASH_SQL}, d AS (SELECT DISTINCT fp FROM sim WHERE n >= 500) SELECT x.fp AS a, y.fp AS b FROM d x JOIN d y ON x.fp < y.fp AND bit_count(xor(x.fp, y.fp)) <= 3")
def near_dup_pairs(spark, sf_dir):
    return dedup.near_pairs(_prints(spark, sf_dir).filter(F.col("n") >= dedup.MIN_CHARS))


@query(
    f"""WITH RECURSIVE {_SIMHASH_SQL}, n AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY doc_id) AS rn FROM sim),
s AS (SELECT 0::BIGINT AS rn, CAST([] AS BIGINT[]) AS kept, CAST(NULL AS BIGINT) AS doc_id, false AS stays
UNION ALL SELECT rn, CASE WHEN n >= 500 AND free THEN list_append(kept, fp) ELSE kept END, doc_id, n < 500 OR free
FROM (SELECT n.*, s.kept, len(list_filter(s.kept, lambda x: bit_count(xor(x, n.fp)) <= 3)) = 0 AS free FROM s JOIN n ON n.rn = s.rn + 1))
SELECT doc_id FROM s WHERE stays"""
)
def near_dup_keep(spark, sf_dir):
    """Survivors of the greedy scan in the order of ``doc_id``."""
    return dedup.dedupe_near(_prints(spark, sf_dir), "fp", "doc_id", F.col("n") >= dedup.MIN_CHARS).select("doc_id")


@query()
def mmr_order(spark, sf_dir):
    top = _top(spark, sf_dir, 30)
    docs = table(spark, sf_dir, "documents").select("doc_id", terms.distinct_tokens(F.col("text")).alias("tokens"))
    pool = docs.join(F.broadcast(top), "doc_id").select(F.lit(1).alias("pool"), F.col("doc_id").alias("id"), "score", "tokens")
    return dedup.diversify(pool, "pool").select(F.col("id").alias("doc_id"), "mmr_pos")


@query()
def title_clusters(spark, sf_dir):
    """Clusters of all page titles, in probes of ten of a domain by page number; no task has more than a range of the table or a probe."""
    pages = table(spark, sf_dir, "pages").select("page_id", url.domain_of(F.col("url")).alias("domain"), html.html_title(F.col("html")).alias("title"))
    pool = sources_table.probes(pages, "domain", 10, F.asc("page_id")).select("domain", "probe", F.col("page_id").alias("id"), "pos", terms.distinct_tokens(F.col("title")).alias("tokens"))
    found = dedup.cluster_titles(pool.withColumn("pool", F.concat_ws(" ", "domain", F.col("probe").cast("string"))), "pool")
    return pool.select("domain", "probe", F.col("id").alias("page_id")).join(found.select(F.col("id").alias("page_id"), "cluster"), "page_id")


@query(
    f"""SELECT lang, array_to_string(list(token ORDER BY rn), ' ') AS label FROM (SELECT lang, token, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS rn
FROM (SELECT lang, token, count(*) AS n FROM (SELECT lang, unnest({sql.tokens('text')}) AS token FROM documents) GROUP BY lang, token)) WHERE rn <= 3 GROUP BY lang"""
)
def angle_labels(spark, sf_dir):
    return dedup.angle_labels(table(spark, sf_dir, "documents").select("lang", F.explode(terms.tokens(F.col("text"))).alias("token")), "lang")


# --- reports against sources ----------------------------------------------------------------------

_REPORT = "SELECT doc_id AS report_id, array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l, i: l || ' [S' || ((i - 1 + doc_id) % 7 + 1) || ']'), chr(10)) AS text FROM documents"
_CITED = f"cited AS (SELECT DISTINCT report_id, unnest(regexp_extract_all(regexp_replace(text, '`[^`\\n]*`', ' ', 'g'), '\\[(S[0-9]+)\\]', 1)) AS source_id FROM ({_REPORT}))"
_SOURCES = "src AS (SELECT doc_id AS report_id, 'S' || s AS source_id, CASE WHEN s = 1 THEN coalesce(text, '') ELSE '' END AS text, ((doc_id + s) % 10) / 10 AS trust FROM documents, range(1, 6) AS r(s))"


def reports(spark, sf_dir):
    """A report for each document: its lines, each citing one of seven sources."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    cited = F.transform(lines, lambda l, i: F.concat(l, F.lit(" [S"), ((i + F.col("doc_id")) % 7 + 1).cast("string"), F.lit("]")))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("report_id"), F.lit("REPORT.md").alias("file"), F.array_join(cited, "\n").alias("text"))


def report_sources(spark, sf_dir):
    """Five sources for each report; the first is the document itself."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("report_id"), "text", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("s"))
    return docs.select("report_id", F.concat(F.lit("S"), F.col("s").cast("string")).alias("source_id"), F.when(F.col("s") == 1, F.coalesce("text", F.lit(""))).otherwise("").alias("text"), ((F.col("report_id") + F.col("s")) % 10 / 10).alias("trust"))


@query(f"WITH {_CITED} SELECT report_id, count(*) AS n_sources FROM cited GROUP BY report_id")
def claim_tokens(spark, sf_dir):
    return reports(spark, sf_dir).select("report_id", F.size(claims.source_tokens(F.col("text"))).cast("long").alias("n_sources"))


@query(f"WITH {_CITED}, {_SOURCES} SELECT report_id, source_id FROM cited ANTI JOIN src USING (report_id, source_id)")
def dangling_citations(spark, sf_dir):
    return grounding.dangling_citations(reports(spark, sf_dir), report_sources(spark, sf_dir))


@query(f"WITH {_CITED}, {_SOURCES} SELECT report_id, source_id FROM src ANTI JOIN cited USING (report_id, source_id)")
def uncited_sources(spark, sf_dir):
    return grounding.uncited_sources(reports(spark, sf_dir), report_sources(spark, sf_dir)).select("report_id", "source_id")


@query()
def claim_pairs(spark, sf_dir):
    return grounding.claim_pairs(reports(spark, sf_dir), report_sources(spark, sf_dir))


@query()
def numeral_grounding(spark, sf_dir):
    return grounding.ungrounded_numerals(reports(spark, sf_dir), report_sources(spark, sf_dir))


@query()
def unsourced_claims(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("report_id"), F.lit("REPORT.md").alias("file"), "text")
    return grounding.unsourced_claims(docs)


@query()
def check_gate(spark, sf_dir):
    return grounding.check(reports(spark, sf_dir), report_sources(spark, sf_dir))


_PAIRS = "p AS (SELECT 'C' || doc_id AS claim_id, 'S' || (doc_id % 9) AS source_id, (doc_id % 10) / 10 AS trust FROM documents)"


def _claim_rows(spark, sf_dir):
    doc = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("C"), doc.cast("string")).alias("claim_id"), F.concat(F.lit("S"), (doc % 9).cast("string")).alias("source_id"), (doc % 10 / 10).alias("trust"))


@query(f"WITH {_PAIRS} SELECT claim_id, source_id, trust FROM p ORDER BY trust DESC, claim_id, source_id LIMIT 40")
def worklist_top40(spark, sf_dir):
    return grounding.worklist(_claim_rows(spark, sf_dir)).drop("pos")


@query(f"WITH {_PAIRS}, t AS (SELECT *, row_number() OVER (ORDER BY trust DESC, claim_id, source_id) AS rn FROM p ORDER BY rn LIMIT 40) SELECT claim_id, source_id FROM t WHERE (rn - 1) % 4 = 1")
def worklist_shard(spark, sf_dir):
    return grounding.worklist(_claim_rows(spark, sf_dir), shards=4, shard=1).select("claim_id", "source_id")


_VERDICTS = "v AS (SELECT 'C' || (doc_id // 3) AS claim_id, 'S' || (doc_id % 9) AS source_id, doc_id AS seq, CASE WHEN doc_id % 4 = 0 THEN 'unsupported' WHEN toxic = 1 THEN 'refuted' WHEN quality = 1 THEN 'supported' ELSE 'partial' END AS verdict FROM labels)"


def verdicts(spark, sf_dir):
    doc = F.col("doc_id")
    kind = F.when(doc % 4 == 0, "unsupported").when(F.col("toxic") == 1, "refuted").when(F.col("quality") == 1, "supported").otherwise("partial")
    return table(spark, sf_dir, "labels").select(F.concat(F.lit("C"), F.floor(doc / 3).cast("string")).alias("claim_id"), F.concat(F.lit("S"), (doc % 9).cast("string")).alias("source_id"), doc.alias("seq"), kind.alias("verdict"))


@query(
    f"""WITH {_VERDICTS}, c AS (SELECT claim_id, count(*) AS pairs, count(*) FILTER (verdict = 'supported') AS supported, count(*) FILTER (verdict = 'partial') AS partial,
count(*) FILTER (verdict = 'unsupported') AS unsupported, count(*) FILTER (verdict = 'refuted') AS refuted FROM v GROUP BY claim_id)
SELECT *, CASE WHEN refuted > 0 THEN 'refuted' WHEN supported + partial + refuted + unsupported < pairs THEN 'unadjudicated' WHEN supported + partial = 0 THEN 'unsupported' ELSE 'ok' END AS status, supported + partial > 0 AND refuted > 0 AS contradiction FROM c"""
)
def reduce_verdicts(spark, sf_dir):
    return grounding.reduce_verdicts(verdicts(spark, sf_dir))


@query(f"WITH {_VERDICTS} SELECT * FROM (SELECT claim_id, list_sort(list(DISTINCT source_id) FILTER (verdict IN ('supported', 'partial'))) AS supporting, list_sort(list(DISTINCT source_id) FILTER (verdict = 'refuted')) AS refuting FROM v GROUP BY claim_id) WHERE len(supporting) > 0 AND len(refuting) > 0")
def contradictions(spark, sf_dir):
    return grounding.contradictions(verdicts(spark, sf_dir))


@query(f"WITH {_VERDICTS} SELECT source_id, arg_max(verdict, CASE verdict WHEN 'supported' THEN 0 WHEN 'partial' THEN 1 WHEN 'unsupported' THEN 2 ELSE 3 END) AS verdict FROM v GROUP BY source_id")
def worst_verdict(spark, sf_dir):
    return grounding.worst_verdict(verdicts(spark, sf_dir))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS verdict FROM events GROUP BY user_id")
def verdict_last_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("claim_id"), F.lit("S1").alias("source_id"), "ts", "event_id", F.col("event_type").alias("verdict"))
    return grounding.last_verdicts(rows, "ts", "event_id").select(F.col("claim_id").alias("user_id"), "verdict")


@query(f"WITH {_VERDICTS}, a AS (SELECT DISTINCT 'C' || (doc_id // 3) AS claim_id, 'S' || (doc_id % 9) AS source_id FROM documents) SELECT claim_id, source_id FROM a ANTI JOIN v USING (claim_id, source_id)")
def coverage_gate(spark, sf_dir):
    doc = F.col("doc_id")
    pairs = table(spark, sf_dir, "documents").select(F.concat(F.lit("C"), F.floor(doc / 3).cast("string")).alias("claim_id"), F.concat(F.lit("S"), (doc % 9).cast("string")).alias("source_id"))
    return grounding.uncovered_pairs(pairs, verdicts(spark, sf_dir))


# --- runs, ingest, cache --------------------------------------------------------------------------


@query(
    f"""SELECT k AS identity_key, round(sum(1.0 / (60 + pos)), 6) AS score, count(DISTINCT d) AS found_by, array_to_string(list_sort(list(DISTINCT 'run' || d)), ',') AS runs
FROM (SELECT {sql.canonical('url')} AS k, page_id % 4 AS d, page_id // 4 + 1 AS pos FROM pages) GROUP BY k"""
)
def merge_provenance(spark, sf_dir):
    page = F.col("page_id")
    runs = table(spark, sf_dir, "pages").select(url.identity_key(F.col("url")).alias("identity_key"), F.concat(F.lit("run"), (page % 4).cast("string")).alias("run_dir"), F.lit("q").alias("sub_question"), (F.floor(page / 4) + 1).alias("pos"))
    out = sources_table.merge_runs(runs)
    return out.select("identity_key", F.round("score", 6).alias("score"), "found_by", F.array_join(F.transform("provenance", lambda p: p["run_dir"]), ",").alias("runs"))


@query("SELECT doc_id, source, rn FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn <= 5")
def top_per_source(spark, sf_dir):
    return fusion.top_per_group(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "source", 5, F.desc("n_chars"), F.asc("doc_id")).select("doc_id", "source", "rn")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'")
def since_filter(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter(F.col("o_orderdate") >= text.since("1997").cast("timestamp_ntz")).select("o_orderkey")


@query("WITH n AS (SELECT max(ts) AS now FROM events) SELECT user_id, arg_max(value, (ts, event_id)) AS value FROM events, n WHERE ts > now - INTERVAL 24 HOUR GROUP BY user_id")
def cache_ttl(spark, sf_dir):
    """Events as cache entries: the last of each user that is not older than a day at the latest event."""
    events = table(spark, sf_dir, "events")
    now = F.broadcast(events.agg(F.max("ts").alias("now")))
    live = events.crossJoin(now).filter(F.col("ts") > F.col("now") - F.expr("INTERVAL 24 HOURS"))
    return live.groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


@query(f"SELECT k AS canonical_url, 'S' || row_number() OVER (ORDER BY p) AS id FROM (SELECT {sql.canonical('url')} AS k, min(page_id) AS p FROM pages GROUP BY 1)")
def ingest_dedupe(spark, sf_dir):
    """All pages into an empty table of sources, each twice: the second copy is refused."""
    pages = table(spark, sf_dir, "pages")
    new = pages.select(F.col("page_id").alias("pos"), "url", F.lit(None).cast("string").alias("title"), F.lit("a page").alias("text"))
    twice = new.unionByName(new.withColumn("pos", F.col("pos") + 1_000_000_000))
    none = spark.createDataFrame([], "id string, canonical_url string")
    return sources_table.add_sources(none, twice).filter("refused is null").select("canonical_url", "id")


@query("SELECT event_type AS extractor, count(*) AS n FROM events GROUP BY event_type")
def extractor_tally(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("extractor")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query(
    """WITH e AS (SELECT source AS engine, count(*) AS items, row_number() OVER (ORDER BY source) AS preference FROM documents GROUP BY source)
SELECT preference, engine, items FROM (SELECT *, sum((items >= 40)::INT) OVER (ORDER BY preference ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e) WHERE coalesce(before, 0) < 3"""
)
def cascade_waves(spark, sf_dir):
    """Sources as engines in name order; waves until three gave 40 items. One engine is asked at a time here, as the SQL counts."""
    engines = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("engine")).agg(F.count(F.lit(1)).alias("items"))
    engines = engines.withColumn("preference", F.row_number().over(Window.orderBy("engine")))
    return fusion.cascade(engines, 40, 3)


@query(
    """SELECT doc_id, md5(array_to_string(list_transform(range(1, len(w) + 1), lambda i: w[i]), ' ')) AS digest FROM (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w FROM documents)"""
)
def inverted_to_text(spark, sf_dir):
    """Texts to inverted indexes (word: positions) and back; positions are sorted inside each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)).alias("w"))
    words = docs.select("doc_id", F.posexplode("w").alias("pos", "word"))
    inverted = words.groupBy("doc_id", "word").agg(F.collect_list("pos").alias("positions"))
    flat = inverted.select("doc_id", F.explode("positions").alias("pos"), "word")
    back = flat.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("text"))
    return docs.select("doc_id").join(back, "doc_id", "left").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))


@query("SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey) - 1) // 8 AS batch FROM customer")
def worklist_batches(spark, sf_dir):
    """All customers as a worklist, in batches of eight."""
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    return sources_table.batches(customers, 8, F.asc("c_custkey")).select("c_custkey", F.col("batch").cast("long").alias("batch"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def hourly_events(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def flagship(spark: SparkSession, sf_dir: str, n: int = 10) -> DataFrame:
    """Search: BM25F fused with two other lists, blended with trust and year; the ten best."""
    return blend_scores(spark, sf_dir).orderBy(F.desc("blended"), "doc_id").limit(n)
