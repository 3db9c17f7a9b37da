"""Queries of URL rules, providers, locales, verdict files, run records and reports, on rows made of whole tables.

The SQL states the expected results by the way the rows are made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions import claims, locale, providers, text, url
from siftline.operators import dedup, grounding, ranking, relink, sources_table, verdicts
from siftline.plans import facets, modes
from siftline.sources import files

from . import sqltext as sql
from .catalog import query, table

_P = "p AS (SELECT p_partkey AS i, CAST(p_partkey AS VARCHAR) AS k, p_name AS n FROM part)"


def parts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.col("p_partkey").cast("string").alias("k"), F.col("p_name").alias("n"))


def _cases(column: str, values: list[str]) -> str:
    """A CASE over ``i`` modulo the number of values, in SQL that both engines read."""
    return f"CASE i % {len(values)} " + " ".join(f"WHEN {j} THEN {v}" for j, v in enumerate(values)) + f" END AS {column}"


# --- URLs -----------------------------------------------------------------------------------------

_WORKS = [
    ("concat('https://doi.org/10.1234/AB', k)", "concat('10.1234/ab', k)", "NULL"),
    ("concat('http://dx.doi.org/10.5555%2Fx', k)", "concat('10.5555/x', k)", "NULL"),
    ("concat('https://dl.acm.org/doi/abs/10.1145/', k, '?q=1')", "concat('10.1145/', k)", "NULL"),
    ("concat('https://arxiv.org/pdf/2001.', lpad(k, 5, '0'), 'v3.pdf')", "NULL", "concat('2001.', lpad(k, 5, '0'))"),
    ("concat('https://arxiv.org/abs/hep-th/', lpad(k, 7, '0'))", "NULL", "concat('hep-th/', lpad(k, 7, '0'))"),
    ("concat('https://example.com/doi/', k)", "NULL", "NULL"),
    ("concat('https://doi.org/not-a-doi/', k)", "NULL", "NULL"),
]


@query(f"WITH {_P} SELECT i, {_cases('doi', [w[1] for w in _WORKS])}, {_cases('arxiv_id', [w[2] for w in _WORKS])} FROM p")
def work_ids(spark, sf_dir):
    rows = parts(spark, sf_dir).selectExpr("i", _cases("url", [w[0] for w in _WORKS]))
    return rows.select("i", url.doi_from_url(F.col("url")).alias("doi"), url.arxiv_from_url(F.col("url")).alias("arxiv_id"))


@query(f"WITH {_P} SELECT i, '10.1000/ab c' || k AS doi FROM p")
def normalized_dois(spark, sf_dir):
    return parts(spark, sf_dir).select("i", url.normalize_doi(F.concat(F.when(F.col("i") % 2 == 0, "  https://dx.doi.org/10.1000/AB c").otherwise("10.1000/aB C"), "k", F.lit(" "))).alias("doi"))


_ADDRESSES = [
    ("concat('https://eutils.x.org/efetch.fcgi?db=pubmed&id=', k, ',', k, ',7')", "3", "false"),
    ("concat('https://x.org/records?ids=', k, '+9')", "2", "false"),
    ("concat('https://x.org/page/', k)", "0", "false"),
    ("concat('https://x.org/view?id=', k)", "1", "false"),
    ("concat('https://publisher.org/10.1111/j.', k)", "0", "true"),
    ("concat('https://x.org/abs/2101.0', lpad(k % 10000, 4, '0'))", "0", "true"),
]


@query(f"WITH {_P} SELECT i, CAST({_cases('x', [w[1] for w in _ADDRESSES])[:-5]} AS INT) AS ids, CAST({_cases('x', [w[2] for w in _ADDRESSES])[:-5]} AS BOOLEAN) AS declares FROM p")
def addressed_records(spark, sf_dir):
    rows = parts(spark, sf_dir).selectExpr("i", _cases("url", [w[0] for w in _ADDRESSES]))
    return rows.select("i", url.addressed_ids(F.col("url")).alias("ids"), url.declares_identity(F.col("url")).alias("declares"))


_FORMATS = [
    ("concat('https://x.org/a', k, '.pdf?x=1')", "true", "NULL"),
    ("concat('https://x.org/doi/pdf/10.1/', k)", "true", "NULL"),
    ("concat('https://x.org/pdf/a', k, '.html')", "false", "NULL"),
    ("concat('https://x.org/a', k, '.DOCX')", "false", "'docx'"),
    ("concat('https://x.org/a', k, '.xlsx#s')", "false", "'xlsx'"),
    ("concat('https://x.org/a', k)", "false", "NULL"),
    ("concat('https://x.org/a', k, '.epub')", "false", "'epub'"),
]


@query(f"WITH {_P} SELECT i, CAST({_cases('x', [w[1] for w in _FORMATS])[:-5]} AS BOOLEAN) AS pdf, {_cases('format', [w[2] for w in _FORMATS])} FROM p")
def document_formats(spark, sf_dir):
    rows = parts(spark, sf_dir).selectExpr("i", _cases("url", [w[0] for w in _FORMATS]))
    return rows.select("i", url.looks_like_pdf(F.col("url")).alias("pdf"), url.doc_format(F.col("url")).alias("format"))


_TEXTS = [
    ("concat('See doi 10.1234/', k, '. and arXiv:2001.00001')", "concat('https://doi.org/10.1234/', k)"),
    ("concat('arXiv:2001.', lpad(k, 5, '0'), ' PMID: 123456')", "concat('https://arxiv.org/abs/2001.', lpad(k, 5, '0'))"),
    ("concat('PMID: ', 100000 + i, ', a record')", "concat('https://pubmed.ncbi.nlm.nih.gov/', 100000 + i, '/')"),
    ("concat('nothing to cite in ', n)", "NULL"),
    ("concat(repeat('x ', 2100), '10.1234/', k)", "NULL"),
]


@query(f"WITH {_P} SELECT i, {_cases('cite', [w[1] for w in _TEXTS])} FROM p")
def derived_citations(spark, sf_dir):
    return parts(spark, sf_dir).selectExpr("i", _cases("t", [w[0] for w in _TEXTS])).select("i", url.derive_citable_url(F.col("t")).alias("cite"))


_EFETCH = "'https://eutils.ncbi.nlm.nih.gov/entrez/eutils/efetch.fcgi?db=pubmed&id='"
_PROVIDED = [
    ("concat(' https://pubmed.ncbi.nlm.nih.gov/', 100000 + i, ' ')", "concat('https://pubmed.ncbi.nlm.nih.gov/', 100000 + i, '/')", f"concat({_EFETCH}, 100000 + i, '&rettype=abstract&retmode=text')", "NULL"),
    ("concat('https://pmc.ncbi.nlm.nih.gov/articles/pmc', k, '/')", "concat('https://pmc.ncbi.nlm.nih.gov/articles/PMC', k, '/')", "NULL", "NULL"),
    ("concat('https://export.arxiv.org/pdf/2001.', lpad(k, 5, '0'), 'v2.pdf')", "concat('https://arxiv.org/abs/2001.', lpad(k, 5, '0'), 'v2')", "concat('https://export.arxiv.org/pdf/2001.', lpad(k, 5, '0'), 'v2.pdf')", "NULL"),
    ("concat('https://eutils.ncbi.nlm.nih.gov/entrez/eutils/eSearch.fcgi?term=', k)", "concat('https://eutils.ncbi.nlm.nih.gov/entrez/eutils/eSearch.fcgi?term=', k)", "NULL", "'a query, not a document: esearch'"),
    ("concat('https://eutils.ncbi.nlm.nih.gov/entrez/eutils/efetch.fcgi?db=pmc&id=', k, '%20', 9)", "concat('https://pmc.ncbi.nlm.nih.gov/articles/PMC', k, '/')", "NULL", "NULL"),
    ("concat('https://example.com/', k)", "concat('https://example.com/', k)", "NULL", "NULL"),
]


@query(f"WITH {_P} SELECT i, {_cases('cite_url', [w[1] for w in _PROVIDED])}, {_cases('text_url', [w[2] for w in _PROVIDED])}, i % {len(_PROVIDED)} = 2 AS prefer_text, {_cases('reject', [w[3] for w in _PROVIDED])} FROM p")
def provider_rules(spark, sf_dir):
    rows = parts(spark, sf_dir).selectExpr("i", _cases("url", [w[0] for w in _PROVIDED]))
    return rows.select("i", providers.resolve_provider(F.col("url")).alias("x")).select("i", "x.*")


_LOCALES = [("'en'", "NULL", "'us-en'", "'en-US,en;q=0.9'"), ("'de-AT'", "NULL", "'at-de'", "'de-AT,de;q=0.9,en;q=0.5'"), ("'ja'", "''", "'jp-ja'", "'ja-JP,ja;q=0.9,en;q=0.5'"), ("'EN'", "' GB '", "'uk-en'", "'en-GB,en;q=0.9'"), ("NULL", "NULL", "'us-en'", "'en-US,en;q=0.9'"), ("'fr'", "NULL", "'fr-fr'", "'fr-FR,fr;q=0.9,en;q=0.5'")]


@query(f"WITH {_P} SELECT i, {_cases('engine_region', [w[2] for w in _LOCALES])}, {_cases('accept', [w[3] for w in _LOCALES])} FROM p")
def locales(spark, sf_dir):
    rows = parts(spark, sf_dir).selectExpr("i", _cases("lang", [w[0] for w in _LOCALES]), _cases("region", [w[1] for w in _LOCALES]))
    lang, region = F.col("lang"), F.col("region").cast("string")
    return rows.select("i", locale.engine_region(lang, region).alias("engine_region"), locale.accept_language(lang, region).alias("accept"))


@query(f"SELECT page_id, CASE WHEN d = 'example.com' OR d LIKE '%.example.com' THEN 0.95e0 ELSE 0.5e0 END AS trust FROM (SELECT page_id, {sql.domain('url')} AS d FROM pages)")
def seeded_trust(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", ranking.trust(F.lit("web"), url.in_domains(F.col("url"), ["example.com"])).alias("trust"))


# --- words ----------------------------------------------------------------------------------------


@query(
    f"""WITH {_P}, w AS (SELECT i, list_concat(string_split(lower(n), ' '), CASE WHEN length(k) > 0 THEN [k] ELSE [] END) AS w FROM p WHERE n IS NOT NULL)
SELECT i, list_filter(list_filter(w, lambda x: length(x) >= 3 AND x NOT IN {sql.STOP}), lambda x, j: list_position(list_filter(w, lambda y: length(y) >= 3 AND y NOT IN {sql.STOP}), x) = j)[1:4] AS subtokens FROM w"""
)
def compound_parts(spark, sf_dir):
    """Names written as one compound with their number: SmallRing12."""
    rows = parts(spark, sf_dir).filter("n is not null")
    return rows.select("i", text.subtokens(F.concat(F.replace(F.initcap("n"), F.lit(" "), F.lit("")), "k")).alias("subtokens"))


TOPIC = "How do Cold Bolts and large-widgets meet?"
# stated here, not taken from the code: the words of the topic with the spellings that count
_TOPIC_PATTERNS = {"cold": "cold", "bolt": "bolts|bolt", "large": "large", "widget": "widgets|widget", "meet": "meet"}


@query(f"WITH {_P} SELECT i, round(({' + '.join(f'CAST(regexp_matches(lower(n), {sql.q(x)}) AS INT)' for x in _TOPIC_PATTERNS.values())}) / {len(_TOPIC_PATTERNS)}, 6) AS coverage FROM p")
def content_coverage(spark, sf_dir):
    return parts(spark, sf_dir).select("i", F.round(text.content_coverage(F.col("n"), TOPIC), 6).alias("coverage"))


@query(
    """WITH m(name, backends, more) AS (VALUES ('topic', ['wikipedia', 'searxng', 'duckduckgo', 'standards'], CAST([] AS VARCHAR[])), ('bug', ['stackexchange', 'github', 'duckduckgo', 'hackernews', 'standards'], ['searxng']),
 ('research', ['arxiv', 'openalex', 'crossref', 'semanticscholar', 'europepmc'], ['pubmed', 'dblp', 'duckduckgo', 'wikipedia']), ('learn', ['wikipedia', 'duckduckgo', 'searxng'], ['standards']), ('startup', ['duckduckgo', 'searxng', 'hackernews'], ['wikipedia'])),
c AS (SELECT c_custkey, ['topic', 'bug', 'research', 'learn', 'startup'][c_nationkey % 5 + 1] AS name, c_acctbal > 5000 AS deep FROM customer), l AS (SELECT c_custkey, CASE WHEN deep THEN list_concat(backends, more) ELSE backends END AS lane FROM c JOIN m USING (name))
SELECT c_custkey, unnest(lane) AS backend, unnest(range(0, len(lane)))::INTEGER AS pos FROM l"""
)
def lanes(spark, sf_dir):
    """The backends that each customer's run searches, in order: the mode goes by nation, rich ones search deeply."""
    names = F.array(*[F.lit(m) for m in ("topic", "bug", "research", "learn", "startup")])
    runs = table(spark, sf_dir, "customer").select("c_custkey", F.get(names, (F.col("c_nationkey") % 5).cast("int")).alias("mode"), F.when(F.col("c_acctbal") > 5000, "deep").otherwise("standard").alias("depth"))
    return modes.run_lanes(runs).select("c_custkey", "backend", "pos")


@query(f"WITH {_P}, t AS (SELECT i, list_distinct(string_split(n, ' ')) AS t FROM p WHERE n IS NOT NULL), o AS (SELECT ['cold', 'bolt', 'large'] AS o) SELECT i, round(len(list_intersect(t, o)) / (len(t) + 3 - len(list_intersect(t, o))), 6) AS jaccard FROM t, o")
def name_jaccard(spark, sf_dir):
    """Overlap of the words of each name with three words."""
    overlap = dedup.jaccard(F.split("n", " "), F.array(*[F.lit(x) for x in ("cold", "bolt", "large")]))
    return parts(spark, sf_dir).filter("n is not null").select("i", F.round(overlap, 6).alias("jaccard"))


_HEADINGS = [h for m in modes.MODES.values() for h in m.headings] + ["Something else entirely"]
_FIRST = {c: "CASE " + " ".join(f"WHEN regexp_matches(h, {sql.q('(?i)' + r[0])}) THEN {v(r)}" for r in facets.FACETS) for c, v in {
    "asked": lambda r: f"replace({sql.q(r[1])}, '{{s}}', s)", "angle": lambda r: sql.q(r[2]), "terms": lambda r: f"[{sql.q(r[3][0])}, {sql.q(r[3][1])}]"}.items()}
_VERBS = "(?i)\\b(" + "|".join(facets.CLAUSE_VERBS) + ")\\b"


@query(
    f"""WITH {_P}, x AS (SELECT i, CASE WHEN i % 3 = 0 THEN n || ' that runs hot' WHEN i % 7 = 0 THEN 'one two three four five six seven ' || n ELSE n END AS s, unnest([{', '.join(sql.q(h) for h in _HEADINGS)}]) AS h FROM p WHERE n IS NOT NULL)
SELECT i, h AS heading, CASE WHEN len(list_filter(regexp_split_to_array(s, '\\s+'), lambda w: w <> '')) >= 8 OR regexp_matches(s, {sql.q(_VERBS)}) THEN 'In the context of "About ' || s || '", ' || {_FIRST['angle']} ELSE 'what does the evidence say about ' || lower(h) END || '?'
 ELSE {_FIRST['asked']} ELSE 'What does the evidence say about ' || lower(h) || ' for ' || s || '?' END END AS question, {_FIRST['terms']} ELSE ({sql.keywords('h')})[1:2] END AS terms FROM x"""
)
def facet_questions(spark, sf_dir):
    """What each heading of all modes, and one that is in none, asks about the parts; some subjects are clauses."""
    i, n = F.col("i"), F.col("n")
    subject = F.when(i % 3 == 0, F.concat(n, F.lit(" that runs hot"))).when(i % 7 == 0, F.concat(F.lit("one two three four five six seven "), n)).otherwise(n)
    rows = parts(spark, sf_dir).filter("n is not null").select("i", subject.alias("s"), F.explode(F.array(*[F.lit(h) for h in _HEADINGS])).alias("heading"))
    return rows.select("i", "heading", facets.facet_question(F.col("s"), F.col("heading"), F.concat(F.lit("About "), "s", F.lit("??"))).alias("x")).select("i", "heading", "x.*")


# --- verdict files and run records ----------------------------------------------------------------

_KIND = "CASE WHEN doc_id % 7 = 0 THEN 'maybe' WHEN toxic = 1 AND doc_id % 3 = 0 THEN 'refuted' WHEN doc_id % 17 = 0 THEN 'unsupported' WHEN quality = 1 THEN 'supported' ELSE 'partial' END"
_GATE = f"""l AS (SELECT doc_id, doc_id // 20 AS run_id, doc_id % 3 AS file_no, 'C' || ((doc_id % 20) // 4) AS claim_id, 'S' || (doc_id % 2) AS source_id, {_KIND} AS verdict FROM labels),
m AS (SELECT run_id, claim_id, source_id, nullif(verdict, 'maybe') AS verdict FROM (SELECT *, row_number() OVER (PARTITION BY run_id, claim_id, source_id ORDER BY file_no DESC, doc_id DESC) AS rn FROM l WHERE doc_id % 11 <> 0) WHERE rn = 1),
c AS (SELECT run_id, claim_id, count(*) AS pairs, count(verdict) AS judged, count(*) FILTER (verdict = 'supported') AS supported, count(*) FILTER (verdict = 'partial') AS partial, count(*) FILTER (verdict = 'unsupported') AS unsupported, count(*) FILTER (verdict = 'refuted') AS refuted FROM m GROUP BY ALL),
f AS (SELECT run_id, sum(pairs)::BIGINT AS pairs, sum(supported)::BIGINT AS supported, sum(partial)::BIGINT AS partial, sum(unsupported)::BIGINT AS unsupported, sum(refuted)::BIGINT AS refuted, count(*) FILTER (refuted > 0 OR (judged = pairs AND supported + partial = 0)) AS failures,
 count(*) FILTER (judged < pairs) AS unadjudicated, count(*) FILTER (refuted > 0 AND supported + partial > 0) AS contradictions FROM c GROUP BY run_id),
x AS (SELECT run_id, count(*) AS refused FROM (SELECT run_id, file_no FROM l GROUP BY ALL HAVING count(*) FILTER (doc_id % 11 <> 0) = 0) GROUP BY run_id),
u AS (SELECT run_id, count(*) AS uncovered FROM (SELECT DISTINCT run_id, claim_id, source_id FROM l WHERE doc_id % 5 <> 0) e WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.run_id = e.run_id AND m.claim_id = e.claim_id AND m.source_id = e.source_id AND m.verdict IS NOT NULL) GROUP BY run_id)"""


def verdict_files(spark, sf_dir) -> DataFrame:
    """Three files for each run of twenty labels: an array, and arrays in ``pairs`` and in ``verdicts``. Some rows lack a claim, some verdicts are of no known kind."""
    doc = F.col("doc_id")
    item = F.struct(
        F.when(doc % 11 != 0, F.concat(F.lit("C"), F.floor((doc % 20) / 4).cast("string"))).alias("claimId"),
        F.concat(F.lit("S"), (doc % 2).cast("string")).alias("sourceId"),
        F.expr(_KIND).alias("verdict"),
    )
    rows = table(spark, sf_dir, "labels").select(F.floor(doc / 20).cast("long").alias("run_id"), (doc % 3).alias("file_no"), "doc_id", F.to_json(item).alias("item"))
    own = rows.groupBy("run_id", "file_no").agg(F.array_sort(F.collect_list(F.struct("doc_id", "item"))).alias("items"))  # seven rows at most
    array = F.concat(F.lit("["), F.array_join(F.transform("items", lambda x: x["item"]), ","), F.lit("]"))
    payload = F.when(F.col("file_no") == 0, array).when(F.col("file_no") == 1, F.concat(F.lit('{"pairs":'), array, F.lit("}"))).otherwise(F.concat(F.lit('{"verdicts":'), array, F.lit("}")))
    return own.select("run_id", "file_no", payload.alias("payload"))


@query(f"WITH {_GATE} SELECT run_id, claim_id, source_id, verdict FROM m")
def verdict_rows(spark, sf_dir):
    return verdicts.merged_verdicts(verdict_files(spark, sf_dir)).drop("note")


@query(
    f"""WITH {_GATE} SELECT r.run_id, coalesce(pairs, 0) AS pairs, coalesce(supported, 0) AS supported, coalesce(partial, 0) AS partial, coalesce(unsupported, 0) AS unsupported, coalesce(refuted, 0) AS refuted, coalesce(failures, 0) AS failures,
coalesce(unadjudicated, 0) AS unadjudicated, coalesce(contradictions, 0) AS contradictions, coalesce(refused, 0) AS refused, coalesce(uncovered, 0) AS uncovered, coalesce(supported + partial + unsupported + refuted, 0) AS adjudicated,
coalesce(supported + partial + unsupported + refuted, 0) > 0 AND coalesce(failures, 0) = 0 AND coalesce(refused, 0) = 0 AND coalesce(uncovered, 0) = 0 AS ok
FROM (SELECT DISTINCT doc_id // 20 AS run_id FROM documents) r LEFT JOIN f USING (run_id) LEFT JOIN x USING (run_id) LEFT JOIN u USING (run_id)"""
)
def semantic_gate(spark, sf_dir):
    """Runs are those of all documents; runs without labels have no file and fail."""
    runs = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 20).cast("long").alias("run_id"))
    doc = F.col("doc_id")
    expected = table(spark, sf_dir, "labels").filter(doc % 5 != 0).select(F.floor(doc / 20).cast("long").alias("run_id"), F.concat(F.lit("C"), F.floor((doc % 20) / 4).cast("string")).alias("claim_id"), F.concat(F.lit("S"), (doc % 2).cast("string")).alias("source_id"))
    return verdicts.semantic_gate(runs, verdict_files(spark, sf_dir), expected)


@query(
    """WITH m AS (SELECT c_nationkey AS nation, c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'standard' ELSE 'summary' END AS depth, ['arxiv', 'b' || (c_custkey % 4)] AS backends FROM customer)
SELECT nation, max('2024-01-' || lpad(CAST(k % 28 + 1 AS VARCHAR), 2, '0')) AS built_at, coalesce(arg_max(depth, CASE depth WHEN 'summary' THEN 1 ELSE 2 END) FILTER (depth IS NOT NULL), 'deep') AS depth,
list_sort(list_distinct(flatten(list(backends)))) AS backends, list_sort(list_distinct(flatten(list(backends[1:1])))) AS backends_used, count(*) AS sub_questions FROM m GROUP BY nation"""
)
def merged_manifests(spark, sf_dir):
    key = F.col("c_custkey")
    backends = F.array(F.lit("arxiv"), F.concat(F.lit("b"), (key % 4).cast("string")))
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("nation"), key.cast("string").alias("run_dir"), F.concat(F.lit("2024-01-"), F.lpad((key % 28 + 1).cast("string"), 2, "0")).alias("built_at"),
        F.when(key % 5 == 0, None).when(key % 3 == 0, "standard").otherwise("summary").alias("depth"), backends.alias("backends"), F.slice(backends, 1, 1).alias("backends_used"),
    )
    return verdicts.merge_manifests(rows, "nation")


@query(
    """WITH k AS (SELECT source AS run, md5(coalesce(text, '')) AS key, lang FROM documents), g AS (SELECT run, count(*) AS found, count(DISTINCT key) AS uniq, list_sort(list_distinct(list(lang) FILTER (lang IS NOT NULL))) AS used FROM k GROUP BY run)
SELECT run, found, uniq AS distinct_found, used AS backends_used, found - uniq AS duplicates, least(uniq, 35) AS kept, uniq - least(uniq, 35) AS not_fetched, least(uniq, 35) < 12 AS thin FROM g"""
)
def run_tallies(spark, sf_dir):
    """Sources as runs, languages as backends, texts as identities."""
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("run"), F.col("lang").alias("backend"), F.md5(F.coalesce("text", F.lit(""))).alias("identity_key"))
    return verdicts.run_tallies(rows, "run", 12, 35)


@query(
    """WITH p AS (SELECT page_id AS pos, CASE page_id % 4 WHEN 0 THEN 404 WHEN 1 THEN 200 WHEN 2 THEN 403 ELSE 500 END AS status, CASE WHEN page_id % 3 = 0 THEN 'own' END AS text, 'saved ' || page_id AS archived FROM pages),
c AS (SELECT pos FROM p WHERE status IN (403, 404) AND text IS NULL ORDER BY pos LIMIT 5) SELECT pos, CASE WHEN c.pos IS NOT NULL THEN archived ELSE text END AS text, c.pos IS NOT NULL AS rescued FROM p LEFT JOIN c USING (pos)"""
)
def rescued_pages(spark, sf_dir):
    page = F.col("page_id")
    rows = table(spark, sf_dir, "pages").select(page.alias("pos"), F.when(page % 4 == 0, 404).when(page % 4 == 1, 200).when(page % 4 == 2, 403).otherwise(500).alias("status"), F.when(page % 3 == 0, "own").alias("text"), F.concat(F.lit("saved "), page.cast("string")).alias("archived"))
    return files.cap_rescues(rows).select("pos", "text", "rescued")


@query(f"WITH {_P}, s AS (SELECT 'S' || i AS id, CASE WHEN i % 6 = 0 THEN 'https://api.x.org/api/v1/' || i ELSE 'https://x.org/' || (i // 3) END AS u FROM p), t AS (SELECT u, arg_min(id, CAST(id[2:] AS BIGINT)) AS first, count(*) AS n FROM s GROUP BY u) SELECT id, unnest(list_filter([CASE WHEN u LIKE '%/api/%' THEN 'not citable' END, CASE WHEN n > 1 AND id <> first THEN 'duplicate of ' || first END], lambda x: x IS NOT NULL)) AS issue FROM s JOIN t USING (u)")
def source_issues(spark, sf_dir):
    own = F.when(F.col("i") % 6 == 0, F.concat(F.lit("https://api.x.org/api/v1/"), "k")).otherwise(F.concat(F.lit("https://x.org/"), F.floor(F.col("i") / 3).cast("string")))
    return sources_table.issues(parts(spark, sf_dir).select(F.concat(F.lit("S"), "k").alias("id"), own.alias("canonical_url"), F.lit("a text").alias("text")))


@query(f"WITH {_P} SELECT 'S' || i AS id, CASE WHEN i % 2 = 0 THEN 'https://doi.org/10.9000/' || k ELSE 'https://x.org/' || k END AS canonical_url FROM p")
def relinked_sources(spark, sf_dir):
    own = F.when(F.col("i") % 2 == 0, F.concat(F.lit("https://api.x.org/api/v1/"), "k")).otherwise(F.concat(F.lit("https://x.org/"), "k"))
    rows = parts(spark, sf_dir).select(F.lit(1).alias("run"), F.concat(F.lit("S"), "k").alias("id"), own.alias("url"), own.alias("canonical_url"), F.concat(F.lit("as 10.9000/"), "k", F.lit(".")).alias("text"), F.lit("t").alias("title"), F.lit("file").alias("backend"))
    return relink.auto_relink(rows)[0].select("id", "canonical_url")


@query(f"WITH {_P}, b AS (SELECT i, i % 40 AS g, 'byte' || (2000 + i % 3) || 'cold' AS base FROM p) SELECT g, 'S' || i AS id, base || CASE WHEN row_number() OVER w = 1 THEN '' ELSE CAST(row_number() OVER w AS VARCHAR) END AS key FROM b WINDOW w AS (PARTITION BY g, base ORDER BY i)")
def citation_keys(spark, sf_dir):
    rows = parts(spark, sf_dir).select((F.col("i") % 40).alias("g"), F.concat(F.lit("S"), "k").alias("id"), F.col("i").alias("pos"), F.lit("Ada Byte").alias("author"), (2000 + F.col("i") % 3).alias("year"), F.lit("On a Cold morning").alias("title"))
    return sources_table.bibliography_keys(rows, "g")


_ENTRY = "'@article{k' || k || ',' || chr(10) || '  title = {' || n || ' x},' || chr(10) || '  author = {Ada B and Cy D},' || chr(10) || CASE WHEN i % 2 = 0 THEN '  year = {2001},' || chr(10) ELSE '' END || '  url = {https://x.org/' || k || '}' || chr(10) || '}' || chr(10)"


@query(f"WITH {_P} SELECT i, {_ENTRY} AS entry FROM p")
def bibtex_entries(spark, sf_dir):
    entry = sources_table.bibtex(F.concat("n", F.lit(" {x}\n")), F.concat(F.lit("k"), "k"), F.array(F.lit("Ada {B}"), F.lit("Cy  D")), F.when(F.col("i") % 2 == 0, 2001), F.lit(None).cast("string"), F.concat(F.lit("https://x.org/"), "k"))
    return parts(spark, sf_dir).select("i", entry.alias("entry"))


# --- reports with known claims --------------------------------------------------------------------

_REPORT = [
    "# Report on {n}", "", "<!-- a note", "over two lines [S9] -->", "The {n} costs 1,234 coins in the usual shop", "and weighs 56 grams there [S1].", "",
    "- The {n} is made of copper in 1987 [S2]", "- It has no source at all but many words", "", "```", "code with [S7] and 99 numbers in it", "```", "",
    "> [model-hint] Perhaps the {n} was cheaper in other years [M]", "", "| name | price |", "| --- | --- |", "| the {n} part | 78 coins [S3] |", "", "## Sources", "- the list [S1]",
]


def made_reports(spark, sf_dir) -> DataFrame:
    """A report of every kind of line for each part."""
    body = F.replace(F.lit("\n".join(_REPORT)), F.lit("{n}"), F.coalesce("n", F.lit("")))
    return parts(spark, sf_dir).select(F.col("i").alias("report_id"), F.lit("REPORT.md").alias("file"), body.alias("text"))


def made_sources(spark, sf_dir) -> DataFrame:
    """S1 has all numerals of its claim, S2 none, S3 is there for even parts only."""
    rows = parts(spark, sf_dir).select(F.col("i").alias("report_id"), F.explode(F.array(*[F.struct(F.lit(s).alias("source_id"), F.lit(t).alias("text"), F.lit(w).alias("trust")) for s, t, w in (("S1", "costs 1234 coins and weighs 56", 0.9), ("S2", "copper", 0.5), ("S3", "78 coins", 0.7))])).alias("s"))
    return rows.select("report_id", "s.*").filter((F.col("source_id") != "S3") | (F.col("report_id") % 2 == 0))


_P0 = "p AS (SELECT p_partkey AS i, coalesce(p_name, '') AS n FROM part)"
_CLAIMS = [("0", "0", "'text'", "'The ' || n || ' costs 1,234 coins in the usual shop and weighs 56 grams there [S1].'"), ("1", "0", "'list'", "'The ' || n || ' is made of copper in 1987 [S2]'"), ("1", "1", "'list'", "'It has no source at all but many words'"), ("2", "0", "'text'", "'the ' || n || ' part 78 coins [S3]'")]


@query(f"WITH {_P0} " + " UNION ALL ".join(f"SELECT i AS report_id, CAST({u} AS INT) AS unit, CAST({x} AS INT) AS item, {k} AS kind, {t} AS claim FROM p" for u, x, k, t in _CLAIMS))
def report_claims(spark, sf_dir):
    """Prose over two lines, list items and a table row; comments, code, hints, headings and appendices are no claims."""
    return grounding.claim_strings(made_reports(spark, sf_dir)).select("report_id", "unit", "item", "kind", "claim")


@query(f"WITH {_P0} SELECT i AS report_id, 'C1' AS claim_id, 'S1' AS source_id, CAST([] AS VARCHAR[]) AS numerals_absent FROM p UNION ALL SELECT i, 'C2', 'S2', ['1987'] FROM p UNION ALL SELECT i, 'C3', 'S3', CAST([] AS VARCHAR[]) FROM p WHERE i % 2 = 0")
def report_pairs(spark, sf_dir):
    return grounding.claim_pairs(made_reports(spark, sf_dir), made_sources(spark, sf_dir)).select("report_id", "claim_id", "source_id", "numerals_absent")


@query(f"WITH {_P0} SELECT i AS report_id, 'C2' AS claim_id, '1987' AS numeral FROM p")
def report_numerals(spark, sf_dir):
    return grounding.ungrounded_numerals(made_reports(spark, sf_dir), made_sources(spark, sf_dir))


@query(f"WITH {_P0} SELECT i AS report_id, 1 AS unit, 'It has no source at all but many words' AS claim FROM p")
def report_unsourced(spark, sf_dir):
    return grounding.unsourced_claims(made_reports(spark, sf_dir)).select("report_id", "unit", "claim")


@query(f"WITH {_P0} SELECT i AS report_id, 3 - i % 2 AS citations, 1 AS model_hints, 0 AS unknown_tokens, i % 2 AS dangling, 0 AS not_citable, 1 AS unsourced, false AS ok FROM p")
def report_gate(spark, sf_dir):
    """Every one of these reports has an unsourced item, so none passes; the citation of a source that is not there does not count."""
    out = grounding.check(made_reports(spark, sf_dir), made_sources(spark, sf_dir))
    return out.select("report_id", *[F.col(c).cast("int").alias(c) for c in ("citations", "model_hints", "unknown_tokens", "dangling", "not_citable", "unsourced")], "ok")


_KINDS = ["body"] * 10 + ["code"] * 3 + ["body", "hint"] + ["body"] * 5 + ["appendix"] * 2
_COUNTS = {k: _KINDS.count(k) for k in sorted(set(_KINDS))}


@query("WITH p AS (SELECT p_partkey AS report_id FROM part) " + " UNION ALL ".join(f"SELECT report_id, '{k}' AS kind, CAST({n} AS BIGINT) AS lines FROM p" for k, n in _COUNTS.items()))
def line_kinds(spark, sf_dir):
    """Lines of each kind: code between fences, quotes that hold a hint, appendices, the rest."""
    rows = made_reports(spark, sf_dir).select("report_id", F.explode(claims.body_lines("text")).alias("l"))
    return rows.groupBy("report_id", F.col("l.kind").alias("kind")).agg(F.count(F.lit(1)).alias("lines"))


@query("WITH p AS (SELECT p_partkey AS id, coalesce(p_name, '') AS n FROM part) SELECT id, unnest([2, 3]) AS n, unnest(['', 'text of ' || n]) AS line FROM p")
def extract_lines(spark, sf_dir):
    """A range of lines of each extract, its header taken off."""
    rows = parts(spark, sf_dir).select(F.col("i").alias("id"), files.extract_page(F.concat(F.lit("S"), "k"), F.lit("t"), F.lit("u"), F.concat(F.lit("first\n\ntext of "), F.coalesce("n", F.lit("")))).alias("extract"))
    return files.read_lines(rows.select("id", files.strip_header(F.col("extract")).alias("text")), 2, 3).select("id", "n", "line")
