"""Queries of the response readers: saved responses are made of the table ``part``, twenty items each, and read back.

The SQL states what each reader must find, straight from the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.sources import responses

from .catalog import QUERIES, SQL, table

_ITEMS = "WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS k, p_partkey AS i, p_name AS n, p_partkey // 20 AS query, row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey) AS pos FROM part)"


def _parts(spark, sf_dir) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(key.cast("string").alias("k"), key.alias("i"), F.col("p_name").alias("n"), F.floor(key / 20).cast("long").alias("query"))


def _payloads(spark, sf_dir, item: str, begin: str, end: str, between: str = ",") -> DataFrame:
    """(query, payload): the items of a query in the order of their keys; ``item`` is a SQL expression of a string."""
    rows = _parts(spark, sf_dir).select("query", "i", F.expr(item).alias("item"))
    own = rows.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("i", "item"))).alias("items"))  # twenty items
    return own.select("query", F.concat(F.lit(begin), F.array_join(F.transform("items", lambda x: x["item"]), between), F.lit(end)).alias("payload"))


#: kind: (an item as JSON, begin and end of the response, what must be read of each column)
JSON_KINDS = {
    "searxng": ("to_json(named_struct('url', concat('https://ex.org/', k), 'title', n, 'content', concat('about ', n)))", '{"results":[', "]}", {"url": "'https://ex.org/' || k", "title": "n", "snippet": "'about ' || n"}),
    "marginalia": ("to_json(named_struct('url', concat('https://ex.org/', k), 'title', n, 'description', concat('on ', n)))", '{"results":[', "]}", {"url": "'https://ex.org/' || k", "title": "n", "snippet": "'on ' || n"}),
    "firecrawl": (
        "to_json(named_struct('metadata', named_struct('sourceURL', concat('https://ex.org/', k), 'title', n), 'markdown', concat('# ', n)))", '{"data":[', "]}",
        {"url": "'https://ex.org/' || k", "title": "n", "text": "'# ' || n", "snippet": "'# ' || n"},
    ),
    "crossref": (
        "to_json(named_struct('DOI', concat('10.1000/', k), 'title', array(n), 'abstract', concat('<p>', n, '</p>'), 'author', array(named_struct('given', 'Ada', 'family', concat('Byte', i % 7)), named_struct('given', string(null), 'family', 'Solo')), "
        "'issued', named_struct('date-parts', array(array(2000 + i % 20))), 'container-title', array('Bits &amp; Bytes')))", '{"message":{"items":[', "]}}",
        {"url": "'https://doi.org/10.1000/' || k", "doi": "'10.1000/' || k", "title": "n", "text": "n", "authors": "['Ada Byte' || (i % 7), 'Solo']", "year": "CAST(2000 + i % 20 AS INT)", "venue": "'Bits & Bytes'"},
    ),
    "openalex": (
        "to_json(named_struct('doi', concat('https://doi.org/10.2/', k), 'title', n, 'abstract_inverted_index', named_struct('alpha', array(0, 2), 'beta', array(1)), 'authorships', array(named_struct('author', named_struct('display_name', 'Ada B'))), "
        "'publication_year', 1990 + i % 30, 'primary_location', named_struct('source', named_struct('display_name', 'J'))))", '{"results":[', "]}",
        {"url": "'https://doi.org/10.2/' || k", "title": "n", "text": "'alpha beta alpha'", "authors": "['Ada B']", "year": "CAST(1990 + i % 30 AS INT)", "venue": "'J'"},
    ),
    "semanticscholar": (
        "to_json(named_struct('url', concat('https://s2.org/', k), 'title', n, 'abstract', concat('abs ', n), 'externalIds', named_struct('DOI', concat('10.3/', k), 'ArXiv', if(i % 2 = 0, '2001.00001', string(null))), 'authors', array(named_struct('name', 'X Y'), named_struct('name', 'Z')), 'year', 2001, 'venue', 'V'))",
        '{"data":[', "]}", {"url": "'https://s2.org/' || k", "doi": "'10.3/' || k", "arxiv_id": "CASE WHEN i % 2 = 0 THEN '2001.00001' END", "text": "'abs ' || n", "authors": "['X Y', 'Z']", "year": "2001"},
    ),
    "europepmc": (
        "to_json(named_struct('source', 'MED', 'id', k, 'doi', if(i % 3 = 0, concat('10.4/', k), string(null)), 'title', concat(n, ' <i>in vivo</i>'), 'abstractText', concat('<h4>Aim</h4>', n), 'authorString', 'Doe J, Roe R.', 'pubYear', '2015', 'journalInfo', named_struct('journal', named_struct('title', 'T'))))",
        '{"resultList":{"result":[', "]}}",
        {"url": "CASE WHEN i % 3 = 0 THEN 'https://doi.org/10.4/' || k ELSE 'https://europepmc.org/article/MED/' || k END", "title": "n || ' in vivo'", "authors": "['Doe J', 'Roe R']", "year": "2015", "venue": "'T'"},
    ),
    "dblp": (
        "to_json(named_struct('info', named_struct('title', concat(n, ' &amp; more.'), 'ee', if(i % 2 = 0, concat('https://doi.org/10.5/', k), string(null)), 'url', concat('https://dblp.org/', k), 'doi', concat('10.5/', k), 'year', '2011', 'venue', 'C', 'authors', named_struct('author', array(named_struct('text', 'P Q'))))))",
        '{"result":{"hits":{"hit":[', "]}}}", {"url": "CASE WHEN i % 2 = 0 THEN 'https://doi.org/10.5/' || k ELSE 'https://dblp.org/' || k END", "title": "n || ' & more'", "authors": "['P Q']", "year": "2011", "venue": "'C'"},
    ),
    "hackernews": (
        "to_json(named_struct('objectID', k, 'url', if(i % 2 = 0, concat('https://ex.org/', k), string(null)), 'title', if(i % 5 = 0, string(null), n), 'story_title', 'story', 'story_text', concat('<p>', n)))",
        '{"hits":[', "]}", {"url": "CASE WHEN i % 2 = 0 THEN 'https://ex.org/' || k ELSE 'https://news.ycombinator.com/item?id=' || k END", "title": "CASE WHEN i % 5 = 0 THEN 'story' ELSE n END", "text": "n"},
    ),
    "github": ("to_json(named_struct('html_url', concat('https://github.com/a/b/issues/', k), 'title', n, 'body', concat('body of ', n)))", '{"items":[', "]}", {"url": "'https://github.com/a/b/issues/' || k", "title": "n", "text": "'body of ' || n", "snippet": "'body of ' || n"}),
    "standards": ("to_json(named_struct('mdn_url', if(i % 4 = 0, string(null), concat('https://mdn.dev/', k)), 'url', concat('https://rfc.dev/', k), 'title', n, 'summary', 's'))", '{"documents":[', "]}", {"url": "CASE WHEN i % 4 = 0 THEN 'https://rfc.dev/' || k ELSE 'https://mdn.dev/' || k END", "title": "n", "snippet": "'s'"}),
}


def _add(name: str, want: dict[str, str], read, order: str = "pos", where: str = "true") -> None:
    def run(spark, sf_dir):
        return read(spark, sf_dir).select("query", F.col("pos").cast("long").alias("pos"), *want)

    run.__name__ = f"read_{name}"
    QUERIES[run.__name__] = run
    columns = ", ".join(f"{x} AS {c}" for c, x in want.items())
    SQL[run.__name__] = f"{_ITEMS} SELECT query, row_number() OVER (PARTITION BY query ORDER BY {order}) AS pos, {columns} FROM p WHERE {where}"


for _kind, (_item, _begin, _end, _want) in JSON_KINDS.items():
    _add(_kind, _want, lambda spark, sf_dir, kind=_kind, item=_item, begin=_begin, end=_end: responses.read_json_responses(_payloads(spark, sf_dir, item, begin, end), kind))

_QUESTIONS = "to_json(named_struct('link', concat('https://so.com/q/', k), 'title', concat(n, ' &lt;x&gt;'), 'body', concat('<p>', n, '</p>'), 'score', i % 5, 'is_answered', i % 3 = 0))"
_add(
    "stackexchange",
    {"url": "'https://so.com/q/' || k", "title": "n || ' <x>'", "text": "n", "score": "CAST(i % 5 AS DOUBLE) + CASE WHEN i % 3 = 0 THEN 2e0 ELSE 0e0 END + CAST(count(*) OVER (PARTITION BY query) - pos + 1 AS DOUBLE) * 0.1e0"},
    lambda spark, sf_dir: responses.read_json_responses(_payloads(spark, sf_dir, _QUESTIONS, '{"items":[', '],"quota_remaining":9}'), "stackexchange"),
    "CAST(i % 5 AS DOUBLE) + CASE WHEN i % 3 = 0 THEN 2e0 ELSE 0e0 END + CAST(21 - pos AS DOUBLE) * 0.1e0 DESC, pos",
)

_ENTRY = "concat('<entry><id>http://arxiv.org/abs/', 1000 + i % 9000, '.', lpad(k, 5, '0'), 'v2</id><title>', n, '\\n  of it</title><summary> about ', n, ' </summary><published>2019-01-02T00:00:00Z</published><author><name>Ada &amp; Co</name></author></entry>')"
_ARXIV = "(1000 + i % 9000) || '.' || lpad(k, 5, '0')"
_add(
    "arxiv",
    {"url": f"'https://arxiv.org/html/' || {_ARXIV}", "arxiv_id": _ARXIV, "title": "n || ' of it'", "snippet": "'about ' || n", "authors": "['Ada & Co']", "year": "2019"},
    lambda spark, sf_dir: responses.read_arxiv(_payloads(spark, sf_dir, _ENTRY, "<feed>", "</feed>", "\n")),
)

#: engine: an item of its result page; every fourth result leads to the engine itself and is no candidate
PAGES = {
    "duckduckgo": "concat('<a class=\"result__a\" href=\"//duckduckgo.com/l/?uddg=', if(i % 4 = 0, 'https%3A%2F%2Fduckduckgo.com%2F', 'https%3A%2F%2Fex.org%2F'), k, '&rut=1\">The <b>', n, '</b></a><a class=\"result__snippet\" href=\"x\">about <b>', n, '</b> &amp; co</a>')",
    "ddglite": "concat('<a rel=\"nofollow\" href=\"https://', if(i % 4 = 0, 'duckduckgo.com', 'ex.org'), '/', k, '\" class=\"result-link\">The ', n, '</a><td class=\"result-snippet\">about ', n, ' &amp; co</td>')",
    "mojeek": "concat('<a class=\"title x\" href=\"https://', if(i % 4 = 0, 'www.mojeek.com', 'ex.org'), '/', k, '\">The ', n, '</a><p class=\"s\">about ', n, ' &amp; co</p>')",
}
for _engine, _item in PAGES.items():
    _add(
        _engine,
        {"url": "'https://ex.org/' || k", "title": "'The ' || n", "snippet": "'about ' || n || ' & co'"},
        lambda spark, sf_dir, engine=_engine, item=_item: responses.read_result_pages(_payloads(spark, sf_dir, item, "<html>", "</html>"), engine),
        where="i % 4 <> 0",
    )

_HIT = "case when i % 3 = 0 then concat('\"https://ex.org/', k, '\"') when i % 3 = 1 then to_json(named_struct('link', concat('https://ex.org/', k), 'name', n, 'excerpt', 'e')) else to_json(named_struct('uri', concat('https://ex.org/', k - 1), 'heading', 'again')) end"
_add(
    "supplied_hits",
    {"url": "'https://ex.org/' || k", "title": "CASE WHEN i % 3 = 1 THEN n END"},
    lambda spark, sf_dir: responses.read_hits(_payloads(spark, sf_dir, _HIT, '{"webResults":[', "]}")),
    # an item that repeats the URL of the one before counts only where that one is in another response
    where="i % 3 <> 2",
)


def _first_of_response(sql: str) -> str:
    repeated = "SELECT query, 0 AS pos, 'https://ex.org/' || (i - 1) AS url, 'again' AS title FROM p WHERE i % 3 = 2 AND pos = 1"
    inner = sql.replace(_ITEMS, "").replace("row_number() OVER (PARTITION BY query ORDER BY pos) AS pos", "pos")
    return f"{_ITEMS} SELECT query, row_number() OVER (PARTITION BY query ORDER BY pos) AS pos, url, title FROM ({inner} UNION ALL {repeated})"


SQL["read_supplied_hits"] = _first_of_response(SQL["read_supplied_hits"])


def _wikipedia(spark, sf_dir):
    searches = _payloads(spark, sf_dir, "to_json(named_struct('key', concat('K', k), 'title', n, 'excerpt', concat('<span>', n, '</span> x')))", '{"pages":[', "]}")
    kinds = "named_struct('type', if(i % 5 = 0, 'disambiguation', 'standard'), 'extract', concat('text ', n), 'content_urls', named_struct('desktop', named_struct('page', concat('https://en.wikipedia.org/wiki/K_', k))))"
    summaries = _parts(spark, sf_dir).filter("i % 7 <> 0").select(F.concat(F.lit("K"), "k").alias("key"), F.expr(f"to_json({kinds})").alias("payload"))
    return responses.read_wikipedia(searches, summaries)


_add(
    "wikipedia",
    {"url": "'https://en.wikipedia.org/wiki/K' || CASE WHEN i % 7 <> 0 THEN '_' ELSE '' END || k", "title": "n", "snippet": "n || ' x'", "text": "CASE WHEN i % 7 <> 0 THEN 'text ' || n END"},
    _wikipedia,
    where="i % 7 = 0 OR i % 5 <> 0",
)


def _pubmed(spark, sf_dir):
    searches = _payloads(spark, sf_dir, "concat('\"', k, '\"')", '{"esearchresult":{"idlist":[', "]}}")
    item = "named_struct('title', n, 'pubdate', '2009 Jan', 'source', 'Lancet', 'authors', array(named_struct('name', 'Doe J')), 'articleids', array(named_struct('idtype', 'pubmed', 'value', k), named_struct('idtype', 'doi', 'value', concat('10.6/', k))))"
    return responses.read_pubmed(searches, _payloads(spark, sf_dir, f"concat('\"', k, '\":', to_json({item}))", '{"result":{"uids":[],', "}}").select("payload"))


_add("pubmed", {"url": "'https://pubmed.ncbi.nlm.nih.gov/' || k || '/'", "title": "n", "doi": "'10.6/' || k", "authors": "['Doe J']", "year": "2009", "venue": "'Lancet'"}, _pubmed)


def response_quota(spark, sf_dir):
    """Several responses of a query: the least quota and the longest pause."""
    rows = _parts(spark, sf_dir).select("query", F.expr("to_json(named_struct('quota_remaining', 1000 - i % 13, 'backoff', if(i % 6 = 0, i % 4, null)))").alias("payload"))
    return responses.quota(rows)


QUERIES["response_quota"] = response_quota
SQL["response_quota"] = f"{_ITEMS} SELECT query, min(1000 - i % 13) AS remaining, max(CASE WHEN i % 6 = 0 THEN i % 4 END) AS backoff FROM p GROUP BY query"


def backend_registry(spark, sf_dir):
    """Candidates by backend through the registry; an unknown backend gives none and says so."""
    rows = []
    for name in ("searxng", "github", "no_such_backend"):
        item, begin, end = (JSON_KINDS[name] if name in JSON_KINDS else JSON_KINDS["github"])[:3]
        found, note = responses.read_responses(spark, _payloads(spark, sf_dir, item, begin, end), name)
        rows.append(found.agg(F.lit(name).alias("backend"), F.count(F.lit(1)).alias("candidates"), F.lit(note).alias("note")))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


QUERIES["backend_registry"] = backend_registry
SQL["backend_registry"] = "SELECT b AS backend, CASE WHEN b = 'no_such_backend' THEN 0 ELSE (SELECT count(*) FROM part) END AS candidates, b || CASE WHEN b = 'no_such_backend' THEN ': no such backend' ELSE ': read' END AS note FROM (VALUES ('searxng'), ('github'), ('no_such_backend')) v(b)"
