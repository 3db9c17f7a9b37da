"""Saved search responses as ranked candidates.

A response is a row (query, payload). Each kind is a declaration: where its items are and which column
each field is of an item. Payloads that do not parse give no row. Candidates have query, backend, pos,
url, title, snippet, text, score, doi, arxiv_id, authors, year, venue; within a query they are ranked
by score, ties by their place.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.html import decode_entities, html_to_text
from siftline.functions.url import canonical_url

FIELDS = {"url": "string", "title": "string", "snippet": "string", "text": "string", "score": "double", "doi": "string", "arxiv_id": "string", "authors": "array<string>", "year": "int", "venue": "string"}
SNIPPET = 360


def get(path: str) -> Callable[[Column], Column]:
    """The first of several JSON paths, separated by |, that has a value."""
    return lambda item: F.coalesce(*[F.nullif(F.get_json_object(item, p.strip()), F.lit("")) for p in path.split("|")])


def listed(path: str) -> Callable[[Column], Column]:
    return lambda item: F.from_json(F.get_json_object(item, path), "array<string>")


def plain(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda item: html_to_text(f(item))


def clean_inline(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(decode_entities(text), "<[^>]+>", " "), r"\s+", " "))


@dataclass
class Spec:
    """items: JSON path of the array (or of one object); fields: a column for each field, of the item's JSON."""

    items: str
    fields: dict[str, Callable[[Column], Column]]
    score: Callable[[Column, Column], Column] | None = None
    keep: Callable[[Column], Column] | None = None
    extra: dict[str, str] = field(default_factory=dict)


def _year(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda item: F.nullif(F.regexp_extract(f(item), "([0-9]{4})", 1), F.lit("")).cast("int")


def _persons(path: str, *names: str) -> Callable[[Column], Column]:
    def of(item: Column) -> Column:
        people = F.from_json(F.get_json_object(item, path), "array<string>")
        return F.filter(F.transform(people, lambda p: F.coalesce(*[F.nullif(F.get_json_object(p, n), F.lit("")) for n in names], F.when(~p.startswith("{"), p))), lambda n: n.isNotNull() & (n != ""))

    return of


def _crossref_authors(item: Column) -> Column:
    people = F.from_json(F.get_json_object(item, "$.author"), "array<struct<given:string,family:string,name:string>>")
    return F.filter(F.transform(people, lambda a: F.coalesce(F.nullif(F.concat_ws(" ", a["given"], a["family"]), F.lit("")), a["name"])), lambda n: n.isNotNull())


def _inverted(item: Column) -> Column:
    """An inverted index {word: [positions]} as text."""
    index = F.map_entries(F.from_json(F.get_json_object(item, "$.abstract_inverted_index"), "map<string,array<int>>"))
    places = F.flatten(F.transform(index, lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(places), lambda x: x["w"]), " ")


def _from_doi(doi: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda item: F.concat(F.lit("https://doi.org/"), doi(item))


SPECS: dict[str, Spec] = {
    "searxng": Spec("$.results", {"url": get("$.url"), "title": get("$.title"), "snippet": get("$.content")}),
    "marginalia": Spec("$.results", {"url": get("$.url"), "title": get("$.title"), "snippet": get("$.description")}),
    "firecrawl": Spec("$.data", {"url": get("$.url|$.metadata.sourceURL"), "title": get("$.title|$.metadata.title"), "snippet": get("$.description"), "text": get("$.markdown")}),
    "crossref": Spec(
        "$.message.items",
        {
            "url": lambda i: F.coalesce(get("$.URL")(i), _from_doi(get("$.DOI"))(i)),
            "title": lambda i: clean_inline(F.array_join(listed("$.title")(i), " ")),
            "text": plain(get("$.abstract")),
            "doi": get("$.DOI"),
            "authors": _crossref_authors,
            "year": _year(get("$.issued.date-parts[0][0]")),
            "venue": lambda i: clean_inline(F.get(listed("$.container-title")(i), F.lit(0))),
        },
    ),
    "openalex": Spec(
        "$.results",
        {
            "url": get("$.doi|$.primary_location.landing_page_url|$.id"),
            "title": get("$.title|$.display_name"),
            "text": _inverted,
            "doi": get("$.doi"),
            "authors": _persons("$.authorships", "$.author.display_name"),
            "year": _year(get("$.publication_year")),
            "venue": get("$.primary_location.source.display_name"),
        },
    ),
    "semanticscholar": Spec(
        "$.data",
        {"url": get("$.url"), "title": get("$.title"), "text": get("$.abstract"), "doi": get("$.externalIds.DOI"), "arxiv_id": get("$.externalIds.ArXiv"), "authors": _persons("$.authors", "$.name"), "year": _year(get("$.year")), "venue": get("$.venue")},
    ),
    "europepmc": Spec(
        "$.resultList.result",
        {
            "url": lambda i: F.coalesce(_from_doi(get("$.doi"))(i), F.concat_ws("/", F.lit("https://europepmc.org/article"), get("$.source")(i), get("$.id")(i))),
            "title": lambda i: clean_inline(get("$.title")(i)),
            "text": plain(get("$.abstractText")),
            "doi": get("$.doi"),
            "authors": lambda i: F.transform(F.split(F.regexp_replace(get("$.authorString")(i), r"\.$", ""), ","), lambda a: F.trim(a)),
            "year": _year(get("$.pubYear")),
            "venue": get("$.journalInfo.journal.title"),
        },
    ),
    "dblp": Spec(
        "$.result.hits.hit",
        {
            "url": get("$.info.ee|$.info.url"),
            "title": lambda i: F.regexp_replace(decode_entities(get("$.info.title")(i)), r"\.$", ""),
            "doi": get("$.info.doi"),
            "authors": lambda i: F.coalesce(_persons("$.info.authors.author", "$.text")(i), F.array(get("$.info.authors.author.text")(i))),
            "year": _year(get("$.info.year")),
            "venue": get("$.info.venue"),
        },
    ),
    "stackexchange": Spec(
        "$.items",
        {"url": get("$.link"), "title": lambda i: decode_entities(get("$.title")(i)), "text": plain(get("$.body"))},
        score=lambda i, back: F.coalesce(F.get_json_object(i, "$.score").cast("double"), F.lit(0.0)) + F.when(F.get_json_object(i, "$.is_answered") == "true", 2.0).otherwise(0.0) + back * 0.1,
        extra={"backoff": "$.backoff", "remaining": "$.quota_remaining"},
    ),
    "hackernews": Spec(
        "$.hits",
        {"url": lambda i: F.coalesce(get("$.url")(i), F.concat(F.lit("https://news.ycombinator.com/item?id="), get("$.objectID")(i))), "title": get("$.title|$.story_title"), "text": plain(get("$.story_text"))},
    ),
    "github": Spec("$.items", {"url": get("$.html_url"), "title": get("$.title"), "text": get("$.body")}),
    "standards": Spec("$.documents", {"url": get("$.mdn_url|$.url"), "title": get("$.title"), "snippet": get("$.summary")}),
}


def _finish(df: DataFrame, backend: str) -> DataFrame:
    """Typed columns, snippets from texts, ranks; candidates without a URL go."""
    from pyspark.sql import Window

    df = df.filter(F.col("url").rlike("^https?://"))
    df = df.withColumn("snippet", F.substring(F.coalesce(F.nullif("snippet", F.lit("")), F.nullif("text", F.lit("")), "title"), 1, SNIPPET))
    ranked = df.withColumn("pos", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "place")))
    return ranked.select("query", F.lit(backend).alias("backend"), "pos", *FIELDS)


def read_json_responses(responses: DataFrame, kind: str) -> DataFrame:
    """Candidates of saved JSON responses of one kind."""
    spec = SPECS[kind]
    body = F.get_json_object("payload", spec.items)
    items = F.coalesce(F.from_json(body, "array<string>"), F.when(body.startswith("{"), F.array(body)))  # one hit may stand without its list
    rows = responses.select("query", F.posexplode(items).alias("place", "item"), F.size(items).alias("n"))
    back = F.col("n") - F.col("place")
    own = {name: spec.fields[name](F.col("item")).cast(kind_) if name in spec.fields else F.lit(None).cast(kind_) for name, kind_ in FIELDS.items()}
    own["score"] = (spec.score(F.col("item"), back) if spec.score else back).cast("double")
    return _finish(rows.select("query", "place", *[c.alias(n) for n, c in own.items()]), kind)


def read_searxng_pages(responses: DataFrame, pages: int = 5, per_page: int = 20) -> tuple[DataFrame, DataFrame]:
    """Candidates of several saved result pages a query (query, page from 0, payload), and the engines they call suspended (query, engine, reason).

    Pages are read in order until one has no URL that an earlier one has not, does not parse, or is missing: what lies behind
    is not read, neither are its suspended engines; that page's own are. Of an engine named again the later reason counts.
    A URL is new where it stands first; that is one aggregation by query and URL, and the end of each query one over its pages.
    """
    spec = SPECS["searxng"]
    asked = responses.filter(F.col("page").between(0, pages - 1))
    asked = asked.groupBy("query", "page").agg(F.min("payload").alias("payload")).withColumn("data", F.try_parse_json("payload"))
    parsed = asked.select("query", "page", "payload", F.col("data").isNotNull().alias("good"))
    items = F.coalesce(F.slice(F.from_json(F.get_json_object("payload", spec.items), "array<string>"), 1, per_page), F.array().cast("array<string>"))
    rows = parsed.filter("good").select("query", "page", F.posexplode(items).alias("place", "item"))
    url = spec.fields["url"](F.col("item"))
    rows = rows.withColumn("key", canonical_url(url)).filter(url.rlike("^https?://"))
    first = rows.groupBy("query", "key").agg(F.min(F.struct("page", "place", "item")).alias("f")).select("query", "f.*")
    fresh = first.select("query", "page").distinct().withColumn("fresh", F.lit(True))
    every = responses.select("query").distinct().select("query", F.explode(F.sequence(F.lit(0), F.lit(pages))).alias("page"))
    stops = every.join(fresh, ["query", "page"], "left").filter("fresh is null").groupBy("query").agg(F.min("page").alias("stop"))
    kept = first.join(stops, "query").filter("page < stop")
    back = (F.lit(pages * per_page) - F.col("page") * per_page - F.col("place")).cast("double")
    own = {name: spec.fields[name](F.col("item")).cast(kind) if name in spec.fields else F.lit(None).cast(kind) for name, kind in FIELDS.items()}
    own["title"] = F.coalesce(F.nullif(own["title"], F.lit("")), own["url"])
    own["score"] = back
    candidates = _finish(kept.select("query", (F.col("page") * per_page + F.col("place")).alias("place"), *[c.alias(n) for n, c in own.items()]), "searxng")

    named = F.from_json(F.get_json_object("payload", "$.unresponsive_engines"), "array<string>")
    heard = parsed.filter("good").join(stops, "query").filter("page <= stop").select("query", "page", F.posexplode(named).alias("place", "x"))
    pair = F.from_json("x", "array<string>")
    engine = F.when(F.col("x").startswith("["), F.get(pair, F.lit(0))).otherwise(F.col("x"))
    heard = heard.select("query", "page", "place", engine.alias("engine"), F.trim(F.coalesce(F.when(F.col("x").startswith("["), F.get(pair, F.lit(1))), F.lit(""))).alias("reason")).filter("engine <> ''")
    suspended = heard.groupBy("query", "engine").agg(F.max_by("reason", F.struct("page", "place")).alias("reason"))
    return candidates, suspended


def quota(responses: DataFrame) -> DataFrame:
    """query, least remaining quota and first backoff over the responses of a query."""
    return responses.groupBy("query").agg(F.min(F.get_json_object("payload", "$.quota_remaining").cast("long")).alias("remaining"), F.max(F.get_json_object("payload", "$.backoff").cast("long")).alias("backoff"))


def read_arxiv(responses: DataFrame) -> DataFrame:
    """Candidates of Atom feeds."""
    entries = F.regexp_extract_all("payload", F.lit(r"(?s)<entry>(.*?)</entry>"), F.lit(1))
    rows = responses.select("query", F.posexplode(entries).alias("place", "e"), F.size(entries).alias("n"))

    def tag(name: str) -> Column:
        return clean_inline(F.regexp_extract("e", rf"(?s)<{name}[^>]*>(.*?)</{name}>", 1))

    arxiv = F.regexp_extract(tag("id"), "abs/([^v<]+)", 1)
    names = F.transform(F.regexp_extract_all("e", F.lit(r"(?s)<name>(.*?)</name>"), F.lit(1)), clean_inline)
    own = {"url": F.concat(F.lit("https://arxiv.org/html/"), arxiv), "title": tag("title"), "snippet": tag("summary"), "score": (F.col("n") - F.col("place")).cast("double"), "arxiv_id": arxiv, "authors": names, "year": F.regexp_extract("e", r"<published>([0-9]{4})", 1).cast("int")}
    return _finish(rows.select("query", "place", *[own.get(n, F.lit(None)).cast(k).alias(n) for n, k in FIELDS.items()]), "arxiv")


#: engine: (attribute of the result anchor, pattern of the snippet, the engine's own host)
SCRAPED = {
    "duckduckgo": (r"\bresult__a\b", r'(?is)class="result__snippet"[^>]*>(.*?)</a>', "duckduckgo.com"),
    "ddglite": (r"\bresult-link\b", r'(?is)class="result-snippet"[^>]*>(.*?)</td>', "duckduckgo.com"),
    "mojeek": (r'\bclass="[^"]*\btitle\b[^"]*"', r'(?is)<p\b[^>]*\bclass="[^"]*\bs\b[^"]*"[^>]*>(.*?)</p>', "mojeek.com"),
}


def unwrap_redirect(href: Column) -> Column:
    """The target of a redirect link of a search page; other links with a scheme."""
    target = F.regexp_extract(href, r"[?&]uddg=([^&]+)", 1)
    return F.when(target != "", F.coalesce(F.try_url_decode(target), target)).when(href.startswith("//"), F.concat(F.lit("https:"), href)).otherwise(decode_entities(href))


def read_result_pages(responses: DataFrame, engine: str) -> DataFrame:
    """Candidates of saved result pages: an anchor, and the snippet before the next one."""
    mark, snippet, own_host = SCRAPED[engine]
    anchor = rf"<a\b[^>]*{mark}[^>]*>"
    heads = F.regexp_extract_all("payload", F.lit("(?is)" + anchor), F.lit(0))
    rests = F.slice(F.split("payload", "(?is)" + anchor, -1), 2, 1_000_000)  # what follows each anchor
    rows = responses.select("query", F.posexplode(F.arrays_zip(heads.alias("head"), rests.alias("rest"))).alias("place", "b"), F.size(heads).alias("n"))
    url = unwrap_redirect(F.regexp_extract("b.head", r'(?i)\bhref="([^"]+)"', 1))
    own = {"url": url, "title": clean_inline(F.regexp_extract("b.rest", r"(?is)^(.*?)</a>", 1)), "snippet": clean_inline(F.regexp_extract("b.rest", snippet, 1)), "score": (F.col("n") - F.col("place")).cast("double")}
    found = rows.select("query", "place", *[own.get(n, F.lit(None)).cast(k).alias(n) for n, k in FIELDS.items()])
    return _finish(found.filter(~F.col("url").contains(own_host)), engine)


def read_wikipedia(searches: DataFrame, summaries: DataFrame) -> DataFrame:
    """Search responses joined with page summaries (key, payload); pages that only list meanings go."""
    pages = F.from_json(F.get_json_object("payload", "$.pages"), "array<string>")
    rows = searches.select("query", F.posexplode(pages).alias("place", "item"), F.size(pages).alias("n")).withColumn("key", get("$.key")(F.col("item")))
    detail = summaries.select("key", F.get_json_object("payload", "$.type").alias("type"), F.get_json_object("payload", "$.extract").alias("extract"), F.get_json_object("payload", "$.content_urls.desktop.page").alias("page"))
    joined = rows.join(detail, "key", "left").filter(F.coalesce("type", F.lit("")) != "disambiguation")
    own = {"url": F.coalesce("page", F.concat(F.lit("https://en.wikipedia.org/wiki/"), F.col("key"))), "title": get("$.title")(F.col("item")), "snippet": clean_inline(get("$.excerpt")(F.col("item"))), "text": F.col("extract"), "score": (F.col("n") - F.col("place")).cast("double")}
    return _finish(joined.select("query", "place", *[own.get(n, F.lit(None)).cast(k).alias(n) for n, k in FIELDS.items()]), "wikipedia")


def read_pubmed(searches: DataFrame, summaries: DataFrame) -> DataFrame:
    """Lists of ids joined with summaries of many ids in one object."""
    ids = F.from_json(F.get_json_object("payload", "$.esearchresult.idlist"), "array<string>")
    rows = searches.select("query", F.posexplode(ids).alias("place", "uid"), F.size(ids).alias("n"))
    detail = summaries.select(F.explode(F.from_json(F.get_json_object("payload", "$.result"), "map<string,string>")).alias("uid", "item")).filter("uid <> 'uids'")
    item = F.col("item")
    named = F.from_json(F.get_json_object(item, "$.articleids"), "array<struct<idtype:string,value:string>>")
    own = {
        "url": F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), F.col("uid"), F.lit("/")),
        "title": clean_inline(get("$.title")(item)),
        "score": (F.col("n") - F.col("place")).cast("double"),
        "doi": F.get(F.filter(named, lambda a: a["idtype"] == "doi"), F.lit(0))["value"],
        "authors": _persons("$.authors", "$.name")(item),
        "year": _year(get("$.pubdate"))(item),
        "venue": get("$.source")(item),
    }
    joined = rows.join(detail.dropDuplicates(["uid"]), "uid", "left")
    return _finish(joined.select("query", "place", *[own.get(n, F.lit(None)).cast(k).alias(n) for n, k in FIELDS.items()]), "pubmed")


# Spellings of the keys of supplied hits.
HIT_URL, HIT_TITLE, HIT_SNIPPET = ("url", "link", "href", "uri"), ("title", "name", "heading"), ("snippet", "description", "summary", "content", "text", "excerpt")
HIT_WRAPPERS = ("results", "hits", "items", "webResults", "web_results", "sources")


def read_hits(responses: DataFrame) -> DataFrame:
    """Supplied hits: a JSON array of objects or URLs, such an array in an object, or lines of URLs; the first of each URL counts."""
    body = F.trim("payload")
    arrays = [F.from_json(body, "array<string>"), *[F.from_json(F.get_json_object(body, f"$.{w}"), "array<string>") for w in HIT_WRAPPERS]]
    lines = F.filter(F.transform(F.split(body, "\n"), lambda l: F.trim(l)), lambda l: l.rlike("^https?://"))
    items = F.when(body.rlike(r"^[\[{]"), F.coalesce(*arrays)).otherwise(lines)
    rows = responses.select("query", F.posexplode(items).alias("place", "item"), F.size(items).alias("n"))

    def any_of(names: tuple[str, ...]) -> Column:
        return get("|".join(f"$.{n}" for n in names))(F.col("item"))

    own = {"url": F.coalesce(F.when(F.col("item").rlike("^https?://"), F.col("item")), any_of(HIT_URL)), "title": any_of(HIT_TITLE), "snippet": any_of(HIT_SNIPPET), "score": (F.col("n") - F.col("place")).cast("double")}
    found = rows.select("query", "place", *[own.get(n, F.lit(None)).cast(k).alias(n) for n, k in FIELDS.items()])
    first = found.groupBy("query", "url").agg(F.min("place").alias("place"))
    return _finish(found.join(first, ["query", "url", "place"], "left_semi"), "supplied")


REGISTRY: dict[str, Callable[[DataFrame], DataFrame]] = {
    **{kind: (lambda df, kind=kind: read_json_responses(df, kind)) for kind in SPECS},
    **{engine: (lambda df, engine=engine: read_result_pages(df, engine)) for engine in SCRAPED},
    "arxiv": read_arxiv,
    "supplied": read_hits,
}


def read_responses(spark: SparkSession, responses: DataFrame, backend: str) -> tuple[DataFrame, str]:
    """Candidates and a note. An unknown backend has no candidates and says so."""
    if backend in REGISTRY:
        return REGISTRY[backend](responses), f"{backend}: read"
    schema = "query string, backend string, pos int, " + ", ".join(f"{n} {k}" for n, k in FIELDS.items())
    return spark.createDataFrame([], schema), f"{backend}: no such backend"
