"""URL, identity and citability functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track.
TRACKING = r"(?i)^(utm_|fbclid$|gclid$|mc_|ref$|ref_src$|ref_url$|spm$|_hsenc$|_hsmi$|igshid$)"
# Hosts, paths and query parameters of programming interfaces.
API_HOSTS = ["eutils.ncbi.nlm.nih.gov", "api.crossref.org", "api.openalex.org", "api.semanticscholar.org", "export.arxiv.org"]
API_PATH = r"(?i)^/europepmc/webservices/|^/search/publ/api|^/api/|\.(fcgi|cgi)$"
API_FORMAT = r"(?i)[?&](format|retmode|rettype|output)=(json|xml|text|atom|csv|bibtex)(?![A-Za-z0-9_])"
ID_PARAMETERS = ["id", "ids", "uid", "uids", "pmid", "doi", "identifier"]

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(F.trim(url), _PARTS, k)


def is_parseable(url: Column) -> Column:
    """Has a scheme and a host, and no space in the host."""
    return F.trim(url).rlike(_PARTS) & (host(url) != "") & ~host(url).rlike(r"\s")


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def host(url: Column) -> Column:
    """Lower-case host without user and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(_part(url, 2), "^.*@", ""), ":[0-9]*$", ""))


def domain_of(url: Column) -> Column:
    """Host without www.; local files have a name of their own, other strings none."""
    return F.when(scheme(url) == "file", "local file").when(is_parseable(url), F.regexp_replace(host(url), r"^www\.", "")).otherwise("")


def path(url: Column) -> Column:
    return _part(url, 3)


def query(url: Column) -> Column:
    """With its question mark; empty without any."""
    return _part(url, 4)


def _encoded(text: Column) -> Column:
    """Percent-encoded, with the characters that a URL component keeps."""
    out = F.url_encode(F.coalesce(F.try_url_decode(text), text))
    for code, kept in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(kept))
    return out


def canonical_url(url: Column) -> Column:
    """One spelling of a URL: host in lower case without www., no default port, fragment, tracking or trailing slash; parameters by key."""
    pairs = F.filter(F.split(F.regexp_replace(query(url), r"^\?", ""), "&"), lambda p: p != "")
    named = F.transform(pairs, lambda p, i: F.struct(F.coalesce(F.try_url_decode(F.regexp_extract(p, "^([^=]*)", 1)), F.lit("")).alias("k"), i.alias("i"), F.regexp_extract(p, "^[^=]*=?(.*)$", 1).alias("v")))
    kept = F.array_sort(F.filter(named, lambda p: ~p["k"].rlike(TRACKING)))
    search = F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    port = F.regexp_extract(_part(url, 2), ":([0-9]+)$", 1)
    usual = ((scheme(url) == "http") & (port == "80")) | ((scheme(url) == "https") & (port == "443"))
    whole = F.concat(
        scheme(url),
        F.lit("://"),
        F.regexp_replace(host(url), r"^www\.", ""),
        F.when((port != "") & ~usual, F.concat(F.lit(":"), port)).otherwise(""),
        F.regexp_replace(path(url), "/+$", ""),
        F.when(search != "", F.concat(F.lit("?"), search)).otherwise(""),
    )
    plain = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "/$", "")
    return F.when(is_parseable(url), F.regexp_replace(whole, "/$", "")).otherwise(plain)


def normalize_doi(doi: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(doi)), r"^https?://(dx\.)?doi\.org/", "")


def _some(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def _decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


# Where resolvers and landing pages have a DOI, and pages of preprints their id.
DOI_HOST, DOI_START = r"(^|\.)(dx\.)?doi\.org$", r"^10\.[0-9]{4,9}/"
DOI_PATH = r"(?i)/doi(?:/(?:abs|full|pdf|epdf|e?pub))?/(10\.[0-9]{4,9}/[^\s?#]+)"
ARXIV_HOST = r"(^|\.)arxiv\.org$"
ARXIV_BEFORE, ARXIV_AFTER = r"(?i)/(?:abs|pdf|html|format)/", r"(?:v[0-9]+)?(?:\.pdf)?$"
ARXIV_MODERN, ARXIV_LEGACY = r"([0-9]{4}\.[0-9]{4,5})", r"([a-z-]+(?:\.[A-Z]{2})?/[0-9]{7})"


def doi_from_url(url: Column) -> Column:
    """The DOI of a resolver link or in the path of a landing page; null without one."""
    resolver = normalize_doi(_decoded(F.regexp_replace(F.regexp_replace(path(url), "^/+", ""), "/+$", "")))
    landing = F.regexp_extract(path(url), DOI_PATH, 1)
    found = F.when(host(url).rlike(DOI_HOST), F.when(resolver.rlike(DOI_START), resolver)).otherwise(
        _some(normalize_doi(F.regexp_replace(_decoded(landing), "/+$", "")))
    )
    return F.when(is_parseable(url), found)


def arxiv_from_url(url: Column) -> Column:
    """The arXiv id of an abs, pdf, html or format page without its version; null without one."""
    modern, legacy = (F.regexp_extract(path(url), ARXIV_BEFORE + own + ARXIV_AFTER, 1) for own in (ARXIV_MODERN, ARXIV_LEGACY))
    return F.when(host(url).rlike(ARXIV_HOST), F.lower(F.coalesce(_some(modern), _some(legacy))))


def identity_key(url: Column, doi: Column | None = None, arxiv: Column | None = None) -> Column:
    """One key for one work: its DOI, its arXiv id, those in the URL, or the canonical URL."""
    none = F.lit(None).cast("string")
    own_doi = none if doi is None else F.concat(F.lit("doi:"), normalize_doi(_some(doi)))
    own_arxiv = none if arxiv is None else F.concat(F.lit("arxiv:"), F.regexp_replace(F.lower(_some(arxiv)), r"v[0-9]+$", ""))
    return F.coalesce(own_doi, own_arxiv, F.concat(F.lit("doi:"), doi_from_url(url)), F.concat(F.lit("arxiv:"), arxiv_from_url(url)), canonical_url(url))


def is_api_endpoint(url: Column) -> Column:
    found = domain_of(url).isin(API_HOSTS) | path(url).rlike(API_PATH) | query(url).rlike(API_FORMAT)
    return is_parseable(url) & found


def is_citable(url: Column) -> Column:
    return is_parseable(url) & scheme(url).isin("http", "https") & ~is_api_endpoint(url)


def addressed_ids(url: Column) -> Column:
    """How many ids the first id parameter with a value names."""
    counts = []
    for name in ID_PARAMETERS:
        raw = _decoded(F.regexp_extract(query(url), f"[?&]{name}=([^&]*)", 1))
        n = F.size(F.filter(F.split(raw, r"[,\s+]+"), lambda s: F.trim(s) != ""))
        counts.append(F.when(n > 0, n))
    return F.coalesce(*counts, F.lit(0))


# What names a work in a text or URL.
DOI = r"(?<![A-Za-z0-9_])(10\.[0-9]{4,9}/[^\s\"'<>()\[\],;]+)"
ARXIV = r"(?i)(?<![A-Za-z0-9_])arxiv[:\s/]+((?:[0-9]{4}\.[0-9]{4,5}|[a-z-]+(?:\.[A-Z]{2})?/[0-9]{7})(?:v[0-9]+)?)"
ARXIV_IN_PATH = r"/([0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?)(?:$|[/?#])"
PMID = r"(?i)(?<![A-Za-z0-9_])PMID:?\s*([0-9]{4,9})(?![A-Za-z0-9_])"


def declares_identity(url: Column) -> Column:
    return url.rlike(DOI) | url.rlike(ARXIV_IN_PATH)


def derive_citable_url(text: Column, canonical: Column | None = None) -> Column:
    """A URL to cite: the canonical one, else that of a DOI, arXiv or PubMed id in the first 4000 characters; null without any."""
    head = F.substring(text, 1, 4000)
    doi, arxiv, pmid = (_some(F.regexp_extract(head, p, 1)) for p in (DOI, ARXIV, PMID))
    own = F.lit(None).cast("string") if canonical is None else F.when(is_citable(canonical), canonical)
    return F.coalesce(
        own,
        F.concat(F.lit("https://doi.org/"), F.regexp_replace(doi, r"[.,;:)\]]+$", "")),
        F.concat(F.lit("https://arxiv.org/abs/"), arxiv),
        F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid, F.lit("/")),
    )


def in_domains(url: Column, domains: list[str]) -> Column:
    """Whether the domain is one of ``domains`` or below one."""
    own = domain_of(url)
    out = F.lit(False)
    for d in domains:
        out = out | (own == d) | own.endswith("." + d)
    return out


# Names and routes of PDF files, and the names that such a route may end in nevertheless.
PDF_NAME, PDF_ROUTE, NO_PDF = r"(?i)\.pdf($|[?#])", r"(?i)/(pdf|epdf)/", r"(?i)\.(html?|xml|json|txt)($|[?#])"


def looks_like_pdf(url: Column) -> Column:
    return url.rlike(PDF_NAME) | (url.rlike(PDF_ROUTE) & ~url.rlike(NO_PDF))


# Office formats by extension.
DOC_FORMATS = {"doc": "doc", "docx": "docx", "odt": "odt", "rtf": "rtf", "xls": "xls", "xlsx": "xlsx", "ods": "ods", "csv": "csv", "ppt": "ppt", "pptx": "pptx", "odp": "odp", "epub": "epub"}


def doc_format(url: Column) -> Column:
    extension = F.lower(F.regexp_extract(url, r"(?i)\.([a-z0-9]{2,5})(?:$|[?#])", 1))
    return F.create_map(*[F.lit(x) for pair in DOC_FORMATS.items() for x in pair])[extension]
