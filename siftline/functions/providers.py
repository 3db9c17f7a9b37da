"""URLs whose shape says more than the generic rules: what to cite, where the text is, what is no document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .url import query

# Landing pages and services that are told apart by their URLs.
PUBMED = r"(?i)^https?://(?:www\.)?pubmed\.ncbi\.nlm\.nih\.gov/([0-9]{4,9})/?$"
PMC = r"(?i)^https?://(?:www\.)?pmc\.ncbi\.nlm\.nih\.gov/articles/(PMC[0-9]+)/?$"
EUTILS = r"(?i)^https?://eutils\.ncbi\.nlm\.nih\.gov/entrez/eutils/([a-z]+)\.fcgi"
ARXIV_PDF = r"(?i)^https?://(?:www\.|export\.)?arxiv\.org/pdf/([^?#]+?)(?:\.pdf)?/?$"
QUERIES = ("esearch", "egquery", "espell")
ABSTRACT = "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/efetch.fcgi?db=pubmed&id={}&rettype=abstract&retmode=text"


def _parameter(url: Column, name: str) -> Column:
    raw = F.regexp_extract(query(url), rf"[?&]{name}=([^&]*)", 1)
    return F.coalesce(F.try_url_decode(raw), raw)


def _abstract(pmid: Column) -> Column:
    before, after = ABSTRACT.split("{}")
    return F.concat(F.lit(before), pmid, F.lit(after))


def resolve_provider(url: Column) -> Column:
    """A struct: cite_url; text_url, an alternate with the text; prefer_text, whether to read that first; reject, why this is no document."""
    raw = F.trim(url)
    pubmed, pmc, service, arxiv = (F.regexp_extract(raw, p, 1) for p in (PUBMED, PMC, EUTILS, ARXIV_PDF))
    asked = F.lower(service).isin(*QUERIES)
    db = F.lower(_parameter(raw, "db"))
    first = F.get(F.filter(F.split(_parameter(raw, "id"), r"[,\s+]+"), lambda x: x != ""), F.lit(0))
    record = (service != "") & ~asked & first.isNotNull()
    pmid = F.when(pubmed != "", pubmed).when(record & (db == "pubmed") & first.rlike("^[0-9]+$"), first)
    pmcid = F.when(pmc != "", F.upper(pmc)).when(record & (db == "pmc"), F.when(first.rlike("(?i)^pmc"), F.upper(first)).otherwise(F.concat(F.lit("PMC"), first)))
    cite = (
        F.when(pmid.isNotNull(), F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid, F.lit("/")))
        .when(pmcid.isNotNull(), F.concat(F.lit("https://pmc.ncbi.nlm.nih.gov/articles/"), pmcid, F.lit("/")))
        .when(arxiv != "", F.concat(F.lit("https://arxiv.org/abs/"), arxiv))
        .otherwise(raw)
    )
    text = F.when(pmid.isNotNull(), _abstract(pmid)).when(arxiv != "", raw)
    reject = F.when((service != "") & asked, F.concat(F.lit("a query, not a document: "), F.lower(service)))
    return F.struct(cite.alias("cite_url"), text.alias("text_url"), (arxiv != "").alias("prefer_text"), reject.alias("reject"))
