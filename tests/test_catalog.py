import glob
import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from siftline.functions import html, text, url
from siftline.plans import catalog

from .test_functions import brute_terms


def plain(value):
    if value is None or value != value:
        return None
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return round(value, 5) if isinstance(value, float) else value


@pytest.fixture(scope="module")
def duck(small):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_against_sql(spark, small, duck, name):
    got = entry.queries()[name](spark, small)
    want = duck.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    theirs = sorted((tuple(plain(v) for v in r) for r in want.select(", ".join(columns)).fetchall()), key=repr)
    assert mine == theirs


def test_gathering_from_addresses_with_several_pages(spark, small, tmp_path):
    """Every third address has a second page of the same title: other words, or a wall."""
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE TABLE p AS SELECT * FROM '{small}/pages.parquet'")
    title, main = "regexp_extract(html, '(?s)<title>.*?</title>')", "'<article><p>' || coalesce(CASE WHEN page_id % 2 = 0 THEN next ELSE 'We use cookies' END, '') || '</p></article>'"
    con.sql(f"CREATE TABLE pages AS SELECT * FROM p UNION ALL SELECT page_id + 1000, url, {title} || {main} FROM (SELECT *, lead(regexp_replace(html, '<[^>]*>', ' ', 'g'), 1) OVER (ORDER BY page_id) AS next FROM p) WHERE page_id % 3 = 0")
    con.sql(f"COPY (FROM pages ORDER BY page_id) TO '{tmp_path}/pages.parquet'")
    con.sql(f"COPY (FROM '{small}/benchmark.parquet') TO '{tmp_path}/benchmark.parquet'")
    con.sql(f"CREATE VIEW benchmark AS FROM '{tmp_path}/benchmark.parquet'")
    for name in ("gather_questions", "question_gaps"):
        got, want = entry.queries()[name](spark, str(tmp_path)), con.sql(entry.oracle_sql()[name])
        columns = sorted(got.columns)
        mine = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
        assert mine == sorted((tuple(plain(v) for v in r) for r in want.select(", ".join(columns)).fetchall()), key=repr)
    found = entry.queries()["gather_rounds"](spark, str(tmp_path)).select("question_id", "url").collect()
    assert found and len(found) == len(set(found))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_runs(spark, small, name):
    assert entry.queries()[name](spark, small).collect() is not None


def test_batches_cover_all_customers(spark, small):
    keys = sorted(r.c_custkey for r in spark.read.parquet(f"{small}/customer.parquet").select("c_custkey").collect())
    got = sorted(tuple(r) for r in entry.queries()["worklist_batches"](spark, small).collect())
    assert got == [(key, k // 8) for k, key in enumerate(keys)]


def brute_title(text):
    parts = re.split(r"\n\s*\n", text)
    heading = re.search(r"^\s*#{1,6}\s+(.+?)\s*#*\s*$", parts[0], re.M)
    if heading:
        return heading[1].strip()[:200]
    paragraphs = [p for p in (" ".join(p.split()) for p in parts) if p]
    lead = paragraphs[0] if paragraphs else ""
    record = re.match(r"\d+\.\s", lead) and re.search(r"\bdoi:|\bepub\b|\d{4}\s+\w{3}\b", lead, re.I)
    return (paragraphs[1] if record and len(paragraphs) > 1 else lead)[:200]


def test_titles_of_all_texts(spark, tmp_path):
    texts = [None, "", " \n\n ", "one line", "first  part\nof it\n\nsecond", "\n\n# Late\n\nbody", "# Heading #\n\nbody", "lead\n## Within\nbody", "\n  \nlead behind a blank line"]
    texts += ["1. Journal. 2020 Sep;1: doi: 10.1/x\n\nThe title\n\nbody", "2. Journal. Epub 2019", "x" * 300 + "\n\ny", "a\n\n# Second paragraph"]
    data = list(enumerate(texts))
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.title for r in entry.queries()["titles_from_text"](spark, str(tmp_path)).collect()}
    assert got == {k: brute_title(t or "") for k, t in data}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def test_marginal_relevance_by_brute_force(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    pool = sorted(((r.doc_id, r.score, set(brute_terms(texts[r.doc_id]))) for r in catalog._top(spark, small, 30).collect()), key=lambda r: (-r[1], r[0]))
    most = max((jaccard(a[2], b[2]) for a in pool for b in pool if a[0] < b[0]), default=0) or 1
    picked = [pool[0]]
    while len(picked) < len(pool):
        left = [r for r in pool if r not in picked]
        picked.append(max(left, key=lambda r: (0.75 * r[1] / pool[0][1] - 0.25 * max(jaccard(r[2], p[2]) for p in picked) / most, -r[0])))
    got = sorted((r.mmr_pos, r.doc_id) for r in entry.queries()["mmr_order"](spark, small).collect())
    assert [d for _, d in got] == [r[0] for r in picked]


def test_title_clusters_by_brute_force(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").select("page_id", url.domain_of(F.col("url")).alias("domain"), html.html_title(F.col("html")).alias("title")).collect()
    want = {}
    for domain in {p.domain for p in pages}:
        clusters = []
        for p in sorted((p for p in pages if p.domain == domain), key=lambda p: p.page_id)[:10]:
            own = set(brute_terms(p.title))
            k = next((i for i, c in enumerate(clusters) if jaccard(c, own) >= 0.2), len(clusters))
            if k == len(clusters) and own:
                clusters.append(set())
            if own:
                clusters[k] |= own
            want[p.page_id] = k if own else -1
    assert {r.page_id: r.cluster for r in entry.queries()["title_clusters"](spark, small).collect()} == want


def test_top_sentences_by_brute_force(spark, small):
    """On texts without headings: the three sentences with most terms, in order; else the head of the text."""
    asked = text.query_patterns(catalog.question(spark, small))
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    got = {r.doc_id: r.snippet for r in entry.queries()["top_sentences"](spark, small).collect()}
    assert set(got) == {d.doc_id for d in docs}
    checked = 0
    for d in docs:
        lines = (d.text or "").split("\n")
        if any(re.match(r"\s*(#|```|~~~)", x) for x in lines):
            continue
        parts = [s for x in lines for s in (y.strip(" ") for y in re.split(r"(?<=[.!?])\s+", x)) if len(s) >= 20]
        scored = [(sum(bool(re.search(p, text._deaccent(s.lower()))) for p in asked.values()), s) for s in parts]
        pool = [i for i, (n, _) in enumerate(scored) if n] or list(range(len(parts)))
        best = sorted(sorted(pool, key=lambda i: (-scored[i][0], i))[:3])
        want = " ".join(parts[i] for i in best)[:360].strip(" ") if parts else " ".join(lines[:4])[:360].strip(" ")
        assert got[d.doc_id] == want
        checked += 1
    assert checked > 100


def test_entry(spark):
    assert entry.entry(spark).count() == 10
