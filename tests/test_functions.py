import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftline.functions import claims, hashing, html, terms, text, url


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("https://WWW.Example.com:443/a/b/?utm_source=x&b=2&a=1#frag", "https://example.com/a/b?a=1&b=2"),
        ("http://example.com/", "http://example.com"),
        ("http://example.com:8080//", "http://example.com:8080"),
        ("https://e.org/?q=a%20b&fbclid=1", "https://e.org?q=a%20b"),
        ("not a url#x", "not a url"),
        ("https://e.org/p?ref=1&ref_src=2&refer=3", "https://e.org/p?refer=3"),
    ],
)
def test_canonical_url(spark, raw, want):
    assert one(spark, raw, url.canonical_url) == want


def test_identity(spark):
    rows = [
        ("https://doi.org/10.1000/ABC", None, None, "doi:10.1000/abc"),
        ("https://dl.acm.org/doi/pdf/10.1145/1.2", None, None, "doi:10.1145/1.2"),
        ("https://arxiv.org/pdf/2405.12345v3.pdf", None, None, "arxiv:2405.12345"),
        ("https://e.org/x", "https://doi.org/10.1/Q", None, "doi:10.1/q"),
        ("https://e.org/x", "", "2405.00001v2", "arxiv:2405.00001"),
        ("https://e.org/x/", None, None, "https://e.org/x"),
        (None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "u string, d string, a string, want string")
    for r in df.select("want", url.identity_key(F.col("u"), F.col("d"), F.col("a")).alias("got")).collect():
        assert r.got == r.want


def test_citable(spark):
    assert one(spark, "https://api.crossref.org/works/1", url.is_api_endpoint)
    assert one(spark, "https://x.org/a?format=json", url.is_api_endpoint)
    assert not one(spark, "ftp://x.org/a", url.is_citable)
    assert one(spark, "https://x.org/a", url.is_citable)
    assert one(spark, "https://x.org/?ids=1,2,3", url.addressed_ids) == 3
    assert one(spark, "see PMID: 12345", url.derive_citable_url) == "https://pubmed.ncbi.nlm.nih.gov/12345/"
    assert one(spark, "doi 10.1000/xyz.1). and", url.derive_citable_url) == "https://doi.org/10.1000/xyz.1"


@pytest.mark.parametrize("word, want", [("Requests", "request"), ("queries", "query"), ("boxes", "box"), ("Éclairs", "eclair"), ("class", "class"), ("status", "status"), ("łódź", "lodz")])
def test_folding(spark, word, want):
    assert one(spark, word, text.fold_term) == want
    assert text._fold_plural(text._deaccent(word.lower())) == want


def test_words(spark):
    assert one(spark, "How do HTTP caches work with Caches and user_id v1.2?", text.keywords) == ["HTTP", "caches", "user_id", "v1"]
    assert one(spark, "the plain retryAfter error_429 thing", text.ranked_keywords) == ["error_429", "retryAfter", "plain", "thing"]
    assert one(spark, 'v1.2.3 fooBar snake_case 404 "quoted span" 10.1234/ab', text.identifiers) == ["v1.2.3", "10.1234", "10.1234/ab", "fooBar", "snake_case", "404", "1234", "quoted span"]
    assert one(spark, "parseHTTPResponse", text.subtokens) == ["parse", "http", "response"]
    assert one(spark, "https://Example.com/A b", text.slug) == "example.com-a-b"
    assert one(spark, "\n", text.slug) == "run"
    assert one(spark, None, terms.tokens) == []


def test_titles_and_cuts(spark):
    assert one(spark, "# Heading one #\n\nbody", text.title_from_text) == "Heading one"
    assert one(spark, "1. Journal. 2020 Sep;1: doi: 10.1/x\n\nThe real  title", text.title_from_text) == "The real title"
    assert one(spark, "a\n" * 3000, lambda c: text.cap_extract(c, "summary")) == ("a\n" * 3000)[:3999] + "\n\n… [truncated]"
    assert one(spark, "x" * 5000, lambda c: text.cap_extract(c, "summary")) == "x" * 4000 + "\n\n… [truncated]"
    assert one(spark, "short", lambda c: text.cap_extract(c, "summary")) == "short"


def test_sentences(spark):
    body = "# Limits\nNothing to see in this sentence. The rate limiter drops excess requests. Unrelated words stand here again.\nA token bucket refills at a fixed rate."
    got = one(spark, body, lambda c: text.top_sentences(c, "rate limiter token bucket", sentences=2))
    assert got == "Limits — The rate limiter drops excess requests. A token bucket refills at a fixed rate."
    assert one(spark, "", lambda c: text.top_sentences(c, "x")) == ""


def test_html(spark):
    page = "<html><head><title>A &amp; B</title></head><body><!-- x --><nav>menu</nav><h2 class='a'>Top</h2><p>One&nbsp;&#233;&#x41;</p><br>two<script>no()</script></body></html>"
    assert one(spark, page, html.html_to_text) == "## Top\nOne éA\ntwo"
    assert one(spark, page, html.html_title) == "A & B"
    assert one(spark, "<link rel='canonical' href='https://e.org/c'>", html.html_canonical_url) == "https://e.org/c"
    assert one(spark, "Please enable JavaScript to go on", html.junk_reason) == "JavaScript-required shell"
    assert one(spark, "a fine page", html.junk_reason) is None
    assert one(spark, "", html.extraction_fault) == html.EMPTY
    assert one(spark, "a\x01\x02b", html.extraction_fault) == html.BINARY
    assert one(spark, "fine text", html.extraction_fault) is None


def test_main_region():
    body = "word " * 200
    page = f"<body><div>menu</div><article><div>{body}</div></article><footer>x</footer></body>"
    assert html.main_region(page) == f"<div>{body}</div>"
    assert html.main_region("<p>no region</p>") == "<p>no region</p>"
    assert html.main_region(f"<main>tiny</main><p>{body}</p>") == f"<main>tiny</main><p>{body}</p>"


def fnv(s):
    h = 0xCBF29CE484222325
    for k in range(0, len(b := s.encode("utf-16-le")), 2):
        h = (h ^ int.from_bytes(b[k : k + 2], "little")) * 0x100000001B3 % (1 << 64)
    return h


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(max_size=12), max_size=12))
def test_fnv(strings):
    assert hashing.fnv1a64_of(strings).tolist() == [fnv(s) for s in strings]


def brute_terms(raw):
    """Terms word by word with the library's own folding rules for the driver."""
    words = regex.findall(r"[\p{L}\p{N}_]+", (raw or "").lower())
    folded = [text._fold_plural(text._deaccent(w)) for w in words if len(w) > 1 and w not in text.STOPWORDS]
    return [t for t in folded if len(t) > 1]


TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aBsé Éß_1½ 日本İ\u0301😀.\nx", max_size=40), st.text(max_size=20)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_terms_by_brute_force(rows):
    own = terms.terms_of(pa.array(rows, pa.string()))
    got = [[own.terms[i].as_py() for i in own.ids[a:b]] for a, b in zip(own.begins, own.begins[1:])]
    assert got == [brute_terms(r) for r in rows]
    once = own.distinct()
    assert [[once.terms[i].as_py() for i in once.ids[a:b]] for a, b in zip(once.begins, once.begins[1:])] == [list(dict.fromkeys(g)) for g in got]


def test_terms_of_columns(spark, monkeypatch):
    rows = [(1, "Cafés and the stories of boxes", "# Box"), (2, None, None), (3, "", "x"), (4, "word " * 3000 + "end", "ends words")]
    df = spark.createDataFrame(rows, "id int, text string, title string").repartition(1)
    got = {r.id: r for r in df.select("id", terms.tokens(F.col("text")).alias("t"), terms.distinct_tokens(F.col("text")).alias("d"), terms.token_counts(F.col("text")).alias("n"), terms.term_places([(F.col("text"), 1), (F.col("title"), 2)], ["box", "end", "word"]).alias("p")).collect()}
    assert got[1].t == ["cafe", "story", "box"] and got[2].t == got[3].t == [] and got[4].d == ["word", "end"]
    assert tuple(got[4].n) == (3001, 2) and [tuple(h) for h in got[1].p.hits] == [(2, "box"), (3, "box"), (4, "box")]
    assert got[1].p.dl == 5 and got[2].p.dl == 0 and got[4].p.dl == 3005 and [tuple(h) for h in got[4].p.hits][-5:] == [(3000, "end"), (3001, "end"), (3002, "word"), (3003, "end"), (3004, "word")]


def test_simhash():
    rows = ["token bucket rate limits drop", None, "one", "one two1", "", "Ωmega naïve wörld token bucket rate token bucket rate token"]

    def brute(raw):
        t = brute_terms(raw)
        hashes = [fnv(" ".join(t[k : k + 3])) for k in range(len(t) - 2)] if len(t) >= 3 else [fnv(x) for x in t]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    assert hashing.simhash_of(terms.terms_of(pa.array(rows))).tolist() == [brute(r) for r in rows]
    assert hashing.simhash_of(terms.terms_of(pa.array([], pa.string()))).dtype == np.uint64


REPORT = """# Report
First claim has six words here [S1][S2].
It goes on `[S9]` in the block.

> A quote of a source [S3]
> in two lines

> [model-hint] this is a guess
> over two lines

| head | head2 |
|---|---|
| cell one | cell two [S4] |

- item one has a source [S1]
  and a continuation
- item two has none at all here

```
code [S7]
```
<!-- hidden [S8]
still hidden -->
See [S5](http://x) and [M].

## Sources
- [S6] listed
"""


def test_units():
    got = claims.claim_units(REPORT)
    assert [u["kind"] for u in got] == ["text", "text", "text", "list", "text"]
    assert got[0]["items"][0].startswith("First claim") and "S9" not in got[0]["items"][0]
    assert got[1]["items"] == ["A quote of a source [S3] in two lines"]
    assert got[2]["items"] == ["cell one cell two [S4]"]
    assert got[3]["items"] == ["item one has a source [S1] and a continuation", "item two has none at all here"]


def test_numerals(spark):
    assert one(spark, "1,234 and 5 and 2.5% in [link 99](http://x/77) [S12] `888` 1234", claims.numerals) == ["1234", "2.5", "99"]
    assert one(spark, "12 345,678", claims.normalize_numerals) == "12345678"
    assert one(spark, "a [S1] [S1] [S2](x) [M] [S3]", claims.source_tokens) == ["S1", "S3"]
    assert one(spark, "**Six** words [S1] [a link](http://y) end", claims.claim_words) == 4
