import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from siftline.functions.text import query_tokens
from siftline.functions.url import in_domains
from siftline.operators import dedup, ranking
from siftline.plans import modes, questions
from siftline.plans.gather import Options

WORDS = "cobalt anode lithium cathode binder slurry coating drying calender press porosity tab weld seal electrolyte fill formation cycle capacity fade".split()


def corpus(rng):
    docs = []
    for k in range(60):
        words = rng.choices(WORDS, k=rng.randrange(3, 30))
        docs.append((f"https://{'lab' if k % 9 == 0 else 'site'}{k % 7}.org/{k}", " ".join(rng.choices(WORDS, k=3)), f"# {rng.choice(WORDS)}\n" + " ".join(words) + (" press coating" if k % 11 == 0 else "")))
    long = " ".join(rng.choices(WORDS, k=120))
    docs += [(f"https://twin.org/{k}", "cobalt twin page", long) for k in range(3)]
    docs += [("https://stub.org/1", "cobalt anode", "Cobalt anode may refer to: cobalt, anode, lithium")]
    return docs


QUESTIONS = [(1, "How does the cobalt anode fade with capacity?"), (2, "lithium cathode binder slurry unobtainium"), (3, "press"), (4, ""), (5, None), (6, "42 17 press99"), (7, "zzz qqq")]


def idf(n, df):
    return 1.0 if n < 3 else math.log(1 + (n - df + 0.5) / (df + 0.5))


def brute_search(docs, query, site, n):
    out = []
    for no, body in enumerate((lambda d: f"{d[1]} {d[2]}", lambda d: d[1])):
        index = {d[0]: set(query_tokens(body(d))) for d in docs}
        df = defaultdict(int)
        for terms in index.values():
            for t in terms:
                df[t] += 1
        held = sum(1 for terms in index.values() if terms)
        hits = []
        for u, terms in index.items():
            both = terms & set(query_tokens(query or ""))
            domain = u.split("/")[2]
            if both and (site is None or domain == site or domain.endswith("." + site)):
                hits.append((-round(sum(idf(held, df[t]) for t in both), 6), u))
        out.append((no, [u for _, u in sorted(hits)[:n]]))
    return out


def all_tokens(text):
    return [t for w in text.split() for t in query_tokens(w)] if text else []


def brute_scores(rows, terms):
    """Content score and matched terms of (title, text) rows by plain counting."""
    counted = []
    for title, text in rows:
        heads = " ".join(line for line in text.split("\n") if line.startswith("#"))
        counted.append(all_tokens(text) + 2 * all_tokens(heads) + 3 * all_tokens(title))
    n, mean = len(rows), sum(map(len, counted)) / max(1, len(rows))
    out = []
    for tokens in counted:
        hits = [(i, t) for i, t in enumerate(tokens) if t in terms]
        score = 0.0
        for t in {t for _, t in hits}:
            f = sum(x == t for _, x in hits)
            score += idf(n, sum(t in c for c in counted)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(tokens) / mean))
        close = sum(a[1] != b[1] and b[0] - a[0] <= 6 for a, b in zip(hits, hits[1:]))
        if len(terms) >= 2 and len(hits) >= 2:
            score *= 1 + min(0.1, 0.1 * close / (len(terms) - 1))
        out.append((score, [t for t in terms if any(x == t for _, x in hits)]))
    return out


def brute_assemble(docs, lists, terms, budget, floor):
    """Places of the sources of one question: fused, scored, blended and floored."""
    by_url = {d[0]: d for d in docs}
    rrf, found = defaultdict(float), defaultdict(set)
    for no, urls in lists:
        for pos, u in enumerate(urls, 1):
            rrf[u] += 1 / (60 + pos)
            found[u].add(no)
    pool = sorted(rrf, key=lambda u: (-round(rrf[u], 12), u))[:budget]
    content = brute_scores([by_url[u][1:] for u in pool], terms)
    most, top = max([1e-9, *(c for c, _ in content)]), max([1e-9, *(rrf[u] for u in pool)])
    rows = []
    for u, (c, matched) in zip(pool, content, strict=True):
        lettered = len(terms) >= 2 and any(any(x.isalpha() for x in t) for t in terms)
        topic = not lettered or (any(any(x.isalpha() for x in t) for t in matched) and "may refer to" not in by_url[u][2][:90])
        rows.append((not topic, -round(0.45 * rrf[u] / top + 0.35 * c / most + 0.075 + 0.025, 6), u, len(found[u])))
    rows.sort()
    on = sum(not r[0] for r in rows)
    return [r for i, r in enumerate(rows) if not r[0] or i < max(on, floor)]


def queries(spark, rows):
    return spark.createDataFrame(rows, "question_id long, list_no int, query string, site string")


@pytest.fixture(scope="module")
def made(spark):
    docs = corpus(random.Random(5))
    table = spark.createDataFrame([(*d, None) for d in docs], "url string, title string, text string, junk string").repartition(3)
    return docs, table.cache(), spark.createDataFrame(QUESTIONS, "question_id long, question string")


def test_search_of_many_queries(spark, made):
    docs, table, _ = made
    asked = [(q, 3, text, site) for q, text in QUESTIONS for site in [None]] + [(1, 4, "cobalt press", "lab0.org"), (1, 5, "cobalt", "org"), (1, 6, "cobalt", "lab9.org")]
    found = questions.corpus_search(table, 5)(queries(spark, asked)).collect()
    got = defaultdict(list)
    for r in sorted(found, key=lambda r: r.pos):
        got[r.question_id, r.list_no].append(r.url)
    want = {(q, 2 * no + k): urls for q, no, text, site in asked for k, urls in brute_search(docs, text, site, 5) if urls}
    assert got == want


def test_first_round_of_every_question(spark, made):
    docs, table, asked = made
    options = Options(depth="summary")
    terms = questions.question_terms(asked)
    assert {r.question_id: r.terms for r in terms.collect()} == {q: query_tokens(t or "") for q, t in QUESTIONS}
    search = questions.corpus_search(table, 12)
    _, kept = questions.assemble(search(queries(spark, [(q, 0, t, None) for q, t in QUESTIONS])), terms, table, options)
    got = defaultdict(list)
    for r in sorted(kept.collect(), key=lambda r: r.place):
        got[r.question_id].append((r.readmitted, -r.blended, r.url, r.found_by))
    want = {q: own for q, t in QUESTIONS if (own := brute_assemble(docs, brute_search(docs, t, None, 12), query_tokens(t or ""), 15, 3))}
    assert got == want


def test_second_round_finds_what_is_missing(spark, made):
    docs, table, asked = made
    few = 3
    options = Options(depth="summary", rounds=2, seeds=("lab0.org",), diversify=False)
    calls = []
    search = questions.corpus_search(table, few)

    def watched(own):
        calls.append([tuple(r) for r in own.select("question_id", "list_no", "query", "site").collect()])
        return search(own)

    found = questions.gather_questions(asked, watched, table, options).collect()
    assert len(calls) == 2 and {no for _, no, _, _ in calls[0]} == {0, 10} and {no for _, no, _, _ in calls[1]} == {20}
    assert {s for _, no, _, s in calls[0] if no == 10} == {"lab0.org"}
    texts = dict((d[0], d[2]) for d in docs)
    for q, text in QUESTIONS:
        terms = query_tokens(text or "")
        lists = [(2 * no + k, urls) for qq, no, query, site in calls[0] if qq == q for k, urls in brute_search(docs, query, site, few)]
        first = brute_assemble(docs, lists, terms, 15, 3)
        missing = [t for t in terms if sum(t in all_tokens(texts[r[2]]) for r in first[:10]) < 2] if first else []
        second = [query for qq, _, query, _ in calls[1] if qq == q]
        assert bool(second) == bool(missing)
        if missing:
            assert second[0].lower().split()[-len(missing) :] == missing or set(missing) <= {t for t in query_tokens(second[0])}
            lists += [(2 * 20 + k, urls) for k, urls in brute_search(docs, second[0], None, few)]
        whole = brute_assemble(docs, lists, terms, 15, 3)
        seeds = {r[2] for r in whole if r[2].split("/")[2] == "lab0.org"}
        got = sorted((r for r in found if r.question_id == q), key=lambda r: r.final)
        twins = [r[2] for r in whole if "twin" in r[2]]
        assert {r.url for r in got} == {r[2] for r in whole} - (set(twins) - {r.url for r in got if "twin" in r.url}) and sum("twin" in r.url for r in got) == min(1, len(twins))
        assert [r.id for r in got] == [f"S{k}" for k in range(1, len(got) + 1)] and [r.place for r in got] == sorted(r.place for r in got)
        old = {u for no, urls in lists if no < 40 for u in urls}
        assert all((r.round == 1) == (r.url in old) for r in got)
        assert all(r.blended >= 0.15 * 0.95 for r in got if r.url in seeds)
    assert any(r.round == 2 for r in found)


def test_order_is_diversified_within_each_question(spark, made):
    _, table, asked = made
    search = questions.corpus_search(table, 4)
    found = questions.gather_questions(asked, search, table, Options(depth="summary"))
    plain = questions.gather_questions(asked, search, table, Options(depth="summary", diversify=False))
    rows = {(r.question_id, r.url): r for r in found.collect()}
    assert rows.keys() == {(r.question_id, r.url) for r in plain.collect()}
    pool = plain.select("question_id", F.col("url").alias("id"), F.col("blended").alias("score"), questions.distinct_tokens(F.col("text")).alias("tokens"))
    want = {(r.question_id, r.id): r.mmr_pos for r in dedup.diversify(pool, "question_id").collect()}
    assert {k: r.final for k, r in rows.items()} == want


# --- hydration


def test_rungs_of_the_ladder(spark):
    kind = "question_id long, identity_key string, url string, abs_url string, title string, text string, snippet string, rank int"
    efetch = "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/efetch.fcgi?db=pubmed&id=7777777&rettype=abstract&retmode=text"
    pool = [
        (1, "a", "https://a.org/", None, "t", "mine", "s", 1),
        (1, "b", "https://b.org", "https://abs.org/b", "https://b.org", " ", "s", 2),
        (1, "c", "https://c.org", "https://abs.org/c", None, None, "s", 3),
        (1, "d", "https://pubmed.ncbi.nlm.nih.gov/7777777/", None, "t", None, "s", 4),
        (1, "e", "https://e.org", "https://pubmed.ncbi.nlm.nih.gov/7777777", "t", None, "s", 5),
        (1, "f", "https://gone.org/1", None, "t", None, "s", 6),
        (1, "g", "https://gone.org/2", None, "t", None, "s", 7),
        (1, "h", "https://gone.org/3", None, "t", None, "s", 8),
        (1, "i", "https://nowhere.org", None, "t", None, None, 9),
        (2, "f", "https://gone.org/3", None, "t", None, "s", 1),
        (2, "j", None, None, None, None, "s", 2),
        (2, "k", "https://wall.org", None, "t", None, "s", 3),
    ]
    documents = [
        ("https://a.org", "A", "theirs", None, 200, None),
        ("https://b.org/?utm_source=x", "B2", "second copy", None, 200, None),
        ("https://b.org/", "B", "first copy", None, 200, None),
        ("https://abs.org/c", "C", "abstract", None, 200, None),
        ("https://c.org", "wall", "We use cookies", "cookie/consent wall", 200, "never"),
        ("https://pubmed.ncbi.nlm.nih.gov/7777777/", "wall", "", None, 404, "too late"),
        (efetch, "P", "record 7777777", None, 200, None),
        ("https://gone.org/1", None, None, None, 410, None),
        ("https://gone.org/2", None, "", None, 404, "saved 2"),
        ("https://gone.org/3", None, "", None, 404, "saved 3"),
        ("https://wall.org", "wall", "We use cookies", "cookie/consent wall", 403, "saved wall"),
    ]
    table = spark.createDataFrame(documents, "url string, title string, text string, junk string, status int, archived string")
    pools = spark.createDataFrame(pool, kind)
    rows = {(r.question_id, r.identity_key): r for r in questions.hydrate(pools, table, rescues=2).collect()}
    got = {k: (r.text_via, r.text) for k, r in rows.items()}
    assert got == {
        (1, "a"): ("own", "mine"), (1, "b"): ("page", "first copy"), (1, "c"): ("alternate", "abstract"), (1, "d"): ("provider", "record 7777777"), (1, "e"): ("provider", "record 7777777"),
        (1, "f"): ("snippet", "s"), (1, "g"): ("archive", "saved 2"), (1, "h"): ("snippet", "s"), (1, "i"): ("snippet", ""), (2, "f"): ("archive", "saved 3"), (2, "j"): ("snippet", "s"), (2, "k"): ("snippet", "s"),
    }
    assert rows[1, "b"].title == "B" and rows[1, "c"].title == "C" and rows[1, "d"].text_from == efetch and rows[1, "b"].text_from is None
    assert {k for k, r in rows.items() if r.dead} == {(1, "f"), (1, "g"), (2, "f")}
    later = questions.hydrate(pools, table, rescues=2, used=spark.createDataFrame([(1, 1)], "question_id long, used int")).collect()
    assert {(r.question_id, r.identity_key) for r in later if r.dead} == {(1, "f"), (2, "f")}
    assert questions.hydrate(pools.limit(0), table).collect() == []
    assert {r.text_via for r in questions.hydrate(pools, table.limit(0)).collect()} == {"own", "snippet"}


def test_floor_readmits_the_best_of_the_dropped(spark):
    rows = [(1, k, ["a"] if k in (2, 5) else [], ["a", "b"], "text") for k in range(1, 8)] + [(2, k, [], ["a"], "text") for k in range(1, 4)] + [(3, 1, ["a"], ["a", "b"], "Mercury may refer to: a, b")]
    table = spark.createDataFrame(rows, "q int, place int, matched array<string>, terms array<string>, text string")
    got = {(r.q, r.place): r.readmitted for r in ranking.floor_by_question(table, "q", 3).collect()}
    assert got == {(1, 2): False, (1, 5): False, (1, 1): True, (2, 1): False, (2, 2): False, (2, 3): False, (3, 1): True}


def test_domains(spark):
    rows = spark.createDataFrame([("https://a.org/x",), ("https://b.a.org",), ("https://ba.org",)], "url string")
    assert [r[0] for r in rows.select(in_domains(F.col("url"), ["a.org"])).collect()] == [True, True, False]


# --- planning


def settle_one_by_one(rows, most):
    out, seen, used = [], set(), set()
    for question, queries in rows:
        key = question.strip().lower()
        if not key or key in seen or len(out) >= most:
            continue
        seen.add(key)
        fresh = []
        for q in queries:
            if q.lower() not in used:
                used.add(q.lower())
                fresh.append(q)
        out.append((f"Q{len(out) + 1}", question.strip(), fresh or queries[:1]))
    return out


def test_plans_of_many_questions(spark):
    rng = random.Random(4)
    names = ["How a", "how A", "b ", "", "c", "d", "E", "e"]
    rows = {q: [(rng.choice(names), [rng.choice("xyzXYZ") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 4))]) for _ in range(rng.randrange(0, 10))] for q in range(40)}
    table = spark.createDataFrame([(q, i, t, "f", x) for q, own in rows.items() for i, (t, x) in enumerate(own)], "question_id int, ord int, question string, facet string, queries array<string>").repartition(3)
    got = defaultdict(list)
    for r in modes.settle_facets(table, 4).collect():
        got[r.question_id].append((r.id, r.question, r.queries))
    assert {q: sorted(x) for q, x in got.items()} == {q: x for q, own in rows.items() if (x := settle_one_by_one(own, 4))}


def test_plans_have_drills_and_headings(spark):
    asked = [(1, "What is the token bucket in RFC 6585 v2.1?", "topic"), (2, "How does caching work", "bug"), (3, None, "topic"), (4, "a question", "no such mode")]
    found = defaultdict(list)
    for r in modes.plan_questions(spark.createDataFrame(asked, "question_id int, question string, mode string"), 8).orderBy("question_id", "id").collect():
        found[r.question_id].append(r)
    assert found.keys() == {1, 2} and found[1][0].facet == "identifier" and "v2.1" in found[1][0].question
    assert [r.facet for r in found[1][1:]] == list(modes.MODES["topic"].headings) and len(found[2]) == len(modes.MODES["bug"].headings)
    assert all(r.queries and len({q.lower() for x in own for q in x.queries}) >= len(own) - 1 for own in found.values() for r in own)
