import random
import re
import time

from pyspark.sql import functions as F

from siftline.functions.terms import distinct_tokens
from siftline.functions.text import query_tokens
from siftline.operators import dedup, fusion, grounding, ranking, sources_table

from .test_functions import REPORT


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_fusion(spark):
    data = [(1, 1, "u1", "t1", "", {"a": "1"}, "k1"), (1, 2, "u2", "t2", "x", None, "k2"), (2, 1, "u3", "t3", "full", {"a": "2", "b": "3"}, "k1"), (2, 2, "u4", "t4", None, {"c": "4"}, "k1")]
    lists = spark.createDataFrame(data, "list_no int, pos int, url string, title string, text string, meta map<string,string>, key string")
    got = {r.key: r for r in fusion.fuse(lists, "key").collect()}
    assert got["k1"].url == "u3" and got["k1"].meta == {"a": "2", "b": "3", "c": "4"} and got["k1"].found_by == 2
    assert abs(got["k1"].score - (1 / 61 + 1 / 61 + 1 / 62)) < 1e-12
    assert got["k2"].meta is None and got["k2"].text == "x"
    assert fusion.fuse(lists.limit(0), "key").collect() == []


def test_dedupe_by_url_ties(spark):
    df = spark.createDataFrame([("k", 1.0, 2, "b"), ("k", 1.0, 1, "a"), ("j", None, 3, "c")], "k string, score double, pos int, v string")
    assert rows(fusion.dedupe_by_url(df, "k", "score", "pos"), "k", "v", "first_pos", "copies") == [("j", "c", 3, 1), ("k", "a", 1, 2)]


def test_cascade(spark):
    engines = spark.createDataFrame([(1, "a", 9), (2, "b", 0), (3, "c", 9), (4, "d", 9)], "preference int, engine string, items int")
    assert [r.engine for r in fusion.cascade(engines, 5, 2).orderBy("preference").collect()] == ["a", "b", "c"]
    assert fusion.cascade(engines.limit(0), 5, 2).collect() == []


def brute_bm25(docs, question):
    import math

    def toks(t):
        return query_all(t)

    q = query_tokens(question)
    streams = {i: toks(body) + toks(title) * 3 for i, title, body in docs}
    n, avg = len(docs), sum(map(len, streams.values())) / len(docs)
    out = {}
    for i, s in streams.items():
        score = 0
        for t in q:
            df, f = sum(t in x for x in streams.values()), s.count(t)
            if f:
                score += math.log(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(s) / avg))
        hits = [(k, t) for k, t in enumerate(s) if t in q]
        close = sum(b[1] != a[1] and b[0] - a[0] <= 6 for a, b in zip(hits, hits[1:]))
        out[i] = score * (1 + (min(0.1, 0.1 * close / max(1, len(q) - 1)) if len(hits) > 1 and len(q) > 1 else 0))
    return out


def query_all(text):
    from siftline.functions.text import STOPWORDS, _deaccent, _fold_plural, _split

    folded = [_fold_plural(_deaccent(w.lower())) for w in _split(text) if len(w) >= 2 and w.lower() not in STOPWORDS]
    return [t for t in folded if len(t) >= 2]


def test_bm25(spark):
    docs = [(1, "token bucket", "rate limits drop requests"), (2, "other", "a bucket and a token far " + "filler " * 20 + "rate"), (3, "none", "nothing here"), (4, "", ""), (5, "token", "token token token bucket")]
    df = spark.createDataFrame(docs, "id int, title string, body string")
    got = {r.id: r.score for r in ranking.bm25(df, "id", "token bucket rate", F.col("title"), F.col("body")).collect()}
    want = brute_bm25(docs, "token bucket rate")
    assert all(abs(got[i] - want[i]) < 1e-9 for i in want)
    assert {r.score for r in ranking.bm25(df, "id", "the of", F.col("title"), F.col("body")).collect()} == {0.0}


def test_floor(spark):
    df = spark.createDataFrame([(1, ["token"]), (2, ["2024"]), (3, []), (4, ["rate"])], "pos int, matched array<string>")
    assert rows(ranking.relevance_floor(df, ["token", "2024"], 3), "pos", "readmitted") == [(1, False), (2, True), (4, False)]
    assert ranking.relevance_floor(df, ["2024"], 1).count() == 4
    assert ranking.relevance_floor(df, ["token", "2024"], 1).count() == 2


def greedy(prints, bits=3):
    kept = []
    for _, fp in sorted(prints):
        if all(((fp ^ k) & (2**64 - 1)).bit_count() > bits for k in kept):
            kept.append(fp)
    return set(kept)


def test_greedy_scan(spark):
    random.seed(11)
    prints, rank = [], 0
    for _ in range(25):
        fp = random.getrandbits(63)
        for _ in range(random.randint(1, 8)):
            prints.append((rank, fp))
            rank += 1
            for b in random.sample(range(63), random.randint(0, 3)):
                fp ^= 1 << b
    random.shuffle(prints)
    prints = [(r, fp) for r, (_, fp) in enumerate(prints)]
    df = spark.createDataFrame(prints, "rank long, fp long")
    got = {r.fp for r in dedup.keep_first(df).filter("kept").collect()}
    assert got == greedy(prints)
    pairs = {(r.a, r.b) for r in dedup.near_pairs(df).collect()}
    keys = sorted({fp for _, fp in prints})
    assert pairs == {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if (a ^ b).bit_count() <= 3}
    docs = df.withColumn("n", F.when(F.col("rank") % 7 == 0, 10).otherwise(1000))
    kept = dedup.dedupe_near(docs, "fp", "rank", F.col("n") >= 500)
    long = [(r, fp) for r, fp in prints if r % 7]
    want = {min(r for r, f in long if f == fp) for fp in greedy(long)} | {r for r, _ in prints if r % 7 == 0}
    assert {r["rank"] for r in kept.collect()} == want


def test_diversify(spark):
    pool = spark.createDataFrame([(1, "a", 1.0, ["x", "y"]), (1, "b", 0.95, ["x", "y"]), (1, "c", 0.9, ["z"]), (2, "d", 0.1, [])], "g int, id string, score double, tokens array<string>")
    assert rows(dedup.diversify(pool, "g"), "g", "mmr_pos", "id") == [(1, 1, "a"), (1, 2, "c"), (1, 3, "b"), (2, 1, "d")]


def test_clusters_and_labels(spark):
    titles = ["token bucket limits", "bucket of tokens", "salmon recipes", "", "salmon soup"]
    df = spark.createDataFrame([(1, str(k), k, t) for k, t in enumerate(titles)], "g int, id string, pos int, title string").withColumn("tokens", distinct_tokens(F.col("title")))
    clusters = dedup.cluster_titles(df, "g")
    assert rows(clusters, "id", "cluster") == [("0", 0), ("1", 0), ("2", 1), ("3", -1), ("4", 1)]
    labels = dedup.angle_labels(df.join(clusters, ["g", "id"]).withColumn("token", F.explode("tokens")), "cluster")
    assert rows(labels, "cluster", "label") == [(0, "bucket token limit"), (1, "salmon recipe soup")]


def report_tables(spark):
    reports = spark.createDataFrame([(1, "REPORT.md", REPORT), (2, "REPORT.md", None)], "report_id long, file string, text string")
    sources = spark.createDataFrame([(1, f"S{k}", k / 10, "value 42" if k == 1 else "") for k in (1, 2, 3, 4, 9)], "report_id long, source_id string, trust double, text string")
    return reports, sources


def test_citations(spark):
    reports, sources = report_tables(spark)
    assert rows(grounding.dangling_citations(reports, sources), "source_id") == [("S6",)]
    assert rows(grounding.uncited_sources(reports, sources), "source_id") == [("S9",)]
    assert rows(grounding.unsourced_claims(reports), "claim") == [("item two has none at all here",)]
    gate = {r.report_id: r for r in grounding.check(reports, sources).collect()}
    assert (gate[1].citations, gate[1].model_hints, gate[1].dangling, gate[1].ok) == (5, 1, 1, False)
    assert not gate[2].ok and gate[2].citations == 0


def test_claim_pairs_and_numerals(spark):
    text = "The value was 42 in the test [S1][S2].\n\nAnother claim says 77 and 42 [S2]."
    reports = spark.createDataFrame([(1, "REPORT.md", text)], "report_id long, file string, text string")
    _, sources = report_tables(spark)
    pairs = grounding.claim_pairs(reports, sources)
    assert rows(pairs, "claim_id", "source_id", "numerals_absent") == [("C1", "S1", []), ("C1", "S2", ["42"]), ("C2", "S2", ["77", "42"])]
    assert rows(grounding.ungrounded_numerals(reports, sources), "claim_id", "numeral") == [("C2", "42"), ("C2", "77")]
    assert rows(grounding.worklist(pairs, 2), "claim_id", "source_id") == [("C1", "S2"), ("C2", "S2")]


def test_numerals_of_long_claims(spark):
    """Against brute force on claims of more than 400 characters, with numerals before, across and behind character 400."""
    random.seed(5)
    texts, bodies, want = [], [], set()
    for r in range(12):
        cited = random.sample([1, 2, 3], random.randint(1, 2))
        found = [str(random.randint(10, 99) * 1000 + k) for k in range(3)]
        head = f"Starts with {found[0]} " + "word " * 200
        claim = head[: 396 + r % 3] + f" {found[1]} " + "more " * 30 + f"{found[2]} " + "".join(f"[S{s}]" for s in cited)
        body = {s: " ".join(n for n in found if random.random() < 0.3) for s in (1, 2, 3)}
        texts.append((r, "REPORT.md", claim))
        bodies += [(r, f"S{s}", 0.5, t) for s, t in body.items()]
        want |= {(r, "C1", n) for n in found if not any(n in body[s] for s in cited)}
    reports = spark.createDataFrame(texts, "report_id long, file string, text string")
    sources = spark.createDataFrame(bodies, "report_id long, source_id string, trust double, text string")
    assert rows(grounding.ungrounded_numerals(reports, sources), "report_id", "claim_id", "numeral") == sorted(want)
    assert {len(r.claim) for r in grounding.claim_pairs(reports, sources).collect()} == {400}


def test_verdicts(spark):
    data = [("C1", "S1", "supported", 1), ("C1", "S2", "refuted", 2), ("C2", "S1", "unsupported", 3), ("C3", "S1", None, 4), ("C3", "S2", "supported", 5), ("C4", "S3", "partial", 6), ("C4", "S3", "supported", 7)]
    v = spark.createDataFrame(data, "claim_id string, source_id string, verdict string, seq int")
    assert rows(grounding.reduce_verdicts(v), "claim_id", "status", "contradiction") == [("C1", "refuted", True), ("C2", "unsupported", False), ("C3", "unadjudicated", False), ("C4", "ok", False)]
    assert rows(grounding.last_verdicts(v, "seq"), "claim_id", "source_id", "verdict")[-1] == ("C4", "S3", "supported")
    assert rows(grounding.worst_verdict(v), "source_id", "verdict") == [("S1", "unsupported"), ("S2", "refuted"), ("S3", "partial")]
    assert rows(grounding.contradictions(v), "claim_id", "supporting", "refuting") == [("C1", ["S1"], ["S2"])]
    assert rows(grounding.uncovered_pairs(v, v), "claim_id", "source_id") == [("C3", "S1")]


def test_numbers_and_ingest(spark):
    df = spark.range(50).withColumn("key", F.lit(100) - F.col("id")).drop("id")
    got = sources_table.number(df, "S", 10, F.asc("key"))
    assert {(r.key, r.id) for r in got.collect()} == {(51 + k, f"S{11 + k}") for k in range(50)}
    known = spark.createDataFrame([("S3", "https://a.org/x")], "id string, canonical_url string")
    new = spark.createDataFrame([(1, "https://a.org/x/", "t", "text"), (2, "https://b.org", "t", "text"), (3, "https://b.org/#f", "t", "text"), (4, "ftp://c.org", "t", "x"), (5, "https://d.org", "t", ""), (6, "https://e.org", "t", "we use cookies")], "pos long, url string, title string, text string")
    got = {r.pos: (r.id, r.refused) for r in sources_table.add_sources(known, new).collect()}
    assert got == {1: (None, "already a source"), 2: ("S4", None), 3: (None, "repeated"), 4: (None, "not citable"), 5: (None, "no text"), 6: (None, "cookie/consent wall")}


def test_batches_of_a_whole_table(spark):
    df = spark.range(1003).select((F.lit(2000) - F.col("id")).alias("id"))
    got = sources_table.batches(df, 8, F.asc("id"))
    assert rows(got, "id", "batch") == [(998 + k, k // 8) for k in range(1003)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert len({r.p for r in got.withColumn("p", F.spark_partition_id()).collect()}) > 1  # no task has all rows
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sources_table.batches(df.limit(0), 8, F.asc("id")).collect() == []


def test_hygiene_and_bibliography(spark):
    s = spark.createDataFrame([("S1", "https://a.org", "fine"), ("S2", "https://a.org", "fine"), ("S3", "https://api.crossref.org/w", "doi 10.1000/z"), ("S4", "https://w.org", "we use cookies")], "id string, canonical_url string, text string")
    assert rows(sources_table.issues(s), "id", "issue") == [("S2", "duplicate of S1"), ("S3", "not citable"), ("S4", "wall")]

    b = spark.createDataFrame([(1, "S1", 1, "Ann Lee", "Deep nets", 2020), (1, "S2", 2, "Bob Lee", "Deep things", 2020), (1, "S3", 3, None, None, None)], "run int, id string, pos int, author string, title string, year int")
    assert rows(sources_table.bibliography_keys(b, "run"), "id", "key") == [("S1", "lee2020deep"), ("S2", "lee2020deep2"), ("S3", "s3")]


def keys_one_by_one(sources):
    """The keys of a run's sources (id, author, title, year) in order."""
    used, out = set(), {}
    for id_, author, title, year in sources:
        names = (author or "").split()
        own = re.sub("[^a-z0-9]", "", names[-1].lower()) if names else id_.lower()
        words = [re.sub("[^a-z0-9]", "", w.lower()) for w in (title or "").split()]
        base = own + (str(year) if year else "") + next((w for w in words if len(w) > 3), "") or id_.lower()
        key, n = base, 2
        while key in used:
            key, n = f"{base}{n}", n + 1
        used.add(key)
        out[id_] = key
    return out


KEYS = "run int, id string, pos int, author string, title string, year int"


def test_citation_keys_that_meet(spark):
    rng = random.Random(8)
    authors = ["Ann Lee", "Lee 2", "lee2", "Lee\u00a02", "Lee 21", "Lee02", "M. M\u00fcller", "\u674e", " ", None, "S1", "x 12", "x 1", "x"]
    titles = [None, "On a", "Deep nets", "deep2 nets", "Deep\u20032 things", "deep12", "22222", "(Deep)"]
    data = [(run, f"S{k}", k, rng.choice(authors), rng.choice(titles), rng.choice([None, 0, 2, 2020])) for run in (1, 2, None) for k in range(rng.choice([90, 250]))]
    data += [(3, f"S{k}", k, None, None, None) for k in range(60)] + [(4, f"S{k}", k, "x" if k % 3 else "x 1", "none", 2) for k in range(40)] + [(5, f"S{k}", 40 - k, "x" if k % 3 else "x 1", None, None) for k in range(40)]
    got = {(r.run, r.id): r.key for r in sources_table.bibliography_keys(spark.createDataFrame(rng.sample(data, len(data)), KEYS).repartition(5), "run").collect()}
    want = {(run, id_): key for run in (1, 2, 3, 4, 5, None) for id_, key in keys_one_by_one([(r[1], *r[3:]) for r in sorted((r for r in data if r[0] == run), key=lambda r: r[2])]).items()}
    assert got == want and len({(run, key) for (run, _), key in got.items()}) == len(data)


def test_citation_keys_of_a_large_run_in_proportion(spark):
    """80,000 sources of one base and 80,000 of bases that meet: a search from the first number for each takes minutes."""
    rows = spark.range(160000).selectExpr("cast(id % 2 as int) AS run", "'S' || id AS id", "cast(id AS int) AS pos", "CASE WHEN id % 4 = 1 THEN 'Lee2' ELSE 'Lee' END AS author", "'On' AS title", "cast(null AS int) AS year")
    begun = time.time()
    got = sources_table.bibliography_keys(rows, "run").groupBy("run").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"), F.max(F.length("key")).alias("longest"))
    assert sorted(tuple(r) for r in got.collect()) == [(0, 80000, 80000, 8), (1, 80000, 80000, 9)]
    assert time.time() - begun < 90


def test_probes_hold_every_row_in_order(spark):
    data = [("hot", k) for k in range(205)] + [("cold", k) for k in range(3)] + [(None, k) for k in range(12)]
    df = spark.createDataFrame(data, "g string, id long").repartition(5)
    got = sorted((tuple(r) for r in sources_table.probes(df, "g", 10, F.asc("id")).select("g", "id", "probe", "pos").collect()), key=repr)
    assert got == sorted(((g, k, k // 10, k % 10 + 1) for g, k in data), key=repr)
    assert sources_table.probes(df.limit(0), "g", 10, F.asc("id")).collect() == []
