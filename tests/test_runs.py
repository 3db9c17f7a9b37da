import json

from pyspark.sql import functions as F

from siftline.plans import gather, modes
from siftline.sources import files, responses
from siftline.streaming import ingest


def saved(spark, payload, query="q"):
    return spark.createDataFrame([(query, payload if isinstance(payload, str) else json.dumps(payload))], "query string, payload string")


def test_json_responses(spark):
    crossref = {"message": {"items": [{"DOI": "10.1/a", "title": ["A <i>B</i> &amp; C"], "author": [{"given": "Ann", "family": "Lee"}, {"name": "Org"}], "issued": {"date-parts": [[2021, 2]]}, "container-title": ["J"]}]}}
    r = responses.read_json_responses(saved(spark, crossref), "crossref").first()
    assert (r.url, r.title, r.authors, r.year, r.venue) == ("https://doi.org/10.1/a", "A B & C", ["Ann Lee", "Org"], 2021, "J")
    inverted = {"results": [{"id": "https://openalex.org/W1", "title": "T", "abstract_inverted_index": {"world": [1], "hello": [0, 2]}}]}
    assert responses.read_json_responses(saved(spark, inverted), "openalex").first().text == "hello world hello"
    one = {"result": {"hits": {"hit": {"info": {"title": "Solo.", "ee": "https://e.org/1", "year": "1999", "authors": {"author": {"text": "Ann"}}}}}}}
    r = responses.read_json_responses(saved(spark, one), "dblp").first()
    assert (r.title, r.authors, r.year) == ("Solo", ["Ann"], 1999)
    stack = {"items": [{"link": "https://s.org/1", "title": "a", "score": 1}, {"link": "https://s.org/2", "title": "b", "score": 1, "is_answered": True}], "quota_remaining": 7}
    got = responses.read_json_responses(saved(spark, stack), "stackexchange").orderBy("pos").collect()
    assert [x.url[-1] for x in got] == ["2", "1"] and responses.quota(saved(spark, stack)).first().remaining == 7
    assert responses.read_json_responses(saved(spark, "{broken"), "github").collect() == []
    found, note = responses.read_responses(spark, saved(spark, "{}"), "nowhere")
    assert found.collect() == [] and "no such backend" in note


def test_pages_and_feeds(spark):
    page = '<a class="result__a" href="//d.com/l/?uddg=https%3A%2F%2Fx.org%2Fa">One <b>x</b></a><a class="result__snippet">snip &amp; s</a><a class="result__a" href="https://duckduckgo.com/y">own</a>'
    got = responses.read_result_pages(saved(spark, page), "duckduckgo").collect()
    assert [(r.url, r.title, r.snippet) for r in got] == [("https://x.org/a", "One x", "snip & s")]
    feed = "<feed><entry><id>http://arxiv.org/abs/2405.00001v2</id><title>T\n x</title><summary>S</summary><published>2024-05-01</published><author><name>Ann</name></author></entry></feed>"
    r = responses.read_arxiv(saved(spark, feed)).first()
    assert (r.url, r.arxiv_id, r.year, r.authors, r.title) == ("https://arxiv.org/html/2405.00001", "2405.00001", 2024, ["Ann"], "T x")


def test_joined_lookups(spark):
    search = saved(spark, {"pages": [{"key": "A", "title": "A", "excerpt": "x"}, {"key": "B", "title": "B"}]})
    summaries = spark.createDataFrame([("A", json.dumps({"type": "standard", "extract": "text a"})), ("B", json.dumps({"type": "disambiguation"}))], "key string, payload string")
    assert [(r.title, r.text) for r in responses.read_wikipedia(search, summaries).collect()] == [("A", "text a")]
    ids = saved(spark, {"esearchresult": {"idlist": ["2", "1"]}})
    detail = spark.createDataFrame([(json.dumps({"result": {"uids": ["1", "2"], "1": {"title": "one", "pubdate": "2001 Jan"}, "2": {"title": "two", "articleids": [{"idtype": "doi", "value": "10.1/x"}]}}}),)], "payload string")
    assert [(r.title, r.doi, r.year) for r in responses.read_pubmed(ids, detail).orderBy("pos").collect()] == [("two", "10.1/x", None), ("one", None, 2001)]


def test_supplied_hits(spark):
    for payload in ([{"link": "https://a.org", "name": "A"}, "https://b.org", {"title": "none"}, {"url": "https://a.org"}], {"webResults": [{"href": "https://a.org", "heading": "A"}, {"uri": "https://b.org"}]}, "https://a.org\nnoise\nhttps://b.org"):
        got = responses.read_hits(saved(spark, payload)).orderBy("pos").collect()
        assert [r.url for r in got] == ["https://a.org", "https://b.org"]


def test_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<head><title>T</title></head><p>hello</p>")
    (tmp_path / "b.md").write_text("# Head\n\nbody")
    (tmp_path / "c.bin").write_bytes(b"\x00\x01")
    (tmp_path / "d.pdf").write_bytes(b"%PDF-1.4\nstream\nBT (Hello) Tj T* (wor\\(l\\)d) Tj ET\nendstream\n")
    got = {r.url.rsplit("/", 1)[-1]: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert (got["a.html"].title, got["a.html"].text) == ("T", "hello")
    assert got["b.md"].title == "Head" and got["c.bin"].refused == "unsupported format" and got["d.pdf"].text == "Hello\nwor(l)d"


def test_runs_on_disk(spark, tmp_path):
    s = spark.createDataFrame([("S1", "t", "https://a.org", "line one\nline two")], "id string, title string, url string, text string")
    assert set(files.write_run(s, {"question": "q"})) == {"sources", "extracts", "manifest"}
    files.write_run(s, {"question": "q"}, str(tmp_path / "run"))
    back = files.read_run(spark, str(tmp_path / "run"))
    assert back.first().text == "line one\nline two"
    assert [(r.n, r.line) for r in files.read_lines(back, 2, 5).collect()] == [(2, "line two")]
    pages = spark.createDataFrame([(1, 404, "", "old a"), (2, 500, "", "old b"), (3, 403, "", "old c"), (4, 200, "x", "old d")], "pos int, status int, text string, archived string")
    assert [(r.pos, r.text) for r in files.cap_rescues(pages, 1).orderBy("pos").collect()] == [(1, "old a"), (2, ""), (3, ""), (4, "x")]


def test_planning(spark):
    assert modes.modes(spark).count() == 5
    assert modes.resolve_backends("research", "deep")[-1] == "wikipedia"
    assert modes.resolve_backends("topic", "standard", engine="mojeek") == ["mojeek", "wikipedia", "standards"]
    assert modes.resolve_backends("topic", "standard", engine="none") == ["wikipedia", "standards"]
    plan = modes.plan(spark, "How does a token bucket work?", "topic").collect()
    assert [r.id for r in plan] == [f"Q{k}" for k in range(1, 7)] and all(r.queries for r in plan)
    assert [r.question for r in modes.plan(spark, "q", "bug", ["A", "a", "B"]).collect()] == ["A", "B"]
    assert modes.ambiguity("python", 1) and not modes.ambiguity("How does the token bucket algorithm limit request rates?", 1)


def candidates(spark):
    base = "The token bucket limits the rate of requests that a client may send to a server. "
    data = [
        (1, 1, "https://a.org/x?utm_source=1", "Token bucket", "s", base * 12, "web", None, None, 2020),
        (1, 2, "https://b.org/y", "Token bucket mirrored", "s", base * 12, "web", None, None, 2021),
        (1, 3, "https://c.org/z", "Salmon", "s", "A recipe for salmon soup with dill and cream. " * 12, "web", None, None, None),
        (2, 1, "https://a.org/x", "Token bucket", "s", "", "wikipedia", None, None, 2020),
        (2, 2, "https://bad.example/q", "Token bucket", "s", base, "web", None, None, None),
        (2, 3, "https://d.org/p", "Leaky bucket", "a short note on the leaky bucket", None, "web", None, None, 2010),
    ]
    return spark.createDataFrame(data, "list_no int, pos int, url string, title string, snippet string, text string, backend string, doi string, arxiv_id string, year int")


def test_gather(spark):
    options = gather.Options(depth="summary", exclude=("bad.example",))
    got = gather.gather(candidates(spark), "How does the token bucket limit request rates?", options=options).orderBy("final").collect()
    assert [r.id for r in got] == [f"S{k}" for k in range(1, len(got) + 1)]
    assert got[0].domain == "a.org" and got[0].found_by == 2
    assert {r.domain for r in got} == {"a.org", "d.org"}  # the mirror is gone, and the floor was met without the page on salmon
    docs = spark.createDataFrame([("https://d.org/p", "Leaky bucket", "The leaky bucket is like the token bucket.", None)], "url string, title string, text string, junk string")
    found = gather.gather(candidates(spark), "How does the token bucket limit request rates?", docs, options)
    assert found.filter("domain = 'd.org'").first().text_via == "page"


def test_search_merge_brainstorm(spark):
    docs = spark.createDataFrame([("u1", "Token bucket", "rate limits"), ("u2", "Soup", "salmon"), ("u3", None, "a bucket")], "url string, title string, text string")
    assert [r.url for r in gather.search(docs, "token bucket").collect()] == ["u1", "u3"]
    runs = spark.createDataFrame([("r1", "a", 1, "https://x.org/1", "t", ""), ("r2", "b", 1, "https://x.org/1/", "t", "text"), ("r2", "b", 2, "https://y.org", "t", "other")], "run_dir string, sub_question string, pos int, url string, title string, text string")
    got = gather.merge(runs).orderBy("id").collect()
    assert [(r.id, r.text, [tuple(p) for p in r.provenance]) for r in got] == [("S1", "text", [("r1", "a"), ("r2", "b")]), ("S2", "other", [("r2", "b")])]
    ideas = gather.brainstorm(candidates(spark).filter("list_no = 1")).collect()
    assert [len(r.titles) for r in ideas] == [2, 1]


def test_ingest_stream(spark, tmp_path):
    schema = "pos long, url string, title string, text string"
    pages = tmp_path / "pages"
    spark.createDataFrame([(1, "https://a.org", "t", "x"), (2, "https://a.org/", "t", "x"), (3, "https://b.org", "t", "x")], schema).coalesce(1).write.parquet(str(pages))
    stream = lambda: spark.readStream.schema(schema).parquet(str(pages))
    ingest.ingest(stream(), str(tmp_path / "table"), str(tmp_path / "state")).awaitTermination()
    spark.createDataFrame([(4, "https://b.org/#x", "t", "x"), (5, "https://c.org", "t", "x")], schema).coalesce(1).write.mode("append").parquet(str(pages))
    ingest.ingest(stream(), str(tmp_path / "table"), str(tmp_path / "state")).awaitTermination()
    got = ingest.read_sources(spark, str(tmp_path / "table")).orderBy("id").collect()
    assert [(r.id, r.canonical_url) for r in got] == [("S1", "https://a.org"), ("S2", "https://b.org"), ("S3", "https://c.org")]


def test_cache_and_windows(spark, tmp_path):
    cache = spark.createDataFrame([("k", "old", 10), ("k", "new", 90), ("j", "stale", 1), ("e", "", 99)], "key string, text string, at int").withColumn("cached_at", F.timestamp_seconds(F.col("at") * 3600))
    now = F.timestamp_seconds(F.lit(100 * 3600))
    got = ingest.cache_lookup(spark.createDataFrame([("k",), ("j",), ("e",)], "key string"), cache, now)
    assert {(r.key, r.text, r.hit) for r in got.collect()} == {("k", "new", True), ("j", None, False), ("e", None, False)}
    events = spark.createDataFrame([(1, 0, "view", 1.0), (1, 600, "view", 2.0), (1, 9000, "click", 3.0)], "user_id long, s long, event_type string, value double").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    for name, df, want in (("counts", ingest.event_counts(stream), {(2, 3.0), (1, 3.0)}), ("spans", ingest.sessions(stream), {(2,), (1,)})):
        q = df.writeStream.outputMode("complete" if name == "counts" else "append").format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination()
        found = {tuple(r) for r in spark.table(name).select(*(["n", "total"] if name == "counts" else ["n"])).collect()}
        assert found == want or name == "spans" and found <= want
    pages = spark.createDataFrame([("https://a.org", 0), ("https://a.org/", 60)], "url string, s long").withColumn("at", F.timestamp_seconds("s")).drop("s")
    pages.write.parquet(str(tmp_path / "pages"))
    q = ingest.distinct_pages(spark.readStream.schema(pages.schema).parquet(str(tmp_path / "pages")), "at").writeStream.format("memory").queryName("pages_once").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("pages_once").count() == 1
