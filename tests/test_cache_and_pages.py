import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from siftline.sources import responses
from siftline.streaming import ingest

NOW = datetime(2024, 5, 1, 12)


def pages(spark, rows):
    data = [(u, t, NOW - timedelta(hours=h)) for u, t, h in rows]
    table = spark.createDataFrame(data, "url string, text string, cached_at timestamp")
    return table.select(ingest.cache_key(F.col("url")).alias("key"), "url", F.lit("t").alias("title"), "text", "cached_at")


def test_cache_is_written_by_a_stream_and_expires(spark, tmp_path):
    source, path, check = str(tmp_path / "in"), f"file://{tmp_path}/cache", str(tmp_path / "check")
    now = F.lit(NOW)

    def deliver(rows):
        pages(spark, rows).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("key string, url string, title string, text string, cached_at timestamp").parquet(source)
        query = ingest.write_cache(stream, path, check)
        query.awaitTermination(120)
        assert query.exception() is None

    def hits(*urls):
        asked = spark.createDataFrame([(u,) for u in urls], "url string").withColumn("key", ingest.cache_key(F.col("url")))
        return {r.url: r.text for r in ingest.cache_lookup(asked, ingest.read_cache(spark, path), now).collect()}

    assert ingest.read_cache(spark, path).collect() == [] and hits("https://a.org") == {"https://a.org": None}
    deliver([("https://a.org/", "first", 30), ("https://b.org", "old b", 25), ("https://c.org", None, 1), ("https://d.org", "  ", 1)])
    assert hits("https://a.org", "https://c.org", "https://d.org") == {"https://a.org": None, "https://c.org": None, "https://d.org": None}
    deliver([("https://a.org/?utm_source=x", "second", 24), ("https://a.org", "", 0), ("https://e.org", "older", 9), ("https://e.org", "newer", 8)])
    assert hits("https://a.org", "https://e.org", "https://b.org") == {"https://a.org": "second", "https://e.org": "newer", "https://b.org": None}
    assert ingest.expire_cache(spark, path, now) == [0] and ingest.read_cache(spark, path).count() == 2
    deliver([("https://e.org", "late news of long ago", 20)])
    assert hits("https://e.org") == {"https://e.org": "newer"}
    # a batch that runs again overwrites its own part
    held = ingest.read_cache(spark, path).filter("batch = 1").drop("batch")
    spark.createDataFrame(held.collect(), held.schema).write.mode("overwrite").parquet(f"{path}/batch=1")
    assert hits("https://a.org") == {"https://a.org": "second"}


def test_keys_name_language_and_reader(spark):
    urls = ["https://A.org/x/", "https://a.org/x", "https://a.org/x.pdf", "https://a.org/x.docx"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select(ingest.cache_key(F.col("url")).alias("k"), ingest.cache_key(F.col("url"), "de").alias("de"), ingest.cache_key(F.col("url"), "", "firecrawl").alias("f")).collect()
    assert rows[0].k == rows[1].k and rows[0].k != rows[0].de != rows[0].f and len({r.k for r in rows}) == 3
    assert rows[2].k == rows[2].f and rows[3].k == rows[3].f  # a PDF is read one way only


def page(urls, engines=()):
    return json.dumps({"results": [{"url": u, "title": "", "content": "s"} if u else {"title": "no url"} for u in urls], "unresponsive_engines": list(engines)})


def brute_pages(saved, pages, per_page):
    """Reads page after page, as one would ask for them."""
    found, suspended = [], {}
    for p in range(pages):
        try:
            data = json.loads(saved.get(p) or "")
        except json.JSONDecodeError:
            break
        for x in data.get("unresponsive_engines") or []:
            name, why = (x[0], x[1] if len(x) > 1 else "") if isinstance(x, list) else (x, "")
            if name:
                suspended[name] = (why or "").strip()
        new = [x["url"] for x in (data.get("results") or [])[:per_page] if x.get("url")]
        fresh = []
        for u in new:
            key = u.rstrip("/").lower()
            if key not in {f.rstrip("/").lower() for f in found + fresh}:
                fresh.append(u)
        if not fresh:
            break
        found += fresh
    return found, suspended


def test_paging_stops_where_nothing_is_new(spark):
    a = [f"https://x.org/{k}" for k in range(9)]
    saved = {
        "all": {0: page(a[:3]), 1: page(a[2:5]), 2: page(a[5:])},
        "repeats": {0: page(a[:3], [["brave", "timeout"]]), 1: page(a[:2], [["brave", " Suspended "], "qwant"]), 2: page(a[5:], [["late", "x"]])},
        "gap": {0: page(a[:2]), 2: page(a[5:])},
        "broken": {0: page(a[:2]), 1: "not json", 2: page(a[5:])},
        "empty first": {0: page([]), 1: page(a)},
        "null": {0: None},
        "inner": {0: page([a[0], a[0] + "/", None, a[1]]), 1: page([a[1], None])},
        "long": {0: page(a), 1: page(a[4:])},
        "no engines": {0: json.dumps({"results": [{"url": a[0]}], "unresponsive_engines": None})},
        "fourth": {k: page(a[2 * k : 2 * k + 2], [[f"e{k}", None]]) for k in range(4)},
    }
    table = spark.createDataFrame([(q, p, body) for q, own in saved.items() for p, body in own.items()], "query string, page int, payload string").repartition(3)
    candidates, suspended = responses.read_searxng_pages(table, pages=3, per_page=4)
    rows = candidates.orderBy("query", "pos").collect()
    for q, own in saved.items():
        found, out = brute_pages(own, 3, 4)
        assert [r.url for r in rows if r.query == q] == found, q
        assert {r.engine: r.reason for r in suspended.filter(F.col("query") == q).collect()} == out, q
    assert all(r.title == r.url for r in rows)
