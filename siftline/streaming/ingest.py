"""Streams of pages and events: ingest without repeats, a cache with a time to live, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftline.functions.url import canonical_url, doc_format, looks_like_pdf
from siftline.operators.sources_table import add_sources


def distinct_pages(pages: DataFrame, event_time: str, delay: str = "24 hours") -> DataFrame:
    """Each canonical URL once within ``delay``; the watermark bounds the state."""
    rows = pages.withColumn("canonical_url", canonical_url(F.col("url"))).withWatermark(event_time, delay)
    return rows.dropDuplicatesWithinWatermark(["canonical_url"])


def ingest(pages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Adds new pages (pos, url, title, text) to the table of sources at ``path``, a folder of one part per batch.

    A batch that runs again after a failure overwrites its own part, so every page is added once and
    ids go on from the greatest of the earlier parts.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = read_sources(spark, path).filter(F.col("batch") < number).select("id", "canonical_url")
        rows = add_sources(known, batch.select("pos", "url", "title", "text")).filter("refused is null").drop("refused")
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return pages.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


SOURCES = "canonical_url string, pos long, url string, title string, text string, id string, batch long"


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """All parts; none yet is an empty table."""
    return _read_parts(spark, path, SOURCES)


def _read_parts(spark: SparkSession, path: str, kind: str) -> DataFrame:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(target) or not any(p.isDirectory() for p in system.listStatus(target)):
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).parquet(path)


# --- a cache of pages with a time to live -----------------------------------------------------------

CACHE = "key string, url string, title string, text string, cached_at timestamp, batch long"


def cache_key(url: Column, accept_language: Column | str = "", extractor: Column | str = "native") -> Column:
    """What an entry is filed under: the canonical URL, the language asked for, and how the page is read; PDF and office files have names of their own."""
    language, reader = (F.lit(x) if isinstance(x, str) else F.coalesce(x, F.lit("")) for x in (accept_language, extractor))
    reader = F.when(looks_like_pdf(url), "pdf").when(doc_format(url).isNotNull(), "doc").otherwise(reader)
    return F.concat_ws("\u0001", canonical_url(url), language, reader)


def write_cache(pages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Files the pages (key, url, title, text, cached_at) that were read with success below ``path``, a folder of one part per batch.

    A part has the newest entry of each key of its batch; entries of later times win when they are looked up, whatever the batch. A
    batch that runs again overwrites its own part. Failures (null or blank texts) leave what was cached before.
    """

    def add(batch: DataFrame, number: int) -> None:
        good = batch.filter((F.trim(F.coalesce("text", F.lit(""))) != "") & F.col("key").isNotNull() & F.col("cached_at").isNotNull())
        newest = good.groupBy("key").agg(F.max_by(F.struct("url", "title", "text"), F.struct("cached_at", "text")).alias("e"), F.max("cached_at").alias("cached_at"))
        newest.select("key", "e.*", "cached_at").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return pages.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The entries of all parts; none yet is an empty table."""
    return _read_parts(spark, path, CACHE)


def expire_cache(spark: SparkSession, path: str, now: Column, hours: float = 24.0) -> list[int]:
    """Takes away the parts that have no live entry any more, and gives their numbers; one row for each part comes to the driver."""
    ages = read_cache(spark, path).groupBy("batch").agg(F.max("cached_at").alias("newest"))
    gone = [r.batch for r in ages.filter(~_fresh("newest", now, hours)).select("batch").collect()]
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for number in gone:
        part = folder(f"{path}/batch={number}")
        part.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(part, True)
    return sorted(gone)


def _fresh(cached_at: str, now: Column, hours: float) -> Column:
    """At most ``hours`` old, to the second."""
    return F.col(cached_at) >= now - F.make_dt_interval(hours=F.lit(0), secs=F.lit(hours * 3600))


def cache_lookup(requests: DataFrame, cache: DataFrame, now: Column, hours: float = 24.0) -> DataFrame:
    """Requests (key) with the text of the newest cache entry (key, text, cached_at) that is not too old; blank texts are none.

    Entries are reduced to one a key before they meet the requests, so a page asked for very often is joined with one row.
    """
    fresh = cache.filter(_fresh("cached_at", now, hours) & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    newest = fresh.groupBy("key").agg(F.max_by("text", F.struct("cached_at", "text")).alias("text"))
    return requests.join(newest, "key", "left").withColumn("hit", F.col("text").isNotNull())


def event_counts(events: DataFrame, window: str = "1 hour", delay: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts and sums by window and type; late events within ``delay`` still count."""
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    return events.withWatermark("ts", delay).groupBy(span, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sessions of each user, parted by pauses of ``gap``."""
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
