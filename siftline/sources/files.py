"""Local files and runs on disk as tables, and runs written back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.html import extraction_fault, html_title, html_to_text, main_html
from siftline.functions.text import title_from_text

from .office import office_text
from .pdf import pdf_text

TEXT, HTML, PDF = ("txt", "md", "markdown", "text", "csv"), ("html", "htm", "xhtml"), ("pdf",)
OFFICE = ("docx", "xlsx", "pptx", "odt", "ods", "odp", "epub", "rtf", "docm", "xlsm", "pptm")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """url, title, text, refused of every file below a path, by its extension. Files are read where the tasks are."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    decoded = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    files = files.select("path", extension.alias("extension"), decoded.alias("decoded"), F.when(extension.isin(*PDF), F.col("content")).alias("pdf"), F.when(extension.isin(*OFFICE), F.col("content")).alias("office"))
    files = files.withColumns({"shown": pdf_text("pdf"), "written": office_text("office"), "main": main_html(F.when(F.col("extension").isin(*HTML), F.col("decoded")))})
    text = F.when(F.col("extension").isin(*HTML), html_to_text(F.col("main"))).when(F.col("extension").isin(*PDF), F.col("shown")).when(F.col("extension").isin(*OFFICE), F.col("written")).when(F.col("extension").isin(*TEXT), F.col("decoded"))
    rows = files.withColumn("text", text)
    refused = F.when(~F.col("extension").isin(*TEXT, *HTML, *PDF, *OFFICE), "unsupported format").otherwise(extraction_fault(F.col("text")))
    title = F.coalesce(F.when(F.col("extension").isin(*HTML), html_title(F.col("decoded"))), title_from_text(F.coalesce("text", F.lit(""))))
    return rows.select(F.col("path").alias("url"), title.alias("title"), "text", refused.alias("refused"))


def cap_rescues(pages: DataFrame, most: int = 5) -> DataFrame:
    """Failed pages (pos, status, text, archived) get their archived text where the status allows it, the first ``most`` by ``pos``."""
    can = F.col("status").isin(403, 404, 410, 451) & (F.coalesce(F.col("text"), F.lit("")) == "")
    chosen = pages.filter(can).orderBy("pos").limit(most).select("pos", F.lit(True).alias("rescued"))
    out = pages.join(F.broadcast(chosen), "pos", "left")  # at most ``most`` rows
    return out.withColumn("text", F.when(F.col("rescued"), F.col("archived")).otherwise(F.col("text"))).withColumn("rescued", F.coalesce("rescued", F.lit(False)))


def extract_page(source_id: Column, title: Column, url: Column, text: Column) -> Column:
    """A source's extract: three header lines and its text."""
    return F.concat_ws("\n", F.concat(F.lit("# "), source_id, F.lit(" — "), title), F.concat(F.lit("URL: "), url), F.lit(""), text)


def strip_header(extract: Column) -> Column:
    return F.regexp_replace(extract, r"\A# S[0-9]+ — [^\n]*\nURL: [^\n]*\n\n", "")


def write_run(sources: DataFrame, manifest: dict, path: str | None = None) -> dict[str, DataFrame]:
    """The tables of a run: sources and manifest. Without a path nothing is written and the tables are returned."""
    spark = sources.sparkSession
    tables = {
        "sources": sources.drop("text"),
        "extracts": sources.select("id", extract_page(F.col("id"), F.col("title"), F.col("url"), F.col("text")).alias("extract")),
        "manifest": spark.createDataFrame([(k, str(v)) for k, v in manifest.items()], "name string, value string"),
    }
    if path is not None:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")
    return tables


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """Sources with their texts."""
    sources, extracts = spark.read.parquet(f"{path}/sources"), spark.read.parquet(f"{path}/extracts")
    return sources.join(extracts.select("id", strip_header(F.col("extract")).alias("text")), "id", "left")


def read_lines(extracts: DataFrame, first: int, last: int) -> DataFrame:
    """id, line number (from 1) and line of a range of lines of each text."""
    lines = extracts.select("id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    return lines.select("id", (F.col("n") + 1).alias("n"), "line").filter(F.col("n").between(first, last))
