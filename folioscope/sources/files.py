"""Scans of uploaded files and landed web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded .txt and .md files as documents; .pdf names are passed on for their page text
    and anything else is reported as unsupported. Bytes that are no text become U+FFFD."""
    name = F.regexp_extract("path", "([^/]+)$", 1)
    end = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    kind = F.when(end.isin("txt", "md"), "text").when(end == "pdf", "pdf").otherwise("unsupported")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(
        "path", F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("source_uri"), kind.alias("status"),
        F.when(kind == "text", F.make_valid_utf8(F.col("content").cast("string"))).alias("text")).withColumns({
            "title": F.regexp_replace("source_uri", r"(.)\.[^.]+$", "$1"), "doc_type": F.lit("text")})


def ingest_split(files: DataFrame, held: DataFrame) -> DataFrame:
    """Each uploaded file as added, refused (no text, or held already) or unsupported."""
    from ..operators.libraries import add_status
    blank = F.coalesce(F.trim("text"), F.lit("")) == ""
    good = files.filter("status = 'text'").filter(~blank).withColumn("sha256", F.sha2("text", 256))
    good = add_status(good.drop("status"), held)
    good = good.withColumn("status", F.when(F.col("status") == "added", "added").otherwise("refused")).drop("sha256")
    rest = files.filter(F.col("status") == "unsupported").unionByName(
        files.filter((F.col("status") == "text") & blank).withColumn("status", F.lit("refused")))
    return good.unionByName(rest.select(good.columns))


def landed_pages(pages: DataFrame) -> DataFrame:
    """Fetched pages as `url`, `headers` (lower-case name to text) and `body`."""
    return pages.select("page_id", "url", F.create_map(F.lit("content-type"), F.lit("text/html")).alias("headers"),
                        F.col("html").alias("body"))
