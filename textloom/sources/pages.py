"""Raw page files, one JSON document each, and pages out of fetched HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.html import extracted
from textloom.functions.text import url_key
from textloom.schemas import PAGE


def read_raw_pages(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """All page files of a folder with their file name; the first ``limit`` by name if given."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        raise FileNotFoundError(folder)
    rows = spark.read.schema(PAGE).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder).select("*", F.col("_metadata.file_name").alias("file_name"))
    return rows.orderBy("file_name").limit(limit) if limit else rows


def pages_of_html(landing: DataFrame, kind: str, site_prefix: str) -> DataFrame:
    """Page rows with their key from landing rows (url, html); ``ok`` tells whether content was found."""
    prefix = "" if kind in ("docs", "release-notes") else f"{kind}_"
    rows = landing.select("url", extracted(F.col("html"), kind).alias("page"))
    source = F.lit(None).cast("string") if prefix == "" else F.lit(kind)
    return rows.select("url", "page.title", "page.breadcrumbs", "page.headings", "page.text", source.alias("source"), url_key(F.col("url"), F.lit(site_prefix), F.lit(prefix)).alias("key"), F.col("page").isNotNull().alias("ok"))
