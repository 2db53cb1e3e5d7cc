"""Repository listings and markdown files from landing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import is_doc_path, markdown_headings, markdown_title, strip

TREE = "struct<tree: array<struct<path: string, type: string>>>"


def doc_files(listings: DataFrame, site: str, raw_site: str, limit: int | None = None) -> DataFrame:
    """(repo, path, url, raw_url) of the documents in listings (repo, branch, status, body).

    Branch main, on 404 master; any other status leaves the repository out. Addresses
    always name main.
    """
    main = listings.filter((F.col("branch") == "main") & (F.col("status") != 404))
    absent = listings.filter("branch = 'main'").filter("status = 404").select("repo")
    master = listings.filter("branch = 'master'").join(absent, "repo", "left_semi")
    good = main.unionByName(master).filter("status = 200")
    files = good.select("repo", F.posexplode(F.from_json("body", TREE)["tree"]).alias("pos", "f")).select("repo", "pos", F.col("f.path").alias("path")).filter(is_doc_path(F.col("path")))
    files = files.orderBy("repo", "pos").limit(limit) if limit else files
    return files.select("repo", "path", F.concat(F.lit(site + "/"), "repo", F.lit("/blob/main/"), "path").alias("url"), F.concat(F.lit(raw_site + "/"), "repo", F.lit("/main/"), "path").alias("raw_url"))


def markdown_bodies(files: DataFrame, fetched: DataFrame) -> DataFrame:
    """Files with their text from (raw_url, status, body): main, else master; NULL text if neither came."""
    good = fetched.filter("status = 200").select(F.col("raw_url").alias("at"), F.col("body"))
    alternative = F.replace(F.col("raw_url"), F.lit("/main/"), F.lit("/master/"))
    first = files.join(good.withColumnsRenamed({"at": "raw_url", "body": "main_body"}), "raw_url", "left").withColumn("other", alternative)
    both = first.join(good.withColumnsRenamed({"at": "other", "body": "other_body"}), "other", "left")
    return both.select("repo", "path", "url", "raw_url", F.coalesce("main_body", "other_body").alias("text"))


def markdown_pages(bodies: DataFrame, least: int = 50) -> DataFrame:
    """Page rows of markdown texts of at least ``least`` characters; the text itself stays as it is."""
    rows = bodies.filter(F.length(strip(F.col("text"))) >= least)
    return rows.select(
        "url",
        markdown_title(F.col("text"), F.col("repo"), F.col("path")).alias("title"),
        F.array("repo", "path").alias("breadcrumbs"),
        markdown_headings(F.col("text")).alias("headings"),
        "text",
        F.lit("github").alias("source"),
    )
