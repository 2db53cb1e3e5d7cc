"""Sitemaps from a landing table (url, content): flat, index of sitemaps, nested with compressed files."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_ENTRIES = "array<struct<loc: string, lastmod: string>>"


@F.pandas_udf(StringType())
def _inflated(content: pd.Series, url: pd.Series) -> pd.Series:
    def one(raw, name):
        if raw is None:
            return None
        if name and name.endswith(".gz"):
            try:
                raw = gzip.decompress(raw)
            except (OSError, EOFError):
                pass
        return bytes(raw).decode("utf-8", "replace")

    return pd.Series([one(c, u) for c, u in zip(content, url)], dtype=object)


def xml_text(content: Column, url: Column) -> Column:
    """Text of a fetched sitemap; compressed where the address ends with .gz, raw if that fails."""
    return F.when(url.endswith(".gz"), _inflated(content, url)).otherwise(F.decode(content, "UTF-8"))


def entries(xml: Column, element: str) -> Column:
    """(loc, lastmod) of every ``element``, whatever its name space prefix; a missing date is NULL."""
    tag = lambda name: rf"<(?:[\w.-]+:)?{name}(?:\s[^>]*)?>"
    end = lambda name: rf"</(?:[\w.-]+:)?{name}\s*>"
    blocks = F.regexp_extract_all(xml, F.lit(rf"(?s){tag(element)}(.*?){end(element)}"), 1)

    def plain(value: Column) -> Column:
        for mark, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
            value = F.replace(value, F.lit(mark), F.lit(char))
        return F.trim(F.regexp_replace(value, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1"))

    def field(block: Column, name: str) -> Column:
        return F.nullif(plain(F.regexp_extract(block, rf"(?s){tag(name)}(.*?){end(name)}", 1)), F.lit(""))

    return F.transform(blocks, lambda b: F.struct(field(b, "loc").alias("loc"), field(b, "lastmod").alias("lastmod"))).cast(_ENTRIES)


def _exploded(pages: DataFrame, element: str) -> DataFrame:
    rows = pages.select(F.col("url").alias("sitemap"), F.posexplode(entries(xml_text(F.col("content"), F.col("url")), element)).alias("pos", "e"))
    return rows.select("sitemap", "pos", F.col("e.loc").alias("url"), "e.lastmod").filter(F.col("url") != "")


def flat(pages: DataFrame, sitemap: str, prefix: str | None = None) -> DataFrame:
    """(url, lastmod) of one sitemap, those with ``prefix`` only if given."""
    rows = _exploded(pages.filter(F.col("url") == sitemap), "url")
    return (rows.filter(F.col("url").startswith(prefix)) if prefix else rows).select("url", "lastmod")


def of_index(pages: DataFrame, index: str, part: str = "post-sitemap", limit: int | None = None) -> DataFrame:
    """(url, lastmod) of the sitemaps an index names whose address contains ``part``, in order."""
    named = _exploded(pages.filter(F.col("url") == index), "sitemap").filter(F.contains("url", F.lit(part))).select(F.col("url").alias("sitemap"), F.col("pos").alias("nth"))
    rows = _exploded(pages.join(named.select(F.col("sitemap").alias("url")), "url", "left_semi"), "url").join(named, "sitemap").orderBy("nth", "pos")
    return (rows.limit(limit) if limit else rows).select("url", "lastmod")


def nested(pages: DataFrame, root: str, levels: int = 3, contains: str = "/t5/", limit: int | None = None) -> DataFrame:
    """(url, lastmod) of all sitemaps reached from ``root`` in at most ``levels`` levels, each visited once."""
    spark = pages.sparkSession
    frontier = spark.createDataFrame([(root,)], "url string")
    visited, found = None, None
    for level in range(levels):
        if visited is not None:
            frontier = frontier.join(visited, "url", "left_anti")
        visited = frontier if visited is None else visited.unionByName(frontier)
        here = pages.join(frontier, "url", "left_semi")
        rows = _exploded(here, "url").withColumn("level", F.lit(level))
        found = rows if found is None else found.unionByName(rows)
        frontier = _exploded(here, "sitemap").select("url").distinct()
    kept = found.filter(F.contains("url", F.lit(contains)))
    return (kept.orderBy("level", "sitemap", "pos").limit(limit) if limit else kept).select("url", "lastmod")
