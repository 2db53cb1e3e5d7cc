"""From lists of addresses to stored pages: selection against the store, statistics, unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.store import last_rows


def distinct_entries(urls: DataFrame) -> DataFrame:
    """(url, lastmod): one row for each address, with its greatest non-empty date."""
    return urls.filter((F.col("url") != "") & F.col("url").isNotNull()).groupBy("url").agg(F.max(F.nullif(F.trim("lastmod"), F.lit(""))).alias("lastmod"))


def in_order(rows: DataFrame, limit: int | None, *order: Column) -> DataFrame:
    """The first ``limit`` rows by ``order``; 0 and None mean all."""
    return rows.orderBy(*order).limit(limit) if limit else rows


def to_crawl(urls: DataFrame, stored: DataFrame, key: str, limit: int | None, order: Column, limit_first: bool = False, force: bool = False) -> DataFrame:
    """Addresses not stored yet. With ``limit_first`` the limit is taken of the source list, so
    repeated runs over an unchanged list select nothing new; else it is taken of what is left."""
    rows = in_order(urls, limit, order) if limit_first else urls
    left = rows if force else rows.join(stored.select(key).distinct(), key, "left_anti")
    return left if limit_first else in_order(left, limit, order)


def crawl_stats(listed: DataFrame, selected: DataFrame, outcome: DataFrame, group: str) -> DataFrame:
    """(group, success, failed, skipped). outcome: (group, ok); rows cut by a limit count as skipped."""
    total = listed.groupBy(group).agg(F.count("*").alias("total"))
    chosen = selected.groupBy(group).agg(F.count("*").alias("chosen"))
    done = outcome.groupBy(group).agg(F.count_if("ok").alias("success"), F.count_if(~F.coalesce(F.col("ok"), F.lit(False))).alias("failed"))
    rows = total.join(chosen, group, "left").join(done, group, "left").na.fill(0, ["chosen", "success", "failed"])
    return rows.select(group, "success", "failed", (F.col("total") - F.col("chosen")).alias("skipped"))


def found_counts(listed: DataFrame, group: str = "source") -> DataFrame:
    """(group, found): how many different addresses each group offers; partial counts come before the shuffle."""
    return listed.filter((F.col("url") != "") & F.col("url").isNotNull()).groupBy(group, "url").agg(F.lit(1).alias("one")).groupBy(group).agg(F.count("*").alias("found"))


def stats_by_source(stats: DataFrame, group: str = "source") -> DataFrame:
    """One row with a map from source to its counters."""
    entry = F.struct(F.col(group), F.struct("success", "failed", "skipped"))
    return stats.agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("stats"))


def with_source(pages: DataFrame, default: str = "docs") -> DataFrame:
    return pages.withColumn("source", F.coalesce("source", F.lit(default)))


def union_pages(*parts: DataFrame) -> DataFrame:
    """All sources in one relation; columns a source lacks are NULL."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def keep_last(pages: DataFrame, key: str, *order: Column) -> DataFrame:
    """Last writer wins by key."""
    return last_rows(pages, key, *order)


def long_enough(pages: DataFrame, text: Column, least: Column) -> DataFrame:
    return pages.filter(F.length(text) >= least)


def chosen_sources(pages: DataFrame, wanted: list[str], valid: tuple[str, ...]) -> DataFrame:
    """Pages of the wanted sources that are valid; no valid source at all is an error."""
    use = [s for s in wanted if s in valid]
    if not use:
        raise ValueError("no valid source")
    return with_source(pages).filter(F.col("source").isin(use))


def first_by_key(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key by ``order``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")
