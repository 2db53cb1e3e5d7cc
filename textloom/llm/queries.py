"""The pN_ queries over the project's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import p01_token_budget as p1
from textloom.llm import p02_near_duplicates as p2
from textloom.llm import p03_quality as p3
from textloom.llm import p04_residue as p4
from textloom.llm import p05_splitting as p5
from textloom.llm import p06_main_content as p6
from textloom.llm import p07_repeated_lines as p7
from textloom.llm import p08_packing as p8
from textloom.llm import p09_contamination as p9
from textloom.llm import p10_subjects as p10
from textloom.tables import table


def _posts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_page").filter(F.col("source").isin("blog", "community"))


def p1_chunk_tokens(spark: SparkSession, d: str) -> DataFrame:
    return p1.chunk_tokens(table(spark, d, "chunk"))


def p1_token_totals(spark: SparkSession, d: str) -> DataFrame:
    return p1.totals(table(spark, d, "chunk"))


def _docs_and_github(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_page").filter(F.col("source").isNull() | (F.col("source") == "github"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2.similar_pairs(_docs_and_github(spark, d))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return p2.groups(_docs_and_github(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3.non_prose(_crawled(spark, d), F.col("source").isin("blog", "community"))


def p3_statistics(spark: SparkSession, d: str) -> DataFrame:
    return p3.quality(_crawled(spark, d), F.col("source").isin("blog", "community"))


def _docs_and_community(spark: SparkSession, d: str) -> tuple[DataFrame, Column]:
    """Docs pages by their text and community pages by their title."""
    text, title = F.array(F.lit("text")), F.array(F.lit("title"))
    fields = F.when(F.col("source").isNull(), text).when(F.col("source") == "community", title).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "raw_page"), fields


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4.residue_of(*_docs_and_community(spark, d))


def p4_clean(spark: SparkSession, d: str) -> DataFrame:
    return p4.without_residue(*_docs_and_community(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5.oversized_pieces(table(spark, d, "chunk")).filter("piece = 1").select("id")


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return p5.renumbered(table(spark, d, "chunk"))


def _crawled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_page").filter(F.col("source").isNull() | F.col("source").isin("blog", "community"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6.boilerplate_lines(_crawled(spark, d))


def p6_bodies(spark: SparkSession, d: str) -> DataFrame:
    return p6.main_bodies(_crawled(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7.repeated_lines(_posts(spark, d))


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    return p7.without_repeated_lines(_posts(spark, d))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return p8.packed(table(spark, d, "documents"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return p8.containers(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9.contaminated(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    return p9.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_item"))


def _subject_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "documents"), table(spark, d, "subject_label"), table(spark, d, "subject")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10.document_subjects(*_subject_tables(spark, d)).select("doc_id", "subject").distinct()


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    return p10.composition(*_subject_tables(spark, d))


# -- what SQL can say of results that it can't compute


def p1_chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many chunks each total of problem 1 is of."""
    return p1.totals(table(spark, d, "chunk")).select("dimension", "value", "chunks")


def p5_cover(spark: SparkSession, d: str) -> DataFrame:
    """Of each chunk that was cut: do its pieces keep the limit, give its text back and overlap as asked?"""
    chunks = table(spark, d, "chunk")
    parts = p5.oversized_pieces(chunks)
    length = p5.latest(chunks).select("id", "n_chars")
    told = parts.groupBy("id").agg(F.max(F.length("text")).alias("longest"), F.max("end").alias("upto"), F.sum(F.col("end") - F.col("start")).alias("new"), F.min("start").alias("head"), F.min(F.when(F.col("piece") > 0, F.length("text") - (F.col("end") - F.col("start")))).alias("more"))
    good = (F.col("longest") <= p5.LIMIT) & (F.col("upto") == F.col("n_chars")) & (F.col("new") + F.col("head") == F.col("n_chars")) & (F.col("more") >= p5.OVERLAP + F.col("head"))
    return told.join(length, "id").select("id", good.alias("covered"))


def p5_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Of each page: do its chunks and pieces have running numbers from 0?"""
    chunks = table(spark, d, "chunk")
    url = p5.latest(chunks).select("id", "url")
    rows = p5.renumbered(chunks).join(url, "id").groupBy("url").agg(F.count("*").alias("n"), F.countDistinct("chunk_index").alias("different"), F.max("chunk_index").alias("last"))
    return rows.select("url", ((F.col("n") == F.col("different")) & (F.col("last") == F.col("n") - 1)).alias("running"))


def p8_capacity(spark: SparkSession, d: str) -> DataFrame:
    """Of each document: is it in one container, or in pieces only if it alone exceeds the capacity? And is no container too full?"""
    rows = p8.packed(table(spark, d, "documents"))
    used = rows.groupBy("container_id").agg((F.sum("tokens") <= p8.CAPACITY).alias("within"))
    own = rows.join(used, "container_id").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.min("within").alias("within"))
    return own.select("doc_id", ((F.col("n") == 1) | (F.col("tokens") > p8.CAPACITY)).alias("whole"), "within")


def p7_chunks(spark: SparkSession, d: str) -> DataFrame:
    """(chunk_key, pages): content-defined chunks repeated within a site, and in how many of its pages."""
    return p7.repeated_chunks(p7.line_chunks(p7.site_lines(_posts(spark, d))))


_NAMED = (p1_chunk_tokens, p1_token_totals, p1_chunk_counts, p2_found, p2_groups, p3_found, p3_statistics, p4_found, p4_clean, p5_found, p5_pieces, p5_cover, p5_numbers, p6_found, p6_bodies, p7_found, p7_clean, p7_chunks, p8_packed, p8_containers, p8_capacity, p9_found, p9_items, p10_found, p10_composition)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _NAMED}

#: SQL for the driver's check, written from the definitions and not from the operators.
_FOLDED = r"trim(regexp_replace(regexp_replace(lower(line), '[\s\x{00a0}\x{3000}]+', ' ', 'g'), '[0-9]+', '0', 'g'))"
_P7_LINES = f"""WITH l AS (SELECT page_id, site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
FROM raw_page WHERE source IN ('blog', 'community')),
f AS (SELECT page_id, site, line_no, {_FOLDED} AS k FROM l),
often AS (SELECT site, k FROM f WHERE length(k) >= 20 GROUP BY site, k HAVING count(DISTINCT page_id) >= 6)
"""
_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_P2 = f"""WITH w AS (SELECT page_id, {_WORDS} AS w FROM raw_page WHERE source IS NULL OR source = 'github'),
s AS (SELECT DISTINCT page_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT page_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 50)),
n AS (SELECT page_id, count(*) AS n FROM s GROUP BY page_id),
p AS (SELECT a.page_id AS a, b.page_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.page_id < b.page_id GROUP BY 1, 2)
SELECT a AS page_id_a, b AS page_id_b FROM p JOIN n x ON x.page_id = a JOIN n y ON y.page_id = b WHERE 10 * k >= 6 * (x.n + y.n - k)"""
_RUNS = lambda table, key: f"SELECT DISTINCT {key}, array_to_string(list_slice(w, i, i + 9), ' ') AS s FROM (SELECT {key}, w, unnest(range(1, len(w) - 8)) AS i FROM (SELECT {key}, {_WORDS} AS w FROM {table}) WHERE len(w) >= 10)"
_LATEST = "(SELECT id, text, lang, metadata FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST) AS r FROM chunk WHERE id IS NOT NULL) WHERE r = 1)"
_P9 = f"WITH d AS ({_RUNS('documents', 'doc_id')}), i AS ({_RUNS('eval_item', 'item_id')}), f AS (SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (s))"
SQL: dict[str, str] = {
    "p2_found": _P2,
    "p2_groups": f"""WITH RECURSIVE pairs AS ({_P2}), pg AS (SELECT page_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM (SELECT page_id, {_WORDS} AS w FROM raw_page WHERE source IS NULL OR source = 'github') WHERE len(w) >= 50),
cl AS (SELECT page_id, min(page_id) OVER (PARTITION BY list_sort(s)) AS class_id FROM pg),
e AS (SELECT page_id_a AS a, page_id_b AS b FROM pairs UNION SELECT page_id_b, page_id_a FROM pairs),
r AS (SELECT page_id, page_id AS reached FROM cl UNION SELECT r.page_id, e.b FROM r JOIN e ON e.a = r.reached),
g AS (SELECT page_id, min(reached) AS group_id FROM r GROUP BY page_id),
l AS (SELECT x.page_id, count(DISTINCT y.class_id) FILTER (WHERE y.class_id <> x.class_id) AS links FROM cl x JOIN e ON e.a = x.page_id JOIN cl y ON y.page_id = e.b GROUP BY x.page_id)
SELECT page_id, class_id, group_id, coalesce(links, 0) AS links FROM cl JOIN g USING (page_id) LEFT JOIN l USING (page_id)""",
    "p1_chunk_counts": f"""WITH c AS (SELECT coalesce(metadata.source, 'docs') AS source, CASE WHEN regexp_matches(lower(trim(lang)), '^[a-z]') THEN regexp_extract(lower(trim(lang)), '^[a-z]+') ELSE coalesce(left(lang, 0), 'und') END AS language, lower(coalesce(regexp_extract(metadata.url, '^[a-zA-Z]+://([^/:?#]+)', 1), '')) AS host FROM {_LATEST})
SELECT 'source' AS dimension, source AS value, count(*) AS chunks FROM c GROUP BY 2 UNION ALL SELECT 'language', language, count(*) FROM c GROUP BY 2 UNION ALL SELECT 'host', host, count(*) FROM c GROUP BY 2""",
    "p5_cover": f"SELECT id, TRUE AS covered FROM {_LATEST} WHERE length(text) > 4000",
    "p5_numbers": f"SELECT metadata.url AS url, TRUE AS running FROM {_LATEST} GROUP BY 1",
    "p8_capacity": "SELECT doc_id, TRUE AS whole, TRUE AS within FROM documents",
    "p9_items": _P9 + " SELECT item_id, any_value(suite) AS suite, count(f.doc_id) AS documents FROM eval_item LEFT JOIN f USING (item_id) GROUP BY item_id",
    "p7_clean": _P7_LINES
    + """SELECT p.page_id, count(*) FILTER (WHERE o.k IS NOT NULL) AS lines_cut, coalesce(string_agg(line, chr(10) ORDER BY f.line_no) FILTER (WHERE o.k IS NULL), CASE WHEN any_value(p.text) IS NOT NULL THEN '' END) AS text
FROM raw_page p LEFT JOIN l ON l.page_id = p.page_id LEFT JOIN f ON f.page_id = l.page_id AND f.line_no = l.line_no LEFT JOIN often o ON f.k = o.k AND f.site IS NOT DISTINCT FROM o.site
WHERE p.source IN ('blog', 'community') GROUP BY p.page_id""",
    "p9_found": _P9 + " SELECT doc_id, item_id FROM f",
    "p5_found": "SELECT id FROM (SELECT id, text, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST) AS r FROM chunk) WHERE r = 1 AND length(text) > 4000",
    "p7_found": _P7_LINES + "SELECT f.page_id, f.line_no FROM f JOIN often o ON f.k = o.k AND f.site IS NOT DISTINCT FROM o.site",
}
