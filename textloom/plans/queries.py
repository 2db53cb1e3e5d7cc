"""Queries over the project's tables by name, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.config import EngineConfig
from textloom.functions import text as T
from textloom.operators import chunking, dialogue, ingest, retrieval
from textloom.operators.store import ChunkStore, last_rows, upserted
from textloom.session import shared_path
from textloom.streaming import pipelines
from textloom.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with SQL if there is any."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# patterns of the SQL, written out here so that a wrong one of the operators shows
_SPACE = r"\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\p{Z}\t-\r\x1c- \x{85}]"
_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_STRIP = lambda x: f"regexp_replace({x}, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"
_COUNT = lambda x: f"len(regexp_extract_all({x}, '{_TOKEN}'))"
_KEY = r"""CASE WHEN source IS NULL THEN '' ELSE source || '_' END || regexp_replace(regexp_replace(replace(url, 'https://' || site || '/', ''), '^/+|/+$', '', 'g'), '[^\p{L}\p{N}_\-]', '_', 'g') || '.json'"""


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_page")


def _keyed(pages: DataFrame) -> DataFrame:
    prefix = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat("source", F.lit("_")))
    return pages.withColumn("key", T.url_key(F.col("url"), F.concat(F.lit("https://"), F.col("site"), F.lit("/")), prefix))


@query(f"SELECT page_id, {_KEY} AS key FROM raw_page")
def url_keys(spark, d):
    return _keyed(_pages(spark, d)).select("page_id", "key")


@query(f"SELECT key, count(DISTINCT url) AS urls FROM (SELECT url, {_KEY} AS key FROM raw_page) GROUP BY key HAVING count(DISTINCT url) > 1")
def url_key_collisions(spark, d):
    return _keyed(_pages(spark, d)).groupBy("key").agg(F.countDistinct("url").alias("urls")).filter("urls > 1")


@query("SELECT url, max(nullif(trim(lastmod), '')) AS lastmod FROM url_entry WHERE url <> '' GROUP BY url")
def sitemap_entries(spark, d):
    return ingest.distinct_entries(table(spark, d, "url_entry"))


@query("SELECT url, lastmod FROM url_entry WHERE starts_with(url, 'https://docs.lumenscope.example/docs/release')")
def url_prefix_filter(spark, d):
    return table(spark, d, "url_entry").filter(F.col("url").startswith("https://docs.lumenscope.example/docs/release"))


@query("SELECT url, lastmod FROM url_entry WHERE contains(url, '/t5/')")
def url_contains_filter(spark, d):
    return table(spark, d, "url_entry").filter(F.contains("url", F.lit("/t5/")))


_DOC_PATH = "path LIKE '%.md' AND (path IN ('README.md', 'ARCHITECTURE.md', 'CONTRIBUTING.md', 'HACKING.md') OR path LIKE '%/README.md' OR starts_with(path, 'doc/') OR starts_with(path, 'docs/') OR starts_with(path, 'documentation/'))"


@query(f"SELECT repo, path, url, raw_url FROM repo_file WHERE {_DOC_PATH}")
def repo_doc_files(spark, d):
    return table(spark, d, "repo_file").filter(T.is_doc_path(F.col("path")))


@query("SELECT DISTINCT repo, path, 'https://git.example/' || repo || '/blob/main/' || path AS url, 'https://raw.git.example/' || repo || '/main/' || path AS raw_url FROM repo_file")
def repo_addresses(spark, d):
    return table(spark, d, "repo_file").select("repo", "path", F.concat(F.lit("https://git.example/"), "repo", F.lit("/blob/main/"), "path").alias("url"), F.concat(F.lit("https://raw.git.example/"), "repo", F.lit("/main/"), "path").alias("raw_url")).distinct()


_LINES = f"list_filter(list_transform(regexp_split_to_array(text, '{_LINE_END}'), lambda x: {_STRIP('x')}), lambda x: x <> '')"


@query(f"SELECT page_id, nullif(array_to_string({_LINES}, chr(10)), '') AS text, len({_LINES}) AS lines FROM raw_page")
def line_clean(spark, d):
    rows = _pages(spark, d).select("page_id", T.clean_lines(F.col("text")).alias("text"), F.col("text").isNull().alias("none"))
    return rows.select("page_id", "text", F.when(~F.col("none"), F.coalesce(F.size(F.split("text", "\n")).cast("long"), F.lit(0))).alias("lines"))


@query(
    rf"""SELECT page_id, split_part(breadcrumbs[1], '/', -1) || ': ' || coalesce({_STRIP("regexp_replace(list_filter(regexp_split_to_array(text, '" + _LINE_END + "'), lambda x: starts_with(x, '# '))[1], '^[# ]+', '')")}, split_part(replace(breadcrumbs[2], '.md', ''), '/', -1)) AS title
FROM raw_page WHERE source = 'github' AND len(breadcrumbs) = 2"""
)
def markdown_titles(spark, d):
    pages = _pages(spark, d).filter("source = 'github' AND size(breadcrumbs) = 2")
    return pages.select("page_id", T.markdown_title(F.col("text"), F.col("breadcrumbs")[0], F.col("breadcrumbs")[1]).alias("title"))


@query(
    rf"""WITH l AS (SELECT page_id, unnest(regexp_split_to_array(text, '{_LINE_END}')) AS line, generate_subscripts(regexp_split_to_array(text, '{_LINE_END}'), 1) AS n FROM raw_page WHERE source = 'github'),
h AS (SELECT page_id, line, row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS pos FROM l WHERE regexp_matches(line, '^#{{1,4}}\s+.+'))
SELECT page_id, pos, length(regexp_extract(line, '^(#{{1,4}})\s', 1)) AS level, {_STRIP(r"regexp_extract(line, '^#{1,4}\s+(.+)', 1)")} AS text FROM h"""
)
def markdown_heading_lines(spark, d):
    rows = _pages(spark, d).filter("source = 'github'").select("page_id", F.posexplode(T.markdown_headings(F.col("text"))).alias("pos", "h"))
    return rows.select("page_id", F.col("pos").cast("long").alias("pos"), F.col("h.level").cast("long").alias("level"), "h.text")


@query(f"SELECT page_id FROM raw_page WHERE length({_STRIP('text')}) >= CASE source WHEN 'blog' THEN 100 WHEN 'github' THEN 50 ELSE 1 END")
def length_gate(spark, d):
    least = F.when(F.col("source") == "blog", 100).when(F.col("source") == "github", 50).otherwise(1)
    return ingest.long_enough(_pages(spark, d), T.strip(F.col("text")), least).select("page_id")


# the store holds the pages scraped in one half of the rows by hash-free rule: even page ids
_LISTED = "(SELECT url, max(nullif(trim(lastmod), '')) AS lastmod FROM url_entry WHERE url <> '' GROUP BY url)"
_STORED = "(SELECT DISTINCT url FROM raw_page WHERE page_id % 2 = 0)"


def _listed_stored(spark, d):
    return ingest.distinct_entries(table(spark, d, "url_entry")), _pages(spark, d).filter("page_id % 2 = 0")


@query(f"SELECT url FROM {_LISTED} WHERE url NOT IN (SELECT url FROM {_STORED}) ORDER BY url LIMIT 50")
def crawl_limit_after(spark, d):
    listed, stored = _listed_stored(spark, d)
    return ingest.to_crawl(listed, stored, "url", 50, F.col("url")).select("url")


@query(f"SELECT url FROM (SELECT url FROM {_LISTED} ORDER BY url LIMIT 50) WHERE url NOT IN (SELECT url FROM {_STORED})")
def crawl_limit_before(spark, d):
    listed, stored = _listed_stored(spark, d)
    return ingest.to_crawl(listed, stored, "url", 50, F.col("url"), limit_first=True).select("url")


_HOST = "regexp_extract(url, '^https?://([^/]+)', 1)"


@query(
    f"""WITH l AS (SELECT url, {_HOST} AS host FROM {_LISTED}), s AS (SELECT * FROM l WHERE url NOT IN (SELECT url FROM {_STORED})),
o AS (SELECT s.host, EXISTS (SELECT 1 FROM raw_page p WHERE p.url = s.url) AS ok FROM s)
SELECT l.host, coalesce(any_value(o2.success), 0) AS success, coalesce(any_value(o2.failed), 0) AS failed, count(*) - coalesce(any_value(s2.n), 0) AS skipped
FROM l LEFT JOIN (SELECT host, count(*) FILTER (WHERE ok) AS success, count(*) FILTER (WHERE NOT ok) AS failed FROM o GROUP BY host) o2 USING (host)
LEFT JOIN (SELECT host, count(*) AS n FROM s GROUP BY host) s2 USING (host) GROUP BY l.host"""
)
def crawl_counters(spark, d):
    listed, stored = _listed_stored(spark, d)
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    listed = listed.withColumn("host", host)
    selected = ingest.to_crawl(listed, stored, "url", None, F.col("url"))
    fetched = _pages(spark, d).select("url").distinct().withColumn("ok", F.lit(True))
    outcome = selected.join(fetched, "url", "left").select("host", F.coalesce("ok", F.lit(False)).alias("ok"))
    return ingest.crawl_stats(listed, selected, outcome, "host")


@query("SELECT coalesce(source, 'docs') AS source, count(*) AS pages, sum(length(text)) AS chars FROM (SELECT source, text FROM raw_page UNION ALL SELECT doc_type AS source, text FROM documents) GROUP BY 1")
def source_union(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_type").alias("source"), "text")
    both = ingest.union_pages(_pages(spark, d).select("source", "text", "url"), docs)
    return ingest.with_source(both).groupBy("source").agg(F.count("*").alias("pages"), F.sum(F.length("text")).alias("chars"))


@query("SELECT page_id, coalesce(source, 'docs') AS source FROM raw_page WHERE coalesce(source, 'docs') IN ('docs', 'blog')")
def source_choice(spark, d):
    return ingest.chosen_sources(_pages(spark, d), ["blog", "unknown", "docs"], ("docs", "release-notes", "blog", "community", "github")).select("page_id", "source")


@query("SELECT url, page_id FROM (SELECT url, page_id, row_number() OVER (PARTITION BY url ORDER BY ingested_at DESC NULLS LAST, page_id DESC) AS r FROM raw_page) WHERE r = 1")
def latest_pages(spark, d):
    rows = _pages(spark, d).select("url", "page_id", "ingested_at")
    return ingest.keep_last(rows, "url", F.coalesce(F.unix_micros(F.col("ingested_at").cast("timestamp")), F.lit(-(2**62))), F.col("page_id")).select("url", "page_id")


@query(f"SELECT page_id, {_COUNT('text')} AS tokens FROM raw_page WHERE text IS NOT NULL")
def token_counts(spark, d):
    return _pages(spark, d).filter("text is not null").select("page_id", T.token_count(F.col("text")).cast("long").alias("tokens"))


_PIECES = rf"""
raw AS (SELECT page_id, CASE WHEN contains(text, chr(10) || chr(10)) THEN chr(10) || chr(10) WHEN contains(text, chr(10)) THEN chr(10) WHEN contains(text, '. ') THEN '. ' WHEN contains(text, ' ') THEN ' ' END AS sep, text FROM raw_page WHERE length(text) > 0),
cut AS (SELECT page_id, sep, CASE WHEN sep IS NULL THEN [text] ELSE string_split(text, sep) END AS parts FROM raw),
led AS (SELECT page_id, CASE WHEN n = 1 THEN part ELSE sep || part END AS piece, n, sep FROM (SELECT page_id, sep, unnest(parts) AS part, generate_subscripts(parts, 1) AS n FROM cut)),
p AS (SELECT page_id, piece, row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS pos FROM led WHERE sep IS NULL OR regexp_matches(piece, '[^{_SPACE}]'))"""


@query(f"WITH {_PIECES} SELECT page_id, pos, piece FROM p")
def separator_pieces(spark, d):
    return chunking.split_pieces(_pages(spark, d)).withColumn("pos", F.col("pos").cast("long"))


_MERGED = f"""WITH RECURSIVE {_PIECES},
c AS (SELECT page_id, pos, piece, {_COUNT('piece')} AS n FROM p),
m AS (SELECT page_id, pos, piece AS cur, n AS tot, 0 AS g FROM c WHERE pos = 0
UNION ALL SELECT c.page_id, c.pos, CASE WHEN m.tot + c.n <= 200 THEN {_STRIP('m.cur || chr(10) || c.piece')} ELSE c.piece END, CASE WHEN m.tot + c.n <= 200 THEN m.tot + c.n ELSE c.n END, CASE WHEN m.tot + c.n <= 200 THEN m.g ELSE m.g + 1 END
FROM m JOIN c ON c.page_id = m.page_id AND c.pos = m.pos + 1),
k AS (SELECT page_id, g AS pos, arg_max(cur, pos) AS text FROM m GROUP BY page_id, g)"""
MERGE_LIMIT = 200


@query(f"{_MERGED} SELECT page_id, pos, text FROM k")
def greedy_chunks(spark, d):
    return chunking.section_chunks(_pages(spark, d), MERGE_LIMIT).withColumn("pos", F.col("pos").cast("long"))


_TAIL = lambda x, n: f"CASE WHEN len(regexp_extract_all({x}, '(?:{_TOKEN})[{_SPACE}]*')) > {n} THEN {_STRIP(f'''array_to_string(list_slice(regexp_extract_all({x}, '(?:{_TOKEN})[{_SPACE}]*'), -{n}, -1), '')''')} ELSE '' END"
_OVERLAPPED = f"""{_MERGED}, l AS (SELECT page_id, pos, text, lag(text) OVER (PARTITION BY page_id ORDER BY pos) AS before FROM k),
t AS (SELECT page_id, pos, text, coalesce({_TAIL('before', 30)}, '') AS tail FROM l),
o AS (SELECT page_id, pos, CASE WHEN tail <> '' THEN tail || chr(10) || text ELSE text END AS text FROM t)"""


# the greedy merge over rows (key columns, pos, piece): one step of the recursion is one piece
_FOLD = lambda name, rows, keys, limit: f"""{name}_c AS (SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY pos) AS pos, piece, {_COUNT('piece')} AS n FROM {rows}),
{name}_m AS (SELECT {keys}, pos, piece AS cur, n AS tot, 0 AS g FROM {name}_c WHERE pos = 1
UNION ALL SELECT {keys}, c.pos, CASE WHEN m.tot + c.n <= {limit} THEN {_STRIP('m.cur || chr(10) || c.piece')} ELSE c.piece END, CASE WHEN m.tot + c.n <= {limit} THEN m.tot + c.n ELSE c.n END, CASE WHEN m.tot + c.n <= {limit} THEN m.g ELSE m.g + 1 END
FROM {name}_m m JOIN (SELECT *, pos - 1 AS before FROM {name}_c) c USING ({keys}) WHERE c.before = m.pos),
{name} AS (SELECT {keys}, g AS pos, arg_max(cur, pos) AS piece FROM {name}_m GROUP BY {keys}, g)"""  # noqa: E731


def _page_chunks_sql(limit: int, most: int, overlap: int) -> str:
    """Sections by second-level headings, parts by third-level ones, pieces by separators, merge, overlap, header."""
    levels = lambda n: f"coalesce(list_transform(list_filter(headings, lambda h: h.level = {n} AND h.text <> ''), lambda h: h.text), [])"
    return f"""WITH RECURSIVE pg AS (SELECT page_id, url, coalesce(title, '') AS title, coalesce(source, 'docs') AS source, text, {levels(2)} AS h2, {levels(3)} AS h3 FROM raw_page WHERE text <> ''),
f AS (SELECT page_id, 0 AS k, 0::BIGINT AS upto, 0::BIGINT AS s, false AS found FROM pg
UNION ALL SELECT page_id, k + 1, CASE WHEN hit = 0 THEN upto WHEN nx > 0 THEN upto + hit - 1 + w + nx - 1 ELSE size END, upto + hit - 1, hit > 0
FROM (SELECT *, CASE WHEN hit > 0 AND k + 2 <= len(h2) THEN strpos(substr(text, upto + hit + w), h2[k + 2]) ELSE 0 END AS nx
FROM (SELECT f.page_id, k, upto, text, h2, length(text) AS size, length(h2[k + 1]) AS w, strpos(substr(text, upto + 1), h2[k + 1]) AS hit FROM f JOIN pg USING (page_id) WHERE k < len(h2)))),
spans AS (SELECT page_id, k, s, upto AS e, coalesce(lead(s) OVER (PARTITION BY page_id ORDER BY k), length(text)) AS nxt, h2[k] AS heading, text FROM f JOIN pg USING (page_id) WHERE found),
sec AS (SELECT page_id, k, heading, {_STRIP('substr(text, s + 1, e - s)')} || CASE WHEN {_STRIP('substr(text, e + 1, nxt - e)')} <> '' THEN chr(10) || {_STRIP('substr(text, e + 1, nxt - e)')} ELSE '' END AS body FROM spans
UNION ALL SELECT page_id, 0, '', CASE WHEN len(h2) = 0 THEN text ELSE {_STRIP('substr(text, 1, coalesce((SELECT min(s) FROM spans x WHERE x.page_id = pg.page_id), length(text)))')} END FROM pg),
big AS (SELECT page_id, k, body, h3 FROM sec JOIN pg USING (page_id) WHERE {_COUNT('body')} > {limit}),
g AS (SELECT page_id, k, 0 AS j, 0::BIGINT AS pos FROM big
UNION ALL SELECT page_id, k, j + 1, CASE WHEN hit > 1 THEN pos + hit - 1 ELSE pos END FROM (SELECT g.*, strpos(substr(body, pos + 1), h3[j + 1]) AS hit FROM g JOIN big USING (page_id, k) WHERE j < len(h3))),
cuts AS (SELECT DISTINCT page_id, k, pos FROM g),
part AS (SELECT page_id, k, pos, CASE WHEN len(h3) = 0 THEN body ELSE {_STRIP('substr(body, pos + 1, nxt - pos)')} END AS piece FROM (SELECT page_id, k, pos, body, h3, coalesce(lead(pos) OVER (PARTITION BY page_id, k ORDER BY pos), length(body)) AS nxt FROM cuts JOIN big USING (page_id, k))),
large AS (SELECT page_id, k, pos AS part, piece AS text, CASE WHEN contains(piece, chr(10) || chr(10)) THEN chr(10) || chr(10) WHEN contains(piece, chr(10)) THEN chr(10) WHEN contains(piece, '. ') THEN '. ' WHEN contains(piece, ' ') THEN ' ' END AS sep FROM part WHERE {_COUNT('piece')} > {most}),
bits AS (SELECT page_id, k, part, n AS pos, CASE WHEN n = 1 THEN bit ELSE sep || bit END AS piece, sep FROM (SELECT page_id, k, part, sep, unnest(CASE WHEN sep IS NULL THEN [text] ELSE string_split(text, sep) END) AS bit, generate_subscripts(CASE WHEN sep IS NULL THEN [text] ELSE string_split(text, sep) END, 1) AS n FROM large)),
own AS (SELECT * FROM bits WHERE sep IS NULL OR regexp_matches(piece, '[^{_SPACE}]')),
{_FOLD('sub', 'own', 'page_id, k, part', limit)},
items AS (SELECT page_id, k, [pos, 0] AS pos, piece FROM part WHERE {_COUNT('piece')} <= {most} AND piece <> '' UNION ALL SELECT page_id, k, [part, pos], piece FROM sub),
{_FOLD('runs', 'items', 'page_id, k', limit)},
ends AS (SELECT *, lag(piece) OVER (PARTITION BY page_id, k ORDER BY pos) AS before FROM runs),
tails AS (SELECT *, coalesce({_TAIL('before', overlap)}, '') AS tail FROM ends),
body AS (SELECT page_id, k, pos, CASE WHEN tail <> '' THEN tail || chr(10) || piece ELSE piece END AS body FROM tails
UNION ALL SELECT page_id, k, 0, body FROM sec WHERE {_COUNT('body')} <= {limit} AND regexp_matches(body, '[^{_SPACE}]')),
num AS (SELECT body.*, row_number() OVER (PARTITION BY page_id ORDER BY body.k, body.pos) - 1 AS chunk_index, coalesce(spans.heading, '') AS section FROM body LEFT JOIN spans USING (page_id, k))
SELECT url || '#chunk-' || chunk_index AS id, 'Source: ' || source || ' | Page: ' || title || CASE WHEN section <> '' THEN ' | Section: ' || section ELSE '' END || ' | URL: ' || url || chr(10) || chr(10) || body AS text, url, title, section, chunk_index, source FROM num JOIN pg USING (page_id)"""


def _chunked(spark, d, config: EngineConfig) -> DataFrame:
    rows = chunking.page_chunks(_pages(spark, d), config)
    return rows.select("id", "text", "metadata.url", "metadata.title", "metadata.section", F.col("metadata.chunk_index").cast("long").alias("chunk_index"), "metadata.source")


@query(_page_chunks_sql(800, 1200, 100))
def page_chunks(spark, d):
    return _chunked(spark, d, EngineConfig())


@query(_page_chunks_sql(90, 140, 12))
def page_chunks_small(spark, d):
    return _chunked(spark, d, EngineConfig(chunk_tokens=90, max_part_tokens=140, overlap_tokens=12))


@query(f"{_OVERLAPPED} SELECT page_id, pos, text FROM o")
def chunk_overlap(spark, d):
    return chunking.with_overlap(chunking.section_chunks(_pages(spark, d), MERGE_LIMIT), 30).withColumn("pos", F.col("pos").cast("long"))


@query(
    f"""{_MERGED} SELECT r.url || '#chunk-' || i AS id, 'Source: ' || coalesce(r.source, 'docs') || ' | Page: ' || coalesce(r.title, '') || ' | URL: ' || r.url || chr(10) || chr(10) || text AS text, i AS chunk_index
FROM (SELECT k.page_id, k.text, row_number() OVER (PARTITION BY url ORDER BY k.page_id, pos) - 1 AS i, url, source, title FROM k JOIN raw_page p USING (page_id)) r"""
)
def chunk_records(spark, d):
    pages = _pages(spark, d)
    merged = chunking.section_chunks(pages, MERGE_LIMIT).join(pages.select("page_id", "url", "title", "source"), "page_id")
    rows = chunking.chunk_rows(merged.withColumn("pos", F.struct("page_id", "pos")).withColumn("section", F.lit("")))
    return rows.select("id", "text", F.col("metadata.chunk_index").cast("long").alias("chunk_index"))


_LAST_CHUNK = "(SELECT id, text, metadata FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST) AS r FROM chunk WHERE id IS NOT NULL) WHERE r = 1)"


def _last_chunks(spark, d):
    order = F.coalesce(F.unix_micros(F.col("indexed_at").cast("timestamp")), F.lit(-(2**62)))
    return last_rows(table(spark, d, "chunk").select("id", "text", "metadata", "indexed_at"), "id", order, F.xxhash64("text"))


@query(f"SELECT coalesce(metadata.source, 'docs') AS source, count(*) AS chunks, count(DISTINCT metadata.url) AS pages, round(count(*) / count(DISTINCT metadata.url), 6) AS average FROM {_LAST_CHUNK} GROUP BY 1")
def chunks_per_page(spark, d):
    rows = _last_chunks(spark, d).select(F.coalesce("metadata.source", F.lit("docs")).alias("source"), F.col("metadata.url").alias("url"))
    pages = rows.groupBy("source", "url").agg(F.count("*").alias("n"))
    return pages.groupBy("source").agg(F.sum("n").alias("chunks"), F.count("url").alias("pages"), F.round(F.try_divide(F.sum("n"), F.count("url")), 6).alias("average"))


_MICROS = "coalesce(epoch_us(indexed_at), -4611686018427387904)"
# of equal times the greater text
_LATEST = f"SELECT id, text, metadata, {_MICROS} AS indexed_us FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST, text DESC NULLS LAST) AS r FROM chunk WHERE id IS NOT NULL) WHERE r = 1"
_STORED_ROW = "id string, text string, metadata struct<url: string>, indexed_us bigint"


def _store_rows(spark, d) -> DataFrame:
    at = F.coalesce(F.unix_micros(F.col("indexed_at").cast("timestamp")), F.lit(-(2**62)))
    return table(spark, d, "chunk").filter("id is not null").select("id", "text", F.struct(F.col("metadata.url").alias("url")).alias("metadata"), at.alias("indexed_us"))


def _filled_store(spark, d, name: str) -> ChunkStore:
    """A store that got the rows before June 2025 first and the others after them."""
    rows, middle = _store_rows(spark, d), F.unix_micros(F.lit("2025-06-01 00:00:00").cast("timestamp"))
    store = ChunkStore(spark, shared_path(spark, name), _STORED_ROW)
    for part in (rows.filter(F.col("indexed_us") < middle), rows.filter(F.col("indexed_us") >= middle)):
        store.upsert(part, F.col("indexed_us"), F.col("text"))
    return store


@query(f"SELECT id, text, indexed_us FROM ({_LATEST})")
def index_upsert(spark, d):
    return _filled_store(spark, d, "upsert").read().select("id", "text", "indexed_us")


@query(f"SELECT metadata.url AS url, count(*) AS chunks FROM ({_LATEST}) WHERE metadata.url NOT IN (SELECT url FROM raw_page WHERE source = 'github') GROUP BY 1")
def index_delete(spark, d):
    store = _filled_store(spark, d, "delete")
    store.replace_pages(_pages(spark, d).filter("source = 'github'").select("url"))
    return store.read().groupBy(F.col("metadata.url").alias("url")).agg(F.count("*").alias("chunks"))


@query(f"SELECT id, text FROM ({_LATEST}) WHERE metadata.url <> (SELECT max(metadata.url) FROM chunk)")
def index_delete_page(spark, d):
    store = _filled_store(spark, d, "delete-page")
    store.delete_by_url(table(spark, d, "chunk").agg(F.max("metadata.url")).first()[0])
    return store.read().select("id", "text")


@query("SELECT 0 AS before, 0 AS after")
def index_truncate(spark, d):
    store = ChunkStore(spark, shared_path(spark, "truncate"), _STORED_ROW)
    before = store.count()
    store.upsert(_store_rows(spark, d), F.col("indexed_us"))
    store.clear()
    return store.read().agg(F.lit(before).cast("int").alias("before"), F.count("*").cast("int").alias("after"))


@query("SELECT count(DISTINCT id) AS index_size FROM chunk")
def index_count(spark, d):
    return table(spark, d, "chunk").filter("id is not null").groupBy("id").count().agg(F.count("*").alias("index_size"))


# -- retrieval: the queries are the vectors whose id is divisible by 20


def _vectors(spark, d):
    v = table(spark, d, "embeddings")
    return v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), v


def _knn(k: int, where: str = "TRUE") -> str:
    return f"""h AS (SELECT q.vec_id AS query_id, c.vec_id, c.label, list_cosine_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS distance FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0 AND {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 12), vec_id) AS rank FROM h QUALIFY rank <= {k})"""


@query(f"WITH {_knn(8)} SELECT query_id, vec_id, round(distance, 6) AS distance, rank FROM r")
def knn_top8(spark, d):
    q, v = _vectors(spark, d)
    return retrieval.nearest(q, v, 8).select("query_id", "vec_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_knn(8, 'c.label = 3')} SELECT query_id, vec_id, round(distance, 6) AS distance, rank FROM r")
def knn_filtered(spark, d):
    q, v = _vectors(spark, d)
    return retrieval.nearest(q, v.filter("label = 3"), 8).select("query_id", "vec_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


def _cells(spark, d):
    q, v = _vectors(spark, d)
    index = retrieval.CellIndex().fit(v).store(v, shared_path(spark, "cells"))
    return index.search(q, 8)


@query()
def knn_cells(spark, d):
    return _cells(spark, d).select("query_id", "vec_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query("SELECT count(*) AS queries, TRUE AS recall_of_nine_tenths FROM embeddings WHERE vec_id % 20 = 0")
def knn_cells_recall(spark, d):
    """The cells' neighbours against those of the exact search."""
    q, v = _vectors(spark, d)
    exact = retrieval.nearest(q, v, 8).select("query_id", "vec_id")
    found = _cells(spark, d).select("query_id", "vec_id", F.lit(1).alias("met"))
    both = exact.join(found, ["query_id", "vec_id"], "left").agg(F.countDistinct("query_id").alias("queries"), (F.count("met") >= 0.9 * F.count("*")).alias("recall_of_nine_tenths"))
    return both


# the vectors of one label stand for the chunks of one page, numbered by their id
FAN_IN = 40


def _hits(spark, d):
    q, v = _vectors(spark, d)
    found = retrieval.nearest(q, v, FAN_IN).join(v.select("vec_id", "label"), "vec_id")
    page = F.concat(F.lit("page-"), "label")
    return found.select(
        "query_id", page.alias("url"), F.col("vec_id").alias("chunk_index"), F.concat(page, F.lit("#chunk-"), "vec_id").alias("id"), F.concat(F.lit("text "), "vec_id").alias("text"), F.concat(F.lit("Title "), F.col("label")).alias("title"), F.round("distance", 6).alias("distance"), "rank"
    )


_ISLANDS = f"""WITH {_knn(FAN_IN)},
i AS (SELECT query_id, 'page-' || label AS url, label, vec_id, round(distance, 6) AS distance, rank, vec_id - row_number() OVER (PARTITION BY query_id, label ORDER BY vec_id) AS island, min(rank) OVER (PARTITION BY query_id, label) AS seen FROM r),
g AS (SELECT query_id, url, 'Title ' || any_value(label) AS title, min(vec_id) AS chunk_index, max(vec_id) AS last_index, string_agg('text ' || vec_id, chr(10) || chr(10) ORDER BY vec_id) AS text, min(distance) AS distance, min(seen) AS seen FROM i GROUP BY query_id, url, island),
f AS (SELECT query_id, url || '#chunk-' || chunk_index AS id, url, title, chunk_index, last_index, text, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, seen, chunk_index) AS place FROM g)"""


@query(f"{_ISLANDS} SELECT query_id, id, url, title, chunk_index, last_index, text, distance, place FROM f")
def merged_hits(spark, d):
    return retrieval.merge_adjacent(_hits(spark, d)).withColumn("place", F.col("place").cast("long"))


@query(f"{_ISLANDS} SELECT query_id, id, distance, place FROM f WHERE place <= 5")
def retrieve_top5(spark, d):
    return retrieval.top_contexts(_hits(spark, d), 5).select("query_id", "id", "distance", F.col("place").cast("long").alias("place"))


@query(f"{_ISLANDS} SELECT query_id, string_agg('--- Context ' || place || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY place) AS context FROM f WHERE place <= 5 GROUP BY query_id")
def context_blocks(spark, d):
    return retrieval.context_blocks(retrieval.top_contexts(_hits(spark, d), 5))


@query(f"{_ISLANDS} SELECT query_id, url, title, row_number() OVER (PARTITION BY query_id ORDER BY place) AS position FROM (SELECT query_id, url, min(place) AS place, arg_min(title, place) AS title FROM f WHERE place <= 5 GROUP BY query_id, url)")
def cited_sources(spark, d):
    return retrieval.cited_sources(retrieval.top_contexts(_hits(spark, d), 5)).withColumn("position", F.col("position").cast("long"))


@query("SELECT page_id, coalesce(nullif(title, ''), url) AS label FROM raw_page")
def source_labels(spark, d):
    return _pages(spark, d).select("page_id", retrieval.source_links(F.col("title"), F.col("url")).alias("label"))


# -- conversations

_CLEAN = "(SELECT session_id, pos, role, content FROM (SELECT *, row_number() OVER (PARTITION BY session_id, pos ORDER BY sent_at DESC NULLS LAST, coalesce(content, '') DESC) AS r FROM message WHERE session_id IS NOT NULL) WHERE r = 1)"
_LAST = lambda n: f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY pos DESC) AS back FROM {_CLEAN}) WHERE back <= {n})"


def _messages(spark, d):
    return dialogue.clean_messages(table(spark, d, "message"))


def _last(n: int, name: str) -> None:
    def run(spark, d):
        return dialogue.last_messages(_messages(spark, d), n).select("session_id", "pos", "role", "content")

    run.__name__ = name
    query(f"SELECT session_id, pos, role, content FROM {_LAST(n)}")(run)


for _n in (6, 12, 40):
    _last(_n, f"history_last_{_n}")


_TRANSCRIPT = f"(SELECT session_id, string_agg(CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || substr(coalesce(content, ''), 1, 500), chr(10) ORDER BY pos) AS transcript FROM {_LAST(6)} GROUP BY session_id)"


@query(f"SELECT session_id, transcript FROM {_TRANSCRIPT}")
def rewrite_transcripts(spark, d):
    return dialogue.transcripts(_messages(spark, d))


def _questions(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The last user message of each session asks; what came before it is the history."""
    asked = messages.filter("role = 'user' and content <> ''").groupBy("session_id").agg(F.max("pos").alias("at"), F.max_by("content", "pos").alias("message"))
    history = messages.join(asked.select("session_id", "at"), "session_id").filter("pos < at").drop("at")
    return asked.select("session_id", "message"), history


_ASKED = f"asked AS (SELECT session_id, max(pos) AS upto, arg_max(content, pos) AS message FROM {_CLEAN} WHERE role = 'user' AND content <> '' GROUP BY session_id), hist AS (SELECT c.* FROM {_CLEAN} c JOIN asked a USING (session_id) WHERE c.pos < a.upto)"


class CountingGenerator:
    """Answers with the prompt's length, and with nothing to prompts of an even length."""

    def generate(self, prompts):
        return prompts.map(lambda p: f" q{len(p)} " if len(p) % 2 else " ")


@query(
    f"""WITH {_ASKED}, b AS (SELECT session_id, string_agg(CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || substr(coalesce(content, ''), 1, 500), chr(10) ORDER BY pos) AS told
FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY pos DESC) AS back FROM hist) WHERE back <= 6 GROUP BY session_id),
p AS (SELECT a.session_id, message, length('Conversation so far:' || chr(10) || told || chr(10) || chr(10) || 'Follow-up question: ' || message || chr(10) || chr(10) || 'Rewritten standalone query:') AS n FROM asked a LEFT JOIN b USING (session_id)),
r AS (SELECT session_id, message, CASE WHEN n IS NULL THEN NULL WHEN n % 2 = 1 THEN 'q' || n ELSE message END AS rewritten FROM p)
SELECT session_id, rewritten, coalesce(rewritten, message) AS query FROM r"""
)
def generated_queries(spark, d):
    asked, history = _questions(_messages(spark, d))
    return dialogue.rewritten_queries(asked, history, CountingGenerator()).select("session_id", "rewritten", "query")


@query(f"WITH {_ASKED} SELECT a.session_id, a.message AS query, CASE WHEN count(h.pos) > 0 THEN a.message END AS rewritten FROM asked a LEFT JOIN hist h USING (session_id) GROUP BY a.session_id, a.message")
def standalone_queries(spark, d):
    asked, history = _questions(_messages(spark, d))
    return dialogue.rewritten_queries(asked, history).select("session_id", "query", "rewritten")


@query(
    f"""WITH {_ASKED}, b AS (SELECT session_id, pos, role, content FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY pos DESC) AS back FROM hist) WHERE back <= 12),
u AS (SELECT session_id, pos, role, content FROM b UNION ALL SELECT session_id, upto, 'user', 'Here is relevant documentation context:' || chr(10) || chr(10) || 'about ' || upper(message) || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'User question: ' || message FROM asked)
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY pos) - 1 AS n, role, content FROM u"""
)
def message_lists(spark, d):
    asked, history = _questions(_messages(spark, d))
    contexts = asked.select("session_id", F.concat(F.lit("about "), F.upper("message")).alias("context"))
    rows = dialogue.message_lists(asked, history, contexts).select("session_id", F.posexplode("messages").alias("n", "m"))
    return rows.select("session_id", F.col("n").cast("long").alias("n"), "m.role", "m.content")


@query(
    f"""WITH c AS (SELECT session_id, pos, role, content FROM {_CLEAN}), l AS (SELECT session_id, max(pos) AS last FROM c GROUP BY session_id),
u AS (SELECT * FROM c UNION ALL SELECT session_id, last + 1, 'user', 'and then?' FROM l UNION ALL SELECT session_id, last + 2, 'assistant', 'nothing' FROM l)
SELECT session_id, pos, role, content FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY pos DESC) AS back FROM u) WHERE back <= 40"""
)
def session_turn_cap(spark, d):
    messages = _messages(spark, d)
    turns = messages.select("session_id").distinct().select("session_id", F.lit("and then?").alias("message"), F.lit("nothing").alias("answer"))
    return dialogue.appended(messages, turns)


_SESSION = lambda t, k, at: f"""WITH g AS (SELECT {k}, {at} AS stamp, CASE WHEN {at} > lag({at}) OVER (PARTITION BY {k} ORDER BY {at}) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM {t} WHERE {at} IS NOT NULL),
s AS (SELECT {k}, stamp, sum(fresh) OVER (PARTITION BY {k} ORDER BY stamp RANGE UNBOUNDED PRECEDING)::BIGINT AS session FROM g)
SELECT {k}, epoch_us(min(stamp)) AS started_us, epoch_us(max(stamp)) AS last_us, count(*) AS accesses"""  # noqa: E731


def _micros(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"started_us": F.unix_micros(F.col("started").cast("timestamp")), "last_us": F.unix_micros(F.col("last_access").cast("timestamp"))}).drop("started", "last_access")


@query(_SESSION("events", "user_id", "ts") + ", session FROM s GROUP BY user_id, session")
def user_sessions(spark, d):
    return _micros(dialogue.sessions(table(spark, d, "events"), "user_id", "ts"))


@query(_SESSION("message", "session_id", "sent_at") + ", session FROM s GROUP BY session_id, session")
def chat_sessions(spark, d):
    return _micros(dialogue.sessions(table(spark, d, "message"), "session_id", "sent_at"))


@query(_SESSION("events", "user_id", "ts") + " FROM s GROUP BY user_id, session")
def session_windows(spark, d):
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return _micros(dialogue.windowed_sessions(rows, "user_id", "ts"))


# -- streams, run over all that is there


@query(f"SELECT id, text, indexed_us FROM ({_LATEST})")
def stream_ingest(spark, d):
    """The chunk table as a stream, delivered twice: a replay changes nothing."""
    path = shared_path(spark, "stream-ingest")
    store = ChunkStore(spark, f"{path}/store", _STORED_ROW)
    for run in ("first", "replay"):
        stream = pipelines.table_stream(spark, f"{d}/chunk.parquet").filter("id is not null")
        at = F.coalesce(F.unix_micros(F.col("indexed_at").cast("timestamp")), F.lit(-(2**62)))
        rows = stream.select("id", "text", F.struct(F.col("metadata.url").alias("url")).alias("metadata"), at.alias("indexed_us"))
        pipelines.upsert_stream(rows, store, "indexed_us", f"{path}/{run}", "text").awaitTermination()
    return store.read().select("id", "text", "indexed_us")


@query(_SESSION("events", "user_id", "ts") + " FROM s GROUP BY user_id, session HAVING max(stamp) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR")
def stream_sessions(spark, d):
    path = shared_path(spark, "stream-sessions")
    stream = pipelines.session_stream(pipelines.table_stream(spark, f"{d}/events.parquet").select("user_id", "ts"), "user_id", "ts")
    return _micros(pipelines.appended_to(stream, f"{path}/out", f"{path}/checkpoint"))


@query(f"SELECT session_id, pos, role, content FROM {_LAST(40)}")
def stream_histories(spark, d):
    path = shared_path(spark, "stream-histories")
    rows = pipelines.table_stream(spark, f"{d}/message.parquet")
    return pipelines.latest_output(pipelines.history_stream(rows, expire=False), "session_id", f"{path}/out", f"{path}/checkpoint")
