"""Queries over the sources: pages, sitemaps, listings and files are written out from the tables
in their outer form (HTML, XML, JSON) and read back by the source operators; the SQL says what
must come out straight from the tables."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from textloom.functions.text import is_doc_path
from textloom.operators.ingest import found_counts
from textloom.plans.queries import _DOC_PATH, _LINE_END, _LINES, _STRIP, query
from textloom.session import shared_path
from textloom.sources import pages, repo, sitemap
from textloom.tables import table


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _each(items: Column, wrap) -> Column:
    return F.array_join(F.transform(items, wrap), "")


def _html(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts])


def _paragraphs() -> Column:
    return _each(F.split("text", "\n"), lambda x: F.concat(F.lit("<p>"), escaped(x), F.lit("</p>")))


def _heads() -> Column:
    return _each(F.col("headings"), lambda h: F.concat(F.lit("<h"), h["level"], F.lit(">"), escaped(F.coalesce(h["text"], F.lit(""))), F.lit("</h"), h["level"], F.lit(">")))


def _extracted(landing: DataFrame, kind: str) -> DataFrame:
    rows = pages.pages_of_html(landing, kind, "https://")
    told = F.array_join(F.transform("headings", lambda h: F.concat_ws(":", h["level"].cast("string"), h["text"])), " | ")
    return rows.select("url", "key", "source", "ok", "title", F.array_join("breadcrumbs", " | ").alias("breadcrumbs"), told.alias("headings"), "text")


_HEADS = f"coalesce(array_to_string(list_transform(headings, lambda h: h.level || ':' || {_STRIP('h.text')}), ' | '), '')"
_HEAD_LINES = f"coalesce(list_filter(list_transform(headings, lambda h: {_STRIP('h.text')}), lambda x: x <> ''), [])"
_CRUMBS = f"coalesce(array_to_string(list_filter(list_transform(breadcrumbs, lambda b: {_STRIP('b')}), lambda b: b <> ''), ' | '), '')"
_PAGE_KEY = lambda prefix: rf"'{prefix}' || regexp_replace(regexp_replace(replace(url, 'https://', ''), '^/+|/+$', '', 'g'), '[^\p{{L}}\p{{N}}_\-]', '_', 'g') || '.json'"
_OWN = f"coalesce({_LINES}, [])"


@query(
    f"""SELECT url, {_PAGE_KEY('')} AS key, NULL::VARCHAR AS source, TRUE AS ok, {_STRIP("coalesce(title, '')")} AS title, {_CRUMBS} AS breadcrumbs, {_HEADS} AS headings,
array_to_string(list_concat({_HEAD_LINES}, {_OWN}, ['```', 'if x < 1:', 'y && z', '```']), chr(10)) AS text FROM raw_page WHERE source IS NULL"""
)
def html_docs(spark: SparkSession, d: str) -> DataFrame:
    """Docs pages as HTML and back: container, noise, title, breadcrumbs, headings, fenced code, clean lines."""
    rows = table(spark, d, "raw_page").filter("source is null")
    crumbs = _each(F.col("breadcrumbs"), lambda b: F.concat(F.lit("<a href='/'> "), escaped(F.coalesce(b, F.lit(""))), F.lit(" </a><i>/</i>")))
    html = _html(
        "<!doctype html><html><head><title>Not this</title><script>var menu = '<p>';</script></head><body><nav>menu<a>Home</a></nav><h1> ", escaped(F.col("title")), "</h1><div aria-label=\"breadcrumb\">", crumbs,
        "<span> </span></div><article>other</article><main class='page'><nav>on page</nav><div class=\"wide sidebar\">side</div><div class='cookie-banner'>cookies</div>", _heads(), _paragraphs(),
        "<pre>if x &lt; 1:\n\n    y &amp;&amp; z</pre><aside>aside<div>deep</div></aside><footer>legal</footer></main></body></html>",
    )
    return _extracted(rows.select("url", html.alias("html")), "docs")


@query(
    f"""WITH p AS (SELECT url, {_STRIP("coalesce(title, '')")} AS title, {_HEADS} AS headings, array_to_string(list_concat({_HEAD_LINES}, {_OWN}), chr(10)) AS text FROM raw_page WHERE source = 'blog'),
k AS (SELECT *, title <> '' AND length(text) >= 100 AS ok FROM p)
SELECT url, {_PAGE_KEY('blog_')} AS key, 'blog' AS source, ok, CASE WHEN ok THEN title END AS title, CASE WHEN ok THEN '' END AS breadcrumbs, CASE WHEN ok THEN headings END AS headings, CASE WHEN ok THEN text END AS text FROM k"""
)
def html_blog(spark: SparkSession, d: str) -> DataFrame:
    """Blog articles as HTML and back: entry title, body, noise, length gate."""
    rows = table(spark, d, "raw_page").filter("source = 'blog'")
    html = _html("<body><h1>Site</h1><header><h1 class='big entry-title'>", escaped(F.col("title")), "</h1></header><article><h2>outside</h2><div class='entry-content'>", _heads(), _paragraphs(), "<div class='share-buttons'>Share</div><style>p {}</style><div class=\"author-bio\"><p>By me</p></div></div></article></body>")
    return _extracted(rows.select("url", html.alias("html")), "blog")


@query(
    f"""WITH p AS (SELECT url, {_STRIP("coalesce(title, '')")} AS title, array_to_string(list_concat({_OWN}, CASE WHEN len({_OWN}) > 0 THEN ['---'] ELSE [] END, ['thanks', 'a lot']), chr(10)) AS text FROM raw_page WHERE source = 'community')
SELECT url, {_PAGE_KEY('community_')} AS key, 'community' AS source, title <> '' AS ok, nullif(title, '') AS title, CASE WHEN title <> '' THEN '' END AS breadcrumbs, CASE WHEN title <> '' THEN '1:' || title END AS headings, CASE WHEN title <> '' THEN title || chr(10) || text END AS text FROM p"""
)
def html_threads(spark: SparkSession, d: str) -> DataFrame:
    """Threads as HTML and back: subject, messages with rules between, empty messages dropped."""
    rows = table(spark, d, "raw_page").filter("source = 'community'")
    html = _html("<body><h1>Board</h1><span class='lia-message-subject'>", escaped(F.col("title")), "</span><div class='message-body'>", _paragraphs(), "</div><div class='message-body'> </div><div class='lia-message-body'>thanks<br>a lot</div><main>area</main></body>")
    return _extracted(rows.select("url", html.alias("html")), "community")


# -- sitemaps: entries lie in sixteen leaves by the length of their address

LEAVES, POSTS = 16, 12
_XMLNS = ' xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'


@F.pandas_udf(BinaryType())
def _zipped(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: gzip.compress(t.encode()))


def _sitemaps(spark: SparkSession, d: str) -> DataFrame:
    """(url, content): leaves, an index of all of them, and compressed indexes below a root that also names itself."""
    rows = table(spark, d, "url_entry").select(F.pmod(F.length("url"), F.lit(LEAVES)).alias("k"), F.col("url").alias("u"), F.nullif(F.trim("lastmod"), F.lit("")).alias("m"))
    entry = F.concat(F.lit("<url>\n<loc>"), escaped(F.coalesce("u", F.lit(""))), F.lit("</loc>"), F.coalesce(F.concat(F.lit("<lastmod>"), "m", F.lit("</lastmod>")), F.lit("")), F.lit("</url>"))
    name = F.concat(F.lit("https://maps.example/"), F.when(F.col("k") < POSTS, F.lit("post")).otherwise(F.lit("page")), F.lit("-sitemap-"), F.col("k"), F.lit(".xml"))
    leaves = rows.filter("k is not null").groupBy("k").agg(F.array_join(F.collect_list(entry), "").alias("body")).select(name.alias("url"), F.encode(F.concat(F.lit(f"<?xml version='1.0'?><urlset{_XMLNS}>"), "body", F.lit("</urlset>")), "UTF-8").alias("content"))
    leaf = lambda k: f"https://maps.example/{'post' if k < POSTS else 'page'}-sitemap-{k}.xml"
    index = lambda names: f"<sm:sitemapindex xmlns:sm='x'>{''.join(f'<sm:sitemap><sm:loc> {n} </sm:loc></sm:sitemap>' for n in names)}</sm:sitemapindex>"
    level = lambda n: f"https://maps.example/level-{n}.xml.gz"
    own = [("https://maps.example/index.xml", index(map(leaf, range(LEAVES)))), ("https://maps.example/root.xml", index([*map(level, range(4)), "https://maps.example/root.xml"]))]
    plain = spark.createDataFrame(own, "url string, body string").select("url", F.encode("body", "UTF-8").alias("content"))
    packed = spark.createDataFrame([(level(n), index(leaf(k) for k in range(LEAVES) if k % 4 in (n, (n + 1) % 4))) for n in range(4)], "url string, body string").select("url", _zipped("body").alias("content"))
    return leaves.unionByName(plain).unionByName(packed)


_ENTRY = "SELECT url, nullif(trim(lastmod), '') AS lastmod FROM url_entry WHERE url <> ''"


@query(f"{_ENTRY} AND length(url) % 16 = 5 AND starts_with(url, 'https://h')")
def sitemap_flat(spark: SparkSession, d: str) -> DataFrame:
    return sitemap.flat(_sitemaps(spark, d), "https://maps.example/post-sitemap-5.xml", "https://h")


@query(f"{_ENTRY} AND length(url) % 16 < 12")
def sitemap_of_index(spark: SparkSession, d: str) -> DataFrame:
    return sitemap.of_index(_sitemaps(spark, d), "https://maps.example/index.xml")


@query(f"{_ENTRY} AND contains(url, '/t5/')")
def sitemap_nested(spark: SparkSession, d: str) -> DataFrame:
    """Three levels; every leaf is named by two compressed indexes and visited once."""
    return sitemap.nested(_sitemaps(spark, d), "https://maps.example/root.xml")


@query(f"SELECT source, count(DISTINCT url) AS found FROM (SELECT CASE WHEN contains(url, '/t5/') THEN 'community' WHEN contains(url, '/news/') THEN 'blog' ELSE 'docs' END AS source, url FROM url_entry WHERE url <> '' UNION ALL SELECT 'github', url FROM (SELECT url, path FROM repo_file) WHERE {_DOC_PATH}) GROUP BY source")
def found_by_source(spark: SparkSession, d: str) -> DataFrame:
    """How many addresses each source offers."""
    kind = F.when(F.contains("url", F.lit("/t5/")), "community").when(F.contains("url", F.lit("/news/")), "blog").otherwise("docs")
    listed = table(spark, d, "url_entry").select(kind.alias("source"), "url")
    files = table(spark, d, "repo_file").filter(is_doc_path(F.col("path"))).select(F.lit("github").alias("source"), "url")
    return found_counts(listed.unionByName(files))


# -- repositories: the tree of a repository as the listing of one of its branches

_SEEN = "length(repo) % 5 <> 0"


def _listings(spark: SparkSession, d: str) -> DataFrame:
    """Repositories with an even name are on main, odd ones on master (main answers 404); every fifth fails on main."""
    n = F.length("repo")
    trees = table(spark, d, "repo_file").groupBy("repo").agg(F.to_json(F.struct(F.collect_list(F.struct("path", F.lit("blob").alias("type"))).alias("tree"))).alias("body"))
    main = trees.select("repo", F.lit("main").alias("branch"), F.when(n % 5 == 0, 500).when(n % 2 == 0, 200).otherwise(404).alias("status"), F.when(n % 2 == 0, F.col("body")).alias("body"))
    return main.unionByName(trees.select("repo", F.lit("master").alias("branch"), F.lit(200).alias("status"), "body"))


@query(f"SELECT repo, path, 'https://git.example/' || repo || '/blob/main/' || path AS url, 'https://raw.git.example/' || repo || '/main/' || path AS raw_url FROM repo_file WHERE {_SEEN} AND {_DOC_PATH}")
def repo_listings(spark: SparkSession, d: str) -> DataFrame:
    return repo.doc_files(_listings(spark, d), "https://git.example", "https://raw.git.example")


@query(
    rf"""WITH f AS (SELECT DISTINCT repo, path, 'https://git.example/' || repo || '/blob/main/' || path AS url FROM repo_file WHERE {_SEEN} AND {_DOC_PATH}),
t AS (SELECT url, arg_max(text, page_id) AS text FROM raw_page WHERE source = 'github' AND text IS NOT NULL GROUP BY url)
SELECT url, 'github' AS source, text, repo || ' | ' || path AS breadcrumbs, len(list_filter(regexp_split_to_array(text, '{_LINE_END}'), lambda x: regexp_matches(x, '^#{{1,4}}\s+.+'))) AS headings,
split_part(repo, '/', -1) || ': ' || coalesce({_STRIP("regexp_replace(list_filter(regexp_split_to_array(text, '" + _LINE_END + "'), lambda x: starts_with(x, '# '))[1], '^[# ]+', '')")}, split_part(replace(path, '.md', ''), '/', -1)) AS title
FROM f JOIN t USING (url) WHERE length({_STRIP('text')}) >= 50"""
)
def repo_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Markdown of listed files: from main, or from master where main has none; titles, headings, length gate."""
    files = repo.doc_files(_listings(spark, d), "https://git.example", "https://raw.git.example").distinct()
    last = table(spark, d, "raw_page").filter("source = 'github' and text is not null").groupBy("url").agg(F.max("page_id").alias("page_id"), F.max_by("text", "page_id").alias("body"))
    raw = F.replace(F.replace("url", F.lit("https://git.example/"), F.lit("https://raw.git.example/")), F.lit("/blob/main/"), F.when(F.col("page_id") % 2 == 0, F.lit("/main/")).otherwise(F.lit("/master/")))
    fetched = last.select(raw.alias("raw_url"), F.lit(200).alias("status"), "body")
    rows = repo.markdown_pages(repo.markdown_bodies(files, fetched))
    return rows.select("url", "source", "text", F.array_join("breadcrumbs", " | ").alias("breadcrumbs"), F.size("headings").cast("long").alias("headings"), "title")


@query("SELECT url, coalesce(source, 'docs') AS source, title, text, coalesce(len(headings), 0) AS headings FROM raw_page")
def raw_page_files(spark: SparkSession, d: str) -> DataFrame:
    """Page files, one JSON document each, and back."""
    path = shared_path(spark, "page-files")
    table(spark, d, "raw_page").select("url", "title", "breadcrumbs", "headings", "text", "source", "scraped_at").write.option("maxRecordsPerFile", 1).json(path)
    rows = pages.read_raw_pages(spark, path)
    return rows.select("url", F.coalesce("source", F.lit("docs")).alias("source"), "title", "text", F.when(F.col("headings").isNull(), 0).otherwise(F.size("headings")).cast("long").alias("headings"))

