"""Sitemaps, repositories, page files and HTML."""

from __future__ import annotations

import gzip
import json

import pytest
from pyspark.sql import functions as F

from textloom.functions import html as H
from textloom.functions import text as T
from textloom.sources import pages, repo, sitemap

NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'


def _urls(*items):
    body = "".join(f"<url><loc>{u}</loc>{f'<lastmod>{m}</lastmod>' if m else ''}</url>" for u, m in items)
    return f"<?xml version='1.0'?><urlset {NS}>{body}</urlset>".encode()


def _index(*items):
    return (f"<sm:sitemapindex xmlns:sm='x'>" + "".join(f"<sm:sitemap><sm:loc> {u} </sm:loc></sm:sitemap>" for u in items) + "</sm:sitemapindex>").encode()


def test_sitemaps(spark):
    rows = [
        ("flat", _urls(("https://h/docs/a?x=1&amp;y=2", "2024"), ("https://h/x", None), ("", "2024"))),
        ("root", _index("one.gz", "two", "post-sitemap-1", "root")),
        ("one.gz", gzip.compress(_urls(("https://h/t5/a", None)))),
        ("two", _index("three", "one.gz")),
        ("three", _urls(("https://h/t5/b", "2023"), ("https://h/user/c", None))),
        ("post-sitemap-1", _urls(("https://h/t5/p", None), ("https://h/t5/q", None))),
        ("broken.gz", b"<urlset><url><loc>https://h/t5/raw</loc></url></urlset>"),
        ("empty", None),
    ]
    land = spark.createDataFrame(rows, "url string, content binary")
    assert sitemap.flat(land, "flat").collect() == [("https://h/docs/a?x=1&y=2", "2024"), ("https://h/x", None)]
    assert sitemap.flat(land, "flat", "https://h/docs").count() == 1
    assert [r.url for r in sitemap.of_index(land, "root", limit=1).collect()] == ["https://h/t5/p"]
    assert sorted(r.url for r in sitemap.nested(land, "root").collect()) == ["https://h/t5/a", "https://h/t5/b", "https://h/t5/p", "https://h/t5/q"]
    assert sitemap.flat(land, "broken.gz").first().url == "https://h/t5/raw"
    assert sitemap.flat(land, "empty").isEmpty()


def test_repositories(spark):
    tree = json.dumps({"tree": [{"path": p, "type": "blob"} for p in ("README.md", "src/a.py", "docs/x.md", "lib/README.md", "lib/x.md", "HACKING.md")]})
    listings = spark.createDataFrame([("o/a", "main", 200, tree), ("o/b", "main", 404, None), ("o/b", "master", 200, tree), ("o/c", "main", 500, tree), ("o/c", "master", 200, tree)], "repo string, branch string, status int, body string")
    files = repo.doc_files(listings, "https://s", "https://r")
    assert sorted((r.repo, r.path) for r in files.collect()) == [(x, p) for x in ("o/a", "o/b") for p in ("HACKING.md", "README.md", "docs/x.md", "lib/README.md")]
    text = "intro\n# Foo #\n##  Bar \n#Foo\n##### x\n" + "y" * 60
    got = spark.createDataFrame([("https://r/o/a/master/README.md", 200, text), ("https://r/o/a/main/docs/x.md", 200, "short")], "raw_url string, status int, body string")
    pages_ = repo.markdown_pages(repo.markdown_bodies(files, got)).collect()
    assert len(pages_) == 1 and pages_[0].title == "a: Foo #" and pages_[0].url.endswith("/blob/main/README.md")
    assert [(h.level, h.text) for h in pages_[0].headings] == [(1, "Foo #"), (2, "Bar")]


def test_raw_page_files(spark, tmp_path):
    for k in (2, 1):
        (tmp_path / f"p{k}.json").write_text(json.dumps({"url": f"u{k}", "title": "t", "headings": [{"level": 2, "text": "h"}], "breadcrumbs": [], "text": "x"}, indent=2))
    rows = pages.read_raw_pages(spark, str(tmp_path), 1).collect()
    assert [r.url for r in rows] == ["u1"] and rows[0].source is None and rows[0].headings[0].level == 2
    with pytest.raises(FileNotFoundError):
        pages.read_raw_pages(spark, str(tmp_path / "none"))


DOC = """<html><head><title>T</title><script>var x</script></head><body><nav>menu</nav><h1></h1>
<main><nav aria-label="breadcrumb"><a>lost</a></nav><div class="breadcrumb"><a>A</a><span>B</span><span> </span></div>
<h2>Head <b>ing</b></h2><p>one<p>two<pre>if x:
    y

z</pre><div class="sidebar">side</div><footer>f</footer></main>"""


def test_docs_html():
    page = H.docs_page(DOC)
    assert page["title"] == ""  # an empty h1 is taken, not the title element
    assert page["breadcrumbs"] == ["A", "B"] and page["headings"] == [{"level": 2, "text": "Heading"}]
    assert page["text"].split("\n")[-5:] == ["```", "if x:", "y", "z", "```"] and "side" not in page["text"] and "two" in page["text"]
    assert H.docs_page("<body>no container</body>") is None and H.docs_page("<main> </main>") is None


def test_blog_and_thread_html():
    body = "word " * 40
    blog = H.blog_page(f"<h1>x</h1><h1 class='a entry-title'>Ti</h1><article><div class='entry-content'><h3>s</h3>{body}<div class='share-buttons'>no</div></div>")
    assert blog["title"] == "Ti" and blog["headings"] == [{"level": 3, "text": "s"}] and "no" not in blog["text"]
    assert H.blog_page("<h1>Ti</h1><article>short</article>") is None
    thread = H.thread_page("<h1>Q</h1><div class='message-body'>a<br>b</div><div class='lia-message-body'>c</div>")
    assert thread["text"] == "Q\na\nb\n---\nc"
    assert H.thread_page("<h1>Q</h1><main><nav>n</nav>only</main>")["text"] == "Q\nonly"


def test_html_columns(spark):
    land = spark.createDataFrame([("https://h/docs/a-b/c.html?x=1", DOC), ("https://h/e", None)], "url string, html string")
    rows = {r.url: r for r in pages.pages_of_html(land, "docs", "https://h/").collect()}
    assert rows["https://h/docs/a-b/c.html?x=1"].key == "docs_a-b_c_html_x_1.json" and rows["https://h/docs/a-b/c.html?x=1"].ok
    assert rows["https://h/e"].ok is False and rows["https://h/e"].text is None


def test_keys_and_lines(spark):
    df = spark.createDataFrame([("https://h/aé-b/c d",), ("https://h/a/b",), ("https://h/a_b",)], "u string")
    keys = [r[0] for r in df.select(T.url_key(F.col("u"), F.lit("https://h/"), F.lit("blog_"))).collect()]
    assert keys == ["blog_aé-b_c_d.json", "blog_a_b.json", "blog_a_b.json"]
    text = spark.createDataFrame([("  a \r\n\n b   c\x1c",), ("  \n ",), (None,)], "t string")
    assert [r[0] for r in text.select(T.clean_lines(F.col("t"))).collect()] == ["a\nb\nc", None, None]
