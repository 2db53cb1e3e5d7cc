"""HTML to records with the standard parser: a small tree, simple selectors, three page kinds."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.schemas import EXTRACTED

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Start tags that end an open element of the same group. Fixed values of the HTML standard.
ENDS = {"p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()), "li": frozenset(["li"]), "td": frozenset("td th tr".split()), "th": frozenset("td th tr".split()), "tr": frozenset(["tr"]), "dt": frozenset("dt dd".split()), "dd": frozenset("dt dd".split()), "option": frozenset(["option"])}
RAW = frozenset(("script", "style", "template", "noscript"))


class Node:
    __slots__ = ("attrs", "kids", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order."""
        stack = list(reversed(self.kids))
        while stack:
            n = stack.pop()
            if isinstance(n, Node):
                yield n
                stack.extend(reversed(n.kids))

    def strings(self) -> Iterator[str]:
        stack = list(reversed(self.kids))
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                yield n
            elif n.tag not in RAW:
                stack.extend(reversed(n.kids))

    def text(self, sep: str = "", strip: bool = False) -> str:
        parts = (s.strip() for s in self.strings()) if strip else self.strings()
        return sep.join(s for s in parts if s or not strip)

    def drop(self) -> None:
        if self.parent is not None:
            self.parent.kids.remove(self)
            self.parent = None


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        while self.at.parent is not None and tag in ENDS.get(self.at.tag, ()):
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.kids.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self.at = n.parent

    def handle_data(self, data: str) -> None:
        self.at.kids.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


_SIMPLE = re.compile(r"^([a-z][a-z0-9]*)?((?:\.[\w-]+)*)((?:\[[\w-]+\*?=\"[^\"]*\"\])*)$")


def _matches(node: Node, simple: str) -> bool:
    m = _SIMPLE.match(simple)
    if m is None:
        raise ValueError(f"selector not supported: {simple}")
    tag, classes, attrs = m.groups()
    if tag and node.tag != tag:
        return False
    own = node.attrs.get("class", "").split()
    if any(c not in own for c in classes.split(".")[1:]):
        return False
    for name, part, value in re.findall(r"\[([\w-]+)(\*?)=\"([^\"]*)\"\]", attrs):
        have = node.attrs.get(name)
        if have is None or (value not in have if part else value != have):
            return False
    return True


def select(root: Node, selector: str) -> list[Node]:
    """Elements below ``root`` that match a comma list of (descendant chains of) simple selectors, in document order."""
    chains = [s.split() for s in selector.split(",")]

    def fits(node: Node, chain: list[str]) -> bool:
        if not _matches(node, chain[-1]):
            return False
        up, rest = node.parent, chain[:-1]
        while rest and up is not None:
            if _matches(up, rest[-1]):
                rest = rest[:-1]
            up = up.parent
        return not rest

    return [n for n in root.walk() if any(fits(n, c) for c in chains)]


def first(root: Node, *selectors: str) -> Node | None:
    """The first element of the first selector that has one."""
    return next((found[0] for s in selectors if (found := select(root, s))), None)


def tidy(text: str) -> str:
    return "\n".join(line for x in text.splitlines() if (line := x.strip()))


#: Selectors of the page kinds, fixed values.
MAIN = ("div.search-content.content", "main", '[role="main"]', "article")
NOISE = "nav, aside, footer, .cookie-banner, .feedback-section, .sidebar, .on-this-page"
CRUMBS = ('[aria-label="breadcrumb"]', ".breadcrumb")
ARTICLE = ("article .entry-content", "article", ".post-content", '[class*="article-body"]')
ARTICLE_NOISE = "nav, aside, .share-buttons, .related-posts, .author-bio, .comments, script, style"
SUBJECT = (".lia-message-subject", "h1")
MESSAGES = ".lia-message-body, .message-body, .lia-quilt-forum-message"
THREAD = (".lia-body-content", '[role="main"]', "main")
THREAD_NOISE = "nav, aside, .sidebar, .lia-component-common-widget-kudos"


def _headings(root: Node) -> list[dict]:
    return [{"level": int(h.tag[1]), "text": h.text(strip=True)} for h in select(root, "h1, h2, h3, h4")]


def docs_page(html: str) -> dict | None:
    """Title, breadcrumbs, headings and text of a docs page; None without a container or text."""
    root = parse(html)
    main = first(root, *MAIN)
    if main is None:
        return None
    for node in select(main, NOISE):
        node.drop()
    head = first(root, "h1", "title")
    crumbs = first(root, *CRUMBS)
    trail = [t for n in select(crumbs, "a, span") if (t := n.text(strip=True))] if crumbs is not None else []
    headings = _headings(main)
    for pre in select(main, "pre"):
        pre.kids = [f"\n```\n{pre.text()}\n```\n"]
    text = tidy(main.text("\n"))
    return {"title": head.text(strip=True) if head is not None else "", "breadcrumbs": trail, "headings": headings, "text": text} if text else None


def blog_page(html: str, least: int = 100) -> dict | None:
    """An article; None without a title, a body or ``least`` characters."""
    root = parse(html)
    head, body = first(root, "h1.entry-title", "h1"), first(root, *ARTICLE)
    title = head.text(strip=True) if head is not None else ""
    if not title or body is None:
        return None
    for node in select(body, ARTICLE_NOISE):
        node.drop()
    text = tidy(body.text("\n", strip=True))
    return {"title": title, "breadcrumbs": [], "headings": _headings(body), "text": text} if len(text) >= least else None


def thread_page(html: str) -> dict | None:
    """A forum thread: the title, then all messages with rules between; else the main area."""
    root = parse(html)
    head = first(root, *SUBJECT)
    title = head.text(strip=True) if head is not None else ""
    if not title:
        return None
    posts = [t for n in select(root, MESSAGES) if (t := n.text("\n", strip=True))]
    if not posts and (area := first(root, *THREAD)) is not None:
        for node in select(area, THREAD_NOISE):
            node.drop()
        posts = [t] if (t := area.text("\n", strip=True)) else []
    if not posts:
        return None
    return {"title": title, "breadcrumbs": [], "headings": [{"level": 1, "text": title}], "text": tidy(title + "\n\n" + "\n\n---\n\n".join(posts))}


KINDS = {"docs": docs_page, "release-notes": docs_page, "blog": blog_page, "community": thread_page}


def extracted(html: Column, kind: str) -> Column:
    """Record of an HTML column; NULL for pages without content and for NULL."""
    work = KINDS[kind]

    def safe(page: str | None) -> dict | None:
        try:
            return work(page) if page else None
        except (ValueError, RecursionError):
            return None

    @F.pandas_udf(f"struct<ok: boolean, page: struct<{EXTRACTED.replace('title string', 'title: string').replace('breadcrumbs array', 'breadcrumbs: array').replace('headings array', 'headings: array').replace('text string', 'text: string')}>>")
    def run(pages: pd.Series) -> pd.DataFrame:
        got = [safe(p) for p in pages]
        return pd.DataFrame({"ok": [g is not None for g in got], "page": got})

    return run(html)["page"]
