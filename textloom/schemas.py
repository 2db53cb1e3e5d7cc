"""Fixed schemas; nothing is inferred from data."""

from __future__ import annotations

URL_ENTRY = "url string, lastmod string"
REPO_FILE = "repo string, path string, url string, raw_url string"
HEADINGS = "array<struct<level: int, text: string>>"
PAGE = f"url string, title string, breadcrumbs array<string>, headings {HEADINGS}, text string, source string, scraped_at string"
METADATA = "struct<url: string, title: string, section: string, chunk_index: int, source: string>"
CHUNK = f"id string, text string, metadata {METADATA}"
INDEXED = f"{CHUNK}, embedding array<float>"
MESSAGE = "session_id string, pos bigint, role string, content string, sent_at timestamp"
EXTRACTED = f"title string, breadcrumbs array<string>, headings {HEADINGS}, text string"
SITEMAP = "url string, content binary"
