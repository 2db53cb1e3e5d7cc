"""Text expressions: everything here is a Column built of built-in functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python strips it, fixed: Unicode spaces and the four information separators.
SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: A token of the additive fallback tokenizer: a run of letters, digits and underscores, or one other visible character.
TOKEN = r"[\p{L}\p{N}_]+|[^\s\x0b\x1c-\x1f\x{85}\p{Z}\p{L}\p{N}_]"
#: Where texts are cut into pieces, the coarsest first. Fixed values.
SEPARATORS = ("\n\n", "\n", ". ", " ")
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def strip(text: Column) -> Column:
    """Without leading and trailing white space of any script; the pattern only runs where an end has some."""
    ends = F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1)))
    return F.when(ends.rlike(f"[{SPACE}]"), F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")).otherwise(text)


def clean_lines(text: Column) -> Column:
    """Every line stripped, empty lines dropped; NULL if nothing is left."""
    lines = F.filter(F.transform(F.split(text, LINE_END), strip), lambda x: x != "")
    return F.nullif(F.array_join(lines, "\n"), F.lit(""))


def url_key(url: Column, site_prefix: Column, source_prefix: Column) -> Column:
    """File-safe key of an address: site prefix dropped, slashes trimmed, other characters than letters, digits, _ and - replaced."""
    path = F.regexp_replace(F.replace(url, site_prefix, F.lit("")), "^/+|/+$", "")
    return F.concat(source_prefix, F.regexp_replace(path, r"[^\p{L}\p{N}_\-]", "_"), F.lit(".json"))


def token_count(text: Column) -> Column:
    """Tokens of the fallback tokenizer; additive over white-space joins."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0))


def token_tail(text: Column, n: int) -> Column:
    """The last ``n`` fallback tokens with what stands between them, '' if the text has no more than n."""
    units = F.regexp_extract_all(text, F.lit(rf"(?:{TOKEN})[{SPACE}]*"), 0)
    # a lambda over one element, so that the units are found once; they begin with a token, so only the end is stripped
    tail = F.transform(F.array(units), lambda u: F.when(F.size(u) > n, F.regexp_replace(F.array_join(F.slice(u, -n, n), ""), f"[{SPACE}]+$", "")).otherwise(F.lit("")))
    return tail[0]


def _led_by(sep: str):
    return lambda piece, i: F.when(i == 0, piece).otherwise(F.concat(F.lit(sep), piece))


def split_by_separators(text: Column) -> Column:
    """Pieces at the first separator present (blank line, line end, full stop, space); separators stay in front of later pieces, blank pieces go."""
    out = F.array(text)
    for sep in reversed(SEPARATORS):
        kept = F.transform(F.split(text, re.escape(sep), -1), _led_by(sep))
        out = F.when(F.contains(text, F.lit(sep)), F.filter(kept, lambda p: p.rlike(f"[^{SPACE}]"))).otherwise(out)
    return out


def greedy_merge(pieces: Column, limit: int) -> Column:
    """Neighbouring pieces joined by a line end while the joined text has at most ``limit`` tokens.

    Counts are additive, so running totals replace counting the growing text again, and
    only the ends that a join makes are stripped, not the growing text.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("text"), F.lit(0).alias("n"), F.lit(False).alias("joined"))
    led = lambda x: F.when(F.left(x, F.lit(1)).rlike(f"[{SPACE}]"), F.regexp_replace(x, f"^[{SPACE}]+", "")).otherwise(x)
    trailed = lambda x: F.when(F.right(x, F.lit(1)).rlike(f"[{SPACE}]"), F.regexp_replace(x, f"[{SPACE}]+$", "")).otherwise(x)

    def step(acc: Column, item: Column) -> Column:
        piece, n = item["piece"], item["n"]
        fits = acc["n"] + n <= limit
        held = F.when(acc["joined"], acc["text"]).otherwise(led(acc["text"]))
        joined = F.when(acc["text"] == "", piece).otherwise(F.concat(held, F.lit("\n"), trailed(piece)))
        return F.struct(
            F.when(fits | (acc["text"] == ""), acc["done"]).otherwise(F.array_append(acc["done"], acc["text"])).alias("done"),
            F.when(fits, joined).otherwise(piece).alias("text"),
            F.when(fits, acc["n"] + n).otherwise(n).alias("n"),
            (fits & (acc["text"] != "")).alias("joined"),
        )

    counted = F.transform(pieces, lambda p: F.struct(p.alias("piece"), token_count(p).alias("n")))
    return F.aggregate(counted, start, step, lambda acc: F.when(acc["text"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["text"])))


def is_doc_path(path: Column) -> Column:
    """Markdown files that document a repository. The directories and file names."""
    named = path.isin("README.md", "ARCHITECTURE.md", "CONTRIBUTING.md", "HACKING.md")
    inside = path.startswith("doc/") | path.startswith("docs/") | path.startswith("documentation/")
    return path.endswith(".md") & (named | inside | path.endswith("/README.md"))


def markdown_title(text: Column, repo: Column, path: Column) -> Column:
    """Name of the repository and the first ``# `` heading, else the file name without its suffix."""
    name = F.element_at(F.split(F.replace(path, F.lit(".md"), F.lit("")), "/"), -1)
    first = F.try_element_at(F.filter(F.split(text, LINE_END), lambda x: x.startswith("# ")), F.lit(1))
    heading = strip(F.regexp_replace(first, "^[# ]+", ""))
    return F.concat(F.element_at(F.split(repo, "/"), -1), F.lit(": "), F.coalesce(heading, name))


def markdown_headings(text: Column) -> Column:
    """(level, text) of the lines with one to four # and white space."""
    lines = F.filter(F.split(text, LINE_END), lambda x: x.rlike(r"^#{1,4}\s+.+"))
    return F.transform(
        lines,
        lambda x: F.struct(F.length(F.regexp_extract(x, r"^(#{1,4})\s", 1)).alias("level"), strip(F.regexp_extract(x, r"^#{1,4}\s+(.+)", 1)).alias("text")),
    )
