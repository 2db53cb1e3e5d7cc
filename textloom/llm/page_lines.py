"""Line features shared by the operators on page bodies (main content, quality statistics)."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import accumulate, repeat

from textloom.llm.text import WORD, fold

#: Scripts written without spaces: each character counts as a word of its own.
UNSPACED = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")
#: Marks of machine output and program text, fixed: log levels, causes, options, calls, assignments, paths.
MACHINE = re.compile(
    r"^\s*(?:ERROR|WARN|WARNING|INFO|DEBUG|TRACE|FATAL|error|warn)\b[: ]\s*\S+|^\s*caused by:|^\s*at [\w.$]+\(|(?:^|\s)--?[a-z][\w-]+(?:\s|=|$).*(?:--|-f\b)|\bexited with (?:status|code) \d+"
    r"|\w\.\w+\([^)]*\)|\w\([\w*]*\) from |^\s*(?:export|set) \w+=|^\s*\w[\w.-]*: [{\[].*[}\]]|^\s*(?:if|for|while|def|class|return|import|from|elif|else)\b.*[:;]$|[{};]\s*$|^\s*\$ \S+|\bafter \d+ ms\b|^\s*</?[a-z][^>]*>|:\s*\"?\$?\{\{?",
    re.I,
)
BULLET = re.compile(r"^\s*(?:([-–—•*·▪◦‣+○●■□✓])|(\(?\d{1,3}[.)\]])|(\[[ xX✓]?\])|(\([a-zA-Z]\)|[a-zA-Z][.)]))\s+")
END = re.compile(r"[.!?…。！？][\"'”’»)\]]*\s*$")
SEPARATOR = re.compile(r"^\s*(?:[-*_=~#]\s*){3,}$")
#: Marks of text decoded with the wrong character set.
BROKEN = re.compile("[\ufffdÃÂ¤€™œ\x80-\x9f]")
GAP = re.compile(r"\S(?: {2,}|\t+)(?=\S)")
SENTENCE_INNER = re.compile(r"[.!?…]\s|[。！？]")
PAIR = re.compile(r"(?:^|[\s,;&|])[\w.\-\"']+\s?(?:=|:=|=>|->)\s?[^\s=]+")
PROSE, LIST, TABLE, JUNK, CODE, SHORT = range(6)
#: Pages from which a site's lines that do not stand are told to be its pages' own.
LARGE_SITE = 20


def tokens(line: str) -> list[str]:
    if line.isascii() or not UNSPACED.search(line):
        return WORD.findall(line.lower())
    out: list[str] = []
    for w in WORD.findall(line.lower()):
        if w.isascii() or not UNSPACED.search(w):
            out.append(w)
        else:
            out.extend(UNSPACED.findall(w))
            out.extend(x for x in UNSPACED.split(w) if x)
    return out


def tags(line: str, host: str, n_tokens: int, from_end: int, lead: bool) -> list[str]:
    """Shape of a line as pseudo-words; they play the part that tags play in marked-up pages."""
    n = len(line)
    out = [f"\1len{min(n.bit_length(), 9)}", "\1end" + ("." if END.search(line) else ":" if line.rstrip().endswith((":", "：")) else "0")]
    if m := BULLET.match(line):
        out.append(f"\1bullet{m.lastindex}{m.group(1) or ''}")
    seps = sum(line.count(x) for x in (" | ", " · ", " › ", " > ", " / "))
    if seps:
        out.append(f"\1sep{min(seps, 3)}")
    if host and host in line.lower():
        out.append("\1host")
    if "©" in line or "(c)" in line.lower():
        out.append("\1mark")
    if from_end <= 2:
        out.append(f"\1last{from_end}")
    if lead:
        out.append("\1lead")
    out.append(f"\1words{min(n_tokens.bit_length(), 7)}")
    return out


def similar(a: set[str], b: set[str]) -> bool:
    """Whether two short lines are the same but for small edits."""
    both = len(a & b)
    return both > 0 and both >= 0.6 * len(a | b)


@dataclass
class LineModel:
    """What is learned from the sample of pages; everything is plain data and small."""

    weight: dict[str, float] = field(default_factory=dict)
    bias: float = 1.0  # without labels a line is taken for content
    openers: frozenset[str] = frozenset()
    followers: dict[str, frozenset[str]] = field(default_factory=dict)
    common: frozenset[str] = frozenset()
    trigram: dict[str, float] = field(default_factory=dict)
    trigram_floor: float = -9.0
    odd_below: float = -7.5
    known: dict[str, float] = field(default_factory=dict, repr=False)  # oddness of words met, up to a bound

    def score(self, toks: list[str]) -> float:
        get = self.weight.get
        return self.bias + sum(map(get, toks, repeat(0.0)))

    def follows(self, before: str, toks: list[str]) -> bool:
        tell = self.followers.get(before)
        return tell is not None and not tell.isdisjoint(toks)

    def oddness(self, word: str) -> float:
        if (value := self.known.get(word)) is None:
            w = f"^{word}$"
            get, floor = self.trigram.get, self.trigram_floor
            value = sum(get(w[i : i + 3], floor) for i in range(len(w) - 2)) / (len(w) - 2) if len(w) >= 4 else floor
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[word] = value
        return value


@dataclass
class Page:
    lines: list[str]
    fixed: list[int]  # 1: content by its form or place, -1: none, 0: open
    folded: list[str]
    code: list[bool]
    words: list[list[str]]


def machine_line(line: str) -> bool:
    """Program text or a log line; several sentences with an end are text, however they look."""
    return not (END.search(line[-12:]) and SENTENCE_INNER.search(line)) and MACHINE.search(line) is not None


def read_page(text: str, title: str | None, headings: list[str] | None) -> Page:
    """Split a page and settle the lines whose part is told by the page itself.

    Content: fenced and machine lines, quotes, separators, the title line, the page's
    headings. No content: the table of contents, that is headings listed before their place.
    """
    lines = text.split("\n")
    folded = [fold(x) for x in lines]
    n = len(lines)
    fixed, code = [0] * n, [False] * n
    fenced = False
    for i, line in enumerate(lines):
        if line.lstrip().startswith("```"):
            fenced = not fenced
            fixed[i], code[i] = 1, True
        elif fenced:
            fixed[i], code[i] = 1, True
        elif machine_line(line):
            fixed[i], code[i] = 1, True
        elif line.lstrip().startswith(">") or SEPARATOR.match(line):
            fixed[i] = 1
    words = [tokens(x) for x in lines]
    title_words = set(tokens(title)) if title else set()
    heads = [set(tokens(h)) for h in headings or () if h]
    exact = {fold(h) for h in headings or () if h}
    bare = [x[m.end() :] if (m := BULLET.match(x)) else x for x in folded]
    # white space and digits apart, a folded line has the words of its line; a list mark may be one of them
    bags: list[set[str] | None] = [set(w if x == b else tokens(b)) if x else None for x, b, w in zip(folded, bare, words)] if title_words or heads else []
    if title_words:
        best = fold(title or "")
        at = next((i for i in range(n) if not fixed[i] and bare[i] == best), None)
        if at is None:
            at = next((i for i in range(n) if not fixed[i] and bags[i] and similar(bags[i], title_words)), None)
        if at is not None:
            fixed[at] = 1
    spots: dict[int, list[int]] = defaultdict(list)
    first_at = {h: k for k, h in reversed(list(enumerate(fold(x) for x in headings or () if x)))}
    for i in range(n if heads else 0):
        if fixed[i] or not bags[i]:
            continue
        if bare[i] in exact:
            spots[first_at[bare[i]]].append(i)
        else:
            for k, h in enumerate(heads):
                if similar(bags[i], h):
                    spots[k].append(i)
                    break
    for where in spots.values():
        for i in where[:-1]:
            fixed[i] = -1
        fixed[where[-1]] = 1
    if not heads:  # no headings delivered: short lines that come twice, the earlier ones side by side
        twice = Counter(b for b, f in zip(bare, fixed) if not f and b and not END.search(b))
        later = {b: i for i, b in enumerate(bare)}
        early = {i for i, b in enumerate(bare) if not fixed[i] and twice[b] == 2 and later[b] != i}
        for i in early:
            if i - 1 in early or i + 1 in early:
                fixed[i], fixed[later[bare[i]]] = -1, 1
    return Page(lines, fixed, folded, code, words)


def title_like(line: str) -> bool:
    """A line that could be a link: no sentence, no list mark, no separator."""
    return line != "" and not BULLET.match(line) and not END.search(line.rstrip("?？")) and not SENTENCE_INNER.search(line.rstrip()[:-1] if line else "") and not SEPARATOR.match(line)


def train(sample: list[tuple[str, list[tuple[str, list[str], int, bool, bool]]]], smooth: float = 1.0, clip: float = 2.5) -> LineModel:
    """Fit the model on labelled pages: (site, [(folded, tokens, label, title_like, code)]).

    label 2: content by form or place, 1: stands once, -1: no content; ``openers`` are
    standing lines after which lines that look like links follow, ``followers`` those after
    which a line with a certain word follows. Lines standing once are content unless an
    opener or its follower explains them.
    """
    follow: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    after: dict[str, Counter] = defaultdict(Counter)
    where: dict[str, Counter] = defaultdict(Counter)
    spread: dict[str, Counter] = defaultdict(Counter)
    n_lines: Counter = Counter()
    for host, lines in sample:
        for i, (folded, toks, label, _, _) in enumerate(lines):
            if label == 1:
                n_lines[host] += 1
                spread[host].update({t for t in toks if t[0] != "\1"})
            if label == -1 and i + 1 < len(lines):
                follow[folded][0] += 1
                if lines[i + 1][2] == 1:
                    follow[folded][1] += lines[i + 1][3]
                    after[folded].update({t for t in lines[i + 1][1] if t[0] != "\1"})
                    where[folded][host] += 1
    model = LineModel()
    model.openers = frozenset(f for f, (n, k) in follow.items() if n >= 3 and k >= 0.5 * n)
    model.followers = {}
    for f, (n, _) in follow.items():
        if n >= 4 and f not in model.openers:
            # a word tells if it comes far more often than in the other lines of the same sites
            usual = lambda t: sum(k * spread[h][t] / n_lines[h] for h, k in where[f].items())  # noqa: B023, E731
            tell = frozenset(t for t, c in after[f].items() if c >= 0.8 * n and usual(t) < 0.25 * c)
            if tell:
                model.followers[f] = tell
    count = {1: Counter(), -1: Counter()}
    total: Counter = Counter()
    pages_of, word_pages = Counter(), defaultdict(Counter)
    trigrams: Counter = Counter()
    for site, lines in sample:
        pages_of[site] += 1
        seen: set[str] = set()
        linked, last = False, ""
        for folded, toks, label, like, code in lines:
            if label == 1 and ((linked and like) or model.follows(last, toks)):
                label = -1
            else:
                linked = folded in model.openers
            last = folded
            side = 1 if label > 0 else -1
            # a title or heading tells nothing of lines whose place is unknown
            if label != 2 or code:
                for t in set(toks):
                    count[side][t] += 1
                total[side] += 1
            if side == 1 and not code and len(toks) >= 8:
                seen.update(t for t in toks if t[0] != "\1")
        word_pages[site].update(seen)
        for w in seen:
            trigrams.update(trigrams_of(w))
    set_weights(model, {t: (count[1][t], count[-1][t]) for t in count[1].keys() | count[-1].keys()}, total[1], total[-1], smooth, clip)
    model.common = frozenset(w for s, c in word_pages.items() if pages_of[s] >= 8 for w, n in c.items() if n >= 0.3 * pages_of[s])
    set_trigrams(model, trigrams)
    set_odd_below(model, ((w, 1) for c in word_pages.values() for w, n in c.items() if n > 1))
    return model


def set_weights(model: LineModel, count: dict[str, tuple[int, int]], content: int, other: int, smooth: float = 1.0, clip: float = 2.5) -> None:
    """Weights of words and tags from the lines of each side that hold them and the lines of each side."""
    if not content or not other:
        return
    for t, (yes, no) in count.items():
        if yes + no >= 4 or t[0] == "\1":
            w = math.log((yes + smooth) / (content + 2 * smooth)) - math.log((no + smooth) / (other + 2 * smooth))
            if abs(w := max(-clip, min(clip, w))) > 0.05:
                model.weight[t] = w
    model.bias = max(-clip, min(clip, math.log(content / other)))


def trigrams_of(word: str) -> list[str]:
    if not word.isalpha() or len(word) < 2 or UNSPACED.search(word):
        return []
    s = f"^{word}$"
    return [s[i : i + 3] for i in range(len(s) - 2)]


def set_trigrams(model: LineModel, trigrams: dict[str, int]) -> None:
    if all_tri := sum(trigrams.values()):
        model.trigram = {t: math.log(c / all_tri) for t, c in trigrams.items()}
        model.trigram_floor = math.log(0.3 / all_tri)


def set_odd_below(model: LineModel, words: Iterable[tuple[str, int]]) -> None:
    """The oddness that one in a hundred of the usual words, each told so many times, lies below."""
    if not model.trigram:
        return
    usual = sorted((model.oddness(w), n) for w, n in words if w.isalpha() and len(w) > 3 and w.isascii())
    left = sum(n for _, n in usual) // 100
    model.odd_below = next((value for (value, _), upto in zip(usual, accumulate(n for _, n in usual)) if upto > left), -99.0)
    model.known.clear()


def variety(toks: list[str], window: int = 12) -> float:
    """Share of different words within windows of a line, so that long paragraphs aren't taken for repetition."""
    return sum(len(set(toks[i : i + window])) for i in range(0, len(toks), window)) / max(1, len(toks))


def kind_of(line: str, code: bool, toks: list[str], model: LineModel) -> tuple[int, int]:
    """(kind, mark): what a line is by itself; mark tells lines of one list or table form apart.

    Tables are settled later, when the lines' delimiters turn out to be aligned.
    """
    if code:
        return CODE, 0
    n = len(line)
    stripped = line.strip()
    if not stripped or SEPARATOR.match(line):
        return SHORT, 0
    known = sum(map(model.common.__contains__, toks))
    share = known / len(toks) if toks else 0.0
    broken = 0 if line.isascii() else len(BROKEN.findall(line))
    ends = END.search(line) is not None
    if share >= 0.34 and (ends or n >= 140) and not broken and "\t" not in line and "   " not in stripped and line.count("|") < 2 and variety(toks) > 0.4:
        return PROSE, 0
    letters = len("".join(toks))
    spaces = n - len("".join(line.split()))
    pipes, tabs, semis, commas, gaps = line.count("|"), line.count("\t"), line.count(";"), line.count(","), len(GAP.findall(line))
    if letters < 0.5 * (n - spaces) and len({c for c in line if not c.isalnum() and not c.isspace()}) >= 7:
        return JUNK, 1
    if pipes >= 2 and share < (0.25 if ends else 0.6):
        return TABLE, 100 + min(pipes, 60)
    if tabs >= 2 and share < (0.25 if ends else 0.6):
        return TABLE, 200 + min(tabs, 60)
    if semis >= 2 and " " not in stripped.replace("; ", ";").split(";")[0].strip() and share < 0.25:
        return TABLE, 300 + min(semis, 60)
    if commas >= 2 and line.count(", ") == 0 and share < 0.25:
        return TABLE, 400 + min(commas, 60)
    pairs = len(PAIR.findall(line))
    if pairs >= 2:
        return TABLE, 600 + min(pairs, 60)
    if gaps >= 2 and "   " in stripped and spaces > 0.15 * n and (share < 0.15 or gaps >= 3):
        return TABLE, 500 + min(gaps, 60)
    longest = max(map(len, stripped.split()))
    if n - letters - spaces > 0.4 * (n - spaces) and n >= 12:
        return JUNK, 1
    if longest >= 36 and UNSPACED.search(line) is None and not stripped.startswith("http"):
        return JUNK, 2
    if len(toks) >= 5 and variety(toks) <= 0.34:
        return JUNK, 3
    if len(toks) >= 6 and sum(len(t) == 1 for t in toks) > 0.7 * len(toks) and not UNSPACED.search(line):
        return JUNK, 4
    if broken >= 4 and broken > 0.04 * n:
        return JUNK, 5
    plain = [t for t in toks if t.isalpha() and len(t) > 2 and not UNSPACED.search(t)]
    if share < 0.12 and len(plain) >= 3 and sum(model.oddness(t) < model.odd_below for t in plain) >= 0.5 * len(plain):
        return JUNK, 6
    marked = BULLET.match(line)
    if marked and (n < 160 if not ends else share < 0.15):
        return LIST, 10 + marked.lastindex
    if commas >= 2 and share < 0.4 and not ends and line.count(", ") == commas and max(len(x.split()) for x in line.split(", ")) <= 6:
        return LIST, 30
    if ends or share >= 0.5 or n >= 140:
        return PROSE, 0
    if toks:
        return LIST, 21 if ":" in line else 22
    return SHORT, 0
