"""Main text of web pages by the contiguous run of tokens with the greatest score.

Words score positive and tags negative, by weights that pages with a marked article teach: the
logarithm of the odds that such a word or tag is inside the article. A linear scan finds the
run of greatest sum, and its blocks are the text. What elements, roles and class names tell to
be a menu, form, notice, comment or the like has no tokens and no text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import WordCache, map_arrow, slices, unused

#: Pages (expected) that the weights are learned from, of those with a marked article.
SAMPLE_PAGES = 4000
#: A word scores LEAST to MOST, a tag -MOST to -LEAST; no run goes through the start or end of an article.
LEAST, MOST, WALL = 0.1, 4.0, 1e9

# Elements of HTML by what they are to a text.
RAW = "script style title textarea iframe noembed noframes".split()
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
SPACES = set("br td th img input hr area base col embed link meta param source track".split())
TEXTUAL = set("p h1 h2 h3 h4 h5 h6 blockquote pre dt dd figcaption".split())
MIXED = set("li ul ol dl div section main article table thead tbody tfoot tr caption figure details summary center body html address hgroup".split())
MAIN, CLOSES_ITSELF = {"article", "main"}, set("p li dt dd tr h1 h2 h3 h4 h5 h6".split())
ASIDE = set("nav header footer aside form menu dialog button fieldset noscript template svg math select object canvas video audio head".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup "
    "sidebar menu navbar nav navigation breadcrumb breadcrumbs pagination pager share sharing social comment comments disqus respond reply replies header masthead footer related recommended widget widgets login search toolbar".split()
)
REMARKS = {"comment", "comments", "reply", "replies"}
#: A class that begins so says what a page has or lacks, and headers of these are part of the text.
HAVING, OWN = {"has", "with", "no", "without", "is", "js"}, {"article", "entry", "post", "content", "story", "page-title"}

_RAW = "|".join(RAW)
_QUOTED = r"""(?:[^<>"']|"[^"]{0,4096}"|'[^']{0,4096}')*+>"""
_TOKEN = re.compile(
    rf"<!--(?:.*?-->|.*)|<(?P<raw>{_RAW})\b{_QUOTED}(?:.*?</(?P=raw)\b[^<>]*>|.*)|<[a-z]{_QUOTED}|</?[a-z][^<>]*>|<[!?/][^<>]*>|[^<]+|<",
    re.S | re.I,
)
_NAME = re.compile(r"</?([a-z][a-z0-9:-]*)", re.I)
_ATTRIBUTE = re.compile(r"""[\s"'/](class|id|role|style|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?(?=[\s>/"'])""", re.I)
_PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")


def _told_aside(name: str) -> bool:
    parts = [p.lower() for p in _PARTS.split(name) if p]
    if not parts or parts[0] in HAVING or (parts[-1] == "header" and parts[0] in OWN):
        return False
    return parts[0] in NAMES or parts[-1] in NAMES


def read_tag(tag: str) -> tuple[str, bool, bool]:
    """(name, is an end, is aside by its own name, role or classes)."""
    name = _NAME.match(tag)[1].lower()
    if tag[1] == "/":
        return name, True, False
    aside = name in ASIDE
    if name in INLINE or name in ("html", "body", "main") or name in SPACES:
        return name, False, False
    for key, a, b, c in _ATTRIBUTE.findall(tag):
        key, value = key.lower(), html.unescape(a or b or c)
        if key == "hidden":
            aside = True
        elif key == "style":
            aside |= "display:none" in value.replace(" ", "").lower()
        elif key == "role":
            aside |= value.strip().lower() in ROLES
        elif name == "article":
            aside |= any(p.lower() in REMARKS for n in value.split() for p in _PARTS.split(n))
        else:
            aside |= any(map(_told_aside, value.split()))
    return name, False, aside


def _known(name: str) -> str:
    return name if name in TEXTUAL or name in MIXED or name in INLINE or name in SPACES else "other"


@dataclass
class Page:
    """Tokens of a page in order: kind, number (words of a piece of text; 1 for a tag), block (none: -1), article and main element (none: 0)."""

    kinds: list[str] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    blocks: list[int] = field(default_factory=list)
    articles: list[int] = field(default_factory=list)
    mains: list[int] = field(default_factory=list)
    texts: list[list[str]] = field(default_factory=list)

    def places(self) -> list[int]:
        """The article of each token; where a page has none, its main element."""
        return self.articles if any(self.articles) else self.mains


def read_page(source: str, tags: WordCache | None = None) -> Page:
    """Tokens of ``source``. Elements left open end with what holds them; inside what is aside there are no tokens."""
    page, tags = Page(), tags or WordCache(read_tag)
    stack: list[tuple[str, bool, int, int]] = []  # name, aside, article, main
    open_: Counter = Counter()
    aside = article = main = made = 0
    link, fresh = False, True

    def add(kind: str, size: int, block: int) -> None:
        page.kinds.append(kind)
        page.sizes.append(size)
        page.blocks.append(block)
        page.articles.append(article)
        page.mains.append(main)

    def pop() -> None:
        nonlocal aside, article, main
        name, was_aside, *_ = stack.pop()
        open_[name] -= 1
        aside -= was_aside
        article, main = stack[-1][2:] if stack else (0, 0)

    for m in _TOKEN.finditer(source):
        token = m[0]
        if m["raw"] or token.startswith("<!"):
            continue
        if token[0] != "<" or len(token) == 1 or not _NAME.match(token):
            if token[0] == "<" and len(token) > 1:
                continue
            if aside:
                continue
            if fresh:
                page.texts.append([])
                fresh = False
            page.texts[-1].append(token)
            words = len(token.split())
            if words:
                add(f"w:{_known(stack[-1][0]) if stack else 'body'}{':a' * link}", words, len(page.texts) - 1)
            continue
        name, end, own_aside = tags[token] if len(token) < 256 else read_tag(token)
        if name in INLINE or name in SPACES:
            if name in SPACES and not aside and not fresh:
                page.texts[-1].append(" ")
            if name == "a":
                link = not end
            if name == "hr":
                fresh = True
            if not aside:
                add(f"/{name}" if end else name, 1, -1)
            continue
        link, fresh = False, True
        if end:
            if not open_[name]:
                continue
            if name not in MAIN:
                # The end of something outside does not end an article.
                for held in reversed(stack):
                    if held[0] == name or held[0] in MAIN:
                        break
                if held[0] != name:
                    continue
            if not aside and name != "article":
                add("/" + _known(name), 1, -1)
            was = article
            while True:
                last = stack[-1][0]
                pop()
                if last == name:
                    break
            if article != was and not aside:
                add("/article", 1, -1)
            continue
        if stack and (stack[-1][0] == "p" or (stack[-1][0] == name and name in CLOSES_ITSELF)):
            pop()
        if name == "header" and article:
            own_aside = False
        if aside and not own_aside and (name in MAIN or name == "body"):
            # What was left open does not hold the article, or the page.
            stack[:] = [(n, False, a, b) for n, _, a, b in stack]
            aside = 0
        if not aside and not own_aside:
            add(_known(name), 1, -1)
        if name in MAIN and not own_aside and not aside:
            made += 1
            article, main = (made, main) if name == "article" else (article, made)
        stack.append((name, own_aside, article, main))
        open_[name] += 1
        aside += own_aside
    return page


def prior(kind: str) -> tuple[float, float]:
    """What is supposed of a kind before pages teach it: how many were seen inside and outside of articles."""
    name = kind.removeprefix("w:").removeprefix("/").removesuffix(":a")
    if kind.startswith("w:"):
        return (1, 4) if kind.endswith(":a") else (8, 2) if name in TEXTUAL else (4, 3)
    return (4, 2) if name in TEXTUAL or name in INLINE or name in SPACES else (1, 2) if name in MIXED else (1, 8)


@dataclass
class Weights:
    """Scores of kinds of tokens, from how often each was seen inside and outside of articles."""

    seen: dict[str, tuple[int, int]] = field(default_factory=dict)

    def __post_init__(self):
        self.score = WordCache(self._score)

    def _score(self, kind: str) -> float:
        if kind in ("article", "/article"):
            return -WALL
        (a, b), (inside, outside) = prior(kind), self.seen.get(kind, (0, 0))
        odds = math.log((inside + a) / (outside + b))
        return min(max(odds, LEAST), MOST) if kind.startswith("w:") else -min(max(-odds, LEAST), MOST)


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the greatest sum, the first of equal ones; (0, 0) if none is positive."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, at = total, (start, i + 1)
    return at


def main_text(source: str | None, weights: Weights, tags: WordCache | None = None) -> str:
    """The blocks of the best run, white space in each made one space, joined by empty lines.

    A block that the run cuts is whole in the text; if the run is inside an article (or the main element), all of
    the article's blocks are.
    """
    page = read_page(source or "", tags)
    start, end = best_run([weights.score[k] * n for k, n in zip(page.kinds, page.sizes, strict=True)])
    if start == end:
        return ""
    places = page.places()
    held = places[start] if places[start] == places[end - 1] else 0
    among = (b for b, p in zip(page.blocks, places, strict=True) if p == held) if held else page.blocks[start:end]
    texts = (" ".join(html.unescape("".join(page.texts[b])).split()) for b in sorted(set(among) - {-1}))
    return "\n\n".join(filter(None, texts))


def seen_kinds(page: Page) -> Counter | None:
    """How many words and tags of each (kind, inside) a page teaches; None if it has not one article (or main element)."""
    places = page.places()
    if len(set(places) - {0}) != 1:
        return None
    found: Counter = Counter()
    for kind, size, place in zip(page.kinds, page.sizes, places, strict=True):
        found[kind, place > 0] += size
    return found


def train(pages: DataFrame, sample: int = SAMPLE_PAGES, html_col: str = "html") -> Weights:
    """Weights from pages with exactly one article element (or, without any, one main element).

    All pages are read if there are up to ``sample``, else those whose hash is below a bound that lets ``sample``
    be expected. Pages without such a mark, null and empty ones teach nothing; without any, the weights
    are those of `prior`. The driver sees a row for each kind of token, which elements of HTML bound.
    """
    rows = pages.select(F.col(html_col).alias("html"))
    n = rows.count()
    if n > sample:
        rows = rows.where(F.pmod(F.xxhash64("html"), F.lit(1 << 31)) < int((1 << 31) * sample / n))

    def run(batches):
        found, tags = Counter(), WordCache(read_tag)
        for batch in batches:
            for source in batch["html"].to_pylist():
                tags.trim()
                found.update(seen_kinds(read_page(source or "", tags)) or {})
        yield pa.RecordBatch.from_pylist([{"kind": k, "inside": i, "n": c} for (k, i), c in found.items()], pa.schema([("kind", pa.string()), ("inside", pa.bool_()), ("n", pa.int64())]))

    counts = rows.mapInArrow(run, "kind string, inside boolean, n long").groupBy("kind").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("b"))
    return Weights({r.kind: (r.a, r.b) for r in counts.collect()})


def extract_main_text(pages: DataFrame, weights: Weights, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` without ``html_col`` and with ``out_col``, the main text of the whole page (empty if null or none), and n_chars, its code points.

    Each row stays, repeated ones too; other columns pass unread, but a former ``out_col`` or ``n_chars`` is replaced.
    An empty table gives no rows.
    """
    kept = [c for c in pages.columns if c.lower() not in {html_col.lower(), out_col.lower(), "n_chars"}]
    source = unused("html", pages.select(*kept))
    rows = pages.select(*kept, F.col(html_col).alias(source))
    seen = weights.seen

    def task():
        known, tags = Weights(seen), WordCache(read_tag)

        def work(batch: pa.RecordBatch):
            for part in slices(batch, source):
                tags.trim()
                texts = [main_text(s, known, tags) for s in part[source].to_pylist()]
                yield pa.table([*(part[c] for c in kept), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*kept, out_col, "n_chars"])

        return work

    schema = rows.select(*kept, F.lit("").alias(out_col), F.lit(0).cast("long").alias("n_chars")).schema
    return map_arrow(rows, task, schema)
