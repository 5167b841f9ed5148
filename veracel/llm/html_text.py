"""Main text of web pages by consensus host paths.

Each page is read into blocks, each with the path of its containers, written as
tags with their classes, digits generalised.  A container scores the share of the
page's running text that stands directly in its paragraphs.  Spark adds these
scores up per host and path; the path with the most votes is the host's, and every
page is read again for what stands in containers on that path.  A page without
that path uses its own best container.  Either is widened to the whole article of the
page: to the article or main element around it, to parents with text of their own
beside it (headings, introductions), and until it holds nearly all running text; the
main heading before it comes along, with what stands between.

Elements that do not belong to an article (by tag, by words in class, id or role, or
hidden) are left out, whatever element it is.  Names of headings are not read, and words
that name parts of articles too (related, discussion, widget) count only where the element
holds links for the most part or next to no text.  Never left out is the one that
holds the page's running text: where next to nothing stands outside them, the largest one stays.

Null and empty pages give the empty text.  Pages with a null url vote under the
empty host.  Ties go to the longer, then the first path.  Repeated rows each get
their own row.  Only page_id, url and html are read.
"""

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, materialize, small_batches
from .url_filter import host_of

TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
TELLING = re.compile(r"class|id|role|hidden|style", re.I)
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

# Elements of HTML by what they do here.
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "select"}
CHROME = {"nav", "footer", "aside", "form", "head", "menu", "dialog", "button", "fieldset"}
CONTAINERS = {"html", "body", "main", "article", "section", "div", "header", "table", "tbody", "tr", "td", "center", "ul", "ol", "dl"} | CHROME
BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dd", "dt", "blockquote", "pre", "figure", "figcaption", "address", "th", "caption", "hr", "summary", "details", "legend", "option"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
ENDED_BY = {"p": BLOCKS | CONTAINERS, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}}
AD_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsored", "sponsor", "promo"}
NOISE_WORDS = AD_WORDS | {
    "nav", "navbar", "navigation", "menu", "sidebar", "footer", "masthead", "topbar", "promotion", "banner", "cookie", "cookies",
    "consent", "notice", "notices", "popup", "modal", "newsletter", "subscribe", "signup", "login", "share", "sharing", "social",
    "comment", "comments", "respond", "breadcrumb", "breadcrumbs", "pagination", "pager", "gdpr", "contentinfo", "complementary",
}
# Words that name parts of articles too: they count only beside a second sign.
WEAK_WORDS = {"side", "search", "discussion", "related", "recommended", "widget", "toolbar", "skip", "legal", "disclaimer", "alert"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
SHORT = 40  # characters of running text of an element that a weak word names as a whole
NEARLY = 0.9  # of a page's running text, held by its article
PASSAGE = 100  # characters of running text that may be an article
WORD = re.compile(r"[a-z]+")
DIGITS = re.compile(r"[0-9]+")


class Block(NamedTuple):
    path: str  # of its containers
    text: str
    linked: int  # characters in links
    tag: str


class _Open(NamedTuple):
    """An open element: every container, and other elements that are marked as noise."""

    tag: str
    path: str
    marks: tuple[int, ...]  # marked elements around and including it
    container: bool


def _attributes(rest: str) -> dict[str, str]:
    return {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(rest)} if TELLING.search(rest) else {}


SURE, MAYBE, NAMED = 3, 2, 1  # a mark of its own; a weak word in a longer name; a weak word as the whole name


def _mark(tag: str, given: dict[str, str], in_article: bool) -> int:
    """What tag and attributes say of an element: 0, or how sure it is that it is not of the article, or unseen.

    Names of headings are made from their words and never read, but for adverts."""
    if tag in CHROME or (tag == "header" and not in_article) or "hidden" in given or UNSEEN.search(given.get("style", "")):
        return SURE
    names = [n for k in ("class", "id", "role") for n in given.get(k, "").lower().split()]
    said = set(names) if tag in ("html", "body", "main", "article") else {w for n in names for w in WORD.findall(n)}
    plain = tag not in HEADINGS and (tag in CONTAINERS or tag in BLOCKS)
    if not said.isdisjoint(NOISE_WORDS if plain else AD_WORDS) or "hidden" in given.get("class", "").lower().split():
        return SURE
    if not plain or said.isdisjoint(WEAK_WORDS):
        return 0
    return NAMED if not WEAK_WORDS.isdisjoint(names) else MAYBE


def _confirmed(mark: int, mass: int, linked: int) -> bool:
    """Whether a second sign stands beside a weak word: most of the text is links, or there is next to none."""
    return mark == SURE or linked >= max(mass, 1) or (mark == NAMED and mass < SHORT)


def _noise(kept: int, total: int, in_article: bool, mass: list[int], tags: list[str], noise: set[int]) -> set[int]:
    """Which of the elements whose marks hold are noise: all, unless next to nothing of the page's running text stands outside them and
    no article or main element holds any; then marks go from the largest element, for as long as it holds most of the text."""
    noise = set(noise)
    may = sorted((i for i in noise if tags[i] not in CHROME - {"form", "fieldset"}), key=lambda i: -mass[i])
    while may and not in_article and kept < (1 - NEARLY) * total and mass[may[0]] >= max(total / 2, PASSAGE):
        noise.discard(may.pop(0))
    return noise


def blocks(page: str) -> list[Block]:
    """Blocks of a page outside noise, in page order."""
    stack = [_Open("", "", (), True)]
    tags, mass, linked, sure = [], [], [], []  # of marked elements: tag, running text, text in links, how sure the mark is
    nested: list[int] = []  # of the marked elements open that are no containers: elements of their own tag inside
    done, pieces = [], []
    in_link, pos, low, block = False, 0, None, ""
    last_gt = page.rfind(">")

    def flush():
        if pieces:
            done.append((stack[-1].path, block, pieces.copy()))
            pieces.clear()

    def say(raw: str):
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            pieces.append((stack[-1].marks, text, in_link))
            n = len(text) - text.count(" ") if text.isspace() else len(text)
            to = linked if in_link else mass
            for i in stack[-1].marks:
                to[i] += n

    def leave(k: int):
        """Close the elements above place k of the stack."""
        for e in stack[k:]:
            if not e.container:
                nested.pop()
        del stack[k:]

    def own_marked(wanted) -> int:
        """Place of the topmost marked element that is wanted, below the next container; 0 for none."""
        k = len(stack) - 1
        while not stack[k].container:
            if wanted(stack[k].tag):
                return k
            k -= 1
        return 0

    while pos < len(page):
        lt = page.find("<", pos)
        if lt < 0 or lt > last_gt:
            say(page[pos:])
            break
        if page.startswith("<!--", lt):
            say(page[pos:lt])
            end = page.find("-->", lt + 4)
            pos = end + 3 if end >= 0 else len(page)
            continue
        m = TAG.match(page, lt)
        if not m:
            if page[lt + 1 : lt + 2] in ("!", "?", "/") or page[lt + 1 : lt + 2].isalpha():
                say(page[pos:lt])
                pos = page.find(">", lt) + 1  # a declaration or a broken tag
            else:
                say(page[pos : lt + 1])
                pos = lt + 1
            continue
        say(page[pos:lt])
        pos = m.end()
        closing, tag, rest = m[1], m[2].lower(), m[3]
        if tag in RAW and not closing and not rest.endswith("/"):
            low = page.lower() if low is None else low
            end = low.find(f"</{tag}", pos)
            pos = page.find(">", end) + 1 if end >= 0 else len(page)
            pos = pos or len(page)
            if tag in ("textarea", "iframe", "select"):
                say(" ")
            continue
        if tag in CONTAINERS:
            flush()
            in_link = False
            if closing:
                if any(e.container and e.tag == tag for e in stack):
                    k = max(i for i, e in enumerate(stack) if e.container and e.tag == tag)
                    leave(k)
                block = ""
        elif tag in BLOCKS:
            flush()
            block = "" if closing else tag
        elif tag == "br":
            say(" ")
        elif tag == "a":
            in_link = not closing
        if closing:
            if tag not in CONTAINERS and not stack[-1].container and (k := own_marked(lambda t: t == tag)):
                at = len(nested) - (len(stack) - k)
                if nested[at]:
                    nested[at] -= 1
                else:
                    leave(k)
            continue
        if not stack[-1].container and (k := own_marked(lambda t: tag in ENDED_BY.get(t, ()))):
            leave(k)
        if rest.endswith("/") or tag in VOID:
            continue
        given, up = _attributes(rest), stack[-1]
        if tag not in CONTAINERS and not given:
            if not up.container and (k := own_marked(lambda t: t == tag)):
                nested[len(nested) - (len(stack) - k)] += 1
            continue
        marked = _mark(tag, given, ">article" in up.path)
        if tag in CONTAINERS:
            name = ".".join([tag, *sorted({DIGITS.sub("#", w) for w in given.get("class", "").lower().split()})])
            path = f"{up.path}>{name}" if up.path else name
        elif marked:
            path = up.path
            nested.append(0)
        else:
            if not up.container and (k := own_marked(lambda t: t == tag)):
                nested[len(nested) - (len(stack) - k)] += 1
            continue
        marks = up.marks
        if marked:
            marks = (*marks, len(mass))
            tags.append(tag), mass.append(0), linked.append(0), sure.append(marked)
        stack.append(_Open(tag, path, marks, tag in CONTAINERS))
    flush()

    def standing(holds: set[int]) -> tuple[int, int, bool]:
        """Running text outside the marks that hold, all running text, and whether an article or main element has some of the former."""
        kept = total = 0
        in_article = False
        for path, _, said in done:
            for marks, text, link in said:
                n = 0 if link or text.isspace() else len(text)
                total += n
                if n and holds.isdisjoint(marks):
                    kept += n
                    in_article = in_article or ">article" in path or ">main" in path
        return kept, total, in_article

    holds = {i for i in range(len(mass)) if _confirmed(sure[i], mass[i], linked[i])}
    kept, total, in_article = standing(holds)
    if not kept and any(sure[i] != SURE for i in holds):  # weak words do not empty a page
        holds = {i for i in holds if sure[i] == SURE}
        kept, total, in_article = standing(holds)
    noise = _noise(kept, total, in_article, mass, tags, holds)
    out = []
    for path, tag, said in done:
        own = [(text, link) for marks, text, link in said if not marks or noise.isdisjoint(marks)]
        if text := " ".join("".join(t for t, _ in own).split()):
            out.append(Block(path, text, sum(len(t) for t, link in own if link), tag))
    return out


def page_scores(found: list[Block]) -> dict[str, float]:
    """Share of the page's running text that stands directly in each container."""
    mass = Counter()
    for b in found:
        mass[b.path] += max(0, len(b.text) - b.linked)
    total = sum(mass.values())
    scores = Counter()
    for path, n in mass.items():
        if total:
            scores[path] += n / total
            up = path.rpartition(">")[0]
            if up:
                scores[up] += n / total / 2  # a parent gathers half of what its children hold
    return scores


def best_path(scores: dict[str, float]) -> str:
    return min(scores, key=lambda p: (-round(scores[p], 9), -len(p), p), default="")


def widened(path: str, found: list[Block]) -> str:
    """The path, or the ancestor of it that holds the whole article of the page."""
    steps = path.split(">")
    tags = [s.partition(".")[0] for s in steps]
    for tag in ("article", "main"):
        if tag in tags:
            steps = steps[: tags.index(tag) + 1]
            break
    mass = Counter()
    for b in found:
        mass[b.path] += max(0, len(b.text) - b.linked)
    total = sum(mass.values())

    def held(top: str) -> int:
        return sum(n for p, n in mass.items() if p == top or p.startswith(top + ">"))

    while len(steps) > 1:
        up = ">".join(steps[:-1])
        beside = mass[up] and steps[-2].partition(".")[0] not in ("html", "body")
        in_article = steps[-1].partition(".")[0] in ("article", "main")
        if held(">".join(steps)) >= NEARLY * total and (in_article or not beside):
            break
        steps.pop()
    return ">".join(steps)


def extract(page: str | None, path: str | None) -> str:
    """Blocks of the article around the path, or around the page's own best path, joined by empty lines.

    The last main heading before the article in a container around it belongs to it, and so does what stands there between."""
    found = blocks(page or "")
    if not found:
        return ""
    under = lambda p, top: p == top or p.startswith(top + ">")
    if not path or not any(under(b.path, path) for b in found):
        path = best_path(page_scores(found))
    top = widened(path, found)
    first = next(i for i, b in enumerate(found) if under(b.path, top))
    above = [b for b in found[:first] if under(top, b.path)]
    heads = [i for i, b in enumerate(above) if b.tag == "h1"]
    lead = above[heads[-1] :] if heads else []
    return "\n\n".join(b.text for b in [*lead, *(b for b in found[first:] if under(b.path, top))])


def host_paths(pages: DataFrame) -> DataFrame:
    """host and the container path that its pages vote for."""

    @F.pandas_udf("array<struct<path:string,score:double>>")
    def votes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"path": p, "score": s} for p, s in page_scores(blocks(t or "")).items()] for t in texts])

    cast = small_batches(pages).select(host_of(F.col("url")).alias("host"), F.explode(votes("html")).alias("v"))
    sums = cast.groupBy("host", "v.path").agg(F.round(F.sum("v.score"), 6).alias("score"))
    return sums.groupBy("host").agg(
        F.max_by("path", F.struct("score", F.length("path"), F.col("path"))).alias("winner")
    )


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    winners = materialize(host_paths(pages), "host-paths")

    @F.pandas_udf("string")
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for htmls, paths in batches:
            yield pd.Series([extract(h, p) for h, p in zip(htmls, paths)])

    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    told = rows.join(bounded(winners), "host", "left")
    out = told.select("page_id", "url", read("html", "winner").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
