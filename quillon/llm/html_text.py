"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block element, in page order; elements that never are
main text (menus, forms, scripts, adverts, comments and the like, by tag, role, class or id) leave
blank lines. A line's weight is the length of its text; menu lines, nearly all links, weigh nothing.
Weights are summed over a sliding window of lines. Where a whole window weighs nothing the text dives,
which cuts the page into stretches; a stretch is kept where its sums surge to half of the page's largest
sum, or to SURGE where that is less, and its lines of any weight are the text. So a short line beside
others stays, and a few short lines by themselves, as pages have at their edges, go.

An article or main element only tells where text weighs: if it holds most of a page's text, what is
outside weighs nothing, and links inside weigh what they say. Surges and dives decide there as well.

Names (classes, ids, roles) are judged on boxes, not on headings, list items or what is inside
running text; inside an article only whole names count, and ids only where they tell of comments.

Defined cases: null, empty or tag-less html gives what text it has or an empty string; a tag without
its end goes up to the next tag; a comment or script without its end goes up to the page's end; equal
rows are extracted each; null ids and urls are passed on; an empty table gives no rows; other columns
are ignored. A page is read once, in time and memory in proportion to its length.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_frames

#: Elements whose text is no text of the page.
SILENT = frozenset("script style noscript template head title iframe select option datalist textarea button audio video annotation annotation-xml desc metadata defs".split())
#: Elements around the article.
AROUND = frozenset("nav footer aside form dialog menu".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption title script style".split()
)
#: What a start tag closes if it is still open, as HTML lets its end tag be left out.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that an implied end never reaches beyond.
WALLS = frozenset("ul ol dl table tbody thead tfoot div article section main aside nav header footer body html form".split())
OPTIONAL_END = frozenset(("p", *CLOSES))
#: Elements that names may mark: boxes; paragraphs outside an article; spans and links outside running text.
BOXES_TAGS = frozenset("div section article aside header footer nav ul ol dl table form figure details center fieldset blockquote span a ins".split())
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th figcaption caption summary blockquote pre".split())
#: Words of a class, id or role that mark what is not the article.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsored sponsor promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side aside complementary footer masthead contentinfo comment comments disqus respond reply replies discussion "
    "share sharing social related recommended recommendations newsletter subscribe subscription signup login search pagination pager toolbar widget widgets skip".split()
)
#: Words that mark a page's header, unless the name is about the article or inside it.
HEADER, ABOUT_ARTICLE = frozenset("header topbar top logo".split()), frozenset("article post entry content story main title".split())
#: Words that mark even an article element as something else; first words that make a name tell what a page has.
NO_ARTICLE, MODIFIERS = frozenset("comment comments reply replies related promo sponsored teaser ad ads advert".split()), frozenset("has with without no".split())
#: First words of a wrapper's name, and the parts of a layout that such a name may tell of.
WRAPPERS, LAYOUT = frozenset("content article main".split()), frozenset("sidebar side aside".split())
#: Names of a section that may be a heading's; ids that count inside an article.
SECTION_IDS, READERS = frozenset("discussion notice notices related side".split()), frozenset("comment comments disqus thread respond replies".split())
#: Words that say what kind of box a name is of.
BOXES = frozenset("box slot unit wrap wrapper container block area list section link links button buttons bar item items".split())
#: Words that say where a box is, or whose it is.
PLACES = frozenset("top bottom left right inline middle mid upper lower first last inner outer in article post posts story page content main user users reader readers mobile desktop".split())
#: Names mark too much if they silence this many times the text that is left, and nothing that is left surges.
TOO_MUCH = 10
ARTICLE_TAGS = frozenset(("article", "main"))
#: Lines of a window, weight that makes a surge, and share of link text above which a line is a menu's.
WINDOW, SURGE, LINK_SHARE = 3, 80, 0.6
#: Share of a page's text above which its named article is where the text weighs.
MOST = 0.5

#: A tag ends at > outside of quoted values, or before the next <. Quotes count where a value begins. Nothing is tried twice.
_TOKEN = re.compile(
    r"""<(?:!--|!\[CDATA\[|[!?]|(?P<end>/?)(?P<tag>[a-zA-Z][^\s/<>]*+)(?P<marks>(?>[^<>=]++|=\s*+(?>"[^"]*+"|'[^']*+'|[^\s<>"'][^\s<>]*+)?+)*+)>?)"""
)
_MARKS = re.compile(r"""(?<![^\s/"'])(class|id|role|hidden|aria-hidden|style)(?![^\s=/])\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe")}
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)
_ROLE = re.compile(r"(?<![\w-])role\s*=\s*[\"']?(?:main|article)\b", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _marked(tag: str, key: str, name: str, in_article: bool) -> bool:
    """Whether one name of an element marks it as boilerplate."""
    words = _WORD.findall(_CAMEL.sub("-", name).lower())
    # What a name has, or is without, doesn't name it.
    words = words[: next((i for i, w in enumerate(words) if w in MODIFIERS), len(words))]
    if not words:
        return False
    if tag == "article":
        return not NO_ARTICLE.isdisjoint(words)
    marks = BOILERPLATE.intersection(words)
    if in_article:
        # A part of a name tells nothing inside an article, and an id may be made from a heading's text.
        known = (marks if key != "id" else READERS & marks) | BOXES | PLACES
        return not marks.isdisjoint(known) and known >= set(words)
    if words[0] in WRAPPERS and marks <= LAYOUT or key == "id" and tag == "section" and (len(words) > 1 or words[0] in SECTION_IDS):
        marks = frozenset()
    return bool(marks) or not HEADER.isdisjoint(words) and ABOUT_ARTICLE.isdisjoint(words)


def _unwanted(tag: str, attributes: str, in_article: bool, running: bool) -> bool:
    """Whether an element is hidden, or boilerplate by its names."""
    judged = tag in BOXES_TAGS and not running or tag == "p" and not in_article
    for m in _MARKS.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value):
            return True
        if judged and key in ("class", "id", "role") and not (tag == "p" and key == "id") and any(_marked(tag, key, name, in_article) for name in value.split()):
            return True
    return False


def page_lines(html: str, by_name: bool = True, forms: bool = False) -> tuple[list[tuple[str, int, bool]], bool]:
    """(text, characters in links, inside an article) of each block, blank ones included, and whether the page names an article.

    by_name: classes, ids, roles and the like may mark an element as boilerplate. forms: their text is text.
    """
    lines: list[tuple[str, int, bool]] = []
    text: list[str] = []
    #: Open elements: tag, and what was in force outside it; where each tag's open ones are.
    stack: list[tuple] = []
    opened: dict[str, list[int]] = defaultdict(list)
    #: Elements with an optional end that are open since the last wall; the innermost block.
    near: dict[str, int] = {}
    block = -1
    silent = article = link = running = named = False
    links = 0

    def end_line() -> None:
        nonlocal links
        line = " ".join(unescape("".join(text)).split()) if text else ""
        if line or not lines or lines[-1][0]:  # several boundaries in a row leave one blank line
            lines.append((line, links, article))
        text.clear()
        links = 0

    def close(depth: int) -> None:
        nonlocal silent, article, link, running, near, block
        _, silent, article, link, running, near, block = stack[depth]
        for tag, *_ in stack[depth:]:
            opened[tag].pop()
        del stack[depth:]

    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        piece = html[at : m.start() if m else n]
        if piece and not silent:
            text.append(piece)
            if link:
                links += len(piece.strip())
        if not m:
            break
        at, tag = m.end(), m["tag"]
        if tag is None:
            start = m[0]
            if start == "<!--":
                end, skip = html.find("-->", at - 2), 3
            elif start == "<![CDATA[":
                end, skip = html.find("]]>", at), 3
                if not silent:
                    text.append(html[at : end if end >= 0 else n].replace("&", "&amp;"))
            else:
                end, skip = html.find(">", at), 1
            at = end + skip if end >= 0 else n
            continue
        tag = tag.lower()
        if tag in BLOCK:
            end_line()
        if m["end"]:
            # An inline element's end doesn't reach out of the block that it stands in.
            if opened[tag] and (tag in BLOCK or opened[tag][-1] > block):
                close(opened[tag][-1])
            continue
        if tag == "br":
            text.append("\n")
        if tag in VOID:
            continue
        if tag in BLOCK and "p" in near:
            close(near["p"])  # a block ends an open paragraph
        if tag in CLOSES and (ended := [near[t] for t in CLOSES[tag] if t in near]):
            close(max(ended))
        if tag in _RAW_END:
            end = _RAW_END[tag].search(html, at)
            at = end.end() if end else n
            continue
        attributes = m["marks"]
        if attributes.endswith("/") and tag not in BLOCK:
            continue
        stack.append((tag, silent, article, link, running, near, block))
        opened[tag].append(len(stack) - 1)
        if tag in WALLS:
            near = {}
        elif tag in OPTIONAL_END:
            near = near | {tag: len(stack) - 1}
        if tag in BLOCK:
            block = len(stack) - 1
        around = tag in AROUND and not (forms and tag == "form") or tag == "header" and not article
        if tag in SILENT or around or attributes and not attributes.isspace() and tag not in ("html", "body", "main") and by_name and _unwanted(tag, attributes, article, running):
            silent = True
        if (tag in ARTICLE_TAGS or "role" in attributes and _ROLE.search(attributes)) and not silent:
            article = named = True
        if tag == "a":
            link = True
        if tag in BLOCK:
            running = tag in RUNNING
    end_line()
    return lines, named


def stretches(weights: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """[first, end) of each stretch of lines between dives that has a surge."""
    n = len(weights)
    sums, total = [], 0
    for j in range(n):
        total += weights[j] - (weights[j - window] if j >= window else 0)
        sums.append(total)
    least = min(surge, max(sums, default=0) / 2)
    kept: list[tuple[int, int]] = []
    start, most = None, 0
    for j in range(n + 1):
        if j == n or not sums[j]:
            if start is not None and most >= least:
                kept.append((start, j))
            start, most = None, 0
        else:
            start, most = (j if start is None else start), max(most, sums[j])
    return kept


def main_text(html: str | None) -> str:
    """The lines between surges and dives, joined by newlines."""
    lines, named = page_lines(html or "")
    left = sum(len(t) for t, _, _ in lines)
    if left < SURGE and not any(t and a for t, _, a in lines):
        # Names that mark everything, or all but a stray line, mark nothing; so does a form around all.
        for forms in (False, True):
            plain = page_lines(html or "", by_name=False, forms=forms)
            if sum(len(t) for t, _, _ in plain[0]) - left > (max(TOO_MUCH * left, SURGE) if left else 0):
                lines, named = plain
                break
    inside = sum(len(t) for t, _, a in lines if a)
    within = named and inside > MOST * sum(len(t) for t, _, _ in lines)

    def weight(t: str, linked: int, a: bool) -> int:
        if within:
            return len(t) if a else 0
        return 0 if linked > LINK_SHARE * len(t) else len(t)

    weights = [weight(*line) for line in lines]
    return "\n".join(lines[j][0] for a, b in stretches(weights) for j in range(a, b) if weights[j])


def extract_pages(pages: DataFrame, html: str = "html", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, url, text, n_chars for every row; no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [main_text(h) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    return map_frames(rows, run, "page_id bigint, url string, text string, n_chars bigint")
