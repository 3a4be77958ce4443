"""Operator 6: main text of HTML pages by tag-path ratios.

A page is read into blocks of text, each with its root-to-leaf path of tags and classes. Per path the text
length, without that of links, and the punctuation of its blocks are summed and divided by their number; the two
ratios are bounded and fused, smoothed along the page between blocks of kindred paths, and paths above a
threshold are content. Their blocks are the text, in page order. With them come, of other paths, headlines
before content and what the ratio is too coarse for: paragraphs, list items and table cells that lie
between blocks of content or go on beside them in one container.

Menus, headers, footers, sidebars, forms and elements whose class, id or role marks them as such, as adverts or
as reader comments are left out before; but one that holds half of the text below it is a wrapper and counts as any
other. A mark that is only one word among others (related-work), or standing beside the page's article, halves a ratio.

Defined cases: null or empty html gives an empty text; markup that is cut off or not closed is read
as browsers do (open elements end with the page, an unfinished tag is dropped, a new paragraph ends
the one before); nothing is dropped for its length; extra columns pass through; the columns ``text``
and ``n_chars`` of the input are replaced; each row is read by itself, so ties and repeated rows
and an empty table need no care.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.common import table

# HTML's element names by how they are read here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|textarea|title|noscript|template|iframe|noframes|xmp|svg|math|object|canvas|audio|video"
SKIPPED = frozenset("head button select option datalist label".split())
ASIDE = frozenset("nav aside footer form menu dialog fieldset".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var wbr".split()
)
ARTICLES = frozenset("article main".split())
HEADLINES = frozenset("h1 h2 h3".split())
TEXTS = frozenset("p li dd dt blockquote pre figcaption caption td th h1 h2 h3 h4 h5 h6".split())
LISTED = frozenset("li dd dt td th".split())
#: Words of class, id or role that mark an element as no part of the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr"
    " notice notices alert popup modal overlay newsletter subscribe subscription signup share sharing social related"
    " recommended recommendations sidebar widget nav navbar navigation menu breadcrumb breadcrumbs masthead footer copyright"
    " comment comments reply replies respond disqus discussion login search pagination pager toolbar".split()
)
REPLIES = frozenset("comment comments reply replies respond disqus discussion".split())
#: Words after which a mark says what a wrapper has or lacks, and words that leave a mark beside them its meaning.
MODIFIERS = frozenset("has have with without no not hide show".split())
STRUCTURE = frozenset(
    "container wrapper wrap box block list lists group row col column left right top bottom inner outer area bar panel section region"
    " content item items link links post posts article articles story stories button buttons icon icons text title heading header head body count"
    " form field site page main primary secondary global mobile desktop message msg slot unit image js".split()
)
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>(?:.*?</\1\s*>|.*\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[/a-zA-Z][^>]*\Z",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?。，；：！？、…]")
#: Length and punctuation of a block at which the ratios are bounded, so that one very long block hides no other;
#: share of the largest smoothed ratio from which a path is content; width of the smoothing; factor of a weak sign.
LENGTH, MARKED_OFF, THRESHOLD, SIGMA, WEAKENED = 600, 12, 0.45, 1.0, 0.5


#: How an element is marked: by one word among others of its own, as no part of the article, as readers' replies.
WEAK, STRONG, REPLY = 1, 2, 3


def _read(tag: str, attributes: str, in_article: bool) -> tuple[bool, int, str]:
    """Whether the element is never shown or never text, how its tag, class, id or role marks it, and its class without digits."""
    if tag in SKIPPED:
        return True, 0, ""
    mark = STRONG if tag in ASIDE or tag == "header" and not in_article else 0
    if not attributes or tag in ("html", "body"):
        return False, mark, ""
    kind = ""
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True, 0, ""
        if name == "class":
            kind = re.sub(r"\d+", "0", value)
        if name in ("class", "id", "role"):
            for token in value.split():
                words = [w for w in re.split(r"[^a-z]+", token) if w]
                at = next((i for i, w in enumerate(words) if w in MODIFIERS), len(words))
                words = words[:at]  # what follows a modifier isn't what the element is
                if tag in ARTICLES:
                    mark = max(mark, REPLY if {"comment", "reply"} & set(words) else 0)
                elif MARKS & set(words):
                    own = any(w not in MARKS and w not in STRUCTURE for w in words)
                    mark = max(mark, WEAK if own else REPLY if REPLIES & set(words) else STRONG)
                elif not in_article and {"header", "complementary", "contentinfo"} & set(words):
                    mark = max(mark, STRONG)
    return False, mark, kind


@dataclass
class Page:
    """Blocks (element, path, text, length without links) in page order; per element its parent, tag and mark; per path its
    parent and depth. Element 0 and path 0 are the page."""

    blocks: list[tuple[int, int, str, int]]
    parent: list[int]
    tags: list[str]
    mark: list[int]
    above: list[int]
    depth: list[int]


def _left_out(page: Page) -> list[bool]:
    """Per element whether it lies in a marked one that is left out. Not left out is one that holds the only
    articles of the page, or in the elements in it half of all text (all, for replies): it is a wrapper."""
    parent, tags, mark = page.parent, page.tags, page.mark
    n = len(tags)
    under, own, articles = [False] * n, [0] * n, [0] * n
    for element, _, text, _ in page.blocks:
        own[element] += len(text)
    size = list(own)
    for x in range(1, n):  # elements come after their parents
        under[x] = under[parent[x]] or mark[x] >= STRONG
        articles[x] = int(tags[x] in ARTICLES and mark[x] < STRONG)
    free = any(articles[x] and not under[x] for x in range(1, n))
    for x in range(n - 1, 0, -1):
        size[parent[x]] += size[x]
        articles[parent[x]] += articles[x]
    out = [False] * n
    for x in range(1, n):
        out[x] = out[parent[x]]
        if mark[x] >= STRONG and not out[x]:
            most = size[x] > own[x] and size[x] - own[x] >= (1 if mark[x] == REPLY else 0.5) * size[0]
            out[x] = not (most and not free or mark[x] == STRONG and not free and articles[x])
    return out


def read_page(page: str) -> Page:
    parent, tags, path_of, skip, article, mark = [-1], ["#"], [0], [False], [False], [0]
    paths: dict[tuple[int, str, str], int] = {}
    up, depth = [-1], [0]  # of paths
    opened: dict[str, int] = {}
    stack, found, piece = [0], [], []
    holder = linked = 0  # the innermost element that isn't inline; the length of links in ``piece``

    def flush() -> None:
        nonlocal linked
        if piece:
            if text := " ".join("".join(piece).split()):
                found.append((holder, path_of[holder], text, max(0, len(text) - linked)))
            piece.clear()
        linked = 0

    def write(text: str) -> None:
        nonlocal linked
        piece.append(text := entities.unescape(text))
        if opened.get("a"):
            linked += len(text.strip())

    def close(tag: str) -> None:
        while stack[-1]:
            name = tags[stack.pop()]
            opened[name] -= 1
            if name == tag:
                break

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at and not skip[stack[-1]]:
            write(page[at : m.start()])
        at = m.end()
        tag = m[3] or m[6]
        if not tag:
            continue
        tag, ends, attributes = tag.lower(), m[2] or m[5], m[4] or m[7] or ""
        if tag in INLINE:
            if tag == "br":
                piece.append(" ")
            elif tag == "img" or tag == "wbr":
                pass
            elif ends:
                if opened.get(tag) and (above := [x for x in stack[-8:] if tags[x] == tag]) and above[-1] > holder:
                    close(tag)
            else:
                top = stack[-1]
                parent.append(top)
                tags.append(tag)
                path_of.append(path_of[top])
                out, how, _ = _read(tag, attributes, article[top]) if attributes else (False, 0, "")
                skip.append(skip[top] or out or how >= STRONG)
                mark.append(0)
                article.append(article[top])
                stack.append(len(tags) - 1)
                opened[tag] = opened.get(tag, 0) + 1
            continue
        flush()
        if ends:
            if opened.get(tag):
                close(tag)
        elif tag not in VOID:
            if opened.get("p"):  # a block ends an open paragraph, if no table cell or the like stands between
                for x in reversed(stack):
                    if tags[x] == "p":
                        close("p")
                        break
                    if tags[x] not in INLINE:
                        break
            for same, within in (("li", ("ul", "ol")), ("tr", ("table",)), ("td", ("tr",)), ("th", ("tr",)), ("dd", ("dl",)), ("dt", ("dl",)), ("head", ())):
                if (tag == same or same == "head" and tag == "body") and opened.get(same):
                    for x in reversed(stack):
                        if tags[x] == same:
                            close(same)
                            break
                        if tags[x] in within:
                            break
            top = stack[-1]
            parent.append(top)
            tags.append(tag)
            out, how, kind = _read(tag, attributes, article[top])
            path = paths.setdefault((path_of[top], tag, kind), len(paths) + 1)
            if path == len(up):
                up.append(path_of[top])
                depth.append(depth[path_of[top]] + 1)
            path_of.append(path)
            skip.append(skip[top] or out)
            mark.append(how)
            article.append(article[top] or tag == "article")
            if not attributes.rstrip().endswith("/") or tag not in ("div", "p"):
                stack.append(len(tags) - 1)
                opened[tag] = opened.get(tag, 0) + 1
        holder = stack[-1]
        while tags[holder] in INLINE:
            holder = parent[holder]
    if at < len(page) and not skip[stack[-1]]:
        write(page[at:])
    flush()
    return Page(found, parent, tags, mark, up, depth)


def ratios(page: Page, found: list[tuple[int, int, str, int]]) -> dict[int, float]:
    """Per path its text length and punctuation a block, bounded, fused by their geometric mean, and smoothed."""
    length: dict[int, float] = {}
    marks: dict[int, float] = {}
    nodes: dict[int, int] = {}
    for _, path, text, unlinked in found:
        length[path] = length.get(path, 0) + unlinked
        marks[path] = marks.get(path, 0) + (len(_PUNCTUATION.findall(text)) if unlinked else 0)
        nodes[path] = nodes.get(path, 0) + 1
    fused = {p: math.sqrt(min(length[p] / nodes[p], LENGTH) * (1 + min(marks[p] / nodes[p], MARKED_OFF))) for p in nodes}
    kin: dict[tuple[int, int], float] = {}

    def kinship(a: int, b: int) -> float:
        """Squared share of the way down that two paths have in common."""
        if (a, b) not in kin:
            x, y = a, b
            while x != y:
                if page.depth[x] >= page.depth[y]:
                    x = page.above[x]
                else:
                    y = page.above[y]
            kin[a, b] = (page.depth[x] / max(page.depth[a], page.depth[b], 1)) ** 2
        return kin[a, b]

    # along the page: a Gaussian over the block and its two neighbours on either side, less for paths that part early
    w, n = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(3)], len(found)
    smooth: dict[int, float] = {}
    for i, (_, path, _, _) in enumerate(found):
        near = [(1.0 if found[j][1] == path else w[abs(j - i)] * kinship(path, found[j][1]), fused[found[j][1]]) for j in range(max(0, i - 2), min(n, i + 3))]
        smooth[path] = smooth.get(path, 0) + (fused[path] + sum(a * b for a, b in near) / sum(a for a, _ in near)) / 2 / nodes[path]
    return smooth


def main_text(html: str | None) -> str:
    """The blocks of the article, joined by one newline."""
    if not html:
        return ""
    page = read_page(html)
    parent, tags, mark, found = page.parent, page.tags, page.mark, page.blocks
    if any(mark):
        out = _left_out(page)
        found = [b for b in found if not out[b[0]]]
    if not found:
        return ""
    n, inside, weak = len(found), [0] * len(tags), [False] * len(tags)  # the outermost article around, and whether a weak mark is
    for x in range(1, len(tags)):
        inside[x] = inside[parent[x]] or (x if tags[x] in ARTICLES else 0)
        weak[x] = weak[parent[x]] or mark[x] == WEAK
    told = any(inside[x] for x, *_ in found)
    score = ratios(page, found)
    value = [score[path] * (WEAKENED if weak[x] else 1) * (WEAKENED if told and not inside[x] else 1) for x, path, *_ in found]
    least = THRESHOLD * max(value)
    chosen = [v >= least for v in value]
    first, last = chosen.index(True), n - 1 - chosen[::-1].index(True)
    # the least element around all content, unless that is the page or its body; and the articles that hold content
    common, ways = None, {}
    for x in {found[i][0] for i in range(n) if chosen[i]}:
        way = []
        while x >= 0:
            way.append(x)
            x = parent[x]
        ways[way[0]] = way
        common = set(way) if common is None else common & set(way)
    around = {x for way in ways.values() for x in way}
    box = max(common)
    homes = {inside[x] for x in ways} - {0}
    held = [False] * len(tags)  # in the articles of the content or, without one, in the box
    for x in range(1, len(tags)):
        held[x] = held[parent[x]] or (x in homes if homes else x == box and tags[x] not in ("html", "body"))

    def goes_along(i: int) -> bool:
        """Whether a block whose path is no content belongs to the text around it."""
        x, _, text, unlinked = found[i]
        if tags[x] not in TEXTS or 2 * unlinked < len(text):
            return False
        if weak[x] and not (first < i < last and _PUNCTUATION.search(text)):
            return False
        if first < i < last:
            return held[x] or not homes
        near = held[x] or parent[x] in around and not homes or i > last and not homes and parent[parent[x]] in around
        return near and (bool(_PUNCTUATION.search(text)) or i > last and tags[x] in LISTED and bool(homes))

    taken = list(chosen)
    for i in range(first, n):
        if not taken[i]:
            taken[i] = goes_along(i)
            if not taken[i] and i > last and not homes:
                break
    for i in range(first - 1, -1, -1):
        taken[i] = goes_along(i)
        if not taken[i] and not homes and tags[found[i][0]] not in HEADLINES:
            break
    # a headline goes with the text that follows it
    following = False
    for i in range(n - 1, -1, -1):
        x = found[i][0]
        if tags[x] in HEADLINES and not chosen[i]:
            taken[i] = following and (held[x] or not homes and parent[x] in around)
        following = taken[i]
    return "\n".join(b[2] for b, t in zip(found, taken, strict=True) if t)


def extract_main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """All columns of ``pages`` but ``html_col`` and text, n_chars (code points of the text)."""
    kept = [c for c in pages.columns if c.lower() not in (html_col.lower(), "text", "n_chars")]
    rows = pages.select(*kept, html_col)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(len(kept))]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(kept)], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                names=[*kept, "text", "n_chars"],
            )

    schema = pages.select(*kept).schema.add("text", "string").add("n_chars", "long")
    return rows.mapInArrow(read, schema)


def op6_tag_path_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
