"""Main text of web pages: composite text density over the block tree of each page."""
from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe noembed noframes xmp object svg math select audio video canvas".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul""".split())
CLOSES_P = BLOCK - frozenset("body caption dd dt head html legend li optgroup option summary tbody td tfoot th thead tr".split())
#: A start tag ends an open element of these names, unless one of the walls lies between.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "caption"), ("table",)), "tfoot": (("tbody", "thead", "caption"), ("table",)), "thead": (("caption",), ("table",)),
}
# Elements and names that mark what is no article text.
ASIDE = frozenset("nav aside footer form button menu dialog".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
ASIDE_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promoted promotion banner nav navbar navigation
    navi menu submenu breadcrumb breadcrumbs sidebar sidebars aside footer foot cookie cookies consent gdpr notice notices notification notifications disclaimer alert
    popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended recommendations comment comments commentlist reply
    replies respond disqus discussion form search searchbox widget widgets toolbar pagination pager copyright masthead skip hidden""".split())
HEADER_WORDS = frozenset({"header", "head", "topbar"})
BODY_WORDS = frozenset("article content main post story entry text body maincontent".split())
LAYOUT_WORDS = frozenset("widget widgets hidden".split())  # of page builders: many small ones may hold the article
FREED = frozenset({"html", "body", "main", "article"})  # names never make these an aside
#: Headings and quoted or preformatted text: their names and ids are anchors and styles.
UNNAMED = frozenset("h1 h2 h3 h4 h5 h6 hgroup blockquote pre figure figcaption td th tr tbody".split())
#: Words that may stand beside a mark in a name that marks an aside; any other word makes it a name of its own.
BESIDE = frozenset("""area bar bars block blocks body bottom box boxes bg col column columns container content count cta desktop element el field fields fixed group head header heading
    icon icons inner item items label left line link links list lists main mobile module node note outer overlay page pane panel panels post posts primary row rows secondary section
    sections side site slot slots small stack sticky strip tab tabs toggle top unit units view wrap wrapper zone button buttons input form forms btn right center global local
    entry entries article articles story stories read more see also you may like tags tag meta author date image img thumb card cards""".split())
#: Marks that are common words of articles; beside them only words of page layout may stand.
COMMON = frozenset("""form search social related discussion notice notices alert share sharing promotion promoted recommended recommendations hidden head header foot footer
    reply replies signup login skip sponsor sponsors sponsored disclaimer consent overlay banner copyright aside menu navigation navi""".split())
#: An id on a section of running text is an anchor; only these name the readers' part.
READERS = frozenset("comment comments commentlist disqus respond".split())

_TAG = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*+)((?>"[^"]*"|'[^']*'|[^>"'])*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)(?:>|$)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CLOSE_RAW = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|$)", re.I) for name in RAW}


def _names(value: str) -> list[set[str]]:
    return [{p.lower() for p in _NAME_PART.findall(name)} for name in value.split()]


def _is_aside(tag: str, attributes: str, inside_article: bool) -> int:
    """0 for no aside, 2 where only names of page layout speak for one, else 1."""
    if tag in ASIDE or tag == "header" and not inside_article:
        return 1
    if not attributes or tag in FREED:
        return 0
    found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(found.get("style", "")):
        return 1
    if found.get("role", "").lower() in ASIDE_ROLES:
        return 1
    marks = ASIDE_WORDS if inside_article else ASIDE_WORDS | HEADER_WORDS
    if tag in UNNAMED:
        return 0
    classes, ids = _names(found.get("class", "")), _names(found.get("id", ""))
    section = tag == "section" or {"section"} in classes
    says = [n for n in classes if _marks_aside(n, marks)] + [n for n in ids if _marks_aside(n, READERS if section else marks)]
    against = [n for n in says if not n & {"has", "with", "no", "without"}]
    if not against or any(n & BODY_WORDS and not n & marks for n in (*classes, *ids)):
        return 0
    return 2 if all(n & marks <= LAYOUT_WORDS for n in against) else 1


def _marks_aside(name: set[str], marks: frozenset[str]) -> bool:
    """Whether a mark in a name is its role: in "comment-thread" and "related-posts", but not in "related-work" or "social-quote"."""
    found = name & marks
    if not found:
        return False
    return bool(found - COMMON) or {w for w in name if not w.isdigit()} <= ASIDE_WORDS | HEADER_WORDS | BESIDE


class Page:
    """The block tree of a page: text, links and block tags per node, and its text blocks in order.

    Inline elements are no nodes of their own, unless they are asides; their text belongs to the block around them.
    Nodes are numbered in page order, so children come after their parents.
    """

    def __init__(self, source: str):
        self.parent, self.tag, self.chars, self.link_chars, self.links = [-1], ["#page"], [0], [0], [0]
        self.aside = [0]
        self.blocks: list[tuple[int, str]] = []
        self._read(source)

    def _open(self, tag: str, parent: int, aside: int) -> int:
        for column, value in ((self.parent, parent), (self.tag, tag), (self.chars, 0), (self.link_chars, 0), (self.links, 0), (self.aside, aside)):
            column.append(value)
        return len(self.tag) - 1

    def _read(self, source: str) -> None:
        stack = [("#page", 0)]  # open elements and the block each belongs to
        words: list[str] = []
        link_depth = articles = 0  # open a and article elements

        def flush() -> None:
            text = " ".join("".join(words).split())
            words.clear()
            if text:
                node = stack[-1][1]
                self.chars[node] += len(text)
                self.blocks.append((node, text))

        def close_to(depth: int) -> None:
            nonlocal link_depth, articles
            while len(stack) > depth:
                tag, node = stack[-1]
                if node != stack[-2][1]:
                    flush()
                stack.pop()
                articles -= tag == "article"
                link_depth -= tag == "a"

        def within(names, walls=()) -> int:
            for d in range(len(stack) - 1, 0, -1):
                if stack[d][0] in names:
                    return d
                if stack[d][0] in walls:
                    return 0
            return 0

        at, end = 0, len(source)
        while at < end:
            m = _TAG.search(source, at)
            text = source[at:m.start() if m else end]
            if text:
                text = html.unescape(text) if "&" in text else text
                words.append(text)
                if link_depth:
                    self.link_chars[stack[-1][1]] += len(" ".join(text.split()))
            if not m:
                break
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            closing, attributes = m[1] or m[4], m[3] or m[6] or ""
            if closing:
                if tag in BLOCK:
                    depth = within((tag,), () if tag != "p" else CLOSES_P - {"p"})
                else:
                    depth = within((tag,), BLOCK)
                if tag in ("body", "html"):
                    depth = 0
                if depth:
                    close_to(depth)
                continue
            if tag in RAW:
                if not attributes.rstrip().endswith("/") or tag not in ("svg", "math"):
                    close = _CLOSE_RAW[tag].search(source, at)
                    at = close.end() if close else end
                words.append(" ")
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                    if depth := within(("p",), BLOCK - {"p"}):
                        close_to(depth)
                elif tag != "wbr":
                    words.append(" ")
                continue
            if tag in ("html", "body", "head") and within((tag,)):
                continue
            if tag in CLOSES_P and (depth := within(("p",), CLOSES_P - {"p"})):
                close_to(depth)
            if tag in IMPLIED and (depth := within(*IMPLIED[tag])):
                close_to(depth)
            aside = _is_aside(tag, attributes, articles > 0)
            node = stack[-1][1]
            if tag in BLOCK or aside:
                flush()
                node = self._open(tag, node, aside)
            if tag == "a":
                self.links[stack[-1][1]] += 1
            stack.append((tag, node))
            articles += tag == "article"
            link_depth += tag == "a"
        close_to(1)
        flush()

    def text(self) -> str:
        chosen = self._content()
        return "\n\n".join(t for n, t in self.blocks if n in chosen)

    def _vetoed(self) -> list[bool]:
        """Nodes in asides. An aside that holds more than half of the page's text outside links is a wrapper and stays."""
        n = len(self.tag)
        size = [max(0, c - lc) for c, lc in zip(self.chars, self.link_chars)]
        if not any(size):
            size = list(self.chars)
        for i in range(n - 1, 0, -1):
            size[self.parent[i]] += size[i]

        def under(asides: list[bool]) -> tuple[list[bool], list[int]]:
            out, tops = [False] * n, []
            for i in range(1, n):
                out[i] = out[self.parent[i]] or asides[i]
                if out[i] and not out[self.parent[i]]:
                    tops.append(i)
            return out, tops

        asides = [bool(a) and 2 * size[i] <= size[0] for i, a in enumerate(self.aside)]
        out, tops = under(asides)
        if 2 * sum(size[i] for i in tops if self.aside[i] == 2) > size[0]:
            out, _ = under([a and self.aside[i] != 2 for i, a in enumerate(asides)])
        return out

    def _content(self) -> set[int]:
        n, out = len(self.tag), self._vetoed()
        kept = lambda column: [0 if o else x for x, o in zip(column, out)]
        chars, links, tags = kept(self.chars), kept(self.links), [0] * n
        link_chars = [min(a, b) for a, b in zip(self.link_chars, chars)]
        children: list[list[int]] = [[] for _ in range(n)]
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            if out[i]:  # an aside counts as one empty block
                tags[p] += self.tag[i] in BLOCK and not out[p]
                continue
            children[p].append(i)
            chars[p] += chars[i]
            link_chars[p] += link_chars[i]
            links[p] += links[i]
            tags[p] += tags[i] + 1
        body_share = link_chars[0] / max(1, chars[0])

        def density(i: int) -> float:
            """Characters per tag, times a logarithm that falls with the share of links; its base grows with link text."""
            c, lc, t, lt = chars[i], link_chars[i], max(1, tags[i]), max(1, links[i])
            if not c:
                return 0.0
            base = math.log(c / max(1, c - lc) * lc + body_share * c + math.e)
            gain = math.log(max(c / max(1, lc) * t / lt, 1.0)) / math.log(max(base, 1.0 + 1e-9)) if base > 1.0 else math.log(max(c / max(1, lc) * t / lt, 1.0)) * 10
            return c / t * max(gain, 0.0)

        dense = [density(i) for i in range(n)]
        sums = [sum(dense[c] for c in children[i]) for i in range(n)]
        best = max(range(n), key=lambda i: (sums[i], i)) if n else 0
        if not sums[best]:
            best = 0
        path = [best]
        while path[-1]:
            path.append(self.parent[path[-1]])
        threshold = min(dense[i] for i in path)
        roots, chosen = [best], set()
        top = next((i for i in path if self.tag[i] == "article"), None)
        if top is not None:
            roots = [top]
        else:
            for below, node in zip(path, path[1:]):
                text_parts = [c for c in children[node] if c != below and 2 * link_chars[c] < chars[c]]
                joined = [c for c in text_parts if dense[c] >= threshold]
                if 2 * chars[below] <= chars[node] < 2 * (chars[below] + sum(chars[c] for c in joined)):
                    joined = text_parts  # the sections share the text: the parent is the article, without lists of links
                    chosen.add(node)
                roots += joined + [c for c in children[node] if self.tag[c] == "h1" and c < below]
        stack = roots
        while stack:
            i = stack.pop()
            chosen.add(i)
            stack.extend(children[i])
        return chosen


def main_text(source: str | None) -> str:
    return Page(source).text() if source else ""


def page_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars``: the main text of every page.

    The page becomes a tree of blocks; navigation, headers, footers, sidebars, forms, hidden
    parts and what names itself advert, notice or comment is left out of it, unless it wraps
    more than half of the page's text. Names count on containers, not on headings, quotes or
    preformatted text; an id on a section is an anchor unless it names the readers' part. Every node gets its characters per tag, adjusted for
    link text; the node whose children have the highest sum of densities is the article.
    Where it lies in an ``article`` element, that is taken; else parts beside it join that
    reach the threshold of its path to the body, and where no single part holds half of the
    parent's text, the parent is taken without its lists of links.

    Character references are decoded, white space inside a block becomes one blank, blocks
    are joined by two newlines, nothing is cut. A null or empty page, or one without text,
    has an empty text. Every input row gives one row; other columns are ignored.
    """
    raw = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def extracted(batches):
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    types = {f.name: f.dataType.simpleString() for f in raw.schema}
    return raw.mapInArrow(extracted, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")
