"""Main text of HTML pages by tree scoring.

A page becomes a tree of its block elements. Every text block, a paragraph,
passes points (one, or less below 25 characters; one per comma; one per 100
characters, three at most) to the containers above it: all to the nearest,
half to the next, a third of a half, and so on, five levels up. A container's
points are discounted by its link density, the share of its characters inside
links. The container with most points is kept, widened to the ``article`` (or
``main``) that it stands in, with those of its siblings that score a fifth of
it, carry its heading, or are plain paragraphs.

Menus, headers and footers of the site, sidebars, notices, adverts, forms,
scripts, styles and reader comments are cut from the tree first, known by
element, role, class or id words; so are lists inside the article that are
mostly short links. Character references are decoded, white space inside a block is
one space, blocks stand in page order, joined by one line break. An ``article``
that the page marks has no siblings but others of its kind, and a heading before
it if it has none.

The page is read in one pass, in time linear in its length, by tags only:
inline elements are transparent, unclosed and misnested ones close as in a
browser, an unfinished tag or reference at the end of a cut page is harmless.

Defined cases: a null or empty page, and one with nothing but cut parts, has
the empty text; a page without ``article`` or any block element is scored
like others (its root is a container); equal rows stay rows of their own;
other columns are not read, but for those in ``keep``, which must not be named
like the result's own.
"""

from __future__ import annotations

import html
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
                   "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup legend li main menu nav ol p pre "
                   "section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style noscript template iframe textarea title svg math xmp noembed noframes".split())
CONTAINERS = frozenset("body main article section div td center details".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
CLOSED_BY_LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
                  "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "tbody", "thead"},
                  "tfoot": {"tr", "td", "th", "tbody", "thead"}}
SCOPE = frozenset("body table td th caption".split())
LIST_SCOPE = SCOPE | {"ul", "ol", "dl", "menu", "dir"}
# Elements, roles and words of classes and ids that stand for parts beside the article.
CUT_ELEMENTS = frozenset("nav footer aside menu dialog select button object canvas audio video head".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar "
                      "toolbar tablist".split())
CUT_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie "
                      "cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup comment "
                      "comments disqus replies respond nav navbar navigation menu menubar breadcrumb breadcrumbs "
                      "pagination pager paywall".split())
LIKELY_CUT_WORDS = frozenset("sidebar side header masthead banner footer foot share sharing social related "
                             "recommended recommendations widget toolbar skip login search tags alert toc form "
                             "outbrain taboola rail".split())
ARTICLE_WORDS = frozenset("article body content main post entry story text page column".split())
NOT_A_PART = frozenset("has have no not with without is in on off hide show".split())

TAG = re.compile(r"""<(?:!--(?:.*?(?:-->|\Z))|(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?)*+)(?:>|\Z)"""
                 r"""|[!?/][^>]*+(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

LEVELS = 5
NEVER, MAYBE, CUT = 0, 1, 2


def _named_parts(value: str) -> set[str]:
    """Words of a class or id list, but for names such as ``has-sidebar``."""
    words: set[str] = set()
    for name in value.split():
        parts = [w.lower() for w in WORDS.findall(name)]
        if parts and parts[0] not in NOT_A_PART:
            words.update(parts)
    return words


def cut_of(tag: str, attributes: str, in_article: bool) -> int:
    """Whether an element is beside the article: CUT, MAYBE (unless it holds
    the article) or NEVER."""
    if tag in CUT_ELEMENTS:
        return CUT
    verdict = MAYBE if tag == "form" or tag == "header" and not in_article else NEVER
    if not attributes or tag in ("body", "html"):
        return verdict
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    if ("hidden" in found or found.get("aria-hidden") == "true"
            or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""))):
        return CUT
    if found.get("role", "").lower() in CUT_ROLES:
        return MAYBE
    words = _named_parts(found.get("class", "") + " " + found.get("id", ""))
    if words & CUT_WORDS:
        return MAYBE if tag == "main" or words & ARTICLE_WORDS and not words & {"comment", "comments"} else CUT
    if words & LIKELY_CUT_WORDS and not words & ARTICLE_WORDS and tag not in ("article", "main"):
        return MAYBE
    return verdict


class Page:
    """Block elements of a page in document order, as parallel lists, and its
    text blocks ``(element, text, characters in links, number of links)``."""

    def __init__(self, source: str):
        self.tag, self.parent, self.cut = ["body"], [-1], [NEVER]
        self.blocks: list[tuple[int, str, int, int]] = []
        self._stack, self._open = [0], {"body": 1}
        self._text: list[str] = []
        self._linked, self._links, self._in_link = 0, 0, False
        self._read(source)
        self._flush()

    def _flush(self) -> None:
        """End the running text block."""
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.blocks.append((self._stack[-1], text, min(self._linked, len(text)), self._links))
            self._text = []
        self._linked = self._links = 0

    def _push(self, tag: str, cut: int) -> None:
        self.tag.append(tag)
        self.parent.append(self._stack[-1])
        self.cut.append(cut)
        self._stack.append(len(self.tag) - 1)
        self._open[tag] = self._open.get(tag, 0) + 1

    def _close(self, tags, scope) -> None:
        """Close the innermost open element of ``tags``, unless one of
        ``scope`` stands between."""
        if not any(self._open.get(t) for t in tags):
            return
        for at in range(len(self._stack) - 1, 0, -1):
            tag = self.tag[self._stack[at]]
            if tag in tags:
                for i in self._stack[at:]:
                    self._open[self.tag[i]] -= 1
                del self._stack[at:]
                return
            if tag in scope:
                return

    def _add(self, piece: str) -> None:
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            self._text.append(piece)
            if self._in_link:
                self._linked += len(piece.strip())

    def _read(self, source: str) -> None:
        at = 0
        while True:
            m = TAG.search(source, at)
            if m is None:
                self._add(source[at:])
                return
            self._add(source[at:m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self._end(tag)
            elif tag in RAW:
                if not m[3].endswith("/"):
                    end = re.compile(f"</{tag}(?=[\\s/>])[^>]*+>?", re.I).search(source, at)
                    at = end.end() if end else len(source)
            else:
                self._start(tag, m[3])

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self._text.append(" ")
        elif tag == "hr":
            self._flush()
        elif tag == "body":
            self._flush()
            self._close({"head"}, ())
        elif tag in VOID or tag == "html":
            return
        elif tag == "a":
            self._in_link = True
            self._links += 1
        elif tag in BLOCKS or tag in CUT_ELEMENTS:
            self._flush()
            if tag in BLOCKS:
                self._close({"head"}, ())
                self._close({"p"}, SCOPE)
            if tag in CLOSED_BY_LIKE:
                self._close(CLOSED_BY_LIKE[tag], LIST_SCOPE - CLOSED_BY_LIKE[tag])
            self._in_link = False
            self._push(tag, cut_of(tag, attributes, bool(self._open.get("article") or self._open.get("main"))))
        elif attributes and cut_of(tag, attributes, True) == CUT:
            self._flush()
            self._push(tag, CUT)

    def _end(self, tag: str) -> None:
        if tag == "a":
            self._in_link = False
        if tag in BLOCKS or tag in CUT_ELEMENTS:
            self._flush()
            self._in_link = False
            if tag not in ("body", "html"):
                self._close({tag}, SCOPE - {tag})
        elif self._open.get(tag):
            self._flush()
            self._close({tag}, BLOCKS)


def _below(parent: list[int], i: int, top: int) -> bool:
    while i > top:
        i = parent[i]
    return i == top


def main_text(source: str | None) -> str:
    """The article of a page, one line per block."""
    page = Page(source or "")
    n = len(page.tag)
    tag, parent = page.tag, page.parent

    # An element that may be a part beside the article stays if it holds one.
    holds = [False] * n
    for i in range(n - 1, 0, -1):
        if holds[i] or (tag[i] in ("article", "main") and page.cut[i] != CUT):
            holds[parent[i]] = True
    gone = [False] * n
    for i in range(1, n):
        gone[i] = gone[parent[i]] or page.cut[i] == CUT or (page.cut[i] == MAYBE and not holds[i])
    blocks = [b for b in page.blocks if not gone[b[0]]]
    if not blocks:
        return ""

    nearest = [0] * n  # the nearest container from an element upwards
    for i in range(1, n):
        nearest[i] = i if tag[i] in CONTAINERS else nearest[parent[i]]
    points, size, linked, links = [0.0] * n, [0] * n, [0] * n, [0] * n
    for at, text, in_links, number in blocks:
        worth = min(1.0, len(text) / 25) + text.count(",") + text.count("，") + min(len(text) / 100, 3)
        worth *= 1 - in_links / len(text)
        size[at] += len(text)
        linked[at] += in_links
        links[at] += number
        box = nearest[at]
        for level in range(LEVELS):
            points[box] += worth / (1 if level == 0 else 2 if level == 1 else 3 * level)
            if box == 0:
                break
            box = nearest[parent[box]]
    for i in range(n - 1, 0, -1):
        if not gone[i]:
            size[parent[i]] += size[i]
            linked[parent[i]] += linked[i]
            links[parent[i]] += links[i]

    def density(i: int) -> float:
        return linked[i] / size[i] if size[i] else 0.0

    def score(i: int) -> float:
        prior = 25.0 if tag[i] in ("article", "main") else 0.0
        return (points[i] + prior) * (1 - density(i))

    best = max((i for i in range(n) if not gone[i] and size[i] and tag[i] in CONTAINERS), key=lambda i: (score(i), -i))
    top, wide = best, best
    while wide > 0:
        if tag[wide] == "article" or tag[wide] == "main" and tag[top] != "article":
            top = wide
        wide = parent[wide]

    kept = [False] * n
    kept[top] = True
    marked = tag[top] in ("article", "main")
    titled = any(tag[b[0]] in ("h1", "h2") and top <= b[0] and _below(parent, b[0], top) for b in blocks)
    last = {b[0]: b[1][-1] for b in blocks}
    for i in range(1, n):
        if top and parent[i] == parent[top] and not gone[i] and size[i] and i != top:
            if tag[i] in HEADINGS:
                kept[i] = i < top and not titled
            elif tag[i] in CONTAINERS and (tag[i] == tag[top] or not marked):
                kept[i] = score(i) >= max(10.0, 0.2 * score(top))
            elif tag[i] == "p" and not marked:
                kept[i] = density(i) < 0.25 and size[i] > 80 or links[i] == 0 and last.get(i, "") in ".!?…。！？"
    for i in range(1, n):
        menu = (tag[i] not in ("article", "main", "p") and tag[i] not in HEADINGS and links[i] > 1
                and density(i) > 0.5 and size[i] < 60 * links[i])
        kept[i] = (kept[i] or kept[parent[i]]) and not (menu and i != top)
    return "\n".join(b[1] for b in blocks if kept[b[0]])


def extract_text(pages: DataFrame, html_column: str = "html", keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """Columns ``keep``, ``text`` and its code points ``n_chars`` per page."""
    clash = {"text", "n_chars"} & set(keep)
    if clash:
        raise ValueError(f"Columns {sorted(clash)} would be overwritten; rename them first.")

    def extracted(batches):
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*keep, "text", "n_chars"])

    source = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html_column}`"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(extracted, f"{schema}{', ' if schema else ''}text string, n_chars long")
