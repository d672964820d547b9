"""Main text of web pages by scoring the element tree.

A page is cut into tags and text by one regular expression; blocks of text hang on the tree of
block elements. Every block gives points for its length and its commas to its container and
half of them to the container above; a container's points are discounted by the share of its
text that is link text. The best container (or the ``article`` or ``main`` around it) and those
of its siblings that look like text are kept, without the parts that are no article: menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments.

Names (classes and ids) only hint at such parts. A name hides no element around the longest
``article`` or ``main`` or, on a page without one, around most of the text that is no link; and
names do not count at all if they would leave nothing. Reader comments go however long they are.
A headline (``h1``) right before the container is kept.

Defined cases: null and empty pages, and pages without text, give the empty text; unclosed and
crossed tags close with the element around them; character references are decoded; nothing is
cut, whatever the length. Repeated rows give equal rows; the first of equally good containers
is taken; columns named ``text`` or ``n_chars`` are replaced. A ``button``, ``select``,
``object``, ``iframe`` or ``noscript`` that is not closed before an article begins hides nothing.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<svg\b(?:[^<>\"'/]++|/(?!>)|\"[^\"]*+\"|'[^']*+')*+/>"
    r"|<(script|style|title|template|textarea|svg)\b[^>]*+>.*?(?:</\1\s*>|\Z)"
    # controls and fallbacks end at their own tag; one that is not closed before an article begins hides nothing
    r"|<(noscript|iframe|object)\b[^>]*+>(?:[^<]++|<(?!/\2\b|(?:article|main|h1)\b))*+</\2\s*+>"
    r"|<(select|button)\b[^>]*+>(?:[^<]++|<(?!/\3\b|(?:article|main|p|h[1-6]|ul|ol|table|form|select|button)\b))*+</\3\s*+>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<rest>(?:[^<>\"']++|\"[^\"<>]*+\"|'[^'<>]*+'|[\"'])*+)>"
    r"|<[!?/][^>]*+>",
    re.S | re.I,
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr input".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOT_TEXT = frozenset("nav header footer aside form head dialog menu fieldset audio video canvas map".split())
PARAGRAPHS = frozenset("p pre td th blockquote li dd dt h1 h2 h3 h4 h5 h6 figure figcaption address".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WHOLE = frozenset(("article", "main"))
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
CONTAINS_LIST = frozenset(("ul", "ol", "dl", "table", "tbody", "thead"))
JUNK = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|side-?bar|comments?|commentlist|respond|disqus|cookies?|consent|gdpr"
    r"|notices?|alert|popup|modal|overlay|share|sharing|social|related|recommend\w*|newsletter|subscribe|subscription|menu|nav"
    r"|navbar|navigation|breadcrumbs?|footer|header|masthead|pagination|pager|toolbar|widget|login|signup|paywall)(?:$|[\s_-])",
    re.I,
)
#: Reader comments, which may be longer than the article; the second kind only outside of an article.
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|respond|disqus)(?:$|[\s_-])", re.I)
DISCUSSION = re.compile(r"(?:^|[\s_-])(?:reviews|discussions?)(?:$|[\s_-])", re.I)
#: Names that say what an element has or lacks, not what it is.
ABOUT = re.compile(r"(?<![^\s_-])(?:has|with|without|no)[_-]\S*", re.I)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
TAG_POINTS = {"article": 10.0, "main": 10.0, "div": 5.0, "section": 5.0, "blockquote": 3.0, "pre": 3.0, "td": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0}
#: A slash at the end of a tag; one behind an unquoted value belongs to the value.
EMPTY = re.compile(r"(?:^|[\s\"'])/$")
SENTENCE_END = re.compile(r"[.!?。…][\"'”’)]*$")


def _junk(tag: str, attributes: str) -> str:
    """How an element's attributes say that it is not part of the article: ``hidden``, only by its ``name``, or not.

    Names of reader comments give ``comments``, or ``discussion`` if they may be a part of an article too.
    """
    junk = ""
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").strip()
        if name in ("class", "id"):
            if tag not in ("html", "body", "article", "main"):
                said = ABOUT.sub("", value)
                if COMMENTS.search(said):
                    junk = "comments"
                elif JUNK.search(said):
                    junk = junk or "name"
                elif DISCUSSION.search(said):
                    junk = junk or "discussion"
        elif name == "role":
            if value.lower() in ROLES:
                return "hidden"
        elif name == "hidden":
            return "hidden"
        elif name == "aria-hidden":
            if value.lower() == "true":
                return "hidden"
        elif "display:none" in value.replace(" ", "").lower():
            return "hidden"
    return junk


class _Page:
    """The block elements of one page and the blocks of text on them.

    Elements with a name of junk are dropped, except those that start at a place in ``spared``;
    without ``spared`` names do not count. ``named`` has the place of each of them, the number of
    the one around it and whether it is, or is within, reader comments; ``within`` has the
    innermost around each block element.
    """

    def __init__(self, html: str, spared: set[int] | None = None):
        self.parent, self.tag, self.dropped = [-1], ["body"], [False]
        self.named: list[tuple[int, int, bool]] = []
        self.within = [-1]
        self.spared = spared
        self.blocks: list[tuple[int, str, int]] = []
        self._read(html)

    def _read(self, html: str) -> None:
        stack: list[tuple[str, int, bool, int]] = [("body", 0, False, -1)]
        buffer: list[str] = []
        linked = 0
        links = 0
        at = 0

        def flush() -> None:
            nonlocal linked
            if buffer:
                text = " ".join(references.unescape("".join(buffer)).split())
                if text:
                    self.blocks.append((stack_node(), text, min(linked, len(text))))
                buffer.clear()
            linked = 0

        def stack_node() -> int:
            return stack[-1][1]

        def pop_to(k: int) -> None:
            nonlocal links
            for name, *_ in stack[k:]:
                links -= name == "a"
            del stack[k:]

        def judged(tag: str, attributes: str, start: int) -> tuple[bool, int]:
            """Whether an element is dropped, and the innermost one with a name of junk."""
            _, _, hide, inside = stack[-1]
            junk = _junk(tag, attributes) if attributes else ""
            if junk == "discussion" and any(name in WHOLE for name, *_ in stack):
                junk = ""
            named = junk not in ("", "hidden")
            if named:
                comments = junk != "name" or (inside >= 0 and self.named[inside][2])
                self.named.append((start, inside, comments))
                inside = len(self.named) - 1
            by_name = named and self.spared is not None and start not in self.spared
            return hide or junk == "hidden" or by_name, inside

        for m in TOKEN.finditer(html):
            if m.start() > at:
                if not stack[-1][2]:
                    buffer.append(html[at : m.start()])
                    if links:
                        linked += m.start() - at
            at = m.end()
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if m["end"]:
                if tag in INLINE:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == tag:
                            pop_to(k)
                            break
                        if stack[k][0] not in INLINE:
                            break
                else:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == tag:
                            flush()
                            pop_to(k)
                            break
                    else:
                        flush()
                continue
            if tag in VOID:
                if tag in ("br", "hr"):
                    flush()
                continue
            attributes = m["rest"]
            if tag in INLINE:
                if not EMPTY.search(attributes):
                    stack.append((tag, stack_node(), *judged(tag, attributes, m.start())))
                    links += tag == "a"
                continue
            flush()
            if tag in ("html", "body"):
                continue
            closing = CLOSES.get(tag, ("p",))
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in closing or stack[k][0] == "p":
                    pop_to(k)
                    if tag not in ("tr", "td", "th"):
                        break
                elif stack[k][0] not in INLINE and (tag not in CLOSES or stack[k][0] in CONTAINS_LIST):
                    break
            node = len(self.parent)
            hide, inside = judged(tag, attributes, m.start())
            hide = hide or tag in NOT_TEXT
            self.parent.append(stack_node())
            self.tag.append(tag)
            self.dropped.append(hide)
            self.within.append(inside)
            if not EMPTY.search(attributes):
                stack.append((tag, node, hide, inside))
        if at < len(html) and not stack[-1][2]:
            buffer.append(html[at:])
        flush()

    def holders(self) -> set[int]:
        """Places of the elements with a name of junk around the longest article, or else around most of the unlinked text.

        An article within reader comments is a comment; comments are not around the text, whatever their length.
        """
        own = [0] * len(self.parent)
        for node, text, in_links in self.blocks:
            own[node] += len(text) - in_links
        comment = [k >= 0 and self.named[k][2] for k in self.within]
        total, held = sum(size for size, c in zip(own, comment, strict=True) if not c), [0] * len(self.named)
        for node, size in enumerate(own):
            if self.within[node] >= 0 and not comment[node]:
                held[self.within[node]] += size
        for k in range(len(held) - 1, -1, -1):
            if self.named[k][1] >= 0:
                held[self.named[k][1]] += held[k]
        for node in range(len(own) - 1, 0, -1):
            own[self.parent[node]] += own[node]
        whole = [i for i, t in enumerate(self.tag) if t in WHOLE and own[i] and not self.dropped[i] and not comment[i]]
        if not whole:
            return {self.named[k][0] for k, size in enumerate(held) if 2 * size > total}
        around, places = self.within[max(whole, key=lambda i: (own[i], -i))], set()
        while around >= 0:
            places.add(self.named[around][0])
            around = self.named[around][1]
        return places

    def main_text(self) -> str:
        blocks = [b for b in self.blocks if not self.dropped[b[0]]]
        if not blocks:
            return ""
        n = len(self.parent)
        points, length, linked = [0.0] * n, [0] * n, [0] * n
        for node, text, in_links in blocks:
            length[node] += len(text)
            linked[node] += in_links
            if self.tag[node] in HEADINGS:
                continue
            gain = 1 + text.count(",") + text.count("，") + text.count("、") + min(len(text) // 100, 3)
            own = node if self.tag[node] not in PARAGRAPHS else max(self.parent[node], 0)
            points[own] += gain
            if self.parent[own] >= 0:
                points[self.parent[own]] += gain / 2
        for node in range(n - 1, 0, -1):
            length[self.parent[node]] += length[node]
            linked[self.parent[node]] += linked[node]
        scores = [
            (p + TAG_POINTS.get(t, 0.0)) * (1 - (k / size if size else 0.0)) if p else 0.0
            for p, t, k, size in zip(points, self.tag, linked, length, strict=True)
        ]
        best = max(range(n), key=lambda i: (scores[i], -i))
        if scores[best] <= 0:
            best = 0
        up = best
        while up > 0 and self.tag[up] not in WHOLE:
            up = self.parent[up]
        kept = {up} if up > 0 else self._with_siblings(best, scores, length, linked, blocks)
        top = up if up > 0 else best
        for node in range(1, top):
            # a headline before the container
            if self.tag[node] == "h1" and self.parent[node] == self.parent[top] and 2 * linked[node] < length[node]:
                kept.add(node)
        inside = [False] * n
        for node in range(n):
            inside[node] = node in kept or (node > 0 and inside[self.parent[node]])
        return " ".join(text for node, text, _ in blocks if inside[node])

    def _with_siblings(self, best: int, scores: list[float], length: list[int], linked: list[int], blocks: list) -> set[int]:
        kept = {best}
        if best == 0:
            return kept
        last = {node: text for node, text, _ in blocks}
        for node in range(1, len(self.parent)):
            if node == best or self.parent[node] != self.parent[best] or self.dropped[node] or not length[node]:
                continue
            share = linked[node] / length[node]
            if scores[node] >= max(10.0, 0.2 * scores[best]):
                kept.add(node)
            elif self.tag[node] == "p" and (
                (length[node] > 80 and share < 0.25) or (share == 0 and SENTENCE_END.search(last.get(node, "")))
            ):
                kept.add(node)
        return kept


def main_text(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    page = _Page(html)
    if not page.named:
        return page.main_text()
    return _Page(html, page.holders()).main_text() or page.main_text()


def extract(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default all but the page and the new ones), ``text`` and ``n_chars``."""
    keep = [c for c in (pages.columns if keep is None else keep) if c not in ("text", "n_chars", html)]
    rows = pages.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{html}`").alias("_in"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*batch.schema.names[:-1], "text", "n_chars"],
            )

    return rows.mapInArrow(run, ", ".join([*fields, "text string", "n_chars long"]))
