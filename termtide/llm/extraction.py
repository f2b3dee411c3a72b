"""Main text of HTML pages by composite text density.

Every node of a page's tree has a density: its characters per tag, lowered for characters in links.
The sum of its children's densities tells a node that holds running text. From the root down, a
node as dense as the thinnest one on the path to the best node contributes its best subtree, and
the smallest subtree around all of these is the article, without the parts that
their tag, role or class names as something else, or that are mostly links.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from termtide.llm.common import parts

# Quoted values may hold ">"; possessive, so an unclosed tag costs no backtracking.
_TAG = re.compile(
    r"""<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*'|["'])*+)>?"""
    r"""|<[!?/][^>]*>?""", re.S)
_COMMENT_END = re.compile(r"-->|--!>|\Z")
_ATTRIBUTE = re.compile(
    r"""([a-zA-Z_:][-\w:.]*+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Their content is not markup; it is skipped up to the end tag.
RAW = frozenset("script style title textarea noscript template iframe noframes xmp svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu "
    "nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul"
    .split())
# An opening tag ends an open element of these names, up to the nearest of the second.
ENDS = {
    "li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)),
    "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")),
    "th": ("td th", ("tr", "table")), "option": ("option", ("select",)),
    "tbody": ("tr td th tbody thead", ("table",)), "tfoot": ("tr td th tbody thead", ("table",)),
}
_P_SCOPE = ("button", "table", "td", "th", "caption", "object", "html")
# Parts that are not the article, by tag, by role and by words in class or id.
OTHER_TAGS = frozenset(
    "nav footer aside form button select menu head dialog fieldset object audio video canvas "
    "search".split())
OTHER_ROLES = frozenset(
    "navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar "
    "toolbar".split())
OTHER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion "
    "banner cookie cookies consent gdpr notice notices alert popup modal overlay paywall "
    "sidebar aside nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc "
    "header masthead footer comment comments commentlist disqus respond replies discussion "
    "related recommended share sharing social newsletter subscribe signup login widget".split())
# Names that hold the article itself, whatever their class.
KEPT = frozenset("html body article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
RUNNING = frozenset("p blockquote pre".split())
MOSTLY_LINKS = 0.6


class Page:
    """The tree of a page: arrays by node in document order, a parent before its children."""

    def __init__(self, html: str):
        self.tag, self.parent, self.other, self.named = ["#root"], [0], [False], [False]
        self.texts: list[tuple[int, int, str]] = []  # node, block, text
        self._parse(html)

    def _parse(self, html: str) -> None:
        stack, block, at = [0], 0, 0
        open_tags: dict[str, int] = {}
        lower: str | None = None

        def close(depth: int) -> None:
            while len(stack) > depth:
                open_tags[self.tag[stack.pop()]] -= 1

        def close_nearest(names: tuple[str, ...] | list[str], until: tuple[str, ...]) -> None:
            if any(open_tags.get(name) for name in names):
                for depth in range(len(stack) - 1, 0, -1):
                    tag = self.tag[stack[depth]]
                    if tag in names:
                        close(depth)
                        return
                    if tag in until:
                        return

        def text(lo: int, hi: int) -> None:
            if lo < hi:
                self.texts.append((stack[-1], block, unescape(html[lo:hi])))

        find = html.find
        while (lt := find("<", at)) >= 0:
            if html.startswith("<!--", lt):
                text(at, lt)
                at = _COMMENT_END.search(html, lt + 4).end()
                continue
            m = _TAG.match(html, lt)
            if m is None:
                text(at, lt + 1)
                at = lt + 1
                continue
            text(at, lt)
            at = m.end()
            if not m[2]:
                continue
            name = m[2].lower()
            if name in BLOCK:
                block += 1
            if m[1]:
                if open_tags.get(name):
                    depth = len(stack) - 1
                    while self.tag[stack[depth]] != name:
                        depth -= 1
                    close(depth)
                continue
            if name == "br":
                self.texts.append((stack[-1], block, " "))
                continue
            if name in ENDS:
                names, until = ENDS[name]
                close_nearest(names.split(), until)
            elif name in BLOCK and open_tags.get("p"):
                close_nearest(("p",), _P_SCOPE)
            self.tag.append(name)
            self.parent.append(stack[-1])
            other, named = self._is_other(name, m[3], open_tags)
            self.other.append(other)
            self.named.append(named)
            if name in RAW:
                lower = html.lower() if lower is None else lower
                if len(lower) != len(html):  # a letter whose lower case is longer
                    end = re.compile(f"</{re.escape(name)}", re.I).search(html, at)
                    end = end.start() if end else -1
                else:
                    end = lower.find(f"</{name}", at)
                at = len(html) if end < 0 else end
            elif name not in VOID and not m[3].endswith("/"):
                stack.append(len(self.tag) - 1)
                open_tags[name] = open_tags.get(name, 0) + 1
        text(at, len(html))

    @staticmethod
    def _is_other(name: str, attributes: str, open_tags: dict[str, int]) -> tuple[bool, bool]:
        """Whether the node is not the article by tag, role or style, and by a word of its name."""
        if name in OTHER_TAGS or name == "header" and not open_tags.get("article"):
            return True, False
        if not attributes.strip() or name in KEPT:
            return False, False
        named = False
        for key, *values in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), "".join(values).lower()
            if (key == "hidden" or key == "aria-hidden" and value == "true"
                    or key == "role" and value in OTHER_ROLES
                    or key == "style" and "display:none" in value.replace(" ", "")):
                return True, False
            if key in ("class", "id") and not OTHER_WORDS.isdisjoint(_NAME.findall(value)):
                named = True
        return False, named

    def _marks(self, last: list[int]) -> list[bool]:
        """The nodes that are not the article. A name does not count on a node with most of the
        text; with an article on the page only if the article is in the node or around it."""
        marks = [a or b for a, b in zip(self.other, self.named, strict=True)]
        if not any(self.named):
            return marks
        hidden, chars = self._hidden(self.other), [0] * len(marks)
        for node, _, text in self.texts:
            if not hidden[node]:
                chars[node] += len(text.strip())
        for i in range(len(marks) - 1, 0, -1):
            chars[self.parent[i]] += chars[i]
        articles = [i for i, tag in enumerate(self.tag)
                    if tag in ("article", "main") and not hidden[i] and chars[i]]
        for i, named in enumerate(self.named):
            if named and 2 * chars[i] > chars[0] and (not articles or any(
                    i <= a <= last[i] or a <= i <= last[a] for a in articles)):
                marks[i] = False
        return marks

    def _last(self) -> list[int]:
        """For every node the last node of its subtree."""
        last = list(range(len(self.tag)))
        for i in range(len(last) - 1, 0, -1):
            last[self.parent[i]] = max(last[self.parent[i]], last[i])
        return last

    def _hidden(self, marks: list[bool]) -> list[bool]:
        hidden = list(marks)
        for i in range(1, len(hidden)):
            hidden[i] = hidden[i] or hidden[self.parent[i]]
        return hidden

    def _join(self, lo: int, hi: int, hidden: list[bool]) -> str:
        blocks: dict[int, list[str]] = {}
        for node, block, text in self.texts:
            if lo <= node <= hi and not hidden[node]:
                blocks.setdefault(block, []).append(text)
        lines = (" ".join("".join(parts).split()) for parts in blocks.values())
        return "\n".join(line for line in lines if line)

    def main_text(self) -> str:
        last = self._last()
        hidden = self._hidden(self._marks(last))
        if not any(t.strip() and not hidden[node] for node, _, t in self.texts):
            hidden = self._hidden([tag in OTHER_TAGS for tag in self.tag])
        n, parent = len(self.tag), self.parent
        chars, links = [0] * n, [0] * n  # in the subtree; in links
        tags, link_tags = [0] * n, [0] * n  # below the node
        in_link = [tag == "a" for tag in self.tag]
        for i in range(1, n):
            in_link[i] = in_link[i] or in_link[parent[i]]
        for node, _, text in self.texts:
            if not hidden[node]:
                size = len(text.strip())
                chars[node] += size
                if in_link[node]:
                    links[node] += size
        for i in range(n - 1, 0, -1):
            up = parent[i]
            chars[up] += chars[i]
            links[up] += links[i]
            if not hidden[i]:
                tags[up] += tags[i] + 1
                link_tags[up] += link_tags[i] + (self.tag[i] == "a")
        share = links[0] / (chars[0] or 1)
        density, sums = [0.0] * n, [0.0] * n
        for i in range(n - 1, -1, -1):
            c, lc = chars[i], links[i]
            if c and not hidden[i]:
                base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
                ratio = c / max(1, lc) * (tags[i] or 1) / (link_tags[i] or 1)
                density[i] = c / (tags[i] or 1) * max(
                    0.0, math.log(ratio) / math.log(base) if base > 1 else math.log(max(ratio, 1)))
            if i:
                sums[parent[i]] += density[i]
        root = self._root(chars, last, hidden)
        best = max(range(root, last[root] + 1), key=lambda i: (sums[i], -i))
        threshold, i = density[best], best
        while i != root:
            i = parent[i]
            threshold = min(threshold, density[i])
        prose = [chars[i] > 0 and not hidden[i] and links[i] <= MOSTLY_LINKS * chars[i]
                 for i in range(n)]
        top = self._around(root, best, threshold, density, sums, last, prose)
        drop = list(hidden)
        for i in range(top + 1, last[top] + 1):
            if (self.tag[i] in BLOCK and link_tags[i] > 1
                    and links[i] > MOSTLY_LINKS * max(1, chars[i])):
                drop[i] = True
        return self._join(top, last[top], self._hidden(drop))

    def _root(self, chars: list[int], last: list[int], hidden: list[bool]) -> int:
        """The outermost article or main element that holds most of the text, or the page."""
        i, n = 1, len(self.tag)
        while i < n:
            if self.tag[i] in ("article", "main") and not hidden[i]:
                if 2 * chars[i] > chars[0]:
                    return i
                i = last[i]
            i += 1
        return 0

    def _around(self, root: int, best: int, threshold: float, density: list[float],
                sums: list[float], last: list[int], prose: list[bool]) -> int:
        """The smallest subtree around the best subtrees of all nodes that are dense enough, a node
        without children being its own. In an article or main element the headings before the
        best node, and running text beside the path to it, belong to them whatever their length."""
        # The best node of every subtree, bottom up; ties to the first in page order.
        top = list(range(len(sums)))
        for i in range(last[root], root, -1):
            up = self.parent[i]
            if (sums[top[i]], -top[i]) > (sums[top[up]], -top[up]):
                top[up] = top[i]
        dense = [False] * len(sums)
        lo = hi = best
        for i in range(root, last[root] + 1):
            dense[i] = density[i] >= threshold > 0 and (i == root or dense[self.parent[i]])
            if dense[i] and (sums[top[i]] > 0 or prose[i]):
                lo, hi = min(lo, top[i]), max(hi, last[top[i]])
        if root:
            path, i = {best}, best
            while i != root:
                i = self.parent[i]
                path.add(i)
            for i in range(root + 1, last[root] + 1):
                if prose[i] and (self.tag[i] in HEADINGS and i < best
                                 or self.tag[i] in RUNNING and self.parent[i] in path):
                    lo, hi = min(lo, i), max(hi, last[i])
        while not (lo <= last[lo] and last[lo] >= hi) and lo != root:
            lo = self.parent[lo]
        return lo


def main_text(html: str | None) -> str:
    """The article of a page: its blocks of text in page order, one a line; empty if none."""
    return Page(html).main_text() if html else ""


def extract(df: DataFrame, html: str = "html", output: str = "main_text") -> DataFrame:
    """Every row of ``df`` with the main text of the whole page in ``output``, which must not be
    a column yet. A null or empty page, and one without text, gives an empty text. Broken markup
    is read as far as it goes; an unclosed comment or script hides the rest."""
    if output in df.columns:
        raise ValueError(f"the input already has a column {output}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = [main_text(h) for h in batch.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())],
                                             names=[*batch.schema.names, output])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(output, T.StringType())]))
