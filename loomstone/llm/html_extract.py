"""HTML extraction by composite text density.

For every element of the page: characters per tag, adjusted by how many of its characters and tags
are links. The densities of an element's children are summed; the element with the largest sum is
the core of the page, and the least density on the way from it up to the body is the page's
threshold. From the body down, each element at the threshold or above gives its subtree of largest
sum. Elements that can't be content by their kind are left out of all of it, and so are those whose
name tells of a menu, an advert and the like, unless the page says otherwise: a name counts only where
what bears it holds a minor share of the page's text, or stands beside its article, and doesn't hold that.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import shared

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NEVER = frozenset("script style noscript template head iframe object embed svg canvas audio video map nav footer aside button select option textarea input menu dialog title".split())
#: An opening tag of the first kind ends an open element of the second, within the nearest of the third.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
#: Words in a class, id or role that tell of a menu, an advert, a notice and the like.
NAMES = re.compile(r"(?<![a-z])(?:ads?|advert\w*|adverts?|banner|breadcrumbs?|byline|comments?|consent|cookies?|copyright|disqus|footer|gdpr|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notices|pagination|paywall|popup|promo\w*|recommended|related|replies|respond|share|sharing|sidebar|sidenav|social|sponsor\w*|subscribe|toolbar|widget)(?![a-z])")
#: The largest shares of the body's text outside links that the bearers of a name may hold together for
#: it to count: a name that is a whole class, id or role (and a form), and one that is a part of it.
WHOLE_SHARE, PART_SHARE = 0.5, 0.25
#: How often the text of the page's marked article the bearers of whole names beside it may hold.
BESIDE = 4
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_HINT = re.compile(r"(?:^|[\s\"'])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


class _Page:
    """The elements of a page in order of their start: parents stand before children."""

    def __init__(self, source: str) -> None:
        self.tag = ["#root"]
        self.parent = [-1]
        self.kids: list[list[int | str]] = [[]]
        self.drop = [False]
        #: (word, whether it stands alone) of each element that bears a name
        self.names: dict[int, frozenset[tuple[str, bool]]] = {}
        self.body = 0
        self._read(source)
        if self.names:
            self._drop_named()

    def _open(self, stack: list[int], tag: str, attributes: str) -> int:
        node, up = len(self.tag), stack[-1]
        self.tag.append(tag)
        self.parent.append(up)
        self.kids.append([])
        drop = tag in NEVER or tag == "header" and not any(self.tag[i] in ("article", "main") for i in stack)
        names = [("form", True)] if tag == "form" else []
        if not drop and attributes and tag not in ("body", "html", "article", "main"):
            for m in _HINT.finditer(attributes):
                key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
                if key == "hidden" or key == "aria-hidden" and value == "true":
                    drop = True
                elif key in ("class", "id", "role"):
                    names += [(n[0], n[0] == token) for token in value.split() for n in NAMES.finditer(token)]
        self.drop.append(drop)
        if names and not drop:
            self.names[node] = frozenset(names)
        self.kids[up].append(node)
        return node

    def _sizes(self) -> list[int]:
        """The characters of each element outside links."""
        size = [0] * len(self.tag)
        for i in range(len(self.tag) - 1, -1, -1):
            if not self.drop[i] and self.tag[i] != "a":
                size[i] = sum(len("".join(k.split())) if isinstance(k, str) else size[k] for k in self.kids[i])
        return size

    def _drop_named(self) -> None:
        """Drop the elements that bear a name which counts on this page."""
        n = len(self.tag)
        size, article = self._sizes(), [False] * n
        # The page's article: main, and the longest of the articles, since comments may be articles too.
        longest = max((i for i in range(n) if self.tag[i] == "article"), key=lambda i: size[i], default=0)
        marked = {i for i in range(n) if self.tag[i] == "main" or i == longest and i}
        for i in range(n - 1, 0, -1):
            if i in marked or article[i]:
                article[self.parent[i]] = True
        above: list[frozenset[tuple[str, bool]]] = [frozenset()] * n
        for i in range(1, n):
            above[i] = above[self.parent[i]] | self.names[i] if i in self.names else above[self.parent[i]]
        barred = frozenset().union(*(self.names[i] for i in self.names if article[i]))

        def held() -> dict[tuple[str, bool], int]:
            out: dict[tuple[str, bool], int] = {}
            for i, names in self.names.items():
                for name in names - above[self.parent[i]] - barred:
                    out[name] = out.get(name, 0) + size[i]
            return out

        # Beside an article that the page marks and no name covers, whole names count even if the article is the shorter.
        clear = max((size[i] for i in marked if not above[i]), default=0)
        whole = {name: chars for name, chars in held().items() if name[1] and name[0] != "form"}
        if sum(whole.values()) <= BESIDE * clear:
            for i, names in self.names.items():
                self.drop[i] = self.drop[i] or not names.isdisjoint(whole)
            size = self._sizes()
        total = size[self.body]
        counts = {name for name, chars in held().items() if (not chars or chars < total * (WHOLE_SHARE if name[1] else PART_SHARE))}
        # Names that each hold little may hold most of the text together: then the whole ones alone count, or none.
        for trusted in (counts, {name for name in counts if name[1]}, set()):
            gone, lost = [False] * n, 0
            for i in range(1, n):
                up = gone[self.parent[i]]
                gone[i] = up or i in self.names and not trusted.isdisjoint(self.names[i])
                if gone[i] and not up:
                    lost += size[i]
            if not lost or lost < total * WHOLE_SHARE:
                break
        for i in self.names:
            self.drop[i] = self.drop[i] or not trusted.isdisjoint(self.names[i])

    def _read(self, source: str) -> None:
        stack, at, end = [0], 0, len(source)
        while at < end:
            m = _TOKEN.search(source, at)
            if m is None:
                self.kids[stack[-1]].append(source[at:])
                break
            if m.start() > at:
                self.kids[stack[-1]].append(source[at : m.start()])
            at = max(m.end(), m.start() + 1)
            if not m[2]:
                if m[0].startswith("<![CDATA["):
                    self.kids[stack[-1]].append(m[0][9:].removesuffix("]]>"))
                continue
            tag = m[2].lower()
            if m[1]:
                if tag in ("p", "br") and not any(self.tag[i] == tag for i in stack):
                    self.kids[stack[-1]].append(" ")
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == tag:
                        del stack[k:]
                        break
                    if tag in INLINE and self.tag[stack[k]] not in INLINE:  # a stray end of an inline element ends no block
                        break
                continue
            if tag not in INLINE:
                for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                    if self.tag[stack[k]] == "p":
                        del stack[k:]
                        break
                    if self.tag[stack[k]] not in INLINE:
                        break
            if tag in ENDS:
                ended, within = ENDS[tag]
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] in within:
                        break
                    if self.tag[stack[k]] in ended:
                        del stack[k:]
                        break
            if tag == "body" and self.body:
                continue
            node = self._open(stack, tag, m[3])
            if tag == "body":
                self.body = node
                self.drop[node] = False
            if tag in VOID or m[3].endswith("/") and tag not in ("p", "div", "article", "body", "section", "li"):
                continue
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(source, at)
                self.kids[node].append(source[at : close.start() if close else end])
                if close:
                    stop = source.find(">", close.end())
                    at = end if stop < 0 else stop + 1
                else:
                    at = end
                continue
            stack.append(node)


def _densities(page: _Page) -> tuple[list[float], list[float], list[int]]:
    """(density, sum of the children's densities, characters) of each element.

    Text that stands beside blocks counts as a child of its own; an element without blocks in it has
    its own density for its sum.
    """
    n = len(page.tag)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    loose, blocks = [0] * n, [False] * n
    for i in range(n - 1, -1, -1):
        if page.drop[i]:
            continue
        for kid in page.kids[i]:
            if isinstance(kid, str):
                own = len("".join(kid.split()))
                chars[i] += own
                loose[i] += own
            elif not page.drop[kid]:
                chars[i] += chars[kid]
                tags[i] += tags[kid] + 1
                link_chars[i] += link_chars[kid]
                link_tags[i] += link_tags[kid]
                if page.tag[kid] in INLINE:
                    loose[i] += loose[kid]
                    blocks[i] = blocks[i] or blocks[kid]
                else:
                    blocks[i] = True
        if page.tag[i] == "a":
            link_chars[i] = chars[i]
            link_tags[i] += 1
            loose[i] = 0
    body = page.body
    share = link_chars[body] / chars[body] if chars[body] else 0.0
    density = [0.0] * n
    for i in range(n):
        c = chars[i]
        if not c:
            continue
        # Counts of zero stand as one, so that the logarithms are defined.
        lc, lt, t = max(1, link_chars[i]), max(1, link_tags[i]), max(1, tags[i])
        base = math.log(c / max(1, c - link_chars[i]) * lc + share * c + math.e)
        density[i] = c / t * max(0.0, math.log(max(1.0, c / lc * t / lt))) / math.log(base)
    sums = [float(x) if b else d for x, b, d in zip(loose, blocks, density)]
    for i in range(1, n):
        if page.tag[i] not in INLINE and not page.drop[i]:
            up = page.parent[i]
            while page.tag[up] in INLINE and up:
                up = page.parent[up]
            sums[up] += density[i]
    return density, sums, chars


def _text(page: _Page, roots: list[int]) -> str:
    blocks: list[str] = []
    run: list[str] = []

    def end_block() -> None:
        if line := " ".join(html.unescape("".join(run)).split()):
            blocks.append(line)
        run.clear()

    for root in roots:
        todo: list[tuple[int, int]] = [(root, 0)]
        end_block()
        while todo:
            node, k = todo.pop()
            kids = page.kids[node]
            while k < len(kids):
                kid = kids[k]
                k += 1
                if isinstance(kid, str):
                    run.append(kid)
                elif page.tag[kid] in ("br", "wbr"):
                    run.append("\n" if page.tag[kid] == "br" else "")
                elif not page.drop[kid]:
                    if page.tag[kid] not in INLINE:
                        end_block()
                    todo.append((node, k))
                    todo.append((kid, 0))
                    break
            else:
                if page.tag[node] not in INLINE:
                    end_block()
        end_block()
    return "\n\n".join(blocks)


def main_text(source: str | None) -> str:
    """The main text of a page: blocks in page order, parted by two line feeds; empty if there is none."""
    if not source:
        return ""
    page = _Page(source)
    density, sums, chars = _densities(page)
    n, body = len(page.tag), page.body
    inside = [False] * n
    inside[body] = True
    for i in range(body + 1, n):
        inside[i] = inside[page.parent[i]] and not page.drop[i]
    block = [inside[i] and (i == body or page.tag[i] not in INLINE) for i in range(n)]
    # The best subtree at or below each element; of equals the deeper if it holds all the text.
    best = list(range(n))
    for i in range(n - 1, body, -1):
        up = page.parent[i]
        if not (inside[i] and inside[up] and block[best[i]]):
            continue
        mine, theirs = sums[best[i]], sums[best[up]]
        if not block[best[up]] or mine > theirs or mine == theirs and chars[best[i]] == chars[up]:
            best[up] = best[i]
    core = up = best[body]
    threshold = density[core]
    while up != body:
        up = page.parent[up]
        threshold = min(threshold, density[up])
    chosen = {best[i] for i in range(body, n) if block[i] and density[i] and density[i] >= threshold}
    roots, covered = [], [False] * n
    for i in range(body, n):
        above = i != body and covered[page.parent[i]]
        covered[i] = above or i in chosen
        if i in chosen and not above:
            roots.append(i)
    return _text(page, roots or [body])  # too little text for densities: all of it


def extract(spark: SparkSession, pages: DataFrame, source: str = "html") -> DataFrame:
    """`pages` with text and n_chars in place of the source.

    A null or empty page, and one without text, has an empty text and 0 characters. Every page is read
    as a whole; markup that is cut short or badly nested is read as far as it goes.
    """
    shared.ship(spark)

    @F.pandas_udf("string")
    def text_of(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in columns:
            yield pd.Series([main_text(x) for x in column], dtype=object)

    kept = [F.col(f"`{c}`") for c in pages.columns if c not in (source, "text", "n_chars")]
    out = pages.select(*kept, text_of(F.col(f"`{source}`")).alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
