"""Main text of web pages by composite text density.

A page becomes a tree. Elements that are never article text (menus, page headers and footers, sidebars, notices,
adverts, forms, scripts, styles, reader comments, hidden elements; told by tag, role, class or id) take no part with
their text; their tags count for the elements around them.
None of these signs but hiding decides alone. An element with a tag or role of noise stays where it holds an article,
main or h1 (a header needs an article or main, or must itself stand in one), or four fifths of the page's text outside
links; one with such a class or id where it holds an article, main or h1 or more than half of that text (reader comments
excepted). Text shares count only where no article or main with text lies outside. In a form that stays, controls and
labels go.
Every other node has a density: characters per tag, lowered as the share of link characters and link tags grows
(composite text density, Sun, Song and Liao, SIGIR 2011). The sum of its children's densities ranks subtrees. The
subtree of the largest sum under the body is the article's core and names a threshold: the least density on the path
from the body to it. If an article or main element on that path holds the core, all of it is the article. Otherwise
the article is the core with those subtrees beside the path, the body's own included, that are headings or reach the
threshold.

Tags are cut by a regular expression that never looks back, so a page takes time in proportion to its length.

Defined results: null, empty and text-free pages give an empty string and 0; markup cut off anywhere is read as far as
it goes; repeated rows give repeated rows; a null identifier or url stays null; a very long page is one row of one task;
of equally large sums the outermost node is chosen; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import bounded_batches, sliced

# A quote opens a value only behind "=". Repeats never give back what they took, and a quote that is never closed is one
# that no later tag can hold either, so reading all tags takes time in proportion to the page.
TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|[="'])*+)(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""(?i)\b(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
TOKEN = re.compile(r"[a-z]+")

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe noembed noframes".split())
RAW_END = {name: re.compile(f"(?ai)</{name}") for name in RAW | {"xmp"}}
BLOCK = frozenset(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre "
    "figure figcaption address details summary fieldset center hgroup header footer nav aside form dialog menu head search".split()
)
CLOSES_P = BLOCK - frozenset("html body head li dt dd caption thead tbody tfoot tr td th".split()) | {"hr"}
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
NOISE_TAGS = frozenset("nav header footer aside form menu dialog search".split())
NEVER_TEXT = frozenset("head button select datalist".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion promoted banner "
    "nav navbar navigation menu menubar topbar breadcrumb breadcrumbs header masthead footer sidebar aside "
    "notice notices cookie cookies consent gdpr popup modal overlay alert "
    "comment comments disqus replies respond share sharing social related recommended newsletter subscribe signup login search form widget pagination pager".split()
)
COMMENT_NAMES = frozenset("comment comments disqus replies respond".split())
NEVER_NOISE = frozenset("html body article main".split())


def noise_kind(tag: str, attributes: str) -> int:
    """4: never text; 2: noise by tag or role; 1: named like it by class or id; 3: named as reader comments; 0: neither."""
    if tag in NEVER_TEXT:
        return 4
    kind = 2 if tag in NOISE_TAGS else 0
    if not attributes:
        return kind
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "style" and "display:none" in value.replace(" ", ""):
            return 4
        if tag in NEVER_NOISE:
            continue
        if name == "role" and value.strip() in NOISE_ROLES or name == "aria-hidden" and value == "true":
            kind = 2
        if name in ("class", "id") and kind != 2 and not NOISE_NAMES.isdisjoint(tokens := TOKEN.findall(value)):
            kind = 1 if kind != 3 and COMMENT_NAMES.isdisjoint(tokens) else 3
    return kind


class Page:
    """Nodes of a page in order of their start tags, and its text blocks, each at a node."""

    def __init__(self, html: str):
        self.parent, self.tag, self.chars, self.link_chars, self.tags, self.link_tags = [-1], ["#page"], [0], [0], [0], [0]
        self.blocks: list[tuple[int, str]] = []
        self.named: dict[int, int] = {}  # nodes with a class or id of noise, and what kind
        self.dead: set[int] = set()  # nodes within what is hidden or never text
        self._read(html)
        if self.named:
            self._judge()
        for k in range(len(self.tag) - 1, 0, -1):  # children come after their parents
            p = self.parent[k]
            self.chars[p] += self.chars[k]
            self.link_chars[p] += self.link_chars[k]
            self.tags[p] += self.tags[k] + 1
            self.link_tags[p] += self.link_tags[k] + (self.tag[k] == "a")

    def _judge(self) -> None:
        """Take out noise: first what tag or role tells, then what is only named like it and what is left of the text."""
        self._drop({k for k, kind in self.named.items() if kind == 2}, 5, 4)
        self._drop({k for k, kind in self.named.items() if kind in (1, 3)}, 2, 1)

    def _drop(self, noise: set[int], whole: int, share: int) -> None:
        """Take out those nodes that hold no article, main or h1 and no more than `share` of `whole` parts of the text."""
        n = len(self.tag)
        text = [c - lc for c, lc in zip(self.chars, self.link_chars, strict=True)]
        marks, tops = [0] * n, [0] * n
        holds = [False] * n  # an article or main with text
        for k in range(n - 1, 0, -1):
            p, t = self.parent[k], self.tag[k]
            if k not in self.dead:
                tops[k] += t in ("article", "main")
                marks[k] += t in ("article", "main", "h1")
            text[p] += text[k]
            marks[p] += marks[k]
            tops[p] += tops[k]
            holds[k] = holds[k] or t in ("article", "main") and text[k] > 0
            holds[p] = holds[p] or holds[k]
        gone, within = [False] * n, [False] * n
        for k in range(1, n):
            p, t = self.parent[k], self.tag[k]
            within[k] = within[p] or t in ("article", "main")
            if k in noise:
                kept = tops[k] or within[k] and marks[k] if t == "header" and self.named[k] == 2 else marks[k]
                kept = kept or self.named[k] != 3 and whole * text[k] > share * text[0] and not holds[0]
            else:
                kept = self.named.get(k) != 5
            gone[k] = gone[p] or not kept
            if gone[k]:
                self.chars[k] = self.link_chars[k] = self.tags[k] = 0
        self.blocks = [(node, t) for node, t in self.blocks if not gone[node]]

    def _read(self, html: str) -> None:
        stack, noise, links = [0], 0, 0  # open nodes; depth of the outermost noise element or 0; open links
        homes, parts = [0], []  # open blocks, and the text of the one being read
        open_tags: Counter[str] = Counter()
        endless: set[str] = set()  # raw elements that nothing ends from here on

        def flush() -> None:
            nonlocal parts
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    self.blocks.append((homes[-1], text))
                parts = []

        def close(depth: int) -> None:
            nonlocal noise, links
            while len(stack) > depth:
                node = stack.pop()
                t = self.tag[node]
                open_tags[t] -= 1
                links -= t == "a"
                if t in BLOCK or node in self.named:
                    flush()
                    homes.pop()
            if noise >= depth:
                noise = 0

        def text(raw: str, plain: bool = False) -> None:
            if noise or not raw:
                return
            got = unescape(raw) if "&" in raw and not plain else raw
            n = len(got) - got.count(" ") - got.count("\n")
            if n:
                self.chars[stack[-1]] += n
                if links:
                    self.link_chars[stack[-1]] += n
            parts.append(got)

        at, end = 0, len(html)
        while at < end:
            m = TAG.search(html, at)
            if m is None:
                text(html[at:])
                break
            text(html[at : m.start()])
            at = m.end()
            slash, name, attributes = m[1], m[2], m[3]
            if not name:
                continue
            name = name.lower()
            if slash:
                if not open_tags[name]:
                    continue
                block = name in BLOCK
                for depth in range(len(stack) - 1, 0, -1):
                    t = self.tag[stack[depth]]
                    if t == name:
                        close(depth)
                        break
                    if not block and t in BLOCK:  # an inline end tag ends nothing beyond its block
                        break
                continue
            if name in CLOSES_P and open_tags["p"]:
                for depth in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[depth]] == "p":
                        close(depth)
                        break
                    if self.tag[stack[depth]] in BLOCK:
                        break
            if name in SIBLINGS:
                ends, within = SIBLINGS[name]
                for depth in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[depth]] in ends:
                        close(depth)
                        break
                    if self.tag[stack[depth]] in within:
                        break
            if name in RAW_END:
                found = None if name in endless else RAW_END[name].search(html, at)
                if found is None:
                    endless.add(name)
                    if name == "noscript":
                        continue
                begin, at = at, end if found is None else found.start()
                if name == "xmp":
                    flush()
                    text(html[begin:at], plain=True)
                    flush()
                continue
            if name in VOID or attributes.endswith("/") and name not in BLOCK:
                if not noise:
                    parts.append(" ")
                    self.tags[stack[-1]] += 1
                continue
            if name in BLOCK:
                flush()
            self.parent.append(stack[-1])
            self.tag.append(name)
            for column in (self.chars, self.link_chars, self.tags, self.link_tags):
                column.append(0)
            stack.append(len(self.tag) - 1)
            open_tags[name] += 1
            links += name == "a"
            kind = 0 if noise else noise_kind(name, attributes)
            if name in ("label", "legend") and not kind and open_tags["form"]:
                kind = 5  # goes with the controls of its form, if the form itself stays
            if kind == 4:
                noise = len(stack) - 1
            elif kind:
                flush()
                self.named[stack[-1]] = kind
            if noise:
                self.dead.add(stack[-1])
            if name in BLOCK or kind in (1, 2, 3, 5):
                homes.append(stack[-1])
        flush()


def densities(page: Page) -> list[float]:
    """Composite text density of every node."""
    body = page.tag.index("body") if "body" in page.tag else 0
    ratio = page.link_chars[body] / max(1, page.chars[body])
    out = []
    for c, lc, t, lt in zip(page.chars, page.link_chars, page.tags, page.link_tags, strict=True):
        if c == 0:
            out.append(0.0)
            continue
        t, lt = max(1, t), max(1, lt)
        base = math.log(c / max(1, c - lc) * lc + ratio * c + math.e)
        value = c / max(1, lc) * t / lt
        out.append(c / t * max(0.0, math.log(value) / math.log(base)) if base > 1 + 1e-9 else c / t * max(0.0, math.log(value + math.e - 1)))
    return out


def main_text(html: str | None) -> str:
    """Blocks of the article, joined by two line ends."""
    if not html:
        return ""
    page = Page(html)
    if not page.blocks:
        return ""
    n, density = len(page.tag), densities(page)
    sums = [0.0] * n
    for k in range(n - 1, 0, -1):
        sums[page.parent[k]] += density[k]
    body = page.tag.index("body") if "body" in page.tag else 0
    best_of = list(range(n))  # node of the largest sum in each subtree; the outermost of equals
    for k in range(n - 1, 0, -1):
        p = page.parent[k]
        if sums[best_of[k]] > sums[best_of[p]] or best_of[p] != p and sums[best_of[k]] == sums[best_of[p]]:
            best_of[p] = best_of[k]
    top = best_of[body]
    path = [top]
    while path[-1] != body and path[-1] > 0:
        path.append(page.parent[path[-1]])
    threshold = min(density[k] for k in path)
    whole = next((k for k in reversed(path) if page.tag[k] in ("article", "main")), top)
    above = set(path[path.index(whole) + 1 :])
    if page.tag[whole] in ("article", "main"):
        above -= {body, *page.named}  # what stands there by itself is no part of the article
    keep = [False] * n
    keep[whole] = True
    for k in range(1, n):
        p = page.parent[k]
        keep[k] = keep[k] or keep[p] or p in above and k not in above and (page.tag[k] in HEADINGS or density[k] >= threshold > 0)
    found = [text for node, text in page.blocks if keep[node] or node in above]
    return "\n\n".join(found or [text for _, text in page.blocks])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars of every page."""
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = [main_text(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "id bigint, url string, text string, n_chars bigint").withColumnsRenamed({"id": id_col, "url": url_col})
