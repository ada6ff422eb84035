"""Main text of web pages by wrapper induction over pages of the same host.

1. One page of each host, chosen by hash, is the host's pattern.
2. Every other page of the host is aligned with it by simple tree matching:
   nodes with equal labels (tag, class, id) match, children are aligned in
   order so that most nodes match. Runs of siblings with the same label align
   as one repeating node, so the alignment of long lists stays small; their
   texts are compared one by one.
3. For each text of the pattern the pages that have its node, and those with the
   same text in it, are counted over all pages of the host. A text that
   hardly ever changes (``CONSTANT``, over ``LEAST_PAGES`` pages at least) is
   template, a node whose text varies is a slot.
4. Every page is aligned again. Its main text is the text of the slots and of
   nodes that the pattern does not have, inside its articles (or, without any,
   its body), without the parts that a page's own markup names as menus,
   headers, footers, sidebars, notices, adverts, forms or comments. A heading in
   an article stays even if all pages of the host have it, as "Summary".

What only part of a host's pages have and the pattern page lacks is not known as
template. If template is all a page's article has (a host whose pages are copies),
it is kept. Blocks are joined by one space and white space is made one space.

Defined cases: null, empty and text-free html give an empty text; a host with
one page has no template; pages without url form one host; rows that repeat a
page are extracted alike; broken markup is closed as browsers close it.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import Recent, per_worker, slices, text_of, written

CONSTANT, LEAST_PAGES = 0.9, 5
CACHED_PATTERNS = 200
#: Up to this many bytes of patterns, or rows of chosen pages, are broadcast to the pages; beyond, a shuffle joins them.
BROADCAST_BYTES, BROADCAST_ROWS = 32 << 20, 1_000_000

# fixed values: element groups of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                     "header hr main menu nav ol p pre section table ul".split())
ENDS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)),
        "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
# elements and class or id words of parts that are not the main text
APART = frozenset("head nav footer aside form script style noscript template iframe object svg canvas button select textarea dialog".split())
APART_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
                        "notice notices alert popup modal newsletter subscribe subscription sidebar widget related recommended share "
                        "sharing social comment comments disqus reply replies breadcrumb breadcrumbs menu nav navbar navigation "
                        "pagination pager login signup search masthead".split())
#: Class or id tokens that tell of a layout or a state, as with-sidebar, hasMenu or comments-open.
_LAYOUT = re.compile(r"(?:with|without|has|no|With|Has|No)(?=[-_A-Z])|.*[-_](?:open|closed|enabled|disabled)$", re.S)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words for a part of a page or its place. In a name of several words they stand behind the word that says
#: what the part is: share-buttons and sidebar-left are apart, share-price and search-methods are not.
PART_WORDS = frozenset("section area block box container list wrapper wrap form posts links bar item items title text inner outer left right "
                       "top bottom main primary secondary slot unit group row col column panel holder zone button buttons link icon icons "
                       "label toggle content body head media inline fixed sticky js".split())
#: Apart outside of articles only: an article's own title block may be called a header.
OUTER, OUTER_WORDS = frozenset(["header"]), frozenset(["header", "footer", "topbar", "toolbar"])

# a script or style without end tag reaches to the end; of the other raw elements, one that is closed
# at once, or not before the next of its name, loses its tag alone: what follows it is page text
_TOKEN = re.compile(
    r"<(script|style)(?=[\s/>])[^>]*+>.*?(?:</\1\s*+>|\Z)"
    r"|<(noscript|template|iframe|textarea|title)(?=[\s/>])(?:[^>]*[^>/])?+>(?:(?!<\2[\s/>]).)*?</\2\s*+>"
    r"|</?(?:noscript|template|iframe|textarea|title)(?=[\s/>])[^>]*+>"
    r"|<!--.*?(?:-->|\Z)|<[!?][^>]*+>"
    r"|</([a-z][^\s/>]*+)[^>]*+>"
    r"|<([a-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<([a-z][^\s/>]*+)([^>]*+)>", re.I | re.S)
_NAMED = re.compile(r"""(?<![^\s"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _name_words(tag: str, names: list[tuple[str, str]]) -> set[str]:
    """What an element's class, id and role name it as: of every name the last word that is not one
    for a part or place, or the first if all are."""
    out: set[str] = set()
    for kind, value in names:
        for token in value.split():
            words = [w.lower() for w in _NAME_PARTS.findall(token) if len(w) > 1]  # not the x of 728x90
            if _LAYOUT.match(token) or not words or kind == "id" and tag in HEADINGS:
                continue
            telling = [w for w in words if w not in PART_WORDS] or words[:1]
            out.add(telling[-1])
    return out


class Page:
    """A page's elements in document order, as parallel lists; ``runs`` are its texts with their element."""

    def __init__(self, source: str):
        self.tag, self.label, self.parent, self.kids, self.apart = ["#"], ["#"], [-1], [[]], [False]
        self.runs: list[tuple[int, str]] = []  # (element, text); element -1: a block boundary
        self.inside = [False]  # within an article or main element
        self._named, self._tops = [False], []  # apart by its own name; articles and mains outside of others
        self._parse(source)
        self._free_articles()
        self._nodes: list | None = None

    def _parse(self, source: str) -> None:
        at, stack = 0, [0]
        for m in _TOKEN.finditer(source):
            if m.start() > at:
                self.runs.append((stack[-1], source[at:m.start()]))
            at = m.end()
            raw, end, start, attributes = m[2], m[3], m[4] or m[6], m[5] or m[7]
            if start:
                self._open(start.lower(), attributes or "", stack)
            elif end:
                self._close(end.lower(), stack)
            elif raw and raw.lower() == "textarea":
                self.runs.append((-1, ""))
        if at < len(source):
            self.runs.append((stack[-1], source[at:]))

    def _pop_to(self, stack: list, i: int) -> None:
        if any(self.tag[n] not in INLINE for n in stack[i:]):
            self.runs.append((-1, ""))
        del stack[i:]

    def _open(self, tag: str, attributes: str, stack: list) -> None:
        if tag in CLOSES_P:
            self._end_open(("p",), ("button", "table", "td", "th", "article", "section", "div", "li", "body"), stack)
        if tag in ENDS:
            names, within = ENDS[tag]
            self._end_open(names.split(), within, stack)
        if tag not in INLINE:
            self.runs.append((-1, ""))
        if tag in VOID:
            return
        if tag in ("html", "body") and tag in self.tag[1:]:
            return  # a second one only adds attributes
        above, n = stack[-1], len(self.tag)
        names = sorted((a[0].lower(), a[1] or a[2] or a[3]) for a in _NAMED.findall(attributes)) if attributes else []
        words = _name_words(tag, names)
        inside, article = self.inside[above], tag in ("article", "main") or ("role", "main") in names
        named = bool(words & APART_WORDS) or not inside and bool(words & OUTER_WORDS)
        if tag in ("html", "body") or article and not inside:
            named = False  # nothing but an article in an article, as a comment, is apart by its name
        apart = self.apart[above] or named or tag in APART or not inside and tag in OUTER
        if tag in ("html", "body"):
            apart = False
        if article and not inside:
            self._tops.append(n)
        self._named.append(named)
        self.tag.append(tag)
        self.label.append(" ".join([tag, *(f"{k}={v}" for k, v in names)]))
        self.parent.append(above)
        self.kids.append([])
        self.apart.append(apart)
        self.inside.append(inside or article)
        self.kids[above].append(n)
        stack.append(n)

    def _free_articles(self) -> None:
        """A name does not set apart what holds the page's main element, nor its only article if that has more
        text than the rest that is kept; several articles in a named part are its comments or teasers."""
        held = [n for n in self._tops if self.apart[n]]
        if not held:
            return
        mains = [n for n in held if self.tag[n] != "article"]
        if not mains and len(self._tops) == 1:
            size = [0, 0]  # characters of the article, of the rest that is kept
            for e, t in self.runs:
                if e >= 0 and (self.inside[e] or not self.apart[e]):
                    size[not self.inside[e]] += len("".join(t.split()))
            mains = held if size[0] > size[1] else []
        free = set()
        for n in mains:
            while n > 0:
                free.add(n)
                n = self.parent[n]
        if any(self._named[n] for n in free):
            for n in range(1, len(self.tag)):
                if self.tag[n] not in ("html", "body"):
                    above = self.parent[n]
                    self.apart[n] = (self.apart[above] or self._named[n] and n not in free or self.tag[n] in APART
                                     or not self.inside[above] and self.tag[n] in OUTER)

    def _end_open(self, names, within, stack: list) -> None:
        for i in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[i]]
            if tag in names:
                self._pop_to(stack, i)
                return
            if tag in within:
                return

    def _close(self, tag: str, stack: list) -> None:
        if tag in ("html", "body"):
            return  # what follows still belongs to the body
        for i in range(len(stack) - 1, 0, -1):
            if self.tag[stack[i]] == tag:
                self._pop_to(stack, i)
                return

    def nodes(self) -> list[tuple[str, list[int], list[int]]]:
        """The tree with runs of equally labelled siblings as one node: (label, child nodes, elements)."""
        if self._nodes is None:
            out: list = [("#", [], [0])]
            todo = [0]
            while todo:
                n = todo.pop()
                for e in out[n][2]:
                    for kid in self.kids[e]:
                        last = out[n][1][-1] if out[n][1] else None
                        if last is None or out[last][0] != self.label[kid]:
                            same = [c for c in out[n][1] if out[c][0] == self.label[kid]] if len(out[n][2]) > 1 else []
                            if same:  # a repeated parent repeats its children
                                out[same[0]][2].append(kid)
                                continue
                            out.append((self.label[kid], [], []))
                            out[n][1].append(len(out) - 1)
                            last = len(out) - 1
                        out[last][2].append(kid)
                todo += out[n][1]
            self._nodes = out
        return self._nodes

    def texts(self) -> dict[int, str]:
        """The own text of every element, white space as one space."""
        out: dict[int, list] = {}
        for e, t in self.runs:
            if e >= 0:
                out.setdefault(e, []).append(t)
        return {e: " ".join(_html.unescape(" ".join(t)).split()) for e, t in out.items()}

    def main_text(self, constant: set[int] = frozenset()) -> str:
        """Text of the elements that are not apart nor ``constant``, of the articles if there are any; with the
        ``constant`` ones if there is none without them."""
        text = self._text(constant)
        return self._text(frozenset()) if constant and not text else text

    def _text(self, constant) -> str:
        articles = any(i and not a for i, a in zip(self.inside, self.apart))
        out = []
        for e, t in self.runs:
            if e < 0:
                out.append(" ")
            elif not self.apart[e] and (self.inside[e] or not articles) and (e not in constant or self.inside[e] and self.tag[e] in HEADINGS):
                out.append(_html.unescape(t) if "&" in t else t)
        return " ".join("".join(out).split())


def align(pattern: list, page: list) -> list[tuple[int, int]]:
    """Simple tree matching: pairs (pattern node, page node) of the largest order-keeping match from the roots.

    A pair of nodes with equal labels is weighed once the pairs of their children are, on a stack of its own, so
    depth is no limit; the work is the product of the numbers of children of nodes that meet.
    """
    memo: dict[tuple[int, int], tuple[int, list]] = {}
    stack = [(0, 0)] if pattern[0][0] == page[0][0] else []
    while stack:
        a, b = stack[-1]
        left, right = pattern[a][1], page[b][1]
        if (a, b) not in memo:
            memo[a, b] = 1, []  # until its children are weighed
            met = [(x, y) for x in left for y in right if pattern[x][0] == page[y][0]]
            if met:
                stack += met
                continue
        stack.pop()
        if memo[a, b] == (1, []) and left and right:
            memo[a, b] = _best(left, right, memo)
    out, todo = [], [(0, 0)] if memo else []
    while todo:
        pair = todo.pop()
        out.append(pair)
        todo += memo[pair][1]
    return out


def _best(left: list[int], right: list[int], memo: dict) -> tuple[int, list]:
    """The weight of the best order-keeping match of two lists of children, with their parents, and its pairs."""
    best = [[0] * (len(right) + 1)]  # best[i][j]: most matches of the first i and j children
    weights = []
    for x in left:
        above, row = best[-1], [0]
        w = [memo[x, y][0] if (x, y) in memo else 0 for y in right]
        for j, v in enumerate(w):
            row.append(max(above[j + 1], row[j], above[j] + v))
        best.append(row)
        weights.append(w)
    pairs, i, j = [], len(left), len(right)
    while i and j:
        if weights[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + weights[i - 1][j - 1]:
            pairs.append((left[i - 1], right[j - 1]))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return 1 + best[-1][-1], pairs


def _own(node: tuple, texts: dict[int, str]) -> dict[str, list[int]]:
    """The own texts in a node, each with its elements."""
    out: dict[str, list[int]] = {}
    for e in node[2]:
        if texts.get(e):
            out.setdefault(texts[e], []).append(e)
    return out


class _Pattern:
    def __init__(self, source: str):
        self.page = Page(source)
        self.nodes = self.page.nodes()
        texts = self.page.texts()
        self.own = [list(_own(n, texts)) for n in self.nodes]  # texts of every node, in order
        self.mark = hashlib.blake2b(source.encode("utf-8", "replace"), digest_size=16).digest()


def _patterns() -> Recent:
    return per_worker(("patterns",), lambda: Recent(_Pattern, CACHED_PATTERNS))


def host_of(url: Column) -> Column:
    """The host of a url in lower case; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1), F.lit("")))


def _beside(rows: DataFrame, wrappers: DataFrame, *cols: str, how: str = "inner"):
    """``rows`` (with their ``host``) and a function of a batch that gives the ``cols`` of each row's host, or nulls.

    A host may have a large share of the pages, so these stay where they are while the
    patterns are few: then a table of all hosts is broadcast, and no row carries a pattern. The patterns' size is
    measured; beyond the bound they are joined.
    """
    size = wrappers.agg(F.sum(F.octet_length("pattern") + 64)).first()[0] or 0
    if size > BROADCAST_BYTES:
        joined, at = rows.join(wrappers, "host", how), len(rows.columns)
        return joined.select(*rows.columns, *cols), lambda b: list(zip(*(b.column(at + k).to_pylist() for k in range(len(cols)))))
    table = {r["host"]: tuple(r[c] for c in cols) for r in wrappers.select("host", *cols).collect()}
    shared, host, none = rows.sparkSession.sparkContext.broadcast(table), rows.columns.index("host"), (None,) * len(cols)
    return rows, lambda b: [shared.value.get(h, none) for h in b.column(host).to_pylist()]


def induce(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, pattern, constant``: each host's pattern page and the texts of it that are template, as (node, nth text)."""
    rows = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html"))
    order = F.xxhash64("host", "id")
    chosen = written(rows.where("html IS NOT NULL").groupBy("host").agg(F.min(order).alias("first")), "chosen")
    if chosen.count() <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    patterns = written(rows.where("html IS NOT NULL").withColumn("first", order).join(chosen, ["host", "first"])
                       .groupBy("host").agg(F.min("html").alias("pattern")), "patterns")
    rows, of_host = _beside(rows.select("host", "html"), patterns, "pattern")

    def count(batches):
        kept = _patterns()
        for b in slices(batches, 512):
            seen: Counter = Counter()
            for host, html, (source,) in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), of_host(b)):
                if not html or source is None:
                    continue
                pattern = kept[source]
                if hashlib.blake2b(html.encode("utf-8", "replace"), digest_size=16).digest() == pattern.mark:
                    continue  # the pattern and its copies say nothing about what varies
                page = Page(html)
                nodes, texts = page.nodes(), page.texts()
                for a, c in align(pattern.nodes, nodes):
                    if pattern.own[a]:
                        own = _own(nodes[c], texts)
                        for i, t in enumerate(pattern.own[a]):
                            seen[host, a, i, 0] += 1
                            seen[host, a, i, 1] += t in own
            keys = [k for k in seen if k[3] == 0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int32()),
                 pa.array([seen[k] for k in keys], pa.int64()), pa.array([seen[*k[:3], 1] for k in keys], pa.int64())],
                names=["host", "node", "nth", "pages", "equal"])
    counts = rows.mapInArrow(count, "host string, node int, nth int, pages long, equal long")
    constant = (counts.groupBy("host", "node", "nth").agg(F.sum("pages").alias("pages"), F.sum("equal").alias("equal"))
                .where((F.col("pages") >= LEAST_PAGES) & (F.col("equal") >= CONSTANT * F.col("pages")))
                .groupBy("host").agg(F.array_sort(F.collect_list(F.struct("node", "nth"))).alias("constant")))
    return written(patterns.join(constant, "host", "left")
                   .select("host", "pattern", F.coalesce("constant", F.array().cast("array<struct<node:int,nth:int>>")).alias("constant")), "wrappers")


def extract(pages: DataFrame, wrappers: DataFrame, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """``id, url, text, n_chars`` of every row of ``pages``."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"),
                        host_of(F.col(url_col)).alias("host"))
    rows, of_host = _beside(rows, wrappers, "pattern", "constant", how="left")

    def run(batches):
        kept = _patterns()
        for b in slices(batches):
            texts = []
            for html, (source, constant) in zip(text_of(b.column(2)), of_host(b)):
                page = Page(html)
                texts.append(page.main_text(template(page, kept[source], constant)) if constant else page.main_text())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, url string, text string, n_chars long")


def template(page: Page, pattern: _Pattern, constant: list) -> set[int]:
    """The elements of a page whose texts are template."""
    known: dict[int, list[str]] = {}
    for c in constant:
        node, nth = (c["node"], c["nth"]) if isinstance(c, dict) else c
        known.setdefault(node, []).append(pattern.own[node][nth])
    nodes, texts, out = page.nodes(), page.texts(), set()
    for a, c in align(pattern.nodes, nodes):
        if a in known:
            own = _own(nodes[c], texts)
            for t in known[a]:
                out.update(own.get(t, ()))
    return out
