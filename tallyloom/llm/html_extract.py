"""Main text of web pages by wrapper induction.

Pages of one host come from one template. Every page is read into a small DOM tree and aligned with
an exemplar page of its host by simple tree matching: the largest mapping that keeps parents, order
and tag names, by dynamic programming over child lists, whatever their length. Over all pages of the
host, counts per exemplar node say how often its text is the same and how much varying text it holds:

* a node whose text is the same in ``CONSTANT`` of the pages is template;
* the rest are slots. From the top, the wrapper goes down to the child that holds more than half
  of the varying text of its parent, as long as there is one that is no text block itself. Where it
  stops is the host's content. A page's text is what stands there, without template nodes.

So where a wrapper exists, position and constancy choose the content; neither ``article`` nor a class
name does. Inside the content, parts that no article has (forms, menus, adverts, notices, comments: by
tag, role or class words) are left out unless they hold most of it. Pages without a wrapper (fewer
than ``LEAST_PAGES`` pages of the host, no URL, a page that lacks the content node) are read by their own
structure: ``article``, else ``main``, else the body, without such parts.

Two passes over the pages, nothing but exemplars and counts in between. Both go to every executor
while they are small (``BROADCAST_CHARS`` characters of exemplars); beyond that pages and wrappers meet
by host and salt, so a host with a third of all pages is dealt over many tasks. Counts are summed
in the tasks before they are shuffled. Pages equal to the exemplar say nothing and are not counted.

Text: character references are decoded, white space inside a block becomes one space, blocks are
trimmed and joined in page order by one line feed.

Edge cases: null, empty or unparsable markup gives an empty text; repeated rows and null ids keep one
result each; ties between exemplars go to the smaller hash; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids, written

SALTS = 32
LEAST_PAGES = 8  # pages of a host before constancy says anything
CONSTANT = 0.9  # share of a host's pages in which a template node has the same text
BROADCAST_CHARS = 1 << 24  # characters of exemplars that go to every executor
MOST_SHAPES = 200_000  # tag trees that a task keeps before it starts anew
TABLE_CELLS = 1 << 22  # of an alignment that is kept whole; larger ones are halved

# fixed values: HTML element names by their role
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math".split())
SKIPPED = frozenset(
    "head script style noscript template iframe svg math object canvas nav footer aside form button select option input textarea dialog menu"
    " audio video".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u"
    " var wbr br img".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre"
    " section table ul".split()
)
# fixed values: words in class, id or role that name a part which is not the article
BOILERPLATE = frozenset(
    "ad ads advert advertisement adverts adsense banner breadcrumb breadcrumbs comment comments cookie cookies consent disclaimer disqus footer"
    " gdpr header login masthead menu modal nav navbar navigation newsletter notice notices paywall popup promo promoted promotion recommended"
    " related reply replies respond share sharing shares sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar widget"
    " widgets contentinfo complementary search alert dialog".split()
)
# each alternative ends at the next "<" or goes on to the end of the page once, so the scan is linear
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*+>|<(/?)([a-zA-Z][^\s/><]*+)((?:[^<>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[=\"'])*+)>", re.S
)
# a name, and its value; quoted values are passed over as a whole, so words in them are no attributes
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[a-z]+|\d+")
_CAMEL = re.compile(r"([a-z])([A-Z])")


class Node:
    """An element; ``parts`` holds texts and child elements in page order."""

    __slots__ = ("aside", "parts", "size", "tag")

    def __init__(self, tag: str, aside: bool = False):
        self.tag, self.aside, self.parts, self.size = tag, aside, [], 1

    def children(self) -> list[Node]:
        return [p for p in self.parts if isinstance(p, Node)]


def _is_aside(tag: str, attributes: str) -> bool:
    if tag in SKIPPED:
        return True
    if attributes and tag not in ("html", "body", "article", "main"):
        for name, *values in _ATTRIBUTE.findall(attributes):
            value = "".join(values)
            if name.lower() == "hidden" or (name.lower() == "aria-hidden" and value == "true"):
                return True
            if name.lower() in ("class", "id", "role") and not BOILERPLATE.isdisjoint(_WORDS.findall(_CAMEL.sub(r"\1 \2", value).lower())):
                return True
    return False


def parsed(page: str | None) -> Node:
    """The page's element tree; tags that are never closed end where HTML ends them."""
    root = Node("#root")
    open_, opened = [root], Counter()
    page = page or ""
    at = 0

    def shut(k: int) -> None:
        opened.subtract(n.tag for n in open_[k:])
        del open_[k:]

    def end(tag: str, within: tuple[str, ...]) -> None:
        for k in range(len(open_) - 1, 0, -1) if opened[tag] else ():
            if open_[k].tag == tag:
                shut(k)
                return
            if open_[k].tag in within:
                return

    for m in iter(lambda: _TAG.search(page, at), None):
        if m.start() > at:
            open_[-1].parts.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                open_[-1].parts.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        if m[1]:
            for k in range(len(open_) - 1, 0, -1) if opened[name] else ():
                if open_[k].tag == name:
                    shut(k)
                    break
                if name == "p" and open_[k].tag not in INLINE:
                    break
            continue
        if name in CLOSES_P:
            end("p", ("button", "td", "th", "li", "article", "section", "div"))
        if name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            end(name, ("ul", "ol", "dl", "table", "select"))
        node = Node(name, _is_aside(name, m[3]))
        open_[-1].parts.append(node)
        if name in VOID or (m[3] or "").rstrip().endswith("/"):
            continue
        if name in RAW:
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            node.parts.append(page[at : close.start() if close else len(page)])
            at = close.end() if close else len(page)
            continue
        open_.append(node)
        opened[name] += 1
    if at < len(page):
        open_[-1].parts.append(page[at:])
    return root


def blocks(node: Node, dropped: set[int], inside: bool = False) -> list[str]:
    """Block texts below ``node`` in page order, without dropped nodes and parts that no article has.

    ``inside``: the node itself is content, whatever its name, and so is a part by its class words that
    holds more than half of the node's text.
    """
    out: list[str] = []
    line: list[str] = []
    most = 0

    def end() -> None:
        text = " ".join(html.unescape("".join(line)).split())
        if text:
            out.append(text)
        line.clear()

    def kept(n: Node) -> bool:
        nonlocal most
        if not n.aside or (inside and n is node):
            return True
        if not inside or n.tag in SKIPPED:
            return False
        most = most or _chars(node)
        return 2 * _chars(n) > most

    stack: list = [node]
    while stack:
        n = stack.pop()
        if n is None:
            end()
        elif isinstance(n, str):
            line.append(n)
        elif n.tag == "br":
            line.append(" ")
        elif n.tag != "title" and id(n) not in dropped and kept(n):
            if n.tag in INLINE:
                stack.extend(reversed(n.parts))
            else:
                end()
                stack.append(None)
                stack.extend(reversed(n.parts))
    end()
    return out


def _chars(node: Node) -> int:
    found, stack = 0, [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            found += len(n.strip())
        elif n.tag not in RAW:
            stack.extend(n.parts)
    return found


class Tree:
    """A page's block elements in page order, as arrays: parents come before their children.

    ``shape`` numbers equal tag trees alike; ``texts`` are the page's texts in order, and a node holds
    those from ``lo`` to ``hi``. Inline elements are part of their block.
    """

    def __init__(self, root: Node, shape: Callable[[tuple], int]):
        self.nodes, self.kids, self.lo, self.hi, self.texts = [], [], [], [], []
        stack: list = [(root, -1)]
        while stack:
            n, above = stack.pop()
            if isinstance(n, int):
                self.hi[n] = len(self.texts)
            elif isinstance(n, str):
                words = " ".join(n.split())
                if words:
                    self.texts.append(words)
            elif n.tag in RAW:
                continue
            elif n.tag in INLINE:
                stack.extend((x, above) for x in reversed(n.parts))
            else:
                own = len(self.nodes)
                self.nodes.append(n)
                self.kids.append([])
                self.lo.append(len(self.texts))
                self.hi.append(0)
                if above >= 0:
                    self.kids[above].append(own)
                stack.append((own, above))
                stack.extend((x, own) for x in reversed(n.parts))
        self.shape = [0] * len(self.nodes)
        for k in range(len(self.nodes) - 1, -1, -1):
            self.shape[k] = shape((self.nodes[k].tag, *(self.shape[c] for c in self.kids[k])))
        self.length = np.concatenate(([0], np.cumsum([len(t) for t in self.texts]))).tolist()

    def text(self, k: int) -> list[str]:
        return self.texts[self.lo[k] : self.hi[k]]

    def chars(self, k: int) -> int:
        return self.length[self.hi[k]] - self.length[self.lo[k]]


class Matcher:
    """Simple tree matching; sizes of mappings depend on shapes only and are kept."""

    def __init__(self) -> None:
        self.shapes: dict[tuple, int] = {}
        self.sizes: dict[tuple[int, int], int] = {}
        self.parts: list[tuple] = []

    def tree(self, page: str | None) -> Tree:
        return Tree(parsed(page), self.shape)

    def shape(self, parts: tuple) -> int:
        """The number of (tag, shapes of the children)."""
        found = self.shapes.get(parts)
        if found is None:
            found = self.shapes[parts] = len(self.shapes)
            self.parts.append(parts)
        return found

    def size(self, a: int, b: int) -> int:
        """Pairs in the largest mapping of two shapes; sizes of deeper shapes are found first."""
        stack = [(a, b)]
        while stack:
            x, y = stack[-1]
            if (x, y) in self.sizes:
                stack.pop()
                continue
            (tag, *p), (other, *q) = self.parts[x], self.parts[y]
            if tag != other:
                self.sizes[x, y] = 0
                continue
            p, q, same = _trimmed(p, q)
            open_ = [(s, t) for s in set(p) for t in set(q) if (s, t) not in self.sizes]
            if open_:
                stack += open_
                continue
            self.sizes[x, y] = 1 + sum(self._whole(s) for s in same) + int(_row(p, q, self.sizes)[-1])
        return self.sizes[a, b]

    def _whole(self, shape: int) -> int:
        """Nodes of a shape."""
        found, stack = 0, [shape]
        while stack:
            found += 1
            stack.extend(self.parts[stack.pop()][1:])
        return found

    def matched(self, a: Tree, b: Tree) -> list[tuple[int, int]]:
        """Pairs of nodes in the largest top-down, order-keeping mapping of two trees."""
        out, stack = [], [(0, 0)]
        while stack:
            x, y = stack.pop()
            out.append((x, y))
            p, q = a.kids[x], b.kids[y]
            n = m = 0
            while n < min(len(p), len(q)) and a.shape[p[n]] == b.shape[q[n]]:
                n += 1
            while m < min(len(p), len(q)) - n and a.shape[p[-1 - m]] == b.shape[q[-1 - m]]:
                m += 1
            stack += zip(p[:n], q[:n], strict=True)
            stack += zip(p[len(p) - m :], q[len(q) - m :], strict=True)
            p, q = p[n : len(p) - m], q[n : len(q) - m]
            if p and q:
                s, t = [a.shape[k] for k in p], [b.shape[k] for k in q]
                for i in set(s):
                    for j in set(t):
                        self.size(i, j)
                stack += [(p[i], q[j]) for i, j in _alignment(s, t, self.sizes)]
        return out


def _trimmed(p: list[int], q: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Child lists without the equal shapes at both ends, which always match, and these shapes."""
    n = m = 0
    most = min(len(p), len(q))
    while n < most and p[n] == q[n]:
        n += 1
    while m < most - n and p[-1 - m] == q[-1 - m]:
        m += 1
    return p[n : len(p) - m], q[n : len(q) - m], p[:n] + p[len(p) - m :]


def _row(p: list[int], q: list[int], sizes: dict[tuple[int, int], int], table: list[np.ndarray] | None = None) -> np.ndarray:
    """Best sums of all p against prefixes of q; ``table`` gets the rows of all prefixes of p."""
    row = np.zeros(len(q) + 1, np.int64)
    by = {s: np.array([sizes[s, t] for t in q], np.int64) for s in set(p)}
    for s in p:
        if table is not None:
            table.append(row)
        row = np.concatenate(([0], np.maximum.accumulate(np.maximum(row[1:], row[:-1] + by[s])))) if q else row
    if table is not None:
        table.append(row)
    return row


def _alignment(p: list[int], q: list[int], sizes: dict[tuple[int, int], int]) -> list[tuple[int, int]]:
    """Places of p and q that match in a best alignment. Long lists are cut in two, so that memory stays linear."""
    out, stack = [], [(0, len(p), 0, len(q))]
    while stack:
        a, b, c, d = stack.pop()
        if a == b or c == d:
            continue
        if (b - a) * (d - c) > TABLE_CELLS and b - a > 1:
            half = (a + b) // 2
            ahead = _row(p[a:half], q[c:d], sizes)
            behind = _row(p[half:b][::-1], q[c:d][::-1], sizes)[::-1]
            cut = c + int(np.argmax(ahead + behind))
            stack += [(a, half, c, cut), (half, b, cut, d)]
            continue
        table: list[np.ndarray] = []
        _row(p[a:b], q[c:d], sizes, table)
        i, j = b - a, d - c
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                if sizes[p[a + i], q[c + j]]:
                    out.append((a + i, c + j))
    return out


class Wrapper(NamedTuple):
    """A host's exemplar, the exemplar node that is its content, and its template nodes."""

    tree: Tree
    content: int
    template: frozenset[int]


TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre blockquote figcaption caption address summary".split())


def wrapper(tree: Tree, counts: list) -> Wrapper | None:
    """From counts per exemplar node: node, n (pages that have it), same (with the same text), chars (of text that varies)."""
    seen = {c["node"]: c for c in counts}
    fixed = frozenset(k for k, c in seen.items() if c["n"] >= LEAST_PAGES and c["same"] >= CONSTANT * c["n"])
    mass = {k: 0 if k in fixed or tree.nodes[k].tag in SKIPPED else c["chars"] for k, c in seen.items()}
    if seen.get(0, {"n": 0})["n"] < LEAST_PAGES or not mass[0]:
        return None
    at = 0
    while True:
        best = max((k for k in tree.kids[at] if k in mass and tree.nodes[k].tag not in TEXT_BLOCKS), key=lambda k: mass[k], default=None)
        if best is None or 2 * mass[best] <= sum(mass.get(k, 0) for k in tree.kids[at]):
            break
        at = best
    return Wrapper(tree, at, fixed) if at else None


def page_text(page: str | None, found: Wrapper | None, matcher: Matcher) -> str:
    if found is None:
        return main_text(parsed(page))
    tree = matcher.tree(page)
    twins = dict(matcher.matched(found.tree, tree))
    at = twins.get(found.content)
    if at is None:
        return main_text(tree.nodes[0])
    template = {id(tree.nodes[y]) for x, y in twins.items() if x in found.template and found.tree.text(x) == tree.text(y)}
    own = tree.nodes[at]
    return "\n".join(blocks(own, template, inside=True)) or main_text(tree.nodes[0])


def main_text(root: Node) -> str:
    """The text of a page by its own structure alone."""
    every, stack = [], [root]
    while stack:
        n = stack.pop()
        if not n.aside or n.tag not in SKIPPED:
            every.append(n)
            stack.extend(n.children())
    for kind in ("article", "main"):
        named = [blocks(n, set()) for n in every if n.tag == kind]
        if any(named):
            return "\n".join(max(named, key=lambda found: sum(map(len, found))))
    body = next((n for n in every if n.tag == "body"), root)
    heads = {id(n) for n in every if n.tag == "header"}
    return "\n".join(blocks(body, heads) or blocks(body, set()) or blocks(body, set(), inside=True))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/?#:]*)", 1))
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))

    def smallest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of each host the page with the smallest hash, per task; and its number of pages."""
        best: dict[str, tuple[int, str]] = {}
        size: dict[str, int] = {}
        for pdf in batches:
            for name, mark, page in zip(pdf["host"], pdf["mark"], pdf["html"], strict=True):
                size[name] = size.get(name, 0) + 1
                if name not in best or mark < best[name][0]:
                    best[name] = (mark, page)
        yield pd.DataFrame([(k, *v, size[k]) for k, v in best.items()], columns=["host", "mark", "html", "n"])

    usable = base.where("host <> '' and html is not null").select("host", F.xxhash64("html").alias("mark"), "html")
    drawn = usable.mapInPandas(smallest, "host string, mark long, html string, n long")
    exemplars = written(drawn.groupBy("host").agg(F.min(F.struct("mark", "html"))["html"].alias("exemplar"), F.sum("n").alias("n")).where(f"n >= {LEAST_PAGES}").drop("n"), "exemplars")

    def observe(rows: Iterator[tuple[str, str, Any]], read: Callable) -> Iterator[pd.DataFrame]:
        matcher, trees, counts = Matcher(), {}, {}
        for name, page, model, _, _ in rows:
            if model is None or page is None or page == read(model):
                continue
            if len(matcher.shapes) > MOST_SHAPES:
                matcher, trees = Matcher(), {}
            if name not in trees:
                trees[name] = matcher.tree(read(model))
            tree, own = trees[name], matcher.tree(page)
            for x, y in matcher.matched(tree, own):
                c = counts.setdefault((name, x), [0, 0, 0])
                same = tree.text(x) == own.text(y)
                c[0] += 1
                c[1] += same
                c[2] += 0 if same else own.chars(y)
        yield pd.DataFrame([(*k, *c) for k, c in counts.items()], columns=["host", "node", "n", "same", "chars"])

    seen = _beside(base, exemplars, lambda r: r["exemplar"], observe, "host string, node int, n long, same long, chars long")
    nodes = seen.groupBy("host", "node").agg(*[F.sum(c).alias(c) for c in ("n", "same", "chars")])
    listed = nodes.groupBy("host").agg(F.collect_list(F.struct("node", "n", "same", "chars")).alias("counts"))  # as long as one page's tree
    rules = written(listed.join(exemplars, "host"), "wrappers")

    def extract(rows: Iterator[tuple], read: Callable) -> Iterator[pd.DataFrame]:
        matcher, models, out = Matcher(), {}, []
        for name, page, model, own, url in rows:
            if len(matcher.shapes) > MOST_SHAPES:
                matcher, models = Matcher(), {}
            if model is not None and name not in models:
                models[name] = wrapper(matcher.tree(read(model)["exemplar"]), read(model)["counts"])
            text = page_text(page, models.get(name) if model is not None else None, matcher)
            out.append((own, url, text, len(text)))
            if len(out) >= 500:
                yield pd.DataFrame(out, columns=["id", "url", "text", "n_chars"]).astype({"id": object})
                out = []
        yield pd.DataFrame(out, columns=["id", "url", "text", "n_chars"]).astype({"id": object})

    kind = pages.schema[id_col].dataType.simpleString()
    found = _beside(base, rules, lambda r: {"exemplar": r["exemplar"], "counts": [c.asDict() if hasattr(c, "asDict") else c for c in r["counts"]]}, extract, f"id {kind}, url string, text string, n_chars long")
    return found.withColumnRenamed("id", id_col)


def _beside(base: DataFrame, per_host: DataFrame, shape: Callable, work: Callable, schema: str) -> DataFrame:
    """``work`` on (host, html, model, id, url) of all pages, with what there is of each host.

    Little enough of it goes to every executor; else both sides meet by host and salt.
    """
    spark = base.sparkSession
    size = per_host.agg(F.sum(F.length("exemplar"))).first()[0] or 0
    if size <= BROADCAST_CHARS:
        shared = spark.sparkContext.broadcast({r["host"]: shape(r) for r in per_host.toLocalIterator()})

        def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            models = shared.value
            yield from work(((h, p, models.get(h), i, u) for pdf in batches for h, p, i, u in zip(pdf["host"], pdf["html"], ids(pdf["id"]), pdf["url"], strict=True)), lambda m: m)

        return base.mapInPandas(near, schema)
    salted = base.withColumn("salt", F.pmod(F.xxhash64("id", "html"), F.lit(SALTS)).cast("int"))
    model = F.struct(*[c for c in per_host.columns if c != "host"]).alias("model")
    spread = per_host.select("host", model, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from work(((h, p, m, i, u) for pdf in batches for h, p, m, i, u in zip(pdf["host"], pdf["html"], pdf["model"], ids(pdf["id"]), pdf["url"], strict=True)), shape)

    return salted.join(spread, ["host", "salt"], "left").select("host", "html", "model", "id", "url").mapInPandas(joined, schema)
