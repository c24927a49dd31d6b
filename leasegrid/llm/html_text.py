"""Main text of web pages by wrapper induction.

Every page becomes a tree of its block elements, equal neighbours folded into one. For each host the
most frequent tree is the reference; simple tree matching aligns each other tree of the host with
it, so that nodes of all the host's pages share slots. Over all distinct pages of a host, a node whose
slot and text recur on at least ``constant`` of them is template; slots that vary are content. A host with
several layouts, frequent trees that are little alike, is also judged layout by layout: each page is aligned
with the nearest one, and ``constant`` is a share of that layout's distinct pages, ``min_pages`` at least.
Content is then what is neither template nor in an element whose tag or class says that it is not
the article (menus, page headers, footers, sidebars, notices, adverts, forms, reader comments). If a
page has an article or main element, only those count.

Counts are keyed by host, slot and text, so a host with a third of all pages is aggregated in every
task before the shuffle; html is parsed once for the counts and once for the result, and only joined
with the template texts of its host.

Null and empty html give an empty text. Character references are decoded, white space within a block
becomes one space, and blocks are joined by a line feed in page order; nothing is capped. Equal
pages of a host count once towards its template, and hosts of fewer than ``min_pages`` distinct
pages have none. Null urls belong to the host ''. Repeated and null ids pass through, other
columns are not read, an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_batches, lean, stored
from .url_rules import host_and_path

# Fixed values of HTML: elements without content, elements whose content is no text, block elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object canvas select button noframes xmp".split())
BLOCKS = frozenset(
    "html head body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES_P = BLOCKS - {"html", "head", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}}
SCOPE = {"ul", "ol", "menu", "dl", "table"}
# What an element's tag, role, class or id says about it.
OUT_TAGS = frozenset("nav footer aside form dialog menu head".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices notification popup modal overlay newsletter subscribe signup login nav navbar navigation menu menus breadcrumb breadcrumbs "
    "sidebar sidebars aside footer header masthead comment comments disqus reply replies respond discussion related recommended share "
    "sharing social widget widgets pagination pager toolbar skip search".split())
MAIN_TAGS = frozenset({"article", "main"})

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|</([a-zA-Z][^\s/>]*+)[^>]*+>?"
    r"|<([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)[^>]*+>?", re.S)
_ATTR = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    """A block element: its symbol, its place in the tree, and whether it is left out or within the article."""

    __slots__ = ("children", "main", "out", "parent", "symbol", "tag")

    def __init__(self, tag: str, symbol: str, parent: Node | None, out: bool, main: bool):
        self.tag, self.symbol, self.parent, self.out, self.main = tag, symbol, parent, out, main
        self.children: list[Node] = []


def _describe(tag: str, attrs: str, in_main: bool) -> tuple[str, bool]:
    """(symbol, left out) of a start tag."""
    out = tag in OUT_TAGS or (tag == "header" and not in_main)
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return tag, out
    symbol = tag
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "class" or name == "id":
            words = value.lower().split()
            if words and name == "class":
                symbol = f"{tag}.{re.sub('[^a-z0-9_-]', '', words[0])}"
            for w in words:
                if tag not in MAIN_TAGS and tag != "body" and not OUT_WORDS.isdisjoint(re.split(r"[-_:]+", w)):
                    out = True
        elif name == "role":
            out = out or value.lower() in OUT_ROLES
        elif name == "hidden" or name == "aria-hidden":
            out = out or name == "hidden" or value.lower() == "true"
        elif _HIDDEN.search(value):
            out = True
    return symbol, out


def parse(html: str) -> tuple[Node, list[tuple[Node, str]]]:
    """(tree, blocks): the block elements and, in page order, each run of text with the block it stands in."""
    root = node = Node("", "", None, False, False)
    stack: list[tuple[str, Node, bool]] = []  # open elements: tag, the block around, whether it is left out though inline
    blocks: list[tuple[Node, str]] = []
    run: list[str] = []
    hidden = 0
    low = None
    pos, size = 0, len(html)

    def flush() -> None:
        if run:
            text = " ".join("".join(map(unescape, run)).split())
            run.clear()
            if text:
                blocks.append((node, text))

    def close(upto: int) -> None:
        nonlocal node, hidden
        while len(stack) > upto:
            tag, before, inline_out = stack.pop()
            if tag in BLOCKS:
                flush()
                node = before
            hidden -= inline_out

    while pos < size:
        at = html.find("<", pos)
        if at < 0:
            at = size
        if at > pos and not hidden:
            run.append(html[pos:at])
        if at == size:
            break
        m = _TOKEN.match(html, at)
        if m is None:
            if not hidden:
                run.append("<")
            pos = at + 1
            continue
        pos = m.end()
        end, start = m.group(1), m.group(2)
        if end:
            end = end.lower()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == end:
                    close(k)
                    break
                if end not in BLOCKS and stack[k][0] in BLOCKS:
                    break
        elif start:
            tag, attrs = start.lower(), m.group(3)
            if tag in RAW:
                if not attrs.endswith("/"):
                    if low is None:
                        low = html.lower()
                        if len(low) != size:
                            low = "".join(c.lower() if c.isascii() else c for c in html)
                    stop = low.find("</" + tag, pos)
                    pos = size if stop < 0 else stop
                    if stop >= 0:
                        pos = html.find(">", stop) + 1 or size
                run.append(" ")
                continue
            if tag == "br" or tag == "wbr":
                run.append(" ")
                continue
            if tag in BLOCKS:
                for k in range(len(stack) - 1, -1, -1):
                    opened = stack[k][0]
                    if opened == "p" and tag in CLOSES_P or opened in SIBLINGS.get(tag, ()):
                        close(k)
                        break
                    if opened in SCOPE or opened in BLOCKS and opened not in ("p", "td", "th", "li", "dd", "dt"):
                        break
                flush()
            if tag in VOID:
                continue
            symbol, out = _describe(tag, attrs, node.main)
            if tag in BLOCKS:
                child = Node(tag, symbol, node, node.out or out, node.main or tag in MAIN_TAGS)
                node.children.append(child)
                stack.append((tag, node, False))
                node = child
            else:
                stack.append((tag, node, out))
                hidden += out
    flush()
    return root, blocks


def fold(root: Node) -> tuple[str, dict[int, int]]:
    """(skeleton, slots): the tree with equal neighbours folded into one, in text form, and for each
    block element's id() its node's number there, in pre-order."""
    order: list[Node] = []
    todo = [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += n.children
    shape: dict[int, int] = {}  # of each subtree a hash of its folded form,
    kids: dict[int, list[Node]] = {}  # the children that stay,
    size: dict[int, int] = {}  # and its number of nodes
    for n in reversed(order):
        own: list[Node] = []
        for c in n.children:
            if not own or shape[id(own[-1])] != shape[id(c)]:
                own.append(c)
        shape[id(n)] = xxhash.xxh64_intdigest(n.symbol + "".join(f",{shape[id(c)]:x}" for c in own))
        kids[id(n)], size[id(n)] = own, 1 + sum(size[id(c)] for c in own)
    slots: dict[int, int] = {}
    open_: list[tuple[Node, int]] = [(root, 0)]
    while open_:
        n, at = open_.pop()
        slots[id(n)] = at
        place, at = at, at + 1
        stay = iter(kids[id(n)])
        following = next(stay, None)
        for c in n.children:
            if c is following:
                place, at, following = at, at + size[id(c)], next(stay, None)
            open_.append((c, place))
    text: list[str] = []
    parts: list[Node | str] = [root]
    while parts:
        x = parts.pop()
        if isinstance(x, str):
            text.append(x)
            continue
        text.append(x.symbol)
        if own := kids[id(x)]:
            parts.append(")")
            for k, c in enumerate(reversed(own)):
                parts.append(c)
                if k < len(own) - 1:
                    parts.append(",")
            parts.append("(")
    return "".join(text), slots


def unfold(skeleton: str) -> list[tuple[str, int, list[int]]]:
    """(symbol, parent, children) of each node of a skeleton, in pre-order."""
    nodes: list[tuple[str, int, list[int]]] = []
    parent, name = -1, []

    def add() -> int:
        nodes.append(("".join(name), parent, []))
        if parent >= 0:
            nodes[parent][2].append(len(nodes) - 1)
        name.clear()
        return len(nodes) - 1

    pending = True
    for c in skeleton:
        if c == "(":
            parent, pending = add(), True
        elif c == "," or c == ")":
            if pending:
                add()
            pending = c == ","
            if c == ")":
                parent = nodes[parent][1]
        else:
            name.append(c)
    if pending:
        add()
    return nodes


def tree_match(a: list, b: list) -> list[int]:
    """For each node of ``b`` the node of ``a`` it is aligned with, or -1, by simple tree matching:
    roots must bear the same symbol, and the children's best order-keeping pairing is found by
    dynamic programming over the subtrees' matches. Iterative from the leaves, so deep trees are fine."""
    def depths(nodes: list) -> list[int]:
        out: list[int] = []
        for _, parent, _ in nodes:
            out.append(out[parent] + 1 if parent >= 0 else 0)
        return out

    score: dict[tuple[int, int], int] = {}
    pairs: dict[tuple[int, int], list[tuple[int, int]]] = {}
    alike: dict[tuple[str, int], list[int]] = {}
    for i, (node, depth) in enumerate(zip(a, depths(a), strict=True)):
        alike.setdefault((node[0], depth), []).append(i)
    depth_b = depths(b)
    for j in range(len(b) - 1, -1, -1):
        symbol, _, kids_b = b[j]
        for i in alike.get((symbol, depth_b[j]), ()):
            kids_a = a[i][2]
            grid = [[0] * (len(kids_b) + 1) for _ in range(len(kids_a) + 1)]
            for x in range(1, len(kids_a) + 1):
                for y in range(1, len(kids_b) + 1):
                    grid[x][y] = max(grid[x - 1][y], grid[x][y - 1], grid[x - 1][y - 1] + score.get((kids_a[x - 1], kids_b[y - 1]), 0))
            score[i, j] = 1 + grid[-1][-1]
            x, y, own = len(kids_a), len(kids_b), []
            while x and y:
                if grid[x][y] == grid[x - 1][y]:
                    x -= 1
                elif grid[x][y] == grid[x][y - 1]:
                    y -= 1
                else:
                    own.append((kids_a[x - 1], kids_b[y - 1]))
                    x, y = x - 1, y - 1
            pairs[i, j] = own
    out = [-1] * len(b)
    todo = [(0, 0)] if (0, 0) in score else []
    while todo:
        i, j = todo.pop()
        out[j] = i
        todo += pairs[i, j]
    return out


def slot_names(reference: str, skeleton: str) -> list[str]:
    """Each node's slot: the reference's node it is aligned with, or else its own path."""
    a, b = unfold(reference), unfold(skeleton)
    names: list[str] = []
    for (symbol, parent, _), i in zip(b, tree_match(a, b), strict=True):
        names.append(str(i) if i >= 0 else f"{names[parent] if parent >= 0 else ''}/{symbol}")
    return names


@lru_cache(maxsize=64)
def _paths(skeleton: str) -> Counter[int]:
    """How often each path from the root occurs; paths as hashes."""
    paths: list[int] = []
    for symbol, parent, _ in unfold(skeleton):
        paths.append(hash((paths[parent] if parent >= 0 else 0, symbol)))
    return Counter(paths)


def alike(a: str, b: str) -> float:
    """The share of paths that two skeletons have in common."""
    a_paths, b_paths = _paths(a), _paths(b)
    return 2 * (a_paths & b_paths).total() / (a_paths.total() + b_paths.total())


def layouts(skeletons: list[str], same: float) -> list[str]:
    """The first skeleton and each later one that is less than ``same`` alike to all before it."""
    out: list[str] = []
    for x in skeletons:
        if all(alike(x, y) < same for y in out):
            out.append(x)
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


@lru_cache(maxsize=1 << 14)
def _hash(symbol: str, text: str) -> int:
    return _signed(xxhash.xxh64_intdigest(f"{symbol}\x00{text}"))


def extract(html: str, template: frozenset[int]) -> str:
    """The blocks of the article, or of the whole page if it has none, without what is left out or template."""
    _, blocks = parse(html)
    inside = any(n.main and not n.out for n, _ in blocks)
    return "\n".join(t for n, t in blocks if not n.out and (n.main or not inside) and (not template or _hash(n.symbol, t) not in template))


def induce(pages: DataFrame, constant: float = 0.8, min_pages: int = 5, frequent: int = 32, same: float = 0.75) -> DataFrame:
    """(host, texts): hashes of the template's nodes of each host, from (host, html) of all pages.

    A host's layouts are those of its ``frequent`` most frequent skeletons that are less than ``same`` alike. A
    text is template if slot and text recur on a share ``constant`` of the host's pages, all aligned with the
    most frequent skeleton, or of the pages nearest to one layout, aligned with that.
    """

    def shape(batches):
        for b in batches:
            rows = []
            for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                root, blocks = parse(html)
                skeleton, slots = fold(root)
                own = sorted({(slots[id(n)], _hash(n.symbol, t)) for n, t in blocks if not n.out})
                rows.append((host, skeleton, _signed(xxhash.xxh64_intdigest(skeleton)), _signed(xxhash.xxh64_intdigest(html)),
                             [s for s, _ in own], [h for _, h in own]))
            host, skeleton, key, page, slot, text = zip(*rows, strict=True) if rows else ([],) * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(host, pa.string()), pa.array(skeleton, pa.string()), pa.array(key, pa.int64()), pa.array(page, pa.int64()),
                 pa.array(slot, pa.list_(pa.int32())), pa.array(text, pa.list_(pa.int64()))],
                names=["host", "skeleton", "key", "page", "slot", "text"])

    shaped = stored(pages.select("host", "html").where("html <> ''").mapInArrow(
        lean(shape), "host string, skeleton string, key long, page long, slot array<int>, text array<long>"), "shapes")
    kinds = shaped.groupBy("host", "key").agg(F.count("*").alias("n"), F.min("skeleton").alias("skeleton"))
    kinds = stored(kinds, "kinds")
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), F.desc("key")))
    top = kinds.withColumn("rank", rank).where(F.col("rank") <= frequent)
    top = (top.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("rank", "skeleton"))).alias("r"))
           .select("host", F.col("r")["skeleton"].alias("skeletons")))

    def choose(batches):
        for b in batches:
            own = [layouts(x, same) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.list_(pa.string()))], names=["host", "layouts"])

    chosen = stored(top.mapInArrow(lean(choose), "host string, layouts array<string>"), "layouts")

    def align(batches):
        for b in batches:
            row, layout, names = [], [], []
            for i, (refs, skeleton) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                row.append(i)
                layout.append(-1)  # all pages of the host
                names.append(slot_names(refs[0], skeleton))
                if len(refs) > 1:
                    near = max(range(len(refs)), key=lambda k: (alike(refs[k], skeleton), -k))
                    row.append(i)
                    layout.append(near)
                    names.append(slot_names(refs[near], skeleton) if near else names[-1])
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(layout, pa.int32()), pa.array(names, pa.list_(pa.string()))],
                                             names=["host", "key", "layout", "names"])

    slots = stored(kinds.join(chosen, "host").select("host", "key", "layouts", "skeleton")
                   .mapInArrow(lean(align), "host string, key long, layout int, names array<string>"), "slots")
    one = shaped.groupBy("host", "key", "page").agg(F.first("slot").alias("slot"), F.first("text").alias("text"))
    placed = one.join(slots, ["host", "key"])
    total = placed.groupBy("host", "layout").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    cells = (placed.select("host", "layout", F.explode(F.arrays_zip("slot", "text")).alias("x"), "names")
             .select("host", "layout", F.element_at("names", F.col("x")["slot"] + 1).alias("name"), F.col("x")["text"].alias("text")))
    return (cells.groupBy("host", "layout", "name", "text").agg(F.count("*").alias("n")).join(total, ["host", "layout"])
            .where(F.col("n") >= constant * F.col("pages")).groupBy("host").agg(F.collect_set("text").alias("texts")))


def main_text(pages: DataFrame, constant: float = 0.8, min_pages: int = 5,
              id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) of every page."""
    bounded_batches(pages.sparkSession)
    host, _ = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).withColumn("host", host)
    # at most 1 / constant texts per slot of the host's trees
    templates = stored(induce(rows, constant, min_pages), "templates")
    kind = rows.schema["page_id"].dataType.simpleString()
    joined = rows.join(templates, "host", "left").select("page_id", "url", "html", "texts")

    def run(batches):
        for b in batches:
            text = [extract(h, frozenset(t or ())) if h else "" for h, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string())], names=["page_id", "url", "text"])

    return joined.mapInArrow(lean(run), f"page_id {kind}, url string, text string")
