"""HTML extraction by wrapper induction.

All pages of a host take part. Simple tree matching aligns their shapes, and pages whose
shapes match well are one layout. Slots (path and text) are counted over all pages of
different content of a layout: those that nearly all of them have become the host's template,
slots that vary are content. Matched elements have the same path of signatures, so counting
by path counts aligned slots. A page's text is then read from its whole tree: boilerplate
elements (by tag, role, class or id) and template slots are left out. Where the rest is read
is learnt too: the deepest slot that holds most of the varying text over all pages of a
layout, and its titles, is its content slot. Tags are a prior in that: text of an article weighs more, text of
links outside of one nothing. Pages of hosts with too few pages to learn from, and pages
without their layout's content slot, are read by the prior alone.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stored
from .url_rules import host_of

#: A slot is template only if at least so many pages of different content, and this share of those of its layout, have it.
MIN_PAGES = 3
MIN_SHARE = 0.8
#: Shapes are one layout if tree matching aligns this share of their elements.
LAYOUT_SHARE = 0.7
#: Template slots inside an article may hold at most this share of its text: near copies aren't templates.
MAX_TEMPLATE_SHARE = 0.3
#: The content slot holds this share of its layout's weighed text; text of an article weighs so many times that of other elements.
CONTENT_SHARE = 0.6
MAIN_WEIGHT = 4
#: Wrappers of at most so many bytes in all are broadcast; more are joined over salted hosts.
BROADCAST_BYTES = 16 << 20
SALTS = 32
#: Elements nested deeper have their content taken into the one at this depth.
MAX_DEPTH = 256

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset(("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"))
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr img".split())
_DROPPED = frozenset("head title script style noscript template nav header footer aside form button select option textarea input "
    "iframe svg canvas object dialog menu menuitem map audio video".split())
_DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
_DROPPED_NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget ad ads advert adverts "
    "advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal "
    "overlay newsletter subscribe signup login share sharing social related recommended comment comments disqus reply replies "
    "respond responses form search toolbar pagination pager skip".split()
)
_MAIN = frozenset(("article", "main"))
#: Elements that can be content slots.
_CONTAINERS = frozenset("#root html body center div section article main td".split())
#: A class or id with such a first word says what an element has or lacks; such a word as a whole class or id says that it is content.
_ABOUT = frozenset("no not non without with has have hide show is".split())
_CONTENT = frozenset("content post entry story article".split())
#: Opening one of these closes an open one of the second kind, up to a boundary.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("tr", "td", "th", "thead")}
_BOUNDS = frozenset(("ul", "ol", "dl", "table", "select", "body", "html", "article", "main", "section", "div", "nav"))
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr main menu nav ol p pre section table ul".split())

#: Comments, declarations, tags, tags with a quote that is never closed (they end at the next >), text.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|</?([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[^<]+|<",
    re.S,
)
_ATTR = re.compile(r"""([^\s"'<>/=][^\s>/=]*)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s>"'][^\s>]*)))?""")
_SPLIT = re.compile(r"[^a-z0-9]+")


class Node:
    """An element.

    Its signature (tag and first class), children (nodes and texts in order) and whether it is boilerplate, or only
    named like it.
    """

    __slots__ = ("tag", "sign", "items", "dropped", "named")

    def __init__(self, tag: str, sign: str, dropped: bool, named: bool = False):
        self.tag, self.sign, self.items, self.dropped, self.named = tag, sign, [], dropped or named, named and not dropped


def _names(value: str) -> bool:
    """Whether a class or id names boilerplate."""
    words = [[w for w in _SPLIT.split(x) if w] for x in value.split()]
    if any(len(x) == 1 and x[0] in _CONTENT for x in words):
        return False
    return any(x and x[0] not in _ABOUT and not _DROPPED_NAMES.isdisjoint(x) for x in words)


def _element(tag: str, attributes: str) -> Node:
    dropped, named, sign = tag in _DROPPED, False, tag
    if attributes and tag not in ("html", "body"):
        found: dict[str, str] = {}
        for name, a, b, c in _ATTR.findall(attributes):
            found.setdefault(name.lower(), (a or b or c).strip().lower())
        words = [w for w in _SPLIT.split(found.get("class", "")) if w]
        if words:
            sign = f"{tag}.{words[0]}"
        named = tag not in _MAIN and (_names(found.get("class", "")) or _names(found.get("id", "")))
        dropped = (dropped or "hidden" in found or found.get("aria-hidden") == "true"
            or not _DROPPED_ROLES.isdisjoint(found.get("role", "").split()[:1]))
    return Node(tag, sign, dropped, named)


def _named_kept(root: Node) -> None:
    """Keep elements that are only named like boilerplate where they hold the page's article, or all of its text."""

    def over(tag: str | None) -> list[Node] | None:
        """Named elements above elements of a tag (above texts without one); None if one lies in no named element."""
        found: dict[int, Node] = {}
        todo: list[tuple[Node, tuple]] = [(root, ())]
        while todo:
            node, above = todo.pop()
            if node.dropped and not node.named:
                continue
            above = (node, above) if node.named and node.dropped else above
            if node.tag == tag or tag is None and any(isinstance(x, str) and x.strip() for x in node.items):
                if not above:
                    return None
                rest = above
                while rest and id(rest[0]) not in found:
                    found[id(rest[0])] = rest[0]
                    rest = rest[1]
            todo.extend((x, above) for x in node.items if not isinstance(x, str))
        return list(found.values())

    held = over("article")
    if held == []:
        held = over("main")
    for node in held or ():
        node.dropped = False
    for node in over(None) or ():
        node.dropped = False


def parse(page: str | None) -> Node:
    """The DOM tree of a page, lenient: unclosed, misnested and cut off markup give a tree too."""
    root = Node("#root", "#root", False)
    stack = [root]
    text = page or ""
    at, n = 0, len(text)
    opened: dict[str, int] = defaultdict(int)

    def close(i: int) -> None:
        """Close the elements from the i-th on; the end of a block below MAX_DEPTH still parts words."""
        ends = any(x.tag not in _INLINE for x in stack[max(i, MAX_DEPTH) :])
        for x in stack[i:]:
            opened[x.tag] -= 1
        del stack[i:]
        if ends:
            stack[-1].items.append(Node("div", "div", False))

    while at < n:
        m = _TOKEN.match(text, at)
        at = m.end()
        tag = m.group(1) or m.group(3)
        if tag is None:
            piece = m.group()
            if piece[0] != "<" or piece == "<":
                stack[-1].items.append(html.unescape(piece))
            elif piece.startswith("<![CDATA["):
                stack[-1].items.append(piece[9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m.group().startswith("</"):
            if not opened[tag]:
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
                if stack[i].tag in _MAIN and tag in _INLINE:
                    break
            continue
        if tag in _ENDS_P and opened["p"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag not in _INLINE:
                    break
        closes = _CLOSES.get(tag)
        if closes and any(opened[x] for x in closes):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in closes:
                    close(i)
                    break
                if stack[i].tag in _BOUNDS:
                    break
        node = _element(tag, m.group(2) or m.group(4) or "")
        below = len(stack) >= MAX_DEPTH and tag not in _RAW and tag not in _VOID
        within = len(stack) > MAX_DEPTH and stack[-1].named
        # Below the depth, content goes to the element at it, or to the boilerplate it lies in; end tags match as ever.
        shared = below and (not node.dropped or node.named and within)
        stack[-1].items.append(Node(tag, tag, False) if shared else node)
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(text, at)
            if not node.dropped:
                node.items.append(html.unescape(text[at : end.start() if end else n]))
            at = n if not end else (text.find(">", end.start()) + 1 or n)
        elif tag not in _VOID:
            if shared:
                node.items, node.named = stack[-1].items, within
            stack.append(node)
            opened[tag] += 1
    _named_kept(root)
    return root


def _own_text(node: Node) -> str:
    return " ".join(" ".join(x for x in node.items if isinstance(x, str)).split())


def _children(node: Node) -> list[Node]:
    return [x for x in node.items if not isinstance(x, str) and not x.dropped]


def _place(path: str) -> int:
    """64 bits of a slot."""
    return _key(path, "\0")


def _key(path: str, text: str) -> int:
    """64 bits of a slot and its text."""
    return int.from_bytes(hashlib.blake2b(f"{path}\0{text}".encode("utf-8", "surrogatepass"), digest_size=8)
        .digest(), "big", signed=True)


def tree_match(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: the largest order-preserving match of two trees whose roots have the same signature.

    Children lists are aligned by dynamic programming; returns its size and the matched pairs.
    """
    if a.sign != b.sign:
        return 0, []
    left, right = _children(a), _children(b)
    if not left or not right:
        return 1, [(a, b)]
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    held: dict[tuple[int, int], tuple[int, list[tuple[Node, Node]]]] = {}
    for i, x in enumerate(left):
        row, above = best[i + 1], best[i]
        for j, y in enumerate(right):
            w = 0
            if x.sign == y.sign:
                if _children(x) and _children(y):
                    held[i, j] = tree_match(x, y)
                    w = held[i, j][0]
                else:
                    w = 1
            row[j + 1] = max(row[j], above[j + 1], above[j] + w)
    pairs, i, j = [(a, b)], len(left), len(right)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs += held[i, j][1] if (i, j) in held else [(left[i], right[j])]
    return best[-1][-1] + 1, pairs


def _size(node: Node) -> int:
    return 1 + sum(_size(x) for x in _children(node))


def _slots(node: Node, path: str, main: bool, out: list[tuple[Node, str, bool]]) -> None:
    path, main = f"{path}/{node.sign}", main or node.tag in _MAIN
    out.append((node, path, main))
    for x in _children(node):
        _slots(x, path, main, out)


def _shape(nodes: list[Node], main: bool = False) -> list:
    """Elements below some of one signature, siblings of the same signature taken as one; an article's plain content has none."""
    held: dict[str, list[Node]] = defaultdict(list)
    for node in nodes:
        for x in _children(node):
            if x.tag not in _INLINE and (not main or "." in x.sign):
                held[x.sign].append(x)
    return [[sign, _shape(xs, main or xs[0].tag in _MAIN)] for sign, xs in sorted(held.items())]


def _tree(sign: str, shape: list) -> Node:
    node = Node(sign, sign, False)
    node.items = [_tree(*x) for x in shape]
    return node


def masses(tree: Node) -> list[tuple[int, int, int, int]]:
    """(slot, depth, mass, titles) of the containers of a tree, down to its articles.

    The mass is the weighed length of the text below, titles that of its first two levels of
    headings. Boilerplate elements weigh nothing, nor do links outside of an article.
    """
    total: dict[str, list[int]] = {}
    todo: list[tuple[Node, str, tuple[str, ...], bool, bool]] = [(tree, "", (), False, False)]
    while todo:
        node, path, held, main, linked = todo.pop()
        linked = linked or node.tag == "a"
        if not main and node.tag not in _INLINE:
            path = f"{path}/{node.sign}"
            if node.tag in _CONTAINERS:
                held = (*held, path)
        main = main or node.tag in _MAIN
        own = len(_own_text(node))
        if own and (main or not linked):
            for depth, x in enumerate(held):
                row = total.setdefault(x, [depth, 0, 0])
                row[1] += own * (MAIN_WEIGHT if main else 1)
                row[2] += own if node.tag in ("h1", "h2") else 0
        todo.extend((x, path, held, main, linked) for x in _children(node))
    return [(_place(x), *row) for x, row in total.items()]


def content_slot(rows: list[tuple[int, int, int, int]]) -> int | None:
    """The content slot of a layout, from (slot, depth, mass, titles) summed over its pages: the deepest with most of text and titles."""
    mass, titles = (max((r[i] for r in rows), default=0) * CONTENT_SHARE for i in (2, 3))
    fit = [(r[1], r[2], r[0]) for r in rows if r[2] >= mass and r[3] >= titles]
    return max(fit)[2] if fit else None


def facts(page: str) -> tuple[str, int, int, dict[int, int], list[tuple[int, int, int, int]]]:
    """What the count needs of a page: shape, 64 bits of its text, length of its articles, its slots and its masses.

    Slots are keys with the length of their text inside an article, and 0 outside.
    """
    tree = parse(page)
    slots: list[tuple[Node, str, bool]] = []
    _slots(tree, "", False, slots)
    found, whole = {}, 0
    for node, path, main in slots:
        text = _own_text(node)
        if text:
            found[_key(path, text)] = len(text) if main else 0
            whole += len(text) if main else 0
    return json.dumps(_shape([tree])), _key("", read(tree, frozenset())), whole, found, masses(tree)


def layouts(shapes: dict[str, int]) -> dict[str, int]:
    """The layout of each shape of a host, given its number of pages: shapes join the first of the more frequent ones that they match."""
    leaders: list[tuple[Node, int]] = []
    found = {}
    for shape in sorted(shapes, key=lambda x: (-shapes[x], x)):
        tree = _tree("#root", json.loads(shape))
        size = _size(tree)
        fits = (i for i, (other, n) in enumerate(leaders) if 2 * min(size, n) >= LAYOUT_SHARE * (size + n)
            and 2 * tree_match(tree, other)[0] >= LAYOUT_SHARE * (size + n))
        found[shape] = next(fits, len(leaders))
        if found[shape] == len(leaders):
            leaders.append((tree, size))
    return found


def induce(pages: list[str]) -> tuple[list[int], list[int]]:
    """Template slots (keys of path and text) and content slots of pages of one host; ``induce_wrappers`` does the same for a table.

    Pages of a layout are told apart by their text first, so copies count once. Slots of an
    article are only taken when they hold a small share of it over all pages of the layout.
    """
    every = [facts(p) for p in pages]
    shapes: dict[str, int] = defaultdict(int)
    for shape, *_ in every:
        shapes[shape] += 1
    of = layouts(shapes)
    distinct: dict[tuple[int, int], tuple] = {}
    for shape, content, whole, slots, weighed in every:
        row = (whole, sorted(slots.items()), sorted(weighed))
        distinct[of[shape], content] = min(distinct.get((of[shape], content), row), row)
    template: set[int] = set()
    content_slots: set[int] = set()
    for layout in set(of.values()):
        held = [x for (n, _), x in distinct.items() if n == layout]
        count: dict[tuple[int, int], int] = defaultdict(int)
        weight: dict[tuple[int, int], list[int]] = defaultdict(lambda: [0, 0])
        for _, slots, weighed in held:
            for slot in slots:
                count[slot] += 1
            for slot, depth, mass, titles in weighed:
                row = weight[slot, depth]
                row[0], row[1] = row[0] + mass, row[1] + titles
        taken = {x: n for x, n in count.items() if n >= MIN_PAGES and n >= MIN_SHARE * len(held)}
        small = sum(n * size for (_, size), n in taken.items()) <= MAX_TEMPLATE_SHARE * sum(whole for whole, *_ in held)
        template |= {key for key, size in taken if small or not size}
        best = content_slot([(*x, *n) for x, n in weight.items()]) if len(held) >= MIN_PAGES else None
        content_slots |= {best} - {None}
    return sorted(template), sorted(content_slots)


def read(tree: Node, template: frozenset[int], content: frozenset[int] = frozenset()) -> str:
    """The main text of a tree: of its content slots where it has any, else of the whole page; and of its articles where there are any."""
    blocks: list[str] = []
    words: list[str] = []

    def articles_of(top: Node, above: str) -> list[tuple[Node, str]]:
        """(element, path above it) of the outermost articles, in page order."""
        found: list[tuple[Node, str]] = []
        todo = [(top, above)]
        while todo:
            node, path = todo.pop()
            if node.tag in _MAIN:
                found.append((node, path))
            else:
                todo.extend((x, f"{path}/{node.sign}") for x in reversed(_children(node)))
        return found

    def end() -> None:
        line = " ".join("".join(words).split())
        if line:
            blocks.append(line)
        words.clear()

    def walk(top: Node, prefix: str) -> None:
        todo: list[tuple[object, str, bool]] = [(top, prefix, False)]
        while todo:
            item, path, skip = todo.pop()
            if item is None:
                end()
            elif isinstance(item, str):
                if not skip:
                    words.append(item)
            elif not item.dropped:
                path = f"{path}/{item.sign}"
                skip = bool(template) and any(isinstance(x, str) for x in item.items) and _key(path, _own_text(item)) in template
                block = item.tag not in _INLINE
                if block:
                    end()
                    todo.append((None, path, skip))
                todo.extend((x, path, skip) for x in reversed(item.items))

    def deepest() -> list[tuple[Node, str]]:
        """(element, path above it) of the deepest content slot that the page has: a host's layouts may share the upper ones."""
        found: dict[int, list[tuple[Node, str]]] = defaultdict(list)
        todo = [(tree, "", "", 0)]
        while todo:
            node, path, blocks_path, depth = todo.pop()
            if node.tag not in _INLINE:  # slots of texts have inline elements in their paths, content slots don't
                blocks_path = f"{blocks_path}/{node.sign}"
                if node.tag in _CONTAINERS and _place(blocks_path) in content:
                    found[depth].append((node, path))
            todo.extend((x, f"{path}/{node.sign}", blocks_path, depth + 1) for x in reversed(_children(node)))
        return found[max(found)] if found else []

    tops = deepest() if content else []
    articles = [x for node, path in tops or [(tree, "")] for x in articles_of(node, path)]
    for chosen in (articles, tops, [(tree, "")]):
        for top, path in chosen:
            walk(top, path)
            end()
        if blocks:
            break
    return " ".join(blocks)


def extract(page: str | None, template: frozenset[int] = frozenset(), content: frozenset[int] = frozenset()) -> str:
    """The main text of one page under its host's wrapper; empty for a null or empty page."""
    return read(parse(page), template, content) if page else ""


def induce_wrappers(pages: DataFrame) -> DataFrame:
    """(host, template array<long>, content array<long>) for hosts with a wrapper, from all pages of each.

    Every page is parsed once into its slots. Copies are folded and slots counted by
    aggregations that combine before the shuffle, so a host with a third of all pages is dealt
    out by content and by slot; only shapes and template slots of a host meet in one task.
    """
    hosted = pages.filter((F.col("host") != "") & F.col("html").isNotNull()).select("host", "html")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = pa.list_(pa.struct([("key", pa.int64()), ("size", pa.int32())]))
        mass = pa.list_(pa.struct([("slot", pa.int64()), ("depth", pa.int32()), ("mass", pa.int64()), ("titles", pa.int64())]))
        for batch in batches:
            found = [facts(h) for h in batch.column(1).to_pylist()]
            slots = [[{"key": k, "size": n} for k, n in sorted(x[3].items())] for x in found]
            weighed = [[dict(zip(("slot", "depth", "mass", "titles"), y)) for y in sorted(x[4])] for x in found]
            columns = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
            names = ["host", "shape", "content", "whole", "slots", "masses"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(slots, slot), pa.array(weighed, mass)], names=names)

    row = "slots array<struct<key:long,size:int>>, masses array<struct<slot:long,depth:int,mass:long,titles:long>>"
    seen = stored(map_batches(hosted, look, f"host string, shape string, content long, whole long, {row}"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        of = layouts(dict(zip(pdf["shape"], pdf["n"])))
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "shapes": [list(of)], "numbers": [list(of.values())]})

    shapes = stored(seen.groupBy("host", "shape").agg(F.count("*").alias("n")).groupBy("host")
        .applyInPandas(fit, "host string, shapes array<string>, numbers array<int>"))
    n_bytes = shapes.agg(F.coalesce(F.sum(F.length("host") + F.length(F.array_join("shapes", "")) + F.size("shapes") * 16 + 32),
        F.lit(0))).first()[0]
    placed = _by_host(seen, shapes, n_bytes, salt=("content", "shape")).select("host",
        F.element_at("numbers", F.array_position("shapes", F.col("shape")).cast("int"))
            .alias("layout"), "content", "whole", "slots", "masses")
    distinct = stored(placed.groupBy("host", "layout", "content").agg(F.min(F.struct("whole", "slots", "masses")).alias("row"))
        .select("host", "layout", "row.*"))
    whole = distinct.groupBy("host", "layout").agg(F.count("*").alias("pages"), F.sum("whole").alias("whole"))
    counted = distinct.select("host", "layout", F.explode("slots")
        .alias("slot")).groupBy("host", "layout", "slot.key", "slot.size").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_PAGES)
    taken = counted.join(whole, ["host", "layout"]).filter(F.col("n") >= MIN_SHARE * F.col("pages"))
    slots = F.collect_list(F.struct("key", "size"))
    layout = taken.groupBy("host", "layout").agg(slots.alias("slots"),
        (F.sum(F.col("n") * F.col("size")) <= MAX_TEMPLATE_SHARE * F.first("whole")).alias("small"))
    keys = layout.select("host", F.explode(F.filter("slots", lambda x: F.col("small") | (x["size"] == 0))).alias("slot"))
    template = keys.groupBy("host").agg(F.sort_array(F.collect_set("slot.key")).alias("template"))
    # The content slot of each layout: summed by slot before anything meets, a few slots a layout.
    weighed = distinct.select("host", "layout", F.explode("masses")
        .alias("m")).groupBy("host", "layout", "m.slot", "m.depth").agg(F.sum("m.mass").alias("mass"), F.sum("m.titles")
            .alias("titles"))
    enough = whole.filter(F.col("pages") >= MIN_PAGES).select("host", "layout")
    most = weighed.groupBy("host", "layout").agg(F.max("mass").alias("most"), F.max("titles").alias("heads"))
    held = (F.col("mass") >= CONTENT_SHARE * F.col("most")) & (F.col("titles") >= CONTENT_SHARE * F.col("heads"))
    fit = weighed.join(most, ["host", "layout"]).filter(held).join(enough, ["host", "layout"])
    best = fit.groupBy("host", "layout").agg(F.max(F.struct("depth", "mass", "slot"))["slot"].alias("slot"))
    content = best.groupBy("host").agg(F.sort_array(F.collect_set("slot")).alias("content"))
    none = F.array().cast("array<long>")
    return stored(template.join(content, "host", "full_outer")
        .select("host", F.coalesce("template", none).alias("template"), F.coalesce("content", none).alias("content")))


def _by_host(pages: DataFrame, small: DataFrame, n_bytes: int, how: str = "inner",
    salt: tuple[str, ...] = ("url", "page_id")) -> DataFrame:
    """Pages joined to a table of one row a host: broadcast within the bound, else over salted hosts."""
    if n_bytes <= BROADCAST_BYTES:
        return pages.join(F.broadcast(small), "host", how)
    dealt = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pages.withColumn("__salt", F.pmod(F.xxhash64(*salt), F.lit(SALTS))
        .cast("int")).join(dealt, ["host", "__salt"], how).drop("__salt")


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page, from its whole html.

    A null or empty html gives an empty text; a null url has no host and so no template; a
    null page_id stays null; repeated rows stay repeated; other columns are ignored.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    wrappers = induce_wrappers(rows)
    n_bytes = wrappers.agg(F.coalesce(F.sum(F.size("template") * 8 + F.size("content") * 8 + F.length("host") + 32),
        F.lit(0))).first()[0]
    joined = _by_host(rows, wrappers, n_bytes, "left").select("page_id", "url", "html", "template", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))
            texts = [extract(h, frozenset(t or ()), frozenset(c or ())) for h, t, c in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_batches(joined, run, "page_id long, url string, text string, n_chars long")
