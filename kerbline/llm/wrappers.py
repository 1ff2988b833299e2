"""HTML extraction by wrapper induction.

All pages of a host are compared. Trees are folded first: sibling elements of one label (tag and names without digits)
become one node, as an iterator would, so that long articles and lists don't grow the match. Labels of siblings are
different then, and simple tree matching pairs the nodes of two pages whose labels are the same from the root on, if
their order agrees. So a node's path, its place, says what it is matched with on every other page, and counts by place
do for all pages what matching does for two (``induce``).

A text that is the same on all pages that have its place is template, if these are enough different pages; other texts
are slots. A place below which the pages that have it hold most of their varying text leads to where the host has its
articles; a host of several layouts has several such places. The text of every page is taken from its region, without
template texts and without what its tags and names mark as menus, headers, footers, sidebars, notices, adverts, forms
or comments. Pages without a region of their host, and pages without a host, fall back to their own article, main or
body element.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from kerbline.llm.dom import BLOCKS, Node, clean, parse, text_parts
from kerbline.llm.texts import map_rows
from kerbline.llm.url_filter import host_of
from kerbline.operators.store import materialize

#: Different pages that a template text must be equal on.
LEAST_PAGES = 8
#: A region goes on into a child with so much of the varying text.
REGION_SHARE = 0.8
#: Nodes equal on all pages are no template if they make up more than this of the region: the pages are copies then.
MOST_TEMPLATE = 0.3
CONTAINERS = frozenset("body div section article main center table tbody tr td".split())
#: The place of a page's root.
ROOT = 0


def own_text(node: Node) -> str:
    return " ".join("".join(c for c in node.children if isinstance(c, str)).split())


class Folded:
    """Elements of one label below one parent, folded into one."""

    def __init__(self, label: str, tag: str):
        self.label, self.tag = label, tag
        self.texts: list[str] = []
        self.children: dict[str, Folded] = {}

    def add(self, node: Node) -> "Folded":
        todo = [(self, node)]
        while todo:
            folded, node = todo.pop()
            if own := own_text(node):
                folded.texts.append(own)
            below = []
            for child in node.children:
                if isinstance(child, Node) and not child.marked:
                    if child.label not in folded.children:
                        folded.children[child.label] = Folded(child.label, child.tag)
                    below.append((folded.children[child.label], child))
            todo.extend(reversed(below))
        return self


def align(a: Folded, b: Folded) -> tuple[int, list[tuple[Folded, Folded]]]:
    """Simple tree matching: the most nodes of two trees that can be paired in order, parents with parents, and the pairs."""
    if a.label != b.label:
        return 0, []
    todo = [(a, b)]
    for x, y in todo:  # Grows: partners of one label, parents first.
        todo += [(child, y.children[label]) for label, child in x.children.items() if label in y.children]
    sizes: dict[int, int] = {}
    chosen: dict[int, list[tuple[Folded, Folded]]] = {}
    for x, y in reversed(todo):
        sizes[id(x)], chosen[id(x)] = _match(list(x.children.values()), list(y.children.values()), sizes)
    pairs = [(a, b)]
    for x, _ in pairs:  # Grows.
        pairs += chosen[id(x)]
    return sizes[id(a)], pairs


def _match(rows: list[Folded], columns: list[Folded], sizes: dict[int, int]) -> tuple[int, list[tuple[Folded, Folded]]]:
    """The best pairs in order of the children of two nodes, whose own pairs have been counted, and the size with their parents."""
    best = [[0] * (len(columns) + 1) for _ in range(len(rows) + 1)]
    for i, x in enumerate(rows, 1):
        for j, y in enumerate(columns, 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1])
            if x.label == y.label:
                best[i][j] = max(best[i][j], best[i - 1][j - 1] + sizes[id(x)])
    pairs, i, j = [], len(rows), len(columns)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((rows[i], columns[j]))
    return best[-1][-1] + 1, pairs


def path_nodes(root: Node, path: list[str]) -> list[Node]:
    level = [root]
    for label in path:
        level = [c for n in level for c in n.children if isinstance(c, Node) and c.label == label and not c.marked]
    return level


def digest(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()[:16]


def induce(pages: list[str]) -> dict:
    """The wrapper of a few pages in memory, by tree matching: the path of the content region and digests of template texts in it."""
    trees = {}
    for page in sorted(set(pages)):
        tree = Folded("#page", "#page").add(parse(page))
        trees.setdefault(json.dumps(_texts(tree)), tree)
    distinct = list(trees.values())
    if not distinct:
        return {"path": [], "template": []}
    reference = max(distinct, key=_size)
    matched: dict[int, list[Folded]] = {}
    for other in distinct:
        if other is not reference:
            for mine, theirs in align(reference, other)[1]:
                matched.setdefault(id(mine), []).append(theirs)

    def constant(node: Folded) -> set[str]:
        """Texts of a block that its partners have on all pages."""
        others = matched.get(id(node), [])
        if node.tag not in BLOCKS or len(distinct) < LEAST_PAGES or len(others) < len(distinct) - 1:
            return set()
        return set(node.texts).intersection(*(o.texts for o in others))

    sums: dict[int, int] = {}
    for node in reversed(list(_walk(reference))):
        fixed = constant(node)
        own = sum(len(t) for n in (node, *matched.get(id(node), [])) for t in n.texts if t not in fixed)
        sums[id(node)] = own + sum(sums[id(c)] for c in node.children.values())

    def varying(node: Folded) -> int:
        return sums[id(node)]

    node, path, total = reference, [], varying(reference)
    while total and node.tag not in ("article", "main"):
        inner = max(node.children.values(), key=varying, default=None)
        if inner is None or inner.tag not in CONTAINERS | {"html"} or varying(inner) < REGION_SHARE * total:
            break
        node = inner
        path.append(node.label)
    template = [t for n in _walk(node) for t in constant(n)]
    if sum(map(len, template)) > MOST_TEMPLATE * sum(map(len, _texts(node))):
        template = []
    return {"path": path, "template": sorted(set(map(digest, template)))}


def _walk(node: Folded):
    """Nodes in page order, parents first."""
    todo = [node]
    while todo:
        node = todo.pop()
        yield node
        todo.extend(reversed(node.children.values()))


def _texts(node: Folded) -> list[str]:
    return [t for n in _walk(node) for t in n.texts]


def _size(node: Folded) -> int:
    return sum(1 for _ in _walk(node))


def number(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode("utf-8", "replace")).digest()[:8], "big", signed=True)


def placing():
    """The place of a label below a place, remembered for the labels of many pages."""
    known: dict[tuple[int, str], int] = {}

    def place(above: int, label: str) -> int:
        if (above, label) not in known:
            if len(known) > 100_000:
                known.clear()
            known[above, label] = number(f"{above} {label}")
        return known[above, label]
    return place


def extract(page: str | None, wrapper: dict | None, place=None) -> str:
    """The main text of a page: blocks of its region in page order. ``wrapper`` is of a whole host, or of ``induce``."""
    root = parse(page)
    template, key = frozenset(wrapper["template"] if wrapper else ()), lambda node, text: digest(text)
    regions = path_nodes(root, wrapper["path"]) if wrapper and wrapper.get("path") else []
    if wrapper and "regions" in wrapper:
        place = place or placing()
        regions, at = _learnt_region(root, frozenset(wrapper["regions"]), place)
        if at in wrapper["copies"]:
            template = frozenset()
        if template:
            places = {id(node): where for node, where in _placed(root, place)}
            key = lambda node, text: number(f"{places.get(id(node))} {text}")
    if not any(clean(text_parts(r, lambda n: n.marked)) for r in regions):
        regions = _own_region(root)

    def skip(node: Node) -> bool:
        if node.marked or not template or node.tag not in BLOCKS:
            return node.marked
        own = own_text(node)
        return bool(own) and key(node, own) in template

    return " ".join(t for t in (clean(text_parts(r, skip)) for r in regions) if t)


def _placed(root: Node, place) -> Iterable[tuple[Node, int]]:
    """Unmarked nodes and their places."""
    todo = [(root, ROOT)]
    while todo:
        node, where = todo.pop()
        yield node, where
        todo.extend((c, place(where, c.label)) for c in node.children if isinstance(c, Node) and not c.marked)


def _learnt_region(root: Node, learnt: frozenset[int], place) -> tuple[list[Node], int]:
    """The nodes of the innermost learnt place of a page, of several beside each other the one with most text, and the place."""
    level, at = [root], ROOT
    while True:
        found: dict[int, list[Node]] = {}
        for child in (c for n in level for c in n.children if isinstance(c, Node) and not c.marked):
            if (where := place(at, child.label)) in learnt:
                found.setdefault(where, []).append(child)
        sizes = {w: sum(len(clean(text_parts(n, lambda x: x.marked))) for n in nodes) for w, nodes in found.items()} \
            if len(found) > 1 else dict.fromkeys(found, 1)
        best = max(sizes, key=lambda w: (sizes[w], w), default=None)
        if best is None:
            return ([] if at == ROOT else level), at
        level, at = found[best], best
        if level[0].tag in ("article", "main"):
            return level, at


def _own_region(root: Node) -> list[Node]:
    found: dict[str, list[Node]] = {}
    todo = [root]
    while todo:
        node = todo.pop()
        for child in reversed(node.children):
            if isinstance(child, Node) and not child.marked:
                found.setdefault(child.tag, []).append(child)
                if child.tag not in ("article", "main"):
                    todo.append(child)
    for tag in ("article", "main"):
        filled = [n for n in found.get(tag, []) if clean(text_parts(n, lambda x: x.marked))]
        if filled:
            return filled
    return [root]


MEASURED = ("above array<int>, places array<bigint>, regions array<boolean>, chars array<bigint>, owners array<int>, "
            "texts array<bigint>, lengths array<bigint>")


def measure(page: str, place) -> tuple:
    """A page's digest of texts, its two longest texts in blocks, and its folded nodes (place, the node above, whether a region, text
    in all) with their texts in blocks (node, place and text as one number, length)."""
    tree = Folded("#page", "#page").add(parse(page))
    above, places, regions, chars, owners, texts, lengths = [], [], [], [], [], [], []
    todo = [(tree, -1, ROOT)]
    for node, up, where in todo:  # Grows: parents first.
        at = len(above)
        above.append(up)
        places.append(where)
        regions.append(node.tag in CONTAINERS or node.tag == "html")
        chars.append(sum(map(len, node.texts)))
        if node.tag in BLOCKS:
            for text, times in sorted(Counter(node.texts).items()):
                owners.append(at)
                texts.append(number(f"{where} {text}"))
                lengths.append(len(text) * times)
        todo += [(c, at, place(where, c.label)) for c in node.children.values()]
    longest = sorted(zip(lengths, texts), reverse=True)[:2] + [(0, 0)] * 2
    return number(json.dumps(_texts(tree))), longest[0][1], longest[1][1], above, places, regions, chars, owners, texts, lengths


def shares(above, places, regions, chars, owners, texts, lengths, constants) -> Iterable[tuple[int, int, int, int]]:
    """Of the root and each place that may be a region: the text below it, the varying text below it, and that of the page."""
    fixed, varying, chars = frozenset(constants or ()), list(chars), list(chars)
    for at, text, length in zip(owners, texts, lengths):
        if text in fixed:
            varying[at] -= length
    for at in range(len(above) - 1, 0, -1):
        chars[above[at]] += chars[at]
        varying[above[at]] += varying[at]
    return [(places[at], chars[at], varying[at], varying[0]) for at in range(len(above)) if regions[at] or not at]


def learn_wrappers(pages: DataFrame, url: str = "url", content: str = "html") -> DataFrame:
    """(host, wrapper as JSON) for every host, from all its pages. Pages of equal texts count once.

    Rows of places and texts are summed in Spark, so that no task holds the pages of a host. A wrapper has the places that lead to
    regions, those among them whose pages are copies of each other, and the template texts. To be different, pages of a
    template text must differ in their longest other text.
    """
    def start():
        place = placing()
        return lambda rows: ((host, *measure(page, place)) for host, page in rows if page)

    own = pages.select(host_of(F.col(url)).alias("host"), F.col(content).alias("html")).where("host <> ''")
    measured = map_rows(own, f"host string, page bigint, longest bigint, next bigint, {MEASURED}", start)
    fields = [c for c in measured.columns if c not in ("host", "page")]
    different = materialize(measured.groupBy("host", "page").agg(F.min(F.struct(*fields)).alias("row")).select("host", "page", "row.*"),
                            "different-pages")

    having = different.select("host", F.explode("places").alias("place")).groupBy("host", "place").agg(F.count("*").alias("having"))
    texts = different.select("host", "places", "longest", "next", F.explode(F.arrays_zip("owners", "texts")).alias("one")).select(
        "host", F.get("places", F.col("one.owners")).alias("place"), F.col("one.texts").alias("text"),
        F.when(F.col("longest") == F.col("one.texts"), F.col("next")).otherwise(F.col("longest")).alias("other"))
    counted = texts.groupBy("host", "place", "text", "other").agg(F.count("*").alias("n")).groupBy("host", "place", "text").agg(
        F.sum("n").alias("n"), F.count("*").alias("different")).where(F.col("different") >= LEAST_PAGES)
    constants = materialize(counted.join(having, ["host", "place"]).where("n = having").groupBy("host").agg(
        F.sort_array(F.collect_list("text")).alias("constants")), "constant-texts")

    parts = different.join(constants, "host", "left").select("host", *(f.split()[0] for f in MEASURED.split(", ")), "constants")
    summed = map_rows(parts, "host string, place bigint, chars bigint, varying bigint, page bigint", lambda: lambda rows: (
        (host, *found) for host, *row in rows for found in shares(*row))).groupBy("host", "place").agg(
        F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("chars", "varying", "page")))
    hosts = summed.where(F.col("place") == ROOT).select("host", F.col("n").alias("pages"))
    # What a single page of several shows is no region of the host.
    regions = summed.join(hosts, "host").where(
        (F.col("place") != ROOT) & (F.col("page") > 0) & (F.col("varying") >= REGION_SHARE * F.col("page"))
        & (F.col("n") >= F.least(F.lit(2), F.col("pages")))).groupBy("host").agg(
        F.sort_array(F.collect_list("place")).alias("regions"),
        F.sort_array(F.collect_list(F.when(F.col("chars") - F.col("varying") > MOST_TEMPLATE * F.col("chars"), F.col("place")))).alias("copies"))
    none = F.array().cast("array<bigint>")
    return regions.join(constants, "host", "full").select("host", F.to_json(F.struct(
        F.coalesce("regions", none).alias("regions"), F.coalesce("copies", none).alias("copies"),
        F.coalesce("constants", none).alias("template"))).alias("wrapper"))


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", content: str = "html") -> DataFrame:
    """Per row of ``pages``: key, url, text and n_chars.

    Null and empty pages have an empty text; a null URL or one without a host has no wrapper. Each row is extracted by itself:
    repeated rows and null keys are no matter.
    """
    wrappers = materialize(learn_wrappers(pages, url, content), "wrappers")
    own = pages.select(F.col(key), F.col(url), host_of(F.col(url)).alias("host"), F.col(content).alias("html"))
    joined = own.join(wrappers, "host", "left").select(key, url, "html", "wrapper")

    def start():
        read: dict[str, dict] = {}
        place = placing()

        def handle(rows):
            for name, address, page, wrapper in rows:
                if wrapper is not None and wrapper not in read:
                    if len(read) > 10_000:
                        read.clear()
                    read[wrapper] = json.loads(wrapper)
                text = extract(page, read.get(wrapper), place)
                yield name, address, text, len(text)
        return handle

    return map_rows(joined, f"`{key}` {pages.schema[key].dataType.simpleString()}, `{url}` string, text string, n_chars bigint", start)
