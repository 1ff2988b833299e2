"""A small DOM for extraction: tolerant parsing, boilerplate marks, text in blocks."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>"""
    r"""|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([A-Za-z_:][\w:.-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
#: Start tags that end an open element of these names, up to the nearest of the stops.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead "
                   "tr ul br".split())
CLOSES_P = BLOCKS - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "html", "body"}
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
            "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
            "option": ({"option"}, {"select"})}
#: Elements that are never part of an article's text.
EXCLUDED = frozenset("head script style textarea title noscript iframe template xmp nav header footer aside form button select "
                     "option svg canvas object dialog menu audio video map".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
#: Words of class and id names that mark what is not the article.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertisements adsense sponsor sponsored sponsors promo promos promotion banner sidebar "
    "sidebars rail menu menus nav navbar navigation navigations breadcrumb breadcrumbs header masthead topbar footer foot bottombar "
    "cookie cookies consent gdpr notice notices alert alerts warning popup overlay modal newsletter subscribe subscription signup "
    "signin login paywall comment comments commentlist reply replies respond disqus discussion share sharing social related "
    "recommended recommendations widget widgets toolbar pagination pager skip copyright legal disclaimer hidden".split())
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("tag", "label", "marked", "children")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.label, self.marked = tag, tag, tag in EXCLUDED
        self.children: list[Node | str] = []
        if attributes.strip(" \t\r\n/"):
            found = {n.lower(): html.unescape(a or b or c) for n, a, b, c in ATTRIBUTE.findall(attributes)}
            names = f"{found.get('class', '')} {found.get('id', '')}"
            words = [w.lower() for w in NAME_WORD.findall(names)]
            style = found.get("style", "").replace(" ", "").lower()
            self.marked |= (found.get("role", "").lower() in ROLES or not BOILERPLATE.isdisjoint(words) and tag not in ("html", "body")
                            or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style)
            if words:
                self.label = f"{tag}.{'.'.join(words)}"


class Stack:
    """The open elements, with the places of each tag among them, so that no end tag searches a deep page."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def nearest(self, tags) -> int:
        """The depth of the innermost open element of these tags; 0 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close(self, tags, stops=()) -> None:
        """Closes the innermost open element of these tags unless a stop lies within it."""
        depth = self.nearest(tags)
        if depth and depth >= self.nearest(stops):
            while len(self.nodes) > depth:
                self.places[self.nodes.pop().tag].pop()


def parse(page: str | None) -> Node:
    """The tree of a page; text nodes are strings with character references decoded. Open elements end with the page."""
    root = Node("#page")
    stack, at, page = Stack(root), 0, page or ""
    while at < len(page):
        token = TOKEN.search(page, at)
        text = page[at:token.start()] if token else page[at:]
        if text:
            stack.nodes[-1].children.append(html.unescape(text) if "&" in text else text)
        if not token:
            break
        at = token.end()
        slash, name, attributes = token.group(1, 2, 3) if token[2] else token.group(4, 5, 6)
        if not name:
            continue
        tag = name.lower()
        if slash:
            if tag == "p" and not stack.nearest({"p"}):
                stack.nodes[-1].children.append(Node("p"))
            stack.close({tag}, () if tag in BLOCKS else ("td", "th", "table", "body"))
            continue
        if tag in CLOSES_P:
            stack.close({"p"}, {"table", "td", "th", "button", "object"})
        if tag in SIBLINGS:
            stack.close(*SIBLINGS[tag])
        node = Node(tag, attributes)
        stack.nodes[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>|\Z", re.I).search(page, at)
            at = end.end()
        elif tag not in VOID and not attributes.endswith("/"):
            stack.push(node)
    return root


def text_parts(node: Node, skip) -> Iterator[str]:
    """Text below a node in page order, with a space where a block begins or ends; ``skip(node)`` leaves an element out."""
    todo: list[Node | str] = [node]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            yield item
        elif item is node or not skip(item):
            if item.tag in BLOCKS:
                yield " "
                todo.append(" ")
            todo.extend(reversed(item.children))
        elif item.tag in BLOCKS:
            yield " "


def clean(parts: Iterator[str]) -> str:
    return " ".join("".join(parts).split())
