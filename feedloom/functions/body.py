"""What a page is about, without its chrome: text blocks and the share of links in them, summed up towards their ancestors."""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import types as T

from feedloom.functions.batches import by_row
from feedloom.functions.tree import BLOCKS, Node, parsed, select
from feedloom.functions.url import article_host

#: Fixed values of our own: names of blocks that hold no text of the page, or that hold it; elements that never do.
CHROME = re.compile(r"(?i)(?:^|[-_ ])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookie\w*|footer|header|masthead|menu|meta|nav\w*|newsletter|pager|pagination|popup|promo\w*|recommend\w*|related|share|sharing|sidebar|social|sponsor\w*|subscribe|tags?|toolbar|widget)(?:$|[-_ ])")
BODY = re.compile(r"(?i)(?:^|[-_ ])(?:article|body|content|entry|hentry|main|post|story|text)(?:$|[-_ ])")
NEVER = frozenset("script style nav footer aside form noscript template iframe object svg math button select textarea head".split())
TEXTS = frozenset("p pre blockquote td li dd h1 h2 h3 h4 h5 h6 figcaption".split())
#: A block's text counts with its parent, half with the one above, then a third, and so on.
HEIGHT = 4
READ = T.StructType([T.StructField("html", T.StringType()), T.StructField("text", T.StringType()), T.StructField("words", T.IntegerType())])


def named(node: Node) -> str:
    return f"{node.attrs.get('class') or ''} {node.attrs.get('id') or ''}"


def without_chrome(root: Node) -> Node:
    """Takes blocks out that never hold a page's text, at any depth, also within blocks of their own kind."""
    for node in [*root.walk()]:
        if any(a.parent is None for a in [node, *node.above()]):
            continue
        chrome = node.tag in NEVER or node.attrs.get("role") in ("navigation", "complementary", "banner", "contentinfo") or (node.tag not in ("html", "body", "article", "main") and CHROME.search(named(node)) and not BODY.search(named(node)))
        if chrome or "hidden" in node.attrs or re.search(r"(?i)display\s*:\s*none", node.attrs.get("style") or ""):
            node.replaced([])
    return root


def link_share(node: Node, size: int) -> float:
    return sum(len(n.text()) for n in node.walk() if n.tag == "a") / max(1, size)


def own_text(node: Node) -> str:
    """The text of a block without that of blocks within it."""
    out, stack = [], node.kids[::-1]
    while stack:
        kid = stack.pop()
        if isinstance(kid, str):
            out.append(kid)
        elif kid.tag not in BLOCKS and kid.tag not in TEXTS and kid.tag != "!":
            stack += kid.kids[::-1]
    return " ".join(" ".join(out).split())


def main_block(root: Node) -> Node:
    """The element whose blocks hold most text for their links."""
    score: dict[int, float] = defaultdict(float)
    nodes: dict[int, Node] = {}
    for node in [root, *root.walk()]:
        text = own_text(node)
        if len(text) < 25:
            continue
        worth = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - min(1.0, link_share(node, len(text))))
        above = [node, *node.above()] if node.tag not in TEXTS else [*node.above()]
        for k, a in enumerate((above or [root])[:HEIGHT]):
            score[id(a)] += worth / (k + 1)
            nodes[id(a)] = a
    if not nodes:
        return root
    for i, n in nodes.items():
        score[i] *= 1.25 if n.tag in ("article", "main") or BODY.search(named(n)) else 1.0
        score[i] *= 1 - min(1.0, link_share(n, len(n.text())))
    best = max(nodes, key=lambda i: score[i])
    top = nodes[best]
    # an element above that holds nearly as much of it holds its neighbours too
    for a in top.above():
        if score.get(id(a), 0) >= 0.75 * score[best] and a.tag not in ("html", "body"):
            top = a
    return top


def kept_parts(top: Node) -> list[Node]:
    """The main block, with those beside it that are text too."""
    if top.parent is None:
        return [top]
    out = []
    for n in top.parent.elements():
        size = len(n.text())
        if n is top or (n.tag in TEXTS and size >= 80 and link_share(n, size) < 0.25 and not top.tag == "article"):
            out.append(n)
    return out


def read(html: str | None) -> tuple[str | None, str | None, int]:
    if not (html or "").strip():
        return None, None, 0
    parts = kept_parts(main_block(without_chrome(parsed(html))))
    for part in parts:
        for node in [*part.walk()]:
            size = len(node.text())
            if node.tag in ("ul", "ol", "div", "section", "p", "table") and size and link_share(node, size) > 0.6 and any(a is part for a in node.above()):
                node.replaced([])
    text = "\n\n".join(t for part in parts for t in blocks_of(part) if t)
    return "".join(p.html(own=bool(p.tag)) for p in parts), text or None, len(text.split())


def blocks_of(part: Node) -> list[str]:
    """The texts of a part's blocks, in order."""
    out, line = [], []
    stack: list[Node | str | None] = [part]
    while stack:
        kid = stack.pop()
        if kid is None or (isinstance(kid, Node) and kid.tag == "br"):
            out.append(" ".join("".join(line).split()))
            line = []
        elif isinstance(kid, str):
            line.append(kid)
        elif kid.tag != "!":
            edge = [None] if kid.tag in BLOCKS or kid.tag in TEXTS else []
            stack += [*edge, *kid.kids[::-1], *edge]
    return [*out, " ".join("".join(line).split())]


@by_row(READ)
def readable(html: str | None) -> dict:
    """(html, text, words) of a page's body; nulls for an empty page."""
    return dict(zip(READ.names, read(html), strict=True))


@by_row(T.StringType())
def bare(html: str | None) -> str | None:
    """A page without its chrome, at any depth; null stays null."""
    return None if html is None else without_chrome(parsed(html)).html()


@dataclass(frozen=True)
class Plugin:
    """What a site's pages lose and what of them stays, by selectors: all that ``strip`` finds goes, then the first that ``content`` finds is the page."""

    host: str
    strip: tuple[str, ...] = ()
    content: str | None = None


def after_plugins(html: Column, link: Column, plugins: list[Plugin]) -> Column:
    """A page after the plugin of its site, the first that fits; pages of other sites, and those whose content isn't found, keep what isn't stripped."""

    @by_row(T.StringType())
    def run(h: str | None, host: str | None) -> str | None:
        own = next((p for p in plugins if host and (host == p.host or host.endswith("." + p.host))), None)
        if h is None or own is None:
            return h
        root = parsed(h)
        for s in own.strip:
            for n in select(root, s):
                if n.parent is not None:
                    n.replaced([])
        kept = next(iter(select(root, own.content)), None) if own.content else None
        return root.html() if kept is None else kept.html(own=True)

    return run(html, article_host(link))
