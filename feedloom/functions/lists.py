"""Lists of links in pages: selectors that find them, and what a selector finds."""

from __future__ import annotations

import re
from urllib.parse import urljoin

from pyspark.sql import types as T

from feedloom.functions.batches import by_row
from feedloom.functions.tree import Node, parsed, select

ITEM = T.StructType([T.StructField("url", T.StringType()), T.StructField("title", T.StringType())])
GROUP = T.StructType([T.StructField("selector", T.StringType()), T.StructField("own", T.IntegerType()), T.StructField("items", T.ArrayType(ITEM))])
#: How far above a link its list is looked for.
HOPS = 4


def word(value: str | None) -> str:
    value = (value or "").strip()
    return value if re.fullmatch(r"[A-Za-z_-][A-Za-z0-9_-]*", value) else ""


def first_class(node: Node) -> str:
    return next((c for c in node.classes() if word(c)), "")


def selector_of(link: Node) -> str | None:
    """What finds a link and those like it: its class, or its nearest ancestor with an id or a class, or the two tags above it."""
    if first_class(link):
        return f"a.{first_class(link)}"
    above = [n for n in link.above()]
    for n in above[:HOPS]:
        if n.tag in ("html", "body"):
            break
        if word(n.attrs.get("id")):
            return f"#{word(n.attrs['id'])} a"
        if first_class(n):
            return f"{n.tag}.{first_class(n)} a"
    return f"{above[1].tag} > {above[0].tag} a" if len(above) > 1 and above[1].tag not in ("html", "body") else None


def item(link: Node, base: str) -> tuple[str, str] | None:
    href = (link.attrs.get("href") or "").strip()
    if not href or href.startswith("#") or href.lower().startswith("javascript:"):
        return None
    try:
        address = urljoin(base, href)
    except ValueError:
        return None
    return address, link.text() or address


def found(root: Node, base: str, selector: str | None) -> list[dict]:
    """Items of the links that a selector finds, or that lie in what it finds, each address once."""
    chosen: dict[int, Node] = {}
    for n in select(root, selector) if selector else [root]:
        for a in [n] if n.tag == "a" and n.attrs.get("href") else [x for x in n.walk() if x.tag == "a"]:
            chosen.setdefault(id(a), a)
    seen: dict[str, str] = {}
    for a in chosen.values():
        got = item(a, base)
        if got:
            seen.setdefault(*got)
    return [{"url": u, "title": t} for u, t in seen.items()]


@by_row(T.ArrayType(ITEM))
def list_items(html: str | None, base: str | None, selector: str | None) -> list[dict] | None:
    """Links with their titles by a selector (null: all links), in the order of the page; null for a selector that isn't one."""
    try:
        return found(parsed(html), base or "", selector)
    except ValueError:
        return None


@by_row(T.ArrayType(GROUP))
def link_groups(html: str | None, base: str | None) -> list[dict]:
    """Selectors of a page's links in the order of their first ones, with how many links gave it and all items that it finds."""
    root, own = parsed(html), {}
    for a in root.walk():
        if a.tag == "a" and item(a, base or "") and (s := selector_of(a)):
            own[s] = own.get(s, 0) + 1
    return [{"selector": s, "own": n, "items": found(root, base or "", s)} for s, n in own.items()]
