"""HTML functions on the standard library's parser, vectorised over Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.functions.batches import by_row
from feedloom.functions.clean import sanitised  # noqa: F401  the tree's functions under their known names
from feedloom.functions.images import gallery, lead_image  # noqa: F401

DROPPED = frozenset("script style iframe object embed form noscript template svg math".split())
VOID = frozenset("br hr img".split())


class Collector(HTMLParser):
    """Links and visible text of a page."""

    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.links, self.text, self.skip, self.open = base, [], [], 0, None

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        if tag in DROPPED:
            self.skip += 1
        elif tag == "a" and own.get("href"):
            self.open = [urljoin(self.base, own["href"]), ""]

    def handle_endtag(self, tag):
        if tag in DROPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == "a" and self.open:
            self.links.append((self.open[0], " ".join(self.open[1].split())))
            self.open = None

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)
            if self.open:
                self.open[1] += data


def collected(h: str | None, b: str | None) -> Collector:
    c = Collector(b or "")
    c.feed(h or "")
    c.close()
    return c


@by_row(T.ArrayType(T.StructType([T.StructField("url", T.StringType()), T.StructField("text", T.StringType())])))
def links(html: str | None, base: str | None) -> list[dict]:
    """Distinct links in order with their text."""
    seen: dict[str, str] = {}
    for u, t in collected(html, base).links:
        seen.setdefault(u, t)
    return [{"url": u, "text": t} for u, t in seen.items()]


@by_row(T.StringType())
def visible_text(html: str | None) -> str:
    return " ".join(" ".join(collected(html, "").text).split())


def ended_references(html: Column) -> Column:
    """A page of which only references that a semicolon ends are read as characters: a cut ``&amp`` stays as it stands."""
    return F.regexp_replace(html, "&(?!(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);)", "&amp;")


class Outline(HTMLParser):
    """Anchors with the selector of the block they stand in, and the feeds a page announces."""

    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.stack, self.anchors, self.feeds = base, [], [], []

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        if tag == "link" and "alternate" in (own.get("rel") or "").lower().split() and re.search(r"(?:rss|atom|feed\+json)", own.get("type") or "", re.I) and own.get("href"):
            self.feeds.append((urljoin(self.base, own["href"]), own.get("title") or ""))
        if tag == "a" and own.get("href") and not own["href"].startswith("#"):
            near = next((x for x in reversed(self.stack) if "." in x), self.stack[-1] if self.stack else "body")
            self.anchors.append((f"{near} a", urljoin(self.base, own["href"])))
        if tag not in ("meta", "link", "input", *VOID):
            names = (own.get("class") or "").split()
            self.stack.append(f"{tag}.{names[0]}" if names else tag)

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].split(".")[0] == tag:
                del self.stack[k:]
                break


def outlined(h: str | None, b: str | None) -> Outline:
    o = Outline(b or "")
    o.feed(h or "")
    o.close()
    return o


@by_row(T.ArrayType(T.StructType([T.StructField("url", T.StringType()), T.StructField("title", T.StringType())])))
def announced_feeds(html: str | None, base: str | None) -> list[dict]:
    """Feeds that a page's head announces, in order."""
    return [{"url": u, "title": t} for u, t in outlined(html, base).feeds]
