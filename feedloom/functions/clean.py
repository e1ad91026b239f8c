"""An allow-list sanitiser over the element tree: HTML, drawings, formulas, players, addresses."""

from __future__ import annotations

import re
from urllib.parse import urljoin, urlsplit

from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.functions.batches import by_row
from feedloom.functions.tree import Node, parsed

#: Fixed values of our own: elements that stay, those that go with all they hold; others leave what they hold behind.
KEPT = frozenset("a abbr article aside audio b bdi blockquote br caption center cite code col colgroup dd del details dfn div dl dt em figcaption figure footer h1 h2 h3 h4 h5 h6 header hr i iframe img ins kbd li main mark nav ol p picture pre q s samp section small source span strong sub summary sup table tbody td tfoot th thead time tr u ul var video wbr".split())
DROPPED = frozenset("script style object embed form link meta base noscript template applet frame frameset title head button input select textarea option".split())
EVERYWHERE = frozenset({"class", "style"})
ATTRIBUTES = {
    "a": "href title", "img": "src srcset alt title loading width height sizes decoding align data-src data-srcset", "source": "src srcset type media width height sizes", "video": "src controls poster preload width height",
    "audio": "src controls preload", "iframe": "src width height allowfullscreen title", "td": "colspan rowspan align", "th": "colspan rowspan scope align", "tr": "align", "col": "span", "colgroup": "span", "time": "datetime", "p": "align", "div": "align", "table": "align", "figure": "align",
}
ADDRESSES = frozenset("href src poster data-src".split())
#: Sites whose players may stand in a page.
PLAYERS = "youtube.com youtube-nocookie.com youtu.be player.vimeo.com vimeo.com dailymotion.com twitch.tv soundcloud.com bandcamp.com spotify.com platform.twitter.com codepen.io redditmedia.com archive.org".split()
SANDBOX = "allow-scripts allow-same-origin allow-popups allow-presentation allow-forms"
#: Fixed values of our own: style declarations that stay, each with the values that it may have.
STYLES = {
    "text-align": "left right center justify start end", "font-style": "normal italic oblique", "font-weight": "normal bold bolder lighter 100 200 300 400 500 600 700 800 900", "text-decoration": "none underline line-through overline",
    "text-transform": "none uppercase lowercase capitalize", "font-variant": "normal small-caps", "float": "left right none", "clear": "left right both none",
}
#: Elements and attributes of drawings, as they are spelt.
SHAPES = "path rect circle ellipse line polyline polygon text".split()
DRAWN = {x.lower(): x for x in "svg g defs title desc symbol marker tspan linearGradient radialGradient stop clipPath mask".split() + SHAPES}
UNDRAWN = frozenset("script style foreignobject image use iframe audio video animate animatetransform animatemotion set handler filter feimage".split())
DRAWN_ATTRIBUTES = {x.lower(): x for x in """xmlns viewBox version preserveAspectRatio class width height x y x1 y1 x2 y2 cx cy r rx ry points d transform offset fill fill-rule fill-opacity clip-rule clip-path
    stroke stroke-width stroke-linecap stroke-linejoin stroke-dasharray stroke-dashoffset stroke-opacity stroke-miterlimit opacity color stop-color stop-opacity gradientUnits gradientTransform spreadMethod
    clipPathUnits maskUnits maskContentUnits markerWidth markerHeight id""".split()}  # fmt: skip
DRAWING_BYTES = 64_000
FORMULA = frozenset("math menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
FORMULA_ATTRIBUTES = frozenset("display mathvariant xmlns columnalign rowspan columnspan".split())
#: Tags that texts hold as text, because a feed escaped them once too often; and where they are meant so.
PSEUDO = re.compile(r"</?(?:a|abbr|b|cite|code|del|em|i|ins|mark|q|s|small|span|strong|sub|sup|u)(?:\s[^>]{0,100})?/?>", re.IGNORECASE)
LITERAL = frozenset("code pre samp kbd var".split())
OPAQUE = re.compile(r"(?i)^(?:data|mailto|javascript|tel|blob|about):|^#")


def safe(address: str, link: bool) -> bool:
    """Whether an address may stand: relative, http or https, and for links mailto and tel."""
    bare = re.sub(r"[\x00-\x20\x7f]", "", address)
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.\-]*):", bare)
    if not bare or scheme is None:
        return bool(bare) and ":" not in re.split(r"[/?#]", bare)[0]
    return scheme[1].lower() in ({"http", "https", "mailto", "tel"} if link else {"http", "https"})


def absolute(address: str, base: str) -> str:
    address = address.strip()
    if not base or not address or OPAQUE.match(address):
        return address
    try:
        return urljoin(base, address)
    except ValueError:
        return address


def absolute_set(candidates: str, base: str) -> str:
    """A srcset with absolute addresses; those that aren't safe go. A comma within an address isn't one between candidates."""
    out = []
    for address, how in re.findall(r"\s*([^\s,]\S*[^\s,]|[^\s,])((?:\s+[^\s,]+)*)\s*(?:,|$)", candidates):
        if safe(address, False):
            out.append(" ".join([absolute(address, base), *how.split()]))
    return ", ".join(out)


def style(declared: str) -> str:
    pairs = [tuple(x.strip().lower() for x in d.split(":", 1)) for d in declared.split(";") if ":" in d]
    return "; ".join(f"{name}: {value}" for name, value in pairs if value in STYLES.get(name, "").split())


def player(node: Node) -> bool:
    """Whether a frame shows a known player; it then gets a sandbox."""
    try:
        parts = urlsplit((node.attrs.get("src") or "").strip())
        host = (parts.hostname or "").lower()
    except ValueError:
        return False
    if parts.scheme.lower() not in ("https", "") or not any(host == p or host.endswith("." + p) for p in PLAYERS):
        return False
    node.attrs = {k: v for k, v in node.attrs.items() if k in ATTRIBUTES["iframe"].split()} | {"sandbox": SANDBOX, "referrerpolicy": "strict-origin-when-cross-origin", "loading": "lazy"}
    return True


def trim(node: Node, base: str) -> None:
    """Leaves the attributes that an element may have, addresses absolute."""
    own, known = {}, EVERYWHERE.union(ATTRIBUTES.get(node.tag, "").split())
    for name, value in node.attrs.items():
        if name not in known:
            continue
        if name == "style":
            value = style(value or "")
        elif name in ("srcset", "data-srcset"):
            value = absolute_set(value or "", base)
        elif name in ADDRESSES:
            value = absolute(value or "", base) if safe(value or "", name == "href") else ""
        if value or name not in ("style", "srcset", "data-srcset", *ADDRESSES):
            own[name] = value
    node.attrs = own


def drawing(root: Node) -> str | None:
    """A drawing by its allow list, with a size of its own; null without a shape, and beyond DRAWING_BYTES."""
    for node in [*root.walk()]:
        if node.parent is None or any(a.parent is None and a is not root for a in [node, *node.above()] if a.tag):
            continue
        if node.tag in UNDRAWN:
            node.replaced([])
        elif node.tag not in DRAWN:
            node.replaced(node.kids)
    shapes = False
    for node in [root, *root.walk()]:
        shapes |= node.tag in SHAPES
        node.tag, node.kids = DRAWN[node.tag], [k for k in node.kids if isinstance(k, str) or k.tag != "!"]
        node.attrs = {DRAWN_ATTRIBUTES[n]: v or "" for n, v in node.attrs.items() if n in DRAWN_ATTRIBUTES and not re.search(r"(?i)url\(\s*[\"']?\s*(?!#|[\s\"'])", v or "")}
    own = root.attrs
    own.setdefault("xmlns", "http://www.w3.org/2000/svg")
    box = re.fullmatch(r"\s*[-+.\deE]+[\s,]+[-+.\deE]+[\s,]+(\d+(?:\.\d+)?)[\s,]+(\d+(?:\.\d+)?)\s*", own.get("viewBox", ""))
    if box and float(box[1]) > 0 < float(box[2]):
        own.setdefault("width", f"{float(box[1]):g}")
        own.setdefault("height", f"{float(box[2]):g}")
    out = root.html(own=True)
    if "currentcolor" in out.lower() and "color=" not in out.lower():
        own["color"] = "#888"
        out = root.html(own=True)
    return out if shapes and len(out.encode()) <= DRAWING_BYTES else None


def once(html: str, base: str) -> str:
    root = parsed(html)
    stack: list[Node] = [root]
    while stack:
        home = stack.pop()
        kids, home.kids = home.kids, []
        for kid in kids:
            settle(home, kid, base, stack)
    return root.html()


def settle(home: Node, kid: Node | str, base: str, stack: list[Node]) -> None:
    """Puts a child, or what is left of it, into its place; what it holds is looked at later."""
    todo: list[Node | str] = [kid]
    while todo:
        one = todo.pop()
        if isinstance(one, str):
            if PSEUDO.search(one) and not any(n.tag in LITERAL for n in [home, *home.above()]):
                fragment = parsed(one)
                if any(isinstance(k, Node) for k in fragment.kids):
                    todo += fragment.kids[::-1]
                    continue
            home.add(one)
        elif one.tag == "!" or one.tag in DROPPED:
            continue
        elif one.tag == "svg":
            clean = drawing(one)
            if clean:
                home.add(Node("!", raw=clean))
        elif one.space == "math":
            if one.tag in FORMULA:
                one.attrs = {n: v for n, v in one.attrs.items() if n in FORMULA_ATTRIBUTES}
                home.add(one)
                stack.append(one)
            else:
                todo += one.kids[::-1]
        elif one.tag == "iframe":
            if player(one):
                one.kids = []
                home.add(one)
        elif one.tag in KEPT:
            trim(one, base)
            home.add(one)
            stack.append(one)
        else:
            todo += one.kids[::-1]


def cleaned(html: str, base: str = "") -> str:
    """Sanitised until nothing changes any more, so that cleaning twice is cleaning once; each further round makes texts of fewer escaped tags."""
    while True:
        out = once(html, base)
        if out == html:
            return out
        html = out


@by_row(T.StringType())
def sanitised(html: str | None, base: str | None) -> str | None:
    """Only what the allow lists name, with absolute addresses; null stays null."""
    return None if html is None else cleaned(html, base or "")


@by_row(T.StringType())
def clean_svg(html: str | None) -> str | None:
    """The first drawing of a page by its allow list, or null where there is none with a shape."""
    found = next((n for n in parsed(html).walk() if n.tag == "svg"), None) if html and "<svg" in html.lower() else None
    return None if found is None else drawing(found)


def base_of(link, feed):
    """Whose addresses a text's are relative to: the entry's link, unless another site's."""
    host = lambda c: F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    own = F.nullif(F.trim(F.coalesce(link, F.lit(""))), F.lit(""))
    return F.when(own.isNull(), feed).when(feed.isNull() | (feed == "") | (host(own) == host(feed)), own).otherwise(feed)
