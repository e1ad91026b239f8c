"""Element trees of pages on the standard library's parser, and a matcher for simple CSS selectors.

The tree follows the rules that matter for its users: void elements have no content, a paragraph ends where a block
begins, items and cells end where the next one does, and drawings and formulas are name spaces of their own in which a tag
may close itself. Everything walks without recursion, so that pages may nest as deeply as they like.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import escape
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset({"script", "style"})
FOREIGN = frozenset({"svg", "math"})
#: What can't stand in a drawing or formula and so ends it, unless it is within one of the elements that take pages in.
OUTSIDE = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
TAKE_PAGES = frozenset("foreignobject desc title annotation-xml".split())
BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table ul".split())
#: What an opening tag ends, and what stands in the way of it.
ENDS = {**{b: {"p"} for b in BLOCKS}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
WALLS = {"p": {"table", "td", "th"}, "li": {"ul", "ol", "table"}, "dt": {"dl", "table"}, "dd": {"dl", "table"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}


class Node:
    """An element; of comments and declarations ``tag`` is "!" and ``raw`` what they say."""

    __slots__ = ("attrs", "kids", "parent", "raw", "space", "tag")

    def __init__(self, tag: str, attrs: dict[str, str | None] | None = None, space: str = "", raw: str = ""):
        self.tag, self.attrs, self.space, self.raw = tag, attrs or {}, space, raw
        self.kids: list[Node | str] = []
        self.parent: Node | None = None

    def add(self, kid: Node | str) -> None:
        if isinstance(kid, Node):
            kid.parent = self
        elif self.kids and isinstance(self.kids[-1], str):
            self.kids[-1] += kid
            return
        self.kids.append(kid)

    def elements(self) -> list[Node]:
        return [k for k in self.kids if isinstance(k, Node) and k.tag != "!"]

    def walk(self) -> Iterator[Node]:
        """All elements below, in the order of the page."""
        stack = self.elements()[::-1]
        while stack:
            node = stack.pop()
            yield node
            stack += node.elements()[::-1]

    def texts(self) -> Iterator[str]:
        """Pieces of visible text, in order."""
        stack: list[Node | str] = self.kids[::-1]
        while stack:
            kid = stack.pop()
            if isinstance(kid, str):
                yield kid
            elif kid.tag not in RAW and kid.tag != "!":
                stack += kid.kids[::-1]

    def text(self, most: int | None = None) -> str:
        """Visible text, white space collapsed; at least its first ``most`` characters."""
        out, size = [], 0
        for piece in self.texts():
            words = piece.split()
            out += words
            size += sum(map(len, words)) + len(words)
            if most is not None and size > most + 1:
                break
        return " ".join(out)

    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def above(self) -> Iterator[Node]:
        node = self.parent
        while node is not None and node.tag:
            yield node
            node = node.parent

    def html(self, own: bool = False) -> str:
        """What the element holds, or with ``own`` the element itself."""
        out: list[str] = []
        stack: list[Node | str | tuple[str]] = [self] if own else self.kids[::-1]
        while stack:
            kid = stack.pop()
            if isinstance(kid, tuple):
                out.append(kid[0])
            elif isinstance(kid, str):
                out.append(escape(kid, quote=False))
            elif kid.tag == "!":
                out.append(kid.raw)
            else:
                out.append("<" + kid.tag + "".join(f" {n}" if v is None else f' {n}="{escape(v)}"' for n, v in kid.attrs.items()) + ">")
                if kid.tag in RAW:
                    out.append("".join(k for k in kid.kids if isinstance(k, str)))
                    out.append(f"</{kid.tag}>")
                elif kid.space or kid.tag not in VOID:
                    stack.append((f"</{kid.tag}>",))
                    stack += kid.kids[::-1]
        return "".join(out)

    def replaced(self, by: list[Node | str]) -> None:
        """Puts ``by`` in the element's place."""
        home = self.parent
        at = next(i for i, k in enumerate(home.kids) if k is self)
        kids, home.kids = home.kids, home.kids[:at]
        for k in [*by, *kids[at + 1 :]]:
            home.add(k)
        self.parent = None


class Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("")

    def open(self, tag: str, attrs: list[tuple[str, str | None]]) -> Node:
        if self.here.space and tag in OUTSIDE:
            inside = [n for n in [self.here, *self.here.above()] if n.space]
            if not any(n.tag in TAKE_PAGES for n in inside):
                self.here = inside[-1].parent
        if not self.here.space:
            ends, node = ENDS.get(tag, ()), self.here
            walls = WALLS.get(tag, WALLS["p"])
            last = None
            while node is not None and node.tag not in walls:
                if node.tag in ends:
                    last = node
                node = node.parent
            if last is not None:
                self.here = last.parent
        own: dict[str, str | None] = {}
        for name, value in attrs:
            own.setdefault(name, value)
        node = Node(tag, own, tag if tag in FOREIGN else self.here.space)
        self.here.add(node)
        return node

    def handle_starttag(self, tag, attrs):
        node = self.open(tag, attrs)
        if node.space or tag not in VOID:
            self.here = node

    def handle_startendtag(self, tag, attrs):
        node = self.open(tag, attrs)
        if not node.space and tag not in VOID:
            self.here = node

    def handle_endtag(self, tag):
        node = self.here
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.here = node.parent

    def handle_data(self, data):
        self.here.add(data)

    def handle_comment(self, data):
        self.here.add(Node("!", raw=f"<!--{data}-->"))

    def handle_decl(self, decl):
        self.here.add(Node("!", raw=f"<!{decl}>"))

    def handle_pi(self, data):
        self.here.add(Node("!", raw=f"<?{data}>"))


def parsed(html: str | None) -> Node:
    builder = Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


STEP = re.compile(r"\s*([>+~])?\s*((?:[\w-]+|\*)?)((?:[#.][\w-]+|\[\s*[\w-]+\s*(?:[~^$*|]?=\s*(?:\"[^\"]*\"|'[^']*'|[^\]\s]+)\s*)?\]|:[\w-]+(?:\([^)]*\))?)*)")
TRAIT = re.compile(r"([#.])([\w-]+)|\[\s*([\w-]+)\s*(?:([~^$*|]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\]\s]+))\s*)?\]|:([\w-]+)(?:\(([^)]*)\))?")
TESTS = {
    "=": lambda a, b: a == b, "~=": lambda a, b: b in a.split(), "^=": lambda a, b: bool(b) and a.startswith(b), "$=": lambda a, b: bool(b) and a.endswith(b),
    "*=": lambda a, b: bool(b) and b in a, "|=": lambda a, b: a == b or a.startswith(b + "-"),
}


def nth(rule: str) -> tuple[int, int]:
    """(a, b) of an+b."""
    rule = rule.replace(" ", "").lower()
    named = {"odd": (2, 1), "even": (2, 0)}
    if rule in named:
        return named[rule]
    m = re.fullmatch(r"(?:([+-]?\d*)n)?([+-]?\d+)?", rule)
    if not rule or m is None:
        raise ValueError(f"not a place: {rule}")
    a = 0 if m[1] is None else int(m[1] + "1" if m[1] in ("", "+", "-") else m[1])
    return a, int(m[2] or 0)


@lru_cache(1024)
def compiled(selector: str) -> tuple:
    """Alternatives, each a list of (combinator, tag, traits) from right to left. Raises ValueError for what it doesn't know."""
    out = []
    for one in selector.split(","):
        steps, at, one = [], 0, one.strip()
        while at < len(one):
            m = STEP.match(one, at)
            if m is None or not (m[2] or m[3]):
                raise ValueError(f"not a selector: {selector}")
            traits = []
            for t in TRAIT.finditer(m[3]):
                if t[1]:
                    traits.append((t[1], t[2], None))
                elif t[3]:
                    traits.append(("[", t[3].lower(), (t[4], next((x for x in (t[5], t[6], t[7]) if x is not None), "")) if t[4] else None))
                elif t[8] in ("first-child", "last-child", "nth-child", "nth-of-type"):
                    traits.append((":", t[8], nth(t[9] or "") if t[8].startswith("nth") else None))
                else:
                    raise ValueError(f"unknown: :{t[8]}")
            steps.append(((m[1] or " ") if steps else "", m[2].lower(), tuple(traits)))
            at = m.end()
        if not steps:
            raise ValueError(f"not a selector: {selector}")
        out.append(tuple(reversed(steps)))
    return tuple(out)


def fits(node: Node, tag: str, traits: tuple) -> bool:
    if tag not in ("", "*", node.tag):
        return False
    for kind, name, value in traits:
        if kind == "#":
            ok = node.attrs.get("id") == name
        elif kind == ".":
            ok = name in node.classes()
        elif kind == "[":
            ok = name in node.attrs and (value is None or TESTS[value[0]](node.attrs[name] or "", value[1]))
        else:
            peers = node.parent.elements()
            if name == "nth-of-type":
                peers = [p for p in peers if p.tag == node.tag]
            place = next(i for i, p in enumerate(peers, 1) if p is node)
            a, b = value or (0, 1)
            ok = place == len(peers) if name == "last-child" else (place == b if a == 0 else (place - b) % a == 0 and (place - b) // a >= 0)
        if not ok:
            return False
    return True


def matches(node: Node, steps: tuple) -> bool:
    """Whether the node ends a chain of steps; of several ways up, all are tried."""
    _, tag, traits = steps[0]
    if not fits(node, tag, traits):
        return False
    ways = [(node, 0)]
    while ways:
        here, k = ways.pop()
        if k + 1 == len(steps):
            return True
        how, (_, tag, traits) = steps[k][0], steps[k + 1]
        if how == ">":
            near = [here.parent] if here.parent is not None and here.parent.tag else []
        elif how == " ":
            near = list(here.above())
        else:
            peers = here.parent.elements()
            before = peers[: next(i for i, p in enumerate(peers) if p is here)]
            near = before[-1:] if how == "+" else before
        ways += [(n, k + 1) for n in near if fits(n, tag, traits)]
    return False


def select(root: Node, selector: str) -> list[Node]:
    """The elements that a selector finds, in the order of the page."""
    ways = compiled(selector)
    return [n for n in root.walk() if any(matches(n, w) for w in ways)]
