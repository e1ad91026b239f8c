"""Edits of a page that readers recorded, replayed on the stored page.

An edit names an element twice: by its path of places among child elements, and by what it looks like. The page
may have changed since, so the path counts only if the element there looks alike; else the best likeness of the whole page is
taken if it is good and the only one, else the only element with the same long text.
"""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import types as T

from feedloom.functions.batches import by_row
from feedloom.functions.tree import Node, parsed

#: Characters of text in a look, of its beginning that count as near, and of a text that names an element alone.
TEXT, NEAR, ALONE = 160, 60, 40
#: What agreement in each respect is worth, and what an element needs where the path led to it and where it was searched.
WORTH = {"tag": 1, "id": 4, "classes": 3, "some_classes": 1, "text": 4, "near_text": 2, "source": 3, "children": 1}
AT_PATH, SEARCHED = 2, 6

LOOK = T.StructType([
    T.StructField("tag", T.StringType()), T.StructField("id", T.StringType()), T.StructField("classes", T.ArrayType(T.StringType())), T.StructField("text", T.StringType()),
    T.StructField("children", T.IntegerType()), T.StructField("source", T.StringType()),
])
ELEMENT = T.StructType([T.StructField("path", T.ArrayType(T.IntegerType())), *LOOK.fields])
REPLAYED = T.StructType([T.StructField("html", T.StringType()), T.StructField("applied", T.IntegerType()), T.StructField("unmatched", T.ArrayType(T.IntegerType())), T.StructField("problem", T.StringType())])


@dataclass(frozen=True)
class Look:
    tag: str
    id: str
    classes: tuple[str, ...]
    text: str
    children: int
    source: str


def file_name(address: str) -> str:
    """The last part of a picture's path, also where a proxy wraps its address."""
    parts = urlsplit(address.strip())
    if parts.path == "/api/img" and "u" in (query := parse_qs(parts.query)):
        parts = urlsplit(query["u"][0])
    return (parts.path or address.strip()).rsplit("/", 1)[-1]


def look(node: Node) -> Look:
    return Look(node.tag, (node.attrs.get("id") or "").strip(), tuple(sorted(node.classes())), node.text(TEXT)[:TEXT], len(node.elements()), file_name(node.attrs.get("src") or ""))


def likeness(seen: Look, wanted: Look) -> int:
    """Points for each respect in which two looks agree, 0 where they contradict each other: in tag, in id, or in text."""
    if seen.tag != wanted.tag or seen.id != wanted.id:
        return 0
    near = bool(seen.text and wanted.text) and (seen.text.startswith(wanted.text[:NEAR]) or wanted.text.startswith(seen.text[:NEAR]))
    if seen.text != wanted.text and not near:
        return 0
    shared = set(seen.classes) & set(wanted.classes)
    agreed = ["tag"]
    agreed += ["id"] if wanted.id else []
    agreed += ["classes" if seen.classes == wanted.classes else "some_classes"] if shared else []
    agreed += [] if not wanted.text else ["text" if seen.text == wanted.text else "near_text"]
    agreed += ["source"] if wanted.source and seen.source == wanted.source else []
    agreed += ["children"] if seen.children == wanted.children else []
    return sum(WORTH[a] for a in agreed)


def found(root: Node, path: list[int], wanted: Look) -> Node | None:
    node = root
    for place in path:
        below = node.elements()
        node = below[place] if 0 <= place < len(below) else None
        if node is None:
            break
    if node is not None and node is not root and likeness(look(node), wanted) >= AT_PATH:
        return node
    ranked = sorted(((likeness(look(n), wanted), -k, n) for k, n in enumerate(root.walk()) if n.tag == wanted.tag), key=lambda x: x[:2], reverse=True)
    if ranked and ranked[0][0] >= SEARCHED and (len(ranked) == 1 or ranked[1][0] < ranked[0][0]):
        return ranked[0][2]
    alike = [n for n in (r[2] for r in ranked) for t in [look(n).text] if min(len(t), len(wanted.text)) >= ALONE and (t.startswith(wanted.text) or wanted.text.startswith(t))]
    return alike[0] if len(alike) == 1 else None


def replayed(html: str | None, edits: list[dict] | None) -> tuple[str | None, int, list[int], str | None]:
    """Edits (op, path, tag, id, classes, text, children, source) in order, each on what the ones before left."""
    edits = list(edits) if edits is not None else []
    if not (html or "").strip():
        return html, 0, list(range(len(edits))), "empty page"
    root, applied, unmatched = parsed(html), 0, []
    for k, e in enumerate(edits):
        wanted = Look(e["tag"] or "", e["id"] or "", tuple(sorted(e["classes"] if e["classes"] is not None else ())), (e["text"] or "")[:TEXT], -1 if e["children"] is None else e["children"], e["source"] or "")
        node = found(root, list(e["path"]), wanted) if e["op"] in ("remove", "isolate") and e["path"] is not None and len(e["path"]) else None
        if node is None:
            unmatched.append(k)
            continue
        applied += 1
        if e["op"] == "remove":
            node.replaced([])
        else:
            root = Node("")
            root.add(node)
    out = root.html()
    return (html, 0, unmatched, "nothing would be left") if applied and not out.strip() else (out, applied, unmatched, None)


@by_row(T.ArrayType(ELEMENT))
def elements(html: str | None) -> list[dict]:
    """Every element of a page with its path and its look, in the order of the page."""
    root, out = parsed(html), []
    stack: list[tuple[Node, list[int]]] = [(n, [k]) for k, n in enumerate(root.elements())][::-1]
    while stack:
        node, path = stack.pop()
        out.append({"path": path, **look(node).__dict__})
        stack += [(n, [*path, k]) for k, n in enumerate(node.elements())][::-1]
    return out


@by_row(REPLAYED)
def replay(html: str | None, edits: list[dict] | None) -> dict:
    """(html, applied, unmatched, problem): the page after its edits, and the places of those that fit no element or several.

    Edits that would leave nothing are not applied. An empty page or null takes none.
    """
    return dict(zip(REPLAYED.names, replayed(html, edits), strict=True))
