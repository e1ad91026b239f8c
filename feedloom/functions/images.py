"""Lead images and galleries of pages: candidates with the blocks they stand in, rules for tags and addresses, points, comic panels."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import parse_qsl, urljoin, urlsplit

from pyspark.sql import types as T

from feedloom.functions.batches import by_row
from feedloom.functions.tree import Node, parsed

#: The least size of a lead image, and of one that is called a placeholder; how much longer than wide it may be.
WIDTH, HEIGHT, HERO_WIDTH, HERO_HEIGHT, RATIO = 200, 100, 400, 200, 4.0
#: Where pages keep a picture's address until it is seen, before its own.
LAZY = "data-src data-lazy-src data-original data-image".split()
#: Names of comic panels, and of the blocks they stand in.
PANEL_IDS = "strip cc-comic comic comicimg comic-image comic_image woo-entry-image".split()
PANEL_CLASSES = re.compile(r"(?i)(?<![-\w])(?:comic[-_](?:image|img|panel|strip)|webcomic-image|wp-post-image)(?![-\w])")
PANEL_BLOCKS = re.compile(r"(?i)(?<![-\w])(?:comic|comic[-_](?:area|body|wrap|wrapper|page|panel)|comicpane|unspliced[-_]comic)(?![-\w])")
#: Fixed values of our own: words in class, id, alternative text or address that tell what a picture or block is.
FACES = re.compile(r"(?i)(?:^|[-_/ .])(?:avatars?|gravatar|headshots?|mugshot|profile[-_ ](?:pic|photo|image)\w*|author[-_ ](?:pic|photo|image|avatar)\w*|user[-_ ]?(?:pic|photo))(?:$|[-_/ .0-9])|gravatar\.com")
DECORATION = re.compile(r"(?i)(?:^|[-_ ])(?:emoji|smil(?:ey|ie)|wp-smiley|ipsemoji|valign-\w+)(?:$|[-_ ])")
EMOJI = re.compile(r"(?i)twemoji|/emoji/|/emojis/|/smil(?:ies|eys)/|s\.w\.org/images/core/emoji")
TRACKERS = re.compile(r"(?i)(?:^|[./_-])(?:pixel|beacon|tracker|tracking|counter|stats?|1x1|impression)(?:[./_?-]|$)|doubleclick|feedburner\.com/~|scorecardresearch|google-analytics|/b\.gif|quantserve")
ADVERTS = re.compile(r"(?i)(?:^|[-_/])(?:ads?|adverts?|advertisements?|sponsors?|banners?-ads?)(?:[-_/]|$)|[-_]ad[0-9]+[._-]")
ADVERT_WORDS = re.compile(r"(?i)\b(?:advertisements?|sponsored|advert)\b")
LOGOS = re.compile(r"(?i)(?:^|[-_/ .])(?:logos?|icons?|favicon|sprites?|badges?|buttons?|wordmark|brand(?:ing)?)(?:$|[-_/ .0-9@])")
PLACEHOLDERS = re.compile(r"(?i)(?:^|[-_/])(?:placeholders?|blank|spacer|transparent|spinner|loading|lazy|fallback|default[-_](?:image|thumb\w*)|no[-_]?image|missing)(?:[-_./@]|$)")
FURNITURE = re.compile(r"(?i)/(?:themes?|templates?|skins?|assets/(?:ui|icons?)|icons?|buttons?|badges?|share|social|sprites?)/|shields\.io|/wp-includes/")
TEMPLATE = re.compile(r"\$\{|\{\{")
SOCIAL = "facebook.com twitter.com x.com instagram.com linkedin.com pinterest.com reddit.com youtube.com t.me mastodon.social bsky.app whatsapp.com tumblr.com".split()
AROUND = re.compile(r"(?i)(?:^|[-_ ])(?:related|recent|recommended|more-posts|read-next|you-may-also-like|posts-grid|wp-block-query|popular|sidebar|widget\w*|menu|nav\w*|masthead|site-(?:header|branding|logo|footer)|footer|comments?|share|sharing|social|newsletter|author(?:-\w+)?|byline|bio|speakers?|contributors?|ad|ads|advert\w*|sponsor\w*)(?:$|[-_ ])")
NAMED = "/banner -banner _banner /hero -hero _hero /cover -cover _cover /featured -featured _featured /thumbnail -thumbnail".split()
SUFFIX = re.compile(r"\.(?:jpe?g|png|gif|webp|avif|bmp|jfif)$")


def whole(value: str | None) -> int | None:
    m = re.match(r"\s*(\d+)(?:\.\d+)?\s*(?:px)?\s*$", value or "")
    return int(m[1]) if m and int(m[1]) > 0 else None


def ranked(candidates: str | None) -> list[str]:
    """Addresses of a srcset, the largest first, of equals the first."""
    found = []
    for address, size, unit in re.findall(r"\s*([^\s,]\S*[^\s,]|[^\s,])(?:\s+([\d.]+)([wx]))?[^,]*(?:,|$)", candidates or ""):
        try:
            found.append((-float(size or 1) * (1000 if unit != "w" else 1), len(found), address))
        except ValueError:
            continue
    return [a for *_, a in sorted(found)]


def addresses(img: Node) -> list[str]:
    """What a picture may be loaded from, best first: a better kind beside it, lazy addresses, the set, its own."""
    out: list[str] = []
    if img.parent is not None and img.parent.tag == "picture":
        out += [a for s in img.parent.elements() if s.tag == "source" and (s.attrs.get("type") or "").lower() == "image/webp" for a in ranked(s.attrs.get("srcset") or s.attrs.get("data-srcset"))]
    out += [img.attrs[n] for n in LAZY if img.attrs.get(n)]
    out += ranked(img.attrs.get("data-srcset")) + ranked(img.attrs.get("srcset")) + [img.attrs.get("src") or ""]
    return list(dict.fromkeys(a.strip() for a in out if a.strip() and not a.strip().startswith("data:")))


def said(node: Node, *names: str) -> str:
    return " ".join(node.attrs.get(n) or "" for n in names)


def featured(img: Node) -> bool:
    return bool(PANEL_CLASSES.search(said(img, "class")))


def beside(img: Node) -> bool:
    """Whether the picture stands in the page's furniture: related posts, menus, authors, shares, or a link to a social site."""
    for n in img.above():
        if n.tag == "a" and (host := urlsplit_host(n.attrs.get("href"))) and any(host == s or host.endswith("." + s) for s in SOCIAL):
            return True
        related = n.tag in ("nav", "footer", "aside") or (n.tag not in ("html", "body", "main", "article") and AROUND.search(said(n, "class", "id")))
        if related and not (featured(img) and not re.search(r"(?i)related|recent|recommend|query", said(n, "class", "id"))):
            return True
    return False


def urlsplit_host(address: str | None) -> str:
    try:
        return (urlsplit((address or "").strip()).hostname or "").removeprefix("www.")
    except ValueError:
        return ""


def served(*texts: str | None) -> tuple[int, int] | None:
    """The size that an image service is asked for: resize= or fit= with two numbers."""
    for t in texts:
        m = re.search(r"(?i)(?:resize|fit)=(\d+)(?:%2c|,)(\d+)", t or "")
        if m:
            return int(m[1]), int(m[2])
    return None


def long(width: int, height: int) -> bool:
    return bool(width and height) and (width / height > RATIO or height / width > RATIO)


def good_tag(img: Node, address: str) -> bool:
    """What a tag says about its picture: no face, decoration, advert, logo without a size, small, small square, long or unseen one."""
    width, height = whole(img.attrs.get("width")), whole(img.attrs.get("height"))
    large = (width or 0) >= WIDTH and (height or 0) >= HEIGHT
    words = said(img, "alt", "title")
    small = (width is not None and width < WIDTH) or (height is not None and height < HEIGHT)
    square = width is not None and width == height and width <= 400 and not featured(img)
    unseen = (img.attrs.get("src") or "").startswith("data:") and not said(img, "srcset", "data-srcset").strip() and width is None and height is None
    shape = served(img.attrs.get("src"), img.attrs.get("srcset"), img.attrs.get("data-srcset"))
    return not (
        small or square or unseen or (img.attrs.get("height") or "").strip().endswith("%") or (shape and long(*shape)) or DECORATION.search(said(img, "class"))
        or FACES.search(said(img, "class", "id", "alt", "title", "aria-label") + " " + address) or ADVERT_WORDS.search(words) or (LOGOS.search(words) and not large)
    )


def sizes_in(path: str) -> list[tuple[int, int]]:
    return [(int(a), int(b)) for a, b in re.findall(r"(?<![0-9a-zA-Z])(\d{1,4})[xX](\d{1,4})(?![0-9a-zA-Z])", path)] + [(int(a), int(b)) for a, b in re.findall(r"/(\d{3,4})/(\d{3,4})(?=/)", path)]


def good_address(address: str, width: int | None = None, height: int | None = None, page: str = "") -> bool:
    """What an address says about its picture. One below the page's own folder may be called a logo."""
    try:
        u, own = urlsplit(address), urlsplit(page)
        host = (u.hostname or "").lower()
    except ValueError:
        return False
    path, query = u.path, {k.lower(): v for k, v in parse_qsl(u.query)}
    folder = own.path if own.path.endswith("/") else own.path.rsplit("/", 1)[0] + "/"
    ours = len(folder) > 1 and own.netloc == u.netloc and path.startswith(folder)
    name = path.rsplit("/", 1)[-1]
    machine = re.match(r"(?i)^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}\b", name)
    if u.scheme not in ("http", "https") or not host or TEMPLATE.search(address) or path.lower().endswith((".svg", ".ico")):
        return False
    if TRACKERS.search(host + path) or EMOJI.search(host + path) or FACES.search(path) or FURNITURE.search(host + path) or "gravatar.com" in host:
        return False
    if ADVERTS.search(path.rsplit("/", 1)[0] + "/") or (not machine and ADVERTS.search("/" + name)):
        return False
    shown, asked = sizes_in(path), served(u.query)
    large = [(w, h) for w, h in shown if w >= WIDTH and h >= HEIGHT]
    wide = [int(x) for x in (query.get("w"), query.get("width"), *re.findall(r"[-_](\d{3,4})w\b", path)) if x and x.isdigit()]
    tall = [int(x) for x in (query.get("h"), query.get("height")) if x and x.isdigit()]
    if LOGOS.search(path) and not ours and not any(not long(w, h) for w, h in large) and not any(w >= WIDTH for w in wide) and not (asked and asked[0] >= WIDTH and asked[1] >= HEIGHT):
        return False
    if PLACEHOLDERS.search(path) and not ((width or 0) >= HERO_WIDTH and (height or 0) >= HERO_HEIGHT):
        return False
    if any(w <= 10 and h <= 10 for w, h in shown):
        return False
    if width is None or height is None:
        if any(w < WIDTH for w in wide) or any(h < HEIGHT for h in tall) or (asked and (asked[0] < WIDTH or asked[1] < HEIGHT or long(*asked))):
            return False
        if shown and not large and not re.search(r"(?i)/(?:download|file|product|entry)?thumbs?(?:nail)?s?/", path):
            return False
        if any(int(w) < WIDTH for w in re.findall(r"[,/]w_(\d+)", path)) or any(int(h) < HEIGHT for h in re.findall(r"[,/]h_(\d+)", path)):
            return False
    return not ((width is not None and width < WIDTH) or (height is not None and height < HEIGHT))


def points(img: Node, address: str) -> int:
    """The sum of what speaks for a picture."""
    css, alt = said(img, "class").lower(), ((img.attrs.get("alt") or "").strip() or (img.attrs.get("title") or "").strip())
    has = lambda *words: any(w in css for w in words)
    low = address.lower()
    return sum((
        120 * has("hero-image"), 40 * has("hero"), 30 * has("featured", "lead", "article-image", "main-image", "entry-image"), 60 * has("topic_icon", "topic-icon", "category-icon", "tag-icon"),
        40 * (said(img, "fetchpriority").strip().lower() == "high"), 20 * (said(img, "data-component-name").strip().lower() == "image"), 10 * bool(said(img, "srcset", "data-srcset").strip()),
        10 if len(alt) >= 40 else 5 if len(alt) >= 16 else 0, 15 * any(n in low for n in NAMED),
    ))


def candidates(root: Node, base: str) -> Iterator[tuple[Node, list[str]]]:
    """Pictures that may illustrate the page, with their acceptable addresses."""
    for img in root.walk():
        if img.tag == "img" and not beside(img):
            width, height = whole(img.attrs.get("width")), whole(img.attrs.get("height"))
            found = [a for a in (joined(base, x) for x in addresses(img)) if a and good_tag(img, a) and good_address(a, width, height, base)]
            if found:
                yield img, found


def joined(base: str, address: str) -> str:
    try:
        return urljoin(base, address)
    except ValueError:
        return ""


def best(root: Node, base: str) -> tuple[str | None, int | None, str | None]:
    """(address, score, alt) of the picture with most points; the first one has ten more, and of equals the first wins."""
    top: tuple[str | None, int | None, str | None] = (None, None, None)
    for k, (img, found) in enumerate(candidates(root, base)):
        score = points(img, found[0]) + (10 if k == 0 else 0)
        if top[1] is None or score > top[1]:
            top = (found[0], score, said(img, "alt").strip() or said(img, "title").strip() or None)
    return top


def panel(root: Node, base: str) -> str | None:
    """The comic on a page: the first good picture in a block that is named so, else the first that is named so itself."""
    free = [img for img in root.walk() if img.tag == "img" and not beside(img)]
    boxed = [img for img in free if any(n.tag in ("div", "section", "article", "figure") and PANEL_BLOCKS.search(said(n, "class", "id")) for n in img.above())]
    named = [img for img in free if said(img, "id").strip().lower() in PANEL_IDS or PANEL_CLASSES.search(said(img, "class"))]
    for img in boxed + named:
        for a in addresses(img):
            address = joined(base, a)
            if address and good_address(address, page=base):
                return address
    return None


def collected(root: Node, base: str, most: int | None = None) -> list[str]:
    """All pictures of a page in order, each file name once; of several addresses that below the page's own path."""
    folder = urlsplit(base).path.rstrip("/").lower() + "/"
    below = lambda a: len(folder) > 1 and urlsplit(a).path.lower().startswith(folder)
    chosen = list(dict.fromkeys(next((a for a in found if below(a)), found[0]) for _, found in candidates(root, base)))
    names: dict[str, str] = {}
    for a in chosen:
        name = urlsplit(a).path.rsplit("/", 1)[-1].lower()
        if name not in names or (below(a) and not below(names[name])):
            names[name] = a
    kept = [a for a in chosen if names[urlsplit(a).path.rsplit("/", 1)[-1].lower()] == a]
    return kept[:most]


LEAD = T.StructType([T.StructField("url", T.StringType()), T.StructField("score", T.IntegerType()), T.StructField("alt", T.StringType()), T.StructField("comic", T.StringType())])


@by_row(LEAD)
def lead_image(html: str | None, base: str | None) -> dict:
    """The best picture of a page with its score and text, and its comic panel, all in one parse; nulls where there is none."""
    root = parsed(html)
    return dict(zip(LEAD.names, (*best(root, base or ""), panel(root, base or "")), strict=True))


@by_row(T.ArrayType(T.StringType()))
def gallery(html: str | None, base: str | None) -> list[str]:
    """A page's pictures in order."""
    return collected(parsed(html), base or "")
