"""Captured pages as text: styles, sizes, drawings, tags, dates, edits, embeds, readable bodies, pictures; Column to Column."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions import text, url

#: Fixed values of our own: what a rebuilt style may say.
STYLES = ("text-align", "font-weight", "font-style", "text-decoration", "vertical-align", "list-style-type", "white-space")
RELATED = "related|share|sharing|social|sidebar|comments?|newsletter|promo|breadcrumbs?|cookie"
BLOCKS = "div|section|aside|nav|footer|ul"


def plain(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]*>", " "), r"\s+", " "))


def first(value: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(value, pattern, group), F.lit(""))


def attribute(tag: Column, name: str) -> Column:
    """Of a start tag, quoted or not; null where there is none."""
    return F.coalesce(first(tag, rf'(?i)\s{name}\s*=\s*"([^"]*)"'), first(tag, rf"(?i)\s{name}\s*=\s*'([^']*)'"), first(tag, rf"(?i)\s{name}\s*=\s*([^\s\"'>]+)"))


def rebuilt_style(style: Column) -> Column:
    """(style, width, height, align): allowed declarations in order, and sizes in pixels and floats lifted out of them."""
    parts = F.transform(F.split(F.coalesce(style, F.lit("")), ";"), lambda x: F.trim(x))
    name = lambda x: F.lower(F.trim(F.regexp_extract(x, "^([^:]*):", 1)))
    value = lambda x: F.trim(F.regexp_replace(x, "^[^:]*:", ""))
    good = F.filter(parts, lambda x: name(x).isin(*STYLES) & ~F.lower(value(x)).rlike(r"url\(|expression|javascript|[<>\\]"))
    pixels = lambda of: F.get(F.filter(F.transform(F.filter(parts, lambda x: name(x) == of), lambda x: F.regexp_extract(F.lower(value(x)), r"^(\d+)(?:\.\d+)?px$", 1).try_cast("int")), lambda v: v.isNotNull()), F.lit(0))
    side = F.get(F.filter(F.transform(F.filter(parts, lambda x: name(x) == "float"), lambda x: F.lower(value(x))), lambda v: v.isin("left", "right")), F.lit(0))
    return F.struct(F.array_join(F.transform(good, lambda x: F.concat(name(x), F.lit(": "), value(x))), "; ").alias("style"), pixels("width").alias("width"), pixels("height").alias("height"), side.alias("align"))


def image_tags(html: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?i)<img\b[^>]*>"), F.lit(0))


def image_sizes(html: Column) -> Column:
    """(src, width, height) of every picture that states both, in order."""
    found = F.transform(image_tags(html), lambda x: F.struct(attribute(x, "src").alias("src"), attribute(x, "width").try_cast("int").alias("width"), attribute(x, "height").try_cast("int").alias("height")))
    return F.filter(found, lambda x: x["src"].isNotNull() & x["width"].isNotNull() & x["height"].isNotNull())


def sizes_reapplied(html: Column, sizes: Column) -> Column:
    """Pictures without a width get the size that was collected for their address."""
    quoted = lambda x: F.concat(F.lit(r'<img(?![^>]*\swidth=)([^>]*\ssrc="\Q'), x["src"], F.lit(r'\E"[^>]*?)(/?)>'))
    put = lambda x: F.concat(F.lit('<img$1 width="'), x["width"].cast("string"), F.lit('" height="'), x["height"].cast("string"), F.lit('"$2>'))
    return F.aggregate(sizes, html, lambda h, x: F.regexp_replace(h, quoted(x), put(x)))


def page_tags(html: Column, most: int = 15) -> Column:
    """Tags of a page in order of trust: article:tag, JSON-LD keywords, keyed meta, meta keywords, rel=tag anchors, anchors of taxonomies.

    Three or more years in a row come from an archive's list and count as none.
    """
    h = F.coalesce(html, F.lit(""))
    metas = F.regexp_extract_all(h, F.lit(r"(?i)<meta\b[^>]*>"), F.lit(0))
    content = lambda name: F.filter(F.transform(F.filter(metas, lambda m: F.lower(F.coalesce(attribute(m, "property"), attribute(m, "name"), F.lit(""))) == name), lambda m: attribute(m, "content")), lambda v: v.isNotNull())
    comma = lambda values: F.flatten(F.transform(values, lambda v: F.split(v, ",")))
    linked = F.regexp_extract_all(h, F.lit(r'"keywords"\s*:\s*\[([^\]]*)\]'), F.lit(1))
    keywords = F.flatten(F.transform(linked, lambda v: F.regexp_extract_all(v, F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1))))
    anchors = F.regexp_extract_all(h, F.lit(r"(?is)<a\b[^>]*>.*?</a>"), F.lit(0))
    of_tag = F.transform(F.filter(anchors, lambda a: F.lower(F.coalesce(attribute(a, "rel"), F.lit(""))).rlike(r"(^|\s)tag(\s|$)")), plain)
    of_taxonomy = F.transform(F.filter(anchors, lambda a: url.taxonomy_slug(attribute(a, "href")).isNotNull()), plain)
    seen = F.filter(F.concat(of_tag, of_taxonomy), text.looks_like_tag)
    years = F.size(F.filter(seen, lambda x: x.rlike(r"^(19|20)\d\d$"))) >= 3
    listed = F.when(years, F.filter(seen, lambda x: ~x.rlike(r"\b(19|20)\d\d\b"))).otherwise(seen)
    keyed = F.flatten(F.transform(content("mrf:tags"), lambda v: text.keyed_meta(v)))
    return text.clean_tags(F.concat(content("article:tag"), keywords, keyed, comma(content("keywords")), listed), most)


MONTHS = "January February March April May June July August September October November December"


def written_date(value: Column) -> Column:
    """A text that is nothing but a date: 2024-01-31, January 31, 2024 or 31 January 2024, months also by three letters."""
    v = F.regexp_replace(F.trim(value), r"\s+", " ")
    tidy = F.regexp_replace(F.regexp_replace(v, r"(?i)^(?:published|posted|updated)?:?\s*(?:on )?", ""), r"(\d)(?:st|nd|rd|th)\b", "$1")
    short = F.initcap(F.regexp_replace(F.regexp_replace(tidy, r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?", "$1"), ",", ""))
    shaped = lambda pattern, form: F.when(short.rlike(pattern), F.try_to_date(short, form))
    return F.coalesce(shaped(r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), shaped(r"^[A-Z][a-z]{2} \d{1,2} \d{4}$", "MMM d yyyy"), shaped(r"^\d{1,2} [A-Z][a-z]{2} \d{4}$", "d MMM yyyy"))


def visible_date(html: Column, now: Column) -> Column:
    """The date in an element that is labelled as one, else in the first element whose whole text is a date; after 1990, at most two days ahead."""
    h = F.coalesce(html, F.lit(""))
    labelled = F.regexp_extract_all(h, F.lit(r"""(?i)<[a-z0-9]+\b[^>]*\b(?:class|id|itemprop)\s*=\s*["'][^"']*(?:date|published|posted|time)[^"']*["'][^>]*>\s*([^<]{8,40})<"""), F.lit(1))
    every = F.regexp_extract_all(h, F.lit(r">\s*([^<>]{8,40}?)\s*<"), F.lit(1))
    dated = F.transform(F.concat(labelled, every), written_date)
    return F.get(F.filter(dated, lambda d: d.isNotNull() & (F.year(d) > 1990) & (d <= F.date_add(now, 2))), F.lit(0))


def resolved_date(html: Column, link: Column, now: Column, in_index: Column, in_page: Column) -> Column:
    """(date, source): of the site's own index, the page's metadata, its visible text, or the link; null where none states one."""
    from feedloom.functions.dates import date_in_url

    shown, linked = visible_date(html, now), date_in_url(link)
    named = lambda d, name: F.when(d.isNotNull(), F.struct(d.alias("date"), F.lit(name).alias("source")))
    return F.coalesce(named(in_index, "index"), in_page, named(shown, "text"), named(linked, "link"))


def edited(html: Column, edits: Column) -> Column:
    """(html, applied, unmatched) after replaying edits (action, passage): each passage must be there exactly once.

    ``remove`` takes it out, ``isolate`` leaves nothing else; later edits see what earlier ones left.
    """
    once = lambda h, p: (F.length(h) - F.length(F.replace(h, p, F.lit("")))) == F.length(p)

    def step(s: Column, e: Column) -> Column:
        hit = (F.length(e["passage"]) > 0) & once(s["html"], e["passage"])
        after = F.when(e["action"] == "isolate", e["passage"]).otherwise(F.replace(s["html"], e["passage"], F.lit("")))
        return F.struct(F.when(hit, after).otherwise(s["html"]).alias("html"), (s["applied"] + hit.cast("int")).alias("applied"), (s["unmatched"] + (~hit).cast("int")).alias("unmatched"))

    return F.aggregate(edits, F.struct(F.coalesce(html, F.lit("")).alias("html"), F.lit(0).alias("applied"), F.lit(0).alias("unmatched")), step)


def missing_embeds(source: Column, content: Column) -> Column:
    """Players that the source page holds and the content lost, in order: videos by id, album players and audio files by address."""
    videos = F.array_except(url.youtube_ids(F.coalesce(source, F.lit(""))), url.youtube_ids(F.coalesce(content, F.lit(""))))
    players = lambda h: F.array_distinct(F.regexp_extract_all(F.coalesce(h, F.lit("")), F.lit(r'(https://bandcamp\.com/EmbeddedPlayer/[^"\'\s<>]+|https?://[^"\'\s<>]+\.(?:mp3|m4a)(?=["\']))'), F.lit(1)))
    return F.concat(F.transform(videos, lambda v: F.concat(F.lit("https://www.youtube.com/embed/"), v)), F.array_except(players(source), players(content)))


def without_chrome(html: Column) -> Column:
    """Without navigation, comments, sharing and related blocks, innermost first."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|nav|footer|aside|form|noscript)\b.*?</\1\s*>", "")
    block = rf"(?is)<({BLOCKS})\b[^>]*\b(?:class|id)\s*=\s*[\"'][^\"']*\b(?:{RELATED})\b[^\"']*[\"'][^>]*>(?:(?!<(?:{BLOCKS})\b).)*?</\1\s*>"
    for _ in range(3):
        out = F.regexp_replace(out, block, "")
    return out


def readable(html: Column, least: int = 60) -> Column:
    """The page's paragraphs with text enough and links few, in order, as plain text; a density rule stands in for a full extractor."""
    body = without_chrome(html)
    parts = F.regexp_extract_all(body, F.lit(r"(?is)<(p|h[1-3]|li|blockquote|pre)\b[^>]*>(.*?)</\1\s*>"), F.lit(2))
    linked = lambda p: F.aggregate(F.regexp_extract_all(p, F.lit(r"(?is)<a\b[^>]*>(.*?)</a>"), F.lit(1)), F.lit(0), lambda n, a: n + F.length(plain(a)))
    good = F.filter(parts, lambda p: (F.length(plain(p)) >= least) & (linked(p) * 3 < F.length(plain(p))))
    return F.nullif(F.array_join(F.transform(good, plain), "\n\n"), F.lit(""))


def markup(body: Column) -> Column:
    """What a text is written in: html, bbcode, markdown or plain."""
    b = F.coalesce(body, F.lit(""))
    return (
        F.when(b.rlike(r"(?i)<(p|a|div|br|img|span|ul|h[1-6])\b"), "html").when(b.rlike(r"(?i)\[(b|i|u|url|img|quote|code|list)(=[^\]]*)?\].*\[/\1\]"), "bbcode")
        .when(b.rlike(r"(?m)^#{1,6} \S|^\s*[-*] \S|\[[^\]]+\]\([^)\s]+\)|\*\*\S[^*]*\*\*|^```"), "markdown").otherwise("plain")
    )


#: What challenge pages say in their head, in the order of the tests, and whose they are.
CHALLENGES = (
    ("/.well-known/sgcaptcha", "SiteGround captcha"),
    ("cf-browser-verification", "Cloudflare challenge"),
    ("challenge-platform", "Cloudflare challenge"),
    ("cf_chl_", "Cloudflare challenge"),
    ("just a moment...", "Cloudflare challenge"),
    ("attention required! | cloudflare", "Cloudflare block"),
    ("_incapsula_resource", "Imperva/Incapsula challenge"),
    ("sucuri_cloudproxy", "Sucuri firewall"),
    ("ddos-guard", "DDoS-Guard challenge"),
    ("awswaf", "AWS WAF challenge"),
    ("/cdn-cgi/challenge", "Cloudflare challenge"),
)


def challenge(content_type: Column, body: Column) -> Column:
    """Whose bot challenge a response is; null for others, for bodies without markup and for types that aren't a page or plain text."""
    head = F.lower(F.substring(body, 1, 4096))
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    out = F.lit(None).cast("string")
    for mark, whose in reversed(CHALLENGES):
        out = F.when(head.contains(mark), whose).otherwise(out)
    return F.when(((kind == "") | kind.contains("html") | kind.contains("text/plain")) & head.contains("<"), out)


@dataclass(frozen=True)
class SitePlugin:
    """What to strip from pages of a host, or the one part to keep: by a class of the element."""

    host: str
    strip: tuple[str, ...] = ()
    content: str | None = None


def with_plugins(html: Column, link: Column, plugins: list[SitePlugin]) -> Column:
    """A page after the plugin of its host; others stay as they are."""
    host = url.article_host(link)
    element = lambda name: rf"(?is)<([a-z0-9]+)\b[^>]*\bclass\s*=\s*[\"'](?:[^\"']*\s)?{name}(?:\s[^\"']*)?[\"'][^>]*>(.*?)</\1\s*>"
    out = html
    for p in plugins:
        own = html
        for name in p.strip:
            own = F.regexp_replace(own, element(name), "")
        if p.content:
            own = F.coalesce(first(own, element(p.content), 2), own)
        out = F.when(url.on_site(host, p.host), own).otherwise(out)
    return out


# --- lead images ---------------------------------------------------------------------------------------------------------


def candidates(html: Column) -> Column:
    """(place, src, width, height, alt, class) of each picture, lazy sources first, then the source, then the largest of its set."""
    source = lambda x: F.coalesce(attribute(x, "data-src"), attribute(x, "data-lazy-src"), attribute(x, "data-original"), F.when(~attribute(x, "src").startswith("data:"), attribute(x, "src")), F.get(text.ranked_sources(attribute(x, "srcset")), F.lit(0)))
    found = F.transform(image_tags(html), lambda x, k: F.struct(k.alias("place"), source(x).alias("src"), attribute(x, "width").try_cast("int").alias("width"), attribute(x, "height").try_cast("int").alias("height"), attribute(x, "alt").alias("alt"), attribute(x, "class").alias("css")))
    return F.filter(found, lambda x: x["src"].isNotNull())


def acceptable_tag(x: Column) -> Column:
    """No tracking pixel, no icon by class or alternative text, not hidden, no thin strip."""
    small = (F.coalesce(x["width"], F.lit(1 << 20)) < 50) | (F.coalesce(x["height"], F.lit(1 << 20)) < 50)
    words = F.lower(F.concat_ws(" ", x["css"], x["alt"]))
    thin = x["width"].isNotNull() & x["height"].isNotNull() & (F.greatest(x["width"], x["height"]) > 5 * F.least(x["width"], x["height"]))
    return ~small & ~thin & ~words.rlike(r"\b(avatar|emoji|icon|logo|badge|sprite|pixel|spacer|hidden|author|profile)\b")


def acceptable_url(u: Column) -> Column:
    """No tracker, advert, emoji, avatar, chrome or placeholder by its address, and no size below 50 in it."""
    low = F.lower(u)
    size = F.regexp_extract(low, r"[-_/](\d{1,4})x(\d{1,4})(?=[-_./]|$)", 1).try_cast("int")
    marks = r"(?:pixel|tracker|beacon|spacer|blank\.|emoji|gravatar|avatar|/logo|favicon|icon[s_-]|sprite|badge|button|placeholder|share[_-]|doubleclick|/ads?/|feedburner\.com/~)"
    return ~low.startswith("data:") & ~low.rlike(marks) & ~url.is_ad(u) & ~low.rlike(r"\.(?:svg|ico)(?:\?|$)") & (F.coalesce(size, F.lit(1 << 20)) >= 50)


def lead(html: Column, strategy: str = "first") -> Column:
    """The address of the best acceptable picture: score by size and text, ten more for the first; ``comic`` prefers panels by class or text."""
    good = F.filter(candidates(html), lambda x: acceptable_tag(x) & acceptable_url(x["src"]))
    area = lambda x: F.coalesce(x["width"] * x["height"], F.lit(0))
    score = lambda x, k: F.when(area(x) >= 200_000, 40).when(area(x) >= 40_000, 20).otherwise(0) + F.when(F.length(F.coalesce(x["alt"], F.lit(""))) > 8, 10).otherwise(0) + F.when(k == 0, 10).otherwise(0)
    panel = lambda x: F.lower(F.concat_ws(" ", x["css"], x["alt"], x["src"])).rlike(r"\b(comic|panel|strip)s?\b|/comics?/").cast("int")
    rated = F.transform(good, lambda x, k: F.struct((-panel(x) if strategy == "comic" else F.lit(0)).alias("panel"), (-score(x, k)).alias("score"), k.alias("place"), x["src"].alias("src")))
    return F.array_min(rated)["src"]


@dataclass(frozen=True)
class ImagePlugin:
    """Hooks of a source of lead images: whose pages it takes, the picture it finds there, whether it is to be trusted, and its name."""

    name: str
    matches: Callable[[Column], Column]
    find: Callable[[Column], Column]
    accept: Callable[[Column], Column] = acceptable_url
    skip_source: Callable[[Column], Column] | None = None


def resolved_image(link: Column, media: Column, html: Column, source: Column, plugins: list[ImagePlugin]) -> Column:
    """(url, strategy): the first of plugin, feed media, picture in the content, picture of the source page that gives one."""
    named = lambda u, name: F.when(u.isNotNull(), F.struct(u.alias("url"), F.lit(name).alias("strategy")))
    steps, skipped = [], F.lit(False)
    for p in plugins:
        found = p.find(F.coalesce(source, html))
        steps.append(F.when(p.matches(link) & p.accept(found), named(found, p.name)))
        if p.skip_source:
            skipped = skipped | F.coalesce(p.skip_source(link), F.lit(False))
    steps += [F.when(acceptable_url(media), named(media, "media")), named(lead(html), "inline"), F.when(~skipped, named(lead(without_chrome(source)), "source"))]
    return F.coalesce(*steps)


def to_look_up(entries: DataFrame, cache: DataFrame, key: str, now: Column, retry_hours: int = 24) -> DataFrame:
    """Entries without an answer in the cache (key, url, checked), or with a negative one (null url) that is old enough to ask again."""
    j = entries.join(cache.select(key, "url", "checked", F.lit(True).alias("known")), key, "left")
    old = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("checked").cast("timestamp")) > retry_hours * 3_600_000_000
    return j.where(F.col("known").isNull() | (F.col("url").isNull() & old)).drop("url", "checked", "known")
