"""URL functions, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def part(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit(name))


def article_host(url: Column) -> Column:
    """Lower-case host without a leading www; null where there is none."""
    return F.regexp_replace(F.lower(part(url, "HOST")), r"^www\.", "")


def authority(url: Column) -> Column:
    return F.lower(part(url, "AUTHORITY"))


def article_url(url: Column) -> Column:
    """http(s) only, without the fragment; null otherwise."""
    return F.when(url.rlike("^(?i)https?://"), F.regexp_replace(url, "#.*$", ""))


def link_key(url: Column) -> Column:
    """Equal for links that differ in scheme, www, host case, fragment or trailing slash only; no scheme; empty is null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "/+$", "")
    key = F.regexp_replace(bare, r"^(?i)[a-z]+://(?:www\.)?", "")
    host = F.lower(F.regexp_extract(key, "^[^/?]*", 0))
    return F.nullif(F.concat(host, F.regexp_replace(key, "^[^/?]*", "")), F.lit(""))


def canonical_feed_url(url: Column) -> Column:
    """Host in lower case, no trailing slash after a path, no format selectors unless a homepage would be left."""
    trimmed = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.regexp_extract(trimmed, "^[A-Za-z]+://[^/?]*", 0)
    rest = F.regexp_replace(trimmed, "^[A-Za-z]+://[^/?]*", "")
    stripped = F.regexp_replace(F.regexp_replace(rest, r"(?<=[?&])(?:format=(?:rss|atom|xml)|alt=rss)(?:&|$)", ""), "[?&]$", "")
    kept = F.when(stripped.isin("", "/"), rest).otherwise(stripped)
    return F.concat(F.lower(host), F.when(F.length(kept) > 1, F.regexp_replace(kept, "/$", "")).otherwise(F.regexp_replace(kept, "^/$", "")))


def without_tracking(url: Column) -> Column:
    """Without utm_* and WT.* parameters; untouched where there are none."""
    cut = F.regexp_replace(F.regexp_replace(url, r"(?<=[?&])(?:utm_[a-z]+|WT\.[a-z_]+)=[^&#]*&?", ""), "[?&](?=#|$)", "")
    return F.when(url.rlike(r"[?&](?:utm_[a-z]+|WT\.[a-z_]+)="), cut).otherwise(url)


def slug(url: Column, least: int = 3) -> Column:
    """The last path segment without an extension; generic or short ones are null."""
    last = F.regexp_replace(F.regexp_extract(F.regexp_replace(part(url, "PATH"), "/+$", ""), "([^/]*)$", 1), r"\.(?:html?|php)$", "")
    #: Fixed values of our own: segments that name no article.
    return F.when((F.length(last) >= least) & ~F.lower(last).isin("index", "home", "post", "article", "default"), last)


def host_slug(url: Column, least: int = 3) -> Column:
    s = slug(url, least)
    return F.when(s.isNotNull(), F.concat_ws("/", article_host(url), s))


def path_tags(url: Column, most: int = 3) -> Column:
    """Up to ``most`` path segments but the last that look like tags; dated permalinks have none."""
    parts = F.filter(F.split(F.coalesce(part(url, "PATH"), F.lit("")), "/"), lambda x: x != "")
    inner = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    good = F.filter(inner, lambda x: x.rlike("^[a-z][a-z-]{1,29}$") & ~x.isin("blog", "news", "posts", "archive", "the"))
    return F.when(url.rlike(r"/\d{4}/\d{1,2}/"), F.array().cast("array<string>")).otherwise(F.slice(good, 1, most))


def on_site(host: Column, site: str) -> Column:
    return (host == site) | host.endswith("." + site)


def is_redirector(url: Column) -> Column:
    return F.coalesce(article_host(url).isin("feedproxy.google.com", "feeds.feedburner.com") | part(url, "PATH").rlike("^/~r/"), F.lit(False))


def attachment_extension(url: Column) -> Column:
    """The path's extension in lower case; page types and none are null."""
    ext = F.lower(F.regexp_extract(F.coalesce(part(url, "PATH"), F.lit("")), r"\.([A-Za-z0-9]+)$", 1))
    return F.when(~ext.isin("", "html", "htm", "php", "asp", "aspx"), ext)


def swap_host(url: Column, old: str, new: str) -> Column:
    return F.when(part(url, "HOST") == old, F.regexp_replace(url, r"^([A-Za-z]+://)[^/?#:]*", "$1" + new)).otherwise(url)


def youtube_ids(text: Column) -> Column:
    """All video ids in order, distinct."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?:youtu\.be/|youtube(?:-nocookie)?\.com/(?:watch\?(?:[^\s\"']*&)?v=|embed/|shorts/|live/))([A-Za-z0-9_-]{11})"), F.lit(1)))


def one_redirector_free(urls: Column) -> Column:
    """The first of the links that goes through no redirector, else the first that isn't empty."""
    some = F.filter(urls, lambda u: u != "")
    return F.coalesce(F.try_element_at(F.filter(some, lambda u: ~is_redirector(u)), F.lit(1)), F.try_element_at(some, F.lit(1)))


def dedupe_key(link: Column, title: Column) -> Column:
    return F.concat_ws("|", link_key(link), title)


def same_link(a: Column, b: Column) -> Column:
    return F.coalesce(link_key(a) == link_key(b), F.lit(False))


def with_width(url: Column, width: int) -> Column:
    """An image link that asks for a width asks for this one; others stay."""
    return F.regexp_replace(url, r"([?&])(w|width)=\d+", f"$1$2={width}")


def safe_link(url: Column) -> Column:
    """http, https, mailto, relative or empty after control characters and white space are gone."""
    bare = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20]", ""))
    return bare.rlike(r"^(https?:|mailto:|[/#?]|[^:/?#]*([/?#]|$))")


def taxonomy_slug(href: Column) -> Column:
    """The slug of a tag or category link, from its path or a query parameter; null otherwise."""
    path = F.regexp_extract(href, r"(?i)/(?:tags?|categor(?:y|ies))/([^/?#]+)", 1)
    param = F.regexp_extract(href, r"(?i)[?&][a-z_]*(?:tags?|category|categories|topics?)=([^&#]+)", 1)
    found = F.coalesce(F.nullif(path, F.lit("")), F.nullif(param, F.lit("")))
    return F.try_url_decode(found)


def devto_source(url: Column) -> Column:
    """tag:… or user:… of an address on dev.to; null elsewhere."""
    p = F.coalesce(part(url, "PATH"), F.lit(""))
    tag, user = F.regexp_extract(p, "^/t/([A-Za-z0-9]+)/?$", 1), F.regexp_extract(p, "^/([A-Za-z0-9_]+)/?$", 1)
    return F.when(article_host(url) == "dev.to", F.when(tag != "", F.concat(F.lit("tag:"), F.lower(tag))).when((user != "") & (user != "t"), F.concat(F.lit("user:"), F.lower(user))))


def deviantart_user(url: Column) -> Column:
    """The artist of an address on deviantart.com, by path or by subdomain; null elsewhere."""
    host = article_host(url)
    named = F.regexp_extract(F.coalesce(part(url, "PATH"), F.lit("")), "^/([A-Za-z0-9-]+)(?:/|$)", 1)
    return F.when((host == "deviantart.com") & ~named.isin("", "tag", "search", "about"), F.lower(named)).when(host.endswith(".deviantart.com"), F.regexp_extract(host, r"^([a-z0-9-]+)\.", 1))


def subreddit(url: Column) -> Column:
    """Of a link on the site itself; a host that merely contains its name has none."""
    name = F.nullif(F.regexp_extract(url, "/r/([A-Za-z0-9_]+)", 1), F.lit(""))
    return F.when(on_site(F.lower(part(url, "HOST")), "reddit.com"), name)


def redditor(url: Column) -> Column:
    name = F.nullif(F.regexp_extract(url, "/user/([A-Za-z0-9_-]+)/submitted", 1), F.lit(""))
    return F.when(on_site(F.lower(part(url, "HOST")), "reddit.com"), name)


#: Ad networks, ad folders, ad slots in file names, and standard ad sizes.
AD_NETWORKS = r"(?:^|\.)(?:doubleclick\.net|googlesyndication\.com|googleadservices\.com|adnxs\.com|taboola\.com|outbrain\.com|criteo\.(?:com|net)|zedo\.com|openx\.net|pubmatic\.com|rubiconproject\.com)$"
AD_HOSTS = r"^(?:ads?|adserver|adservice|banners?|promo)\d*\."
AD_PATHS = r"/(?:www/)?delivery/[a-z]+\.php|/(?:adserver|adframe|ad_?frame|banner(?:s|ad)?)/"
AD_NAMES = r"superbanner|leaderboard|skyscraper|halfpage|billboard|\bmpu\b|sponsored|advertisement|house[-_]?ad|ad[-_]?banner"
AD_SIZES = ("728x90 970x250 970x90 300x250 336x280 300x600 160x600 120x600 320x50 320x100 468x60 234x60 250x250 200x200 180x150 125x125").split()


def is_ad(url: Column) -> Column:
    host, path = F.lower(part(url, "HOST")), F.lower(F.coalesce(part(url, "PATH"), F.lit("")))
    name = F.regexp_extract(path, "([^/]*)$", 1)
    return F.coalesce(host.rlike(AD_HOSTS) | host.rlike(AD_NETWORKS), F.lit(False)) | path.rlike(AD_PATHS) | name.rlike(AD_NAMES)


def is_ad_size(width: Column, height: Column) -> Column:
    return F.coalesce(F.concat(width.cast("string"), F.lit("x"), height.cast("string")).isin(*AD_SIZES), F.lit(False))
