"""The feeds behind a page's address: candidates by known sites, announcements and conventions, judged by what probes of them answered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions import html as H

#: Paths where feeds usually are, below the page and at the root, and queries that blogs answer with one.
PATHS = ("/feed", "/feed/", "/feed.xml", "/rss", "/rss.xml", "/atom.xml", "/atom", "/index.xml", "/feeds/posts/default")
QUERIES = ("feed=rss2", "feed=rss", "feed=atom", "feed=json")
SEGMENT = r"(?:popular|recent|private|unread|untagged|starred|network|[ut]:[^/]+|from:[^/]+|secret:[^/]+)"
#: Sites whose feeds their pages don't announce. Host, path, feed, and first parts of paths that are the site's own.
SITES = (
    (r"(?:www\.)?pinboard\.in", rf"/({SEGMENT}(?:/{SEGMENT})*)/?", "https://feeds.pinboard.in/rss/$2/", ""),
    (r"(?!www\.)([a-z0-9_-]+)\.artstation\.com", r"(?:/.*)?", "https://www.artstation.com/$1.rss", ""),
    (r"(?:www\.)?artstation\.com", r"/((?![^/]*\.rss$)[^/]+)/?", "https://www.artstation.com/$2.rss", "artwork search jobs blogs prints marketplace learning contests channels guilds about terms privacy podcast magazine studios schools wallpapers 2d 3d login signup users explore following notifications messages"),
    (r"(?:www\.)?behance\.net", r"/((?![^/]*\.rss$)[^/]+)/?", "https://www.behance.net/$2.rss", "search galleries joblist hire assets for_you live onboarding settings notifications messages adobe blog help about careers login signup feeds gallery collection collections reviews schools discover"),
    (r"(?:www\.)?freecodecamp\.org", r"/(news(?:/(?:tag|author)/(?!rss/?$)[^/]+)?)/?", "https://www.freecodecamp.org/$2/rss/", ""),
    (r"(?:www\.|m\.)?tapas\.io", r"/series/([0-9]+)/?", "https://tapas.io/rss/series/$2", ""),
    (r"(?:www\.)?tinyview\.com", r"/((?![^/]*\.)[^/]+)(?:/(?!(?:.*/)?feed\.rss/?$).*)?", "https://tinyview.com/$2/feed.rss", "about account admin api blog comics contact discover faq gift help home login logout privacy search settings signup subscribe support terms tinyview"),
)
GONE = (404, 410)


def root_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", 0)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def site_feed(url: Column) -> Column:
    """The feed of a known site's page, or null."""
    host = F.lower(F.regexp_extract(url, r"^https?://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    place = F.concat(host, path_of(url))
    known = []
    for h, p, feed, own in SITES:
        groups = h if "([a-z" in h else f"({h})"
        whole = rf"(?i)^{groups}{p}$"
        first = F.lower(F.regexp_extract(path_of(url), "^/([^/]*)", 1))
        known.append(F.when(place.rlike(whole) & ~first.isin(*own.split()), F.regexp_replace(place, whole, feed)))
    return F.coalesce(*known)


def candidates(pages: DataFrame) -> DataFrame:
    """(page_id, tier, place, url): addresses to ask about each page (page_id, url, html), in the order in which they count.

    Tier 0 is the page, or what a known site has for it; 1 what it announces; 2 conventional paths, below the page and then at the root; 3
    queries of the page.
    """
    url, html, folder = F.col("url"), F.col("html"), F.rtrim(path_of(F.col("url")), F.lit("/"))
    at = lambda tier, urls: F.transform(urls, lambda u, i: F.struct(F.lit(tier).alias("tier"), i.alias("place"), u.alias("url")))
    below = [F.concat(root_of(url), folder, F.lit(p)) for p in PATHS]
    root = [F.concat(root_of(url), F.lit(p)) for p in PATHS]
    series = F.coalesce(*[F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in (r"seriesId:\s*(\d+)", r'data-series-id="(\d+)"')])
    hidden = F.when(url.rlike(r"(?i)^https?://(?:www\.|m\.)?tapas\.io/(?:series|episode)/") & series.isNotNull(), F.array(F.concat(F.lit("https://tapas.io/rss/series/"), series)))
    told = F.array_distinct(F.transform(H.announced_feeds(F.coalesce(html, F.lit("")), url), lambda x: x["url"]))
    none = F.array().cast("array<string>")
    every = F.concat(
        at(0, F.array(F.coalesce(site_feed(url), url))), at(1, F.when(F.size(told) > 0, told).otherwise(F.coalesce(hidden, none))),
        at(2, F.concat(F.when(folder != "", F.array(*below)).otherwise(none), F.array(*root))), at(3, F.when(folder != "", F.array(*[F.concat(root_of(url), folder, F.lit(f"/?{q}")) for q in QUERIES])).otherwise(none)),
    )
    return pages.where("url is not null").select("page_id", F.explode(every).alias("c")).select("page_id", "c.tier", "c.place", "c.url")


def discovered(pages: DataFrame, probes: DataFrame) -> DataFrame:
    """(page_id, status, why, feeds): what to subscribe to for each page, by ``probes`` (url, status, content_type, size), one row an address that was asked.

    status is feed, feeds, none, blocked or error. A page that is a feed is its own; of one that answers at all its announced feeds count unless a probe says that
    they fail; then the first conventional path that is a feed, then all queries that are; then announced feeds that were only refused.
    A page that answers with hardly a word blocks readers; one that doesn't answer may still have a conventional feed.
    """
    kind = F.lower(F.trim(F.split("content_type", ";")[0]))
    is_feed = F.coalesce((F.col("code") >= 200) & (F.col("code") < 300) & (kind.isin("application/feed+json", "text/xml", "application/xml") | kind.rlike("rss|atom")), F.lit(False))
    asked = candidates(pages).join(probes.select("url", F.col("status").alias("code"), "content_type", "size"), "url", "left")
    failed = F.coalesce((F.col("code") >= 400) & ~F.col("code").isin(405, 501), F.lit(False))
    answer = F.struct("place", "url", "code", "size", kind.alias("kind"), is_feed.alias("good"), failed.alias("failed"))
    tiers = asked.groupBy("page_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("tier") == k, answer))).alias(f"t{k}") for k in range(4)])  # some thirty a page
    urls = lambda a: F.transform(a, lambda x: x["url"])
    page, alive = F.get("t0", F.lit(0)), F.filter("t1", lambda x: ~x["failed"])
    usual, asking = F.slice(F.filter("t2", lambda x: x["good"]), 1, 1), F.filter("t3", lambda x: x["good"])
    refused, gone = F.filter("t1", lambda x: x["failed"] & ~x["code"].isin(*GONE)), F.filter("t1", lambda x: x["code"].isin(*GONE))
    ok = F.coalesce((page["code"] >= 200) & (page["code"] < 300), F.lit(False))
    none = F.array().cast("array<string>")
    says = lambda why, feeds: F.struct(F.lit(why).alias("why"), feeds.alias("feeds"))
    result = (
        F.when(page["good"], says("page", urls(F.array(page)))).when(page["code"].isNull(), says("unreachable", none)).when(~ok & (F.size(usual) > 0), says("path", urls(usual))).when(~ok, says("refused", none))
        .when((page["size"] < 512) & F.contains(page["kind"], F.lit("html")), says("empty", none)).when(F.size(alive) > 0, says("announced", urls(alive))).when(F.size(usual) > 0, says("path", urls(usual)))
        .when(F.size(asking) > 0, says("query", urls(asking))).when(F.size(refused) > 0, says("announced, refused", urls(refused))).when(F.size(gone) > 0, says("announced, gone", none)).otherwise(says("nothing", none))
    )
    found = tiers.select("page_id", result.alias("r")).select("page_id", "r.why", "r.feeds")
    status = F.when(F.size("feeds") > 1, "feeds").when(F.size("feeds") == 1, "feed").when(F.col("why") == "empty", "blocked").when(F.col("why").isin("unreachable", "refused"), "error").otherwise("none")
    return found.select("page_id", status.alias("status"), "why", "feeds")
