"""Feeds of known sites' pages, and the order in which candidates count."""

import pytest
from pyspark.sql import functions as F

from feedloom.operators import discovery


@pytest.mark.parametrize("url, want", [
    ("https://pinboard.in/popular/", "https://feeds.pinboard.in/rss/popular/"), ("https://pinboard.in/u:me/t:x", "https://feeds.pinboard.in/rss/u:me/t:x/"), ("https://pinboard.in/settings/", None), ("https://pinboard.in/", None),
    ("https://Some-One.artstation.com/projects", "https://www.artstation.com/some-one.rss"), ("https://www.artstation.com/someone", "https://www.artstation.com/someone.rss"), ("https://www.artstation.com/jobs", None), ("https://www.artstation.com/x.rss", None), ("https://www.artstation.com/a/b", None),
    ("https://behance.net/Me/", "https://www.behance.net/Me.rss"), ("https://behance.net/search", None), ("https://www.freecodecamp.org/news/", "https://www.freecodecamp.org/news/rss/"), ("https://www.freecodecamp.org/news/tag/math/", "https://www.freecodecamp.org/news/tag/math/rss/"), ("https://www.freecodecamp.org/news/an-article/", None),
    ("https://m.tapas.io/series/123", "https://tapas.io/rss/series/123"), ("https://tapas.io/series/slug", None), ("https://tinyview.com/comic/2026/08/13/time", "https://tinyview.com/comic/feed.rss"), ("https://tinyview.com/comic/feed.rss", None), ("https://tinyview.com/about", None), ("https://example.org/popular/", None),
    ("https://pinboard.in.evil.org/popular/", None), (None, None), ("", None),
])
def test_feeds_of_known_sites(spark, url, want):
    assert spark.range(1).select(discovery.site_feed(F.lit(url).cast("string")).alias("x")).first().x == want


def test_candidates_in_their_order(spark):
    df = spark.createDataFrame([(1, "https://a.org/blog/post?x#y", '<link rel=alternate type="application/atom+xml" href="/a"><link rel=alternate type="application/rss+xml" href="r"><link rel=alternate type="application/rss+xml" href="/a">'), (2, "https://b.org/", None), (3, None, "x"), (4, "https://tapas.io/series/slug", "x seriesId: 77 y")], "page_id long, url string, html string")
    got = {}
    for r in discovery.candidates(df).orderBy("page_id", "tier", "place").collect():
        got.setdefault((r.page_id, r.tier), []).append(r.url)
    assert got[1, 0] == ["https://a.org/blog/post?x#y"] and got[1, 1] == ["https://a.org/a", "https://a.org/blog/r"] and got[2, 0] == ["https://b.org/"] and got[4, 1] == ["https://tapas.io/rss/series/77"]
    assert got[1, 2] == ["https://a.org/blog/post" + p for p in discovery.PATHS] + ["https://a.org" + p for p in discovery.PATHS] and got[2, 2] == ["https://b.org" + p for p in discovery.PATHS]
    assert got[1, 3] == ["https://a.org/blog/post/?" + q for q in discovery.QUERIES] and (2, 3) not in got and 3 not in {k[0] for k in got}


def test_a_page_that_is_a_feed_and_one_that_never_answered(spark):
    pages = spark.createDataFrame([(1, "https://a.org/f", None), (2, "https://pinboard.in/popular", None), (3, "https://c.org/", ""), (4, "https://d.org/x", "")], "page_id long, url string, html string")
    probes = spark.createDataFrame([("https://a.org/f", 200, "Application/RSS+xml; a", 9), ("https://feeds.pinboard.in/rss/popular/", 200, "text/xml", 9), ("https://d.org/x", 404, None, 0), ("https://d.org/atom.xml", 200, "application/atom+xml", 9)], "url string, status int, content_type string, size int")
    got = {r.page_id: (r.status, r.why, list(r.feeds)) for r in discovery.discovered(pages, probes).collect()}
    assert got == {1: ("feed", "page", ["https://a.org/f"]), 2: ("feed", "page", ["https://feeds.pinboard.in/rss/popular/"]), 3: ("error", "unreachable", []), 4: ("feed", "path", ["https://d.org/atom.xml"])}
    assert discovery.discovered(pages.limit(0), probes).count() == 0
