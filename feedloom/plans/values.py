"""More of SURVEY 2.B, 2.C, 2.D, 2.E, 2.F, 2.K and 2.L as functions over pages, documents, parts and events."""

from pyspark.sql import functions as F

from feedloom.functions import dates, text, url
from feedloom.plans.registry import query, t
from feedloom.plans.scalar import HOST
from feedloom.sources import feeds

PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
SLUG = """CASE WHEN length(x) >= 3 AND lower(x) NOT IN ('index', 'home', 'post', 'article', 'default') THEN x END"""
LAST = f"regexp_replace(regexp_extract(regexp_replace({PATH}, '/+$', ''), '([^/]*)$', 1), '\\.(html?|php)$', '')"
STOP, STRUCTURE = (", ".join(f"'{w}'" for w in words) for words in (text.STOP_WORDS, text.LINK_WORDS))


@query("b7_merged_bookmarks", """WITH b AS (SELECT page_id AS ord, regexp_replace(url, '[?#].*$', '') AS url, CASE WHEN page_id % 2 = 0 THEN '' ELSE 'title ' || page_id END AS title, page_id % 5 = 0 AS archived, make_timestamp(1700000000000000 - page_id * 1000000) AS saved_at, page_id % 3 AS tag FROM pages)
    SELECT url, bool_or(archived) AS archived, min_by(title, ord) FILTER (title <> '') AS title, min(saved_at) AS saved_at FROM b GROUP BY url""")
def b7(s, d):
    k = F.col("page_id")
    rows = t(s, d, "pages").select(k.alias("ord"), F.regexp_replace("url", "[?#].*$", "").alias("url"), F.when(k % 2 == 0, "").otherwise(F.concat(F.lit("title "), k.cast("string"))).alias("title"),
        (k % 5 == 0).alias("archived"), F.timestamp_seconds(F.lit(1700000000) - k).cast("timestamp_ntz").alias("saved_at"), F.array((k % 3).cast("string")).alias("tags"))
    return feeds.merged_bookmarks(rows).drop("tags")


@query("b22_embedded_images", "SELECT page_id, CASE WHEN page_id % 4 < 3 THEN url END AS first, CAST(page_id % 4 AS INTEGER) % 3 + CASE page_id % 4 WHEN 0 THEN 1 WHEN 3 THEN 0 ELSE 1 END AS images FROM pages")
def b22(s, d):
    """One picture twice, two, two and one beside a quoted record, or none."""
    k = F.col("page_id") % 4
    pic = lambda u, name="fullsize": F.struct(*[(u if n == name else F.lit(None).cast("string")).alias(n) for n in ("fullsize", "thumb")])
    own = F.when(k == 0, F.array(pic(F.col("url")), pic(F.col("url"), "thumb"))).when(k < 3, F.array(pic(F.col("url"), "thumb"), pic(F.concat("url", F.lit("#2")))))
    quoted = F.when(k == 2, F.struct(F.array(pic(F.concat("url", F.lit("#3"))), pic(F.col("url"))).alias("images")))
    embed = F.to_json(F.struct(F.struct(F.lit("app.bsky.embed.images").alias("$type"), own.alias("images"), quoted.alias("media")).alias("embed")))
    found = t(s, d, "pages").select("page_id", feeds.embedded_images(embed).alias("i"))
    return found.select("page_id", F.get("i", F.lit(0)).alias("first"), F.size("i").alias("images"))


@query("b25_canonical_links", "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://a.b/' || page_id WHEN 1 THEN 'https://a.b/' || page_id WHEN 2 THEN 'https://c.d/' || page_id WHEN 3 THEN 'https://c.d/' || page_id END AS canonical FROM pages")
def b25(s, d):
    """The tags in any order of their attributes; other links and a page without any."""
    k, n = F.col("page_id") % 5, F.col("page_id").cast("string")
    meta = F.concat(F.lit('<meta content="https://c.d/'), n, F.lit('" property="og:url">'))
    html = F.when(k == 0, F.concat(meta, F.lit('<link rel="canonical" href="https://a.b/'), n, F.lit('">'))).when(k == 1, F.concat(F.lit("<LINK href='https://a.b/"), n, F.lit("' rel='canonical'>"), meta)).when(k == 2, meta)
    html = html.when(k == 3, F.concat(F.lit('<link rel="stylesheet" href="x"><meta property="og:url" content="https://c.d/'), n, F.lit('">'))).otherwise('<a href="https://e.f">canonical</a>')
    return t(s, d, "pages").select("page_id", feeds.canonical_link(html).alias("canonical"))


@query("c2_host_of", "SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host FROM pages")
def c2(s, d):
    return t(s, d, "pages").select("page_id", url.authority(F.col("url")).alias("host"))


@query("c4_canonical_feed", """SELECT page_id, lower(regexp_extract(url, '^[a-z]+://[^/?#]*', 0)) || CASE WHEN length(r) > 1 THEN regexp_replace(r, '/$', '') ELSE regexp_replace(r, '^/$', '') END AS feed
    FROM (SELECT page_id, url, regexp_replace(regexp_replace(url, '#.*$', ''), '^[a-z]+://[^/?]*', '') AS r FROM pages)""")
def c4(s, d):
    return t(s, d, "pages").select("page_id", url.canonical_feed_url(F.col("url")).alias("feed"))


@query("c7_host_slug", f"SELECT page_id, CASE WHEN {SLUG} IS NOT NULL THEN h || '/' || x END AS slug FROM (SELECT page_id, {HOST} AS h, {LAST} AS x FROM pages)")
def c7(s, d):
    return t(s, d, "pages").select("page_id", url.host_slug(F.col("url")).alias("slug"))


@query("c8_dedupe_key", "SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', ''), '^[a-z]+://(www\\.)?', '') || '|t' || page_id AS k FROM pages")
def c8(s, d):
    return t(s, d, "pages").select("page_id", url.dedupe_key(F.col("url"), F.concat(F.lit("t"), F.col("page_id").cast("string"))).alias("k"))


@query("c11_clamped", "SELECT event_id, greatest(0.5, least(1.0, value / 200)) AS pct FROM events")
def c11(s, d):
    return t(s, d, "events").select("event_id", text.clamp((F.col("value") / 200).cast("string"), 0.5, 1.0, 0.8).alias("pct"))


@query("c14_clean_tags", "SELECT p_partkey, CASE WHEN p_brand = p_type THEN lower(p_type) ELSE lower(p_type) || ',' || lower(p_brand) END AS tags FROM part")
def c14(s, d):
    tags = F.array(F.concat(F.lit("#"), "p_type"), F.col("p_brand"), F.lit("2024"), F.col("p_type"), F.lit("  "))
    return t(s, d, "part").select("p_partkey", F.array_join(text.clean_tags(tags), ",").alias("tags"))


@query("c18_keyed_meta", "SELECT p_partkey, p_type || '|' || p_brand AS tags FROM part")
def c18(s, d):
    content = F.concat(F.lit("region:GB;articleType: "), "p_type", F.lit(";channel:"), "p_brand", F.lit(";control:x;;category:"), "p_type")
    return t(s, d, "part").select("p_partkey", F.array_join(text.keyed_meta(content), "|").alias("tags"))


@query("c19_taxonomy_slug", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_type END AS slug FROM part")
def c19(s, d):
    k = F.col("p_partkey") % 3
    href = F.when(k == 0, F.concat(F.lit("http://a.b/Tag/"), F.url_encode("p_brand"), F.lit("/?x=1"))).when(k == 1, F.concat(F.lit("/list?post_tags="), "p_type", F.lit("&y=2"))).otherwise(F.lit("/about/tagging"))
    return t(s, d, "part").select("p_partkey", url.taxonomy_slug(href).alias("slug"))


@query("c20_looks_like_tag", "SELECT conv_id, turn, length(trim(text)) BETWEEN 2 AND 30 AND NOT regexp_matches(text, '[»«…→]') AND NOT regexp_matches(lower(trim(text)), '^(more posts|view all|all posts|see all|browse )') AS tag FROM conversations")
def c20(s, d):
    return t(s, d, "conversations").select("conv_id", "turn", text.looks_like_tag(F.col("text")).alias("tag"))


@query("c23_excerpts", """SELECT page_id, CASE WHEN length(p) > 300 THEN substr(p, 1, 300) || '…' ELSE p END AS excerpt FROM (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS p FROM pages)""")
def c23(s, d):
    return t(s, d, "pages").select("page_id", text.excerpt(F.col("html")).alias("excerpt"))


@query("c25_title_words", f"SELECT p_partkey, len(list_filter(list_distinct(regexp_extract_all(lower(p_name || ' of the ' || p_brand), '[a-z0-9]+')), lambda w: length(w) > 2 AND w NOT IN ({STOP}))) AS words FROM part")
def c25(s, d):
    return t(s, d, "part").select("p_partkey", F.size(text.title_words(F.concat_ws(" of the ", "p_name", "p_brand"))).cast("long").alias("words"))


@query("c25_link_words", f"SELECT page_id, len(list_filter(list_distinct(regexp_extract_all(lower({PATH} || ' ' || array_to_string(regexp_extract_all(regexp_extract(url, '\\?([^#]*)', 1), '=([^&]*)', 1), ' ')), '[a-z0-9]+')), lambda w: length(w) > 2 AND w NOT IN ({STOP}, {STRUCTURE}))) AS words FROM pages")
def c25l(s, d):
    return t(s, d, "pages").select("page_id", F.size(text.link_words(F.col("url"))).cast("long").alias("words"))


@query("c26_redirectors", "SELECT page_id, CASE page_id % 4 WHEN 2 THEN 'http://feedproxy.google.com/x' WHEN 3 THEN NULL ELSE url END AS link FROM pages")
def c26(s, d):
    """A good link among redirectors and blanks, before or behind them; only redirectors; nothing."""
    k = F.col("page_id") % 4
    proxy, other = F.lit("http://feedproxy.google.com/x"), F.lit("https://feeds.a.b/~r/x/1")
    links = F.when(k == 0, F.array(F.lit(""), proxy, other, F.col("url"))).when(k == 1, F.array(F.col("url"), proxy)).when(k == 2, F.array(F.lit(""), proxy, other)).otherwise(F.array(F.lit("")))
    return t(s, d, "pages").select("page_id", url.one_redirector_free(links).alias("link"))


@query("c27_swapped_hosts", "SELECT page_id, regexp_replace(url, '^([a-z]+://)spam-farm\\.example\\.org', '\\1moved.example.org') AS link FROM pages")
def c27(s, d):
    return t(s, d, "pages").select("page_id", url.swap_host(F.col("url"), "spam-farm.example.org", "moved.example.org").alias("link"))


@query("c28_image_width", "SELECT page_id, url || '?a=1&w=1200' AS image FROM pages")
def c28(s, d):
    return t(s, d, "pages").select("page_id", url.with_width(F.concat(F.col("url"), F.lit("?a=1&w=300")), 1200).alias("image"))


@query("c30_same_link", "SELECT page_id, page_id % 6 < 3 AS same FROM pages")
def c30(s, d):
    """Alike but for scheme, www and fragment; or another path, another case of it, or another host."""
    k, n = F.col("page_id") % 6, F.col("page_id").cast("string")
    here = F.concat(F.lit("https://a.b/Path/"), n)
    there = F.when(k == 0, F.concat(F.lit("http://www.a.b/Path/"), n)).when(k == 1, F.concat(F.lit("https://A.B/Path/"), n, F.lit("#x"))).when(k == 2, F.concat(here, F.lit("/")))
    there = there.when(k == 3, F.concat(here, F.lit("0"))).when(k == 4, F.lower(here)).otherwise(F.concat(F.lit("https://c.a.b/Path/"), n))
    return t(s, d, "pages").select("page_id", url.same_link(here, there).alias("same"))


@query("c31_video_ids", "SELECT page_id, lpad(page_id::VARCHAR, 11, 'x') AS ids FROM pages")
def c31(s, d):
    own = F.lpad(F.col("page_id").cast("string"), 11, "x")
    body = F.concat(F.lit("see https://youtu.be/"), own, F.lit(" and https://www.youtube.com/watch?a=1&v="), own, F.lit(" "))
    return t(s, d, "pages").select("page_id", F.array_join(url.youtube_ids(body), ",").alias("ids"))


@query("c33_subreddits", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS subreddit, CASE WHEN p_partkey % 2 = 1 THEN p_type END AS redditor FROM part")
def c33(s, d):
    link = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("https://old.reddit.com/r/"), "p_type", F.lit("/.rss"))).otherwise(F.concat(F.lit("https://www.reddit.com/user/"), "p_type", F.lit("/submitted/.rss")))
    return t(s, d, "part").select("p_partkey", url.subreddit(link).alias("subreddit"), url.redditor(link).alias("redditor"))


@query("c37_episodes", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS episode, regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g') || ' ep ' || lpad(p_size::VARCHAR, 4, '0') AS title FROM part")
def c37(s, d):
    title = F.concat("p_name", F.lit(" - Ep. "), F.lpad(F.col("p_size").cast("string"), 4, "0"))
    return t(s, d, "part").select("p_partkey", text.episode_number(title).alias("episode"), text.plain_title(title).alias("title"))


@query("c39_site_names", "SELECT p_partkey, p_name AS site FROM part")
def c39(s, d):
    return t(s, d, "part").select("p_partkey", text.site_name(F.concat("p_name", F.lit(" — a "), "p_brand", F.lit(" - site"))).alias("site"))


@query("d2_real_dates", "SELECT event_id, CASE WHEN event_id % 3 > 0 THEN ts END AS published FROM events")
def d2(s, d):
    k = F.col("event_id") % 3
    return t(s, d, "events").select("event_id", dates.real(F.when(k == 0, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).otherwise(F.col("ts"))).alias("published"))


@query("d4_months_in_urls", "SELECT page_id, CASE WHEN page_id % 12 > 0 AND page_id % 2 = 0 THEN make_date(2001 + page_id % 20, page_id % 12, 1) END AS month, CASE WHEN page_id % 12 > 0 AND page_id % 2 = 1 THEN make_date(2001 + page_id % 20, page_id % 12, 7) END AS day FROM pages")
def d4(s, d):
    k = F.col("page_id")
    link = F.concat(F.lit("http://a.b/"), (2001 + k % 20).cast("string"), F.lit("/"), (k % 12).cast("string"), F.when(k % 2 == 0, "/x").otherwise("/7/x"))
    return t(s, d, "pages").select("page_id", dates.month_in_url(link).alias("month"), dates.date_in_url(link).alias("day"))


@query("d5_effective_dates", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN ts WHEN 1 THEN ts - INTERVAL 1 DAY ELSE TIMESTAMP '2021-04-12 00:00:00' END AS effective FROM events")
def d5(s, d):
    k, null, ts = F.col("event_id") % 3, F.lit(None).cast("timestamp"), F.col("ts").cast("timestamp")
    published = F.when(k == 0, ts).otherwise(F.lit("1970-01-01 00:00:00").cast("timestamp"))
    updated = F.when(k == 1, ts - F.expr("interval 1 day")).otherwise(null)
    return t(s, d, "events").select("event_id", dates.effective(published, updated, F.lit("http://a.b/2021/04/12/x"), ts).cast("timestamp_ntz").alias("effective"))


META = {"og": '<meta[^>]+property="article:published_time"[^>]+content="([0-9-]{10})', "json-ld": '"datePublished"\\s*:\\s*"([0-9-]{10})', "time": '<time[^>]+datetime="([0-9-]{10})'}


@query("d7_page_dates", "SELECT page_id, CASE " + " ".join(f"WHEN nullif(regexp_extract(h, '{p}', 1), '') IS NOT NULL THEN '{n}'" for n, p in META.items()) + """ END AS source FROM (SELECT page_id, html || CASE page_id % 3 WHEN 0 THEN '<time class="a" datetime="2020-02-03T00:00">' WHEN 1 THEN '{"datePublished": "2020-01-02"}' ELSE '' END AS h FROM pages)""")
def d7(s, d):
    k = F.col("page_id") % 3
    page = F.concat("html", F.when(k == 0, '<time class="a" datetime="2020-02-03T00:00">').when(k == 1, '{"datePublished": "2020-01-02"}').otherwise(""))
    return t(s, d, "pages").select("page_id", dates.in_page(page)["source"].alias("source"))


@query("e9_site_search", f"SELECT page_id FROM pages WHERE ({HOST} = 'example.org' OR ends_with({HOST}, '.example.org')) AND contains(lower(html), 'the')")
def e9(s, d):
    return t(s, d, "pages").where(url.on_site(url.article_host(F.col("url")), "example.org") & F.lower("html").contains("the")).select("page_id")


@query("e15_short_stubs", "SELECT page_id, length(trim(regexp_replace(html, '<[^>]*>', '', 'g'))) < 120 AS stub, contains(url, '/shorts/') AS short FROM pages")
def e15(s, d):
    return t(s, d, "pages").select("page_id", (F.length(F.trim(F.regexp_replace("html", "<[^>]*>", ""))) < 120).alias("stub"), F.col("url").contains("/shorts/").alias("short"))


@query("e22_ad_assets", "SELECT p_partkey, p_size % 4 = 0 AS by_size, p_partkey % 3 < 2 AS by_link FROM part")
def e22(s, d):
    k = F.col("p_partkey") % 3
    link = F.when(k == 0, "https://ads2.example.com/a.png").when(k == 1, "http://a.b/img/x-superbanner.gif?x=1").otherwise("http://a.b/sponsors/banner.jpg")
    width = F.when(F.col("p_size") % 4 == 0, 728).otherwise(730)
    return t(s, d, "part").select("p_partkey", url.is_ad_size(width, F.lit(90)).alias("by_size"), url.is_ad(link).alias("by_link"))


@query("f12_ranked_sources", "SELECT page_id, url || ' ' || url || '-b ' || url || '-c' AS ranked FROM pages")
def f12(s, d):
    srcset = F.concat(F.col("url"), F.lit("-c 320w, "), F.col("url"), F.lit(" 2x, "), F.col("url"), F.lit("-b 1024w,"))
    return t(s, d, "pages").select("page_id", F.array_join(text.ranked_sources(srcset), " ").alias("ranked"))


@query("k2_safe_links", "SELECT p_partkey, p_partkey % 4 <> 3 AS safe FROM part")
def k2(s, d):
    k = F.col("p_partkey") % 4
    link = F.when(k == 0, "https://a.b").when(k == 1, "/x?y").when(k == 2, "mailto:a@b.c").otherwise("java\tscript:alert(1)")
    return t(s, d, "part").select("p_partkey", url.safe_link(link).alias("safe"))


BARE = "length(regexp_replace({}, '<[^>]+>', '', 'g'))"


@query("k8_link_index", f"""WITH p AS (SELECT page_id, html, regexp_extract_all(html, '(?is)<a\\b[^>]*>(.*?)</a>', 1) AS a FROM pages)
    SELECT page_id, len(a) >= 5 AND {BARE.format("html")} >= 200 AND coalesce(list_sum(list_transform(a, lambda x: {BARE.format("x")})), 0) >= {BARE.format("html")} * 0.02::DOUBLE AS is_index FROM p""")
def k8(s, d):
    return t(s, d, "pages").select("page_id", text.link_index(F.col("html"), 5, 0.02).alias("is_index"))
