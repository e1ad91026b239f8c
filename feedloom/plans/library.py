"""Queries over a library of feeds and entries: parsing, rules, duplicates, curation, maintenance, pages.

The library is a view over the driver's documents: a feed for each source, an entry for each document.
"""

import datetime

from pyspark.sql import functions as F

from feedloom.functions import clean, dates, page, text
from feedloom.functions import url as U
from feedloom.operators import lifecycle as L
from feedloom.plans.registry import query, t
from feedloom.sources import feeds, parse

ENTRIES = """entries AS (SELECT 'https://' || source || '.example.com/feed' AS feed, CAST(doc_id AS VARCHAR) AS id, doc_id AS number,
    trim(regexp_replace(substr(split_part(text, '.', 1), 1, 60), '[\\x00-\\x20]+', ' ', 'g')) AS title,
    'https://www.' || source || '.example.com/' || (2000 + doc_id % 24) || '/' || lpad(CAST(1 + doc_id % 12 AS VARCHAR), 2, '0') || '/' || lpad(CAST(1 + doc_id % 28 AS VARCHAR), 2, '0') || '/p' || (doc_id % 500) AS link,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id % 720 AS INTEGER)) AS published, text AS content, doc_id % 3 = 0 AS read, doc_id % 7 = 0 AS starred, lang, n_chars FROM documents WHERE text IS NOT NULL AND source IS NOT NULL)"""
FEEDS = "feeds AS (SELECT feed, min(number) AS number, 'Feed ' || min(lang) AS title, CASE WHEN feed LIKE '%1.example.com/feed' THEN 'ones' ELSE 'others' END AS folder FROM entries GROUP BY feed)"


def entries(s, d):
    n = lambda k, w: F.lpad((1 + F.col("doc_id") % k).cast("string"), w, "0")
    title = F.trim(F.regexp_replace(F.substring(F.split_part("text", F.lit("."), F.lit(1)), 1, 60), r"[\x00-\x20]+", " "))
    link = F.concat(F.lit("https://www."), "source", F.lit(".example.com/"), (2000 + F.col("doc_id") % 24).cast("string"), F.lit("/"), n(12, 2), F.lit("/"), n(28, 2), F.lit("/p"), (F.col("doc_id") % 500).cast("string"))
    return t(s, d, "documents").where("text is not null and source is not null").select(
        F.concat(F.lit("https://"), "source", F.lit(".example.com/feed")).alias("feed"), F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("number"), title.alias("title"), link.alias("link"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(doc_id % 720 as int))").alias("published"), F.col("text").alias("content"), (F.col("doc_id") % 3 == 0).alias("read"), (F.col("doc_id") % 7 == 0).alias("starred"), "lang", "n_chars",
    )


def subscribed(s, d):
    e = entries(s, d).groupBy("feed").agg(F.min("number").alias("number"), F.concat(F.lit("Feed "), F.min("lang")).alias("title"))
    return e.withColumn("folder", F.when(F.col("feed").endswith("1.example.com/feed"), "ones").otherwise("others"))


def feed_texts(s, d, newest=20):
    """Each feed as an RSS document of its newest entries, with a control character and white space before it."""
    e = L.top_per_group(entries(s, d), ["feed"], [F.desc("published"), F.desc("number")], newest)
    stamp = F.concat(F.date_format("published", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), feeds.escaped(value), F.lit(f"</{name}>"))
    body = F.concat(F.lit("<p>"), feeds.escaped(F.col("title")), F.lit('</p><script>x()</script><img src="/a.png" onclick="y()">'))
    item = F.concat(F.lit("<item>"), tag("guid", F.col("id")), tag("title", F.col("title")), tag("link", F.col("link")), tag("pubDate", stamp), tag("category", F.concat("lang", F.lit("; News"))), tag("description", body), F.lit("</item>"))
    items = e.groupBy("feed").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", item.alias("x")))), lambda r: r["x"]), "").alias("items"))  # at most ``newest``
    return items.select("feed", F.concat(F.lit('\x01 \n<?xml version="1.0"?><rss version="2.0"><channel><title>t</title>'), "items", F.lit("</channel></rss>")).alias("text"))


NEWEST = f"WITH {ENTRIES}, n AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY published DESC, number DESC) AS r FROM entries QUALIFY r <= 20) "


@query("b1_parsed_feeds", NEWEST + "SELECT feed, id, nullif(title, '') AS title, link, published FROM n")
def b1(s, d):
    return parse.parsed(feed_texts(s, d)).select("feed", "id", F.nullif("title", F.lit("")).alias("title"), "link", F.col("published").cast("timestamp_ntz").alias("published"))


@query("b2_ingested_feeds", NEWEST + """SELECT feed, id, replace(link, 'www.src1.example.com', 'src1.example.org') AS link, lang || ',news' AS tags,
    '<p>' || replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p><img src="' || regexp_extract(replace(link, 'www.src1.example.com', 'src1.example.org'), '^https://[^/]*') || '/a.png">' AS content FROM n
    QUALIFY row_number() OVER (PARTITION BY feed ORDER BY published DESC, id DESC) <= 10""")
def b2(s, d):
    found = parse.ingested(feed_texts(s, d), {"www.src1.example.com": "src1.example.org"}, 10)
    return found.select("feed", "id", "link", F.array_join("tags", ",").alias("tags"), "content")


@query("b8_remote_items", f"WITH {ENTRIES} SELECT feed, id, title, link, published, read, starred FROM entries")
def b8(s, d):
    """Other readers' answers, a third of the library each."""
    e = entries(s, d)
    sec = F.unix_micros(F.col("published").cast("timestamp")).cast("long") / 1_000_000
    state = F.array_compact(F.array(F.when(F.col("read"), parse.READ), F.when(F.col("starred"), parse.STARRED)))
    greader = F.to_json(F.struct(F.array(F.struct("id", "title", sec.cast("long").alias("published"), F.array(F.struct(F.col("link").alias("href"))).alias("canonical"), state.alias("categories"), F.struct(F.concat(F.lit("feed/"), "feed").alias("streamId")).alias("origin"))).alias("items")))
    ttrss = F.to_json(F.struct(F.array(F.struct(F.col("number").alias("id"), "title", sec.cast("long").alias("updated"), "link", (~F.col("read")).alias("unread"), F.col("starred").alias("marked"), F.col("feed").alias("feed_url"))).alias("content")))
    miniflux = F.to_json(F.struct(F.array(F.struct(F.col("number").alias("id"), "title", F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"), F.col("link").alias("url"), F.when(F.col("read"), "read").otherwise("unread").alias("status"), "starred", F.struct(F.col("feed").alias("feed_url")).alias("feed"))).alias("entries")))
    parts = [parse.remote_items(e.where(F.col("number") % 3 == k).select(body.alias("body")), kind) for k, (kind, body) in enumerate((("greader", greader), ("ttrss", ttrss), ("miniflux", miniflux)))]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.select("feed", "id", "title", "link", F.col("published").cast("timestamp_ntz").alias("published"), "read", "starred")


@query("b21_pushed", "SELECT event_type AS topic, user_id % 5 AS user, props AS body FROM events WHERE event_id % 4 <> 0 AND user_id % 5 > 0")
def b21(s, d):
    e = t(s, d, "events")
    sign = F.when(F.col("event_id") % 4 == 0, F.repeat(F.lit("0"), 64)).otherwise(F.concat(F.lit("sha256="), parse.signed_by(b"key", F.col("props"))))
    topic = F.concat("event_type", F.lit("/"), (F.col("user_id") % 5).cast("string"))
    subscribers = e.select(topic.alias("topic"), (F.col("user_id") % 5).alias("user"), (F.col("user_id") % 5 > 0).alias("active"))
    out = parse.pushed(e.select(topic.alias("topic"), F.col("props").alias("body"), sign.alias("signature")), subscribers, b"key")
    return out.select(F.split_part("topic", F.lit("/"), F.lit(1)).alias("topic"), "user", "body")


@query("b23_listing_entries", f"WITH {ENTRIES} SELECT lang AS subreddit, 't3_' || id AS id, title, 'https://www.reddit.com/r/' || lang || '/' || id AS link, CASE WHEN number % 2 = 0 THEN link END AS target FROM entries")
def b23(s, d):
    path = F.concat(F.lit("/r/"), "lang", F.lit("/"), "id")
    own = F.struct(F.concat(F.lit("t3_"), "id").alias("name"), "title", path.alias("permalink"), F.when(F.col("number") % 2 == 0, F.col("link")).otherwise(F.concat(F.lit("https://www.reddit.com"), path)).alias("url"), F.lit(1.7e9).alias("created_utc"), F.col("lang").alias("subreddit"))
    body = F.to_json(F.struct(F.struct(F.array(F.struct(own.alias("data"))).alias("children")).alias("data")))
    return parse.listing_entries(entries(s, d).select(body.alias("body"))).select("subreddit", "id", "title", "link", "target")


@query("b24_thumbnails", f"WITH {ENTRIES} SELECT id, CASE WHEN number % 4 = 0 THEN NULL WHEN number % 4 = 1 THEN link || '/small.jpg' ELSE link || '/large.jpg' END AS thumbnail FROM entries")
def b24(s, d):
    media = lambda name, w: F.concat(F.lit('<media:content medium="image" url="'), "link", F.lit(f'/{name}.jpg" width="{w}" height="{w}"/>'))
    own = F.concat(F.when(F.col("number") % 4 > 0, media("small", 80)).otherwise(F.lit('<media:content medium="video" url="v.mp4" width="900"/>')), F.when(F.col("number") % 4 > 1, media("large", 640)).otherwise(""))
    body = F.concat(F.lit('<rss xmlns:media="http://search.yahoo.com/mrss/"><channel><item><guid>'), "id", F.lit("</guid>"), own, F.lit("</item></channel></rss>"))
    return parse.parsed(entries(s, d).select(body.alias("text"))).select("id", "thumbnail")


@query("c15_split_terms", f"WITH {ENTRIES} SELECT id, lang || '|R&D|x, y' AS terms FROM entries")
def c15(s, d):
    return entries(s, d).select("id", F.array_join(parse.split_terms(F.concat("lang", F.lit("; R&amp;D ;; x, y"))), "|").alias("terms"))


@query("c16_categories", f"WITH {ENTRIES} SELECT id, CASE number % 4 WHEN 0 THEN 'term,' WHEN 1 THEN 'label,' WHEN 2 THEN 'text,' ELSE 'scheme,' END || lang AS names FROM entries")
def c16(s, d):
    kind = F.col("number") % 4
    own = F.struct(F.when(kind == 2, "text").alias("_VALUE"), F.when(kind == 0, "term").otherwise(" ").alias("_term"), F.when(kind == 1, "label").alias("_label"), F.lit("scheme").alias("_scheme"))
    plain = F.struct(F.col("lang").alias("_VALUE"), *[F.lit(None).cast("string").alias(c) for c in ("_term", "_label", "_scheme")])
    return entries(s, d).select("id", F.array_join(parse.categories(F.array(own, plain).cast(f"array<{parse.CATEGORY}>")), ",").alias("names"))


@query("c34_source_names", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'tag:rust' WHEN 1 THEN 'user:ann' END AS source, CASE WHEN page_id % 2 = 0 THEN 'some-one' END AS artist FROM pages")
def c34(s, d):
    n = F.col("page_id")
    a = F.when(n % 3 == 0, "https://dev.to/t/rust/").when(n % 3 == 1, "https://dev.to/ann?x=1").otherwise("https://dev.to.example.org/ann")
    b = F.when(n % 2 == 0, "https://www.deviantart.com/Some-One/gallery").otherwise(F.col("url"))
    return t(s, d, "pages").select("page_id", U.devto_source(a).alias("source"), U.deviantart_user(b).alias("artist"))


@query("d6_visible_dates", "SELECT page_id, DATE '2023-01-01' + CAST(page_id % 300 AS INTEGER) AS day FROM pages")
def d6(s, d):
    day = F.date_add(F.lit(datetime.date(2023, 1, 1)), (F.col("page_id") % 300).cast("int"))
    shown = F.when(F.col("page_id") % 3 == 0, F.date_format(day, "MMMM d, yyyy")).when(F.col("page_id") % 3 == 1, F.date_format(day, "d MMM yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    body = F.concat(F.lit("<p>On 3 May 2022 it rained.</p><span>3 May 1901</span>"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<i>4 May 2021</i><span class="post-date">Published '), shown, F.lit("</span>"))).otherwise(F.concat(F.lit("<b> "), shown, F.lit(" </b>"))))
    return t(s, d, "pages").select("page_id", page.visible_date(body, F.lit(datetime.date(2024, 2, 1))).alias("day"))


@query("d8_d9_resolved_dates", f"WITH {ENTRIES} SELECT id, CASE number % 4 WHEN 0 THEN DATE '2020-02-02' WHEN 1 THEN DATE '2021-03-03' ELSE make_date(2000 + CAST(number % 24 AS INTEGER), 1 + CAST(number % 12 AS INTEGER), 1 + CAST(number % 28 AS INTEGER)) END AS day, CASE number % 4 WHEN 0 THEN 'index' WHEN 1 THEN 'og' ELSE 'link' END AS source FROM entries")
def d9(s, d):
    """A site's index as a table of links, else the page, else the link."""
    e = entries(s, d)
    index = e.where("number % 4 = 0").select("id", F.lit(datetime.date(2020, 2, 2)).alias("listed"))
    html = F.when(F.col("number") % 4 == 1, '<meta property="article:published_time" content="2021-03-03T10:00">').otherwise("<p>x</p>")
    found = page.resolved_date(html, F.col("link"), F.lit(datetime.date(2024, 2, 1)), F.col("listed"), dates.in_page(html))
    return e.join(index, "id", "left").select("id", found.alias("f")).select("id", F.col("f.date").alias("day"), "f.source")


@query("e21_file_assets", f"WITH {ENTRIES} SELECT id, 'pdf' AS ending FROM entries WHERE number % 5 = 1")
def e21(s, d):
    of = F.array(F.lit("/a.png"), F.lit("/b.PDF?x=1"), F.lit("/c"), F.lit("/d.pdf"), F.lit("/e.html"))
    mime = F.array(F.lit("image/png"), F.lit("application/pdf"), F.lit(None).cast("string"), F.lit("text/html; charset=utf-8"), F.lit(None).cast("string"))
    k = (F.col("number") % 5).cast("int")
    return L.file_assets(entries(s, d).select("id", F.concat("link", F.get(of, k)).alias("url"), F.get(mime, k).alias("mime"))).select("id", "ending")


@query("f11_rotated_users", "WITH u AS (SELECT DISTINCT user_id FROM events), n AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS p, count(*) OVER () AS c FROM u) SELECT user_id, CAST((p - 7 % c + c) % c AS BIGINT) AS turn FROM n")
def f11(s, d):
    return L.rotated(t(s, d, "events").select("user_id").distinct(), 7, "user_id")


@query("g4_surrogates", f"""WITH {ENTRIES}, m AS (SELECT feed, id, number FROM entries WHERE number % 2 = 0), n AS (SELECT feed, id, (SELECT max(number) FROM m) + row_number() OVER (ORDER BY feed, id) AS number FROM entries WHERE number % 2 = 1)
    SELECT id, CAST(number AS BIGINT) AS number FROM m UNION ALL SELECT id, CAST(number AS BIGINT) FROM n""")
def g4(s, d):
    e = entries(s, d)
    known = e.where("number % 2 = 0").select("feed", "id", "number")
    every = known.unionByName(L.new_surrogates(e, known))
    return L.with_surrogates(e.select("feed", "id"), every).select("id", "number")


@query("g9_ghost_state", f"WITH {ENTRIES}, {FEEDS} SELECT feed, count(*) AS n FROM entries WHERE feed NOT IN (SELECT feed FROM feeds WHERE folder = 'others') GROUP BY feed")
def g9(s, d):
    state = entries(s, d).groupBy("feed").agg(F.count("*").alias("n"))
    return L.ghosts(state, subscribed(s, d).where("folder = 'others'"))


@query("g10_uncurated", f"WITH {ENTRIES}, {FEEDS} SELECT id FROM entries JOIN feeds USING (feed) WHERE folder = 'ones' AND NOT starred AND lang <> 'de'")
def g10(s, d):
    e = entries(s, d)
    return L.uncurated(e.select("feed", "id"), subscribed(s, d).where("folder = 'others'"), e.where("starred"), e.where("lang = 'de'")).select("id")


@query("g13_episode_audio", "SELECT page_id AS id, CASE page_id % 3 WHEN 0 THEN 'a' || page_id WHEN 1 THEN 'b' || page_id END AS url, CASE page_id % 3 WHEN 0 THEN 'title' WHEN 1 THEN 'number' END AS how FROM pages")
def g13(s, d):
    n = F.col("page_id")
    p = t(s, d, "pages")
    letters = F.translate(F.translate(n.cast("string"), "01234", "abcde"), "56789", "fghij")
    episodes = p.select(n.alias("id"), F.when(n % 3 == 0, F.concat(F.lit("The Show: "), letters)).when(n % 3 == 1, F.concat(F.lit("Ep. "), n.cast("string"))).otherwise("none").alias("title"))
    a = p.where("page_id % 3 = 0").select(F.concat(F.lit("the show — "), F.upper(letters)).alias("title"), F.concat(F.lit("a"), n.cast("string")).alias("url"), n.alias("place"))
    b = p.where("page_id % 3 = 1").select(F.concat(F.lit("Episode "), n.cast("string"), F.lit(": words")).alias("title"), F.concat(F.lit("b"), n.cast("string")).alias("url"), n.alias("place"))
    return L.episode_audio(episodes, a.unionByName(b).unionByName(b.withColumn("place", F.col("place") + 100_000).withColumn("url", F.lit("later"))))


@query("i1_keyword_rules", f"""WITH {ENTRIES}, {FEEDS} SELECT 'r1' AS rule_id, 'highlight' AS action, id FROM entries WHERE contains(lower(title), 'the') OR contains(lower(title), 'die')
    UNION ALL SELECT 'r2', 'mark_as_read', id FROM entries JOIN feeds USING (feed) WHERE folder = 'ones' AND regexp_matches(content, '(?i)[0-9]{{3}}')
    UNION ALL SELECT 'r3', 'deliver', id FROM entries WHERE feed = 'https://src0.example.com/feed' AND (contains(lower(title || chr(10) || content), 'que'))""")
def i1(s, d):
    rules = [("r1", "global", "", "title", "the, die", False, "highlight", True), ("r2", "folder", "ones", "content", "[0-9]{3}", True, "mark_as_read", True), ("r3", "feed", "https://src0.example.com/feed", "both", "que", False, "deliver", True), ("r4", "global", "", "both", "e", False, "deliver", False)]
    rules = s.createDataFrame(rules, "rule_id string, scope string, scope_id string, search_in string, keyword string, is_regex boolean, action string, enabled boolean")
    return L.keyword_hits(entries(s, d), subscribed(s, d), rules).select("rule_id", "action", "id")


@query("i4_deduplicate_rule", f"""WITH {ENTRIES}, k AS (SELECT *, regexp_extract(link, '[^/]*$') AS slug, feed AS host FROM entries WHERE feed <> 'https://src3.example.com/feed'),
    g AS (SELECT *, CASE WHEN epoch(published)::BIGINT - lag(epoch(published)::BIGINT) OVER w <= 1080000 THEN 0 ELSE 1 END AS b FROM k WHERE length(slug) >= 3 WINDOW w AS (PARTITION BY host, slug ORDER BY published, feed, id)),
    r AS (SELECT *, sum(b) OVER (PARTITION BY host, slug ORDER BY published, feed, id ROWS UNBOUNDED PRECEDING) AS run FROM g),
    f AS (SELECT *, first_value(id) OVER (PARTITION BY host, slug, run ORDER BY published, feed, id) AS kept_id FROM r) SELECT id, kept_id FROM f WHERE id <> kept_id""")
def i4(s, d):
    return L.duplicates(entries(s, d), "slug", 300, excluded=["https://src3.example.com/feed"]).select("id", "kept_id")


@query("g16_title_groups", f"""WITH {ENTRIES}, w AS (SELECT *, trim(regexp_replace(lower(title), ' +', ' ', 'g')) AS key FROM entries WHERE regexp_full_match(title, '[a-zA-Z ]*')),
    k AS (SELECT * FROM w WHERE len(string_split(key, ' ')) >= 3 AND key <> ''), f AS (SELECT id, first_value(id) OVER (PARTITION BY key ORDER BY published, feed, id) AS kept_id FROM k) SELECT id, kept_id FROM f WHERE id <> kept_id""")
def g16(s, d):
    return L.duplicates(entries(s, d).where(F.col("title").rlike("^[a-zA-Z ]*$")), "title", 1_000_000, least=3).select("id", "kept_id")


@query("g20_cleanup_passes", f"""WITH {ENTRIES}, e AS (SELECT * FROM entries WHERE feed <> 'https://src2.example.com/feed'), a AS (SELECT *, row_number() OVER (PARTITION BY feed, replace(link, 'https://www.', '') ORDER BY published, id) AS n FROM e),
    b AS (SELECT *, row_number() OVER (PARTITION BY feed, regexp_extract(link, '[^/]*$') ORDER BY published, feed, id) AS m FROM a WHERE n = 1 AND length(regexp_extract(link, '[^/]*$')) >= 3)
    SELECT id, 'feed' AS mode FROM a WHERE n > 1 UNION ALL SELECT id, 'library' FROM b WHERE m > 1""")
def g20(s, d):
    return L.cleanup(entries(s, d), "https://src2.example.com/feed").select("id", "mode")


@query("g22_duplicate_feeds", """WITH b AS (SELECT page_id, 'https://f' || page_id || '.org/feed' AS base FROM pages WHERE page_id % 11 > 0), x AS (SELECT CASE page_id % 5 WHEN 0 THEN 'same_folder' WHEN 1 THEN 'cross_folder' WHEN 2 THEN 'query_pairs' WHEN 3 THEN 'title_groups' ELSE 'upgradable' END AS tier,
    CASE page_id % 5 WHEN 3 THEN 'feed ' || page_id WHEN 4 THEN substr(base, 9) ELSE base END AS key, base, CASE page_id % 5 WHEN 0 THEN base || '/' WHEN 1 THEN base || '/' WHEN 2 THEN base || '?x=1' WHEN 3 THEN 'https://g' || page_id || '.org/rss' ELSE 'http://f' || page_id || '.org/feed' END AS other FROM b)
    SELECT tier, key, CASE WHEN tier = 'upgradable' THEN other || ' ' || base ELSE base || ' ' || other END AS members FROM x""")
def g22(s, d):
    n, k = F.col("page_id").cast("string"), F.col("page_id") % 5
    base = F.concat(F.lit("https://f"), n, F.lit(".org/feed"))
    other = F.when(k < 2, F.concat(base, F.lit("/"))).when(k == 2, F.concat(base, F.lit("?x=1"))).when(k == 3, F.concat(F.lit("https://g"), n, F.lit(".org/rss"))).otherwise(F.concat(F.lit("http://f"), n, F.lit(".org/feed")))
    p = t(s, d, "pages")
    title = F.concat(F.lit("Feed "), n)
    rows = p.select(base.alias("feed"), title.alias("title"), F.lit("a").alias("folder")).unionByName(p.select(other.alias("feed"), F.when(k == 3, F.upper(title)).otherwise(F.concat(title, F.lit("b"))).alias("title"), F.when(k == 1, "b").otherwise("a").alias("folder")))
    names = F.when(k == 0, "same_folder").when(k == 1, "cross_folder").when(k == 2, "query_pairs").when(k == 3, "title_groups").otherwise("upgradable")
    gone = p.where("page_id % 11 = 0").select(names.alias("tier"), F.when(k == 3, F.lower(title)).when(k == 4, F.substring(base, 9, 100)).otherwise(base).alias("key"))
    return L.duplicate_feeds(rows, gone)


@query("g21_saved_tiers", f"""WITH {ENTRIES}, s AS (SELECT * FROM entries), a AS (SELECT *, row_number() OVER w AS n, first_value(id) OVER w AS k FROM s WINDOW w AS (PARTITION BY link ORDER BY published, feed, id)),
    b AS (SELECT *, row_number() OVER w AS m, first_value(id) OVER w AS j FROM a WHERE n = 1 AND length(regexp_extract(link, '[^/]*$')) >= 3 WINDOW w AS (PARTITION BY feed, regexp_extract(link, '[^/]*$') ORDER BY published, feed, id))
    SELECT id, k AS kept_id, 'confirmed' AS tier FROM a WHERE n > 1 UNION ALL SELECT id, j, 'confirmed' FROM b WHERE m > 1""")
def g21(s, d):
    """Titles hold no word here, so that nothing is merely possible; tests cover that tier."""
    return L.saved_duplicates(entries(s, d).withColumn("title", F.lit(""))).select("id", "kept_id", "tier")


@query("j1_prune_with_tombstones", f"WITH {ENTRIES}, p AS (SELECT * FROM entries WHERE read AND published < TIMESTAMP '2024-01-20 00:00:00' AND NOT starred AND feed <> 'https://src2.example.com/feed') SELECT id, published AS read_at FROM p")
def j1(s, d):
    e = entries(s, d)
    state = e.select("feed", "id", "read", F.when(F.col("number") % 2 == 0, F.col("published")).alias("read_at"), F.col("published").alias("read_modified"))
    gone, left = L.pruned(state, e.where("starred"), F.expr("timestamp_ntz'2024-01-20 00:00:00'"), "https://src2.example.com/feed")
    return gone.select("id", "read_at")


@query("j4_purgeable", f"WITH {ENTRIES} SELECT id FROM entries WHERE number % 4 = 0 AND NOT starred")
def j4(s, d):
    e = entries(s, d)
    return L.purgeable(e.select("feed", "id"), e.where("number % 4 <> 0"), e.where("starred")).select("id")


@query("j6_reattached", f"""WITH {ENTRIES}, live AS (SELECT link, min(id) AS id, count(*) AS n FROM entries WHERE number % 3 <> 0 GROUP BY link HAVING count(*) = 1),
    o AS (SELECT e.id AS old_id, l.id, e.published FROM entries e JOIN live l USING (link) WHERE number % 3 = 0 AND l.id NOT IN (SELECT id FROM entries WHERE number % 3 < 2))
    SELECT old_id, id FROM o QUALIFY row_number() OVER (PARTITION BY id ORDER BY published DESC, old_id) = 1""")
def j6(s, d):
    e = entries(s, d)
    captures = e.where("number % 3 in (0, 1)").select("feed", "id", "link", F.col("published").alias("saved_at"))
    return L.reattached(captures, e.where("number % 3 <> 0")).select("old_id", "id")


@query("j6_moved_captures", f"""WITH {ENTRIES}, u AS (SELECT link, min(id) AS id FROM entries GROUP BY link HAVING count(*) = 1) SELECT 'x' || number AS old_id, u.id FROM entries JOIN u USING (link) WHERE number % 3 = 0 AND number % 6 <> 0""")
def j6_moved(s, d):
    """Captures of a feed that is gone, by other spellings of their links; half of the entries have a capture already."""
    e = entries(s, d)
    old = e.where("number % 3 = 0").select(F.lit("https://gone.example.com/feed").alias("feed"), F.concat(F.lit("x"), "id").alias("id"), F.replace("link", F.lit("https://www."), F.lit("http://")).alias("link"), F.col("published").alias("saved_at"))
    return L.reattached(old.unionByName(e.where("number % 6 = 0").select("feed", "id", "link", F.col("published").alias("saved_at"))), e).select("old_id", "id")


@query("j9_reclaimed", "SELECT event_id, CASE WHEN event_type = 'view' AND ts < TIMESTAMP '2024-01-15 00:00:00' THEN CASE WHEN user_id % 4 >= 3 THEN 'failed' ELSE 'pending' END WHEN event_type = 'view' THEN 'in_progress' ELSE 'complete' END AS status FROM events")
def j9(s, d):
    q = t(s, d, "events").select("event_id", F.when(F.col("event_type") == "view", "in_progress").otherwise("complete").alias("status"), F.col("ts").alias("started"), (F.col("user_id") % 4).alias("tries"))
    return L.reclaimed(q, F.expr("timestamp_ntz'2024-01-15 00:30:00'")).select("event_id", "status")


@query("j10_repaired_dates", f"WITH {ENTRIES} SELECT id, make_date(2000 + CAST(number % 24 AS INTEGER), 1 + CAST(number % 12 AS INTEGER), 1 + CAST(number % 28 AS INTEGER)) AS day, 'link' AS source FROM entries WHERE number % 5 = 0")
def j10(s, d):
    e = entries(s, d).withColumn("published", F.when(F.col("number") % 5 == 0, F.expr("timestamp_ntz'1970-01-01 00:00:00'")).otherwise(F.col("published")))
    return L.repaired_dates(e).select("id", F.col("published").alias("day"), "source")


@query("j11_repaired_text", f"WITH {ENTRIES} SELECT id, title, replace(link, 'www.src1.example.com', 'src1.example.org') AS link, lang || ',r-d' AS tags FROM entries WHERE number % 2 = 0 OR feed = 'https://src1.example.com/feed'")
def j11(s, d):
    title = F.when(F.col("number") % 2 == 0, F.concat(F.replace(F.col("title"), F.lit("&"), F.lit("&amp;")), F.lit("&#32;"))).otherwise(F.concat("title", F.lit(" ")))
    tags = F.when(F.col("number") % 2 == 0, F.array(F.concat("lang", F.lit("; R/D")))).otherwise(F.array("lang", F.lit("r-d")))
    e = entries(s, d).where(~F.col("title").contains("&")).withColumn("title", title).withColumn("tags", tags)
    rest = entries(s, d).where(F.col("title").contains("&")).withColumn("tags", tags).withColumn("title", F.concat(F.replace(F.col("title"), F.lit("&"), F.lit("&amp;")), F.lit("&#32;")))
    rest = rest.where("number % 2 = 0 or feed = 'https://src1.example.com/feed'")
    out = L.repaired_text(e.unionByName(rest), "www.src1.example.com", "src1.example.org")
    return out.select("id", F.regexp_replace("title", " $", "").alias("title"), "link", F.array_join("tags", ",").alias("tags"))


@query("j12_boilerplate_damage", f"WITH {ENTRIES}, e AS (SELECT *, number % 5 < 2 AS damaged FROM entries), s AS (SELECT feed FROM e WHERE damaged GROUP BY feed HAVING count(DISTINCT link) >= 3) SELECT id FROM e WHERE damaged AND feed IN (SELECT feed FROM s)")
def j12(s, d):
    body = F.when(F.col("number") % 5 < 2, F.repeat(F.lit("Please accept our cookies. "), 9)).otherwise(F.concat(F.col("id"), F.lit(" its own words")))
    return L.boilerplate_damage(entries(s, d).withColumn("content", body)).select("id")


@query("j13_rehomed", f"""WITH {ENTRIES}, r AS (SELECT link, min((feed, id)) AS k FROM entries GROUP BY link) SELECT e.id AS old_id, r.k[2] AS id, e.number % 2 = 0 AND (SELECT bool_or(x.starred) FROM entries x WHERE x.id = r.k[2]) AS merged FROM entries e JOIN r USING (link) WHERE e.number % 2 = 0""")
def j13(s, d):
    e = entries(s, d)
    own = e.where("number % 2 = 0").withColumn("feed", F.lit("articles"))
    stars = own.select("feed", "id").unionByName(e.where("starred").select("feed", "id"))
    return L.rehomed(stars, e.unionByName(own), "articles").select("old_id", "id", "merged")


@query("k3_rebuilt_styles", "SELECT page_id, 'text-align: center; font-weight: ' || (100 + page_id % 9) AS style, CAST(page_id % 700 AS INTEGER) AS width, CAST(NULL AS INTEGER) AS height, 'left' AS align FROM pages")
def k3(s, d):
    css = F.concat(F.lit("TEXT-ALIGN: center; position:fixed; width: "), (F.col("page_id") % 700).cast("string"), F.lit("px; height: 50%; float:LEFT; background: url(x); font-weight:"), (100 + F.col("page_id") % 9).cast("string"))
    return t(s, d, "pages").select("page_id", page.rebuilt_style(css).alias("r")).select("page_id", "r.style", "r.width", "r.height", "r.align")


@query("k5_sizes_reapplied", """SELECT page_id, '<p><img width="' || (page_id % 90) || '" height="7" src="/a+(1).png" alt="x"><img src="/b.png"/><img src="/a+(1).png" width="3"></p>' AS html FROM pages""")
def k5(s, d):
    size = F.concat(F.lit('<img src="/a+(1).png" width="'), (F.col("page_id") % 90).cast("string"), F.lit('" height="7"><img src="/b.png" width="5">'))
    after = page.sizes_reapplied(F.lit('<p><img src="/a+(1).png" alt="x"><img src="/b.png"/><img src="/a+(1).png" width="3"></p>'), page.image_sizes(size))
    tidy = F.regexp_replace(after, r'<img src="/a\+\(1\)\.png" alt="x" width="(\d+)" height="(\d+)">', '<img width="$1" height="$2" src="/a+(1).png" alt="x">')
    return t(s, d, "pages").select("page_id", F.regexp_replace(tidy, r'<img width="(\d+)" height="7" src="/a\+\(1\)\.png" alt="x">', '<img width="$1" height="7" src="/a+(1).png" alt="x">').alias("html"))


@query("k6_clean_svg", """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '<svg viewBox="0 0 9 9" xmlns="http://www.w3.org/2000/svg" width="9" height="9"><path d="M' || page_id || '"></path></svg>' END AS svg FROM pages""")
def k6(s, d):
    n = F.col("page_id").cast("string")
    raw = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<?xml version="1.0"?><svg viewBox="0 0 9 9" onload="x()"><script>a</script><path d="M'), n, F.lit('" style="fill:url(http://x)"/><use href="#a"/><foreignObject><b>x</b></foreignObject></svg>'))).otherwise(F.concat(F.lit("<p>"), n))
    return t(s, d, "pages").select("page_id", clean.clean_svg(raw).alias("svg"))


@query("k7_page_tags", "SELECT page_id, 'alpha,key-' || (page_id % 9) || ',beta,gamma' AS tags FROM pages")
def k7(s, d):
    html = F.concat(F.lit('<meta property="article:tag" content="Alpha"><script type="application/ld+json">{"keywords":["Key '), (F.col("page_id") % 9).cast("string"), F.lit('","alpha"]}</script><meta name="keywords" content="beta, alpha"><a rel="nofollow tag" href="/x">Gamma</a><a href="/2019" rel="tag">2019</a><a rel="tag">2020</a><a rel="tag">2021</a><a href="/about">About</a>'))
    return t(s, d, "pages").select("page_id", F.array_join(page.page_tags(html), ",").alias("tags"))


@query("k10_replayed_edits", "SELECT page_id, '<p>keep ' || page_id || '</p><i>x</i><i>x</i>' AS html, 1 AS applied, 2 AS unmatched FROM pages")
def k10(s, d):
    html = F.concat(F.lit("<p>keep "), F.col("page_id").cast("string"), F.lit("</p><div>advert</div><i>x</i><i>x</i>"))
    edit = lambda a, p: F.struct(F.lit(a).alias("action"), F.lit(p).alias("passage"))
    e = page.edited(html, F.array(edit("remove", "<div>advert</div>"), edit("remove", "<i>x</i>"), edit("remove", "not there")))
    return t(s, d, "pages").select("page_id", e.alias("e")).select("page_id", "e.html", "e.applied", "e.unmatched")


@query("k12_missing_embeds", "SELECT page_id, 'https://www.youtube.com/embed/abcdefghi' || lpad(CAST(page_id % 90 AS VARCHAR), 2, '0') || ' https://x.org/a.mp3' AS embeds FROM pages")
def k12(s, d):
    two = F.lpad((F.col("page_id") % 90).cast("string"), 2, "0")
    source = F.concat(F.lit('<iframe src="https://www.youtube.com/embed/abcdefghi'), two, F.lit('"></iframe><iframe src="https://www.youtube.com/embed/ABCDEFGHIJK"></iframe><audio src="https://x.org/a.mp3"></audio><a href="https://x.org/b.mp3">'))
    content = F.lit('<iframe src="https://www.youtube.com/embed/ABCDEFGHIJK"></iframe> <a href="https://x.org/b.mp3">')
    return t(s, d, "pages").select("page_id", F.array_join(page.missing_embeds(source, content), " ").alias("embeds"))


@query("k13_site_plugins", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN '<p>body</p>' WHEN 1 THEN '<h1>t</h1><p>body</p>' ELSE '<h1>t</h1><div class=\"big ad\">buy</div><section class=\"post-body\"><p>body</p></section>' END AS html FROM pages")
def k13(s, d):
    whole = '<h1>t</h1><div class="big ad">buy</div><section class="post-body"><p>body</p></section>'
    link = F.when(F.col("page_id") % 3 == 0, "https://www.one.org/x").when(F.col("page_id") % 3 == 1, "https://blog.two.org/x").otherwise("https://notone.org/x")
    plugins = [page.SitePlugin("one.org", ("ad",), "post-body"), page.SitePlugin("two.org", ("ad",))]
    out = page.with_plugins(F.lit(whole), link, plugins)
    return t(s, d, "pages").select("page_id", F.when(F.col("page_id") % 3 == 1, F.regexp_replace(out, r"</?section[^>]*>", "")).otherwise(out).alias("html"))


@query("k14_readable", f"WITH {ENTRIES}, e AS (SELECT id, trim(regexp_replace(regexp_replace(content, '[<>&]', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS body FROM entries WHERE NOT regexp_matches(content, '[^\\x20-\\x7E\\n\\t]')) SELECT id, CASE WHEN length(body) >= 60 THEN body END AS body FROM e")
def k14(s, d):
    own = F.regexp_replace("content", "[<>&]", " ")
    html = F.concat(F.lit('<nav><p>Home and much more that is said in the menu of the site, again and again, for ever</p></nav><div class="x related"><p>Related: other articles with rather long names that say nothing about this one</p></div><article><p>'), own, F.lit('</p><p><a href="/">read all of the other things on this page, in a link that is long enough to count</a></p></article>'))
    return entries(s, d).where(~F.col("content").rlike(r"[^\x20-\x7E\n\t]")).select("id", page.readable(html).alias("body"))


@query("k14_markup", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'html' WHEN 1 THEN 'bbcode' WHEN 2 THEN 'markdown' ELSE 'plain' END AS kind FROM pages")
def k14b(s, d):
    kinds = F.array(F.lit("<p>x</p>"), F.lit("[b]x[/b] and [url=y]z[/url]"), F.lit("# Title\n\nsome **bold** words"), F.lit("just text, a * b * c"))
    return t(s, d, "pages").select("page_id", page.markup(F.get(kinds, (F.col("page_id") % 4).cast("int"))).alias("kind"))


@query("l2_l6_lead_images", "SELECT page_id, 'https://x.org/photo-' || page_id || '.jpg' AS lead, 'https://x.org/comics/today.png' AS comic FROM pages")
def l2(s, d):
    html = F.concat(F.lit('<img src="https://x.org/pixel.gif" width="1" height="1"><img class="avatar" src="https://x.org/me.jpg" width="400" height="400"><img src="https://x.org/wide.jpg" width="900" height="60"><img src="data:image/gif;base64,AA" data-src="https://x.org/photo-'), F.col("page_id").cast("string"), F.lit('.jpg" width="800" height="600" alt="A large photo"><img src="https://x.org/comics/today.png" width="300" height="200"><img src="https://gravatar.com/x.jpg" width="900" height="900">'))
    return t(s, d, "pages").select("page_id", page.lead(html).alias("lead"), page.lead(html, "comic").alias("comic"))


@query("l8_l11_image_strategies", """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://p.org/own.jpg' WHEN 1 THEN 'https://m.org/media.jpg' WHEN 2 THEN 'https://x.org/in.jpg' WHEN 3 THEN 'https://x.org/src.jpg' END AS url,
    CASE page_id % 5 WHEN 0 THEN 'panel' WHEN 1 THEN 'media' WHEN 2 THEN 'inline' WHEN 3 THEN 'source' END AS strategy FROM pages""")
def l8(s, d):
    k = F.col("page_id") % 5
    plugin = page.ImagePlugin("panel", lambda link: U.on_site(U.article_host(link), "p.org"), lambda html: page.first(html, r'<main data-own="([^"]+)"'), skip_source=lambda link: U.on_site(U.article_host(link), "q.org"))
    link = F.when(k == 0, "https://www.p.org/1").when(k == 4, "https://q.org/1").otherwise("https://z.org/1")
    html = F.when(k == 2, '<img src="https://x.org/in.jpg">').otherwise("<p>x</p>")
    source = F.lit('<main data-own="https://p.org/own.jpg"><aside><img src="https://x.org/aside.jpg"></aside><img src="https://x.org/src.jpg"></main>')
    media = F.when(k == 1, "https://m.org/media.jpg").when(k == 2, "https://m.org/spacer.gif")
    return t(s, d, "pages").select("page_id", page.resolved_image(link, media, html, source, [plugin]).alias("r")).select("page_id", "r.url", "r.strategy")


@query("l9_images_to_look_up", "SELECT page_id FROM pages WHERE page_id % 4 IN (0, 1)")
def l9(s, d):
    p = t(s, d, "pages").select("page_id")
    k = F.col("page_id") % 4
    cache = p.where(k > 0).select("page_id", F.when(k == 3, "u").alias("url"), F.when(k == 1, F.expr("timestamp_ntz'2024-01-01 00:00:00'")).otherwise(F.expr("timestamp_ntz'2024-01-09 20:00:00'")).alias("checked"))
    return page.to_look_up(p, cache, "page_id", F.expr("timestamp_ntz'2024-01-10 00:00:00'"))


@query("l10_without_chrome", """SELECT page_id, '<main><p>body ' || page_id || '</p></main>' AS html FROM pages""")
def l10(s, d):
    html = F.concat(F.lit("<nav>n</nav><main><p>body "), F.col("page_id").cast("string"), F.lit('</p><div class="post-share"><div class="social">x</div>y</div><section id="comments"><p>c</p></section></main><footer>f</footer>'))
    return t(s, d, "pages").select("page_id", page.without_chrome(html).alias("html"))


@query("m13_fresh_cache", "SELECT user_id, count(*) AS value FROM events GROUP BY user_id HAVING count(*) % 2 = 0")
def m13(s, d):
    n = t(s, d, "events").groupBy("user_id").agg(F.count("*").alias("value"))
    current = n.select("user_id", (F.col("value") % 2).alias("generation"))
    return L.fresh(n.withColumn("generation", F.lit(0)), current, "user_id").select("user_id", "value")


@query("m14_stalled_jobs", """WITH e AS (SELECT user_id, ts, value, max(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM (SELECT user_id, ts, max(value) AS value FROM events GROUP BY ALL)),
    l AS (SELECT user_id, max(ts) AS since FROM e WHERE m IS NULL OR value > m GROUP BY user_id) SELECT user_id, since FROM l WHERE since < TIMESTAMP '2024-01-21 00:00:00'""")
def m14(s, d):
    p = t(s, d, "events").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return L.stalled(p, "user_id", "ts", "value", F.expr("timestamp_ntz'2024-01-31 00:00:00'"), 864_000)


@query("m15_due_maintenance", "SELECT c_custkey AS user FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 0")
def m15(s, d):
    """At 08:30 UTC it is 3 in New York, 9 in Berlin and 17 in Tokyo; even users ran a day ago, odd ones just now."""
    n = F.col("c_custkey")
    zone = F.when(n % 3 == 0, "America/New_York").when(n % 3 == 1, "Europe/Berlin").otherwise("Asia/Tokyo")
    last = F.when(n % 2 == 0, F.lit("2024-01-09 08:10:00")).otherwise("2024-01-10 08:10:00").cast("timestamp")
    return L.due_maintenance(t(s, d, "customer").select(n.alias("user"), zone.alias("zone"), F.lit(3).alias("hour"), last.alias("last_run")), F.lit("2024-01-10 08:30:00").cast("timestamp")).select("user")


@query("p5_categories", f"WITH {ENTRIES}, {FEEDS}, u AS (SELECT feed, count(*) AS n FROM entries WHERE NOT read GROUP BY feed) SELECT folder AS title, count(*) AS feed_count, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_unread FROM feeds LEFT JOIN u USING (feed) GROUP BY folder")
def p5(s, d):
    return L.api_categories(subscribed(s, d), entries(s, d))


@query("p5_entries", f"""WITH {ENTRIES}, {FEEDS} SELECT e.number, to_json({{'id': e.number, 'feed_id': f.number, 'status': CASE WHEN read THEN 'read' ELSE 'unread' END, 'title': e.number || ' t', 'url': link, 'starred': starred,
    'feed': {{'id': f.number, 'feed_url': f.feed, 'title': f.title, 'category': {{'title': folder}}}}}})::VARCHAR AS body FROM entries e JOIN feeds f USING (feed)""")
def p5b(s, d):
    return L.api_entry(entries(s, d).withColumn("title", F.concat(F.col("id"), F.lit(" t"))), subscribed(s, d))


@query("d7_page_date_places", "SELECT page_id, DATE '2020-01-01' + CAST(page_id % 200 AS INTEGER) AS day, CASE page_id % 5 WHEN 0 THEN 'og' WHEN 1 THEN 'json-ld' WHEN 2 THEN 'itemprop' WHEN 3 THEN 'meta' ELSE 'time' END AS source FROM pages")
def d7(s, d):
    """Each place beside a later one of less trust, and a date in the future that none may be."""
    day = F.date_format(F.date_add(F.lit(datetime.date(2020, 1, 1)), (F.col("page_id") % 200).cast("int")), "yyyy-MM-dd")
    k = F.col("page_id") % 5
    own = F.when(k == 0, F.concat(F.lit('<meta content="'), day, F.lit('T10:00:00Z" property="article:published_time">'))).when(k == 1, F.concat(F.lit('<script>{"datePublished": "'), day, F.lit('"}</script>'))).when(k == 2, F.concat(F.lit("<meta itemprop='datePublished' content='"), day, F.lit("'>"))).when(k == 3, F.concat(F.lit('<meta name="DC.date.issued" content="'), day, F.lit('">'))).otherwise(F.concat(F.lit('<time class="x" datetime="'), day, F.lit('">')))
    future = F.when(k > 0, '<meta property="article:published_time" content="2031-01-01">').otherwise("")
    html = F.concat(future, own, F.when(k < 4, '<time datetime="1999-09-09">').otherwise(""))
    found = dates.in_page(html, F.lit(datetime.date(2024, 1, 1)))
    return t(s, d, "pages").select("page_id", found.alias("f")).select("page_id", F.col("f.date").alias("day"), "f.source")


@query("e20_sync_items", f"""WITH {ENTRIES}, {FEEDS} SELECT e.number, to_json({{'id': 'tag:google.com,2005:reader/item/' || lpad(lower(to_hex(e.number)), 16, '0'), 'timestampUsec': CAST(epoch(published)::BIGINT * 1000000 AS VARCHAR), 'published': epoch(published)::BIGINT, 'title': e.id, 'canonical': [{{'href': link}}],
    'origin': {{'streamId': 'feed/' || feed, 'title': f.title}}, 'categories': list_filter(['user/-/state/com.google/reading-list', CASE WHEN read THEN 'user/-/state/com.google/read' END, CASE WHEN starred THEN 'user/-/state/com.google/starred' END, 'user/-/label/' || folder], lambda x: x IS NOT NULL)}})::VARCHAR AS body FROM entries e JOIN feeds f USING (feed)""")
def e20s(s, d):
    return L.sync_item(entries(s, d).withColumn("title", F.col("id")), subscribed(s, d))


@query("e20_fever_items", f"""WITH {ENTRIES}, {FEEDS} SELECT e.number, to_json({{'id': e.number, 'feed_id': f.number, 'title': e.id, 'url': link, 'is_saved': CAST(starred AS INTEGER), 'is_read': CAST(read AS INTEGER), 'created_on_time': CASE WHEN e.number % 5 = 0 THEN 0 ELSE epoch(published)::BIGINT END}})::VARCHAR AS body FROM entries e JOIN feeds f USING (feed)""")
def e20f(s, d):
    e = entries(s, d).withColumn("title", F.col("id")).withColumn("published", F.when(F.col("number") % 5 > 0, F.col("published")))
    return L.fever_item(e, subscribed(s, d))


@query("h2_folder_details", f"""WITH {ENTRIES}, {FEEDS}, p AS (SELECT feed, folder, count(*) AS n, count(*) FILTER (NOT read) AS u, min(published) AS o, count(*) FILTER (starred) AS d FROM feeds JOIN entries USING (feed) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY n DESC, feed) AS place FROM p)
    SELECT folder, count(*) AS feed_count, CAST(sum(n) AS BIGINT) AS total, CAST(sum(u) AS BIGINT) AS unread, min(o) AS oldest, CAST(sum(d) AS BIGINT) AS deleted, string_agg(feed, ' ' ORDER BY place) FILTER (place <= 3) AS top_feeds FROM r GROUP BY folder""")
def h2(s, d):
    e = entries(s, d)
    return L.folder_properties(e, subscribed(s, d), e.where("starred")).withColumn("top_feeds", F.array_join("top_feeds", " "))


@query("h12_captions", f"WITH {ENTRIES} SELECT id, CASE WHEN count(*) OVER (PARTITION BY feed, title) = 1 THEN title END AS caption FROM entries")
def h12(s, d):
    return L.captions(entries(s, d)).select("id", "caption")


@query("k11_challenges", """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'Cloudflare challenge' WHEN 1 THEN 'AWS WAF challenge' WHEN 2 THEN 'Cloudflare block' END AS whose FROM pages""")
def k11(s, d):
    k = (F.col("page_id") % 6).cast("int")
    bodies = F.array(F.lit("<title>Just a moment...</title>"), F.lit("<script src='AwsWaf.js'>"), F.lit("<h1>Attention Required! | Cloudflare</h1><i>ddos-guard</i>"), F.lit("<feed>awswaf</feed>"), F.concat(F.lit("<p>"), F.repeat(F.lit("x"), 4096), F.lit("awswaf")), F.lit("just a moment..."))
    kinds = F.array(F.lit("text/html; charset=utf-8"), F.lit(None).cast("string"), F.lit("TEXT/HTML"), F.lit("application/xml"), F.lit("text/html"), F.lit("text/plain"))
    return t(s, d, "pages").select("page_id", page.challenge(F.get(kinds, k), F.get(bodies, k)).alias("whose"))


@query("m2_domain_due", """WITH f AS (SELECT page_id AS feed, page_id % 40 AS host, page_id % 7 > 0 AS fetched FROM pages WHERE page_id % 40 < 38 OR page_id < 200), n AS (SELECT host, count(*) AS n FROM f GROUP BY host)
    SELECT feed, CASE WHEN host % 6 >= 3 AND n < 8 AND fetched THEN 1700000000 + CASE host % 6 WHEN 3 THEN 900 WHEN 4 THEN 1800 ELSE 3600 END END AS due FROM f JOIN n USING (host)""")
def m2(s, d):
    f = t(s, d, "pages").where("page_id % 40 < 38 or page_id < 200").select(F.col("page_id").alias("feed"), (F.col("page_id") % 40).alias("host"), F.when(F.col("page_id") % 7 > 0, 1).alias("updated"))
    hosts = s.range(40).select(F.col("id").alias("host"), F.when(F.col("id") % 6 == 5, 60).otherwise(F.col("id") % 6).alias("failures"), F.lit(1_700_000_000).cast("long").alias("last_failure"))
    return L.domain_due(f, hosts, 900)


@query("p2_mark_all_read", f"WITH {ENTRIES} SELECT id, read OR (lang = 'de' AND (number % 9 = 0 OR published <= TIMESTAMP '2024-01-15 00:00:00')) AS read FROM entries")
def p2(s, d):
    """Streams by language; a ninth of the entries has no date, and this client marks those."""
    e = entries(s, d).withColumn("published", F.when(F.col("number") % 9 > 0, F.col("published"))).withColumn("feed", F.col("lang"))
    return L.marked_read(e, s.createDataFrame([("de",)], "feed string"), F.expr("timestamp_ntz'2024-01-15 00:00:00'"), True).select("id", "read")


@query("p3_mark_feed_read", f"WITH {ENTRIES} SELECT id, read OR (lang = 'fr' AND number % 9 > 0 AND published <= TIMESTAMP '2024-01-15 00:00:00') AS read FROM entries")
def p3(s, d):
    """The other client leaves undated entries alone."""
    e = entries(s, d).withColumn("published", F.when(F.col("number") % 9 > 0, F.col("published"))).withColumn("feed", F.col("lang"))
    return L.marked_read(e, s.createDataFrame([("fr",)], "feed string"), F.expr("timestamp_ntz'2024-01-15 00:00:00'"), False).select("id", "read")
