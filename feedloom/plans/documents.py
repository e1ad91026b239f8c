"""SURVEY 2.K, 2.L, 2.B and 2.M over pages and events: HTML, images, feeds as text, stateful steps."""

from pyspark.sql import functions as F

from feedloom.functions import html
from feedloom.operators import entries as E
from feedloom.plans.registry import query, t
from feedloom.sources import feeds
from feedloom.streaming import health, memory


@query("k1_sanitised")
def k1(s, d):
    return t(s, d, "pages").select("page_id", F.md5(html.sanitised(F.col("html"), F.col("url"))).alias("clean"))


@query("k8_visible_text")
def k8(s, d):
    return t(s, d, "pages").select("page_id", F.length(html.visible_text(F.col("html"))).alias("chars"))


@query("k9_fingerprints", "SELECT page_id, sha256(trim(regexp_replace(lower(regexp_replace(html, '<[^>]*>', ' ', 'g')), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) AS fp FROM pages")
def k9(s, d):
    plain = F.trim(F.regexp_replace(F.lower(F.regexp_replace("html", "<[^>]*>", " ")), r"[ \t\n\r\f\x0B]+", " "))
    return t(s, d, "pages").select("page_id", F.sha2(plain, 256).alias("fp"))


@query("k11_bot_challenge", """SELECT page_id, CASE WHEN contains(lower(substr(html, 1, 4096)), 'just a moment') THEN 'challenge' WHEN contains(lower(substr(html, 1, 4096)), 'captcha') THEN 'captcha' END AS kind FROM pages""")
def k11(s, d):
    head = F.lower(F.substring("html", 1, 4096))
    return t(s, d, "pages").select("page_id", F.when(F.contains(head, F.lit("just a moment")), "challenge").when(F.contains(head, F.lit("captcha")), "captcha").alias("kind"))


LINKS = """WITH a AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') AS root, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS h, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS x FROM pages),
    u AS (SELECT page_id, root, unnest(h) AS href, unnest(x) AS text, generate_subscripts(h, 1) AS k FROM a), f AS (SELECT page_id, root || replace(href, '&amp;', '&') AS url, replace(text, '&amp;', '&') AS text, k FROM u), o AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY k) AS r FROM f)"""


@query("k15_page_links", LINKS + " SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS INTEGER) AS place, url, text FROM o WHERE r = 1")
def k15(s, d):
    p = t(s, d, "pages").select("page_id", F.posexplode(html.links(F.col("html"), F.col("url"))).alias("place", "l"))
    return p.select("page_id", "place", F.col("l.url").alias("url"), F.col("l.text").alias("text"))


@query("l5_lead_image")
def l5(s, d):
    return t(s, d, "pages").select("page_id", html.lead_image(F.col("html"), F.col("url")).alias("i")).select("page_id", "i.url", "i.score")


@query("b11_change_detection", """WITH h AS (SELECT conv_id, turn, sha256(text) AS h, lag(sha256(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) SELECT conv_id, turn, p IS NULL OR p <> h AS changed FROM h""")
def b11(s, d):
    from pyspark.sql import Window

    h = F.sha2("text", 256)
    last = F.lag(h).over(Window.partitionBy("conv_id").orderBy("turn"))
    return t(s, d, "conversations").select("conv_id", "turn", (last.isNull() | (last != h)).alias("changed"))


@query("b15_feed_items", "SELECT doc_id, '<item><guid>' || doc_id || '</guid><title>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</title><category>' || source || '</category></item>' AS item FROM documents")
def b15(s, d):
    return t(s, d, "documents").select("doc_id", feeds.rss_item(F.col("doc_id"), F.col("text"), F.col("source")).alias("item"))


@query("b20_payloads", "SELECT event_id, to_json({'id': event_id, 'kind': event_type}) AS body FROM events")
def b20(s, d):
    return t(s, d, "events").select("event_id", F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))).alias("body"))


@query("m2_domain_backoff", """WITH e AS (SELECT *, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS f FROM events), i AS (SELECT *, sum(1 - f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM e),
    s AS (SELECT user_id, event_id, ts, sum(f) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM i)
    SELECT user_id, CAST(max_by(streak, (ts, event_id)) AS BIGINT) AS streak, max_by(streak, (ts, event_id)) >= 3 AS backing_off FROM s GROUP BY user_id""")
def m2(s, d):
    return health.current(t(s, d, "events"), "user_id", F.col("event_type") == "error")


@query("b19_announced_feeds")
def b19(s, d):
    return t(s, d, "pages").select("page_id", F.size(html.announced_feeds(F.col("html"), F.col("url"))).alias("feeds"))


@query("b10_unseen_links", LINKS + " SELECT DISTINCT url FROM o WHERE url NOT IN (SELECT url FROM pages)")
def b10(s, d):
    links = t(s, d, "pages").select(F.explode(html.links(F.col("html"), F.col("url"))).alias("l")).select("l.url").distinct()
    return links.join(t(s, d, "pages").select("url"), "url", "left_anti")


@query("l7_galleries")
def l7(s, d):
    return t(s, d, "pages").select("page_id", F.array_join(html.gallery(F.col("html"), F.col("url")), " ").alias("images"))


@query("m9_late_redelivery", """SELECT doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'good' END, lang) AS lang FROM documents LEFT JOIN labels l USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def m9(s, d):
    """Re-ingested entries: the deleted stay away, overrides apply again."""
    labels = t(s, d, "labels")
    docs = E.in_scope(t(s, d, "documents"), labels.where("toxic = 1"), ["doc_id"], inside=False)
    return docs.join(labels.select("doc_id", F.when(F.col("quality") == 1, "good").alias("o")), "doc_id", "left").select("doc_id", F.coalesce("o", "lang").alias("lang"))


@query("m10_recent_memory", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 300 AND ts >= TIMESTAMP '2024-01-29 12:00:00'")
def m10(s, d):
    return E.newest_and_young(t(s, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 300, F.expr("ts >= timestamp_ntz '2024-01-29 12:00:00'")).select("user_id", "event_id")


@query("m10_refused_extractions", """WITH RECURSIVE e AS (SELECT user_id AS feed, event_id AS entry, event_type AS f, epoch_us(ts) // 1000 AS at_ms FROM events),
    c(feed, f, entry, at_ms) AS (SELECT feed, f, arg_min(entry, (at_ms, entry)), min(at_ms) FROM e GROUP BY feed, f UNION ALL SELECT e.feed, e.f, arg_min(e.entry, (e.at_ms, e.entry)), min(e.at_ms) FROM c JOIN e ON e.feed = c.feed AND e.f = c.f AND e.at_ms - c.at_ms > 21600000 GROUP BY e.feed, e.f),
    s AS (SELECT e.feed, e.entry, e.at_ms, max_by(c.entry, (c.at_ms, c.entry)) AS noted FROM e JOIN c ON c.feed = e.feed AND c.f = e.f AND (c.at_ms < e.at_ms OR c.at_ms = e.at_ms AND c.entry <= e.entry) GROUP BY ALL)
    SELECT feed, entry, at_ms AS "at", CASE WHEN noted <> entry THEN noted END AS sibling FROM s""")
def m10_refused(s, d):
    """Events whose kind the same user's memory holds for another one of the last six hours."""
    e = t(s, d, "events").select(F.col("user_id").alias("feed"), F.col("event_id").alias("entry"), F.col("event_type").alias("fingerprint"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    return memory.replayed(e)
