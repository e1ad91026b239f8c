"""SURVEY 2.C and 2.D: URL, text and date functions over pages, documents and events."""

from pyspark.sql import functions as F

from feedloom.functions import dates, text, url
from feedloom.plans.registry import query, t

HOST = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\\.', '')"


@query("c1_article_host", f"SELECT page_id, {HOST} AS host FROM pages")
def c1(s, d):
    return t(s, d, "pages").select("page_id", url.article_host(F.col("url")).alias("host"))


@query("c3_article_url", "SELECT page_id, CASE WHEN regexp_matches(url, '^https?://') THEN regexp_replace(url, '#.*$', '') END AS u FROM pages")
def c3(s, d):
    return t(s, d, "pages").select("page_id", url.article_url(F.col("url")).alias("u"))


@query("c5_link_key", "SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', ''), '^[a-z]+://(www\\.)?', '') AS k FROM pages")
def c5(s, d):
    return t(s, d, "pages").select("page_id", url.link_key(F.col("url")).alias("k"))


@query("c6_slug", """SELECT page_id, CASE WHEN length(x) >= 3 AND lower(x) NOT IN ('index', 'home', 'post', 'article', 'default') THEN x END AS slug FROM (
    SELECT page_id, regexp_replace(regexp_extract(regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', ''), '/+$', ''), '([^/]*)$', 1), '\\.(html?|php)$', '') AS x FROM pages)""")
def c6(s, d):
    return t(s, d, "pages").select("page_id", url.slug(F.col("url")).alias("slug"))


@query("c17_path_tags", "SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*/([a-z][a-z-]{1,29})/[^/?#]', 1) AS tags FROM pages")
def c17(s, d):
    return t(s, d, "pages").select("page_id", F.array_join(url.path_tags(F.col("url")), ",").alias("tags"))


@query("c22_site", f"SELECT page_id FROM pages WHERE {HOST} = 'example.com' OR ends_with({HOST}, '.example.com')")
def c22(s, d):
    return t(s, d, "pages").where(url.on_site(url.article_host(F.col("url")), "example.com")).select("page_id")


@query("c29_without_tracking", "SELECT page_id, CASE WHEN regexp_matches(url, '[?&](utm_[a-z]+|WT\\.[a-z_]+)=') THEN regexp_replace(regexp_replace(url, '([?&])utm_[a-z]+=[^&#]*&?', '\\1', 'g'), '[?&](#|$)', '\\1') ELSE url END AS u FROM pages")
def c29(s, d):
    return t(s, d, "pages").select("page_id", url.without_tracking(F.col("url")).alias("u"))


@query("c36_attachments", "SELECT page_id, CASE WHEN x NOT IN ('', 'html', 'htm', 'php', 'asp', 'aspx') THEN x END AS ext FROM (SELECT page_id, lower(regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', ''), '\\.([A-Za-z0-9]+)$', 1)) AS x FROM pages)")
def c36(s, d):
    return t(s, d, "pages").select("page_id", url.attachment_extension(F.col("url")).alias("ext"))


@query("c10_word_jaccard", """WITH w AS (SELECT doc_id, list_distinct(regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+')) AS w FROM documents), k AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x IN ('the', 'of', 'and', 'to', 'in'))) AS b FROM w) SELECT doc_id, round(b / (n + 5 - b), 6) AS similarity FROM k WHERE n IS NOT NULL""")
def c10(s, d):
    docs = t(s, d, "documents").select("doc_id", F.array_distinct(F.split(F.lower("text"), r"\s+")).alias("w"))
    bench = F.array(*[F.lit(x) for x in ("the", "of", "and", "to", "in")])
    return docs.select("doc_id", F.round(text.word_jaccard(F.col("w"), bench), 6).alias("similarity"))


@query("c9_normal_title", None)
def c9(s, d):
    return t(s, d, "documents").select("doc_id", text.normal_title(F.col("text")).alias("title"))


@query("c13_tag_value", "SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(lower(trim(p_brand)), '[\\s_/.,;:!?]+', '-', 'g'), '-{2,}', '', 'g'), '^-+|-+$', '', 'g') AS tag FROM part")
def c13(s, d):
    return t(s, d, "part").select("p_partkey", text.tag_value(F.col("p_brand")).alias("tag"))


@query("c21_keyword_rule", "SELECT doc_id FROM documents WHERE contains(lower(text), 'idiot') OR contains(lower(text), 'token')")
def c21(s, d):
    return t(s, d, "documents").where(text.keyword_match(F.col("text"), "Idiot, token")).select("doc_id")


@query("c21_regex_rule", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)token = .[0-9a-f]{8}')")
def c21r(s, d):
    return t(s, d, "documents").where(text.keyword_match(F.col("text"), "TOKEN = .[0-9a-f]{8}", is_regex=True)).select("doc_id")


@query("c32_durations", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) * 97 AS seconds, CASE WHEN CAST(l_quantity AS BIGINT) * 97 >= 3600 THEN printf('%d:%02d:%02d', CAST(l_quantity AS BIGINT) * 97 // 3600, CAST(l_quantity AS BIGINT) * 97 % 3600 // 60, CAST(l_quantity AS BIGINT) * 97 % 60) ELSE printf('%d:%02d', CAST(l_quantity AS BIGINT) * 97 // 60, CAST(l_quantity AS BIGINT) * 97 % 60) END AS shown FROM lineitem")
def c32(s, d):
    n = F.col("l_quantity").cast("long") * 97
    iso = F.concat(F.lit("PT"), n.cast("string"), F.lit("S"))
    read = t(s, d, "lineitem").select("l_orderkey", "l_linenumber", text.duration_seconds(iso).alias("seconds"))
    return read.withColumn("shown", text.duration_display(F.col("seconds")))


@query("c35_item_ids", "SELECT o_orderkey, lpad(lower(to_hex(o_orderkey)), 16, '0') AS item, o_orderkey AS back FROM orders")
def c35(s, d):
    hexed = text.item_id_hex(F.col("o_orderkey"))
    return t(s, d, "orders").select("o_orderkey", hexed.alias("item"), text.item_id_number(F.concat(F.lit("tag:feedloom,item/"), hexed)).alias("back"))


@query("c38_hashes", "SELECT doc_id, sha256(text) AS sha, md5(text) AS md FROM documents")
def c38(s, d):
    return t(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.md5("text").alias("md"))


@query("d1_parsed", "SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS a, epoch(date_trunc('second', ts))::BIGINT AS b FROM events")
def d1(s, d):
    sec = F.date_trunc("second", F.col("ts").cast("timestamp"))
    naive, iso = F.date_format(sec, "yyyy-MM-dd HH:mm:ss"), F.date_format(sec, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return t(s, d, "events").select("event_id", F.unix_timestamp(dates.parsed(naive)).alias("a"), F.unix_timestamp(dates.parsed(iso)).alias("b"))


@query("d3_date_in_url", "SELECT page_id, CASE WHEN page_id % 5 < 2 THEN make_date(2001 + CAST(page_id % 20 AS INTEGER), 1 + CAST(page_id % 12 AS INTEGER), 1 + CAST(page_id % 28 AS INTEGER)) END AS day, CASE WHEN page_id % 5 = 4 THEN make_date(2001 + CAST(page_id % 20 AS INTEGER), 1 + CAST(page_id % 12 AS INTEGER), 1) END AS month FROM pages")
def d3(s, d):
    """With slashes, with hyphens, no valid day, before 2000, or a month alone."""
    n = lambda k, first: (first + F.col("page_id") % k).cast("string")
    k = F.col("page_id") % 5
    link = F.when(k == 0, F.concat_ws("/", F.lit("https://a.b"), n(20, 2001), n(12, 1), n(28, 1), F.lit("x"))).when(k == 1, F.concat(F.lit("https://a.b/"), F.concat_ws("-", n(20, 2001), F.lpad(n(12, 1), 2, "0"), F.lpad(n(28, 1), 2, "0")), F.lit("/x")))
    link = link.when(k == 2, F.concat_ws("/", F.lit("https://a.b"), n(20, 2001), F.lit("13"), F.lit("40"), F.lit("x"))).when(k == 3, "https://a.b/1999/01/02/x").otherwise(F.concat_ws("/", F.lit("https://a.b"), n(20, 2001), n(12, 1), F.lit("some-post")))
    return t(s, d, "pages").select("page_id", dates.date_in_url(link).alias("day"), dates.month_in_url(link).alias("month"))


@query("d10_coerced", "SELECT o_orderkey, epoch_us(o_orderdate) AS us FROM orders")
def d10(s, d):
    us = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    return t(s, d, "orders").select("o_orderkey", F.unix_micros(dates.coerced(F.lit(None).cast("long"), F.lit(None).cast("long"), us)).alias("us"))
