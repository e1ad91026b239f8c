"""SURVEY 2.B: tables written in exchange formats and read back, as imports meet them."""

from pyspark.sql import functions as F

from feedloom.plans.registry import query, t
from feedloom.session import scratch
from feedloom.sources import exchange, feeds


def there_and_back(s, df, kind: str):
    exchange.register(s)
    path = scratch(s, kind)
    df.write.format(kind).mode("append").save(path)
    return s.read.format(kind).load(path)


@query("b3_opml_import", "SELECT 'https://s' || c_custkey || '.example.org/feed' AS url, c_name || ' & <co>' AS title, c_mktsegment || '/n' || c_nationkey AS folder FROM customer WHERE c_custkey % 3 <> 0")
def b3(s, d):
    """Subscriptions of an OPML export that aren't there yet; a third is, by other spellings of the address."""
    n = F.col("c_custkey").cast("string")
    c = t(s, d, "customer")
    subscribed = c.select(F.concat(F.lit("https://s"), n, F.lit(".example.org/feed")).alias("url"), F.concat("c_name", F.lit(" & <co>")).alias("title"), F.concat("c_mktsegment", F.lit("/n"), F.col("c_nationkey").cast("string")).alias("folder")).sortWithinPartitions("folder")
    existing = c.where("c_custkey % 3 = 0").select(F.concat(F.lit("https://S"), n, F.lit(".EXAMPLE.org/feed/")).alias("url"))
    return feeds.new_subscriptions(existing, there_and_back(s, subscribed, "opml")).select("url", "title", "folder")


@query("b6_bookmark_files", """SELECT url, max(page_id % 3 = 0) AS archived, count(*) AS rows, list_sort(list_distinct(flatten(list(['t' || page_id % 7, 'a "b", c'])))) [1] AS first_tag, CAST(epoch(min(TIMESTAMP '2024-01-01 00:00:00' + INTERVAL (page_id) MINUTE)) AS BIGINT) AS saved FROM pages GROUP BY url""")
def b6(s, d):
    """Bookmark files of pages with tags of quotes and commas, and what a link has over all of them."""
    when = F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 60)
    rows = t(s, d, "pages").select("url", F.lit("x\ny, \"z\"").alias("title"), (F.col("page_id") % 3 == 0).alias("archived"), when.alias("saved_at"), F.array(F.concat(F.lit("t"), (F.col("page_id") % 7).cast("string")), F.lit('a "b", c')).alias("tags"))
    got = there_and_back(s, rows, "bookmarks")
    tags = F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags"))))
    return got.where(F.col("title") == 'x\ny, "z"').groupBy("url").agg(F.bool_or("archived").alias("archived"), F.count("*").alias("rows"), F.get(tags, F.lit(0)).alias("first_tag"), F.unix_seconds(F.min("saved_at")).alias("saved"))


@query("b15_rss_documents", """SELECT 'https://' || coalesce(source, 'none') || '/' AS feed, CAST(doc_id AS VARCHAR) AS guid, sha256(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g')) AS description, CAST(1704067200 + doc_id AS BIGINT) AS published FROM documents WHERE text IS NOT NULL AND text <> ''""")
def b15(s, d):
    """Every document as an item of its source's RSS documents, whole texts, written and read again."""
    rows = t(s, d, "documents").where("text is not null and text <> ''").select(
        F.concat(F.lit("https://"), F.coalesce("source", F.lit("none")), F.lit("/")).alias("feed"), F.col("doc_id").cast("string").alias("guid"), F.lit(None).cast("string").alias("link"), F.substring("text", 1, 40).alias("title"), F.col("text").alias("description"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id")).alias("published"),
    )
    got = there_and_back(s, rows.repartitionByRange("feed", "guid").sortWithinPartitions("feed", "guid"), "rss")
    return got.select("feed", "guid", F.sha2("description", 256).alias("description"), F.unix_seconds("published").alias("published"))


@query("b16_b17_takeout_merge", """SELECT 'starred' AS kind, count(*) FILTER (c_custkey % 2 = 1) AS added, count(*) AS total, CAST(0 AS BIGINT) AS added_again FROM customer
    UNION ALL SELECT 'settings', count(*) FILTER (n_nationkey % 5 NOT IN (0, 4)), count(*) FILTER (n_nationkey % 5 NOT IN (0, 4)), 0 FROM nation""")
def b16_b17(s, d):
    """A takeout of stars and settings, merged into a library that has half of the stars, and merged again. A fifth of the settings are secrets, another fifth passwords."""
    stars = t(s, d, "customer").select(F.col("c_custkey").alias("entry"), F.col("c_name").alias("title"), F.col("c_acctbal").alias("at"))
    k = F.col("n_nationkey") % 5
    settings = t(s, d, "nation").select(F.concat("n_name", F.when(k == 0, "_api_token").when(k == 4, "_Password").otherwise("_theme")).alias("key"), F.col("n_name").alias("value"))
    archive = there_and_back(s, exchange.taken_out({"starred": stars, "settings": settings}), "takeout")
    out = None
    for kind, whole, here, keys in (("starred", stars, stars.where("entry % 2 = 0").withColumn("title", F.lit("mine")), ["entry"]), ("settings", settings, settings.limit(0), ["key"])):
        every, added = exchange.merged(here, archive, kind, keys)
        again = exchange.merged(every, archive, kind, keys)[1]
        one = added.agg(F.count("*").alias("added")).join(every.agg(F.count("*").alias("total"))).join(again.agg(F.count("*").alias("added_again"))).select(F.lit(kind).alias("kind"), "added", "total", "added_again")
        out = one if out is None else out.unionByName(one)
    return out
