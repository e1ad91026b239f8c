"""Feeds as data: OPML, bookmarks, exports and synthetic RSS, read and written with Spark's own sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.url import article_url, canonical_feed_url


def escaped(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def rss_item(guid: Column, title: Column, category: Column) -> Column:
    return F.concat(F.lit("<item><guid>"), guid.cast("string"), F.lit("</guid><title>"), escaped(title), F.lit("</title><category>"), escaped(category), F.lit("</category></item>"))


def read_opml(spark: SparkSession, path: str) -> DataFrame:
    """(url, title, folder) of every subscription; outlines lie at most one folder deep."""
    schema = "_text string, _title string, _xmlUrl string, outline array<struct<_text:string,_title:string,_xmlUrl:string>>"
    top = spark.read.schema(schema).option("rowTag", "outline").format("xml").load(path)
    flat = top.where("_xmlUrl is not null").select(F.col("_xmlUrl").alias("url"), F.coalesce("_title", "_text").alias("title"), F.lit(None).cast("string").alias("folder"))
    inner = top.where("_xmlUrl is null").select(F.coalesce("_title", "_text").alias("folder"), F.explode("outline").alias("o"))
    return flat.unionByName(inner.select(F.col("o._xmlUrl").alias("url"), F.coalesce("o._title", "o._text").alias("title"), "folder"))


def new_subscriptions(existing: DataFrame, imported: DataFrame) -> DataFrame:
    """Imported feeds whose canonical URL isn't subscribed yet, each once; a second import adds nothing."""
    key = canonical_feed_url(F.col("url"))
    return imported.withColumn("key", key).join(existing.select(key.alias("key")), "key", "left_anti").dropDuplicates(["key"]).drop("key")


def read_bookmarks(spark: SparkSession, path: str) -> DataFrame:
    """(url, title, archived, saved_at, tags) of a bookmark CSV; header case doesn't matter, tags are JSON or comma-separated."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", "\"").csv(path)
    raw = raw.toDF(*[c.lstrip("﻿").strip().lower() for c in raw.columns])
    cell = lambda name: F.col(name) if name in raw.columns else F.lit(None).cast("string")
    tags = F.coalesce(F.from_json(cell("tags"), "array<string>"), F.transform(F.split(cell("tags"), ","), lambda x: F.trim(x)), F.array().cast("array<string>"))
    return raw.select(cell("url").alias("url"), cell("title").alias("title"), (F.lower(F.coalesce(cell("folder"), F.lit(""))) == "archive").alias("archived"), F.timestamp_seconds(cell("timestamp").try_cast("long")).alias("saved_at"), F.filter(tags, lambda x: x != "").alias("tags"), F.monotonically_increasing_id().alias("ord"))


def merged_bookmarks(rows: DataFrame) -> DataFrame:
    """One row for each article URL: archived if any is, first title, earliest time, all tags by first use; rows go by ``ord``."""
    keyed = rows.withColumn("url", article_url(F.col("url"))).where("url is not null")
    title = F.min_by("title", F.when(F.col("title") != "", F.col("ord")))
    lists = F.transform(F.array_sort(F.collect_list(F.struct("ord", "tags"))), lambda x: x["tags"])
    return keyed.groupBy("url").agg(F.bool_or("archived").alias("archived"), title.alias("title"), F.min("saved_at").alias("saved_at"), F.array_distinct(F.flatten(lists)).alias("tags"))


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, link, published, tags) of a JSON export in its native or JSON Feed shape; labels all in lower case are tags."""
    schema = "items array<struct<id:string,title:string,published:long,crawlTimeMsec:string,timestampUsec:string,canonical:array<struct<href:string>>,url:string,date_published:string,categories:array<string>,tags:array<string>>>"
    item = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("items").alias("i")).select("i.*")
    seconds = F.coalesce(F.timestamp_seconds("published"), F.timestamp_millis(F.col("crawlTimeMsec").try_cast("long")), F.timestamp_micros(F.col("timestampUsec").try_cast("long")), F.try_to_timestamp("date_published"))
    names = F.coalesce("categories", "tags", F.array().cast("array<string>"))
    return item.select("id", "title", F.coalesce(F.try_element_at("canonical", F.lit(1))["href"], F.col("url")).alias("link"), seconds.alias("published"), F.filter(names, lambda x: x == F.lower(x)).alias("tags"))


def write_rss(entries: DataFrame, path: str) -> None:
    """Entries (doc_id, title, source) as text files with an item a line."""
    entries.select(rss_item(F.col("doc_id"), F.col("title"), F.col("source")).alias("value")).write.mode("overwrite").text(path)


def write_takeout(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def merge_takeout(existing: DataFrame, path: str, key: list[str]) -> DataFrame:
    """Existing rows and those of a takeout table whose key is new; nothing that exists changes."""
    new = existing.sparkSession.read.schema(existing.schema).json(path)
    return existing.unionByName(new.join(existing.select(*key), key, "left_anti").dropDuplicates(key))


def canonical_link(html: Column) -> Column:
    """Of a captured page: its canonical link, else its og:url; attributes in any order and quotes."""
    first = lambda p: F.nullif(F.trim(F.regexp_extract(html, p, 1)), F.lit(""))
    link = r"""(?i)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']([^"']+)"""
    meta = r"""(?i)<meta\b(?=[^>]*\b(?:property|name)\s*=\s*["']og:url["'])[^>]*\bcontent\s*=\s*["']([^"']+)"""
    return F.coalesce(first(link), first(meta))


def embedded_images(post: Column) -> Column:
    """Distinct image links of a post's embed in order, also of media beside a quoted record; the full size before the thumb."""
    images = "images array<struct<fullsize:string,thumb:string>>"
    parsed = F.from_json(post, f"embed struct<{images.replace(' ', ':', 1)},media:struct<{images.replace(' ', ':', 1)}>>")
    none = F.array().cast("array<struct<fullsize:string,thumb:string>>")
    both = F.concat(F.coalesce(parsed["embed"]["images"], none), F.coalesce(parsed["embed"]["media"]["images"], none))
    return F.array_distinct(F.filter(F.transform(both, lambda x: F.coalesce(F.nullif(x["fullsize"], F.lit("")), x["thumb"])), lambda u: u.isNotNull()))
