"""Feeds and remote listings as text, parsed into entries with Spark's own XML and JSON functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions import html
from feedloom.functions.text import clean_tags, unescaped
from feedloom.functions.url import swap_host

CATEGORY = "struct<_VALUE:string,_term:string,_label:string,_scheme:string>"
MEDIA = "struct<_url:string,_width:int,_height:int,_medium:string,_type:string>"
RSS = (
    f"channel struct<title:string,item:array<struct<guid:string,title:string,link:string,pubDate:string,category:array<{CATEGORY}>,description:string,"
    f"`media:thumbnail`:array<{MEDIA}>,`media:content`:array<{MEDIA}>,enclosure:array<{MEDIA}>>>>"
)
ATOM = f"title string, entry array<struct<id:string,title:string,link:array<struct<_href:string,_rel:string>>,published:string,updated:string,category:array<{CATEGORY}>,content:string,summary:string>>"
#: An Atom feed's first element, behind any prolog, comments and declarations.
ATOM_ROOT = r"(?s)^(?:\s+|<\?.*?\?>|<!--.*?-->|<!(?!--)[^>]*>)*+<(?:[\w.-]+:)?feed[\s/>]"
JSON_FEED = "title string, items array<struct<id:string,title:string,url:string,date_published:string,tags:array<string>,content_html:string,content_text:string>>"


def cleaned(text: Column) -> Column:
    """A response without control characters that XML forbids and without anything before its first bracket or brace."""
    return F.regexp_replace(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""), r"^[^<{]+", "")


def feed_time(text: Column) -> Column:
    """RFC 822 with or without its day's name, or ISO 8601; junk is null. In UTC."""
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    formats = ["d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm Z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd"]
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in formats])


def split_terms(term: Column) -> Column:
    """A term that holds several: entities decoded, split at semicolons only."""
    return F.filter(F.transform(F.split(unescaped(term), ";"), lambda x: F.trim(x)), lambda x: x != "")


def category_name(c: Column) -> Column:
    """The term of a category, else its label, else its text, else its scheme."""
    return F.coalesce(*[F.nullif(F.trim(c[k]), F.lit("")) for k in ("_term", "_label", "_VALUE", "_scheme")])


def categories(found: Column) -> Column:
    return F.filter(F.transform(F.coalesce(found, F.array().cast(f"array<{CATEGORY}>")), category_name), lambda x: x.isNotNull())


def best_media(found: Column) -> Column:
    """The address of the largest picture; the first of equals, and those without a size last."""
    pictures = F.filter(found, lambda m: m["_url"].isNotNull() & ~F.coalesce(m["_medium"], m["_type"], F.lit("image")).rlike("^(video|audio|application)"))
    rated = F.transform(pictures, lambda m, k: F.struct((-F.coalesce(m["_width"], F.lit(0)) * F.coalesce(m["_height"], F.lit(1))).alias("size"), k.alias("place"), m["_url"].alias("url")))
    return F.array_min(rated)["url"]


def parsed(df: DataFrame, text: str = "text") -> DataFrame:
    """Each feed's entries: the frame's other columns with id, title, link, published, tags, thumbnail, content.

    RSS, Atom or JSON Feed, told by the first element or brace. An entry without an id goes by its link; what can't be parsed gives no rows.
    """
    other = [c for c in df.columns if c != text]
    body = df.select(*other, cleaned(F.col(text)).alias("body"))
    kind = F.when(F.col("body").startswith("{"), "json").when(F.col("body").rlike(ATOM_ROOT), "atom").otherwise("rss")
    told = body.withColumn("kind", kind)
    none = F.lit(None).cast("string")
    media = f"array<{MEDIA}>"
    pictures = F.concat(*[F.coalesce(F.col(f"e.{c}"), F.array().cast(media)) for c in ("`media:thumbnail`", "`media:content`", "enclosure")])
    rss = told.where("kind = 'rss'").select(*other, F.explode(F.from_xml(F.col("body"), RSS, {"ignoreSurroundingSpaces": "true"})["channel"]["item"]).alias("e"))
    rss = rss.select(*other, F.coalesce("e.guid", "e.link").alias("id"), "e.title", "e.link", feed_time(F.col("e.pubDate")).alias("published"), categories(F.col("e.category")).alias("tags"), best_media(pictures).alias("thumbnail"), F.col("e.description").alias("content"))
    atom = told.where("kind = 'atom'").select(*other, F.explode(F.from_xml(F.col("body"), ATOM, {"ignoreSurroundingSpaces": "true"})["entry"]).alias("e"))
    links = F.coalesce(F.col("e.link"), F.array().cast("array<struct<_href:string,_rel:string>>"))
    link = F.coalesce(F.get(F.filter(links, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0)), F.get(links, F.lit(0)))["_href"]
    atom = atom.select(*other, F.coalesce(F.col("e.id"), link).alias("id"), "e.title", link.alias("link"), feed_time(F.coalesce("e.published", "e.updated")).alias("published"), categories(F.col("e.category")).alias("tags"), none.alias("thumbnail"), F.coalesce("e.content", "e.summary").alias("content"))
    feed = told.where("kind = 'json'").select(*other, F.explode(F.from_json("body", JSON_FEED)["items"]).alias("e"))
    feed = feed.select(*other, F.coalesce("e.id", "e.url").alias("id"), "e.title", F.col("e.url").alias("link"), feed_time(F.col("e.date_published")).alias("published"), F.coalesce("e.tags", F.array().cast("array<string>")).alias("tags"), none.alias("thumbnail"), F.coalesce("e.content_html", "e.content_text").alias("content"))
    return rss.unionByName(atom).unionByName(feed).where("id is not null")


def ingested(feeds: DataFrame, rewrites: dict[str, str], newest: int = 500) -> DataFrame:
    """Entries of feeds (feed, text) as the library stores them: hosts rewritten, content sanitised against the link, tags cleaned,
    and of each feed the ``newest``, later repeats of an id gone."""
    entries = parsed(feeds)
    for old, new in rewrites.items():
        entries = entries.withColumn("link", swap_host(F.col("link"), old, new))
    entries = entries.withColumn("content", html.sanitised(F.col("content"), F.col("link"))).withColumn("tags", clean_tags(F.flatten(F.transform("tags", lambda x: F.split(x, ";")))))
    once = entries.withColumn("again", F.row_number().over(Window.partitionBy("feed", "id").orderBy(F.desc_nulls_last("published"), "link"))).where("again = 1").drop("again")
    place = F.row_number().over(Window.partitionBy("feed").orderBy(F.desc_nulls_last("published"), F.desc("id")))
    return once.withColumn("place", place).where(F.col("place") <= newest).drop("place")


# --- remote listings, already fetched ---------------------------------------------------------------------------

#: Schemas of other readers' answers: where each keeps an item's fields.
REMOTE = {
    "greader": ("items array<struct<id:string,title:string,published:long,canonical:array<struct<href:string>>,categories:array<string>,origin:struct<streamId:string>,summary:struct<content:string>>>", "items"),
    "ttrss": ("content array<struct<id:long,title:string,updated:long,link:string,unread:boolean,marked:boolean,feed_url:string,content:string,labels:array<array<string>>>>", "content"),
    "miniflux": ("entries array<struct<id:long,title:string,published_at:string,url:string,status:string,starred:boolean,feed:struct<feed_url:string>,content:string,tags:array<string>>>", "entries"),
}
READ, STARRED = "user/-/state/com.google/read", "user/-/state/com.google/starred"


def remote_items(df: DataFrame, kind: str, body: str = "body") -> DataFrame:
    """(feed, id, title, link, published, read, starred, content) of a remote reader's JSON answers, one row an item."""
    schema, items = REMOTE[kind]
    e = df.select(F.explode(F.from_json(body, schema)[items]).alias("e")).select("e.*")
    if kind == "greader":
        has = lambda label: F.coalesce(F.array_contains("categories", label), F.lit(False))
        out = [F.regexp_replace("origin.streamId", "^feed/", "").alias("feed"), "id", "title", F.get("canonical", F.lit(0))["href"].alias("link"), F.timestamp_seconds("published").alias("published"), has(READ).alias("read"), has(STARRED).alias("starred"), F.col("summary.content").alias("content")]
    elif kind == "ttrss":
        out = [F.col("feed_url").alias("feed"), F.col("id").cast("string").alias("id"), "title", "link", F.timestamp_seconds("updated").alias("published"), (~F.coalesce("unread", F.lit(True))).alias("read"), F.coalesce("marked", F.lit(False)).alias("starred"), "content"]
    else:
        out = [F.col("feed.feed_url").alias("feed"), F.col("id").cast("string").alias("id"), "title", F.col("url").alias("link"), feed_time(F.col("published_at")).alias("published"), (F.col("status") == "read").alias("read"), F.coalesce("starred", F.lit(False)).alias("starred"), "content"]
    return e.select(*out)


LISTING = "data struct<children:array<struct<data:struct<name:string,title:string,permalink:string,url:string,created_utc:double,author:string,subreddit:string,selftext:string,over_18:boolean>>>>"


def listing_entries(df: DataFrame, body: str = "body") -> DataFrame:
    """(subreddit, id, title, link, target, published, author) of a link site's listing; the discussion is the link, what it points to the target."""
    e = df.select(F.explode(F.from_json(body, LISTING)["data"]["children"]).alias("e")).select("e.data.*").where("name is not null")
    link = F.concat(F.lit("https://www.reddit.com"), F.col("permalink"))
    return e.select("subreddit", F.col("name").alias("id"), "title", link.alias("link"), F.when(F.col("url") != link, F.col("url")).alias("target"), F.timestamp_seconds("created_utc").alias("published"), "author")


def signed_by(secret: bytes, body: Column) -> Column:
    """The HMAC-SHA256 of a pushed body in hex, of Catalyst's own hashes."""
    import hashlib

    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = bytearray(x ^ 0x36 for x in key), bytearray(x ^ 0x5C for x in key)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), body.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def pushed(payloads: DataFrame, subscribers: DataFrame, secret: bytes) -> DataFrame:
    """Payloads (topic, body, signature) whose signature holds, once for each active subscriber (topic, user) of their topic."""
    good = payloads.where(F.lower(F.regexp_replace("signature", "^sha256=", "")) == signed_by(secret, F.col("body")))
    return good.join(subscribers.where("active").select("topic", "user").distinct(), "topic").select("user", "topic", "body")
