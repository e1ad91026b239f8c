"""Dates: three encodings, placeholders, dates in links, effective dates, ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """Naive (UTC), ISO with offset, or trailing Z; junk is null."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ss")])


def real(ts: Column) -> Column:
    """A year up to 1990 is a placeholder."""
    return F.when(F.year(ts) > 1990, ts)


def date_in_url(url: Column) -> Column:
    """/Y/M/D/ or /Y-M-D/, a valid day after 1999."""
    grab = lambda i: F.coalesce(F.nullif(F.regexp_extract(url, r"/(\d{4})/(\d{1,2})/(\d{1,2})(?:/|$)", i), F.lit("")), F.nullif(F.regexp_extract(url, r"/(\d{4})-(\d{1,2})-(\d{1,2})(?:[/-]|$)", i), F.lit("")))
    day = F.try_to_date(F.concat_ws("-", grab(1), F.lpad(grab(2), 2, "0"), F.lpad(grab(3), 2, "0")), "yyyy-MM-dd")
    return F.when(F.year(day).between(2000, 2100), day)


def month_in_url(url: Column) -> Column:
    """/Y/M/ as the month's first day; links with a full date have none."""
    y, m = F.regexp_extract(url, r"/(\d{4})/(\d{1,2})/", 1), F.regexp_extract(url, r"/(\d{4})/(\d{1,2})/", 2)
    day = F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lit("01")), "yyyy-MM-dd")
    return F.when(date_in_url(url).isNull() & F.year(day).between(2000, 2100), day)


def effective(published: Column, updated: Column, link: Column, received: Column) -> Column:
    return F.coalesce(real(published), real(updated), date_in_url(link).cast("timestamp"), month_in_url(link).cast("timestamp"), received)


def coerced(seconds: Column, millis: Column, micros: Column) -> Column:
    return F.coalesce(F.timestamp_seconds(seconds), F.timestamp_millis(millis), F.timestamp_micros(micros))


def age_bucket(days: Column) -> Column:
    return F.when(days < 7, "0-6").when(days < 30, "7-29").when(days < 90, "30-89").when(days < 365, "90-364").otherwise("365+")


def pacific_day(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, "America/Los_Angeles"))


#: Where pages state their date, in order of trust; any date of a <time> comes last, as the first may be a comment's.
META_DATES = {"og": "article:published_time", "itemprop": "datePublished", "meta": r"(?:date|pubdate|publish-date|DC\.date[^\"']*)"}


def in_page(html: Column, saved: Column | None = None) -> Column:
    """(date, source) of the first place that states a valid date, not after the day behind ``saved``; null where none does."""
    meta = lambda name: [rf"""(?i)<meta\b(?=[^>]*\b(?:property|name|itemprop)\s*=\s*["']{name}["'])[^>]*\bcontent\s*=\s*["']([0-9-]{{10}})"""]
    places = [("og", meta(META_DATES["og"])[0]), ("json-ld", r'"datePublished"\s*:\s*"([0-9-]{10})'), ("itemprop", meta(META_DATES["itemprop"])[0]), ("meta", meta(META_DATES["meta"])[0]), ("time", r"""(?i)<time\b[^>]*\bdatetime\s*=\s*["']([0-9-]{10})""")]
    found = lambda p: F.try_to_date(F.nullif(F.regexp_extract(html, p, 1), F.lit("")), "yyyy-MM-dd")
    valid = lambda d: (F.year(d) > 1990) if saved is None else (F.year(d) > 1990) & (d <= F.date_add(F.to_date(saved), 1))
    return F.coalesce(*[F.when(valid(found(p)), F.struct(found(p).alias("date"), F.lit(name).alias("source"))) for name, p in places])
