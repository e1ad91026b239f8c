"""Rules end to end, curation joins and maintenance jobs over feeds and entries; each gives a new table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions import dates, text, url
from feedloom.operators.entries import top_per_group
from feedloom.operators.rules import fuzzy_pairs, rule_feeds

KEY = ["feed", "id"]


# --- rules ---------------------------------------------------------------------------------------------------------


def keyword_hits(entries: DataFrame, feeds: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule_id, action, feed, id): entries that enabled rules match within their scope.

    Rules are rows (rule_id, scope, scope_id, search_in, keyword, is_regex, action, enabled); search_in is title, content or both. A
    plain keyword is a comma-separated list of folded substrings, a pattern is a case-insensitive search.
    """
    own = rules.where(F.col("enabled") & (F.trim("keyword") != ""))
    scoped = rule_feeds(own, feeds).join(own.select("rule_id", "search_in", "keyword", "is_regex", "action"), "rule_id")
    j = entries.join(scoped, "feed")
    hay = F.concat_ws("\n", F.when(F.col("search_in") != "content", F.col("title")), F.when(F.col("search_in") != "title", F.col("content")))
    terms = F.filter(F.transform(F.split(text.folded(F.col("keyword")), ","), lambda x: F.trim(x)), lambda x: x != "")
    plain = F.exists(terms, lambda x: F.contains(text.folded(hay), x))
    return j.where(F.when(F.col("is_regex"), F.regexp_like(hay, F.concat(F.lit("(?i)"), "keyword"))).otherwise(plain)).select("rule_id", "action", *KEY)


def duplicates(entries: DataFrame, mode: str, hours: int = 168, percent: int = 80, least: int = 5, excluded: Sequence[str] = ()) -> DataFrame:
    """(feed, id, kept_feed, kept_id): each later copy with the oldest entry of its group that lies within ``hours`` before it.

    Modes: slug (host and slug of the link), title (normalised, at least ``least`` words), fuzzy (word sets alike by ``percent``), safe
    (the link's key and the body's fingerprint both agree, or one long id under several feeds). Entries of excluded feeds take no part.
    """
    e = entries.where(~F.col("feed").isin(*excluded)) if excluded else entries
    words = F.split(F.trim(text.normal_title(F.col("title"))), " ")
    if mode == "fuzzy":
        numbered = e.select(*KEY, "published", F.concat_ws("\x1f", *KEY).alias("ident"), words.alias("words"))
        same = numbered.select("ident", F.array_sort(F.array_distinct(F.filter("words", lambda w: w != ""))).alias("w")).where(F.size("w") >= least)
        of_set = same.groupBy("w").agg(F.min("ident").alias("a"))
        pairs = fuzzy_pairs(numbered, "ident", F.col("words"), percent, least).select("a", "b")
        stars = same.join(of_set, "w").where("ident <> a").select("a", F.col("ident").alias("b"))
        both = pairs.unionByName(stars)
        both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
        side = lambda p: numbered.select(F.col("ident").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in (*KEY, "published")])
        j = both.join(side("a"), "a").join(side("b"), "b").where("a_published < b_published or a_published = b_published and a < b")
        near = j.where(F.unix_micros(F.col("b_published").cast("timestamp")) - F.unix_micros(F.col("a_published").cast("timestamp")) <= hours * 3_600_000_000)
        first = near.groupBy("b_feed", "b_id").agg(F.min(F.struct("a_published", "a_feed", "a_id")).alias("k"))
        return first.select(F.col("b_feed").alias("feed"), F.col("b_id").alias("id"), F.col("k.a_feed").alias("kept_feed"), F.col("k.a_id").alias("kept_id"))
    if mode == "safe":
        print_ = text.fingerprint(text.excerpt(F.col("content"), 1 << 30))
        long_id = F.when(F.length(F.col("id").cast("string")) >= 20, F.concat(F.lit("id:"), F.col("id").cast("string")))
        key = F.coalesce(long_id, F.concat(url.link_key(F.col("link")), F.lit("\x1f"), print_))
    else:
        key = url.host_slug(F.col("link")) if mode == "slug" else F.when(F.size(words) >= least, F.concat_ws(" ", words))
    # Of a group, copies further apart than the window form runs of their own, each with its own keeper.
    keyed = e.select(*KEY, key.alias("key"), F.unix_micros(F.col("published").cast("timestamp")).alias("us")).where("key is not null and us is not null")
    return later_copies(keyed, hours * 3_600_000_000)


def later_copies(rows: DataFrame, apart: int) -> DataFrame:
    """(feed, id, kept_feed, kept_id) of rows (feed, id, key, us) that follow the first of their run: rows of a key none of which comes more than ``apart`` after the one before.

    Rows of a key within one slot of that length are of one run, whatever lies between them. So rows are summed up by key and
    slot, a key however frequent in as many tasks as its rows come from, and only slots are put in order.
    """
    slot = F.floor(F.col("us") / apart) if apart else F.col("us")
    dealt = rows.withColumn("slot", slot)
    blocks = dealt.groupBy("key", "slot").agg(F.min("us").alias("start"), F.max("us").alias("end"), F.min(F.struct("us", *KEY)).alias("first"))
    w = Window.partitionBy("key").orderBy("slot")
    run = blocks.withColumn("run", F.sum(F.when(F.col("start") - F.lag("end").over(w) <= apart, 0).otherwise(1)).over(w))
    keeper = run.select("key", "slot", F.min("first").over(Window.partitionBy("key", "run")).alias("k"))
    joined = dealt.join(keeper, ["key", "slot"])
    return joined.where((F.col("k.feed") != F.col("feed")) | (F.col("k.id") != F.col("id"))).select(*KEY, F.col("k.feed").alias("kept_feed"), F.col("k.id").alias("kept_id"))


def cleanup(entries: DataFrame, saved_feed: str, hours: int = 1 << 20) -> DataFrame:
    """Marks of two passes: copies within each feed by link, then across feeds by slug, among those still unmarked; never of the saved feed."""
    own = entries.where(F.col("feed") != saved_feed)
    inside = own.withColumn("n", F.row_number().over(Window.partitionBy("feed", url.link_key(F.col("link"))).orderBy("published", "id"))).where("n > 1").select(*KEY, F.lit("feed").alias("mode"))
    across = duplicates(own.join(inside, KEY, "left_anti"), "slug", hours).select(*KEY, F.lit("library").alias("mode"))
    return inside.unionByName(across)


# --- curation joins --------------------------------------------------------------------------------------------------


def with_surrogates(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """Entries with the number that sync clients know them by (feed, id, number); unknown ones have none."""
    return entries.join(ids.select(*KEY, "number"), KEY, "left")


def new_surrogates(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """Numbers for entries that have none yet, after the largest in use, in order of (feed, id): ranks by blocks of feeds, then within."""
    new = entries.select(*KEY).distinct().join(ids.select(*KEY), KEY, "left_anti")
    size = new.groupBy("feed").agg(F.count("*").alias("n"))
    before = size.withColumn("before", F.sum("n").over(Window.orderBy("feed")) - F.col("n")).select("feed", "before")  # a row a feed
    base = F.coalesce(F.lit(ids.agg(F.max("number")).first()[0]), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("feed").orderBy("id"))
    return new.join(before, "feed").select(*KEY, (base + F.col("before") + rank).cast("long").alias("number"))


def ghosts(state: DataFrame, feeds: DataFrame) -> DataFrame:
    """Rows about feeds that are gone."""
    return state.join(feeds.select("feed"), "feed", "left_anti")


def uncurated(captures: DataFrame, feeds: DataFrame, stars: DataFrame, tags: DataFrame) -> DataFrame:
    """Captures of feeds that are gone and that neither a star nor a tag keeps."""
    kept = stars.select(*KEY).unionByName(tags.select(*KEY)).distinct()
    return ghosts(captures, feeds).join(kept, KEY, "left_anti")


def episode_audio(episodes: DataFrame, audio: DataFrame) -> DataFrame:
    """Episodes (id, title) with the audio (url, title, place) of the same plain title, else of the same episode number; the first wins."""
    by_title = audio.groupBy(text.plain_title(F.col("title")).alias("t")).agg(F.min(F.struct("place", "url")).alias("by_title")).where("t <> ''")
    by_number = audio.groupBy(text.episode_number(F.col("title")).alias("n")).agg(F.min(F.struct("place", "url")).alias("by_number")).where("n is not null")
    e = episodes.withColumn("t", text.plain_title(F.col("title"))).withColumn("n", text.episode_number(F.col("title")))
    j = e.join(by_title, "t", "left").join(by_number, "n", "left")
    return j.select("id", F.coalesce("by_title.url", "by_number.url").alias("url"), F.when(F.col("by_title").isNotNull(), "title").when(F.col("by_number").isNotNull(), "number").alias("how"))


def duplicate_feeds(feeds: DataFrame, dismissed: DataFrame | None = None, most: int = 5) -> DataFrame:
    """(tier, key, members): groups of feeds (feed, title, folder) that may be one, but for dismissed (tier, key) ones.

    Tiers: same_folder and cross_folder (one canonical address), query_pairs (alike but for the query), upgradable (alike but for
    the scheme), title_groups (one title, at most ``most`` feeds). Members are sorted and joined by spaces.
    """
    canonical = url.canonical_feed_url(F.col("feed"))
    bare = F.regexp_replace(canonical, "[?#].*$", "")
    members = F.array_join(F.array_sort(F.collect_set("feed")), " ").alias("members")  # the spellings of one address, or few by ``most``

    def tier(name: str, key: Column, having: Column, rows: DataFrame = feeds) -> DataFrame:
        grouped = rows.withColumn("key", key).where("key is not null and key <> ''").groupBy("key").agg(
            F.countDistinct("feed").alias("n"), F.countDistinct("folder").alias("folders"), F.countDistinct(canonical).alias("addresses"), F.countDistinct(F.regexp_extract("feed", "^[a-z]+:", 0)).alias("schemes"), members
        )
        return grouped.where((F.col("n") > 1) & having).select(F.lit(name).alias("tier"), "key", "members")

    one = F.col("addresses") == 1
    small = feeds.join(feeds.groupBy(F.lower("title").alias("t")).agg(F.countDistinct("feed").alias("n")).where(F.col("n").between(2, most)), F.lower("title") == F.col("t"), "left_semi")
    out = tier("same_folder", canonical, one & (F.col("folders") == 1)).unionByName(tier("cross_folder", canonical, one & (F.col("folders") > 1)))
    out = out.unionByName(tier("query_pairs", bare, F.col("addresses") > 1)).unionByName(tier("upgradable", F.regexp_replace(canonical, "^[a-z]+://", ""), F.col("schemes") > 1))
    out = out.unionByName(tier("title_groups", F.lower("title"), F.lit(True), small))
    return out if dismissed is None else out.join(dismissed.select("tier", "key"), ["tier", "key"], "left_anti")


def saved_duplicates(saved: DataFrame, least: int = 5) -> DataFrame:
    """(feed, id, kept_feed, kept_id, tier): saved copies with the one to keep: with content, then by https, then the oldest.

    Confirmed ones share a link key or a host and slug; possible ones only a title of ``least`` words.
    """
    rank = F.struct((~F.coalesce(F.length("content") > 0, F.lit(False))).alias("bare"), (~F.col("link").startswith("https:")).alias("plain"), "published", *KEY)
    words = F.split(F.trim(text.normal_title(F.col("title"))), " ")

    def copies(rows: DataFrame, key: Column, tier: str) -> DataFrame:
        k = rows.select(*KEY, key.alias("key"), rank.alias("rank")).where("key is not null")
        best = k.groupBy("key").agg(F.min("rank").alias("k"))
        return k.join(best, "key").where("rank > k").select(*KEY, F.col("k.feed").alias("kept_feed"), F.col("k.id").alias("kept_id"), F.lit(tier).alias("tier"))

    by_link = copies(saved, url.link_key(F.col("link")), "confirmed")
    by_slug = copies(saved.join(by_link, KEY, "left_anti"), url.host_slug(F.col("link")), "confirmed")
    sure = by_link.unionByName(by_slug)
    return sure.unionByName(copies(saved.join(sure, KEY, "left_anti"), F.when(F.size(words) >= least, F.concat_ws(" ", words)), "possible"))


# --- maintenance -------------------------------------------------------------------------------------------------------


def purgeable(meta: DataFrame, entries: DataFrame, captures: DataFrame | None) -> DataFrame:
    """Stored rows of entries that are gone, but none that a capture protects; without a readable list of captures, none at all."""
    if captures is None:
        return meta.limit(0)
    return meta.join(entries.select(*KEY), KEY, "left_anti").join(captures.select(*KEY), KEY, "left_anti")


def reattached(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Captures (feed, id, link, saved_at) whose entry is gone, moved to the one live entry with the same link key, unless a capture is there."""
    live = entries.select("feed", "id", url.link_key(F.col("link")).alias("key"))
    orphan = captures.join(entries.select(*KEY), KEY, "left_anti").withColumn("key", url.link_key(F.col("link")))
    target = live.groupBy("key").agg(F.min(F.struct(*KEY)).alias("to"), F.count("*").alias("n")).where("n = 1")
    moved = orphan.join(target, "key").select(F.col("feed").alias("old_feed"), F.col("id").alias("old_id"), "to.feed", "to.id", "saved_at")
    free = moved.join(captures.select(*KEY), KEY, "left_anti")
    return top_per_group(free, KEY, [F.desc("saved_at"), F.asc("old_feed"), F.asc("old_id")]).drop("rank", "saved_at")


def reclaimed(queue: DataFrame, now: Column, minutes: int = 30, attempts: int = 3) -> DataFrame:
    """The queue (status, started, tries, …) with work that nobody finishes put back, or failed after its last try."""
    stale = (F.col("status") == "in_progress") & (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp")) > minutes * 60_000_000)
    return queue.withColumn("status", F.when(stale & (F.col("tries") >= attempts), "failed").when(stale, "pending").otherwise(F.col("status")))


def repaired_dates(entries: DataFrame) -> DataFrame:
    """(feed, id, published, source) of entries with a placeholder date: from the link's day or month, or the page; else null, from none."""
    bad = entries.where(dates.real(F.col("published")).isNull())
    page = dates.in_page(F.col("content"))
    day, month = dates.date_in_url(F.col("link")), dates.month_in_url(F.col("link"))
    return bad.select(*KEY, F.coalesce(day, page["date"], month).alias("published"), F.when(day.isNotNull(), "link").when(page.isNotNull(), page["source"]).when(month.isNotNull(), "month").otherwise("none").alias("source"))


def repaired_text(entries: DataFrame, old: str, new: str) -> DataFrame:
    """(feed, id, title, link, tags) of the rows that a repair changes: entities decoded, hosts rewritten, tags split and cleaned."""
    tags = text.clean_tags(F.flatten(F.transform("tags", lambda x: F.split(x, ";"))))
    fixed = entries.select(*KEY, text.unescaped(F.col("title")).alias("t"), url.swap_host(F.col("link"), old, new).alias("l"), tags.alias("g"), "title", "link", "tags")
    changed = ~(F.col("t").eqNullSafe(F.col("title")) & F.col("l").eqNullSafe(F.col("link")) & F.col("g").eqNullSafe(F.col("tags")))
    return fixed.where(changed).select(*KEY, F.col("t").alias("title"), F.col("l").alias("link"), F.col("g").alias("tags"))


def boilerplate_damage(entries: DataFrame, least: int = 3) -> DataFrame:
    """(feed, id) of entries whose body is that of ``least`` or more different links of their feed: captured boilerplate, not articles."""
    e = entries.select(*KEY, "link", text.fingerprint(F.col("content")).alias("fp")).where("fp is not null")
    shared = e.groupBy("feed", "fp").agg(F.countDistinct("link").alias("links")).where(F.col("links") >= least)
    return e.join(shared, ["feed", "fp"]).select(*KEY)


def rehomed(stars: DataFrame, entries: DataFrame, article_feed: str) -> DataFrame:
    """Stars on the feed of single articles, moved to the real feed that holds the same link; a star that is there already stays alone."""
    at = stars.where(F.col("feed") == article_feed).join(entries.select(*KEY, "link"), KEY)
    real = entries.where(F.col("feed") != article_feed).groupBy(url.link_key(F.col("link")).alias("key")).agg(F.min(F.struct(*KEY)).alias("to"))
    moved = at.withColumn("key", url.link_key(F.col("link"))).join(real, "key").select(F.col("feed").alias("old_feed"), F.col("id").alias("old_id"), "to.feed", "to.id")
    there = stars.select(*KEY).withColumn("there", F.lit(True))
    return moved.join(there, KEY, "left").select("old_feed", "old_id", *KEY, F.coalesce("there", F.lit(False)).alias("merged"))


def pruned(state: DataFrame, kept: DataFrame, cutoff: Column, saved_feed: str) -> tuple[DataFrame, DataFrame]:
    """(tombstones, state left) after pruning entries read before the cutoff; kept ones and those of the saved feed stay.

    Where the time of reading is missing, that of the last change counts; where both are, the entry stays.
    """
    at = F.coalesce("read_at", "read_modified")
    gone = state.where(F.col("read") & (at < cutoff) & (F.col("feed") != saved_feed)).join(kept.select(*KEY), KEY, "left_anti")
    return gone.select(*KEY, at.alias("read_at")), state.join(gone.select(*KEY), KEY, "left_anti")


# --- schedules ----------------------------------------------------------------------------------------------------------


def rotated(users: DataFrame, tick: int, order: str = "user") -> DataFrame:
    """Users (one row each) with their turn in this tick: the list starts one further on each time, so nobody is always last."""
    n = users.count()
    place = F.row_number().over(Window.orderBy(order)) - 1  # a row a user
    return users.withColumn("turn", F.pmod(place - F.lit(tick % max(n, 1)), F.lit(max(n, 1))).cast("long"))


def fresh(computed: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Cached values (key, generation, value) still valid: computed under the key's present generation; others are discarded."""
    return computed.join(current.select(key, F.col("generation").alias("now")), key).where(F.col("generation") == F.col("now")).drop("now")


def stalled(progress: DataFrame, job: str, ts: str, done: str, now: Column, seconds: int) -> DataFrame:
    """(job, since): jobs without progress for so long. Time since the start doesn't matter, nor do reports without new work."""
    w = Window.partitionBy(job).orderBy(ts)
    before = F.max(done).over(w.rowsBetween(Window.unboundedPreceding, -1))
    moved = progress.where("true").withColumn("moved", before.isNull() | (F.col(done) > before)).where("moved")
    last = moved.groupBy(job).agg(F.max(ts).alias("since"))
    return last.where(F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("since").cast("timestamp")) > seconds * 1_000_000)


def due_maintenance(users: DataFrame, now: Column) -> DataFrame:
    """Users (user, zone, hour, last_run) whose nightly hour it is by their clock and who haven't run on that day yet; times are UTC."""
    local = F.from_utc_timestamp(now, F.col("zone"))
    done = F.to_date(F.from_utc_timestamp("last_run", F.col("zone"))) == F.to_date(local)
    return users.where((F.hour(local) == F.col("hour")) & ~F.coalesce(done, F.lit(False)))


#: Failures in a row from which a host backs off, its longest wait in seconds, and feeds of a host that is exempt.
DOMAIN_AFTER, DOMAIN_MOST, DOMAIN_FEEDS = 3, 3600, 8


def domain_due(feeds: DataFrame, hosts: DataFrame, base: int = 300) -> DataFrame:
    """(feed, due): when a feed's host lets it be fetched again, in seconds; null where it doesn't hold it back.

    Hosts are rows (host, failures in a row, last_failure in seconds); a success has set failures to 0. A wait doubles from ``base``. Hosts with many feeds
    are exempt, and a feed (feed, host, updated) that was never updated gets its first fetch.
    """
    many = feeds.groupBy("host").agg(F.count("*").alias("n"))
    wait = F.least(F.lit(float(DOMAIN_MOST)), F.lit(base) * F.pow(F.lit(2.0), F.least(F.col("failures") - DOMAIN_AFTER, F.lit(30)))).cast("long")
    j = feeds.join(many, "host").join(hosts, "host", "left")
    held = (F.col("failures") >= DOMAIN_AFTER) & (F.col("n") < DOMAIN_FEEDS) & F.col("updated").isNotNull()
    return j.select("feed", F.when(held, F.col("last_failure") + wait).alias("due"))


# --- properties ----------------------------------------------------------------------------------------------------------


def folder_properties(entries: DataFrame, feeds: DataFrame, tombstones: DataFrame, top: int = 3) -> DataFrame:
    """(folder, feed_count, total, unread, oldest, deleted, top_feeds) of every folder; counts are by feed before they meet the folders."""
    per = entries.groupBy("feed").agg(F.count("*").alias("n"), F.count_if(~F.col("read")).alias("u"), F.min("published").alias("o"))
    gone = tombstones.groupBy("feed").agg(F.count("*").alias("d"))
    j = feeds.select("feed", "folder").join(per, "feed", "left").join(gone, "feed", "left").fillna(0, ["n", "u", "d"])
    ranked = j.withColumn("place", F.row_number().over(Window.partitionBy("folder").orderBy(F.desc("n"), "feed")))
    best = F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= top, F.struct("place", "feed")))), lambda x: x["feed"])  # at most ``top``
    return ranked.groupBy("folder").agg(F.count("*").alias("feed_count"), F.sum("n").alias("total"), F.sum("u").alias("unread"), F.min("o").alias("oldest"), F.sum("d").alias("deleted"), best.alias("top_feeds"))


def captions(entries: DataFrame) -> DataFrame:
    """(feed, id, caption): the title as a picture's caption, null where another entry of the feed has it too."""
    repeated = entries.groupBy("feed", "title").agg(F.count("*").alias("n")).where("n > 1")
    j = entries.select(*KEY, "title").join(repeated, ["feed", "title"], "left")
    return j.select(*KEY, F.when(F.col("n").isNull(), F.col("title")).alias("caption"))


# --- projections ----------------------------------------------------------------------------------------------------------


def api_entry(entries: DataFrame, feeds: DataFrame) -> DataFrame:
    """(number, body): an entry as a client reads it, with its feed and category nested."""
    f = feeds.select("feed", F.struct(F.col("number").alias("id"), F.col("feed").alias("feed_url"), F.col("title"), F.struct(F.col("folder").alias("title")).alias("category")).alias("of"))
    status = F.when(F.col("read"), "read").otherwise("unread")
    return entries.join(f, "feed").select("number", F.to_json(F.struct(F.col("number").alias("id"), F.col("of.id").alias("feed_id"), status.alias("status"), "title", F.col("link").alias("url"), F.coalesce("starred", F.lit(False)).alias("starred"), F.col("of").alias("feed"))).alias("body"))


def api_categories(feeds: DataFrame, entries: DataFrame) -> DataFrame:
    """(title, feed_count, total_unread) of every folder."""
    unread = entries.where(~F.col("read")).groupBy("feed").agg(F.count("*").alias("n"))
    return feeds.join(unread, "feed", "left").groupBy(F.col("folder").alias("title")).agg(F.count("*").alias("feed_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_unread"))


#: Endings of what a page's own assets are; anything else that has an ending is a file.
PAGE_ASSETS = "png jpg jpeg gif webp avif svg ico bmp mp3 m4a ogg wav flac mp4 webm mov mkv avi html htm php asp aspx css js".split()


def file_assets(assets: DataFrame) -> DataFrame:
    """Assets (url, mime) that are files to keep: by type no picture, sound, film or page, and by name something with an ending."""
    ending = url.attachment_extension(F.col("url"))
    wrong = F.coalesce(F.col("mime"), F.lit("")).rlike("^(image|audio|video)/|^text/html|^application/xhtml")
    return assets.where(~wrong & ending.isNotNull() & ~ending.isin(*PAGE_ASSETS)).withColumn("ending", ending)


def sync_item(entries: DataFrame, feeds: DataFrame) -> DataFrame:
    """(number, body): an entry as sync clients read it, with its states and labels as categories."""
    e = entries.join(feeds.select("feed", F.col("title").alias("feed_title"), "folder"), "feed")
    sec = F.coalesce(F.unix_seconds(F.col("published").cast("timestamp")), F.lit(0))
    state = "user/-/state/com.google/"
    labels = F.array_compact(F.array(F.lit(state + "reading-list"), F.when(F.col("read"), state + "read"), F.when(F.col("starred"), state + "starred"), F.concat(F.lit("user/-/label/"), "folder")))
    body = F.struct(
        F.concat(F.lit("tag:google.com,2005:reader/item/"), text.item_id_hex(F.col("number"))).alias("id"), (sec * 1_000_000).cast("string").alias("timestampUsec"), sec.alias("published"),
        F.coalesce("title", F.lit("")).alias("title"), F.array(F.struct(F.col("link").alias("href"))).alias("canonical"), F.struct(F.concat(F.lit("feed/"), "feed").alias("streamId"), F.col("feed_title").alias("title")).alias("origin"), labels.alias("categories"),
    )
    return e.select("number", F.to_json(body).alias("body"))


def fever_item(entries: DataFrame, feeds: DataFrame) -> DataFrame:
    """(number, body): an entry in the flat form with numbers as flags; without a date its time is 0."""
    e = entries.join(feeds.select("feed", F.col("number").alias("feed_id")), "feed")
    sec = F.coalesce(F.unix_seconds(F.col("published").cast("timestamp")), F.lit(0))
    body = F.struct(F.col("number").alias("id"), "feed_id", F.coalesce("title", F.lit("")).alias("title"), F.col("link").alias("url"), F.coalesce("starred", F.lit(False)).cast("int").alias("is_saved"), F.coalesce("read", F.lit(False)).cast("int").alias("is_read"), sec.alias("created_on_time"))
    return e.select("number", F.to_json(body).alias("body"))


def marked_read(entries: DataFrame, keys: DataFrame, cutoff: Column, undated: bool) -> DataFrame:
    """Entries with ``read`` set for those of the given feeds published up to the cutoff; clients differ in whether undated ones count."""
    hit = keys.select("feed").distinct().withColumn("asked", F.lit(True))
    j = entries.join(hit, "feed", "left")
    reached = F.col("asked").isNotNull() & F.coalesce(F.col("published") <= cutoff, F.lit(undated))
    return j.withColumn("read", F.coalesce("read", F.lit(False)) | reached).drop("asked")
