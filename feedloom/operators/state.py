"""Changes of state as new tables: marks, re-keying, tombstones, queues and paced runs. Nothing updates in place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.operators.entries import latest, top_per_group

#: The answers by which a host refuses a client, and those that end a feed.
REFUSALS = (403, 415, 429, 503)
GONE = 410

#: Gestures on an entry, and what each leaves of (star, tags, archived, read); null keeps the old value.
GESTURES = {
    "star": (True, None, None, None),
    "unstar": (False, None, None, None),
    "archive": (False, None, True, True),
    "discard": (False, False, False, True),
}


def replaced(existing: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Insert-or-replace: rows of ``new`` take the place of those with their key. Keys of ``new`` are unique."""
    return existing.join(new.select(*key), list(key), "left_anti").unionByName(new)


def rekeyed(df: DataFrame, column: str, changes: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows with ``column`` moved from old to new by ``changes``; where a key is then taken, the row that had it stays, then the first by ``order``."""
    moved = df.join(changes.select(F.col("old").alias(column), "new"), column, "left")
    moved = moved.withColumn("moved", F.col("new").isNotNull()).withColumn(column, F.coalesce("new", column)).drop("new")
    return top_per_group(moved, key, [F.asc("moved"), *order]).drop("rank", "moved")


def marked_until(ts: Column, cutoff: Column, undated: bool) -> Column:
    """Whether a bulk mark up to the cutoff reaches an entry; clients differ in whether undated ones are marked."""
    return F.coalesce(ts <= cutoff, F.lit(undated))


def gesture(name: Column, star: Column, tags: Column, archived: Column, read: Column) -> list[Column]:
    """The four flags after a gesture; an unknown one changes nothing."""
    out = []
    for k, (label, old) in enumerate((("star", star), ("tags", tags), ("archived", archived), ("read", read))):
        new = F.lit(None).cast("boolean")
        for gest, effect in GESTURES.items():
            if effect[k] is not None:
                new = F.when(name == gest, F.lit(effect[k])).otherwise(new)
        out.append(F.coalesce(new, old).alias(label))
    return out


def kept(star: Column, tags: Column, archived: Column) -> Column:
    """Any of the three signals that keep an entry from being pruned."""
    return star | tags | archived


def paced(df: DataFrame, host: str, order: Sequence[Column], failed: Column, limit: int = 4) -> DataFrame:
    """Outcome of each attempt in order: a host is dropped after ``limit`` failures in a row; anything else resets the count."""
    w = Window.partitionBy(host).orderBy(*order)
    run = df.withColumn("bad", F.coalesce(failed, F.lit(False)).cast("int"))
    run = run.withColumn("island", F.sum(1 - F.col("bad")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = run.withColumn("streak", F.sum("bad").over(Window.partitionBy(host, "island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    before = F.max("streak").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return run.withColumn("outcome", F.when(F.coalesce(before, F.lit(0)) >= limit, "skipped_host").when(F.col("bad") == 1, "failed").otherwise("ok")).drop("bad", "island", "streak")


def failure_action(status: Column, timed_out: Column) -> Column:
    return F.when(status == GONE, "disable").when(status.isin(*REFUSALS) | timed_out, "escalate").otherwise("back_off")


def due_at(feed: Column, domain: Column, server: Column) -> tuple[Column, Column]:
    """The latest of three times before which a feed isn't fetched, and which one it is; nulls don't hold back."""
    latest_ = F.greatest(feed, domain, server)
    return latest_, F.when(latest_.isNull(), None).when(feed == latest_, "feed").when(domain == latest_, "domain").otherwise("server")


def resync_hours(days: Column) -> Column:
    """Hours between syncs of a source by the days since it last posted; never posted, three days."""
    return F.when(days.isNull(), 72).when(days <= 30, 1).when(days <= 180, 6).when(days <= 730, 48).otherwise(168)


def swept(tombstones: DataFrame, window: DataFrame, feed: str, entry: str, old: Column) -> DataFrame:
    """Tombstones that stay: young ones, those of feeds without a known window, and those still in it."""
    known = window.select(feed).distinct().withColumn("known", F.lit(True))
    present = window.select(feed, entry).distinct().withColumn("present", F.lit(True))
    j = tombstones.join(known, feed, "left").join(present, [feed, entry], "left")
    return j.where(~(F.coalesce(old, F.lit(False)) & F.col("known").isNotNull() & F.col("present").isNull())).drop("known", "present")


def enqueued(queue: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    """Upsert to pending: queued keys start over, others join the queue."""
    new = keys.select(*key).distinct().withColumn("status", F.lit("pending"))
    return replaced(queue.select(*key, "status"), new, key)


def last_operation(changes: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Of a list of operations on each key the last one."""
    return latest(changes, key, order)
