"""Filters, sorts, pages, joins, aggregates, rules and lifecycle steps over entries; column names are parameters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.session import scratch

from feedloom.functions.text import folded


def search(df: DataFrame, terms: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows in which every term is in some column; case-insensitive, % and _ literal. No terms select nothing."""
    if not terms:
        return df.where(F.lit(False))
    # The haystack is the one item of an array, so that it is built once for all terms.
    return df.where(F.exists(F.array(folded(F.concat_ws("\n", *columns))), lambda hay: reduce(lambda a, b: a & b, [hay.contains(t.lower()) for t in terms])))


def in_scope(df: DataFrame, keys: DataFrame, on: Sequence[str], inside: bool = True) -> DataFrame:
    return df.join(keys.select(*on).distinct(), list(on), "left_semi" if inside else "left_anti")


def page(df: DataFrame, order: Sequence[Column], size: int, number: int = 1) -> DataFrame:
    """Page k of one total order: rows ((k-1)n, kn]."""
    return df.orderBy(*order).limit(size * number).withColumn("position", F.row_number().over(Window.orderBy(*order))).where(F.col("position") > size * (number - 1))


def after_cursor(df: DataFrame, key: Column, cursor, size: int, tiebreak: Sequence[Column], newest_first: bool = True) -> DataFrame:
    """Strictly beyond the cursor, as sync clients page; ties at a page's edge are lost by design of the cursor."""
    beyond = df if cursor is None else df.where(key < cursor if newest_first else key > cursor)
    return beyond.orderBy(key.desc() if newest_first else key.asc(), *tiebreak).limit(size)


def numbered(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """Every row with its number from 1 in one order of all rows: dealt and sorted by ranges, numbered within them, and moved by what lies before.

    The dealt rows are written once to the shared folder, as ranges are drawn from a sample and must stay as they are. Of each
    part one count reaches the driver. Rows that agree in the whole order get any of their numbers.
    """
    spark, tie = df.sparkSession, F.col("tie").asc()
    dealt = df.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order, tie).sortWithinPartitions(*order, tie).drop("tie")
    path = scratch(spark, "numbered")
    dealt.withColumn("at", F.monotonically_increasing_id()).write.parquet(path)
    saved = spark.read.parquet(path)
    part = F.call_function("shiftright", F.col("at"), F.lit(33))
    before, shifts = 1, []
    for p, n in sorted((r.part, r.n) for r in saved.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):
        shifts.append((p, before - (p << 33)))
        before += n
    parts = spark.createDataFrame(shifts, "part long, shift long")
    return saved.withColumn("part", part).join(F.broadcast(parts), "part").withColumn(name, F.col("at") + F.col("shift")).select(*df.columns, name)  # a row for each part


def relative_to(df: DataFrame, order: Sequence[Column], anchor: Column, above: bool) -> DataFrame:
    """Rows before or after the anchor in the whole order; without a row that is the anchor, none. Of several the first counts."""
    ranked = numbered(df, order)
    at = ranked.where(anchor).agg(F.min("position")).first()[0]
    return ranked.where(F.lit(False) if at is None else F.col("position") < at if above else F.col("position") > at)


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= n)


def interleaved(df: DataFrame, host: str, order: Sequence[Column]) -> DataFrame:
    """Round-robin by host: ordinal within the host, then the host's first place."""
    own = Window.partitionBy(host).orderBy(*order)
    return df.withColumn("turn", F.row_number().over(own)).withColumn("first", F.first("seq").over(own))


def latest(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Upsert: the last row of each key wins."""
    return top_per_group(df, key, order, 1).drop("rank")


def first_wins(existing: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Insert-or-ignore: rows of ``new`` whose key isn't there yet."""
    return new.join(existing.select(*key), list(key), "left_anti").dropDuplicates(list(key))


def streaks(df: DataFrame, key: str, order: Sequence[Column], failed: Column) -> DataFrame:
    """Consecutive failures so far at each event; a success resets (gaps and islands)."""
    w = Window.partitionBy(key).orderBy(*order)
    run = df.withColumn("failed", failed.cast("int")).withColumn("island", F.sum(1 - F.col("failed")).over(w))
    return run.withColumn("streak", F.sum("failed").over(Window.partitionBy(key, "island").orderBy(*order)).cast("long"))


def backoff(streak: Column, base: int, most: int) -> Column:
    """min(base * 2^(n-1), most) seconds after n failures in a row."""
    return F.when(streak > 0, F.least(F.lit(most), (base * F.pow(F.lit(2), F.least(streak - 1, F.lit(30)))).cast("long"))).otherwise(F.lit(0))


def newest_and_young(df: DataFrame, group: str, order: Sequence[Column], keep: int, young: Column) -> DataFrame:
    """History retention: the newest ``keep`` of each group that are young enough."""
    return top_per_group(df, [group], order, keep).where(young)


def tag_filter(tags: Column, spec: str) -> Column:
    """Whether an entry stays: -x drops, +x or x rescues, ++x requires; untagged entries stay."""
    tokens = [t.strip() for t in spec.split(",") if t.strip()]
    if not tokens:
        raise ValueError("an empty tag filter")
    need = [t[2:] for t in tokens if t.startswith("++")]
    drop = [t[1:] for t in tokens if t.startswith("-")]
    good = [t.lstrip("+") for t in tokens if not t.startswith("-") and not t.startswith("++")]
    has = lambda names: F.arrays_overlap(tags, F.array(*map(F.lit, names))) if names else F.lit(False)
    stays = ~(has(drop) & ~has(good) & ~has(need))
    if need:
        stays = stays & has(need)
    return (F.size(tags) == 0) | stays


def near_in_time(df: DataFrame, key: str, ts: Column, ident: str, hours: int) -> DataFrame:
    """Pairs (a, b) of different ids with equal key at most so many hours apart: bucketed interval join."""
    span = hours * 3600
    left = df.select(F.col(key).alias("k"), F.col(ident).alias("a"), ts.alias("ta"), F.floor(ts / span).alias("slot"))
    right = df.select(F.col(key).alias("k"), F.col(ident).alias("b"), ts.alias("tb"), F.explode(F.array(F.floor(ts / span) - 1, F.floor(ts / span), F.floor(ts / span) + 1)).alias("slot"))
    return left.join(right, ["k", "slot"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("ta") - F.col("tb")) <= span)).select("k", "a", "b")
