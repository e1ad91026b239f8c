"""Numbers in one order of all rows, and runs of copies on hot keys, against brute force; both spread over tasks."""

import random
from collections import Counter

from pyspark.sql import functions as F

from feedloom.operators import entries, lifecycle


def test_numbers_in_a_whole_order_without_one_task_for_all(spark):
    rows = [(k, (k * 7919) % 1000 if k % 3 else 500, None if k % 50 == 0 else k % 9) for k in range(6000)]
    df = spark.createDataFrame(rows, "id long, a long, part long").repartition(6)
    order = [F.desc("a"), F.asc_nulls_last("part"), F.asc("id")]
    got = entries.numbered(df, order)
    want = sorted(rows, key=lambda r: (-r[1], r[2] is None, r[2] or 0, r[0]))
    assert got.columns == ["id", "a", "part", "position"] and [r.id for r in got.orderBy("position").collect()] == [r[0] for r in want] and got.agg(F.max("position")).first()[0] == 6000
    at = [r[0] for r in want].index(77)
    above, below = (entries.relative_to(df, order, F.col("id") == 77, above=x) for x in (True, False))
    assert {r.id for r in above.collect()} == {r[0] for r in want[:at]} and {r.id for r in below.collect()} == {r[0] for r in want[at + 1 :]}
    assert "SinglePartition" not in below._jdf.queryExecution().toString() and "Window" not in below._jdf.queryExecution().toString()
    assert entries.relative_to(df, order, F.col("id") == -1, above=True).count() == 0 and entries.numbered(df.limit(0), order).count() == 0


def test_numbers_of_one_frequent_value_lie_in_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(entries, "scratch", lambda spark, name: str(tmp_path / name))
    df = spark.range(0, 9000, 1, 6).select(F.lit(1).alias("a"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = entries.numbered(df, [F.asc("a")])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r.position for r in got.collect()) == list(range(1, 9001))
    parts = spark.read.parquet(str(tmp_path / "numbered")).groupBy(F.call_function("shiftright", F.col("at"), F.lit(33)).alias("part")).count().collect()
    assert len(parts) == 4 and max(r["count"] for r in parts) < 4500


def brute_copies(rows, apart):
    out = Counter()
    by = {}
    for feed, id_, key, us in rows:
        if key is not None and us is not None:
            by.setdefault(key, []).append((us, feed, id_))
    for own in by.values():
        own.sort()
        first = own[0]
        for before, now in zip([own[0], *own], own, strict=False):
            if now[0] - before[0] > apart:
                first = now
            if now[1:] != first[1:]:
                out[now[1], now[2], first[1], first[2]] += 1
    return out


def test_copies_of_a_hot_key_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(f"f{rng.randrange(5)}", k, "hot" if k % 2 else f"k{rng.randrange(60)}", rng.randrange(40) * 1000 + rng.randrange(300)) for k in range(3000)]
    df = spark.createDataFrame(rows, "feed string, id long, key string, us long")
    for apart in (0, 1, 150, 600, 900, 10**6):
        got = Counter(tuple(r) for r in lifecycle.later_copies(df, apart).collect())
        assert got == brute_copies(rows, apart), apart


def test_copies_of_a_hot_key_are_summed_up_before_they_meet(spark):
    df = spark.range(0, 20_000, 1, 8).select(F.lit("f").alias("feed"), "id", F.lit("hot").alias("key"), (F.col("id") * 1000).alias("us"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = lifecycle.later_copies(df, 1_000_000)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.index("Window [") < plan.index("partial_min") and plan.count("partial_min") >= 2  # windows see blocks only
    assert lifecycle.later_copies(df, 1_000_000).count() == 19_999
