"""Streams against their batch versions, with late, repeated and redelivered rows, and a watchdog over them."""

import collections
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from feedloom.streaming import memory, redelivery, watchdog

HOUR = 3600 * 1000


def brute(rows):
    """By its rules: the newest 300 texts of a feed in a list."""
    lists, out = collections.defaultdict(list), collections.Counter()
    for feed, entry, text, at in sorted(set(rows), key=lambda r: (r[0], r[3], r[1], r[2])):
        own = lists[feed]
        hit = next((x for x in own if x[0] == text), None)
        if hit and hit[1] != entry and at - hit[2] <= 6 * HOUR:
            out[feed, entry, at, hit[1]] += 1
            continue
        if hit:
            own.remove(hit)
        own.append((text, entry, at))
        del own[:-300]
        out[feed, entry, at, None] += 1
    return out


def extractions(n=4000):
    rng = random.Random(8)
    rows = [(rng.choice([1, 1, 1, 2, 3]), rng.randrange(900), f"t{int(rng.random() ** 2 * 700)}", 1_700_000_000_000 + rng.randrange(48 * HOUR)) for _ in range(n)]
    return rows + rng.sample(rows, 200)


def test_memory_in_batch_equals_brute_force(spark):
    rows = extractions()
    df = spark.createDataFrame([*rows, (None, 1, "x", 1), (1, None, "x", 1), (1, 1, None, 1), (1, 1, "x", None)], "feed long, entry long, fingerprint string, at long")
    assert collections.Counter(tuple(r) for r in memory.replayed(df).collect()) == brute(rows)
    assert memory.replayed(df.limit(0)).count() == 0


def test_memory_as_a_stream_equals_the_batch(spark, tmp_path):
    rows = sorted(extractions(1500), key=lambda r: r[3] + random.Random(r[1]).randrange(HOUR // 2))  # up to half an hour late
    known = max(collections.Counter(f for f, *_ in rows).values())
    end = (9, 1, "end", 1_700_000_000_000 + 60 * HOUR)
    size = len(rows) // 4
    for k in range(5):
        part = rows[k * size : (k + 1) * size] if k < 4 else [*rows[4 * size :], end]
        spark.createDataFrame(part or [end], "feed long, entry long, fingerprint string, at long").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        given = spark.readStream.schema("feed long, entry long, fingerprint string, at long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        made = memory.streaming(given.withColumn("ts", F.timestamp_millis("at")).drop("at"))
        q = made.writeStream.format("memory").queryName("recent").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(240)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = collections.Counter(tuple(r) for r in spark.table("recent").collect())
    assert known > 300 and got == brute(rows)


@pytest.mark.parametrize("n", [301, 900])
def test_memory_is_bounded(n):
    recent = memory.Recent()
    for k in range(n):
        assert recent.sibling(k, f"t{k}", k) is None
    assert len(recent.known) == 300 and recent.sibling(-1, f"t{n - 300}", n) == n - 300 and recent.sibling(-1, "t0", n) is None


def test_redelivered_rows_are_there_once_also_after_a_restart(spark, tmp_path):
    schema = "feed string, id long, title string, ts timestamp"
    base = 1_700_000_000
    rows = [("f", k, f"t{k}", base + k * 60) for k in range(40)]
    again = [("f", k, f"other {k}", base + k * 60 + 30) for k in range(0, 40, 3)] + [("f", k, f"t{k}", base + k * 60) for k in range(40, 60)]
    write = lambda part, name: spark.createDataFrame(part, "feed string, id long, title string, ts long").withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    dead = spark.createDataFrame([("f", 3), ("f", 41), ("g", 4)], "feed string, id long")
    own = spark.createDataFrame([("f", 5, "mine"), ("f", 6, None)], "feed string, id long, title string")

    def run():
        given = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        q = redelivery.delivered(given, dead, own, ["feed", "id"]).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    write(rows, "a")
    run()
    write(again, "b")
    run()
    run()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("feed", "id", "title").collect())
    whole = spark.createDataFrame(rows + [r for r in again if r[1] >= 40], "feed string, id long, title string, ts long")
    want = sorted(tuple(r) for r in redelivery.delivered(whole, dead, own, ["feed", "id"]).select("feed", "id", "title").collect())
    assert got == want and len(got) == 58 and ("f", 5, "mine") in got and ("f", 6, "t6") in got


def test_watchdog_tells_stalled_from_slow_streams(spark, tmp_path):
    for k in range(12):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k:02}"))
    gate, dog = threading.Event(), watchdog.Watchdog()
    spark.streams.addListener(dog)
    given = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    start = lambda name, step: given().writeStream.foreachBatch(step).queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(processingTime="0 seconds").start()
    slow = start("slow", lambda df, k: (df.count(), time.sleep(1.0)))
    stuck = start("stuck", lambda df, k: gate.wait(60))
    try:
        seen = []
        for _ in range(14):
            time.sleep(0.7)
            seen.append(dog.states(4.0))
        assert any(s.get("stuck") == "stalled" for s in seen)
        assert all(s.get("slow") in ("moving", "idle") for s in seen if "slow" in s)
        assert watchdog.stop_stalled(spark, dog, 4.0) == ["stuck"]
    finally:
        gate.set()
        slow.stop()
        stuck.stop()
        spark.streams.removeListener(dog)


def test_watchdog_counts_rows_not_reports():
    now = [0.0]
    dog = watchdog.Watchdog(lambda: now[0])
    dog._told("r", "q", 0, "working")
    for t in (5.0, 10.0, 15.0):
        now[0] = t
        dog._told("r", "q", 0, "working")
    assert dog.states(12) == {"q": "stalled"}
    dog._told("r", "q", 3, "working")
    now[0] = 20.0
    assert dog.states(12) == {"q": "moving"} and dog.seen["r"].rows == 3
    dog._told("r", None, 0, "idle")
    now[0] = 99.0
    assert dog.states(12) == {"q": "idle"}
