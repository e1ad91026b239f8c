"""Exchange formats: round trips of odd rows, files of others, overwriting, failing tasks, versions and secrets."""

import json
import zipfile
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from feedloom.sources import exchange, feeds

ODD = ["plain", 'a "quoted", <b> & \'c\'', "lines\nand\ttabs\r\nhere", "é𝔘 ü", "]]> <!-- -->", "&amp; &lt;", None]


@pytest.fixture(scope="module")
def formats(spark):
    exchange.register(spark)
    return spark


def written(df, kind, path, mode="append"):
    df.write.format(kind).mode(mode).save(str(path))
    return df.sparkSession.read.format(kind).load(str(path))


def test_opml_round_trip_and_import_twice(formats, tmp_path):
    rows = [(f"https://a{k}.org/?x=1&y=<2>", t, f) for k, (t, f) in enumerate((t, f) for t in ODD for f in (None, "A", "A/B", "A/B & C", "D"))]
    df = formats.createDataFrame(rows, "url string, title string, folder string")
    got = written(df.repartition(3).sortWithinPartitions("folder"), "opml", tmp_path / "o")
    titled = {u: t for u, t, _ in rows}
    assert {tuple(r) for r in got.collect()} == {(u, t if t is not None else u, f) for u, t, f in rows} and titled
    new = feeds.new_subscriptions(df.limit(0), got)
    assert new.count() == len(rows) and feeds.new_subscriptions(new, got).count() == 0


def test_opml_of_others(formats, tmp_path):
    (tmp_path / "x.opml").write_text('<opml><head><title>t</title></head><body><outline text="F"><outline title="G"><outline text="A" xmlURL="https://a/"/></outline></outline><outline text="B" xmlUrl="https://b/"><outline text="C" xmlUrl="https://c/"/></outline><outline text="empty"/></body></opml>')
    assert {tuple(r) for r in formats.read.format("opml").load(str(tmp_path / "x.opml")).collect()} == {("https://a/", "A", "F/G"), ("https://b/", "B", None), ("https://c/", "C", None)}


def test_bookmarks_round_trip_and_files_of_others(formats, tmp_path):
    when = datetime(2024, 5, 6, 7, 8, 9, tzinfo=timezone.utc)
    rows = [(f"https://a/{k}", t, k % 2 == 0, when if k % 3 else None, [x for x in (t, "p,q") if x]) for k, t in enumerate(ODD)]
    got = written(formats.createDataFrame(rows, exchange.Bookmarks.columns), "bookmarks", tmp_path / "b").collect()
    strip = lambda tags: [t.strip() for t in tags]
    assert sorted((r.url, r.title, r.archived, r.saved_at and r.saved_at.astimezone(timezone.utc), list(r.tags)) for r in got) == sorted((u, t, a, s, strip(g)) for u, t, a, s, g in rows)
    (tmp_path / "c.csv").write_bytes('﻿url,TITLE,Timestamp,tags\nhttps://x,T,17,"a, b"\n,none,,\nhttps://y,,soon,\n'.encode())
    assert [tuple(r)[:3] + (list(r.tags),) for r in formats.read.format("bookmarks").load(str(tmp_path / "c.csv")).collect()] == [("https://x", "T", False, ["a", "b"]), ("https://y", None, False, [])]


def test_rss_round_trip(formats, tmp_path):
    when = datetime(2024, 5, 6, 7, 8, 9, tzinfo=timezone.utc)
    rows = [(f"https://f{k % 2}/", str(k), None if k % 2 else f"https://f/{k}?a=1&b", t, (t or "") * 1000 or None, when if k % 3 else None) for k, t in enumerate([*ODD, "bad\x00\x0bchars"])]
    df = formats.createDataFrame(rows, exchange.Rss.columns)
    got = written(df.repartition("feed").sortWithinPartitions("feed"), "rss", tmp_path / "r").collect()
    clean = lambda t: None if t is None else t.replace("\x00", "").replace("\x0b", "")
    assert sorted((r.feed, r.guid, r.link, r.title, r.description, r.published and r.published.astimezone(timezone.utc)) for r in got) == sorted((f, g, k, clean(t), clean(d), p) for f, g, k, t, d, p in rows)


def test_takeouts_merge_without_change_of_what_is_there(formats, tmp_path):
    here = formats.createDataFrame([(1, "mine"), (2, None)], "id long, title string")
    there = formats.createDataFrame([(1, "theirs"), (3, 'x "y"\n'), (3, "again"), (None, "nobody")], "id long, title string")
    settings = formats.createDataFrame([("theme", "dark"), ("smtp_password", "x"), ("API-Key", "y")], "key string, value string")
    archive = written(exchange.taken_out({"stars": there, "settings": settings}).coalesce(1).sortWithinPartitions("kind"), "takeout", tmp_path / "t")
    every, added = exchange.merged(here, archive, "stars", ["id"])
    assert {r.id for r in added.collect()} == {3, None} and {(r.id, r.title) for r in every.collect()} >= {(1, "mine"), (2, None)} and every.count() == 4
    assert exchange.merged(every, archive, "stars", ["id"])[1].count() == 0
    assert [json.loads(r.record)["key"] for r in archive.where("kind = 'settings'").collect()] == ["theme"]
    with zipfile.ZipFile(next((tmp_path / "t").glob("*.zip"))) as z:
        assert "smtp" not in "".join(z.read(n).decode() for n in z.namelist()) and json.loads(z.read("manifest.json")) == {"takeout_version": 1, "records": {"settings": 1, "stars": 4}}


def test_takeouts_of_others_and_newer_ones(formats, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("rules.json", json.dumps([{"keyword": "x"}, {"keyword": "y"}]))
        z.writestr("settings.json", json.dumps({"theme": 1, "session_secret": 2}))
        z.writestr("opml.xml", "<opml/>")
    got = formats.read.format("takeout").load(str(tmp_path / "a.zip")).collect()
    assert sorted(json.loads(r.record)["keyword"] for r in got if r.kind == "rules") == ["x", "y"] and [json.loads(r.record) for r in got if r.kind == "settings"] == [{"key": "theme", "value": 1}]
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("manifest.json", json.dumps({"takeout_version": exchange.VERSION + 1}))
    with pytest.raises(Exception, match="newer"):
        formats.read.format("takeout").load(str(tmp_path / "b.zip")).collect()


def test_jobs_that_fail_leave_nothing_and_overwriting_replaces_at_the_end(formats, tmp_path):
    good = formats.createDataFrame([("https://a", "t", None)], "url string, title string, folder string")
    written(good, "opml", tmp_path / "o")
    bad = formats.range(0, 40, 1, 4).select(F.concat(F.lit("https://b"), F.when(F.col("id") == 37, F.raise_error(F.lit("lost"))).otherwise(F.col("id").cast("string"))).alias("url"), F.lit("t").alias("title"), F.lit(None).cast("string").alias("folder"))
    with pytest.raises(Exception, match="lost"):
        bad.write.format("opml").mode("overwrite").save(str(tmp_path / "o"))
    assert [r.url for r in formats.read.format("opml").load(str(tmp_path / "o")).collect()] == ["https://a"] and not list((tmp_path / "o").glob("_job*"))
    assert written(good.withColumn("url", F.lit("https://c")), "opml", tmp_path / "o").count() == 2
    assert [r.url for r in written(good.withColumn("url", F.lit("https://d")), "opml", tmp_path / "o", "overwrite").collect()] == ["https://d"]
    with pytest.raises(Exception, match="missing"):
        good.select("url").write.format("opml").mode("append").save(str(tmp_path / "x"))
    assert written(good.limit(0), "opml", tmp_path / "none").count() == 0
