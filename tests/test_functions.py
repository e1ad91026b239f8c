"""URL, text and date functions, table-driven; operators on tiny tables; streams against batches."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from feedloom.functions import dates, html, page, text, url
from feedloom.operators import entries as E
from feedloom.operators import lifecycle, rules, state
from feedloom.plans import pages as _pages  # noqa: F401  registers its queries
from feedloom.plans.registry import ORACLE, QUERIES
from feedloom.sources import feeds, parse
from feedloom.streaming import health, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("a, b, same", [
    ("http://www.example.com/a/", "https://example.com/a", True), ("https://example.com/a#x", "https://example.com/a", True), ("https://EXAMPLE.com/a", "https://example.com/a", True),
    ("https://example.com/A", "https://example.com/a", False), ("https://example.com/a?x=1", "https://example.com/a", False),
])
def test_link_keys(spark, a, b, same):
    assert (one(spark, url.link_key(F.lit(a))) == one(spark, url.link_key(F.lit(b)))) == same


@pytest.mark.parametrize("raw, want", [
    ("https://Example.com/feed/", "https://example.com/feed"), ("https://example.com/", "https://example.com"), ("https://example.com/feed?format=rss", "https://example.com/feed"),
    ("https://example.com/?format=rss", "https://example.com/?format=rss"), ("  https://example.com/a  ", "https://example.com/a"),
])
def test_canonical_feed_urls(spark, raw, want):
    got = one(spark, url.canonical_feed_url(F.lit(raw)))
    assert got == want and one(spark, url.canonical_feed_url(F.lit(got))) == got


@pytest.mark.parametrize("function, given, want", [
    (url.article_host, "https://user@WWW.Example.com:80/a", "example.com"), (url.slug, "https://a.b/2020/my-post.html", "my-post"), (url.slug, "https://a.b/index.html", None),
    (url.without_tracking, "https://a.b/c?utm_source=x&id=1", "https://a.b/c?id=1"), (url.without_tracking, "https://a.b/c?utm_source=x", "https://a.b/c"), (url.article_url, "ftp://a.b", None),
    (url.attachment_extension, "https://a.b/c.PDF?x", "pdf"), (text.tag_value, " #C++ Tips ", "c++-tips"), (text.tag_value, "!!!", None),
    (text.duration_seconds, "PT1H2M3S", 3723), (text.duration_seconds, "PT", None), (text.item_id_number, "tag:x,item/000000000000001f", 31), (text.item_id_number, "12", 12),
    (text.excerpt, "<p>a  <b>b</b></p>", "a b"),
])
def test_scalars(spark, function, given, want):
    assert one(spark, function(F.lit(given))) == want


@pytest.mark.parametrize("link, day, month", [("https://a.b/2025/11/22/x", "2025-11-22", None), ("https://a.b/2025-11-22/", "2025-11-22", None), ("https://a.b/2021/04/x", None, "2021-04-01"), ("https://a.b/2021/13/x", None, None), ("https://a.b/1999/01/x", None, None)])
def test_dates_in_links(spark, link, day, month):
    as_text = lambda x: None if x is None else str(x)
    assert as_text(one(spark, dates.date_in_url(F.lit(link)))) == day and as_text(one(spark, dates.month_in_url(F.lit(link)))) == month


@pytest.mark.parametrize("given", ["2024-01-02 03:04:05", "2024-01-02T03:04:05Z", "2024-01-02T04:04:05+01:00"])
def test_three_encodings(spark, given):
    assert str(one(spark, dates.parsed(F.lit(given)))) == "2024-01-02 03:04:05" and one(spark, dates.parsed(F.lit("junk"))) is None


@pytest.mark.parametrize("keyword, regex, body, hit", [("foo", False, "a FOOd", True), ("a,b c", False, "x b c", True), ("don't", False, "don’t", True), ("f.o", True, "FOO", True), ("f.o", False, "foo", False), ("", False, "x", False)])
def test_keywords(spark, keyword, regex, body, hit):
    assert one(spark, text.keyword_match(F.lit(body), keyword, regex)) is hit


@pytest.mark.parametrize("tags, spec, stays", [(["linux"], "-linux", False), (["linux", "win"], "-linux,+win", True), ([], "-linux", True), (["x"], "++win", False), (["win"], "++win", True)])
def test_tag_filter(spark, tags, spec, stays):
    assert one(spark, E.tag_filter(F.array(*map(F.lit, tags)).cast("array<string>"), spec)) is stays


def test_titles_and_html(spark):
    assert one(spark, text.normal_title(F.lit("“C++” — vs C#!"))) == "c++ vs c#"
    page = '<div onclick="x"><script>bad()</script><a href="javascript:1">a</a><a href="/b">b  c</a><img src="l.png" width="900" height="600"></div>'
    assert one(spark, html.sanitised(F.lit(page), F.lit("https://h/"))) == '<div><a>a</a><a href="https://h/b">b  c</a><img src="https://h/l.png" width="900" height="600"></div>'
    assert [x.url for x in one(spark, html.links(F.lit(page), F.lit("https://h/")))] == ["javascript:1", "https://h/b"]
    assert one(spark, html.lead_image(F.lit(page), F.lit("https://h/"))).url == "https://h/l.png"


def test_sources(spark, tmp_path):
    (tmp_path / "f.opml").write_text('<opml><body><outline text="F"><outline text="A" xmlUrl="https://A.com/"/></outline><outline text="B" xmlUrl="https://b.com/feed"/></body></opml>')
    got = feeds.read_opml(spark, str(tmp_path / "f.opml"))
    assert {(r.url, r.folder) for r in got.collect()} == {("https://A.com/", "F"), ("https://b.com/feed", None)}
    assert feeds.new_subscriptions(spark.createDataFrame([("https://a.com",)], "url string"), got).count() == 1
    (tmp_path / "b.csv").write_text('URL,Title,Folder,Timestamp,Tags\nhttps://x/1#a,T,Archive,10,"[""p"",""q""]"\nhttps://x/1,,Unread,5,"r, p"\n')
    row = feeds.merged_bookmarks(feeds.read_bookmarks(spark, str(tmp_path / "b.csv"))).first()
    assert (row.url, row.archived, row.title, row.tags) == ("https://x/1", True, "T", ["p", "q", "r"])


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "event_type")
    events.write.parquet(str(tmp_path / "in"))
    stream = health.streaming(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("health").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {tuple(r) for r in health.current(events, "user_id", F.col("event_type") == "error").collect()}
    assert {tuple(r) for r in spark.sql("select user_id, streak, backing_off from health").collect()} == want


def test_rules():
    assert rules.toggled("", "deals", "-") == "-deals"
    assert rules.toggled("-deals", "deals", "-") == ""
    assert rules.toggled("-linux", "linux", "+") == "+linux"
    assert rules.toggled("+linux", "deals", "-") == "+linux, -deals"
    assert [rules.clamp_percent(x) for x in (None, "x", 0.1, 2, "0.9", float("nan"))] == [0.8, 0.8, 0.5, 1.0, 0.9, 0.8]


def test_fuzzy_pairs_are_complete(spark):
    words = ["alpha beta gamma delta epsilon", "alpha beta gamma delta zeta", "alpha beta gamma delta epsilon", "a b c", None, "", "alpha beta gamma delta epsilon zeta"]
    df = spark.createDataFrame(list(enumerate(words)), "id long, title string")
    got = {tuple(r) for r in rules.fuzzy_pairs(df, "id", F.split("title", " "), 66, 5).collect()}
    assert got == {(0, 1, 4, 6), (0, 6, 5, 6), (1, 6, 5, 6)}


@pytest.mark.parametrize("cells, rare", [(1 << 22, 1 / 500), (50, 0.0), (1000, 0.05), (7, 1.0)])
def test_similar_sets_of_two_blocks(monkeypatch, cells, rare):
    """Words counted by products and pair by pair, in pieces of any size, give brute force's pairs."""
    monkeypatch.setattr(rules, "CELLS", cells)
    monkeypatch.setattr(rules, "RARE", rare)
    pick = random.Random(cells)
    sets = {k: sorted({f"w{int(pick.paretovariate(0.6)) % 80}" for _ in range(pick.randint(5, 14))}) for k in range(90)}
    got = []
    for low, high in ((0, 0), (0, 1), (1, 1)):
        ids = [k for k in sets if k % 2 in (low, high)]
        block = pa.table({"low": [low] * len(ids), "high": [high] * len(ids), "part": pa.array([k % 2 for k in ids], pa.int32()), "id": pa.array(ids, pa.int64()), "w": [sets[k] for k in ids]})
        got += [tuple(r.values()) for r in rules.similar(block, 25).to_pylist()]
    every = [(a, b, len({*x} & {*y}), len({*x} | {*y})) for a, x in sets.items() for b, y in sets.items() if a < b]
    assert sorted(got) == sorted(p for p in every if p[2] * 100 >= p[3] * 25)


@pytest.mark.parametrize("block", [1 << 17, 120])
def test_loose_pairs_by_blocks(spark, monkeypatch, block):
    """At low percentages nearly all sets share indexed words; blocks of any size give brute force's pairs."""
    monkeypatch.setattr(rules, "BLOCK", block)
    pick = random.Random(block)
    sets = {k: sorted({f"w{int(pick.paretovariate(0.6)) % 80}" for _ in range(pick.randint(4, 14))}) for k in range(60)}
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in sets.items()], "id long, title string")
    pairs = rules.fuzzy_pairs(df, "id", F.split("title", " "), 25, 5)
    # No pair is a row before it is known to be similar.
    assert "Join" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    first = {}
    for k, v in sets.items():
        if len(v) >= 5:
            first.setdefault(tuple(v), k)
    every = [(a, b, len({*x} & {*y}), len({*x} | {*y})) for x, a in first.items() for y, b in first.items() if a < b]
    assert sorted(map(tuple, pairs.collect())) == sorted(p for p in every if p[2] * 100 >= p[3] * 25)


def brute_force(sets, percent):
    every = [(a, b, len({*x} & {*y}), len({*x} | {*y})) for a, x in sets.items() for b, y in sets.items() if a < b]
    return sorted(p for p in every if p[2] * 100 >= p[3] * percent)


def test_loose_pairs_write_each_set_once(spark, monkeypatch, tmp_path):
    """Blocks meet by reading saved sets: nothing is shuffled for pairs of blocks, and disk doesn't grow with their number."""
    pick = random.Random(5)
    sets = {k: sorted({f"w{int(pick.paretovariate(0.4)) % 300}" for _ in range(pick.randint(8, 40))}) for k in range(150)}
    sets = {f"k{k}": v for k, v in sets.items() if len(v) >= 5}
    monkeypatch.setattr(rules, "BLOCK", 200)
    monkeypatch.setattr(rules, "ROWS", 20)
    monkeypatch.setattr(rules, "scratch", lambda spark, name: f"file://{tmp_path}/{name}", raising=False)
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in sets.items()], "id string, title string")
    pairs = rules.fuzzy_pairs(df, "id", F.split("title", " "), 25, 5)
    assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert pairs.dtypes[:2] == [("a", "string"), ("b", "string")]
    assert sorted(map(tuple, pairs.collect())) == brute_force(sets, 25)
    saved = sorted(r.id for r in spark.read.parquet(str(tmp_path / "sets")).collect())
    assert saved == sorted(sets) and len([*(tmp_path / "sets").glob("*.parquet")]) >= len(sets) / 20


def test_loose_pairs_of_nothing(spark):
    assert rules.fuzzy_pairs(spark.createDataFrame([], "id long, title string"), "id", F.split("title", " "), 25, 5).collect() == []


def test_blocks_hold_each_set_once(monkeypatch, tmp_path):
    """Small files share a block, of a large one each block has a part."""
    monkeypatch.setattr(rules, "BLOCK", 100)
    files, start = [], 0
    for name, rows in (("a", 3), ("b", 4), ("c", 2500), ("d", 9), ("e", 2)):
        pq.write_table(pa.table({"id": range(start, start + rows), "w": [["x"] * 10] * rows}), tmp_path / name)
        files.append((f"file://{tmp_path}/{name}", 10 * rows))
        start += rows
    blocks = rules.dealt(files)
    assert [len(b[0]) for b in blocks] == [2, *[1] * 250, 1, 1]
    held = [rules.sets_of(*b)["id"].to_pylist() for b in blocks]
    assert max(map(len, held)) <= 10 and sorted(sum(held, [])) == list(range(start))


@pytest.mark.parametrize("percent", [3, 25, 33.3, 49])
@pytest.mark.parametrize("much", [(0, 0, 0), (0.2, 1e9, 1e9), (1e9, 0, 0), (1e9, 1e9, 0), (1e9, 1e9, 1e9)])
def test_similar_sets_by_index_and_by_counts(monkeypatch, percent, much):
    """The index of rare words, its bounds and the signatures lose no pair, whether or not all is counted in the end; sizes differ widely."""
    monkeypatch.setattr(rules, "MUCH", much, raising=False)
    monkeypatch.setattr(rules, "CELLS", 1000)
    pick = random.Random(int(percent))
    sets = {}
    for k in range(160):
        base = sets[pick.choice([*sets])] if sets and pick.random() < 0.7 else []
        sets[k] = sorted({*pick.sample(base, int(len(base) * pick.random())), *(f"w{int(pick.paretovariate(0.3)) % 5000}" for _ in range(int(5 + pick.paretovariate(0.6)) % 200 + 5))})
    got = []
    for low, high in ((0, 0), (0, 1), (1, 1)):
        ids = [k for k in sets if k % 2 in (low, high)]
        block = pa.table({"low": [low] * len(ids), "high": [high] * len(ids), "part": pa.array([k % 2 for k in ids], pa.int32()), "id": pa.array(ids, pa.int64()), "w": [sets[k] for k in ids]})
        got += [tuple(r.values()) for r in rules.similar(block, percent).to_pylist()]
    assert sorted(got) == brute_force(sets, percent)


def test_rekeyed_and_enqueued(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("b", 2, "z")], "tag string, entry int, v string")
    changes = spark.createDataFrame([("b", "a")], "old string, new string")
    got = {tuple(r) for r in state.rekeyed(df, "tag", changes, ["tag", "entry"], [F.asc("v")]).select("tag", "entry", "v").collect()}
    assert got == {("a", 1, "x"), ("a", 2, "z")}
    queue = spark.createDataFrame([(1, "failed"), (2, "complete")], "id int, status string")
    got = {tuple(r) for r in state.enqueued(queue, spark.createDataFrame([(1,), (3,), (3,)], "id int"), ["id"]).collect()}
    assert got == {(1, "pending"), (2, "complete"), (3, "pending")}


def test_links_and_titles(spark):
    row = spark.range(1).select(
        url.subreddit(F.lit("https://reddit.com.evil.com/r/x")).alias("evil"), url.safe_link(F.lit(" java\nscript:x")).alias("script"), url.safe_link(F.lit("a/b:c")).alias("relative"),
        url.is_ad(F.lit("https://example.com/banner.jpg")).alias("hero"), url.is_ad(F.lit("https://x.doubleclick.net/1")).alias("ad"), text.episode_number(F.lit("No digits")).alias("none"),
        text.looks_like_tag(F.lit("View all posts")).alias("phrase"), rules.failure_category(F.lit("HTTP 403 Forbidden")).alias("why"), rules.failure_category(F.lit(None).cast("string")).alias("other"),
    ).first()
    assert tuple(row) == (None, False, True, False, True, None, False, "blocked", "other")


@pytest.mark.parametrize("title, want", [("Ep. 12345", "12345"), ("Episode 0012345678901: words", "12345678901"), ("ep000", "0"), ("12345 then 08", "8"), ("2024, ep 7", "2024"), ("step12", None)])
def test_episode_numbers(spark, title, want):
    assert one(spark, text.episode_number(F.lit(title))) == want


@pytest.mark.parametrize("name", ["k13_page_plugins", "k14_page_bodies", "l10_page_chrome"])
def test_cut_references_stay(spark, tmp_path, name):
    """Page queries read references as their SQL does: only those that a semicolon ends."""
    text = "<p>A first passage, long enough to count, with words and more &amp; words &amp;lt; and yet more of them, and a last one.</p>" * 3
    pages = [(k, f"https://a.example.{top}/x", f"<html><head><title>x</title></head><body><nav>n</nav><article><h1>Tom &amp; {cut}</h1>{text}</article></body></html>") for k, (top, cut) in enumerate([("com", "x&amp"), ("net", "x&quot"), ("org", "&#x27"), ("com", "a&lt")])]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = QUERIES[name](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(ORACLE[name]).fetchall())


def test_durations(spark):
    given = {"PT1H2M3S": (3723, "1:02:03"), "PT59S": (59, "0:59"), "PT10H": (36000, "10:00:00"), "PT2M": (120, "2:00"), "PT1H5S": (3605, "1:00:05"), "PT99999999999999999999S": (0, "0:00"), "PT1S2M": (None, None), "P1D": (None, None), "PT": (None, None)}
    df = spark.createDataFrame([(x,) for x in given], "iso string").withColumn("n", text.duration_seconds(F.col("iso"))).withColumn("shown", text.duration_display(F.col("n")))
    assert {r.iso: (r.n, r.shown) for r in df.collect()} == given
    # The pattern stands once in the plan, however often the seconds are read.
    assert df._jdf.queryExecution().executedPlan().toString().count("RLIKE") == 1


def test_stream_replaces_by_key(spark, tmp_path):
    for k, rows in enumerate([[("e", "a", 1), ("e", "b", 1), ("f", "a", 1)], [("e", "c", 2), ("e", "c", 3)]]):
        spark.createDataFrame(rows, "entry string, tag string, n long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("entry string, tag string, n long").parquet(str(tmp_path / "in"))
        sink = sinks.replacing(str(tmp_path / "out"), ["entry"], ["entry", "tag"], [F.desc("n")])
        q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    got = {tuple(r) for r in sinks.current(spark, str(tmp_path / "out"), "entry string, tag string, n long").select("entry", "tag", "n").collect()}
    assert got == {("e", "c", 3), ("f", "a", 1)}


def test_a_sink_rewrites_only_touched_buckets(spark, tmp_path):
    schema, out = "entry string, tag string, n long", str(tmp_path / "t")
    sink = sinks.replacing(out, ["entry"], ["entry", "tag"], [F.desc("n")], buckets=8)
    want = {}
    for batch in range(4):
        rows = [(f"e{k}", f"t{batch}-{j}", j) for k in range(batch, 20, 3 + batch) for j in range(2)]
        for again in range(2):  # a batch may run twice
            sink(spark.createDataFrame(rows, schema), batch)
        want |= {e: {r for r in rows if r[0] == e} for e, _, _ in rows}
        got = {tuple(r) for r in sinks.current(spark, out, schema).collect()}
        assert got == set().union(*want.values())
    sink(spark.createDataFrame([("e0", "x", 1)], schema), 4)
    assert len(list((tmp_path / "t" / "batch=4").glob("bucket=*"))) == 1


def test_page_outline():
    page = '<head><link rel="alternate" type="application/rss+xml" href="/feed" title="F"></head><ul class="list x"><li><a href="/1">1</a><li><a href="/2">2</a></ul><p><a href="#top">t</a>'
    o = html.outlined(page, "http://a.b/")
    assert o.feeds == [("http://a.b/feed", "F")]
    assert o.anchors == [("ul.list a", "http://a.b/1"), ("ul.list a", "http://a.b/2")]


@pytest.mark.parametrize("given, want", [("January 3, 2024", "2024-01-03"), ("Posted: 3 Jan 2024", "2024-01-03"), ("2024-01-03", "2024-01-03"), ("Sept. 5th, 2021", "2021-09-05"), ("on the 3 Jan 2024", None), ("2024", None), ("Foo 3, 2024", None)])
def test_written_dates(spark, given, want):
    got = one(spark, page.written_date(F.lit(given)))
    assert (None if got is None else str(got)) == want


@pytest.mark.parametrize("body, kind", [("RSS", "rss"), ("Atom", "atom"), ("JSON", "json")])
def test_feeds_in_three_forms(spark, body, kind):
    texts = {
        "RSS": "\ufeff <?xml version='1.0'?><rss><channel><title>f</title><item><guid isPermaLink='false'>1</guid><title>A &amp; B</title><link>http://a.b/1</link><pubDate>Wed, 3 Jan 2024 04:05:06 GMT</pubDate><category>x</category></item></channel></rss>",
        "Atom": "<feed xmlns='http://www.w3.org/2005/Atom'><entry><id>1</id><title>A &amp; B</title><link rel='self' href='http://a.b/self'/><link href='http://a.b/1'/><updated>2024-01-03T04:05:06Z</updated><category term='x' label='y'/></entry></feed>",
        "JSON": '{"version":"1.1","items":[{"id":"1","title":"A & B","url":"http://a.b/1","date_published":"2024-01-03T04:05:06Z","tags":["x"]}]}',
    }
    row = parse.parsed(spark.createDataFrame([("f", texts[body])], "feed string, text string")).first()
    assert (row.feed, row.id, row.title, row.link, str(row.published), row.tags) == ("f", "1", "A & B", "http://a.b/1", "2024-01-03 04:05:06", ["x"])
    assert parse.parsed(spark.createDataFrame([("f", "not a feed"), ("g", None)], "feed string, text string")).count() == 0


def test_signatures_are_those_of_hmac(spark):
    import hashlib
    import hmac

    for secret in (b"k", b"x" * 100):
        assert one(spark, parse.signed_by(secret, F.lit("bödy"))) == hmac.new(secret, "bödy".encode(), hashlib.sha256).hexdigest()


def test_modes_of_the_duplicate_rule(spark):
    rows = [("f", "1", "alpha beta gamma delta epsilon", "http://a.b/one-post", 0, "x"), ("g", "2", "Alpha beta, gamma delta epsilon!", "http://c.d/other", 5, "y"), ("h", "3", "alpha beta gamma delta zeta", "http://www.a.b/one-post/", 9, "z"), ("f", "4", "alpha beta gamma delta epsilon", "http://e.f/late", 900, "x")]
    e = spark.createDataFrame(rows, "feed string, id string, title string, link string, h int, content string").withColumn("published", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("h") * 3600))
    found = lambda mode, **how: {(r.id, r.kept_id) for r in lifecycle.duplicates(e, mode, **how).collect()}
    assert found("slug") == {("3", "1")} and found("title") == {("2", "1")} and found("title", hours=10_000) == {("2", "1"), ("4", "1")}
    assert found("fuzzy", percent=60) == {("2", "1"), ("3", "1")} and found("fuzzy", percent=90) == {("2", "1")} and found("title", excluded=["g"]) == set()
    assert found("safe") == set()


def test_saved_copies_keep_the_one_with_content(spark):
    rows = [("f", "1", "a b c d e", "http://x.y/1?utm_source=q", "", 1), ("g", "2", "t", "https://x.y/1?utm_source=q", "body", 2), ("h", "3", "a b c d e", "http://z.w/9", "body", 3), ("i", "4", "A, b c d e", "http://q.r/8", "", 4)]
    e = spark.createDataFrame(rows, "feed string, id string, title string, link string, content string, published int")
    assert {tuple(r) for r in lifecycle.saved_duplicates(e).collect()} == {("f", "1", "g", "2", "confirmed"), ("i", "4", "h", "3", "possible")}


@pytest.mark.parametrize("before", ["", "Notice: undefined index\n", "\ufeff  ", "<?xml version='1.0'?><!-- " + "x" * 5000 + " <rss> --><!DOCTYPE feed>\n<!-- y -->", "\x01\x02"])
def test_feeds_behind_junk_and_long_prologs(spark, before):
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><title>t</title><entry><id>1</id><title>A</title><link href="https://a/"/></entry></feed>'
    rss = "<rss><channel><item><guid>2</guid><title>mentions &lt;feed&gt;</title></item></channel></rss>"
    df = spark.createDataFrame([("a", before + atom), ("r", before + rss), ("j", (before if "<" not in before else "") + '{"items":[{"id":"3","title":"<feed>"}]}')], "feed string, text string")
    assert sorted((r.feed, r.id) for r in parse.parsed(df).collect()) == [("a", "1"), ("j", "3"), ("r", "2")]
