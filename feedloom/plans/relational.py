"""SURVEY 2.A, 2.E, 2.F, 2.G, 2.H, 2.J and 2.P over the driver's tables.

Feeds are users of events or sources of documents; stars, reads and archives are kinds of events; archived entries
and their assets are orders and line items; folders are regions over nations.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from feedloom.functions import dates
from feedloom.operators import entries as E
from feedloom.plans.registry import query, t

ROUND = 4


@query("a1_point_lookup", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = 7 AND l_linenumber = 1")
def a1(s, d):
    return t(s, d, "lineitem").where("l_orderkey = 7 and l_linenumber = 1").select("l_orderkey", "l_linenumber", "l_quantity")


@query("a4_key_membership", "SELECT o_orderkey, o_totalprice FROM orders WHERE (o_custkey, o_orderstatus) IN (SELECT c_custkey, 'F' FROM customer WHERE c_mktsegment = 'BUILDING')")
def a4(s, d):
    keys = t(s, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), F.lit("F").alias("o_orderstatus"))
    return t(s, d, "orders").join(keys, ["o_custkey", "o_orderstatus"], "left_semi").select("o_orderkey", "o_totalprice")


@query("a5_keyset_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 50")
def a5(s, d):
    return t(s, d, "orders").where("o_orderkey > 100").orderBy("o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


@query("a7_problem_feeds", """SELECT user_id, count(*) AS failures, min(ts) AS first_failure FROM events WHERE event_type = 'error'
    GROUP BY user_id ORDER BY failures DESC, first_failure ASC NULLS FIRST, user_id LIMIT 10""")
def a7(s, d):
    g = t(s, d, "events").where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("failures"), F.min("ts").alias("first_failure"))
    return g.orderBy(F.desc("failures"), F.asc_nulls_first("first_failure"), "user_id").limit(10)


@query("a8_status_counts", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def a8(s, d):
    return t(s, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("a9_totals", "SELECT count(*) AS n, coalesce(sum(CAST(l_quantity AS BIGINT)), 0)::BIGINT AS quantity FROM lineitem")
def a9(s, d):
    return t(s, d, "lineitem").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("l_quantity").cast("long")), F.lit(0)).alias("quantity"))


@query("a10_largest_entries", """SELECT o_orderkey, (SELECT CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) FROM lineitem WHERE l_orderkey = o_orderkey) AS total,
    (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS assets FROM orders
    WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) ORDER BY total DESC, o_orderkey LIMIT 20""")
def a10(s, d):
    sizes = t(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_quantity").cast("long")).alias("total"), F.count("*").alias("assets"))
    return t(s, d, "orders").select("o_orderkey").join(sizes, "o_orderkey").orderBy(F.desc("total"), "o_orderkey").limit(20)


@query("a12_distinct_feeds", "SELECT DISTINCT source FROM documents")
def a12(s, d):
    return t(s, d, "documents").select("source").distinct()


@query("a13_unreferenced_assets", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def a13(s, d):
    used = t(s, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return t(s, d, "part").join(used, "p_partkey", "left_anti").select("p_partkey")


@query("a14_same_value_elsewhere", """SELECT user_id, count(*) AS n FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id, props) AS c FROM events) WHERE c > 1 GROUP BY user_id""")
def a14(s, d):
    again = F.count("*").over(Window.partitionBy("user_id", "props")) > 1
    return t(s, d, "events").select("user_id", again.alias("again")).where("again").groupBy("user_id").agg(F.count("*").alias("n"))


@query("a15_prefix", "SELECT c_custkey, c_name FROM customer WHERE starts_with(c_name, 'Customer#00000001') AND NOT starts_with(c_name, '_')")
def a15(s, d):
    return t(s, d, "customer").where(F.col("c_name").startswith("Customer#00000001") & ~F.col("c_name").startswith("_")).select("c_custkey", "c_name")


@query("a16_upsert_latest", """SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def a16(s, d):
    return E.latest(t(s, d, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("a17_insert_or_ignore", """SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND event_id < 2000)""")
def a17(s, d):
    ev = t(s, d, "events")
    return E.first_wins(ev.where("event_type = 'purchase' and event_id < 2000"), ev.where("event_type = 'signup'").select("user_id"), ["user_id"])


@query("a25_shared_links", "SELECT text_hash, n FROM (SELECT md5(text) AS text_hash, count(DISTINCT source) AS n FROM documents GROUP BY md5(text)) WHERE n > 1")
def a25(s, d):
    return t(s, d, "documents").groupBy(F.md5("text").alias("text_hash")).agg(F.countDistinct("source").alias("n")).where("n > 1")


@query("a26_left_join_min", "SELECT c_custkey, min(o_orderdate) AS first_order FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def a26(s, d):
    return t(s, d, "customer").join(t(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.min("o_orderdate").alias("first_order"))


@query("a27_epoch_drift", """SELECT l_orderkey, l_linenumber, CAST(epoch(l_shipdate) AS BIGINT) - CAST(epoch(o_orderdate) AS BIGINT) AS drift FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE CAST(epoch(l_shipdate) AS BIGINT) - CAST(epoch(o_orderdate) AS BIGINT) > 86400 * 100""")
def a27(s, d):
    sec = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    j = t(s, d, "lineitem").join(t(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("l_orderkey", "l_linenumber", (sec("l_shipdate") - sec("o_orderdate")).alias("drift")).where(F.col("drift") > 86400 * 100)


@query("a28_least_recently_synced", """SELECT user_id, last_sync FROM (SELECT u.user_id, (SELECT max(ts) FROM events e WHERE e.user_id = u.user_id AND event_type = 'view') AS last_sync FROM (SELECT DISTINCT user_id FROM events) u)
    ORDER BY last_sync ASC NULLS FIRST, user_id LIMIT 30""")
def a28(s, d):
    ev = t(s, d, "events")
    last = ev.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "view", F.col("ts"))).alias("last_sync"))
    return last.orderBy(F.asc_nulls_first("last_sync"), "user_id").limit(30)


@query("e1_read_filter", "SELECT event_id, user_id FROM events WHERE event_type = 'click' AND event_id NOT IN (SELECT event_id FROM events WHERE value < 5)")
def e1(s, d):
    ev = t(s, d, "events")
    return E.in_scope(ev.where("event_type = 'click'"), ev.where("value < 5"), ["event_id"], inside=False).select("event_id", "user_id")


@query("e2_folder_scope", "SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def e2(s, d):
    feeds = t(s, d, "nation").join(t(s, d, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("s_nationkey"))
    return E.in_scope(t(s, d, "supplier"), feeds, ["s_nationkey"]).select("s_suppkey")


@query("e4_inbox", """SELECT user_id FROM events WHERE event_type = 'purchase' EXCEPT SELECT user_id FROM events WHERE event_type = 'signup' AND user_id % 3 = 0""")
def e4(s, d):
    ev = t(s, d, "events")
    stars = ev.where("event_type = 'purchase'").select("user_id").distinct()
    return E.in_scope(stars, ev.where("event_type = 'signup' and user_id % 3 = 0"), ["user_id"], inside=False)


@query("e6_text_search", """SELECT doc_id, source FROM documents WHERE contains(lower(concat_ws(chr(10), text, source, lang)), 'the') AND contains(lower(concat_ws(chr(10), text, source, lang)), 'src1')""")
def e6(s, d):
    return E.search(t(s, d, "documents"), ["The", "src1"], ["text", "source", "lang"]).select("doc_id", "source")


@query("e7_kept_search", """SELECT doc_id FROM documents WHERE contains(lower(concat_ws(chr(10), text, source)), '%') AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)""")
def e7(s, d):
    return E.in_scope(E.search(t(s, d, "documents"), ["%"], ["text", "source"]), t(s, d, "labels").where("quality = 0"), ["doc_id"]).select("doc_id")


@query("e11_time_range", "SELECT event_id FROM events WHERE ts IS NULL OR ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-06 00:00:00'")
def e11(s, d):
    return t(s, d, "events").where("ts is null or ts between timestamp_ntz '2024-01-05 00:00:00' and timestamp_ntz '2024-01-06 00:00:00'").select("event_id")


@query("e14_below_in_whole_order", """WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id) AS position FROM events) SELECT event_id, position FROM r WHERE position > (SELECT position FROM r WHERE event_id = (SELECT min(event_id) FROM events WHERE event_type = 'purchase'))""")
def e14_whole(s, d):
    """All events after the first purchase by number, in one order of all users' events."""
    e = t(s, d, "events").select("event_id", "ts", "event_type")
    first = e.where("event_type = 'purchase'").agg(F.min("event_id")).first()[0]
    return E.relative_to(e, [F.desc("ts"), F.asc("event_id")], F.col("event_id") == first, above=False).select("event_id", "position")


@query("e14_range_above", """SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id) AS p FROM events WHERE user_id = 3)
    WHERE p < (SELECT p FROM (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id) AS p FROM events WHERE user_id = 3) ORDER BY abs(p - 5) LIMIT 1)""")
def e14(s, d):
    own = t(s, d, "events").where("user_id = 3")
    order = [F.desc("ts"), F.asc("event_id")]
    fifth = own.orderBy(*order).limit(5).orderBy(F.asc("ts"), F.desc("event_id")).limit(1).select("event_id")
    ranked = own.withColumn("p", F.row_number().over(Window.orderBy(*order)))  # of one feed
    at = ranked.join(F.broadcast(fifth), "event_id").select(F.col("p").alias("at"))
    return ranked.join(F.broadcast(at), F.col("p") < F.col("at")).select("event_id")


@query("e16_overrides", "SELECT d.doc_id, coalesce(CASE WHEN quality = 0 THEN 'low' END, lang) AS lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def e16(s, d):
    over = t(s, d, "labels").select("doc_id", F.when(F.col("quality") == 0, "low").alias("override"))
    return t(s, d, "documents").join(over, "doc_id", "left").select("doc_id", F.coalesce("override", "lang").alias("lang"))


@query("e20_api_rows", """SELECT s_suppkey, to_json({'id': s_suppkey, 'title': s_name, 'category': {'id': n_nationkey, 'title': n_name}}) AS body FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def e20(s, d):
    j = t(s, d, "supplier").join(F.broadcast(t(s, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return j.select("s_suppkey", F.to_json(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"), F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title")).alias("category"))).alias("body"))


@query("f2_stream_page", "SELECT event_id, epoch_us(ts) AS us FROM events WHERE epoch_us(ts) < 1704844800000000 ORDER BY us DESC, event_id LIMIT 40")
def f2(s, d):
    us = t(s, d, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return E.after_cursor(us, F.col("us"), 1704844800000000, 40, ["event_id"])


@query("f4_position_cursor", """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS p FROM orders)
    SELECT o_orderkey, p AS position FROM r WHERE p > 30 AND p <= 60""")
def f4(s, d):
    return E.page(t(s, d, "orders"), [F.asc("o_orderdate"), F.asc("o_orderkey")], 30, 2).select("o_orderkey", F.col("position").cast("long").alias("position"))


@query("f8_top_per_group", "SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r = 1")
def f8(s, d):
    return E.top_per_group(t(s, d, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")]).select("c_nationkey", "c_custkey", "c_acctbal")


@query("f9_top5_collected", """SELECT c_nationkey, string_agg(c_custkey::VARCHAR, ',' ORDER BY r) AS top FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 5 GROUP BY c_nationkey""")
def f9(s, d):
    top = E.top_per_group(t(s, d, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")], 5)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("rank", "c_custkey"))), lambda x: x["c_custkey"].cast("string"))
    return top.groupBy("c_nationkey").agg(F.array_join(ordered, ",").alias("top"))


@query("f10_host_interleave", """WITH o AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages), r AS (SELECT page_id, row_number() OVER (PARTITION BY host ORDER BY page_id) AS turn, min(page_id) OVER (PARTITION BY host) AS first FROM o)
    SELECT page_id, turn, first FROM r""")
def f10(s, d):
    p = t(s, d, "pages").select("page_id", F.col("page_id").alias("seq"), F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"))
    return E.interleaved(p, "host", [F.asc("page_id")]).select("page_id", F.col("turn").cast("long").alias("turn"), "first")


@query("f14_fetch_history", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5")
def f14(s, d):
    return E.top_per_group(t(s, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_id")


@query("g3_saved_flag", "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS is_saved FROM documents")
def g3(s, d):
    saved = t(s, d, "labels").where("quality = 1").select("doc_id", F.lit(True).alias("is_saved")).distinct()
    return t(s, d, "documents").join(saved, "doc_id", "left").select("doc_id", F.coalesce("is_saved", F.lit(False)).alias("is_saved"))


@query("g6_enqueue", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def g6(s, d):
    return t(s, d, "customer").join(t(s, d, "orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("g7_curated_orphans", """SELECT DISTINCT user_id FROM events WHERE event_type = 'view' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND event_id < 3000)
    AND user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' UNION SELECT user_id FROM events WHERE event_type = 'click')""")
def g7(s, d):
    ev = t(s, d, "events")
    gone = E.in_scope(ev.where("event_type = 'view'").select("user_id").distinct(), ev.where("event_type = 'signup' and event_id < 3000"), ["user_id"], inside=False)
    return E.in_scope(gone, ev.where("event_type in ('purchase', 'click')"), ["user_id"])


@query("g12_twin_priority", """SELECT d.doc_id, coalesce(a.id, b.id) AS twin, CASE WHEN a.id IS NOT NULL THEN 'text' WHEN b.id IS NOT NULL THEN 'folded' END AS kind FROM documents d
    LEFT JOIN (SELECT md5(text) AS k, min(doc_id) AS id FROM documents GROUP BY 1 HAVING count(*) > 1) a ON md5(d.text) = a.k
    LEFT JOIN (SELECT md5(lower(text)) AS k, min(doc_id) AS id FROM documents GROUP BY 1 HAVING count(*) > 1) b ON md5(lower(d.text)) = b.k""")
def g12(s, d):
    docs = t(s, d, "documents").select("doc_id", F.md5("text").alias("whole"), F.md5(F.lower("text")).alias("folded"))
    first = lambda k, name: docs.groupBy(k).agg(F.min("doc_id").alias(name), F.count("*").alias("n")).where("n > 1").drop("n")
    j = docs.join(first("whole", "a"), "whole", "left").join(first("folded", "b"), "folded", "left")
    return j.select("doc_id", F.coalesce("a", "b").alias("twin"), F.when(F.col("a").isNotNull(), "text").when(F.col("b").isNotNull(), "folded").alias("kind"))


@query("g14_near_in_time", """SELECT a.user_id AS k, a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id
    AND abs(epoch(a.ts)::BIGINT - epoch(b.ts)::BIGINT) <= 3600 WHERE a.event_type = 'error' AND b.event_type = 'error'""")
def g14(s, d):
    ev = t(s, d, "events").where("event_type = 'error'").withColumn("sec", F.unix_timestamp(F.date_trunc("second", F.col("ts").cast("timestamp") + F.expr("interval 500 milliseconds"))))
    return E.near_in_time(ev, "user_id", F.col("sec"), "event_id", 1)


@query("g16_duplicate_groups", """WITH g AS (SELECT md5(text) AS k, min(doc_id) AS keeper, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1)
    SELECT d.doc_id AS marked, g.keeper FROM documents d JOIN g ON md5(d.text) = g.k WHERE d.doc_id <> g.keeper""")
def g16(s, d):
    docs = t(s, d, "documents").select("doc_id", F.md5("text").alias("k"))
    g = docs.groupBy("k").agg(F.min("doc_id").alias("keeper"), F.count("*").alias("n")).where("n > 1")
    return docs.join(g, "k").where("doc_id <> keeper").select(F.col("doc_id").alias("marked"), "keeper")


@query("g24_last_post", "SELECT user_id, max(ts) AS last_post FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id")
def g24(s, d):
    return t(s, d, "events").where("event_type in ('view', 'click')").groupBy("user_id").agg(F.max("ts").alias("last_post"))


@query("g28_two_way_sync", """SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'add' WHEN a.k IS NULL THEN 'remove' ELSE 'keep' END AS action FROM
    (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') a FULL OUTER JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O') b ON a.k = b.k""")
def g28(s, d):
    of = lambda st, c: t(s, d, "orders").where(F.col("o_orderstatus") == st).select(F.col("o_custkey").alias(c)).distinct()
    j = of("F", "a").join(of("O", "b"), F.col("a") == F.col("b"), "full_outer")
    return j.select(F.coalesce("a", "b").alias("k"), F.when(F.col("b").isNull(), "add").when(F.col("a").isNull(), "remove").otherwise("keep").alias("action"))


@query("h1_unread_counts", """SELECT key, count(*) AS unread, max(us) AS newest FROM (SELECT 'feed/' || user_id AS key, epoch_us(ts) AS us FROM events WHERE event_type <> 'click'
    UNION ALL SELECT 'label/' || event_type, epoch_us(ts) FROM events WHERE event_type <> 'click') GROUP BY key""")
def h1(s, d):
    ev = t(s, d, "events").where("event_type <> 'click'")
    keys = F.explode(F.array(F.concat(F.lit("feed/"), F.col("user_id").cast("string")), F.concat(F.lit("label/"), "event_type")))
    return ev.select(keys.alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).groupBy("key").agg(F.count("*").alias("unread"), F.max("us").alias("newest"))


@query("h2_folder_properties", """SELECT r_name, count(DISTINCT s_suppkey) AS feeds, count(l_orderkey) AS total, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS unread, min(l_shipdate) AS oldest
    FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY r_name""")
def h2(s, d):
    per = t(s, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("u"), F.min("l_shipdate").alias("o"))
    feeds = t(s, d, "supplier").join(per, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    j = feeds.join(t(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name").agg(F.count("*").alias("feeds"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum("u"), F.lit(0)).alias("unread"), F.min("o").alias("oldest"))


@query("h3_tag_vocabulary", "SELECT lower(p_brand) AS tag, count(*) AS n FROM part GROUP BY lower(p_brand) ORDER BY n DESC, tag LIMIT 40")
def h3(s, d):
    return t(s, d, "part").groupBy(F.lower("p_brand").alias("tag")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(40)


@query("h6_unstar_plan", """WITH u AS (SELECT user_id, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS starred, max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS tagged FROM events GROUP BY user_id)
    SELECT count(*) FILTER (starred = 1) AS starred, count(*) FILTER (starred = 1 AND tagged = 1) AS protected, count(*) FILTER (starred = 1 AND tagged = 0) AS to_unstar FROM u""")
def h6(s, d):
    u = t(s, d, "events").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "purchase").alias("star"), F.bool_or(F.col("event_type") == "signup").alias("tag"))
    return u.agg(F.count_if("star").alias("starred"), F.count_if(F.col("star") & F.col("tag")).alias("protected"), F.count_if(F.col("star") & ~F.col("tag")).alias("to_unstar"))


@query("h7_age_buckets", """WITH a AS (SELECT CAST(epoch(TIMESTAMP '2024-03-01 00:00:00') - epoch(date_trunc('second', ts)) AS BIGINT) // 86400 AS days FROM events WHERE event_type = 'purchase')
    SELECT CASE WHEN days < 7 THEN '0-6' WHEN days < 30 THEN '7-29' WHEN days < 90 THEN '30-89' WHEN days < 365 THEN '90-364' ELSE '365+' END AS bucket, count(*) AS n FROM a GROUP BY 1""")
def h7(s, d):
    sec = F.unix_timestamp(F.col("ts").cast("timestamp"))
    days = F.floor((F.lit(1709251200) - sec) / 86400)
    return t(s, d, "events").where("event_type = 'purchase'").groupBy(dates.age_bucket(days).alias("bucket")).agg(F.count("*").alias("n"))


@query("h8_autofile_plan", """WITH c AS (SELECT lang, source, count(*) AS support FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY support DESC, source) AS r, sum(support) OVER (PARTITION BY lang) AS total FROM c)
    SELECT lang, source AS candidate, support, support * 2 >= total AS confident FROM r WHERE r = 1""")
def h8(s, d):
    c = t(s, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("support")).withColumn("total", F.sum("support").over(Window.partitionBy("lang")))
    return E.top_per_group(c, ["lang"], [F.desc("support"), F.asc("source")]).select("lang", F.col("source").alias("candidate"), "support", (F.col("support") * 2 >= F.col("total")).alias("confident"))


@query("h9_status_pivot", """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS complete, count(*) FILTER (o_orderstatus = 'O') AS pending, count(*) FILTER (o_orderstatus = 'P') AS in_progress FROM orders GROUP BY o_orderpriority""")
def h9(s, d):
    is_ = lambda x: F.count_if(F.col("o_orderstatus") == x)
    return t(s, d, "orders").groupBy("o_orderpriority").agg(is_("F").alias("complete"), is_("O").alias("pending"), is_("P").alias("in_progress"))


@query("h10_run_estimate", """WITH h AS (SELECT user_id, count(*) AS c FROM events WHERE event_type = 'error' GROUP BY 1) SELECT greatest(sum(c) * 3.0, max(c) * 10.0)::DOUBLE AS seconds FROM h""")
def h10(s, d):
    per = t(s, d, "events").where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("c"))
    return per.agg(F.greatest(F.sum("c") * 3.0, F.max("c") * 10.0).alias("seconds"))


@query("h11_shared_bodies", """WITH f AS (SELECT doc_id, source, CASE WHEN length(text) >= 120 THEN md5(text) END AS fp FROM documents), c AS (SELECT *, count(*) OVER (PARTITION BY source, fp) AS n FROM f WHERE fp IS NOT NULL)
    SELECT doc_id, source FROM c WHERE n > 1""")
def h11(s, d):
    f = t(s, d, "documents").where(F.length("text") >= 120).select("doc_id", "source", F.md5("text").alias("fp"))
    return f.withColumn("n", F.count("*").over(Window.partitionBy("source", "fp"))).where("n > 1").select("doc_id", "source")


@query("h13_failure_categories", """SELECT CASE WHEN value < 5 THEN 'timeout' WHEN value < 20 THEN 'refused' ELSE 'other' END AS category, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1""")
def h13(s, d):
    c = F.when(F.col("value") < 5, "timeout").when(F.col("value") < 20, "refused").otherwise("other")
    return t(s, d, "events").where("event_type = 'error'").groupBy(c.alias("category")).agg(F.count("*").alias("n"))


@query("h14_history_retention", """SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 20 AND ts >= TIMESTAMP '2024-01-10 00:00:00'""")
def h14(s, d):
    return E.newest_and_young(t(s, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 20, F.expr("ts >= timestamp_ntz '2024-01-10 00:00:00'")).select("user_id", "event_id")


@query("h18_quota_by_pacific_day", """SELECT CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles' AS DATE) AS day, count(*) AS calls FROM events GROUP BY 1""")
def h18(s, d):
    return t(s, d, "events").groupBy(dates.pacific_day(F.col("ts").cast("timestamp")).alias("day")).agg(F.count("*").alias("calls"))


@query("h20_progress_ratio", "SELECT count(*) AS total, count(CASE WHEN contains(html, '<img') THEN 1 END) AS with_image FROM pages")
def h20(s, d):
    return t(s, d, "pages").agg(F.count("*").alias("total"), F.count_if(F.contains("html", F.lit("<img"))).alias("with_image"))


@query("h21_domain_fan_out", """WITH h AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages) SELECT host, count(*) AS feeds FROM h GROUP BY host HAVING count(*) >= 2""")
def h21(s, d):
    return t(s, d, "pages").groupBy(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host")).agg(F.count("*").alias("feeds")).where("feeds >= 2")


@query("i2_tag_filter", """SELECT doc_id FROM documents WHERE NOT (lang IN ('de') OR source IN ('src1')) OR source = 'src2'""")
def i2(s, d):
    tags = F.array("lang", "source")
    return t(s, d, "documents").where(E.tag_filter(tags, "-de,-src1,+src2")).select("doc_id")


@query("i10_majority_folder", """WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY source) AS total, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS r FROM c)
    SELECT source, lang FROM r WHERE r = 1 AND n >= 2 AND n * 10 >= total * 6""")
def i10(s, d):
    c = t(s, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy("source")))
    return E.top_per_group(c, ["source"], [F.desc("n"), F.asc("lang")]).where("n >= 2 and n * 10 >= total * 6").select("source", "lang")


@query("j1_prune_read", """SELECT event_id FROM events WHERE event_type = 'click' AND ts < TIMESTAMP '2024-01-15 00:00:00' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 50)""")
def j1(s, d):
    ev = t(s, d, "events")
    return E.in_scope(ev.where("event_type = 'click' and ts < timestamp_ntz '2024-01-15 00:00:00'"), ev.where("event_type = 'purchase' and value > 50"), ["user_id"], inside=False).select("event_id")


@query("j3_tombstone_sweep", """SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)""")
def j3(s, d):
    known = t(s, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    window = t(s, d, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    return E.in_scope(E.in_scope(t(s, d, "orders"), known, ["o_custkey"]), window, ["o_orderkey"], inside=False).select("o_orderkey")


@query("m1_backoff", """WITH e AS (SELECT *, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS f FROM events), i AS (SELECT *, sum(1 - f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM e),
    s AS (SELECT *, sum(f) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM i)
    SELECT event_id, CAST(streak AS BIGINT) AS streak, CAST(CASE WHEN streak > 0 THEN least(3600, 60 * pow(2, streak - 1)) ELSE 0 END AS BIGINT) AS wait FROM s""")
def m1(s, d):
    run = E.streaks(t(s, d, "events"), "user_id", [F.asc("ts"), F.asc("event_id")], F.col("event_type") == "error")
    return run.select("event_id", "streak", E.backoff(F.col("streak"), 60, 3600).cast("long").alias("wait"))


@query("m11_sliding_usage", """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS last_hour FROM events""")
def m11(s, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-3600000000, 0)
    return t(s, d, "events").withColumn("us", us).select("event_id", F.count("*").over(w).alias("last_hour"))


@query("m17_batches_of_50", "SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 50 AS batch FROM events")
def m17(s, d):
    return t(s, d, "events").select("event_id", F.expr("(row_number() over (partition by user_id order by event_id) - 1) div 50").alias("batch"))


@query("p1_edit_tags", """SELECT user_id, max_by(event_type, (ts, event_id)) AS state FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id""")
def p1(s, d):
    ev = t(s, d, "events").where("event_type in ('click', 'view')")
    return ev.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))


@query("w1_conversation_order", "SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def w1(s, d):
    roles = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    return t(s, d, "conversations").groupBy("conv_id").agg(F.array_join(roles, ">").alias("roles"))
