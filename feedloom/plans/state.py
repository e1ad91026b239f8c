"""SURVEY 2.A, 2.B, 2.E to 2.J, 2.M and 2.P: scopes, marks, re-keying, rules, queues, retention over the driver's tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from feedloom.operators import entries as E
from feedloom.operators import rules as R
from feedloom.operators import state as S
from feedloom.plans.registry import query, t

RULES = "VALUES (1, 'global', ''), (2, 'folder', '3'), (3, 'feed', '7'), (4, 'feeds', '1' || chr(10) || '2' || chr(10)), (5, 'feeds', '')"


@query("a3_in_list", "SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 100)")
def a3(s, d):
    ev = t(s, d, "events")
    return E.in_scope(ev, ev.where("event_type = 'signup' and value > 100"), ["user_id"]).select("event_id")


@query("a6_equi_join", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'")
def a6(s, d):
    return t(s, d, "orders").where("o_orderstatus = 'P'").join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("a11_tags_by_use", "SELECT min(p_type) AS tag, count(*) AS n FROM part GROUP BY lower(p_type) ORDER BY n DESC, lower(min(p_type)) LIMIT 3")
def a11(s, d):
    g = t(s, d, "part").groupBy(F.lower("p_type").alias("k")).agg(F.min("p_type").alias("tag"), F.count("*").alias("n"))
    return g.orderBy(F.desc("n"), "k").limit(3).select("tag", "n")


@query("a18_replace", """SELECT user_id, coalesce(max(CASE WHEN event_type = 'click' THEN event_id END), max(CASE WHEN event_type = 'view' THEN event_id END)) AS event_id FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id""")
def a18(s, d):
    of = lambda kind: t(s, d, "events").where(F.col("event_type") == kind).groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    return S.replaced(of("view"), of("click"), ["user_id"])


@query("a19_key_migration", """WITH k AS (SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL), m AS (SELECT user_id, CASE event_type WHEN 'click' THEN 'view' ELSE event_type END AS event_type, event_id, event_type = 'click' AS moved FROM k)
    SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY moved, event_id) AS r FROM m) WHERE r = 1""")
def a19(s, d):
    k = t(s, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
    return S.rekeyed(k, "event_type", s.sql("select 'click' as old, 'view' as new"), ["user_id", "event_type"], [F.asc("event_id")]).select("user_id", "event_type", "event_id")


@query("a20_delete", "SELECT event_id FROM events WHERE NOT (event_type = 'view' AND value < 10)")
def a20(s, d):
    return t(s, d, "events").where("not (event_type = 'view' and value < 10)").select("event_id")


@query("a21_state_machine", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'in_progress' WHEN o_orderstatus = 'P' AND o_totalprice > 100000 THEN 'failed' WHEN o_orderstatus = 'P' THEN 'complete' ELSE 'done' END AS state FROM orders""")
def a21(s, d):
    st = F.col("o_orderstatus")
    state = F.when(st == "O", "in_progress").when((st == "P") & (F.col("o_totalprice") > 100000), "failed").when(st == "P", "complete").otherwise("done")
    return t(s, d, "orders").select("o_orderkey", state.alias("state"))


@query("a23_counts_by_feed", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def a23(s, d):
    return t(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))


@query("a24_insertion_order", "SELECT p_partkey, CAST(unnest(range(len(string_split(p_name, ' ')))) AS INTEGER) AS ord, unnest(string_split(p_name, ' ')) AS word FROM part")
def a24(s, d):
    return t(s, d, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("ord", "word"))


@query("a29_blob_prefix", "SELECT source, min(substr(hex(encode(text)), 1, 64)) AS head, min(doc_id) AS doc_id FROM documents GROUP BY source")
def a29(s, d):
    head = F.hex(F.substring(F.encode("text", "utf-8"), 1, 32))
    return t(s, d, "documents").groupBy("source").agg(F.min(head).alias("head"), F.min("doc_id").alias("doc_id"))


@query("a30_first_non_empty", "SELECT doc_id, coalesce(nullif(CASE WHEN lang = 'en' THEN '' ELSE lang END, ''), nullif(source, '')) AS label FROM documents")
def a30(s, d):
    lang = F.when(F.col("lang") == "en", "").otherwise(F.col("lang"))
    return t(s, d, "documents").select("doc_id", F.coalesce(F.nullif(lang, F.lit("")), F.nullif("source", F.lit(""))).alias("label"))


@query("b9_label_or_folder", "SELECT doc_id, CASE WHEN source = lower(source) THEN 'tag' ELSE 'folder' END AS kind FROM documents")
def b9(s, d):
    return t(s, d, "documents").select("doc_id", F.when(F.col("source") == F.lower("source"), "tag").otherwise("folder").alias("kind"))


@query("b13_adapter_filter", "SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars >= 200 AND source NOT IN ('src1', 'src3')")
def b13(s, d):
    tags = F.array("source")
    return t(s, d, "documents").where((F.col("lang") == "en") & (F.col("n_chars") >= 200) & ~F.arrays_overlap(tags, F.array(F.lit("src1"), F.lit("src3")))).select("doc_id")


@query("b14_resync_due", """WITH l AS (SELECT user_id, max(CASE WHEN event_type = 'purchase' THEN ts END) AS posted, max(ts) AS synced FROM events GROUP BY user_id),
    g AS (SELECT user_id, synced, date_diff('day', posted, TIMESTAMP '2024-03-01 00:00:00') AS days FROM l), h AS (SELECT user_id, synced, CAST(CASE WHEN days IS NULL THEN 72 WHEN days <= 30 THEN 1 WHEN days <= 180 THEN 6 WHEN days <= 730 THEN 48 ELSE 168 END AS INTEGER) AS hours FROM g)
    SELECT user_id, hours, epoch(TIMESTAMP '2024-03-01 00:00:00') - epoch(synced) >= hours * 3600 AS due FROM h""")
def b14(s, d):
    ts = F.col("ts").cast("timestamp")
    now = F.lit("2024-03-01 00:00:00").cast("timestamp")
    last = t(s, d, "events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "purchase", ts)).alias("posted"), F.max(ts).alias("synced"))
    hours = S.resync_hours(F.datediff(now, "posted"))
    return last.select("user_id", hours.alias("hours"), ((F.unix_micros(now) - F.unix_micros("synced")) / 1e6 >= hours * 3600).alias("due"))


@query("e3_rule_scopes", f"""WITH r(rule_id, scope, scope_id) AS ({RULES}), f AS (SELECT CAST(s_suppkey AS VARCHAR) AS feed, CAST(s_nationkey AS VARCHAR) AS folder FROM supplier)
    SELECT rule_id, feed FROM r JOIN f ON scope = 'global' OR (scope = 'folder' AND folder = scope_id) OR (scope = 'feed' AND feed = scope_id) OR (scope = 'feeds' AND list_contains(string_split(scope_id, chr(10)), feed))""")
def e3(s, d):
    rules = s.sql(f"SELECT col1 AS rule_id, col2 AS scope, col3 AS scope_id FROM ({RULES})")
    feeds = t(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("feed"), F.col("s_nationkey").cast("string").alias("folder"))
    return R.rule_feeds(rules, feeds)


@query("e5_tag_before_limit", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) ORDER BY doc_id DESC LIMIT 20")
def e5(s, d):
    return E.in_scope(t(s, d, "documents"), t(s, d, "labels").where("toxic = 1"), ["doc_id"]).orderBy(F.desc("doc_id")).limit(20).select("doc_id")


@query("e8_orphan_search", """SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND contains(lower(c_name || chr(10) || c_mktsegment), 'build')""")
def e8(s, d):
    gone = t(s, d, "customer").join(t(s, d, "orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return E.search(gone, ["build"], ["c_name", "c_mktsegment"]).select("c_custkey")


@query("e10_dry_run_count", "SELECT count(*) AS n FROM events WHERE event_type = 'view' AND value > 50")
def e10(s, d):
    return t(s, d, "events").where("event_type = 'view' and value > 50").agg(F.count("*").alias("n"))


@query("e12_mark_newer", """SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 250)""")
def e12(s, d):
    ev = t(s, d, "events")
    return E.in_scope(ev.where("ts > timestamp_ntz '2024-01-20 00:00:00'"), ev.where("event_type = 'purchase' and value > 250"), ["user_id"], inside=False).select("event_id")


DATED = "CASE WHEN event_type <> 'signup' THEN ts END"


@query("e13_mark_until", f"SELECT event_id, {DATED} IS NULL OR ts <= TIMESTAMP '2024-01-10 00:00:00' AS stream_client, {DATED} IS NOT NULL AND ts <= TIMESTAMP '2024-01-10 00:00:00' AS item_client FROM events")
def e13(s, d):
    ts, cutoff = F.when(F.col("event_type") != "signup", F.col("ts")), F.expr("timestamp_ntz '2024-01-10 00:00:00'")
    return t(s, d, "events").select("event_id", S.marked_until(ts, cutoff, True).alias("stream_client"), S.marked_until(ts, cutoff, False).alias("item_client"))


@query("e17_tombstones", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def e17(s, d):
    return E.in_scope(t(s, d, "documents"), t(s, d, "labels").where("quality = 0"), ["doc_id"], inside=False).select("doc_id")


@query("e18_hidden_folders", "SELECT r_regionkey, r_name FROM region WHERE NOT starts_with(CASE WHEN r_regionkey = 2 THEN '_' || r_name ELSE r_name END, '_')")
def e18(s, d):
    name = F.when(F.col("r_regionkey") == 2, F.concat(F.lit("_"), "r_name")).otherwise(F.col("r_name"))
    return t(s, d, "region").where(~name.startswith("_")).select("r_regionkey", "r_name")


@query("e19_display_name", "SELECT s_suppkey, coalesce(nullif(CASE WHEN s_suppkey % 3 = 0 THEN '' END, ''), nullif(CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE '' END, ''), 'feed/' || s_suppkey) AS name FROM supplier")
def e19(s, d):
    user = F.when(F.col("s_suppkey") % 3 == 0, "")
    own = F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise("")
    return t(s, d, "supplier").select("s_suppkey", F.coalesce(F.nullif(user, F.lit("")), F.nullif(own, F.lit("")), F.concat(F.lit("feed/"), F.col("s_suppkey").cast("string"))).alias("name"))


@query("e23_unsubscribed", "SELECT c_custkey, c_custkey NOT IN (SELECT o_custkey FROM orders) AS unsubscribed FROM customer")
def e23(s, d):
    live = t(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("live")).distinct()
    return t(s, d, "customer").join(live, "c_custkey", "left").select("c_custkey", F.col("live").isNull().alias("unsubscribed"))


@query("f1_sorted_list", """SELECT event_id FROM events ORDER BY coalesce(CASE WHEN event_type <> 'error' THEN ts END, ts - INTERVAL 1 DAY) DESC, user_id, event_id LIMIT 100""")
def f1(s, d):
    key = F.coalesce(F.when(F.col("event_type") != "error", F.col("ts")), F.expr("ts - interval 1 day"))
    return t(s, d, "events").orderBy(key.desc(), "user_id", "event_id").limit(100).select("event_id")


@query("f3_id_paging", "SELECT event_id FROM events WHERE event_id < 500 ORDER BY event_id DESC LIMIT 50")
def f3(s, d):
    return E.after_cursor(t(s, d, "events"), F.col("event_id"), 500, 50, []).select("event_id")


@query("f5_chunk", "SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) AS position FROM events WHERE event_type = 'purchase' ORDER BY value DESC, event_id LIMIT 10 OFFSET 20")
def f5(s, d):
    return E.page(t(s, d, "events").where("event_type = 'purchase'"), [F.desc("value"), F.asc("event_id")], 10, 3).select("event_id", F.col("position").cast("long").alias("position"))


@query("g2_feeds_in_folders", "SELECT s_suppkey, n_name AS folder FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE NOT starts_with(r_name, '_')")
def g2(s, d):
    folders = t(s, d, "nation").join(t(s, d, "region").where(~F.col("r_name").startswith("_")), F.col("n_regionkey") == F.col("r_regionkey"))
    return t(s, d, "supplier").join(folders, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("folder"))


@query("g8_orphan_stars", "SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def g8(s, d):
    return E.in_scope(t(s, d, "labels"), t(s, d, "documents").where("lang = 'en'"), ["doc_id"], inside=False).select("doc_id")


@query("g11_disposition", """WITH k AS (SELECT user_id, bool_or(event_type = 'purchase' AND value > 100) AS star, bool_or(event_type = 'click' AND value > 100) AS tag, bool_or(event_type = 'view') AS live FROM events GROUP BY user_id)
    SELECT user_id, CASE WHEN live AND (star OR tag) THEN 'kept' WHEN star THEN 'star-only' WHEN tag THEN 'tag-only' ELSE 'uncurated' END AS disposition FROM k""")
def g11(s, d):
    k = t(s, d, "events").groupBy("user_id").agg(F.expr("bool_or(event_type = 'purchase' and value > 100)").alias("star"), F.expr("bool_or(event_type = 'click' and value > 100)").alias("tag"), F.expr("bool_or(event_type = 'view')").alias("live"))
    return k.select("user_id", F.when(F.col("live") & (F.col("star") | F.col("tag")), "kept").when(F.col("star"), "star-only").when(F.col("tag"), "tag-only").otherwise("uncurated").alias("disposition"))


TITLES = "SELECT conv_id * 1000 + turn AS id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: w <> '')) AS w FROM conversations"


@query("g15_fuzzy_titles", f"""WITH d AS ({TITLES}), k AS (SELECT min(id) AS id, list_sort(w) AS w FROM d WHERE len(w) >= 5 GROUP BY list_sort(w)),
    p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.w, b.w)) AS shared, len(a.w) + len(b.w) AS total FROM k a JOIN k b ON a.id < b.id AND least(len(a.w), len(b.w)) * 100 >= greatest(len(a.w), len(b.w)) * 25)
    SELECT a, b, CAST(shared AS INTEGER) AS shared, CAST(total - shared AS INTEGER) AS united FROM p WHERE shared * 100 >= (total - shared) * 25""")
def g15(s, d):
    return R.fuzzy_pairs(t(s, d, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn")), "id", F.split(F.lower("text"), "[^a-z]+"), 25, 5)


@query("g17_false_matches", """WITH g AS (SELECT md5(text) AS k, min(doc_id) AS keeper FROM documents GROUP BY 1), m AS (SELECT doc_id AS marked, keeper FROM documents d JOIN g ON md5(d.text) = g.k WHERE doc_id <> keeper)
    SELECT marked, keeper FROM m WHERE (keeper, marked) NOT IN (SELECT doc_id, doc_id + 1 FROM labels)""")
def g17(s, d):
    docs = t(s, d, "documents").select("doc_id", F.md5("text").alias("k"))
    m = docs.join(docs.groupBy("k").agg(F.min("doc_id").alias("keeper")), "k").where("doc_id <> keeper").select(F.col("doc_id").alias("marked"), "keeper")
    false = t(s, d, "labels").select(F.col("doc_id").alias("keeper"), (F.col("doc_id") + 1).alias("marked"))
    return m.join(false, ["keeper", "marked"], "left_anti").select("marked", "keeper")


@query("g18_actionable", """SELECT count(*) FILTER (n > 1) AS all_groups, count(*) FILTER (u > 1) AS unread_groups FROM (SELECT user_id, props, count(*) AS n, count(*) FILTER (event_type <> 'click') AS u FROM events GROUP BY ALL)""")
def g18(s, d):
    g = t(s, d, "events").groupBy("user_id", "props").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") != "click").alias("u"))
    return g.agg(F.count_if(F.col("n") > 1).alias("all_groups"), F.count_if(F.col("u") > 1).alias("unread_groups"))


@query("g19_identifier_churn", """SELECT event_id FROM events n WHERE ts >= TIMESTAMP '2024-01-28 00:00:00' AND event_type <> 'click'
    AND EXISTS (SELECT 1 FROM events o WHERE o.user_id = n.user_id AND o.props = n.props AND o.ts < TIMESTAMP '2024-01-28 00:00:00' AND o.ts >= n.ts - INTERVAL 7 DAY)""")
def g19(s, d):
    ev = t(s, d, "events")
    new = ev.where("ts >= timestamp_ntz '2024-01-28 00:00:00' and event_type <> 'click'")
    old = ev.where("ts < timestamp_ntz '2024-01-28 00:00:00'").groupBy("user_id", "props").agg(F.max("ts").alias("last"))
    return new.join(old, ["user_id", "props"]).where("last >= ts - interval 7 days").select("event_id")


@query("g20_marked_copies", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(text), source ORDER BY doc_id) AS r FROM documents WHERE source <> 'src0') WHERE r > 1")
def g20(s, d):
    docs = t(s, d, "documents").where("source <> 'src0'").select("doc_id", "source", F.md5("text").alias("k"))
    keep = docs.groupBy("k", "source").agg(F.min("doc_id").alias("keep"))
    return docs.join(keep, ["k", "source"]).where("doc_id <> keep").select("doc_id")


@query("g21_saved_duplicates", """WITH k AS (SELECT page_id, url, length(html) > 2000 AS body, starts_with(url, 'https') AS secure, regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '^[a-z]+://(www\\.|m\\.)?', '') AS k FROM pages)
    SELECT page_id, first_value(page_id) OVER w AS keeper FROM k WINDOW w AS (PARTITION BY k ORDER BY body DESC, secure DESC, page_id) QUALIFY count(*) OVER (PARTITION BY k) > 1""")
def g21(s, d):
    key = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/+$", ""), r"^[a-z]+://(www\.|m\.)?", "")
    k = t(s, d, "pages").select("page_id", key.alias("k"), F.struct((F.length("html") <= 2000).alias("a"), (~F.col("url").startswith("https")).alias("b"), F.col("page_id").alias("id")).alias("rank"))
    g = k.groupBy("k").agg(F.min("rank").alias("best"), F.count("*").alias("n")).where("n > 1")
    return k.join(g, "k").select("page_id", F.col("best.id").alias("keeper"))


@query("g23_collisions", """WITH k AS (SELECT s_suppkey, s_nationkey, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) AS curated FROM supplier)
    SELECT s_suppkey AS dupe, first_value(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY curated DESC, s_suppkey) AS survivor, curated FROM k""")
def g23(s, d):
    n = t(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("curated"))
    k = t(s, d, "supplier").join(n, "s_suppkey", "left").select("s_suppkey", "s_nationkey", F.coalesce("curated", F.lit(0)).alias("curated"))
    best = k.groupBy("s_nationkey").agg(F.max_by("s_suppkey", F.struct("curated", -F.col("s_suppkey"))).alias("survivor"))
    return k.join(best, "s_nationkey").select(F.col("s_suppkey").alias("dupe"), "survivor", "curated")


@query("g25_several_folders", "SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) > 3")
def g25(s, d):
    return t(s, d, "events").groupBy("user_id").agg(F.countDistinct("event_type").alias("n")).where("n > 3").select("user_id")


@query("g26_set_operations", """SELECT 'union' AS op, count(*) AS n FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
    UNION ALL SELECT 'intersect', count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
    UNION ALL SELECT 'except', count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def g26(s, d):
    of = lambda st: t(s, d, "orders").where(F.col("o_orderstatus") == st).select("o_custkey")
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
    a, b = of("F"), of("P")
    return n(a.union(b).distinct(), "union").union(n(a.intersect(b), "intersect")).union(n(a.subtract(b), "except"))


@query("g29_live_copies", """SELECT event_id FROM (SELECT event_id, event_type = 'view' AS live, count(*) FILTER (event_type = 'view') OVER (PARTITION BY user_id, props) AS n FROM events) WHERE live OR n = 0""")
def g29(s, d):
    n = F.count_if(F.col("event_type") == "view").over(Window.partitionBy("user_id", "props"))
    return t(s, d, "events").select("event_id", (F.col("event_type") == "view").alias("live"), n.alias("n")).where("live or n = 0").select("event_id")


@query("g30_reattached", "SELECT l.doc_id, d.source FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE l.doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'de')")
def g30(s, d):
    lost = E.in_scope(t(s, d, "labels"), t(s, d, "documents").where("lang = 'de'"), ["doc_id"], inside=False)
    return lost.join(t(s, d, "documents"), "doc_id").select("doc_id", "source")


@query("h4_alias_preview", "SELECT p_type AS tag, count(*) FILTER (p_size < 20) AS manual, count(*) FILTER (p_size >= 20) AS feed FROM part GROUP BY p_type")
def h4(s, d):
    return t(s, d, "part").groupBy(F.col("p_type").alias("tag")).agg(F.count_if(F.col("p_size") < 20).alias("manual"), F.count_if(F.col("p_size") >= 20).alias("feed"))


@query("h5_counts_by_scope", "SELECT r_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def h5(s, d):
    per = t(s, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    j = per.join(t(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name").agg(F.sum("n").alias("n"))


@query("h12_repeated_captions", "SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY source, md5(text)) = 1 THEN md5(text) END AS caption FROM documents")
def h12(s, d):
    once = F.count("*").over(Window.partitionBy("source", "h")) == 1
    return t(s, d, "documents").select("doc_id", "source", F.md5("text").alias("h")).select("doc_id", F.when(once, F.col("h")).alias("caption"))


@query("h13_error_categories", """SELECT CASE WHEN contains(e, '403') OR contains(e, 'forbidden') THEN 'blocked' WHEN contains(e, '429') THEN 'rate_limited' WHEN contains(e, '404') OR contains(e, 'not found') THEN 'not_found' WHEN contains(e, 'timeout') THEN 'timeout' ELSE 'other' END AS category, count(*) AS n FROM (
    SELECT CASE CAST(event_id % 6 AS INTEGER) WHEN 0 THEN 'http 403 for url' WHEN 1 THEN 'forbidden by host' WHEN 2 THEN 'status 429' WHEN 3 THEN 'page not found' WHEN 4 THEN 'read timeout' ELSE 'unknown' END AS e FROM events) GROUP BY 1""")
def h13(s, d):
    k = F.col("event_id") % 6
    e = F.when(k == 0, "HTTP 403 for url").when(k == 1, "Forbidden by host").when(k == 2, "status 429").when(k == 3, "Page not found").when(k == 4, "read timeout").otherwise("unknown")
    return t(s, d, "events").groupBy(R.failure_category(e).alias("category")).agg(F.count("*").alias("n"))


@query("h15_weekly_rate", """SELECT user_id, count(*)::DOUBLE / greatest(1.0, date_diff('day', CAST(min(ts) AS DATE), DATE '2024-03-01') / 7.0) AS per_week FROM events GROUP BY user_id""")
def h15(s, d):
    weeks = F.greatest(F.lit(1.0), F.datediff(F.lit("2024-03-01").cast("date"), F.min("ts").cast("date")) / 7.0)
    return t(s, d, "events").groupBy("user_id").agg((F.count("*").cast("double") / weeks).alias("per_week"))


@query("h16_filter_diagnostics", "SELECT count(*) AS total, count(*) FILTER (lang = 'de' AND source <> 'src2') AS cut, count(*) FILTER (lang = 'de' AND source = 'src2') AS rescued FROM documents")
def h16(s, d):
    tags = F.array("lang", "source")
    cut, drop = ~E.tag_filter(tags, "-de,+src2"), F.array_contains(tags, "de")
    return t(s, d, "documents").agg(F.count("*").alias("total"), F.count_if(cut).alias("cut"), F.count_if(drop & ~cut).alias("rescued"))


@query("h17_run_log", "SELECT l_suppkey, l_orderkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' GROUP BY ALL")
def h17(s, d):
    runs = t(s, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return t(s, d, "lineitem").join(runs, "l_orderkey", "left_semi").groupBy("l_suppkey", "l_orderkey").agg(F.count("*").alias("n"))


@query("h19_distinct_counts", "SELECT count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs FROM documents")
def h19(s, d):
    return t(s, d, "documents").agg(F.countDistinct("source").alias("sources"), F.countDistinct("lang").alias("langs"))


@query("h22_repeated_images", "SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) >= 3")
def h22(s, d):
    return t(s, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n")).where("n >= 3")


@query("h23_drift_report", """SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), CAST(first AS DATE)) AS days FROM orders JOIN (SELECT l_orderkey, min(l_shipdate) AS first, max(l_shipdate) AS last FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey
    WHERE abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(first AS DATE))) > 30 AND abs(date_diff('day', CAST(first AS DATE), CAST(last AS DATE))) <= 60""")
def h23(s, d):
    a = t(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))
    j = t(s, d, "orders").join(a, "o_orderkey").select("o_orderkey", F.datediff("first", "o_orderdate").cast("long").alias("days"), F.datediff("last", "first").alias("spread"))
    return j.where("abs(days) > 30 and spread <= 60").select("o_orderkey", "days")


@query("i5_rule_chain", """SELECT doc_id, CASE WHEN lang = 'fr' THEN 'hide' WHEN contains(lower(text), 'token') THEN 'mark_as_read' WHEN source = 'src1' THEN 'tag_filter' END AS rule FROM documents""")
def i5(s, d):
    from feedloom.functions.text import keyword_match

    rules = [("hide", F.col("lang") == "fr"), ("mark_as_read", keyword_match(F.col("text"), "Token")), ("tag_filter", ~E.tag_filter(F.array("lang", "source"), "-src1"))]
    return R.chained(t(s, d, "documents"), rules).select("doc_id", "rule")


@query("i6_applicable_rules", f"""WITH r(rule_id, scope, scope_id) AS ({RULES}), f AS (SELECT CAST(s_suppkey AS VARCHAR) AS feed, CAST(s_nationkey AS VARCHAR) AS folder FROM supplier)
    SELECT feed, string_agg(CAST(rule_id AS VARCHAR), ',' ORDER BY rule_id) AS rules FROM r JOIN f ON scope = 'global' OR (scope = 'folder' AND folder = scope_id) OR (scope = 'feed' AND feed = scope_id) OR (scope = 'feeds' AND list_contains(string_split(scope_id, chr(10)), feed)) GROUP BY feed""")
def i6(s, d):
    return e3(s, d).groupBy("feed").agg(F.array_join(F.transform(F.array_sort(F.collect_set("rule_id")), lambda x: x.cast("string")), ",").alias("rules"))


@query("i7_claims", "SELECT DISTINCT user_id, event_type FROM events WHERE value > 100 EXCEPT SELECT user_id, event_type FROM events WHERE value < 20")
def i7(s, d):
    ev = t(s, d, "events").select("user_id", "event_type", "value")
    return E.first_wins(ev.where("value < 20"), ev.where("value > 100"), ["user_id", "event_type"]).select("user_id", "event_type")


@query("i8_redundant_rules", "SELECT p_type, p_brand, count(*) AS n, min(p_partkey) AS keep FROM part GROUP BY ALL HAVING count(*) > 1")
def i8(s, d):
    return R.redundant(t(s, d, "part").withColumnRenamed("p_partkey", "rule_id"), ["p_type", "p_brand"])


@query("i9_categories", """SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN 'Law' WHEN contains(lower(text), 'token') OR contains(lower(text), 'password') THEN 'Secrets' END AS folder FROM documents""")
def i9(s, d):
    return t(s, d, "documents").select("doc_id", R.first_category(F.col("text"), {"Law": ("license",), "Secrets": ("token", "password")}).alias("folder"))


@query("j2_purge_count", """SELECT s_nationkey, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_shipdate < TIMESTAMP '1996-01-01 00:00:00' AND l_returnflag = 'R' GROUP BY s_nationkey""")
def j2(s, d):
    per = t(s, d, "lineitem").where("l_shipdate < timestamp_ntz '1996-01-01 00:00:00' and l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    return per.join(t(s, d, "supplier"), "s_suppkey").groupBy("s_nationkey").agg(F.sum("n").alias("n"))


@query("j3_tombstone_window", """WITH w AS (SELECT DISTINCT user_id, props FROM events WHERE event_type = 'view') SELECT event_id FROM events e WHERE event_type = 'error' AND NOT (ts < TIMESTAMP '2024-01-15 00:00:00'
    AND user_id IN (SELECT user_id FROM w) AND (user_id, props) NOT IN (SELECT user_id, props FROM w))""")
def j3(s, d):
    ev = t(s, d, "events")
    return S.swept(ev.where("event_type = 'error'"), ev.where("event_type = 'view'").select("user_id", "props"), "user_id", "props", F.expr("ts < timestamp_ntz '2024-01-15 00:00:00'")).select("event_id")


@query("j7_undo_batch", "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' THEN 'O' ELSE o_orderstatus END AS status FROM orders")
def j7(s, d):
    batch = (F.col("o_orderpriority") == "1-URGENT") & F.expr("o_orderdate >= timestamp_ntz '1996-01-01 00:00:00'")
    return t(s, d, "orders").select("o_orderkey", F.when(batch, "O").otherwise(F.col("o_orderstatus")).alias("status"))


@query("m3_due_times", """WITH k AS (SELECT user_id, max(CASE WHEN event_type = 'error' THEN event_id END) AS f, max(CASE WHEN event_type = 'view' THEN event_id END) AS h, max(CASE WHEN event_type = 'click' THEN event_id END) AS u FROM events GROUP BY 1)
    SELECT user_id, greatest(f, h, u) AS due, CASE WHEN greatest(f, h, u) IS NULL THEN NULL WHEN f = greatest(f, h, u) THEN 'feed' WHEN h = greatest(f, h, u) THEN 'domain' ELSE 'server' END AS reason FROM k""")
def m3(s, d):
    of = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("event_id")))
    k = t(s, d, "events").groupBy("user_id").agg(of("error").alias("f"), of("view").alias("h"), of("click").alias("u"))
    due, reason = S.due_at(F.col("f"), F.col("h"), F.col("u"))
    return k.select("user_id", due.alias("due"), reason.alias("reason"))


@query("m4_failure_actions", "SELECT event_id, CASE WHEN s = 410 THEN 'disable' WHEN s IN (403, 415, 429, 503) OR value > 200 THEN 'escalate' ELSE 'back_off' END AS action FROM (SELECT event_id, value, 400 + event_id % 105 AS s FROM events WHERE event_type = 'error')")
def m4(s, d):
    return t(s, d, "events").where("event_type = 'error'").select("event_id", S.failure_action(400 + F.col("event_id") % 105, F.col("value") > 200).alias("action"))


@query("m5_paced_schedule", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) * 7 AS tenths FROM events")
def m5(s, d):
    return t(s, d, "events").select("event_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long") * 7).alias("tenths"))


@query("m6_paced_outcomes", """WITH e AS (SELECT *, CASE WHEN event_type IN ('error', 'view', 'purchase') THEN 1 ELSE 0 END AS bad FROM events), i AS (SELECT *, sum(1 - bad) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM e),
    s AS (SELECT *, sum(bad) OVER (PARTITION BY user_id, island ORDER BY event_id) AS streak FROM i), b AS (SELECT *, max(streak) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s)
    SELECT event_id, CASE WHEN coalesce(before, 0) >= 4 THEN 'skipped_host' WHEN bad = 1 THEN 'failed' ELSE 'ok' END AS outcome FROM b""")
def m6(s, d):
    return S.paced(t(s, d, "events"), "user_id", [F.asc("event_id")], F.col("event_type").isin("error", "view", "purchase")).select("event_id", "outcome")


@query("m12_leases", "SELECT event_id FROM events WHERE event_type = 'signup' AND ts < TIMESTAMP '2024-01-16 00:00:00'")
def m12(s, d):
    return t(s, d, "events").where("event_type = 'signup' and ts < timestamp_ntz '2024-01-16 00:00:00'").select("event_id")


@query("m16_negative_retry", "SELECT c_custkey FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1) ON c_custkey = o_custkey WHERE last IS NULL OR last < TIMESTAMP '1997-01-01 00:00:00'")
def m16(s, d):
    last = t(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"))
    return t(s, d, "customer").join(last, "c_custkey", "left").where("last is null or last < timestamp_ntz '1997-01-01 00:00:00'").select("c_custkey")


@query("p4_toggle_bookmarks", "SELECT d.doc_id, coalesce(quality = 1, false) <> (toxic = 1 AND toxic IS NOT NULL) AS starred FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def p4(s, d):
    j = t(s, d, "documents").select("doc_id").join(t(s, d, "labels"), "doc_id", "left")
    return j.select("doc_id", (F.coalesce(F.col("quality") == 1, F.lit(False)) != F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("starred"))


@query("p6_gestures", """WITH k AS (SELECT user_id, max_by(event_type, event_id) AS last, bool_or(event_type = 'purchase') AS star, bool_or(event_type = 'signup') AS tags FROM events GROUP BY user_id),
    g AS (SELECT *, CASE last WHEN 'click' THEN 'archive' WHEN 'error' THEN 'discard' WHEN 'view' THEN 'star' WHEN 'signup' THEN 'unstar' END AS g FROM k)
    SELECT user_id, CASE WHEN g = 'star' THEN true WHEN g IN ('unstar', 'archive', 'discard') THEN false ELSE star END AS star, CASE WHEN g = 'discard' THEN false ELSE tags END AS tags,
    coalesce(g = 'archive', false) AS archived, coalesce(g IN ('archive', 'discard'), false) AS read FROM g""")
def p6(s, d):
    k = t(s, d, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last"), F.bool_or(F.col("event_type") == "purchase").alias("star"), F.bool_or(F.col("event_type") == "signup").alias("tags"))
    last = F.col("last")
    g = F.when(last == "click", "archive").when(last == "error", "discard").when(last == "view", "star").when(last == "signup", "unstar")
    return k.select("user_id", *S.gesture(g, F.col("star"), F.col("tags"), F.lit(False), F.lit(False)))


@query("p7_tag_rename", "SELECT DISTINCT doc_id, CASE WHEN lang = 'fr' THEN 'de' ELSE lang END AS tag FROM documents")
def p7(s, d):
    return S.rekeyed(t(s, d, "documents").select("doc_id", F.col("lang").alias("tag")), "tag", s.sql("select 'fr' as old, 'de' as new"), ["doc_id", "tag"], []).select("doc_id", "tag")


@query("p8_suppressed_tags", "SELECT doc_id, source FROM documents WHERE lower(source) NOT IN ('src1', 'src2')")
def p8(s, d):
    gone = s.sql("select explode(array('SRC1', 'Src2')) as tag").select(F.lower("tag").alias("k"))
    return t(s, d, "documents").withColumn("k", F.lower("source")).join(F.broadcast(gone), "k", "left_anti").select("doc_id", "source")  # two rows


@query("p9_feed_removed", "SELECT event_id FROM events WHERE user_id <> 3 OR (user_id, props) IN (SELECT user_id, props FROM events WHERE event_type = 'purchase')")
def p9(s, d):
    ev = t(s, d, "events")
    kept = ev.where("event_type = 'purchase'").select("user_id", "props").distinct()
    return ev.where("user_id <> 3").unionByName(ev.where("user_id = 3").join(kept, ["user_id", "props"], "left_semi")).select("event_id")


@query("p11_enqueue", """WITH q AS (SELECT user_id, CASE WHEN max(value) > 400 THEN 'complete' ELSE 'failed' END AS status FROM events WHERE event_type = 'view' GROUP BY 1), k AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 300)
    SELECT coalesce(q.user_id, k.user_id) AS user_id, CASE WHEN k.user_id IS NOT NULL THEN 'pending' ELSE status END AS status FROM q FULL JOIN k ON q.user_id = k.user_id""")
def p11(s, d):
    ev = t(s, d, "events")
    q = ev.where("event_type = 'view'").groupBy("user_id").agg(F.when(F.max("value") > 400, "complete").otherwise("failed").alias("status"))
    return S.enqueued(q, ev.where("event_type = 'purchase' and value > 300"), ["user_id"])
