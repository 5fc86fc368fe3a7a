"""Queries of aggregates, dedup, latest rows and incremental state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docweave.functions.keys import content_hash, hash_bucket
from docweave.operators import keyed, lookups, ordering, views
from docweave.registry import query, table
from docweave.sources.deltas import Store, Stores
from docweave.sources.tables import fresh_path

EVENT_TYPES = ("view", "click", "signup", "purchase", "error")


@query("daily_change_counts", f"""
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, {", ".join(f"CAST(count(*) FILTER (event_type = '{t}') AS BIGINT) AS n_{t}" for t in EVENT_TYPES)},
       CAST(count(*) FILTER (event_type = 'purchase' AND value >= 10 OR event_type = 'error') AS BIGINT) AS n_important
FROM events GROUP BY 1""")
def daily_change_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    important = (F.col("event_type") == "purchase") & (F.col("value") >= 10) | (F.col("event_type") == "error")
    tests = {f"n_{t}": F.col("event_type") == t for t in EVENT_TYPES}
    return keyed.conditional_counts(e, [F.to_date("ts").cast("string").alias("day")], **tests, n_important=important)


@query("day_summary_nested", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id
FROM events GROUP BY 1, 2""")
def day_summary_nested(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.struct(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")).alias("s"))
    days = rows.groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "s"))).alias("types"))
    return days.select("day", F.explode("types").alias("event_type", "s")).select("day", "event_type", "s.*")


@query("target_latest", "SELECT o_custkey, CAST(max(o_orderdate) AS VARCHAR) AS latest FROM orders GROUP BY o_custkey")
def target_latest(spark, sf_dir):
    return keyed.latest_per_key(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate").select("o_custkey", F.date_format("latest", "yyyy-MM-dd HH:mm:ss").alias("latest"))


@query("latest_row_per_key", """
SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1""")
def latest_row_per_key(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate")
    return keyed.last_per_key(o, ["o_custkey"], "o_orderdate", -F.col("o_orderkey")).drop("o_orderdate")


@query("first_seen_dedup", "SELECT min(doc_id) AS doc_id, count(*) AS n, arg_min(source, doc_id) AS source FROM documents GROUP BY text")
def first_seen_dedup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    firsts = keyed.first_per_key(d, ["h"], "doc_id")
    return firsts.join(d.groupBy("h").agg(F.count("*").alias("n")), "h").select("doc_id", "n", "source")


@query("content_hash_dedup", "SELECT substr(sha1(text), 1, 12) AS h, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1")
def content_hash_dedup(spark, sf_dir):
    return keyed.equal_groups(table(spark, sf_dir, "documents"), F.substring(F.sha1("text"), 1, 12), "doc_id")


@query("canonical_content_hash", "SELECT count(DISTINCT (lang, source, text)) AS n_bodies, count(*) AS n FROM documents")
def canonical_content_hash(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(content_hash("lang", "source", "text").alias("h"))
    return d.groupBy("h").count().agg(F.count("*").alias("n_bodies"), F.sum("count").alias("n"))


@query("hash_buckets", """
WITH h AS (SELECT lpad(CAST(CAST('0x' || substr(sha1(text), 1, 2) AS BIGINT) % 64 AS VARCHAR), 2, '0') AS bucket, doc_id FROM documents),
b AS (SELECT lpad(CAST(i AS VARCHAR), 2, '0') AS bucket FROM range(64) t(i))
SELECT b.bucket, count(h.doc_id) AS n FROM b LEFT JOIN h ON h.bucket = b.bucket GROUP BY b.bucket""")
def hash_buckets(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy(hash_bucket(F.sha1("text")).alias("bucket")).count()
    every = spark.range(64).select(F.lpad(F.col("id").cast("string"), 2, "0").alias("bucket"))
    return every.join(counts, "bucket", "left").select("bucket", F.coalesce("count", F.lit(0)).cast("long").alias("n"))


@query("anti_new_rows", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def anti_new_rows(spark, sf_dir):
    stored = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return lookups.new_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), stored, ["o_orderkey"])


@query("semi_known_rows", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)")
def semi_known_rows(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    return lookups.referenced(table(spark, sf_dir, "part").select("p_partkey", "p_name"), used, "p_partkey")


@query("stale_targets", """
WITH t AS (SELECT o_custkey AS u, max(o_orderdate) AS t FROM orders GROUP BY 1),
s AS (SELECT o_custkey AS u, max(o_orderdate) AS t, CASE WHEN o_custkey % 7 = 0 THEN 1 ELSE 2 END AS v FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01' GROUP BY 1, 3)
SELECT t.u, CASE WHEN s.t IS NULL THEN 'missing' WHEN s.t <> t.t THEN 'changed' ELSE 'version' END AS why
FROM t LEFT JOIN s ON s.u = t.u WHERE s.t IS NULL OR s.t <> t.t OR s.v <> 2""")
def stale_targets(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("u"), "o_orderdate")
    targets = o.groupBy("u").agg(F.max("o_orderdate").alias("t"))
    state = o.where(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp")).groupBy("u").agg(F.max("o_orderdate").alias("t")).withColumn("v", F.when(F.col("u") % 7 == 0, 1).otherwise(2))
    return lookups.stale(targets, state, "u", "t", "v", 2).select("u", "why")


@query("mode_with_ties", """
WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n, min(c_custkey) AS f FROM customer GROUP BY 1, 2)
SELECT c_nationkey, c_mktsegment, n FROM c QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, f) = 1""")
def mode_with_ties(spark, sf_dir):
    return keyed.mode_first_seen(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_mktsegment", "c_custkey")


@query("merge_by_id_union", """
WITH f AS (SELECT l_orderkey, l_returnflag, min(l_linenumber) AS p FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, string_agg(l_returnflag, ',' ORDER BY p, l_returnflag) AS l_returnflag, count(*) AS n FROM f GROUP BY 1""")
def merge_by_id_union(spark, sf_dir):
    return keyed.ordered_union(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag", "l_linenumber")


@query("conditional_store_stats", """
SELECT count(*) AS docs, count(l.doc_id) AS with_label, count(*) FILTER (l.doc_id IS NULL) AS pending, CAST(sum(n_chars) AS BIGINT) AS chars,
       count(*) FILTER (l.toxic = 1) AS toxic, count(*) FILTER (l.quality = 0) AS bad, count(DISTINCT d.source) AS sources
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def conditional_store_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source")
    labels = table(spark, sf_dir, "labels").withColumn("has", F.lit(True))
    has = F.col("has").isNotNull()
    return keyed.store_statistics(d.join(labels, "doc_id", "left"), {"chars": "n_chars"}, {"sources": "source"}, with_label=has, pending=~has, toxic=F.col("toxic") == 1, bad=F.col("quality") == 0)


@query("union_overwrite", """
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS p_name, CASE WHEN p_partkey % 2 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part""")
def union_overwrite(spark, sf_dir):
    """A sheet of all parts but some of the even ones, and a later one of the even parts, which wins."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    first = p.where("p_partkey % 6 <> 0").withColumn("sheet", F.lit(0))
    second = p.where("p_partkey % 2 = 0").select("p_partkey", F.upper("p_name").alias("p_name"), (F.col("p_size") + 1).alias("p_size"), F.lit(1).alias("sheet"))
    return keyed.last_per_key(first.unionByName(second), ["p_partkey"], "sheet").drop("sheet")


@query("snapshot_except", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
a AS (SELECT line FROM l WHERE doc_id % 2 = 0), b AS (SELECT line FROM l WHERE doc_id % 2 = 1)
SELECT 'removed' AS kind, line, count(*) AS n FROM (FROM a EXCEPT ALL FROM b) GROUP BY line
UNION ALL SELECT 'added', line, count(*) FROM (FROM b EXCEPT ALL FROM a) GROUP BY line""")
def snapshot_except(spark, sf_dir):
    """The lines of the even documents as the old snapshot, those of the odd ones as the new."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return keyed.multiset_changes(lines, F.col("doc_id") % 2 == 0, "line").select("kind", "line", "n")


#: What three overlapping batches say of an event: which could not be fetched, which failed.
_ATTEMPTS = """
SELECT event_id, user_id, event_type, CAST(ts AS DATE) AS day, 0 AS batch, CASE WHEN event_id % 7 = 0 THEN 'GET failed: 503' WHEN event_id % 5 = 0 THEN 'timeout' END AS error FROM events WHERE ts < TIMESTAMP '2024-01-20'
UNION ALL SELECT event_id, user_id, event_type, CAST(ts AS DATE), 1, CASE WHEN event_id % 11 = 0 THEN 'parse' END FROM events WHERE ts >= TIMESTAMP '2024-01-13'
UNION ALL SELECT event_id, user_id, event_type, CAST(ts AS DATE), 2, CASE WHEN event_id % 2 = 1 THEN 'late' END FROM events WHERE ts < TIMESTAMP '2024-01-20'"""


@query("feed_merge_idempotent", f"""
WITH a AS ({_ATTEMPTS}),
u AS (SELECT * FROM a WHERE event_type <> 'error' AND (error IS NULL OR error NOT LIKE 'GET failed%')),
b AS (SELECT *, min(batch) OVER (PARTITION BY event_id) AS first_batch FROM u
  QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY error IS NOT NULL, CASE WHEN error IS NULL THEN batch ELSE -batch END) = 1),
d AS (SELECT user_id, CAST(day AS VARCHAR) AS day, min(batch) AS first_batch FROM a WHERE event_type = 'error' GROUP BY ALL)
SELECT 'update' AS kind, CAST(day AS VARCHAR) AS day, CAST(event_id AS VARCHAR) AS key, error, CAST(first_batch AS BIGINT) AS first_batch, CAST(row_number() OVER (PARTITION BY day ORDER BY first_batch, event_id) AS BIGINT) AS place FROM b
UNION ALL SELECT 'delete', day, CAST(user_id AS VARCHAR), NULL, CAST(first_batch AS BIGINT), CAST(row_number() OVER (PARTITION BY day ORDER BY first_batch, user_id) AS BIGINT) FROM d""")
def feed_merge_idempotent(spark, sf_dir):
    """All events in three overlapping batches, each merged twice, into a store of updates and one of deletes.

    A good row stays, a failed one is replaced in its place, what couldn't be fetched is left out; a user is deleted once a day.
    """
    attempts = spark.sql(_ATTEMPTS.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))
    stores = Stores(spark, fresh_path(spark, "feed"), [Store("updates", ("day", "event_id"), "day date, event_id long, error string"), Store("deletes", ("day", "user_id"), "day date, user_id long, error string")], fan=3)
    for number in (0, 1, 2):
        batch = attempts.where(F.col("batch") == number)
        both = {"updates": (batch.where("event_type <> 'error'").select("day", "event_id", "error"), "event_id"), "deletes": (batch.where("event_type = 'error'").select("day", "user_id", F.lit(None).cast("string").alias("error")), "user_id")}
        stores.merge(number, both)
        stores.merge(number, both)
    stores.compact()
    place = F.row_number().over(Window.partitionBy("day").orderBy("first_batch", "first_pos")).cast("long").alias("place")  # one day's rows
    updates, deletes = stores.read("updates").withColumn("key", F.col("event_id").cast("string")), stores.read("deletes").withColumn("key", F.col("user_id").cast("string"))
    shown = lambda rows, kind: rows.select(F.lit(kind).alias("kind"), F.col("day").cast("string").alias("day"), "key", "error", "first_batch", place)
    return shown(updates, "update").unionByName(shown(deletes, "delete"))


#: Orders after their changes: paid ones went, prices of open ones rose, a day was added to them.
_CHANGED = """
SELECT o_orderpriority AS p, o_custkey AS c, CASE WHEN o_orderstatus = 'O' THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END AS d, o_orderstatus AS s,
  CAST(round(o_totalprice * 100) AS BIGINT) + CASE WHEN o_orderstatus = 'O' THEN 100 ELSE 0 END AS cents FROM orders WHERE o_orderstatus <> 'P'"""


@query("maintained_statistics", f"""
WITH r AS ({_CHANGED}),
m AS (SELECT p, c FROM r GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY p ORDER BY count(*) DESC, c) = 1)
SELECT r.p, count(*) AS n, CAST(count(*) FILTER (s = 'O') AS BIGINT) AS n_open, CAST(sum(cents) AS BIGINT) AS cents, count(DISTINCT r.c) AS customers, CAST(any_value(m.c) AS BIGINT) AS most, CAST(max(d) AS VARCHAR) AS latest
FROM r JOIN m ON m.p = r.p GROUP BY r.p""")
def maintained_statistics(spark, sf_dir):
    """Counts, sums, distinct and most frequent customers and the latest day, kept through deletions and replacements of all orders."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("p"), F.col("o_custkey").cast("long").alias("c"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("d"), F.col("o_orderstatus").alias("s"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    gone, open_ = o.where("s = 'P'"), o.where("s = 'O'")
    later = open_.withColumn("d", F.date_format(F.col("d").cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY"), "yyyy-MM-dd HH:mm:ss")).withColumn("cents", F.col("cents") + 100)
    none = o.where("false")
    stores = Stores(spark, fresh_path(spark, "views"), [Store("counts", ("p",), "p string, n long, n_open long, cents long", "sum"), Store("customers", ("p", "c"), "p string, c long, n long", "sum"), Store("days", ("p", "d"), "p string, d string, n long", "sum")], fan=3)
    for number, (old, new) in enumerate([(none, o), (gone, none), (open_, later)]):
        changes = views.change_set(old, new)
        at = F.lit(0)
        stores.merge(number, {"counts": (views.count_changes(changes, ["p"], {"n_open": F.col("s") == "O"}, {"cents": F.col("cents")}), at), "customers": (views.value_changes(changes, ["p"], "c"), at), "days": (views.value_changes(changes, ["p"], "d"), at)})
    stores.compact()
    customers = views.value_statistics(stores.read("customers"), ["p"], "c").select("p", F.col("distinct").alias("customers"), F.col("mode").alias("most"))
    days = views.value_statistics(stores.read("days"), ["p"], "d").select("p", F.col("greatest").alias("latest"))
    return stores.read("counts").select("p", "n", "n_open", "cents").join(customers, "p").join(days, "p")


@query("dedupe_overlap_window", "SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events")
def dedupe_overlap_window(spark, sf_dir):
    """Weekly batches that overlap by their whole length, keyed dedup over them."""
    e = table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("day"))
    once = keyed.overlapping_batches([e.where("day < DATE '2024-01-15'"), e.where("day >= DATE '2024-01-08'")], ["event_id"], "day")
    return once.select("event_id", F.col("day").cast("string").alias("day"))


@query("priority_cap", """
WITH t AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0 WHEN o_orderstatus = 'O' THEN 1 ELSE 2 END AS turn FROM orders)
SELECT o_orderkey, turn FROM t ORDER BY turn, o_orderkey LIMIT 300""")
def priority_cap(spark, sf_dir):
    """A fetch budget: changed rows first, then the backlog, 300 in all."""
    turn = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return ordering.budgeted(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), turn, ["o_orderkey"], 300).select("o_orderkey", "turn")


@query("budget_first_n", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey) <= 2""")
def budget_first_n(spark, sf_dir):
    """The two lines of each order that matter most."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey")
    return ordering.first_of_group(lines, ["l_orderkey"], [F.desc("l_quantity"), F.col("l_linenumber"), F.col("l_partkey")], 2).drop("l_partkey")


@query("recent_days", "SELECT DISTINCT CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events ORDER BY day DESC LIMIT 14")
def recent_days(spark, sf_dir):
    return ordering.newest(table(spark, sf_dir, "events").select(F.to_date("ts").cast("string").alias("day")), "day", 14)


@query("build_stamp", "SELECT CAST(date_trunc('second', max(ts)) AS VARCHAR) AS stamp FROM events")
def build_stamp(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 2 == 0, F.col("ts")).alias("updated"), F.col("ts").alias("created"))
    return keyed.last_stamp(e, "updated", "created").select(F.date_format("stamp", "yyyy-MM-dd HH:mm:ss").alias("stamp"))


@query("used_references", """
SELECT k, count(*) AS n FROM (SELECT DISTINCT l_partkey % 100 AS k, 'line' AS s FROM lineitem UNION SELECT p_size, 'part' FROM part) GROUP BY k""")
def used_references(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 100).alias("k"), F.lit("line").alias("s"))
    parts = table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("k"), F.lit("part").alias("s"))
    return keyed.used_by_any(lines, parts).groupBy("k").agg(F.count("*").alias("n"))


@query("kept_after_collection", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def kept_after_collection(spark, sf_dir):
    """Garbage collection with the guard off: only what is still named stays."""
    used = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return lookups.referenced(table(spark, sf_dir, "customer").select("c_custkey"), used, "c_custkey", guard=0)
