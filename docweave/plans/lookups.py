"""Queries of joins, order within keys, search and partition planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.operators import history, keyed, lookups, runs, search, substring_index
from docweave.operators.partitions import capped_partitions
from docweave.registry import query, table
from docweave.sources.tables import fresh_path


@query("exact_then_prefix", """
WITH e AS (SELECT p_partkey, p_type FROM part WHERE p_partkey % 3 = 2),
f AS (SELECT p_name, p_brand, min(p_type) AS lo, max(p_type) AS hi FROM part WHERE p_partkey % 3 = 1 GROUP BY 1, 2)
SELECT p.p_partkey, coalesce(e.p_type, CASE WHEN lo = hi THEN lo END) AS p_type,
       CASE WHEN e.p_type IS NOT NULL THEN 'exact' WHEN lo = hi THEN 'prefix' WHEN lo IS NOT NULL THEN 'ambiguous' ELSE 'none' END AS how
FROM part p LEFT JOIN e ON e.p_partkey = p.p_partkey LEFT JOIN f ON f.p_name = p.p_name AND f.p_brand = p.p_brand""")
def exact_then_prefix(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", F.concat_ws("|", "p_name", "p_brand").alias("short"))
    exact = p.where("p_partkey % 3 = 2").select("p_partkey", "p_type")
    fallback = p.where("p_partkey % 3 = 1").select(F.col("short").alias("prefix"), "p_type")
    return lookups.exact_then_prefix(p.select("p_partkey", "short"), "p_partkey", F.col("short"), exact, fallback, "p_type").select("p_partkey", "p_type", "how")


@query("attach_price_rows", """
SELECT o_orderkey, count(l_orderkey) AS n, CAST(coalesce(sum(CAST(l_extendedprice AS DECIMAL(12,2))), 0) AS DOUBLE) AS total,
       string_agg(l_linestatus, '' ORDER BY l_linenumber, l_partkey, l_extendedprice, l_linestatus) AS states
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def attach_price_rows(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.struct("l_linenumber", "l_partkey").alias("pos"), F.col("l_extendedprice").cast("decimal(12,2)").alias("price"), "l_linestatus")
    out = lookups.attach_rows(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", lines, "pos", ["price", "l_linestatus"], "rows")
    total = F.aggregate("rows", F.lit(0).cast("decimal(22,2)"), lambda a, x: (a + x.getField("price")).cast("decimal(22,2)"))
    states = F.array_join(F.transform("rows", lambda x: x.getField("l_linestatus")), "")
    return out.select("o_orderkey", F.when(F.col("rows").isNull(), 0).otherwise(F.size("rows")).cast("long").alias("n"), F.coalesce(total, F.lit(0)).cast("double").alias("total"), states.alias("states"))


@query("prefix_unambiguous", """
WITH p AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN substr(c_name, 1, 17) || 'X' ELSE c_name END AS product FROM customer),
c AS (SELECT c_custkey, product, n, substr(product, 1, n) AS prefix FROM p, (VALUES (18), (17), (16)) v(n)),
h AS (SELECT c.c_custkey, c.n, c.prefix, count(DISTINCT k.c_mktsegment) AS found, string_agg(DISTINCT k.c_mktsegment, ',' ORDER BY k.c_mktsegment) AS names
  FROM c JOIN (SELECT n, substr(c_name, 1, n) AS prefix, c_mktsegment FROM customer, (VALUES (18), (17), (16)) v(n)) k ON k.n = c.n AND k.prefix = c.prefix GROUP BY 1, 2, 3)
SELECT c_custkey, prefix, CASE WHEN found <= 3 THEN names ELSE '' END AS found, found AS n_found
FROM h QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY n DESC) = 1""")
def prefix_unambiguous(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    product = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.substring("c_name", 1, 17), F.lit("X"))).otherwise(F.col("c_name"))
    products = c.select("c_custkey", F.array(*[F.substring(product, 1, n) for n in (18, 17, 16)]).alias("cut"))
    out = lookups.longest_prefix(products, "c_custkey", "cut", c.select("c_name", "c_mktsegment"), "c_name", "c_mktsegment", least=16, most=3)
    return out.select("c_custkey", "prefix", F.array_join("found", ",").alias("found"), F.col("n_found").cast("long").alias("n_found"))


@query("first_match_join", """
SELECT l_orderkey, l_linenumber, p_partkey, p_name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size <= 10
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) = 1""")
def first_match_join(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").alias("p_partkey")))).alias("f"))
    store = table(spark, sf_dir, "part").where("p_size <= 10").select("p_partkey", "p_name")
    return lookups.first_match(lines, "f", "p_partkey", store, "p_partkey", "l_orderkey").select("l_orderkey", "l_linenumber", "p_partkey", "p_name")


@query("doc_body_outer", """
SELECT d.doc_id, CASE WHEN length(d.text) < 300 THEN '' ELSE substr(sha1(d.text), 1, 12) END AS h, coalesce(b.n, 0) AS n
FROM documents d LEFT JOIN (SELECT substr(sha1(text), 1, 12) AS h, count(*) AS n FROM documents WHERE length(text) >= 300 GROUP BY 1) b
  ON b.h = CASE WHEN length(d.text) < 300 THEN '' ELSE substr(sha1(d.text), 1, 12) END""")
def doc_body_outer(spark, sf_dir):
    """A document without the section has the empty hash and no body, and stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.length("text") < 300, "").otherwise(F.substring(F.sha1("text"), 1, 12)).alias("h"))
    bodies = docs.where("h <> ''").groupBy("h").agg(F.count("*").alias("n"))
    return keyed.with_bodies(docs, bodies).select("doc_id", "h", F.coalesce("n", F.lit(0)).alias("n"))


@query("category_lookup", """
SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
def category_lookup(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    names = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    return lookups.named(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", names, "c_nationkey").select("c_custkey", "n_name", "r_name")


@query("snapshot_previous", """
SELECT event_id, user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, event_type AS after FROM events""")
def snapshot_previous(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.col("event_type").alias("after"))
    return runs.previous(e, ["user_id"], ["ts", "event_id"], "after", "before").select("event_id", "user_id", "before", "after")


@query("state_as_of", """
WITH v AS (SELECT user_id, ts, max(event_id) AS event_id, max_by(value, event_id) AS value FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY 1, 2)
SELECT e.event_id, coalesce(a.event_id, -1) AS version, coalesce(b.value, -1) AS value_before FROM events e
ASOF LEFT JOIN v a ON a.user_id = e.user_id AND a.ts <= e.ts ASOF LEFT JOIN v b ON b.user_id = e.user_id AND b.ts < e.ts""")
def state_as_of(spark, sf_dir):
    """What a user's last version was when, and right before, each event came."""
    e = table(spark, sf_dir, "events")
    versions = e.where("event_type IN ('signup', 'purchase')").select("user_id", "ts", "event_id", "value")
    at = history.as_of(e.select("event_id", "user_id", "ts"), versions, "user_id", "ts", "ts", ["event_id"])
    before = history.as_of(at.withColumn("version", F.col("version.event_id")), versions, "user_id", "ts", "ts", ["event_id"], "earlier", strict=True)
    return before.select("event_id", F.coalesce("version", F.lit(-1)).alias("version"), F.coalesce("earlier.value", F.lit(-1.0)).alias("value_before"))


@query("version_intervals", """
WITH v AS (SELECT user_id, date_trunc('hour', ts) AS t, max(event_id) AS event_id FROM events GROUP BY 1, 2)
SELECT user_id, event_id, CAST(t AS VARCHAR) AS valid_from, CAST(lead(t) OVER (PARTITION BY user_id ORDER BY t) AS VARCHAR) AS valid_to FROM v""")
def version_intervals(spark, sf_dir):
    """A user's versions of each hour with the time in which they hold; of one hour the last event counts."""
    e = table(spark, sf_dir, "events").select("user_id", F.date_trunc("hour", "ts").alias("t"), "event_id")
    said = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return history.intervals(e, "user_id", "t", ["event_id"]).select("user_id", "event_id", said("valid_from"), said("valid_to"))


@query("state_at_moment", """
SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type, max(ts) <= TIMESTAMP '2024-01-10' AS old FROM events WHERE ts <= TIMESTAMP '2024-01-15' GROUP BY user_id""")
def state_at_moment(spark, sf_dir):
    """Every user's last event at a moment."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    state = history.state_at(e, "user_id", "ts", F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"), ["event_id"])
    return state.select("user_id", "event_type", (F.col("ts") <= F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")).alias("old"))


@query("greedy_pair_replace", """
WITH o AS (SELECT conv_id AS pair, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS nth FROM conversations WHERE conv_id % 2 = 0),
n AS (SELECT conv_id - 1 AS pair, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS nth FROM conversations WHERE conv_id % 2 = 1)
SELECT coalesce(o.pair, n.pair) AS pair, coalesce(o.role, n.role) AS role, coalesce(o.nth, n.nth) AS nth,
       CASE WHEN n.text IS NULL THEN 'removed' WHEN o.text IS NULL THEN 'added' ELSE 'changed' END AS kind, coalesce(sha1(o.text), '') AS before, coalesce(sha1(n.text), '') AS after
FROM o FULL JOIN n ON o.pair = n.pair AND o.role = n.role AND o.nth = n.nth""")
def greedy_pair_replace(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    old = c.where("conv_id % 2 = 0").withColumnRenamed("conv_id", "pair")
    new = c.where("conv_id % 2 = 1").withColumn("pair", F.col("conv_id") - 1)
    return runs.replaced_pairs(old, new, ["pair"], "role", "turn", "text").select("pair", "role", F.col("nth").cast("long").alias("nth"), "kind", *[F.coalesce(F.sha1(c), F.lit("")).alias(c) for c in ("before", "after")])


@query("mru_top_n", """
WITH l AS (SELECT user_id, event_type, max(ts) AS t FROM events GROUP BY 1, 2)
SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY t DESC) AS rank FROM l QUALIFY rank <= 10""")
def mru_top_n(spark, sf_dir):
    out = runs.recent_distinct(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", "event_id", 10)
    return out.select("user_id", "event_type", F.col("rank").cast("long").alias("rank"))


@query("failure_streak", """
WITH e AS (SELECT user_id, event_type = 'error' AS bad, ts, event_id,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) AS island FROM events),
s AS (SELECT user_id, bad, island, count(*) AS n FROM e GROUP BY 1, 2, 3)
SELECT user_id, coalesce(max(n) FILTER (bad), 0) AS longest FROM s GROUP BY user_id""")
def failure_streak(spark, sf_dir):
    return runs.longest_streak(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error")


@query("section_assign", """
SELECT conv_id, turn, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS section FROM conversations""")
def section_assign(spark, sf_dir):
    return runs.sections(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.col("role") == "user").select("conv_id", "turn", "section")


@query("following_run", """
WITH c AS (SELECT conv_id, turn, text, CAST(sum(CASE WHEN role <> 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS head, role FROM conversations)
SELECT conv_id, head, count(*) FILTER (role = 'assistant') AS n_following, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS chars
FROM c WHERE head > 0 GROUP BY 1, 2""")
def following_run(spark, sf_dir):
    """The rows after each heading row up to the next one."""
    c = runs.sections(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.col("role") != "assistant", "head").where("head > 0")
    body = F.col("role") == "assistant"
    return c.groupBy("conv_id", "head").agg(F.count_if(body).alias("n_following"), F.coalesce(F.sum(F.when(body, F.length("text"))), F.lit(0)).cast("long").alias("chars"))


@query("search_insert", """
WITH h AS (SELECT p_partkey, p_name, p_brand, lower(p_name) AS n, lower(p_type) AS g FROM part),
m AS (SELECT p_partkey, p_name, CASE WHEN n LIKE 'red%' OR g LIKE 'red%' THEN 0 WHEN n LIKE '%red%' OR g LIKE '%red%' THEN 1 ELSE 2 END AS score
  FROM h WHERE n || ' ' || g || ' ' || lower(p_brand) LIKE '%red%' AND n || ' ' || g || ' ' || lower(p_brand) LIKE '%brand#1%')
SELECT p_partkey, p_name, score, count(*) OVER () AS total FROM m ORDER BY score, p_name, p_partkey LIMIT 200""")
def search_insert(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.lower("p_name").alias("n"), F.lower("p_type").alias("g"), F.lower("p_brand").alias("c"))
    return search.search_names(p, ["n", "g", "c"], ["red", "brand#1"], ["p_name", "p_partkey"]).select("p_partkey", "p_name", "score", "total")


@query("search_codes", """
WITH h AS (SELECT p_partkey, p_name, [upper(replace(p_brand, '#', '')), CAST(p_partkey AS VARCHAR)] AS codes, lower(replace(p_name, ' ', '')) AS blob FROM part),
m AS (SELECT *, CASE WHEN list_contains(codes, '12') THEN 0 WHEN len(list_filter(codes, lambda c: c LIKE '12%')) > 0 THEN 1 WHEN len(list_filter(codes, lambda c: c LIKE '%12%')) > 0 THEN 2 ELSE 3 END AS score
  FROM h WHERE len(list_filter(codes, lambda c: c LIKE '%12%')) > 0 OR blob LIKE '%12%')
SELECT p_partkey, p_name, score, count(*) OVER () AS total FROM m ORDER BY score, p_name, p_partkey LIMIT 200""")
def search_codes(spark, sf_dir):
    codes = F.array(F.upper(F.replace("p_brand", F.lit("#"), F.lit(""))), F.col("p_partkey").cast("string"))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", codes.alias("codes"), F.lower(F.replace("p_name", F.lit(" "), F.lit(""))).alias("blob"))
    return search.search_codes(p, "codes", F.col("blob"), [("12", "12")], ["p_name", "p_partkey"]).select("p_partkey", "p_name", "score", "total")


@query("search_grouped", """
WITH h AS (SELECT substr(sha1(text), 1, 12) AS h, lower(source) AS n, lower(text) AS g FROM documents WHERE lower(source) || ' ' || lower(text) LIKE '%benchmark%' OR lower(source) || ' ' || lower(text) LIKE '%src1%'),
m AS (SELECT h, n, CASE WHEN n LIKE 'src1%' OR g LIKE 'src1%' THEN 0 WHEN n LIKE '%src1%' OR g LIKE '%src1%' THEN 1 ELSE 2 END AS score FROM h WHERE n || ' ' || g LIKE '%src1%')
SELECT h, min(score) AS score, count(*) AS size, arg_min(n, (score, n)) AS first FROM m GROUP BY h ORDER BY 2, 3 DESC, 4, 1 LIMIT 100""")
def search_grouped(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.substring(F.sha1("text"), 1, 12).alias("h"), F.lower("source").alias("n"), F.lower("text").alias("g"))
    return search.search_grouped(d, ["n", "g"], ["src1"], "h", "n")


@query("search_indexed", """
WITH d AS (SELECT doc_id, lower(lang) AS g, lower(source) AS n, lower(coalesce(text, '')) AS t FROM documents),
h AS (SELECT doc_id, CASE WHEN n LIKE 'src1%' OR g LIKE 'src1%' THEN 0 WHEN n LIKE '%src1%' OR g LIKE '%src1%' THEN 1 ELSE 2 END AS score
  FROM d WHERE contains(n || ' ' || g || ' ' || t, 'src1') AND contains(n || ' ' || g || ' ' || t, 'tion') AND contains(n || ' ' || g || ' ' || t, 'th'))
SELECT doc_id, score, count(*) OVER () AS total FROM h ORDER BY score, doc_id LIMIT 500""")
def search_indexed(spark, sf_dir):
    """Whole texts by an index of their trigrams; one word is shorter than a trigram."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.lower("source").alias("n"), F.lower("lang").alias("g"), F.lower("text").alias("t"))
    path = fresh_path(spark, "search")
    substring_index.build(d, path, ["n", "g", "t"], ["doc_id"])
    return substring_index.search(spark, path, ["src1", "tion", "th"], ["n", "g", "t"], ["n", "g"], 500).select("doc_id", "score", "total")


@query("search_updates", """
SELECT event_id, event_type, count(*) OVER () AS total FROM events WHERE event_type || ' ' || props LIKE '%error%' AND event_type || ' ' || props LIKE '%1%'
ORDER BY ts DESC, event_id LIMIT 300""")
def search_updates(spark, sf_dir):
    """Q01: the newest first, no score."""
    e = table(spark, sf_dir, "events")
    return search.search_updates(e, ["event_type", "props"], ["error", "1"], [F.desc("ts"), F.col("event_id")]).select("event_id", "event_type", "total")


@query("search_theme", """
WITH d AS (SELECT doc_id, lower(source) AS g, lang, CASE WHEN length(text) < 500 THEN 0 WHEN length(text) < 2000 THEN 1 ELSE 2 END AS k, lower(text) AS t FROM documents)
SELECT doc_id, k, CASE WHEN g LIKE 'the%' THEN 0 WHEN g LIKE '%the%' THEN 1 ELSE 2 END AS score FROM d WHERE g || ' ' || lang || ' ' || t LIKE '%the%' AND k IN (0, 2)""")
def search_theme(spark, sf_dir):
    """Q08: tiers on, no cap."""
    k = F.when(F.length("text") < 500, 0).when(F.length("text") < 2000, 1).otherwise(2)
    d = table(spark, sf_dir, "documents").select("doc_id", F.lower("source").alias("g"), "lang", k.alias("k"), F.lower("text").alias("t")).where(F.col("k").isin(0, 2))
    hits = d.where(search.holds_all(F.concat_ws(" ", "g", "lang", "t"), ["the"]))
    return hits.select("doc_id", "k", search.name_score([F.col("g")], "the").alias("score"))


@query("capped_partitions", """
WITH RECURSIVE o AS (SELECT o_orderpriority AS p, CAST(o_orderdate AS DATE) AS d FROM orders),
t AS (SELECT DISTINCT p FROM o),
r(p, y, lo, hi) AS (
  SELECT p, CAST(NULL AS INTEGER), DATE '1995-01-01', DATE '2001-12-31' FROM t
  UNION ALL
  SELECT r.p, coalesce(r.y, s.y), s.lo, s.hi FROM r, LATERAL (
    SELECT CAST(y AS INTEGER) AS y, make_date(y, 1, 1) AS lo, make_date(y, 12, 31) AS hi FROM range(1995, 2002) g(y) WHERE r.y IS NULL
    UNION ALL SELECT r.y, r.lo, r.lo + CAST((r.hi - r.lo) // 2 AS INTEGER) WHERE r.y IS NOT NULL AND r.lo < r.hi
    UNION ALL SELECT r.y, r.lo + CAST((r.hi - r.lo) // 2 + 1 AS INTEGER), r.hi WHERE r.y IS NOT NULL AND r.lo < r.hi) s
  WHERE (SELECT count(*) FROM o WHERE o.p = r.p AND o.d BETWEEN r.lo AND r.hi) > 300)
SELECT p AS class, CAST(lo AS VARCHAR) AS low, CAST(hi AS VARCHAR) AS high, n FROM (
  SELECT r.p, lo, hi, (SELECT count(*) FROM o WHERE o.p = r.p AND o.d BETWEEN r.lo AND r.hi) AS n FROM r) x
WHERE n <= 300 OR lo = hi""")
def capped(spark, sf_dir):
    """Classes, then years, then halves of date ranges, until no part has more than 300 rows."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("class"), F.to_date("o_orderdate").alias("day"))
    out = capped_partitions(o, "class", "day", 1995, 2001, 300)
    return out.select("class", F.col("low").cast("string").alias("low"), F.col("high").cast("string").alias("high"), "n")
