"""Queries of the groupings, orders and columns that lists are shown with."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.operators import groups, ordering
from docweave.registry import query, table

#: Lines have no key of their own: the place of one in its order.
PLACE = "l_linenumber * 100000000000 + l_partkey * 100000 + l_suppkey"


def lines_with_place(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").withColumn("pos", F.expr(PLACE))


@query("band_groups", f"""
WITH l AS (SELECT l_orderkey, {PLACE} AS pos, CAST(round(l_discount * 100) AS INTEGER) AS x, CASE WHEN l_returnflag = 'R' THEN '{groups.SERIOUS}' ELSE l_returnflag END AS cat, l_partkey, l_linestatus FROM lineitem),
b AS (SELECT *, CASE WHEN x = 0 THEN '頻度不明' WHEN x <= 3 THEN '1%未満' WHEN x <= 6 THEN '1～5%未満' ELSE '5%以上' END AS band, CASE WHEN x = 0 THEN 0 WHEN x <= 3 THEN 1 WHEN x <= 6 THEN 2 ELSE 3 END AS level FROM l),
g AS (SELECT l_orderkey, band, level, string_agg(cat || ':' || l_partkey || ':' || l_linestatus, ',' ORDER BY cat <> '{groups.SERIOUS}', pos, cat, l_partkey, l_linestatus) AS rows FROM b GROUP BY 1, 2, 3)
SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY level DESC) AS place, band, level, rows FROM g""")
def band_groups(spark, sf_dir):
    """A10: bands of an order's discounts, written in several ways."""
    x = F.round(F.col("l_discount") * 100).cast("int")
    band = F.when(x == 0, "頻度不明").when(x <= 3, "1%未満").when(x <= 6, "1～5%未満").otherwise("5%以上")
    cat = F.when(F.col("l_returnflag") == "R", groups.SERIOUS).otherwise(F.col("l_returnflag"))
    rows = lines_with_place(spark, sf_dir).select("l_orderkey", "pos", band.alias("band"), cat.alias("category"), F.col("l_partkey").cast("string").alias("text"), F.col("l_linestatus").alias("label"))
    out = groups.band_groups(rows, "l_orderkey", "pos").select("l_orderkey", F.posexplode("groups").alias("place", "g"))
    said = F.array_join(F.transform("g.rows", lambda r: F.concat_ws(":", r.getField("category"), r.getField("text"), r.getField("label"))), ",")
    return out.select("l_orderkey", (F.col("place") + 1).cast("long").alias("place"), "g.band", "g.level", said.alias("rows"))


@query("generic_groups", """
WITH p AS (SELECT p_partkey AS pos, CASE WHEN p_size % 7 = 0 THEN p_name ELSE p_brand END AS name, p_name AS n, '123456_' || lpad(CAST(p_partkey AS VARCHAR), 12, '0') || '_1' AS u,
  CASE WHEN p_size % 11 = 0 THEN '' ELSE p_type END AS cls, p_size % 3 AS k, p_type AS ch FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 3 <> 0),
c AS (SELECT name, cls, count(*) AS m, min(pos) AS f FROM p WHERE cls <> '' GROUP BY 1, 2),
m AS (SELECT name, cls FROM c QUALIFY row_number() OVER (PARTITION BY name ORDER BY m DESC, f) = 1),
b AS (SELECT name, n, arg_min(u, pos) AS u FROM p GROUP BY 1, 2),
bb AS (SELECT name, string_agg(n || '=' || u, ',' ORDER BY n, u) AS brands FROM b GROUP BY 1),
h AS (SELECT name, pos, u, CAST(k AS INTEGER) AS k, ch, 0 AS hit FROM p UNION ALL SELECT name, pos, u, 2, 'x', 1 FROM p),
hh AS (SELECT name, min(k) AS k, min(substr(u, 8, 4)) AS y, count(*) AS n_hits, string_agg(k || ':' || ch || ':' || u, ',' ORDER BY k, ch, pos, hit) AS hits FROM h GROUP BY 1)
SELECT hh.name, coalesce(m.cls, '') AS cls, y, k, brands, hits, n_hits FROM hh JOIN bb ON bb.name = hh.name LEFT JOIN m ON m.name = hh.name""")
def generic_groups(spark, sf_dir):
    """Parts by their brand, of which some have no generic, and documents that aren't stored."""
    p = table(spark, sf_dir, "part")
    u = lambda n: F.concat(F.lit("123456_"), F.lpad(F.col("p_partkey").cast("string"), 12, "0"), F.lit(f"_{n}"))
    generic = F.when(F.col("p_size") % 7 == 0, F.when(F.col("p_size") % 2 == 0, "")).otherwise(F.concat("p_brand", F.when(F.col("p_size") % 2 == 0, "水和物 ").otherwise("")))
    catalog = p.select(F.col("p_partkey").alias("pos"), generic.alias("g"), F.col("p_name").alias("n"), F.array(u(9), u(1)).alias("f"))
    store = p.where("p_partkey % 5 <> 0").select(u(1).alias("u"), F.when(F.col("p_size") % 11 == 0, "").otherwise(F.concat("p_type", F.lit(" / other"))).alias("cls"))
    found = F.array(F.struct(F.lit(0).alias("hit"), (F.col("p_size") % 3).alias("k"), F.col("p_type").alias("ch")), F.struct(F.lit(1).alias("hit"), F.lit(2).alias("k"), F.lit("x").alias("ch")))
    hits = p.where("p_partkey % 3 <> 0").select(u(1).alias("u"), F.explode(found).alias("h")).select("u", "h.*", F.lit("").alias("t"))
    out = groups.generic_groups(catalog, store, hits)
    brands = F.array_join(F.transform("brands", lambda b: F.concat_ws("=", b.getField("n"), b.getField("u"))), ",")
    said = F.array_join(F.transform("hits", lambda h: F.concat_ws(":", h.getField("k"), h.getField("ch"), h.getField("u"))), ",")
    return out.select("name", "cls", "y", "k", brands.alias("brands"), said.alias("hits"), "n_hits")


@query("first_of_pattern", r"""
WITH c AS (SELECT c_custkey, lpad(CAST(c_custkey % 50 AS VARCHAR), 6, '0') || '_' || lpad(CAST(c_nationkey AS VARCHAR), 12, '0') AS key FROM customer),
s AS (SELECT lpad(CAST(s_suppkey % 60 AS VARCHAR), 6, '0') || '_' || lpad(CAST(s_nationkey AS VARCHAR), 12, '0') AS key, arg_min(s_name, s_suppkey) AS pdf FROM supplier GROUP BY 1)
SELECT c_custkey, pdf FROM c LEFT JOIN s ON s.key = c.key""")
def first_of_pattern(spark, sf_dir):
    """Codes inside of longer names on both sides."""
    code = lambda a, b: F.concat(F.lpad(a.cast("string"), 6, "0"), F.lit("_"), F.lpad(b.cast("string"), 12, "0"))
    left = table(spark, sf_dir, "customer").select("c_custkey", F.concat(code(F.col("c_custkey") % 50, F.col("c_nationkey")), F.lit("_1_01")).alias("u"))
    right = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.concat(F.lit("if/"), code(F.col("s_suppkey") % 60, F.col("s_nationkey")), F.lit(".pdf")).alias("u"))
    return groups.first_of_pattern(left, "u", right, "u", r"(\d{6}_[0-9A-Z]{12})", "s_suppkey", "s_name", "pdf").select("c_custkey", "pdf")


@query("cleaned_codes", f"""
WITH l AS (SELECT l_orderkey, {PLACE} AS pos, 'C' || l_partkey % 5 AS c, l_returnflag AS b, CASE WHEN l_linestatus = 'O' THEN '本体表示' END AS l FROM lineitem WHERE l_linenumber <> 7)
SELECT l_orderkey, c, b, l, min(pos) OVER (PARTITION BY l_orderkey, c, b) AS pos FROM l
QUALIFY row_number() OVER (PARTITION BY l_orderkey, c, b ORDER BY l IS NOT NULL, pos) = 1""")
def cleaned_codes(spark, sf_dir):
    """F05, A11."""
    rows = lines_with_place(spark, sf_dir)
    code = F.when(F.col("l_linenumber") == 7, "表").otherwise(F.concat(F.lit("C"), (F.col("l_partkey") % 5).cast("string")))
    codes = rows.select("l_orderkey", "pos", code.alias("c"), F.col("l_returnflag").alias("b"), F.when(F.col("l_linestatus") == "O", "本体 表示").otherwise("").alias("l"))
    return groups.cleaned_codes(codes, "l_orderkey", "pos").select("l_orderkey", "c", "b", "l", "pos")


@query("image_records", """
WITH o AS (SELECT o_orderkey AS u, o_custkey AS c, o_orderstatus = 'P' AS failed, o_custkey % 2 = 0 OR o_custkey % 5 = 0 AS wanted FROM orders)
SELECT u, CASE WHEN NOT failed THEN 7 ELSE 0 END AS v, CASE WHEN c % 2 = 0 THEN 1 ELSE 0 END AS n_codes,
  CASE WHEN wanted AND NOT failed AND c % 3 <> 0 THEN u || '_1.gif' END AS sh, CASE WHEN wanted AND NOT failed AND c % 5 = 0 AND c % 4 <> 0 THEN u || '_3.gif' END AS ic FROM o""")
def image_records(spark, sf_dir):
    """Orders as documents, of which some have no code, lack images or failed to store them."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("u"), F.col("o_custkey").alias("c"), "o_orderstatus")
    name = lambda n: F.concat("u", F.lit(f"_{n}.gif"))
    none = lambda kind: F.array().cast(kind)
    shapes = F.array(F.struct(F.lit("a").alias("b"), F.array(name(1), name(2)).alias("g")))
    images = F.when(F.col("c") % 5 == 0, F.array(F.struct(name(3).alias("g"), F.lit("").alias("b")))).otherwise(none("array<struct<g: string, b: string>>"))
    documents = o.select("u", F.lit("2026-01-01").alias("t"), F.when(F.col("c") % 2 == 0, F.array(F.lit("A"))).otherwise(none("array<string>")).alias("codes"), shapes.alias("shapes"), images.alias("idimgs"), (F.col("o_orderstatus") == "P").alias("failed"))
    stored = o.where("c % 3 <> 0").select("u", name(1).alias("name")).unionByName(o.where("c % 4 <> 0").select("u", name(3).alias("name")))
    out = groups.image_records(documents, stored, 7)
    first = lambda c, f: F.when(F.col(c).isNotNull(), f(F.element_at(c, 1).getField("g")))
    return out.select(F.col("u").cast("long").alias("u"), F.coalesce("v", F.lit(0)).alias("v"), F.size("codes").alias("n_codes"), first("sh", lambda g: F.array_join(g, ",")).alias("sh"), first("ic", lambda g: g).alias("ic"))


@query("block_lengths", """
WITH c AS (SELECT conv_id, sum(CASE turn % 4 WHEN 0 THEN 0 WHEN 2 THEN length(replace(text, ' ', '')) ELSE length(text) END) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id, CAST(n AS BIGINT) AS n, n > 1500 AS long FROM c""")
def block_lengths(spark, sf_dir):
    """The turns of a conversation as headings, paragraphs, tables and notes."""
    kind = F.element_at(F.array(*map(F.lit, "hptn")), (F.col("turn") % 4 + 1).cast("int"))
    block = F.struct("turn", kind.alias("kind"), "text", F.when(kind == "t", F.array(F.split("text", " "))).alias("rows"))
    blocks = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(block)).alias("b"))
    return blocks.select("conv_id", groups.blocks_length(F.col("b")).cast("long").alias("n"), groups.is_long(F.col("b")).alias("long"))


@query("update_list", f"""
WITH l AS (SELECT l_orderkey, string_agg(l_returnflag, ' / ' ORDER BY {PLACE}, l_returnflag) FILTER (l_quantity > 25) AS brands,
  coalesce(string_agg(DISTINCT l_returnflag || ' > ' || l_linestatus, ' / ' ORDER BY l_returnflag || ' > ' || l_linestatus) FILTER (l_discount > 0.055), '') AS p FROM lineitem GROUP BY 1)
SELECT o_orderkey, coalesce(brands, o_orderpriority) AS t, coalesce(p, '') AS p,
  CASE WHEN p <> '' THEN 'marked' WHEN o_orderstatus = 'P' THEN 'new' WHEN o_orderpriority = '1-URGENT' THEN 'first_edition' ELSE 'unmarked' END AS state
FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def update_list(spark, sf_dir):
    """orders as updates, their lines as brands and revised sections."""
    line = lines_with_place(spark, sf_dir)
    brand = F.when(F.col("l_quantity") > 25, F.struct("pos", "l_returnflag"))
    path = F.when(F.col("l_discount") > 0.055, F.array("l_returnflag", "l_linestatus"))
    of = line.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(brand)), lambda b: b.getField("l_returnflag")).alias("brands"), F.collect_list(path).alias("paths"))
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "l_orderkey").join(of, "l_orderkey", "left")
    revised = F.transform("paths", lambda x: F.array_join(x, " > "))
    reason = F.when(F.col("o_orderstatus") == "P", ordering.NEW_ENTRY).otherwise("改訂")
    version = F.when(F.col("o_orderpriority") == "1-URGENT", ordering.FIRST_EDITION).otherwise("第2版")
    return o.select(F.col("l_orderkey").alias("o_orderkey"), ordering.title(F.col("brands"), F.col("o_orderpriority")).alias("t"), ordering.path_list(F.col("paths")).alias("p"), ordering.revision_state(revised, reason, version).alias("state"))


@query("theme_order", "SELECT p_partkey, p_brand, p_name FROM part ORDER BY p_brand, p_name, p_partkey LIMIT 200")
def theme_order(spark, sf_dir):
    """By class and then name in Japanese order, the first 200."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("y"), F.col("p_name").alias("name"))
    return p.orderBy(*ordering.theme_order(by_name=False), "p_partkey").limit(200).select("p_partkey", F.col("y").alias("p_brand"), F.col("name").alias("p_name"))


#: Letters as kana in the order of Japanese, every other one in hiragana, whose code points all come first; and all as katakana.
_LETTERS, _MIXED, _KATAKANA = "abcdeghilmnoprstuvwz", "アいウえオかキくケこサしスせソたチつテと", "アイウエオカキクケコサシスセソタチツテト"


@query("theme_order_by_name", f"""
SELECT p_partkey, translate(p_name, '{_LETTERS}', '{_MIXED}') AS name FROM part ORDER BY translate(p_name, '{_LETTERS}', '{_KATAKANA}'), p_partkey LIMIT 300""")
def theme_order_by_name(spark, sf_dir):
    """By name alone, in Japanese order, which isn't that of code points."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.translate("p_name", _LETTERS, _MIXED).alias("name"))
    return p.orderBy(*ordering.theme_order(by_name=True), "p_partkey").limit(300).select("p_partkey", "name")


@query("important_order", "SELECT event_id, event_type = 'error' AS important FROM events ORDER BY event_type = 'error' DESC, event_id LIMIT 300")
def important_order(spark, sf_dir):
    """O03, O06."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_type") == "error").alias("important"))
    return e.orderBy(*ordering.important_first("important", "event_id")).limit(300)
