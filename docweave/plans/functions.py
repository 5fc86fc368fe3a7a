"""Queries of text forms, lenient values, refresh of stale rows and classes asked for by their children."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions import keys, text
from docweave.operators import incremental, partitions
from docweave.plans.documents import joined
from docweave.registry import query, table
from docweave.sources import feeds


@query("text_forms", r"""
SELECT p_partkey, 'x' || p_name AS watch, 'ア' || upper(p_brand) AS code, 'アーイ' || lower(p_brand) AS match, ['p', 'k', 'j', 'a'][CAST(1 + p_size % 4 AS INTEGER)] AS class,
  3 AS n_sentences, p_type AS second, p_name || '。' AS residue, replace(p_name, ' ', '') || p_brand AS key, '<mark>' || p_type || '</mark> ' || p_brand AS shown FROM part""")
def text_forms(spark, sf_dir):
    """T09-T12, T16-T18, T36 on names with wide letters, half-width kana, hyphens and marks."""
    p = table(spark, sf_dir, "part")
    first = F.element_at(F.array(*map(F.lit, "(ア漢b")), (F.col("p_size") % 4 + 1).cast("int"))
    said = text.sentences(F.concat("p_name", F.lit("。　"), "p_type", F.lit("\n\n"), "p_brand"))
    return p.select(
        "p_partkey",
        text.watch_form(text.nfkc(F.concat(F.lit("Ｘ"), "p_name"))).alias("watch"),
        text.code_form(text.nfkc(F.concat(F.lit("ｱ- "), "p_brand", F.lit("・ー")))).alias("code"),
        text.match_form(text.nfkc(F.concat(F.lit("ｱ-ｲ　"), "p_brand", F.lit("-")))).alias("match"),
        text.char_class(F.concat(first, "p_name")).alias("class"),
        F.size(said).alias("n_sentences"),
        F.element_at(said, 2).alias("second"),
        text.without_reference_marks(F.concat("p_name", F.lit("。,, "))).alias("residue"),
        text.cluster_key(F.array().cast("array<string>"), F.concat("p_name", F.lit("、")), F.concat(F.lit("（"), "p_brand", F.lit("）"))).alias("key"),
        text.highlighted(F.concat_ws(" ", "p_type", "p_brand"), F.array("p_type")).alias("shown"),
    )


@query("class_options", "SELECT CAST(p_partkey AS VARCHAR) AS code, p_name AS name FROM part")
def class_options(spark, sf_dir):
    """Forms of a hundred classes each."""
    option = F.concat(F.lit('<option value=" '), "p_partkey", F.lit('">-- '), "p_name", F.lit("</option>\n"))
    forms = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") / 100).cast("long").alias("page")).agg(joined(F.array_sort(F.collect_list(option))).alias("o"))
    pages = forms.select(F.concat(F.lit('<option value="x">not this</option><select id="e" name="effectValue"><option value="">all</option>'), "o", F.lit("</select>")).alias("html"))
    return feeds.class_options(pages)


@query("lenient_values", """
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(CAST(o_totalprice AS DECIMAL(14, 2)) AS VARCHAR) ELSE '-' END AS price,
  CASE WHEN o_orderstatus = 'F' THEN 999 ELSE date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') END AS age FROM orders""")
def lenient_values(spark, sf_dir):
    """Prices with commas and ages of dates, some of which aren't any."""
    o = table(spark, sf_dir, "orders")
    price = keys.lenient_price(F.when(F.col("o_orderstatus") != "P", F.format_string("%,.2f", F.col("o_totalprice"))).otherwise("n/a"))
    day = F.when(F.col("o_orderstatus") == "F", "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select("o_orderkey", F.coalesce(price.cast("string"), F.lit("-")).alias("price"), keys.age_in_days(day, F.to_date(F.lit("2002-01-01"))).cast("long").alias("age"))


@query("due_targets", """
SELECT o_orderkey AS u, CASE WHEN o_custkey % 4 = 0 OR o_custkey % 4 = 1 THEN 0 ELSE 1 END AS turn FROM orders
WHERE (o_custkey % 4 <= 1 OR o_custkey % 4 = 2) AND NOT (o_custkey % 4 <> 0 AND o_orderstatus = 'P')""")
def due_targets(spark, sf_dir):
    """Missing, changed, of an old version and up to date; what has failed at its present date waits."""
    o = table(spark, sf_dir, "orders").withColumn("t", F.date_format("o_orderdate", "yyyy-MM-dd"))
    state = o.where("o_custkey % 4 <> 0").select(F.col("o_orderkey").alias("u"), F.when(F.col("o_custkey") % 4 == 1, "1990-01-01").otherwise(F.col("t")).alias("t"), F.when(F.col("o_custkey") % 4 == 2, 1).otherwise(2).alias("v"), F.when(F.col("o_orderstatus") == "P", F.col("t")).alias("err_t"))
    return incremental.due(o.select(F.col("o_orderkey").alias("u"), "t"), state, "u", "t", 2).select("u", "turn")


@query("refreshed_state", """
SELECT o_orderkey AS u, CASE WHEN o_custkey % 3 = 0 THEN 'new' || o_custkey ELSE o_orderstatus END AS v FROM orders WHERE o_custkey % 5 <> 0 OR o_custkey % 3 = 0""")
def refreshed_state(spark, sf_dir):
    """Rows read again replace stored ones, rows read for the first time come in, the rest stays."""
    o = table(spark, sf_dir, "orders")
    state = o.where("o_custkey % 5 <> 0").select(F.col("o_orderkey").alias("u"), F.col("o_orderstatus").alias("v"))
    read = o.where("o_custkey % 3 = 0").select(F.col("o_orderkey").alias("u"), F.concat(F.lit("new"), "o_custkey").alias("v"))
    return incremental.refreshed(state, read, "u")


@query("classes_by_children", """
WITH n AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)
SELECT CASE WHEN n.n > (SELECT avg(n) FROM n) THEN o.o_orderpriority || '/' || o_orderstatus ELSE o.o_orderpriority END AS class, count(*) AS n
FROM orders o JOIN n ON n.o_orderpriority = o.o_orderpriority GROUP BY 1""")
def classes_by_children(spark, sf_dir):
    """Classes over the mean size are asked for by their children."""
    o = table(spark, sf_dir, "orders").select("o_orderpriority", F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("child"))
    cap = o.count() / o.select("o_orderpriority").distinct().count()
    return partitions.with_children(o, "o_orderpriority", "child", cap).groupBy("class").agg(F.count("*").alias("n"))


@query("page_heads", r"""
SELECT CAST(page_id AS VARCHAR) AS name, trim(regexp_extract(html, '<title>([^|<]*)', 1)) AS title FROM pages WHERE page_id % 10 <> 0""")
def page_heads(spark, sf_dir):
    """Pages whose names begin with an underscore are left out."""
    pages = table(spark, sf_dir, "pages").select(F.when(F.col("page_id") % 10 == 0, F.concat(F.lit("_"), "page_id")).otherwise(F.col("page_id").cast("string")).alias("name"), "html")
    return feeds.page_head(pages, "name").select("name", "title")
