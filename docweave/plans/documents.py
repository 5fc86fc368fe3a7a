"""Queries of the document, feed and page sources: documents are built from the driver tables and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import escape_html
from docweave.operators.classify import THEMES, classified
from docweave.operators.keyed import first_per_key
from docweave.registry import query, table
from docweave.sources import feeds, package_nodes, package_xml

_OPEN = f'<PackIns xmlns="{package_xml.NS[1:-1]}">'


def tagged(name: str, *inside: Column | str, **attributes: Column) -> Column:
    """An element as text."""
    head = [F.lit(f"<{name}")]
    for k, v in attributes.items():
        head += [F.lit(f' {k}="'), v.cast("string"), F.lit('"')]
    return F.concat(*head, F.lit(">"), *[F.lit(x) if isinstance(x, str) else x for x in inside], F.lit(f"</{name}>"))


def lang(c: Column | str) -> Column:
    return tagged("Lang", c if isinstance(c, str) else F.replace(escape_html(c), F.lit("<br>"), F.lit("<?enter?>")))


def joined(elements: Column) -> Column:
    return F.array_join(elements, "")


def conversations_as_documents(spark, sf_dir) -> DataFrame:
    """A chapter for each conversation, an item under its role for each turn; every third turn is marked as revised."""
    c = table(spark, sf_dir, "conversations")
    body = F.concat(tagged("Header", lang(F.col("role"))), tagged("Detail", lang(F.regexp_replace(F.trim("text"), "[ \t]+", " "))))
    item = F.when(F.col("turn") % 3 == 1, F.concat(F.lit('<Item modified="今回">'), body, F.lit("</Item>"))).otherwise(F.concat(F.lit("<Item>"), body, F.lit("</Item>")))
    items = c.groupBy("conv_id").agg(joined(F.transform(F.array_sort(F.collect_list(F.struct("turn", item.alias("x")))), lambda s: s.getField("x"))).alias("items"))
    return items.select(F.col("conv_id").cast("string").alias("u"), F.concat(F.lit(f"{_OPEN}<!--chapter--><Warnings>"), F.col("items"), F.lit("</Warnings></PackIns>")).alias("xml"))


@query("package_lines", r"""
SELECT CAST(conv_id AS VARCHAR) AS u, 'chapter > ' || role AS path, sha1(trim(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n\s*\n+', chr(10), 'g'))) AS h, count(*) AS n
FROM conversations WHERE trim(text) <> '' GROUP BY ALL""")
def package_lines(spark, sf_dir):
    lines = package_nodes.line_table(conversations_as_documents(spark, sf_dir)).where("NOT revised AND path[1] IS NOT NULL AND text <> path[1]")
    return lines.select("u", F.array_join("path", " > ").alias("path"), F.sha1("text").alias("h")).groupBy("u", "path", "h").agg(F.count("*").alias("n"))


@query("package_revisions", "SELECT CAST(conv_id AS VARCHAR) AS u, count(*) AS n FROM conversations WHERE turn % 3 = 1 GROUP BY conv_id")
def package_revisions(spark, sf_dir):
    return package_nodes.line_table(conversations_as_documents(spark, sf_dir)).where("revised").groupBy("u").agg(F.count("*").alias("n"))


def parts_as_documents(spark, sf_dir) -> DataFrame:
    """A package insert for each part: its brand and code, an adverse-event table and a pharmacology section."""
    # a small file is one task, and its documents are a hundred times its size
    p = table(spark, sf_dir, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    code = F.concat(F.lit("1110"), F.lpad(F.col("p_partkey").cast("string"), 8, "0"))
    brand = tagged("DetailBrandName", tagged("ApprovalBrandName", lang(F.col("p_name"))), tagged("BrandCode", tagged("YJCode", code)), id=F.lit("B1"))
    serious = tagged("SeriousAdverseEvents", tagged("Item", tagged("Header", lang(F.concat("p_type", F.lit("（頻度不明）、"), "p_brand")))))
    cell = tagged("AdverseReactionDescription", lang(F.col("p_name")), categoryRef=F.lit("C1"), frequencyRef=F.lit("F1"))
    other = tagged("OtherAdverseEvent", tagged("OtherAdverse", tagged("Category", lang(F.col("p_type")), id=F.lit("C1")), tagged("Frequency", lang(F.concat(F.col("p_size").cast("string"), F.lit("％未満"))), id=F.lit("F1")), cell))
    action = tagged("MechanismOfAction", tagged("Detail", tagged("Lang", '<ApprovalBrandNameRef ref="B1"/>: ', escape_html(F.col("p_type")))))
    more = tagged("OtherInformation", tagged("Header", lang(F.col("p_brand"))), tagged("OrderedList", tagged("Item", tagged("Header", lang("first")), tagged("Detail", lang(F.col("p_name")))), tagged("Item", tagged("Detail", lang("untitled")))))
    xml = F.concat(F.lit(_OPEN), tagged("PackageInsertNo", code, "_1_01"), tagged("CompanyIdentifier", "123456"), tagged("ApprovalEtc", brand), tagged("GenericName", tagged("Detail", lang(F.col("p_type")))), tagged("AdverseEvents", serious, other), tagged("EfficacyPharmacology", action, more), F.lit("</PackIns>"))
    return p.select(F.concat(F.lit("123456_"), code, F.lit("_1_01")).alias("u"), xml.alias("xml"))


_U = "'123456_1110' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') || '_1_01'"


@query("package_meta", f"""
SELECT {_U} AS u, '1110' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') || '_1_01' AS packins_no, '123456' AS company_id, p_name AS brands, p_type AS generic_name FROM part""")
def package_meta(spark, sf_dir):
    return package_nodes.meta_table(parts_as_documents(spark, sf_dir)).select("u", "packins_no", "company_id", F.array_join("brands", " / ").alias("brands"), "generic_name")


@query("package_products", f"SELECT {_U} AS u, p_name AS brand, '1110' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS code FROM part")
def package_products(spark, sf_dir):
    return package_nodes.product_table(parts_as_documents(spark, sf_dir)).select("u", "brand", "code")


@query("package_adverse_events", f"""
SELECT {_U} AS u, unnest([0, 1, 2]) AS pos, unnest(['頻度不明', '頻度の記載なし', p_size || '%未満']) AS band, unnest(['重大な副作用', '重大な副作用', p_type]) AS category, unnest([p_type, p_brand, p_name]) AS text FROM part""")
def package_adverse_events(spark, sf_dir):
    return package_xml.adverse_event_table(parts_as_documents(spark, sf_dir)).select("u", "pos", "band", "category", "text")


@query("package_blocks", f"""
SELECT {_U} AS u, unnest([0, 1, 2, 3, 4, 5]) AS pos, unnest(['h', 'p', 'h', 'h', 'p', 'p']) AS kind,
  unnest(['18.1 作用機序', p_name || ': ' || p_type, '18.2 ' || p_brand, '18.2.1 first', p_name, 'untitled']) AS text FROM part""")
def package_blocks(spark, sf_dir):
    return package_xml.block_table(parts_as_documents(spark, sf_dir)).select("u", "pos", "kind", "text")


@query("body_store", """
SELECT substr(sha1(p_type || '|' || p_brand), 1, 12) AS h, min(p_partkey) AS first, count(*) AS n FROM part GROUP BY p_type, p_brand""")
def body_store(spark, sf_dir):
    """One body for each content, the document that brings it first, and how many have it."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.substring(F.sha1(F.concat_ws("|", "p_type", "p_brand")), 1, 12).alias("h"))
    sizes = rows.groupBy("h").agg(F.count("*").alias("n"))
    return first_per_key(rows.select("h", "p_partkey"), ["h"], "p_partkey").join(sizes, "h").select("h", F.col("p_partkey").alias("first"), "n")


def orders_as_feed(spark, sf_dir) -> DataFrame:
    """A page for each status and month: a block for each day, posted rows of orders of the three upper priorities, deleted rows of the others."""
    o = table(spark, sf_dir, "orders").withColumn("posted", F.col("o_orderpriority") < "4")
    first = F.when(F.col("posted"), F.concat(F.lit('<a HREF="/go/pack/'), "o_orderkey", F.lit('_1_01/">order<BR>'), "o_orderkey", F.lit("</a>"))).otherwise(F.concat(F.lit("order &amp; "), "o_orderkey", F.lit("<!-- K"), "o_custkey", F.lit(" -->")))
    row = F.concat(F.lit("<TR><TD>"), first, F.lit("</TD><TD>"), "o_custkey", F.lit("</TD>\n<TD>"), "o_orderstatus", F.lit("</TD></TR>"))
    of = lambda p: joined(F.transform(F.array_sort(F.collect_list(F.when(p, F.struct("o_orderkey", row.alias("x"))))), lambda s: s.getField("x")))
    days = o.groupBy("o_orderstatus", F.to_date("o_orderdate").alias("d")).agg(of(F.col("posted")).alias("posted"), of(~F.col("posted")).alias("deleted"))
    block = F.concat(F.lit('<td class="title">'), F.date_format("d", "yyyy年MM月dd日"), F.lit("</td><h2>掲載分</h2><TABLE>"), "posted", F.lit("</TABLE><h2>削除分</h2><TABLE>"), "deleted", F.lit("</TABLE>"))
    return days.groupBy("o_orderstatus", F.date_trunc("month", "d").alias("month")).agg(joined(F.transform(F.array_sort(F.collect_list(F.struct("d", block.alias("x")))), lambda s: s.getField("x"))).alias("html"))


@query("weekly_feed", """
SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN o_orderpriority < '4' THEN 'posted' ELSE 'deleted' END AS kind,
  CASE WHEN o_orderpriority < '4' THEN 'order / ' || o_orderkey ELSE 'order & ' || o_orderkey END AS brand, CAST(o_custkey AS VARCHAR) AS company, o_orderstatus AS reason,
  CASE WHEN o_orderpriority < '4' THEN o_orderkey || '_1_01' END AS packins_no, CASE WHEN o_orderpriority >= '4' THEN 'K' || o_custkey END AS yj_hint
FROM orders""")
def weekly_feed(spark, sf_dir):
    return feeds.feed_rows(orders_as_feed(spark, sf_dir)).drop("pos")


@query("feed_day_records", """
WITH r AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderpriority < '4' AS posted, o_orderkey, o_custkey, o_orderstatus,
  row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE), o_orderstatus, o_orderpriority < '4' ORDER BY o_orderkey) AS pos FROM orders),
t AS (SELECT date, posted, pos, CASE WHEN posted THEN 'order / ' || o_orderkey ELSE 'order & ' || o_orderkey END AS brand, CAST(o_custkey AS VARCHAR) AS company, o_orderstatus AS reason,
  CASE WHEN posted THEN o_orderkey || '_1_01' ELSE 'K' || o_custkey END AS code FROM r)
SELECT date, count(*) FILTER (posted) AS updates, count(*) FILTER (NOT posted) AS deletes,
  sha1(coalesce(string_agg(concat_ws(':', brand, company, reason, code), '|' ORDER BY pos, brand, company, reason, code) FILTER (posted), '')) AS updates_sha1,
  sha1(coalesce(string_agg(concat_ws(':', brand, company, reason, code), '|' ORDER BY pos, brand, company, reason, code) FILTER (NOT posted), '')) AS deletes_sha1
FROM t GROUP BY date""")
def feed_day_records(spark, sf_dir):
    """Content and order of each day's updates and deletes."""
    days = feeds.day_records(feeds.feed_rows(orders_as_feed(spark, sf_dir)))
    told = lambda c, code: F.sha1(F.array_join(F.transform(c, lambda r: F.concat_ws(":", *[r.getField(f) for f in ("brand", "company", "reason", code)])), "|"))
    n = lambda c: F.size(c).cast("long").alias(c)
    return days.select("date", n("updates"), n("deletes"), told("updates", "packins_no").alias("updates_sha1"), told("deletes", "yj_hint").alias("deletes_sha1"))


@query("catalog_scan", """
SELECT p_type AS g, p_name AS n, p_brand AS c, CAST(p_partkey AS VARCHAR) AS d, '000001_' || p_partkey || '_1' AS u, '2022-04-' || lpad(CAST(1 + p_size % 28 AS VARCHAR), 2, '0') AS t FROM part WHERE p_size % 5 <> 0""")
def catalog_scan(spark, sf_dir):
    link = F.concat(F.lit("<a href='/ResultDataSetPDF/000001_"), "p_partkey", F.lit("_1'>PDF(2022年04月"), F.lpad((1 + F.col("p_size") % 28).cast("string"), 2, "0"), F.lit("日)</a><a href='javascript:x'>HTML</a>"))
    row = F.concat(F.lit("<tr class='TrColor01'><td><a href='GeneralList/"), "p_partkey", F.lit("'>"), "p_type", F.lit("</a></td><td>"), "p_name", F.lit("</td><td>"), "p_brand", F.lit("</td><td>"), F.when(F.col("p_size") % 5 != 0, link).otherwise(""), F.lit("</td></tr>"))
    pages = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") / 100).cast("long").alias("page")).agg(joined(F.collect_list(row)).alias("html"))
    return feeds.catalog_rows(pages).select("g", "n", "c", "d", F.explode("f").alias("f")).select("g", "n", "c", "d", "f.u", "f.t")


@query("guideline_index", """
SELECT CAST(p_partkey AS VARCHAR) AS i, p_name || '錠，' || p_type || '・' || p_brand || ' ［内］' AS label, 3 AS n_names FROM part""")
def guideline_index(spark, sf_dir):
    link = F.concat(F.lit('<a href="../files/'), "p_partkey", F.lit('.pdf"> ◎'), "p_name", F.lit("錠 ，○"), "p_type", F.lit(" ・"), "p_brand", F.lit(" [内] ？</a><br />"))
    pages = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 44).alias("row")).agg(F.concat(F.lit('<section class="contents">'), joined(F.collect_list(link)), F.lit("</section>")).alias("html"))
    return feeds.index_entries(pages, "row").select("i", "label", F.size(feeds.label_names(F.col("label"))).alias("n_names"))


@query("version_fallback", """
SELECT o_orderkey || '_' || lpad(CAST(1 + o_custkey % 5 AS VARCHAR), 2, '0') AS k,
  CASE WHEN o_custkey % 5 <= 2 THEN o_orderkey || '_03' WHEN o_custkey % 5 = 3 THEN NULL ELSE o_orderkey || '_07' END AS used FROM orders""")
def version_fallback(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    wanted = o.select(F.concat("o_orderkey", F.lit("_"), F.lpad((1 + F.col("o_custkey") % 5).cast("string"), 2, "0")).alias("k"))
    there = o.select(F.concat("o_orderkey", F.lit("_03")).alias("k")).union(o.where("o_custkey % 5 = 4").select(F.concat("o_orderkey", F.lit("_07")).alias("k")))
    return feeds.resolved_versions(wanted, there, "k").select("k", "used")


@query("theme_tiers", """
WITH p AS (SELECT p_partkey AS doc, p_partkey % 7 AS kind, p_size, p_size % 2 = 1 AS user FROM part),
k AS (SELECT doc, kind, CASE kind WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN CASE WHEN NOT user THEN 2 END WHEN 4 THEN CASE WHEN p_size % 3 <> 0 THEN 3 END
  WHEN 5 THEN CASE WHEN NOT user THEN 1 END WHEN 6 THEN 1 END AS k FROM p)
SELECT doc, k, CASE kind WHEN 0 THEN '2. 禁忌' WHEN 6 THEN '10. 相互作用' ELSE '8. 重要な基本的注意' END AS chapter,
  CASE kind WHEN 0 THEN '手術を受ける患者' WHEN 1 THEN '手術前は投与を中止すること。' WHEN 2 THEN '手術では観察する。' WHEN 4 THEN '' WHEN 5 THEN '詳細。' ELSE '手術の日。|手術では観察する。' END AS said
FROM k WHERE k IS NOT NULL""")
def theme_tiers(spark, sf_dir):
    """Forbidden, stop and other tiers, sentences that are ignored, the document's own lines, table rows and bodies that tell what to do."""
    p = table(spark, sf_dir, "part")
    kind = F.col("p_partkey") % 7
    by_kind = lambda *values: F.element_at(F.array(*map(F.lit, values)), (kind + 1).cast("int"))
    own = F.when((kind == 4) & (F.col("p_size") % 3 == 0), "")
    said = F.coalesce(own, by_kind("手術を受ける患者", "手術前は投与を中止すること。", "手術では観察する。", "手術不能の患者。", "自身の記載", "詳細。", "手術の日。関係のない文。手術では観察する。"))
    body = F.when(kind == 5, F.when(F.col("p_size") % 2 == 0, "投与を中止する。").otherwise("観察する。")).when(kind == 6, "3日以内に観察する。")
    path = F.when(kind == 5, "手術中の注意").otherwise("p")
    group = F.when(F.col("p_size") % 2 == 0, "999").otherwise("111")
    chapter = F.when(kind == 0, "ContraIndications").when(kind == 6, "Interactions").otherwise("ImportantPrecautions")
    rows = p.select("p_partkey", F.concat(F.lit("123456_"), group, F.lit("0000A1011_1_01")).alias("u"), F.lit("").alias("cls"), chapter.alias("ch"), path.alias("p"), said.alias("t"), body.alias("b"), (kind == 4).cast("int").alias("own"), (kind == 5).cast("int").alias("row"))
    return classified(rows, THEMES["shujutsu"]).select(F.col("p_partkey").alias("doc"), "k", "chapter", F.array_join("s", "|").alias("said"))
