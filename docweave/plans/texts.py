"""Queries of text, band, page and formula functions, classification, diffs and clusters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docweave.functions import bands, keys, text
from docweave.operators import classify, clusters, diffs
from docweave.registry import query, table
from docweave.sources.tables import with_ids, written


@query("tier_classify", """
SELECT doc_id, CASE WHEN regexp_matches(text, 'idiot|moron|trash') THEN 0 WHEN regexp_matches(text, '[#$%&*]{3}') THEN 1 WHEN n_chars >= 5000 THEN 2 ELSE 3 END AS k FROM documents""")
def tier_classify(spark, sf_dir):
    k = F.when(F.col("text").rlike("idiot|moron|trash"), 0).when(F.col("text").rlike("[#$%&*]{3}"), 1).when(F.col("n_chars") >= 5000, 2).otherwise(3)
    return table(spark, sf_dir, "documents").select("doc_id", k.alias("k"))


@query("tier_counts_hidden", """
WITH t AS (SELECT CASE WHEN n_chars < 500 THEN 0 WHEN n_chars < 2000 THEN 1 WHEN n_chars < 5000 THEN 2 ELSE 3 END AS k FROM documents)
SELECT k, count(*) AS n, k IN (0, 2) AS shown, CASE WHEN k IN (0, 2) THEN 0 ELSE count(*) END AS n_hidden FROM t GROUP BY k""")
def tier_counts_hidden(spark, sf_dir):
    n = F.col("n_chars")
    t = table(spark, sf_dir, "documents").select(F.when(n < 500, 0).when(n < 2000, 1).when(n < 5000, 2).otherwise(3).alias("k"))
    return classify.tier_counts(t, "k", [0, 2])


@query("important_flag", """
SELECT doc_id, contains(string_split(text, chr(10))[1], 'tion') OR contains(string_split(text, chr(10))[1], 'ment') AS important FROM documents""")
def important_flag(spark, sf_dir):
    first = F.element_at(F.split("text", "\n"), 1)
    return table(spark, sf_dir, "documents").select("doc_id", classify.important(first, ["tion", "ment"]).alias("important"))


@query("band_parse_order", """
WITH d AS (SELECT DISTINCT CAST(round(l_discount * 100) AS INTEGER) AS x FROM lineitem),
b AS (SELECT x, CASE WHEN x = 0 THEN '頻度不明' WHEN x % 4 = 1 THEN x || '%以上' WHEN x % 4 = 2 THEN x || '%未満' WHEN x % 4 = 3 THEN '0.1～' || x || '%未満' ELSE x || '%' END AS band FROM d),
k AS (SELECT x, band, CASE WHEN x = 0 THEN -1.0 WHEN x % 4 = 2 THEN 0.0 WHEN x % 4 = 3 THEN 0.1 ELSE x END AS lo, CASE WHEN x = 0 THEN -1.0 WHEN x % 4 = 1 THEN 1000.0 ELSE x END AS hi FROM b)
SELECT band, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi, CAST(CASE WHEN lo < 0 THEN 0 WHEN lo >= 5 THEN 3 WHEN lo >= 1 OR hi >= 5 THEN 2 ELSE 1 END AS INTEGER) AS level,
  row_number() OVER (ORDER BY CASE WHEN hi >= 1000 THEN lo ELSE hi END DESC, lo DESC, band) AS place FROM k""")
def band_parse_order(spark, sf_dir):
    x = F.col("x")
    raw = F.when(x == 0, "頻度不明").when(x % 4 == 1, F.concat(x, F.lit("％ 以上"))).when(x % 4 == 2, F.concat(x, F.lit("%未満注1)"))).when(x % 4 == 3, F.concat(F.lit("0.1%〜"), x, F.lit("％未満"))).otherwise(F.concat(F.lit("いずれも"), x, F.lit("%")))
    d = table(spark, sf_dir, "lineitem").select(F.round(F.col("l_discount") * 100).cast("int").alias("x")).distinct()
    b = d.select(bands.band(raw).alias("band")).withColumn("b", bands.bounds(F.col("band")))


    place = F.row_number().over(Window.orderBy(F.desc(bands.order_key(F.col("b"))), "band"))  # a dozen bands
    return b.select("band", "b.lo", "b.hi", bands.level(F.col("b")).alias("level"), place.cast("long").alias("place"))


@query("split_header_freq", """
SELECT p_partkey, unnest([1, 2, 3]) AS pos, unnest(['頻度不明', p_size || '%未満', '頻度の記載なし']) AS band, unnest([p_name, p_brand || '、' || p_type, 'rest']) AS name FROM part""")
def split_header_freq(spark, sf_dir):
    header = F.concat("p_name", F.lit("（頻度不明）、"), "p_brand", F.lit("、"), "p_type", F.lit("（"), "p_size", F.lit("％未満）、rest"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(bands.named_bands(header, F.lit(""))).alias("pos", "x"))
    return rows.select("p_partkey", (F.col("pos") + 1).alias("pos"), "x.band", "x.name")


@query("sentence_split", """
WITH s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[.\\n]'), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents)
SELECT doc_id, len(s) AS n, CAST(coalesce(list_sum(list_transform(s, lambda x: length(x))), 0) AS BIGINT) AS chars FROM s""")
def sentence_split(spark, sf_dir):
    s = F.filter(F.transform(F.split("text", r"[.\n]"), lambda x: F.trim(x)), lambda x: x != "")
    d = table(spark, sf_dir, "documents").select("doc_id", s.alias("s"))
    return d.select("doc_id", F.size("s").cast("long").alias("n"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"))


@query("normalize_text", r"""
SELECT doc_id, sha1(regexp_replace(lower(text), '\s+', '', 'g')) AS h, CAST(length(regexp_replace(lower(text), '\s+', '', 'g')) AS BIGINT) AS n FROM documents""")
def normalize_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", text.search_form(text.nfkc("text")).alias("t"))
    return d.select("doc_id", F.sha1("t").alias("h"), F.length("t").cast("long").alias("n"))


#: Letters of part names as kana in several forms, how they are folded, and the row each is listed under.
_LETTERS, _RAW = "rdalgtuoiwsnbvmezpch", "がｱあざばぱうおいゎｻなべゔまえずｐＣほ"
_FOLDED, _ROWS = "ガアアザバパウオイヮサナベヴマエズpcホ", "カアアサハハウオイワサナヘウマエスpcホ"


@query("kana_fold", f"""
WITH p AS (SELECT p_partkey, replace(p_name, ' ', '') AS n FROM part)
SELECT p_partkey, translate(n, '{_LETTERS}', '{_FOLDED}') AS folded, translate(substr(n, 1, 1), '{_LETTERS}', '{_ROWS}') AS row FROM p""")
def kana_fold(spark, sf_dir):
    """Part names in hiragana, half-width and full-width characters."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.translate("p_name", _LETTERS, _RAW).alias("raw"))
    folded = rows.select("p_partkey", text.search_form(text.nfkc("raw")).alias("folded"))
    return folded.select("p_partkey", "folded", text.index_kana(F.col("folded")).alias("row"))


@query("html_cells", r"""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) AS a FROM pages)
SELECT page_id, regexp_extract(a, 'href="([^"]*)"', 1) AS href,
  trim(regexp_replace(replace(replace(replace(replace(replace(regexp_extract(a, '>([^<]*)<', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS label, count(*) AS n
FROM l GROUP BY 1, 2, 3""")
def html_cells(spark, sf_dir):
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="[^"]*">[^<]*</a>'), 0)).alias("a"))
    cells = links.select("page_id", F.regexp_extract("a", 'href="([^"]*)"', 1).alias("href"), text.strip_tags(F.col("a")).alias("label"))
    return cells.groupBy("page_id", "href", "label").agg(F.count("*").alias("n"))


@query("page_meta", r"""
SELECT page_id, regexp_extract(html, '<title>([^<|]*)', 1) AS title, regexp_extract(url, '^(\w+)://([^/]*)', 1) AS scheme, regexp_extract(url, '^(\w+)://([^/]*)', 2) AS host,
  regexp_extract(html, '<html lang="(\w*)"', 1) AS lang FROM pages""")
def page_meta(spark, sf_dir):
    part = lambda c, p, i=1: F.regexp_extract(c, p, i)
    return table(spark, sf_dir, "pages").select("page_id", part("html", "<title>([^<|]*)").alias("title"), part("url", r"^(\w+)://([^/]*)").alias("scheme"), part("url", r"^(\w+)://([^/]*)", 2).alias("host"), part("html", r'<html lang="(\w*)"').alias("lang"))


@query("json_props", "SELECT user_id, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count(*) AS n FROM events GROUP BY user_id")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", F.from_json("props", "k long").alias("p")).groupBy("user_id").agg(F.sum("p.k").alias("k"), F.count("*").alias("n"))


@query("dialysis_formula", """
SELECT p_partkey, CASE WHEN p_retailprice > 0 AND p_size > 0 THEN floor((-17.32::DOUBLE * log10(p_retailprice) - 0.39::DOUBLE * (p_partkey % 101) + 0.06::DOUBLE * ((p_partkey % 97)::DOUBLE / p_size) + 83.34::DOUBLE) * 100 + 0.5) / 100 END AS removal FROM part""")
def dialysis_formula(spark, sf_dir):
    value = keys.removal_percent(F.col("p_retailprice"), F.col("p_partkey") % 101, F.col("p_partkey") % 97, F.col("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", value.alias("removal"))


@query("accumulation_ratio", "SELECT p_size, round(1 / (1 - exp(-0.693::DOUBLE * p_size / 12.0::DOUBLE)), 6) AS ratio FROM (SELECT DISTINCT p_size FROM part WHERE p_size > 0)")
def accumulation_ratio(spark, sf_dir):
    sizes = table(spark, sf_dir, "part").where("p_size > 0").select("p_size").distinct()
    return sizes.select("p_size", F.round(keys.accumulation_ratio(F.col("p_size").cast("double"), F.lit(12.0)), 6).alias("ratio"))


@query("fiscal_years", """
SELECT o_orderkey, CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) < 4 THEN 1 ELSE 0 END AS INTEGER) AS fy,
  strftime(o_orderdate, '%Y-%m-%d') || ' (' || ['Mon','Tue','Wed','Thu','Fri','Sat','Sun'][CAST(isodow(o_orderdate) AS INTEGER)] || ')' AS label FROM orders""")
def fiscal_years(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", keys.fiscal_year(F.col("o_orderdate")).alias("fy"), keys.weekday_label(F.col("o_orderdate")).alias("label"))


@query("document_keys", """
SELECT l_orderkey, l_linenumber, l_partkey, 'Y' || l_partkey || '_' || l_suppkey AS key, CAST(l_partkey AS VARCHAR) AS code FROM lineitem""")
def document_keys(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    full = F.concat(F.lit("Y"), "l_partkey", F.lit("_"), "l_suppkey", F.lit("_"), F.lpad(F.col("l_linenumber").cast("string"), 2, "0"))
    return l.select("l_orderkey", "l_linenumber", "l_partkey", keys.document_key(full).alias("key"), keys.product_code(F.concat(F.lit("000001_"), "l_partkey", F.lit("_1"))).alias("code"))


#: Runs of sixteen characters, the n-th of equal ones told apart, as the cluster measure counts them; keys in the order seen.
_RUNS = """
k AS (SELECT source, lang, key, min(doc_id) AS first, count(*) AS times FROM d GROUP BY ALL),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY first) AS i FROM k),
z AS (SELECT source, lang, i, length(key) AS size, unnest(string_split(key, '')) AS c, unnest(range(1, length(key) + 1)) AS p FROM n WHERE key <> ''),
y AS (SELECT source, lang, i, p, size, concat(c, lead(c, 1) OVER w, lead(c, 2) OVER w, lead(c, 3) OVER w, lead(c, 4) OVER w, lead(c, 5) OVER w, lead(c, 6) OVER w, lead(c, 7) OVER w, lead(c, 8) OVER w, lead(c, 9) OVER w, lead(c, 10) OVER w, lead(c, 11) OVER w, lead(c, 12) OVER w, lead(c, 13) OVER w, lead(c, 14) OVER w, lead(c, 15) OVER w) AS gram FROM z WINDOW w AS (PARTITION BY source, lang, i ORDER BY p)),
x AS (SELECT source, lang, i, gram FROM y WHERE p <= greatest(size - 15, 1)),
g AS (SELECT *, row_number() OVER (PARTITION BY source, lang, i, gram) AS nth FROM x),
s AS MATERIALIZED (SELECT source, lang, i, list(nth || ':' || gram) AS l FROM g GROUP BY ALL),
e AS MATERIALIZED (SELECT a.source, a.lang, a.i AS late, list(b.i) AS near FROM s a JOIN s b ON a.source = b.source AND a.lang = b.lang AND b.i < a.i AND 2 * least(len(a.l), len(b.l)) >= 0.8 * (len(a.l) + len(b.l)) - 1e-9
  WHERE 2 * len(list_intersect(a.l, b.l)) >= 0.8 * (len(a.l) + len(b.l)) - 1e-9 GROUP BY ALL),
m AS MATERIALIZED (SELECT n.source, n.lang, n.i, coalesce(near, []) AS near FROM n LEFT JOIN e ON e.source = n.source AND e.lang = n.lang AND e.late = n.i)"""


@query("fuzzy_cluster", f"""
WITH RECURSIVE d AS (SELECT source, lang, doc_id, coalesce(text, '') AS key FROM documents),{_RUNS},
r(source, lang, i, opened) AS (
  SELECT DISTINCT source, lang, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM n
  UNION ALL
  SELECT r.source, r.lang, m.i, CASE WHEN list_has_any(r.opened, m.near) THEN r.opened ELSE list_append(r.opened, m.i) END
  FROM r JOIN m ON m.source = r.source AND m.lang = r.lang AND m.i = r.i + 1),
o AS (SELECT source, lang, arg_max(opened, i) AS opened FROM r GROUP BY ALL),
c AS (SELECT n.source, n.lang, n.key, n.first, n.times, CASE WHEN list_contains(opened, n.i) THEN n.i ELSE list_min(list_intersect(opened, m.near)) END AS top
  FROM n JOIN o ON o.source = n.source AND o.lang = n.lang JOIN m ON m.source = n.source AND m.lang = n.lang AND m.i = n.i),
b AS (SELECT source, lang, top, min(first) AS cluster, min(struct_pack(t := -times, f := first)).f AS lead, sum(times) AS size FROM c GROUP BY ALL)
SELECT d.source, doc_id, cluster, doc_id = lead AS representative, CAST(size AS BIGINT) AS size
FROM d JOIN c ON c.source = d.source AND c.lang = d.lang AND c.key = d.key JOIN b ON b.source = c.source AND b.lang = c.lang AND b.top = c.top""")
def fuzzy_cluster(spark, sf_dir):
    """Near copies within a source and language by their whole texts; a cluster is named by the document that opened it."""
    d = table(spark, sf_dir, "documents").select("source", "lang", "doc_id", F.coalesce("text", F.lit("")).alias("key"))
    return clusters.clustered(d, ["source"], ["lang"], "key", ["doc_id"], clusters.Grams()).select("source", "doc_id", "cluster", "representative", "size")


@query("seq_diff")
def seq_diff(spark, sf_dir):
    """Line diffs of adjacent conversations."""
    lines = table(spark, sf_dir, "conversations").select("conv_id", "role", (F.col("turn") * 1000).alias("base"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    lines = lines.select((F.col("conv_id") - F.col("conv_id") % 2).alias("pair"), "conv_id", (F.col("base") + F.col("i")).alias("pos"), "role", "line")
    out = diffs.snapshots_diff(lines.where("conv_id % 2 = 0"), lines.where("conv_id % 2 = 1"), "pair", "pos", "role", "line")
    return out.withColumnRenamed("key", "pair")


@query("char_diff")
def char_diff(spark, sf_dir):
    """Marked differences of near copies: each different text of a cluster, over all sources, against the text that opened it."""
    d = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("key")).withColumn("h", F.sha2("key", 256))
    members = clusters.clustered(d, [], [], "key", ["doc_id"], clusters.Grams()).select("doc_id", "cluster", "h")
    # texts don't go with the members: only those of pairs are fetched
    pairs = written(members.groupBy("cluster", "h").agg(F.min("doc_id").alias("last")).where("last <> cluster"), "diff-pairs", freed=True)
    late, early = with_ids(d.withColumnsRenamed({"doc_id": "last", "key": "b"}), pairs, "last"), with_ids(d.select(F.col("doc_id").alias("cluster"), F.col("key").alias("a")), pairs, "cluster")
    both = pairs.join(late, ["last", "h"]).dropDuplicates(["cluster", "h"]).join(early, "cluster")
    both = both.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "last")  # few bytes, much work
    return both.select(F.col("cluster").alias("first"), "last", diffs.mark_changes("a", "b").alias("m")).select("first", "last", "m.*")
