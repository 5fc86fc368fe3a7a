import gzip
import io
import json
import zipfile

from pyspark.sql import functions as F

from docweave.sources import feeds, sheets, stores


def test_weekly_feed(spark):
    page = """x<td class="title">2026年08月21日</td><h2>掲載分</h2><TABLE><TR><TD><a HREF="/go/pack/1_2_03/">甲<BR>錠</a></TD><TD>社</TD> <TD>更新</TD></TR>
<TR><TD>乙</TD><TD>社</TD><TD>新規</TD></TR></TABLE><h2>削除分</h2><TABLE><TR><TD>丙<!-- 111A --></TD><TD>社</TD><TD>削除</TD></TR></TABLE><td class="title">2026年08月22日</td>none"""
    rows = feeds.feed_rows(spark.createDataFrame([(page,)], "html string"))
    assert [tuple(r) for r in rows.orderBy("kind", "pos").collect()] == [
        ("2026-08-21", "deleted", 0, "丙", "社", "削除", None, "111A"),
        ("2026-08-21", "posted", 0, "甲 / 錠", "社", "更新", "1_2_03", None),
        ("2026-08-21", "posted", 1, "乙", "社", "新規", None, None),
    ]
    day = feeds.day_records(rows).first()
    assert [u.brand for u in day.updates] == ["甲 / 錠", "乙"] and len(day.deletes) == 1


def test_versions(spark):
    wanted = spark.createDataFrame([("a_1_03",), ("b_1_01",), ("c",)], "k string")
    there = spark.createDataFrame([("a_1_04",), ("a_1_06",), ("c",)], "k string")
    assert {r.k: (r.used, r.moved) for r in feeds.resolved_versions(wanted, there, "k").collect()} == {"a_1_03": ("a_1_04", True), "b_1_01": (None, None), "c": ("c", False)}


def test_catalog(spark):
    row = "<tr class='TrColor01'><td><a href='GeneralList/12'>一般</a></td><td>名<div></td><td>社</td><td><a href='x/ResultDataSetPDF/1_2_3'>PDF(2022年04月01日)</a><a href='j'>HTML</a></td></tr>"
    page = row + "<tr class='TrColor02'><td>a</td></tr><select name=\"effectValue\"><option value=\"\">-</option><option value=\"11\">--中枢</option></select>検索結果3件／全1ページ"
    pages = spark.createDataFrame([(page,)], "html string")
    r = feeds.catalog_rows(pages).first()
    assert (r.g, r.n, r.c, r.d, [tuple(x) for x in r.f]) == ("一般", "名", "社", "12", [("1_2_3", "2022-04-01")])
    assert [tuple(r) for r in feeds.class_options(pages).collect()] == [("11", "中枢")]
    over = "検索結果<span>1160</span>件見つかりました"
    got = spark.createDataFrame([(page,), (over,)], "html string").select(feeds.result_counts(F.col("html")).alias("x")).collect()
    assert [tuple(r.x) for r in got] == [(3, 1, False), (1160, None, True)]


def test_index(spark):
    page = '<section class="contents a"><a href="../files/747.pdf"> ◎アーチスト錠，○カルベジロール錠 ［内］</a><a href="x">y</a></section><a href="files/1.pdf">no</a>'
    pages = spark.createDataFrame([("a", 1, page), ("i", 2, page.replace("○カルベ", "別名・カルベ"))], "row string, at int, html string")
    entries = feeds.index_entries(pages, "row").join(pages.select("row", "at"), "row")
    assert {r.label for r in entries.collect()} == {"アーチスト錠，カルベジロール錠 ［内］", "アーチスト錠，別名・カルベジロール錠 ［内］"}
    m = feeds.merged_entries(entries, "row", "at").first()
    assert (m.i, m.n, m.s, m.r) == ("747", "アーチスト錠，カルベジロール錠 ［内］", ["アーチスト錠", "カルベジロール錠", "別名"], ["a", "i"])
    head = feeds.page_head(spark.createDataFrame([("a", "<title>T | S</title><meta name=\"description\" content=\"D\">"), ("_b", "")], "name string, html string"), "name")
    assert [tuple(r) for r in head.collect()] == [("a", "T", "D")]


def workbook(rows):
    cell = lambda ref, v: f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
    m = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    body = "".join("<row>" + "".join(cell(f"{chr(65 + j)}{i + 1}", v) for j, v in enumerate(r) if v is not None) + "</row>" for i, r in enumerate(rows))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{m}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><x Id="r1" Target="worksheets/s.xml"/></R>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{m}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def test_price_list(spark):
    head = ["区分", "薬価基準収載医薬品コード", "品名", "規格 単位", "メーカー名", "薬価", "経過措置"]
    a = workbook([["title"], head, ["内", "1110000a1011", "甲", "1錠", None, "1,234.5", None], ["内", "x", "", "", "", "1", ""], ["内", "1110000A1022", "乙", "1錠", "社", "?", ""]])
    b = workbook([head, ["内", "1110000A1011", "甲", "1錠", "社", "9", "2026.3"]])
    assert sheets.column_index("AB12") == 27
    got = sheets.price_list(spark.createDataFrame([(1, a), (2, b)], "n int, content binary"), "n").collect()
    assert [(r.code, r.name, r.unit, float(r.price), r.expiry, r.unified) for r in got] == [("1110000A1011", "甲", "1錠", 9.0, "2026.3", False)]
    one = sheets.price_list(spark.createDataFrame([(1, a)], "n int, content binary"), "n").first()
    assert float(one.price) == 1234.5 and one.unified


def test_stores(spark, tmp_path):
    assert stores.read_store(spark, f"{tmp_path}/none.json", "a int").count() == 0
    (tmp_path / "s.json").write_text('{"a": 1}\n{"a": \n')
    from pyspark.sql.types import StructType

    good, bad = stores.split_corrupt(spark, str(tmp_path / "s.json"), StructType.fromDDL("a int"))
    assert [r.a for r in good.collect()] == [1] and bad.count() == 1
    days = spark.createDataFrame([("d1", 1), ("d2", 2)], "date string, v int")
    stores.write_days(days, f"{tmp_path}/days")
    stores.write_days(days.where("date = 'd1'").withColumn("v", F.lit(5)), f"{tmp_path}/days")
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/days").select("date", "v").collect()} == {("d1", 5), ("d2", 2)}
    assert stores.write_if_changed(days, f"{tmp_path}/w") and not stores.write_if_changed(days.orderBy("v"), f"{tmp_path}/w")
    assert stores.write_if_changed(days.limit(1), f"{tmp_path}/w")
    assert stores.read_current(spark, f"{tmp_path}/w", "date string, v int").count() == 1 and stores.read_current(spark, f"{tmp_path}/x", "v int").count() == 0
    (tmp_path / "w" / "version-000000000009").mkdir()  # a write that never ended
    assert stores.current(spark, f"{tmp_path}/w").endswith("version-000000000001")
    hashed = spark.createDataFrame([("a9f", 1), ("00f", 2)], "h string, v int")
    stores.write_buckets(hashed, f"{tmp_path}/b", "h")
    assert len(list((tmp_path / "b").glob("bucket=*"))) == 64 and spark.read.parquet(f"{tmp_path}/b").count() == 2
    assert stores.read_bucket(spark, f"{tmp_path}/b", "a9f").first().v == 1
    stores.write_buckets(spark.createDataFrame([("a9f", 1)], "sha string, v int"), f"{tmp_path}/named", "sha")
    assert stores.read_bucket(spark, f"{tmp_path}/named", "a9f", "sha").first().v == 1
    docs = spark.createDataFrame([("123456_1110000A1011_1_02", "<a/>"), ("../evil", "x")], "u string, xml string")
    stores.put_cache(docs, f"{tmp_path}/c")
    cache = spark.read.parquet(f"{tmp_path}/c")
    assert [r.u for r in cache.collect()] == ["123456_1110000A1011_1_02"] and stores.pruned(cache, docs.where("u = 'z'")).count() == 0
    asked = spark.createDataFrame([("123456_1110000A1011_1_02",), ("123456_9990000A1011_1_01",)], "u string")
    assert [r.xml for r in stores.cached(spark, f"{tmp_path}/c", asked).collect()] == ["<a/>"]
    assert [tuple(r) for r in stores.cache_stats(cache).collect()] == [("111", 1, 4)]
    config = stores.with_defaults(spark.createDataFrame([(None,)], "a int"), a=3, b="x").first()
    assert (config.a, config.b) == (3, "x")
    slim = spark.sql("SELECT array(named_struct('u', 'a', 't', 'T')) AS f").select(stores.slim_files(F.col("f")).alias("f")).first().f
    assert json.loads(json.dumps([tuple(x) for x in slim])) == [["a", None]]


def test_bytes(spark):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.xml", "<a/>")
        f.writestr("p.gif", b"GIF89a")
        f.writestr("q.gif", b"no")
    raw = [z.getvalue(), gzip.compress(b"<b/>"), b"<c/>", None]
    df = spark.createDataFrame([(x,) for x in raw], "b binary")
    assert [r[0] for r in df.select(stores.document_of("b")).collect()] == ["<a/>", "<b/>", "<c/>", None]
    pages = spark.createDataFrame([("<meta charset=shift_jis>あ".encode("shift_jis"),), (b"\xff",)], "b binary")
    assert [r[0] for r in pages.select(stores.decoded_page("b")).collect()] == ["<meta charset=shift_jis>あ", "�"]
    got = df.limit(1).select(F.explode(stores.extract_images("b", F.array(F.lit("P.gif"), F.lit("q.gif"), F.lit("../x.gif")))).alias("i")).select("i.*")
    assert [r.name for r in got.collect()] == ["P.gif"]
    assert stores.changed_images(got, got).count() == 0 and stores.changed_images(got, got.withColumn("crc", F.lit(0).cast("long"))).count() == 1


def test_price_files(spark):
    link = lambda k, n: f'<a href="/d/tp20260{n}01-{n}_0{k}.xlsx">x</a>'
    full = "".join(link(k, 4) for k in (1, 2, 3, 4)) + link(1, 9)
    pages = spark.createDataFrame([(2026, full.replace("_04", "_09")), (2025, full), (2024, full)], "year int, html string")
    got = {r.kind: r.href for r in feeds.price_files(pages, 2026).collect()}
    assert set(got) == {"01", "02", "03", "04"} and got["01"] == "/d/tp20260401-4_01.xlsx"
    assert feeds.price_files(pages.where("year = 2026"), 2026).count() == 0
    dates = spark.createDataFrame([("x/tp20260401-1_01.xlsx",), ("x",)], "h string").select(feeds.file_date(F.col("h")))
    assert [r[0] for r in dates.collect()] == ["2026-04-01", ""]


def test_broken_and_newest_files(spark, tmp_path):
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("a int")
    (tmp_path / "broken.json").write_text('{"a": 1')
    assert stores.read_store(spark, str(tmp_path / "broken.json"), schema).count() == 0
    moved = stores.moved_aside(spark, str(tmp_path / "broken.json"), schema)
    assert [p.name for p in tmp_path.glob("*.bad")] == ["broken.json.bad"] and moved[0].endswith("broken.json.bad")
    for day, a in (("2026-01-01", 1), ("2026-01-03", 3), ("2026-01-02", 2)):
        (tmp_path / f"{day}.json").write_text(json.dumps({"a": a}))
    assert [(r.a, r.file) for r in stores.newest_first(spark, f"{tmp_path}/2026*.json", schema, 2).collect()] == [(3, "2026-01-03.json"), (2, "2026-01-02.json")]
    assert {f.rsplit("/", 1)[1] for f in stores.newest_first(spark, f"{tmp_path}/2026*.json", schema, 2).inputFiles()} == {"2026-01-03.json", "2026-01-02.json"}
    assert stores.newest_first(spark, f"{tmp_path}/none*.json", schema, 2).count() == 0
    stores.write_index(spark.createDataFrame([(2,), (1,)], "a int"), f"{tmp_path}/index", "a")
    assert "".join(p.read_text() for p in (tmp_path / "index").glob("part-*")) == '{"a":1}\n{"a":2}\n'


def test_labels_part_by_part(spark):
    labels = {
        "　◎ 甲錠 ， ○乙 ･ 丙 [ 内 ] ？": "甲錠，乙・丙 ［内］",
        "甲 ▼ 乙": "甲 乙",
        "｢甲｣乙［外］［注］": "「甲」乙 ［外］ ［注］",
        "甲[長い長い長い長い長い注]": "甲[長い長い長い長い長い注]",
        "甲、 乙?": "甲、乙",
        "[◎内]甲[内 ･ 外] [ 注　意 ]": "［内］甲 ［内・外］ ［注 意］",
        "": "",
    }
    df = spark.createDataFrame([(x,) for x in labels], "x string")
    assert [r[0] for r in df.select(feeds.clean_label(F.col("x"))).collect()] == list(labels.values())
    names = {"甲錠＜販売中止＞，乙（中止）・丙（未来） ［内］": ["甲錠", "乙", "丙（未来）"], "甲［内］乙": ["甲 乙"], "，": [], "250単位/mL<x>": ["250単位/mL"]}
    df = spark.createDataFrame([(x,) for x in names], "x string")
    assert [r[0] for r in df.select(feeds.label_names(F.col("x"))).collect()] == list(names.values())


def test_servers(spark):
    """Retries, what isn't found, and result pages of one session, against a server of the test's own."""
    import threading
    import urllib.parse
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    from docweave.sources import landed

    seen = {}

    class Answers(BaseHTTPRequestHandler):
        def answer(self, status, text, **headers):
            self.send_response(status)
            for k, v in headers.items():
                self.send_header(k.replace("_", "-"), v)
            self.end_headers()
            self.wfile.write(text.encode())

        def do_GET(self):
            seen[self.path] = seen.get(self.path, 0) + 1
            if self.path == "/start":
                self.answer(200, "form", Set_Cookie="s=1")
            elif self.path == "/flaky" and seen[self.path] < 3:
                self.answer(500, "no")
            else:
                self.answer(404 if self.path == "/none" else 200, "yes")

        def do_POST(self):
            form = dict(urllib.parse.parse_qsl(self.rfile.read(int(self.headers["Content-Length"])).decode()))
            self.answer(200 if self.headers.get("Cookie") == "s=1" else 403, f"検索結果3件／全2ページ {form['effect']} {form['page']} {form['doc']}")

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    try:
        landed.register(spark)
        got = spark.read.format("docweave_addresses").option("addresses", json.dumps([f"{at}/flaky", f"{at}/none"])).option("wait", "0.01").load()
        rows = {r.address.rsplit("/", 1)[1]: (r.status, r.content and bytes(r.content), r.error) for r in got.collect()}
        assert rows == {"flaky": (200, b"yes", None), "none": (404, None, "404 Not Found")} and seen == {"/flaky": 3, "/none": 1}
        found = spark.read.format("docweave_results").options(start=f"{at}/start", search=f"{at}/s", classes='["11", "12"]', form='{"doc": "x"}', pause="0").load()
        assert sorted((r["class"], r.page, r.html[-6:]) for r in found.collect()) == [(c, p, f"{c} {p} x") for c in ("11", "12") for p in (1, 2)]
    finally:
        server.shutdown()
