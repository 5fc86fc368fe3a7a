from pyspark.sql import functions as F

from docweave.functions import bands, keys, names, text


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column).collect()]


def test_band_spelling_and_bounds(spark):
    raw = ["0.1%～5%未満", "0.1〜5％未満", "1%以上5%未満", "1%以上～5%未満", "いずれも 5%以上", "1%未満注1)", "72.6%", "3.9%、49.7%", "頻度不明", "", None]
    one = bands.band(text.nfkc(F.col("x")))
    assert values(spark, one, raw) == ["0.1～5%未満", "0.1～5%未満", "1～5%未満", "1～5%未満", "5%以上", "1%未満", "72.6%", "3.9%、49.7%", "頻度不明", "頻度の記載なし", "頻度の記載なし"]
    assert [tuple(b) for b in values(spark, bands.bounds(one), raw)] == [(0.1, 5), (0.1, 5), (1, 5), (1, 5), (5, 1000), (0, 1), (72.6, 72.6), (49.7, 49.7), (-1, -1), (-2, -2), (-2, -2)]


def test_band_order(spark):
    order = ["72.6%", "20%以上", "5～20%未満", "5%以上", "0.1～5%未満", "3.2%", "1%未満", "0.5%", "0.1%未満", "頻度不明", "頻度の記載なし"]
    df = spark.createDataFrame([(x,) for x in sorted(order)], "x string").orderBy(F.desc(bands.order_key(bands.bounds(F.col("x")))))
    assert [r.x for r in df.collect()] == order
    assert values(spark, bands.level(bands.bounds(F.col("x"))), ["5%以上", "1～5%未満", "1%未満", "頻度不明"]) == [3, 2, 1, 0]


def test_named_bands(spark):
    got = values(spark, bands.named_bands(F.col("x"), F.lit("")), ["劇症肝炎（頻度不明）、肝機能障害、黄疸（0.1%未満）", "発疹", ""])
    assert [[tuple(p) for p in g] for g in got] == [[("頻度不明", "劇症肝炎"), ("0.1%未満", "肝機能障害、黄疸")], [("頻度の記載なし", "発疹")], []]


def test_normal_forms(spark):
    assert values(spark, text.code_form(text.nfkc("x")), ["DK 505", "dk-505", "ＤＫ５０５"]) == ["DK505"] * 3
    once = text.search_form(text.nfkc("x"))
    assert values(spark, once, ["ひらがな　カナ", "Ａb", None]) == ["ヒラガナカナ", "ab", None]
    assert values(spark, text.match_form(text.nfkc("x")), ["メチコバ－ル", "アスパラ-CA錠", "ネオラミン・スリービー"]) == ["メチコバール", "アスパラca錠", "ネオラミンスリービー"]
    assert values(spark, text.char_class(F.col("x")), ["ア", "漢", "a1", "("]) == ["k", "j", "a", "p"]
    assert values(spark, text.sentences(F.col("x")), ["一。二。\n 三 ", ""]) == [["一。", "二。", "三"], []]
    assert values(spark, text.without_reference_marks(F.col("x")), ["文。,", "文, ", "文"]) == ["文。", "文", "文"]
    assert values(spark, text.strip_tags(F.col("x")), ["<a>x</a><BR>y &amp;lt;", "a</div>\n<div>b"]) == ["x / y &lt;", "a / b"]
    assert values(spark, text.highlighted(F.col("x"), F.array(F.lit("b"))), ["abc"]) == ["a<mark>b</mark>c"]
    assert values(spark, text.escape_html(F.col("x")), ["<a>&\n"]) == ["&lt;a&gt;&amp;<br>"]


def test_keys(spark):
    assert values(spark, keys.document_key(F.col("x")), ["2399008F1020_7_04", "x"]) == ["2399008F1020_7", "x"]
    assert values(spark, keys.hash_bucket(F.col("x")), ["a9ff", "00", "ff"]) == ["41", "00", "63"]
    assert values(spark, keys.is_target(F.col("x")), ["1_2", "1_2E", "12", ""]) == [True, False, False, False]
    assert values(spark, keys.lenient_price(F.col("x")), ["1,234.50", "x", ""])[1:] == [None, None]
    assert values(spark, keys.half_up(F.col("x")), [-0.125, 0.125], "x double") == [-0.12, 0.13]
    assert values(spark, keys.removal_percent(F.col("x"), F.lit(0), F.lit(0), F.lit(1)), [1.0, 0.0], "x double") == [83.34, None]
    assert values(spark, keys.age_in_days(F.col("x"), F.to_date(F.lit("2026-01-31"))), ["2026-01-01", "?"]) == [30, 999]


def test_prefixes():
    assert names.prefixes("アクテムラ皮下注シリンジ") == ["アクテムラ皮下注シリンジ", "アクテムラ皮下注", "アクテムラ"]
    assert names.form_only("点滴静注用") and names.form_only("ds76%") and not names.form_only("アクテムラ")


def test_nfkc_in_stretches(spark, monkeypatch):
    """Python holds a stretch of a batch's texts at a time; long and null texts are whole."""
    import unicodedata

    import pyarrow as pa

    from docweave.functions import text

    rows = [None, "ﾊﾟ" * 3, "", "Ｘ" * 900_000, *(["①½ﬁ"] * 500), None, "é" * 700_000]
    held = [x.to_pylist() for x in text.slices(pa.array(rows))]
    assert sum(held, []) == rows and 2 < len(held) < 10 and [] not in held
    assert all(len(x) == 1 or sum(len((t or "").encode()) for t in x) <= text.SLICE for x in held)
    got = spark.createDataFrame(list(enumerate(rows)), "i int, t string").coalesce(1).select("i", text.nfkc("t").alias("t")).collect()
    assert {r.i: r.t for r in got} == {i: None if t is None else unicodedata.normalize("NFKC", t) for i, t in enumerate(rows)}
    assert spark.createDataFrame([], "t string").select(text.nfkc("t")).count() == 0
