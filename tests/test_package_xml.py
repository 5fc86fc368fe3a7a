import pytest

from docweave.operators.classify import FORBIDDEN, OTHER, OWN, STOP, THEMES, classified
from docweave.sources import package_xml as px

DOC = """<?xml version="1.0" encoding="UTF-8"?>
<PackIns xmlns="http://info.pmda.go.jp/namespace/prescription_drugs/package_insert/1.0">
<PackageInsertNo> 1110000A1011_1_02 </PackageInsertNo><CompanyIdentifier>123456</CompanyIdentifier>
<DateOfPreparationOrRevision><PreparationOrRevision id="今回"><YearMonth>2026-06</YearMonth><Version><Lang>第2版</Lang></Version></PreparationOrRevision></DateOfPreparationOrRevision>
<TherapeuticClassification><Detail><Lang>分類</Lang></Detail></TherapeuticClassification>
<GenericName><Detail><Lang>一般</Lang></Detail></GenericName>
<ApprovalEtc><DetailBrandName id="B1"><ApprovalBrandName><Lang>甲錠</Lang></ApprovalBrandName><BrandCode><YJCode>1110000a1011</YJCode></BrandCode></DetailBrandName>
<DetailBrandName id="B2"><ApprovalBrandName><Lang>乙錠</Lang></ApprovalBrandName></DetailBrandName></ApprovalEtc>
<!--2. 禁忌--><ContraIndications><Item><Detail><Lang>手術を予定している患者</Lang></Detail></Item></ContraIndications>
<!--8. 重要な基本的注意--><ImportantPrecautions modified="今回"><Item><Header><Lang>見出<?enter?>し</Lang></Header><Detail><Lang>手術前は投与を中止すること。別の文。</Lang><Lang modified="今回"></Lang></Detail></Item>
<Item><Detail><Lang>手術後の患者</Lang></Detail></Item></ImportantPrecautions>
<UseInSpecificPopulations><Item><Header><Lang>手術中の患者</Lang></Header><Detail><Lang>観察する。</Lang></Detail></Item></UseInSpecificPopulations>
<Interactions><PrecautionsForCombinations><Drug><DrugName><Lang>造影剤</Lang></DrugName><ClinSymptomsAndMeasures><Lang>一時休薬する。</Lang></ClinSymptomsAndMeasures><MechanismAndRiskFactors><Lang>機序</Lang></MechanismAndRiskFactors></Drug></PrecautionsForCombinations></Interactions>
<CompositionAndProperty><Property><PropertyForBrand ref="B1"><PropertyTable><IdCode><Lang>DK 505</Lang></IdCode>
<Shape><ShapeFront><InlineGraphic gfname="f.gif"/></ShapeFront><ShapeBack><InlineGraphic gfname="b.gif"/></ShapeBack><ShapeSide><InlineGraphic gfname="s.gif"/></ShapeSide></Shape>
<OtherProperty><CategoryName><Lang>本体表示</Lang></CategoryName><Content><Lang>505</Lang><InlineGraphic gfname="c.gif"/></Content></OtherProperty></PropertyTable></PropertyForBrand></Property></CompositionAndProperty>
<AdverseEvents><SeriousAdverseEvents><Instructions><Lang>いずれも頻度不明</Lang></Instructions><Item><Header><Lang>劇症肝炎（頻度不明）、肝機能障害、黄疸（0.1%未満）</Lang></Header></Item><Item><Header><Lang>発疹</Lang></Header></Item></SeriousAdverseEvents>
<OtherAdverseEvent><Instructions><Lang>〈効能〉</Lang></Instructions><OtherAdverse><Category id="C1"><Lang>皮膚</Lang></Category><Frequency id="F1"><Lang>0.1%〜5％未満<Sup>注1）</Sup></Lang></Frequency>
<AdverseReactionDescription categoryRef="C1" frequencyRef="F1"><Lang>痒み</Lang></AdverseReactionDescription></OtherAdverse></OtherAdverseEvent><OtherAdverseEvent><Lang>表の外</Lang></OtherAdverseEvent></AdverseEvents>
<EfficacyPharmacology><MechanismOfAction><Detail><Lang><ApprovalBrandNameRef ref="B1"/>は阻害する<HeaderRef/>, 。</Lang></Detail></MechanismOfAction>
<OtherInformation><Header><Lang>薬理</Lang></Header><OrderedList><Item><Header><Lang>作用</Lang></Header><Detail><Lang>文</Lang></Detail></Item><Item><Detail><Lang>無題</Lang></Detail></Item></OrderedList>
<TblBlock><TblCaption><Lang>表</Lang></TblCaption><SimpleTable><SimpTblRow><SimpTblCell><Lang>a</Lang></SimpTblCell><SimpTblCell><Lang>b</Lang></SimpTblCell></SimpTblRow></SimpleTable></TblBlock><Graphic/></OtherInformation></EfficacyPharmacology>
</PackIns>"""


@pytest.fixture(scope="module")
def root():
    return px.parse(DOC)


def test_lines_and_revisions(root):
    walk = px.Walk().visit(root)
    assert (("8. 重要な基本的注意", "見出\nし"), "手術前は投与を中止すること。別の文。") in walk.lines
    assert (("2. 禁忌", "(1)"), "手術を予定している患者") in walk.lines
    assert [p for p, _ in walk.revised] == [("8. 重要な基本的注意",)]  # the marked text inside is part of it
    assert walk.revised[0][1].splitlines()[-1] == "手術後の患者"


def test_marked_empty_text_is_a_revision():
    walk = px.Walk().visit(px.parse(f'<R xmlns="{px.NS[1:-1]}"><D><Lang modified="今回"></Lang></D></R>'))
    assert walk.revised == [((), "")] and not walk.lines


def test_meta_and_products(root):
    m = px.meta(root)
    assert (m["packins_no"], m["company_id"], m["brands"], m["generic_name"]) == ("1110000A1011_1_02", "123456", ["甲錠", "乙錠"], "一般")
    assert m["current"] == {"ym": "2026-06", "ver": "第2版"} and m["previous"] is None
    assert px.products(root) == [("甲錠", "1110000A1011"), ("乙錠", "")]


def test_adverse_events(root):
    found = px.adverse_events(root)
    assert found["r"] == [
        ("頻度不明", px.SERIOUS, "劇症肝炎", ""),
        ("0.1%未満", px.SERIOUS, "肝機能障害、黄疸", ""),
        ("頻度不明", px.SERIOUS, "発疹", ""),
        ("0.1～5%未満", "皮膚", "痒み", "〈効能〉"),
    ]
    assert found["x"] == "表の外"
    assert px.adverse_events(px.parse("<a/>")) is None


def test_blocks(root):
    assert [b[:3] for b in px.pharmacology(root)] == [
        ("h", 1, "18.1 作用機序"),
        ("p", None, "甲錠は阻害する。"),
        ("h", 1, "18.2 薬理"),
        ("h", 2, "18.2.1 作用"),
        ("p", None, "文"),
        ("p", None, "無題"),
        ("t", None, "表"),
        ("g", None, ""),
    ]
    assert px.pharmacology(root)[6][3] == [["a", "b"]]


def test_imprints(root):
    found = px.Imprints(root)
    assert list(found.codes) == [("DK 505", "甲錠", None), ("505", "甲錠", "本体表示")]
    assert found.shapes == [(["f.gif", "b.gif"], "甲錠")] and found.images == [("c.gif", "甲錠")]


def test_tables_and_classification(spark):
    docs = spark.createDataFrame([("123456_1110000A1011_1_02", DOC), ("123456_9990000A1011_1_02", DOC), ("bad", "<x")], "u string, xml string")
    cands = px.candidate_table(docs)
    assert cands.where("error IS NOT NULL").count() == 1
    rows = {(r.u[7:10], r.ch, r.k) for r in classified(cands.where("theme = 'shujutsu'"), THEMES["shujutsu"]).collect()}
    assert ("999", "ContraIndications", FORBIDDEN) in rows and ("999", "ImportantPrecautions", STOP) in rows and ("999", "UseInSpecificPopulations", OTHER) in rows
    assert ("111", "UseInSpecificPopulations", OTHER) not in rows  # an anaesthetic itself
    heading = cands.where("ch = 'UseInSpecificPopulations' AND u LIKE '%999%' AND theme = 'shujutsu'").first()
    assert heading.t == "手術中の患者" and heading.b == "観察する。" or heading.t == "手術中の患者"
    contrast = classified(cands.where("theme = 'zouei' AND u LIKE '%999%'"), THEMES["zouei"]).collect()
    assert [(r.k, r.p, r.s) for r in contrast] == [(STOP, "併用注意 › 併用薬: 造影剤", ["一時休薬する。"])]
    own = DOC.replace("<Lang>分類</Lang>", "<Lang>Ｘ線造影剤</Lang>")
    mine = px.candidate_table(spark.createDataFrame([("123456_7210000A1011_1_01", own)], "u string, xml string"))
    assert [r.k for r in classified(mine.where("theme = 'zouei'"), THEMES["zouei"]).collect()] == [OWN]
    assert px.line_table(docs).where("revised").count() == 2
    assert px.block_table(docs).where("kind = 'h'").count() == 6
    assert px.adverse_event_table(docs).where("present").count() == 10
    assert px.product_table(docs).where("code <> ''").count() == 2
    assert px.imprint_table(docs).where("kind = 'code'").count() == 4
    assert px.meta_table(docs).where("company_id = '123456'").count() == 2
