"""Lines, meta data and products by joins of node rows, against a plain walk of each document."""

import random

import pytest

from docweave.sources import package_nodes as pn
from docweave.sources import package_xml as px
from tests.test_package_xml import DOC

NAMES = ["Item", "Detail", "Header", "Lang", "Warnings", "Detail", "Lang", "ApprovalEtc", "DetailBrandName", "ApprovalBrandName", "YJCode", "GenericName", "PackageInsertNo", "Sup", "DateOfPreparationOrRevision", "PreparationOrRevision", "YearMonth"]


def made(rng, depth=0):
    """A random element, with comments, breaks, marks, languages and text between them."""
    out = []
    for _ in range(rng.randint(0, 4 if depth else 7)):
        kind = rng.random()
        if kind < 0.15:
            out.append(rng.choice(["<!--title-->", "<!-- -->", "<?enter?>", "<?other?>"]))
        elif kind < 0.45:
            out.append(rng.choice(["word ", " \n ", "a\tb", "\n\n\nline", "é"]))
        elif depth < 6:
            name = rng.choice(NAMES)
            attributes = rng.choice(["", "", ' modified="今回"', ' xml:lang="en"', ' xml:lang="ja"', ' id="B1"', ' id="今回"', ' id="前回"', ' id=""'])
            out.append(f"<{name}{attributes}>{made(rng, depth + 1)}</{name}>")
    return "".join(out)


@pytest.fixture(scope="module")
def documents():
    rng = random.Random(11)
    docs = [("doc", DOC), ("bad", "<x>"), ("none", None), ("plain", f'<R xmlns="{px.NS[1:-1]}"><D><Lang modified="今回"></Lang></D></R>')]
    return docs + [(f"r{i}", f'<PackIns xmlns="{px.NS[1:-1]}">{made(rng)}</PackIns>') for i in range(250)]


def plain(documents, extract):
    out = []
    for u, xml in documents:
        try:
            out += [(u, *row) for row in extract(px.parse(xml))]
        except Exception:  # noqa: BLE001
            out.append((u, "error"))
    return sorted(map(repr, out))


def told(rows, *columns):
    return sorted(repr((r.u, "error") if r.error else (r.u, *(tuple(r[c]) if isinstance(r[c], list) else r[c] for c in columns))) for r in rows)


def test_lines(spark, documents):
    def walk(root):
        w = px.Walk().visit(root)
        return [(kind, i, path, text) for kind, rows in ((False, w.lines), (True, w.revised)) for i, (path, text) in enumerate(rows)]

    got = pn.line_table(spark.createDataFrame(documents, "u string, xml string").repartition(3)).collect()
    assert told(got, "revised", "pos", "path", "text") == plain(documents, walk) and sum(r.revised or False for r in got) > 50


def test_meta(spark, documents):
    def rows(root):
        m = px.meta(root)
        pair = lambda v: None if v is None else (v["ym"], v["ver"])
        return [(m["packins_no"], m["company_id"], pair(m["current"]), pair(m["previous"]), tuple(m["brands"]), m["generic_name"], m["therapeutic_class"])]

    got = pn.meta_table(spark.createDataFrame(documents, "u string, xml string").repartition(3)).collect()
    shown = [repr((r.u, "error") if r.error else (r.u, r.packins_no, r.company_id, r.current and tuple(r.current), r.previous and tuple(r.previous), tuple(r.brands), r.generic_name, r.therapeutic_class)) for r in got]
    assert sorted(shown) == plain(documents, rows)


def test_products(spark, documents):
    got = pn.product_table(spark.createDataFrame(documents, "u string, xml string").repartition(3)).collect()
    assert told(got, "pos", "brand", "code") == sorted(plain(documents, lambda root: [(i, *p) for i, p in enumerate(px.products(root))])) and len(got) > 5


def test_no_documents(spark):
    none = spark.createDataFrame([], "u string, xml string")
    assert pn.line_table(none).count() == pn.meta_table(none).count() == pn.product_table(none).count() == 0


def test_meta_and_products_are_one_shuffle(spark, documents):
    """a document's rows meet once; names of a brand that is in another's name are its own."""
    docs = spark.createDataFrame(documents, "u string, xml string")
    for table in (pn.meta_table(docs), pn.product_table(docs)):
        plan = table._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    inside = "<DetailBrandName id='B1'><ApprovalBrandName><Lang>one</Lang><DetailBrandName id='B2'><Lang>two</Lang></DetailBrandName></ApprovalBrandName></DetailBrandName>"
    own = [("in", f'<R xmlns="{px.NS[1:-1]}">{inside}</R>'), ("bad", "<x>"), ("bad", "<x>")]
    assert told(pn.product_table(spark.createDataFrame(own, "u string, xml string")).collect(), "pos", "brand", "code") == sorted(plain(own, lambda root: [(i, *p) for i, p in enumerate(px.products(root))]))


def test_only_kept_elements_get_their_path(documents):
    """the walk keeps one path, and copies it for rows alone."""
    seen = []
    rows = pn.rows_of("u", px.parse(DOC), lambda tags: seen.append(tags) or tags[-1] == "Lang")
    assert len(seen) > 10 and all(t is seen[0] for t in seen) and not seen[0]
    kept = [r for r in rows if r[3]]
    assert kept and all(r[14][-1] == "Lang" and len(r[13]) == len(r[14]) == r[3] and r[13][-1] == r[1] for r in kept)


def test_parts_are_spread(spark):
    """documents made of a file that is one task go to all tasks."""
    from pyspark.sql import functions as F

    from docweave.plans.documents import parts_as_documents

    docs = parts_as_documents(spark, "/root/testdata/sf0.01")
    assert docs.select(F.spark_partition_id()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
