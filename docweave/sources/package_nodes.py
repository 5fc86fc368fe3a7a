"""Package documents as rows: elements and pieces of text, of which lines, revisions, meta data and products are made by joins.

One pass of a document gives a row for each element, with its ancestors and their tags, what stands right before it and,
of elements whose text is asked for, the character data in it. What is said of documents then is
DataFrame work: paths are titles joined to ancestors, revisions are the topmost marked elements, and what an element is in is
told by its tags, so that meta data and products are one shuffle by document of the few rows that they are made of.
Groups are an element's ancestors or a document's rows, never more.

Defined results: a document that can't be read is one row with its error; a null document likewise.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.sources.package_xml import BEFORE, LANG, NOW, parse, tag
from docweave.sources.tables import written

#: Elements whose text is asked for as a whole.
TEXTS = ("Lang", "Header")
NODES = (
    "u string, node int, parent int, depth int, tag string, id string, lang string, marked boolean, marked_above boolean, in_lang boolean, "
    "comment string, item int, head string, above array<int>, tags array<string>, said string, error string"
)
#: Rows that leave together.
ROWS = 10_000
_NAMES = [c.strip().split()[0] for c in NODES.split(", ")]


def rows_of(u: str, root: ET.Element, keep: Callable[[list[str]], bool]) -> list[tuple]:
    """The root's row, and those of elements whose tags, from the outermost to its own, are to be kept."""
    count = 0
    out: list[list] = [[u, 0, None, 0, tag(root), *[None] * 8, [], [], None, None]]
    above: list[int] = []
    tags: list[str] = []

    def visit(node: ET.Element, me: int, marked: bool, in_lang: bool, holders: list[list[str]]) -> None:
        nonlocal count
        comment, items = None, 0
        if holders and node.text:
            put(holders, node.text)
        for child in node:
            if child.tag is ET.Comment:
                comment = (child.text or "").strip()
            elif child.tag is ET.PI:
                if holders and (child.text or "").strip().startswith("enter"):
                    put(holders, "\n")
            else:
                count += 1
                own, name = count, tag(child)
                items += name == "Item"
                new = child.get("modified") == NOW
                inner = holders
                above.append(own)
                tags.append(name)
                if keep(tags):
                    said: list[str] | None = [] if name in TEXTS else None
                    out.append([u, own, me, len(above), name, child.get("id"), child.get(LANG), new, marked, in_lang, comment, items if name == "Item" else None, child.text or "", above.copy(), tags.copy(), said, None])
                    inner = holders if said is None else [*holders, said]
                comment = None
                if len(child):
                    visit(child, own, marked or new, in_lang or name == "Lang", inner)
                elif inner and child.text:
                    put(inner, child.text)
                above.pop()
                tags.pop()
            if holders and child.tail:
                put(holders, child.tail)

    def put(holders: list[list[str]], text: str) -> None:
        for h in holders:
            h.append(text)

    visit(root, 0, False, False, [])
    at = _NAMES.index("said")
    return [(*r[:at], None if r[at] is None else "".join(r[at]), *r[at + 1 :]) for r in out]


def node_table(docs: DataFrame, key: str = "u", xml: str = "xml", keep: Callable[[list[str]], bool] = lambda tags: True) -> DataFrame:
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    types = [kinds[c.strip().split()[1]] for c in NODES.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for some in batches:
            for u, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                try:
                    held += rows_of(u, parse(text), keep)
                except Exception as e:  # noqa: BLE001  errors are data
                    held.append((u, *[None] * (len(_NAMES) - 2), f"{type(e).__name__}: {e}"))
                if len(held) >= ROWS:
                    yield batch(held)
                    held = []
        if held:
            yield batch(held)

    return docs.select(F.col(key).alias("u"), F.col(xml).alias("xml")).mapInArrow(run, NODES)


def ordered_text(said: Column) -> Column:
    """Character data with single spaces and no empty lines."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(said, "[ \\t]+", " "), r"(?U)\n\s*\n+", "\n"), r"(?U)^\s+|\s+$", "")


def texts(nodes: DataFrame) -> DataFrame:
    """(u, node, parent, tag, lang, above, in_lang, text) of every element of TEXTS."""
    own = nodes.where(F.col("tag").isin(*TEXTS) & (F.col("depth") > 0))
    return own.select("u", "node", "parent", "tag", "lang", "above", "in_lang", ordered_text(F.col("said")).alias("text"))


def titles(nodes: DataFrame, said: DataFrame) -> DataFrame:
    """(u, node, title) of elements that add to a path: the comment before one, else its header's text; items without either by number."""
    headers = said.where("tag = 'Header'").groupBy("u", F.col("parent").alias("node")).agg(F.min_by("text", "node").alias("header"))
    own = nodes.where("tag IS NOT NULL").select("u", "node", "tag", "comment", "item").join(headers, ["u", "node"], "left")
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    item = F.coalesce(some("comment"), some("header"), F.concat(F.lit("("), F.col("item").cast("string"), F.lit(")")))
    other = F.when(F.col("comment").isNotNull(), some("comment")).when(~F.col("tag").isin("Lang", "Detail", "Header"), some("header"))
    return own.select("u", "node", F.when(F.col("tag") == "Item", item).otherwise(other).alias("title")).where("title IS NOT NULL")


def with_paths(rows: DataFrame, titled: DataFrame) -> DataFrame:
    """Rows (u, node, above, ...) with the titles of their elements above and their own, from the outermost on."""
    opened = rows.select("u", "node", "above").dropDuplicates(["u", "node"]).select("u", "node", F.explode("above").alias("a"))
    found = opened.join(titled.select("u", F.col("node").alias("a"), "title"), ["u", "a"]).groupBy("u", "node").agg(F.array_sort(F.collect_list(F.struct("a", "title"))).alias("p"))
    path = F.coalesce(F.transform("p", lambda x: x.getField("title")), F.array().cast("array<string>"))
    return rows.join(found, ["u", "node"], "left").withColumn("path", path).drop("p")


def line_table(docs: DataFrame, key: str = "u", xml: str = "xml") -> DataFrame:
    """(u, revised, pos, path, text, error): texts under their headings, and what the present revision marks, once from the top."""
    nodes = written(node_table(docs, key, xml), "nodes")
    said = texts(nodes)
    titled = written(titles(nodes, said), "titles")
    langs = said.where("tag = 'Lang'")
    marks = nodes.where("tag IS NOT NULL AND marked AND NOT marked_above AND NOT in_lang").select("u", "node", "tag", "above")
    inside = langs.where("text <> ''").select("u", F.col("node").alias("n"), "text", F.explode("above").alias("node")).join(marks.where("tag <> 'Lang'").select("u", "node"), ["u", "node"])
    whole = inside.groupBy("u", "node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x.getField("text")), "\n").alias("text"))
    revised = marks.where("tag <> 'Lang'").join(whole, ["u", "node"], "left").select("u", "node", "above", F.coalesce("text", F.lit("")).alias("text"))
    revised = revised.unionByName(marks.where("tag = 'Lang'").join(langs.select("u", "node", "text"), ["u", "node"]).select("u", "node", "above", "text"))
    every = langs.where("text <> '' AND NOT in_lang").select("u", "node", "above", "text", F.lit(False).alias("revised")).unionByName(revised.withColumn("revised", F.lit(True)))
    place = F.row_number().over(Window.partitionBy("u", "revised").orderBy("node")) - 1  # a document's lines
    lines = with_paths(every, titled).select("u", "revised", place.cast("int").alias("pos"), "path", "text", F.lit(None).cast("string").alias("error"))
    return lines.unionByName(failed(nodes, lines))


def failed(nodes: DataFrame, like: DataFrame) -> DataFrame:
    """The documents that couldn't be read, in the columns of another table."""
    kinds = dict(like.dtypes)
    return nodes.where("error IS NOT NULL").select("u", *[F.lit(None).cast(kinds[c]).alias(c) for c in like.columns if c not in ("u", "error")], "error").select(*like.columns)


def in_tag(name: str) -> Column:
    """The elements of a tag that a row's element is in or is, from the outermost on: (o, k), k its place among those above."""
    at = F.transform("above", lambda o, k: F.struct(o.alias("o"), k.alias("k"), F.get("tags", k).alias("tag")))
    return F.filter(at, lambda x: x.getField("tag") == name)


def told_once(rows: DataFrame) -> DataFrame:
    """One row of each document, as many as there are of one that couldn't be read; n is its rows."""
    return rows.withColumn("n", F.explode(F.array_repeat(F.col("n"), F.when(F.col("error").isNotNull(), F.col("n")).otherwise(1).cast("int")))).drop("n")


_META = ("PackageInsertNo", "CompanyIdentifier", "GenericName", "TherapeuticClassification")


def of_meta(tags: list[str]) -> bool:
    """Elements that meta data are made of."""
    top, name = tags[0], tags[-1]
    if len(tags) == 1:
        return name in _META
    if top == "ApprovalEtc":
        return name == "Lang" and "ApprovalBrandName" in tags
    if top == "DateOfPreparationOrRevision":
        return tags[1] == "PreparationOrRevision" and (len(tags) == 2 or name in ("YearMonth", "Lang"))
    return top in ("GenericName", "TherapeuticClassification") and name == "Lang"


def meta_table(docs: DataFrame, key: str = "u", xml: str = "xml") -> DataFrame:
    """(u, packins_no, company_id, current, previous, brands, generic_name, therapeutic_class, error)."""
    nodes = node_table(docs, key, xml, of_meta).withColumn("text", ordered_text(F.col("said")))
    bare = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    tag, node, depth, top, outer = F.col("tag"), F.col("node"), F.col("depth"), F.get("tags", F.lit(0)), F.get("above", F.lit(0))
    at = lambda of: F.max(F.when(of, node))
    last = lambda of, value: F.max_by(F.when(of, value), F.when(of, node))
    every = lambda of, *values: F.collect_list(F.when(of, F.struct(*values)))
    own = lambda name: (depth == 1) & (tag == name)
    spoken = (tag == "Lang") & (F.col("text") != "")
    dated = lambda which: (depth == 2) & (top == "DateOfPreparationOrRevision") & (tag == "PreparationOrRevision") & (F.col("id") == which)
    inner = lambda name: (depth > 2) & (top == "DateOfPreparationOrRevision") & (tag == name)
    revision = F.get("above", F.lit(1))
    brands = F.transform(in_tag("ApprovalBrandName"), lambda x: F.struct(x.getField("o").alias("o"), node.alias("node"), F.col("text").alias("text")))
    parts = nodes.groupBy("u", "error").agg(
        F.count(F.lit(1)).alias("n"),
        last(own("PackageInsertNo"), bare(F.col("head"))).alias("packins_no"),
        last(own("CompanyIdentifier"), bare(F.col("head"))).alias("company_id"),
        *[at(own(name)).alias(f"{name}_at") for name in ("GenericName", "TherapeuticClassification")],
        *[every(spoken & (top == name), node.alias("node"), "text", outer.alias("o")).alias(name) for name in ("GenericName", "TherapeuticClassification")],
        F.array_sort(F.flatten(F.collect_list(F.when(spoken & (top == "ApprovalEtc"), brands)))).alias("b"),
        at(dated(NOW)).alias("current_at"),
        at(dated(BEFORE)).alias("previous_at"),
        every(inner("YearMonth"), node.alias("node"), bare(F.col("head")).alias("head"), revision.alias("o")).alias("months"),
        every(inner("Lang"), node.alias("node"), bare(F.col("head")).alias("head"), revision.alias("o")).alias("versions"),
    )
    of = lambda c, where: F.filter(c, lambda x: x.getField("o") == F.col(where))
    said = lambda name: F.when(F.col(f"{name}_at").isNotNull(), F.array_join(F.transform(F.array_sort(of(name, f"{name}_at")), lambda x: x.getField("text")), " / "))
    version = lambda where: F.when(F.col(where).isNotNull(), F.struct(F.array_max(of("months", where)).getField("head").alias("ym"), F.array_min(of("versions", where)).getField("head").alias("ver")))
    read = F.col("error").isNull()
    return told_once(parts).select(
        "u", "packins_no", "company_id", version("current_at").alias("current"), version("previous_at").alias("previous"),
        F.when(read, F.transform("b", lambda x: x.getField("text"))).alias("brands"), said("GenericName").alias("generic_name"), said("TherapeuticClassification").alias("therapeutic_class"), "error",
    )


def of_products(tags: list[str]) -> bool:
    """Elements that products are made of."""
    name = tags[-1]
    if name == "Lang":
        return "DetailBrandName" in tags and "ApprovalBrandName" in tags
    return name == "DetailBrandName" or name == "YJCode" and "DetailBrandName" in tags


def product_table(docs: DataFrame, key: str = "u", xml: str = "xml") -> DataFrame:
    """(u, pos, brand, code, error): distinct pairs of a document in order, of brands that have an id."""
    nodes = node_table(docs, key, xml, of_products).where("depth > 0 OR error IS NOT NULL").withColumn("text", ordered_text(F.col("said")))
    tag, node = F.col("tag"), F.col("node")
    japanese = (tag == "Lang") & (F.col("text") != "") & (F.col("lang").isNull() | (F.col("lang") == "ja"))
    # the last element of that tag above is in the brand, if any is
    inmost = F.element_at(in_tag("ApprovalBrandName"), -1).getField("k")
    details = in_tag("DetailBrandName")
    outers = F.when(japanese, F.filter(details, lambda x: x.getField("k") < inmost)).when(tag == "YJCode", details).when(F.col("id") != "", F.array(F.element_at(details, -1)))
    # all that follows is by document, in the same partitions
    rows = nodes.select("u", "error", "tag", "node", "text", "head", F.explode_outer(F.when(F.col("error").isNull(), F.transform(outers, lambda x: x.getField("o")))).alias("o")).where("o IS NOT NULL OR error IS NOT NULL").repartition("u")
    first = lambda name, value: F.min_by(F.when(tag == name, F.col(value)), F.when(tag == name, node))
    brands = rows.groupBy("u", "error", "o").agg(F.count(F.lit(1)).alias("n"), F.max(tag == "DetailBrandName").alias("is_brand"), first("Lang", "text").alias("brand"), first("YJCode", "head").alias("code"))
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    read = F.col("error").isNull()
    pairs = brands.where(~read | F.col("is_brand")).select("u", "error", "n", "o", F.when(read, bare(F.regexp_replace("brand", r"(?U)\s*\n\s*", " "))).alias("brand"), F.when(read, F.upper(bare(F.col("code")))).alias("code"))
    kept = pairs.where("error IS NOT NULL OR brand <> '' OR code <> ''").groupBy("u", "error", "brand", "code").agg(F.min("o").alias("o"), F.first("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("u", "error").orderBy("o")) - 1
    return told_once(kept.withColumn("pos", F.when(read, place.cast("int")))).select("u", "pos", "brand", "code", "error")
