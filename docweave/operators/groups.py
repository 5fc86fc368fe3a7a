"""Groupings that pages are made of: bands, generics with their hits, cleaned codes, image records.

Groups are one document's or one generic's rows; everything that is ordered inside them is an
array of structs, built by combinable aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions import bands
from docweave.functions.keys import product_code

#: The category that comes first in a band, code cells that only name a place, the class of no code, a long text.
SERIOUS = "重大な副作用"
PLACES = ("表", "裏", "側面", "上面", "下面", "本体", "PTP", "キャップ", "ボディ")
NO_CLASS, OPEN_TEXT = "9999", 1500


def band_groups(rows: DataFrame, key: str, pos: str | Column, band: str = "band", category: str = "category", columns: tuple[str, ...] = ("category", "text", "label"), first: str = SERIOUS) -> DataFrame:
    """A10: (key, groups): bands from the highest to the lowest with level and rows, rows of the first category before others.

    Bands of one order stay as they were first seen, rows in order of pos.
    """
    own = rows.withColumn("__pos", F.col(pos) if isinstance(pos, str) else pos).repartition(key)  # once for both groupings
    line = F.struct((F.col(category) != first).alias("later"), F.col("__pos").alias("pos"), *columns)
    grouped = own.groupBy(key, band).agg(F.array_sort(F.collect_list(line)).alias("lines"), F.min("__pos").alias("seen"))
    bound = bands.bounds(F.col(band))
    order = bands.order_key(bound)
    lines = F.transform("lines", lambda x: F.struct(*[x.getField(c).alias(c) for c in columns]))
    entry = F.struct((-order.getField("reach")).alias("reach"), (-order.getField("lo")).alias("lo"), "seen", F.col(band).alias("band"), bands.level(bound).alias("level"), lines.alias("rows"))
    shown = lambda e: F.struct(e.getField("band").alias("band"), e.getField("level").alias("level"), e.getField("rows").alias("rows"))
    return grouped.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(entry)), shown).alias("groups"))


def generic_name(generic: Column, brand: Column, code: Column) -> Column:
    """Without the hydrate at its end; the brand, then the code, where there is none."""
    bare = F.regexp_replace(F.trim(F.coalesce(generic, F.lit(""))), "水和物$", "")
    return F.coalesce(F.nullif(bare, F.lit("")), F.nullif(brand, F.lit("")), code)


def generic_groups(catalog: DataFrame, store: DataFrame, hits: DataFrame) -> DataFrame:
    """(name, cls, y, k, brands, hits, n_hits) of every generic that has a document with hits.

    catalog (pos, g, n, f: array of u), every document of an item counts; store (u, cls); hits (u, hit, k, ch, t).
    cls is the most frequent class, of ties the first seen; y the least class code; k the least tier;
    brands have their first document; hits are by tier and chapter, then in the order met.
    """
    opened = catalog.select("pos", "g", "n", F.posexplode("f").alias("nth", "u"))
    documents = opened.join(store, "u").join(hits.select("u").distinct(), "u", "left_semi")
    documents = documents.withColumn("name", generic_name(F.col("g"), F.col("n"), F.col("u"))).withColumn("at", F.struct("pos", "nth")).repartition("name")
    coded = F.substring(product_code(F.col("u")), 1, 4)
    # one aggregate of a generic's documents: its class codes, and for each class and brand how often and where it is met first
    one = documents.groupBy("name", F.coalesce("cls", F.lit("")).alias("cls"), F.coalesce("n", F.lit("")).alias("n")).agg(
        F.min(F.coalesce(F.nullif(coded, F.lit("")), F.lit(NO_CLASS))).alias("y"), F.count("*").alias("times"), F.min(F.struct("at", "u")).alias("first")
    )
    item = F.struct("cls", "n", "times", "first")
    of = one.groupBy("name").agg(F.min("y").alias("y"), F.collect_list(item).alias("items"))
    classes = F.array_distinct(F.transform(F.filter("items", lambda i: i.getField("cls") != ""), lambda i: i.getField("cls")))
    same = lambda c: F.filter("items", lambda i: i.getField("cls") == c)
    counted = F.transform(classes, lambda c: F.struct((-F.aggregate(same(c), F.lit(0).cast("long"), lambda s, i: s + i.getField("times"))).alias("n"), F.array_min(F.transform(same(c), lambda i: i.getField("first").getField("at"))).alias("at"), c.alias("cls")))
    cls = F.regexp_replace(F.element_at(F.split(F.array_min(counted).getField("cls"), r"\n| / "), 1), "^[ \\-－‐]+|[ \\-－‐]+$", "")
    brand = F.array_sort(F.transform("items", lambda i: F.struct(i.getField("n").alias("n"), i.getField("first").alias("first"))))
    firsts = F.filter(brand, lambda b, k: (k == 0) | (F.get(brand, k - 1).getField("n") != b.getField("n")))
    brands = F.transform(firsts, lambda b: F.struct(b.getField("n").alias("n"), b.getField("first").getField("u").alias("u")))
    heads = of.select("name", F.coalesce(cls, F.lit("")).alias("cls"), "y", brands.alias("brands"))
    met = documents.select("name", "u", "at", "n").join(hits, "u")
    entry = F.struct("k", "ch", "at", "hit", "u", "n", "t")
    listed = met.groupBy("name").agg(F.min("k").alias("k"), F.array_sort(F.collect_list(entry)).alias("hits"), F.count("*").alias("n_hits"))
    shown = F.transform("hits", lambda h: F.struct(*[h.getField(c).alias(c) for c in ("k", "ch", "u", "n", "t")]))
    return listed.join(heads, "name").select("name", "cls", "y", "k", "brands", shown.alias("hits"), "n_hits")


def first_of_pattern(left: DataFrame, left_key: str, right: DataFrame, right_key: str, pattern: str, order: str, value: str, into: str) -> DataFrame:
    """Every left row with the value of the first right row that holds the same key by a pattern; null without one."""
    key = lambda c: F.regexp_extract(c, pattern, 1)
    firsts = right.select(key(right_key).alias("__key"), F.col(value).alias(into), F.col(order).alias("__at")).where("__key <> ''")
    firsts = firsts.groupBy("__key").agg(F.min_by(into, "__at").alias(into))
    return left.withColumn("__key", key(left_key)).join(firsts, "__key", "left").drop("__key")


def cleaned_codes(codes: DataFrame, key: str, pos: str, code: str = "c", brand: str = "b", label: str = "l") -> DataFrame:
    """One row for each code and brand of a document, an unlabelled one before labelled ones, at the first one's place.

    Cells that only name a place are no codes; white space in labels goes. A place is the least pos of the equal ones.
    """
    own = codes.where(~F.coalesce(F.col(code), F.lit("")).isin(*PLACES)).withColumn(label, F.nullif(F.regexp_replace(F.col(label), r"(?U)\s", ""), F.lit("")))
    rest = [c for c in own.columns if c not in (key, code, brand)]
    best = own.groupBy(key, code, brand).agg(F.min_by(F.struct(*rest), F.struct(F.col(label).isNotNull(), F.col(pos))).alias("r"), F.min(pos).alias("place"))
    return best.select(key, code, brand, *[F.col(f"r.{c}").alias(c) for c in rest if c != pos], F.col("place").alias(pos))


def image_records(documents: DataFrame, stored: DataFrame, version: int) -> DataFrame:
    """(u, t, v, codes, sh, ic) of (u, t, codes, shapes: array of (b, g), idimgs: array of (g, b), failed).

    Images count only for documents with a code or an image of one, and where they are stored (u, name);
    where storing failed the codes are kept without a version, so that the document stays stale.
    """
    there = stored.groupBy("u").agg(F.collect_set("name").alias("__there"))
    own = documents.join(there, "u", "left").withColumn("__there", F.coalesce("__there", F.array().cast("array<string>")))
    wanted = ((F.size("codes") > 0) | (F.size("idimgs") > 0)) & ~F.col("failed")
    held = lambda g: F.array_contains("__there", g)
    shapes = F.filter(F.transform("shapes", lambda s: F.struct(s.getField("b").alias("b"), F.filter(s.getField("g"), held).alias("g"))), lambda s: F.size(s.getField("g")) > 0)
    images = F.filter("idimgs", lambda d: held(d.getField("g")))
    some = lambda a: F.when(wanted & (F.size(a) > 0), a)
    return own.select("u", "t", F.when(~F.col("failed"), version).alias("v"), "codes", some(shapes).alias("sh"), some(images).alias("ic"))


def blocks_length(blocks: Column) -> Column:
    """Characters of (kind, text, rows) blocks; headings count nothing, tables all their cells."""
    cells = lambda b: F.array_join(F.flatten(F.coalesce(b.getField("rows"), F.array().cast("array<array<string>>"))), "")
    length = lambda b: F.when(b.getField("kind") == "h", 0).when(b.getField("kind") == "t", F.length(cells(b))).otherwise(F.length(F.coalesce(b.getField("text"), F.lit(""))))
    return F.aggregate(blocks, F.lit(0), lambda n, b: n + length(b))


def is_long(blocks: Column, most: int = OPEN_TEXT) -> Column:
    return blocks_length(blocks) > most
