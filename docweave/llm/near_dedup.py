"""MinHash near-dedup by a multi-index Hamming join.

A text's signature has 60 symbols of 16 bits, in 12 chunks. By the pigeonhole principle two
signatures that differ in at most 23 symbols have a chunk in which at most one differs; so every
chunk is entered under the keys of each choice of one allowed error, and all pairs under the
distance meet in a bucket. (At a similarity of 0.75 a pair meets but for 6 in a million; pairs
that meet and differ in over FARTHEST symbols, for which it's 1 in 10 million, are let go.)

Texts of equal shingle sets are one class, of which only the smallest id goes on. Pairs are never
listed. Every member has a home, the fullest bucket around it, and homes are cut into tiles of
bounded rows and bytes. Two tiles that share a bucket are compared as two blocks: signatures by
distance, then full sets, links only where they join what is apart so far. First each tile meets
itself and one pivot tile of each bucket, which is work in proportion to the members and leaves
of a large group one component and some outsiders. Then tiles are cut anew, with outsiders apart, and
those pairs of tiles meet that share a bucket and aren't all of one component. Nothing that shares
a bucket is left out.

Defined results: null text has no words; texts without words, and null ids, are linked with
nothing; texts of fewer than five words are one shingle; rows that repeat an id are one node;
texts of any length are compared whole; other columns, whatever their names, are not looked at;
an empty table gives no rows. Shingles are compared by 64-bit hashes of their words' bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.columnar import blocks, mix
from docweave.llm.components import components
from docweave.llm.exact_dedup import tree_merge
from docweave.llm.shingles import SYMBOLS, bucket_keys, shingle_sets, signatures
from docweave.llm.storage import HEAVY, beside, free_name, materialise, materialise_counted, skew_join

#: Links: 100 * intersection >= SIMILARITY * union.
SIMILARITY = 75
#: Symbols in which signatures of a pair that is compared on full sets may differ.
FARTHEST = 34
#: Members and shingles of a tile (about, and a single text may have more), members of a lump, pairs of one tile that are dealt as one.
TILE, TILE_SHINGLES, LUMP, DEALT = 512, 1 << 20, 128, 64
#: Members up to which a bucket is joined in one part, whatever its share.
HOT = 1000


def profiles(texts: DataFrame) -> DataFrame:
    """(id, n_shingles, set_key, signature): a digest of the shingle set (null when empty) and the symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column(1)):
                sets = shingle_sets(data, offsets)
                symbols = [s.tobytes() for s in signatures(sets)]
                digests = [hashlib.blake2b(s.tobytes(), digest_size=24).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(symbols, pa.binary())], names=["id", "n_shingles", "set_key", "signature"])

    return texts.mapInArrow(run, "id long, n_shingles long, set_key binary, signature binary")


def symbols_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), SYMBOLS)


def keyed(leading: DataFrame, hot: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(id, size, bucket, part) of (id, n_shingles, signature): the keys of all chunks and allowed errors.

    hot has keys, sorted, that are dealt over several parts, and the number of their parts; others have part 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = bucket_keys(symbols_of(batch.column(2))).view(np.int64)
            ids, sizes = (np.repeat(batch.column(i).to_numpy(), keys.shape[1]) for i in (0, 1))
            keys = keys.ravel()
            part = np.zeros(len(keys), np.int32)
            if hot is not None and len(hot[0]):
                at = np.minimum(np.searchsorted(hot[0], keys), len(hot[0]) - 1)
                some = np.flatnonzero(hot[0][at] == keys)
                part[some] = mix(ids[some].view(np.uint64)) % hot[1][at[some]].astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sizes), pa.array(keys), pa.array(part)], names=["id", "size", "bucket", "part"])

    return leading.select("id", "n_shingles", "signature").mapInArrow(run, "id long, size long, bucket long, part int")


def in_parts(buckets: DataFrame) -> DataFrame:
    """A row for each part of a bucket."""
    return buckets.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))


def members_of(leading: DataFrame) -> DataFrame | None:
    """(bucket, part, parts, n, id, size) of the buckets that several texts are in; None if there are none.

    A bucket with more than one in HEAVY of all members is joined in parts.
    """
    full, seen = materialise_counted(keyed(leading).groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets", F.sum("n").alias("members"))
    if not seen.n:
        return None
    cut = full.withColumn("parts", F.ceil(F.col("n") / max(HOT, seen.members // HEAVY)).cast("int"))
    hot = cut.where("parts > 1").select("bucket", "parts").toArrow().sort_by("bucket")  # at most HEAVY for each key of a text
    found = keyed(leading, (np.asarray(hot.column("bucket")), np.asarray(hot.column("parts")))).join(in_parts(cut), ["bucket", "part"])
    return materialise(found.select("bucket", "part", "parts", "n", "id", "size"), "members")


def sets_of(texts: DataFrame) -> DataFrame:
    """(id, shingles, signature): the bytes of sorted 64-bit hashes, and the symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column(1)):
                sets = shingle_sets(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in signatures(sets)], pa.binary())], names=["id", "shingles", "signature"])

    return texts.mapInArrow(run, "id long, shingles binary, signature binary")


def linking(ids: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], symbols: np.ndarray, first_other: int, similarity: int = SIMILARITY) -> Iterator[tuple[int, int]]:
    """Links that join what is apart. Rows before first_other meet those from there on; all meet all if it's the end."""
    n = len(ids)
    itself = first_other == n
    sizes = np.fromiter(map(len, sets), np.int64, n)
    label = np.unique(roots, return_inverse=True)[1]
    codes: np.ndarray | None = None
    ends = np.concatenate(([0], np.cumsum(sizes)))
    for i in range(first_other):
        others = np.arange(i + 1 if itself else first_other, n)
        others = others[(label[others] != label[i]) & (100 * np.minimum(sizes[others], sizes[i]) >= similarity * np.maximum(sizes[others], sizes[i])) & (sizes[others] > 0)]
        others = others[(symbols[others] != symbols[i]).sum(axis=1) <= FARTHEST]
        if not len(others):
            continue
        if codes is None:
            codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
            own = np.zeros(len(codes), np.uint8)
        mine = codes[ends[i] : ends[i + 1]]
        own[mine] = 1
        theirs = np.concatenate([codes[ends[j] : ends[j + 1]] for j in others.tolist()])
        common = np.add.reduceat(own[theirs], np.concatenate(([0], np.cumsum(sizes[others])[:-1])), dtype=np.int64)
        own[mine] = 0
        for j in others[100 * common >= similarity * (sizes[i] + sizes[others] - common)].tolist():
            if label[j] != label[i]:
                yield int(ids[i]), int(ids[j])
                label[label == label[j]] = label[i]


def compared(pairs: DataFrame, tiles: DataFrame, sets: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """Links (a, b) between members of the pairs (x, y) of tiles (tile, id, root), x <= y. A pair is one group of rows, of the size of two tiles."""
    pairs = materialise(pairs, "pairs")  # it's read three times
    many = pairs.select(F.explode(F.array_distinct(F.array("x", "y"))).alias("tile")).groupBy("tile").agg(F.ceil(F.count("*") / DEALT).cast("int").alias("parts"))
    copies = tiles.join(many, "tile").select("tile", "id", "root", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    sides = pairs.select("x", "y", F.posexplode(F.when(F.col("x") == F.col("y"), F.array("x")).otherwise(F.array("x", "y"))).alias("side", "tile"))
    sides = sides.join(many, "tile").withColumn("part", F.pmod(F.xxhash64("x", "y"), F.col("parts")).cast("int"))
    rows = sides.join(copies, ["tile", "part"]).select("x", "y", "side", "id", "root").join(sets, "id")
    rows = rows.repartition("x", "y").sortWithinPartitions("x", "y", "side").select("x", "y", "side", "id", "root", "shingles", "signature")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def links() -> Iterator[tuple[int, int]]:
            group = pa.concat_tables(held).combine_chunks()
            sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
            other = int(np.count_nonzero(np.asarray(group.column("side")) == 0))
            yield from linking(np.asarray(group.column("id")), np.asarray(group.column("root")), sets, symbols_of(group.column("signature")), other, similarity)

        def as_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
            a, b = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        last = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            x, y = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            cut = np.flatnonzero((x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
            found: list[tuple[int, int]] = []
            for start, end in zip([0, *cut.tolist()], [*cut.tolist(), len(x)], strict=True):
                if end == start:
                    continue
                now = (x[start], y[start])
                if held and now != last:
                    found += links()
                    held.clear()
                held.append(table.slice(start, end - start))
                last = now
            yield as_batch(found)
        if held:
            yield as_batch(list(links()))

    return rows.mapInArrow(run, "a long, b long")


def homes_of(members: DataFrame) -> tuple[DataFrame, int]:
    """(id, size, near, home) of members, and their number: the fullest bucket of each, and the fullest that is such for any member of its buckets.

    So the members of a large group, whatever buckets each is in, have one home, and few tiles.
    """
    near = materialise(members.groupBy("id").agg(F.max("size").alias("size"), F.max(F.struct("n", "bucket")).alias("near")), "homes")
    top = members.select("bucket", "parts", "id").join(near.select("id", "near"), "id").groupBy("bucket").agg(F.max("near").alias("top"), F.max("parts").alias("parts"))
    far = members.select("bucket", "part", "id").join(in_parts(top).drop("parts"), ["bucket", "part"]).groupBy("id").agg(F.max("top")["bucket"].alias("home"))
    homes, seen = materialise_counted(near.select("id", "size", F.col("near")["bucket"].alias("near")).join(far, "id"), "homes")
    return homes, seen.n


def tiled(homes: DataFrame, apart: list[str], total: int) -> DataFrame:
    """(id, root, tile) of the total homes (id, size, near, home, root): tiles of members of one home that agree in the columns apart.

    Members of one fullest bucket stay together in lumps, of which a tile has some.
    """
    counts = lambda name: {f"{name}_rows": F.count("*"), f"{name}_shingles": F.sum("size")}
    parts = lambda name, rows, shingles: F.ceil(F.greatest(F.col(f"{name}_rows") / rows, F.col(f"{name}_shingles") / shingles)).cast("int")
    cut = beside(homes, ["near", *apart], counts("near"), total)
    cut = beside(cut, ["home", *apart], counts("home"), total)
    lump = F.xxhash64("near", F.pmod(F.xxhash64("id"), parts("near", LUMP, TILE_SHINGLES * LUMP / TILE)))
    return cut.select("id", "root", F.xxhash64("home", *apart, F.pmod(lump, parts("home", TILE, TILE_SHINGLES))).alias("tile"))


def ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("x"), F.greatest(x, y).alias("y")]


def star_pairs(in_buckets: DataFrame) -> DataFrame:
    """Pairs of tiles of each bucket: each with itself, and with the one that has most of the bucket's members."""
    pivot = in_buckets.groupBy("bucket").agg(F.max(F.struct("n", "tile"))["tile"].alias("pivot"))
    met = in_buckets.join(pivot, "bucket")
    alone = met.where("n > 1").select(F.col("tile").alias("x"), F.col("tile").alias("y"))
    return met.where("tile <> pivot").select(*ordered("tile", "pivot")).unionByName(alone).distinct()


def open_pairs(in_buckets: DataFrame) -> DataFrame:
    """Pairs of tiles that share a bucket and aren't all of one root (low = high); none where both are the bucket's main root."""
    top = in_buckets.where("low = high").groupBy("bucket", "low").agg(F.sum("n").alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "low"))["low"].alias("top"))
    left = in_buckets.join(top, "bucket", "left").where("top IS NULL OR low <> top OR high <> top").select("bucket", F.col("tile").alias("t"), F.col("low").alias("l"), F.col("high").alias("h"))
    met = left.join(in_buckets, "bucket").where("least(l, low) <> greatest(h, high)")
    return met.select(*ordered("t", "tile")).distinct()


def linked_roots(texts: DataFrame, leading: DataFrame) -> DataFrame | None:
    """(id, root) of the leading texts that belong to a smaller one; None if no two are linked."""
    members = members_of(leading)
    if members is None:
        return None
    homes, total = homes_of(members)
    # texts are never gathered by broadcast ids, whose number grows with the table
    sets = materialise(sets_of(texts.join(homes.select("id").hint("shuffle_merge"), "id").select("id", "text")), "sets")

    tiles = materialise(tiled(homes.withColumn("root", F.col("id")), [], total), "tiles")
    in_buckets = members.select("bucket", "id").join(tiles, "id").groupBy("bucket", "tile").agg(F.count("*").alias("n"))
    in_buckets = materialise(in_buckets, "tiles-in-buckets")
    links, found = materialise_counted(compared(star_pairs(in_buckets), tiles, sets), "links")
    labels = components(links, found.n) if found.n else None

    rest, left = materialise_counted(in_buckets.groupBy("bucket").count().where("count > 2").select("bucket"), "open-buckets")
    if left.n:
        rooted = homes.withColumn("root", F.col("id")) if labels is None else homes.join(labels, "id", "left").withColumn("root", F.coalesce("root", "id"))
        rooted = beside(rooted, ["home", "root"], {"n": F.count("*")}, total)
        rooted = beside(rooted, ["home"], {"main": F.max(F.struct("n", "root"))}, total).withColumn("outside", F.col("root") != F.col("main")["root"])
        tiles = materialise(tiled(rooted.select("id", "size", "near", "home", "root", "outside"), ["outside"], total), "tiles")
        rows = members.select("bucket", "id").join(rest, "bucket", "left_semi").join(tiles, "id")
        in_buckets = rows.groupBy("bucket", "tile").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
        more, also = materialise_counted(compared(open_pairs(in_buckets), tiles, sets), "links")
        if also.n:
            labels = components(more if labels is None else more.unionByName(labels.select(F.col("id").alias("a"), F.col("root").alias("b"))), also.n + total)
    return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, n_shingles, component_id, kept."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    profile, seen = materialise_counted(profiles(texts), "profiles")
    valid = profile.where("set_key IS NOT NULL AND id IS NOT NULL")
    classes = tree_merge(valid.select("id", F.col("set_key").alias("key")), "min", name="set-runs").select(F.col("key").alias("set_key"), F.col("keep_id").alias("class_id"), "group_size")
    leading = valid.join(classes, (valid.set_key == classes.set_key) & (valid.id == classes.class_id), "left_semi")
    labels = linked_roots(texts, leading.select("id", "n_shingles", "signature"))
    if labels is not None:
        classes = classes.join(labels.select(F.col("id").alias("class_id"), "root"), "class_id", "left").withColumn("class_id", F.coalesce("root", "class_id"))
    found = materialise(classes.select("set_key", F.col("class_id").alias("component_id"), "group_size"), "classes")
    linked = skew_join(valid.select("id", "n_shingles", "set_key"), found, "set_key", F.col("group_size"), seen.n).select("id", "n_shingles", "component_id")
    alone = profile.where("set_key IS NULL OR id IS NULL").select("id", "n_shingles", F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of which each component keeps the one with the smallest id, with all their columns."""
    own = free_name(docs, "lost")
    lost = near_duplicates(docs, id_col, text_col).where("NOT kept").select(F.col(id_col).cast("long").alias(own)).distinct()
    return docs.join(lost, F.col(id_col).cast("long") == F.col(own), "left_anti")
