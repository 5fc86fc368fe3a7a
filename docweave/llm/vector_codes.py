"""Product codes of vectors, every part matched by an Exponion search.

Components become integers, vectors equal parts. In each round every part looks for the nearest
entry of its codebook: it starts at its entry of the round before, at squared distance u, and
scans that entry's neighbours, sorted by their distance from it, as far as 4u. By the triangle
inequality an entry beyond that is farther away than the start, so the nearest one is always
seen, and of equally near ones each, of which the lowest index is taken. All distances are exact
integers. A pass over the rows writes their codes for the next one; its sums go by numbers that
don't depend on the rows, one line from a task, and meet by addition. Only codebooks are sent to tasks:
parts * entries * width integers, all parameters or the vectors' width.

Defined results: rows whose vector is null or has null or non-finite components are left out. A null vec_id
is the largest one. Rows that repeat a vec_id are each coded; of their vectors the least, by components, opens the
codebooks. With fewer ids than entries the codebooks have as many entries as ids. Vectors that are shorter than the
longest one, or whose length isn't a multiple of the parts, are read as if zeros followed. Components too large for
squared distances in 64 bits (about 370,000 at 64 components) go by unbounded integers and a plain search, up to
2 ** 54, beyond which the job ends with an error; an error sum that a long can't hold is null. Equal labels are summed together, nulls too. An empty table gives no rows;
other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.storage import discard, materialise, materialise_counted

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows that are searched at once.
ROWS = 4096


def holds(array: np.ndarray, width: int) -> bool:
    """Whether four times the squared distance of vectors of such components is under 2 ** 63."""
    limit = isqrt((1 << 59) // max(width, 1))
    return max(abs(int(array.max(initial=0))), abs(int(array.min(initial=0)))) < limit


class Codebook:
    """The entries of one part with, for each, all entries by their distance from it."""

    def __init__(self, entries: np.ndarray, width: int):
        self.entries, self.small = entries, holds(entries, width)
        if not self.small:
            return
        apart = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.sorted = np.take_along_axis(apart, self.order, axis=1)

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(entry, squared distance) for each row of x, and how many distances were taken."""
        best = ((x - self.entries[start]) ** 2).sum(axis=1)
        found, radius = start.copy(), 4 * best
        reach = np.empty(len(x), np.int64)
        by_start = np.argsort(start, kind="stable")
        entry, first = np.unique(start[by_start], return_index=True)
        for e, rows in zip(entry.tolist(), np.split(by_start, first[1:]), strict=True):
            reach[rows] = np.searchsorted(self.sorted[e], radius[rows], "right")
        rows = np.argsort(-reach, kind="stable")  # those that scan on come first
        for nth in range(int(reach.max(initial=0))):
            rows = rows[: int(np.searchsorted(-reach[rows], -nth, "left"))]
            other = self.order[start[rows], nth]
            far = ((x[rows] - self.entries[other]) ** 2).sum(axis=1)
            closer = (far < best[rows]) | (far == best[rows]) & (other < found[rows])
            at = rows[closer]
            best[at], found[at] = far[closer], other[closer]
        return found, best, int(reach.sum())


def plain_nearest(entries: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same by all distances, for integers of any size."""
    far = ((x.astype(object)[:, None, :] - entries.astype(object)[None, :, :]) ** 2).sum(axis=2)
    found = np.array([min(range(len(row)), key=row.__getitem__) for row in far], np.int64)
    return found, far[np.arange(len(x)), found]


def scaled(column: pa.Array, width: int) -> np.ndarray:
    """The integers (rows, width) of a column of vectors."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.floor(np.asarray(column.flatten().cast(pa.float64())) * SCALE)
    if len(flat) and np.abs(flat).max() >= 1 << 62:
        raise ValueError("a component is too large to be coded")
    sizes = np.asarray(column.value_lengths().fill_null(0), np.int64)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat.astype(np.int64)
    return out


def assigned(q: np.ndarray, codes: np.ndarray | None, books: list[Codebook]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, error) of scaled vectors; codes are those of the round before, if there was one. error is of objects where integers are large."""
    parts, width = len(books), q.shape[1] // len(books)
    out, error = np.zeros((len(q), parts), np.uint8), np.zeros(len(q), np.int64)
    small = holds(q, q.shape[1])
    for p, book in enumerate(books):
        x = q[:, p * width : (p + 1) * width]
        if small and book.small:
            found, far, _ = book.nearest(x, np.zeros(len(q), np.int64) if codes is None else codes[:, p].astype(np.int64))
        else:
            found, far = plain_nearest(book.entries, x)
        out[:, p] = found
        error = error + far
    return out, error


def in_rows(array: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Each row of an array as a list."""
    n, width = array.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(array.ravel(), kind))


def as_matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), width)


def first_entries(rows: DataFrame, entries: int) -> np.ndarray:
    """The scaled vectors of the smallest ids, ascending. A task gives at most entries lines, each id once."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, list[int]] = {}  # (is null, id): its least vector
        for batch in batches:
            ids, none = np.asarray(batch.column(0).fill_null(0)), np.asarray(batch.column(0).is_null())
            smallest = np.unique(ids[~none])[:entries]
            able = ~none & (ids <= smallest[-1]) if len(smallest) else none & False
            if len(smallest) < entries:
                able |= none
            for i in np.flatnonzero(able).tolist():
                key, q = (bool(none[i]), int(ids[i])), batch.column(1)[i].as_py()
                kept[key] = min(kept.get(key, q), q)
            for key in sorted(kept)[entries:]:
                del kept[key]
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array([k[1] for k in kept], pa.int64()), pa.array([k[0] for k in kept]), pa.array(list(kept.values()), pa.list_(pa.int64()))], names=["id", "no_id", "q"])

    tasks = rows.select("vec_id", "q").mapInArrow(least, "id long, no_id boolean, q array<long>")
    ids = tasks.groupBy("no_id", "id").agg(F.min("q").alias("q")).orderBy("no_id", "id").limit(entries).collect()
    return np.array([r.q for r in ids], np.int64)


def pass_over(rows: DataFrame, books: list[np.ndarray], width: int, last: bool) -> DataFrame:
    """The rows with codes (and error, in the last pass), and besides from each task a line of sums and counts of every entry."""
    entries = len(books[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Codebook(b, width) for b in books]
        parts, wide = len(own), width // len(own)
        sums = np.zeros((parts, entries, wide + 1), object)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                n = batch.num_rows
                q = as_matrix(batch.column("q"), width)
                before = as_matrix(batch.column("codes"), parts) if "codes" in whole.schema.names else None
                codes, error = assigned(q, before, own)
                if not last:
                    for p in range(parts):
                        x = q[:, p * wide : (p + 1) * wide]
                        order = np.argsort(codes[:, p], kind="stable")
                        used, first = np.unique(codes[order, p], return_index=True)
                        # rows at once are few, so that sums of a batch hold in 64 bits; those of a task are unbounded
                        x = x[order] if np.abs(x).max(initial=0) < 1 << 48 else x[order].astype(object)
                        if wide:
                            sums[p, used, :wide] += np.add.reduceat(x, first, axis=0)
                        sums[p, used, wide] += np.diff(np.append(first, n))
                columns = [batch.column("vec_id"), batch.column("label"), batch.column("q") if not last else pa.nulls(n, pa.list_(pa.int64())), in_rows(codes.astype(np.int16), pa.int16())]
                fits = [int(e) if int(e) < 1 << 63 else None for e in error]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(fits, pa.int64()), pa.nulls(n, pa.list_(pa.string()))], names=names)
        if not last:
            told = [str(int(v)) for v in sums.ravel()]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.list_(pa.int16())), pa.nulls(1, pa.int64()), pa.array([told], pa.list_(pa.string()))], names=names)

    names = ["vec_id", "label", "q", "codes", "error", "sums"]
    return rows.mapInArrow(run, "vec_id long, label string, q array<long>, codes array<smallint>, error long, sums array<string>")


def moved(done: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks whose entries are the floors of their parts' means; entries without parts stay."""
    parts, entries, wide = len(books), *books[0].shape
    values = done.where("sums IS NOT NULL").select(F.posexplode("sums").alias("at", "value")).groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    flat = np.zeros(parts * entries * (wide + 1), object)
    for r in values.collect():  # parts * entries * (width + 1) lines
        flat[r.at] = int(r.value)
    sums = flat.reshape(parts, entries, wide + 1)
    out = []
    for book, of_part in zip(books, sums, strict=True):
        new = book.copy()
        for e in np.flatnonzero(of_part[:, wide] > 0):
            new[e] = [s // of_part[e, wide] for s in of_part[e, :wide]]
        out.append(new)
    return out


def codebooks_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


def scaled_rows(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int) -> tuple[DataFrame, int]:
    """The rows that are kept, as integers in a written table, and the width of all."""
    x = F.col(vector_col).cast("array<double>")
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), x.alias("v"))
    kept = kept.where(F.col("v").isNotNull() & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    longest = kept.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-longest // parts) * parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), in_rows(scaled(some.column(2), width), pa.int64())], names=["vec_id", "label", "q"])

    return kept.mapInArrow(run, "vec_id long, label string, q array<long>"), width


def encode_vectors(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, codes, error) of each row that is kept, in a written table; and the codebooks, one (entries, width) array for each part."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte")
    scaled_, width = scaled_rows(vectors, id_col, vector_col, label_col, parts)
    rows, told = materialise_counted(scaled_, "vectors")
    if not told.n:
        return rows.select("vec_id", "label", F.array().cast("array<smallint>").alias("codes"), F.lit(None).cast("long").alias("error")), []
    start = first_entries(rows, entries).reshape(-1, width)
    books = [start[:, p * width // parts : (p + 1) * width // parts] for p in range(parts)]
    for _ in range(rounds):
        done = materialise(pass_over(rows, books, width, False), "codes")
        books = moved(done, books)
        discard(rows)
        rows = done.where("sums IS NULL").select("vec_id", "label", "q", "codes")
    return materialise(pass_over(rows, books, width, True).select("vec_id", "label", "codes", "error"), "coded"), books


def vector_code_report(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each row that is kept."""
    coded, books = encode_vectors(vectors, **options)
    code = F.concat_ws("", F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c.cast("long")), 2, "0"))))
    own = coded.select("vec_id", code.alias("code"), "error", "label")
    # a line for each label; it is written, so that Spark knows its size when it plans the join, and splits a hot label where it shuffles
    sums = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("s"), F.count_if(F.col("error").isNull()).alias("lost"))
    sums = materialise(sums.select(F.col("label").alias("of_label"), F.when(F.col("lost") == 0, F.expr("try_cast(s AS long)")).alias("label_error")), "label-errors")
    joined = own.join(sums, F.col("label").eqNullSafe(F.col("of_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


def decode_codes(coded: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """The vectors (vec_id, q) that codes stand for, as scaled integers."""
    table = F.array(*[F.array(*[F.array(*[F.lit(int(v)) for v in entry]) for entry in book]) for book in books]) if books else F.array()
    parts = F.transform("codes", lambda c, p: F.element_at(F.element_at(table, p + 1), c.cast("int") + 1))
    return coded.select("vec_id", F.flatten(parts).alias("q"))
