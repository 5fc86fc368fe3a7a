"""Fill-in-the-middle by a matcher in two passes that holds no units.

The units of a text are the matches of a pattern, lines by default. The first pass counts them;
the second advances one lazy iterator of matches to the lower and then to the higher of two ranks
that are drawn from a hash of the document's id, and takes the places where those matches end. So
a text needs its own memory and that of its output, however many units it has. Prefix, middle and suffix
go out in one of two orders behind marks; every place of a mark in an output is that of a true mark,
as texts with marks stay plain, so output and form give the text back.

Defined results: null text counts as empty and is plain; a null id is hashed like an empty one; rows that repeat
an id or a text are each transformed, those of one id and text alike; texts of any length go whole; one that
ends without a line end has its rest as the last unit; an empty table gives no rows; other columns,
whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.columnar import BLOCK

LINES = r"[^\n]*\n|[^\n]+"
#: Marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM = 7, 100, 50


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four numbers under 2 ** 32 of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    a, b, c, d = (int.from_bytes(digest[k : k + 4]) for k in range(0, 16, 4))
    return a, b, c, d


def counted(matches: Iterable) -> int:
    """How many there are; none is kept."""
    n = 0
    for _ in matches:
        n += 1
    return n


def cut_places(matches: Iterator[re.Match], low: int, high: int) -> tuple[int, int]:
    """Where the first low and the first high units end, by one iterator."""
    first = last = 0
    if low:
        first = next(islice(matches, low - 1, None)).end()
    last = first
    if high > low:
        last = next(islice(matches, high - low - 1, None)).end()
    return first, last


def transformed(text: str, doc_id: int | None, units: re.Pattern, marks: tuple[str, str, str], seed: int, rate: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of the prefix, of the middle, output)."""
    n = counted(units.finditer(text))
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not text or h3 % 100 >= rate or any(m in text for m in marks):
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = cut_places(units.finditer(text), low, high)
    p, s, m = marks
    if h4 % 100 < spm:
        return n, "spm", a, b - a, "".join((s, text[b:], p, text[:a], m, text[a:b]))
    return n, "psm", a, b - a, "".join((p, text[:a], s, text[b:], m, text[a:b]))


def checked(marks: tuple[str, str, str]) -> tuple[str, str, str]:
    """Marks whose first character is nowhere else in them can't begin inside one another or over an edge."""
    heads = {m[:1] for m in marks}
    if len(set(marks)) != 3 or "" in heads or any(c in heads for m in marks for c in m[1:]):
        raise ValueError(f"marks that can't be told apart: {marks}")
    return marks


def fill_in_middle(docs: DataFrame, units: str = LINES, marks: tuple[str, str, str] = MARKS, seed: int = SEED, rate: int = RATE, spm: int = SPM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n, form, prefix_chars, middle_chars, output.

    units is a pattern whose matches, left to right, cover a text; rate and spm are percentages of
    documents that are transformed, and of those that have the suffix first.
    """
    checked(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(units)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            rows: list[tuple] = []
            size = 0
            for i in range(batch.num_rows):
                doc_id = ids[i].as_py()
                rows.append((doc_id, *transformed(texts[i].as_py() or "", doc_id, pattern, marks, seed, rate, spm)))
                size += len(rows[-1][-1])
                if size > BLOCK:  # outputs leave block by block, however many rows a batch has
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind, _ in _SCHEMA))


_SCHEMA = (("doc_id", "long", pa.int64()), ("n", "long", pa.int64()), ("form", "string", pa.string()), ("prefix_chars", "long", pa.int64()), ("middle_chars", "long", pa.int64()), ("output", "string", pa.string()))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, (_, _, kind) in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], names=[name for name, _, _ in _SCHEMA])


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text again, from output and form alone, by built-in functions."""
    p, s, m = checked(marks)

    def between(start: str, end: str | None) -> Column:
        rest = F.substr(output, F.locate(start, output) + F.lit(len(start)))
        return rest if end is None else F.substr(rest, F.lit(1), F.locate(end, rest) - F.lit(1))

    psm = F.concat(between(p, s), between(m, None), between(s, m))
    spm = F.concat(between(p, m), between(m, None), between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle_report(docs: DataFrame, **options) -> DataFrame:
    """Digests of the outputs and of what they are restored to."""
    out = fill_in_middle(docs, **options)
    text = restored(F.col("output"), F.col("form"), options.get("marks", MARKS))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))
