"""Text normalisers. All are columns of built-in functions but nfkc, which Spark lacks."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import StringType

#: Hiragana and the katakana that replace them, from the code points' fixed distance.
HIRAGANA = "".join(chr(c) for c in range(0x3041, 0x3097))
KATAKANA = "".join(chr(ord(c) + 0x60) for c in HIRAGANA)
#: Bytes of texts that are Python's objects at once.
SLICE = 1 << 20
#: Fixed value: characters that name lists use as hyphens.
HYPHENS = "-‐‑‒–—―−－"


def slices(s: pa.Array) -> Iterator[pa.Array]:
    """An array in stretches of about SLICE bytes, or of one text: what Python holds of a batch at once."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(s), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(s):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
        yield s.slice(at, end - at)
        at = end


@arrow_udf(StringType())
def nfkc(s: pa.Array) -> pa.Array:
    out = [pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in some.to_pylist()], pa.string()) for some in slices(s)]
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


@pandas_udf(StringType())
def unescape_html(s: pd.Series) -> pd.Series:
    """All named and numbered entities."""
    return s.map(lambda t: None if t is None else html.unescape(t))


def fold_kana(c: Column) -> Column:
    return F.translate(c, HIRAGANA, KATAKANA)


def without_space(c: Column) -> Column:
    """No white space, the full-width space included."""
    return F.regexp_replace(c, r"(?U)\s+", "")


def one_space(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", "")


def search_form(c: Column) -> Column:
    """T08 after nfkc: lower case, katakana, no white space."""
    return without_space(fold_kana(F.lower(c)))


def watch_form(c: Column) -> Column:
    """T09 after nfkc."""
    return F.lower(c)


def code_form(c: Column) -> Column:
    """T10 after nfkc: upper case, katakana, no spaces, hyphens, long vowels or punctuation."""
    return F.regexp_replace(fold_kana(F.upper(c)), rf"(?U)[\s{HYPHENS}ー_.,:;/・･'()\[\]「」]+", "")


def match_form(c: Column) -> Column:
    """T11 after nfkc: a hyphen between katakana is a long vowel, other hyphens and middle dots go."""
    joined = F.regexp_replace(search_form(c), rf"(?<=[ァ-ヶ])[{HYPHENS}](?=[ァ-ヶ])", "ー")
    return F.regexp_replace(joined, rf"[{HYPHENS}・･]", "")


def char_class(c: Column) -> Column:
    """T12 of the first character: k katakana, j kanji, a ASCII letter or digit, p any other."""
    one = F.substring(c, 1, 1)
    return F.when(one.rlike("[ァ-ヺー]"), "k").when(one.rlike("[一-鿿々〆]"), "j").when(one.rlike("[0-9A-Za-z]"), "a").otherwise("p")


#: Fixed value: rows of the syllabary with the kana that head each of their five columns.
_SMALL, _LARGE = "ァィゥェォッャュョヮヵヶ", "アイウエオツヤユヨワカケ"
_VOICED = "ガギグゲゴザジズゼゾダヂヅデドバビブベボパピプペポヴ"
_PLAIN = "カキクケコサシスセソタチツテトハヒフヘホハヒフヘホウ"


def index_kana(c: Column) -> Column:
    """The base kana under which a name is listed."""
    return F.translate(fold_kana(F.substring(c, 1, 1)), _SMALL + _VOICED, _LARGE + _PLAIN)


def strip_tags(c: Column, breaks: str = " / ") -> Column:
    """Line breaks as text, no tags, the five basic entities, single spaces."""
    c = F.regexp_replace(c, r"(?i)</div>\s*<div>|<br\s*/?>", breaks)
    c = F.regexp_replace(c, r"<[^>]+>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return one_space(c)


def escape_html(c: Column) -> Column:
    """T21, newlines as breaks."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("\n", "<br>")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def sentences(c: Column, ends: str = "。") -> Column:
    """Cut after each end mark and at newlines, trimmed, no empties."""
    return F.filter(F.transform(F.split(c, rf"(?<=[{ends}])|\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def without_reference_marks(c: Column) -> Column:
    """Commas that references leave behind a sentence or at the end."""
    return F.regexp_replace(c, r"(?U)(?<=。),+|[,\s]+$", "")


def cluster_key(found: Column, path: Column, text: Column) -> Column:
    """The matched sentences, or else path and text, without spaces and punctuation."""
    joined = F.array_join(F.coalesce(found, F.array().cast("array<string>")), "")
    return F.regexp_replace(F.when(joined != "", joined).otherwise(F.concat(F.coalesce(path, F.lit("")), F.coalesce(text, F.lit("")))), r"(?U)[\s・\-－‐―,，、.。·()（）]", "")


def highlighted(c: Column, found: Column, before: str = "<mark>", after: str = "</mark>") -> Column:
    """Every found sentence in marks."""
    return F.aggregate(found, c, lambda a, x: F.replace(a, x, F.concat(F.lit(before), x, F.lit(after))))


def keywords(c: Column) -> Column:
    """A query's words."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")
