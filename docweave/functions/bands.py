"""Frequency bands: one spelling, bounds, order and level."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The band of rows without one, the band of unknown frequency, and the open upper bound.
NONE_STATED, UNKNOWN, OPEN = "頻度の記載なし", "頻度不明", 1000.0
_NUMBER = r"(\d+(?:\.\d+)?)"
_FREQUENCY = r"[（(]([^（()）]*(?:[0-9０-９]\s*[%％]|頻度不明)[^（()）]*)[）)]"


#: What stands around a band, what stands between its two bounds, and the tildes and signs that are one.
_AROUND = r"^(?:いずれも|すべて|全て)|(?:注\d*\)?|[a-z]\))+$"
_BETWEEN = r"(?<=\d)%(?:(?:以上)?～|以上(?=\d))"
_MANY, _ONE = "〜~∼％", "～～～%"


def band(c: Column) -> Column:
    """T04 of text in NFKC form; wide tildes and percent signs are also taken as they are."""
    tight = F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), _MANY, _ONE), r"(?U)\s+", "")
    out = F.regexp_replace(F.regexp_replace(tight, _AROUND, ""), _BETWEEN, "～")
    return F.when(out == "", NONE_STATED).otherwise(out)


def spelled_band(s: str | None) -> str:
    """T04 of any text, for documents that are walked in Python."""
    tight = "".join(unicodedata.normalize("NFKC", s or "").split()).translate(str.maketrans(_MANY, _ONE))
    return re.sub(_BETWEEN, "～", re.sub(_AROUND, "", tight)) or NONE_STATED


def bounds(band_: Column) -> Column:
    """T06 of a band in its one spelling: struct (lo, hi)."""
    double = lambda pattern, group: F.regexp_extract(band_, pattern, group).try_cast("double")
    span, edge = _NUMBER + "%?[～-]" + _NUMBER + "%", _NUMBER + "%(以上|超|未満|以下)"
    low, high, value = double(span, 1), double(span, 2), double(edge, 1)
    exact = F.array_max(F.transform(F.regexp_extract_all(band_, F.lit(_NUMBER + "%"), 1), lambda x: x.try_cast("double")))
    upward = F.regexp_extract(band_, edge, 2).isin("以上", "超")
    pair = lambda lo, hi: F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))
    return (
        F.when(low.isNotNull(), pair(low, high))
        .when(value.isNotNull() & upward, pair(value, F.lit(OPEN)))
        .when(value.isNotNull(), pair(F.lit(0.0), value))
        .when(exact.isNotNull(), pair(exact, exact))
        .when(band_ == NONE_STATED, pair(F.lit(-2.0), F.lit(-2.0)))
        .otherwise(pair(F.lit(-1.0), F.lit(-1.0)))
    )


def order_key(bounds_: Column) -> Column:
    """Sorts descending by what a band reaches, then by its lower bound."""
    lo, hi = bounds_.getField("lo"), bounds_.getField("hi")
    return F.struct(F.when(hi >= OPEN, lo).otherwise(hi).alias("reach"), lo.alias("lo"))


def level(bounds_: Column) -> Column:
    """C04."""
    lo, hi = bounds_.getField("lo"), bounds_.getField("hi")
    return F.when(lo < 0, 0).when(lo >= 5, 3).when((lo >= 1) | (hi >= 5), 2).otherwise(1)


def first_frequency(c: Column) -> Column:
    """The first frequency in brackets, or the empty string."""
    return F.regexp_extract(c, _FREQUENCY, 1)


def named_bands(header: Column, fallback: Column) -> Column:
    """Array of (band, name) from names each followed by a frequency in brackets; a bare rest takes the fallback."""
    edges = r"(?U)^[、,，\s]+|[、,，\s]+$"
    names = F.split(header, _FREQUENCY)
    found = F.concat(F.regexp_extract_all(header, F.lit(_FREQUENCY), 1), F.array(fallback))
    pairs = F.zip_with(names, found, lambda n, f: F.struct(band(f).alias("band"), F.regexp_replace(n, edges, "").alias("name")))
    return F.filter(pairs, lambda p: p.getField("name") != "")
