"""Keys cut from identifiers, content hashes, buckets, dates and two formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKETS = 64


def document_key(c: Column) -> Column:
    """The identifier without its version."""
    return F.regexp_replace(c, r"_\d+$", "")


def product_code(c: Column) -> Column:
    """The second field of a document code, or the empty string."""
    return F.coalesce(F.try_element_at(F.split(c, "_"), F.lit(2)), F.lit(""))


def company_product(c: Column) -> Column:
    return F.regexp_extract(c, r"(\d{6}_[0-9A-Z]{12})", 1)


def is_target(c: Column) -> Column:
    """documents to be read: with a field mark, not the English edition."""
    return (c != "") & F.contains(c, F.lit("_")) & ~F.endswith(c, F.lit("E"))


def content_hash(*columns: str | Column) -> Column:
    """Twelve digits that equal contents share; fields stay apart in JSON, nulls are kept."""
    return F.substring(F.sha1(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})), 1, 12)


def hash_bucket(c: Column, buckets: int = BUCKETS) -> Column:
    """Two digits from the first two of a hash."""
    return F.lpad((F.conv(F.substring(c, 1, 2), 16, 10).cast("long") % buckets).cast("string"), 2, "0")


def safe_name(c: Column) -> Column:
    """F08."""
    return c.rlike(r"^[A-Za-z0-9_.\-]{1,150}$")


def fiscal_year(c: Column) -> Column:
    """Years begin in April."""
    return F.year(c) - (F.month(c) < 4).cast("int")


def weekday_label(c: Column) -> Column:
    """T22."""
    return F.concat(F.date_format(c, "yyyy-MM-dd"), F.lit(" ("), F.element_at(F.array(*map(F.lit, ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"))), F.weekday(c) + 1), F.lit(")"))


def middle_day(low: Column, high: Column) -> Column:
    """T24."""
    return F.date_add(low, F.floor(F.datediff(high, low) / 2).cast("int"))


def age_in_days(written: Column, today: Column) -> Column:
    """What can't be read is old."""
    return F.coalesce(F.datediff(today, F.try_to_timestamp(written)), F.lit(999))


def lenient_price(c: Column) -> Column:
    """With separators; null if it is no number."""
    return F.regexp_replace(c, ",", "").try_cast("decimal(12,2)")


def half_up(c: Column, digits: int = 2) -> Column:
    """Rounding with halves toward plus infinity."""
    return F.floor(c * 10**digits + F.lit(0.5)) / 10**digits


def removal_percent(weight: Column, binding: Column, excretion: Column, volume: Column) -> Column:
    """Share removed by dialysis; null where an input is out of its range."""
    value = F.lit(-17.32) * F.log10(weight) - F.lit(0.39) * binding + F.lit(0.06) * (excretion / volume) + F.lit(83.34)
    return F.when((weight > 0) & (volume > 0) & (binding <= 100) & (excretion <= 100), half_up(value))


def accumulation_ratio(interval: Column, half_life: Column) -> Column:
    """T33."""
    return 1 / (1 - F.exp(F.lit(-0.693) * interval / half_life))


def now_in_japan() -> Column:
    """This moment in Japan, to the second."""
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("Asia/Tokyo"), F.localtimestamp()), "yyyy-MM-dd HH:mm:ss")
