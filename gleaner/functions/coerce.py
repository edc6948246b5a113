"""Coercion of cells to logical types. Strings go in and strings come out; what cannot be read is kept or emptied by type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions import text as tx

TYPES = ("text", "number", "currency", "date", "url", "email", "phone", "boolean", "list", "image")

# What reads as true and as false, English and Bengali.
TRUE_WORDS = ("true", "yes", "y", "1", "in stock", "available", "হ্যাঁ")
FALSE_WORDS = ("false", "no", "n", "0", "out of stock", "unavailable", "না")

MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def type_of(name: str | None) -> str:
    """A known type's id; anything else is text."""
    found = (name or "text").lower()
    return found if found in TYPES else "text"


def number(c: Column) -> Column:
    """The first number, without its grouping commas and spaces; empty where there is none."""
    return F.translate(F.regexp_extract(tx.digits(c), r"[-+]?\d[\d,\s]*(?:\.\d+)?", 0), ", ", "")


def email(c: Column) -> Column:
    t = F.lower(tx.collapse(c))
    found = F.regexp_extract(t, r"[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}", 0)
    return F.when(found != "", found).otherwise(t)


def phone(c: Column) -> Column:
    """All decimal digits, behind a plus where the cell starts with one."""
    t = tx.digits(tx.collapse(c))
    return F.concat(F.when(t.startswith("+"), F.lit("+")).otherwise(F.lit("")), tx.only_digits(t))


def boolean(c: Column) -> Column:
    t = F.lower(tx.collapse(c))
    return F.when(t.isin(*FALSE_WORDS) | (t == ""), "false").otherwise("true")


def _iso(y: Column, m: Column, d: Column, clamp: bool) -> Column:
    """ISO date of the parts; null if they are none. clamp: a day past the month's end, up to 31, becomes its last day."""
    first = F.make_date(F.greatest(y, F.lit(1)), F.greatest(F.least(m, F.lit(12)), F.lit(1)), F.lit(1))
    last = F.day(F.last_day(first))
    sound = (y >= 1) & m.between(1, 12) & d.between(1, 31) & (F.lit(clamp) | (d <= last))
    return F.when(sound, F.concat(F.lpad(y.cast("string"), 4, "0"), F.lit("-"), F.lpad(m.cast("string"), 2, "0"), F.lit("-"), F.lpad(F.least(d, last).cast("string"), 2, "0")))


def date(c: Column) -> Column:
    """ISO form of the dates that are read; else the first ISO-like run, unchecked, or a d/m/y date anywhere; else the collapsed text.

    A whole cell is tried as these forms in order: year-month-day, d/m/y, m/d/y, d-m-y with two digits each, day month
    year and month day, year in English names or their first three letters, y/m/d, y.m.d.
    """
    return tx.let(tx.collapse(tx.digits(c)), _date_of)


def _date_of(t: Column) -> Column:
    """Forms of digits are told by the text with every digit as a 9, without a pattern; patterns are run only where none of them is."""
    mask = F.translate(t, "012345678", "999999999")

    def whole(form: str, order: str) -> Column:
        at = {x: order.index(x) for x in "ymd"}
        part = {x: F.substring(t, at[x] + 1, order.count(x)).try_cast("int") for x in "ymd"}
        return F.when(mask == form, _iso(part["y"], part["m"], part["d"], True))

    def named(pattern: str, name_at: int, day_at: int) -> Column:
        def of_words(w: Column) -> Column:
            names = [F.array_position(F.array(*map(F.lit, found)), F.get(w, F.lit(name_at))).cast("int") for found in (MONTHS, [m[:3] for m in MONTHS])]
            return _iso(F.get(w, F.lit(2)).try_cast("int"), F.greatest(*names), F.get(w, F.lit(day_at)).try_cast("int"), True)  # 0 where it is no name

        return F.when(t.rlike(pattern), tx.let(F.split(t, ",? ", -1), of_words))

    loose = F.split(F.regexp_extract(t, r"\d{1,2}[/-]\d{1,2}[/-]\d{4}", 0), "[/-]", -1)
    d, m, y = (F.get(loose, F.lit(i)).try_cast("int") for i in range(3))
    iso_like = F.regexp_extract(t, r"\d{4}-\d{2}-\d{2}", 0)
    return F.coalesce(
        whole("9999-99-99", "yyyy-mm-dd"), whole("99/99/9999", "dd/mm/yyyy"), whole("99/99/9999", "mm/dd/yyyy"), whole("99-99-9999", "dd-mm-yyyy"),
        named(r"\A\d{1,2} [A-Z][a-z]+ \d{4}\z", 1, 0), named(r"\A[A-Z][a-z]+ \d{1,2}, \d{4}\z", 0, 1), whole("9999/99/99", "yyyy/mm/dd"), whole("9999.99.99", "yyyy.mm.dd"),
        F.when(iso_like != "", iso_like), _iso(y, m, d, False), t,
    )


def by_type(c: Column, ftype: str) -> Column:
    kinds = {"number": number, "currency": number, "date": date, "email": email, "phone": phone, "boolean": boolean}
    return kinds.get(ftype, tx.collapse)(c)


def regex_groups(spark, pattern: str) -> int | None:
    """Capturing groups of a Java pattern; null if it is none. Asked on the driver, so a bad pattern never fails a job."""
    try:
        return spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern).matcher("").groupCount()
    except Exception:  # the gateway wraps the pattern's own error
        return None


def coerce(c: Column | str, ftype: str = "text", regex: str | None = None, trim: bool = True, default: str | None = None, spark=None) -> Column:
    """A cell's value: cut by regex (first group, or the whole match; no match: empty; a bad pattern: as it is), then by type, trimmed, and the default if empty."""
    v = tx.text_or_empty(c)
    if regex and regex.strip():
        from pyspark.sql import SparkSession

        groups = regex_groups(spark or SparkSession.getActiveSession(), regex)
        if groups is not None:
            v = F.regexp_extract(v, regex, min(groups, 1))
    v = by_type(v, type_of(ftype))
    if trim:
        v = tx.trim(v)
    return F.when(v == "", F.lit(default)).otherwise(v) if default is not None else v
