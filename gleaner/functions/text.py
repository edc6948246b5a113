"""Text expressions that all operators share. Blanks are Unicode's: separators of any kind, and ASCII controls 9-13 and 28-31."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = r"[\p{Z}\t\n\x0B\f\r\x1C-\x1F]"

# Bengali and Arabic-Indic digits.
BENGALI = "০১২৩৪৫৬৭৮৯"
ARABIC_INDIC = "٠١٢٣٤٥٦٧٨٩"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim(c: Column | str) -> Column:
    """Without blanks at either end, no-break ones too."""
    return F.regexp_replace(col(c), rf"\A{_BLANK}+|{_BLANK}+\z", "")


def is_blank(c: Column | str) -> Column:
    return ~col(c).rlike(r"[^\p{Z}\t\n\x0B\f\r\x1C-\x1F]")


def collapse(c: Column | str) -> Column:
    """Runs of ASCII blanks as one space, then trimmed."""
    return trim(F.regexp_replace(col(c), r"\s+", " "))


def digits(c: Column | str) -> Column:
    """Bengali and Arabic-Indic digits as ASCII ones."""
    return F.translate(col(c), BENGALI + ARABIC_INDIC, "0123456789" * 2)


def only_digits(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"\P{Nd}", "")


def text_or_empty(c: Column | str) -> Column:
    """A cell: a string, never null."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def before_hash(c: Column | str) -> Column:
    return F.substring_index(col(c), "#", 1)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)
