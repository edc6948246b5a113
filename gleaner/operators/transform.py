"""Cleaners of datasets, and pipelines of them that report what each step changed.

A cleaner is a function from Dataset to Dataset with an id and a description. Cell cleaners are Column expressions over
the fields they apply to: all fields, those listed, or, for the typed ones, the fields of their types.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import coerce as co
from gleaner.functions import scalar as sc
from gleaner.functions import text as tx
from gleaner.operators.dataset import Dataset, Field


@dataclass(frozen=True)
class Transform:
    id: str
    description: str
    apply: Callable[[Dataset], Dataset]

    def __call__(self, dataset: Dataset) -> Dataset:
        return self.apply(dataset)


def _cells(id: str, description: str, new: Callable[[Column, str], Column], fields: list[str] | None = None, types: tuple[str, ...] = ()) -> Transform:
    def apply(d: Dataset) -> Dataset:
        if fields:
            at = [n for n in fields if n in d.names]
        else:
            at = [f.name for f in d.fields if not types or f.type in types]
        return d.changed({n: new(F.col(f"`{n}`"), d.type_of(n)) for n in dict.fromkeys(at)}) if at else d

    return Transform(id, description, apply)


def trim_whitespace(fields: list[str] | None = None) -> Transform:
    return _cells("trim", "Cut blanks off both ends", lambda c, _: tx.trim(c), fields)


def normalize_whitespace(fields: list[str] | None = None) -> Transform:
    return _cells("normalize_whitespace", "Make runs of blanks one space", lambda c, _: tx.collapse(c), fields)


def _email(c: Column, _: str) -> Column:
    t = tx.trim(c)
    return F.when(t.rlike(r"\A[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\z"), F.lower(t)).otherwise(c)


def _phone(c: Column, _: str) -> Column:
    """Cells of fewer than six digits are no phone numbers."""
    return F.when(F.length(tx.only_digits(tx.digits(c))) < 6, c).otherwise(co.coerce(c, "phone"))


def _or_same(new: Column, c: Column) -> Column:
    return F.when(tx.is_blank(new), c).otherwise(new)


def normalize_email(fields: list[str] | None = None) -> Transform:
    return _cells("normalize_email", "Write addresses in lower case", _email, fields, ("email",))


def normalize_phone(fields: list[str] | None = None) -> Transform:
    return _cells("normalize_phone", "Keep a phone number's digits and leading plus", _phone, fields, ("phone",))


def normalize_url(fields: list[str] | None = None) -> Transform:
    return _cells("normalize_url", "Drop fragments and final slashes", lambda c, _: sc.clean_url(c), fields, ("url", "image"))


def normalize_date(fields: list[str] | None = None) -> Transform:
    return _cells("normalize_date", "Write dates that can be read in ISO form", lambda c, _: _or_same(co.coerce(c, "date"), c), fields, ("date",))


def normalize_number(fields: list[str] | None = None) -> Transform:
    return _cells("normalize_number", "Keep the number of a cell", lambda c, _: _or_same(co.coerce(c, "number"), c), fields, ("number", "currency"))


def change_case(mode: str, fields: list[str] | None = None) -> Transform:
    """mode: lower, upper or title."""
    new = {"lower": F.lower, "upper": F.upper, "title": sc.title_case}[mode]
    return _cells(f"case_{mode}", f"Write in {mode} case", lambda c, _: new(c), fields)


def remove_empty_rows() -> Transform:
    return Transform("remove_empty_rows", "Drop rows that have nothing in any field", Dataset.remove_empty_rows)


def rename_field(old: str, new: str) -> Transform:
    return Transform("rename_field", f"Name {old} {new}", lambda d: d.rename_field(old, new))


def select_fields(keep: list[str]) -> Transform:
    return Transform("select_fields", f"Keep {', '.join(keep)}", lambda d: d.select_fields(keep))


def merge_fields(sources: list[str], into: str, separator: str = " ", drop_sources: bool = False) -> Transform:
    """The sources' non-blank cells, joined, as one field; its history is not kept. Dropping the sources drops into as well where it is one of them."""

    def apply(d: Dataset) -> Dataset:
        present = [s for s in sources if s in d.names]
        if not present:
            return d
        parts = F.filter(F.array(*[F.col(f"`{s}`") for s in present]), lambda x: ~tx.is_blank(x))
        fields = d.fields if into in d.names else (*d.fields, Field(into, origin="merge"))
        out = d.having(d.df.withColumn(into, F.array_join(parts, separator)), fields)
        return out.select_fields([n for n in out.names if n not in present]) if drop_sources else out

    return Transform("merge_fields", f"Join {' and '.join(sources)} into {into}", apply)


def split_field(source: str, into: list[str], delimiter: str = ",") -> Transform:
    """A field's parts at a literal delimiter, trimmed, as fields; parts that are missing are empty, those left over are dropped."""

    def apply(d: Dataset) -> Dataset:
        if source not in d.names:
            return d
        parts = F.split(F.col(f"`{source}`"), r"\Q" + delimiter.replace(r"\E", r"\E\\E\Q") + r"\E", -1)
        new = {n: tx.trim(F.coalesce(F.get("_parts", F.lit(i)), F.lit(""))) for i, n in enumerate(into)}
        fields = (*d.fields, *(Field(n, origin="split") for n in dict.fromkeys(into) if n not in d.names))
        return d.having(d.df.withColumn("_parts", parts).withColumns(new).drop("_parts"), fields)

    return Transform("split_field", f"Split {source} into {', '.join(into)}", apply)


def standard_cleanup() -> list[Transform]:
    return [normalize_whitespace(), normalize_email(), normalize_phone(), normalize_url(), normalize_number(), normalize_date(), remove_empty_rows()]


def run(dataset: Dataset, transforms: list[Transform]) -> Dataset:
    """The transforms in order; one lazy plan."""
    for t in transforms:
        dataset = t(dataset)
    return dataset


def report(dataset: Dataset, transforms: list[Transform]) -> tuple[Dataset, DataFrame]:
    """run(), and a row for each step: step, id, description, cells_changed, rows_removed.

    A cell of a row that is still there counts as changed where its field is new or its value differs; rows meet
    their former selves in a join on _id. Lazy, as the counts cost a join a step.
    """
    steps = None
    for i, t in enumerate(transforms):
        after = t(dataset)
        before = dataset.df.select(F.col("_id").alias("_b"), F.struct(*dataset.cells()).alias("was")) if dataset.names else None
        both = after.df.join(before, F.col("_id") == F.col("_b"), "left") if before is not None else after.df
        changed = F.lit(0)
        for n in after.names:
            differs = F.lit(True) if n not in dataset.names else ~F.col(f"`{n}`").eqNullSafe(F.col(f"was.`{n}`"))
            changed = changed + differs.cast("int")
        now = both.agg(F.coalesce(F.sum(changed), F.lit(0)).cast("long").alias("cells_changed"), F.count(F.lit(1)).alias("n"))
        then = dataset.df.agg(F.count(F.lit(1)).alias("m"))
        row = now.crossJoin(then).select(  # one row each
            F.lit(i).alias("step"), F.lit(t.id).alias("id"), F.lit(t.description).alias("description"), "cells_changed",
            F.greatest(F.col("m") - F.col("n"), F.lit(0)).cast("long").alias("rows_removed"),
        )
        steps = row if steps is None else steps.unionByName(row)
        dataset = after
    return dataset, steps
