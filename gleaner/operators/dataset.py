"""Datasets: a DataFrame of string columns with logical types, and the operators on it.

Beside its fields a dataset has columns _id, _pos, _raw, _source_url and _collected_at. Order is by _pos, which every
order-sensitive operator sorts by; _raw maps a field to the value it had before its first change.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text as tx
from gleaner.functions.coerce import type_of
from gleaner.functions.storage import written

SYSTEM = ("_id", "_pos", "_raw", "_source_url", "_collected_at")
LARGEST = 1.7976931348623157e308


@dataclass(frozen=True)
class Field:
    name: str
    type: str = "text"
    label: str = ""
    origin: str = ""
    required: bool = False

    def __post_init__(self) -> None:
        if not self.name.strip():
            raise ValueError("a field needs a name")
        object.__setattr__(self, "type", type_of(self.type))
        object.__setattr__(self, "label", self.label or self.name)


@dataclass(frozen=True)
class Source:
    kind: str = "job"
    job_id: str = ""
    provider_id: str = ""
    url: str = ""


@dataclass(frozen=True)
class Partial:
    processed: int = 0
    failed: int = 0
    skipped: int = 0
    reason: str = ""


def infer_fields(rows: DataFrame, column: str, position: str) -> list[Field]:
    """Fields of a map column: the union of its keys, in the order they are first seen."""
    keys = rows.select(F.col(position).alias("p"), F.posexplode(F.map_keys(column)).alias("i", "k"))
    first = keys.groupBy("k").agg(F.min(F.struct("p", "i")).alias("at")).orderBy("at")
    return [Field(r["k"]) for r in first.collect()]  # a field each


@dataclass(frozen=True)
class Dataset:
    id: str
    name: str
    df: DataFrame
    fields: tuple[Field, ...]
    source: Source = field(default_factory=Source)
    created_at: int = 0
    updated_at: int = 0
    partial: Partial | None = None
    #: The version of a store that it was loaded from.
    version: int | None = None

    # -- making --------------------------------------------------------------

    @staticmethod
    def of(id: str, name: str, rows: DataFrame, position: Column | str, fields: list[Field] | None = None, source: Source | None = None, now: int = 0) -> Dataset:
        """A dataset of a table's columns as strings; other columns than the fields' are dropped.

        position: a unique whole number that the rows are ordered by. Ids count the rows from 1, so position should
        count from 0 where ids are to be dense; it need not, and nothing is sorted here.
        """
        fields = fields or [Field(c) for c in rows.columns if not c.startswith("_")]
        cells = [(tx.text_or_empty(f"`{f.name}`") if f.name in rows.columns else F.lit("")).alias(f.name) for f in fields]
        url = tx.text_or_empty("url") if "url" in rows.columns else F.lit("")
        pos = tx.col(position).cast("long")
        df = rows.select(
            *cells, F.concat(F.lit(f"{id}-"), (pos + 1).cast("string")).alias("_id"), pos.alias("_pos"), F.create_map().cast("map<string,string>").alias("_raw"),
            url.alias("_source_url"), F.lit(now).cast("long").alias("_collected_at"),
        )
        return Dataset(id, name, df, tuple(fields), source or Source(), now, now)

    def having(self, df: DataFrame, fields: tuple[Field, ...] | list[Field] | None = None, **more) -> Dataset:
        return replace(self, df=df, fields=tuple(fields if fields is not None else self.fields), **more)

    # -- schema --------------------------------------------------------------

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def is_partial(self) -> bool:
        return self.partial is not None and self.partial.failed > 0

    def type_of(self, name: str) -> str:
        return next((f.type for f in self.fields if f.name == name), "text")

    def cells(self) -> list[Column]:
        return [F.col(f"`{n}`") for n in self.names]

    def values(self) -> DataFrame:
        """The fields alone."""
        return self.df.select(*self.cells())

    # -- operators -------------------------------------------------------------

    def rename(self, name: str) -> Dataset:
        return replace(self, name=name)

    def select_fields(self, keep: list[str]) -> Dataset:
        """Those fields, in that order; unknown names vanish."""
        by_name = {f.name: f for f in self.fields}
        kept = [by_name[k] for k in dict.fromkeys(keep) if k in by_name]
        return self.having(self.df.select(*[F.col(f"`{f.name}`") for f in kept], *SYSTEM), kept)

    def rename_field(self, old: str, new: str) -> Dataset:
        """The field under another name; nothing if there is no such field. Where the name is taken, the later field's values win. Old values stay under the old name."""
        if old not in self.names or old == new:
            return self
        order = [new if n == old else n for n in self.names]
        from_ = {(new if n == old else n): n for n in self.names}
        kept = list(dict.fromkeys(order))
        fields = {(new if f.name == old else f.name): replace(f, name=(new if f.name == old else f.name)) for f in reversed(self.fields)}
        df = self.df.select(*[F.col(f"`{from_[n]}`").alias(n) for n in kept], *SYSTEM)
        return self.having(df, [fields[n] for n in kept])

    def filter(self, condition: Column) -> Dataset:
        return self.having(self.df.where(condition))

    def search(self, query: str, field: str | None = None) -> Dataset:
        """Rows with the text anywhere in a field, or in the one named, whatever its case; all rows for a blank query."""
        if not query.strip():
            return self
        if field is not None and field not in self.names:
            return self.filter(F.lit(False))
        q = F.lower(F.lit(query))
        found = F.lit(False)
        for n in [field] if field is not None else self.names:
            found = found | F.contains(F.lower(F.col(f"`{n}`")), q)
        return self.filter(found)

    def search_blob(self, pattern: str) -> Dataset:
        """Rows whose fields, in lower case and joined by spaces, have the pattern somewhere; % and _ in it are wildcards, and it may span fields. search() is the plain one."""
        blob = F.concat_ws(" ", *[F.lower(c) for c in self.cells()])
        return self.filter(blob.like(f"%{pattern.lower()}%"))

    def remove_empty_rows(self) -> Dataset:
        return self.filter(~self.empty_row())

    def empty_row(self) -> Column:
        out = F.lit(True)
        for c in self.cells():
            out = out & tx.is_blank(c)
        return out

    def sort_keys(self, field: str, descending: bool = False) -> list[Column]:
        """Numbers by value, what is no number last, then by lower-case text, then by place; descending reverses all of it."""
        c = F.col(f"`{field}`") if field in self.names else F.lit("")
        keys = [F.lower(c), F.col("_pos")]
        if self.type_of(field) in ("number", "currency"):
            keys.insert(0, F.coalesce(c.try_cast("double"), F.lit(LARGEST)))
        return [k.desc() if descending else k.asc() for k in keys]

    def sorted_by(self, field: str, descending: bool = False) -> DataFrame:
        return self.df.orderBy(*self.sort_keys(field, descending))

    def page(self, offset: int = 0, limit: int = 100, query: str = "", sort: str | None = None, descending: bool = False) -> DataFrame:
        """Rows offset to offset + limit of those that search finds, by the sort field or by place."""
        if offset < 0 or limit <= 0:
            raise ValueError("offset must not be negative, limit must be positive")
        found = self.search(query)
        df = found.sorted_by(sort, descending) if sort else found.df.orderBy("_pos")
        return df.offset(offset).limit(limit)

    def remove(self, ids: DataFrame | list[str]) -> Dataset:
        if isinstance(ids, DataFrame):
            return self.having(self.df.join(ids.select(F.col(ids.columns[0]).alias("_id")), "_id", "left_anti").select(*self.df.columns))
        return self.filter(~F.col("_id").isin(*ids)) if ids else self

    def merge(self, other: Dataset, name: str | None = None) -> Dataset:
        """The rows of both, this one's first; fields of both, this one's first and its types winning; empty where a side has none."""
        fields = [*self.fields, *(f for f in other.fields if f.name not in self.names)]

        def side(d: Dataset, first: bool) -> DataFrame:
            cells = [(F.col(f"`{f.name}`") if f.name in d.names else F.lit("")).alias(f.name) for f in fields]
            return d.df.select(*cells, *SYSTEM, F.lit(0 if first else 1).alias("_side"))

        rows = side(self, True).unionByName(side(other, False))
        last = self.df.agg(F.coalesce(F.max("_pos"), F.lit(-1)).alias("_last"))
        pos = F.when(F.col("_side") == 1, F.col("_pos") + F.col("_last") + 1).otherwise(F.col("_pos"))
        df = rows.crossJoin(F.broadcast(last)).withColumn("_pos", pos).drop("_side", "_last")  # one row
        return replace(self, name=name or self.name, df=df, fields=tuple(fields), source=Source("merge"))

    # -- aggregates ------------------------------------------------------------

    def missing_counts(self) -> DataFrame:
        """field, missing: how many rows have each field blank, in one pass."""
        counts = self.df.agg(*[F.count_if(tx.is_blank(c)).alias(f"c{i}") for i, c in enumerate(self.cells())])
        pairs = F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"c{i}").alias("missing")) for i, n in enumerate(self.names)])
        return counts.select(F.explode(pairs).alias("x")).select("x.*")

    def stats(self) -> DataFrame:
        """One row: records, fields, missing (by field), empty_rows."""
        missing = [x for i, n in enumerate(self.names) for x in (F.lit(n), F.col(f"c{i}"))]
        return self.df.agg(
            F.count(F.lit(1)).alias("records"), F.count_if(self.empty_row()).alias("empty_rows"), *[F.count_if(tx.is_blank(c)).alias(f"c{i}") for i, c in enumerate(self.cells())]
        ).select("records", F.lit(len(self.names)).alias("fields"), F.create_map(*missing).alias("missing"), "empty_rows")

    def count(self) -> int:
        return self.df.count()

    # -- history -----------------------------------------------------------------

    def changed(self, new: dict[str, Column]) -> Dataset:
        """Fields with new values; a field's first former value goes to _raw where it differs. One projection, however many fields."""
        old = {n: F.col(f"`{n}`") for n in new}
        staged = self.df.select("*", *[c.alias(f"_new_{i}") for i, c in enumerate(new.values())])
        entries = F.array(*[F.struct(F.lit(n).alias("key"), old[n].alias("value"), F.col(f"_new_{i}").alias("new")) for i, n in enumerate(new)])
        first = F.filter(entries, lambda x: (x["value"] != x["new"]) & ~F.map_contains_key(F.col("_raw"), x["key"]))
        raw = F.map_concat("_raw", F.map_from_entries(F.transform(first, lambda x: F.struct(x["key"], x["value"]))))
        at = {n: i for i, n in enumerate(new)}
        cells = [(F.col(f"_new_{at[n]}") if n in at else F.col(f"`{n}`")).alias(n) for n in self.names]
        system = [raw.alias("_raw") if s == "_raw" else F.col(s) for s in SYSTEM]
        return self.having(staged.select(*cells, *system))

    def raw_of(self, name: str) -> Column:
        return F.coalesce(F.try_element_at("_raw", F.lit(name)), F.col(f"`{name}`"))

    def was_modified(self, name: str) -> Column:
        """True where the field once had another value than now."""
        return F.coalesce(F.try_element_at("_raw", F.lit(name)) != F.col(f"`{name}`"), F.lit(False))


def dense_positions(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with _pos counting from 0 by the keys' order, without sorting all rows in one task.

    Rows are range-partitioned and sorted; each partition counts its rows, and starts where the ones before it end.
    The sorted rows are a written table, as a second sampling of ranges need not agree with the first.
    """
    spark: SparkSession = rows.sparkSession
    ordered = written(rows.orderBy(*keys).withColumn("_m", F.monotonically_increasing_id()), "ordered")
    part, at = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r["p"], r["n"]) for r in ordered.groupBy(part.alias("p")).count().withColumnRenamed("count", "n").collect())  # a row a partition
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    offsets = spark.createDataFrame(starts, "_p long, _start long")
    return ordered.withColumn("_p", part).join(F.broadcast(offsets), "_p").withColumn("_pos", F.col("_start") + at).drop("_p", "_start", "_m")
