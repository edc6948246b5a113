"""Versions of a stored table: files in order of place, bitmaps of removed rows, and a manifest of both.

    files-<id>/      rows, sorted by _pos within and across files, each with a hash of itself
    removed-<id>/    removed rows of some files: bitmaps of 32,768 row numbers each
    manifest-<id>/   a row for each file of a version
    index-<id>/      which trigrams occur in which file

All of these are written once and never changed: a version is a manifest, and a reader that has one is untouched by
what others write. Which manifest is current is the store's to say. Removing rows writes bitmaps for the files that
hold them and a new manifest; pages are found by the manifest's running counts and read from the one or two files
that hold them; searches for text read the files that have all of its trigrams.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, MapType, StringType, StructField, StructType

#: Rows of a file at most.
FILE_ROWS = 1_000_000
#: Rows of a bitmap, and its bytes.
BUCKET, BITMAP = 32_768, 4_096
#: Bitmaps of a version are broadcast up to so many bytes, and joined beyond.
BROADCAST = 64 << 20
HASH = "_digest"
#: Files of a folder that are looked up by name at most, if they are most of it.
FEW = 32


def row_hash(df: DataFrame) -> Column:
    """64 bits of all columns, in their order; maps by their sorted entries."""
    flat = [F.array_sort(F.map_entries(f"`{f.name}`")) if isinstance(f.dataType, MapType) else F.col(f"`{f.name}`") for f in df.schema]
    return F.xxhash64(*flat)


def hash_sum() -> Column:
    """Of rows in any order; whole, so that no two errors cancel by overflow."""
    return F.sum(F.col(HASH).cast("decimal(20,0)")).cast("string")


def grams(pattern: str) -> list[str]:
    """Three-character runs of a text."""
    return sorted({pattern[i : i + 3] for i in range(len(pattern) - 2)})


class Versions:
    def __init__(self, spark: SparkSession, root: str, file_rows: int = FILE_ROWS) -> None:
        self.spark, self.root, self.file_rows = spark, root, file_rows

    def _new(self, kind: str) -> str:
        return f"{kind}-{uuid.uuid4().hex}"

    def _read(self, schema: StructType, paths: Iterable[str]) -> DataFrame:
        paths = [f"{self.root}/{p}" for p in paths]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _of(self, schema: StructType, listed: list, columns: list[Column]) -> DataFrame:
        """The columns of those files' rows (folder, file). Where these are most files of a folder, it is listed at once and the others are left out; else each file is looked up by its name."""
        folders: dict[str, set[str]] = {}
        for r in listed:
            folders.setdefault(r["folder"], set()).add(r["file"])
        named, parts = [], []
        for folder, names in folders.items():
            if len(names) > FEW:
                rows = self._read(schema, [folder])
                there = {f.rsplit("/", 1)[1] for f in rows.inputFiles()}
                others = sorted(there - names)
                if names <= there and len(others) * 4 <= len(there):  # a file that is gone is looked up, so that Spark says so
                    parts.append((rows.where(~F.col("_metadata.file_name").isin(others)) if others else rows).select(*columns))
                    continue
            named += [f"{folder}/{n}" for n in sorted(names)]
        if named:
            parts.append(self._read(schema, named).select(*columns))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    # -- writing -----------------------------------------------------------------

    def write(self, df: DataFrame) -> tuple[str, list[str]]:
        """df's rows as files in the order of _pos: the manifest, and the folders that it needs."""
        folder = self._new("files")
        df.withColumn(HASH, row_hash(df)).orderBy("_pos").write.option("maxRecordsPerFile", self.file_rows).parquet(f"{self.root}/{folder}")
        seen = StructType([df.schema["_pos"], StructField(HASH, LongType())])
        files = self._read(seen, [folder]).groupBy(F.col("_metadata.file_name").alias("file")).agg(
            F.count(F.lit(1)).alias("rows"), F.min("_pos").alias("first"), F.max("_pos").alias("last"), hash_sum().alias("digest")
        )
        none = F.lit(None).cast("string")
        manifest = self._manifest(files.withColumns({"folder": F.lit(folder), "gone": F.lit(0).cast("long"), "bitmaps": none, "buckets": F.lit(0).cast("long")}))
        return manifest, [folder, manifest]

    def _manifest(self, files: DataFrame) -> str:
        """Files in order, each with how many rows that are not removed come before it: one row a file, in one task."""
        name, before = self._new("manifest"), Window.orderBy("first", "file").rowsBetween(Window.unboundedPreceding, -1)
        start = F.coalesce(F.sum(F.col("rows") - F.col("gone")).over(before), F.lit(0)).alias("start")
        files.select("folder", "file", "rows", "first", "last", "digest", "gone", "bitmaps", "buckets", start).write.parquet(f"{self.root}/{name}")
        return name

    def files(self, manifest: str) -> DataFrame:
        """folder, file, rows, first and last place, digest, gone (removed rows), bitmaps (the folder of their bitmaps), buckets, start."""
        return self.spark.read.parquet(f"{self.root}/{manifest}")

    def remove(self, manifest: str, schema: StructType, ids: DataFrame) -> tuple[str, list[str], int] | None:
        """A manifest without the rows that have those ids (_id): it, the folders that it needs, how many rows went; None if there are none."""
        files, folder = self.files(manifest), self._new("removed")
        live = self._placed(files, StructType([schema["_id"]]))
        hit = live.join(ids, "_id", "left_semi").select("_file", (F.col("_at") + 1).alias("n"))
        bit = F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("bitmap")
        new = hit.groupBy("_file", F.bitmap_bucket_number("n").alias("_bucket")).agg(bit)
        touched = new.select("_file").distinct()
        both = new.unionByName(self._bitmaps(files).join(touched, "_file", "left_semi"))
        both.groupBy("_file", "_bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap")).write.parquet(f"{self.root}/{folder}")
        count = self.spark.read.parquet(f"{self.root}/{folder}").groupBy(F.col("_file").alias("file")).agg(F.sum(F.bitmap_count("bitmap")).alias("now"), F.count(F.lit(1)).alias("of"))
        told = files.join(count, "file", "left").withColumns({
            "gone": F.coalesce("now", "gone"), "buckets": F.coalesce("of", "buckets"), "bitmaps": F.when(F.col("now").isNotNull(), F.lit(folder)).otherwise(F.col("bitmaps")),
        })
        result = self._manifest(told)
        after = self.files(result)
        went = after.agg(F.coalesce(F.sum("gone"), F.lit(0))).first()[0] - files.agg(F.coalesce(F.sum("gone"), F.lit(0))).first()[0]
        if not went:
            return None
        kept = [r[0] for c in ("folder", "bitmaps") for r in after.select(c).distinct().collect() if r[0]]
        return result, [*kept, result], int(went)

    # -- reading -----------------------------------------------------------------

    def _bitmaps(self, files: DataFrame) -> DataFrame:
        """_file, _bucket, bitmap as these files' manifest has them."""
        said = files.where("bitmaps is not null").select(F.col("file").alias("_file"), "bitmaps")
        folders = [r[0] for r in said.select("bitmaps").distinct().collect()]  # a row a removal
        schema = StructType.fromDDL("_file string, _bucket long, bitmap binary")
        parts = [self._read(schema, [f]).join(said.where(F.col("bitmaps") == f).select("_file"), "_file", "left_semi") for f in folders]
        out = parts[0] if parts else self._read(schema, [])
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _placed(self, files: DataFrame, schema: StructType) -> DataFrame:
        """The rows of those files that are not removed, with _file and _at, the row's number there.

        Files without removed rows are only scanned; the others meet their bitmaps, broadcast while these are few.
        """
        listed = files.select("folder", "file", "buckets").collect()  # a row a file
        place = [F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at")]
        names = [F.col(f"`{f.name}`") for f in schema]
        none = StructType([*schema, StructField("_file", StringType()), StructField("_at", LongType())])

        def scan(some: list) -> DataFrame:
            if not some:
                return self.spark.createDataFrame([], none)
            return self._of(schema, some, [*names, *place])

        whole, cut = [r for r in listed if not r["buckets"]], [r for r in listed if r["buckets"]]
        if not cut:
            return scan(whole)
        bits = self._bitmaps(files)
        if sum(r["buckets"] for r in cut) * BITMAP <= BROADCAST:
            bits = F.broadcast(bits)
        rows = scan(cut).withColumn("_bucket", F.bitmap_bucket_number(F.col("_at") + 1)).join(bits, ["_file", "_bucket"], "left")
        at = F.col("_at") % BUCKET
        byte = F.conv(F.hex(F.substring(F.col("bitmap"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        left = rows.where(F.col("bitmap").isNull() | (F.getbit(byte, (at % 8).cast("int")) == 0)).select(*names, "_file", "_at")
        return left if not whole else scan(whole).unionByName(left)

    def rows(self, manifest: str, schema: StructType, only: DataFrame | None = None) -> DataFrame:
        """The rows of a version, of the files named (file) alone if some are."""
        files = self.files(manifest)
        if only is not None:
            files = files.join(only, "file", "left_semi")
        return self._placed(files, schema).select(*[F.col(f"`{f.name}`") for f in schema])

    def page(self, manifest: str, schema: StructType, offset: int, limit: int) -> DataFrame:
        """Rows offset to offset + limit by place, from the files that hold them and no others."""
        end, parts = offset + limit, []
        holding = self.files(manifest).where((F.col("start") < end) & (F.col("start") + F.col("rows") - F.col("gone") > offset))
        for r in holding.orderBy("start").collect():
            first, last = max(0, offset - r["start"]), min(r["rows"] - r["gone"], end - r["start"])
            part = self._placed(holding.where(F.col("file") == r["file"]), schema)
            if r["gone"]:  # which row numbers these are, among those that are left
                bits = np.zeros(-(-r["rows"] // BUCKET) * BUCKET, np.uint8)
                for b in self._bitmaps(holding.where(F.col("file") == r["file"])).collect():  # of one file: an eighth of a byte a row
                    bits[(b["_bucket"] - 1) * BUCKET : b["_bucket"] * BUCKET] = np.unpackbits(np.frombuffer(b["bitmap"], np.uint8), bitorder="little")
                left = np.flatnonzero(bits[: r["rows"]] == 0)
                first, last = int(left[first]), int(left[last - 1]) + 1
            parts.append(part.where((F.col("_at") >= first) & (F.col("_at") < last)))
        out = parts[0] if parts else self._placed(holding, schema)
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.orderBy("_pos").select(*[F.col(f"`{f.name}`") for f in schema])

    # -- searching ---------------------------------------------------------------

    @staticmethod
    def blob(names: list[str]) -> Column:
        """A row's cells as searches see them."""
        return F.concat_ws(" ", *[F.lower(F.col(f"`{n}`")) for n in names])

    def index(self, manifest: str, schema: StructType, names: list[str]) -> str:
        """Which trigrams the cells of each file have, sorted by trigram: the folder. Removed rows count, so the index outlives removals."""
        name, listed = self._new("index"), self.files(manifest).select("folder", "file").collect()  # a row a file
        runs = F.array_distinct(F.regexp_extract_all(self.blob(names), F.lit("(?s)(?=(.{3}))"), F.lit(1)))
        found = self._of(schema, listed, [F.col("_metadata.file_name").alias("file"), F.explode(runs).alias("gram")]) if listed else self.spark.createDataFrame([], "file string, gram string")
        found.distinct().orderBy("gram").write.parquet(f"{self.root}/{name}")
        return name

    def having(self, index: str, runs: list[str]) -> DataFrame | None:
        """The files (file) that have all trigrams of these runs of text; None if the runs are too short to tell."""
        wanted = sorted({g for r in runs for g in grams(r)})
        if not wanted:
            return None
        hits = self.spark.read.schema("file string, gram string").parquet(f"{self.root}/{index}").where(F.col("gram").isin(wanted))
        return hits.groupBy("file").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted)).select("file")

    def runs(self, pattern: str, wild: bool = False) -> list[str]:
        """What a pattern holds of plain text, in lower case as Spark has it; wild: % and _ stand for others, and a backslash for what follows it."""
        low = self.spark.range(1).select(F.lower(F.lit(pattern))).first()[0]
        return re.split(r"[%_]|\\.?", low, flags=re.S) if wild else [low]

    # -- checking ----------------------------------------------------------------

    def damage(self, manifest: str, schema: StructType) -> DataFrame:
        """file, what: files whose rows are not those written, found by counting and hashing them anew."""
        files = self.files(manifest)
        listed = [f"{r[0]}/{r[1]}" for r in files.select("folder", "file").collect()]
        rows = self._read(schema, listed)
        names = [F.col(f"`{f.name}`") for f in schema]
        now = rows.select(*names, F.col("_metadata.file_name").alias("_file")) if listed else self.spark.createDataFrame([], schema).withColumn("_file", F.lit(""))
        now = now.withColumn(HASH, row_hash(rows)).groupBy(F.col("_file").alias("file")).agg(F.count(F.lit(1)).alias("n"), hash_sum().alias("d"))
        both = files.join(now, "file", "left")
        what = F.when(F.coalesce("n", F.lit(0)) != F.col("rows"), F.concat(F.coalesce("n", F.lit(0)).cast("string"), F.lit(" rows, "), F.col("rows").cast("string"), F.lit(" written")))
        what = what.when(F.coalesce("d", F.lit("")) != F.col("digest"), F.lit("rows are not those written"))
        return both.select("file", what.alias("what")).where("what is not null")
