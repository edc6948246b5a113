"""Exact dedup against a persistent digest index, in DataFrame functions only.

Texts are equal when their normalised forms (all ASCII blanks deleted) have one SHA-256. The index is a Parquet table of
one row for each text ever kept, bucketed and sorted by digest, a folder for each batch. New documents are reduced to
(digest, length, id), grouped by digest with a partial aggregate on the map side, so that a digest which a third of
all rows share reaches its reducer as one row from each task; the groups meet the index in a sort-merge anti-join,
which reads the index's buckets as they lie, without a shuffle; what the index doesn't know is appended to it.

Documents come back through an equi-join of their digests with their group's row, both shuffled, so that adaptive
execution can split a digest with very many rows. Texts are never shuffled.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import partitions, scratch, written

BLANKS = " \t\n\x0b\f\r"
ENTRY = "digest binary, doc_id long, n_chars long, group_size long, batch string"
#: The folder of a new index's only batch, which has no rows: the first documents meet it as later ones meet theirs.
EMPTY = "batch-none"


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text, as 32 bytes; null counts as empty."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text.cast("string"), F.lit("")), BLANKS, "").cast("binary"), 256))


class DigestIndex:
    """Digests of all texts kept so far, in a folder that all executors share.

    ``add`` is safe to repeat: a batch is a folder of its own, which a second attempt under the same name replaces,
    and batches that were never finished are not read. One batch is added at a time.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None) -> None:
        """The index in that folder, new if there is none; buckets (of a new one): as many as shuffle partitions, unless said."""
        self.spark, self.path = spark, path.rstrip("/")
        noted = self._get("index.json")
        self.buckets = int(noted["buckets"]) if noted else buckets or partitions(spark)
        if not noted:
            self._fs().mkdirs(self._at(EMPTY))
            self._put("index.json", {"buckets": self.buckets, "batches": []})

    # -- the folder ----------------------------------------------------------------

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._at("x").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _get(self, name: str) -> dict | None:
        fs, at = self._fs(), self._at(name)
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def _put(self, name: str, value: dict) -> None:
        """Written beside and moved over: a reader finds the old note or the new one."""
        sc = self.spark.sparkContext
        beside = self._at(f"{name}.{uuid.uuid4().hex}")
        out = self._fs().create(beside, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        rename = sc._jvm.org.apache.hadoop.fs.Options.Rename
        how = sc._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs().getUri(), sc._jsc.hadoopConfiguration()).rename(beside, self._at(name), how)

    def batches(self) -> dict[str, str]:
        """Folder of each finished batch by its name, in the order in which they came."""
        return {b["name"]: b["folder"] for b in self._get("index.json")["batches"]}

    def _note(self, name: str, folder: str) -> None:
        rest = [{"name": n, "folder": f} for n, f in self.batches().items() if n != name]
        self._put("index.json", {"buckets": self.buckets, "batches": [*rest, {"name": name, "folder": folder}]})

    def _write(self, entries: DataFrame, folder: str) -> None:
        """Entries, dealt by digest to the index's buckets, as bucket files sorted by digest, one a bucket."""
        table = f"gleaner_digests_{uuid.uuid4().hex}"
        entries.write.bucketBy(self.buckets, "digest").sortBy("digest").option("path", f"{self.path}/{folder}").saveAsTable(table)
        self.spark.sql(f"DROP TABLE {table}")  # the files stay: the table was an external one

    def _bucketed(self, folder: str) -> DataFrame:
        """A batch's entries as a bucketed scan, which needs no shuffle in a join by digest."""
        table = f"gleaner_digests_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {table} ({ENTRY}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{folder}'")
        try:
            return self.spark.table(table)
        finally:
            self.spark.sql(f"DROP TABLE {table}")

    def entries(self) -> DataFrame:
        """digest, doc_id, n_chars, group_size and batch of every text kept."""
        folders = [f"{self.path}/{f}" for f in self.batches().values()]
        return self.spark.read.schema(ENTRY).parquet(*folders) if folders else self.spark.createDataFrame([], ENTRY)

    # -- what it is for ------------------------------------------------------------

    def add(self, docs: DataFrame, batch: str) -> DataFrame:
        """Judges docs (doc_id, text) by the index, and appends to it what it didn't know.

        Returns one row per row of docs: doc_id, keep_id (the row that stays), group_size (equal rows of this batch),
        kept, known (an earlier batch has the text, so no row of this one stays) and text_sha256 (lowercase hex). Of
        equal texts of a batch the row with the most code points in its original text stays, of those the smallest
        doc_id (null after all others), of rows equal in both any one. Null texts count as empty and are one group with blank
        ones; ids are cast to long; other columns are ignored; no rows give none, and add an empty batch.
        """
        key = F.monotonically_increasing_id().alias("row")
        size = F.length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long").alias("n_chars")
        rows = written(docs.select(key, F.col("doc_id").cast("long").alias("doc_id"), size, digest(F.col("text")).alias("digest")), "digests")
        best = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")
        groups = written(rows.groupBy("digest").agg(best, F.count(F.lit(1)).alias("group_size")), "groups")

        earlier = [f for n, f in self.batches().items() if n != batch] or [EMPTY]
        fresh = groups.select("digest", F.col("best.doc_id").alias("doc_id"), (-F.col("best.less")).alias("n_chars"), "group_size", F.lit(batch).alias("batch"))
        fresh = fresh.repartition(self.buckets, "digest")
        for folder in earlier:
            fresh = fresh.join(self._bucketed(folder).select("digest").hint("merge"), "digest", "left_anti")
        folder = f"batch-{uuid.uuid4().hex}"
        self._write(fresh, folder)
        self._note(batch, folder)

        # the verdict is what the index now says: the entry of a text, and whether this batch brought it
        said = self.entries().select("digest", F.col("doc_id").alias("keep_id"), (F.col("batch") != batch).alias("known"))
        judged = written(groups.join(said, "digest").select("digest", "keep_id", "known", "group_size", F.col("best.row").alias("first")), "judged")
        kept = ~F.col("known") & (F.col("row") == F.col("first"))
        return rows.join(judged, "digest").select("doc_id", "keep_id", "group_size", kept.alias("kept"), "known", F.lower(F.hex("digest")).alias("text_sha256"))

    def compact(self) -> None:
        """All batches as one, under a name of its own: later joins read one sorted file a bucket. Entries still say which batch brought them."""
        if len(self.batches()) < 2:
            return
        folder = f"batch-{uuid.uuid4().hex}"
        self._write(self.entries().repartition(self.buckets, "digest"), folder)
        self._put("index.json", {"buckets": self.buckets, "batches": [{"name": folder, "folder": folder}]})


def dedup(docs: DataFrame) -> DataFrame:
    """add() of docs as the one batch of a new index in the shared folder."""
    spark = docs.sparkSession
    return DigestIndex(spark, scratch(spark, "digest_index")).add(docs, "all")
