"""Streams, beyond what batch operators need: rows of new pages, dropping repeats as they come, jobs that go on where they ended."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gleaner.functions import scalar as sc
from gleaner.operators.dataset import Source, dense_positions
from gleaner.plans.store import Run, Store
from gleaner.sources import jobspec
from gleaner.sources.extract import Plan, extract_pages
from gleaner.sources.jobspec import JobSpec


def page_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Pages (page_id, url, html) from Parquet files as they arrive in a folder."""
    return spark.readStream.schema("page_id long, url string, html string").option("maxFilesPerTrigger", files_per_batch).parquet(path)


def rows_of(pages: DataFrame, plan: Plan, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """extract_pages() over a stream: a scan without state."""
    return extract_pages(pages, plan, keep=keep)


def first_seen(rows: DataFrame, key: str, at: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Rows whose address has not come before. With a time column the memory of addresses is bounded: those older than the delay are forgotten."""
    keyed = rows.withColumn("_key", sc.url_key(F.col(key)))
    if at is None:
        return keyed.dropDuplicates(["_key"])
    return keyed.withWatermark(at, delay).dropDuplicatesWithinWatermark(["_key"])


def counts(events: DataFrame, at: str, length: str = "10 minutes", delay: str = "30 minutes", by: tuple[str, ...] = ()) -> DataFrame:
    """Events in each window of time; late ones count until the delay has passed."""
    return events.withWatermark(at, delay).groupBy(F.window(at, length), *by).agg(F.count(F.lit(1)).alias("n"))


def to_table(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append the stream to a Parquet table; the checkpoint makes a restart go on where it ended."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start(path)


class _First(StatefulProcessor):
    """The first row of each key, by _pos within a batch; forgotten after the time to live."""

    def __init__(self, names: list[str], ttl_ms: int | None) -> None:
        self.names, self.ttl_ms = names, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "at long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:  # of one key and batch, a frame at a time
            if pdf.empty:
                continue
            pdf = pdf.set_axis(self.names, axis=1)  # names with an underscore come as numbers
            best = pdf.nsmallest(1, "_pos")
            if first is None or best["_pos"].iloc[0] < first["_pos"].iloc[0]:
                first = best
        if first is not None and not self.seen.exists():
            self.seen.update((int(first["_pos"].iloc[0]),))
            yield first

    def close(self) -> None:
        pass


def first_records(rows: DataFrame, key: Column, ttl_ms: int | None = None) -> DataFrame:
    """A dataset's rows as they come (with _pos, in order over batches), without those whose key an earlier one has: exact dedup that goes on.

    key: what rows are told apart by; a null key is equal to no other. State is a number for each key, in a store that
    must be RocksDB (spark.sql.streaming.stateStore.providerClass); with a time to live a key is forgotten that
    long after its first row, and its next row is kept (a query that is to end with its data then needs
    spark.sql.streaming.noDataMicroBatches.enabled set to false).
    """
    keyed = rows.withColumn("_key", key)
    told = keyed.where("_key is not null").groupBy("_key")
    kept = told.transformWithStateInPandas(_First(keyed.columns, ttl_ms), keyed.schema, "Append", "ProcessingTime" if ttl_ms else "None")
    return kept.unionByName(keyed.where("_key is null")).drop("_key")


def run_job(store: Store, spec: JobSpec, run: Run, pages: DataFrame, dataset_id: str, before: Callable[[int], None] | None = None) -> Run:
    """A job over a stream of pages (page_id, url, html), each batch done once; called again with the same run it goes on where it ended.

    A batch's rows are a folder named by the batch, which a second attempt replaces; the run notes the batch as its
    checkpoint and how much has been done only once the folder is there. When the stream ends the rows become a dataset, in
    the order of pages. before: called with each batch's number. An error leaves the run as it is, for interrupted() to find.
    """
    spark, root = store.spark, f"{store.root}/runs-data/{run.id}"
    if not any(r.id == run.id for r in store.interrupted()):
        store.save_run(replace(run, status="RUNNING", checkpoint=None))

    def batch(df: DataFrame, number: int) -> None:
        if before:
            before(number)
        at = store.run(run.id)
        done = json.loads(at.checkpoint or "{}")
        found = df.select(F.count(F.lit(1)).alias("n")).first()["n"]
        jobspec.run(spec, df).write.mode("overwrite").parquet(f"{root}/rows/batch={number}")
        n = spark.read.parquet(f"{root}/rows/batch={number}").count()
        done[str(number)] = [found, n]
        noted = replace(at, checkpoint=json.dumps(done), pages_processed=sum(x[0] for x in done.values()), records_collected=sum(x[1] for x in done.values()))
        store.save_run(noted)

    pages.writeStream.foreachBatch(batch).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    at = store.run(run.id)
    folders = [f"{root}/rows/batch={k}" for k in json.loads(at.checkpoint or "{}")]
    if folders:
        rows = dense_positions(spark.read.parquet(*folders), "page_id", "_row")
        store.save(replace(jobspec.to_dataset(spec, rows, "_pos", dataset_id), source=Source("job", run.job_id, "", spec.url)))
    store.save_run(replace(at, dataset_id=dataset_id if folders else None))
    store.update_run(run.id, "COMPLETED")
    return store.run(run.id)
