"""A corpus pipeline over documents: quality rules, near-dedup, pseudonyms, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. Counted as part of the llm subpackage.
"""

from __future__ import annotations

import threading
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.storage import Scope, scope
from gleaner.llm.common import written
from gleaner.llm.jaccard import near_copies
from gleaner.llm.mixing import mixed
from gleaner.llm.packing import pack
from gleaner.llm.pii import pseudonymise, session_key
from gleaner.llm.quality import keep_good

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
_THREAD = threading.local()


def _held() -> Scope:
    """What the stages that this thread runs have written for their results to read."""
    if not hasattr(_THREAD, "held"):
        _THREAD.held = Scope()
    return _THREAD.held


def release(spark: SparkSession) -> int:
    """Removes what this thread's stages still hold, once the last result has been used; how many tables."""
    return _held().remove(spark)


def _stage(f):
    """The stage f, which begins by removing what earlier ones of its thread have written, unless the docs given still read it: each result is written before the next stage begins."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = " ".join(docs.inputFiles())
        _held().remove(spark, [p for p in _held().paths if p.rsplit("/", 1)[-1] not in read])
        with scope(_held()):
            return f(spark, docs, sf_dir)

    return run_stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the certified cutoffs keep.

    Null texts, empty ones and those of fewer than 50 words go; null ids, langs and repeated rows are judged like others
    (a null id is never labelled); a text of any length is judged whole; an empty table gives no rows; other columns are dropped.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return keep_good(docs, labels).select(*COLUMNS)


@_stage
def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts linked at 0.8 or more (Jaccard of five-word shingles): the smallest doc_id's, null after all others.

    Texts that are not alike stay, whether their ids are null or equal; of rows with the smallest id the one with the
    least hash of all its columns stays, and of equal rows any one. Null texts and texts without words are one group;
    a text of any length is compared whole; other columns are dropped; an empty table gives no rows.
    """
    rows, groups = near_copies(docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("_k"), F.xxhash64(F.lit(1), *COLUMNS).alias("_l")))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_k", "_l", "_row")
    ids = rows.select("_row", order.alias("order")).join(groups, "_row")
    first = ids.groupBy("_component").agg(F.min("order").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("_component", F.col("first._row").alias("keep"))
    # what goes is little beside the rest, so texts seldom move to be told apart
    gone = written(groups.join(first, "_component").where("_row <> keep").select("_row"), "gone")
    return rows.join(gone, "_row", "left_anti").select(*COLUMNS)


@_stage
def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; n_chars is the new text's length.

    A null text stays null; repeated rows get equal texts; ids are left alone; a text of any length is read whole; other columns are dropped.
    """
    return pseudonymise(docs.select(*COLUMNS), session_key(spark)).select(*COLUMNS)


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes, each document as often as it is taken.

    Null texts and those without words are never taken; a null source is a source, a null id stays null, repeated rows
    are separate documents; an empty table gives no rows; other columns are dropped.
    """
    return mixed(docs.select(*COLUMNS)).select(*COLUMNS)


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix with their places in sequences of 2048 tokens.

    A null or empty text is the end token alone; rows of one id, repeated rows and null ids are separate documents; an
    empty table gives no rows; other columns are dropped.
    """
    return pack(docs.select("doc_id", "text"), length=2048)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", simhash_near_dedup),
    ("pii", pii),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL can express neither certified cutoffs, keyed permutations nor packing; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; release() removes what the result reads once it has been used."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            with scope(_held()):
                docs = written(docs, "stage")
    return docs
