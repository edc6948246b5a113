"""Pieces that the training-data operators share: the cluster's folder, written tables, components."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gleaner.functions.graph import components
from gleaner.functions.storage import scratch, shared_dir, written

__all__ = ["WORD", "components", "crc_mod", "partitions", "scratch", "shared_dir", "written"]

#: A word is a maximal run of characters other than space, tab, newline, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"


def partitions(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session sets them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def crc_mod(column, n: int):
    """crc32 of a column's text, modulo n: the fixed folds of labelled and training rows."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % F.lit(n)
