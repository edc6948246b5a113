"""Connected components, and the rows that a reader going through a graph in order would keep."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.storage import newest, sweep, written

#: Edges that one task takes at once, 16 bytes each.
PIECE = 1_000_000


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of edges (a, b long): rows (v, c), c the smallest vertex reachable from v.

    Alternates large-star and small-star: each round replaces edges by edges to smaller vertices, so the
    number of edges never grows beyond the input's and the number of rounds grows with its logarithm. A star's
    minimum comes from a pre-aggregated groupBy that is joined back, so a vertex with very many neighbours needs
    no task that holds all of them. Every round is a written table: a lost executor costs one round.
    """
    e = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    if e.isEmpty():
        return edges.select(F.col("a").alias("v"), F.col("a").alias("c")).where("false")
    for _ in range(rounds):
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("lo")).select("a", F.least("a", "lo").alias("m"))
        # large-star: neighbours above a vertex move to the least vertex of its star
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small-star: neighbours at or below a vertex, and the vertex itself, move to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", "m"))
        old = newest()
        new = written(small.where("a <> b").distinct(), "links")
        # settled when every vertex has one link, and what it links to has none
        state = (
            new.groupBy("a")
            .agg(F.count(F.lit(1)).alias("n"))
            .join(new.select(F.col("b").alias("a")).distinct().withColumn("root", F.lit(1)), "a", "left")
            .agg(F.max("n").alias("n"), F.count("root").alias("inner"))
            .first()
        )
        sweep(edges.sparkSession, [old])
        e = new
        if state["n"] == 1 and state["inner"] == 0:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("a").alias("v"), F.col("b").alias("c")).union(e.select("b", "b").distinct())


def _in_order(pdf: pd.DataFrame) -> pd.DataFrame:
    """Each vertex of whole components, in order: kept unless an earlier neighbour is."""
    a, b = pdf["a"].to_numpy(), pdf["b"].to_numpy()
    order = np.argsort(b, kind="stable")
    a, b = a[order], b[order]
    vertices = np.unique(np.concatenate([a, b]))
    at_a, at_b = np.searchsorted(vertices, a), np.searchsorted(vertices, b)
    kept = np.ones(len(vertices), bool)
    starts = np.searchsorted(at_b, np.arange(len(vertices)))
    ends = np.append(starts[1:], len(at_b))
    for v in np.flatnonzero(ends > starts).tolist():
        kept[v] = not kept[at_a[starts[v] : ends[v]]].any()
    return pd.DataFrame({"_pos": vertices, "kept": kept})


def first_come(edges: DataFrame, piece: int = PIECE) -> DataFrame:
    """_pos, kept: which ends of edges (a, b long; a before b) are kept, going by number, if a vertex is kept unless an earlier neighbour is.

    Up to ``piece`` edges are solved in order by one task. Of more, a round decides vertices without an open earlier
    neighbour, and those beside them; edges between open vertices are left. While rounds halve them they go on. What then is
    left falls into connected components: those of at most ``piece`` edges are solved in order, many in a task of about
    ``piece`` edges. Of a larger one its front, as many edges as make a piece, is solved so, and what follows from it is
    settled in the next rounds. So a chain takes its edges over ``piece`` passes, not a round a link. Each step is a
    written table.
    """
    spark = edges.sparkSession
    left, done, n = written(edges.select("a", "b").distinct(), "open"), None, None
    if left.isEmpty():
        return spark.createDataFrame([], "_pos long, kept boolean")

    def settle(decided: DataFrame) -> None:
        """Takes decided vertices (_pos, kept), and those that follow at once, out of what is left."""
        nonlocal left, done
        hit = left.join(decided.where("kept").select(F.col("_pos").alias("a")), "a", "left_semi").select(F.col("b").alias("_pos")).distinct()
        hit = hit.join(decided.select("_pos"), "_pos", "left_anti").withColumn("kept", F.lit(False))
        now = written(decided.unionByName(hit), "decided")
        gone = now.select("_pos")
        left = written(left.join(gone.withColumnRenamed("_pos", "a"), "a", "left_anti").join(gone.withColumnRenamed("_pos", "b"), "b", "left_anti"), "open")
        done = now if done is None else done.unionByName(now)

    ends = lambda: left.select(F.col("a").alias("_pos")).union(left.select("b")).distinct()
    open_ = ends()
    while True:
        before, n = n, left.count()
        if n == 0:
            break
        if n <= piece:
            settle(left.withColumn("part", F.lit(0)).groupBy("part").applyInPandas(lambda pdf: _in_order(pdf[["a", "b"]]), "_pos long, kept boolean"))
            continue
        if before is None or n * 2 <= before:
            # vertices without an open earlier neighbour are kept
            settle(left.select(F.col("a").alias("_pos")).distinct().join(left.select(F.col("b").alias("_pos")).distinct(), "_pos", "left_anti").withColumn("kept", F.lit(True)))
            continue
        of = left.join(components(left).withColumnRenamed("v", "a"), "a")
        sizes = of.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("b", [0.5**k for k in range(1, 31)], 10_000).alias("cuts"))
        # the greatest power of a half that leaves a piece; where it is not met well, a task is larger, not wrong
        sizes = sizes.withColumn("upto", F.get("cuts", F.least(F.lit(29), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / piece)).cast("int") - 1))))
        # the front of a large component is closed: its vertices' earlier neighbours are in it
        front = of.join(sizes, "c").where((F.col("n") <= piece) | (F.col("b") < F.col("upto")))
        parts = max(1, -(-n // piece))
        settle(front.withColumn("part", F.pmod(F.xxhash64("c"), F.lit(parts))).groupBy("part").applyInPandas(lambda pdf: _in_order(pdf[["a", "b"]]), "_pos long, kept boolean"))
        before = n = None  # rounds again
    # vertices that lost all their neighbours to a decision stay
    rest = open_.join(done.select("_pos"), "_pos", "left_anti").withColumn("kept", F.lit(True))
    return done.unionByName(rest)
