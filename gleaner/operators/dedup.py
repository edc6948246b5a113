"""Exact and likely duplicates of a dataset's rows, as a reader going through them in order would find them.

Going by _pos, a row whose key equals a kept row's is an exact duplicate; else one whose best similarity to a kept
row reaches the threshold is a likely duplicate; else it is kept. So the kept rows are the greedy, first-come
independent set of the graph of equal keys and similar rows, which depends on order but not on going one by one:

1. Only the first row of a key can be kept, so one row stands for each key.
2. A mean similarity of t needs some column of similarity t or more. For each column, rows that can reach it share one
   of their rarest trigrams (prefix filter) and are of like size; candidates are an equi-join, then checked in full.
3. A row is a duplicate if an earlier neighbour is kept, and kept if all its earlier neighbours are duplicates: decided
   component by component (functions/graph.py), in order within one, so that a long chain takes few passes.
4. Targets: the kept row with the best score that comes before, the earliest of equals.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import coerce as co
from gleaner.functions import scalar as sc
from gleaner.functions import text as tx
from gleaner.functions.graph import first_come
from gleaner.functions.storage import newest, passing, written
from gleaner.operators.dataset import Dataset

LOOSE, BALANCED, STRICT = 0.60, 0.80, 0.95
UNIQUE, EXACT, LIKELY = "UNIQUE", "EXACT", "LIKELY"
#: Loosens filters against rounding; the check itself is exact.
SLACK = 1e-9
#: 64-bit words of a cell's digest. Each gram turns over the bit that its hash names, so cells differ in at least as many grams as bits.
WORDS = 4
#: Cells that share a gram, laid against each other in one block; cells that one task takes, about; pairs that are compared at once.
BLOCK, ENTRIES, AT_ONCE = 4_096, 20_000, 1 << 17


def normalized(c: Column, ftype: str) -> Column:
    """A cell as it is compared."""
    if ftype in ("phone", "number", "currency"):
        return co.coerce(c, ftype)
    t = F.lower(tx.trim(c))
    if ftype == "email":
        return t
    if ftype in ("url", "image"):
        return F.regexp_replace(tx.before_hash(t), r"/+\z", "")
    return F.regexp_replace(t, r"\s+", " ")


def _keyed(d: Dataset, keys: list[str]) -> DataFrame:
    """_id, _pos, n (normalised key columns), key (joined; null where it can equal no other)."""
    n = F.array(*[normalized(F.col(f"`{k}`"), d.type_of(k)) for k in keys])
    rows = d.df.select("_id", "_pos", n.alias("n"))
    key = F.array_join("n", "\x00")
    return rows.withColumn("key", F.when(~tx.is_blank(key), key))


def similarity(a: Column, b: Column, grams_a: Column, grams_b: Column) -> Column:
    """Mean over columns of equality or trigram overlap; columns blank on both sides do not count, and 0 where none counts."""
    pairs = F.arrays_zip(a.alias("x"), b.alias("y"), grams_a.alias("g"), grams_b.alias("h"))
    counted = F.filter(pairs, lambda p: ~(tx.is_blank(p["x"]) & tx.is_blank(p["y"])))
    score = F.transform(
        counted,
        lambda p: F.when(p["x"] == p["y"], F.lit(1.0)).when(tx.is_blank(p["x"]) | tx.is_blank(p["y"]), F.lit(0.0)).otherwise(sc.jaccard(p["g"], p["h"])),
    )
    return F.when(F.size(score) > 0, F.aggregate(score, F.lit(0.0), lambda s, x: s + x) / F.size(score)).otherwise(F.lit(0.0))


def _laid(threshold: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For a task's lists of cells that share a gram: a, b (_pos, a before b), pairs that the digests, the sizes and the place of the gram do not rule out."""
    apart, shared = (1 - threshold) / (1 + threshold), threshold / (1 + threshold)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [f for f in frames if len(f)]
        if not found:
            return
        pdf = pd.concat(found, ignore_index=True)
        # the shorter cell of a pair has the gram early, so of two that have it late there is no pair
        late = pdf["rest"].to_numpy() < 2 * shared * pdf["size"].to_numpy() - SLACK
        order = np.lexsort((late, pdf["side"], pdf["j"], pdf["i"], pdf["key"]))
        key, i, j, side, pos, size, rest, lone = (pdf[c].to_numpy()[order] for c in ("key", "i", "j", "side", "_pos", "size", "rest", "lone"))
        bits, late = [pdf[f"b{w}"].to_numpy()[order].view(np.uint64) for w in range(WORDS)], late[order]
        room = np.clip(np.ceil(apart * size) - lone, -10_000, 10_000).astype(np.int16)

        def lay(x0: int, x1: int, y0: int, y1: int, own: bool) -> Iterator[pd.DataFrame]:
            """Rows x0 to x1 against y0 to y1; own: against those of them that come later."""
            step = max(1, AT_ONCE // max(1, y1 - y0))
            for p in range(x0, x1, step):
                q, lo = min(p + step, x1), p if own else y0
                differ = np.bitwise_count(bits[0][p:q, None] ^ bits[0][None, lo:y1])
                differ += np.bitwise_count(bits[1][p:q, None] ^ bits[1][None, lo:y1])
                x, y = np.nonzero(differ <= room[p:q, None] + room[None, lo:y1])
                x, y = x + p, y + lo
                if own:
                    x, y = x[y > x], y[y > x]
                both = size[x] + size[y]
                ok = sum(np.bitwise_count(b[x] ^ b[y]).astype(np.int32) for b in bits) + lone[x] + lone[y] <= apart * both + SLACK
                ok &= (pos[x] != pos[y]) & (np.minimum(rest[x], rest[y]) >= shared * both - SLACK)
                ok &= np.minimum(size[x], size[y]) >= threshold * np.maximum(size[x], size[y]) - SLACK
                if ok.any():
                    yield pd.DataFrame({"a": np.minimum(pos[x[ok]], pos[y[ok]]), "b": np.maximum(pos[x[ok]], pos[y[ok]])})

        new = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        ends = [*(np.flatnonzero(new) + 1).tolist(), len(key)]
        for s, e in zip([0, *ends[:-1]], ends, strict=True):
            if e - s < 2:
                continue
            if i[s] == j[s]:
                yield from lay(s, e - int(late[s:e].sum()), s, e, True)
            else:
                m = s + int(np.searchsorted(side[s:e], 1))
                early, early_m = m - int(late[s:m].sum()), e - int(late[m:e].sum())
                yield from lay(s, early, m, e, False)
                yield from lay(early, m, m, early_m, False)

    return run


def _candidates(reps: DataFrame, threshold: float) -> DataFrame:
    """a, b: pairs of rows, _pos a before b, of which some column may be similar enough; as a written table."""
    cells = reps.select("_pos", F.posexplode("grams").alias("c", "g")).where(F.size("g") > 0)
    grams = cells.select("_pos", "c", F.size("g").alias("size"), F.explode("g").alias("gram"))
    rare = grams.groupBy("c", "gram").agg(F.count(F.lit(1)).alias("freq")).where("freq > 1")
    bit = F.pmod(F.xxhash64("gram"), F.lit(64 * WORDS)).cast("int")
    flag = F.call_function("shiftleft", F.lit(1).cast("long"), bit % 64)
    digest = [F.bit_xor(F.when(F.floor(bit / 64) == w, flag).otherwise(F.lit(0).cast("long"))).alias(f"b{w}") for w in range(WORDS)]
    ranked = grams.join(rare, ["c", "gram"]).groupBy("_pos", "c", "size").agg(F.array_sort(F.collect_list(F.struct("freq", "gram"))).alias("shared"), *digest)
    # grams that no other row has come first in rarity: they use up places of the prefix but can match nothing
    lone = F.col("size") - F.size("shared")
    place = F.col("size") - F.ceil(threshold * F.col("size") - SLACK) + 1 - lone
    words = [f"b{w}" for w in range(WORDS)]
    cell = ranked.where(place > 0).select("_pos", "size", lone.alias("lone"), F.size("shared").alias("n"), "c", *words, F.posexplode(F.slice("shared", F.lit(1), place.cast("int"))).alias("at", "x"))
    prefix = written(cell.select("_pos", "size", "lone", (F.col("n") - F.col("at")).alias("rest"), *words, F.xxhash64("c", "x.gram").alias("key")), "prefix")
    # a long list falls into blocks, and every two blocks, and each with itself, are a cell of their own
    long = prefix.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > BLOCK).select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("k"))
    blocks = prefix.join(long, "key", "left").withColumn("k", F.coalesce("k", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("_pos"), F.col("k")).cast("int"))
    blocks = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    laid = blocks.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "_pos", "size", "rest", "lone", *words)
    tasks = max(1, -(-prefix.count() // ENTRIES))
    return written(laid.repartition(tasks, "key", "i", "j").mapInPandas(_laid(threshold), "a long, b long").distinct(), "pairs")


def similar(reps: DataFrame, threshold: float) -> DataFrame:
    """a, b, score: pairs of rows with _pos a before b whose similarity reaches the threshold."""
    pairs = _candidates(reps, threshold)
    side = lambda x: reps.select(F.col("_pos").alias(x), F.col("n").alias(f"n_{x}"), F.col("grams").alias(f"g_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    score = similarity(F.col("n_a"), F.col("n_b"), F.col("g_a"), F.col("g_b"))
    return both.select("a", "b", score.alias("score")).where(F.col("score") >= threshold)


def _edges(reps: DataFrame, threshold: float) -> DataFrame:
    """similar(), as a written table."""
    with passing(reps.sparkSession) as keep:
        edges = written(similar(reps, threshold), "edges")
        keep.append(newest())
    return edges


def _kept(reps: DataFrame, edges: DataFrame) -> DataFrame:
    """_pos of the rows that are kept, as a written table."""
    with passing(reps.sparkSession) as keep:
        gone = first_come(edges.select("a", "b")).where("not kept")
        kept = written(reps.select("_pos").join(gone.select("_pos"), "_pos", "left_anti"), "kept")
        keep.append(newest())
    return kept


def analyze(d: Dataset, keys: list[str] | None = None, threshold: float = BALANCED) -> DataFrame:
    """A row for each of the dataset's: _id, _pos, verdict, duplicate_of (an _id), score.

    keys: fields to compare; unknown ones are dropped, and all fields are used where none is left.
    """
    keys = [k for k in keys or [] if k in d.names] or d.names
    rows = written(_keyed(d, keys), "rows")
    if threshold <= 0:
        return _first_only(rows)
    rep_of = rows.where("key is not null").groupBy("key").agg(F.min("_pos").alias("rep"))
    rows = rows.join(rep_of, "key", "left").select("_id", "_pos", "n", F.coalesce("rep", "_pos").alias("rep"))
    grams = F.transform("n", lambda x: F.when(tx.is_blank(x), F.array().cast("array<string>")).otherwise(sc.trigrams(x)))
    reps = written(rows.where("_pos = rep").select("_pos", "_id", "n", grams.alias("grams")), "reps")
    edges = _edges(reps, threshold)
    kept = _kept(reps, edges).withColumn("kept", F.lit(True))
    links = edges.select(F.col("a").alias("rep"), F.col("b").alias("to"), "score").unionByName(edges.select(F.col("b").alias("rep"), F.col("a").alias("to"), "score"))
    links = links.join(kept.select(F.col("_pos").alias("to")), "to", "left_semi")
    rows = rows.join(kept.withColumnRenamed("_pos", "rep"), "rep", "left")
    ids = reps.select(F.col("_pos").alias("to"), F.col("_id").alias("duplicate_of"))
    none, one = F.lit(None).cast("string"), F.lit(1.0)
    unique = rows.where("kept and _pos = rep").select("_id", "_pos", F.lit(UNIQUE).alias("verdict"), none.alias("duplicate_of"), one.alias("score"))
    exact = rows.where("kept and _pos > rep").join(ids.withColumnRenamed("to", "rep"), "rep").select("_id", "_pos", F.lit(EXACT).alias("verdict"), "duplicate_of", one.alias("score"))
    likely = rows.where("kept is null").join(links, "rep").where("to < _pos").groupBy("_id", "_pos").agg(F.max(F.struct("score", (-F.col("to")).alias("at"))).alias("best"))
    likely = likely.withColumn("to", -F.col("best.at")).join(ids, "to").select("_id", "_pos", F.lit(LIKELY).alias("verdict"), "duplicate_of", F.col("best.score").alias("score"))
    return unique.unionByName(exact).unionByName(likely)


def _first_only(rows: DataFrame) -> DataFrame:
    """At a threshold of 0 or less every row is like the first."""
    first = rows.orderBy("_pos").limit(1).select(F.col("_id").alias("f_id"), F.col("n").alias("f_n"), F.col("key").alias("f_key"), F.col("_pos").alias("f_pos"))
    both = rows.crossJoin(F.broadcast(first))  # one row
    grams = lambda n: F.transform(n, lambda x: F.when(tx.is_blank(x), F.array().cast("array<string>")).otherwise(sc.trigrams(x)))
    score = similarity(F.col("n"), F.col("f_n"), grams("n"), grams("f_n"))
    top, same = F.col("_pos") == F.col("f_pos"), F.coalesce(F.col("key") == F.col("f_key"), F.lit(False))
    return both.select(
        "_id", "_pos", F.when(top, UNIQUE).when(same, EXACT).otherwise(LIKELY).alias("verdict"), F.when(~top, F.col("f_id")).alias("duplicate_of"),
        F.when(top | same, 1.0).otherwise(score).alias("score"),
    )


def exact_only(d: Dataset, keys: list[str] | None = None) -> DataFrame:
    """Rows with an earlier row of equal key, without looking for likely duplicates: _id, _pos, duplicate_of. Pre-aggregated by key."""
    keys = [k for k in keys or [] if k in d.names] or d.names
    rows = _keyed(d, keys).where("key is not null")
    first = rows.groupBy("key").agg(F.min(F.struct("_pos", "_id")).alias("f"))
    return rows.join(first, "key").where("_pos > f._pos").select("_id", "_pos", F.col("f._id").alias("duplicate_of"))


def summary(analysis: DataFrame) -> DataFrame:
    """One row: unique, exact, likely, and a line that says so."""
    n = analysis.agg(*[F.count_if(F.col("verdict") == v).alias(v.lower()) for v in (UNIQUE, EXACT, LIKELY)])
    part = lambda k: F.when(F.col(k) > 0, F.concat(F.lit(", "), F.col(k).cast("string"), F.lit(f" {k} duplicate"), F.when(F.col(k) == 1, "").otherwise("s"))).otherwise("")
    return n.withColumn("summary", F.concat(F.col("unique").cast("string"), F.lit(" unique"), part("exact"), part("likely")))


def apply_exact(d: Dataset, keys: list[str] | None = None, threshold: float = BALANCED) -> Dataset:
    """Without exact duplicates."""
    return d.remove(analyze(d, keys, threshold).where(F.col("verdict") == EXACT).select("_id"))


def apply_all(d: Dataset, keys: list[str] | None = None, threshold: float = BALANCED) -> Dataset:
    """Without exact and likely duplicates."""
    return d.remove(analyze(d, keys, threshold).where(F.col("verdict") != UNIQUE).select("_id"))
