"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The mix is a number of blocks of equally many words. Sources get blocks by the highest quotients target / (2 n + 1);
each source's blocks are dealt to its shards the same way, by the shards' sizes; so every shard has an integer quota.
Within a shard, documents lie end to end in a seeded order and are cut into equal blocks; a quota of q over n blocks
takes each block q // n times and a seeded choice of q % n blocks once more. A document takes the words of the blocks
it lies in, so a block can hold parts of two documents.

A shard holds about ``shard_words`` words, however large its source, so a hot source is many shards; only sums by
source come to the driver, and sums by shard to one task for each source.
"""

from __future__ import annotations

import heapq
import math
import re
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import WORD, written

WEIGHTS = (5, 2, 1)
#: Characters of the table of sources up to which it goes to every task.
BROADCAST = 4 << 20


def targets(sizes: list[int], share: Fraction = Fraction(3, 2), weights: tuple[int, ...] = WEIGHTS, most: int = 2) -> list[Fraction]:
    """Words wanted of each source, given in order: share of all words by repeating weights, none above most times its size."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, left, free = [Fraction(0)] * len(sizes), share * sum(sizes), set(range(len(sizes)))
    while free:
        total = sum(w[i] for i in free)
        over = {i for i in free if left * w[i] / total > most * sizes[i]}
        for i in over or free:
            out[i] = Fraction(most * sizes[i]) if over else left * w[i] / total
        left -= sum(out[i] for i in over)
        free -= over or free
    return out


def _highest(votes: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Seats by highest quotients votes / (2 n + 1), at most most[i] each; of equal quotients the earlier first. All in integers.

    The quotients above a divisor are counted for every party at once, and the divisor is halved into place: the least
    one above which there are no more quotients than seats. What lies just below it is dealt singly.
    """
    out, able = np.zeros(len(votes), votes.dtype), np.flatnonzero(votes > 0)
    if not len(able) or seats <= 0:
        return out
    v, cap = votes[able], most[able]
    if seats >= int(cap.sum()):
        out[able] = cap
        return out
    unit = 1 << (64 if v.dtype == object else max(0, 61 - int(v.max()).bit_length()))
    above = lambda d: np.minimum(cap, (v * unit + (d - 1)) // d // 2)  # noqa: E731  quotients above d / unit
    low, high = 0, int(v.max()) * unit  # above(high) is none
    while high - low > 1:
        d = (low + high) // 2
        low, high = (low, d) if int(above(d).sum()) <= seats else (d, high)
    got = above(high)
    near = np.flatnonzero((above(low) if low else cap) > got)
    heap = [(-Fraction(int(v[i]), 2 * int(got[i]) + 1), int(i)) for i in near]
    heapq.heapify(heap)
    for _ in range(seats - int(got.sum())):
        i = heapq.heappop(heap)[1]
        got[i] += 1
        if got[i] < cap[i]:
            heapq.heappush(heap, (-Fraction(int(v[i]), 2 * int(got[i]) + 1), i))
    out[able] = got
    return out


def apportion(votes: list, seats: int, most: list[int] | None = None) -> list[int]:
    """Sainte-Lague: seats by highest quotients votes / (2 n + 1), at most most[i] each; of equal quotients the earlier first."""
    votes = [Fraction(v) for v in votes]
    scale = math.lcm(*(v.denominator for v in votes)) if votes else 1
    whole = np.array([v.numerator * (scale // v.denominator) for v in votes], object)
    return [int(x) for x in _highest(whole, seats, np.array([seats] * len(votes) if most is None else most, object))]


def _quotas(block: int, most: int):
    """Sets each shard's blocks and quota, from one row for each shard of a source."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard").reset_index(drop=True)
        size = pdf["words"].to_numpy(np.int64)
        n = np.maximum(np.rint(size / block).astype(np.int64), (size > 0).astype(np.int64))
        return pdf.assign(blocks=n, quota=_highest(size, int(pdf["seats"].iloc[0]), most * n))[["sid", "shard", "blocks", "quota"]]

    return run


def _chosen(seed: int):
    """Words that a shard's documents give: whole passes, and the spans of words in blocks taken once more."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "doc_id", "size", "k", "copy"]).reset_index(drop=True)
        size, n, quota = pdf["size"].to_numpy(np.int64), int(pdf["blocks"].iloc[0]), int(pdf["quota"].iloc[0])
        end = np.cumsum(size)
        start, total = end - size, int(end[-1])
        passes, spans, once = 0, [[] for _ in size], np.zeros(len(size), np.int64)
        if n:
            passes, more = divmod(quota, n)
            rng = np.random.default_rng([seed, int(pdf["sid"].iloc[0]), int(pdf["shard"].iloc[0])])
            taken = np.zeros(n, bool)
            taken[rng.permutation(n)[:more]] = True
            edge = np.arange(n + 1) * total // n
            cover = np.r_[0, np.cumsum(np.where(taken, np.diff(edge), 0))]
            upto = np.interp(np.r_[start, end], edge, cover).round().astype(np.int64)
            once = upto[len(size) :] - upto[: len(size)]
            change = np.flatnonzero(np.diff(np.r_[False, taken, False]))
            for a, b in zip(edge[change[::2]].tolist(), edge[change[1::2]].tolist(), strict=True):
                for i in range(int(np.searchsorted(end, a, "right")), int(np.searchsorted(start, b, "left"))):
                    if size[i]:
                        spans[i].append([int(max(a - start[i], 0)), int(min(b - start[i], size[i]))])
        return pdf.assign(passes=passes, taken=passes * size + once, spans=spans)[["doc_id", "k", "size", "source", "source_size", "target", "taken", "passes", "spans"]]

    return run


MIX = "doc_id long, k long, size long, source string, source_size long, target double, taken long, passes long, spans array<array<bigint>>"


def mix(
    docs: DataFrame, share: Fraction = Fraction(3, 2), weights: tuple[int, ...] = WEIGHTS, most: int = 2, block: int = 32,
    shard_words: int = 1 << 20, seed: int = 11,
) -> DataFrame:
    """What the mix takes of each row of docs (doc_id, text, source).

    Returns doc_id, k (a hash of the row's id and text), size, source, source_size, target, taken (words, repeats
    counted, at most ``most`` times size), passes (whole copies) and spans (word ranges taken once more). Blocks are
    of about ``block`` words. Sources are ordered by code point, null last; null texts and texts without words
    have size 0 and give nothing; a null doc_id stays null; repeated rows are separate documents, numbered and dealt
    to shards one by one; a text of any length is one row of its shard; other columns are ignored; an empty table
    gives no rows. Reruns over the same rows agree, however they are partitioned: equal hashes (order) go by
    doc_id, size, k and copy, and rows equal in all of these are equal rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    rows = written(docs.select(doc_id, F.xxhash64("doc_id", text).alias("k"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size")), "sizes")
    sums = rows.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")).collect()  # one row a source
    sums.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["words"] for r in sums]
    want = targets(sizes, share, weights, most)
    seats = apportion(want, round(sum(want) / block))
    # seats of a source that is taken whole: all its blocks, each as often as it may be
    seats = [s if t < most * z else 2 * most * (z + 1) for s, t, z in zip(seats, want, sizes, strict=True)]
    shards = [max(1, -(-(r["words"] + r["n"]) // shard_words)) for r in sums]
    by_source = spark.createDataFrame(
        [(r["source"], i, r["words"], float(t), s, c) for i, (r, t, s, c) in enumerate(zip(sums, want, seats, shards, strict=True))],
        "source string, sid long, source_size long, target double, seats long, shards long",
    )
    small = sum(len(r["source"] or "") + 64 for r in sums) < BROADCAST
    rows = rows.groupBy("doc_id", "k", "source", "size").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.join(F.broadcast(by_source) if small else by_source, rows.source.eqNullSafe(by_source.source)).drop(by_source.source)
    rows = rows.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    rows = rows.withColumn("order", F.xxhash64(F.lit(seed), "doc_id", "k", "copy")).withColumn("shard", F.pmod(F.xxhash64("order"), "shards"))
    quotas = rows.groupBy("sid", "shard").agg(F.sum("size").alias("words"), F.first("seats").alias("seats"))
    quotas = quotas.groupBy("sid").applyInPandas(_quotas(block, most), "sid long, shard long, blocks long, quota long")
    return rows.join(quotas, ["sid", "shard"]).groupBy("sid", "shard").applyInPandas(_chosen(seed), MIX)


_WORD = re.compile(WORD)


def _copies(schema: pa.Schema):
    def run(batches):
        for batch in batches:
            text, passes, spans, at = batch.column("text"), batch.column("_mix_passes"), batch.column("_mix_spans"), []
            texts = []
            for i in range(batch.num_rows):
                t = text[i].as_py() or ""
                at += [i] * passes[i].as_py()
                texts += [t] * passes[i].as_py()
                if found := spans[i].as_py():
                    words = [m.span() for m in _WORD.finditer(t)]
                    whole = [s for s in found if s == [0, len(words)]]
                    at.append(i)
                    texts.append(t if whole else "\n".join(t[words[a][0] : words[b - 1][1]] for a, b in found))
            if at:
                rows = batch.take(pa.array(at, pa.int64()))
                columns = {f.name: rows.column(f.name) for f in schema if f.name in rows.schema.names}
                columns |= {"text": pa.array(texts, pa.string())}
                if "n_chars" in columns:
                    columns["n_chars"] = pa.array([len(t) for t in texts], schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema], schema=schema)

    return run


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: rows of docs, with their columns, as often as the mix takes them.

    A document taken twice is two rows; one taken in part is a row with those parts of its text, joined by a
    newline, and n_chars set anew where there is such a column; one not taken is no row.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    known = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-1)).alias("_mix_id")
    of = F.xxhash64(F.col("source").cast("string")).alias("_mix_s")
    taken = mix(docs, **how).where("taken > 0").select(known("doc_id"), F.col("k").alias("_mix_k"), of, F.col("passes").alias("_mix_passes"), F.col("spans").alias("_mix_spans"))
    # equal rows give one text here, as taken has a row for each of them
    keyed = docs.select("*", known("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("_mix_k"), of).dropDuplicates(["_mix_id", "_mix_k", "_mix_s"])
    both = keyed.join(taken, ["_mix_id", "_mix_k", "_mix_s"])
    return both.select(*docs.columns, "_mix_passes", "_mix_spans").mapInArrow(_copies(to_arrow_schema(docs.schema)), docs.schema)
