"""Near-copies by SimHash links and the exact Jaccard similarity of word-shingle sets.

Every link is decided by the two whole sets, by 64-bit hashes of their shingles; equal sets are one vertex. Two bits of
64 tell only very near copies, so SimHash gives the first links, and other candidates complete them:

* A set takes part if it shares one of 40 MinHash keys of five minima with another: a pair at 0.8 has no key in common
  with a probability of 1.3e-7, nearer ones more rarely.
* Among these sets shingles are ordered by how many sets have them, the rarest first. Two similar sets share one of their first
  ``n - ceil(0.8 n) + 1`` shingles, so these, but for those that no other set has, are the index. A shingle's
  place in the order bounds how alike two sets can be, and so does a parity bitmap: two of them differ in no more
  bits than the sets in shingles. Both bounds are part of the join.
* What is wanted are groups. So first some members of the largest group under each shingle are compared with those
  outside it, in rounds; then all pairs of different groups that the bounds leave: none is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from gleaner.functions.storage import newest, passing, scratch_table
from gleaner.llm.common import components, partitions, written
from gleaner.llm.simhash import links as simhash_links
from gleaner.llm.simhash import majority, shingle_hashes

BANDS, MINIMA = 40, 5
CHUNK = 1 << 13
#: Longs of a parity bitmap.
PARITY = 8
#: Members of the largest group that are compared with those outside, by round.
CENTRES = (1, 4, 8)
_RANDOM = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 64, (2, BANDS * MINIMA, 1), np.uint64)
_FLIP, _ODD = _RANDOM[0], _RANDOM[1] | np.uint64(1)


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Distinct 64-bit hashes of the text's word shingles, in order; a text of fewer words is one, one without words none."""
    return np.unique(shingle_hashes(text, size).astype(np.uint64))


def signature(hashes: np.ndarray) -> int:
    """A hash of the whole set, as a signed long."""
    return int(np.array([xxhash.xxh64_intdigest(hashes.tobytes(), 7)], np.uint64).view(np.int64)[0])


def bands(hashes: np.ndarray) -> np.ndarray:
    """The keys of a set, as signed longs; none for the empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), CHUNK):
        np.minimum(least, ((hashes[None, at : at + CHUNK] ^ _FLIP) * _ODD).min(axis=1), out=least)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least.reshape(BANDS, MINIMA))], np.uint64).view(np.int64)


def parity(hashes: np.ndarray) -> np.ndarray:
    """PARITY longs; a bit says whether an odd number of the set's hashes fall on it."""
    odd = np.bincount((hashes % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _sketched(docs: DataFrame, size: int) -> DataFrame:
    """The rows of docs with _row (a number), _sig, _fp (SimHash) and _bands."""
    schema = StructType([*docs.schema, *(StructField(c, LongType()) for c in ("_sig", "_fp")), StructField("_bands", ArrayType(LongType()))])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            new = {"_sig": [], "_fp": [], "_bands": []}
            for text in batch.column("text"):
                hashes = shingle_hashes(text.as_py(), size)
                found = np.unique(hashes.astype(np.uint64))
                for c, v in zip(new, (signature(found), int(np.array([majority(hashes)], np.uint64).view(np.int64)[0]), bands(found)), strict=True):
                    new[c].append(v)
            columns = [pa.array(new[f.name], f.type) if f.name in new else batch.column(f.name).cast(f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return docs.mapInArrow(run, schema).withColumn("_row", F.monotonically_increasing_id())


def _sets(texts: DataFrame, size: int) -> DataFrame:
    names = [f"p{i}" for i in range(PARITY)]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = [shingles(t.as_py(), size) for t in batch.column("text")[at : at + 256]]
                bits = np.array([parity(s) for s in sets]).reshape(-1, PARITY)
                columns = [pa.array([signature(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(bits[:, i]) for i in range(PARITY))], ["sig", "n", "hashes", *names])

    return texts.mapInArrow(run, "sig long, n int, hashes array<long>, " + ", ".join(f"{p} long" for p in names))


def _prefixes(sets: DataFrame, few: int, many: int) -> DataFrame:
    """The index: h, sig, n, place (how many of the set's shingles come before h) and the set's bitmap."""
    grams = sets.select("sig", F.explode("hashes").alias("h"))
    common = written(grams.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "common")
    held = grams.join(common, "h").groupBy("sig").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("held"))
    n = F.col("n")
    first = n - F.ceil(n * few / many).cast("int") + 1  # by integers below 2^53, so exact
    alone = n - F.size("held")
    index = sets.drop("hashes").join(held, "sig").withColumn("alone", alone)
    index = index.select("*", F.posexplode(F.slice("held", F.lit(1), F.greatest(F.lit(0), first - F.col("alone")))).alias("i", "x"))
    return index.select(F.col("x.h").alias("h"), "sig", "n", (F.col("alone") + F.col("i")).alias("place"), *(f"p{i}" for i in range(PARITY)))


def _possible(a: str, b: str, few: int, many: int) -> Column:
    """Whether rows a and b of the index, which meet under the first shingle they share, can be similar: bounds that no similar pair fails."""
    c = lambda t, x: F.col(f"{t}.{x}").cast("long")
    both = F.least(c(a, "n") - c(a, "place"), c(b, "n") - c(b, "place"))
    differ = sum((F.bit_count(F.col(f"{a}.p{i}").bitwiseXOR(F.col(f"{b}.p{i}"))) for i in range(PARITY)), F.lit(0))
    total, apart = c(a, "n") + c(b, "n"), c(a, "place") + c(b, "place")
    return (both * (many - few) >= apart * few) & (both * (many + few) >= total * few) & (differ * (many + few) <= total * (many - few))


def near_copies(docs: DataFrame, size: int = 5, parts: tuple[int, int] = (4, 5), radius: int = 2, centres: tuple[int, ...] = CENTRES) -> tuple[DataFrame, DataFrame]:
    """Groups of texts linked by steps of at least parts[0] / parts[1] (0.8) similarity; not for less, as the keys are laid for it.

    docs: text and any other columns. Returns docs with _row, a number of its own for each row, as a written table, and
    (_row, _component) for each, _component being a long that is equal within a group. Texts without words, null ones
    too, are one group; repeated rows share a group; a text of any length is compared whole; an empty table gives no
    rows; columns named _row, _sig, _fp, _bands and _component are not kept.
    """
    spark = docs.sparkSession
    docs = docs.drop("_row", "_sig", "_fp", "_bands", "_component")
    # texts move once: what joins them by _row later goes to their buckets
    rows = _bucketed(_sketched(docs, size), "_row", "sketches")
    with passing(spark) as keep:
        groups = written(_grouped(rows, size, parts, radius, centres), "groups")
        keep.append(newest())
    return rows.select(*docs.columns, "_row"), groups


def _bucketed(df: DataFrame, by: str, name: str) -> DataFrame:
    """df as a table in the shared folder that is dealt by a column, so that joins on it need not move it."""
    n, (table, path) = partitions(df.sparkSession), scratch_table(df.sparkSession, name)
    df.repartition(n, by).write.bucketBy(n, by).option("path", path).format("parquet").saveAsTable(table)
    return df.sparkSession.table(table)


def _grouped(rows: DataFrame, size: int, parts: tuple[int, int], radius: int, centres: tuple[int, ...]) -> DataFrame:
    """(_row, _component) of sketched rows."""
    few, many = parts
    distinct = written(rows.groupBy("_sig").agg(F.min("_row").alias("_row"), F.first("_fp").alias("fp"), F.first("_bands").alias("bands")), "distinct")
    keys = distinct.select("_sig", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    alive = keys.join(shared, "key", "left_semi").select("_sig").distinct()
    alive = written(distinct.join(alive, "_sig", "left_semi").select("_row", F.col("_sig").alias("sig"), "fp"), "alive")
    sets = _bucketed(_sets(rows.join(alive.select("_row"), "_row", "left_semi").select("text"), size), "sig", "sets")

    def linked(pairs: DataFrame) -> DataFrame:
        one, two = (sets.select(F.col("sig").alias(v), F.col("hashes").alias(h), F.col("n").cast("long").alias(f"n{v}")) for v, h in (("a", "x"), ("b", "y")))
        both = F.size(F.array_intersect("x", "y"))
        found = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(one, "a").join(two, "b")
        return found.where(both * (many + few) >= (F.col("na") + F.col("nb")) * few).select("a", "b")

    # SimHash: fingerprints within the radius, and sets that share one
    heads = alive.groupBy("fp").agg(F.min("sig").alias("a"))
    near = simhash_links(alive, radius).toDF("one", "two")
    near = near.join(heads.toDF("one", "a"), "one").join(heads.toDF("two", "b"), "two").select("a", "b")
    links = written(linked(near.union(alive.join(heads, "fp").where("sig <> a").select("a", F.col("sig").alias("b")))), "near")

    index = written(_prefixes(sets, few, many), "index")
    possible = _possible("x", "y", few, many)
    for turn, m in enumerate((*centres, 0)):
        found = components(links).toDF("sig", "c")
        placed = written(index.join(found, "sig", "left").withColumn("c", F.coalesce("c", "sig")), "placed")
        groups = placed.groupBy("h", "c").agg(F.count(F.lit(1)).alias("k")).groupBy("h").agg(F.max(F.struct("k", "c")).alias("main"), F.count(F.lit(1)).alias("groups"))
        opened = placed.join(groups.where("groups > 1").select("h", F.col("main.c").alias("main")), "h")
        outside = opened.where("c <> main").drop("main")
        if m:
            draw = lambda i: F.xxhash64("sig", F.lit(100 * turn + i)) if turn else F.col("place") / F.col("n")
            row = [F.struct(draw(i).alias("draw"), "sig") for i in range(m)]
            inside = opened.where("c = main").groupBy("h", "c").agg(F.array_distinct(F.array(*[F.min(r).getField("sig") for r in row])).alias("sigs"))
            inside = inside.select("h", "c", F.explode("sigs").alias("sig")).join(placed, ["h", "c", "sig"])
        else:
            inside = opened.drop("main")
        pairs = outside.alias("x").join(inside.alias("y"), (F.col("x.h") == F.col("y.h")) & (F.col("x.c") != F.col("y.c")) & possible)
        links = written(links.union(linked(pairs.select(F.col("x.sig").alias("a"), F.col("y.sig").alias("b")))), "near")
    found = components(links).toDF("_sig", "_component")
    return rows.select("_row", "_sig").join(found, "_sig", "left").select("_row", F.coalesce("_component", "_sig").alias("_component"))
