"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints that differ in at most ``radius`` bits, cut into radius // 2 + 1 segments, have a segment in which they
differ by one bit at most. So each fingerprint is indexed under its segments as they are, and under every segment
with one bit made a wildcard; an equality join of the index with itself gives the candidates, and the bit count of
the whole difference decides. A wildcard key joins those with the bit clear to those with the bit set, so a pair
that agrees in a segment meets there once, under the exact key.

Only distinct fingerprints are indexed: copies share one, and are never paired. A key that more than ``crowd``
fingerprints share is refined: the bits outside the segment differ by r bits at most, so of r + 1 parts of them one is
equal, and that part joins the key. Counting the keys is a pre-aggregated groupBy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import components, partitions, written

CHUNK = 1 << 16


def shingle_hashes(text: str | None, shingle: int = 3) -> np.ndarray:
    """XXH64 of the text's word shingles in order, repeats included; of fewer words the whole sequence; none without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # of bytes: A-Z only, and the six ASCII blanks
    if not words:
        return np.zeros(0, "<u8")
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1][:n].tolist()
    ends = (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts, ends, strict=True)), "<u8", n)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of the hashes: a bit is 1 if set in over half of them; 0 for none."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        count += np.unpackbits(hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of the text's word shingles, each weighed by its repeats; 0 for a text without words."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (the SimHash as a signed long) for each row of docs (doc_id, text)."""

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _parts(bits: list[int], n: int) -> list[int]:
    """Masks of n nearly equal runs of the given bits."""
    return [_signed(sum(1 << b for b in bits[i * len(bits) // n : (i + 1) * len(bits) // n])) for i in range(n)]


def _index(fps: DataFrame, radius: int) -> DataFrame:
    """Rows (tag, key, side, fp): a tag is a segment, or one wildcard bit of it; side 0 joins side 1."""
    keys, fp = [], F.col("fp")
    m = radius // 2 + 1
    for s in range(m):
        bits = list(range(64 * s // m, 64 * (s + 1) // m))
        mask = _signed(sum(1 << b for b in bits))
        row = lambda tag, key, side: F.struct(F.lit(tag).alias("tag"), key.alias("key"), side.alias("side"))
        keys += [row(64 + s, fp.bitwiseAND(F.lit(mask)), F.lit(0)), row(64 + s, fp.bitwiseAND(F.lit(mask)), F.lit(1))]
        for b in bits:
            one = F.lit(_signed(1 << b))
            keys.append(row(b, fp.bitwiseAND(F.lit(_signed((mask % (1 << 64)) & ~(1 << b)))), (fp.bitwiseAND(one) != 0).cast("int")))
    return fps.select("fp", F.explode(F.array(*keys)).alias("x")).select("x.tag", "x.key", "x.side", "fp")


def _refined(index: DataFrame, radius: int, crowd: int) -> DataFrame:
    """The index with a column part: null, or in a crowded key one of the parts of the other bits, of which one is equal."""
    sides = index.groupBy("tag", "key").agg(F.sum(F.col("side")).alias("ones"), F.count(F.lit(1)).alias("n"))
    crowded = sides.where((F.col("n") > crowd) & (F.col("ones") > 0) & (F.col("ones") < F.col("n"))).select("tag", "key", F.lit(True).alias("crowded"))
    m = radius // 2 + 1
    part: Column | None = None
    for s in range(m):
        inside = range(64 * s // m, 64 * (s + 1) // m)
        outside = [b for b in range(64) if b not in inside]
        for tags, left in ((F.col("tag") == 64 + s, radius), ((F.col("tag") >= inside[0]) & (F.col("tag") <= inside[-1]), radius - 1)):
            cut = F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(x)).alias("v")) for i, x in enumerate(_parts(outside, left + 1))])
            part = F.when(tags, cut) if part is None else part.when(tags, cut)
    whole = F.array(F.struct(F.lit(-1).alias("i"), F.lit(0).cast("long").alias("v")))
    return index.join(crowded, ["tag", "key"], "left").select("tag", "key", "side", "fp", F.explode(F.when(F.col("crowded"), part).otherwise(whole)).alias("part"))


def links(fps: DataFrame, radius: int = 2, crowd: int = 512) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints of fps (fp) that differ in 1 to radius bits; every such pair, once."""
    # distinct fingerprints are few bytes, but each gives many variants: spread them over all tasks first; by a hash,
    # as dealt by fp alone they would keep the few partitions that adaptive execution made of them
    fps = fps.select("fp").distinct().repartition(partitions(fps.sparkSession), F.xxhash64("fp"))
    index = written(_refined(_index(fps, radius), radius, crowd), "variants")
    by = ["tag", "key", "part"]
    left = index.where("side = 0").select(*by, F.col("fp").alias("a"))
    right = index.where("side = 1").select(*by, F.col("fp").alias("b"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    near = (F.bit_count(differ) <= radius) & (differ != 0) & ((F.col("tag") < 64) | (F.col("a") < F.col("b")))
    return left.join(right, by).where(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """Groups of documents whose SimHash fingerprints are linked by steps of at most radius differing bits.

    docs: doc_id, text (other columns are ignored). Returns one row per input row: doc_id, fp (signed long),
    fingerprint (16 lowercase hex digits) and component_id, the smallest doc_id of the group. Texts without words,
    null ones too, have fingerprint zero and link like any other. Repeated rows share a group; a null doc_id keeps
    its row and never names a group unless the group has no other; an empty table gives no rows.
    """
    rows = written(fingerprints(docs, shingle), "fingerprints")
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(fps, radius))
    of = fps.join(found, fps.fp == found.v, "left").select("fp", "least", F.coalesce("c", "fp").alias("c"))
    named = of.groupBy("c").agg(F.min("least").alias("component_id"))
    group = of.join(named, "c").select("fp", "component_id")
    return rows.join(group, "fp").select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
