"""Repeated byte windows by a depth-limited radix sort of suffixes.

A suffix array orders all suffixes to their ends; to find strings of ``depth`` bytes that occur twice it is enough
to order them through that depth, and of an order only the groups of equal suffixes matter. The sort here goes by
most-significant-digit passes, and a pass deals out only what the pass before left tied:

* The first digit of a window is its *anchor*: of its 32-byte strings, the leftmost with the least hash. Equal
  windows hold equal anchors at equal offsets, and the windows that share one anchor are consecutive, so the digit
  of a whole run of windows is one row (about one for 70 bytes). Anchors that occur once drop out.
* Each further pass takes the runs still tied and cuts them into narrower intervals of offsets from the anchor
  (``widths``), whose *core*, the bytes common to all windows of the interval, is longer. Cores that occur once
  drop out. Where the whole *envelope* (every byte of the interval's windows) occurs twice, all its windows are
  repeated and are done; one representative of each distinct envelope goes on.
* The last pass has intervals of one window: its core is the window itself.

Digits are dealt as hashes, and are not the leading bytes that a textbook's sort deals: a row for each suffix would be
sixteen times the text for the first digit alone. The comparison that decides is by a 128-bit XXH3 of the bytes
themselves, with their length and offset; 64-bit polynomials of prefix sums only ever drop what is unique.

Skew: group sizes are counted with map-side partial aggregates, and members meet their group's count in a plain
equi-join of two written tables, which adaptive execution splits; no task gathers a group. Texts are shuffled once, into a bucketed table
in the shared folder that every later pass joins without moving it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.storage import scratch_table
from gleaner.llm.common import partitions, written

ANCHOR = 32
#: Bytes of text hashed at once; a longer document is hashed alone.
BATCH = 1 << 20
_SEED = 0x5EED
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(31))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(29))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


class _Powers:
    """Powers of the hash base and its inverse, grown as longer buffers come."""

    def __init__(self) -> None:
        self.table = np.random.default_rng(_SEED).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
        self.n = 0

    def upto(self, n: int) -> None:
        if n <= self.n:
            return
        self.n = max(n, 1 << 16)

        def powers(base: int) -> np.ndarray:
            a = np.full(self.n + 1, base, np.uint64)
            a[0] = 1
            return np.multiply.accumulate(a)

        self.up, self.down = powers(_BASE), powers(pow(_BASE, -1, 1 << 64))


_POWERS = _Powers()


class Buffer:
    """Texts laid end to end with prefix hashes, so that the hash of any slice is two lookups."""

    def __init__(self, texts: list[bytes]) -> None:
        self.lens = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(self.lens)
        self.base = self.ends - self.lens
        self.raw = b"".join(texts)
        self.bytes = np.frombuffer(self.raw, np.uint8)
        self.n = len(self.bytes)
        _POWERS.upto(self.n)
        self.prefix = np.zeros(self.n + 1, np.uint64)
        np.cumsum(_POWERS.table[self.bytes] * _POWERS.up[: self.n], out=self.prefix[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * _POWERS.down[start]

    def digests(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits over the bytes of each slice, as two halves."""
        raw, digest = self.raw, xxhash.xxh3_128_digest
        both = np.frombuffer(b"".join([digest(raw[s:e]) for s, e in zip(start.tolist(), end.tolist(), strict=True)]), "<u8").reshape(-1, 2)
        return both[:, 0], both[:, 1]

    def anchors(self, depth: int) -> tuple[np.ndarray, ...]:
        """Runs of windows with one anchor: (document, anchor, first start, last start, anchor's hash); positions in the buffer."""
        none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
        if self.n < depth:
            return none
        w, m, bits = depth - ANCHOR + 1, self.n - ANCHOR + 1, 32  # the same in every buffer, or the choice would differ
        h = _mix((self.prefix[ANCHOR:] - self.prefix[:-ANCHOR]) * _POWERS.down[:m])
        low = _U((1 << bits) - 1)
        v = (h & ~low) | np.arange(m, dtype=np.uint64)  # least hash, then leftmost
        v = np.concatenate([v, np.full(-m % w, 2**64 - 1, np.uint64)]).reshape(-1, w)
        ahead = np.minimum.accumulate(v, axis=1).ravel()
        behind = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
        ns = self.n - depth + 1
        at = (np.minimum(behind[:ns], ahead[w - 1 : w - 1 + ns]) & low).astype(np.int64)
        doc = np.repeat(np.arange(len(self.lens)), self.lens)[:ns]
        starts = np.flatnonzero(self.ends[doc] - np.arange(ns) >= depth)
        if not len(starts):
            return none
        at = at[starts]
        new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)])
        last = np.r_[new[1:], len(starts)] - 1
        return doc[starts[new]], at[new], starts[new], starts[last], h[at[new]]


def _batches(rows: Iterator, size: int = BATCH) -> Iterator[list]:
    """Lists of rows (bytes first) of about size bytes."""
    held, n = [], 0
    for row in rows:
        if held and n + len(row[0]) > size:
            yield held
            held, n = [], 0
        held.append(row)
        n += len(row[0])
    if held:
        yield held


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        columns = [batch.column(x) for x in names]
        for i in range(batch.num_rows):
            yield (columns[0][i].as_py() or b"", *(c[i].as_py() for c in columns[1:]))


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _first_digits(depth: int):
    """Each document's anchors: h, how often it has it, and the document's key."""

    def run(batches):
        for rows in _batches(_rows(batches, "bytes", "k", "doc_id")):
            buffer = Buffer([r[0] for r in rows])
            doc, _, _, _, h = buffer.anchors(depth)
            if not len(doc):
                continue
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])
            n = np.diff(np.r_[new, len(doc)])
            k, ids = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
            yield pa.RecordBatch.from_arrays(
                [_signed(h[new]), pa.array(n), pa.array(k[doc[new]]), pa.array(ids[doc[new]])], ["h", "n", "k", "doc_id"]
            )

    return run


NODE = "c long, e1 long, e2 long, k long, doc_id long, a long, lo int, hi int"


def _nodes(buffer: Buffer, rows: list, doc, a, lo, hi, width: int, depth: int) -> pa.RecordBatch:
    """Digits of intervals: anchor a (in the buffer), offsets lo..hi of the starts before it, aligned to width."""
    first = lo // width * width
    core_from, core_to = a - first, a - np.minimum(first + width, depth - ANCHOR + 1) + 1 + depth
    start, end = a - hi, a - lo + depth
    c = _mix(buffer.hash(core_from, core_to) + first.astype(np.uint64))
    tag = (lo.astype(np.uint64) << _U(32)) | hi.astype(np.uint64)
    one, two = buffer.digests(start, end)
    e1, e2 = one ^ _mix(tag), two + tag
    k, ids = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
    columns = [_signed(c), _signed(e1), _signed(e2), pa.array(k[doc]), pa.array(ids[doc]), pa.array(a - buffer.base[doc])]
    return pa.RecordBatch.from_arrays(
        [*columns, pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))],
        ["c", "e1", "e2", "k", "doc_id", "a", "lo", "hi"],
    )


def _tied_anchors(depth: int):
    """Intervals of the first pass: all offsets of each anchor whose hash occurs again somewhere."""

    def run(batches):
        for rows in _batches(_rows(batches, "bytes", "k", "doc_id", "tied")):
            buffer = Buffer([r[0] for r in rows])
            doc, a, s1, s2, h = buffer.anchors(depth)
            if not len(doc):
                continue
            tied = [np.array(r[3] or [], np.int64).view(np.uint64) for r in rows]
            of = np.repeat(np.arange(len(rows)), [len(t) for t in tied])
            tied = np.concatenate(tied)
            # a document's own set: a hash counts only together with the document's number
            keep = np.isin(_mix(h) ^ doc.astype(np.uint64), _mix(tied) ^ of.astype(np.uint64))
            doc, a, s1, s2 = doc[keep], a[keep], s1[keep], s2[keep]
            if len(doc):
                yield _nodes(buffer, rows, doc, a, a - s2, a - s1, depth - ANCHOR + 1, depth)

    return run


def _narrower(width: int, depth: int):
    """Intervals of at most width offsets of the given, wider ones."""

    def run(batches):
        for rows in _batches(_rows(batches, "bytes", "k", "doc_id", "nodes")):
            buffer = Buffer([r[0] for r in rows])
            doc = np.repeat(np.arange(len(rows)), [len(r[3]) for r in rows])
            a, lo, hi = (np.array([x[f] for r in rows for x in r[3]], np.int64) for f in ("a", "lo", "hi"))
            a = a + buffer.base[doc]
            parts = hi // width - lo // width + 1
            of = np.repeat(np.arange(len(a)), parts)
            j = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts) + (lo // width)[of]
            yield _nodes(
                buffer, rows, doc[of], a[of], np.maximum(lo[of], j * width), np.minimum(hi[of], (j + 1) * width - 1), width, depth
            )

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of half-open spans that overlap or touch."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _cut(batches):
    for batch in batches:
        out = []
        text, marks = batch.column("bytes"), batch.column("marks")
        for i in range(batch.num_rows):
            b, found = text[i].as_py() or b"", marks[i].as_py() or []
            runs = merged([(x["s"], x["e"]) for x in found])
            at, kept = 0, []
            for s, e in runs:
                kept.append(b[at:s])
                at = e
            kept = b"".join([*kept, b[at:]])
            out.append((len(b), len(b) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept, [list(r) for r in runs]))
        columns = list(zip(*out, strict=True)) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()),
                pa.array(columns[3], pa.string()), pa.array(columns[4], pa.binary()), pa.array(columns[5], pa.list_(pa.list_(pa.int64()))),
            ],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"],
        )


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<array<bigint>>"


def remove_repeats(docs: DataFrame, depth: int = 200, widths: tuple[int, ...] = (24, 4, 1)) -> DataFrame:
    """Remove each byte covered by a ``depth``-byte string that starts at two or more places of the corpus.

    docs: doc_id, text (other columns are ignored). Returns one row per input row: doc_id, n_bytes, n_removed,
    n_spans, kept_sha256, kept (the remaining bytes) and spans (removed [start, end) runs, in bytes).
    A null text counts as empty; texts shorter than depth are kept whole; repeated rows are separate places, so two
    equal rows of depth bytes or more lose every byte; a null doc_id stays null; an empty table gives no rows.
    depth must be at least 2 * 32 bytes; widths must each divide the one before and end in 1.
    """
    if depth < 2 * ANCHOR or widths[-1] != 1 or any(a % b for a, b in zip(widths, widths[1:], strict=False)):
        raise ValueError("depth must be 64 or more; widths must nest and end in 1")
    spark = docs.sparkSession
    # A row's key is its content: rows with one key are equal, and what holds for one holds for all.
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("bytes"))
    docs = docs.select("id", F.coalesce("id", F.lit(-1)).alias("doc_id"), F.xxhash64("id", "bytes").alias("k"), "bytes")
    key = ["k", "doc_id"]

    digits = docs.select("bytes", *key).mapInArrow(_first_digits(depth), "h long, n long, k long, doc_id long")
    twice = written(digits.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"), "twice")
    tied = digits.join(twice, "h", "left_semi").groupBy(*key).agg(F.collect_set("h").alias("tied"))

    n, (table, path) = partitions(spark), scratch_table(spark, "texts")
    held = docs.join(tied, key).repartition(n, *key)
    held.write.bucketBy(n, *key).option("path", path).format("parquet").saveAsTable(table)
    texts = spark.table(table)

    nodes = texts.select("bytes", *key, "tied").mapInArrow(_tied_anchors(depth), NODE)
    marks = []
    for level, width in enumerate((*widths, 0)):
        nodes = written(nodes, "digits")
        rep = F.struct("k", "doc_id", "a", "lo", "hi")
        classes = written(nodes.groupBy("c", "e1", "e2").agg(F.count(F.lit(1)).alias("n"), F.min(rep).alias("rep")), "ties")
        again = nodes.join(classes.where("n > 1").select("c", "e1", "e2"), ["c", "e1", "e2"], "left_semi")
        marks.append(again.select(*key, (F.col("a") - F.col("hi")).alias("s"), (F.col("a") - F.col("lo") + depth).alias("e")))
        if not width:
            break
        several = written(classes.groupBy("c").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("c"), "several")
        reps = classes.join(several, "c", "left_semi").select("rep.*").groupBy(*key).agg(F.collect_list(F.struct("a", "lo", "hi")).alias("nodes"))
        nodes = texts.select("bytes", *key).join(reps, key).select("bytes", *key, "nodes").mapInArrow(_narrower(width, depth), NODE)
    found = marks[0]
    for m in marks[1:]:
        found = found.union(m)
    # a set: all of several equal rows have one key, and each brings the same marks
    found = found.groupBy(*key).agg(F.collect_set(F.struct("s", "e")).alias("marks"))
    cut = texts.select("bytes", *key, "id").join(found, key, "left").select("bytes", F.col("id").alias("doc_id"), "marks").mapInArrow(_cut, RESULT)
    # documents without any tied anchor have nothing to remove
    return cut.unionByName(_untouched(docs, texts, key))


def _untouched(docs: DataFrame, texts: DataFrame, key: list[str]) -> DataFrame:
    clean = docs.select(*key, "id", F.sha2("bytes", 256).alias("kept_sha256"), F.octet_length("bytes").cast("long").alias("n_bytes"), "bytes")
    clean = clean.join(texts.select(*key).distinct(), key, "left_anti")
    zero = F.lit(0).cast("long")
    return clean.select(
        F.col("id").alias("doc_id"), "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), "kept_sha256",
        F.col("bytes").alias("kept"), F.array().cast("array<array<bigint>>").alias("spans"),
    )
