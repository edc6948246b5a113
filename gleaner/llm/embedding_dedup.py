"""Near-duplicate embeddings by Euclidean p-stable hashing, with exact cosine checks.

Vectors are normalised; two with cosine c lie sqrt(2 - 2 c) apart. A table's bucket is the list of ``width``-quantised
offsets along ``projections`` Gaussian directions, so near vectors often share one; ``tables`` independent tables make
it nearly certain that a pair at the threshold shares one somewhere (see miss_rate). All vectors are indexed. What
shares a bucket, and the label, is compared exactly, in double precision.

Directions grow with the logarithm of the most vectors that a label has, so that unrelated vectors seldom meet, and
tables with a small power of it (0.23 at cosine 0.93), so that no more pairs are missed (see layout). Buckets are
found from ids and codes alone; a vector is fetched only for buckets that it shares.

Equal vectors are one class with a multiplicity, and are never compared. Pairs are never rows: a bucket is compared in
blocks, and gives each class its number of links and the links of a spanning forest. A pair that shares buckets in
several tables is counted in the first. A bucket of more than ``block`` classes is cut into parts, and each pair of
parts is its own piece of work, so no task holds a bucket.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import components, partitions, written


def agree_rate(cosine: float, width: float) -> float:
    """Probability that two unit vectors of that cosine have one quantised offset along a direction."""
    c = math.sqrt(2 - 2 * cosine)
    if c == 0:
        return 1.0
    r = width / c
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def miss_rate(cosine: float, width: float, projections: int, tables: int) -> float:
    """Probability that two unit vectors of that cosine share a bucket in no table."""
    return (1 - agree_rate(cosine, width) ** projections) ** tables


def layout(n: int, cosine: float, width: float, missed: float = 2e-4, mates: float = 0.1) -> tuple[int, int]:
    """Projections and tables for n vectors: one meets mates unrelated (orthogonal) ones in a table, and a pair at the cosine is missed less often than missed."""
    projections = max(4, math.ceil(math.log(max(n, 2) / mates) / -math.log(agree_rate(0.0, width))))
    found = agree_rate(cosine, width) ** projections
    return projections, 1 if found >= 1 else max(1, math.ceil(math.log(missed) / math.log1p(-found)))


class _Hash:
    """Codes of vectors, one for each table."""

    def __init__(self, width: float, projections: int, tables: int, seed: int) -> None:
        self.width, self.projections, self.tables, self.seed = width, projections, tables, seed
        self.mixer = np.random.default_rng(seed).integers(1, 2**63, projections, dtype=np.uint64) | np.uint64(1)
        self.planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def codes(self, x: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
        """Codes of the vectors in the tables from first to last."""
        dim, last = x.shape[1], self.tables if last is None else min(last, self.tables)
        if dim not in self.planes:
            rng = np.random.default_rng([self.seed, dim])
            n = self.tables * self.projections
            self.planes[dim] = rng.standard_normal((dim, n)), rng.uniform(0, self.width, n)
        a, b = (y[..., first * self.projections : last * self.projections] for y in self.planes[dim])
        out = np.zeros((len(x), last - first), np.int64)
        for at in range(0, len(x), 256):
            cells = np.floor((_unit(x[at : at + 256]) @ a + b) / self.width).astype(np.int64).view(np.uint64)
            cells = cells.reshape(-1, last - first, self.projections)
            h = np.zeros(cells.shape[:2], np.uint64)
            for j in range(self.projections):
                h = (h ^ cells[:, :, j]) * self.mixer[j]
                h ^= h >> np.uint64(29)
            out[at : at + 256] = h.view(np.int64)
        return out

    def first(self, x: np.ndarray, i: np.ndarray, j: np.ndarray, t: np.ndarray, step: int = 16) -> np.ndarray:
        """Whether the pairs of rows (i, j) share a bucket in no table before t; some tables at a time, as near pairs mostly share an early one."""
        out, left = np.ones(len(i), bool), np.arange(len(i))
        for at in range(0, self.tables, step):
            left = left[out[left] & (t[left] > at)]
            if not len(left):
                break
            rows, place = np.unique(np.r_[i[left], j[left]], return_inverse=True)
            codes, tables = self.codes(x[rows], at, at + step), np.arange(at, min(at + step, self.tables))
            a, b = place[: len(left)], place[len(left) :]
            for s in range(0, len(left), 1 << 14):
                some = slice(s, s + (1 << 14))
                out[left[some]] = ~((codes[a[some]] == codes[b[some]]) & (tables < t[left[some], None])).any(axis=1)
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _vectors(lists: pa.ListArray) -> np.ndarray:
    """Lists of equal length as rows, in double precision."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _codes(hash_: _Hash):
    def run(batches):
        for batch in batches:
            lists = batch.column("embedding")
            sizes = np.diff(lists.offsets.to_numpy())
            out: list = [None] * batch.num_rows
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                for i, row in zip(at, hash_.codes(_vectors(lists.take(pa.array(at)))), strict=True):
                    out[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()))], [*batch.schema.names, "codes"])

    return run


class _Forest:
    def __init__(self, n: int) -> None:
        self.root = list(range(n))

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.root[max(i, j)] = min(i, j)
        return i != j


def _pairs(group: np.ndarray, apart: np.ndarray, part: np.ndarray, x: np.ndarray, threshold: float):
    """Linked rows (i, j), i < j, of one group each; where apart, only of different parts. Small groups all at once, large ones in blocks."""
    ends = np.r_[np.flatnonzero(np.diff(group)) + 1, len(group)]
    starts = np.r_[0, ends[:-1]]
    many = ends - starts > 64
    for s, e in zip(starts[many].tolist(), ends[many].tolist(), strict=True):
        for at in range(s, e, 512):
            cos = x[at : min(at + 512, e)] @ x[s:e].T
            i, j = np.nonzero(cos >= threshold)
            i, j = i + at, j + s
            keep = (i < j) & (~apart[i] | (part[i] != part[j]))
            yield i[keep], j[keep]
    few = np.flatnonzero(~many[np.searchsorted(ends, np.arange(len(group)), "right")])
    for d in range(1, 64):
        few = few[few + d < len(group)]
        few = few[group[few] == group[few + d]]
        if not len(few):
            break
        i, j = few, few + d
        keep = ~apart[i] | (part[i] != part[j])
        i, j = i[keep], j[keep]
        hit = np.einsum("nd,nd->n", x[i], x[j]) >= threshold
        yield i[hit], j[hit]


GROUP = ("label", "dim", "t", "b", "part_a", "part_b")


def _linked(threshold: float, hash_: _Hash):
    """Of rows sorted by group: (v, n) a class and links found for it, or (v, w) a link between classes."""

    def out(table: pa.Table):
        table = table.combine_chunks()
        number = lambda c: table.column(c).to_numpy()
        for dim in np.unique(number("dim")):
            mine = table.filter(pa.compute.equal(table.column("dim"), int(dim))) if table.num_rows and (number("dim") != dim).any() else table
            yield from _found(mine.combine_chunks(), threshold, hash_)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n < 20_000:
                continue
            table = pa.Table.from_batches(held)
            key = _group_key(table)
            last = int(np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[-1])  # the last group may go on
            if last:
                yield from out(table.slice(0, last))
                held, n = table.slice(last).to_batches(), n - last
        if held:
            yield from out(pa.Table.from_batches(held))

    return run


def _group_key(table: pa.Table) -> np.ndarray:
    """A number for each run of rows with one group."""
    new = np.zeros(table.num_rows, bool)
    for c in GROUP:
        codes = table.column(c).combine_chunks()
        codes = codes.dictionary_encode().indices.to_numpy() if pa.types.is_string(codes.type) else codes.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(new)


def _found(table: pa.Table, threshold: float, hash_: _Hash):
    number = lambda c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False)
    group, part, t, m, v = _group_key(table), number("part"), number("t"), number("m"), number("v")
    apart = number("part_a") != number("part_b")  # two parts meet here, and each part meets itself elsewhere
    x = _vectors(table.column("embedding").combine_chunks())
    unit = _unit(x)
    links = np.zeros(len(v), np.int64)
    forest, edges = _Forest(len(v)), []
    for i, j in _pairs(group, apart, part, unit, threshold):
        # a pair counts in the first table that has it in one bucket, and is joined there
        first = hash_.first(x, i, j, t[i])
        i, j = i[first], j[first]
        np.add.at(links, i, m[j])
        np.add.at(links, j, m[i])
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            if forest.join(a, b):
                edges.append((a, b))
    some = np.flatnonzero(links)
    a, w = np.array([v[a] for a, _ in edges], np.int64), np.array([v[b] for _, b in edges], np.int64)
    if len(some) or len(a):
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[v[some], a]), pa.array(np.r_[links[some], np.zeros(len(a), np.int64)]), pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(w)])], ["v", "n", "w"]
        )


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.93, width: float = 2.0, projections: int | None = None, tables: int | None = None, block: int = 512, seed: int = 5
) -> DataFrame:
    """Links between vectors with equal labels and cosine of at least threshold, and what they connect.

    vectors: vec_id, embedding (array of numbers), label; other columns are ignored. Returns one row per input row:
    vec_id, n_links (other vectors linked directly, copies included), component_id (smallest vec_id reachable) and
    kept (vec_id is the component's). A vector that is null, empty, zero, or holds a null or non-finite number, or
    whose label is null, links with nothing. Vectors of different lengths never link. Repeated rows are separate
    vectors that link with each other; an empty table gives no rows. projections and tables are those of layout()
    unless given: a pair at the threshold is missed with probability below 0.0002, nearer pairs more rarely.
    """
    spark = vectors.sparkSession
    # single precision is carried as such, and compared in double
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"), F.col("label").cast("string").alias("label"))
    e = F.col("embedding")
    sound = F.coalesce(
        F.col("label").isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0),
        F.lit(False),
    )
    rows = written(rows.select("vec_id", "label", "embedding", F.xxhash64("embedding", "label").alias("h"), sound.alias("sound")), "vectors")
    of = ["label", "h", "embedding"]
    classes = rows.where("sound").groupBy(*of).agg(F.count(F.lit(1)).alias("m"), F.min("vec_id").alias("least"))
    classes = classes.withColumn("v", F.coalesce("least", "h"))
    classes = written(classes, "classes")
    most = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if projections is None or tables is None:
        projections, tables = layout(most, threshold, width)
    hash_ = _Hash(width, projections, tables, seed)
    # buckets, from ids and codes alone
    codes = classes.select("label", "embedding", "h", "v").mapInArrow(_codes(hash_), f"label string, embedding array<{kind}>, h long, v long, codes array<long>")
    codes = written(codes.select("label", F.size("embedding").alias("dim"), "h", "v", "codes"), "codes")
    bucket = ["label", "dim", "t", "b"]
    cells = codes.select("label", "dim", "h", "v", F.posexplode("codes").alias("t", "b"))
    crowds = written(cells.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    parts = F.ceil(F.col("n") / block).cast("int")
    shared = cells.join(crowds, bucket).withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("v"), "parts").cast("int"))
    shared = shared.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    shared = shared.withColumn("part_a", F.least("part", "other")).withColumn("part_b", F.greatest("part", "other"))
    # then the vectors that share one
    shared = written(shared.select(*GROUP, "part", "h", "v"), "shared")
    work = shared.join(classes.select("label", "h", "v", "m", "embedding"), ["label", "h", "v"])
    work = work.select(*GROUP, "part", "v", "m", "embedding").repartition(partitions(spark), *GROUP).sortWithinPartitions(*GROUP, "v")
    found = written(work.mapInArrow(_linked(threshold, hash_), "v long, n long, w long"), "links")
    group = components(found.where("w is not null").select(F.col("v").alias("a"), F.col("w").alias("b")))
    counts = found.groupBy("v").agg(F.sum("n").alias("n"))
    named = classes.join(counts, "v", "left").join(group, "v", "left")
    named = written(
        named.select(*of, (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("c", "v").alias("component_id")), "named"
    )
    alone = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = rows.where("sound").join(named, of).select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
