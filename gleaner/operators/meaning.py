"""Results of one meaning in long lists, where no task may hold a list.

Going through a list in order, a result that is like a kept one is dropped, or takes its place where it is of more use.
Results are alike by the cosine of their vectors, or, where one side has none, by their shared tokens.

A list whose results all have vectors is decided by blocks: what a place is compared by, its first result's vector,
never changes. So the first rows of a list settle among themselves, in one task; all later rows meet
the places that this made, in a scan that keeps one number a row; those without a place go on, and the next block
is the first of them. A block is bounded by its bytes, and a round drops every row like one of its places, however many
there are. Which result a place ends with is a maximum.

Where some results have no vector, a place's tokens change with its result, and order matters beyond that. Results that
cannot come to be compared fall apart into components of a graph of candidates; in each, runs of equal results are drawn together, and what is
left is gone through in order, many components a task. A component of different results that are alike in a chain is one task's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.graph import components
from gleaner.functions.storage import written
from gleaner.operators.dataset import dense_positions

#: Bytes of the vectors that a block's places may take, and rows compared at once.
BLOCK_BYTES, ROWS = 16 << 20, 256
#: Results that one task goes through, and those of a block in which all vectors are compared.
PIECE, GRID = 200_000, 8_192


def unit(vectors) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: places of the vectors that have it, and those vectors at length 1, or 0."""
    by: dict[int, list[int]] = {}
    for at, v in enumerate(vectors):
        if v is not None and len(v):
            by.setdefault(len(v), []).append(at)
    out = {}
    for dim, at in by.items():
        m = np.array([vectors[i] for i in at], np.float64)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        out[dim] = np.array(at), np.divide(m, n, out=np.zeros_like(m), where=n > 0)
    return out


def _first(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """For each row of a the first of b that is like it; -1 for none."""
    if not len(b):
        return np.full(len(a), -1)
    hit = a @ b.T >= threshold
    return np.where(hit.any(axis=1), hit.argmax(axis=1), -1)


def lead(v: np.ndarray, vectors: np.ndarray, threshold: float) -> np.ndarray:
    """The place of each row of one length, in order: the first kept one like it, or its own."""
    place, kept = np.empty(len(v), np.int64), np.zeros(0, np.int64)
    for s in range(0, len(v), ROWS):
        chunk = vectors[s : s + ROWS]
        first, among = _first(chunk, vectors[kept], threshold), chunk @ chunk.T >= threshold
        new: list[int] = []
        for i in range(len(chunk)):
            if first[i] >= 0:
                place[s + i] = v[kept[first[i]]]
                continue
            near = [j for j in new if among[i, j]]
            place[s + i] = v[s + near[0]] if near else v[s + i]
            if not near:
                new.append(i)
        kept = np.concatenate([kept, s + np.array(new, np.int64)])
    return place


def _leaders(threshold: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v").reset_index(drop=True)
        v, place = pdf["v"].to_numpy(), pdf["v"].to_numpy().copy()
        for at, m in unit(pdf["vec"].tolist()).values():
            place[at] = lead(v[at], m, threshold)
        return pdf.assign(place=place)[["v", "list", "place"]]

    return run


def _followers(held: dict[int, tuple[int, dict[int, tuple[np.ndarray, np.ndarray]]]], threshold: float):
    """Rows behind the block of their list, with the place they have; null for none. held: by list the last of the block, and its places by the vectors' length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, of = batch.column("v").to_numpy(), batch.column("list").to_numpy()
            place = np.full(len(v), -1, np.int64)
            later = np.array([x > held[k][0] if k in held else True for x, k in zip(v.tolist(), of.tolist(), strict=True)], bool)
            vectors = batch.column("vec").to_pylist()
            for k in set(of[later].tolist()) & set(held):
                rows = np.flatnonzero(later & (of == k))
                for dim, (at, m) in unit([vectors[i] for i in rows]).items():
                    if dim not in held[k][1]:
                        continue
                    names, block = held[k][1][dim]
                    for s in range(0, len(at), ROWS):
                        first = _first(m[s : s + ROWS], block, threshold)
                        place[rows[at[s : s + ROWS]]] = np.where(first >= 0, names[first], -1)
            found = pa.array(place, mask=place < 0)
            out = pa.RecordBatch.from_arrays([batch.column("v"), batch.column("list"), batch.column("vec"), found], ["v", "list", "vec", "place"])
            yield out.filter(pa.array(later))

    return run


def by_vectors(rows: DataFrame, threshold: float, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """v, place of rows (v, list, vec) that all have vectors. v numbers them in order, a list's rows behind each other."""
    left, parts = written(rows.select("v", "list", F.col("vec").cast("array<double>").alias("vec")), "vectors"), []
    while True:
        state = left.agg(F.count_distinct("list").alias("lists"), F.max(F.size("vec")).alias("dim")).first()
        if not state["lists"]:
            break
        size = max(1, block_bytes // (8 * state["dim"] * state["lists"]))
        place = F.row_number().over(Window.partitionBy("list").orderBy("v"))
        front = written(left.withColumn("n", place).where(F.col("n") <= size).drop("n"), "front")
        led = written(front.groupBy("list").applyInPandas(_leaders(threshold), "v long, list long, place long"), "led")
        last = {r["list"]: r["last"] for r in front.groupBy("list").agg(F.max("v").alias("last")).collect()}
        # the places of all blocks together are bounded by block_bytes
        kept = front.join(led.where("v = place").select("v"), "v", "left_semi").orderBy("v").collect()
        held = {}
        for k, end in last.items():
            own = [r for r in kept if r["list"] == k]
            held[k] = end, {dim: (np.array([own[i]["v"] for i in at], np.int64), m) for dim, (at, m) in unit([r["vec"] for r in own]).items()}
        met = written(left.mapInArrow(_followers(held, threshold), "v long, list long, vec array<double>, place long"), "met")
        parts += [led.select("v", "place"), met.where("place is not null").select("v", "place")]
        left = met.where("place is null").select("v", "list", "vec")
    out = parts[0] if parts else rows.select("v", F.col("v").alias("place")).where("false")
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# -- lists in which some results have no vector -----------------------------------------------


def _linked(rows: DataFrame, threshold: float) -> DataFrame:
    """a, b: enough pairs of distinct vectors of a list at that cosine to connect all that are connected, from rows (v, list, vec)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("v").reset_index(drop=True)
        v, out = pdf["v"].to_numpy(), []
        for at, m in unit(pdf["vec"].tolist()).values():
            parent = list(range(len(at)))

            def root(x: int, parent: list[int] = parent) -> int:
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                return x

            for s in range(0, len(at), ROWS):
                for i, j in zip(*np.nonzero(m[s : s + ROWS] @ m[s:].T >= threshold), strict=True):
                    x, y = root(s + int(i)), root(s + int(j))
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                        out.append((v[at[x]], v[at[y]]))
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    size = rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / GRID).cast("int").alias("blocks"))
    blocks = rows.join(size, "list").withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    # each pair of blocks is a task; a block goes to as many as there are
    with_ = blocks.select("v", "list", "vec", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return with_.groupBy("list", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q")).applyInPandas(lambda pdf: run(pdf[["v", "vec"]]), "a long, b long")


def _sharing(rows: DataFrame, least: float) -> DataFrame:
    """a, b: pairs of rows (v, list, tokens), distinct sets of a list, whose Jaccard is at least that: they share one of their rarest tokens (prefix filter)."""
    size = F.size("tokens")
    each = rows.select("v", "list", size.alias("size"), F.explode("tokens").alias("token"))
    rare = each.groupBy("list", "token").agg(F.count(F.lit(1)).alias("n"))
    ranked = each.join(rare, ["list", "token"]).groupBy("v", "list", "size").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("t"))
    prefix = ranked.select("v", "list", "size", F.explode(F.slice("t", F.lit(1), (F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1).cast("int"))).alias("x"))
    prefix = written(prefix.select("v", "list", "size", "x.token"), "prefix")
    p, q = prefix.alias("p"), prefix.alias("q")
    near = (
        (F.col("p.list") == F.col("q.list")) & (F.col("p.token") == F.col("q.token")) & (F.col("p.v") < F.col("q.v"))
        & (F.least("p.size", "q.size") >= least * F.greatest("p.size", "q.size") - 1e-9)
    )
    pairs = p.join(q, near).select(F.col("p.v").alias("a"), F.col("q.v").alias("b")).distinct()
    sides = [rows.select(F.col("v").alias(x), F.col("tokens").alias(f"t{x}")) for x in "ab"]
    both = F.size(F.array_intersect("ta", "tb"))
    return pairs.join(sides[0], "a").join(sides[1], "b").where(both / (F.size("ta") + F.size("tb") - both) >= least).select("a", "b")


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by component and number: of neighbours that are equal and like themselves the first, with the best of them."""
    for pdf in batches:
        new = (pdf["class"] != pdf["class"].shift()) | (pdf["component"] != pdf["component"].shift()) | ~pdf["alike"]
        run = new.cumsum()
        best = pdf.assign(run=run).sort_values(["run", "free", "size", "long", "v"], ascending=[True, False, False, False, True]).drop_duplicates("run")
        out = pdf[new].reset_index(drop=True)
        for c in ("free", "size", "long"):
            out[c] = best[c].to_numpy()
        out["best"] = best["v"].to_numpy()
        yield out


ENTRY = "v long, component long, class long, vec array<double>, tokens array<string>, alike boolean, free boolean, size long, long long, best long"


def in_order(rows: DataFrame, threshold: float, shared: float, kept_by: Callable, piece: int = PIECE) -> DataFrame:
    """place, best of rows (v, list, vec, tokens, free, size, long), some without a vector: the places, and the row that each ends with. kept_by makes the state of a list."""
    equal = rows.groupBy("list", "tokens", "vec").agg(F.min("v").alias("class"))
    equal = written(equal, "equal")
    sets = equal.where(F.size("tokens") > 0).groupBy("list", "tokens").agg(F.min("class").alias("v"))
    vectors = equal.where(F.size("vec") > 0).groupBy("list", "vec").agg(F.min("class").alias("v"))
    same = lambda df, on: equal.join(df, on).select(F.col("class").alias("a"), F.col("v").alias("b"))
    edges = _sharing(written(sets, "sets"), shared).unionByName(_linked(written(vectors, "vectors"), threshold))
    edges = written(edges.unionByName(same(sets, ["list", "tokens"])).unionByName(same(vectors, ["list", "vec"])), "candidates")
    found = components(edges)
    of = equal.join(found, equal["class"] == found["v"], "left").select("list", "tokens", "vec", "class", F.coalesce("c", "class").alias("component"))
    has = F.size(F.coalesce("vec", F.array().cast("array<double>"))) > 0
    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    alike = F.when(has, F.coalesce((norm > 0) & ~F.isnan(norm) & F.lit(threshold <= 1), F.lit(False))).otherwise(F.size("tokens") > 0)
    keys = rows["list"].eqNullSafe(of["list"]) & rows["tokens"].eqNullSafe(of["tokens"]) & rows["vec"].eqNullSafe(of["vec"])
    told = rows.join(of.withColumn("alike", alike), keys).select(rows["v"], "component", "class", rows["vec"], rows["tokens"], "alike", "free", "size", "long", rows["v"].alias("best"))
    entries = written(told.orderBy("component", "v").mapInPandas(_runs, ENTRY), "entries")
    parts = max(1, -(-entries.count() // piece))

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, one in pdf.groupby("component", sort=False):
            one = one.sort_values("v")
            state, places, use = kept_by(), [], []
            for v, vec, words, best, *value in zip(one["v"], one["vec"], one["tokens"], one["best"], one["free"], one["size"], one["long"], strict=True):
                u = next(iter(unit([vec]).values()))[1][0] if vec is not None and len(vec) else None
                hit = state.first_like(frozenset(words), u)
                if hit is None:
                    state.add(frozenset(words), u)
                    places.append([v, best])
                    use.append(value)
                elif value > use[hit]:
                    state.renew(hit, frozenset(words))
                    places[hit][1], use[hit] = best, value
            out += places
        return pd.DataFrame(out, columns=["place", "best"], dtype=np.int64)

    return entries.withColumn("part", F.pmod(F.xxhash64("component"), F.lit(parts))).groupBy("part").applyInPandas(go, "place long, best long")


def drop_in_long_lists(rows: DataFrame, column: str | None, threshold: float, shared: float, kept_by: Callable, block_bytes: int = BLOCK_BYTES, piece: int = PIECE) -> DataFrame:
    """rows (results with _list and _tokens), without those that mean what an earlier one of their list does, as a table with _pos of the place."""
    names = [c for c in rows.columns if c not in ("_list", "_tokens")]
    numbered = written(dense_positions(rows.withColumnRenamed("_pos", "_place"), "_list", "_place").withColumnRenamed("_pos", "_v"), "numbered")
    first = numbered.groupBy("_list").agg(F.min("_v").alias("_first"))
    vec = F.when(F.size(column) > 0, F.col(column).cast("array<double>")) if column else F.lit(None).cast("array<double>")
    free, size = F.col("direct_url").isNotNull() | F.col("magnet").isNotNull(), F.coalesce("size_bytes", F.lit(0)).cast("long")
    flat = numbered.join(first, "_list").select(
        F.col("_v").alias("v"), F.col("_first").alias("list"), vec.alias("vec"), F.col("_tokens").alias("tokens"), free.alias("free"), size.alias("size"),
        F.coalesce(F.length("title"), F.lit(0)).cast("long").alias("long"),
    )
    flat = written(flat, "flat")
    mixed = written(flat.where("vec is null").select("list").distinct(), "mixed")
    placed = by_vectors(flat.join(mixed, "list", "left_anti"), threshold, block_bytes)
    best = F.max(F.struct("free", "size", "long", (-F.col("v")).alias("v"))).alias("b")
    ends = placed.join(flat.select("v", "free", "size", "long"), "v").groupBy("place").agg(best).select("place", (-F.col("b.v")).alias("best"))
    if not mixed.isEmpty():
        ends = ends.unionByName(in_order(flat.join(mixed, "list", "left_semi"), threshold, shared, kept_by, piece))
    at = numbered.select(F.col("_v").alias("place"), F.col("_place").alias("_pos"))
    out = ends.join(at, "place").join(numbered.withColumnRenamed("_v", "best"), "best")
    return out.select(*names)
