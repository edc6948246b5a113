"""Search results: dropping repeats, ranking by use, and by meaning.

Results have _pos and, where they answer several queries, a column that says which (by). A query's results are mostly a short
list, at most its limit from each source, which one task goes through in order; longer ones are resolved by operators/meaning.py.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import scalar as sc
from gleaner.functions import text as tx
from gleaner.functions.storage import written
from gleaner.operators.meaning import drop_in_long_lists

SCHEMA = (
    "title string, url string, kind string, provider string, snippet string, direct_url string, magnet string, size_bytes long, mime_type string, "
    "format string, duration_sec long, published string, author string, license string, extra map<string,string>, _pos long"
)
SAME_MEANING, SAME_TOKENS, DEFAULT_LIMIT = 0.86, 0.82, 50
#: Results of a list that one task goes through.
LIST = 20_000


def is_downloadable() -> Column:
    return F.col("direct_url").isNotNull() | F.col("magnet").isNotNull()


def fingerprint() -> Column:
    """The text that stands for a result: title, author and format."""
    return tx.trim(F.concat_ws(" ", "title", "author", "format"))


def drop_repeats(results: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One result for each address (else magnet, else download address), at the place of the first: the first that can be downloaded, else the first."""
    address = F.when(tx.is_blank("url"), F.coalesce("magnet", "direct_url", F.lit(""))).otherwise(F.col("url"))
    rows = results.withColumn("_key", sc.url_key(address)).withColumn("_row", F.struct(*results.columns))
    rank = F.struct((~is_downloadable()).alias("no"), F.col("_pos").alias("at"))
    best = rows.groupBy(*by, "_key").agg(F.min("_pos").alias("_first"), F.min_by("_row", rank).alias("_row"))
    return best.select("_row.*", "_first").withColumn("_pos", F.col("_first")).drop("_first")


def rank_keys(kind: Column, formats: Column, subject: Column) -> list[Column]:
    """Can be downloaded, has a wanted format, is of the wanted kind, shares words with the subject; then by place."""
    wanted = F.coalesce(F.array_contains(F.transform(formats, F.lower), F.lower("format")), F.lit(False))
    return [is_downloadable().desc(), wanted.desc(), (F.col("kind") == kind).desc(), sc.title_overlap("title", subject).desc(), F.col("_pos").asc()]


def rank(results: DataFrame, kind: str, formats: list[str], subject: str, limit: int | None = None) -> DataFrame:
    """Results of one query in order of use, cut at the limit."""
    wanted = F.array(*map(F.lit, formats)) if formats else F.array().cast("array<string>")
    out = results.orderBy(*rank_keys(F.lit(kind), wanted, F.lit(subject)))
    return out.limit(limit) if limit is not None else out


def rank_each(results: DataFrame, queries: DataFrame, by: str = "qid") -> DataFrame:
    """Results of many queries (by, kind, formats, subject, limit), with rank, each list cut at its limit."""
    q = queries.select(by, F.col("kind").alias("q_kind"), "formats", "subject", "limit")
    both = results.join(q, by)
    place = F.row_number().over(Window.partitionBy(by).orderBy(*rank_keys(F.col("q_kind"), F.col("formats"), F.col("subject"))))
    return both.withColumn("rank", place).where("rank <= limit").select(*results.columns, "rank")


def by_meaning(results: DataFrame, vector: list[float] | None, column: str = "embedding") -> DataFrame:
    """Results by falling cosine to the vector, then by place; as they are where there is no vector."""
    if not vector:
        return results.orderBy("_pos")
    score = sc.cosine(F.col(column), F.array(*[F.lit(float(x)) for x in vector]))
    return results.withColumn("_score", score).orderBy(F.desc("_score"), "_pos").drop("_score")


def nearest(rows: DataFrame, queries: DataFrame, id: str, column: str, k: int, block: int = 1024) -> DataFrame:
    """The k rows nearest by cosine to each query, of all rows: query_id, the row's id, score, rank; the smaller id first among equals.

    Queries and rows have a whole-number id and a vector. Both are packed into blocks of about ``block``, and every block of queries
    meets every block of rows as a matrix product that keeps k a query; these are ranked in two steps, so no task
    ranks all rows. Vectors that are null, zero or of another length than the query's have score 0.
    """

    def packed(df: DataFrame, name: str) -> DataFrame:
        n = max(1, -(-df.count() // block))
        return df.groupBy(F.pmod(F.xxhash64(id), F.lit(n)).alias(f"{name}_block")).agg(F.collect_list(F.struct(F.col(id).cast("long").alias("i"), F.col(column).cast("array<double>").alias("v"))).alias(name))

    def unit(found: list) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
        """All ids, and by length the places and unit vectors of those that have any."""
        by: dict[int, list[int]] = {}
        for at, x in enumerate(found):
            by.setdefault(len(x["v"] or ()), []).append(at)
        out = {}
        for dim, places in by.items():
            if dim:
                v = np.array([found[at]["v"] for at in places], np.float64)
                n = np.linalg.norm(v, axis=1, keepdims=True)
                out[dim] = np.array(places), np.divide(v, n, out=np.zeros_like(v), where=n > 0)
        return np.array([x["i"] for x in found], np.int64), out

    def run(batches):
        for batch in batches:
            for a, b, at in zip(batch.column("q"), batch.column("r"), batch.column("r_block"), strict=True):
                (qi, qs), (ri, rs) = unit(a.as_py()), unit(b.as_py())
                cos = np.zeros((len(qi), len(ri)))
                for dim in set(qs) & set(rs):
                    cos[np.ix_(qs[dim][0], rs[dim][0])] = np.round(qs[dim][1] @ rs[dim][1].T, 12)
                order = np.lexsort((np.broadcast_to(ri, cos.shape), -cos), axis=1)[:, :k]
                n = order.shape[1]
                columns = [np.repeat(qi, n), ri[order].ravel(), np.take_along_axis(cos, order, 1).ravel(), np.full(len(qi) * n, at.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", id, "score", "part"])

    both = packed(queries, "q").crossJoin(packed(rows, "r"))  # of blocks: a stated set of queries against all rows
    found = both.repartition("q_block", "r_block").mapInArrow(run, f"query_id long, `{id}` long, score double, part long")
    for by in (["query_id", F.pmod("part", F.lit(64))], ["query_id"]):
        place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), id))
        found = found.withColumn("rank", place).where(F.col("rank") <= k)
    return found.select("query_id", id, "score", "rank")


def scores(results: DataFrame, query: str, vector: list[float] | None = None, column: str = "embedding") -> DataFrame:
    """Results with score: cosine moved to 0 to 1, or shared tokens where there is no vector."""
    if vector:
        return results.withColumn("score", (sc.cosine(F.col(column), F.array(*[F.lit(float(x)) for x in vector])) + 1) / 2)
    return results.withColumn("score", sc.token_similarity(fingerprint(), F.lit(query)))


class _Kept:
    """What a list has kept so far: unit vectors by length, and tokens by word, so that a result is compared with those alone that can be like it."""

    def __init__(self, threshold: float) -> None:
        self.threshold, self.tokens, self.has_vector = threshold, [], []
        self.by_token: dict[str, set[int]] = {}
        self.by_dim: dict[int, tuple[np.ndarray, list[int]]] = {}

    def first_like(self, tokens: frozenset, v: np.ndarray | None) -> int | None:
        hits = []
        if v is not None and len(v) in self.by_dim:
            held, at = self.by_dim[len(v)]
            found = np.flatnonzero(held[: len(at)] @ v >= self.threshold)
            hits += [at[found[0]]] if len(found) else []
        shared = Counter(k for t in tokens for k in self.by_token.get(t, ()) if v is None or not self.has_vector[k])
        hits += [k for k, both in shared.items() if both / (len(tokens) + len(self.tokens[k]) - both) >= SAME_TOKENS]
        return min(hits, default=None)

    def add(self, tokens: frozenset, v: np.ndarray | None) -> None:
        k = len(self.tokens)
        self.tokens.append(frozenset())
        self.has_vector.append(v is not None)
        self.renew(k, tokens)
        if v is not None:
            held, at = self.by_dim.setdefault(len(v), (np.zeros((16, len(v))), []))
            if len(at) == len(held):
                held = np.concatenate([held, np.zeros_like(held)])
                self.by_dim[len(v)] = held, at
            held[len(at)] = v
            at.append(k)

    def renew(self, k: int, tokens: frozenset) -> None:
        """Other tokens for a place; its vector stays."""
        for t in self.tokens[k]:
            self.by_token[t].discard(k)
        for t in tokens:
            self.by_token.setdefault(t, set()).add(k)
        self.tokens[k] = tokens


def _semantic(column: str | None, threshold: float, names: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos").reset_index(drop=True)
        # of two, the one that can be downloaded, else the larger, else the one with the longer title, else the first
        use = list(zip((pdf["direct_url"].notna() | pdf["magnet"].notna()).tolist(), pdf["size_bytes"].fillna(0).tolist(), pdf["title"].str.len().fillna(0).tolist(), strict=True))
        kept, row_of, places = _Kept(threshold), [], []
        for i, words in enumerate(pdf["_tokens"]):
            v = pdf[column].iat[i] if column else None
            v = None if v is None or len(v) == 0 else np.asarray(v, np.float64)
            if v is not None and (n := float(np.linalg.norm(v))) > 0:
                v = v / n
            words = frozenset(words)
            hit = kept.first_like(words, v)
            if hit is None:
                kept.add(words, v)
                row_of.append(i)
                places.append(pdf["_pos"].iat[i])
            elif use[i] > use[row_of[hit]]:
                kept.renew(hit, words)
                row_of[hit] = i
        return pdf.iloc[row_of].assign(_pos=places)[names]

    return run


def drop_same_meaning(results: DataFrame, by: tuple[str, ...] = (), column: str | None = None, threshold: float = SAME_MEANING, most: int = LIST) -> DataFrame:
    """Each list (by) without results that mean what an earlier kept one does: by cosine of a vector column, or by shared tokens where a side has no vector.

    A repeat replaces the kept result, at its place, where it is of more use: downloadable, larger, longer title. Lists
    of up to ``most`` results are gone through by a task each, longer ones never are.
    """
    names = results.columns
    rows = results.withColumn("_tokens", sc.tokens(fingerprint())).withColumn("_list", F.struct(*by) if by else F.struct(F.lit(0).alias("all")))
    longer = rows.groupBy("_list").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("_list")
    short = lambda df: df.drop("_list").withColumn("_all", F.lit(0)).groupBy(*(by or ("_all",))).applyInPandas(_semantic(column, threshold, names), results.schema)
    if longer.isEmpty():
        return short(rows)
    longer = written(longer, "longer")
    rest = drop_in_long_lists(rows.join(longer, "_list", "left_semi"), column, threshold, SAME_TOKENS, lambda: _Kept(threshold))
    return short(rows.join(longer, "_list", "left_anti")).unionByName(rest)
