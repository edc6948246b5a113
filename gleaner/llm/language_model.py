"""Scores of texts under a hidden Markov language model.

A word is seen as a symbol: the commonest words are symbols of their own, the others fall into classes by their last
three bytes. The model is P(word | state) = P(symbol | state) * P(word | symbol). The chain of states and
P(symbol | state) are learned by Baum-Welch: each round, every partition runs forward-backward over its whole training texts
and adds up expected counts, which are summed by groupBy; only the sums, as many as the model has parameters, come to
the driver. P(word | symbol) is the smoothed share of the word in its class, from counts over all training texts.

So a text's likelihood is exact and comes in two parts: the scaled forward recursion over its symbols, which needs
the bounded model only, and a sum over its words of logarithms of counts. Counts of the ``common`` words go with the
model; the counts of all others, which grow with the corpus, are met in a join of (word, document, times).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import crc_mod, written

CLASSES = 512
#: Times of a long text that are run side by side, and texts longer than which are run so.
STRETCH, LONG = 256, 4096
BATCH = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(77).integers(1, 2**63, 256, dtype=np.uint64)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(29))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


class _Hasher:
    """64-bit hashes of all words of a buffer at once, by prefix sums of a polynomial."""

    n = 0

    def upto(self, n: int) -> None:
        if n > self.n:
            self.n = max(n, BATCH)
            self.up, self.down = (np.full(self.n + 1, b % 2**64, np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
            for a in (self.up, self.down):
                a[0] = 1
                np.multiply.accumulate(a, out=a)

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, class) of each word of the texts in order, and how many words each text has. Texts are in lower case."""
        buf = np.frombuffer(b"   " + b" ".join(texts) + b" ", np.uint8)
        self.upto(len(buf))
        blank = _BLANK[buf]
        edge = np.diff(blank.view(np.int8))
        start, end = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
        prefix = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_TABLE[buf] * self.up[: len(buf)], out=prefix[1:])
        h = _mix((prefix[end] - prefix[start]) * self.down[start] + (end - start).astype(np.uint64))
        size = end - start
        last = buf[end - 1].astype(np.uint64)
        for n in (1, 2):  # bytes before a short word are not its own
            last |= np.where(size > n, buf[end - 1 - n], 0).astype(np.uint64) << _U(8 * n)
        cls = (_mix(last) % _U(CLASSES)).astype(np.int32)
        bounds = 3 + np.cumsum([len(t) + 1 for t in texts])
        upto = np.searchsorted(start, bounds)
        return h.view(np.int64), cls, np.diff(np.r_[0, upto])


_HASHER = _Hasher()


def _texts(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[list[bytes], list[tuple]]]:
    """Texts as lower-case bytes with the other columns' values, about BATCH bytes at once."""
    texts, rows, n = [], [], 0
    for batch in batches:
        columns = [batch.column(x) for x in ("text", *names)]
        for i in range(batch.num_rows):
            t = (columns[0][i].as_py() or "").encode("utf-8", "replace").lower()
            if texts and n + len(t) > BATCH:
                yield texts, rows
                texts, rows, n = [], [], 0
            texts.append(t)
            rows.append(tuple(c[i].as_py() for c in columns[1:]))
            n += len(t)
    if texts:
        yield texts, rows


def _grouped(values: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted rows and how often each occurs."""
    order = np.lexsort((values, *more)) if more else np.argsort(values, kind="stable")
    columns = [values[order], *(m[order] for m in more)]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    at = np.flatnonzero(new)
    return (*(c[at] for c in columns), np.diff(np.r_[at, len(order)]))


def _counts(batches):
    """Words of training texts with their class and how often a partition has them; flushed before they grow too many."""
    held, n = [], 0

    def flush():
        h, cls = (np.concatenate(x) for x in zip(*held, strict=True))
        h, cls, times = _grouped(h, cls)
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(cls), pa.array(times)], ["w", "cls", "c"])

    for texts, _ in _texts(batches):
        h, cls, _ = _HASHER.words(texts)
        held.append((h, cls))
        n += len(h)
        if n > 4_000_000:
            yield flush()
            held, n = [], 0
    if n:
        yield flush()


@dataclass
class Words:
    """What is known of words apart from the chain: the common ones by hash, with counts and symbols, and classes' totals."""

    hashes: np.ndarray
    counts: np.ndarray
    symbols: np.ndarray  # of common words: their own symbol, or their class's
    own: int  # symbols of their own come first, then classes, then the end
    class_log: np.ndarray  # log10 of the denominator of P(word | class)
    ends: int
    total: int  # N, ends counted
    distinct: int  # V, the end counted

    @property
    def n_symbols(self) -> int:
        return self.own + CLASSES + 1


def _encoded(words: Words):
    """Each text's symbols, the part of its sums that common words give, and its other words."""

    def run(batches):
        for texts, rows in _texts(batches, "doc_id", "k", "held_out"):
            h, cls, n = _HASHER.words(texts)
            at = np.minimum(np.searchsorted(words.hashes, h), max(0, len(words.hashes) - 1))
            common = words.hashes[at] == h if len(words.hashes) else np.zeros(len(h), bool)
            symbol = np.where(common, words.symbols[at], words.own + cls) if len(words.hashes) else words.own + cls
            symbol = symbol.astype(np.uint16)
            log_c = np.zeros(len(h))
            log_c[common] = np.log10(words.counts[at[common]] + 0.1)
            in_class = symbol >= words.own
            end = np.cumsum(n)
            doc = np.repeat(np.arange(len(n)), n)
            add = lambda x: np.bincount(doc, x, len(n))
            known, base, inside = add(common.astype(float)), add(log_c), add(np.where(in_class, log_c, 0.0))
            inside -= add(np.where(in_class, words.class_log[np.maximum(symbol.astype(int) - words.own, 0)], 0.0))
            rare_h, rare_doc, times = _grouped(h[~common], doc[~common])
            upto = np.searchsorted(rare_doc, np.arange(len(n) + 1))
            pairs = pa.StructArray.from_arrays([pa.array(rare_h), pa.array(times.astype(np.int32))], ["w", "n"])
            rare = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pairs)
            ids, k, held = zip(*rows, strict=True)
            symbols = [symbol[e - m : e].tobytes() for e, m in zip(end.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(k, pa.int64()), pa.array(held), pa.array(n + 1), pa.array(symbols, pa.binary()), pa.array(known.astype(np.int64)), pa.array(base), pa.array(inside), rare],
                ["doc_id", "k", "held_out", "n_tokens", "symbols", "known", "base", "inside", "rare"],
            )

    return run


ENCODED = "doc_id long, k long, held_out boolean, n_tokens long, symbols binary, known long, base double, inside double, rare array<struct<w:bigint,n:int>>"


@dataclass
class Chain:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbols by states

    @staticmethod
    def random(states: int, symbols: int, seed: int) -> Chain:
        rng = np.random.default_rng(seed)
        move = rng.dirichlet(np.ones(states), states) * 0.3 + 0.7 * np.eye(states)
        return Chain(np.full(states, 1 / states), move, rng.dirichlet(np.full(symbols, 2.0), states).T.copy())

    def forward(self, sequences: list[np.ndarray], first: np.ndarray, moved: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Last state probabilities, scaled, and natural log likelihood of each sequence, longest first.

        first: state probabilities at each sequence's first time, or, where moved, one time before it.
        """
        lens = np.array([len(s) for s in sequences])
        steps = int(lens[0]) if len(lens) else 0
        at = np.zeros((steps, len(lens)), np.int64)
        for i, s in enumerate(sequences):
            at[: len(s), i] = s
        alpha, log = first.copy(), np.zeros(len(lens))
        active = np.searchsorted(-lens, -np.arange(steps), "left")
        for t in range(steps):
            n = active[t]
            a = alpha[:n]
            a = (a @ self.move if t or moved else a) * self.emit[at[t, :n]]
            scale = a.sum(axis=1)
            log[:n] += np.log(scale)
            alpha[:n] = a / scale[:, None]
        return alpha, log

    def likelihood(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Natural log likelihood of each sequence; of a long one by stretches side by side, from every state, then chained."""
        out = np.zeros(len(sequences))
        short = sorted((i for i, s in enumerate(sequences) if len(s) <= LONG), key=lambda i: -len(sequences[i]))
        at = 0
        while at < len(short):  # together where lengths are alike and the padded times fit in memory
            longest = len(sequences[short[at]])
            n = max(1, min(len(short) - at, 2_000_000 // max(1, longest)))
            mine = short[at : at + n]
            out[mine] = self.forward([sequences[i] for i in mine], np.tile(self.start, (n, 1)))[1]
            at += n
        states = len(self.start)
        for i, s in enumerate(sequences):
            if len(s) > LONG:
                alpha, log = self.forward([s[:STRETCH]], self.start[None])
                v, total = alpha[0], log[0]
                for block in range(STRETCH, len(s), STRETCH * 256):
                    parts = [s[b : b + STRETCH] for b in range(block, min(block + STRETCH * 256, len(s)), STRETCH)]
                    ends, logs = self.forward([p for p in parts for _ in range(states)], np.tile(np.eye(states), (len(parts), 1)), moved=True)
                    for p in range(len(parts)):
                        a, lg = ends[p * states : (p + 1) * states], logs[p * states : (p + 1) * states]
                        w = v * np.exp(lg - lg.max())
                        total += lg.max() + math.log(w.sum())
                        v = w @ a / w.sum()
                out[i] = total
        return out

    def expected(self, sequences: list[np.ndarray], first: np.ndarray | None = None, last: np.ndarray | None = None, moved: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts of starts, moves and emissions by forward-backward over the sequences, longest first, and their log likelihood.

        first: state probabilities at each sequence's first time (the chain's start unless given), or, where moved, one time before it. last: for each
        sequence what follows it weighs its last states by, up to a factor.
        """
        lens = np.array([len(s) for s in sequences])
        steps, n, k = int(lens[0]), len(lens), len(self.start)
        first = np.tile(self.start, (n, 1)) if first is None else first
        at = np.zeros((steps, n), np.int64)
        for i, s in enumerate(sequences):
            at[: len(s), i] = s
        active = np.searchsorted(-lens, -np.arange(steps), "left").tolist()
        alpha, scale, one = np.zeros((steps, n, k)), np.ones((steps, n)), np.ones(k)
        before = first
        for t, m in enumerate(active):
            a = alpha[t, :m]
            if t or moved:
                np.matmul(before[:m], self.move, out=a)
            else:
                a[:] = before[:m]
            a *= self.emit.take(at[t, :m], axis=0)
            np.matmul(a, one, out=scale[t, :m])
            a /= scale[t, :m, None]
            before = a
        beta, moves, back = np.ones((n, k)), np.zeros((k, k)), np.ascontiguousarray(self.move.T)
        if last is not None:
            beta = last / (alpha[lens - 1, np.arange(n)] * last).sum(axis=1, keepdims=True)
        for t in range(steps - 1, -1, -1):
            m = active[t]
            if t < steps - 1 and active[t + 1]:
                r = active[t + 1]
                ahead = self.emit.take(at[t + 1, :r], axis=0)
                ahead *= beta[:r]
                ahead /= scale[t + 1, :r, None]
                moves += alpha[t, :r].T @ ahead
                np.matmul(ahead, back, out=beta[:r])
            if not t and moved:
                moves += first.T @ (self.emit[at[0]] * beta / scale[0, :, None])
            alpha[t, :m] *= beta[:m]
        flat, gamma = at.ravel(), alpha.reshape(-1, k)  # past a sequence's end its weights are 0
        emits = np.stack([np.bincount(flat, gamma[:, s], len(self.emit)) for s in range(k)], axis=1)
        return np.zeros(k) if moved else alpha[0].sum(axis=0), moves * self.move, emits, float(np.log(scale).sum())

    def transfers(self, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For each part and state before it: the last state's probabilities, and the part's likelihood up to a factor for the part."""
        k, lens = len(self.start), np.array([len(p) for p in parts])
        ends, weights = np.zeros((len(parts), k, k)), np.ones((len(parts), k))
        for n in np.unique(lens):  # all but a text's last part are of one length
            mine = np.flatnonzero(lens == n)
            at, a = np.stack([parts[i] for i in mine], axis=1).astype(np.int64), np.tile(np.eye(k), (len(mine), 1, 1))
            for t in range(n):
                a = (a.reshape(-1, k) @ self.move).reshape(-1, k, k)
                a *= self.emit.take(at[t], axis=0)[:, None, :]
                if t % 8 == 7:  # by one factor for all states, long before numbers grow too small
                    a /= a.max(axis=(1, 2), keepdims=True)
            sums = a.sum(axis=2)
            ends[mine], weights[mine] = a / sums[:, :, None], sums / sums.max(axis=1, keepdims=True)
        return ends, weights

    def expected_long(self, sequences: list[np.ndarray]) -> Iterator[tuple]:
        """Expected counts of long sequences, whole: what their stretches make of every state is chained both ways, then all stretches run side by side."""
        k = len(self.start)
        heads = [s[:STRETCH] for s in sequences]
        parts = [[s[b : b + STRETCH] for b in range(STRETCH, len(s), STRETCH)] for s in sequences]
        flat = [p for mine in parts for p in mine]
        ends, weights = np.zeros((len(flat), k, k)), np.zeros((len(flat), k))
        for b in range(0, len(flat), 1024):
            ends[b : b + 1024], weights[b : b + 1024] = self.transfers(flat[b : b + 1024])
        before, after, follows, at = np.zeros((len(flat), k)), np.ones((len(flat), k)), np.ones((len(sequences), k)), 0
        for i, (v, mine) in enumerate(zip(self.forward(heads, np.tile(self.start, (len(heads), 1)))[0], parts, strict=True)):
            for p in range(at, at + len(mine)):
                before[p] = v
                w = v * weights[p]
                v = w @ ends[p] / w.sum()
            x = np.ones(k)
            for p in range(at + len(mine) - 1, at - 1, -1):
                after[p] = x
                x = weights[p] * (ends[p] @ x)
                x /= x.max()
            follows[i] = x
            at += len(mine)
        for b in range(0, len(heads), 1024):
            yield self.expected(heads[b : b + 1024], np.tile(self.start, (len(heads[b : b + 1024]), 1)), follows[b : b + 1024])
        order = sorted(range(len(flat)), key=lambda p: -len(flat[p]))
        for b in range(0, len(order), 1024):
            some = order[b : b + 1024]
            yield self.expected([flat[p] for p in some], before[some], after[some], moved=True)

    def expectations(self, sequences: list[np.ndarray]) -> Iterator[tuple]:
        """Expected counts of whole sequences, in groups of like length whose padded times fit in memory."""
        short = sorted((s for s in sequences if len(s) <= LONG), key=len, reverse=True)
        at = 0
        while at < len(short):
            n = max(1, min(4096, len(short) - at, 1_000_000 // max(1, len(short[at]))))
            yield self.expected(short[at : at + n])
            at += n
        long, at = [s for s in sequences if len(s) > LONG], 0
        while at < len(long):  # some millions of times together
            n = 1 + int(np.searchsorted(np.cumsum([len(s) for s in long[at + 1 :]]), 4_000_000))
            yield from self.expected_long(long[at : at + n])
            at += n


def _sequences(batches, end: int) -> Iterator[tuple[list[np.ndarray], pa.RecordBatch]]:
    for batch in batches:
        yield [np.append(np.frombuffer(b.as_py() or b"", np.uint16), np.uint16(end)) for b in batch.column("symbols")], batch


def _expectations(chain: Chain, end: int):
    """Expected counts as rows (i, x): starts, then moves, then emissions. Every text is one sequence."""

    def run(batches):
        found = None
        for sequences, _ in _sequences(batches, end):
            for starts, moves, emits, log in chain.expectations(sequences):
                one = np.r_[starts, moves.ravel(), emits.ravel(), log]
                found = one if found is None else found + one
        if found is not None:
            i = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(found[i])], ["i", "x"])

    return run


def train(encoded: DataFrame, n_symbols: int, states: int = 8, rounds: int = 4, seed: int = 3) -> tuple[Chain, list[float]]:
    """Baum-Welch over encoded (symbols) training texts, all of them each round; also the log likelihood before each round."""
    chain, logs = Chain.random(states, n_symbols, seed), []
    for _ in range(rounds):
        rows = encoded.select("symbols").mapInArrow(_expectations(chain, n_symbols - 1), "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
        if not rows:
            break
        sums = np.zeros(states + states * states + n_symbols * states + 1)
        for r in rows:
            sums[r["i"]] = r["x"]
        starts, moves, emits = np.split(sums[:-1], [states, states + states * states])
        starts, moves, emits = starts + 0.01, moves.reshape(states, states) + 0.01, emits.reshape(n_symbols, states) + 0.01
        logs.append(float(sums[-1]))
        chain = Chain(starts / starts.sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=0))
    return chain, logs


def _scored(chain: Chain, end: int):
    def run(batches):
        for sequences, batch in _sequences(batches, end):
            logs = chain.likelihood(sequences) / math.log(10)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "k", "held_out", "n_tokens", "known", "base", "inside")), pa.array(logs)], [
                "doc_id", "k", "held_out", "n_tokens", "known", "base", "inside", "chain"])

    return run


def _commonest(counts: DataFrame, most: int) -> list:
    """At most that many words, the commonest, by falling count: those above a cutoff that a histogram gives, so no task or driver sorts more."""
    step = F.floor(F.log2("c") * 64).cast("int")
    bars = counts.groupBy(step.alias("step")).count().collect()  # a few thousand steps, however many words
    left, cutoff = most, None
    for step_, n in sorted(map(tuple, bars), reverse=True):
        if n > left:
            break
        left, cutoff = left - n, step_
    if cutoff is None:
        return []
    return sorted(counts.where(step >= cutoff).collect(), key=lambda r: (-r["c"], r["w"]))


def score(docs: DataFrame, folds: int = 10, held: int = 0, common: int = 100_000, own: int = 2_000, states: int = 8, rounds: int = 4, seed: int = 3) -> DataFrame:
    """Scores of each row of docs (doc_id, text) under a model learned from those outside fold ``held`` (crc32 of doc_id as text, modulo folds).

    Returns doc_id, held_out, n_tokens (words and one end), n_known (tokens that training texts have), train_tokens,
    base_score (log10 probability under smoothed unigrams) and score (log10 probability under the model).
    Null texts count as empty, and are the end alone; a null doc_id stays null, its text being that of an empty name in
    the folds; repeated rows are separate texts in the counts and get equal scores; an empty table gives no rows.
    ``common`` words (counts) and ``own`` symbols bound what goes to every task; all counts are over all training texts.
    Words are told apart by 64-bit hashes.
    """
    doc_id = F.col("doc_id").cast("long")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, text).alias("k"), (crc_mod(F.col("doc_id"), folds) == held).alias("held_out"), text.alias("text"))
    learning = docs.where(~F.col("held_out"))
    counts = written(learning.select("text").mapInArrow(_counts, "w long, cls int, c long").groupBy("w").agg(F.first("cls").alias("cls"), F.sum("c").alias("c")), "counts")
    top = _commonest(counts, common)
    sums = {r["cls"]: (r["n"], r["v"]) for r in counts.groupBy("cls").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    ends = learning.count()
    n_words, n_types = sum(n for n, _ in sums.values()), sum(v for _, v in sums.values())
    own = min(own, len(top))
    for r in top[:own]:
        n, v = sums[r["cls"]]
        sums[r["cls"]] = (n - r["c"], v - 1)
    symbols = {r["w"]: i if i < own else own + r["cls"] for i, r in enumerate(top)}
    top = sorted(top, key=lambda r: r["w"])
    words = Words(
        np.array([r["w"] for r in top], np.int64), np.array([r["c"] for r in top], np.float64), np.array([symbols[r["w"]] for r in top], np.int32),
        own, np.log10([n + 0.1 * (v + 1) for n, v in (sums.get(c, (0, 0)) for c in range(CLASSES))]), ends, n_words + ends, n_types + (ends > 0),
    )
    encoded = written(docs.mapInArrow(_encoded(words), ENCODED), "encoded")
    chain, _ = train(encoded.where(~F.col("held_out")), words.n_symbols, states, rounds, seed)
    scored = encoded.drop("rare").mapInArrow(_scored(chain, words.n_symbols - 1), "doc_id long, k long, held_out boolean, n_tokens long, known long, base double, inside double, chain double")
    name = F.coalesce("doc_id", F.lit(-1)).alias("id")
    rare = encoded.select("k", name, F.explode("rare").alias("x")).select("k", "id", "x.*").join(counts.select("w", "c"), "w", "left")
    c = F.coalesce("c", F.lit(0))
    rare = rare.select("k", "id", (F.col("n") * F.log10(c + 0.1)).alias("log"), F.when(c > 0, F.col("n")).otherwise(0).alias("seen"), F.lit(0).alias("copies"))
    # a row for each copy of a text, as equal texts share a key; they meet no word's key
    rare = rare.union(encoded.select("k", name, F.lit(0.0).alias("log"), F.lit(0).alias("seen"), F.lit(1).alias("copies")))
    rare = written(rare.groupBy("k", "id").agg(F.sum("log").alias("log"), F.sum("seen").alias("seen"), F.sum("copies").alias("copies")), "rare")
    v = scored.withColumn("id", F.coalesce("doc_id", F.lit(-1))).join(rare, ["k", "id"])
    tail, log = (math.log10(ends + 0.1), math.log10(words.total + 0.1 * (words.distinct + 1)))
    extra = F.col("log") / F.col("copies")
    return v.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + (F.col("seen") / F.col("copies")).cast("long") + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"), (F.col("base") + extra + F.lit(tail) - F.col("n_tokens") * F.lit(log)).alias("base_score"),
        (F.col("chain") + F.col("inside") + extra).alias("score"),
    )
