"""Best-fit packing of tokenised documents into fixed-length sequences, by vectors.

A sequence has three capacities: tokens, documents, and attention cost (the sum of squared piece lengths, what
attention confined to each piece costs). Pieces go largest first; each goes to the open sequence that has room in
every dimension and fits best: by default the one whose residual capacities, as shares of the whole, have the least
weighted norm after the piece is in; or the one with the largest weighted dot-product of piece and residual.

Texts are tokenised where they are read and never shuffled; what moves is a few numbers a piece. Pieces are dealt to
shards of about ``shard_tokens``, each packed by one task; further rounds pack anew what lies in sequences that the
shards left partly empty, until one shard holds it or a round leaves more than half of what it was given.
"""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import written

VOCABULARY = "byte_bpe_50k"
END = 0
PROBE = "An idea: it's 42 naïve wörds\n\n  in <|endoftext|> “quotes” — ñandú 東京  \t end  "


@lru_cache(maxsize=2)
def _plain(vocabulary: str):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public.path(f"{vocabulary}.json"))


def plain(text: str, vocabulary: str = VOCABULARY) -> np.ndarray:
    """The ids that the vocabulary's ``tokenizers`` file gives a text; tokens added to it, written out in a text, are such tokens."""
    return np.array(_plain(vocabulary).encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def _ranks(vocabulary: str, added: tuple[tuple[str, int], ...]):
    import public_tokenizers as public
    import tiktoken

    with open(public.path(f"{vocabulary}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(vocabulary, pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens=dict(added))


@lru_cache(maxsize=2)
def agreeing(vocabulary: str = VOCABULARY) -> tuple[tuple[str, int], ...] | None:
    """The vocabulary's added tokens, if it is there as ranks too and these give the same ids for a probe text; else None."""
    found = _plain(vocabulary).get_added_tokens_decoder()
    added = tuple(sorted((t.content, i) for i, t in found.items()))
    if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in found.values()):
        return None
    try:
        ids = _ranks(vocabulary, added).encode_to_numpy(PROBE, allowed_special="all")
    except (ImportError, OSError):
        return None
    return added if np.array_equal(ids, plain(PROBE, vocabulary)) else None


def encoder(vocabulary: str = VOCABULARY, added: tuple[tuple[str, int], ...] | None = None):
    """text -> ids as an array, as plain() gives them.

    The same vocabulary as ranks is several times faster, so it encodes where agreeing() has found it to agree (its
    answer is ``added``); a text on which it breaks off goes to the slower library, loaded only then.
    """
    if added is None:
        return lambda text: plain(text, vocabulary)
    fast = _ranks(vocabulary, added)

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except BaseException as e:  # the library's own panic is no Exception
            if type(e).__name__ != "PanicException" and not isinstance(e, ValueError):
                raise
            return plain(text, vocabulary)

    return encode


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: one if they fit, else full ones behind a first that may be shorter."""
    first = n % length or length
    return [(0, n)] if n <= length else [(0, first), *((s, length) for s in range(first, n, length))]


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, length: int = 2048, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces of each row of docs (doc_id, text): its ids, then END, cut to at most length."""
    added = agreeing(vocabulary)

    def run(batches):
        encode = encoder(vocabulary, added)
        for batch in batches:
            ids, out = batch.column("doc_id"), []
            for i, text in enumerate(batch.column("text")):
                tokens = np.append(encode(text.as_py() or ""), END).astype("<u4")
                out += [(ids[i].as_py(), p, s, n, zlib.crc32(tokens[s : s + n])) for p, (s, n) in enumerate(cut(len(tokens), length))]
            for at in range(0, len(out), 10_000):
                columns = zip(*out[at : at + 10_000], strict=True)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, PIECE)


def best_fit(lengths: np.ndarray, capacity: tuple[int, int, int], weights: tuple[float, float, float] = (1.0, 0.05, 0.05), rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; lengths in falling order. capacity: tokens, documents and cost of a sequence."""
    full, w = np.array(capacity, np.float64), np.array(weights)
    at, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room = np.zeros((3, 256))
    names = np.zeros(256, np.int64)
    n_open = n_bins = 0
    for i, length in enumerate(lengths.tolist()):
        need = np.array([length, 1, length * length], np.float64)
        best = -1
        if n_open:
            r = room[:, :n_open]
            left = r - need[:, None]
            fits = np.flatnonzero(left.min(axis=0) >= 0)
            if len(fits):
                if rule == "norm":
                    score = w @ np.square(left[:, fits] / full[:, None])
                else:
                    score = -((w * need / full) @ (r[:, fits] / full[:, None]))
                best = int(fits[np.argmin(score)])
        if best < 0:
            if need[0] > full[0] or need[2] > full[2]:
                raise ValueError(f"a piece of {length} tokens exceeds a sequence's capacity")
            if n_open == room.shape[1]:
                room, names = np.concatenate([room, np.zeros_like(room)], axis=1), np.concatenate([names, np.zeros_like(names)])
            best, n_open = n_open, n_open + 1
            room[:, best], names[best] = full, n_bins
            n_bins += 1
        at[i], offset[i] = names[best], capacity[0] - room[0, best]
        room[:, best] -= need
        if room[:, best].min() <= 0:  # nothing more fits: the last open one takes its place
            n_open -= 1
            room[:, best], names[best] = room[:, n_open], names[n_open]
    return at, offset


def _packed(capacity, weights, rule, spread: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32", "copy"], ascending=[False, True, True, True, True]).reset_index(drop=True)
        at, offset = best_fit(pdf["length"].to_numpy(np.int64), capacity, weights, rule)
        used = np.bincount(at, pdf["length"]).astype(np.int64)
        shard = int(pdf["shard"].iloc[0])
        return pdf.assign(sequence_id=(spread << 56) + (shard << 24) + at, offset=offset, used=used[at]).drop(columns="shard")

    return run


PIECES = ("doc_id", "piece", "start", "length", "ids_crc32")
PACKED = f"{PIECE}, copy long, sequence_id long, offset long, used long"
RESULT = (*PIECES, "sequence_id", "offset")


def pack(
    docs: DataFrame, length: int = 2048, max_docs: int = 1024, max_cost: int | None = None, weights: tuple[float, float, float] = (1.0, 0.05, 0.05),
    rule: str = "norm", shard_tokens: int = 1 << 22, shard_pieces: int = 50_000, vocabulary: str = VOCABULARY,
) -> DataFrame:
    """Pack all rows of docs (doc_id, text) into sequences of at most length tokens, max_docs pieces and max_cost.

    Returns per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. max_cost is length ** 2 where it
    is not given, which every sequence keeps; less than that refuses longer pieces. A null or empty text is the end
    token alone; a null doc_id stays null; repeated rows are separate documents; a text of any length is cut into
    pieces; columns besides doc_id and text are ignored, however they are named; an empty table gives no rows.
    """
    capacity = (length, max_docs, max_cost or length * length)
    spare, out, again, before = written(pieces(docs, length, vocabulary), "pieces"), None, 0, None
    while True:
        total = spare.agg(F.sum("length").alias("tokens"), F.count(F.lit(1)).alias("n")).first()
        shards = max(1, -(-(total["tokens"] or 0) // shard_tokens), -(-total["n"] // shard_pieces))
        if before is None:  # equal pieces are told apart, so that a document repeated very often is dealt to all shards
            spare = spare.groupBy(*PIECES).agg(F.count(F.lit(1)).alias("copies"))
            spare = spare.select(*PIECES, F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
        shard = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "copy", F.lit(again)), F.lit(shards))
        packed = spare.withColumn("shard", shard).groupBy("shard").applyInPandas(_packed(capacity, weights, rule, again), PACKED)
        # one shard holds all that is left, or packing anew has stopped to pay
        if shards == 1 or before is not None and 2 * total["tokens"] > before:
            packed = packed.select(*RESULT)
            return packed if out is None else out.unionByName(packed)
        packed = written(packed, "packed")
        whole = F.col("used") >= int(0.985 * length)
        done = packed.where(whole).select(*RESULT)
        out = done if out is None else out.unionByName(done)
        spare, before, again = packed.where(~whole).select(*PIECES, "copy"), total["tokens"], again + 1
