"""Alignment of two tokenizers over the same texts, and how often their tokens meet in the corpus.

Both tokenizers cut the bytes of a blank and the text. Every byte gets a label: no token ends there, one of A's does, one
of B's, or both. A regular expression scans the label string for spans up to each label "both"; the labels counted in
a span say how many tokens of A and of B are its group. Inside a group every boundary closes one overlap of a token of
A with one of B, so a text's links are as many as its labelled bytes.

A text's distinct id pairs are few beside its links. They are written once, as a sorted array beside the text's
figures; counting them over the corpus is an explode and a groupBy with a partial aggregate. The pairs that most
documents hold, at most ``common`` of them by a count of the counts, are broadcast to where the arrays are read; all
others, of which each is in few documents, meet their counts in an equi-join. Both give the same sums.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import written
from gleaner.llm.packing import _plain, _ranks

A_END, B_END, BOTH = 1, 2, 3
SPAN = re.compile(rb"[^\x03]*\x03")
#: A word with the blanks before it.
WORD = re.compile(r" +[^ ]*")
#: Words whose ids a worker keeps.
WORDS = 300_000
PROBE = "An idea: it's 42 naïve wörds\n\n  in <|endoftext|> “quotes” — ñandú 東京  \t end  "
#: Texts of so many links together make a batch of results.
CHUNK = 500_000


@lru_cache(maxsize=1)
def _bytes_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE vocabulary: ids of a text, its added tokens' strings read as plain text, and the bytes of each id."""

    def __init__(self, name: str) -> None:
        self.name, of = name, _bytes_of()
        vocabulary = _plain(name).get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        self.fast = None
        try:
            fast = _ranks(name, ())
            if list(fast.encode_ordinary(PROBE)) == self._plain(PROBE):
                self.fast = fast
        except (ImportError, OSError):
            pass

    def _plain(self, text: str) -> list[int]:
        tokenizer = _whole(self.name)
        return tokenizer.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> np.ndarray | None:
        """As tokenizers gives them; the same vocabulary as ranks is faster, and encodes where a probe has found it to agree. None where the tokens' bytes are not the text's."""
        if self.fast is not None:
            try:
                ids = self.fast.encode_ordinary(text)
                return np.array(ids, np.int64) if self.fast.decode_bytes(ids) == text.encode() else None
            except BaseException as e:  # the library's own panic is no Exception
                if type(e).__name__ != "PanicException" and not isinstance(e, ValueError):
                    raise
        ids = self._plain(text)
        return np.array(ids, np.int64) if b"".join(map(self.bytes.__getitem__, ids)) == text.encode() else None


@lru_cache(maxsize=2)
def _whole(name: str):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(public.path(f"{name}.json"))
    found.encode_special_tokens = True
    return found


class _Words(dict):
    """Ids of words that begin with a blank, as bytes of 32-bit numbers, None where their pieces are not the word; the first WORDS are kept."""

    def __init__(self, model, pieces: list[bytes]) -> None:
        self.model, self.pieces, self.blank = model, pieces, model.piece_to_id("▁")

    def __missing__(self, word: str) -> bytes | None:
        # the model adds the first blank by itself, but not to an empty text
        ids = self.model.encode(word[1:], num_threads=1) if len(word) > 1 else [self.blank]
        same = b"".join(map(self.pieces.__getitem__, ids)) == word.encode()
        found = np.array(ids, np.int32).tobytes() if same else None
        if len(self) < WORDS and len(word) <= 40:
            self[word] = found
        return found


class Pieces:
    """A sentencepiece model: ids of a text, and the bytes of each piece.

    Where no piece has a blank behind another character, no merge crosses the place before a blank, so a text's ids are
    those of its words in order, and a word's are found once.
    """

    def __init__(self, name: str) -> None:
        import public_tokenizers as public
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=public.path(f"{name}.model"))
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())
        apart = not any(re.search("[^▁]▁", self.model.id_to_piece(i)) for i in range(len(self.bytes)))
        self.words = _Words(self.model, self.bytes) if apart else None
        if apart and self(PROBE).tolist() != self.whole(PROBE).tolist():
            self.words = None

    def whole(self, text: str) -> np.ndarray | None:
        ids = self.model.encode(text, num_threads=1)
        return np.array(ids, np.int64) if b"".join(map(self.bytes.__getitem__, ids)) == b" " + text.encode() else None

    def __call__(self, text: str) -> np.ndarray | None:
        """None where the pieces' bytes are not those of a blank and the text."""
        if self.words is None:
            return self.whole(text)
        found = [*map(self.words.__getitem__, WORD.findall(" " + text))]
        return None if None in found else np.frombuffer(b"".join(found), np.int32).astype(np.int64)


@lru_cache(maxsize=2)
def _pair(a: str, b: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(a), Pieces(b)


class Aligner:
    """Aligns texts by two tokenizers."""

    def __init__(self, a: str, b: str) -> None:
        self.a, self.b = _pair(a, b)
        na, nb = len(self.a.bytes), len(self.b.bytes)
        self.na, self.nb = na, nb
        self.len_a, self.len_b = (np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b))
        # how each id is written inside its side of a group, and at its end; shorter ones end in zero bytes
        self.shown = np.array([f"{i}{end}".encode() for n, ends in ((na, ",|"), (nb, ",;")) for end in ends for i in range(n)])

    def ids(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """A's ids of a blank and the text, and B's of the text; None if there is no text or either side's bytes are others."""
        if not text:
            return None
        a, b = self.a(" " + text), self.b(text)
        if a is None or b is None:
            return None
        return a, b

    def labels(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which tokens end at each byte."""
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        out = np.zeros(end_a[-1], np.uint8)
        out[end_a - 1] = A_END
        out[end_b - 1] += B_END
        return out

    def align(self, text: str | None) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
        """(A's tokens, B's, groups, links, the groups written out, distinct pairs ascending, links of each pair)."""
        found = self.ids(text)
        if found is None:
            return 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = found
        labels = self.labels(a, b)
        spans = np.cumsum(np.fromiter(map(len, SPAN.findall(labels.tobytes())), np.int64))
        at = np.flatnonzero(labels)
        is_a, is_b = labels[at] & A_END, labels[at] >> 1
        ends_a, ends_b = np.cumsum(is_a, dtype=np.int64), np.cumsum(is_b, dtype=np.int64)
        # the overlap that a boundary closes is of the tokens that are open before it
        pairs, times = np.unique(a[ends_a - is_a] * self.nb + b[ends_b - is_b], return_counts=True)

        last = np.searchsorted(at, spans - 1)  # the boundary at which each span ends
        upto_a, upto_b = ends_a[last], ends_b[last]
        size_a, size_b = upto_a.copy(), upto_b.copy()
        size_a[1:] -= upto_a[:-1]
        size_b[1:] -= upto_b[:-1]
        order = np.empty(len(a) + len(b), np.int64)
        starts = np.cumsum(size_a + size_b) - size_a - size_b
        group_a, group_b = np.repeat(np.arange(len(last)), size_a), np.repeat(np.arange(len(last)), size_b)
        shown_a, shown_b = a.copy(), b + 2 * self.na
        shown_a[upto_a - 1] += self.na
        shown_b[upto_b - 1] += self.nb
        order[(starts - upto_a + size_a)[group_a] + np.arange(len(a))] = shown_a
        order[(starts + size_a - upto_b + size_b)[group_b] + np.arange(len(b))] = shown_b
        text_of = self.shown[order].tobytes().replace(b"\0", b"")[:-1].decode()
        return len(a), len(b), len(last), len(at), text_of, pairs, times


SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"


def alignments(docs: DataFrame, a: str = "byte_bpe_50k", b: str = "piece_bpe_32k") -> DataFrame:
    """The alignment of each row of docs (doc_id, text): counts, the groups, and its distinct pairs with their links.

    groups is `a1,a2|b1;a3|b2,b3`: ids in order, a group's of A, then its of B. A pair is A's id times the number of
    B's ids plus B's id. Null and empty texts, and those whose bytes a tokenizer doesn't give back, have no tokens:
    zeros and nothing else. Repeated rows get equal results; ids are cast to long, null ones stay; a text of any
    length is aligned whole; other columns are ignored; an empty table gives no rows.
    """

    def run(batches):
        aligner, names = Aligner(a, b), [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [*[pa.int64()] * 5, pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]
        for batch in batches:
            ids, out, links = batch.column("doc_id"), [], 0
            for i, text in enumerate(batch.column("text")):
                out.append((ids[i].as_py(), *aligner.align(text.as_py())))
                links += out[-1][4]
                if links >= CHUNK or i == len(batch) - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                    out, links = [], 0

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, SCHEMA)


def linked(rows: DataFrame, b_ids: int) -> DataFrame:
    """pair, n (rows that hold it) and best (no pair of its A id is in more) from rows (pairs)."""
    counts = written(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pair_counts")
    of = F.floor(F.col("pair") / b_ids)
    top = counts.groupBy(of.alias("a")).agg(F.max("n").alias("most"))
    return counts.withColumn("a", of).join(top, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def agreement(docs: DataFrame, a: str = "byte_bpe_50k", b: str = "piece_bpe_32k", common: int = 200_000) -> DataFrame:
    """Alignments with corpus-wide counts: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A pair's count is how many rows of docs hold it linked. count_sum adds it up over a text's links; n_best counts the
    links whose pair has the highest count of its A id, ties included. groups_sha256 is the digest of the groups in
    lowercase hex, '' without tokens. Edge cases as in alignments(); each of several equal rows counts as a document.

    common: no more pairs than this are broadcast (17 bytes each); the others are joined.
    """
    b_ids = len(_pair(a, b)[1].bytes)
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("").alias("groups_sha256")
    found = alignments(docs, a, b).select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "pairs", "times")
    rows = written(found.withColumn("row", F.monotonically_increasing_id()), "alignments")
    stats = written(linked(rows, b_ids), "pair_stats")

    # the least power of two that at most `common` pairs reach
    steps = [F.count_if(F.col("n") >= F.lit(1 << k)).alias(str(k)) for k in range(48)]
    reach = stats.agg(*steps).first()
    least = 1 << next(k for k in range(48) if reach[str(k)] <= common)

    held = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    often = stats.where(F.col("n") >= least)
    first = held.join(F.broadcast(often), "pair", "left")
    sums = (F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    parts = first.where("n is not null").groupBy("row").agg(*sums)
    if least > 1:
        rare = held.join(F.broadcast(often.select("pair")), "pair", "left_anti").join(stats.where(F.col("n") < least), "pair").groupBy("row").agg(*sums)
        parts = parts.union(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return rows.drop("pairs", "times").join(parts, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
