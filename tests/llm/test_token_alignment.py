import hashlib
import random
from collections import Counter
from functools import lru_cache

import pytest

from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.llm.token_alignment import Aligner, Pieces, agreement, alignments, linked

SCHEMA = "doc_id long, text string, pairs string"


@pytest.fixture(scope="module")
def libraries():
    import public_tokenizers as public
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel

    a = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model")), ByteLevel()


def byte_tables(libraries):
    a, b, _ = libraries
    # the byte-level alphabet, from its rule: printable bytes are themselves, others follow from U+0100
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of, extra = {chr(x): x for x in printable}, 0
    for x in range(256):
        if x not in printable:
            of[chr(256 + extra)] = x
            extra += 1
    bytes_a = lambda i: bytes(of[c] for c in a.id_to_token(i))

    def bytes_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    return bytes_a, bytes_b


def plain_doc(libraries, text):
    """Token ranges, compared one by one."""
    if not text:
        return None
    a, b, _ = libraries
    bytes_a, bytes_b = byte_tables(libraries)
    ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    if any(b"".join(map(f, x)) != (" " + text).encode() for f, x in ((bytes_a, ids[0]), (bytes_b, ids[1]))):
        return None
    ranges = []
    for f, x in ((bytes_a, ids[0]), (bytes_b, ids[1])):
        at, out = 0, []
        for i in x:
            out.append((i, at, at := at + len(f(i))))
        ranges.append(out)
    ends = sorted({r[2] for r in ranges[0]} & {r[2] for r in ranges[1]})
    groups = ";".join("|".join(",".join(str(i) for i, _, e in side if lo < e <= hi) for side in ranges) for lo, hi in zip([0, *ends], ends, strict=False))
    links = [(i, j) for i, s, e in ranges[0] for j, t, f in ranges[1] if max(s, t) < min(e, f)]
    return len(ids[0]), len(ids[1]), len(ends), links, groups


def plain_rows(libraries, rows):
    docs = [plain_doc(libraries, r[1]) for r in rows]
    count = Counter(p for d in docs if d for p in set(d[3]))
    best = {}
    for (a, _), n in count.items():
        best[a] = max(n, best.get(a, 0))
    out = []
    for r, d in zip(rows, docs, strict=True):
        if d is None:
            out.append((r[0], 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, n_groups, links, groups = d
            out.append((r[0], n_a, n_b, n_groups, len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(groups.encode()).hexdigest()))
    return sorted(out, key=repr)


def texts():
    rng = random.Random(4)
    words = "the naïve 東京 tokenizer’s 12345 <|endoftext|> <s> </s> <unk> <0x41> über x ▁ \t \n\n   été 🙂 ﬁ é don't C++ \x00   aaaaaaaa ĠĠ".split(" ")
    return [rng.choice([" ", "", "  "]).join(rng.choices(words, k=rng.randint(1, 25))) for _ in range(120)]


@pytest.mark.parametrize("common", [200_000, 60, 0])
def test_against_brute_force(spark, libraries, common):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(500, None, "x"), (501, "", "x"), (502, " ", "x"), (None, "null id", "x")] + [(7, "a row more than once", "x")] * 4
    got = agreement(spark.createDataFrame(rows, SCHEMA).repartition(3), common=common)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = plain_rows(libraries, rows)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert sum(r[1] == 0 for r in want) >= 2 and sum(r[1] > 0 for r in want) > 60


def test_real_texts(spark, libraries):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    short = [r for r in docs.collect() if r.text is not None and len(r.text) < 1500][:40]
    got = agreement(spark.createDataFrame([(r.doc_id, r.text) for r in short], "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_rows(libraries, short)


def test_long_text_and_no_rows(spark, libraries):
    text = "word été 🙂 " * 60_000
    row = alignments(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    a, b = Aligner("byte_bpe_50k", "piece_bpe_32k").ids(text)
    assert (row.n_a, row.n_b) == (len(a), len(b)) and row.n_links == row.n_a + row.n_b - row.n_groups == sum(row.times)
    assert row.groups.count(";") + 1 == row.groups.count("|") == row.n_groups
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert agreement(empty).count() == 0 and alignments(empty).count() == 0


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \t\n▁abthe é東🙂\x00\u00a0\u3000\u200b"), st.characters(codec="utf-8")), min_size=1, max_size=40))
def test_words_apart_have_the_ids_of_the_whole(text):
    pieces = _pieces()
    assert pieces.words is not None
    apart, whole = pieces(text), pieces.whole(text)
    assert (apart is None) == (whole is None) and (whole is None or apart.tolist() == whole.tolist())


@lru_cache(maxsize=1)
def _pieces():
    return Pieces("piece_bpe_32k")


def test_counts_and_ties(spark):
    rows = spark.createDataFrame([([10, 11, 25],), ([11, 25],), ([10],)], "pairs array<long>")
    assert {tuple(r) for r in linked(rows, 10).collect()} == {(10, 2, True), (11, 2, True), (25, 2, True)}
    rows = spark.createDataFrame([([10, 11],), ([11],)], "pairs array<long>")
    assert {tuple(r) for r in linked(rows, 10).collect()} == {(10, 1, False), (11, 2, True)}
