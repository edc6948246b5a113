import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gleaner.llm.packing import agreeing, best_fit, cut, encoder, pack

HF = Tokenizer.from_file(P.path("byte_bpe_50k.json"))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_same_ids_as_tokenizers(text):
    for t in (text, f"{text}<|endoftext|>{text}"):
        assert encoder(added=agreeing())(t).tolist() == encoder()(t).tolist() == HF.encode(t, add_special_tokens=False).ids


def test_added_token():
    assert encoder(added=agreeing())("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]
    assert dict(agreeing()) == {"<|endoftext|>": 50256}


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_is_the_plain_rule(rule):
    rng = random.Random(4)
    lengths, capacity, w = sorted((rng.randint(1, 100) for _ in range(300)), reverse=True), (100, 4, 9000), (1.0, 0.05, 0.05)
    lengths = [n for n in lengths if n * n <= capacity[2]]
    bins, want = [], []  # residuals; (bin, offset) by going through all bins
    for n in lengths:
        need, best = (n, 1, n * n), None
        for b, room in enumerate(bins):
            left = [r - x for r, x in zip(room, need)]
            if min(left) >= 0:
                score = sum(k * (x / c) ** 2 for k, x, c in zip(w, left, capacity)) if rule == "norm" else -sum(k * x * r / c / c for k, x, r, c in zip(w, need, room, capacity))
                if best is None or score < best[0] - 1e-12:
                    best = (score, b)
        if best is None:
            bins.append(list(capacity))
        b = best[1] if best else len(bins) - 1
        want.append((tuple(bins[b]), n))
        bins[b] = [r - x for r, x in zip(bins[b], need)]
    at, offset = best_fit(np.array(lengths), capacity, rule=rule)
    # of equally good sequences either may be taken: what each piece finds is the same, and so is their number
    rooms, got = {}, []
    for n, b in zip(lengths, at.tolist()):
        room = rooms.setdefault(b, list(capacity))
        got.append((tuple(room), n))
        rooms[b] = [r - x for r, x in zip(room, (n, 1, n * n))]
    assert got == want and len(rooms) == len(bins)


def test_cut():
    assert cut(5, 8) == [(0, 5)] and cut(8, 8) == [(0, 8)] and cut(16, 8) == [(0, 8), (8, 8)] and cut(17, 8) == [(0, 1), (1, 8), (9, 8)]


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    rng = random.Random(1)
    lengths = np.array(sorted((rng.choice([1, 2, 5, 60, 90]) for _ in range(900)), reverse=True))
    capacity = (100, 9, 6000) if rule == "norm" else (100, 30, 8200)
    with_room = lengths[lengths**2 <= capacity[2]]
    at, offset = best_fit(with_room, capacity, rule=rule)
    for b in set(at.tolist()):
        mine = np.flatnonzero(at == b)
        assert with_room[mine].sum() <= capacity[0] and len(mine) <= capacity[1] and (with_room[mine] ** 2).sum() <= capacity[2]
        order = mine[np.argsort(offset[mine])]
        assert (offset[order] == np.cumsum(with_room[order]) - with_room[order]).all()
    if len(with_room) < len(lengths):
        with pytest.raises(ValueError):
            best_fit(lengths, capacity, rule=rule)


def test_pack(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(f"wörd{rng.randint(0, 999)}" for _ in range(rng.choice([0, 1, 9, 60, 200, 1500])))) for i in range(250)]
    rows += [(900, None), (901, ""), (902, "a <|endoftext|> b"), (None, "x y"), *[rows[0]] * 40, (903, "very long text " * 40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as piece", "2 as length", "3 as shard", "4 as ids_crc32", "5 as sequence_id", "6 as copy").repartition(5)
    for shard_tokens in (1 << 22, 20_000):
        got = pack(df, length=512, shard_tokens=shard_tokens).collect()
        want = []
        for d, t in rows:
            ids = np.array(HF.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
            want += [(str(d), p, s, n, zlib.crc32(ids[s : s + n].tobytes())) for p, (s, n) in enumerate(cut(len(ids), 512))]
        assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
        bins = defaultdict(list)
        for r in got:
            bins[r.sequence_id].append((r.offset, r.length))
        for b in bins.values():
            b.sort()
            assert all(o == sum(n for _, n in b[:i]) for i, (o, _) in enumerate(b)) and sum(n for _, n in b) <= 512
        assert len(bins) <= 1.02 * -(-sum(r.length for r in got) // 512) + 1
    assert pack(df.limit(0)).count() == 0
