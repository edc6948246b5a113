import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np

from gleaner.llm import language_model as lm
from gleaner.llm.language_model import Chain, score


def test_forward_is_the_sum_over_all_paths():
    chain = Chain.random(3, 5, 1)
    rng = np.random.default_rng(0)
    sequences = [rng.integers(0, 5, n).astype(np.uint16) for n in (6, 1, 4)]
    got = chain.likelihood(sequences)
    for s, g in zip(sequences, got):
        total = 0.0
        for path in itertools.product(range(3), repeat=len(s)):
            p = chain.start[path[0]] * chain.emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= chain.move[path[t - 1], path[t]] * chain.emit[s[t], path[t]]
            total += p
        assert abs(g - math.log(total)) < 1e-9


def test_long_sequences_in_stretches():
    chain = Chain.random(4, 50, 2)
    s = np.random.default_rng(1).integers(0, 50, 9001).astype(np.uint16)
    direct = chain.forward([s], chain.start[None])[1][0]
    assert abs(chain.likelihood([s])[0] - direct) < 1e-6 * abs(direct)


def test_expected_counts_by_all_paths():
    chain = Chain.random(2, 3, 4)
    sequences = [np.array(x, np.uint16) for x in ([0, 1, 2, 2], [2, 0], [1])]
    starts, moves, emits, log = chain.expected(sequences)
    s2, m2, e2, l2 = np.zeros(2), np.zeros((2, 2)), np.zeros((3, 2)), 0.0
    for s in sequences:
        paths = list(itertools.product(range(2), repeat=len(s)))
        p = np.array([chain.start[q[0]] * chain.emit[s[0], q[0]] * math.prod(chain.move[q[t - 1], q[t]] * chain.emit[s[t], q[t]] for t in range(1, len(s))) for q in paths])
        l2 += math.log(p.sum())
        for w, q in zip(p / p.sum(), paths):
            s2[q[0]] += w
            for t in range(len(s)):
                e2[s[t], q[t]] += w
                if t:
                    m2[q[t - 1], q[t]] += w
    assert np.allclose(starts, s2) and np.allclose(moves, m2) and np.allclose(emits, e2) and abs(log - l2) < 1e-9


def plain_expected(chain, s):
    """Forward-backward over one sequence, a state at a time, scaled by each time's sum."""
    k, n = len(chain.start), len(s)
    alpha, beta, scale = [[0.0] * k for _ in s], [[1.0] * k for _ in s], [0.0] * n
    for t in range(n):
        for j in range(k):
            before = chain.start[j] if t == 0 else sum(alpha[t - 1][i] * chain.move[i, j] for i in range(k))
            alpha[t][j] = before * chain.emit[s[t], j]
        scale[t] = sum(alpha[t])
        alpha[t] = [a / scale[t] for a in alpha[t]]
    for t in range(n - 2, -1, -1):
        beta[t] = [sum(chain.move[i, j] * chain.emit[s[t + 1], j] * beta[t + 1][j] for j in range(k)) / scale[t + 1] for i in range(k)]
    starts = np.array([a * b for a, b in zip(alpha[0], beta[0])])
    moves, emits = np.zeros((k, k)), np.zeros_like(chain.emit)
    for t in range(n):
        for i in range(k):
            emits[s[t], i] += alpha[t][i] * beta[t][i]
            for j in range(k) if t else ():
                moves[i, j] += alpha[t - 1][i] * chain.move[i, j] * chain.emit[s[t], j] * beta[t][j] / scale[t]
    return starts, moves, emits, sum(map(math.log, scale))


def test_expected_counts_of_whole_long_texts(monkeypatch):
    chain, rng = Chain.random(3, 12, 9), np.random.default_rng(3)
    sequences = [rng.integers(0, 12, n).astype(np.uint16) for n in (1000, 1, 300, 700, 2)]
    want = [sum(x) for x in zip(*(plain_expected(chain, s) for s in sequences))]
    for long, stretch in ((4096, 256), (200, 64), (299, 1)):
        monkeypatch.setattr(lm, "LONG", long)
        monkeypatch.setattr(lm, "STRETCH", stretch)
        got = [sum(x) for x in zip(*chain.expectations(sequences))]
        assert all(np.allclose(g, w, rtol=1e-9, atol=1e-9) for g, w in zip(got, want))


def test_score_is_that_of_a_plain_model(spark):
    """Counts, symbols, Baum-Welch rounds and forward probabilities, all over again in plain Python."""
    rng = random.Random(7)
    names = [f"{p}{i}{e}" for p in ("ba", "ku") for i in range(20) for e in ("", "er", "ing")]
    rows = [(i, " ".join(names[min(119, int(rng.expovariate(0.05)))] for _ in range(rng.choice([0, 3, 40, 600])))) for i in range(40)] + [(77, None), (78, "never-seen ba1 ba1")]
    rows.append(rows[3])
    own, common, states, rounds = 12, 30, 3, 2
    held = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    texts = [(d, (t or "").split()) for d, t in rows]
    counts = Counter(w for d, t in texts if not held(d) for w in t)
    known = {w: tuple(int(x[0]) for x in lm._HASHER.words([w.encode()])[:2]) for w in {w for _, t in texts for w in t}}  # hash and class
    ranked = sorted(counts, key=lambda w: (-counts[w], known[w][0]))[:own]
    symbol = lambda w: ranked.index(w) if w in ranked else own + known[w][1]
    size = own + lm.CLASSES + 1
    inside, types = Counter(), Counter()
    for w, c in counts.items():
        if w not in ranked:
            inside[known[w][1]] += c
            types[known[w][1]] += 1
    chain = Chain.random(states, size, 3)
    for _ in range(rounds):
        sums = [plain_expected(chain, [*map(symbol, t), size - 1]) for d, t in texts if not held(d)]
        starts, moves, emits = (sum(x) + 0.01 for x in list(zip(*sums))[:3])
        chain = Chain(starts / starts.sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=0))
    want = []
    for d, t in texts:
        log = plain_expected(chain, [*map(symbol, t), size - 1])[3] / math.log(10)
        for w in t:
            if w not in ranked:
                c = known[w][1]
                log += math.log10((counts[w] + 0.1) / (inside[c] + 0.1 * (types[c] + 1)))
        want.append((d, len(t) + 1, log))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id, r.n_tokens, r.score) for r in score(df, common=common, own=own, states=states, rounds=rounds).collect())
    assert [g[:2] for g in got] == [w[:2] for w in sorted(want)] and np.allclose([g[2] for g in got], [w[2] for w in sorted(want)], rtol=1e-6)


def test_score(spark):
    rng = random.Random(5)
    languages = [[f"{p}{i}" for i in range(150)] for p in ("ba", "ku", "Zö")]
    rows = []
    for i in range(300):
        words = languages[i % 3]
        rows.append((i, rng.choice([" ", "\n", "\x0b "]).join(words[min(149, int(rng.expovariate(0.03)))] + rng.choice(["", ",", str(rng.randint(0, 30))]) for _ in range(rng.randint(1, 120)))))
    rows += [(900, None), (901, ""), (902, "ba1 ku1 unseen-word"), (903, "unseen " * 10 + "BA1"), (904, "ba1 ba2 " * 3000), (None, "x y"), rows[5], rows[5]]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as k", "2 as w", "3 as n").repartition(5)
    got = score(df, common=40, own=20, states=4, rounds=3).collect()
    token = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "").replace("\x0b", " ").replace("\n", " ")).split()
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0
    counts = Counter(w for d, t in rows if not held(d) for w in [*token(t), None])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for d, t in rows:
        words = [*token(t), None]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        want[(d, held(d), len(words), sum(counts[w] > 0 for w in words), n, round(base, 6))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    some = [r for r in got if r.held_out and r.n_tokens > 20]
    assert some and sum(r.score for r in some) > sum(r.base_score for r in some)  # held-out texts are likelier than under unigrams
    again = {(r.doc_id, r.n_tokens): r.score for r in score(df.repartition(2), common=40, own=20, states=4, rounds=3).collect()}
    assert all(abs(again[(r.doc_id, r.n_tokens)] - r.score) < 1e-6 * abs(r.score) for r in got)
    # what is common or rare changes how a sum is gathered, not what it is
    other = {(r.doc_id, r.n_tokens): r.score for r in score(df, common=1000, own=20, states=4, rounds=3).collect()}
    assert all(abs(other[(r.doc_id, r.n_tokens)] - r.score) < 1e-6 * abs(r.score) for r in got)
    assert score(df.limit(0)).count() == 0
