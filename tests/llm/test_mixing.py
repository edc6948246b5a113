import random
import re
from collections import defaultdict
from fractions import Fraction

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.llm.common import WORD
from gleaner.llm.mixing import _quotas, apportion, mix, mixed, targets

SCHEMA = "doc_id long, text string, source string, n_chars long"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=7), st.integers(0, 60), st.data())
def test_apportion_is_highest_quotients(votes, seats, data):
    most = [data.draw(st.integers(0, 20)) for _ in votes]
    want = [0] * len(votes)
    for _ in range(seats):
        able = [i for i in range(len(votes)) if want[i] < most[i] and votes[i]]
        if not able:
            break
        want[max(able, key=lambda i: (Fraction(votes[i], 2 * want[i] + 1), -i))] += 1
    got = apportion(votes, seats, most)
    assert sum(got) == sum(want) and all(g <= m for g, m in zip(got, most))
    last = [Fraction(v, 2 * g - 1) for v, g in zip(votes, got) if g]
    following = [Fraction(v, 2 * g + 1) for v, g, m in zip(votes, got, most) if g < m and v]
    assert not last or not following or min(last) >= max(following)


def quotients(votes, seats, most):
    """One seat at a time to the highest quotient, of equals the first."""
    out = [0] * len(votes)
    for _ in range(seats):
        able = [i for i in range(len(votes)) if out[i] < most[i] and votes[i]]
        if able:
            out[max(able, key=lambda i: (Fraction(votes[i], 2 * out[i] + 1), -i))] += 1
    return out


@settings(max_examples=2000, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 9)), min_size=1, max_size=7), st.integers(0, 60), st.integers(1, 97))
def test_apportion_is_the_plain_rule(parties, seats, part):
    votes, most = [Fraction(v, part) for v, _ in parties], [m for _, m in parties]
    assert apportion(votes, seats, most) == quotients(votes, seats, most)


@settings(max_examples=2000, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=9), st.integers(0, 80), st.integers(1, 40))
def test_quotas_are_highest_quotients(words, seats, block):
    got = _quotas(block, 2)(pd.DataFrame({"sid": 0, "shard": range(len(words)), "words": words, "seats": seats}))
    blocks = [max(round(w / block), int(w > 0)) for w in words]
    assert got["blocks"].tolist() == blocks
    assert got["quota"].tolist() == quotients(words, seats, [2 * b for b in blocks])


def test_quotas_of_large_and_equal_shards():
    big = [3 * 10**12, 10**12, 10**12 + 1, 7]
    got = _quotas(10**9, 2)(pd.DataFrame({"sid": 0, "shard": range(4), "words": big, "seats": 2001}))
    assert got["quota"].tolist() == quotients(big, 2001, [6000, 2000, 2000, 2])
    same = _quotas(32, 2)(pd.DataFrame({"sid": 0, "shard": range(1000), "words": 1 << 20, "seats": 33_554}))
    assert same["quota"].tolist() == [34] * 554 + [33] * 446


@given(st.lists(st.integers(0, 1000), min_size=1, max_size=12))
def test_targets(sizes):
    t = targets(sizes)
    assert sum(t) == Fraction(3, 2) * sum(sizes) and all(x <= 2 * s for x, s in zip(t, sizes))
    free = [(x, (5, 2, 1)[i % 3]) for i, (x, s) in enumerate(zip(t, sizes)) if x < 2 * s]
    assert len({x / w for x, w in free}) <= 1


def corpus(n=400):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        words = [f"w{rng.randint(0, 99)}" for _ in range(rng.choice([0, 1, 5, 40, 300]))]
        rows.append((i, "\n ".join(words), rng.choice(["a", "a", "a", "b", "c", "é", None]), 7))
    long = " ".join(f"w{i % 100}" for i in range(30_000))
    return rows + [(500, None, "a", 0), (501, "", "z", 0), (None, "one two", "b", 7), *[rows[3]] * 30, (502, long, "c", 7), (503, long, "c", 7)]


def test_mix(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as k", "2 as shard", "3 as passes", "4 as seats").repartition(7)
    got = mix(df, shard_words=2000).collect()
    again = mix(df.repartition(3), shard_words=2000).collect()
    key = lambda r: str(tuple(r))
    assert sorted(got, key=key) == sorted(again, key=key) and len(got) == len(rows)
    size = lambda t: len(re.findall(WORD, t or ""))
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(r[0]), size(r[1])) for r in rows)
    by = defaultdict(int)
    for r in rows:
        by[r[2]] += size(r[1])
    order = sorted(by, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, map(float, targets([by[s] for s in order]))))
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == by[r.source] and r.target == want[r.source]
        assert r.taken == r.passes * r.size + sum(b - a for a, b in r.spans)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.01 * want[s] + 3 for s in order)
    assert mix(df.limit(0)).count() == 0


def test_mixed_texts(spark):
    rows = corpus(120)
    df = spark.createDataFrame(rows, SCHEMA)
    plan = defaultdict(int)
    for r in mix(df).collect():
        plan[r.doc_id] += r.taken
    out = mixed(df.selectExpr("*", "1 as _id", "2 as _k", "3 as _passes", "4 as k", "5 as copies")).select(*df.columns)
    assert mixed(df).columns == df.columns
    found = defaultdict(int)
    texts = {r[0]: r[1] for r in rows}
    for r in out.collect():
        words = re.findall(WORD, r.text)
        found[r.doc_id] += len(words)
        assert words and r.n_chars == len(r.text) and set(words) <= set(re.findall(WORD, texts[r.doc_id]))
    assert found == {d: n for d, n in plan.items() if n}
