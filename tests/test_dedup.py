import random

import pytest

from gleaner.operators import dedup
from gleaner.operators.dataset import Dataset, Field


def grams(s):
    p = f"  {s} "
    return {p[i : i + 3] for i in range(len(p) - 2)}


def like(a, b):
    scores = []
    for x, y in zip(a, b):
        if not x.strip() and not y.strip():
            continue
        if x == y:
            scores.append(1.0)
        elif not x.strip() or not y.strip():
            scores.append(0.0)
        else:
            g, h = grams(x), grams(y)
            scores.append(len(g & h) / len(g | h))
    return sum(scores) / len(scores) if scores else 0.0


def one_by_one(rows, threshold):
    """The rule itself: each row against every kept row before it."""
    out, kept = [], []
    for i, cells in enumerate(rows):
        n = ["".join(c.lower().strip()) for c in cells]
        n = [" ".join(c.split()) if c.split() else "" for c in n]
        key = "\x00".join(n)
        exact = next((j for j, m, k in kept if k == key and key.strip()), None)
        if exact is not None:
            out.append((i, dedup.EXACT, exact, 1.0))
            continue
        best = max(((like(n, m), -j) for j, m, _ in kept), default=None)
        if best is not None and best[0] >= threshold:
            out.append((i, dedup.LIKELY, -best[1], round(best[0], 9)))
        else:
            out.append((i, dedup.UNIQUE, None, 1.0))
            kept.append((i, n, key))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_against_the_rule(spark, seed):
    rng = random.Random(seed)
    base = ["mohammed rahman", "mohammad rahman", "Mohammed  Rahman", "karim", "karima", "abc def", "abc deg", "", " ", "x"]
    rows = [tuple(rng.choice(base) + rng.choice(["", "", "!", " jr"]) * rng.randint(0, 1) for _ in range(1 + seed % 3)) for _ in range(40)]
    names = [f"c{i}" for i in range(len(rows[0]))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ", ".join(["i long", *(f"{n} string" for n in names)])).repartition(3)
    d = Dataset.of("d", "d", df, "i", [Field(n) for n in names])
    for threshold in (0.3, 0.6, 0.8, 0.95)[seed % 2 :: 2]:
        got = sorted((r["_pos"], r.verdict, None if r.duplicate_of is None else int(r.duplicate_of[2:]) - 1, round(r.score, 9)) for r in dedup.analyze(d, None, threshold).collect())
        assert got == one_by_one(rows, threshold)


def test_types_summary_and_application(spark):
    rows = [(0, "A@B.com ", "https://x/a/#1", "1,000"), (1, "a@b.com", "HTTPS://X/a", "1000"), (2, "c@b.com", "https://x/b", "7")]
    df = spark.createDataFrame(rows, "i long, e string, u string, n string")
    d = Dataset.of("d", "d", df, "i", [Field("e", "email"), Field("u", "url"), Field("n", "number")])
    s = dedup.summary(dedup.analyze(d, ["e", "u", "n", "none"])).first()
    assert (s.unique, s.exact, s.likely, s.summary) == (2, 1, 0, "2 unique, 1 exact duplicate")
    assert dedup.apply_exact(d, ["e"]).count() == 2 and dedup.apply_all(d, ["none"]).count() == 2
    assert [tuple(r) for r in dedup.exact_only(d, ["n"]).collect()] == [("d-2", 1, "d-1")]


def test_blank_keys_and_low_threshold(spark):
    df = spark.createDataFrame([(0, "", ""), (1, "", " "), (2, "a", "b"), (3, "zz", "b")], "i long, a string, b string")
    both = Dataset.of("d", "d", df, "i", [Field("a"), Field("b")])
    verdicts = lambda d, t: [r.verdict for r in dedup.analyze(d, None, t).orderBy("_pos").collect()]
    assert verdicts(both, 0.9) == ["UNIQUE", "EXACT", "UNIQUE", "UNIQUE"]
    assert verdicts(both.select_fields(["a"]), 0.9) == ["UNIQUE", "UNIQUE", "UNIQUE", "UNIQUE"]
    assert verdicts(both, 0.0) == ["UNIQUE", "EXACT", "LIKELY", "LIKELY"]
    assert dedup.analyze(both.filter(both.df["_pos"] < 0)).count() == 0


def _reps(spark, texts):
    rows = [(i, [t], [sorted(grams(t))]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "_pos long, n array<string>, grams array<array<string>>")


def test_unlike_rows_with_a_rare_run_are_not_compared_in_full(spark, monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    texts = [" ".join([*rng.sample(words, 5), "zq"]) for _ in range(300)]
    texts += [t + "x" for t in texts[:10]]
    monkeypatch.setattr(dedup, "similarity", lambda *_: dedup.F.lit(1.0))
    assert 10 <= dedup.similar(_reps(spark, texts), 0.6).count() < 100


@pytest.mark.parametrize("threshold", [0.2, 0.6, 0.8, 0.95, 1.0])
def test_long_lists_fall_into_blocks(spark, monkeypatch, threshold):
    """Lists of more than a block, and short, long and equal rows in them: all pairs, each once."""
    monkeypatch.setattr(dedup, "BLOCK", 7)
    monkeypatch.setattr(dedup, "ENTRIES", 50)
    monkeypatch.setattr(dedup, "AT_ONCE", 16)
    rng = random.Random(9)
    words = ["".join(rng.choice("abcd") for _ in range(4)) for _ in range(12)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 4, 5, 40]))) for _ in range(60)] + ["a", "", "aaaa aaaa", "aaaa"]
    want = sorted((i, j, round(s, 9)) for j in range(len(texts)) for i in range(j) if (s := like([texts[i]], [texts[j]])) >= threshold and texts[j])
    got = sorted((r.a, r.b, round(r.score, 9)) for r in dedup.similar(_reps(spark, texts), threshold).collect())
    assert got == [w for w in want if texts[w[0]]]
