import hashlib
import random
import time
from collections import Counter

from gleaner.llm.suffix_dedup import merged, remove_repeats

SCHEMA = "doc_id long, text string"


def brute(rows, depth):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + depth] for b in texts for i in range(len(b) - depth + 1))
    out = []
    for (d, _), b in zip(rows, texts):
        runs = merged([(i, i + depth) for i in range(len(b) - depth + 1) if seen[b[i : i + depth]] > 1])
        kept, at = b"", 0
        for s, e in runs:
            kept, at = kept + b[at:s], e
        kept += b[at:]
        out.append((d, len(b), len(b) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, depth=200):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = remove_repeats(df, depth).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, depth)
    return got


def test_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdeé ", k=rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(60) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [prose(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a, b = sorted(rng.sample(range(len(s)), 2))
            parts += [s[a:b] if rng.random() < 0.7 else s, prose(rng.randint(0, 30))]
        rows.append((i, "".join(parts)))
    rows += [(100, rows[0][1]), (101, None), (102, ""), (103, "a" * 450), (104, "ab" * 300), (105, "x" * 199), (106, "y" * 200)]
    rows += [(107, "z" * 200), (107, "z" * 200), (None, prose(90)), (108, rows[3][1][:150]), (109, prose(3000) + shared[0])]
    got = {r[0]: r for r in check(spark, rows)}
    assert got[103][2] == 450 and got[107][2] == 200 and got[106][2] == 0


def test_windows_one_byte_apart(spark):
    base = "".join(random.Random(1).choices("abcdefgh", k=400))
    check(spark, [(1, base[:200]), (2, "!" + base[:200]), (3, base[:199] + "?"), (4, base[1:201]), (5, base[100:300]), (6, base[150:349] + "#")])


def test_other_depth_extra_columns_and_empty(spark):
    rows = [(i, f"{i} " + "lorem ipsum dolor sit amet " * (i % 4)) for i in range(20)]
    check(spark, rows, 64)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as k", "1 as bytes", "2 as n")
    assert remove_repeats(df, 64).count() == 20
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_very_long_texts(spark):
    rng = random.Random(21)
    fresh = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz é", k=n))
    shared, short = fresh(700), fresh(150)
    long = fresh(1_500_000) + "#" + shared + "#" + fresh(400_000) + "#" + short
    rows = [(1, long), (2, "%" + shared + "%" + short), (3, fresh(300) + "&" + short)]
    got = {r.doc_id: r for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), depth=200).collect()}
    n = len(shared.encode())
    assert [(got[i].n_removed, got[i].n_spans) for i in (1, 2, 3)] == [(n, 1), (n, 1), (0, 0)]
    at = long.encode().index(shared.encode())
    assert got[1].spans == [[at, at + n]] and got[1].n_bytes == len(long.encode())


def test_many_equal_rows(spark):
    """Costs grow with the rows, not with the square of equal ones."""
    rng = random.Random(8)
    same = "".join(rng.choices("abcdefgh ", k=10_000))
    other = "".join(rng.choices("ijklmnop ", k=900))
    rows = [(7, same)] * 2000 + [(1, other + same[500:800]), (2, other[100:350])]
    started = time.monotonic()
    got = remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(4)).select("doc_id", "n_bytes", "n_removed", "n_spans").collect()
    assert time.monotonic() - started < 120
    assert Counter(map(tuple, got)) == {(7, 10_000, 10_000, 1): 2000, (1, 1200, 550, 2): 1, (2, 250, 250, 1): 1}
