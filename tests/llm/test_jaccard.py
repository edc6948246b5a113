"""The pipeline's near-dedup against Jaccard similarity by brute force."""

import random

import numpy as np

import corpus_pipeline
from gleaner.llm.jaccard import bands, near_copies, parity, shingles


def plain_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\f\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_groups(texts):
    sets = [plain_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]) and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def edited():
    rng = random.Random(4)
    base = [[f"w{rng.randint(0, 300)}É" for _ in range(rng.randint(3, 250))] for _ in range(12)]
    texts = [None, "", " \n", "One", "ONE", "one two", "a b c d e", "A b\tc d e f"]
    for _ in range(120):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, max(1, len(words) // 25))):
            words[rng.randrange(len(words))] = f"edit{rng.randint(0, 9)}"
        texts.append(rng.choice([" ", "\n", "\t  "]).join(words))
    return texts


def found(df):
    rows, groups = near_copies(df)
    return {r.i: r._component for r in rows.join(groups, "_row").collect()}


def test_near_copies_against_brute_force(spark):
    texts = edited()
    want = plain_groups(texts)
    assert 15 < len(set(want)) < 100
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").repartition(5)
    got = found(df)
    assert sorted(got) == list(range(len(texts)))
    assert all(got[i] == got[w] for i, w in enumerate(want)) and len(set(got.values())) == len(set(want))
    assert len(found(df.limit(0))) == 0


def test_large_cluster(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(104)]
    texts = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.choice([1, 1, 1, 2, 3, 5])):
            words[rng.randrange(len(words))] = f"edit{i}"
        texts.append(" ".join(words))
    want = plain_groups(texts)
    assert 3 < len(set(want)) < 100
    got = found(spark.createDataFrame(list(enumerate(texts)), "i long, text string"))
    assert all(got[i] == got[w] for i, w in enumerate(want)) and len(set(got.values())) == len(set(want))


def test_stage_keeps_the_first_of_each_group(spark):
    texts = edited()[5:]
    want = {i for i, g in enumerate(plain_groups(texts)) if g == i}
    df = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, df, "").collect()} == want


def test_null_and_equal_ids_in_the_stage(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (-1, a + " z"), (9, d), (-1, b + " y q r s t u v w x z k l m n"), (None, None)]
    df = spark.createDataFrame([(i, t, "en", "web", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.simhash_near_dedup(spark, df, "").collect()), key=str)
    assert got == sorted([(None, b), (7, c), (7, d), (-1, a + " z"), rows[7], (None, None)], key=str)


def test_bounds_hold():
    rng = random.Random(2)
    for _ in range(200):
        a, b = (shingles(" ".join(f"w{rng.randint(0, 60)}" for _ in range(rng.randint(1, 80))), rng.choice([1, 5])) for _ in "ab")
        bits = int(np.unpackbits((parity(a) ^ parity(b)).view(np.uint8)).sum())
        assert bits <= len(set(a.tolist()) ^ set(b.tolist()))


def test_pairs_at_the_limit_share_a_key():
    rng = random.Random(6)
    for _ in range(200):
        n = rng.choice([9, 45, 450])
        both, rest = n * 8 // 9, n - n * 8 // 9
        words = [f"x{rng.getrandbits(40)}" for _ in range(both + 2 * rest)]
        rng.shuffle(words)
        a = shingles(" ".join(words[: both + rest]), 1)
        b = shingles(" ".join(words[:both] + words[both + rest :]), 1)
        assert 5 * len(set(a) & set(b)) >= 4 * (len(set(a) | set(b))) and set(bands(a)) & set(bands(b))
