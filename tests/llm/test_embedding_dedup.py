import math
import random

import numpy as np

from gleaner.llm.embedding_dedup import agree_rate, layout, miss_rate, near_duplicates


def brute(rows, threshold):
    ok = [i for i, (_, e, lb) in enumerate(rows) if lb is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    link, root = {i: set() for i in range(len(rows))}, list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ok:
        for b in ok:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                    link[a].add(b), link[b].add(a)
                    root[find(b)] = find(a)
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), math.inf), rows[i][0])
    return sorted((rows[i][0], len(link[i]), least[find(i)], rows[i][0] == least[find(i)]) for i in range(len(rows)))


def corpus():
    rng = np.random.default_rng(3)
    rows, centres = [], rng.standard_normal((12, 24))
    for i in range(420):
        c = centres[rng.integers(12)]
        noise = rng.standard_normal(24) * rng.choice([0.05, 0.25, 0.4, 2.0])
        rows.append((i * 3, (c + noise).astype(np.float32).tolist(), int(rng.integers(3)) if i % 40 else None))
    rows += [(2000 + i, rows[5][1], rows[5][2]) for i in range(30)]
    rows += [(3000, None, 1), (3001, [], 1), (3002, [0.0] * 24, 1), (3003, [None] + [1.0] * 23, 1), (3004, [float("nan")] * 24, 1), (3005, [float("inf")] + [0.0] * 23, 1)]
    rows += [(3006, [1e-30] * 24, 1), (3007, [1e30] * 24, 1), (3008, [1.0, 2.0], 1), (3009, [1.0, 2.01], 1), (2, rows[7][1], rows[7][2])]
    random.Random(1).shuffle(rows)
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as v", "2 as m", "3 as codes").repartition(5)
    want = brute(rows, 0.93)
    for block in (512, 7):
        assert sorted(map(tuple, near_duplicates(df, block=block).collect())) == want
    assert near_duplicates(df.limit(0)).count() == 0


def test_miss_rate():
    assert miss_rate(0.93, 2.0, 8, 28) < 2e-4 and miss_rate(0.99, 2.0, 8, 28) < miss_rate(0.93, 2.0, 8, 28) and miss_rate(1.0, 2, 8, 28) == 0


def test_layout():
    for n in (1, 100, 10_000, 10**9):
        projections, tables = layout(n, 0.93, 2.0)
        assert miss_rate(0.93, 2.0, projections, tables) < 2e-4 and n * agree_rate(0.0, 2.0) ** projections <= 0.1 + 1e-9
    assert layout(10**9, 0.93, 2.0)[1] < 10 * layout(10**5, 0.93, 2.0)[1]
