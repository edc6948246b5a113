import random

import pytest

from gleaner.llm.common import components, crc_mod


def plain(edges):
    root = {v: v for e in edges for v in e}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {v: find(v) for v in root}


@pytest.mark.parametrize("shape", ["random", "path", "star", "loops"])
def test_components(spark, shape):
    rng = random.Random(shape)
    names = rng.sample(range(-(10**12), 10**12), 120)
    if shape == "random":
        edges = [(rng.choice(names), rng.choice(names)) for _ in range(90)]
    elif shape == "path":
        edges = list(zip(names, names[1:]))
    elif shape == "star":
        edges = [(names[0], x) for x in names[1:]] + [(names[5], names[6])] * 3
    else:
        edges = [(names[0], names[0]), (names[1], names[2]), (names[2], names[1])]
    got = {r.v: r.c for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {v: c for v, c in plain(edges).items() if any(v in e for e in edges if e[0] != e[1])}
    assert got == want


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_folds(spark):
    import zlib

    rows = spark.createDataFrame([(1,), (77,), (None,)], "d long")
    assert [r[0] for r in rows.select(crc_mod(rows.d, 10)).collect()] == [zlib.crc32(b"1") % 10, zlib.crc32(b"77") % 10, zlib.crc32(b"") % 10]
