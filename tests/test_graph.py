import random

import pytest

from gleaner.functions import graph, storage


def one_by_one(edges):
    before, kept = {}, {}
    for a, b in edges:
        before.setdefault(b, set()).add(a)
    for v in sorted({x for e in edges for x in e}):
        kept[v] = not any(kept[a] for a in before.get(v, ()))
    return kept


def found(spark, edges, piece):
    df = spark.createDataFrame(edges, "a long, b long")
    rows = graph.first_come(df, piece).collect()
    assert len(rows) == len({r["_pos"] for r in rows})
    return {r["_pos"]: r["kept"] for r in rows}


@pytest.mark.parametrize("piece", [1_000_000, 30])
def test_against_the_loop(spark, piece):
    rng = random.Random(piece)
    edges = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(70)}  # one large component and some small ones
    edges |= {(100 + i, 101 + i) for i in range(40)} | {(200, 200 + i) for i in range(1, 40)} | {(300 + i, 400) for i in range(40)}
    assert found(spark, sorted(edges), piece) == one_by_one(edges)
    storage.sweep(spark)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, tables = 100_000, []
    written = graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: tables.append(name) or written(df, name))
    edges = spark.range(n - 1).selectExpr("id as a", "id + 1 as b")
    rows = graph.first_come(edges).where("kept").selectExpr("count(*) as n", "sum(_pos % 2) as odd").first()
    assert (rows.n, rows.odd) == (n // 2, 0) and tables.count("open") < 20
    storage.sweep(spark)


def test_no_edges(spark):
    assert found(spark, [], 10) == {} and graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
