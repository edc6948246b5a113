"""Results of one meaning in lists that no task holds, against the loop that goes through each list."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import meaning
from gleaner.operators import results as rs

COLUMNS = ", ".join(x for x in rs.SCHEMA.split(", ")) + ", q string, e array<double>"


def unit(v):
    n = float(np.linalg.norm(v))
    return v / n if n else v


def loop(rows, threshold):
    """Going through each list in order."""
    out = []
    for q in {r["q"] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r["q"] == q), key=lambda r: r["_pos"]):
            v = unit(np.array(r["e"])) if r["e"] else None
            words = {w for w in r["title"].lower().split() if len(w) > 2}
            hit = None
            for k in kept:
                if v is not None and k["v"] is not None:
                    same = len(v) == len(k["v"]) and float(v @ k["v"]) >= threshold
                else:
                    same = bool(words & k["w"]) and len(words & k["w"]) / len(words | k["w"]) >= rs.SAME_TOKENS
                if same:
                    hit = k
                    break
            use = (r["direct_url"] is not None, r["size_bytes"] or 0, len(r["title"]))
            if hit is None:
                kept.append({"v": v, "w": words, "use": use, "row": r, "p": r["_pos"]})
            elif use > hit["use"]:
                hit.update(w=words, use=use, row=r)
        out += [(q, k["p"], k["row"]["title"], k["row"]["size_bytes"]) for k in kept]
    return sorted(out, key=str)


def rows_of(seed, n, lists, vectors):
    """Some equal, some alike, some apart; vectors: the share of results that have one."""
    rng = random.Random(seed)
    words = "alpha beta gamma delta epsilon zeta theta kappa".split()
    centres = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(6)]
    out = []
    for i in range(n):
        e = None
        if rng.random() < vectors:
            c = rng.choice(centres)
            e = c if rng.random() < 0.3 else [x + rng.gauss(0, 0.25) for x in c]
            e = rng.choice([e, e, e, e, e, e, [0.0] * 4, e[:3]])
        title = " ".join(rng.sample(words, rng.randint(5, 7))) if rng.random() < 0.6 else rng.choice(["alpha beta gamma delta epsilon", "of it", ""])
        row = dict.fromkeys(x.split()[0] for x in COLUMNS.split(", "))
        row.update(title=title, extra={}, _pos=i * 3, q=rng.choice(lists), e=e, direct_url=rng.choice([None, None, "d"]), size_bytes=rng.choice([None, 3, 5, 9]))
        out.append(row)
    return out


@pytest.mark.parametrize(("vectors", "threshold", "lists"), [(1.0, 0.86, ["a", None]), (1.0, 0.97, ["a"]), (0.0, 0.86, ["a", "b"]), (0.5, 0.9, ["a", None]), (0.9, 0.7, ["a"])])
def test_against_the_loop(spark, monkeypatch, vectors, threshold, lists):
    monkeypatch.setattr(meaning, "GRID", 30)
    monkeypatch.setattr(meaning.drop_in_long_lists, "__defaults__", (8 * 4 * 20, 10))
    rows = rows_of(int(threshold * 100) + len(lists), 160, lists, vectors)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], COLUMNS).repartition(4)
    for by, most in ((("q",), 1000), (("q",), 5), ((), 5)):
        got = rs.drop_same_meaning(df, by, "e" if vectors else None, threshold, most)
        assert got.columns == df.columns
        want = loop(rows if by else [r | {"q": None} for r in rows], threshold)
        found = [(r.q if by else None, r["_pos"], r.title, r.size_bytes) for r in got.collect()]
        assert sorted(found, key=str) == want


def test_a_hot_group_leaves_one_row_a_round(spark):
    """Nine tenths of a list are near copies of one vector; no pairs of them are made."""
    df = spark.range(30_000).selectExpr("id as v", "0L as list", "if(id % 10 = 0, array(sin(id), cos(id * 7), sin(id * 3), cos(id * 11)), array(1D, 1D, 1D, 1 + id / 1e9)) as vec")
    placed = meaning.by_vectors(df, 0.999, 8 * 4 * 200)
    assert placed.count() == 30_000 and placed.select("v").distinct().count() == 30_000
    hot = placed.where("v % 10 <> 0").select("place").distinct().collect()
    assert len(hot) == 1 and placed.where("place > v").isEmpty()
    places = placed.select("place").distinct()
    assert placed.where("v = place").count() == places.count() and places.join(placed.where("v <> place").select(F.col("v").alias("place")), "place", "left_semi").isEmpty()
