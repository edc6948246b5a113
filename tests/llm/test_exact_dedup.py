import hashlib
import random

import pytest

from gleaner.llm.exact_dedup import DigestIndex, dedup

SCHEMA = "doc_id long, text string, digest int"
BLANKS = str.maketrans("", "", " \t\n\x0b\f\r")


def plain_groups(rows):
    found = {}
    for i, text, *_ in rows:
        found.setdefault((text or "").translate(BLANKS), []).append((-len(text or ""), i is None, i or 0, i))
    return {t: (min(g)[3], len(g)) for t, g in found.items()}


def verdicts(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=repr)


def random_rows(n, seed):
    rng = random.Random(seed)
    words = ["a", "b", "ab", "é ", "", "\t", "x\n", "🙂"]
    return [(i, rng.choice([" ", "", "\r\n"]).join(rng.choices(words, k=rng.randint(0, 4))), 1) for i in range(n)]


def test_against_brute_force(spark):
    rows = random_rows(600, 1) + [(1000, None, 1), (None, "a b", 1), (None, "  solo", 1)]
    want = plain_groups(rows)
    got = verdicts(dedup(spark.createDataFrame(rows, SCHEMA).repartition(5)))
    assert len(got) == len(rows)
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in want.items()}
    assert {(r[4], r[1], r[2]) for r in got} == {(h, *v) for h, v in by_digest.items()}
    assert sum(r[3] for r in got) == len(want) and all(r[0] == r[1] for r in got if r[3])


def test_repeated_rows_keep_one(spark):
    got = verdicts(dedup(spark.createDataFrame([(7, "a b", 1)] * 50 + [(7, "ab", 1)], SCHEMA).repartition(4)))
    assert [r[3] for r in got].count(True) == 1 and {r[1:3] for r in got} == {(7, 51)}


def test_very_long_and_empty(spark):
    long = "word " * 300_000
    got = verdicts(dedup(spark.createDataFrame([(1, long, 1), (2, long + "\n", 1), (3, "", 1), (4, " \t", 1), (5, None, 1)], SCHEMA)))
    assert [(r[0], r[1], r[3]) for r in got] == [(1, 2, False), (2, 2, True), (3, 4, False), (4, 4, True), (5, 4, False)]
    assert dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_later_batches_meet_earlier_ones(spark, tmp_path):
    index = DigestIndex(spark, f"file://{tmp_path}/index", buckets=3)
    index.add(spark.createDataFrame([(1, "a b", 1), (2, "c", 1)], SCHEMA), "one")
    # opened anew, as a later session would
    index = DigestIndex(spark, f"file://{tmp_path}/index", buckets=99)
    assert index.buckets == 3
    second = [(3, "a  b", 1), (4, "d", 1), (5, " d", 1)]
    got = {r.doc_id: (r.keep_id, r.kept, r.known, r.group_size) for r in index.add(spark.createDataFrame(second, SCHEMA), "two").collect()}
    assert got == {3: (1, False, True, 1), 4: (5, False, False, 2), 5: (5, True, False, 2)}
    assert sorted(r.doc_id for r in index.entries().collect()) == [1, 2, 5]
    # a second attempt at a batch replaces the first
    again = {r.doc_id: (r.keep_id, r.kept) for r in index.add(spark.createDataFrame(second, SCHEMA), "two").collect()}
    assert again == {3: (1, False), 4: (5, False), 5: (5, True)}
    assert sorted(r.doc_id for r in index.entries().collect()) == [1, 2, 5]
    index.compact()
    assert len(index.batches()) == 1
    got = {r.doc_id: (r.keep_id, r.kept) for r in index.add(spark.createDataFrame([(8, "c ", 1), (9, "e", 1)], SCHEMA), "three").collect()}
    assert got == {8: (2, False), 9: (9, True)}
    assert sorted(r.doc_id for r in index.entries().collect()) == [1, 2, 5, 9]


def test_batch_that_broke_off_is_not_read(spark, tmp_path, monkeypatch):
    index = DigestIndex(spark, f"file://{tmp_path}/index", buckets=2)
    index.add(spark.createDataFrame([(1, "a", 1)], SCHEMA), "one")

    def broken(*_):
        raise OSError("lost")

    monkeypatch.setattr(DigestIndex, "_note", broken)
    with pytest.raises(OSError):
        index.add(spark.createDataFrame([(2, "b", 1)], SCHEMA), "two")
    monkeypatch.undo()
    got = index.add(spark.createDataFrame([(3, "b", 1), (4, "a", 1)], SCHEMA), "two").collect()
    assert {r.doc_id: r.kept for r in got} == {3: True, 4: False}


def test_the_index_is_read_without_a_shuffle(spark, tmp_path):
    index = DigestIndex(spark, f"file://{tmp_path}/index", buckets=4)
    index.add(spark.createDataFrame(random_rows(200, 2), SCHEMA), "one")
    folder = next(iter(index.batches().values()))
    new = index.entries().repartition(4, "digest").join(index._bucketed(folder).select("digest").hint("merge"), "digest", "left_anti")
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1 and "Bucketed: true" in plan
    assert new.count() == 0
