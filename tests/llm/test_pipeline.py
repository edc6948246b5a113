"""Each stage of the pipeline against a plain version, on its predecessor's rows."""

import os
from collections import Counter, defaultdict

import pytest
from tests.llm.test_jaccard import plain_groups
from tests.llm.test_mixing import targets
from tests.llm.test_packing import HF
from tests.llm.test_quality import failed, plain

import corpus_pipeline
from gleaner.llm.packing import cut
from gleaner.llm.pii import pseudonyms

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [docs.collect()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{root}/{i}")
        docs = spark.read.parquet(f"{root}/{i}")
        found.append((docs.columns, docs.collect()))
    return [(COLUMNS, found[0]), *found[1:]]


def key(r):
    return str([r[c] for c in COLUMNS])


def test_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5 and all(c == COLUMNS for c, _ in stages[:-1])


def test_quality(stages):
    want = [r for r in stages[0][1] if not failed(plain(r.text)[0], plain(r.text)[4])]  # too few labels here to certify a cutoff
    assert sorted(map(key, stages[1][1])) == sorted(map(key, want))


def test_near_dedup(stages):
    rows = sorted(stages[1][1], key=lambda r: r.doc_id)
    group = plain_groups([r.text for r in rows])  # five words, Jaccard of 0.8 or more
    assert sorted(map(key, stages[2][1])) == sorted(key(r) for i, r in enumerate(rows) if group[i] == i)


def test_pii(stages):
    want = []
    for r in stages[2][1]:
        t = pseudonyms(r.text)[0]
        want.append(str([r.doc_id, t, r.lang, r.source, len(t)]))
    assert sorted(map(key, stages[3][1])) == sorted(want)


def test_mixing(stages):
    before, sizes, taken = {r.doc_id: r for r in stages[3][1]}, defaultdict(int), defaultdict(int)
    for r in before.values():
        sizes[r.source] += plain(r.text)[0]
    for r in stages[4][1]:
        old = before[r.doc_id]
        n = plain(r.text)[0]
        assert 0 < n <= plain(old.text)[0] and (r.lang, r.source) == (old.lang, old.source) and r.n_chars == len(r.text)
        taken[r.source] += n
    order = sorted(sizes)
    for s, want in zip(order, targets([sizes[s] for s in order])):
        assert abs(taken[s] - want) <= 0.02 * want + 5
    assert max(Counter(r.doc_id for r in stages[4][1]).values()) <= 2


def test_packing(stages):
    want = Counter()
    for r in stages[4][1]:
        n = len(HF.encode(r.text, add_special_tokens=False).ids) + 1
        want.update((r.doc_id, p, s, m) for p, (s, m) in enumerate(cut(n, 2048)))
    got = stages[5][1]
    assert Counter((r.doc_id, r.piece, r.start, r.length) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    assert all(sorted(b)[i][0] == sum(n for _, n in sorted(b)[:i]) for b in bins.values() for i in range(len(b)))
    assert len(bins) <= -(-sum(r.length for r in got) // 2048) + 1


def test_registered_run(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() == len(stages[5][1]) and corpus_pipeline.ORACLE_SQL is None


def edges():
    """Null and repeated ids, null, empty, very long and equal texts; a column too many, and some named like the operators' own."""
    word = lambda i: f"w{i * 7919 % 100_003}"
    text = lambda a, n: " ".join(word(i) for i in range(a, a + n))
    rows = [
        (None, text(0, 80)), (None, text(500, 90)), (None, None), (7, None), (7, ""), (7, " \n\t"), (8, text(1000, 70)), (8, text(2000, 70)), (9, text(3000, 60)), (9, text(3000, 60)), (10, text(3000, 60)),
        (11, text(5000, 60_000)), (12, "short"), (13, "same " * 80), (-1, text(90_000, 64)),
    ]
    return [(d, t, "en" if i % 3 else None, ["a", "b", None][i % 3], len(t or ""), i, i, i, i) for i, (d, t) in enumerate(rows)]


MORE = "doc_id long, text string, lang string, source string, n_chars long, _judged long, _row long, f long, copies long"


@pytest.mark.parametrize("number", range(5))
def test_edges_of_each_stage(spark, tmp_path, number):
    name, stage = corpus_pipeline.STAGES[number]
    spark.createDataFrame([(8, 1), (8, None), (None, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = edges()
    df = spark.createDataFrame(rows, MORE).repartition(4)
    df.write.parquet(f"{tmp_path}/in")
    got = stage(spark, spark.read.parquet(f"{tmp_path}/in"), str(tmp_path)).collect()
    pairs = sorted(((str(r.doc_id), r.text) for r in got), key=str) if number < 4 else None
    texts = [(d, t) for d, t, *_ in rows]
    long = [(d, t) for d, t in texts if len((t or "").split()) >= 50 and t != "same " * 80]
    if number == 0:
        assert pairs == sorted(((str(d), t) for d, t in long), key=str)
    elif number == 1:  # copies go, other texts under null or equal ids stay; of texts without words one stays
        want = [(d, t) for d, t in texts if (t or "").strip() and (d, t) != (10, rows[9][1])]
        want.remove((9, rows[9][1]))
        assert sorted(p for p in pairs if (p[1] or "").strip()) == sorted((str(d), t) for d, t in want)
        assert [p[0] for p in pairs if not (p[1] or "").strip()] == ["7"]
    elif number == 2:
        assert pairs == sorted(((str(d), t) for d, t in texts), key=str)  # nothing personal in them
    elif number == 3:
        size = lambda t: len((t or "").split())
        have, took = defaultdict(int), defaultdict(int)
        for d, t in texts:
            have[str(d)] += size(t)
        for r in got:
            assert r.text.split() and set(r.text.split()) <= {w for d, t in texts if d == r.doc_id for w in (t or "").split()}
            took[str(r.doc_id)] += size(r.text)
        assert all(n <= 2 * have[d] for d, n in took.items()) and sum(took.values()) > 1.4 * sum(have.values())
    else:
        want = Counter()
        for d, t in texts:
            n = len(HF.encode(t or "", add_special_tokens=False).ids) + 1
            want.update((d, p, s, m) for p, (s, m) in enumerate(cut(n, 2048)))
        assert Counter((r.doc_id, r.piece, r.start, r.length) for r in got) == want
    if number < 4:
        assert all(set(r.asDict()) == set(COLUMNS) for r in got)
    assert stage(spark, spark.read.parquet(f"{tmp_path}/in").limit(0), str(tmp_path)).count() == 0


def test_two_runs_in_one_driver(spark, tmp_path):
    """Each thread removes its own tables only, and leaves none."""
    import threading
    from pathlib import Path

    root = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before, counts, errors = set(os.listdir(root)) if root.exists() else set(), [], []

    def one(k):
        try:
            corpus_pipeline.run(spark, SF).write.parquet(f"{tmp_path}/{k}")
            corpus_pipeline.release(spark)
            counts.append(spark.read.parquet(f"{tmp_path}/{k}").count())
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=one, args=(k,)) for k in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and len(set(counts)) == 1 and len(counts) == 2
    assert set(os.listdir(root)) == before
