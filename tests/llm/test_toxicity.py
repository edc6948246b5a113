import random

from gleaner.llm.common import crc_mod
from gleaner.llm.toxicity import Lexicon, classify, fold, learn, score


def test_fold():
    assert fold("Ídiоt 1D10T pаthetic$$ a@b 2024 $5") .split() == ["idiot", "idiot", "pathetic", "aab", "2024", "5"]
    assert fold(None) == "  " and fold("ｗｏｒｄ").split() == ["word"]


def plain_rate(lexicon, text):
    """Term by term, without an automaton."""
    t, best = fold(text), {}
    for term, w in lexicon.terms.items():
        at = t.find(term)
        while at >= 0:
            best[at] = max(best.get(at, 0.0), w)
            at = t.find(term, at + 1)
    for e in lexicon.exceptions:
        at = t.find(e)
        while at >= 0:
            best = {s: w for s, w in best.items() if not at <= s < at + len(e) - 1}
            at = t.find(e, at + 1)
    return 100 * sum(w for w in best.values() if w > 0) / max(1, len(t.split()))


def test_rate_against_brute_force():
    rng = random.Random(1)
    words = ["idiot", "idiotic", "clown", "clownfish", "not", "an", "the", "sea", "1diot", "cl0wn"]
    lexicon = Lexicon({" idiot": 2.0, " idiotic ": 5.0, " clown ": 3.0}, (" not idiot ", " clown sea "))
    for _ in range(300):
        text = " ".join(rng.choices(words, k=rng.randint(0, 14)))
        assert abs(lexicon.rate(text) - plain_rate(lexicon, text)) < 1e-9
    assert lexicon.rate("") == lexicon.rate(None) == 0 and Lexicon().rate("idiot") == 0
    assert lexicon.score("idiot") > lexicon.score("idiot " + "fine " * 200) > lexicon.score("fine")


def corpus(n=900):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randint(0, 99)}n" for _ in range(rng.choice([8, 60, 400]))]
        if toxic:
            for _ in range(max(1, len(words) // 40)):
                words[rng.randrange(len(words))] = rng.choice(["grobnik", "Gr0bnik!", "loathling", "lоathlings"])
        elif i % 20 == 1:
            at = rng.randrange(len(words) - 1)
            words[at : at + 2] = ["museum", "grobnik"]
        rows.append((i, " ".join(words)))
        if i % 10:
            labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_no_leak(spark):
    rows, labels = corpus()
    rows += [(5000, None), (5001, ""), (None, "x"), (5002, "fine " * 30_000 + "grobnik"), rows[4], rows[4]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as toxic", "1 as score").repartition(4)
    got = classify(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    found = got.collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    held = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert len(held) > 200
    right = [r for r in held if r.predicted == (r.doc_id % 4 == 0)]
    assert len(right) >= 0.97 * len(held)
    by = {r.doc_id: r for r in found}
    assert by[5000].score == by[5001].score < 0.5
    # labels of the held-out fold change nothing
    wrong = spark.createDataFrame(labels, "doc_id long, toxic int").selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 1 - toxic else toxic end as toxic")
    again = {r.doc_id: r.score for r in classify(docs, wrong).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-12 for r in found)


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    lexicon = learn(docs, none)
    assert lexicon.terms == {} and score(docs, lexicon).count() == 2 and score(docs.limit(0), lexicon).count() == 0
    assert docs.select(crc_mod(docs.doc_id, 3)).count() == 2


def test_repeated_rows_and_long_texts_in_learning(spark):
    rows, labels = corpus()
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    want = learn(docs, known)
    assert want.terms and want.exceptions
    # copies of a labelled row, of a label, and null labels and ids change nothing
    more = docs.union(spark.createDataFrame([rows[4]] * 300 + [rows[7]] * 40 + [(None, "grobnik")] * 9, docs.schema))
    again = known.union(spark.createDataFrame([labels[3]] * 50 + [(None, 1), (8, None)], known.schema))
    got = learn(more.repartition(6), again)
    assert got.terms == want.terms and got.exceptions == want.exceptions and abs(got.bias - want.bias) < 1e-9
    # a term that only very long texts have is learned from them
    long = [(7000 + i, "fine day " * 20_000 + "vexatrix") for i in range(40)] + [(7100 + i, "fine day " * 20_000) for i in range(40)]
    got = learn(docs.union(spark.createDataFrame(long, docs.schema)), known.union(spark.createDataFrame([(d, int(d < 7100)) for d, _ in long], known.schema)))
    assert any(t.startswith(" vexa") for t in got.terms)


def test_neighbours_of_a_term():
    from gleaner.llm.toxicity import _pairer

    folded = fold("a" * 500 + "  idiot   " + "b" * 500 + " the idiot")
    assert _pairer({" idiot": 1.0})(folded) == {f" {'a' * 500} idiot ", f" idiot {'b' * 500} ", " the idiot "}
