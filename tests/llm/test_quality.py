import random
import re

from gleaner.llm.common import WORD
from gleaner.llm.quality import GRID, assess, at_most, keep_good


def plain(text):
    t = text or ""
    words = re.findall(WORD, t)
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = {i + d for at in windows.values() if len(at) > 1 for i in at for d in range(3)}
    lines = [x for x in t.split("\n") if re.search(WORD, x)]
    return len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated)


def failed(n_words, n_repeat):
    return n_words < 50 or 100 * n_repeat > 50 * n_words


def test_counts_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(1, None, "en"), (2, "", "en"), (3, " \n\t\x0b\x0c\r", None), (4, "one", "de"), (5, "a b c a b c", "de"), (6, "x " * 30_000, "fr")]
    for i in range(7, 80):
        vocabulary = [f"w{j}" for j in range(rng.choice([3, 20, 500]))] + ["Ünï|<>", "#*$%&", " é "]
        rows.append((i, "".join(rng.choice(vocabulary) + rng.choice([" ", "\n", "\r\n", "\t", "\x0b"]) for _ in range(rng.randint(0, 200))), rng.choice(["en", None])))
    rows += [rows[8], (None, rows[9][1], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as f", "2 as stratum", "3 as quality")
    labels = spark.createDataFrame([(7, 1), (7, 0), (8, None), (None, 1)], "doc_id long, quality int")
    got = assess(docs, labels).collect()
    want = sorted(((d, *plain(t), failed(plain(t)[0], plain(t)[4])) for d, t, _ in rows), key=str)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=str) == want
    assert all(r.kept == (not r.base_failed) for r in got)  # four labels certify nothing
    assert assess(docs.limit(0), labels).count() == 0
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(not x[-1] for x in want)


def test_binomial_tail():
    from fractions import Fraction
    from math import comb

    for k, n, p in ((0, 10, 0.1), (3, 10, 0.1), (9, 200, 0.02), (10, 10, 0.5), (40, 1000, 0.05)):
        exact = sum(comb(n, i) * Fraction(p) ** i * (1 - Fraction(p)) ** (n - i) for i in range(k + 1))
        assert abs(at_most(k, n, p) - float(exact)) < 1e-9


def test_cutoffs_keep_good_and_reject_bad(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(2600):
        lang, bad = ("en", i % 4 == 0) if i < 2400 else ("rare", i % 2 == 0)
        words = [f"w{rng.randint(0, 9999)}" + ("%%%" if bad else "") for _ in range(60)]
        rows.append((i, " ".join(words), lang))
        if i % 5:
            labels.append((i, 0 if bad else 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.kept for r in assess(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert all(got[i] == (i % 4 != 0) for i in range(2400))
    assert all(got[i] for i in range(2400, 2600))  # too few labels to certify a cutoff for this stratum
    assert list(GRID) == sorted(GRID, reverse=True)
