"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton over folded text.

Folding undoes what hides a word: compatibility forms and accents go, letters of other scripts that look like Latin
ones become those, and digits or signs that stand for letters inside a word become the letters. All else but letters
and digits is a blank, so that a term can ask for the start, or both ends, of a word.

A term is the start of a word, or a whole word; it has a weight. A document's rate is the summed weight of the terms
found, the heaviest at each word, less those inside an exception phrase, for each hundred words. The score is a
logistic function of the rate's logarithm.

Lexicon, exceptions and the two parameters of the score are learned from labelled documents: a term is a word start
(or word) found in many toxic and few other documents, weighed by the log odds less what chance may have added; an exception is a term with the word
before or after it that others have and toxic documents lack.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import crc_mod, written

# Letters of other scripts by the Latin letter they look like.
LOOKS_LIKE = {
    "a": "аαɑ", "b": "вβ", "c": "сϲ", "d": "ԁ", "e": "еεє", "h": "нһ", "i": "іιı", "j": "јϳ", "k": "кκ", "l": "ӏ", "m": "м", "n": "п",
    "o": "оοσө", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "t": "тτ", "u": "υ", "v": "ѵν", "w": "ԝω", "x": "хχ", "y": "уγү", "z": "ᴢ",
}
# Digits and signs by the letter they stand for.
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}

SHORTEST, LONGEST = 4, 12


class _Fold(dict):
    """Code point to folded text, filled as characters come."""

    def __missing__(self, code: int) -> str:
        latin = {x: k for k, v in LOOKS_LIKE.items() for x in v}
        out = []
        for c in unicodedata.normalize("NFKD", chr(code).lower()):
            if not unicodedata.combining(c):
                c = latin.get(c, c)
                out.append(c if c.isalnum() or c in "@$" else " ")
        self[code] = found = "".join(out)
        return found


_FOLD = _Fold()
_SIGNS = re.compile(r"[^ ]*[0-9@$][^ ]*")
_STANDS = str.maketrans(STANDS_FOR)


def _signs(m: re.Match) -> str:
    word = m[0].strip("@$")
    if any(c.isalpha() for c in word):
        return word.translate(_STANDS)
    return word.replace("@", " ").replace("$", " ")


def fold(text: str | None) -> str:
    """The text in folded words, each with a blank on both sides."""
    t = (text or "").translate(_FOLD)
    if _SIGNS.search(t):
        t = _SIGNS.sub(_signs, t)
    return f" {t} "


@dataclass
class Lexicon:
    """terms: folded pattern (" start" or " word ") to weight; exceptions: folded phrases (" two words "); score: sigmoid(bias + slope * log(rate))."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    bias: float = -3.0
    slope: float = 1.0

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for t, w in self.terms.items():
            a.add_word(t, (len(t), w))
        for e in self.exceptions:
            if e not in self.terms:
                a.add_word(e, (len(e), None))
        if len(a):
            a.make_automaton()
        return a

    def rate(self, text: str | None, automaton=None) -> float:
        """Weight for each hundred words, found outside exceptions."""
        return self.rate_of(fold(text), automaton if automaton is not None else self.automaton())

    def rate_of(self, folded: str, a) -> float:
        """The rate of a folded text."""
        if not len(a):
            return 0.0
        best, excused = {}, []
        for end, (n, w) in a.iter(folded):
            start = end - n + 1
            if w is None:
                excused.append((start, end))
            elif w > best.get(start, 0.0):
                best[start] = w
        if not best:
            return 0.0
        total = sum(w for s, w in best.items() if not any(x <= s < y for x, y in excused))
        return 100.0 * total / max(1, len(folded.split()))

    def score(self, text: str | None, automaton=None) -> float:
        x = self.bias + self.slope * math.log(self.rate(text, automaton) + 0.01)
        return 1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, x))))


def _candidates(words: set[str]) -> set[str]:
    found = set()
    for w in words:
        if len(w) >= SHORTEST:
            found.add(f" {w} ")
            found.update(f" {w[:n]}" for n in range(SHORTEST, min(len(w), LONGEST) + 1))
    return found


Counts = dict[int, Counter]


def _tally(found):
    """For rows (folded, toxic): rows (term, n1, n0), how many toxic and other texts have each of found(folded)."""

    def run(batches):
        for batch in batches:
            counts: Counts = {0: Counter(), 1: Counter()}
            for text, y in zip(batch.column("folded"), batch.column("toxic"), strict=True):
                counts[y.as_py()].update(found(text.as_py()))
            terms = list(counts[0] | counts[1])
            if terms:
                columns = [pa.array(terms), pa.array([counts[1][t] for t in terms], pa.int64()), pa.array([counts[0][t] for t in terms], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["term", "n1", "n0"])

    return run


def _tallied(known: DataFrame, found) -> DataFrame:
    rows = known.select("folded", "toxic").mapInArrow(_tally(found), "term string, n1 long, n0 long")
    return rows.groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def sure_odds(a: int, b: int, n1: int, n0: int) -> float:
    """Log odds of a in n1 toxic against b in n0 other documents, less 1.5 standard errors."""
    return math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1)) - 1.5 * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))


def _selected(rows: list, n1: int, n0: int) -> dict[str, float]:
    """Weights of the terms worth having: of nested starts with the same toxic documents the longest, of starts that add nothing none."""
    weight = {r["term"]: sure_odds(r["n1"], r["n0"], n1, n0) for r in rows}
    toxic = {r["term"]: r["n1"] for r in rows}
    chosen: dict[str, float] = {}
    longer: Counter = Counter()  # of each start of a chosen term, the most toxic documents that such a term has
    for t in sorted(weight, key=lambda t: (-toxic[t], -len(t), t)):
        starts = [t[:n] for n in range(SHORTEST + 1, len(t))]
        if any(s in chosen and chosen[s] >= weight[t] - 1.0 for s in starts):
            continue
        # a longer start with as many toxic documents is more exact, and was seen before, as ties go to the longer
        if longer[t] and longer[t] >= 0.98 * toxic[t]:
            continue
        chosen[t] = weight[t]
        for n in range(1, len(t) + 1):
            longer[t[:n]] = max(longer[t[:n]], toxic[t])
    return chosen


def _matcher(terms: dict[str, float], exceptions: tuple[str, ...] = ()):
    """folded -> the terms in it, outside exceptions; the automaton is built where it runs."""
    held: list = []

    def found(folded: str) -> set[str]:
        if not held:
            held.append(Lexicon(terms, exceptions).automaton())
        at, excused = [], []
        for end, (n, w) in held[0].iter(folded) if len(held[0]) else ():
            (excused if w is None else at).append((end - n + 1, end))
        return {folded[s : e + 1] for s, e in at if not any(x <= s < z for x, z in excused)}

    return found


def _word(folded: str, at: int) -> tuple[int, int]:
    """Start and end of the first word at or after a place; equal where there is none."""
    while at < len(folded) and folded[at] == " ":
        at += 1
    end = folded.find(" ", at)
    return at, len(folded) if end < 0 else end


def _pairer(terms: dict[str, float]):
    """folded -> phrases of a term's word with the word before or after it."""
    held: list = []

    def found(folded: str) -> set[str]:
        if not held:
            held.append(Lexicon(terms).automaton())
        pairs = set()
        for end, (n, _) in held[0].iter(folded) if len(held[0]) else ():
            start = end - n + 1
            a, b = _word(folded, start)
            stop = start + 1
            while stop and folded[stop - 1] == " ":
                stop -= 1
            first = folded.rfind(" ", 0, stop) + 1
            if first < stop:
                pairs.add(f" {folded[first:stop]} {folded[a:b]} ")
            c, d = _word(folded, b)
            if c < d:
                pairs.add(f" {folded[a:b]} {folded[c:d]} ")
        return pairs

    return found


def _exceptions(known: DataFrame, terms: dict[str, float]) -> tuple[str, ...]:
    """Pairs of a term's word with a neighbour that three or more other documents have and no toxic one."""
    if not terms:
        return ()
    return tuple(sorted(r["term"] for r in _tallied(known, _pairer(terms)).where("n0 >= 3 and n1 = 0").select("term").collect()))


def _excused(known: DataFrame, weak: dict[str, float], n1: int, n0: int, least_odds: float) -> dict[str, float]:
    """Of terms that too many other texts have, those that are sure enough where exceptions do not count."""
    if not weak:
        return {}
    seen = _tallied(known, _matcher(weak, _exceptions(known, weak))).collect()  # no more rows than terms
    sure = {r["term"]: sure_odds(r["n1"], r["n0"], n1, n0) for r in seen}
    return {t: w for t, w in sure.items() if w >= least_odds}


def _covering(known: DataFrame, terms: dict[str, float], need: int = 3, least: int = 2) -> dict[str, float]:
    """The terms, heaviest first, without which some least toxic texts would have fewer than need of them.

    Copies of a toxic text make any of its words look toxic; but those texts have heavier terms already. What comes to
    the driver is each sampled toxic text's numbers of terms.
    """
    if not terms:
        return terms
    order = sorted(terms, key=lambda t: (-terms[t], t))
    number, found = {t: i for i, t in enumerate(order)}, _matcher(terms)

    def run(batches):
        for batch in batches:
            rows = [sorted(number[t] for t in found(x.as_py())) for x in batch.column("folded")]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32()))], ["terms"])

    having: list[list[int]] = [[] for _ in order]
    for i, r in enumerate(known.where("toxic = 1").select("folded").mapInArrow(run, "terms array<int>").collect()):
        for t in r["terms"]:
            having[t].append(i)
    covered, kept = Counter(), {}
    for t, mine in zip(order, having, strict=True):
        if sum(covered[i] < need for i in mine) >= least:
            kept[t] = terms[t]
            covered.update(mine)
    return kept


def _rates(known: DataFrame, lexicon: Lexicon) -> tuple[list[float], list[int]]:
    """The rate and the label of each sampled text, in order of rate and label."""

    def run(batches):
        a = lexicon.automaton()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([lexicon.rate_of(x.as_py(), a) for x in batch.column("folded")], pa.float64()), batch.column("toxic")], ["rate", "toxic"])

    rows = known.select("folded", "toxic").mapInArrow(run, "rate double, toxic int").groupBy("rate", "toxic").count().collect()
    rows = sorted((r["rate"], r["toxic"], r["count"]) for r in rows)
    return [x for x, _, n in rows for _ in range(n)], [y for _, y, n in rows for _ in range(n)]


def _fitted(rates: list[float], toxic: list[int]) -> tuple[float, float]:
    """Bias and slope of the logistic score, by Newton steps with a weak prior that keeps them finite."""
    b, s = 0.0, 0.5
    x = [math.log(r + 0.01) for r in rates]
    for _ in range(50):
        g0, g1, h00, h01, h11 = -0.02 * b, -0.02 * (s - 0.5), 0.02, 0.0, 0.02
        for xi, y in zip(x, toxic, strict=True):
            p = 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, b + s * xi))))
            w = p * (1 - p)
            g0, g1, h00, h01, h11 = g0 + y - p, g1 + (y - p) * xi, h00 + w, h01 + w * xi, h11 + w * xi * xi
        d = h00 * h11 - h01 * h01
        step0, step1 = (h11 * g0 - h01 * g1) / d, (h00 * g1 - h01 * g0) / d
        b, s = b + max(-5.0, min(5.0, step0)), s + max(-5.0, min(5.0, step1))
        if abs(step0) + abs(step1) < 1e-9:
            break
    return b, max(s, 0.0)


def learn(docs: DataFrame, labels: DataFrame, sample: int = 20_000, least_docs: int = 5, least_odds: float = 2.0) -> Lexicon:
    """A lexicon from docs (doc_id, text) and labels (doc_id, toxic).

    The one bound: terms, exceptions and the score are learned from at most ``sample`` labelled documents, those with
    the least hash of doc_id, their whole texts, whatever their length. Null labels and ids are ignored; of several
    labels of a document the largest counts, and of several texts the one with the least hash, once. A term has
    least_docs toxic documents, or four and 0.4 % of all toxic ones if those are more, and log odds of least_odds less
    1.5 standard errors. All passes over the sample run on executors.
    """
    labels = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    labels = labels.withColumn("order", F.xxhash64("doc_id"))
    # the least hashes: first about as many as wanted by a cutoff, so that no task or driver sorts all labels
    share = min(1.0, (1.1 * sample + 100) / max(1, labels.count()))
    few = labels if share == 1.0 else labels.where(F.col("order") < int((2 * share - 1) * (1 << 63)))
    picked = few.orderBy("order", "doc_id").limit(sample)
    both = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")  # at most sample rows
    both = both.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x"))
    known = written(both.select("toxic", F.col("x.text").alias("text")).mapInArrow(_folded, "folded string, toxic int"), "known")
    sizes = known.agg(F.count_if(F.col("toxic") == 1).alias("n1"), F.count_if(F.col("toxic") == 0).alias("n0")).first()
    n1, n0 = sizes["n1"], sizes["n0"]
    counts = _tallied(known, lambda folded: _candidates(set(folded.split())))
    a, b = F.col("n1") + 0.5, F.col("n0") + 0.5
    odds = F.log(a / (n1 + 1)) - F.log(b / (n0 + 1)) - 1.5 * F.sqrt(1 / a + 1 / b)
    # terms of a twentieth of the toxic documents may be less sure: exceptions may explain the others that have them
    rows = counts.where((F.col("n1") >= max(least_docs, 4 + n1 // 250)) & ((odds >= least_odds) | (odds >= least_odds / 2) & (F.col("n1") >= n1 / 20))).collect()
    terms = _selected(rows, n1, n0)
    weak = {t: w for t, w in terms.items() if w < least_odds}
    terms = {t: w for t, w in terms.items() if t not in weak} | _excused(known, weak, n1, n0, least_odds)
    terms = _covering(known, terms)
    lexicon = Lexicon(terms, _exceptions(known, terms))
    if n1 and n0:
        lexicon.bias, lexicon.slope = _fitted(*_rates(known, lexicon))
    return lexicon


def _folded(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([fold(t.as_py()) for t in batch.column("text")], pa.string()), batch.column("toxic")], ["folded", "toxic"])


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id and score (0 to 1) of each row of docs (doc_id, text).

    A null or empty text has rate 0; repeated rows get equal scores; a null doc_id stays null; other columns are
    ignored; an empty table gives no rows.
    """

    def run(batches):
        a = lexicon.automaton()
        for batch in batches:
            scores = [lexicon.score(t.as_py(), a) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 3, held: int = 1, **bounds) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs (doc_id, text); labels (doc_id, toxic) of fold ``held`` (crc32 of doc_id as text, modulo folds) are never seen.

    Null and empty texts get the score of rate 0, a null doc_id stays null and counts as an empty name in the folds;
    repeated rows get equal scores, and count once where they are labelled; labels may be empty, null or repeated;
    other columns are ignored; an empty table gives no rows.
    """
    lexicon = learn(docs, labels.where(crc_mod(F.col("doc_id"), folds) != held), **bounds)
    return score(docs, lexicon).select(
        "doc_id", (crc_mod(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
