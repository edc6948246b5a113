"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

A rule rejects a document whose ratio (symbols, capitals, repeated lines, repeated words) exceeds a cutoff. Which
cutoffs may be used is decided on labelled documents: for each rule and each stratum (a language), the cutoffs of a
fixed grid are tested from the most lenient to the strictest. A cutoff passes if the labelled good documents
that it would reject are so few that, by the exact binomial tail, a false rejection rate of ``alpha / rules`` or more
is refused at level ``delta / (rules * strata)``: Bonferroni over rules and strata, and a fixed testing order within a
grid, which needs no further correction. Testing stops at the first cutoff that fails. So with probability 1 - delta
no stratum loses more than alpha of its good documents to all rules together. Of the cutoffs that passed, the one
that rejects most labelled bad documents, less ``care`` times the share of good ones, is used; of equals, the most
lenient. A stratum with too few labelled good documents to pass any cutoff has no rule, and keeps what the base keeps.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import WORD, written

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
RATIOS = ("symbol_ratio", "capital_ratio", "dup_line_ratio", "repeat_ratio")
GRID = (0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05, 0.02)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however the optimizer moves or repeats the expression around it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _without(c: Column, chars: str) -> Column:
    return F.length(F.translate(c, chars, ""))


def _repeated(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the text: windows are told apart by a 64-bit hash within a text."""
    windows = F.when(
        F.size(words) >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size(words) - 3),
            lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
        ),
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))

    def twice(s: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))
        found = F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1))
        covered = F.transform(found, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))
        return F.size(F.array_distinct(F.flatten(covered)))

    return _let(F.sort_array(windows), twice)


def features(text: Column) -> Column:
    """Struct of the five base counts (long) and the four ratios (double) of a text; null counts as empty."""

    def of_text(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: _without(x, BLANKS) > 0)
        dup = _let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).alias("dup"), F.size(x).alias("all")))
        words = _let(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), lambda w: F.struct(F.size(w).alias("n"), _repeated(w).alias("rep")))
        return F.struct(
            words.alias("w"), _without(t, BLANKS).alias("chars"), (F.length(t) - _without(t, SYMBOLS)).alias("sym"),
            dup.alias("l"), (F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}", ""))).alias("cap"),
        )

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    def counts(x: Column) -> Column:
        return F.struct(
            x["w"]["n"].cast("long").alias("n_words"), x["chars"].cast("long").alias("word_chars"), x["sym"].cast("long").alias("n_symbols"),
            x["l"]["dup"].cast("long").alias("n_dup_lines"), x["w"]["rep"].cast("long").alias("n_repeat_words"),
            ratio(x["sym"], x["chars"]).alias("symbol_ratio"), ratio(x["cap"], x["chars"]).alias("capital_ratio"),
            ratio(x["l"]["dup"], x["l"]["all"]).alias("dup_line_ratio"), ratio(x["w"]["rep"], x["w"]["n"]).alias("repeat_ratio"),
        )

    return _let(_let(F.coalesce(text, F.lit("")), of_text), counts)


def base_failed(f: Column) -> Column:
    return (f["n_words"] < 50) | (100 * f["n_repeat_words"] > 50 * f["n_words"])


def at_most(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k), exactly summed from the mode side in logarithms."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def cutoffs(scored: DataFrame, labels: DataFrame, alpha: float = 0.04, delta: float = 0.05, care: float = 10.0) -> dict[str, dict[str, float]]:
    """The certified cutoff of each rule by stratum, from scored (doc_id, stratum, f) and labels (doc_id, quality).

    What comes to the driver is one row of counts for each stratum that has enough good labels to pass a cutoff at
    all; with fewer, no test could pass, whatever the documents.
    """
    share, rules = alpha / len(RATIOS), len(RATIOS)
    least = math.ceil(math.log(delta / rules) / math.log1p(-share))
    labels = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = scored.where(~base_failed(F.col("f"))).join(labels, "doc_id")
    good, sums = F.col("quality") == 1, []
    for r in RATIOS:
        for i, c in enumerate(GRID):
            over = F.col("f")[r] > c
            sums += [F.count_if(over & good).alias(f"{r}_{i}_good"), F.count_if(over & ~good).alias(f"{r}_{i}_bad")]
    rows = known.groupBy("stratum").agg(F.count_if(good).alias("good"), F.count_if(~good).alias("bad"), *sums).where(F.col("good") >= least).collect()
    found: dict[str, dict[str, float]] = {}
    for row in rows:
        for r in RATIOS:
            best = None
            for i, c in enumerate(GRID):
                lost = row[f"{r}_{i}_good"]
                if at_most(lost, row["good"], share) > delta / (rules * len(rows)):
                    break
                worth = row[f"{r}_{i}_bad"] / max(1, row["bad"]) - care * lost / row["good"]
                if worth > max(0.0, best[0] if best else 0.0):
                    best = (worth, c)
            if best:
                found.setdefault(row["stratum"], {})[r] = best[1]
    return found


def verdict(stratum: Column, f: Column, limits: dict[str, dict[str, float]]) -> Column:
    """True if no certified rule of the document's stratum rejects it."""
    out = F.lit(True)
    for r in RATIOS:
        pairs = [F.lit(x) for s, rule in sorted(limits.items()) if r in rule for x in (s, rule[r])]
        if pairs:
            out = out & ~F.coalesce(f[r] > F.try_element_at(F.create_map(*pairs), stratum), F.lit(False))
    return out


def _stratum() -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit(""))


def assess(docs: DataFrame, labels: DataFrame, alpha: float = 0.04, delta: float = 0.05) -> DataFrame:
    """doc_id, the five counts, the four ratios, base_failed and kept for each row of docs (doc_id, text, lang).

    labels: doc_id, quality (1 good, 0 bad; null rows are ignored; of several for one document the least counts).
    A null text counts as empty and fails the base; a null lang counts as an empty one, a stratum of its own; a null doc_id is never
    labelled; repeated rows get the same answer; an empty table gives no rows; without labels only the base rejects.
    """
    scored = written(docs.select(F.col("doc_id"), _stratum().alias("stratum"), features(F.col("text").cast("string")).alias("f")), "quality")
    limits = cutoffs(scored, labels, alpha, delta)
    f = F.col("f")
    return scored.select("doc_id", "f.*", base_failed(f).alias("base_failed"), (~base_failed(f) & verdict(F.col("stratum"), f, limits)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = 0.04, delta: float = 0.05) -> DataFrame:
    """The rows of docs that assess() keeps, all columns as they were.

    Features are computed once, where the row is read, and written beside it, so texts are not shuffled. Null texts,
    empty ones and null ids as in assess(); of repeated rows all are kept or none; an empty table gives no rows.
    """
    of = "_judged"
    while of in docs.columns:
        of += "_"
    judged = F.struct(_stratum().alias("stratum"), features(F.col("text").cast("string")).alias("f"))
    scored = written(docs.select("*", judged.alias(of)), "quality")
    limits = cutoffs(scored.select("doc_id", f"{of}.stratum", f"{of}.f"), labels, alpha, delta)
    f = F.col(of)["f"]
    return scored.where(~base_failed(f) & verdict(F.col(of)["stratum"], f, limits)).select(*docs.columns)
