"""Fill-in-the-middle transformation of texts.

A text is cut into units (a word with the blanks before it, or blanks at the end). Two cuts, drawn from a digest of seed
and id, divide the units into prefix, middle and suffix; the parts are put in another order behind marks, so that a
model learns to write the middle from what stands around it. Draws come from the id alone: the same on any cluster.

The work is an Arrow-batched pandas UDF: one scan of a text collects the units' end offsets in a compact array, two
lookups in it give the places to cut at, and the digests are hashlib's.
"""

from __future__ import annotations

import hashlib
from array import array
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word with the blanks before it, or blanks that no word follows.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
MARKS = ("<P>", "<S>", "<M>")
FORMS = ("plain", "psm", "spm")
RESULT = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"


@lru_cache(maxsize=1)
def _unit():
    import regex

    return regex.compile(UNIT)


def unit_ends(text: str) -> array:
    """End offsets of the text's units, in code points; the units follow each other without a gap."""
    return array("L", (m.end() for m in _unit().finditer(text)))


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four 32-bit draws of a document; a null id draws as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))


def rearrange(text: str, doc_id: int | None, seed: int = 42, rate: int = 50, spm: int = 80) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix length, middle length, output) of a text."""
    ends = unit_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= rate or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (first, second))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = MARKS
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def restore(output: str, form: str) -> str:
    """The text that rearrange() made the output of: marks are in no rearranged text, so the first of each is the mark."""
    if form == "plain":
        return output
    first, second, last = MARKS if form == "psm" else (MARKS[1], MARKS[0], MARKS[2])
    if not output.startswith(first):
        raise ValueError(f"an output of form {form} begins with {first}")
    one, rest = output[len(first) :].split(second, 1)
    two, middle = rest.split(last, 1)
    return one + middle + two if form == "psm" else two + middle + one


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, prefix: str = "") -> DataFrame:
    """docs (doc_id, text, any others) with n, form, prefix_chars, middle_chars, output and output_sha256.

    rate: per cent of the texts that are rearranged; spm: per cent of these whose suffix comes first. A name that docs
    has already is taken for the result, not kept; ``prefix`` goes before the results' names where both are wanted.
    Null texts count as empty, and empty texts and those that hold a mark stay plain, with null lengths; a null
    id draws as an empty one; repeated rows get equal outputs; a text of any length is cut whole; no rows give none.
    """

    @F.pandas_udf(RESULT)
    def of(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = [rearrange(t, None if i is None else int(i), seed, rate, spm) for i, t in zip(ids, texts, strict=True)]
        out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
        out["prefix_chars"], out["middle_chars"] = out["prefix_chars"].astype("Int64"), out["middle_chars"].astype("Int64")
        out["output_sha256"] = [hashlib.sha256(x.encode()).hexdigest() for x in out["output"]]
        return out

    # as text, ids of any width and null ones reach Python as they are
    found = of(F.col("doc_id").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    new = [x.split()[0] for x in RESULT.split(", ")]
    held = "_fim"
    while held in docs.columns:
        held += "_"
    taken = {prefix + x for x in new}
    return docs.withColumn(held, found).select(*(c for c in docs.columns if c not in taken), *(F.col(held)[x].alias(prefix + x) for x in new))


def restored(output: Column, form: Column) -> Column:
    """The texts that fill_in_middle() made these outputs of."""

    @F.pandas_udf("string")
    def of(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([restore(o, f) for o, f in zip(outputs, forms, strict=True)], dtype=object)

    return of(output, form)


def restored_sha256(output: Column, form: Column) -> Column:
    """Digests of what restored() gives, in lowercase hex; the texts stay on the executor that restores them."""

    @F.pandas_udf("string")
    def of(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([hashlib.sha256(restore(o, f).encode()).hexdigest() for o, f in zip(outputs, forms, strict=True)], dtype=object)

    return of(output, form)
