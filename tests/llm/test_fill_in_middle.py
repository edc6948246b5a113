import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.llm.fill_in_middle import fill_in_middle, rearrange, restore, restored, restored_sha256

BLANK = " \t\n\x0b\f\r"


def plain_units(text):
    """One at a time, by hand."""
    out, i = [], 0
    while i < len(text):
        j = i
        while j < len(text) and text[j] in BLANK:
            j += 1
        while j < len(text) and text[j] not in BLANK:
            j += 1
        out.append(text[i:j])
        i = j
    return out


def plain(doc_id, text):
    text = text or ""
    units = plain_units(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if text == "" or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    lo, hi = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=" \t\n\x0b\f\rab<>PSM é🙂 ", max_size=30), st.integers(-5, 2**63 - 1))
def test_plain_version_and_round_trip(text, doc_id):
    found = rearrange(text, doc_id)
    assert found == plain(doc_id, text)
    assert restore(found[4], found[1]) == text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<PSM> ", max_size=12), st.integers(0, 10**6))
def test_marks_cut_in_two_are_no_marks(text, doc_id):
    found = rearrange(text, doc_id, rate=100)
    assert restore(found[4], found[1]) == text


SCHEMA = "doc_id long, text string, output string, n string"


def test_frames(spark):
    long = "x" * 200_000 + " word" * 400_000
    texts = [None, "", " ", "\n\n", "one", "a <P> b", "two words  and\ttrailing \n", long, "naïve 🙂 été"]
    rows = [(i, t, "kept?", "x") for i, t in enumerate(texts * 12)] + [(None, "null id here", "o", "x")] + [(3, "same row", "o", "x")] * 3
    df = fill_in_middle(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert df.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"]
    got = df.withColumn("back", restored("output", "form")).withColumn("sha", restored_sha256(df.output, df.form)).collect()
    assert len(got) == len(rows) and {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.doc_id, r.text)
        assert r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest()
        assert r.back == (r.text or "") and r.sha == hashlib.sha256((r.text or "").encode()).hexdigest()
    both = fill_in_middle(spark.createDataFrame(rows, SCHEMA), prefix="fim_")
    assert {"n", "output", "fim_n", "fim_output"} <= set(both.columns)
    assert fill_in_middle(spark.createDataFrame([], SCHEMA)).count() == 0
