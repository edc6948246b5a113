"""Every registered query of the engine runs, and equals its SQL, over the smallest tables."""

import math
import os

import duckdb
import pytest

from gleaner.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "as_tuple"):
        return round(float(v), 6)
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, db, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    q = db.sql(sql)
    names = [d[0] for d in q.description]
    assert sorted(names) == columns
    assert got == sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in q.fetchall())


CUT = ["q_html_title", "q_job_fields", "q_job_run"]


@pytest.mark.parametrize("name", CUT)
def test_cut_references(spark, tmp_path, name):
    """Titles and headings that end within a character reference, and an & that begins none."""
    said = ["a &amp; b&amp", "R&D&quot;s", "x&amp;amp", "y &qu", "z&&amp;&quot", "plain"]
    rows = [(i, f"https://e.example/{i}?a=1&b=2", f'<html lang="en"><title>{t}</title><nav><ul><li><a href="/p?a=1&amp;b=2">{t}</a></li></ul></nav><article><h1>{t}</h1></article></html>') for i, t in enumerate(said)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.sql(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    q = c.sql(registry.oracle_sql()[name])
    columns = [d[0] for d in q.description]
    assert sorted(map(tuple, registry.queries()[name](spark, str(tmp_path)).select(*columns).collect())) == sorted(q.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_semantic_dedup_compares_whole_vectors(spark, tmp_path):
    from gleaner.plans import registry

    rows = [(1, 0, [1.0] * 64 + [9.0] * 64), (2, 0, [1.0] * 64 + [-9.0] * 64)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert registry.queries()["q_semantic_dedup"](spark, str(tmp_path)).count() == 2
