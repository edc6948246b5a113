import json

import pytest
from pyspark.sql import functions as F

from gleaner.operators import dedup
from gleaner.operators.dataset import Dataset, Field
from gleaner.plans import store as st
from gleaner.sources import jobspec
from gleaner.sources.extract import Plan
from gleaner.streaming import incremental as inc


def test_pages_as_they_come(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    page = lambda i, u: (i, u, f"<title>T{i}</title><a href='/x'>l</a>")
    write = lambda rows: spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(src)
    write([page(0, "http://a/1"), page(1, "http://a/1/#x")])

    def run():
        rows = inc.rows_of(inc.page_stream(spark, src), Plan.of({"title": "title", "link": "a@href"}), keep=("page_id", "url"))
        inc.to_table(inc.first_seen(rows, "url"), out, state).awaitTermination()
        return sorted((r.page_id, r.title, r.link) for r in spark.read.parquet(out).collect())

    assert run() in ([(0, "T0", "http://a/x")], [(1, "T1", "http://a/x")])
    write([page(2, "HTTP://A/1"), page(3, "http://a/2")])
    assert run()[-1] == (3, "T3", "http://a/x") and len(run()) == 2


def test_windows_and_late_events(spark):
    df = spark.createDataFrame([("2024-01-01 00:01:00", "a"), ("2024-01-01 00:09:00", "a"), ("2024-01-01 00:11:00", "b")], "t string, k string").selectExpr("cast(t as timestamp) t", "k")
    got = inc.counts(df, "t", by=("k",)).orderBy("window", "k").collect()
    assert [(r.k, r.n) for r in got] == [("a", 2), ("b", 1)]


@pytest.fixture()
def rocksdb(spark):
    names = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        # else a query that ends when there is no more data would go on for its times to live
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k in names:
        spark.conf.unset(k)


def test_first_records_over_batches(spark, tmp_path, rocksdb):
    """Equal to exact dedup of all batches together; keys that are forgotten at once are those of a batch."""
    src, rows = f"{tmp_path}/in", [(i, ["a@b.c", "A@B.C ", "d", "", " ", f"x{i % 7}"][i % 6], str(i)) for i in range(60)]
    schema = "_pos long, email string, other string"

    def arrive(some):
        spark.createDataFrame(some, schema).repartition(1).write.mode("append").parquet(src)

    def step(out, ttl=None):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        key = F.lower(F.trim("email"))
        kept = inc.first_records(stream, F.when(key != "", key), ttl)
        inc.to_table(kept, f"{tmp_path}/{out}", f"{tmp_path}/{out}-state").awaitTermination()
        return sorted(r["_pos"] for r in spark.read.parquet(f"{tmp_path}/{out}").collect())

    for i in range(0, 60, 20):
        arrive(rows[i : i + 20])
        got = step("kept")
    df = spark.createDataFrame([(p, e) for p, e, _ in rows], "i long, email string")
    d = Dataset.of("d", "d", df, "i", [Field("email")])
    gone = {r["_pos"] for r in dedup.exact_only(d).collect()}
    assert got == [p for p, _, _ in rows if p not in gone]
    assert step("hour", 3_600_000) == got
    brief = []  # each batch by itself
    for i in range(0, 60, 20):
        seen = set()
        for p, e, _ in rows[i : i + 20]:
            key = e.strip().lower()
            if not key or key not in seen:
                brief.append(p)
            seen.add(key)
    assert step("brief", 1) == brief


SPEC = json.dumps({"spec_version": 1, "name": "P", "source": {"url": "https://a.example/"}, "extract": {"fields": [{"name": "title", "selector": "title", "required": True}, {"name": "n", "selector": "b", "type": "number"}]}})


def test_a_killed_job_goes_on(spark, tmp_path):
    src, s, spec = f"{tmp_path}/pages", st.Store(spark, f"file://{tmp_path}/store"), jobspec.parse(SPEC)
    pages = [(i, f"https://a.example/{i}", f"<title>{'T%d' % i if i % 5 else ''}</title><b>{i}</b>") for i in range(40)]
    for i in range(0, 40, 8):
        spark.createDataFrame(pages[i : i + 8], "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(src)

    def stop(number):
        if number == 2 and not stopped:
            stopped.append(number)
            # the batch's rows are there already, and it is killed before it is noted
            jobspec.run(spec, spark.createDataFrame(pages[:3], "page_id long, url string, html string")).write.mode("overwrite").parquet(f"{s.root}/runs-data/r/rows/batch=2")
            raise OSError("killed")

    stopped, run = [], st.Run("r", "j")
    with pytest.raises(Exception, match="killed"):
        inc.run_job(s, spec, run, inc.page_stream(spark, src), "d", stop)
    half = s.run("r")
    assert [r.id for r in s.interrupted()] == ["r"] and half.pages_processed == 16 and not s.exists("d")
    done = inc.run_job(s, spec, run, inc.page_stream(spark, src), "d", stop)
    assert (done.status, done.pages_processed, done.records_collected, done.dataset_id) == ("COMPLETED", 40, 32, "d") and s.interrupted() == []
    whole = inc.run_job(s, spec, st.Run("w", "j"), inc.page_stream(spark, src), "e")
    rows = lambda id: [(r["_pos"], r["title"], r["n"]) for r in s.load(id).df.orderBy("_pos").collect()]
    assert rows("d") == rows("e") == [(i, f"T{k}", str(k)) for i, k in enumerate(k for k in range(40) if k % 5)] and whole.records_collected == 32
    assert s.load("d").source.job_id == "j" and inc.run_job(s, spec, st.Run("w", "j"), inc.page_stream(spark, src), "e").records_collected in (0, 32)
