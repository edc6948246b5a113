"""Versions of stored datasets: readers, writers, removals, pages, the trigram index, damage."""

import glob
import os
import random
import threading

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gleaner.operators.dataset import Dataset, Field
from gleaner.plans import store as st
from gleaner.plans import versions as vs


def people(spark, n, id="a", step=1):
    df = spark.range(n).selectExpr(f"id * {step} as id", "concat('Person ', id) as name", "sha2(cast(id as string), 256) as token", "if(id % 2 = 0, 'Dhaka', 'Sylhet') as city")
    return Dataset.of(id, "People", df.repartition(3), "id", [Field("name"), Field("token"), Field("city")])


@pytest.fixture()
def s(spark, tmp_path):
    return st.Store(spark, f"file://{tmp_path}/store")


@pytest.fixture()
def small_files(s):
    s.file_rows = 100


def names(df):
    return sorted(r["name"] for r in df.collect())


def data_files(df):
    return [f for f in df.inputFiles() if "/files-" in f]


def size(root):
    return sum(os.path.getsize(f) for f in glob.glob(f"{root}/**", recursive=True) if os.path.isfile(f))


def test_a_loaded_dataset_keeps_its_version(spark, s):
    s.save(people(spark, 300))
    first = s.load("a")
    s.delete_records("a", ["a-1", "a-2"])
    second = s.load("a")
    s.save(people(spark, 5))
    assert (first.count(), second.count(), s.load("a").count()) == (300, 298, 5)
    assert s.versions("a") == [1, 2, 3] and s.load("a", 2).count() == 298
    with pytest.raises(st.NotFound):
        s.load("a", 9)


def test_vacuum_leaves_pinned_and_last_versions(spark, s, tmp_path):
    for n in (10, 20, 30, 40):
        s.save(people(spark, n))
    assert s.pin("a", "report", 2) == 2
    pinned, held = s.load("a", 2), s.load("a")
    os.makedirs(f"{tmp_path}/store/data/a/files-orphan")
    assert s.vacuum("a") == 4  # files and manifest of two versions; the orphan is young
    assert s.versions("a") == [2, 4] and (pinned.count(), held.count()) == (20, 40)
    with pytest.raises(st.NotFound):
        s.load("a", 1)
    s.unpin("a", "report")
    assert s.vacuum("a", older_ms=0) == 3 and s.versions("a") == [4] and held.count() == 40 and s.verify() == []
    # the number of a version that went cannot be taken by a writer that still goes by it
    with pytest.raises(st.Conflict):
        s._commit("a", {"commit": 1}, s._meta("a"))


def test_removal_writes_little_and_only_what_is_asked(spark, s, tmp_path):
    s.save(people(spark, 200_000))
    before = size(tmp_path)
    removed = s.delete_records("a", spark.range(0, 200_000, 100).select(F.concat(F.lit("a-"), (F.col("id") + 1).cast("string")).alias("x")))
    assert removed == 2000 and s.summary("a").records == 198_000 and size(tmp_path) - before < 0.02 * before
    df = s.load("a").df
    assert df.count() == 198_000 and df.where("_pos % 100 = 0").isEmpty() and s.verify() == []
    assert s.delete_records("a", ["a-1", "a-none"]) == 0 and s.versions("a") == [1, 2]
    assert s.delete_records("a", ["a-2", "a-2", "a-101"]) == 1 and s.load("a").count() == 197_999
    s.compact("a")
    assert s.load("a").count() == 197_999 and s.load("a", 2).count() == 198_000 and s.verify() == []


def test_removals_in_many_files_by_join_and_broadcast(spark, s, small_files, monkeypatch):
    s.save(people(spark, 1000))
    rng, gone = random.Random(1), set()
    for _ in range(3):
        now = rng.sample(range(1000), 120)
        s.delete_records("a", [f"a-{i + 1}" for i in now])
        gone |= set(now)
        for bound in (vs.BROADCAST, 0):
            monkeypatch.setattr(vs, "BROADCAST", bound)
            assert names(s.load("a").df) == sorted(f"Person {i}" for i in range(1000) if i not in gone)
    assert s.summary("a").records == 1000 - len(gone)


def test_writers_at_once_lose_nothing(spark, s):
    s.save(people(spark, 400))
    errors = []

    def remove(k):
        try:
            for i in range(3):
                assert s.delete_records("a", [f"a-{100 * k + i + 1}"]) == 1
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=remove, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and s.load("a").count() == 391 and s.summary("a").records == 391 and len(s.versions("a")) == 10


def test_what_was_not_seen_is_not_replaced(spark, s):
    s.save(people(spark, 10))
    mine, other = s.load("a"), s.load("a")
    s.save(other.filter(F.col("city") == "Dhaka"))
    with pytest.raises(st.Conflict):
        s.save(mine.rename("Mine"))
    assert s.load("a").count() == 5 and s.summary("a").name == "People"
    s.save(s.load("a").rename("Mine"))
    assert s.summary("a").name == "Mine"


def test_a_commit_that_was_not_noted_counts(spark, s):
    s.save(people(spark, 10))
    noted = s.files.get("datasets/a.json")
    s.rename("a", "Later")
    s.files.put("datasets/a.json", noted)  # as if its writer had stopped in between
    assert s.summary("a").name == "Later"
    s.rename("a", "Last")
    assert s.summary("a").name == "Last" and s.versions("a") == [1, 2, 3]


@pytest.mark.parametrize("removals", [0, 1, 2])
def test_deep_pages_read_few_files(spark, s, small_files, removals):
    d = people(spark, 1000, step=3)
    s.save(d)
    left, rng = list(range(1000)), random.Random(removals)
    for _ in range(removals):
        gone = set(rng.sample(left, 150))
        s.delete_records("a", [f"a-{3 * i + 1}" for i in gone])
        left = [i for i in left if i not in gone]
    for offset, limit in ((0, 10), (95, 10), (int(0.9 * len(left)), 30), (len(left) - 5, 50), (len(left), 5), (10**9, 5)):
        p = s.page("a", offset, limit)
        assert [r["name"] for r in p.items.collect()] == [f"Person {i}" for i in left[offset : offset + limit]] and p.total == len(left)
        assert len(data_files(p.items)) <= 2
    assert [r["name"] for r in s.page("a", 0, 2000).items.collect()] == [f"Person {i}" for i in left]


def test_trigram_index(spark, s, small_files):
    d = people(spark, 2000)
    s.save(d.having(d.df.withColumn("city", F.when(F.col("_pos") == 1234, "Xylograph").otherwise(F.col("city")))))
    s.index("a")
    wanted = s.load("a").df.where("_pos = 1234").first()["token"][:12]
    for query in ("Person 1234", wanted, wanted.upper(), "sylhet", "er", "no such", "PERSON 77", "x" * 50):
        found = s.search("a", query)
        assert names(found.df) == names(s.load("a").search(query).df)
        assert names(s.search("a", query, "city").df) == names(s.load("a").search(query, "city").df)
    for pattern in ("person 99% dhaka", "person_77", "1234 " + wanted, "%", "a", "\\%", "x_y%z"):
        assert names(s.search_blob("a", pattern).df) == names(s.load("a").search_blob(pattern).df)
    files, wanted = len(data_files(s.load("a").df)), "xylogr"
    assert files == 20 and len(data_files(s.search("a", wanted).df)) == 1 and s.search("a", wanted).count() == 1
    assert s.page("a", 0, 10, wanted).total == 1
    # it outlives removals, and a save ends it
    s.delete_records("a", ["a-1235"])
    assert s.search("a", wanted).count() == 0 and len(data_files(s.search("a", wanted).df)) == 1
    s.save(people(spark, 50))
    assert s.search("a", "Person 49").count() == 1


def test_damage_is_found_and_its_file_named(spark, s, small_files, tmp_path):
    s.save(people(spark, 500))
    s.delete_records("a", ["a-3"])
    assert s.verify() == []
    files = sorted(glob.glob(f"{tmp_path}/store/data/a/files-*/part-*.parquet"))
    table = pq.read_table(files[2])
    cells = table["city"].to_pylist()
    cells[7] = "Khulna"
    pq.write_table(table.set_column(table.schema.get_field_index("city"), "city", pa.array(cells)), files[2])
    os.remove(os.path.join(os.path.dirname(files[2]), f".{os.path.basename(files[2])}.crc"))
    assert s.verify() == [f"a: {os.path.basename(files[2])}: rows are not those written"]


def test_no_rows(spark, s):
    s.save(people(spark, 0))
    assert s.load("a").count() == 0 and s.page("a").items.count() == 0 and s.delete_records("a", ["x"]) == 0 and s.verify() == []
    s.index("a")
    assert s.search("a", "person").count() == 0
    s.compact("a")
    s.save(people(spark, 3))
    assert s.delete_records("a", ["a-1", "a-2", "a-3"]) == 3 and s.load("a").count() == 0 and s.page("a").total == 0
    s.compact("a")
    assert s.load("a").count() == 0 and s.verify() == []


def test_many_files_are_listed_by_folder(spark, s, small_files, monkeypatch):
    """Whole, with removed rows, without the files that a search leaves out, and with a file that is gone."""
    s.save(people(spark, 4_000))
    s.index("a")
    asked, read = [], vs.Versions._read
    monkeypatch.setattr(vs.Versions, "_read", lambda self, schema, paths: asked.append(list(paths)) or read(self, schema, asked[-1]))
    assert s.load("a").count() == 4_000 and max(map(len, asked)) == 1
    v = s._versions("a")
    manifest = s._meta("a")["manifest"]
    listed = sorted(v.files(manifest).select("folder", "file", "first", "last").collect(), key=lambda r: r["first"])
    assert len(listed) >= 40
    most = v._of(s.load("a").df.schema, listed[3:], [F.col("_pos")])
    assert sorted(r[0] for r in most.collect()) == list(range(listed[3]["first"], 4_000)) and max(map(len, asked)) == 1
    few = v._of(s.load("a").df.schema, listed[:2], [F.col("_pos")])
    assert few.count() == listed[1]["last"] + 1 and max(map(len, asked)) == 2
    assert s.delete_records("a", ["a-1", "a-4000"]) == 2
    assert s.load("a").count() == 3_998 and names(s.search("a", "person 3998").df) == ["Person 3998"]
    os.remove(f"{s.root.removeprefix('file://')}/data/a/{listed[5]['folder']}/{listed[5]['file']}")
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        s.load("a").count()
