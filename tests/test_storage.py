import threading
import types

import pytest

from gleaner.functions import storage


def test_tables_pass_but_for_what_is_kept(spark):
    before = storage.scratch_paths()
    with storage.passing(spark) as keep:
        gone = storage.written(spark.range(5), "one")
        first = storage.newest()
        kept = storage.written(gone.where("id > 1"), "two")
        keep.append(storage.newest())
        name, path = storage.scratch_table(spark, "three")
        spark.range(9).write.bucketBy(2, "id").option("path", path).saveAsTable(name)
        assert spark.table(name).count() == 9
    assert sorted(r.id for r in kept.collect()) == [2, 3, 4] and [p for p in storage.scratch_paths() if p not in before] == keep
    assert not spark.catalog.tableExists(name)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(first).count()
    assert storage.sweep(spark, keep) == 1 and storage.sweep(spark, keep) == 0


def test_threads_keep_their_tables(spark):
    """A block that ends removes what its own thread wrote in it, and nothing that another has written meanwhile."""
    inside, outside, found = threading.Event(), threading.Event(), {}

    def other():
        inside.wait(60)
        with storage.scope() as mine:
            found["df"], found["newest"] = storage.written(spark.range(7), "other"), storage.newest()
            outside.set()
            done.wait(60)
            found["rows"] = found["df"].count()
            found["removed"] = mine.remove(spark)

    done, t = threading.Event(), threading.Thread(target=other)
    t.start()
    with storage.passing(spark) as keep:
        storage.written(spark.range(3), "gone")
        first = storage.newest()
        inside.set()
        outside.wait(60)
        assert storage.newest() == first != found["newest"] and keep == []
    done.set()
    t.join()
    assert found["rows"] == 7 and found["removed"] == 1


def test_a_failed_body_leaves_no_tables(spark):
    before = storage.scratch_paths()
    with pytest.raises(ZeroDivisionError), storage.passing(spark) as keep:
        storage.written(spark.range(3), "gone")
        path = storage.newest()
        keep.append(path)
        1 / 0
    assert storage.scratch_paths() == before
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path)


def test_a_cluster_needs_a_shared_folder():
    context = types.SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    session = types.SimpleNamespace(conf={}, sparkContext=context)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(session)
