"""Tables in the folder that all executors share, to cut the lineage of iterative plans.

What is written belongs to a scope: the innermost one open in the thread, or one for the whole process where none is.
A scope removes what it holds, and nothing else, so runs in several threads of a driver leave each other's tables alone.
"""

from __future__ import annotations

import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the session's Python workers, once, so that it need not be installed where they run."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parents[2]
        spark.sparkContext.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='gleaner-')}/gleaner", "zip", root, "gleaner"))
        _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where none is set, a temporary folder if driver and executors are one process, as in tests, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not (spark.sparkContext.master or "").startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gleaner-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scope:
    """Paths in the shared folder, and the catalog's names for some of them."""

    def __init__(self) -> None:
        self.paths: list[str] = []
        self.tables: dict[str, str] = {}

    def remove(self, spark: SparkSession, paths: list[str] | None = None) -> int:
        """Those of its tables, or all; how many there were."""
        gone = [p for p in self.paths if paths is None or p in set(paths)]
        for p in gone:
            if p in self.tables:
                spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(p)}")
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            self.paths.remove(p)
        return len(gone)

    def give(self, other: Scope, paths: list[str] | None = None) -> None:
        """Those of its tables, or all, are another scope's from now on."""
        for p in [p for p in self.paths if paths is None or p in set(paths)]:
            self.paths.remove(p)
            other.paths.append(p)
            if p in self.tables:
                other.tables[p] = self.tables.pop(p)


_PROCESS = Scope()
_SCOPE: ContextVar[Scope | None] = ContextVar("gleaner_scope", default=None)
_LAST = threading.local()


def current() -> Scope:
    return _SCOPE.get() or _PROCESS


@contextmanager
def scope(into: Scope | None = None) -> Iterator[Scope]:
    """What the body writes is held by this scope; the caller removes it, or gives it on. If the body fails, all of it is removed where Spark still can."""
    new = into or Scope()
    token, before = _SCOPE.set(new), list(new.paths)
    try:
        yield new
    except BaseException:
        spark = SparkSession.getActiveSession()
        if spark is not None:
            new.remove(spark, [p for p in new.paths if p not in before])
        raise
    finally:
        _SCOPE.reset(token)


@contextmanager
def passing(spark: SparkSession) -> Iterator[list[str]]:
    """Tables written inside are removed at the end, or if the body fails, but for those that the body puts on the list: what its result still reads."""
    outer, keep = current(), []
    with scope() as inner:
        yield keep
    inner.give(outer, keep)
    inner.remove(spark)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, held by the current scope."""
    _LAST.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    current().paths.append(_LAST.path)
    return _LAST.path


def scratch_table(spark: SparkSession, name: str) -> tuple[str, str]:
    """A new table name and its path in the shared folder, for bucketed tables, which need a catalog; held by the current scope."""
    path = scratch(spark, name)
    current().tables[path] = f"gleaner_{name}_{path.rsplit('-', 1)[1]}"
    return current().tables[path], path


def sweep(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Remove those tables, or all that the current scope holds, once no DataFrame needs them; how many there were."""
    return current().remove(spark, paths)


def scratch_paths() -> list[str]:
    """What the current scope holds."""
    return list(current().paths)


def newest() -> str:
    """The path of the table that this thread wrote last."""
    return _LAST.path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back with its schema."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
