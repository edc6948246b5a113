"""One file out of many, without its bytes passing through one process where the file system allows it."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

CHUNK = 8 << 20


class _FileSystem:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.conf, self.gateway = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._gateway
        self.fs = self.path(path).getFileSystem(self.conf)
        self.local = self.fs.getUri().getScheme() == "file"

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def put(self, name: str, data: bytes) -> None:
        out = self.fs.create(self.path(name), True)
        out.write(bytearray(data))
        out.close()

    def move(self, source: str, target: str) -> None:
        """In one step: whoever reads the target finds what was there, or all of the new."""
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = self.gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(self.path(source), self.path(target), how)


def parts(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(path, bytes) of the part files that Spark has written to a folder, in order."""
    f = _FileSystem(spark, folder)
    found = [(s.getPath().toString(), s.getLen()) for s in f.fs.listStatus(f.path(folder)) if s.getPath().getName().startswith("part-")]
    return sorted(found)


def _copy(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each part to its offset of a file that is there; done twice, it leaves the same bytes."""
    for pdf in frames:
        for source, target, at in zip(pdf["source"], pdf["target"], pdf["at"], strict=True):
            out = os.open(target, os.O_WRONLY)
            try:
                with open(source, "rb") as f:
                    place = int(at)
                    while data := f.read(CHUNK):
                        while data:
                            done = os.pwrite(out, data, place)
                            place, data = place + done, data[done:]
            finally:
                os.close(out)
        yield pdf[["at"]]


def join_files(spark: SparkSession, header: bytes, folder: str, footer: bytes, target: str) -> int:
    """The header, the part files of a folder in order, and the footer as one file, there at once; how many bytes.

    On a mounted file system executors copy parts side by side, each to the offset that the sizes before it add up to.
    Where the file system can join files by their blocks (HDFS), it does. Else their bytes go through the driver, a
    buffer at a time. The parts are gone afterwards, or are to be removed with their folder.
    """
    f, found = _FileSystem(spark, target), parts(spark, folder)
    above, _, name = target.rpartition("/")
    beside, total = f"{above}/.{name}.{uuid.uuid4().hex}", len(header) + sum(n for _, n in found) + len(footer)
    try:
        if f.local:
            plain = lambda p: f.path(p).toUri().getPath()
            f.fs.mkdirs(f.path(above))
            with open(plain(beside), "wb") as out:
                out.write(header)
                out.truncate(total)
                out.seek(total - len(footer))
                out.write(footer)
            rows, at = [], len(header)
            for p, n in found:
                rows.append((plain(p), plain(beside), at))
                at += n
            if rows:
                jobs = spark.createDataFrame(rows, "source string, target string, at long").repartition(min(len(rows), 1000))
                jobs.mapInPandas(_copy, "at long").write.format("noop").mode("overwrite").save()
            if os.path.exists(sums := plain(f"{above}/.{name}.crc")):  # of the file that is replaced
                os.remove(sums)
        else:
            f.put(beside, header)
            f.put(f"{beside}.end", footer)
            sources = [p for p, n in [*found, (f"{beside}.end", len(footer))] if n]
            try:
                array = f.gateway.new_array(f.jvm.org.apache.hadoop.fs.Path, len(sources))
                for i, p in enumerate(sources):
                    array[i] = f.path(p)
                f.fs.concat(f.path(beside), array)
            except (Py4JJavaError, PySparkException) as e:
                if "UnsupportedOperation" not in f"{type(e).__name__} {e}":
                    raise
                _stream(f, header, sources, beside)
            f.fs.delete(f.path(f"{beside}.end"), False)
        f.move(beside, target)
    except BaseException:
        for p in (beside, f"{beside}.end"):
            f.fs.delete(f.path(p), False)
        raise
    return total


def _stream(f: _FileSystem, header: bytes, sources: list[str], target: str) -> None:
    out = f.fs.create(f.path(target), True)
    try:
        out.write(bytearray(header))
        for p in sources:
            stream = f.fs.open(f.path(p))
            try:
                f.jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, CHUNK, False)
            finally:
                stream.close()
    finally:
        out.close()
