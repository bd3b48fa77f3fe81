"""Bytes of files of any store that Spark reads: local paths by Python, others by the session's Hadoop file systems, a bounded piece at a time."""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Bytes that are fetched from a store at a time.
BLOCK = 1 << 20


def is_stored(path: str) -> bool:
    """Whether the path names a store (scheme:/...), not a local file."""
    return re.match(r"[A-Za-z][A-Za-z0-9+.-]+:/", path) is not None


def _hadoop(path: str):
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()  # a thread of its own has no active one
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


class _Stored(io.RawIOBase):
    def __init__(self, path: str):
        store, where = _hadoop(path)
        self.stream, self.block = store.open(where), memoryview(b"")

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, place: int, whence: int = 0) -> int:
        if whence != 0:
            raise OSError("only places from the start")
        self.stream.seek(place)
        self.block = memoryview(b"")
        return place

    def readinto(self, into) -> int:
        if not self.block:  # readers of text ask for a few KB at a time, a call to the JVM each
            self.block = memoryview(bytes(self.stream.readNBytes(BLOCK)))
        data, self.block = self.block[: len(into)], self.block[len(into) :]
        into[: len(data)] = data
        return len(data)

    def close(self) -> None:
        if not self.closed:
            self.stream.close()
        super().close()


def opened(path: str) -> io.BufferedIOBase:
    return io.BufferedReader(_Stored(path), BLOCK) if is_stored(path) else open(path, "rb")


def exists(path: str) -> bool:
    if not is_stored(path):
        return os.path.exists(path)
    store, where = _hadoop(path)
    return store.exists(where)


def size(path: str) -> int:
    if not is_stored(path):
        return os.path.getsize(path)
    store, where = _hadoop(path)
    return store.getFileStatus(where).getLen()


def files(folder: str) -> list[str]:
    """All files below a folder; of local ones no links to folders are followed, and folders that cannot be read have none."""
    if not is_stored(folder):
        return [os.path.join(d, n) for d, _, names in os.walk(folder, followlinks=False, onerror=lambda e: None) for n in names]
    store, where = _hadoop(folder)
    found, out = store.listFiles(where, True), []
    while found.hasNext():
        out.append(found.next().getPath().toString())
    return out


class _Created(io.RawIOBase):
    """A new file that is written from its start to its end."""

    def __init__(self, path: str):
        store, where = _hadoop(path)
        self.stream, self.place = store.create(where, True), 0

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.stream.write(bytearray(data))
        self.place += len(data)
        return len(data)

    def tell(self) -> int:
        return self.place

    def close(self) -> None:
        if not self.closed:
            super().close()
            self.stream.close()


def created(path: str) -> io.BufferedIOBase:
    return io.BufferedWriter(_Created(path), BLOCK) if is_stored(path) else open(path, "wb")


def moved(path: str, to: str) -> None:
    """Rename a file over another one, if there is one."""
    if not is_stored(path):
        os.replace(path, to)
        return
    store, where = _hadoop(path)
    target = _hadoop(to)[1]
    if store.exists(target):
        store.delete(target, False)
    if not store.rename(where, target):
        raise OSError(f"{path} could not be renamed to {to}")


def deleted(path: str) -> None:
    """Delete a file or folder, if it is there."""
    if not is_stored(path):
        if os.path.exists(path):
            os.remove(path)
        return
    store, where = _hadoop(path)
    store.delete(where, True)


def shared(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir, which all executors share. Only where that is unset and all runs in one process (tests), below a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weft-")
        spark.conf.set("spark.checkpoint.dir", found)
    where = spark._jvm.org.apache.hadoop.fs.Path(found)
    whole = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()  # with its store
    return f"{whole}/weft-{name}-{uuid.uuid4().hex}"
