"""Paths through Hadoop's file systems, so that any store that Spark reads will do."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

from ..types import TableError


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def is_regular(spark: SparkSession, path: str) -> bool:
    """A file, or a link to one: no directory, and no pipe or device, which can be read once only."""
    fs, p = _fs(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isFile()


def read_text(spark: SparkSession, folder: str) -> str:
    """The text of a folder's only part file, by the file system itself: a small file needs no job."""
    fs, p = _fs(spark, folder)
    (part,) = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith("part-") and s.getLen()]
    stream = fs.open(part)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def taken(spark: SparkSession, path: str) -> bool:
    """Whether a name is in use, be it by a link that leads nowhere."""
    fs, p = _fs(spark, path)
    return fs.exists(p) or (fs.getScheme() == "file" and os.path.lexists(p.toUri().getPath()))


def refuse_existing(spark: SparkSession, path: str, overwrite: bool) -> None:
    if not overwrite and taken(spark, path):
        raise TableError(f"output '{path}' already exists; pass overwrite to replace it")


def require_regular(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        if not exists(spark, p):
            raise TableError(f"'{p}' does not exist")
        if not is_regular(spark, p):
            raise TableError(f"'{p}' is not a regular file")


def beside(path: str) -> str:
    return f"{path.rstrip('/')}.part-{uuid.uuid4().hex}"


def install(spark: SparkSession, made: str, path: str, overwrite: bool) -> None:
    """Rename a finished output into its place; nobody sees a part of it."""
    fs, to = _fs(spark, path)
    source = spark._jvm.org.apache.hadoop.fs.Path(made)
    if fs.exists(to):
        if not overwrite:
            fs.delete(source, True)
            raise TableError(f"output '{path}' already exists; pass overwrite to replace it")
        old = spark._jvm.org.apache.hadoop.fs.Path(beside(path))
        if not fs.rename(to, old):
            raise TableError(f"cannot install '{path}': the old output stays in its place")
        if not _moved(fs, source, to):
            back = "is back in its place" if _moved(fs, old, to) else f"is at '{old.toString()}'"
            raise TableError(f"cannot install '{path}': the old output {back}")
        fs.delete(old, True)
    elif not _moved(fs, source, to):
        raise TableError(f"cannot install '{path}'")


def _moved(fs, source, to) -> bool:
    """Rename to a name that is free. A folder that another writer put there meanwhile would take the source inside it."""
    if fs.exists(to) or not fs.rename(source, to):
        return False
    inside = to.suffix(f"/{source.getName()}")
    if fs.exists(inside):
        fs.rename(inside, source)
        return False
    return True


def discard(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)
