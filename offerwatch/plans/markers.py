"""Numbered markers on the shared file system: the first writer of a number gets it.

A marker is a small file that appears whole or not at all and is never replaced.
Its text is written beside it first and then given the marker's name: by a hard
link on a local disk and by a rename elsewhere, which file systems like HDFS
refuse when the name is taken. (An object store whose rename replaces files
needs a committer of its own; it is refused.)
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_NO_ATOMIC_RENAME = {"s3", "s3a", "s3n", "gs", "wasb", "wasbs"}


def _open(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def put_if_absent(spark: SparkSession, folder: str, number: int, text: str) -> bool:
    """Make marker `number` with `text`; False if it is there already, whoever made it."""
    root, files = _open(spark, folder)
    if files.getScheme() in _NO_ATOMIC_RENAME:
        raise ValueError(f"{files.getScheme()} cannot refuse to replace a file")
    files.mkdirs(root)
    hadoop = spark._jvm.org.apache.hadoop.fs
    draft, marker = hadoop.Path(root, f"_{uuid.uuid4().hex}"), hadoop.Path(root, str(number))
    out = files.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if files.getScheme() != "file":
            return not files.exists(marker) and files.rename(draft, marker)
        nio = spark._jvm.java.nio.file
        place = lambda p: nio.Paths.get(files.resolvePath(root).toUri()).resolve(p.getName())
        try:
            nio.Files.createLink(place(marker), place(draft))
        except Py4JJavaError as error:
            if error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise
        return True
    finally:
        files.delete(draft, False)


def read(spark: SparkSession, folder: str, number: int) -> str | None:
    """Text of a marker; None if there is none."""
    root, files = _open(spark, folder)
    marker = spark._jvm.org.apache.hadoop.fs.Path(root, str(number))
    if not files.exists(marker):
        return None
    source = files.open(marker)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def last(spark: SparkSession, folder: str) -> int | None:
    """The highest number that has a marker."""
    root, files = _open(spark, folder)
    if not files.exists(root):
        return None
    numbers = [int(f.getPath().getName()) for f in files.listStatus(root) if f.getPath().getName().isdigit()]
    return max(numbers, default=None)


def remove(spark: SparkSession, folder: str, number: int) -> None:
    """Give a number back."""
    root, files = _open(spark, folder)
    files.delete(spark._jvm.org.apache.hadoop.fs.Path(root, str(number)), False)
