"""Small files in any store that Spark reaches: listing, reading, and writing so that a reader sees all or nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def names(spark: SparkSession, folder: str) -> list[str]:
    """What is in the folder; nothing if there is none."""
    fs, where = _at(spark, folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = _at(spark, path)
    stream = fs.open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Written beside and renamed, so that it is there whole or not at all; what was there is replaced."""
    fs, where = _at(spark, path)
    fs.mkdirs(where.getParent())
    beside = spark._jvm.org.apache.hadoop.fs.Path(where.getParent(), f"_{uuid.uuid4().hex}")
    stream = fs.create(beside, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    files = spark._jvm.org.apache.hadoop.fs
    over = spark.sparkContext._gateway.new_array(files.Options.Rename, 1)
    over[0] = files.Options.Rename.OVERWRITE
    files.FileContext.getFileContext(where.toUri() if where.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(beside), fs.makeQualified(where), over)


def move(spark: SparkSession, path: str, to: str) -> None:
    """To a name that is free, in a folder that is made if need be."""
    fs, where = _at(spark, path)
    target = _at(spark, to)[1]
    fs.mkdirs(target.getParent())
    if not fs.rename(where, target):
        raise OSError(f"{path} can't be moved to {to}")


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)
