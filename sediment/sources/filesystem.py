"""The few file-system calls the jobs need, through the file system Spark itself uses for a path."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _open(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none when it does not exist."""
    fs, target = _open(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []


def read_text(spark: SparkSession, path: str) -> str | None:
    """Content of a small file; None when it does not exist."""
    fs, target = _open(spark, path)
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a new small file; False when it exists already.

    The file is written under another name and renamed without overwriting, so readers see all of it or nothing, and a
    writer that dies leaves no torn file. Two writers at once are told apart where rename is atomic, as in HDFS; object
    stores do not promise that, so there a table may have one writer only.
    """
    fs, target = _open(spark, path)
    if fs.exists(target):
        return False
    hadoop = spark._jvm.org.apache.hadoop.fs
    waiting = hadoop.Path(target.getParent(), f"_{uuid.uuid4().hex}.tmp")
    stream = fs.create(waiting, False)
    stream.write(bytearray(text, "utf-8"))
    stream.close()
    kind = getattr(hadoop, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.NONE
    try:
        hadoop.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(
            fs.makeQualified(waiting), fs.makeQualified(target), options
        )
    except Py4JJavaError as error:
        fs.delete(waiting, False)
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def delete(spark: SparkSession, path: str) -> bool:
    fs, target = _open(spark, path)
    return fs.delete(target, True)


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """Every file below a folder: path, modified, bytes.  Contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))
    )
