"""Folders and small files on whatever file system Spark writes to."""

from __future__ import annotations

import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Exists(Exception):
    """A file of that name is there already."""


class Folder:
    """A folder on any Hadoop file system, seen from the driver."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path().getFileSystem(self._conf)

    def _path(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        """Names of the files in the folder; none if it isn't there."""
        if not self._fs.exists(self._path()):
            return []
        return sorted(status.getPath().getName() for status in self._fs.listStatus(self._path()) if status.isFile())

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> None:
        """A whole file at once, or ``Exists``: of several writers of one name exactly one succeeds.

        The text is written beside the name and then renamed without overwriting, which file systems like HDFS do in
        one step. Readers list finished names only.
        """
        beside = self._path(f".{name}.{uuid.uuid4().hex}")
        stream = self._fs.create(beside, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri(), self._conf)
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self._jvm.java.lang.reflect.Array.newInstance(rename.NONE.getClass(), 1)
        options[0] = rename.NONE
        try:
            context.rename(self._fs.makeQualified(beside), self._fs.makeQualified(self._path(name)), options)
        except Py4JJavaError as error:
            self._fs.delete(beside, False)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                raise Exists(f"{self.path}/{name}") from None
            raise

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), False)


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share, below ``spark.checkpoint.dir``.

    Without that setting it is a temporary folder, under a local master only.
    """
    context = spark.sparkContext
    key = "spark.checkpoint.dir"
    found = spark.conf.get(key, None) or context.getConf().get(key) or context.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError(f"set {key} to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="fundperf-")
        context.setCheckpointDir(found)
    return f"{found.rstrip('/')}/fundperf-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str, partition_by: str | None = None) -> DataFrame:
    """The rows written to a new folder and read back."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
