"""Small files in a folder that the driver and the executors share, through the file system that Spark uses for it."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


class Folder:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._at("").getFileSystem(self.conf)

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self._at(""))) if self.fs.exists(self._at("")) else []

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._at(name))

    def read(self, name: str, most: int = 64 << 10) -> str | None:
        """A file's text, or null where there is none."""
        if not self.exists(name):
            return None
        if self.fs.getFileStatus(self._at(name)).getLen() > most:
            raise ValueError(f"{name} is too large")
        stream = self.fs.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, name: str, text: str, overwrite: bool) -> None:
        stream = self.fs.create(self._at(name), overwrite)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def swap(self, name: str, text: str) -> None:
        """Replaces a file as a whole: readers see the old text or the new one."""
        other = f".{name}.{uuid.uuid4().hex}.new"
        self._put(other, text, False)
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        modes = self.spark.sparkContext._gateway.new_array(rename, 1)
        modes[0] = rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(self._at(other), self._at(name), modes)

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)

    @contextmanager
    def locked(self, name: str, error: Exception) -> Iterator[None]:
        """Holds a lock file; the error where another writer does."""
        try:
            self._put(name, uuid.uuid4().hex, False)
        except Exception as found:
            if self.exists(name):
                raise error from found
            raise
        try:
            yield
        finally:
            self.delete(name)
