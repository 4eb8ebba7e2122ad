"""Small text files and listings on whatever file system a path belongs to."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    """Reads, writes and lists beside the data, on the driver."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.path(path))

    def names(self, folder: str) -> list[str]:
        """Names in a folder, in order; none if there is no such folder."""
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(folder)))

    def read(self, path: str) -> str:
        stream = self.fs.open(self.path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """The file appears whole or not at all."""
        draft = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(draft), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.remove(path)
        if not self.fs.rename(self.path(draft), self.path(path)):
            raise OSError(f"cannot write {path}")

    def remove(self, path: str) -> None:
        if self.exists(path):
            self.fs.delete(self.path(path), True)
