"""Small files and renames on whatever file system Spark reaches (local, HDFS, object stores), through Hadoop's API."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Store:
    """The file system of a path."""

    def __init__(self, path: str, spark: SparkSession | None = None):
        session = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        self._jvm = session._jvm
        self._fs = self.path(path).getFileSystem(session._jsc.hadoopConfiguration())

    def path(self, text: str):
        return self._jvm.org.apache.hadoop.fs.Path(text)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self.path(path))

    def is_folder(self, path: str) -> bool:
        return self.exists(path) and self._fs.getFileStatus(self.path(path)).isDirectory()

    def read_text(self, path: str) -> str:
        stream = self._fs.open(self.path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, path: str, text: str) -> None:
        """Write a small file in place of an old one."""
        stream = self._fs.create(self.path(path), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def rename(self, old: str, new: str) -> None:
        """Rename a file or folder; a file takes the place of an old one."""
        if not self.exists(old):
            raise FileNotFoundError(old)
        if self.exists(new) and not self.is_folder(new):
            self._fs.delete(self.path(new), False)
        if not self._fs.rename(self.path(old), self.path(new)):
            raise OSError(f"{old} could not be renamed to {new}")

    def stamp(self, path: str) -> list[tuple[str, int, int]]:
        """Name, size and time of change of every file under a path."""
        found, files = [], self._fs.listFiles(self.path(path), True)
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        return sorted(found)
