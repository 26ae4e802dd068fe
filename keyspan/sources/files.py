"""Small files and folders through Hadoop's file system interface, so that any path Spark reads works here too."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Info:
    path: str
    name: str
    size: int
    is_dir: bool


class Files:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm = spark._jvm
        self.root = root.rstrip("/")
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def qualified(self) -> str:
        """The folder as paths of its files begin."""
        return self._fs.makeQualified(self._path("")).toString()

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def list(self, name: str = "") -> list[Info]:
        if not self.exists(name):
            return []
        found = [Info(s.getPath().toString(), s.getPath().getName(), s.getLen(), s.isDirectory()) for s in self._fs.listStatus(self._path(name))]
        return sorted(found, key=lambda i: i.name)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            raw = self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)
        finally:
            stream.close()
        return bytes(raw).decode()

    def put_new(self, name: str, text: str) -> bool:
        """Creates a file; False if there is one of that name."""
        try:
            stream = self._fs.create(self._path(name), False)
        except Exception as e:  # py4j wraps what the store throws
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def put(self, name: str, text: str) -> None:
        stream = self._fs.create(self._path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def delete(self, name: str) -> bool:
        return self._fs.delete(self._path(name), True)

    def move(self, path: str, name: str) -> None:
        if not self._fs.rename(self._jvm.org.apache.hadoop.fs.Path(path), self._path(name)):
            raise OSError(f"can't move {path}")

    def make(self, name: str = "") -> None:
        self._fs.mkdirs(self._path(name))
