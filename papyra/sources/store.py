"""Small files through Hadoop's file systems, so that a catalog may lie wherever Spark reads and writes."""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def at(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        return self._fs(path).exists(self._path(path))

    def list(self, path: str) -> list[str]:
        if not self.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self._fs(path).listStatus(self._path(path)))

    def mkdir(self, path: str) -> None:
        self._fs(path).mkdirs(self._path(path))

    def delete(self, path: str) -> None:
        self._fs(path).delete(self._path(path), True)

    def size(self, path: str) -> int:
        return self._fs(path).getContentSummary(self._path(path)).getLength() if self.exists(path) else 0

    def modified(self, path: str) -> float:
        """Seconds since 1970."""
        return self._fs(path).getFileStatus(self._path(path)).getModificationTime() / 1000

    def read_json(self, path: str) -> dict:
        stream = self._fs(path).open(self._path(path))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def create_json(self, path: str, value: dict, stale_seconds: float = 60) -> bool:
        """Write a file that must not exist yet, whole; False if it does, or another writer is at it.

        A claim, created exclusively, decides between writers; one that is left by a lost writer goes stale.
        """
        fs, claim = self._fs(path), f"{path}.claim"
        if self.exists(path):
            return False
        if self.exists(claim) and time.time() - fs.getFileStatus(self._path(claim)).getModificationTime() / 1000 > stale_seconds:
            fs.delete(self._path(claim), False)
        try:
            fs.create(self._path(claim), False).close()
        except Py4JJavaError:
            return False
        try:
            if self.exists(path):
                return False
            part = f"{path}.{uuid.uuid4().hex}.tmp"
            out = fs.create(self._path(part), True)
            out.write(bytearray(json.dumps(value).encode()))
            out.close()
            return bool(fs.rename(self._path(part), self._path(path)))
        finally:
            fs.delete(self._path(claim), False)
