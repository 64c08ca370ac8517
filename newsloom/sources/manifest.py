"""Numbered descriptions of a table's state, so that a change of many files becomes visible at once."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Manifests:
    """JSON files in a folder of any file system that Spark writes to; the one with the highest number holds.

    A description is written whole under a name that no reader looks at and then renamed, so there is no half of one. One
    writer at a time; readers keep what an older description names until it is forgotten.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._files = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def numbers(self) -> list[int]:
        if not self._files.exists(self._path("")):
            return []
        names = [status.getPath().getName() for status in self._files.listStatus(self._path(""))]
        return sorted(int(name[:-5]) for name in names if name.endswith(".json") and name[:-5].isdigit())

    def read(self, number: int) -> dict:
        stream = self._files.open(self._path(f"{number}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def last(self) -> dict | None:
        numbers = self.numbers()
        return self.read(numbers[-1]) if numbers else None

    def commit(self, state: dict) -> None:
        number = (self.numbers() or [-1])[-1] + 1
        draft = self._path(f"_{number}.draft")
        stream = self._files.create(draft, True)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        if not self._files.rename(draft, self._path(f"{number}.json")):
            raise RuntimeError(f"{self.folder}: another writer has written description {number}")

    def forget(self, keep: int) -> list[dict]:
        """Delete all but the last ``keep`` descriptions and return the deleted ones."""
        old = self.numbers()[:-keep]
        states = [self.read(n) for n in old]
        for n in old:
            self._files.delete(self._path(f"{n}.json"), False)
        return states

    def remove(self, folder: str) -> None:
        """Delete a folder of data that no description names any more."""
        self._files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(folder), True)
