"""Numbered versions of a table's state, committed one after the other.

A state is a small JSON document (which folders make up the table, which batches are in it). Data
is written first, to folders of its own; the new state is then put in place by one rename that
fails if the number is taken. A job that dies before that leaves the last version as it was, and
two writers cannot both commit the same number.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Versions:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.folder = f"{self.path}/_versions"
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        place = self._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self._conf), place

    def numbers(self) -> list[int]:
        fs, place = self._at(self.folder)
        if not fs.exists(place):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(place)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def read(self, number: int) -> dict:
        fs, place = self._at(f"{self.folder}/{number:012d}.json")
        stream = fs.open(place)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict]:
        """Number and state of the last version; 0 and an empty state before the first."""
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (0, {})

    def commit(self, after: int, state: dict) -> int:
        """Make ``state`` the version that follows number ``after``; raises if another writer was faster."""
        number = after + 1
        fs, folder = self._at(self.folder)
        fs.mkdirs(folder)
        _, draft = self._at(f"{self.folder}/_{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        finally:
            out.close()
        _, place = self._at(f"{self.folder}/{number:012d}.json")
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        files.rename(draft, place, none)  # fails if the number exists
        return number

    def new_folder(self, name: str) -> str:
        return f"{self.path}/{name}-{uuid.uuid4().hex}"

    def prune(self, keep: int, folders_of) -> list[str]:
        """Forget all but the last ``keep`` versions and delete the data folders (``folders_of(state)``) that
        none of these names; returns what was deleted. Readers of older versions must be done."""
        numbers = self.numbers()
        kept = {f for n in numbers[-keep:] for f in folders_of(self.read(n))}
        gone = sorted({f for n in numbers[:-keep] for f in folders_of(self.read(n))} - kept)
        for target in [*gone, *[f"{self.folder}/{n:012d}.json" for n in numbers[:-keep]]]:
            fs, place = self._at(target)
            fs.delete(place, True)
        return gone
