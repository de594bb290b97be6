"""Versions of a folder of tables, one manifest each.

Whoever changes the folder writes new files first and then the next version's manifest, which the
file system creates only if it is not there. Of two writers that started from one version
the second is refused; files that no manifest names are never read. So a change is whole or absent.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has made the version that this one wanted to make."""


class Versions:
    """The manifests of a folder; ``told`` is the content of version ``version``, {} for 0."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.version, self.told = 0, {}
        self.refresh()

    def _file(self, name: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def refresh(self) -> Versions:
        """Goes to the newest version."""
        fs, place = self._file("versions")
        if fs.exists(place):
            known = [int(n[:-5]) for n in (f.getPath().getName() for f in fs.listStatus(place)) if n.endswith(".json")]
            if known and max(known) > self.version:
                _, place = self._file(f"versions/{max(known):08d}.json")
                self.told = json.loads(self.spark.read.text(place.toString(), wholetext=True).first().value)
                self.version = max(known)
        return self

    def commit(self, told: dict) -> None:
        """Makes ``told`` the next version, or raises Conflict."""
        fs, place = self._file(f"versions/{self.version + 1:08d}.json")
        try:
            out = fs.create(place, False)  # fails if it is there already
        except Exception as e:
            raise Conflict(f"version {self.version + 1} was made by another writer") from e
        out.write(bytearray(json.dumps(told, ensure_ascii=False).encode()))
        out.close()
        self.version, self.told = self.version + 1, told

    def change(self, make: Callable[[Versions], dict | None], tries: int = 20) -> None:
        """Commits what make(self) tells of the newest version, again from there if another writer was first; None changes nothing."""
        for _ in range(tries):
            told = make(self.refresh())
            if told is None:
                return
            try:
                return self.commit(told)
            except Conflict:
                continue
        raise Conflict(f"no turn in {tries} tries")
