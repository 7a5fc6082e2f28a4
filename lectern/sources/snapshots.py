"""Tables that are replaced as a whole: immutable snapshots and numbered manifests.

A snapshot is written to a folder of its own, which nothing reads yet. It becomes the table by one write: the manifest
with the next number, made only if no other has that number. So a reader, started at any moment, finds the snapshot of
the highest complete manifest; of two writers that began from the same number one gets a Conflict. The folder's file
system must make a file exclusively (as HDFS and local disks do).
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has committed since."""


class SnapshotStore:
    """``read()`` the table, ``commit()`` its next state."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._root = self._at("_manifests")
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _numbers(self) -> list[int]:
        if not self._fs.exists(self._root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._root)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _manifest(self, number: int) -> dict | None:
        """None for one that was begun and not finished."""
        stream = self._fs.open(self._at(f"_manifests/{number:012d}.json"))
        try:
            raw = bytes(stream.readAllBytes())
        finally:
            stream.close()
        try:
            found = json.loads(raw)
        except ValueError:
            return None
        return found if found.get("complete") else None

    def current(self) -> int:
        """The number of the newest complete state; 0 for none."""
        for n in reversed(self._numbers()):
            if self._manifest(n):
                return n
        return 0

    def read(self, number: int | None = None) -> DataFrame:
        """The table as it was at a number, or is now. The DataFrame goes on reading that state, whatever is committed."""
        number = self.current() if number is None else number
        found = self._manifest(number) if number in self._numbers() else None
        if not found:
            raise FileNotFoundError(f"{self.path} has no state {number}")
        return self.spark.read.schema(found["schema"]).parquet(f"{self.path}/{found['folder']}")

    def commit(self, df: DataFrame, base: int | None = None) -> int:
        """Make ``df`` the table's next state and return its number; ``df`` may read the table itself.

        ``base``: the number that ``df`` was made from. If another state has come since, or comes meanwhile, this one is a
        Conflict and the table stays as the other writer left it.
        """
        base = self.current() if base is None else base
        folder = f"snapshot-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        if self.current() != base:
            self._fs.delete(self._at(folder), True)
            raise Conflict(f"{self.path} has state {self.current()}, this one was made from {base}")
        number = max([base, *self._numbers()]) + 1  # numbers of unfinished manifests aren't used again
        body = json.dumps({"folder": folder, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "base": base, "complete": True})
        try:
            stream = self._fs.create(self._at(f"_manifests/{number:012d}.json"), False)
        except Exception as e:
            if not isinstance(e, PySparkException) and "exist" not in str(e).lower():
                raise
            self._fs.delete(self._at(folder), True)
            raise Conflict(f"{self.path} got state {number} from another writer") from e
        stream.write(body.encode())
        stream.close()
        return number

    def vacuum(self, keep: int = 2) -> None:
        """Delete all states but the newest ``keep``, and folders that no manifest names. Readers of deleted ones fail."""
        complete = [n for n in self._numbers() if self._manifest(n)]
        held = {self._manifest(n)["folder"] for n in complete[-keep:]}
        for n in self._numbers():
            if n not in complete[-keep:] and n <= (complete[-1] if complete else 0):
                self._fs.delete(self._at(f"_manifests/{n:012d}.json"), False)
        for s in self._fs.listStatus(self._at("")):
            name = s.getPath().getName()
            if name.startswith("snapshot-") and name not in held:
                self._fs.delete(s.getPath(), True)
