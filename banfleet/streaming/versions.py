"""Tables that are read while a stream writes them.

A version is a set of finished folders, named by a pointer: one small file, written after all
of them and read before any. Folders that no pointer names yet belong to a batch that has not
finished; nobody reads them, and the batch replaces them when it runs again.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

_POINTERS = "_versions"


@dataclass(frozen=True)
class Version:
    """Number of the batch that finished it, and its folders by table, below the stream's own."""

    number: int
    folders: dict[str, list[str]] = field(default_factory=dict)


class Versions:
    """The versions below one folder, which any file system that Spark writes to may hold."""

    def __init__(self, spark: SparkSession, out: str):
        self.out, self._path = out.rstrip("/"), spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(out).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.out}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def _delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.out}/{name}"), True)

    def numbers(self) -> list[int]:
        return sorted(int(n) for n in self._names(_POINTERS) if n.isdigit())

    def at(self, number: int) -> Version:
        stream = self._fs.open(self._path(f"{self.out}/{_POINTERS}/{number:019}"))
        try:
            found = json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()
        return Version(number, found)

    def newest(self) -> Version | None:
        numbers = self.numbers()
        return self.at(numbers[-1]) if numbers else None

    def publish(self, version: Version) -> None:
        """Make a version the newest: its pointer appears whole, by a rename."""
        name = f"{self.out}/{_POINTERS}/{version.number:019}"
        draft = self._path(f"{name}.draft")
        stream = self._fs.create(draft, True)
        try:
            stream.write(json.dumps(version.folders).encode())
        finally:
            stream.close()
        if not self._fs.rename(draft, self._path(name)) and version.number not in self.numbers():
            raise OSError(f"can't rename {draft}")

    def retire(self, keep: int = 2) -> None:
        """Delete all but the newest ``keep`` versions, and folders that only those named.

        Who has begun to read a version can finish while fewer than ``keep`` newer ones appear.
        """
        numbers = self.numbers()
        kept = [self.at(n) for n in numbers[-keep:]]
        for n in numbers[:-keep]:
            self._delete(f"{_POINTERS}/{n:019}")
        named = {f for v in kept for folders in v.folders.values() for f in folders}
        for table in {t for v in kept for t in v.folders}:
            for name in self._names(table):
                if f"{table}/{name}" not in named and batch_of(name) <= numbers[-1]:
                    self._delete(f"{table}/{name}")

    def paths(self, folders: list[str]) -> list[str]:
        return [f"{self.out}/{f}" for f in folders]


def folder(table: str, batch_id: int) -> str:
    return f"{table}/batch_id={batch_id}"


def batch_of(name: str) -> int:
    return int(name.rpartition("=")[2])
