"""Tables as immutable parts and a manifest that is switched in one step.

A table is a folder with ``parts/`` (written once, never changed) and ``manifest/`` (one small file a version, which lists
the parts). A writer writes its part first and then creates the next version's file by renaming a finished one; a name
that exists already means that another writer was faster, and the writer tries again on top of it. A reader takes
the highest version, so it sees the state before a write or after it, never half of one. Parts that no kept version names
are removed by ``expire``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Attempts to commit on top of other writers before giving up.
ATTEMPTS = 50


def ddl(df: DataFrame) -> str:
    """The schema of ``df`` as text."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


class VersionedTable:
    """Parquet parts under ``path``; every change is a new version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._file(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _file(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def versions(self) -> list[int]:
        folder = self._file(f"{self.path}/manifest")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())

    def parts(self, version: int | None = None) -> list[str]:
        """Names of the parts of a version, the newest by default; none before the first write."""
        known = self.versions()
        if not known:
            return []
        stream = self._fs.open(self._file(self._manifest(known[-1] if version is None else version)))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["parts"]
        finally:
            stream.close()

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifest/v{version:020d}"

    def _commit(self, change: Callable[[list[str]], list[str] | None]) -> int:
        """Create the next version from the newest one; ``change`` gives the new parts, or None for nothing to do."""
        for _ in range(ATTEMPTS):
            version = (self.versions() or [0])[-1]
            parts = change(self.parts(version) if version else [])
            if parts is None:
                return version
            ready = self._file(f"{self.path}/manifest/.{uuid.uuid4().hex}")
            stream = self._fs.create(ready, False)
            stream.write(json.dumps({"parts": parts}).encode())
            stream.close()
            target = self._file(self._manifest(version + 1))
            try:
                if not self._fs.exists(target) and self._fs.rename(ready, target):
                    return version + 1
            except Exception:  # noqa: S110  some stores raise where others return false
                pass
            self._fs.delete(ready, False)
        raise RuntimeError(f"no version of {self.path} could be committed in {ATTEMPTS} attempts")

    def _write(self, df: DataFrame, name: str | None = None) -> str:
        name = name or uuid.uuid4().hex
        df.write.mode("overwrite").parquet(f"{self.path}/parts/{name}")
        return name

    def append(self, df: DataFrame, name: str | None = None) -> int:
        """Add rows. A named part is added once, however often it comes: a repeated micro-batch changes nothing."""
        if name and name in self.parts():
            return self.versions()[-1]
        part = self._write(df, name)
        return self._commit(lambda parts: None if part in parts else [*parts, part])

    def replace(self, df: DataFrame) -> int:
        """The rows of ``df`` are the table from now on."""
        part = self._write(df)
        return self._commit(lambda parts: [part])

    def clear(self) -> int:
        return self._commit(lambda parts: [])

    def read(self, schema: str, version: int | None = None) -> DataFrame:
        """All rows of a version."""
        parts = self.parts(version)
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/parts/{p}" for p in parts])

    def compact(self, schema: str, least: int = 8) -> int:
        """Join the parts into one once there are ``least``; rows added meanwhile stay."""
        old = self.parts()
        if len(old) < least:
            return (self.versions() or [0])[-1]
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/parts/{p}" for p in old])
        part = self._write(rows.hint("rebalance"))

        def swap(parts: list[str]) -> list[str] | None:
            return [part, *[p for p in parts if p not in old]] if set(old) <= set(parts) else None

        return self._commit(swap)

    def expire(self, keep: int = 5) -> None:
        """Forget all but the newest ``keep`` versions and the parts that only they name. Not while a writer is between part and commit."""
        known = self.versions()
        named = {p for v in known[-keep:] for p in self.parts(v)}
        for version in known[:-keep]:
            self._fs.delete(self._file(self._manifest(version)), False)
        folder = self._file(f"{self.path}/parts")
        for status in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
            if status.getPath().getName() not in named:
                self._fs.delete(status.getPath(), True)
