"""An append-only commit log in a folder: numbered files, each written only where none is yet."""

from __future__ import annotations

import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer took the number first."""


class CommitLog:
    """Numbered JSON records under ``path``, on any file system that Spark writes.

    A record counts once its file is complete: it ends with its own writer's mark. A writer that dies half way leaves a file that
    readers pass over and whose number stays taken. Of two writers of one number, the file system lets one create the file; a
    writer reads its record back and has lost when it is not its own.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _file(self, name: str):
        return self._fs_path(f"{self.path}/{name}")

    def _names(self) -> list[str]:
        if not self._fs.exists(self._fs_path(self.path)):
            return []
        return sorted(f.getPath().getName() for f in self._fs.listStatus(self._fs_path(self.path)) if f.getPath().getName().endswith(".json"))

    def _read(self, name: str) -> dict | None:
        stream = self._fs.open(self._file(name))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        try:
            record = json.loads(text)
            return record if record.get("complete") else None
        except ValueError:
            return None

    def _create(self, name: str, record: dict) -> bool:
        mark = uuid.uuid4().hex
        # the mark is the last thing written, so a cut file does not parse
        raw = json.dumps({**record, "writer": mark, "complete": True}).encode()
        if self._fs.getUri().getScheme() == "file":
            return self._link(self._file(name).toUri().getPath(), raw, mark)
        try:
            out = self._fs.create(self._file(name), False)
        except Py4JJavaError:
            if self._fs.exists(self._file(name)):
                return False
            raise
        try:
            out.write(bytearray(raw))
        finally:
            out.close()
        found = self._read(name)
        return found is not None and found["writer"] == mark

    @staticmethod
    def _link(path: str, raw: bytes, mark: str) -> bool:
        """On local and mounted folders the whole file appears at once, or not when there is one: Spark's writer for them does not
        keep two writers apart."""
        os.makedirs(os.path.dirname(path), exist_ok=True)
        draft = f"{path}.{mark}"
        with open(draft, "xb") as f:
            f.write(raw)
        try:
            os.link(draft, path)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)

    def numbers(self) -> list[int]:
        """Numbers that are taken, complete or not."""
        return [int(n[:-5]) for n in self._names() if n[:-5].isdigit()]

    def head(self) -> int:
        """The highest number taken; 0 for an empty log."""
        return max(self.numbers(), default=0)

    def records(self) -> list[tuple[int, dict]]:
        """All complete records in order."""
        found = ((n, self._read(f"{n:012d}.json")) for n in sorted(self.numbers()))
        return [(n, r) for n, r in found if r is not None]

    def append(self, record: dict, after: int | None = None) -> int:
        """Write the next number. With ``after`` only if the log still ends there, else Conflict; without, after whatever is there."""
        while True:
            number = (self.head() if after is None else after) + 1
            if self._create(f"{number:012d}.json", {"record": record}):
                return number
            if after is not None:
                raise Conflict(f"number {number} of {self.path} is taken")

    def _attempts(self, key: str) -> list[str]:
        start = f"done-{_name(key)}-"
        return [n for n in self._names() if n.startswith(start)]

    def done(self, key: str) -> dict | None:
        """The note of ``key``, or None."""
        return next((r["record"] for r in map(self._read, self._attempts(key)) if r is not None), None)

    def once(self, key: str, record: dict | None = None) -> bool:
        """Note that ``key`` is done; False when it is noted already. A note that was cut short is passed over."""
        while self.done(key) is None:
            name = f"done-{_name(key)}-{len(self._attempts(key)):04d}.json"
            if self._create(name, {"record": {"key": key, **(record or {})}}):
                return True
        return False

    def notes(self) -> list[dict]:
        """The notes of all keys, by key."""
        found: dict[str, dict] = {}
        for r in map(self._read, (n for n in self._names() if n.startswith("done-"))):
            if r is not None:
                found.setdefault(r["record"]["key"], r["record"])
        return [found[k] for k in sorted(found)]

    def table(self, schema: str) -> DataFrame:
        """``schema`` and ``number``: the complete records as a table, read by Spark."""
        names = [f"{self.path}/{n:012d}.json" for n in self.numbers()]
        if not names:
            return self.spark.createDataFrame([], f"{schema}, number bigint")
        number = F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\.json", 1).cast("bigint").alias("number")
        read = self.spark.read.schema(f"record struct<{schema}>, writer string, complete boolean")
        return read.json(names).where("complete").select("record.*", number)


def _name(key: str) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, key).hex
