"""Small files on any file system that Spark reaches: atomic writes, job checkpoints, raw copies."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import SparkSession


class Files:
    """Hadoop's file system below one folder."""

    def __init__(self, spark: SparkSession, base: str):
        self.base = base.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, text: str):
        return self._jvm.org.apache.hadoop.fs.Path(text)

    def full(self, name: str) -> str:
        return f"{self.base}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(self.full(name)))

    def names(self) -> list[str]:
        """Files right in the folder; unfinished ones don't count."""
        folder = self._path(self.base)
        if not self._fs.exists(folder):
            return []
        found = (s.getPath().getName() for s in self._fs.listStatus(folder) if s.isFile())
        return sorted(n for n in found if not n.startswith("."))

    def read(self, name: str) -> bytes | None:
        if not self.exists(name):
            return None
        stream = self._fs.open(self._path(self.full(name)))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(self.full(name)), True)

    def write(self, name: str, data: bytes) -> None:
        """All of the bytes or nothing: written beside the target, then renamed over it."""

        def put(path: str) -> None:
            out = self._fs.create(self._path(path), True)
            try:
                out.write(bytearray(data))
                out.hsync()
            finally:
                out.close()

        self.write_via(name, put)

    def write_via(self, name: str, writer: Callable[[str], object], check: Callable[[str], object] | None = None) -> None:
        """``writer`` makes a file or folder at the path it is given, ``check`` may refuse it by raising.

        Only then it replaces the target.
        """
        staging, target = self.full(f".{name}.{uuid.uuid4().hex}"), self._path(self.full(name))
        self._fs.mkdirs(self._path(self.base))
        try:
            writer(staging)
            if check is not None:
                check(staging)
            if self._fs.exists(target):
                self._fs.delete(target, True)
            if not self._fs.rename(self._path(staging), target):
                raise OSError(f"{name} couldn't be renamed into place")
        except BaseException:
            self._fs.delete(self._path(staging), True)
            raise


class Checkpoints:
    """What batch jobs have done, one JSON file a job."""

    def __init__(self, spark: SparkSession, base: str):
        self.files = Files(spark, base)

    def load(self, key: str) -> dict | None:
        """A job's state; None where there is none or it can't be read."""
        data = self.files.read(f"{key}.json")
        try:
            return None if data is None else json.loads(data.decode())
        except ValueError:
            return None

    def save(self, key: str, state: dict) -> None:
        stamped = state | {"updated_at": datetime.now(UTC).isoformat()}
        self.files.write(f"{key}.json", json.dumps(stamped, indent=2, default=str).encode())

    def clear(self, key: str) -> None:
        self.files.delete(f"{key}.json")

    def all(self) -> list[tuple[str, dict]]:
        names = [n.removesuffix(".json") for n in self.files.names() if n.endswith(".json")]
        return [(n, state) for n in names if (state := self.load(n)) is not None]


def retried(fetch: Callable[[], object], tries: int = 3, pause: float = 1.0, sleep: Callable[[float], None] = time.sleep):
    """The result of ``fetch``; failures are tried again after growing pauses, the last one is raised."""
    for n in range(tries):
        try:
            return fetch()
        except Exception:  # noqa: BLE001, PERF203
            if n == tries - 1:
                raise
            sleep(pause * 2**n)


def keep_raw(spark: SparkSession, source: str, raw: str, provider: str, run_id: str) -> str:
    """A copy of a provider's file as it came, under its provider and run; returns its path."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    src = jvm.org.apache.hadoop.fs.Path(source)
    dst = jvm.org.apache.hadoop.fs.Path(f"{raw.rstrip('/')}/{provider}/{run_id}/{src.getName()}")
    jvm.org.apache.hadoop.fs.FileUtil.copy(src.getFileSystem(conf), src, dst.getFileSystem(conf), dst, False, True, conf)
    return dst.toString()
