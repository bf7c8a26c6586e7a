"""Versions of a small JSON state, of which each is committed whole or not at all.

A version is written aside and renamed to its number; renaming fails if another writer has committed that number, who then has to begin again from
the new state. Readers take the last version, so what a writer has put into files is seen when, and only when, a version names it.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class Manifest:
    def __init__(self, spark: SparkSession, folder: str):
        self.folder = folder.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway
        self.fs = self.path(self.folder).getFileSystem(self.conf)

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def version(self) -> int:
        """The last version; 0 before the first."""
        if not self.fs.exists(self.path(self.folder)):
            return 0
        found = [re.fullmatch(r"v(\d+)\.json", f.getPath().getName()) for f in self.fs.listStatus(self.path(self.folder))]
        return max((int(m[1]) for m in found if m), default=0)

    def read(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {}
        stream = self.fs.open(self.path(f"{self.folder}/v{version:08d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, state: dict, base: int) -> int:
        """Make ``state`` the version after ``base``."""
        aside = self.path(f"{self.folder}/_{uuid.uuid4().hex}")
        out = self.fs.create(aside, True)
        out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        out.close()
        files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(self.folder).toUri(), self.conf)
        try:
            files.rename(aside, self.path(f"{self.folder}/v{base + 1:08d}.json"), self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            self.fs.delete(aside, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {base + 1} exists") from e
            raise
        return base + 1

    def update(self, change: Callable[[dict], dict]) -> dict:
        """Commit what ``change`` makes of the last state, begun again whenever another writer is first; the state committed."""
        while True:
            base = self.version()
            state = change(self.read(base))
            try:
                self.commit(state, base)
                return state
            except Conflict:
                continue
