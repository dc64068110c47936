"""Small JSON records in a shared folder that appear whole or not at all, and never twice."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Commits:
    """Named records of a folder.  A record is written aside and renamed, which fails if its name is taken."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.jvm = spark._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def put(self, name: str, record: dict) -> bool:
        """Write a record; False if there is one of that name already."""
        aside = self._path(f".{name}-{uuid.uuid4().hex}")
        files = aside.getFileSystem(self.conf)
        out = files.create(aside, True)
        out.write(bytearray(json.dumps(record, sort_keys=True).encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self.conf)
        kind = self.jvm.org.apache.hadoop.fs.Options.Rename
        flags = self.spark.sparkContext._gateway.new_array(kind, 1)
        flags[0] = kind.NONE
        try:
            context.rename(aside, self._path(name), flags)
        except Exception:
            files.delete(aside, False)
            if self.get(name) is None:
                raise
            return False
        return True

    def get(self, name: str) -> dict | None:
        path = self._path(name)
        files = path.getFileSystem(self.conf)
        if not files.exists(path):
            return None
        source = files.open(path)
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def names(self) -> list[str]:
        """Names of all records; those still aside don't count."""
        path = self.jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.conf)
        if not files.exists(path):
            return []
        return sorted(n for n in (s.getPath().getName() for s in files.listStatus(path)) if not n.startswith("."))
