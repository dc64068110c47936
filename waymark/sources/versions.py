"""Tables of files that change by whole versions.

A version is a manifest that names the folders its rows lie in.  Data is written
aside first and shows when the manifest is committed, so readers see the version
before or the one after.  Old versions stay readable: nothing is overwritten.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from waymark.operators.hits import last_by
from waymark.sources.commits import Commits


class Conflict(RuntimeError):
    """Another writer committed the version first."""


class _Versions:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.commits = Commits(spark, f"{self.folder}/versions")

    def latest(self) -> int:
        """The number of the last version; 0 before the first."""
        return max((int(n) for n in self.commits.names()), default=0)

    def manifest(self, version: int | None = None) -> dict | None:
        version = self.latest() if version is None else version
        found = self.commits.get(f"{version:08d}")
        if found is None and version:
            raise ValueError(f"no version {version}")
        return found

    def _commit(self, version: int, record: dict) -> int:
        if not self.commits.put(f"{version:08d}", record):
            raise Conflict(f"version {version} is taken")
        return version

    def _aside(self) -> str:
        return f"{self.folder}/data/{uuid.uuid4().hex}"


class LayeredTable(_Versions):
    """A table of layers that are built one by one; a layer that fails is left out as a whole."""

    def publish(self, layers: dict[str, Callable[[], DataFrame]]) -> int:
        """Build and write every layer, then commit those that succeeded, with their counts and the others' errors.

        Nothing is committed if no layer has a row.
        """
        version, good, failed = self.latest() + 1, {}, {}
        for name, build in layers.items():
            path = self._aside()
            try:
                df = build()
                df.write.parquet(path)
                good[name] = {"path": path, "rows": self.spark.read.schema(df.schema).parquet(path).count(), "schema": df.schema.json()}
            except Exception as error:  # whatever a layer's own source raises, the others are built
                failed[name] = str(error).split("\n")[0][:200]
        if not any(layer["rows"] for layer in good.values()):
            raise ValueError(f"no layer gave a row: {failed}")
        return self._commit(version, {"layers": good, "failed": failed})

    def counts(self, version: int | None = None) -> DataFrame:
        """layer, n_rows and published of every layer that a version tried."""
        record = self.manifest(version) or {"layers": {}, "failed": {}}
        rows = [(name, layer["rows"], True) for name, layer in record["layers"].items()] + [(name, None, False) for name in record["failed"]]
        return self.spark.createDataFrame(rows, "layer string, n_rows long, published boolean")

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version with their layer; columns that a layer lacks are null."""
        import json

        layers = (self.manifest(version) or {"layers": {}})["layers"]
        if not layers:
            raise ValueError("nothing is published")
        read = [self.spark.read.schema(StructType.fromJson(json.loads(v["schema"]))).parquet(v["path"]).withColumn("layer", F.lit(name)) for name, v in layers.items()]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), read)


class KeyedTable(_Versions):
    """Rows by key in buckets; an upsert rewrites the buckets in which a row really changes."""

    def __init__(self, spark: SparkSession, folder: str, key: str, schema: str, buckets: int = 64):
        super().__init__(spark, folder)
        self.key, self.buckets = key, buckets
        self.schema = spark.createDataFrame([], schema).schema

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_bucket", F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int"))

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version, or of some of its buckets."""
        folders = (self.manifest(version) or {"buckets": {}})["buckets"]
        paths = [p for b, p in folders.items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def upsert(self, rows: DataFrame, deleted: DataFrame | None = None, order: str | None = None) -> int:
        """Add or replace ``rows`` and remove the keys of ``deleted``; the version with all that, or the last one if nothing changes.

        Of rows that repeat a key the last by ``order`` wins, or without one the
        greatest by its values; a key both given and deleted is given.  Rows without
        a key are left out.
        """
        base = self.latest()
        columns = self.schema.fieldNames()
        given = rows.where(F.col(self.key).isNotNull())
        given = last_by(given, self.key, order) if order else given.groupBy(self.key).agg(F.max(F.struct(*columns)).alias("_v")).select("_v.*")
        given = self._bucketed(given.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema))).withColumn("_given", F.lit(True))
        if deleted is not None:
            gone = self._bucketed(deleted.select(F.col(self.key).cast(self.schema[self.key].dataType).alias(self.key)).where(F.col(self.key).isNotNull()).distinct())
            gone = gone.join(given.select(self.key), self.key, "left_anti").withColumn("_given", F.lit(False))
            given = given.unionByName(gone, allowMissingColumns=True)
        changes = self._aside() + "-changes"
        given.write.parquet(changes)
        given = self.spark.read.schema(given.schema).parquet(changes)
        old = self._bucketed(self.read(base))
        own = F.struct(*(F.col(f"g.{c}") for c in columns))
        was = F.struct(*(F.col(f"o.{c}") for c in columns))
        met = given.alias("g").join(old.withColumn("_there", F.lit(True)).alias("o"), F.col(f"g.{self.key}") == F.col(f"o.{self.key}"), "left")
        differs = F.when(F.col("g._given"), F.col("o._there").isNull() | ~own.eqNullSafe(was)).otherwise(F.col("o._there").isNotNull())
        touched = sorted(r[0] for r in met.where(differs).select("g._bucket").distinct().collect())  # at most ``buckets`` numbers
        if not touched and base:
            return base
        kept = self._bucketed(self.read(base, touched)).join(given.select(self.key), self.key, "left_anti")
        new = kept.unionByName(given.where(F.col("_given") & F.col("_bucket").isin(touched)).drop("_given"))
        path = self._aside()
        new.repartition("_bucket").write.partitionBy("_bucket").parquet(path)
        written = self.spark.read.schema(StructType([*self.schema.fields, StructField("_bucket", IntegerType())])).parquet(path)
        left = {r[0] for r in written.select("_bucket").distinct().collect()}
        folders = {b: p for b, p in (self.manifest(base) or {"buckets": {}})["buckets"].items() if int(b) not in touched}
        folders |= {str(b): f"{path}/_bucket={b}" for b in touched if b in left}
        return self._commit(base + 1, {"buckets": folders, "rewritten": touched})
