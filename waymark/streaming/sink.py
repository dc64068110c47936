"""Usage events with typed parameters, and a sink that writes every batch once.

Each kind of event has its parameters.  What arrives is the kind and a JSON object;
``typed`` reads it as a variant, gives the parameters as columns and says what is
wrong with an event.  ``EventSink`` writes a stream's batches: valid events to one
table, the others with their reason to a quarantine.  A batch is written aside
and shows by a commit record under its number, so a batch that runs again, after a
failure or a restart, changes nothing.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from waymark.functions.style import CATEGORY_COLOURS
from waymark.sources.commits import Commits

# The parameters of each kind of event; a kind in NULLABLE may have null there.
PARAMETERS: dict[str, dict[str, str]] = {
    "sign_select": {"sign_id": "string", "category": "category", "cluster_size": "int", "zoom": "double"},
    "filter_category_toggle": {"category": "category", "enabled": "boolean"},
    "filter_toggle_all": {"enabled": "boolean"},
    "filter_mode_switch": {"mode": "filter_mode"},
    "filter_signid_toggle": {"sign_id": "string", "enabled": "boolean"},
    "filter_signid_bulk": {"count": "int", "enabled": "boolean"},
    "filter_signid_clear": {},
    "filter_signid_only": {"sign_id": "string"},
    "filter_signid_hide": {"sign_id": "string"},
    "filter_signid_unhide": {"sign_id": "string"},
    "locale_switch": {"from": "string", "to": "string"},
    "theme_change": {"mode": "theme_mode"},
    "info_open": {},
    "map_init_failed": {},
}
NULLABLE = {("sign_select", "sign_id")}
ALLOWED = {"category": [*CATEGORY_COLOURS, "none"], "filter_mode": ["category", "sign-id"], "theme_mode": ["light", "dark", "system"]}
COLUMNS = {"sign_id": "string", "category": "string", "cluster_size": "int", "zoom": "double", "enabled": "boolean", "mode": "string", "count": "int", "from": "string", "to": "string"}
#: How a variant's type is told, by the type that a parameter asks for.
_TOLD = {"string": "STRING", "boolean": "BOOLEAN", "int": "BIGINT", "double": "(BIGINT|DOUBLE|FLOAT|DECIMAL.*)"}

TYPED = "event_id long, at timestamp, kind string, " + ", ".join(f"`{c}` {t}" for c, t in COLUMNS.items())
REJECTED = "event_id long, at timestamp, kind string, params string, problem string"


def _wrong(kind: str, name: str, asked: str) -> Column:
    """What is wrong with a parameter of an event of that kind; null if nothing."""
    told = F.expr(f"schema_of_variant(variant_get(_v, '$.{name}'))")
    is_null = told.isNull() | (told == "VOID")
    missing = F.lit(f"{name} is missing")
    fits = told.rlike(f"^{_TOLD.get(asked, 'STRING')}$")
    if asked in ALLOWED:
        fits = fits & F.expr(f"try_variant_get(_v, '$.{name}', 'string')").isin(ALLOWED[asked])
    elif asked == "int":
        fits = fits & F.expr(f"try_variant_get(_v, '$.{name}', 'int')").isNotNull()
    if (kind, name) in NULLABLE:
        return F.when(told.isNull(), missing).when((told != "VOID") & ~fits, F.lit(f"{name} is no {asked}"))
    return F.when(is_null, missing).when(~fits, F.lit(f"{name} is no {asked}"))


def typed(events: DataFrame) -> DataFrame:
    """``events(event_id, at, kind, params)`` with their parameters as columns and ``problem``.

    ``problem`` is null for a valid event; else the first of: no id, no time,
    unknown kind, parameters that are no JSON object, a missing, wrong or unknown
    parameter.  Events without parameters may have none at all (null or an empty
    text).  Batch or stream.
    """
    blank = F.coalesce(F.trim("params"), F.lit("")) == ""
    own = events.select("event_id", "at", "kind", "params").withColumn("_v", F.try_parse_json(F.when(blank, "{}").otherwise(F.col("params"))))
    own = own.withColumn("_names", F.json_object_keys(F.when(blank, "{}").otherwise(F.col("params"))))
    checks, known = F.lit(None).cast("string"), F.array().cast("array<string>")
    for kind, parameters in PARAMETERS.items():
        first = F.coalesce(*(_wrong(kind, name, asked) for name, asked in parameters.items()), F.lit(None).cast("string"))
        checks = F.when(F.col("kind") == kind, first).otherwise(checks)
        known = F.when(F.col("kind") == kind, F.array(*map(F.lit, parameters)) if parameters else F.array().cast("array<string>")).otherwise(known)
    extra = F.array_except("_names", known)
    problem = (
        F.when(F.col("event_id").isNull(), "no id").when(F.col("at").isNull(), "no time").when(F.col("kind").isNull() | ~F.col("kind").isin(list(PARAMETERS)), "unknown kind")
        .when(F.col("_v").isNull() | F.col("_names").isNull(), "no object").when(checks.isNotNull(), checks).when(F.size(extra) > 0, F.concat(F.lit("unknown "), F.array_min(extra)))
    )
    values = [F.expr(f"try_variant_get(_v, '$.{c}', '{t}')").alias(c) for c, t in COLUMNS.items()]
    return own.select("event_id", "at", "kind", "params", *values, problem.alias("problem"))


def once(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each event_id once while its repeats come within ``late``, events without an id by all their values; batch or stream.

    In a stream an event older than the watermark goes, and events without a time,
    which no watermark can place, all pass.
    """
    mark = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("at", "kind", "params")]
    keyed = events.withColumn("_id", F.coalesce(F.col("event_id").cast("string"), F.concat_ws(":", F.lit("none"), *mark)))
    if not events.isStreaming:
        return keyed.dropDuplicates(["_id"]).drop("_id")
    timed = keyed.where("at is not null").withWatermark("at", late).dropDuplicatesWithinWatermark(["_id"])
    return timed.unionByName(keyed.where("at is null")).drop("_id")


class EventSink:
    """Valid events and a quarantine, written by batches that show once they are committed."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.commits = Commits(spark, f"{self.folder}/batches")

    def write_batch(self, batch: DataFrame, number: int) -> None:
        """Write one batch of ``typed`` events; nothing if its number is committed already."""
        name = f"{number:012d}"
        if self.commits.get(name) is not None:
            return
        aside = f"{self.folder}/data/{name}-{uuid.uuid4().hex}"
        split = batch.withColumn("valid", F.col("problem").isNull())
        split.write.partitionBy("valid").parquet(aside)  # one pass over the batch for both tables
        self.commits.put(name, {"path": aside})

    def start(self, events: DataFrame, checkpoint: str, late: str = "10 minutes", trigger: dict | None = None) -> StreamingQuery:
        """Check, de-duplicate and write a stream of events."""
        stream = typed(once(events, late)).writeStream.foreachBatch(self.write_batch).option("checkpointLocation", checkpoint)
        return stream.trigger(**(trigger or {"availableNow": True})).start()

    def _read(self, valid: bool, schema: str) -> DataFrame:
        paths = [self.commits.get(n)["path"] for n in self.commits.names()]
        full = TYPED + ", params string, problem string, valid boolean"
        parts = [self.spark.read.schema(full).parquet(p) for p in paths]
        rows = reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], full)
        names = self.spark.createDataFrame([], schema).columns
        return rows.where(F.col("valid") == valid).select(*names)

    def events(self) -> DataFrame:
        """All valid events of committed batches."""
        return self._read(True, TYPED)

    def quarantine(self) -> DataFrame:
        """All others, with what is wrong."""
        return self._read(False, REJECTED)
