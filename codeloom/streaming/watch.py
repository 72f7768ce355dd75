"""A stream of file events applied to an engine, a micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeloom.engine import Loom
from codeloom.sources.projects import SKIPPED, in_scope

EVENTS = "event_type string, file_path string, seq long"
CONFIGS = ("package.json", "tsconfig.json")


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Events (create, change, delete) as JSON lines that arrive in a folder."""
    return spark.readStream.schema(EVENTS).json(folder)


def relevant(events: DataFrame) -> DataFrame:
    """Sources and configurations outside skipped folders; declaration files don't count."""
    name = F.element_at(F.split("file_path", "/"), -1)
    skipped = F.exists(F.split("file_path", "/"), lambda p: p.isin(*SKIPPED))
    return events.where(~skipped & (name.isin(*CONFIGS) | (in_scope(F.col("file_path")) & ~F.endswith("file_path", F.lit(".d.ts")))))


def latest(events: DataFrame) -> DataFrame:
    """The last event of each path."""
    return events.groupBy("file_path").agg(F.max_by("event_type", "seq").alias("event_type"))


def watch(engine: Loom, events: DataFrame, checkpoint: str, interval: str = "100 milliseconds", once: bool = False) -> StreamingQuery:
    """Applies events as they come: one run at a time, and a full run where a configuration changed."""

    def apply(batch: DataFrame, _: int) -> None:
        rows = [(r.event_type, r.file_path) for r in latest(batch).collect()]
        if not rows:
            return
        if any(path.rsplit("/", 1)[-1] in CONFIGS for _, path in rows):
            engine.reindex()
        else:
            engine.apply_events(rows)

    writer = relevant(events).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
