"""Progress events of scans: an append-only log of JSON lines, and the live state of each scan.

Events carry scan_id and seq, which order them within a scan. A scan is running until an event ends it; the last such
event by seq tells how.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "scan_id string, seq bigint, event string, scan_type string, total_hosts bigint, ip string, hostname string, device_type string, protocol string, from_protocol string, to_protocol string, total bigint, new bigint, skipped boolean, reason string, error string, depth int, devices_in_layer bigint, total_discovered bigint, total_devices bigint, failed_count bigint, elapsed double, inventory_key string"
# Kinds of events, and how a scan stands after those that end it.
KINDS = ["scan_started", "device_connecting", "connection_fallback", "device_authenticated", "collecting_data", "neighbors_found", "device_complete", "device_failed", "layer_complete", "scan_complete", "scan_cancelled", "scan_error"]
ENDS = {"scan_complete": "complete", "scan_error": "error", "scan_cancelled": "cancelled"}


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).json(path)


def status(event: Column) -> Column:
    out = F.lit("running")
    for name, state in ENDS.items():
        out = F.when(event == name, state).otherwise(out)
    return out


def live_state(events: DataFrame) -> DataFrame:
    """One row a scan: status, devices done, failed and skipped, the deepest layer, and the last event. Runs on batches and, in update or complete mode, on streams."""
    ended = F.col("event").isin(list(ENDS))
    is_ = lambda e: F.col("event") == e
    skipped = F.coalesce("skipped", F.lit(False))
    out = events.groupBy("scan_id").agg(
        F.coalesce(F.max_by(F.when(ended, status(F.col("event"))), F.when(ended, F.col("seq"))), F.lit("running")).alias("status"),
        F.count_if(is_("device_complete") & ~skipped).alias("done"), F.count_if(is_("device_failed")).alias("failed"), F.count_if(is_("device_complete") & skipped).alias("skipped"),
        F.max("depth").alias("depth"), F.count("*").alias("events"), F.max_by("event", "seq").alias("last_event"),
    )
    return out


def running(state: DataFrame) -> DataFrame:
    """Scans that run; a new scan may start only if there is none."""
    return state.where("status = 'running'").select("scan_id")


def messages(events: DataFrame, beside: Sequence[str] = ()) -> DataFrame:
    """Events as messages of an event stream over HTTP: a line with the kind, a line with the data, a blank line. Columns in `beside` are not part of the data but stay."""
    body = F.to_json(F.struct(*[c for c in events.columns if c not in ("scan_id", "seq", *beside)]))
    return events.select("scan_id", "seq", *beside, F.concat(F.lit("event: "), F.coalesce("event", F.lit("message")), F.lit("\ndata: "), body, F.lit("\n\n")).alias("message"))


def to_messages(events: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Sends messages of each micro-batch, in order of scan and seq, to a sink."""
    return messages(events).writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: send(df.orderBy("scan_id", "seq"), i)).trigger(availableNow=True).start()


def to_table(events: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """The live state as a table in memory, whole after each micro-batch."""
    return live_state(events).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
