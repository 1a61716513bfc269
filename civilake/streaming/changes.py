"""Structured Streaming: change events to notifications, with idempotent batches; windowed counts as an extra."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# Which changes are watched (event, table, watched column or null for inserts, operation).
RULES = (
    ("RP_INSERT", "RepresentativeProposer", None, "c"), ("BILL_STAGE_UPDATE", "Bill", "stage", "u"),
    ("BILL_RESULT_UPDATE", "Bill", "bill_result", "u"), ("CONGRESSMAN_PARTY_UPDATE", "Congressman", "party_id", "u"),
)

CHANGE = "txn_id long, table string, op string, ts timestamp, before map<string,string>, after map<string,string>"


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """A stream of change events from landed JSON lines."""
    return spark.readStream.schema(CHANGE).json(path)


def watched(changes: DataFrame, key_column: str) -> DataFrame:
    """``txn_id, event, target, before, after`` of every change a rule watches; an update counts only if its column changed.

    Works alike on a stream and on a table. Rows without a target are skipped.
    """
    hits = []
    for event, table, column, op in RULES:
        own = (F.col("table") == table) & (F.col("op") == op)
        old, new = (F.try_element_at(side, F.lit(column or "")) for side in ("before", "after"))
        moved = own if column is None else own & ~old.eqNullSafe(new)
        hits.append(F.when(moved, F.struct(F.lit(event).alias("event"), old.alias("before"), new.alias("after"))))
    found = changes.select("txn_id", F.col(f"after.{key_column}").alias("target"), F.explode(F.array_compact(F.array(*hits))).alias("h"))
    return found.where("target IS NOT NULL").select("txn_id", "h.event", "target", "h.before", "h.after")


def notifications(events: DataFrame, followers: DataFrame) -> DataFrame:
    """One row for each follower (``target, user_id``) of an event's target: a stream joined with a table."""
    return events.join(followers, "target").select("txn_id", "event", "target", "user_id", "before", "after")


def write_once(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Write what is available. A batch's folder is named by its number, so a batch that is retried replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(keys).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()


def run_to_end(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> DataFrame:
    """Run a stream over all that has landed and read the result; rows seen in several batches count once."""
    write_once(stream, path, checkpoint, keys).awaitTermination()
    rows = stream.sparkSession.read.option("basePath", path).schema(stream.schema).parquet(path)
    return rows.dropDuplicates(keys)


def each_batch(stream: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Apply a merge to each micro-batch of what has landed."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(apply).start()


def windowed_counts(events: DataFrame, when: str, width: str, late: str, *keys: Column) -> DataFrame:
    """Counts in tumbling windows of event time; rows later than ``late`` behind the newest are dropped. An extra, for streams."""
    timed = events.withWatermark(when, late)
    return timed.groupBy(F.window(when, width), *keys).agg(F.count("*").alias("n"))
