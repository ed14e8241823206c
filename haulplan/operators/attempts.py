"""Shard state from a log of copy attempts: ``shard_id, attempt, rc``.

``rc`` 0 means copied.  A null ``rc`` is an attempt that left no result, for
example because its shard file was missing; it counts as an attempt only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulplan.operators.ordering import number_within
from haulplan.staging import stage

MAX_ATTEMPTS = 5  # Fixed value: default number of attempts per shard.


def number_attempts(log: DataFrame) -> DataFrame:
    """``shard_id, attempt, rc`` of a log ``shard_id, ts, event_id, rc``, counted from 1 in time order."""
    numbered = number_within(log, ["shard_id"], [F.col("ts"), F.col("event_id")], "earlier")
    return numbered.select("shard_id", (F.col("earlier") + 1).alias("attempt"), "rc")


def attempt_summary(attempts: DataFrame) -> DataFrame:
    """Per shard that was started: attempts, status and last return code.

    Attempts logged after the first success are ignored.  Plain aggregates, so
    the same expression runs on a table and on a stream.
    """
    done_at = F.min(F.when(F.col("rc") == 0, F.col("attempt")))
    last_rc = F.max_by("rc", F.when(F.col("rc").isNotNull(), F.col("attempt")))
    return attempts.groupBy("shard_id").agg(
        F.coalesce(done_at, F.max("attempt")).cast("bigint").alias("attempts"),
        F.when(done_at.isNotNull(), "done").when(last_rc.isNotNull(), "fail").otherwise("pending").alias("status"),
        F.when(done_at.isNotNull(), F.lit(0)).otherwise(last_rc).cast("bigint").alias("last_rc"),
    )


def shard_status(shards: DataFrame, attempts: DataFrame) -> DataFrame:
    """State of every shard of a summary (``shard_id, files, ...``); empty shards are done."""
    seen = attempt_summary(attempts).withColumnRenamed("shard_id", "seen_id")
    joined = shards.join(seen, F.col("shard_id") == F.col("seen_id"), "left")
    status = F.when(F.col("files") == 0, "done").otherwise(F.coalesce("status", F.lit("pending")))
    return joined.select(
        "shard_id", "files", F.coalesce("attempts", F.lit(0).cast("bigint")).alias("attempts"), status.alias("status"), "last_rc"
    )


def pending_work(sharded: DataFrame, status: DataFrame) -> DataFrame:
    """Manifest records whose shard is not done yet.

    The finished shards are written as a small table, so that its true size
    decides whether it is broadcast; the records are then not shuffled.
    """
    done = stage(status.where(F.col("status") == "done").select("shard_id"), "done")
    return sharded.join(done, "shard_id", "left_anti")


def retry_plan(status: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Add ``action``: ``retry`` or ``exhausted`` for failed shards, else none/start."""
    action = (
        F.when(F.col("status") == "done", "none")
        .when(F.col("status") == "pending", "start")
        .when(F.col("attempts") < max_attempts, "retry")
        .otherwise("exhausted")
    )
    return status.withColumn("action", action)
