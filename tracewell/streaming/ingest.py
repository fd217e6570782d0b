"""Streaming ingestion (M12 and the batch rules): micro-batches append what came in, and the tables that follow from it are made by the functions that a batch job uses.

Spark's file source follows whole files, so writers of ledgers, payloads and transcripts must roll their files; a file that grows after it was read is not read again.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewell import schema
from tracewell.operators import extract, merge
from tracewell.sources import raw
from tracewell.streaming.store import Rule, Store

RULES = {
    "deliveries": Rule(["hash", "received_ms"], lambda d: d.distinct()),
    "faults": Rule(["fault_id"], lambda d: merge.insert_earliest(d, "fault_id")),
    "ledger": Rule(["request_id"], merge.best_ledger),
    "ledger_faults": Rule(["fault_id"], lambda d: merge.insert_earliest(d, "fault_id")),
    "messages": Rule(["path", "request_id"], extract.merge_message_parts),
    "prompts": Rule(["path", "line_no"], lambda d: d.groupBy("path", "line_no").agg(F.min("prompt_id").alias("prompt_id"))),
    "line_faults": Rule(["fault_id"], lambda d: merge.insert_earliest(d, "fault_id")),
    "recorded": Rule(["request_id"], lambda d: merge.insert_earliest(d, "request_id")),
}


def open_store(spark: SparkSession, folder: str) -> Store:
    return Store(spark, folder, RULES)


def deliveries(payloads: DataFrame) -> DataFrame:
    return payloads.select("received_ms", "hash", "event", "session_id", "payload").distinct()


def derived(rows: DataFrame) -> dict[str, DataFrame]:
    """The tables that follow from all deliveries of some sessions: as a batch job makes them, and so the same for any order of arrival."""
    held = merge.claim_occurrences(rows)
    events = extract.event_rows(held).join(held.select("hash", F.col("received_ms").alias("ts"), "event_id", F.col("ts").alias("first_ts")), ["hash", "ts"]).withColumn("ts", F.col("first_ts")).drop("first_ts", "hash")
    events = merge.insert_earliest(events.distinct())
    seen = extract.opened(held.select("session_id", "received_ms", "payload")).select("session_id", F.col("received_ms").alias("ts"), extract.field("cwd").alias("cwd"), extract.field("transcript_path").alias("transcript_path"))
    return {"events": events, "sessions": merge.touch_sessions(seen), "agent_turns": merge.agent_turns(events)}


def tables(store: Store) -> dict[str, DataFrame]:
    """events, sessions and agent_turns as all deliveries so far make them; none before the first."""
    rows = store.read("deliveries")
    return {} if rows is None else derived(rows)


def held(store: Store) -> DataFrame | None:
    """Requests of all transcripts so far, as extract.requests_from_transcript() gives them; None if there is none."""
    messages, prompts = store.read("messages"), store.read("prompts")
    return None if messages is None or prompts is None else extract.requests_of_parts(messages, prompts)


def requests(store: Store) -> tuple[DataFrame, DataFrame] | None:
    """Requests, and the summary of merge.join_ledger(): those recorded, settled by what transcripts hold of them (M07), with the prices and side calls of the ledger (M11). None if there is nothing."""
    recorded, read, lines, seen = store.read("recorded"), held(store), store.read("ledger"), tables(store).get("sessions")
    spark = store.spark
    if recorded is None and read is None and lines is None:
        return None
    none = spark.createDataFrame([], schema.schema("requests"))
    recorded = none if recorded is None else schema.conform(recorded, "requests")
    seen = spark.createDataFrame([], "session_id string, first_ts bigint") if seen is None else seen
    settled = recorded if read is None else merge.settle(recorded, read.drop("calls"), seen)
    known = none if read is None else read
    if lines is None:
        lines = raw.ledger(spark.createDataFrame([], "path string, line_no bigint, raw string"))[0]
    return merge.join_ledger(settled, lines, known.select("request_id", "api_request_id"))


def _run(stream: DataFrame, batch, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@contextmanager
def dealt(lines: DataFrame) -> Iterator[DataFrame]:
    """The lines (path, line_no, raw) of a micro-batch, read once for all tables that they go to and dealt by line: a file, however large, may come in one task, and lines are parsed in many."""
    held = lines.repartition(lines.sparkSession.sparkContext.defaultParallelism, "path", "line_no").persist()
    try:
        yield held
    finally:
        held.unpersist()


def payload_stream(spark: SparkSession, source: str, store: Store, checkpoint: str, files: int = 1000) -> StreamingQuery:
    """Files of (received_ms, payload) rows, JSON lines, into `deliveries` and `faults`; so many files at most in a micro-batch."""

    def batch(df: DataFrame, number: int) -> None:
        good, faults = raw.payloads(df)
        store.append("deliveries", deliveries(good), "payloads", number)
        store.append("faults", faults, "payloads", number)

    return _run(spark.readStream.schema("received_ms bigint, payload string").option("maxFilesPerTrigger", files).json(source), batch, checkpoint)


def rolled_lines(spark: SparkSession, source: str, files: int = 1000) -> DataFrame:
    """A stream of (path, line_no, raw) of rolled files: the path without the number of the roll before the extension, and numbers that grow from file to file by their times."""
    whole = spark.readStream.option("maxFilesPerTrigger", files).text(source, wholetext=True)
    path = F.regexp_replace(F.col("_metadata.file_path"), r"\.\d+(\.[^./]*)$", "$1")
    parts = whole.select(path.alias("path"), (F.unix_millis("_metadata.file_modification_time") * 1_000_000).alias("base"), "value")
    lines = parts.select("path", "base", F.posexplode(F.split("value", "\n")).alias("pos", "raw")).where(F.trim("raw") != "")
    return lines.select("path", (F.col("base") + F.col("pos")).alias("line_no"), "raw")


def ledger_batches(lines: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """A stream of ledger lines (path, line_no, raw) into `ledger` and `ledger_faults`; the session is the stem of the path."""

    def batch(df: DataFrame, number: int) -> None:
        with dealt(df) as lines:
            rows, faults = raw.ledger(lines)
            store.append("ledger", rows, "ledger", number)
            store.append("ledger_faults", faults, "ledger", number)

    return _run(lines, batch, checkpoint)


def ledger_stream(spark: SparkSession, source: str, store: Store, checkpoint: str, files: int = 1000) -> StreamingQuery:
    """Rolled ledger files into the store; requests() has them in its prices and side calls."""
    return ledger_batches(rolled_lines(spark, source, files), store, checkpoint)


def transcript_batches(lines: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """A stream of transcript lines (path, line_no, raw) into `messages`, what each line says of its message, `prompts`, and `line_faults`."""

    def batch(df: DataFrame, number: int) -> None:
        with dealt(df) as lines:
            good = raw.is_object(F.col("raw"))
            p = extract.parsed(lines.where(good))
            store.append("messages", extract.message_parts(p), "transcripts", number)
            store.append("prompts", extract.prompt_lines(p), "transcripts", number)
            bad = lines.where(~good).select(F.concat_ws(":", F.lit("line"), "path", F.col("line_no").cast("string")).alias("fault_id"), F.lit(None).cast("bigint").alias("ts"), F.lit("parse").alias("stage"), F.left("raw", F.lit(200)).alias("error"))
            store.append("line_faults", bad, "transcripts", number)

    return _run(lines, batch, checkpoint)


def transcript_stream(spark: SparkSession, source: str, store: Store, checkpoint: str, files: int = 1000) -> StreamingQuery:
    """Rolled transcript files into the store; held() has their requests, and so has requests()."""
    return transcript_batches(rolled_lines(spark, source, files), store, checkpoint)
