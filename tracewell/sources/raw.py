"""Readers of raw records (S01-S07). A record that does not decode is a row of its own kind, never an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.tables import let, once

#: Counts above these are unknown and mark the line partial (fixed values).
MOST_TOKENS, MOST_MICROS = 10**12, 10**15
TOOL_EVENTS = ("PreToolUse", "PostToolUse", "PostToolUseFailure", "PostToolBatch")
LIFECYCLE_EVENTS = (
    "Stop", "UserPromptSubmit", "SessionStart", "SessionEnd", "SubagentStart", "SubagentStop", "Notification", "PreCompact", "PostCompact", "InstructionsLoaded", "PermissionRequest", "UserPromptExpansion", "StopFailure",
)


def lines_of(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, line_no, raw) of whole files (path, content), and the numbered lines that are no JSON object.

    A last line without a line break is a writer still at work: it is left out of both unless it decodes.
    """
    rows = files.select("path", F.posexplode(F.split("content", "\n")).alias("line_no", "raw"), F.size(F.split("content", "\n")).alias("n"))
    rows = rows.where(F.trim("raw") != "").withColumn("good", is_object(F.col("raw")))
    bad = rows.where(~F.col("good") & (F.col("line_no") < F.col("n") - 1))
    return rows.where("good").select("path", "line_no", "raw"), bad.select("path", "line_no", "raw")


def is_object(raw: Column) -> Column:
    return F.coalesce(F.try_parse_json(raw).isNotNull() & raw.rlike(r"^\s*\{"), F.lit(False))


def read_transcripts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S01 over a folder of JSON-lines files: as lines_of(), of files of any size.

    Spark reads a large file by byte ranges, in several tasks. Each range is counted; a line's number is its place in its range and the lines of the ranges before. A file whose lines and
    line breaks are one byte longer than it is has no line break at its end.
    """
    m = lambda name: F.col(f"_metadata.{name}")
    read = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path)
    lines = read.select(m("file_path").alias("path"), m("file_block_start").alias("block"), m("file_size").alias("size"), F.col("value").alias("raw"), F.monotonically_increasing_id().alias("at"))
    ranges = lines.groupBy("path", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.sum(F.octet_length("raw") + 1).alias("bytes"), F.max("size").alias("size"))
    of_file = Window.partitionBy("path")
    before = F.sum("n").over(of_file.orderBy("block")) - F.col("n")
    ranges = ranges.select("path", "block", (before - F.col("first")).alias("offset"), F.sum("n").over(of_file).alias("of_file"), (F.sum("bytes").over(of_file) == F.col("size") + 1).alias("torn"))
    rows = lines.join(ranges, ["path", "block"]).withColumn("line_no", F.col("at") + F.col("offset")).where(F.trim("raw") != "").withColumn("good", is_object(F.col("raw")))
    torn = F.col("torn") & (F.col("line_no") == F.col("of_file") - 1)
    found = lambda cond: rows.where(cond).select("path", "line_no", "raw")
    return found(F.col("good")), found(~F.col("good") & ~torn)


def payloads(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(received_ms, hash, event, session_id, payload) of rows (received_ms, payload), and faults of those without a session or of an unknown event."""
    # decoded once; of a payload that does not decode, what stands before the place where it is torn
    decoded = once(raw.select("received_ms", "payload"), {"_decoded": F.try_parse_json("payload")})
    is_one = F.coalesce(F.col("_decoded").isNotNull() & F.col("payload").rlike(r"^\s*\{"), F.lit(False))

    def of(name: str) -> Column:
        # what may be no text is told as it is written
        value, written = F.when(is_one, F.try_variant_get("_decoded", f"$.{name}", "string")), F.get_json_object("payload", f"$.{name}")
        return let(value, lambda x: F.when(x.isNull() | x.rlike(r"^(?:[{\[].*|-?[0-9][0-9.eE+-]*)$"), written).otherwise(x))

    rows = once(decoded, {"event": of("hook_event_name"), "session_id": of("session_id"), "_object": is_one})
    rows = rows.select("received_ms", F.sha2("payload", 256).alias("hash"), "event", "session_id", "payload", "_object")
    good = F.col("_object") & F.col("session_id").isNotNull() & F.coalesce(F.col("event").isin(*LIFECYCLE_EVENTS, *TOOL_EVENTS), F.lit(False))
    error = F.when(~F.col("_object"), "payload does not decode").when(F.col("session_id").isNull(), "payload without session").otherwise(F.concat(F.lit("unknown event "), F.coalesce("event", F.lit("?"))))
    faults = rows.where(~good).select(F.concat(F.lit("payload:"), "hash", F.lit(":"), "received_ms").alias("fault_id"), F.col("received_ms").alias("ts"), "session_id", F.lit(None).cast("string").alias("tool_use_id"), F.lit("payload").alias("stage"), error.alias("error"))
    return rows.where(good).drop("_object"), faults


def number(v: Column, name: str, most: int) -> Column:
    value = F.try_variant_get(v, f"$.{name}", "bigint")
    return F.when(value.between(0, most), value)


RANK = {"log+span": 3, "log": 2, "span": 1}


def ledger(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ledger rows of lines (path, line_no, raw), and faults. The session is the file's stem; a count out of bounds is unknown and marks the row partial."""
    v = F.try_parse_json("raw")
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    text = lambda name: F.try_variant_get(v, f"$.{name}", "string").alias(name)
    counts = {"input": ("input_tokens", MOST_TOKENS), "output": ("output_tokens", MOST_TOKENS), "cache_read": ("cache_read_tokens", MOST_TOKENS), "cache_creation": ("cache_creation_tokens", MOST_TOKENS), "cost": ("cost_usd_micros", MOST_MICROS)}
    partial = F.lit(False)
    for name, most in counts.values():
        partial = partial | (F.try_variant_get(v, f"$.{name}", "variant").isNotNull() & number(v, name, most).isNull())
    rank = F.coalesce(*(F.when(F.try_variant_get(v, "$.join", "string") == k, r) for k, r in RANK.items()), F.lit(0))
    good = is_object(F.col("raw")) & F.try_variant_get(v, "$.request_id", "string").isNotNull()
    rows = lines.where(good).select(
        text("request_id"), stem.alias("session_id"), (F.unix_millis(F.try_to_timestamp(F.try_variant_get(v, "$.ts", "string")))).alias("ts"), text("agent_id"), text("query_source"), text("model"),
        *(number(v, name, most).alias(a) for a, (name, most) in counts.items()), rank.alias("rank"), partial.alias("partial"), "line_no",
    )
    bad = lines.where(~good).select(F.concat(F.lit("ledger:"), stem, F.lit(":"), "line_no").alias("fault_id"), F.lit(None).cast("bigint").alias("ts"), stem.alias("session_id"), F.lit(None).cast("string").alias("tool_use_id"), F.lit("parse").alias("stage"), F.lit("ledger line without request").alias("error"))
    return rows, bad


def lost_log(lines: DataFrame) -> DataFrame:
    """Faults of a log (raw, modified_ms) of lost events: seconds, event, reason and session by tabs. A line of another shape is a fault of its first 200 bytes at the file's time."""
    part = F.split("raw", "\t")
    good = part[0].rlike(r"^\d{1,12}$") & (F.size(part) >= 3)
    stage = F.when(part[2].startswith("terminated"), "terminated").otherwise("binary")
    return lines.select(
        F.when(good, part[0].cast("bigint") * 1000).otherwise(F.col("modified_ms")).alias("ts"), F.when(good, stage).otherwise("binary").alias("stage"), F.when(good, F.nullif(F.try_element_at(part, F.lit(4)), F.lit(""))).alias("session_id"),
        F.when(good, F.concat_ws(": ", part[1], part[2])).otherwise(F.left("raw", F.lit(200))).alias("error"),
    )


def agent_meta(files: DataFrame) -> DataFrame:
    """(agent_id, agent_type, parent_tool_use_id) of files (path, content) named agent-{id}.meta.json."""
    field = lambda *names: F.coalesce(*(F.get_json_object("content", f"$.{n}") for n in names))
    return files.where(F.col("path").rlike(r"\.meta\.json$")).select(F.regexp_extract("path", r"agent-([^/]*)\.meta\.json$", 1).alias("agent_id"), field("agentType", "agent_type").alias("agent_type"), field("toolUseId", "parent_tool_use_id").alias("parent_tool_use_id"))


def transcripts_of(files: DataFrame) -> DataFrame:
    """(root, project, session_id, modified, bytes) of listed files (path, modified, bytes): transcripts of chats, those of sub-agents left out."""
    shape = r"^(.*)/projects/([^/]+)/([^/]+)\.jsonl$"
    part = lambda i: F.regexp_extract("path", shape, i)
    return files.where(F.col("path").rlike(shape)).select(part(1).alias("root"), part(2).alias("project"), part(3).alias("session_id"), "modified", "bytes")


def list_transcripts(spark: SparkSession, roots: str | Sequence[str]) -> DataFrame:
    """S06 over folders: what transcripts_of() gives of all files in and under the roots, merged; a file under two roots is listed once.

    Only names, times and sizes are read; Spark leaves out files of no bytes. It lists more than 32 folders of a level by a job, so roots with many projects are listed by the executors.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([roots] if isinstance(roots, str) else list(roots))
    return transcripts_of(files.select("path", F.unix_millis("modificationTime").alias("modified"), F.col("length").alias("bytes"))).distinct()


def call_lines(lines: DataFrame) -> DataFrame:
    """(line_no, id, tool, command, cwd, status) of lines to classify; an unreadable one keeps its number and says so."""
    v = F.try_parse_json("raw")
    text = lambda name: F.try_variant_get(v, f"$.{name}", "string")
    cause = F.when(~is_object(F.col("raw")), "not a JSON object").when(text("tool").isNull(), "no tool")
    status = F.when(cause.isNotNull(), F.concat(F.lit("unreadable input line "), F.col("line_no").cast("string"), F.lit(": "), cause)).otherwise("ok")
    return lines.select("line_no", *(text(n).alias(n) for n in ("id", "tool", "command", "cwd")), status.alias("status"))
