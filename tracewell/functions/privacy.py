"""Privacy rules (P01-P05, P07, P08): what stays of a payload is shape, numbers and labels; other text becomes its byte count."""

from __future__ import annotations

import json
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.commands import cut_content
from tracewell.tables import once

#: Of an input: fields that never keep their text; those that do; labels, which do up to LABEL bytes; and tools whose command is kept without its content (fixed values).
DROPPED = ("content", "old_string", "new_string", "edits", "new_source", "prompt")
PATHS = ("file_path", "notebook_path", "path", "pattern", "glob")
LABELS = ("subagent_type", "model", "skill", "task_id", "shell_id", "output_mode", "type", "cell_id", "cell_type", "edit_mode", "to")
LABEL = 4096
SHELL_TOOLS = ("Bash", "Monitor")
#: Of a payload's detail: keys that keep their text; keys that do by event, if it is a label; and keys left out, as they have columns: of every event, and by event (fixed values).
DETAIL_KEYS = (
    "id", "type", "status", "source", "trigger", "level", "mode", "behavior", "destination", "notification_type", "load_reason", "memory_type", "command_name", "command_source", "expansion_type", "task_id", "tool_name", "tool_use_id", "model",
    "file_path", "trigger_file_path", "schedule", "cron",
)
DETAIL_LABELS = {("StopFailure", "error"): r"[a-z][a-z0-9_]{0,63}", ("SessionEnd", "reason"): "clear|resume|logout|prompt_input_exit|bypass_permissions_disabled|other"}
IN_COLUMNS = ("session_id", "transcript_path", "cwd", "hook_event_name", "prompt_id", "agent_id", "agent_type", "permission_mode", "effort")
IN_COLUMNS_BY_EVENT = {
    "SessionStart": ("source", "model"), "SessionEnd": ("reason",), "Setup": ("trigger",), "PreCompact": ("trigger",), "PostCompact": ("trigger",), "StopFailure": ("error",), "InstructionsLoaded": ("load_reason", "memory_type", "file_path"),
    "PermissionRequest": ("tool_name",), "PermissionDenied": ("tool_name",), "UserPromptSubmit": ("prompt",), "UserPromptExpansion": ("command_name", "prompt"), "TaskCreated": ("task_id",), "TaskCompleted": ("task_id",),
    "Stop": ("background_tasks", "session_crons", "last_assistant_message", "stop_hook_active"), "SubagentStop": ("background_tasks", "session_crons", "last_assistant_message", "stop_hook_active"),
}
TASK_NOTICE = "<task-notification>"
NOT_STORED = "error text not stored"
OUTCOMES = ("denied by a PreToolUse hook", "denied by permission", "rejected or interrupted by the user", "refused by Claude Code")


def cut_url(url: Column) -> Column:
    """A URL without query, fragment and user."""
    return F.regexp_replace(F.regexp_replace(url, r"[?#][\s\S]*$", ""), r"^([^/@:]+://|//)[^/]*@", "$1")


def sanitize_error(error: Column, outcome: Column | None = None) -> Column:
    """An outcome label, a first line that is an exit code, or a fixed label."""
    line = F.element_at(F.split(error, "\n"), 1)
    stored = F.when(error.isNull(), None).when(error.isin(*OUTCOMES, NOT_STORED), error).when(line.rlike(r"^Exit code -?[0-9]+$"), line).otherwise(NOT_STORED)
    return stored if outcome is None else F.when(error.isNotNull() & outcome.isin(*OUTCOMES), outcome).otherwise(stored)


def sanitize_fault(stage: Column, text: Column) -> Column:
    """A parse fault keeps its part and program, and how many bytes its message had; other stages keep their own message."""
    sized = rf"^{NOT_STORED} \([0-9]+ bytes\)$"
    part = lambda i: F.regexp_extract(text, r"(?s)^part ([0-9]+) \((.*?)\): (.*)$", i)
    of = lambda message: F.concat(F.lit(f"{NOT_STORED} ("), F.octet_length(message).cast("string"), F.lit(" bytes)"))
    named = F.when(part(2) == "", "no program parsed").otherwise(part(2))
    known = text.rlike(sized) | ((part(1) != "") & (part(2) != "") & part(3).rlike(sized))
    return F.when((stage != "parse") | stage.isNull() | known, text).when(part(1) == "", of(text)).otherwise(F.concat(F.lit("part "), part(1), F.lit(" ("), named, F.lit("): "), of(part(3))))


@F.pandas_udf(T.StructType([T.StructField("command", T.StringType()), T.StructField("heredoc_bytes", T.IntegerType()), T.StructField("operand_bytes", T.IntegerType())]))
def cut_command(commands: pd.Series) -> pd.DataFrame:
    """P06 for a column: see cut_content(); nulls stay."""
    found = {c: (None, 0, 0) if c is None else cut_content(c) for c in commands.unique()}
    return pd.DataFrame([found[c] for c in commands], columns=["command", "heredoc_bytes", "operand_bytes"])


def sanitize_input(tool: Column, value: Column) -> Column:
    """One level of an input, its keys in order. For an mcp__ tool no text stays. What is no JSON object is dropped."""
    shell = F.coalesce(tool.isin(*SHELL_TOOLS), F.lit(False))
    cut = cut_command(F.when(shell, F.get_json_object(value, "$.command")))
    some = lambda name: F.when(cut[name] > 0, _pair(F.lit(name), cut[name].cast("string")))
    size = _pair(F.lit("command_bytes"), F.octet_length(F.get_json_object(value, "$.command")).cast("string"))
    stays = F.array_compact(F.array(_pair(F.lit("command"), _json_text(cut["command"])), some("heredoc_bytes"), some("operand_bytes")))
    command = F.try_variant_get(F.try_parse_json(F.when(shell, value)), "$.command", "variant")
    of_shell = F.when(F.coalesce(F.schema_of_variant(command) == "STRING", F.lit(False)), F.when(cut["command"].isNull(), F.array(size)).otherwise(stays)).otherwise(F.array().cast(PAIRS))
    shown = F.transform(F.array_sort(F.concat(_pieces(value, shell, F.coalesce(tool.startswith("mcp__"), F.lit(False))), of_shell)), lambda x: F.concat(_json_text(x["k"]), F.lit(":"), x["v"]))
    return F.concat(F.lit("{"), F.array_join(shown, ","), F.lit("}"))


PAIRS = "array<struct<k:string,v:string>>"


def _pair(k: Column, v: Column) -> Column:
    return F.struct(k.alias("k"), v.alias("v"))


def _json_text(v: Column) -> Column:
    shown = F.to_json(F.struct(v.alias("v")))
    return F.when(v.isNotNull(), F.substring(shown, F.lit(6), F.length(shown) - 6))


def _pieces(value: Column, shell: Column, mcp: Column) -> Column:
    """What stays of an input by key, but for the command of a shell. Keys meet their texts and their kinds as maps, each of which is read once. Null if it is no JSON object."""
    none = F.array().cast(PAIRS)
    kinds = F.transform_values(F.try_variant_get(F.try_parse_json(value), "$", "map<string,variant>"), lambda _, v: F.schema_of_variant(v))
    fields = F.map_zip_with(F.from_json(value, "map<string,string>"), F.coalesce(kinds, F.create_map().cast("map<string,string>")), lambda _, v, kind: F.struct(v.alias("text"), kind.alias("kind")))

    def pieces(e: Column) -> Column:
        k, v, kind = e["key"], e["value"]["text"], e["value"]["kind"]
        text, plain = kind == "STRING", kind.rlike("^(BIGINT|DOUBLE|DECIMAL.*|BOOLEAN|VOID)")
        size = F.array(_pair(F.concat(k, F.lit("_bytes")), F.octet_length(F.coalesce(v, F.lit(""))).cast("string")))
        short = F.octet_length(v) <= LABEL
        return (
            F.when(k.isin(*DROPPED), size).when((k == "command") & shell & text, none).when(plain, F.array(_pair(k, F.coalesce(v, F.lit("null"))))).when(mcp | ~text, size)
            .when(k.isin(*PATHS), F.array(_pair(k, _json_text(v)))).when((k == "url") & short, F.array(_pair(k, _json_text(cut_url(v))))).when(k.isin(*LABELS) & short, F.array(_pair(k, _json_text(v)))).otherwise(size)
        )

    return F.flatten(F.transform(F.map_entries(fields), pieces))


def _bytes(text: str) -> int:
    return len(text.encode("utf-8", "replace"))


def _detail(value: object, event: str | None, key: str | None, sized: bool, tool: str | None = None) -> object:
    """value, found under a key: shape, numbers and booleans stay, and text under a listed key; other text is counted."""
    stays = lambda k, v: not sized and (k in DETAIL_KEYS or ((event, k) in DETAIL_LABELS and re.fullmatch(DETAIL_LABELS[event, k], v) is not None))
    if isinstance(value, dict):
        mcp = tool is not None and tool.startswith("mcp__")
        return dict((f"{k}_bytes", _bytes(v)) if isinstance(v, str) and not stays(k, v) else (k, v if isinstance(v, str) else _detail(v, event, k, sized or mcp and k == "tool_input")) for k, v in value.items())
    if isinstance(value, list):
        return [(v if stays(key, v) else _bytes(v)) if isinstance(v, str) else _detail(v, event, key, sized) for v in value]
    return value


@F.arrow_udf(T.StringType())
def _details(details: pa.Array, events: pa.Array, tools: pa.Array, whole: pa.Array) -> pa.Array:
    """Texts leave their Arrow batch one at a time, so one decoded text is held, not those of a batch."""

    def one(text: str | None, event: str | None, tool: str | None, payload: bool) -> str | None:
        try:
            found = None if text is None else json.loads(text)
        except ValueError:
            return None
        if not isinstance(found, (dict, list)):
            return None
        more = {}
        if payload and isinstance(found, dict):
            prompt = found.get("prompt")
            if event == "UserPromptSubmit" and isinstance(prompt, str) and prompt.startswith(TASK_NOTICE):
                more = {"task_notification": True}
            found = {k: v for k, v in found.items() if k not in IN_COLUMNS and k not in IN_COLUMNS_BY_EVENT.get(event or "", ())}
        cleaned = _detail(found, event, None, False, tool)
        return json.dumps(cleaned | more if more else cleaned, separators=(",", ":"), ensure_ascii=False)

    return pa.array((one(*(v.as_py() for v in x)) for x in zip(details, events, tools, whole, strict=True)), pa.string())


def sanitize_detail(detail: Column | str, event: Column | None = None, tool: Column | None = None) -> Column:
    """JSON of any depth, of an event and a tool: shape, numbers, booleans and listed labels stay, other text becomes its byte count. What does not decode is dropped."""
    none = F.lit(None).cast("string")
    return _details(detail, none if event is None else event, none if tool is None else tool, F.lit(False))


def event_detail(payload: Column, event: Column, tool: Column) -> Column:
    """What of a payload has no column of its own, by P05; and whether its prompt is a task's notice."""
    return _details(payload, event, tool, F.lit(True))


def redact(calls: DataFrame, faults: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The rules applied to stored rows: calls, faults, parts (those of calls whose input changed go), and (column, changed)."""
    new_input, new_error = sanitize_input(F.col("tool"), F.col("input")), sanitize_error(F.col("error"))
    c = once(calls, {"_input": new_input, "_error": new_error})
    changed = c.where(~F.col("_input").eqNullSafe(F.col("input"))).select("tool_use_id")
    f = faults.withColumn("_error", sanitize_fault(F.col("stage"), F.col("error")))
    count = lambda df, name, a, b: df.agg(F.lit(name).alias("column"), F.count_if(~F.col(a).eqNullSafe(F.col(b))).alias("changed"))
    counts = count(c, "calls.input", "_input", "input").unionByName(count(c, "calls.error", "_error", "error")).unionByName(count(f, "faults.error", "_error", "error"))
    put = lambda df, names: df.withColumns({n: F.col(f"_{n}") for n in names}).drop(*(f"_{n}" for n in names))
    return put(c, ["input", "error"]), put(f, ["error"]), parts.join(changed, "tool_use_id", "left_anti"), counts


def count_unredacted(calls: DataFrame) -> DataFrame:
    """One row of how many calls P01 or P03 would still change."""
    return calls.agg(F.count_if(~sanitize_input(F.col("tool"), F.col("input")).eqNullSafe(F.col("input")) | ~sanitize_error(F.col("error")).eqNullSafe(F.col("error"))).alias("n"))
