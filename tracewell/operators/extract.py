"""From raw lines and payloads to columns (E01-E32), as set-oriented jobs over all files at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import privacy
from tracewell.functions.commands import runner_of
from tracewell.tables import let, once

USAGE = "struct<input_tokens:bigint,cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint,output_tokens:bigint,output_tokens_details:struct<thinking_tokens:bigint>,cache_creation:struct<ephemeral_5m_input_tokens:bigint,ephemeral_1h_input_tokens:bigint>,iterations:array<struct<type:string,model:string,input_tokens:bigint,cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint,output_tokens:bigint,cache_creation:struct<ephemeral_5m_input_tokens:bigint,ephemeral_1h_input_tokens:bigint>>>>"
LINE = (
    "type string, subtype string, uuid string, timestamp string, sessionId string, cwd string, promptId string, requestId string, isApiErrorMessage boolean, error string, toolUseResult string,"
    f"message struct<id:string,model:string,stop_reason:string,content:string,usage:{USAGE}>,"
    "compactMetadata struct<trigger:string,preTokens:double,postTokens:double,cumulativeDroppedTokens:double,durationMs:double>,"
    "hookCount double, hookInfos array<struct<command:string,durationMs:double,promptText:string>>, hookErrors array<string>, durationMs double, messageCount double, pendingBackgroundAgentCount double,"
    "totalCostUSD double, totalAPIDuration double, totalAPIDurationWithoutRetries double, totalToolDuration double, totalDuration double, startTime double, modelUsage map<string,struct<costUSD:double>>,"
    "customTitle string, aiTitle string, summary string"
)
BLOCKS = "array<struct<type:string,id:string,name:string,input:string,tool_use_id:string,content:string,is_error:boolean,text:string>>"


def in_file():
    return Window.partitionBy("path").orderBy("line_no")


def parsed(lines: DataFrame) -> DataFrame:
    """Lines (path, line_no, raw) with their fields; a mistyped field is null and the rest stands. ts in Unix milliseconds."""
    rows = lines.withColumn("j", F.from_json("raw", LINE)).select("path", "line_no", "raw", "j.*")
    return rows.withColumn("ts", F.unix_millis(F.try_to_timestamp("timestamp")))


def prompt_of(p: DataFrame, stretch: int | None = None) -> DataFrame:
    """Adds prompt_id, that of the last user line up to each line of its file.

    With `stretch`, a file is dealt by so many lines: the last prompt of each stretch is carried over the stretches after it, and lines are only looked through inside their own. The
    lines are read twice then, so this is for files that are too long for a task.
    """
    named = F.when(F.col("type") == "user", F.col("promptId"))
    if stretch is None:
        return p.withColumn("prompt_id", F.last(named, ignorenulls=True).over(in_file().rowsBetween(Window.unboundedPreceding, 0)))
    rows = p.withColumn("_stretch", F.floor(F.col("line_no") / stretch))
    lasts = rows.groupBy("path", "_stretch").agg(F.max_by(named, F.when(named.isNotNull(), F.col("line_no"))).alias("_named"))
    carried = lasts.select("path", "_stretch", F.last("_named", ignorenulls=True).over(Window.partitionBy("path").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    inside = F.last(named, ignorenulls=True).over(Window.partitionBy("path", "_stretch").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("prompt_id", inside).join(carried, ["path", "_stretch"]).withColumn("prompt_id", F.coalesce("prompt_id", "_carried")).select(*p.columns, "prompt_id")


def messages(p: DataFrame) -> DataFrame:
    """Assistant lines of a model's messages."""
    return p.where("type = 'assistant' and message.id <> '' and not (message.model <=> '<synthetic>')")


def context_tokens(usage: Column) -> Column:
    """The whole prompt of a request: uncached input, cache reads and cache writes."""
    return usage["input_tokens"] + usage["cache_read_input_tokens"] + usage["cache_creation_input_tokens"]


def requests_from_transcript(p: DataFrame) -> DataFrame:
    """A request for each message: its last usage, model, stop reason and API id, its first time; no usage anywhere leaves tokens unknown."""
    m = messages(prompt_of(p))
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("line_no")))
    rows = m.groupBy("path", F.col("message.id").alias("request_id")).agg(
        F.min_by("sessionId", "line_no").alias("session_id"), F.min_by("prompt_id", "line_no").alias("prompt_id"), F.min_by("ts", "line_no").alias("ts"), last(F.col("message.model")).alias("model"), last(F.col("message.stop_reason")).alias("stop_reason"),
        last(F.col("requestId")).alias("api_request_id"), last(F.col("message.usage")).alias("u"),
    )
    u = F.col("u")
    return rows.select(
        "request_id", "session_id", "prompt_id", "ts", "model", "stop_reason", "api_request_id", u["input_tokens"].alias("input_tokens"), u["cache_read_input_tokens"].alias("cache_read_tokens"), u["cache_creation_input_tokens"].alias("cache_creation_tokens"),
        u["cache_creation"]["ephemeral_5m_input_tokens"].alias("cache_creation_5m_tokens"), u["cache_creation"]["ephemeral_1h_input_tokens"].alias("cache_creation_1h_tokens"), context_tokens(u).alias("context_tokens"), u["output_tokens"].alias("output_tokens"), u["output_tokens_details"]["thinking_tokens"].alias("thinking_tokens"),
    )


#: What a message's lines say, the last of each that is known.
SAID = {"model": "message.model", "stop_reason": "message.stop_reason", "api_request_id": "requestId", "usage": "message.usage"}


def prompt_lines(p: DataFrame) -> DataFrame:
    """(path, line_no, prompt_id) of the user lines that name a prompt."""
    return p.where("type = 'user' and promptId is not null").select("path", F.col("line_no").cast("bigint").alias("line_no"), F.col("promptId").alias("prompt_id"))


def message_parts(p: DataFrame) -> DataFrame:
    """(path, request_id, first, and a field for each of SAID): what some lines of files say of a message, with the numbers of the lines that say so. Parts of any lines, in any order, merge to those of all."""
    at = F.col("line_no").cast("bigint").alias("line_no")
    last = lambda name, c: F.max(F.when(F.col(c).isNotNull(), F.struct(at, F.col(c).alias("v")))).alias(name)
    first = F.min(F.struct(at, F.col("sessionId").alias("session_id"), "ts")).alias("first")
    return messages(p).groupBy("path", F.col("message.id").alias("request_id")).agg(first, *(last(n, c) for n, c in SAID.items()))


def merge_message_parts(parts: DataFrame) -> DataFrame:
    return parts.groupBy("path", "request_id").agg(F.min("first").alias("first"), *(F.max(n).alias(n) for n in SAID))


def requests_of_parts(parts: DataFrame, prompts: DataFrame) -> DataFrame:
    """What requests_from_transcript() gives of the lines that merged message_parts() and prompt_lines() were taken from."""
    a = parts.select("path", F.col("first.line_no").alias("line_no"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("prompt_id"), F.struct("request_id", "first", *SAID).alias("m"))
    b = prompts.select("path", "line_no", F.lit(0).alias("kind"), "prompt_id", F.lit(None).cast(a.schema["m"].dataType).alias("m"))
    order = Window.partitionBy("path").orderBy("line_no", "kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = a.unionByName(b).withColumn("prompt_id", F.last("prompt_id", ignorenulls=True).over(order)).where("kind = 1")
    u = F.col("m.usage.v")
    return rows.select(
        "m.request_id", "m.first.session_id", "prompt_id", "m.first.ts", F.col("m.model.v").alias("model"), F.col("m.stop_reason.v").alias("stop_reason"), F.col("m.api_request_id.v").alias("api_request_id"), u["input_tokens"].alias("input_tokens"), u["cache_read_input_tokens"].alias("cache_read_tokens"),
        u["cache_creation_input_tokens"].alias("cache_creation_tokens"), u["cache_creation"]["ephemeral_5m_input_tokens"].alias("cache_creation_5m_tokens"), u["cache_creation"]["ephemeral_1h_input_tokens"].alias("cache_creation_1h_tokens"), context_tokens(u).alias("context_tokens"),
        u["output_tokens"].alias("output_tokens"), u["output_tokens_details"]["thinking_tokens"].alias("thinking_tokens"),
    )


def blocks(p: DataFrame) -> DataFrame:
    return p.select("*", F.posexplode(F.from_json("message.content", BLOCKS)).alias("pos", "block"))


def tool_uses(p: DataFrame) -> DataFrame:
    """(request_id, tool_use_id, tool, input, ts, cwd, session_id, prompt_id), one for each id of a message."""
    b = blocks(messages(prompt_of(p))).where("block.type = 'tool_use' and block.id is not null")
    first = F.min(F.struct("line_no", "pos", F.col("block.name").alias("tool"), F.col("block.input").alias("input"), "ts", "cwd", F.col("sessionId").alias("session_id"), "prompt_id")).alias("f")
    return b.groupBy(F.col("message.id").alias("request_id"), F.col("block.id").alias("tool_use_id")).agg(first).select("request_id", "tool_use_id", "f.tool", "f.input", "f.ts", "f.cwd", "f.session_id", "f.prompt_id")


def iterations(p: DataFrame) -> DataFrame:
    """request_iterations: the entries of a request's last usage that are no message, numbers as given."""
    m = messages(p).where("message.usage is not null")
    last = m.groupBy(F.col("message.id").alias("request_id")).agg(F.max_by("message.usage", "line_no").alias("u"), F.min("ts").alias("ts"))
    e = last.select("request_id", "ts", F.posexplode("u.iterations").alias("seq", "i")).where("not (i.type <=> 'message')")
    return e.select("request_id", "seq", "ts", "i.type", "i.model", "i.input_tokens", F.col("i.cache_read_input_tokens").alias("cache_read_tokens"), F.col("i.cache_creation_input_tokens").alias("cache_creation_tokens"), F.col("i.cache_creation.ephemeral_5m_input_tokens").alias("cache_creation_5m_tokens"), F.col("i.cache_creation.ephemeral_1h_input_tokens").alias("cache_creation_1h_tokens"), "i.output_tokens")


def mark_key() -> Column:
    """A mark's key: its uuid, else its line's hash."""
    return F.coalesce(F.nullif("uuid", F.lit("")), F.concat(F.lit("line#"), F.substring(F.sha2(F.trim("raw"), 256), 1, 16)))


def marks(p: DataFrame, subtype: str, sessions: DataFrame | None = None) -> DataFrame:
    """System lines of a subtype, each key once; with sessions, those before their session's first recorded run go, marks of unknown time stay."""
    rows = prompt_of(p).where((F.col("type") == "system") & (F.col("subtype") == subtype)).withColumn("entry_id", mark_key()).withColumnRenamed("sessionId", "session_id")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("entry_id").orderBy("path", "line_no"))).where("n = 1").drop("n")
    if sessions is not None:
        rows = rows.join(sessions.select("session_id", "first_ts"), "session_id", "left").where("ts is null or first_ts is null or ts >= first_ts")
    return rows


def compactions(p: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """E06. A trigger that is no plain label is unknown; fractions are cut."""
    m = lambda c: F.col(f"compactMetadata.{c}").cast("bigint")
    trigger = F.when(F.col("compactMetadata.trigger").rlike("^[a-z][a-z0-9_]{0,31}$"), F.col("compactMetadata.trigger"))
    return marks(p, "compact_boundary", sessions).select("entry_id", "session_id", "ts", trigger.alias("trigger"), m("preTokens").alias("pre_tokens"), m("postTokens").alias("post_tokens"), m("cumulativeDroppedTokens").alias("cumulative_dropped_tokens"), m("durationMs").alias("duration_ms"))


def stop_hook_name(command: Column, is_prompt: Column) -> Column:
    """The base name of a program or of the script that an interpreter runs; else # and eight hex digits; a prompt is prompt# and digits."""
    digits = F.substring(F.sha2(command, 256), 1, 8)
    script = F.regexp_extract(command, r"^(?:\S*/)?(?:sh|bash|zsh|python3?|node|bun|deno)\s+(?:-\S+\s+)*([^\s;&|'\"$]+)", 1)
    program = F.regexp_extract(command, r"^([^\s;&|'\"$=]+)", 1)
    base = F.element_at(F.split(F.when(script != "", script).otherwise(program), "/"), -1)
    return F.when(is_prompt, F.concat(F.lit("prompt#"), digits)).when(base.rlike(r"^[A-Za-z0-9_.-]{1,64}$"), base).otherwise(F.concat(F.lit("#"), digits))


def stop_hooks(p: DataFrame, sessions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """stop_hooks and stop_hook_runs; a missing count is the number of runs."""
    m = marks(p, "stop_hook_summary", sessions)
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("bigint")
    summary = m.select("entry_id", "session_id", "prompt_id", "ts", F.coalesce(F.col("hookCount").cast("bigint"), size("hookInfos")).alias("hook_count"), size("hookErrors").alias("hook_errors"))
    runs = m.select("entry_id", "ts", F.posexplode("hookInfos").alias("seq", "h"))
    return summary, runs.select("entry_id", "seq", "ts", stop_hook_name(F.coalesce("h.command", F.lit("")), F.col("h.promptText").isNotNull()).alias("name"), F.col("h.durationMs").cast("bigint").alias("duration_ms"))


def turn_durations(p: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """E08."""
    return marks(p, "turn_duration", sessions).select("entry_id", "session_id", "prompt_id", "ts", F.col("durationMs").cast("bigint").alias("duration_ms"), F.col("messageCount").cast("bigint").alias("message_count"), F.col("pendingBackgroundAgentCount").cast("bigint").alias("background_agents"))


def session_costs(p: DataFrame) -> DataFrame:
    """The last cost snapshot of each session in file order; model costs of names that look like a model's."""
    rows = p.where("type = 'cost-state'")
    last = rows.groupBy(F.col("sessionId").alias("session_id")).agg(F.max_by(F.struct(*[c for c in rows.columns]), F.struct("path", "line_no")).alias("c"))
    costs = F.map_filter(F.transform_values("c.modelUsage", lambda _, v: v["costUSD"]), lambda k, v: k.rlike(r"^[A-Za-z0-9][A-Za-z0-9._:/@\[\]-]{0,99}$") & v.isNotNull())
    ms = lambda c: F.col(f"c.{c}").cast("bigint")
    return last.select("session_id", F.col("c.ts").alias("ts"), ms("startTime").alias("started"), F.col("c.totalCostUSD").alias("cost_usd"), ms("totalAPIDuration").alias("api_ms"), ms("totalAPIDurationWithoutRetries").alias("api_no_retry_ms"), ms("totalToolDuration").alias("tool_ms"), ms("totalDuration").alias("wall_ms"), costs.alias("model_costs"))


def text_bytes(content: Column) -> Column:
    texts = F.filter(F.from_json(content, BLOCKS), lambda b: b["type"] == "text")
    return F.aggregate(texts, F.lit(0).cast("bigint"), lambda n, b: n + F.coalesce(F.octet_length(b["text"]), F.lit(0)))


def delivered_bytes(content: Column) -> Column:
    """UTF-8 bytes of a result as it reached the context: a text's own, or those of its text blocks; empty and null 0; other JSON its own length."""
    blockish = content.rlike(r'^\s*\[\s*\{') & (F.size(F.from_json(content, BLOCKS)) > 0)
    return F.when(content.isNull() | (content == "") | (content == "null"), 0).when(blockish, text_bytes(content)).otherwise(F.octet_length(content)).cast("bigint")


def may_hold(text: Column, name: str) -> Column:
    """Whether JSON can have a field of a name: it says so, or holds an escape, which can spell it otherwise."""
    return text.contains(name) | text.contains("\\")


def json_field(text: Column, path: str) -> Column:
    """get_json_object() of a path of plain names, which looks for the name before it parses."""
    return F.when(may_hold(text, path.rsplit(".", 1)[-1]), F.get_json_object(text, path))


def real_bytes(tool: Column, response: Column) -> Column:
    """A tool's own output size: the first of the persisted size, stdout, a file's content, content, the whole response; unknown for Edit, Write and Agent."""
    get = lambda path: json_field(response, path)
    size = F.coalesce(get("$.persistedOutputSize").cast("bigint"), *(F.octet_length(get(x)).cast("bigint") for x in ("$.stdout", "$.file.content", "$.content")), F.octet_length(response).cast("bigint"))
    return F.when(~tool.isin("Edit", "Write", "MultiEdit", "NotebookEdit", "Agent", "Task"), size)


def result_outcome(text: Column) -> Column:
    """What the opening words of a failed result say of it (fixed values)."""
    starts = lambda *xs: F.lit(False) if not xs else text.startswith(xs[0]) | starts(*xs[1:])
    return (
        F.when(starts("PreToolUse:", "Hook PreToolUse"), "denied by a PreToolUse hook").when(starts("Permission to use", "Claude requested permissions"), "denied by permission")
        .when(starts("The user doesn't want", "[Request interrupted by user"), "rejected or interrupted by the user").when(starts("<tool_use_error>"), "refused by Claude Code")
    )


def tool_results(p: DataFrame) -> DataFrame:
    """(tool_use_id, bytes, failed, outcome, real) of results in user lines. The line's own response counts only beside a single result."""
    b = blocks(p.where("type = 'user'")).where("block.type = 'tool_result' and block.tool_use_id is not null")
    alone = F.count("*").over(Window.partitionBy("path", "line_no")) == 1
    failed = F.coalesce("block.is_error", F.lit(False)).cast("int")
    text = F.coalesce("block.content", F.lit(""))
    uses = tool_uses(p).select("tool_use_id", "tool")
    rows = b.select(F.col("block.tool_use_id").alias("tool_use_id"), delivered_bytes(F.col("block.content")).alias("bytes"), failed.alias("failed"), F.when(failed == 1, result_outcome(text)).alias("outcome"), F.when(alone, F.col("toolUseResult")).alias("response"), "path", "line_no")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("tool_use_id").orderBy("path", "line_no"))).where("n = 1").join(uses, "tool_use_id", "left")
    real = F.when(F.col("failed") == 1, F.col("bytes")).otherwise(real_bytes(F.coalesce("tool", F.lit("")), F.col("response")))
    return rows.select("tool_use_id", "bytes", "failed", "outcome", real.alias("real"))


def file_columns_from_input(calls: DataFrame) -> DataFrame:
    """Adds file_path (joined to cwd if relative), read_start and read_lines from a file tool's input."""
    path = F.coalesce(*(json_field(F.col("input"), f"$.{c}") for c in ("file_path", "notebook_path")))
    path = F.when(path.isNull() | path.startswith("/") | F.col("cwd").isNull(), path).otherwise(F.concat_ws("/", F.regexp_replace("cwd", "/$", ""), path))
    is_read = F.col("tool") == "Read"
    start = F.greatest(F.coalesce(json_field(F.col("input"), "$.offset").cast("bigint"), F.lit(1)), F.lit(1))
    return calls.withColumns({"file_path": path, "read_start": F.when(is_read, start), "read_lines": F.when(is_read, json_field(F.col("input"), "$.limit").cast("bigint"))})


def file_columns_from_result(calls: DataFrame) -> DataFrame:
    """From `response`: the range that a Read returned, and a file's size before an Edit or Write (0 if created, unknown if mistyped)."""
    get = lambda path: json_field(F.col("response"), path)
    v = F.try_variant_get(F.try_parse_json(F.when(may_hold(F.col("response"), "originalFile"), F.col("response"))), "$.originalFile", "variant")
    before = F.when(get("$.type") == "create", 0).when(F.schema_of_variant(v) == "STRING", F.octet_length(get("$.originalFile")))
    return calls.withColumns({
        "read_start": F.coalesce(get("$.file.startLine").cast("bigint"), F.col("read_start")), "read_lines": F.coalesce(get("$.file.numLines").cast("bigint"), F.col("read_lines")),
        "read_total_lines": get("$.file.totalLines").cast("bigint"), "file_bytes_before": before.cast("bigint"),
    })


def line_counts(response: Column) -> tuple[Column, Column]:
    """Lines added and removed by a response's patch; a created file counts its content's lines; unreadable is unknown."""
    hunks = F.from_json(json_field(response, "$.structuredPatch"), "array<struct<lines:array<string>>>")
    count = lambda mark: let(F.transform(hunks, lambda h: h["lines"]), lambda x: F.when(x.isNotNull(), F.size(F.filter(F.flatten(x), lambda y: y.startswith(mark))).cast("bigint")))
    created, content = json_field(response, "$.type") == "create", json_field(response, "$.content")
    whole = F.when(content == "", 0).otherwise(F.size(F.split(F.regexp_replace(content, "\n$", ""), "\n"))).cast("bigint")
    return F.when(created & content.isNotNull(), whole).otherwise(count("+")), F.when(created & content.isNotNull(), F.lit(0).cast("bigint")).otherwise(count("-"))


COMMIT = r"(?m)^\[(\S+)(?: \(root-commit\))? ([0-9a-f]{7,40})\]"


def commit_from_text(command: Column, output: Column) -> tuple[Column, Column]:
    """Sha and branch of a commit that a git command reports."""
    is_commit = command.rlike(r"\bgit\b[^;&|\n]*\bcommit\b") & output.rlike(COMMIT)
    return F.when(is_commit, F.regexp_extract(output, COMMIT, 2)), F.when(is_commit, F.regexp_extract(output, COMMIT, 1))


def agent_totals(p: DataFrame) -> DataFrame:
    """(agent_id, total_tokens, tool_uses, model) of sub-agent transcripts, over each message's last usage."""
    agent = F.regexp_extract("path", r"agent-([^/]+)\.jsonl$", 1)
    r = requests_from_transcript(p.withColumn("sessionId", agent)).groupBy(F.col("session_id").alias("agent_id")).agg(F.sum(F.col("context_tokens") + F.col("output_tokens")).alias("total_tokens"), F.max_by("model", F.struct("ts", "request_id")).alias("model"))
    t = tool_uses(p.withColumn("sessionId", agent)).groupBy(F.col("session_id").alias("agent_id")).agg(F.count_distinct("tool_use_id").alias("tool_uses"))
    return r.join(t, "agent_id", "left").select("agent_id", "total_tokens", F.coalesce("tool_uses", F.lit(0)).alias("tool_uses"), "model").where("agent_id <> ''")


def turn_end(p: DataFrame) -> DataFrame:
    """(path, session_id, event, error_type, ts): how a transcript's last user or assistant line ends its turn, if it does."""
    last = p.where("type in ('user', 'assistant')").groupBy("path").agg(F.max_by(F.struct("type", "sessionId", "message", "isApiErrorMessage", "error", "ts"), "line_no").alias("l")).select("path", "l.*")
    failed = (F.col("type") == "assistant") & F.coalesce("isApiErrorMessage", F.lit(False)) & F.col("message.model").eqNullSafe("<synthetic>")
    event = F.when(failed, "StopFailure").when((F.col("type") == "assistant") & F.col("message.stop_reason").isin("end_turn", "stop_sequence"), "Stop")
    kind = F.when(failed, F.when(F.col("error").rlike("^[a-z][a-z0-9_]{0,63}$"), F.col("error")).otherwise("unknown"))
    return last.select("path", F.col("sessionId").alias("session_id"), event.alias("event"), kind.alias("error_type"), "ts").where("event is not null")


def chat_titles(p: DataFrame) -> DataFrame:
    """(session_id, title): the last custom title, else the last AI title, else the last summary; white space and control characters become one space."""
    session = F.coalesce("sessionId", F.regexp_extract("path", r"([^/]+)\.jsonl$", 1))
    last = lambda c: F.max_by(c, F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.col("line_no")))
    rows = p.groupBy(session.alias("session_id")).agg(F.coalesce(last(F.col("customTitle")), last(F.col("aiTitle")), last(F.col("summary"))).alias("title"))
    return rows.where("title is not null").select("session_id", F.trim(F.regexp_replace("title", r"[\s\p{Cntrl}]+", " ")).alias("title"))


def task_notices(p: DataFrame) -> DataFrame:
    """(agent_id, ts) of notices that a task has a status."""
    text = F.coalesce("message.content", F.lit(""))
    agent, status = F.regexp_extract(text, r"<task-id>\s*([^<\s]+)\s*</task-id>", 1), F.regexp_extract(text, r"<status>\s*([^<]*?)\s*</status>", 1)
    return p.where(F.col("type") == "user").select(agent.alias("agent_id"), "ts", status.alias("status")).where("agent_id <> '' and status <> ''").select("agent_id", "ts")


# Payload rows: (received_ms, hash, event, session_id, payload) of sources.raw.payloads


def field(name: str, kind: str = "string") -> Column:
    """A field of payload rows that are opened()."""
    return F.try_variant_get("_payload", f"$.{name}", kind)


def opened(payloads: DataFrame) -> DataFrame:
    """Payload rows with their payload decoded, once for all of its fields."""
    return once(payloads, {"_payload": F.try_parse_json("payload")})


#: Events that come with no effort of their own do not take the one given as a parameter if they are of these (fixed values).
WITHOUT_FALLBACK = ("PreToolUse", "PostToolUse", "PostToolUseFailure", "PostToolBatch", "Stop", "SubagentStop", "StopFailure")


def event_rows(payloads: DataFrame, effort: str | None = None) -> DataFrame:
    """A row of events for each lifecycle payload, with what has no column sanitised as `detail`. The effort given as a parameter holds for known models other than haiku only."""
    event = F.col("event")
    of = lambda name, *events: F.when(event.isin(*events), field(name))
    fallback = F.when(~event.isin(*WITHOUT_FALLBACK) & (F.coalesce(field("model"), F.lit("")) != "") & ~field("model").contains("haiku"), F.lit(effort))
    prompt = F.when(event.isin("UserPromptSubmit", "UserPromptExpansion"), F.octet_length(field("prompt"))).cast("bigint")
    return opened(payloads.where(~event.isin("PreToolUse", "PostToolUse", "PostToolUseFailure", "PostToolBatch"))).select(
        "hash", "event", "session_id", field("agent_id").alias("agent_id"), field("agent_type").alias("agent_type"), field("prompt_id").alias("prompt_id"), F.col("received_ms").alias("ts"), of("source", "SessionStart").alias("source"), of("reason", "SessionEnd").alias("reason"),
        of("trigger", "Setup", "PreCompact", "PostCompact").alias("trigger"), of("error", "StopFailure").alias("error_type"), of("load_reason", "InstructionsLoaded").alias("load_reason"), of("memory_type", "InstructionsLoaded").alias("memory_type"),
        of("file_path", "InstructionsLoaded").alias("file_path"), of("tool_name", "PermissionRequest", "PermissionDenied").alias("tool"), of("command_name", "UserPromptExpansion").alias("command_name"), of("task_id", "TaskCreated", "TaskCompleted").alias("task_id"), prompt.alias("prompt_bytes"),
        F.coalesce(F.nullif(field("effort.level"), F.lit("")), fallback).alias("effort"), field("permission_mode").alias("permission_mode"), field("model").alias("model"), field("cwd").alias("cwd"), field("transcript_path").alias("transcript_path"),
        privacy.event_detail(F.col("payload"), event, field("tool_name")).alias("detail"),
    )


def sanitized(rows: DataFrame) -> DataFrame:
    """Rows (tool, input) with the test runner of their command, and the input as P01 leaves it."""
    command = F.when(F.col("tool") == "Bash", F.get_json_object("input", "$.command"))
    return rows.withColumn("test_runner", runner_of(command)).withColumn("input", privacy.sanitize_input(F.col("tool"), F.col("input")))


def without_internal_agents(payloads: DataFrame, transcripts: DataFrame | None) -> DataFrame:
    """Payloads that are opened(), but those of agents without a type that no transcript (path) is of: they are internal, and nothing of them is metered."""
    if transcripts is None:
        return payloads
    path = F.concat(F.regexp_replace(field("transcript_path"), r"\.jsonl$", ""), F.lit("/subagents/agent-"), field("agent_id"), F.lit(".jsonl"))
    p = payloads.withColumn("_of", F.when((F.coalesce(field("agent_id"), F.lit("")) != "") & (F.coalesce(field("agent_type"), F.lit("")) == ""), F.coalesce(path, F.lit(""))))
    there = p.where("_of is not null").join(transcripts.select(F.col("path").alias("_of")).distinct(), "_of", "left_semi")
    return p.where("_of is null").unionByName(there).drop("_of")


def call_rows(payloads: DataFrame) -> DataFrame:
    """A call for each finished tool payload: it began its duration before it was received, not before 0. Input and error are as P01 and P03 leave them."""
    p = opened(payloads.where(F.col("event").isin("PostToolUse", "PostToolUseFailure")))
    took = field("duration_ms", "double").cast("bigint")
    failed = (F.col("event") == "PostToolUseFailure").cast("int")
    response = field("tool_response")
    said = once(p.select("received_ms", "event", "session_id", "_payload"), {"tool": field("tool_name"), "_error": field("error"), "_took": took, "_response": response, "_input": field("tool_input"), "_cwd": field("cwd")})
    tool, error, took, response = F.col("tool"), F.col("_error"), F.col("_took"), F.col("_response")
    rows = said.select(
        field("tool_use_id").alias("tool_use_id"), "session_id", field("agent_id").alias("agent_id"), field("agent_type").alias("agent_type"), field("prompt_id").alias("prompt_id"), F.greatest(F.col("received_ms") - F.coalesce(took, F.lit(0)), F.lit(0)).alias("ts"), took.alias("duration_ms"),
        tool, F.col("_input").alias("input"), F.col("_cwd").alias("cwd"), failed.alias("failed"), field("is_interrupt", "boolean").cast("int").alias("is_interrupt"), F.when(failed == 1, result_outcome(F.coalesce(error, F.lit("")))).alias("outcome"),
        F.when(failed == 1, F.octet_length(error).cast("bigint")).otherwise(real_bytes(tool, response)).alias("bytes_real"), response.alias("response"), F.when(failed == 1, error).alias("error"),
    )
    added, removed = line_counts(F.col("response"))
    rows = file_columns_from_result(file_columns_from_input(rows)).withColumns({"lines_added": added, "lines_removed": removed})
    sha, branch = commit_from_text(F.coalesce(json_field(F.col("input"), "$.command"), F.lit("")), F.coalesce(json_field(F.col("response"), "$.stdout"), F.lit("")))
    rows = rows.withColumns({"commit_sha": sha, "commit_branch": branch, "error": privacy.sanitize_error(F.col("error"), F.col("outcome"))}).drop("response")
    return sanitized(rows)


#: How the rows of a call's start are merged (M01): its directory replaces one, what else it says fills, and the earliest time holds.
START_MODES = {"session_id": "fill", "agent_id": "fill", "ts": "min", "tool": "fill", "input": "fill", "cwd": "overwrite", "test_runner": "fill"}


def call_start_rows(payloads: DataFrame, transcripts: DataFrame | None = None) -> DataFrame:
    """What a tool's start says of its call, with its test runner and its input as P01 leaves it; merged by START_MODES."""
    p = without_internal_agents(opened(payloads.where("event = 'PreToolUse'")), transcripts)
    return sanitized(p.select(field("tool_use_id").alias("tool_use_id"), "session_id", field("agent_id").alias("agent_id"), F.col("received_ms").alias("ts"), field("tool_name").alias("tool"), field("tool_input").alias("input"), field("cwd").alias("cwd")))


def batch_rows(payloads: DataFrame, uses: DataFrame | None = None, transcripts: DataFrame | None = None) -> DataFrame:
    """(tool_use_id, session_id, agent_id, tool, bytes_delivered, request_id, outcome) of the calls of a batch.

    Calls that no transcript message holds yet share the pending request of the batch's first call. With `transcripts` (path), batches of
    internal agents are left out (see without_internal_agents()).
    """
    batches = without_internal_agents(opened(payloads.where("event = 'PostToolBatch'")), transcripts)
    of = lambda call, name: F.try_variant_get(call, f"$.{name}", "string")
    # one call may stand alone, without a list
    alone = F.when(field("tool_calls", "map<string,variant>").isNotNull(), F.array(field("tool_calls", "variant")))
    batches = once(batches.select("session_id", "_payload"), {"agent_id": field("agent_id"), "calls": F.coalesce(field("tool_calls", "array<variant>"), alone)})
    # a call is taken out of its batch decoded, and the others do not go along with it
    b = batches.select("session_id", "agent_id", F.concat(F.lit("pending:"), of(F.get("calls", F.lit(0)), "tool_use_id")).alias("pending"), "calls")
    b = b.select("session_id", "agent_id", "pending", F.explode("calls").alias("_call"))
    b = once(b, {"tool_use_id": of(F.col("_call"), "tool_use_id"), "tool": of(F.col("_call"), "tool_name"), "_response": of(F.col("_call"), "tool_response")})
    b = b.select("tool_use_id", "session_id", "agent_id", "tool", delivered_bytes(F.col("_response")).alias("bytes_delivered"), result_outcome(F.coalesce("_response", F.lit(""))).alias("outcome"), "pending")
    if uses is not None:
        b = b.join(uses.select("tool_use_id", F.col("request_id").alias("known")), "tool_use_id", "left").withColumn("request_id", F.coalesce("known", "pending")).drop("known")
    else:
        b = b.withColumn("request_id", F.col("pending"))
    return b.drop("pending")


def agent_rows(payloads: DataFrame) -> DataFrame:
    """What starts, stops and Agent calls say of a sub-agent."""
    p = opened(payloads.where("event in ('SubagentStart', 'SubagentStop')"))
    own = p.select(field("agent_id").alias("agent_id"), "session_id", field("agent_type").alias("agent_type"), field("prompt_id").alias("prompt_id"), F.lit(None).cast("string").alias("parent_tool_use_id"), F.when(F.col("event") == "SubagentStart", F.col("received_ms")).alias("started"), F.when(F.col("event") == "SubagentStop", F.col("received_ms")).alias("stopped"))
    call = opened(payloads.where("event = 'PostToolUse'")).where(field("tool_name").isin("Agent", "Task")).select(F.coalesce(field("tool_response.agentId"), field("tool_response.agent_id")).alias("agent_id"), "session_id", field("tool_input.subagent_type").alias("agent_type"), field("prompt_id").alias("prompt_id"), field("tool_use_id").alias("parent_tool_use_id"), F.lit(None).cast("bigint").alias("started"), F.lit(None).cast("bigint").alias("stopped"))
    return own.unionByName(call).where("agent_id is not null")
