"""Raw records that stand in for transcripts, payloads and ledgers, made from `conversations` and the stand-in views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.plans.standins import StandIns

START = 1_704_067_200  # 2024-01-01, in seconds


def stamp(offset: int) -> Column:
    return F.concat(F.substring(F.date_format(F.timestamp_seconds(F.lit(START) + F.col("conv_id") % 100_000 * 3600 + F.col("turn") * 60 + offset).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ssXXX"), 1, 40))


def transcripts(S: StandIns) -> DataFrame:
    """(path, line_no, raw): a file for each conversation. An assistant turn has two lines of one message and a line with its call's result."""
    c = S.table("conversations").withColumn("n", F.length("text"))
    session = F.concat(F.lit("s"), F.col("conv_id").cast("string"))
    tag = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    name = lambda p: F.concat(F.lit(p), tag)
    usage = lambda out: F.struct(
        (F.col("n") % 1000).alias("input_tokens"), (F.col("turn") * 1000).alias("cache_read_input_tokens"), (F.col("n") * 3 % 700).alias("cache_creation_input_tokens"), out.alias("output_tokens"),
        F.array(F.struct(F.lit("message").alias("type"), F.lit(1).alias("output_tokens")), F.struct(F.lit("fallback_message").alias("type"), (F.col("n") % 77).alias("output_tokens"))).alias("iterations"),
    )
    model = F.concat(F.lit("model-"), (F.col("conv_id") % 3).cast("string"))
    user = F.struct(F.lit("user").alias("type"), stamp(0).alias("timestamp"), session.alias("sessionId"), F.when(F.col("turn") % 3 != 0, name("p")).alias("promptId"), F.struct(F.col("text").alias("content")).alias("message"))
    said = F.struct(F.lit("assistant").alias("type"), stamp(0).alias("timestamp"), session.alias("sessionId"), name("req").alias("requestId"), F.struct(name("m").alias("id"), model.alias("model"), F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("content"), usage(F.lit(1)).alias("usage")).alias("message"))
    command = F.struct(F.when(F.col("n") % 2 == 0, F.concat(F.lit("git commit -m 'x "), tag, F.lit("'"))).otherwise(F.concat(F.lit("cd t"), F.col("turn").cast("string"), F.lit(" && pytest -q "), tag, F.lit(".py | tail -3"))).alias("command"))
    call = F.struct(F.lit("assistant").alias("type"), stamp(1).alias("timestamp"), session.alias("sessionId"), F.lit("/w").alias("cwd"), F.struct(name("m").alias("id"), model.alias("model"), F.when(F.col("n") % 4 == 0, "end_turn").otherwise("tool_use").alias("stop_reason"), F.array(F.struct(F.lit("tool_use").alias("type"), name("t").alias("id"), F.lit("Bash").alias("name"), command.alias("input"))).alias("content"), usage(F.col("n")).alias("usage")).alias("message"))
    failed = F.col("n") % 5 == 3
    told = F.when(failed & (F.col("n") % 2 == 0), F.concat(F.lit("Permission to use Bash "), F.col("text"))).otherwise(F.col("text"))
    result = F.struct(F.lit("user").alias("type"), stamp(2).alias("timestamp"), session.alias("sessionId"), F.struct(F.array(F.struct(F.lit("tool_result").alias("type"), name("t").alias("tool_use_id"), failed.alias("is_error"), told.alias("content"))).alias("content")).alias("message"), F.struct(F.concat(F.col("text"), F.lit("+")).alias("stdout")).alias("toolUseResult"))
    title = F.struct(F.lit("ai-title").alias("type"), session.alias("sessionId"), F.concat(F.left("text", F.lit(20)), F.lit("\n x")).alias("aiTitle"))
    compact = F.struct(F.lit("system").alias("type"), F.lit("compact_boundary").alias("subtype"), name("u").alias("uuid"), stamp(0).alias("timestamp"), session.alias("sessionId"), F.struct(F.when(F.col("n") % 2 == 0, "auto").otherwise("Not a label!").alias("trigger"), (F.col("n") + 0.5).alias("preTokens"), (F.col("n") / 4).alias("postTokens")).alias("compactMetadata"))
    took = F.struct(F.lit("system").alias("type"), F.lit("turn_duration").alias("subtype"), session.alias("sessionId"), stamp(3).alias("timestamp"), (F.col("n") * 7.5).alias("durationMs"), F.col("turn").cast("double").alias("messageCount"))
    hooks = F.struct(F.lit("system").alias("type"), F.lit("stop_hook_summary").alias("subtype"), name("h").alias("uuid"), session.alias("sessionId"), stamp(3).alias("timestamp"), F.array(F.struct(F.lit("bash /opt/hooks/lint.sh --fast").alias("command"), F.col("n").cast("double").alias("durationMs")), F.struct(F.lit("$X && y").alias("command"), F.lit(None).cast("double").alias("durationMs"))).alias("hookInfos"))
    cost = F.struct(F.lit("cost-state").alias("type"), session.alias("sessionId"), (F.col("n") / 64).alias("totalCostUSD"), (F.col("n") * 10.0).alias("totalDuration"), F.create_map(model, F.struct((F.col("n") / 128).alias("costUSD"))).alias("modelUsage"))
    line = lambda k, s: F.struct(F.lit(k).alias("k"), F.to_json(s).alias("raw"))
    at_start = F.when(F.col("turn") == 0, line(6, title))
    of = F.when(F.col("role") == "assistant", F.array(line(0, said), line(1, call), line(2, result), line(3, took), line(4, hooks), line(5, cost), at_start)).when(F.col("role") == "system", F.array(line(0, compact), at_start)).otherwise(F.array(line(0, user), at_start))
    path = F.concat(F.lit("/h/projects/proj/"), session, F.lit(".jsonl"))
    rows = c.select(path.alias("path"), F.col("turn"), F.explode(F.array_compact(of)).alias("l"))
    return rows.select("path", (F.col("turn") * 10 + F.col("l.k")).cast("int").alias("line_no"), F.col("l.raw").alias("raw"))


def payload_rows(S: StandIns) -> DataFrame:
    """(received_ms, payload): lifecycle and tool payloads of the stand-in events and calls; some are delivered twice."""
    e = S.hook_events.withColumn("ms", F.col("ts"))
    common = [F.col("session_id"), F.col("agent_id"), F.col("prompt_id"), F.concat(F.lit("/home/"), F.col("session_id")).alias("cwd"), F.col("permission_mode")]
    life = F.to_json(F.struct(F.col("event").alias("hook_event_name"), *common, F.col("source"), F.col("reason"), F.col("trigger"), F.col("error_type").alias("error"), F.when(F.col("prompt_bytes").isNotNull(), F.repeat(F.lit("x"), F.col("prompt_bytes").cast("int"))).alias("prompt"), F.concat("event_id", F.lit("!")).alias("nonce")))
    twice = F.explode(F.when(F.col("ms") % 3 == 0, F.array(F.lit(0), F.lit(400), F.lit(1400))).otherwise(F.array(F.lit(0))))
    return e.select(life.alias("payload"), "ms", twice.alias("d")).select((F.col("ms") + F.col("d")).alias("received_ms"), "payload")


def call_payloads(S: StandIns) -> DataFrame:
    c = S.calls.where("ts is not null and failed is not null")
    name = F.when(F.col("failed") == 1, "PostToolUseFailure").otherwise("PostToolUse")
    shown = F.struct(F.col("file_path"), F.when(F.col("tool") == "Read", F.col("read_start") - 5).alias("offset"), F.col("read_lines").alias("limit"), F.when(F.col("tool") == "Bash", "git commit -m x").alias("command"))
    patch = F.array(F.struct(F.array(F.lit("+a"), F.lit("-b"), F.lit(" c"), F.lit("+d")).alias("lines")))
    answer = F.struct(F.when(F.col("tool") == "Bash", F.concat(F.lit("[main "), F.substring(F.sha2("tool_use_id", 256), 1, 8), F.lit("] x"))).alias("stdout"), F.when(F.col("tool") == "Edit", patch).alias("structuredPatch"), F.when(F.col("tool") == "Edit", F.repeat(F.lit("z"), (F.col("duration_ms") % 50).cast("int"))).alias("originalFile"), F.when(F.col("tool") == "Write", "create").alias("type"), F.when(F.col("tool") == "Write", "l1\nl2\n").alias("content"))
    body = F.struct(name.alias("hook_event_name"), "session_id", "agent_id", "prompt_id", "cwd", F.col("tool").alias("tool_name"), "tool_use_id", shown.alias("tool_input"), answer.alias("tool_response"), F.col("duration_ms").cast("double").alias("duration_ms"), F.when(F.col("failed") == 1, F.col("error")).alias("error"))
    return c.select((F.col("ts") + F.coalesce("duration_ms", F.lit(0))).alias("received_ms"), F.to_json(body).alias("payload"))


def ledger_lines(S: StandIns) -> DataFrame:
    """(path, line_no, raw): ledger files by session: a line for most requests, a second one of a lower rank for some, and side calls."""
    k = F.regexp_extract("request_id", r"(\d+)", 1).cast("bigint")
    r = S.requests.withColumn("k", k)
    body = lambda join, cost, api: F.to_json(F.struct(api.alias("request_id"), "session_id", F.lit("2024-01-01T00:00:00Z").alias("ts"), "model", "input_tokens", "output_tokens", cost.alias("cost_usd_micros"), F.lit("agent:x").alias("query_source"), F.lit(join).alias("join")))
    lines = F.array_compact(F.array(F.when(F.col("k") % 4 != 0, body("log", F.col("k") % 900, F.col("api_request_id"))), F.when(F.col("k") % 8 == 1, body("log+span", F.col("k") % 700, F.col("api_request_id"))), F.when(F.col("k") % 16 == 1, body("log+span", F.lit(-1), F.col("api_request_id"))), F.when(F.col("k") % 10 == 0, body("span", F.col("k") % 50, F.concat(F.lit("side_"), "request_id"))), F.when(F.col("k") % 50 == 7, F.lit('{"torn": '))))
    rows = r.select("session_id", "k", F.posexplode(lines).alias("n", "raw"))
    return rows.select(F.concat(F.lit("/ledger/"), "session_id", F.lit(".jsonl")).alias("path"), (F.col("k") * 8 + F.col("n")).cast("bigint").alias("line_no"), "raw")


def message_ledger(S: StandIns) -> DataFrame:
    """(path, line_no, raw): ledger files for the messages of transcripts(): a line for most, a second one of a higher rank for some, side calls, and lines that are torn."""
    c = S.table("conversations").where("role = 'assistant'").withColumn("n", F.length("text"))
    tag, session = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")), F.concat(F.lit("s"), F.col("conv_id").cast("string"))
    body = lambda join, cost, api: F.to_json(F.struct(F.concat(F.lit(api), tag).alias("request_id"), F.lit("2024-01-01T00:00:00Z").alias("ts"), cost.alias("cost_usd_micros"), F.lit(join).alias("join")))
    n = F.col("n")
    lines = F.array_compact(F.array(F.when(n % 4 != 0, body("log", n % 900, "req")), F.when(n % 8 == 1, body("log+span", n % 700, "req")), F.when(n % 10 == 0, body("span", n % 50, "side_")), F.when(n % 50 == 7, F.lit('{"torn": '))))
    return c.select(F.concat(F.lit("/ledger/"), session, F.lit(".jsonl")).alias("path"), "turn", F.posexplode(lines).alias("k", "raw")).select("path", (F.col("turn") * 10 + F.col("k")).cast("bigint").alias("line_no"), "raw")
