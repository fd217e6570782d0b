"""Order-free merges and derivations (M01-M12, M18-M28). A result depends on the set of its input rows, never on their order."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.schema import KEYS, not_ledger

SECOND = 1_000
HOUR = 3_600_000


def merge(target: DataFrame, contributions: DataFrame, key: Sequence[str], modes: Mapping[str, str], order: str = "ts") -> DataFrame:
    """Keyed upsert. Each column of `modes` is merged by mode over the target's rows and the contributions:

    overwrite: the known value of the latest contribution; fill: the target's, else the earliest known one; min and max. Ties in order go
    to the smaller value. Columns missing on a side are null there.
    """
    wanted = [*key, *modes]
    both = target.withColumn("_new", F.lit(0)).unionByName(contributions.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    at = F.coalesce(F.col(order).cast("bigint"), F.lit(0))

    def merged(name: str, mode: str) -> Column:
        c, known = F.col(name), F.col(name).isNotNull()
        if mode in ("min", "max"):
            return getattr(F, mode)(c).alias(name)
        if mode == "overwrite":
            top = F.max(F.when(known, F.struct(F.col("_new").alias("n"), at.alias("at"), c.alias("v"))))
            return top["v"].alias(name)
        return F.min(F.when(known, F.struct(F.col("_new").alias("n"), at.alias("at"), c.alias("v"))))["v"].alias(name)

    return both.groupBy(*key).agg(*(merged(n, m) for n, m in modes.items())).select(*wanted)


def claim_occurrences(payloads: DataFrame) -> DataFrame:
    """Adds event_id and ts: deliveries of one payload within a second of an occurrence's first one are that occurrence, and ts is that of the first.

    The first occurrence of a hash has the hash as its id, later ones hash:ts. Occurrences are taken greedily from the earliest delivery, so any order of arrival gives the same ids. The distinct times of a
    hash are read in order and only the last occurrence is held, so a hash may have any number of deliveries; they are joined on hash and time, so they are not dealt by the hash alone.
    """
    times = payloads.select("hash", "received_ms").where("hash is not null and received_ms is not null").distinct()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, anchor, first = None, 0, True
        for batch in batches:
            anchors, firsts = [], []
            for h, t in zip(*(batch.column(c).to_pylist() for c in ("hash", "received_ms")), strict=True):
                if h != last:
                    last, anchor, first = h, t, True
                elif t - anchor > SECOND:
                    anchor, first = t, False
                anchors.append(anchor)
                firsts.append(first)
            yield pa.RecordBatch.from_arrays([batch.column("hash"), batch.column("received_ms"), pa.array(anchors, pa.int64()), pa.array(firsts, pa.bool_())], ["hash", "received_ms", "_ts", "_first"])

    folded = times.repartition("hash").sortWithinPartitions("hash", "received_ms").mapInArrow(fold, "hash string, received_ms bigint, _ts bigint, _first boolean")
    return payloads.join(folded, ["hash", "received_ms"]).select(*payloads.columns, F.when(F.col("_first"), F.col("hash")).otherwise(F.concat_ws(":", "hash", "_ts")).alias("event_id"), F.col("_ts").alias("ts"))


def insert_earliest(rows: DataFrame, key: str = "event_id") -> DataFrame:
    """Of rows with one id, that of the earliest delivery, ties to the smaller row."""
    others = [c for c in rows.columns if c not in (key, "ts")]
    return rows.groupBy(key).agg(F.min(F.struct("ts", *others)).alias("r")).select(key, "r.ts", *(f"r.{c}" for c in others)).select(rows.columns)


def touch_sessions(seen: DataFrame, own: Sequence[str] = ("cwd", "host", "tz_name", "engine")) -> DataFrame:
    """Sessions of rows (session_id, ts, own columns, transcript_path): own columns from the earliest run that carried one, ties to the
    smaller value; transcript_path from the latest, ties to the larger; each with the time of the run that gave it."""
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("ts", c)))
    own = [c for c in own if c in seen.columns]
    aggs = [F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), *(first(c).alias(f"_{c}") for c in own)]
    if "transcript_path" in seen.columns:
        aggs.append(F.max(F.when(F.col("transcript_path").isNotNull(), F.struct("ts", "transcript_path"))).alias("_transcript_path"))
        own = [*own, "transcript_path"]
    g = seen.groupBy("session_id").agg(*aggs)
    return g.select("session_id", "first_ts", "last_ts", *(x for c in own for x in (F.col(f"_{c}.{c}").alias(c), F.col(f"_{c}.ts").alias(f"{c}_ts"))))


def refresh_sessions(sessions: DataFrame, events: DataFrame, requests: DataFrame) -> DataFrame:
    """start_source of the earliest start, end_reason of the latest end, model of the latest main-chat request that has one, else of the latest start that has one."""
    model_of_start = F.max(F.when((F.col("event") == "SessionStart") & F.col("model").isNotNull(), F.struct("ts", "event_id", "model"))) if "model" in events.columns else F.lit(None).cast("struct<model:string>")
    e = events.groupBy("session_id").agg(
        F.min(F.when(F.col("event") == "SessionStart", F.struct("ts", "event_id", "source"))).alias("s"), F.max(F.when(F.col("event") == "SessionEnd", F.struct("ts", "event_id", "reason"))).alias("e"), model_of_start.alias("m"))
    r = requests.where(F.col("agent_id").isNull() & not_ledger() & F.col("model").isNotNull()).groupBy("session_id").agg(F.max(F.struct("ts", "request_id", "model")).alias("r"))
    kept = sessions.drop("start_source", "end_reason", "model")
    joined = kept.join(e, "session_id", "left").join(r, "session_id", "left")
    return joined.select(*kept.columns, F.col("s.source").alias("start_source"), F.col("e.reason").alias("end_reason"), F.coalesce("r.model", "m.model").alias("model"))


def agent_turns(events: DataFrame) -> DataFrame:
    """An agent's starts and stops by time and id: a stop closes the start right before it, else is a turn without start; a start that no stop follows stays open."""
    e = events.where("event in ('SubagentStart', 'SubagentStop') and agent_id is not null")
    order = Window.partitionBy("agent_id").orderBy("ts", "event_id")
    e = e.select("agent_id", "session_id", "prompt_id", "event_id", "event", "ts", F.lag("event").over(order).alias("before"), F.lead(F.struct("event", "event_id", "ts", "session_id", "prompt_id")).over(order).alias("next"))
    is_start, closed = F.col("event") == "SubagentStart", F.col("next.event").eqNullSafe("SubagentStop")
    heads = e.where(is_start | ~F.col("before").eqNullSafe("SubagentStart"))
    fill = lambda c: F.when(is_start & closed, F.coalesce(c, f"next.{c}")).otherwise(F.col(c))
    return heads.select(
        "agent_id", F.row_number().over(order).alias("seq"), fill("session_id").alias("session_id"), fill("prompt_id").alias("prompt_id"), F.when(is_start, F.col("ts")).alias("started"),
        F.when(is_start, F.when(closed, F.col("next.ts"))).otherwise(F.col("ts")).alias("stopped"), F.when(is_start, F.col("event_id")).alias("start_event_id"), F.when(is_start, F.when(closed, F.col("next.event_id"))).otherwise(F.col("event_id")).alias("stop_event_id"),
    )


def resolve_pending(requests: DataFrame, calls: DataFrame, uses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A provisional request becomes the message that holds one of its calls: calls are re-pointed, its values fill, the earlier time stays."""
    provisional = F.coalesce(F.col("request_id").startswith("pending:"), F.lit(False))
    known = uses.groupBy("tool_use_id").agg(F.min("request_id").alias("found"))
    pending = calls.where(provisional).join(known, "tool_use_id", "left")
    found = pending.where("found is not null").groupBy("request_id").agg(F.min("found").alias("found"))
    # calls of known requests are not shuffled
    moved = pending.withColumn("request_id", F.coalesce(F.min("found").over(Window.partitionBy("request_id")), "request_id")).select(calls.columns)
    moved = calls.where(~provisional).unionByName(moved)
    named = requests.join(found, "request_id", "left").withColumn("_was", F.col("found").isNotNull()).withColumn("request_id", F.coalesce("found", "request_id")).drop("found")
    others = [c for c in requests.columns if c not in ("request_id", "ts", "pending")]
    stored = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(F.col("_was").cast("int").alias("w"), F.col("ts").alias("t"), F.col(c).alias("v"))))["v"].alias(c)
    merged = named.groupBy("request_id").agg(F.min("ts").alias("ts"), F.max(F.when(~F.col("_was"), F.col("pending"))).alias("_p"), *(stored(c) for c in others))
    return merged.withColumn("pending", F.coalesce("_p", F.lit(0))).select(requests.columns), moved


TOKENS = ("input_tokens", "cache_read_tokens", "cache_creation_tokens", "cache_creation_5m_tokens", "cache_creation_1h_tokens", "context_tokens", "output_tokens", "thinking_tokens")


def settle(requests: DataFrame, read: DataFrame, sessions: DataFrame, overwrite: bool = True) -> DataFrame:
    """Requests with what transcripts hold of them: usage overwrites (settle) or fills (recover), the rest fills.

    A new request older than its session's first run is left out; a row that another session or agent owns is never written.
    """
    from tracewell.schema import conform

    stored = conform(requests, "requests")
    new = conform(read, "requests").join(sessions.select("session_id", "first_ts"), "session_id", "left")
    new = new.select("request_id", F.struct(*[c for c in stored.columns if c != "request_id"], "first_ts").alias("n"))
    j = stored.select("request_id", F.struct(*[c for c in stored.columns if c != "request_id"]).alias("o")).join(new, "request_id", "full_outer")
    alien = F.col("o").isNotNull() & F.col("n").isNotNull() & ((F.col("o.session_id") != F.col("n.session_id")) | (F.col("o.agent_id").isNotNull() & ~F.col("o.agent_id").eqNullSafe(F.coalesce("n.agent_id", "o.agent_id"))))
    j = j.where(F.col("o").isNotNull() | F.col("n.ts").isNull() | F.col("n.first_ts").isNull() | (F.col("n.ts") >= F.col("n.first_ts")))

    def column(c: str) -> Column:
        o, n = F.col(f"o.{c}"), F.when(~F.coalesce(alien, F.lit(False)), F.col(f"n.{c}"))
        if c == "pending":
            return F.when(n.isNotNull() | (F.col("n").isNotNull() & ~F.coalesce(alien, F.lit(False))), 0).otherwise(o)
        return F.coalesce(n, o) if overwrite and c in (*TOKENS, "stop_reason", "model") else F.coalesce(o, n)

    return j.select("request_id", *(column(c).alias(c) for c in stored.columns if c != "request_id")).select(stored.columns)


def recount(requests: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls of each request."""
    n = calls.where("request_id is not null").groupBy("request_id").agg(F.count("*").alias("calls"))
    return requests.drop("calls").join(n, "request_id", "left").withColumn("calls", F.coalesce("calls", F.lit(0)))


def merge_session_costs(*snapshots: DataFrame) -> DataFrame:
    """The snapshot with the largest wall time, an unknown one counting as latest; ts keeps the maximum."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), snapshots)
    others = [c for c in both.columns if c not in ("session_id", "ts", "model_costs")]
    kept = [*others, "model_costs"] if "model_costs" in both.columns else others
    order = F.struct(F.coalesce("wall_ms", F.lit((1 << 62))), F.coalesce("ts", F.lit(0)))
    g = both.groupBy("session_id").agg(F.max("ts").alias("ts"), F.max_by(F.struct(*kept), order).alias("r"))
    return g.select("session_id", "ts", *(f"r.{c}" for c in kept))


def best_ledger(ledger: DataFrame) -> DataFrame:
    """Of each request the line of the best rank; among equals a whole one, then the latest."""
    g = ledger.groupBy("request_id").agg(F.max_by(F.struct(*[c for c in ledger.columns if c != "request_id"]), F.struct("rank", (~F.col("partial")).cast("int"), "line_no")).alias("r"))
    return g.select("request_id", "r.*").select(ledger.columns)


def join_ledger(requests: DataFrame, ledger: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with ledger prices, and a summary (kind, count).

    A request known by its API id takes price and purpose. One that a transcript holds (held: request_id, api_request_id) gets the API
    id and the same. Any other ledger row becomes a side call, unless the transcripts hold it and no request is recorded.
    """
    best = best_ledger(ledger).withColumnsRenamed({"request_id": "api", "session_id": "l_session", "ts": "l_ts", "agent_id": "l_agent", "model": "l_model", "query_source": "l_query"})
    own = requests.where(not_ledger()).join(held.select("request_id", F.col("api_request_id").alias("h_api")), "request_id", "left").withColumn("api_request_id", F.coalesce("api_request_id", "h_api")).drop("h_api")
    priced = own.join(best, own["api_request_id"] == best["api"], "left")
    cost = F.coalesce("cost", "cost_usd_micros")
    over = priced.withColumns({"cost_source": F.when(F.col("cost").isNotNull(), "ledger").otherwise(F.col("cost_source")), "query_source": F.coalesce("l_query", "query_source")}).withColumn("cost_usd_micros", cost).select(requests.columns)
    taken = own.where("api_request_id is not null").select(F.col("api_request_id").alias("api"))
    rest = best.join(taken, "api", "left_anti")
    unrecorded = rest.join(held.select(F.col("api_request_id").alias("api")), "api", "left_semi")
    side = rest.join(held.select(F.col("api_request_id").alias("api")), "api", "left_anti")
    values = {"request_id": F.col("api"), "api_request_id": F.col("api"), "session_id": F.col("l_session"), "agent_id": F.col("l_agent"), "ts": F.col("l_ts"), "model": F.col("l_model"), "query_source": F.col("l_query"), "input_tokens": F.col("input"), "output_tokens": F.col("output"), "cache_read_tokens": F.col("cache_read"), "cache_creation_tokens": F.col("cache_creation"), "cost_usd_micros": F.col("cost"), "cost_source": F.when(F.col("cost").isNotNull(), "ledger"), "source": F.lit("ledger"), "pending": F.lit(0)}
    types = dict(requests.dtypes)
    sides = side.select(*(values.get(c, F.lit(None)).cast(types[c]).alias(c) for c in requests.columns))
    summary = side.agg(F.lit("side calls").alias("kind"), F.count("*").alias("count")).unionByName(unrecorded.agg(F.lit("held but unrecorded").alias("kind"), F.count("*").alias("count"))).unionByName(priced.where("cost is not null").agg(F.lit("priced").alias("kind"), F.count("*").alias("count")))
    return over.unionByName(sides), summary


def recoverable_sessions(sessions: DataFrame, calls: DataFrame, requests: DataFrame, turns: DataFrame, events: DataFrame, cutoff: int) -> DataFrame:
    """M18 (session_id, reason): quiet sessions (no row since the cutoff) with something that a transcript may settle."""
    quiet = sessions.where(F.col("last_ts") < cutoff).select("session_id", "last_ts", "end_reason")
    says = lambda df, reason: df.select("session_id").distinct().join(quiet, "session_id", "left_semi").select("session_id", F.lit(reason).alias("reason"))
    prompt = events.where("event = 'UserPromptSubmit'").groupBy("session_id").agg(F.max("ts").alias("p"))
    end = events.where("event in ('Stop', 'StopFailure')").groupBy("session_id").agg(F.max("ts").alias("e"))
    open_turn = prompt.join(end, "session_id", "left").where("e is null or e < p")
    return (
        says(calls.where("failed is null or bytes_delivered is null"), "open call").unionByName(says(requests.where("pending = 1"), "pending request"))
        .unionByName(says(turns.where("started is null or stopped is null"), "open agent turn")).unionByName(says(open_turn, "missing turn end"))
        .unionByName(says(quiet.where("end_reason is null or end_reason in ('never', 'lost')"), "missing or lost session end"))
    )


def rebuild_calls(uses: DataFrame, results: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls that transcripts show and no row holds, with their results."""
    new = uses.join(calls.select("tool_use_id"), "tool_use_id", "left_anti").join(results, "tool_use_id", "left")
    return new.select("tool_use_id", "session_id", "request_id", "prompt_id", "ts", "tool", "input", "cwd", "failed", "outcome", F.col("bytes").alias("bytes_delivered"), F.col("real").alias("bytes_real"), F.lit("transcript").alias("source"))


#: What the detail of a rebuilt turn end says.
REBUILT = '{"rebuilt":true}'


def latest_prompts(events: DataFrame) -> DataFrame:
    """(session_id, p): the latest prompt (ts, event_id, prompt_id) of each main chat."""
    main = events.where("event = 'UserPromptSubmit' and coalesce(agent_id, '') = ''")
    return main.groupBy("session_id").agg(F.max(F.struct("ts", "event_id", "prompt_id")).alias("p"))


def open_prompts(events: DataFrame) -> DataFrame:
    """(session_id, p): latest prompts that no Stop or StopFailure of the main chat answers, at or after them and of the same prompt id, if both have one."""
    prompts = latest_prompts(events)
    ends = events.where("event in ('Stop', 'StopFailure') and coalesce(agent_id, '') = ''").select("session_id", F.col("ts").alias("end_ts"), F.col("prompt_id").alias("end_prompt"))
    answers = (F.col("end_ts") >= F.col("p.ts")) & (F.col("end_prompt").isNull() | F.col("p.prompt_id").isNull() | (F.col("end_prompt") == F.col("p.prompt_id")))
    return prompts.join(prompts.join(ends, "session_id").where(answers).select("session_id").distinct(), "session_id", "left_anti")


def rebuild_turn_ends(events: DataFrame, ends: DataFrame) -> DataFrame:
    """An end for each session whose latest main-chat prompt has none, as its transcript ends (E21), not before the prompt. A Stop that the transcript has before the prompt is an earlier turn's."""
    rows = open_prompts(events).join(ends.select("session_id", "event", "error_type", F.col("ts").alias("end_ts")), "session_id").where("event <> 'Stop' or end_ts is null or end_ts >= p.ts")
    key = F.sha2(F.concat_ws("\0", F.lit("rebuilt"), "event", "session_id", F.col("p.ts").cast("string")), 256)
    return rows.select(key.alias("event_id"), "event", "session_id", F.col("p.prompt_id").alias("prompt_id"), F.greatest("end_ts", "p.ts").alias("ts"), "error_type", F.lit(REBUILT).alias("detail"))


def drop_rebuilt(events: DataFrame) -> DataFrame:
    """Events without the rebuilt turn ends that a real Stop or StopFailure of the main chat replaces.

    It replaces one whose prompt, the latest at or before it, is not later than the real end, and of the same prompt id, if both have one.
    """
    rebuilt = F.coalesce(F.col("detail") == REBUILT, F.lit(False)) & F.col("event").isin("Stop", "StopFailure")
    main = events.where(F.col("event").isin("Stop", "StopFailure", "UserPromptSubmit") & (F.coalesce("agent_id", F.lit("")) == "")).select("event_id", "event", "session_id", "prompt_id", "ts", rebuilt.alias("rebuilt"))
    main = main.join(main.where("rebuilt").select("session_id").distinct(), "session_id", "left_semi")
    asks = F.col("event") == "UserPromptSubmit"
    before = Window.partitionBy("session_id").orderBy("ts", (~asks).cast("int")).rowsBetween(Window.unboundedPreceding, 0)
    asked = main.withColumn("asked", F.coalesce(F.max(F.when(asks, F.col("ts"))).over(before), F.lit(0))).where("event <> 'UserPromptSubmit'")
    real = asked.where("not rebuilt").groupBy("session_id", F.col("prompt_id").alias("real_prompt")).agg(F.max("ts").alias("real_ts"))
    same_prompt = F.coalesce(F.col("real_prompt") == F.col("prompt_id"), F.lit(True))
    gone = asked.where("rebuilt").join(real, "session_id").where(same_prompt & (F.col("real_ts") >= F.col("asked")))
    return events.join(gone.select("event_id").distinct(), "event_id", "left_anti").select(events.columns)


def rebuild_agent_stops(turns: DataFrame, ends: DataFrame, notices: DataFrame) -> DataFrame:
    """M21 (agent_id, seq, stopped): the open latest turn of an agent gets its transcript's earliest end since its start, else the earliest notice."""
    latest = turns.withColumn("n", F.row_number().over(Window.partitionBy("agent_id").orderBy(F.desc("seq")))).where("n = 1 and stopped is null and started is not null").select("agent_id", "seq", "started")
    after = lambda df, name: latest.join(df.select("agent_id", "ts"), "agent_id").where("ts >= started").groupBy("agent_id").agg(F.min("ts").alias(name))
    found = latest.join(after(ends, "a"), "agent_id", "left").join(after(notices, "b"), "agent_id", "left")
    return found.select("agent_id", "seq", F.coalesce("a", "b").alias("stopped")).where("stopped is not null")


def end_reasons(sessions: DataFrame, events: DataFrame, faults: DataFrame) -> DataFrame:
    """M22 (session_id, end_reason): lost where a fault since the latest start names a SessionEnd of the session, never where there is no end and no such trace."""
    e = events.groupBy("session_id").agg(F.max(F.when(F.col("event") == "SessionStart", F.col("ts"))).alias("start"), F.max(F.when(F.col("event") == "SessionEnd", F.struct("ts", "reason"))).alias("end"))
    lost = faults.where(F.col("error").contains("SessionEnd") & F.col("session_id").isNotNull()).groupBy("session_id").agg(F.max("ts").alias("lost"))
    j = sessions.select("session_id").join(e, "session_id", "left").join(lost, "session_id", "left")
    ended = F.col("end.ts") >= F.coalesce("start", F.lit(0))
    traced = F.floor(F.col("lost") / SECOND) >= F.floor(F.coalesce("start", F.lit(0)) / SECOND)
    return j.select("session_id", F.when(ended, F.col("end.reason")).when(traced, "lost").when(F.col("start").isNotNull(), "never").alias("end_reason"))


#: What the faults of things that a full reading left open say after their ids (fixed values).
UNFILLED = {
    "agent turn": "no request in its span, and its quiet transcript holds none at or after the session's first hook", "stop reply": "no final reply request, and its quiet main transcript holds none at or after the session's first hook",
    "turn end": "no Stop or StopFailure, and its quiet main transcript shows no turn end after it", "call": "no size or no request, and no quiet transcript of the session holds its result or, at or after the session's first hook, its request",
    "agent stop": "no SubagentStop, and its quiet transcript shows no turn end at or after the turn's start",
}


def unfilled(events: DataFrame, agent_turns_: DataFrame, calls: DataFrame, requests: DataFrame) -> DataFrame:
    """M23 (session_id, tool_use_id, ts, kind, error, once): each thing that is open: agent turns and stops of the main chat without their request, latest prompts
    without an end, calls without size or request, latest agent turns without a stop. once: a later row of the session does not open it again."""
    none, text = F.lit(None).cast("string"), lambda kind, *ids: F.concat(*ids, F.lit(f": {UNFILLED[kind]}"))
    row = lambda kind, once, ts, error, tool=none: ["session_id", tool.alias("tool_use_id"), ts.alias("ts"), F.lit(kind).alias("kind"), error.alias("error"), F.lit(once).alias("once")]
    own = requests.where("agent_id is not null").select("agent_id", F.col("ts").alias("r_ts"))
    stopped = agent_turns_.where("stopped is not null")
    filled = stopped.join(own, "agent_id").where(F.col("r_ts").between(F.coalesce("started", "stopped"), F.col("stopped"))).select("agent_id", "seq").distinct()
    turn = stopped.join(filled, ["agent_id", "seq"], "left_anti").select(*row("agent turn", True, F.col("stopped"), text("agent turn", F.lit("agent "), "agent_id", F.lit(" turn stopped "), F.col("stopped").cast("string"))))
    stops = events.where("event = 'Stop' and coalesce(agent_id, '') = '' and prompt_id is not null")
    replies = requests.where("agent_id is null and stop_reason = 'end_turn' and prompt_id is not null").select("session_id", "prompt_id").distinct()
    reply = stops.join(replies, ["session_id", "prompt_id"], "left_anti").select(*row("stop reply", True, F.col("ts"), text("stop reply", F.lit("prompt "), "prompt_id", F.lit(" Stop "), "event_id")))
    end = open_prompts(events).select(*row("turn end", False, F.col("p.ts"), text("turn end", F.lit("prompt "), F.coalesce("p.prompt_id", F.lit("-")), F.lit(" UserPromptSubmit "), "p.event_id")))
    open_call = calls.where("(bytes_real is null and bytes_delivered is null) or request_id is null")
    call = open_call.select(*row("call", False, F.coalesce("ts", F.lit(0)), text("call", F.lit("call "), "tool_use_id"), F.col("tool_use_id")))
    latest = agent_turns_.groupBy("agent_id").agg(F.max_by(F.struct("session_id", "seq", "started", "stopped"), "seq").alias("t")).select("agent_id", "t.*").where("stopped is null")
    stop = latest.select(*row("agent stop", False, F.coalesce("started", F.lit(0)), text("agent stop", F.lit("agent "), "agent_id", F.lit(" turn "), F.col("seq").cast("string"), F.lit(" open"))))
    return reduce(lambda x, y: x.unionByName(y), (turn, reply, end, call, stop))


def mark_unfillable(open_: DataFrame, faults: DataFrame, sessions: DataFrame) -> DataFrame:
    """A fault for each open thing (see unfilled()) of sessions that were read in full, at the session's last row, or at its own time where it is marked once. One that
    is marked already is marked again only if its session has a later row."""
    marked = faults.where("stage = 'transcript' and session_id is not null").groupBy("session_id", "error").agg(F.max("ts").alias("marked"))
    j = open_.join(sessions.select("session_id", "last_ts"), "session_id").join(marked, ["session_id", "error"], "left")
    new = j.where(F.col("marked").isNull() | (~F.col("once") & (F.col("marked") < F.coalesce("last_ts", F.lit(0)))))
    ts = F.when(F.col("once"), F.col("ts")).otherwise(F.coalesce("last_ts", "ts"))
    return new.select(F.sha2(F.concat_ws("\0", "session_id", "error", ts.cast("string")), 256).alias("fault_id"), ts.alias("ts"), "session_id", "tool_use_id", F.lit("transcript").alias("stage"), "error")


def insert_lost_faults(faults: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of `new` beyond identical stored ones, as multisets: reading a log again adds nothing."""
    columns = ["ts", "stage", "session_id", "error"]
    return new.select(columns).exceptAll(faults.select(columns))


def retention_of_parts(parts: DataFrame, archived: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """M25 for dependants (command_parts, request_iterations): they go with their parent."""
    return parts.join(archived.select(key), key, "left_anti"), parts.join(archived.select(key), key, "left_semi")


#: Tables whose archived rows give way to newer ones; of others the first copy stays.
AGGREGATES = ("calls", "requests", "request_iterations", "agents", "sessions", "session_costs")
PARENTS = {"request_iterations": ("requests", "request_id"), "command_parts": ("calls", "tool_use_id")}


def aged(tables: Mapping[str, DataFrame], name: str, cutoff: int) -> DataFrame:
    """A table with `_old`, whether a row has aged out. A call without a time ages by its request, an agent and its turns by their stop, else their start, a session by its last row;
    dependants go with their parent, or if it is gone. A row without any time stays."""
    table = tables[name]
    if name in PARENTS:
        parent, key = PARENTS[name]
        young = aged(tables, parent, cutoff).where("not _old").select(key).distinct().withColumn("_old", F.lit(False))
        return table.join(young, key, "left").select(*table.columns, F.col("_old").isNull().alias("_old"))
    if name == "calls":
        gone = tables["requests"].where(F.col("ts") < cutoff).select("request_id").distinct().withColumn("_old", F.lit(True))
        untimed = table.where("ts is null").join(gone, "request_id", "left").select(*table.columns, F.col("_old").isNotNull().alias("_old"))
        return table.where("ts is not null").withColumn("_old", F.col("ts") < cutoff).unionByName(untimed)
    age = {"agents": F.coalesce("stopped", "started"), "agent_turns": F.coalesce("stopped", "started"), "sessions": F.col("last_ts")}
    return table.withColumn("_old", F.coalesce(age.get(name, F.col("ts")) < cutoff, F.lit(False)))


def beside(tables: Mapping[str, DataFrame], name: str, archive: DataFrame, cutoff: int) -> DataFrame:
    """M25 of a table of facts that has an archive; see place(). Its rows, the parents that stay and the archive's rows meet in one shuffle, by the parent's key where there is one. Equal is equal in each column that the archive has."""
    table, key = tables[name], KEYS[name]
    sided = lambda df, side: df.withColumn("_side", F.lit(side))
    both = lambda a, b: a.unionByName(b, allowMissingColumns=True)
    if name in PARENTS:
        parent, by = PARENTS[name]
        young = aged(tables, parent, cutoff).where(~F.col("_old") & F.col(by).isNotNull()).select(by)
        met = reduce(both, (sided(table, "table"), sided(young, "parent"), sided(archive, "archive")))
        # a parent has nothing in the rest of the key, so it comes first; the rows are in order of their keys then, and are sorted once
        first = Window.partitionBy(by).orderBy(*(k for k in key if k != by))
        met = met.withColumn("_old", ~F.max(F.col("_side") == "parent").over(first)).where("_side <> 'parent'")
    else:
        rows = aged(tables, name, cutoff)
        met = both(sided(rows.where("_old"), "table"), sided(archive, "archive"))
    filed, whole = F.col("_side") == "archive", F.to_json(F.struct(*(c for c in table.columns if c in archive.columns)))
    copies = F.when(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in key)), F.collect_set(F.when(filed, whole)).over(Window.partitionBy(*key))).otherwise(F.array())
    differs = (F.size("_copies") > 0) & ~F.array_contains("_copies", whole)
    where = F.when(filed, "archive").when(~F.col("_old") | differs, "kept").when(F.size("_copies") == 0, "archive")
    found = met.withColumn("_copies", copies).withColumn("place", where).where("place is not null").drop("_side", "_old", "_copies")
    return found if name in PARENTS else both(rows.where("not _old").drop("_old").withColumn("place", F.lit("kept")), found)


def place(tables: Mapping[str, DataFrame], archives: Mapping[str, DataFrame], cutoff: int) -> dict[str, DataFrame]:
    """M25 of whole tables by name (schema.KEYS): each and its archive as one frame, whose `place` is kept or archive. What aged out is archived first, and leaves its table only where the archive has an identical row.

    Archived aggregates are replaced; of facts, the first copy stays, so a row that differs from it stays in the table.
    """
    placed = {}
    for name, table in tables.items():
        archive, key = archives.get(name), KEYS[name]
        if archive is not None and name not in AGGREGATES:
            placed[name] = beside(tables, name, archive, cutoff)
            continue
        placed[name] = aged(tables, name, cutoff).select(*table.columns, F.when(F.col("_old"), "archive").otherwise("kept").alias("place"))
        if archive is not None:
            new = placed[name].where("place = 'archive'").select(*key)
            placed[name] = placed[name].unionByName(archive.join(new, key, "left_anti").withColumn("place", F.lit("archive")), allowMissingColumns=True)
    return placed


def retain(tables: Mapping[str, DataFrame], archives: Mapping[str, DataFrame], cutoff: int) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """M25 (kept, archives) of whole tables by name, as frames of their own; see place()."""
    placed = place(tables, archives, cutoff)
    kept = {n: df.where("place = 'kept'").select(tables[n].columns) for n, df in placed.items()}
    return kept, {n: df.where("place = 'archive'").drop("place") for n, df in placed.items()}


def union_archive(store: DataFrame, archive: DataFrame, key: Sequence[str]) -> DataFrame:
    """Archived rows only where the store has none of their key."""
    return store.unionByName(archive.join(store.select(*key), list(key), "left_anti"), allowMissingColumns=True)


def settle_calls(calls: DataFrame, results: DataFrame) -> DataFrame:
    """A call without outcome or size takes them from its transcript result; a failed call's real size is its text's."""
    r = results.select("tool_use_id", F.struct("bytes", "failed", "outcome", "real").alias("r"))
    open_ = F.col("failed").isNull() | F.col("bytes_delivered").isNull()
    take = lambda c, new: F.when(open_, F.coalesce(c, new)).otherwise(F.col(c)).alias(c)
    named = {"failed": "r.failed", "bytes_delivered": "r.bytes", "outcome": "r.outcome", "bytes_real": "r.real"}
    return calls.join(r, "tool_use_id", "left").select(*(take(c, named[c]) if c in named else F.col(c) for c in calls.columns))
