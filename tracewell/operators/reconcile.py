"""Reconciliation of stored tables against an independent reading of their sources."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.operators.filters import settled
from tracewell.tables import saved


def mismatches(store: DataFrame, source: DataFrame, key: str, classes: Mapping[str, Column], one_sided: tuple[str, str] = ("missing", "extra")) -> DataFrame:
    """(class, session_id, ts, id): rows of one side only, and the classes that hold for rows of both (columns s.* stored, t.* read)."""
    # columns cross the join one by one, so Spark leaves out those that no class reads; the structs are put together behind it
    side = lambda df, name: df.select(F.col(key).alias("id"), F.lit(True).alias(f"_{name}"), *(F.col(c).alias(f"_{name}_{c}") for c in df.columns))
    struct = lambda df, name: F.struct(*(F.col(f"_{name}_{c}").alias(c) for c in df.columns)).alias(name)
    j = side(store, "s").join(side(source, "t"), "id", "full_outer").select("id", "_s", "_t", struct(store, "s"), struct(source, "t"))
    both = F.col("_s").isNotNull() & F.col("_t").isNotNull()
    found = F.array_compact(F.array(F.when(F.col("_s").isNull(), one_sided[0]), F.when(F.col("_t").isNull(), one_sided[1]), *(F.when(both & F.coalesce(c, F.lit(False)), n) for n, c in classes.items())))
    rows = j.select(found.alias("found"), F.coalesce("s.session_id", "t.session_id").alias("session_id"), F.coalesce("s.ts", "t.ts").alias("ts"), "id")
    return rows.select(F.explode("found").alias("class"), "session_id", "ts", "id")


def differ(column: str) -> Column:
    return ~F.col(f"s.{column}").eqNullSafe(F.col(f"t.{column}"))


def compare_sessions(sessions: DataFrame, read: DataFrame) -> DataFrame:
    """Sessions without transcript, with requests before their first row, without a model though a request has one, and without prompts. read: (session_id, ts, model, prompts)."""
    at = sessions.withColumn("ts", F.col("first_ts"))
    classes = {"session before first row": F.col("t.ts") < F.col("s.first_ts"), "session without model": F.col("s.model").isNull() & F.col("t.model").isNotNull(), "session without prompt": F.col("t.prompts") == 0}
    return mismatches(at, read, "session_id", classes, ("session not stored", "session without transcript"))


def compare_calls(calls: DataFrame, read: DataFrame) -> DataFrame:
    """Calls missing, extra, or with another session, agent, agent type, tool or request than read; without size, request, time or outcome that was read; and calls that only a batch has told of.

    A pending request is no other one. A call that only a batch has told of has neither duration, outcome, nor real size, for that one reason.
    """
    batch_only = F.col("s.bytes_delivered").isNotNull() & F.col("s.bytes_real").isNull() & F.col("s.duration_ms").isNull() & F.col("s.failed").isNull()
    known = calls.columns
    batch_only = batch_only if {"bytes_real", "duration_ms", "failed"} <= set(known) else F.lit(False)
    other_type = differ("agent_type") & F.col("t.agent_type").isNotNull() & ~differ("agent_id") if "agent_type" in known and "agent_type" in read.columns else F.lit(False)
    classes = {
        "call session_id": differ("session_id"), "call agent_id": differ("agent_id"), "call agent type": other_type, "call tool": differ("tool"), "call without request": F.col("s.request_id").isNull() & F.col("t.request_id").isNotNull(),
        "call request_id": F.col("s.request_id").isNotNull() & ~F.col("s.request_id").startswith("pending:") & differ("request_id"),
        "call without size": F.col("s.bytes_delivered").isNull() & F.col("t.bytes_delivered").isNotNull(), "call failed flag": F.col("s.failed").isNotNull() & F.col("t.failed").isNotNull() & differ("failed"),
        "call without ts": F.col("s.ts").isNull() & F.col("t.ts").isNotNull() & ~batch_only,
    }
    found = mismatches(calls, read, "tool_use_id", classes, ("call missing", "call extra"))
    only = calls.select(F.struct("*").alias("s")).where(batch_only).select(F.lit("call batch only").alias("class"), F.col("s.session_id").alias("session_id"), F.col("s.ts").alias("ts"), F.col("s.tool_use_id").alias("id"))
    return found.unionByName(only)


def compare_requests(requests: DataFrame, read: DataFrame) -> DataFrame:
    """Requests missing, extra, pending though read, or with other tokens, owner, model, stop reason or number of calls; and untracked ones: read messages without a call that no row has."""
    tokens = ("input_tokens", "cache_read_tokens", "cache_creation_tokens", "output_tokens")
    other = differ(tokens[0])
    for c in tokens[1:]:
        other = other | differ(c)
    classes = {"request pending": F.col("s.pending") == 1, "request tokens": other, "request owner": differ("session_id") | differ("agent_id"), "request model": differ("model"), "request stop reason": differ("stop_reason"), "request calls": differ("calls")}
    found = mismatches(requests.where("not (source <=> 'ledger')"), read, "request_id", classes, ("request missing", "request extra"))
    if "calls" not in read.columns:
        return found
    without = read.where("coalesce(calls, 0) = 0").select(F.col("request_id").alias("id"), F.lit("request missing").alias("class"), F.lit(True).alias("untracked"))
    return found.join(without, ["id", "class"], "left").select(F.when(F.col("untracked"), "request untracked").otherwise(F.col("class")).alias("class"), "session_id", "ts", "id")


def token_sums(requests: DataFrame, read: DataFrame) -> DataFrame:
    """Total tokens of both sides, one row."""
    sums = [F.sum("context_tokens").alias("context"), F.sum("output_tokens").alias("output")]
    a, b = settled(requests).agg(*sums), read.agg(*(c.alias(n) for c, n in zip((F.sum("context_tokens"), F.sum("output_tokens")), ("read_context", "read_output"), strict=True)))
    return a.crossJoin(F.broadcast(b))  # one row and one row


def compare_agents(agents: DataFrame, read: DataFrame, turns: DataFrame | None = None) -> DataFrame:
    """Agents missing, extra, of another session, type or parent, or with another number of tool uses, or stopped in the transcript only.

    With turns (agent_id, seq, started, stopped, and optionally rebuilt) and, read, `turns` and `ends` (the times at which the transcript shows a turn to end): another number of
    turns, turns without a start, and rebuilt stops that no end that was read is near to, at the same time.
    """
    classes = {"agent session": differ("session_id"), "agent type": differ("agent_type"), "agent parent": differ("parent_tool_use_id"), "agent tool uses": differ("tool_uses"), "agent open turn": F.col("s.stopped").isNull() & F.col("t.stopped").isNotNull()}
    stored = agents.withColumn("ts", F.col("started"))
    if turns is None:
        return mismatches(stored, read.withColumn("ts", F.col("started")), "agent_id", classes, ("agent missing", "agent extra"))
    classes["agent turns"] = F.col("t.turns").isNotNull() & (F.coalesce("s.n_turns", F.lit(0)) != F.col("t.turns"))
    stored = stored.join(turns.groupBy("agent_id").agg(F.count("*").alias("n_turns")), "agent_id", "left")
    found = mismatches(stored, read.withColumn("ts", F.col("started")), "agent_id", classes, ("agent missing", "agent extra"))
    of = lambda rows, name: rows.join(agents.select("agent_id", "session_id"), "agent_id").select(F.lit(name).alias("class"), "session_id", F.coalesce("stopped", "started").alias("ts"), F.concat_ws("#", "agent_id", F.col("seq").cast("string")).alias("id"))
    found = found.unionByName(of(turns.where("started is null").drop("session_id"), "agent turn without start"))
    if "rebuilt" in turns.columns:
        shown = turns.where("rebuilt").drop("session_id").join(read.select("agent_id", "ends"), "agent_id", "left").where(~F.coalesce(F.array_contains("ends", F.col("stopped")), F.lit(False)))
        found = found.unionByName(of(shown, "agent stop rebuilt"))
    return found


def compare_parts(calls: DataFrame, parts: DataFrame, version: int) -> DataFrame:
    """Shell calls without parts, with parts of an older parser, and parts by status."""
    shell = calls.where("tool = 'Bash'").select("tool_use_id", "session_id", "ts")
    per = parts.groupBy("tool_use_id").agg(F.min("parser").alias("parser"), F.min_by("parse_status", F.when(F.col("parse_status") != "ok", F.col("seq"))).alias("status"))
    found = F.array_compact(F.array(F.when(F.col("parser").isNull(), "parts missing"), F.when(F.col("parser") < version, "parts stale"), F.when(F.col("status").isNotNull(), F.concat(F.lit("parts "), "status"))))
    return shell.join(per, "tool_use_id", "left").select(F.explode(found).alias("class"), "session_id", "ts", F.col("tool_use_id").alias("id"))


#: Times that a stored and a read event may be apart; a compaction's two ends and its record, more.
TOLERANCE, COMPACT_TOLERANCE = 2_000, 60_000


def near_pairs(a: DataFrame, b: DataFrame, keys: list[str], tolerance_ms: int) -> DataFrame:
    """a (keys, ts, others) and b (keys, read_ts, others) within the tolerance. Times meet in buckets of its width and their neighbours, so the join is one of equals."""
    bucket = lambda c: F.floor(F.col(c) / tolerance_ms)
    wide = b.withColumn("k", F.explode(F.array(bucket("read_ts") - 1, bucket("read_ts"), bucket("read_ts") + 1)))
    return a.withColumn("k", bucket("ts")).join(wide, [*keys, "k"]).where(F.abs(F.col("ts") - F.col("read_ts")) <= tolerance_ms).drop("k")


def compare_events(events: DataFrame, read: DataFrame, tolerance_ms: int = TOLERANCE) -> DataFrame:
    """Events (event_id, session_id, event, ts) against those read: each read one needs a stored one of its kind within the tolerance, and the other way round; repeats are counted."""
    a = events.select("event_id", "session_id", "event", "ts")
    b = read.select(F.col("event_id").alias("read_id"), "session_id", "event", F.col("ts").alias("read_ts"))
    near = near_pairs(a, b, ["session_id", "event"], tolerance_ms)
    missing = b.join(near.select("read_id").distinct(), "read_id", "left_anti").select(F.concat(F.col("event"), F.lit(" missing")).alias("class"), "session_id", F.col("read_ts").alias("ts"), F.col("read_id").alias("id"))
    extra = a.join(near.select("event_id").distinct(), "event_id", "left_anti").select(F.concat(F.col("event"), F.lit(" extra")).alias("class"), "session_id", "ts", F.col("event_id").alias("id"))
    again = near.groupBy("read_id", "session_id", "event").agg(F.count("*").alias("n"), F.min("ts").alias("ts")).where("n > 1").select(F.concat(F.col("event"), F.lit(" repeated")).alias("class"), "session_id", "ts", F.col("read_id").alias("id"))
    return missing.unionByName(extra).unionByName(again)


def compare_compactions(events: DataFrame, compactions: DataFrame, tolerance_ms: int = COMPACT_TOLERANCE) -> DataFrame:
    """Recorded compactions (entry_id, session_id, ts) without a PreCompact or a PostCompact event within the tolerance, and such events without a compaction."""
    b = compactions.where("ts is not null").select(F.col("entry_id").alias("read_id"), "session_id", F.col("ts").alias("read_ts"))
    found = []
    for kind in ("PreCompact", "PostCompact"):
        a = events.where(F.col("event") == kind).select("event_id", "session_id", "ts")
        near = near_pairs(a, b, ["session_id"], tolerance_ms)
        found.append(b.join(near.select("read_id").distinct(), "read_id", "left_anti").select(F.lit(f"{kind} missing").alias("class"), "session_id", F.col("read_ts").alias("ts"), F.col("read_id").alias("id")))
        found.append(a.join(near.select("event_id").distinct(), "event_id", "left_anti").select(F.lit(f"{kind} without compaction").alias("class"), "session_id", "ts", F.col("event_id").alias("id")))
    return reduce(lambda x, y: x.unionByName(y), found)


def nearest_pairs(faults: list[tuple], rows: list[tuple], tolerance: int) -> list[tuple]:
    """Pairs of (ts, id) of faults with those of rows: the pair at the least distance first, ties by the fault's time, the row's time, the fault's id, the row's id; then the same with what is left, up to the tolerance.

    The pair at the least distance is one of neighbours in time. Neighbours of either kind stand in a list, with those of one kind and time in one place, and wait in a heap; where a place
    is empty, its neighbours become neighbours.
    """
    places: dict[tuple, list] = {}
    for kind, items in enumerate((faults, rows)):
        for ts, i in sorted(items, reverse=True):
            places.setdefault((ts, kind), []).append(i)  # the smallest last
    keys = sorted(places)
    before, after = list(range(-1, len(keys) - 1)), list(range(1, len(keys) + 1))
    heap: list[tuple] = []

    def push(a: int, b: int) -> None:
        if a >= 0 and b < len(keys) and keys[a][1] != keys[b][1] and keys[b][0] - keys[a][0] <= tolerance:
            f, r = (a, b) if keys[b][1] else (b, a)
            heappush(heap, (keys[b][0] - keys[a][0], keys[f][0], keys[r][0], f, r))

    for a in range(len(keys) - 1):
        push(a, a + 1)
    found = []
    while heap:
        *_, f, r = heappop(heap)
        a, b = places[keys[f]], places[keys[r]]
        if not a or not b:
            continue
        while a and b:
            found.append((a.pop(), b.pop()))
        for place, left in ((f, a), (r, b)):
            if not left:
                low, high = before[place], after[place]
                if low >= 0:
                    after[low] = high
                if high < len(keys):
                    before[high] = low
                push(low, high)
    return found


def pair_faults(faults: DataFrame, rows: DataFrame, tolerance_ms: int = 60_000) -> DataFrame:
    """C07 (fault_id, row_id): faults paired one to one with the rows (row_id, session_id, ts) that their lost events would have written.

    Inside a session the nearest pair within the tolerance is taken first, ties by time, then id, and so on with what is left: nearest_pairs(). Where a session is silent for longer than the
    tolerance nothing pairs across, so it is read in order, stretch by stretch, and only a stretch is held. Rows without a session or a time pair with none.
    """
    a = faults.select("session_id", F.col("ts").cast("long").alias("ts"), F.lit(0).alias("kind"), F.col("fault_id").alias("fault_id"), F.lit(None).cast(rows.schema["row_id"].dataType).alias("row_id"))
    b = rows.select("session_id", F.col("ts").cast("long").alias("ts"), F.lit(1).alias("kind"), F.lit(None).cast(faults.schema["fault_id"].dataType).alias("fault_id"), "row_id")
    both = a.unionByName(b).where("session_id is not null and ts is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        session, last, types = None, 0, [pa.null(), pa.null()]

        def pairs() -> list[tuple]:
            found = nearest_pairs(*held, tolerance_ms) if held[0] and held[1] else []
            held[0].clear()
            held[1].clear()
            return found

        def made(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], t) for i, t in enumerate(types)], ["fault_id", "row_id"])

        for batch in batches:
            found = []
            types = [batch.column(c).type for c in ("fault_id", "row_id")]
            for s, ts, kind, fault, row in zip(*(batch.column(c).to_pylist() for c in ("session_id", "ts", "kind", "fault_id", "row_id")), strict=True):
                if s != session or ts - last > tolerance_ms:
                    found += pairs()
                session, last = s, ts
                held[kind].append((ts, row if kind else fault))
            yield made(found)
        if held[0] or held[1]:
            yield made(pairs())

    schema = T.StructType([T.StructField(c, both.schema[c].dataType) for c in ("fault_id", "row_id")])
    return both.where("coalesce(fault_id, row_id) is not null").repartition("session_id").sortWithinPartitions("session_id", "ts").mapInArrow(run, schema)


#: A lost turn end is known to the second; a session that it ended is gone within this time (fixed values).
FAULT_SECOND, END_WITHIN = 1_000, 5_000


def turns_at(events: DataFrame, points: DataFrame) -> DataFrame:
    """points (point, session_id, upto) with prompt, stopped, failed: of the session's main chat the time of its last prompt up to then (null if there is none), and whether a Stop or a StopFailure came from that prompt on and before the next."""
    main = events.where("agent_id is null and session_id is not null and ts is not null")
    prompts = main.where("event = 'UserPromptSubmit'").select("session_id", "ts").distinct()
    ends = main.where("event in ('Stop', 'StopFailure')").select("session_id", "ts", "event")
    none = F.lit(None)
    rows = prompts.select("session_id", "ts", F.lit(0).alias("kind"), F.col("ts").alias("prompt"), none.cast("string").alias("event"), none.cast("string").alias("point"))
    rows = rows.unionByName(ends.select("session_id", "ts", F.lit(1).alias("kind"), none.cast("bigint").alias("prompt"), "event", none.cast("string").alias("point")))
    rows = rows.unionByName(points.select("session_id", F.col("upto").alias("ts"), F.lit(1).alias("kind"), none.cast("bigint").alias("prompt"), none.cast("string").alias("event"), "point"))
    order = Window.partitionBy("session_id").orderBy("ts", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("prompt", F.last("prompt", ignorenulls=True).over(order))
    ended = rows.where("event is not null and prompt is not null").groupBy("session_id", "prompt").agg(F.bool_or(F.col("event") == "Stop").alias("stopped"), F.bool_or(F.col("event") == "StopFailure").alias("failed"))
    found = rows.where("point is not null").select("point", "session_id", "prompt").join(ended, ["session_id", "prompt"], "left")
    return found.select("point", "session_id", "prompt", F.coalesce("stopped", F.lit(False)).alias("stopped"), F.coalesce("failed", F.lit(False)).alias("failed"))


def judge_stops(faults: DataFrame, events: DataFrame) -> DataFrame:
    """C07 of lost turn ends: (fault_id, event, session_id, verdict) of faults (fault_id, ts, session_id, stage, error `{event}: {reason}`), against events (session_id, agent_id, event, ts).

    Judged are terminated Stops, and, where the fault names its session, lost Stops and StopFailures. A turn of a session runs from a prompt to the next. A fault that names its session is `paired` if the turn at its
    second has an end of its kind that no earlier such fault has taken (a Stop none but a Stop); else `no prompt`, `open turn`, `unpaired`, or `unknown session`. One without a session is of those that end within five
    seconds of it: `open turn` if one of them left its turn open, as that may be the lost end; else it is paired with the first of them by name whose turn a Stop closes and no earlier fault has taken; else `unpaired`.
    A session is taken by one fault without a session only. Earlier is by time, then id.

    Faults compete only where they share a session. In each round every fault that is the earliest of those that still want the first session it can have takes it, so rounds are as many as the longest queue.
    """
    event = F.substring_index("error", ": ", 1)
    f = faults.where(F.col("error").contains(": ") & F.col("ts").isNotNull()).select("fault_id", "ts", "session_id", "stage", event.alias("event"))
    named = F.col("session_id").isNotNull()
    f = f.where(((F.col("event") == "Stop") & ((F.col("stage") == "terminated") | (named & (F.col("stage") == "binary")))) | ((F.col("event") == "StopFailure") & named & F.col("stage").isin("terminated", "binary")))
    f = saved(f.select("fault_id", "ts", "session_id", "event"))
    main = events.where("agent_id is null and ts is not null")
    # a fault meets the ends of sessions in buckets of five seconds
    ends = main.where("event = 'SessionEnd' and session_id is not null").select(F.col("session_id").alias("ending"), F.col("ts").alias("end"), F.floor(F.col("ts") / END_WITHIN).alias("bucket"))
    at = F.floor(F.col("ts") / END_WITHIN)
    loose = f.where(~named).drop("session_id").withColumn("bucket", F.explode(F.array(at, at + 1)))
    wanted = loose.join(ends, "bucket").where(f"end >= ts and end < ts + {END_WITHIN}").select("fault_id", "ts", "event", F.col("ending").alias("session_id")).distinct()
    both = f.where(named).withColumn("named", F.lit(True)).unionByName(wanted.withColumn("named", F.lit(False)))
    points = both.select(F.to_json(F.struct("fault_id")).alias("point"), "session_id", (F.col("ts") + FAULT_SECOND - 1).alias("upto"))
    turns = turns_at(events, points).distinct().withColumn("fault_id", F.from_json("point", "fault_id string")["fault_id"]).drop("point")
    both = saved(both.withColumn("fault_id", F.col("fault_id").cast("string")).join(turns, ["fault_id", "session_id"]))

    known = main.select("session_id").distinct().withColumn("known", F.lit(True))
    fits = F.when(F.col("event") == "Stop", F.col("stopped")).otherwise(F.col("failed"))
    of_turn = Window.partitionBy("session_id", "event", "prompt").orderBy("ts", "fault_id")
    own = both.where("named").join(known, "session_id", "left").withColumn("place", F.row_number().over(of_turn))
    told = F.when(F.col("known").isNull(), "unknown session").when(F.col("prompt").isNull(), "no prompt").when(~F.col("stopped") & ~F.col("failed"), "open turn").when(~fits | (F.col("place") > 1), "unpaired")
    own = own.withColumn("verdict", told)

    per = both.where("not named and prompt is not null").groupBy("fault_id").agg(F.bool_or(~F.col("stopped") & ~F.col("failed")).alias("open"))
    left = both.where("not named and prompt is not null and stopped").join(per.where("not open").select("fault_id"), "fault_id")
    claims = left.unionByName(own.where("verdict is null and event = 'Stop'").select(left.columns)).select("fault_id", "ts", "session_id", "prompt", "named")
    claims, taken = saved(claims), None
    while not claims.isEmpty():
        first = claims.groupBy("fault_id").agg(F.min("session_id").alias("session_id"))
        wants = F.struct("ts", "fault_id")
        oldest = claims.groupBy("session_id").agg(F.min(wants).alias("oldest"))
        new = claims.join(first, ["fault_id", "session_id"]).join(oldest, "session_id").where(wants == F.col("oldest")).drop("oldest")
        new = saved(new)
        taken = new if taken is None else saved(taken.unionByName(new))
        rest = claims.join(new.select("fault_id"), "fault_id", "left_anti")
        rest = rest.join(new.select("session_id", "prompt"), ["session_id", "prompt"], "left_anti")  # the turn is taken
        gone = new.where("not named").select("session_id").distinct().withColumn("gone", F.lit(True))
        rest = rest.join(gone, "session_id", "left").where("named or gone is null").drop("gone")
        claims = saved(rest)
    taken = (claims if taken is None else taken).select("fault_id", F.col("session_id").alias("taken"))
    own = own.join(taken, "fault_id", "left").withColumn("verdict", F.coalesce("verdict", F.when((F.col("event") == "StopFailure") | F.col("taken").isNotNull(), "paired").otherwise("unpaired")))
    loose = f.where(~named).select(F.col("fault_id").cast("string").alias("fault_id"), "event").join(per, "fault_id", "left").join(taken, "fault_id", "left")
    loose = loose.select("fault_id", "event", F.col("taken").alias("session_id"), F.when(F.coalesce("open", F.lit(False)), "open turn").when(F.col("taken").isNotNull(), "paired").otherwise("unpaired").alias("verdict"))
    return own.select("fault_id", "event", "session_id", "verdict").unionByName(loose)


#: Begins a scope that names a tool.
TOOL_SCOPE = "tool="


def apply_allowlist(found: DataFrame, allowed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mismatches with entry, reason and verdict (expected or unexplained), and allowlist entries that explain none.

    found: (class, session_id, ts, id) and, where a mismatch has several, ids. allowed: (entry, class, scopes, before_ts, reason), entry a number in the order of the list. An entry explains a mismatch of its class if one
    of its scopes begins the session or one of the ids, a scope `tool=...` if it is one of the ids, or if the mismatch has a time, above 0 and before before_ts. Of several the first counts, and
    one that always comes later is not used.

    Scopes are met by joins of equals: a mismatch's ids are cut at the lengths that the scopes of its class have.
    """
    columns = found.columns
    ids = F.col("ids") if "ids" in columns else F.array("id")
    rows = found.groupBy(*columns).agg(F.count("*").alias("_copies"))
    scopes = allowed.select("class", "entry", F.explode("scopes").alias("scope")).where("scope <> ''")
    exact = F.startswith("scope", F.lit(TOOL_SCOPE))
    lengths = scopes.where(~exact).groupBy("class").agg(F.array_sort(F.collect_set(F.length("scope"))).alias("_lengths"))
    times = allowed.where("before_ts is not null").groupBy("class").agg(F.collect_list(F.struct("entry", "before_ts")).alias("_times"))
    early = F.array_min(F.transform(F.filter("_times", lambda t: t["before_ts"] > F.col("ts")), lambda t: t["entry"]))
    rows = rows.join(lengths, "class", "left").join(times, "class", "left").withColumn("_early", F.when(F.col("ts") > 0, early)).drop("_times")
    known = F.filter(F.array_union(F.array("session_id"), F.coalesce(ids, F.array().cast("array<string>"))), lambda x: x.isNotNull() & (x != ""))
    cut = F.flatten(F.transform(known, lambda x: F.transform(F.filter(F.col("_lengths"), lambda n: n <= F.length(x)), lambda n: F.struct(F.lit(False).alias("exact"), F.substring(x, F.lit(1), n).alias("scope")))))
    whole = F.transform(F.filter(F.coalesce(ids, F.array().cast("array<string>")), lambda x: F.startswith(x, F.lit(TOOL_SCOPE))), lambda x: F.struct(F.lit(True).alias("exact"), x.alias("scope")))
    rows = rows.withColumn("_cut", F.explode_outer(F.array_distinct(F.concat(F.coalesce(cut, F.array().cast("array<struct<exact:boolean,scope:string>>")), whole))))
    rows = rows.select(*columns, "_copies", "_early", F.col("_cut.exact").alias("_exact"), F.col("_cut.scope").alias("_scope"))
    index = scopes.groupBy(F.col("class").alias("_class"), exact.alias("_is"), "scope").agg(F.min("entry").alias("_entry"))
    hit = rows.join(index, (F.col("class") == F.col("_class")) & (F.col("_exact") == F.col("_is")) & (F.col("_scope") == F.col("scope")), "left")
    first = hit.groupBy(*columns, "_copies").agg(F.least(F.min("_early"), F.min("_entry")).alias("entry"))
    judged = first.join(allowed.select("entry", "reason"), "entry", "left").withColumn("verdict", F.when(F.col("entry").isNotNull(), "expected").otherwise("unexplained"))
    judged = judged.withColumn("_copies", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*columns, "entry", "reason", "verdict")
    return judged, allowed.join(first.select("entry").distinct(), "entry", "left_anti")
