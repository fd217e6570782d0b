"""The report topics (R01-R29): frames of the store's tables in, typed rows out. Text formatting is a last projection (operators.filters)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.merge import open_prompts
from tracewell.operators.filters import LIMIT, nearest_ranks, settled, top, value_counts
from tracewell.schema import not_ledger
from tracewell.tables import once

FILE = r"^([^\t]*)\t([^\t]*)\t([01?])\t(.*)$"
READS = ("read-whole", "read-range", "search")


def decode_parts(parts: DataFrame) -> DataFrame:
    """Args as an array, files as structs (action, range, exists, path); a value that does not decode costs only itself and is counted."""
    args, files = F.from_json("args", "array<string>"), F.from_json("files", "array<string>")
    field = lambda x, i: F.regexp_extract(x, FILE, i)
    good = F.filter(files, lambda x: x.rlike(FILE))
    return parts.select(
        *[c for c in parts.columns if c not in ("args", "files")],
        args.alias("args"),
        F.transform(good, lambda x: F.struct(field(x, 1).alias("action"), field(x, 2).alias("range"), field(x, 3).alias("exists"), field(x, 4).alias("path"))).alias("files"),
        (F.when(F.col("args").isNotNull() & args.isNull(), 1).otherwise(0)).alias("bad_args"),
        (F.when(F.col("files").isNotNull() & files.isNull(), 1).otherwise(F.coalesce(F.size(files) - F.size(good), F.lit(0)))).alias("bad_files"),
    )


def shell_looks(calls: DataFrame, parts: DataFrame) -> DataFrame:
    """(tool_use_id, path, action, range, exists, conditional, party, ts, bytes): each file of each shell part."""
    looks = decode_parts(parts).select("tool_use_id", "conditional", F.explode("files").alias("f"))
    own = calls.select("tool_use_id", "session_id", "agent_id", "ts", "bytes_delivered")
    return looks.join(own, "tool_use_id").select("tool_use_id", "conditional", "f.*", "session_id", "agent_id", "ts", "bytes_delivered")


def files(calls: DataFrame, parts: DataFrame, limit: int | None = LIMIT) -> DataFrame:
    """What put each file into the context. A shell call is credited its bytes if it reads one file only and executes none."""
    party = F.struct("session_id", "agent_id")
    reads = calls.where("tool = 'Read' and file_path is not null").select(
        F.col("file_path").alias("path"), F.col("bytes_delivered").alias("read_bytes"), F.lit(None).cast("bigint").alias("bash_bytes"), F.lit(1).alias("reads"), F.lit(1).alias("certain"), F.lit(0).alias("conditional"),
        party.alias("party"), F.when((F.col("read_start") > 1) | (F.col("read_lines") < F.col("read_total_lines")), 1).otherwise(0).alias("ranged"), F.lit(0).alias("execs"), "ts", F.lit("1").alias("exists"), F.col("read_total_lines").alias("lines"), F.lit(0).alias("shell"), "tool_use_id",
    )
    # each file of each shell call once: what reads it, and whether the call runs it
    reading, of_read = F.col("action").isin(*READS), lambda c: F.when(F.col("action").isin(*READS), c)
    looks = shell_looks(calls, parts).groupBy("tool_use_id", "path").agg(
        F.max(reading.cast("int")).alias("reads"), F.max((F.col("action") == "exec").cast("int")).alias("execs"), F.max(F.col("action").isin("exec", "unknown").cast("int")).alias("runs"), F.min(of_read(F.col("conditional"))).alias("conditional"),
        F.min(of_read(F.when(F.col("action") == "read-whole", 0).otherwise(1))).alias("ranged"), F.max(of_read(F.col("exists"))).alias("exists"), *(F.first(c).alias(c) for c in ("session_id", "agent_id", "ts", "bytes_delivered")),
    )
    call = Window.partitionBy("tool_use_id")
    alone = (F.sum("reads").over(call) == 1) & (F.max("runs").over(call) == 0)
    is_read = F.col("reads") == 1
    shell = looks.withColumn("alone", alone).select(
        "path", F.lit(None).cast("bigint").alias("read_bytes"), F.when(is_read & F.col("alone"), F.col("bytes_delivered")).alias("bash_bytes"), "reads", F.when(is_read, 1 - F.col("conditional")).alias("certain"), F.when(is_read, F.col("conditional")).alias("conditional"),
        F.when(is_read, party).alias("party"), "ranged", "execs", F.when(is_read, F.col("ts")).alias("ts"), "exists", F.lit(None).cast("bigint").alias("lines"), F.lit(1).alias("shell"), "tool_use_id",
    )
    grouped = reads.unionByName(shell).groupBy("path").agg(
        F.sum("read_bytes").alias("read_bytes"), F.sum("bash_bytes").alias("bash_bytes"), F.sum("reads").alias("reads"), F.sum("certain").alias("certain"), F.sum("conditional").alias("conditional"),
        F.count_distinct("party").alias("agents"), F.sum(1 - F.col("ranged")).alias("whole"), F.sum("ranged").alias("ranged"), F.sum("execs").alias("execs"),
        F.max_by("exists", F.when(F.col("reads") == 1, F.struct("ts", "shell", "tool_use_id"))).alias("last_exists"),
        F.max_by("lines", F.when(F.col("lines").isNotNull(), F.struct("ts", "tool_use_id"))).alias("lines"),
    ).where("reads > 0")
    size = F.when(F.col("last_exists") == "0", "gone").otherwise(F.col("lines").cast("string"))
    rows = grouped.select("path", "read_bytes", "bash_bytes", "reads", "certain", "conditional", "agents", size.alias("size"), "whole", "ranged", (F.col("reads") - F.col("agents")).alias("re_reads"), "execs")
    return top(rows, [F.desc(F.greatest(F.coalesce("read_bytes", F.lit(0)), F.coalesce("bash_bytes", F.lit(0)))), F.desc("reads"), "path"], limit)


def writes(calls: DataFrame, parts: DataFrame, limit: int | None = LIMIT) -> DataFrame:
    """Writes of each file by tool and by shell, and how it grew where known."""
    tool = calls.where("tool in ('Edit', 'Write', 'MultiEdit', 'NotebookEdit') and file_path is not null").select(F.col("file_path").alias("path"), F.lit(1).alias("tool"), F.lit(0).alias("bash"), (F.col("file_bytes") - F.col("file_bytes_before")).alias("growth"))
    shell = shell_looks(calls, parts).where("action = 'write'").select("tool_use_id", "path").distinct().select("path", F.lit(0).alias("tool"), F.lit(1).alias("bash"), F.lit(None).cast("bigint").alias("growth"))
    rows = tool.unionByName(shell).groupBy("path").agg(F.count("*").alias("writes"), F.sum("tool").alias("tool"), F.sum("bash").alias("bash"), F.sum("growth").alias("growth"), F.count_if(F.col("growth").isNull()).alias("growth_unknown"))
    return top(rows, [F.desc("writes"), "path"], limit)


#: Programs that say nothing of what a command is for, and filters of a stream (fixed values).
TRIVIAL = ("cd", "true", "false", ":", "set", "export", "pwd", "sleep")
STREAM = ("head", "tail", "sort", "uniq", "wc", "grep", "sed", "awk", "tr", "cut", "tee", "cat")
PRINTS = ("echo", "printf")


def call_shape(parts: DataFrame) -> DataFrame:
    """R04 (tool_use_id, shape): the programs of a call's parts with their first plain argument, trivial ones left out, three at most."""
    p = parts.withColumns({"args": F.from_json("args", "array<string>"), "bare": ~F.coalesce(F.exists(F.from_json("files", "array<string>"), lambda x: x.rlike(FILE)), F.lit(False))})
    base = F.element_at(F.split("program", "/"), -1)
    no_files = F.col("bare")
    first = F.coalesce(F.try_element_at("args", F.lit(1)), F.lit(""))
    named = F.when((first != "") & ~first.rlike(r"^-|/|\.|\s"), F.concat(base, F.lit(" "), first)).otherwise(base)
    rank = F.when(base.isin(*TRIVIAL), 3).when(base.isin(*PRINTS) & no_files, 2).when(base.isin(*STREAM) & no_files, 1).otherwise(0)
    steps = p.select("tool_use_id", F.struct("seq", named.alias("name"), rank.alias("rank")).alias("s")).groupBy("tool_use_id").agg(F.array_sort(F.collect_list("s")).alias("all"))
    least = F.array_min(F.transform("all", lambda s: s["rank"]))
    kept = F.filter("all", lambda s: s["rank"] == least)
    shape = F.array_join(F.slice(F.array_distinct(F.transform(kept, lambda s: s["name"])), 1, 3), " ; ")
    return steps.select("tool_use_id", shape.alias("shape"))


def commands(calls: DataFrame, parts: DataFrame, limit: int | None = LIMIT) -> DataFrame:
    """Shell calls by shape, their delivered bytes, and reads that follow a spilled output."""
    shaped = calls.where("tool = 'Bash'").join(call_shape(parts), "tool_use_id")
    spilled = shaped.where("persisted_path is not null").select("shape", "tool_use_id", "session_id", F.coalesce("agent_id", F.lit("")).alias("agent"), "ts", "persisted_path")
    reads = calls.where("tool = 'Read'").select(F.col("tool_use_id").alias("read_id"), "session_id", F.coalesce("agent_id", F.lit("")).alias("agent"), F.col("ts").alias("read_ts"), F.col("file_path").alias("persisted_path"))
    follow = spilled.join(reads, ["session_id", "agent", "persisted_path"]).where("read_ts >= ts").groupBy("shape").agg(F.count_distinct("read_id").alias("follow_up_reads"))
    # sums and percentiles are both taken from the counts of values, so the calls are read once for them
    counts = value_counts(shaped, ["shape"], "bytes_delivered", F.count_if((F.col("bytes_real") >= 20_000) & (F.col("bytes_real") < 30_000)).alias("from_20k_to_30k"), F.count("persisted_path").alias("persisted"))
    rows = counts.groupBy("shape").agg(F.sum("n").alias("calls"), F.sum(F.col("bytes_delivered") * F.col("n")).alias("bytes"), F.sum("from_20k_to_30k").alias("from_20k_to_30k"), F.sum("persisted").alias("persisted"))
    rows = rows.join(nearest_ranks(counts, ["shape"], "bytes_delivered", {"p50": 50, "p95": 95}), "shape").join(follow, "shape", "left").fillna(0, ["follow_up_reads"])
    rows = rows.select("shape", "calls", "bytes", "p50", "p95", "from_20k_to_30k", "persisted", "follow_up_reads")
    return top(rows, [F.desc_nulls_last("bytes"), F.desc("calls"), "shape"], limit)


def labels(calls: DataFrame, parts: DataFrame) -> DataFrame:
    """(request_id, label): up to three of a request's calls as text, and how many more there are."""
    shape = call_shape(parts)
    what = F.when(F.col("tool") == "Bash", F.concat(F.lit("Bash "), F.coalesce("shape", F.lit("?")))).when(F.col("file_path").isNotNull(), F.concat("tool", F.lit(" "), "file_path")).otherwise(F.col("tool"))
    c = calls.where("request_id is not null").join(shape, "tool_use_id", "left").select("request_id", F.struct(F.coalesce("ts", F.lit(0)).alias("ts"), "tool_use_id", what.alias("what")).alias("c"))
    all_ = c.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list("c")), lambda x: x["what"]).alias("all"))
    more = F.when(F.size("all") > 3, F.concat(F.lit(" +"), (F.size("all") - 3).cast("string"), F.lit(" more"))).otherwise("")
    return all_.select("request_id", F.concat(F.array_join(F.slice("all", 1, 3), ", "), more).alias("label"))


def context(requests: DataFrame, calls: DataFrame, parts: DataFrame, limit: int | None = LIMIT) -> DataFrame:
    """How each party's context grew, and after which calls it grew most (three growths)."""
    rows = settled(requests).where("ts is not null and context_tokens is not null").withColumn("party", F.coalesce("agent_id", F.lit("")))
    order = Window.partitionBy("session_id", "party").orderBy("ts", "request_id")
    seen = rows.select("session_id", "party", "agent_id", "ts", "request_id", "context_tokens", F.lag(F.struct("request_id", "context_tokens")).over(order).alias("prev"), F.row_number().over(order).alias("pos"))
    grown = seen.withColumn("delta", F.col("context_tokens") - F.col("prev.context_tokens"))
    per = grown.groupBy("session_id", "party").agg(
        F.count("*").alias("requests"), F.min_by("context_tokens", "pos").alias("start"), F.max("context_tokens").alias("peak"), F.max_by("context_tokens", "pos").alias("last"))
    per = per.withColumn("mean_growth", F.expr("CASE WHEN requests > 1 THEN (last - start) div (requests - 1) END"))
    ranked = grown.where("delta > 0").withColumn("n", F.row_number().over(Window.partitionBy("session_id", "party").orderBy(F.desc("delta"), "pos"))).where("n <= 3")
    named = ranked.select("session_id", "party", "n", "delta", F.col("prev.request_id").alias("request_id")).join(labels(calls, parts), "request_id", "left")
    text = F.concat(F.col("delta").cast("string"), F.lit(" "), F.coalesce("label", F.lit("-")))
    wide = named.groupBy("session_id", "party").agg(*(F.max(F.when(F.col("n") == i, text)).alias(f"growth_{i}") for i in (1, 2, 3)))
    out = per.join(wide, ["session_id", "party"], "left").select("session_id", F.nullif("party", F.lit("")).alias("agent_id"), "requests", "start", "peak", "mean_growth", "growth_1", "growth_2", "growth_3")
    return top(out, [F.desc("peak"), "session_id", F.col("agent_id").asc_nulls_first()], limit)


#: The longest run of R06; what a file's distance is where there is no file; and bits a step takes in a run's shape: its pieces of text, which are seldom more than one, and that distance.
LONGEST, NO_FILE, SHAPE_BITS, DISTANCE_BITS = 5, 7, 12, 3
RUNS = "run_key string, n int, party bigint, whole bigint, occurrences bigint, bytes bigint, sized bigint, at bigint, shape bigint"


def runs_of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """RUNS of rows (party, at, shape, run_n and size_n for each n) in order of party and at: for each run its occurrences in parties that lie inside the batch, and how many parties these are (`whole`).
    The first and the last party may go on in other batches: theirs are rows of their own, with the party's number."""
    for batch in batches:
        if not batch.num_rows:
            continue
        party, at, shape = (batch.column(c).to_numpy() for c in ("party", "at", "shape"))
        number = np.cumsum(np.concatenate([[0], party[1:] != party[:-1]]))
        part = np.where(party == party[0], 1, np.where(party == party[-1], 2, 0))
        for n in range(2, LONGEST + 1):
            runs, sizes = batch.column(f"run_{n}"), batch.column(f"size_{n}")
            rows = np.flatnonzero(runs.is_valid().to_numpy(zero_copy_only=False))
            texts = runs.drop_null().dictionary_encode()
            k = len(texts.dictionary)
            of = texts.indices.to_numpy().astype(np.int64) + part[rows] * k
            occurrences, known = np.bincount(of, minlength=3 * k), sizes.is_valid().to_numpy(zero_copy_only=False)[rows]
            total, first = np.zeros(3 * k, np.int64), np.zeros(3 * k, np.int64)
            np.add.at(total, of, sizes.fill_null(0).to_numpy()[rows])
            first[of[::-1]] = rows[::-1]
            parties = np.unique(of * (number[-1] + 1) + number[rows]) // (number[-1] + 1)
            got = np.flatnonzero(occurrences)
            inside = got < k
            whole = np.where(inside, np.bincount(parties, minlength=3 * k)[got], 0)
            columns = [texts.dictionary.take(pa.array(got % max(k, 1))), pa.array(np.full(len(got), n, np.int32)), pa.array(party[first[got]], mask=inside), *map(pa.array, (whole, occurrences[got], total[got], np.bincount(of[known], minlength=3 * k)[got], at[first[got]], shape[first[got]] & ((1 << SHAPE_BITS * n) - 1)))]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in RUNS.split(", ")])


def sequences(calls: DataFrame, parts: DataFrame, limit: int | None = LIMIT) -> DataFrame:
    """Runs of two to five consecutive steps that recur in two parties or more; a shorter run inside a longer one with the same count is left out.

    Calls are dealt by ranges of parties, so their place in the sorted whole tells which occurrence of a run is the first. What is aggregated are texts and whole numbers: a run's shape says which
    piece of its text is which step, and how many steps before it the same file was used.
    """
    program = F.element_at(F.split("program", "/"), -1)
    first = parts.groupBy("tool_use_id").agg(F.min_by(program, "seq").alias("program"))
    timed = calls.where("ts is not null").select("session_id", "agent_id", "ts", "tool_use_id", "tool", "file_path", "bytes_delivered")
    is_shell = F.col("tool").eqNullSafe("Bash")
    shell = timed.where(is_shell).join(first, "tool_use_id", "left").withColumn("step", F.concat(F.lit("Bash "), F.coalesce("program", F.lit("?"))))
    steps = shell.drop("program").unionByName(timed.where(~is_shell).withColumn("step", F.col("tool"))).drop("tool").repartitionByRange("session_id", "agent_id")
    order = Window.partitionBy("session_id", "agent_id").orderBy("ts", "tool_use_id")
    file = F.col("file_path")
    near = F.when(file.isNull(), NO_FILE)
    for k in range(1, LONGEST):
        near = near.when(F.lag("file_path", k).over(order) == file, k)
    pieces = F.when(F.col("step").isNull(), 0).otherwise(F.least(F.size(F.split("step", " > ")), F.lit((1 << SHAPE_BITS - DISTANCE_BITS) - 1)))
    steps = steps.select("session_id", "agent_id", "ts", "tool_use_id", "step", F.col("bytes_delivered").alias("bytes"), near.otherwise(0).alias("near"), pieces.alias("pieces"))
    here = F.struct("step", "bytes", "near", "pieces")
    ahead = steps.select(F.row_number().over(order).alias("place"), here.alias("s0"), *(F.lead(here, k).over(order).alias(f"s{k}") for k in range(1, LONGEST)))
    ahead = ahead.withColumn("at", F.monotonically_increasing_id())

    def marked(x: Column, before: Column | int) -> Column:
        """The text of a step in a run with so many steps before it; null if it has none."""
        return F.concat(x["step"], F.when(x["near"] == NO_FILE, "").when(x["near"].between(1, before), " same").otherwise(" new"))

    s = [F.col(f"s{k}") for k in range(LONGEST)]
    texts = [marked(x, k) for k, x in enumerate(s)]
    # an unknown size leaves the occurrence's bytes out whole
    of_n = [c for n in range(2, LONGEST + 1) for c in (
        F.when(s[n - 1].isNotNull(), F.concat_ws(" > ", *texts[:n])).alias(f"run_{n}"), reduce(lambda a, b: a + b, (x["bytes"] for x in s[:n])).cast("bigint").alias(f"size_{n}"))]
    shape = reduce(lambda a, b: a + b, (F.coalesce(F.shiftleft((x["pieces"] * (1 << DISTANCE_BITS) + x["near"]).cast("bigint"), SHAPE_BITS * k), F.lit(0)) for k, x in enumerate(s)))
    runs = ahead.select((F.col("at") - F.col("place")).alias("party"), "at", shape.alias("shape"), *of_n).mapInArrow(runs_of_batch, RUNS)
    found = runs.groupBy("run_key", "n").agg(
        F.sum("occurrences").alias("occurrences"), (F.sum("whole") + F.count_distinct("party")).alias("agents"), F.sum("bytes").alias("bytes"), F.sum("sized").alias("sized"), F.min_by("shape", "at").alias("shape"),
    ).where("agents >= 2")
    # a run with the sub-runs of its first occurrence, each by key; one that is a sub-run of another with the same count goes
    of_shape = lambda k, shift, bits: F.shiftright("shape", SHAPE_BITS * k + shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    size = [of_shape(k, DISTANCE_BITS, SHAPE_BITS - DISTANCE_BITS) for k in range(LONGEST)]

    def step_of(k: int) -> Column:
        text = F.array_join(F.slice("pieces", reduce(lambda a, b: a + b, size[:k], F.lit(1)), size[k]), " > ")
        distance = of_shape(k, 0, DISTANCE_BITS)
        mark = F.when(distance == NO_FILE, 0).when(distance.between(1, k), len(" same")).otherwise(len(" new"))
        return F.struct(F.when(size[k] > 0, F.left(text, F.length(text) - mark)).alias("step"), distance.alias("near"))

    found = once(once(found, {"pieces": F.split("run_key", " > ")}), {"steps": F.slice(F.array(*map(step_of, range(LONGEST))), 1, F.col("n"))})
    keyed = lambda run: F.array_join(F.transform(run, lambda x, i: marked(x, i)), " > ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("n") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("n") - m + 1), lambda i: F.struct(keyed(F.slice("steps", i, m)).alias("run_key"), m.cast("int").alias("n"), F.lit(None).cast("struct<agents:bigint,bytes:bigint,sized:bigint>").alias("own")))))
    own = F.struct("run_key", F.col("n").cast("int").alias("n"), F.struct(*(F.col(c).cast("bigint").alias(c) for c in ("agents", "bytes", "sized"))).alias("own"))
    each = found.select("occurrences", F.explode(F.when(F.col("n") > 2, F.concat(F.array(own), inner)).otherwise(F.array(own))).alias("r")).select("occurrences", "r.*")
    kept = each.groupBy("run_key", "n", "occurrences").agg(F.max("own").alias("own"), F.count_if(F.col("own").isNull()).alias("inside")).where("own is not null and inside = 0").select("run_key", "n", "occurrences", "own.*")
    mean = F.expr("CASE WHEN sized > 0 THEN bytes div sized END")
    rows = kept.select("run_key", "n", "occurrences", "agents", "bytes", mean.alias("mean_bytes"))
    return top(rows, [F.desc("bytes"), F.desc("occurrences"), "run_key"], limit)


STAGES = ("payload", "store", "transcript", "parse", "binary", "terminated")


def faults(faults_: DataFrame, parts: DataFrame, refusals_: DataFrame, limit: int | None = LIMIT) -> DataFrame:
    """R07 (kind, label, count, ts, session_id, call, error): counts by stage, all listed; parts by status; latest faults and refusals."""
    spark = faults_.sparkSession
    none = {"count": "bigint", "ts": "bigint", "session_id": "string", "call": "string", "error": "string"}
    shape = lambda df, kind, label: df.select(F.lit(kind).alias("kind"), label.alias("label"), *((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in none.items()))
    stages = spark.createDataFrame([(s,) for s in STAGES], "stage string").join(faults_.groupBy("stage").agg(F.count("*").alias("count")), "stage", "left").fillna(0, ["count"])
    status = parts.groupBy("parse_status").agg(F.count("*").alias("count"))
    latest = top(faults_.withColumnRenamed("tool_use_id", "call"), [F.desc("ts"), "fault_id"], limit)
    refused = top(refusals_.withColumnRenamed("kind", "what"), [F.desc("ts"), "session_id"], limit)
    return (
        shape(stages, "stage", F.col("stage")).unionByName(shape(status, "parts", F.col("parse_status")))
        .unionByName(shape(latest, "fault", F.col("stage"))).unionByName(shape(refused, "refusal", F.col("what")))
    )


def refusals(events: DataFrame, turn_ends: DataFrame | None = None) -> DataFrame:
    """R08 (ts, session_id, kind, source): failed turn ends, and transcripts (E21 rows) whose last prompt has no end and that end on an API error."""
    told = events.where("event = 'StopFailure'").select("ts", "session_id", F.coalesce("error_type", F.lit("unknown")).alias("kind"), F.lit("hook").alias("source"))
    if turn_ends is None:
        return told
    open_ = open_prompts(events).select("session_id")
    read = turn_ends.where("event = 'StopFailure'").join(open_, "session_id", "left_semi").select("ts", "session_id", F.col("error_type").alias("kind"), F.lit("transcript").alias("source"))
    return told.unionByName(read)


HOUR = 3_600_000


def ended_before_start(events: DataFrame, faults_: DataFrame) -> DataFrame:
    """R10 (session_id): only SessionEnd events, no fault of the session, and no lost event without a session within the hour before."""
    per = events.groupBy("session_id").agg(F.count_if(F.col("event") != "SessionEnd").alias("others"), F.min("ts").alias("ts")).where("others = 0")
    per = per.join(faults_.where("session_id is not null").select("session_id").distinct(), "session_id", "left_anti")
    lost = faults_.where("session_id is null and stage in ('binary', 'terminated')").select(F.col("ts").alias("lost_ts"), F.floor(F.col("ts") / HOUR).alias("h"))
    near = per.select("session_id", "ts", F.explode(F.array(F.floor(F.col("ts") / HOUR), F.floor(F.col("ts") / HOUR) - 1)).alias("h")).join(lost, "h").where(f"lost_ts between ts - {HOUR} and ts")
    return per.join(near.select("session_id").distinct(), "session_id", "left_anti").select("session_id")


IDLE = ("SessionStart", "SessionEnd", "InstructionsLoaded", "Notification")


def ran_nothing(events: DataFrame, calls: DataFrame, requests: DataFrame, faults_: DataFrame) -> DataFrame:
    """R11 (session_id): a start, only idle events, no call, request or fault, and no lost event without a session since the start."""
    per = events.groupBy("session_id").agg(F.count_if(~F.col("event").isin(*IDLE)).alias("busy"), F.min(F.when(F.col("event") == "SessionStart", F.col("ts"))).alias("ts")).where("busy = 0 and ts is not null")
    for other in (calls, requests, faults_.where("session_id is not null")):
        per = per.join(other.select("session_id").distinct(), "session_id", "left_anti")
    last_lost = faults_.where("session_id is null and stage in ('binary', 'terminated')").agg(F.max("ts").alias("lost"))
    return per.crossJoin(F.broadcast(last_lost)).where("lost is null or lost < ts").select("session_id")  # one row


def sessions(sessions_: DataFrame, calls: DataFrame, agents_: DataFrame, unused: DataFrame, limit: int | None = LIMIT) -> DataFrame:
    """Sessions by last time; `(unused)` models where nothing ran."""
    n_calls = calls.groupBy("session_id").agg(F.count("*").alias("calls"))
    n_agents = agents_.groupBy("session_id").agg(F.count("*").alias("agents"))
    rows = sessions_.join(n_calls, "session_id", "left").join(n_agents, "session_id", "left").join(unused.select("session_id", F.lit(True).alias("unused")), "session_id", "left")
    model = F.when(F.col("model").isNull() & F.col("unused"), "(unused)").otherwise(F.col("model"))
    rows = rows.select("session_id", "first_ts", "last_ts", model.alias("model"), "start_source", "end_reason", F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("agents", F.lit(0)).alias("agents"), "cwd", "host", F.coalesce("tz_name", F.lit("-")).alias("tz"))
    return top(rows, [F.desc("last_ts"), "session_id"], limit)


def prompts(calls: DataFrame, requests: DataFrame, agents_: DataFrame, turn_durations: DataFrame, limit: int | None = LIMIT) -> DataFrame:
    """Each prompt's calls, requests and agents, whichever there are, and its measured wall time."""
    c = calls.where("prompt_id is not null").groupBy("prompt_id").agg(F.min("session_id").alias("s1"), F.min("ts").alias("f1"), F.max("ts").alias("l1"), F.count("*").alias("calls"), F.sum("failed").alias("failed"), F.count_distinct("agent_id").alias("call_agents"))
    r = settled(requests).where("prompt_id is not null").groupBy("prompt_id").agg(F.min("session_id").alias("s2"), F.min("ts").alias("f2"), F.max("ts").alias("l2"), F.count("*").alias("requests"), F.max("context_tokens").alias("context_tokens"), F.sum("output_tokens").alias("output_tokens"))
    a = agents_.where("prompt_id is not null").groupBy("prompt_id").agg(F.min("session_id").alias("s3"), F.min("started").alias("f3"), F.max("stopped").alias("l3"), F.count("*").alias("agents"))
    wall = turn_durations.where("prompt_id is not null").groupBy("session_id", "prompt_id").agg(F.sum("duration_ms").alias("wall_ms"))
    rows = c.join(r, "prompt_id", "full_outer").join(a, "prompt_id", "full_outer").select(
        "prompt_id", F.coalesce("s1", "s2", "s3").alias("session_id"), F.least("f1", "f2", "f3").alias("first_ts"), F.greatest("l1", "l2", "l3").alias("last_ts"), F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("failed", F.lit(0)).alias("failed"),
        F.coalesce("agents", F.lit(0)).alias("agents"), F.coalesce("requests", F.lit(0)).alias("requests"), "context_tokens", "output_tokens",
    )
    return top(rows.join(wall, ["session_id", "prompt_id"], "left"), [F.desc_nulls_last("first_ts"), "prompt_id"], limit)


def effort(calls: DataFrame, turns_: DataFrame, agents_: DataFrame) -> DataFrame:
    """Calls, turn ends and failed calls by effort, permission mode and agent type."""
    c = calls.select("effort", "permission_mode", "agent_type", F.lit(1).alias("calls"), F.lit(0).alias("turns"), F.when(F.col("failed") == 1, 1).otherwise(0).alias("failed"))
    t = turns_.join(agents_.select("agent_id", "agent_type"), "agent_id", "left").select("effort", "permission_mode", "agent_type", F.lit(0).alias("calls"), F.lit(1).alias("turns"), F.lit(0).alias("failed"))
    return c.unionByName(t).groupBy("effort", "permission_mode", "agent_type").agg(*(F.sum(x).alias(x) for x in ("calls", "turns", "failed")))


def tokens(requests: DataFrame, agents_: DataFrame) -> DataFrame:
    """Token sums by model and agent type; cache hits over the prompt, thinking over the output of requests that carried it."""
    rows = settled(requests).join(agents_.select("agent_id", "agent_type"), "agent_id", "left")
    sums = [F.sum(c).alias(a) for c, a in (("input_tokens", "input"), ("cache_read_tokens", "cache_read"), ("cache_creation_5m_tokens", "cache_write_5m"), ("cache_creation_1h_tokens", "cache_write_1h"), ("cache_creation_tokens", "cache_write"), ("output_tokens", "output"), ("thinking_tokens", "thinking"))]
    rows = rows.groupBy("model", "agent_type").agg(F.count("*").alias("requests"), *sums, F.sum(F.when(F.col("thinking_tokens").isNotNull(), F.col("output_tokens"))).alias("thought_of"))
    whole = F.col("input") + F.col("cache_read") + F.col("cache_write")
    return rows.select(*[c for c in rows.columns if c != "thought_of"], F.round(F.when(whole > 0, 100 * F.col("cache_read") / whole), 6).alias("cache_hit_percent"), F.round(F.when(F.col("thought_of") > 0, 100 * F.col("thinking") / F.col("thought_of")), 6).alias("think_percent"))


def agents(agent_turns: DataFrame, limit: int | None = LIMIT) -> DataFrame:
    """Each turn of each sub-agent with its seconds."""
    rows = agent_turns.select("agent_id", "agent_type", "session_id", "seq", "started", "stopped", F.expr("(stopped - started) div 1000").alias("seconds"), "prompt_id")
    return top(rows, [F.desc_nulls_last(F.coalesce("started", "stopped")), "agent_id", "seq"], limit)


def outcomes(calls: DataFrame) -> DataFrame:
    """Edits by file, commits by sha and tests by runner, in each session."""
    base = {"branch": "string", "added": "bigint", "removed": "bigint", "passed": "bigint", "failed": "bigint"}
    shape = lambda df, kind: df.select(F.lit(kind).alias("kind"), "session_id", "subject", *((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in base.items()), "last")
    edit = calls.where("tool in ('Edit', 'Write', 'MultiEdit', 'NotebookEdit') and file_path is not null").groupBy("session_id", F.col("file_path").alias("subject")).agg(F.sum("lines_added").alias("added"), F.sum("lines_removed").alias("removed"), F.max("ts").alias("last"))
    commit = calls.where("commit_sha is not null").groupBy("session_id", F.col("commit_sha").alias("subject")).agg(F.max("commit_branch").alias("branch"), F.max("ts").alias("last"))
    test = calls.where("test_runner is not null").groupBy("session_id", F.col("test_runner").alias("subject")).agg(F.count_if(F.col("failed") == 0).alias("passed"), F.count_if(F.col("failed") == 1).alias("failed"), F.max("ts").alias("last"))
    return shape(edit, "edit").unionByName(shape(commit, "commit")).unionByName(shape(test, "test"))


def coverage(files_: DataFrame, lines: DataFrame, sessions_: DataFrame, calls: DataFrame, store_start: int) -> DataFrame:
    """Transcripts (root, project, session_id, modified, bytes) that no session or call records, and why.

    lines: (session_id, ts, turn, hook, bad) of each line: whether it is of a turn, names a hook, and could not be read.
    """
    seen = sessions_.select("session_id").union(calls.select("session_id")).distinct()
    of = lines.groupBy("session_id").agg(F.min("ts").alias("started"), F.max(F.col("turn").cast("int")).alias("turn"), F.max(F.col("hook").cast("int")).alias("hook"), F.min(F.col("bad").cast("int")).alias("all_bad"))
    why = F.when(F.col("all_bad").isNull() | (F.col("all_bad") == 1), "unreadable").when(F.col("started") < store_start, "before-store").when(F.coalesce("turn", F.lit(0)) == 0, "no-turn").when(F.col("hook") == 1, "hook-ran").otherwise("no-hook")
    return files_.join(seen, "session_id", "left_anti").join(of, "session_id", "left").select("root", "project", "session_id", "started", "modified", "bytes", why.alias("why"))


def notification_type(detail: Column) -> Column:
    return F.get_json_object(detail, "$.notification_type")


def events(events_: DataFrame) -> DataFrame:
    """Events by kind and the first value they carry."""
    value = F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in ("source", "reason", "trigger", "error_type", "load_reason", "tool", "command_name") if c in events_.columns), notification_type(F.col("detail")))
    return events_.groupBy("event", value.alias("value")).agg(F.count("*").alias("count"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def compactions(compactions_: DataFrame, limit: int | None = LIMIT) -> DataFrame:
    """Compactions, newest first."""
    rows = compactions_.select("entry_id", "session_id", "ts", "trigger", F.col("pre_tokens").alias("before"), F.col("post_tokens").alias("after"), (F.col("pre_tokens") - F.col("post_tokens")).alias("freed"), F.col("cumulative_dropped_tokens").alias("dropped_total"), F.col("duration_ms"))
    return top(rows, [F.desc_nulls_last("ts"), "entry_id"], limit)


EXIT_SLACK = 2_000


def cost_chats(costs: DataFrame, requests: DataFrame, events_: DataFrame, limit: int | None = LIMIT) -> DataFrame:
    """Each chat's priced requests beside its own total. pre_ledger: what of the total no ledger price before its exit covers."""
    ends = events_.where("event = 'SessionEnd'").groupBy("session_id").agg(F.max("ts").alias("ended"))
    c = costs.join(ends, "session_id", "left").withColumn("exit", F.greatest(F.col("started") + F.col("wall_ms"), F.col("ended")))
    c = c.withColumn("exit", F.when(F.col("started").isNotNull() & F.col("wall_ms").isNotNull(), F.col("exit")))
    priced_ = requests.where("cost_usd_micros is not null").join(c.select("session_id", "exit"), "session_id", "left")
    per = priced_.groupBy("session_id").agg(
        F.sum("cost_usd_micros").alias("requests_micros"), F.sum(F.when(F.col("source").eqNullSafe("ledger"), F.col("cost_usd_micros"))).alias("side_micros"),
        F.sum(F.when((F.col("cost_source") == "ledger") & (F.col("ts") <= F.col("exit") + EXIT_SLACK), F.col("cost_usd_micros"))).alias("covered"),
    )
    own = F.round(F.col("cost_usd") * 1_000_000).cast("long")
    rows = c.join(per, "session_id", "full_outer").withColumn("own_micros", own)
    pre = F.when(F.col("exit").isNotNull() & own.isNotNull() & F.col("covered").isNotNull(), F.greatest(own - F.col("covered"), F.lit(0)))
    rows = rows.select("session_id", "requests_micros", "own_micros", (F.col("own_micros") - F.col("requests_micros")).alias("diff_micros"), pre.alias("pre_ledger_micros"), "side_micros", "api_ms", (F.col("api_ms") - F.col("api_no_retry_ms")).alias("retry_ms"), "tool_ms", "wall_ms")
    return top(rows, [F.desc(F.greatest(F.coalesce("requests_micros", F.lit(0)), F.coalesce("own_micros", F.lit(0)))), "session_id"], limit)


def cost_models(costs: DataFrame) -> DataFrame:
    """R20's models: (session_id, model, usd), dearest first inside a chat."""
    return costs.select("session_id", F.explode_outer("model_costs").alias("model", "usd"))


def cost_agents(requests: DataFrame, agents_: DataFrame, limit: int | None = LIMIT) -> DataFrame:
    """Money by chat and agent, by where the price came from."""
    part = lambda c: F.sum(F.when(c, F.col("cost_usd_micros")))
    per = requests.groupBy("session_id", "agent_id").agg(F.sum("cost_usd_micros").alias("micros"), part(F.col("cost_source") == "ledger").alias("ledger_micros"), part(F.col("cost_source") == "table").alias("table_micros"), part(F.col("source") == "ledger").alias("side_micros"))
    rows = per.join(agents_.select("agent_id", "agent_type"), "agent_id", "left").select("session_id", "agent_id", "agent_type", "micros", "ledger_micros", "table_micros", "side_micros")
    return top(rows, [F.desc_nulls_last("micros"), "session_id", F.col("agent_id").asc_nulls_first()], limit)


def cost_calls(requests: DataFrame, limit: int | None = LIMIT) -> DataFrame:
    """The dearest requests, those without a price last."""
    rows = requests.select("request_id", "session_id", "ts", "agent_id", "query_source", "model", "input_tokens", "cache_read_tokens", "cache_creation_tokens", "output_tokens", "cost_usd_micros", "cost_source", F.when(F.col("source").eqNullSafe("ledger"), 1).otherwise(0).alias("side_call"))
    return top(rows, [F.desc_nulls_last("cost_usd_micros"), "request_id"], limit)


def cost_gaps(requests: DataFrame, agents_: DataFrame) -> DataFrame:
    """One row of what prices are missing or are no bill."""
    known = agents_.select("agent_id", F.lit(1).alias("known")).distinct()
    r = requests.join(known, "agent_id", "left")
    gpt, side = F.lower("model").startswith("gpt-"), F.col("source").eqNullSafe("ledger")
    return r.agg(
        F.count_if(F.col("cost_usd_micros").isNull()).alias("unpriced"), F.count_if(side & (F.col("cost_source") == "table")).alias("table_priced_side"),
        F.count_if(F.col("agent_id").isNotNull() & F.col("known").isNull()).alias("unknown_agent"), F.count_if(gpt).alias("list_equivalent"), F.sum(F.when(gpt, F.col("cost_usd_micros"))).alias("list_equivalent_micros"),
    )


def hooks(stop_hooks: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs of each stop hook and how long they took, where measured."""
    rows = runs.join(stop_hooks.select("entry_id"), "entry_id").groupBy("name").agg(F.count("*").alias("runs"), F.count("duration_ms").alias("timed"), F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("max_ms"))
    return rows.withColumn("avg_ms", F.expr("total_ms div timed"))


def turns(turn_durations: DataFrame, turns_: DataFrame, limit: int | None = LIMIT) -> DataFrame:
    """Turns by wall time, with the effort of the latest end of their prompt at or before them (an as-of join by union and window)."""
    keys = ["session_id", "prompt_id"]
    ends = turns_.where("prompt_id is not null and ts is not null").select(*keys, "ts", F.lit(0).alias("kind"), F.col("event_id").alias("id"), F.struct("effort").alias("end"))
    own = turn_durations.select(*keys, "ts", F.lit(1).alias("kind"), F.col("entry_id").alias("id"), "duration_ms", "message_count", "background_agents")
    order = Window.partitionBy(*keys).orderBy("ts", "kind", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = own.unionByName(ends, allowMissingColumns=True).withColumn("last", F.last("end", ignorenulls=True).over(order)).where("kind = 1")
    effort_ = F.when(F.col("ts").isNotNull() & F.col("prompt_id").isNotNull(), F.col("last.effort"))
    rows = both.select(F.col("id").alias("entry_id"), *keys, "ts", "duration_ms", "message_count", "background_agents", effort_.alias("effort"))
    return top(rows, [F.desc("duration_ms"), "entry_id"], limit)


def turn_notes(turn_durations: DataFrame) -> DataFrame:
    """R26's note: one row of count, total, median and 90th percentile."""
    sums = turn_durations.agg(F.count("duration_ms").alias("turns"), F.sum("duration_ms").alias("total_ms"))
    return sums.crossJoin(nearest_ranks(value_counts(turn_durations, [], "duration_ms"), [], "duration_ms", {"p90_ms": 90}, "median_ms")).select("turns", "total_ms", "median_ms", "p90_ms")


def json_number(detail: Column, name: str) -> Column:
    """A field's number; null where it is missing or of another type, as a number in quotes is."""
    v = F.try_parse_json(detail)
    kind = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
    return F.when(kind.rlike(r"^(BIGINT|DECIMAL|DOUBLE|INT|FLOAT)"), F.try_variant_get(v, f"$.{name}", "double"))


def resumes(events_: DataFrame) -> DataFrame:
    """Resumed chats: how long they were idle, what context they reload, and whether the cache was gone."""
    r = events_.where("event = 'SessionStart' and source = 'resume'")
    v = F.try_parse_json("detail")
    flag = F.schema_of_variant(F.try_variant_get(v, "$.prompt_cache_likely_expired", "variant")) == "BOOLEAN"
    return r.select(
        "event_id", "session_id", "ts", json_number(F.col("detail"), "seconds_since_last_response").alias("idle_s"), json_number(F.col("detail"), "context_tokens").alias("context_tokens"),
        F.when(flag, F.try_variant_get(v, "$.prompt_cache_likely_expired", "boolean")).alias("cache_expired"), json_number(F.col("detail"), "estimated_cache_write_usd").alias("cache_write_usd"),
    )


def waiting(events_: DataFrame, requests: DataFrame) -> DataFrame:
    """How long each session waited on its user, by kind.

    The next prompt and the next request after a notification are forward as-of lookups: a minimum over later rows of one
    window in time order over the union of the three kinds of row.
    """
    e = events_.where("session_id is not null and ts is not null")
    note = e.where("event = 'Notification'").select("session_id", "ts", notification_type(F.col("detail")).alias("kind")).where("kind in ('idle_prompt', 'permission_prompt')")
    marks = e.where("event = 'UserPromptSubmit'").select("session_id", "ts", F.col("ts").alias("prompt_ts"))
    asked = requests.where(not_ledger()).where("ts is not null").select("session_id", "ts", F.col("ts").alias("request_ts"))
    later = Window.partitionBy("session_id").orderBy("ts").rangeBetween(1, Window.unboundedFollowing)
    all_ = note.unionByName(marks, allowMissingColumns=True).unionByName(asked, allowMissingColumns=True)
    all_ = all_.select("session_id", "ts", "kind", F.min("prompt_ts").over(later).alias("prompt"), F.min("request_ts").over(later).alias("request")).where("kind is not null")
    end = F.when(F.col("kind") == "permission_prompt", F.least("prompt", "request")).otherwise(F.col("prompt"))
    waits = all_.groupBy("session_id", "kind", end.alias("end")).agg(F.min("ts").alias("start")).withColumn("ms", F.col("end") - F.col("start"))
    return waits.groupBy("session_id", "kind").agg(F.count("*").alias("waits"), F.count_if(F.col("end").isNull()).alias("open"), F.sum("ms").alias("total_ms"), F.median("ms").alias("median_ms"), F.max("ms").alias("max_ms"))


def cache(cache_: DataFrame, requests: DataFrame) -> DataFrame:
    """Settled requests by party, lifetime, outcome and cause."""
    party = F.when(F.col("agent_id").isNull(), "(main)").otherwise("sub-agent")
    rows = cache_.join(requests.select("request_id", "agent_id"), "request_id")
    return rows.groupBy(party.alias("party"), "entry_ttl", "outcome", "cause").agg(F.count("*").alias("requests"))
