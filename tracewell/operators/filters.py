"""Filters and shared report operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.schema import not_ledger

LIMIT = 25


@dataclass(frozen=True)
class Filter:
    since: int | None = None  # Unix milliseconds
    project: str | None = None  # a cwd, or one above it
    agent_type: str | None = None
    session: str | None = None
    limit: int = LIMIT


def under(cwd: str, project: str) -> Column:
    return (F.col(cwd) == project) | F.startswith(F.col(cwd), F.lit(project.rstrip("/") + "/"))


def call_filter(calls: DataFrame, f: Filter) -> DataFrame:
    """calls of the window; without a time a call is in no window."""
    for wanted, condition in (
        (f.since, F.col("ts") >= f.since), (f.project, under("cwd", f.project or "")), (f.agent_type, F.col("agent_type") == f.agent_type), (f.session, F.col("session_id") == f.session),
    ):
        if wanted is not None:
            calls = calls.where(condition)
    return calls


def scoped_filter(table: DataFrame, f: Filter, sessions: DataFrame, calls: DataFrame, ts: str = "ts") -> DataFrame:
    """rows of a table without cwd; for a project, those whose session is seen under it in sessions or calls."""
    if f.since is not None:
        table = table.where(F.col(ts) >= f.since)
    if f.session is not None:
        table = table.where(F.col("session_id") == f.session)
    if f.project is not None:
        seen = sessions.where(under("cwd", f.project)).select("session_id").union(calls.where(under("cwd", f.project)).select("session_id"))
        table = table.join(seen.distinct(), "session_id", "left_semi")
    return table


def request_filter(requests: DataFrame, calls: DataFrame, f: Filter) -> DataFrame:
    """with a project or an agent type a request counts only if a call of it matches."""
    if f.since is not None:
        requests = requests.where(F.col("ts") >= f.since)
    if f.session is not None:
        requests = requests.where(F.col("session_id") == f.session)
    if f.project is not None or f.agent_type is not None:
        requests = requests.join(call_filter(calls, Filter(project=f.project, agent_type=f.agent_type)), "request_id", "left_semi")
    return requests


def top(df: DataFrame, order: Sequence[Column | str], limit: int | None = LIMIT) -> DataFrame:
    """the first rows in a total order; None gives all."""
    return df if limit is None else df.orderBy(*order).limit(limit)


def size_sum(name: str) -> list[Column]:
    """a sum of sizes with how many are known and how many are not."""
    return [F.sum(name).alias(name), F.count(name).alias(f"{name}_known"), F.count_if(F.col(name).isNull()).alias(f"{name}_unknown")]


#: Values whose upper bits are the same are counted up in one task.
LOW_BITS = 16


def value_counts(df: DataFrame, keys: Sequence[str], name: str, *more: Column) -> DataFrame:
    """(keys, name, n, more): how often each value of a column occurs in a group, and other sums of these rows; so a value that is common is counted where it lies."""
    return df.groupBy(*keys, name).agg(F.count("*").alias("n"), *more)


def nearest_ranks(counts: DataFrame, keys: Sequence[str], name: str, percents: Mapping[str, float], median: str | None = None) -> DataFrame:
    """for each group of value_counts() of a whole-number column, by name the smallest value that at least so many percent of the values do not exceed, and the median (of an even number the mean of the middle two).

    Nulls are no values; a group of nulls has nulls. A group may have any number of values: they are dealt by their upper bits, counted up inside these, and over the blocks of upper
    bits, so no task needs all values of a group.
    """
    c = counts.where(F.col(name).isNotNull()).select(*keys, F.col(name).cast("bigint").alias("_v"), "n").withColumn("_block", F.shiftright("_v", LOW_BITS))
    blocks = c.groupBy(*keys, "_block").agg(F.sum("n").alias("_n"))
    of_group = Window.partitionBy(*(keys or [F.lit(0)]))
    blocks = blocks.select(*(F.col(k).alias(f"_key_{k}") for k in keys), F.col("_block").alias("_at"), (F.sum("_n").over(of_group.orderBy("_block")) - F.col("_n")).alias("_before"), F.sum("_n").over(of_group).alias("_total"))
    same = reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"_key_{k}")), keys, F.col("_block") == F.col("_at"))
    inside = F.sum("n").over(Window.partitionBy(*keys, "_block").orderBy("_v"))
    upto = c.withColumn("_inside", inside).join(blocks, same).withColumn("_upto", F.col("_before") + F.col("_inside"))
    at_rank = lambda rank: F.min(F.when(F.col("_upto") >= rank, F.col("_v")))
    found = [at_rank(F.ceil(F.col("_total") * F.lit(p) / 100)).alias(a) for a, p in percents.items()]
    if median is not None:
        found.append(((at_rank(F.floor((F.col("_total") + 1) / 2)) + at_rank(F.floor(F.col("_total") / 2) + 1)) / 2).alias(median))
    found = upto.groupBy(*keys).agg(*found)
    if not keys:
        return found
    groups = counts.select(*keys).distinct()
    found = found.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    return groups.join(found, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys)), "left").drop(*(f"_key_{k}" for k in keys))


def recording_notes(faults: DataFrame, calls: DataFrame) -> DataFrame:
    """F08 (kind, count): calls that faults name and no row holds, lost tool events without an id, and other faults by stage."""
    lost = faults.where("tool_use_id is not null").select("tool_use_id").distinct().join(calls.select("tool_use_id"), "tool_use_id", "left_anti")
    counts = faults.agg(
        F.count_if(F.col("tool_use_id").isNull() & F.col("error").startswith("PostToolUse")).alias("lost tool events"),
        F.count_if(F.col("stage") == "binary").alias("binary"),
        F.count_if(F.col("stage") == "terminated").alias("terminated"),
        F.count_if(F.col("stage").isin("payload", "store", "transcript")).alias("other faults"),
        F.count_if(F.col("stage") == "parse").alias("parse"),
    )
    kinds = counts.select(F.inline(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(f"`{c}`").alias("count")) for c in counts.columns))))
    return lost.agg(F.lit("lost calls").alias("kind"), F.count("*").alias("count")).unionByName(kinds)


def pending_notes(requests: DataFrame, faults: DataFrame, events: DataFrame) -> DataFrame:
    """F09 (reason, count) of pending requests: their session's transcript faulted, the session ended after them, or it is live."""
    waiting = requests.where("pending = 1")
    bad = faults.where("stage = 'transcript' and session_id is not null").select("session_id").distinct().withColumn("bad", F.lit(True))
    ended = events.where("event = 'SessionEnd'").groupBy("session_id").agg(F.max("ts").alias("ended"))
    reason = F.when(F.col("bad"), "transcript faulted").when(F.col("ended") >= F.col("ts"), "session ended").otherwise("still live")
    return waiting.join(bad, "session_id", "left").join(ended, "session_id", "left").groupBy(reason.alias("reason")).agg(F.count("*").alias("count"))


def gap_notes(calls: DataFrame, parts: DataFrame) -> DataFrame:
    """F10 (kind, label, count): what the window's calls lack: a time, a delivered size, parsed parts."""
    no_ts = calls.where("ts is null").groupBy(F.lit("no time").alias("kind"), F.col("tool").alias("label")).agg(F.count("*").alias("count"))
    reason = F.when(F.col("failed").isNull(), "no outcome").when(F.col("error").isNotNull(), "refused or failed").otherwise("no result")
    no_size = calls.where("bytes_delivered is null").groupBy(F.lit("no delivered size").alias("kind"), reason.alias("label")).agg(F.count("*").alias("count"))
    status = parts.where("parse_status <> 'ok'").join(calls.select("tool_use_id"), "tool_use_id", "left_semi")
    status = status.groupBy(F.lit("unparsed").alias("kind"), F.col("parse_status").alias("label")).agg(F.count("*").alias("count"))
    never = calls.where("tool = 'Bash'").join(parts.select("tool_use_id"), "tool_use_id", "left_anti")
    never = never.groupBy(F.lit("never parsed").alias("kind"), F.lit("Bash").alias("label")).agg(F.count("*").alias("count"))
    return no_ts.unionByName(no_size).unionByName(status).unionByName(never)


def utc(ms: Column) -> Column:
    """a time as text, - where unknown."""
    days, rest = F.floor(ms / 86_400_000), F.pmod(ms, F.lit(86_400_000))
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int")), "yyyy-MM-dd")
    clock = F.format_string("%02d:%02d:%02d", F.floor(rest / 3_600_000), F.floor(rest / 60_000) % 60, F.floor(rest / 1000) % 60)
    return F.coalesce(F.concat(day, F.lit(" "), clock), F.lit("-"))


def seconds(ms: Column) -> Column:
    """seconds with one decimal."""
    return F.coalesce(F.format_string("%.1f", ms / 1000), F.lit("-"))


def duration(ms: Column) -> Column:
    """as 2h03m, 4m05s or 7s."""
    s = F.floor(ms / 1000)
    text = F.when(s >= 3600, F.format_string("%dh%02dm", F.floor(s / 3600), F.floor(s / 60) % 60)).when(s >= 60, F.format_string("%dm%02ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%ds", s))
    return F.when(ms.isNull(), "-").otherwise(text)


def usd(micros: Column) -> Column:
    return F.when(micros.isNull(), "unknown").otherwise(F.format_string("%.4f", micros / 1_000_000))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.format_string("%.1f", 100 * part / whole)).otherwise("-")


def settled(requests: DataFrame) -> DataFrame:
    """Requests that are not pending and that a transcript or a hook gave."""
    return requests.where((F.coalesce("pending", F.lit(0)) != 1) & not_ledger())
