"""The documented queries over the store (Q01-Q12). Times are parameters: `now` and `since` in Unix milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.filters import settled, top
from tracewell.tables import saved

DAY = 86_400_000


def agent_name(column: str = "agent_id") -> Column:
    return F.coalesce(F.col(column), F.lit("(main)")).alias("agent")


def spend_per_agent(requests: DataFrame, agents: DataFrame, session_id: str, limit: int = 30) -> DataFrame:
    """Q01: spend and peak context of each agent of a session, the main chat included."""
    r = settled(requests).where(F.col("session_id") == session_id).join(agents.select("agent_id", "agent_type"), "agent_id", "left")
    sums = {"output": "output_tokens", "thinking": "thinking_tokens", "cache_read": "cache_read_tokens", "cache_write": "cache_creation_tokens"}
    rows = r.groupBy("agent_id").agg(F.max("agent_type").alias("agent_type"), F.count("*").alias("requests"), F.max("context_tokens").alias("peak_context"), *(F.sum(c).alias(a) for a, c in sums.items()))
    return top(rows.select(agent_name(), *rows.columns[1:]), [F.desc_nulls_last("peak_context"), "agent"], limit)


def money_per_party(requests: DataFrame, agents: DataFrame, session_id: str, limit: int = 30) -> DataFrame:
    """Q02: money of each party of a session, side calls included; the dollars are a floor wherever unpriced is above 0."""
    r = requests.where((F.col("session_id") == session_id) & (F.col("pending") == 0)).join(agents.select("agent_id", "agent_type"), "agent_id", "left")
    rows = r.groupBy("agent_id").agg(
        F.max("agent_type").alias("agent_type"), F.count("*").alias("requests"), F.count_if(F.col("source") == "ledger").alias("side_calls"), F.round(F.coalesce(F.sum("cost_usd_micros"), F.lit(0)) / 1e6, 4).alias("usd"),
        F.count_if(F.col("cost_usd_micros").isNull()).alias("unpriced"), F.array_join(F.array_sort(F.collect_set("cost_source")), ",").alias("price_from"),
    )
    return top(rows.select(agent_name(), *rows.columns[1:]), [F.desc("usd"), "agent"], limit)


def agent_calls(calls: DataFrame, agents: DataFrame, session_id: str, limit: int = 50) -> DataFrame:
    """Q03: each Agent call of a session and the agent that it started."""
    c = calls.where((F.col("session_id") == session_id) & F.col("tool").isin("Agent", "Task")).select("tool_use_id", "agent_id", "input", "ts")
    a = agents.select(F.col("parent_tool_use_id").alias("tool_use_id"), F.col("agent_id").alias("started_agent"), F.col("model").alias("agent_model"), "started", "stopped", "total_tokens", "tool_uses")
    rows = c.join(a, "tool_use_id", "left").select(
        "tool_use_id", F.coalesce("agent_id", F.lit("(main)")).alias("spawned_by"), F.get_json_object("input", "$.subagent_type").alias("type"), F.coalesce("agent_model", F.get_json_object("input", "$.model")).alias("model"),
        "started_agent", "started", F.round((F.col("stopped") - F.col("started")) / 60000, 1).alias("wall_min"), "total_tokens", "tool_uses", "ts",
    )
    return top(rows, [F.asc_nulls_first("ts"), "tool_use_id", "started_agent"], limit)


def descendants(calls: DataFrame, agents: DataFrame, agent_id: str) -> DataFrame:
    """(agent_id, depth): an agent and all that it started, theirs included.

    Agents that started none are left aside, and follow the one that started them at the end. Pointers of the others to who started whom are doubled: after k rounds an agent's pointer is 2^k steps up, or at
    the agent asked for, where it stops, and the agent is written for good. Agents whose pointer has come to the top of another tree are left out of the next round, so few are left of shallow trees, and a
    chain of n takes log n rounds. A circle that does not hold the agent never ends; rounds end once they reach further than there are agents. An agent that several calls claim to have started belongs to the smallest of their agents.
    """
    spark = calls.sparkSession
    by = calls.select(F.col("tool_use_id").alias("parent_tool_use_id"), F.col("agent_id").alias("at"))
    up = agents.join(by, "parent_tool_use_id").where((F.col("agent_id") != agent_id) & F.col("at").isNotNull()).groupBy("agent_id").agg(F.min("at").alias("at"))
    up = saved(up)
    inner = up.select(F.col("at").alias("agent_id")).distinct().withColumn("starts", F.lit(True))
    up = saved(up.join(inner, "agent_id", "left"))
    leaves, up = up.where("starts is null").drop("starts"), up.where("starts").select("agent_id", "at", F.lit(1).alias("steps"))
    most, reach, home = up.count(), 1, F.col("at") == agent_id
    found, rest = up.where(home), up.where(~home)
    while reach <= most and not rest.isEmpty():
        further = found.unionByName(rest).select(F.col("agent_id").alias("at"), F.col("at").alias("above"), F.col("steps").alias("more"))
        moved = saved(rest.join(further, "at").select("agent_id", F.col("above").alias("at"), (F.col("steps") + F.col("more")).alias("steps")))
        found, rest, reach = found.unionByName(saved(moved.where(home))), moved.where(~home), 2 * reach
    root = spark.range(1).select(F.lit(agent_id).alias("agent_id"), F.lit(0).alias("depth"))
    tree = root.unionByName(found.select("agent_id", F.col("steps").alias("depth")))
    return tree.unionByName(leaves.join(tree.withColumnRenamed("agent_id", "at"), "at").select("agent_id", (F.col("depth") + 1).alias("depth")))


def family(requests: DataFrame, calls: DataFrame, agents: DataFrame, agent_id: str) -> DataFrame:
    """Q04: totals of an agent and all its descendants."""
    tree = descendants(calls, agents, agent_id)
    return tree.join(settled(requests).select("agent_id", "request_id", "output_tokens", "context_tokens"), "agent_id", "left").agg(
        F.count_distinct("agent_id").alias("agents"), F.max("depth").alias("depth"), F.count("request_id").alias("requests"), F.sum("output_tokens").alias("output"), F.max("context_tokens").alias("peak_context"))


def tool_mix(calls: DataFrame, agent_id: str) -> DataFrame:
    """Q05: an agent's calls by tool."""
    return calls.where(F.col("agent_id") == agent_id).groupBy("tool").agg(F.count("*").alias("calls"), F.sum("failed").alias("failed"), F.round(F.sum("duration_ms") / 60000, 1).alias("tool_min"), F.sum("bytes_delivered").alias("bytes_into_context"))


def slowest_calls(calls: DataFrame, agent_id: str, limit: int = 10) -> DataFrame:
    """Q05: an agent's slowest calls."""
    what = F.substring(F.replace(F.coalesce(F.get_json_object("input", "$.command"), "file_path", F.lit("")), F.lit("\n"), F.lit(" ")), 1, 120)
    rows = calls.where(F.col("agent_id") == agent_id).select("tool_use_id", F.round(F.col("duration_ms") / 1000, 1).alias("secs"), "tool", what.alias("what"), "duration_ms")
    return top(rows, [F.desc_nulls_last("duration_ms"), "tool_use_id"], limit)


def bytes_by_tool(calls: DataFrame, since: int, limit: int = 15) -> DataFrame:
    """Q06: which tools put the most bytes into the context."""
    rows = calls.where(F.col("ts") >= since).groupBy("tool").agg(F.count("*").alias("calls"), F.sum("bytes_delivered").alias("bytes"), F.max("bytes_delivered").alias("largest"), F.count("persisted_path").alias("spilled_to_file"))
    return top(rows, [F.desc_nulls_last("bytes"), "tool"], limit)


def latest_compactions(compactions: DataFrame, limit: int = 20) -> DataFrame:
    """Q07: compactions, newest first."""
    rows = compactions.select("entry_id", "ts", "session_id", agent_name(), "trigger", "pre_tokens", "post_tokens", (F.col("pre_tokens") - F.col("post_tokens")).alias("freed"), F.round(F.col("duration_ms") / 1000, 1).alias("secs"))
    return top(rows, [F.desc_nulls_last("ts"), "entry_id"], limit)


def cache_outcomes(cache: DataFrame, requests: DataFrame, since: int) -> DataFrame:
    """Q08: prompt-cache outcomes of parties in a window; an empty outcome is an unknown count, never a miss."""
    party = F.when(F.col("agent_id").isNull(), "(main)").otherwise("sub-agent").alias("party")
    return cache.join(requests.where(F.col("ts") >= since).select("request_id", "agent_id"), "request_id").groupBy(party, "entry_ttl", "outcome", "cause").agg(F.count("*").alias("requests"))


def cost_by_model(costs: DataFrame, limit: int | None = 30) -> DataFrame:
    """Q09: cost of each session, and of each model in it where there is a split."""
    rows = costs.select("session_id", "cost_usd", F.round("cost_usd", 2).alias("usd"), F.round(F.col("wall_ms") / 3_600_000, 2).alias("wall_h"), F.round(F.col("api_ms") / 3_600_000, 2).alias("api_h"), F.explode_outer("model_costs").alias("model", "value"))
    rows = rows.withColumn("model_usd", F.round("value", 2))
    return top(rows, [F.desc("cost_usd"), F.desc_nulls_last("value"), "session_id", "model"], limit).drop("cost_usd", "value")


def without_stop(agents: DataFrame, calls: DataFrame, session_id: str, now: int, limit: int = 20) -> DataFrame:
    """Q10: sub-agents of a session without a recorded stop, and the minutes since their last call."""
    last = calls.groupBy("session_id", "agent_id").agg(F.max("ts").alias("last"))
    rows = agents.where((F.col("session_id") == session_id) & F.col("stopped").isNull()).join(last, ["session_id", "agent_id"], "left")
    return top(rows.select("agent_id", "agent_type", "started", F.round((F.lit(now) - F.col("last")) / 60000).alias("min_since_last_call")), [F.desc("started"), "agent_id"], limit)


def agent_counts(agents: DataFrame, session_id: str) -> DataFrame:
    """Q10: a session's agents, and how many have no stop."""
    return agents.where(F.col("session_id") == session_id).agg(F.count("*").alias("agents_in_session"), F.count_if(F.col("stopped").isNull()).alias("without_stop"), F.max("started").alias("latest_start"))


def turns_of_session(events: DataFrame, turn_durations: DataFrame, session_id: str, limit: int = 20) -> DataFrame:
    """Q11: the turns of a session: what was submitted into each, and its wall time."""
    e = events.where((F.col("session_id") == session_id) & (F.col("event") == "UserPromptSubmit"))
    e = e.groupBy("session_id", "prompt_id").agg(F.min("ts").alias("first"), F.count("*").alias("submits"), F.sum("prompt_bytes").alias("prompt_bytes"))
    d = turn_durations.where("prompt_id is not null").groupBy("session_id", "prompt_id").agg(F.round(F.sum("duration_ms") / 1000, 1).alias("wall_s"))
    return top(e.join(d, ["session_id", "prompt_id"], "left").drop("session_id"), [F.desc("first"), "prompt_id"], limit)


def peak_percentiles(requests: DataFrame, agents: DataFrame, since: int) -> DataFrame:
    """Q12: interpolated percentiles of the peak context of each agent type."""
    peaks = settled(requests).where(F.col("ts") >= since).join(agents.select("agent_id", "agent_type"), "agent_id").groupBy("agent_id").agg(F.max("context_tokens").alias("peak"), F.max("agent_type").alias("agent_type"))
    return peaks.groupBy(F.coalesce("agent_type", F.lit("?")).alias("agent_type")).agg(F.count("*").alias("n"), F.round(F.percentile("peak", F.lit(0.5)), 4).alias("p50"), F.round(F.percentile("peak", F.lit(0.9)), 4).alias("p90"), F.max("peak").alias("max"))
