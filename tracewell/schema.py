"""The fifteen tables of the store, and what brings any frame into their shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns by table. Times are Unix milliseconds, money is USD micros, 0/1 flags are ints, null means unknown.
DDL = {
    "calls": "tool_use_id string, session_id string, agent_id string, agent_type string, request_id string, prompt_id string, ts bigint, duration_ms bigint, tool string, input string, cwd string, failed int, is_interrupt int, error string, bytes_real bigint, bytes_delivered bigint, persisted_path string, file_path string, file_bytes bigint, file_bytes_before bigint, read_start bigint, read_lines bigint, read_total_lines bigint, lines_added bigint, lines_removed bigint, commit_sha string, commit_branch string, test_runner string, effort string, permission_mode string, result_tokens bigint, result_basis string, result_write_micros bigint, outcome string, source string, seat_dir string",
    "requests": "request_id string, session_id string, agent_id string, prompt_id string, ts bigint, model string, stop_reason string, pending int, input_tokens bigint, cache_read_tokens bigint, cache_creation_tokens bigint, cache_creation_5m_tokens bigint, cache_creation_1h_tokens bigint, context_tokens bigint, output_tokens bigint, thinking_tokens bigint, api_request_id string, cost_usd_micros bigint, cost_source string, query_source string, source string, calls bigint, speed string, seat_dir string",
    "agents": "agent_id string, session_id string, agent_type string, model string, prompt_id string, parent_tool_use_id string, started bigint, stopped bigint, total_tokens bigint, tool_uses bigint, transcript_path string, source string",
    "agent_turns": "agent_id string, seq int, session_id string, agent_type string, prompt_id string, started bigint, stopped bigint, start_event_id string, stop_event_id string",
    "turns": "event_id string, event string, session_id string, agent_id string, prompt_id string, ts bigint, effort string, permission_mode string, last_assistant_message_bytes bigint, stop_hook_active int, background_tasks string, session_crons string",
    "events": "event_id string, event string, session_id string, agent_id string, prompt_id string, ts bigint, source string, reason string, trigger string, error_type string, load_reason string, memory_type string, file_path string, command_name string, tool string, prompt_bytes bigint, effort string, permission_mode string, detail string",
    "sessions": "session_id string, first_ts bigint, last_ts bigint, model string, start_source string, end_reason string, cwd string, cwd_ts bigint, transcript_path string, transcript_path_ts bigint, host string, host_ts bigint, tz_name string, tz_name_ts bigint, tz_offset_minutes int, engine string, engine_ts bigint",
    "command_parts": "tool_use_id string, seq int, lang string, program string, args string, files string, conditional int, parse_status string, parser int",
    "faults": "fault_id string, ts bigint, session_id string, tool_use_id string, stage string, error string",
    "compactions": "entry_id string, session_id string, agent_id string, ts bigint, trigger string, pre_tokens bigint, post_tokens bigint, cumulative_dropped_tokens bigint, duration_ms bigint",
    "session_costs": "session_id string, ts bigint, started bigint, cost_usd double, api_ms bigint, api_no_retry_ms bigint, tool_ms bigint, wall_ms bigint, model_costs map<string,double>",
    "stop_hooks": "entry_id string, session_id string, agent_id string, prompt_id string, ts bigint, hook_count bigint, hook_errors bigint",
    "stop_hook_runs": "entry_id string, seq int, ts bigint, name string, duration_ms bigint",
    "turn_durations": "entry_id string, session_id string, agent_id string, prompt_id string, ts bigint, duration_ms bigint, message_count bigint, background_agents bigint",
    "request_iterations": "request_id string, seq int, ts bigint, type string, model string, input_tokens bigint, cache_read_tokens bigint, cache_creation_tokens bigint, cache_creation_5m_tokens bigint, cache_creation_1h_tokens bigint, output_tokens bigint",
}

KEYS = {
    "calls": ["tool_use_id"], "requests": ["request_id"], "agents": ["agent_id"], "agent_turns": ["agent_id", "seq"], "turns": ["event_id"],
    "events": ["event_id"], "sessions": ["session_id"], "command_parts": ["tool_use_id", "seq"], "faults": ["fault_id"], "compactions": ["entry_id"],
    "session_costs": ["session_id"], "stop_hooks": ["entry_id"], "stop_hook_runs": ["entry_id", "seq"], "turn_durations": ["entry_id"], "request_iterations": ["request_id", "seq"],
}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """df with exactly the table's columns: missing ones are typed nulls, others are dropped."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(table)))


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def not_ledger(column: str | Column = "source") -> Column:
    """True for every source but `ledger`, an unknown one included."""
    return ~(F.col(column) if isinstance(column, str) else column).eqNullSafe("ledger")
