"""Every registered query of the report engine, with the SQL that DuckDB checks it by.

A query is a function of the stand-in views; its SQL names views and driver tables in braces.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import derive, filters
from tracewell.operators.filters import Filter
from tracewell.plans import reports as R
from tracewell.plans.standins import StandIns, with_views

Query = Callable[[StandIns], DataFrame]
CATALOG: dict[str, tuple[Query, str | None]] = {}


def entry(name: str, query: Query, sql: str | None = None) -> None:
    CATALOG[name] = (query, with_views(sql) if sql else None)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, q=q: q(StandIns(spark, sf_dir))) for name, (q, _) in CATALOG.items()}


def oracles() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOG.items() if sql}


SETTLED = "coalesce(pending, 0) <> 1 AND source IS DISTINCT FROM 'ledger'"

CACHE_SQL = f"""
  p AS (SELECT *, lag(request_id) OVER w AS prev_id, lag(ts) OVER w AS prev_ts, lag(model) OVER w AS prev_model, lag(context_tokens) OVER w AS expected_read
        FROM {{requests}} WHERE {SETTLED} AND ts IS NOT NULL WINDOW w AS (PARTITION BY session_id, agent_id ORDER BY ts, request_id)),
  wr AS (SELECT a.request_id, arg_max(CASE WHEN b.cache_creation_5m_tokens > 0 AND b.cache_creation_1h_tokens > 0 THEN 'mixed' WHEN b.cache_creation_1h_tokens > 0 THEN '1h' WHEN b.cache_creation_5m_tokens > 0 THEN '5m' ELSE '' END, (b.ts, b.request_id)) AS ttl
         FROM p a JOIN p b ON a.session_id = b.session_id AND a.agent_id IS NOT DISTINCT FROM b.agent_id AND b.cache_creation_tokens > 0 AND (b.ts < a.ts OR (b.ts = a.ts AND b.request_id < a.request_id)) GROUP BY a.request_id),
  jd AS (SELECT p.*, p.ts - prev_ts AS gap_ms, nullif(wr.ttl, '') AS entry_ttl,
              CASE WHEN prev_id IS NULL THEN 'first' WHEN expected_read IS NULL OR cache_read_tokens IS NULL THEN NULL WHEN cache_read_tokens * 100 >= expected_read * 95 THEN 'hit' WHEN cache_read_tokens * 100 >= expected_read * 50 THEN 'partial' ELSE 'miss' END AS outcome
        FROM p LEFT JOIN wr ON wr.request_id = p.request_id),
  rc AS (SELECT request_id, agent_id, ts, gap_ms, entry_ttl, expected_read, outcome,
              CASE WHEN outcome IS NULL OR outcome NOT IN ('partial', 'miss') THEN NULL WHEN model <> prev_model THEN 'model_changed'
                   WHEN EXISTS (SELECT 1 FROM {{compactions}} c WHERE c.session_id = jd.session_id AND c.agent_id IS NOT DISTINCT FROM jd.agent_id AND c.ts > jd.prev_ts AND c.ts <= jd.ts) THEN 'compacted'
                   WHEN gap_ms > CASE entry_ttl WHEN '1h' THEN 3600000 WHEN '5m' THEN 300000 WHEN 'mixed' THEN 300000 END THEN 'expired' ELSE 'unknown' END AS cause
        FROM jd)"""

entry("m17_request_cache", lambda S: derive.request_cache(S.requests, S.compactions), f"WITH {CACHE_SQL} SELECT request_id, gap_ms, entry_ttl, expected_read, outcome, cause FROM rc")
entry("r29_cache", lambda S: R.cache(derive.request_cache(S.requests, S.compactions), S.requests), f"WITH {CACHE_SQL} SELECT CASE WHEN agent_id IS NULL THEN '(main)' ELSE 'sub-agent' END AS party, entry_ttl, outcome, cause, count(*) AS requests FROM rc GROUP BY ALL")

# Filters
SINCE = 850_000_000_000
entry("f02_call_filter", lambda S: filters.call_filter(S.calls, Filter(since=SINCE, project="/home/u/proj1", agent_type="explore")).groupBy("session_id").agg(F.count("*").alias("calls")),
      f"SELECT session_id, count(*) AS calls FROM {{calls}} WHERE ts >= {SINCE} AND (cwd = '/home/u/proj1' OR starts_with(cwd, '/home/u/proj1/')) AND agent_type = 'explore' GROUP BY 1")
entry("f03_scoped_filter", lambda S: filters.scoped_filter(S.hook_events, Filter(since=1_704_500_000_000, project="/home/u/proj2"), S.sessions, S.calls).select("event_id", "session_id", "event"),
      "SELECT event_id, session_id, event FROM {hook_events} WHERE ts >= 1704500000000 AND session_id IN (SELECT session_id FROM {sessions} WHERE cwd = '/home/u/proj2' OR starts_with(cwd, '/home/u/proj2/') UNION SELECT session_id FROM {calls} WHERE cwd = '/home/u/proj2' OR starts_with(cwd, '/home/u/proj2/'))")
entry("f04_request_filter", lambda S: filters.request_filter(S.requests, S.calls, Filter(agent_type="review")).groupBy("model").agg(F.count("*").alias("requests")),
      "SELECT model, count(*) AS requests FROM {requests} WHERE request_id IN (SELECT request_id FROM {calls} WHERE agent_type = 'review') GROUP BY 1")
entry("f07_top", lambda S: filters.top(S.calls.select("tool_use_id", "bytes_delivered"), [F.desc_nulls_last("bytes_delivered"), "tool_use_id"], 25), "SELECT tool_use_id, bytes_delivered FROM {calls} ORDER BY bytes_delivered DESC NULLS LAST, tool_use_id LIMIT 25")
entry("f08_recording_notes", lambda S: filters.recording_notes(S.faults, S.calls),
      """SELECT 'lost calls' AS kind, count(*) AS count FROM (SELECT DISTINCT tool_use_id FROM {faults} WHERE tool_use_id IS NOT NULL) f WHERE NOT EXISTS (SELECT 1 FROM {calls} c WHERE c.tool_use_id = f.tool_use_id)
      UNION ALL SELECT 'lost tool events', count(*) FROM {faults} WHERE tool_use_id IS NULL AND error LIKE 'PostToolUse%' UNION ALL SELECT 'binary', count(*) FROM {faults} WHERE stage = 'binary' UNION ALL SELECT 'terminated', count(*) FROM {faults} WHERE stage = 'terminated'
      UNION ALL SELECT 'other faults', count(*) FROM {faults} WHERE stage IN ('payload', 'store', 'transcript') UNION ALL SELECT 'parse', count(*) FROM {faults} WHERE stage = 'parse'""")
entry("f09_pending_notes", lambda S: filters.pending_notes(S.requests, S.faults, S.hook_events),
      """SELECT CASE WHEN EXISTS (SELECT 1 FROM {faults} f WHERE f.stage = 'transcript' AND f.session_id = r.session_id) THEN 'transcript faulted' WHEN (SELECT max(ts) FROM {hook_events} e WHERE e.event = 'SessionEnd' AND e.session_id = r.session_id) >= r.ts THEN 'session ended' ELSE 'still live' END AS reason, count(*) AS count
      FROM {requests} r WHERE pending = 1 GROUP BY 1""")
entry("f10_gap_notes", lambda S: filters.gap_notes(S.calls, S.command_parts),
      """SELECT 'no time' AS kind, tool AS label, count(*) AS count FROM {calls} WHERE ts IS NULL GROUP BY tool
      UNION ALL SELECT 'no delivered size', CASE WHEN failed IS NULL THEN 'no outcome' WHEN error IS NOT NULL THEN 'refused or failed' ELSE 'no result' END, count(*) FROM {calls} WHERE bytes_delivered IS NULL GROUP BY 2
      UNION ALL SELECT 'unparsed', parse_status, count(*) FROM {command_parts} WHERE parse_status <> 'ok' GROUP BY 2
      UNION ALL SELECT 'never parsed', 'Bash', count(*) FROM {calls} c WHERE tool = 'Bash' AND NOT EXISTS (SELECT 1 FROM {command_parts} p WHERE p.tool_use_id = c.tool_use_id)""")
entry("f11_display", lambda S: S.requests.groupBy("model").agg(F.min("ts").alias("t"), F.sum("cost_usd_micros").alias("m"), F.sum("cache_read_tokens").alias("r"), F.sum("context_tokens").alias("c")).select("model", filters.utc(F.col("t")).alias("first"), filters.usd(F.col("m")).alias("usd"), filters.duration(F.col("m")).alias("as_duration"), filters.percent(F.col("r"), F.col("c")).alias("hit")),
      """SELECT model, strftime(make_timestamp(min(ts) * 1000), '%Y-%m-%d %H:%M:%S') AS first, printf('%.4f', sum(cost_usd_micros) / 1000000) AS usd,
      CASE WHEN sum(cost_usd_micros) // 1000 >= 3600 THEN printf('%dh%02dm', CAST(sum(cost_usd_micros) // 3600000 AS INT), CAST(sum(cost_usd_micros) // 60000 % 60 AS INT)) WHEN sum(cost_usd_micros) // 1000 >= 60 THEN printf('%dm%02ds', CAST(sum(cost_usd_micros) // 60000 AS INT), CAST(sum(cost_usd_micros) // 1000 % 60 AS INT)) ELSE printf('%ds', CAST(sum(cost_usd_micros) // 1000 AS INT)) END AS as_duration,
      printf('%.1f', 100 * sum(cache_read_tokens) / sum(context_tokens)) AS hit FROM {requests} GROUP BY model""")
entry("f12_size_sum", lambda S: S.calls.groupBy("tool").agg(*filters.size_sum("bytes_delivered")), "SELECT tool, isum(bytes_delivered) AS bytes_delivered, count(bytes_delivered) AS bytes_delivered_known, count(*) FILTER (bytes_delivered IS NULL) AS bytes_delivered_unknown FROM {calls} GROUP BY tool")
entry("f13_nearest_rank", lambda S: filters.nearest_ranks(filters.value_counts(S.calls, ["tool"], "duration_ms"), ["tool"], "duration_ms", {f"p{p}": p for p in (50, 90, 95)}, "median_ms"),
      "SELECT tool, quantile_disc(duration_ms, 0.5) AS p50, quantile_disc(duration_ms, 0.9) AS p90, quantile_disc(duration_ms, 0.95) AS p95, median(duration_ms) AS median_ms FROM {calls} GROUP BY tool")

# Call results and prices
RATES = [("1-urgent", 3.0, 0.3, 3.75, 6.0, 15.0, 200_000, 6.0, 22.5), ("2-high", 15.0, 1.5, 18.75, 30.0, 75.0, None, None, None), ("5-low", 1.0, 0.1, 1.25, 2.0, 5.0, None, None, None)]


def rates(S: StandIns) -> DataFrame:
    return S.spark.createDataFrame(RATES, derive.RATES_DDL)


RATES_SQL = "rates(name, i, cr, w5, w1, o, lf, li, lo) AS (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in r) + ")" for r in RATES) + ")"
PRICE_SQL = f"""{RATES_SQL},
 pr AS (SELECT r.*, CASE WHEN context_tokens >= lf THEN li ELSE i END AS i2, CASE WHEN context_tokens >= lf THEN lo ELSE o END AS o2, i AS base, cr, w5, w1,
        CASE WHEN coalesce(cache_creation_5m_tokens, 0) + coalesce(cache_creation_1h_tokens, 0) > 0 THEN coalesce(cache_creation_5m_tokens, 0) ELSE cache_creation_tokens END AS n5,
        CASE WHEN coalesce(cache_creation_5m_tokens, 0) + coalesce(cache_creation_1h_tokens, 0) > 0 THEN coalesce(cache_creation_1h_tokens, 0) ELSE 0 END AS n1
        FROM {{requests}} r LEFT JOIN rates ON lower(r.model) = name),
 px AS (SELECT *, CAST(round(input_tokens * i2 + cache_read_tokens * cr * (i2 / base) + (n5 * w5 * (i2 / base) + n1 * w1 * (i2 / base)) + output_tokens * o2) AS BIGINT) AS table_micros FROM pr)"""
entry("m13_price", lambda S: derive.priced(S.requests, rates(S)).select("request_id", "table_micros"), f"WITH {PRICE_SQL} SELECT request_id, table_micros FROM px")
entry("m14_write_rate", lambda S: derive.priced(S.requests, rates(S)).select("request_id", F.round(F.col("write_rate") * 1e6, 6).alias("write_usd_per_million")),
      f"WITH {PRICE_SQL} SELECT request_id, round(CASE WHEN base IS NULL THEN NULL WHEN n5 + n1 > 0 THEN (n5 * w5 * (i2 / base) + n1 * w1 * (i2 / base)) / (n5 + n1) ELSE w5 * (i2 / base) END / 1000000 * 1e6, 6) AS write_usd_per_million FROM px")
entry("m15_apply_prices", lambda S: derive.apply_prices(S.requests, rates(S)).groupBy("model", "cost_source").agg(F.count("*").alias("n"), F.sum("cost_usd_micros").alias("micros")),
      f"WITH {PRICE_SQL}, q AS (SELECT model, CASE WHEN cost_source = 'ledger' AND cost_usd_micros IS NOT NULL THEN 'ledger' WHEN table_micros IS NOT NULL THEN 'table' ELSE cost_source END AS cost_source, CASE WHEN cost_source = 'ledger' AND cost_usd_micros IS NOT NULL THEN cost_usd_micros ELSE coalesce(table_micros, cost_usd_micros) END AS m FROM px) SELECT model, cost_source, count(*) AS n, isum(m) AS micros FROM q GROUP BY ALL")
entry("m16_call_results", lambda S: derive.call_results(S.calls, S.requests).select("tool_use_id", "result_tokens", "result_basis"),
      """WITH n AS (SELECT request_id, pending, context_tokens, output_tokens, lead(pending) OVER w AS np, lead(context_tokens) OVER w AS nc FROM {requests} WHERE ts IS NOT NULL AND source IS DISTINCT FROM 'ledger' WINDOW w AS (PARTITION BY session_id, agent_id ORDER BY ts, request_id)),
      g AS (SELECT request_id, CASE WHEN pending = 1 OR np = 1 OR nc - context_tokens < -5000 OR nc IS NULL OR context_tokens IS NULL OR output_tokens IS NULL THEN NULL ELSE greatest(nc - context_tokens - output_tokens, 0) END AS growth FROM n),
      c AS (SELECT tool_use_id, request_id, bytes_delivered AS b, count(*) OVER w AS n, count(bytes_delivered) OVER w AS known, sum(bytes_delivered) OVER w AS total, sum(bytes_delivered) OVER (PARTITION BY request_id ORDER BY tool_use_id ROWS UNBOUNDED PRECEDING) AS cum FROM {calls} WINDOW w AS (PARTITION BY request_id)),
      t AS (SELECT tool_use_id, n, CASE WHEN n = 1 THEN growth WHEN known = n AND total > 0 THEN CAST(round(growth * cum / total) - round(growth * (cum - b) / total) AS BIGINT) END AS result_tokens FROM c JOIN g USING (request_id))
      SELECT tool_use_id, result_tokens, CASE WHEN result_tokens IS NOT NULL THEN CASE WHEN n = 1 THEN 'exact' ELSE 'split' END END AS result_basis FROM t""")

# Report topics
FILES_SQL = r"""
 fl AS (SELECT p.tool_use_id, p.conditional, regexp_extract(f, '^([^\t]*)\t([^\t]*)\t([01?])\t(.*)$', 1) AS action, regexp_extract(f, '^([^\t]*)\t([^\t]*)\t([01?])\t(.*)$', 3) AS ex, regexp_extract(f, '^([^\t]*)\t([^\t]*)\t([01?])\t(.*)$', 4) AS path
        FROM (SELECT tool_use_id, conditional, unnest(CAST(files AS JSON)::VARCHAR[]) AS f FROM {command_parts}) p),
 lk AS (SELECT fl.*, c.session_id, c.agent_id, c.ts, c.bytes_delivered FROM fl JOIN {calls} c USING (tool_use_id))"""
entry("r01_files", lambda S: R.files(S.calls, S.command_parts, None), f"""WITH {FILES_SQL},
 al AS (SELECT tool_use_id, count(DISTINCT CASE WHEN action IN ('read-whole', 'read-range', 'search') THEN path END) AS paths, count(*) FILTER (action IN ('exec', 'unknown')) AS runs FROM lk GROUP BY 1),
 bp AS (SELECT tool_use_id, path, min(conditional) AS conditional, min(CASE WHEN action = 'read-whole' THEN 0 ELSE 1 END) AS ranged, max(ex) AS ex, any_value(session_id) AS session_id, any_value(agent_id) AS agent_id, any_value(ts) AS ts, any_value(bytes_delivered) AS b FROM lk WHERE action IN ('read-whole', 'read-range', 'search') GROUP BY 1, 2),
 al2 AS (SELECT file_path AS path, bytes_delivered AS read_bytes, NULL::BIGINT AS bash_bytes, 1 AS certain, 0 AS conditional, session_id, agent_id, CASE WHEN read_start > 1 OR read_lines < read_total_lines THEN 1 ELSE 0 END AS ranged, ts, '1' AS ex, read_total_lines AS lines, 0 AS shell, tool_use_id FROM {{calls}} WHERE tool = 'Read' AND file_path IS NOT NULL
   UNION ALL SELECT path, NULL, CASE WHEN paths = 1 AND runs = 0 THEN b END, 1 - conditional, conditional, session_id, agent_id, ranged, ts, ex, NULL, 1, tool_use_id FROM bp JOIN al USING (tool_use_id)),
 g AS (SELECT path, isum(read_bytes) AS read_bytes, isum(bash_bytes) AS bash_bytes, count(*) AS reads, isum(certain) AS certain, isum(conditional) AS conditional, count(DISTINCT session_id || '/' || coalesce(agent_id, '')) AS agents, isum(1 - ranged) AS whole, isum(ranged) AS ranged FROM al2 GROUP BY 1),
 lx AS (SELECT path, ex, row_number() OVER (PARTITION BY path ORDER BY ts DESC NULLS LAST, shell DESC, tool_use_id DESC) AS n FROM al2),
 ll AS (SELECT path, lines, row_number() OVER (PARTITION BY path ORDER BY ts DESC NULLS LAST, tool_use_id DESC) AS n FROM al2 WHERE lines IS NOT NULL),
 rn AS (SELECT path, count(DISTINCT tool_use_id) AS execs FROM lk WHERE action = 'exec' GROUP BY 1)
 SELECT g.path, read_bytes, bash_bytes, reads, certain, g.conditional, agents, CASE WHEN lx.ex = '0' THEN 'gone' ELSE CAST(ll.lines AS VARCHAR) END AS size, whole, ranged, reads - agents AS re_reads, coalesce(execs, 0) AS execs
 FROM g JOIN lx ON lx.path = g.path AND lx.n = 1 LEFT JOIN ll ON ll.path = g.path AND ll.n = 1 LEFT JOIN rn ON rn.path = g.path""")
entry("r02_writes", lambda S: R.writes(S.calls, S.command_parts, None), f"""WITH {FILES_SQL},
 u AS (SELECT file_path AS path, 1 AS tool, 0 AS bash, file_bytes - file_bytes_before AS growth FROM {{calls}} WHERE tool IN ('Edit', 'Write') AND file_path IS NOT NULL UNION ALL SELECT path, 0, 1, NULL FROM (SELECT DISTINCT tool_use_id, path FROM lk WHERE action = 'write'))
 SELECT path, count(*) AS writes, isum(tool) AS tool, isum(bash) AS bash, isum(growth) AS growth, count(*) FILTER (growth IS NULL) AS growth_unknown FROM u GROUP BY path""")
entry("e23_decode_parts", lambda S: R.decode_parts(S.command_parts).groupBy("program").agg(F.count("*").alias("parts"), F.sum(F.size("files")).alias("files"), F.sum("bad_args").alias("bad_args"), F.sum("bad_files").alias("bad_files")),
      "SELECT program, count(*) AS parts, isum(len(CAST(files AS JSON)::VARCHAR[])) AS files, count(*) FILTER (NOT json_valid(args)) AS bad_args, 0 AS bad_files FROM {command_parts} GROUP BY program")
SHAPE_SQL = """
 sp AS (SELECT tool_use_id, seq, regexp_extract(program, '[^/]*$') AS base, CASE WHEN json_valid(args) THEN coalesce(json_extract_string(args, '$[0]'), '') ELSE '' END AS a, files = '[]' AS none FROM {command_parts}),
 sn AS (SELECT tool_use_id, seq, CASE WHEN a <> '' AND NOT regexp_matches(a, '^-|/|\\.|\\s') THEN base || ' ' || a ELSE base END AS name,
   CASE WHEN base IN ('cd', 'true', 'false', ':', 'set', 'export', 'pwd', 'sleep') THEN 3 WHEN base IN ('echo', 'printf') AND none THEN 2 WHEN base IN ('head', 'tail', 'sort', 'uniq', 'wc', 'grep', 'sed', 'awk', 'tr', 'cut', 'tee', 'cat') AND none THEN 1 ELSE 0 END AS rank FROM sp),
 sk AS (SELECT tool_use_id, name, min(seq) AS seq FROM (SELECT *, min(rank) OVER (PARTITION BY tool_use_id) AS least FROM sn) WHERE rank = least GROUP BY 1, 2),
 sh AS (SELECT tool_use_id, array_to_string(list_slice(list(name ORDER BY seq), 1, 3), ' ; ') AS shape FROM sk GROUP BY 1)"""
entry("r04_call_shape", lambda S: R.call_shape(S.command_parts), f"WITH {SHAPE_SQL} SELECT tool_use_id, shape FROM sh")
entry("r03_commands", lambda S: R.commands(S.calls, S.command_parts, None), f"""WITH {SHAPE_SQL}, c AS (SELECT c.*, shape FROM {{calls}} c JOIN sh USING (tool_use_id) WHERE tool = 'Bash'),
 f AS (SELECT c.shape, count(DISTINCT r.tool_use_id) AS n FROM c JOIN {{calls}} r ON r.tool = 'Read' AND r.file_path = c.persisted_path AND r.session_id = c.session_id AND r.agent_id IS NOT DISTINCT FROM c.agent_id AND r.ts >= c.ts GROUP BY 1)
 SELECT c.shape, count(*) AS calls, isum(bytes_delivered) AS bytes, quantile_disc(bytes_delivered, 0.5) AS p50, quantile_disc(bytes_delivered, 0.95) AS p95, count(*) FILTER (bytes_real >= 20000 AND bytes_real < 30000) AS from_20k_to_30k, count(persisted_path) AS persisted, coalesce(max(f.n), 0) AS follow_up_reads FROM c LEFT JOIN f ON f.shape = c.shape GROUP BY c.shape""")
LABEL_SQL = SHAPE_SQL + """,
 lb AS (SELECT request_id, array_to_string(list_slice(list(what ORDER BY coalesce(ts, 0), tool_use_id), 1, 3), ', ') || CASE WHEN count(*) > 3 THEN ' +' || (count(*) - 3) || ' more' ELSE '' END AS label
   FROM (SELECT c.request_id, c.ts, c.tool_use_id, CASE WHEN tool = 'Bash' THEN 'Bash ' || coalesce(shape, '?') WHEN file_path IS NOT NULL THEN tool || ' ' || file_path ELSE tool END AS what FROM {calls} c LEFT JOIN sh USING (tool_use_id)) GROUP BY 1)"""
entry("r05_context", lambda S: R.context(S.requests, S.calls, S.command_parts, None), f"""WITH {LABEL_SQL},
 q AS (SELECT session_id, agent_id, request_id, context_tokens, lag(request_id) OVER w AS prev, lag(context_tokens) OVER w AS before, row_number() OVER w AS pos FROM {{requests}} WHERE {SETTLED} AND ts IS NOT NULL AND context_tokens IS NOT NULL WINDOW w AS (PARTITION BY session_id, agent_id ORDER BY ts, request_id)),
 g AS (SELECT session_id, agent_id, count(*) AS requests, arg_min(context_tokens, pos) AS start, max(context_tokens) AS peak, CASE WHEN count(*) > 1 THEN (arg_max(context_tokens, pos) - arg_min(context_tokens, pos)) // (count(*) - 1) END AS mean_growth FROM q GROUP BY 1, 2),
 d AS (SELECT q.*, context_tokens - before AS delta, row_number() OVER (PARTITION BY session_id, agent_id ORDER BY context_tokens - before DESC, pos) AS n FROM q WHERE context_tokens > before),
 t AS (SELECT session_id, agent_id, n, delta || ' ' || coalesce(label, '-') AS what FROM d LEFT JOIN lb ON lb.request_id = d.prev WHERE n <= 3)
 SELECT g.*, max(what) FILTER (n = 1) AS growth_1, max(what) FILTER (n = 2) AS growth_2, max(what) FILTER (n = 3) AS growth_3 FROM g LEFT JOIN t ON t.session_id = g.session_id AND t.agent_id IS NOT DISTINCT FROM g.agent_id GROUP BY ALL""")
KEY_OF = "array_to_string(list_transform({0}, lambda x, k: x.s || CASE WHEN x.f IS NULL THEN '' WHEN list_contains(list_transform({0}[1:k - 1], lambda y: y.f), x.f) THEN ' same' ELSE ' new' END), ' > ')"
entry("r06_sequences", lambda S: R.sequences(S.calls, S.command_parts, None), f"""WITH fp AS (SELECT tool_use_id, arg_min(regexp_extract(program, '[^/]*$'), seq) AS program FROM {{command_parts}} GROUP BY 1),
 c AS (SELECT session_id, agent_id, ts, k.tool_use_id, CASE WHEN tool = 'Bash' THEN 'Bash ' || coalesce(program, '?') ELSE tool END AS step, file_path AS f, bytes_delivered AS b, row_number() OVER (PARTITION BY session_id, agent_id ORDER BY ts, k.tool_use_id) AS i FROM {{calls}} k LEFT JOIN fp ON fp.tool_use_id = k.tool_use_id WHERE ts IS NOT NULL),
 r AS (SELECT a.session_id, a.agent_id, a.ts, a.tool_use_id, n.n, list({{'s': x.step, 'f': x.f, 'b': x.b}} ORDER BY x.i) AS run FROM c a CROSS JOIN (VALUES (2), (3), (4), (5)) n(n) JOIN c x ON x.session_id = a.session_id AND x.agent_id IS NOT DISTINCT FROM a.agent_id AND x.i BETWEEN a.i AND a.i + n.n - 1 GROUP BY ALL HAVING count(*) = n.n),
 q AS (SELECT *, {KEY_OF.format("run")} AS run_key, CASE WHEN NOT list_contains(list_transform(run, lambda z: z.b IS NULL), TRUE) THEN list_sum(list_transform(run, lambda z: z.b)) END AS size FROM r),
 g AS (SELECT run_key, n, count(*) AS occurrences, count(DISTINCT session_id || '/' || coalesce(agent_id, '')) AS agents, coalesce(isum(size), 0) AS bytes, count(size) AS sized, arg_min(run, (session_id, coalesce(agent_id, ''), ts, tool_use_id)) AS first FROM q GROUP BY 1, 2 HAVING count(DISTINCT session_id || '/' || coalesce(agent_id, '')) >= 2),
 u AS (SELECT occurrences, first[w.p:w.p + w.m - 1] AS sub FROM g JOIN (SELECT m, p FROM (VALUES (2), (3), (4)) m(m) CROSS JOIN (VALUES (1), (2), (3), (4)) a(p)) w ON w.m < g.n AND w.p <= g.n - w.m + 1),
 i AS (SELECT DISTINCT occurrences, {KEY_OF.format("sub")} AS run_key FROM u)
 SELECT run_key, n, occurrences, agents, bytes, CASE WHEN sized > 0 THEN bytes // sized END AS mean_bytes FROM g WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.run_key = g.run_key AND i.occurrences = g.occurrences)""")
#: Latest prompts of main chats that no end answers.
OPEN_SQL = """lp AS (SELECT * FROM (SELECT session_id, event_id, prompt_id, ts, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) AS r FROM {hook_events} WHERE event = 'UserPromptSubmit') WHERE r = 1),
 op AS (SELECT session_id, event_id AS p_id, prompt_id AS p_prompt, ts AS p_ts FROM lp WHERE NOT EXISTS (SELECT 1 FROM {hook_events} e WHERE e.session_id = lp.session_id AND e.event IN ('Stop', 'StopFailure') AND e.ts >= lp.ts AND (e.prompt_id IS NULL OR lp.prompt_id IS NULL OR e.prompt_id = lp.prompt_id)))"""
#: What transcripts say of the end of each session: for every second one an API error, after its last row.
TURN_ENDS = lambda S: S.sessions.select("session_id", F.when(F.col("first_ts") % 2 == 0, "StopFailure").otherwise("Stop").alias("event"), F.lit("overloaded").alias("error_type"), (F.col("last_ts") + 1).alias("ts"))
REFUSED = """SELECT ts, session_id, coalesce(error_type, 'unknown') AS kind, 'hook' AS source FROM {hook_events} WHERE event = 'StopFailure'
      UNION ALL SELECT last_ts + 1, session_id, 'overloaded', 'transcript' FROM op JOIN {sessions} USING (session_id) WHERE first_ts % 2 = 0"""
entry("r07_faults", lambda S: R.faults(S.faults, S.command_parts, R.refusals(S.hook_events, TURN_ENDS(S)), 25), f"""WITH {OPEN_SQL}, st(s) AS (VALUES ('payload'), ('store'), ('transcript'), ('parse'), ('binary'), ('terminated')),
 f AS (SELECT * FROM {{faults}} ORDER BY ts DESC, fault_id LIMIT 25), r AS (SELECT * FROM ({REFUSED}) ORDER BY ts DESC, session_id LIMIT 25)
 SELECT 'stage' AS kind, s AS label, (SELECT count(*) FROM {{faults}} x WHERE x.stage = s) AS count, NULL::BIGINT AS ts, NULL::VARCHAR AS session_id, NULL::VARCHAR AS call, NULL::VARCHAR AS error FROM st
 UNION ALL SELECT 'parts', parse_status, count(*), NULL, NULL, NULL, NULL FROM {{command_parts}} GROUP BY 2 UNION ALL SELECT 'fault', stage, NULL, ts, session_id, tool_use_id, error FROM f UNION ALL SELECT 'refusal', kind, NULL, ts, session_id, NULL, NULL FROM r""")
entry("r08_refusals", lambda S: R.refusals(S.hook_events, TURN_ENDS(S)), f"WITH {OPEN_SQL} {REFUSED}")
entry("r09_sessions", lambda S: R.sessions(S.sessions, S.calls, S.agents, R.ran_nothing(S.hook_events, S.calls, S.requests, S.faults), None), """WITH n AS (SELECT session_id FROM {hook_events} GROUP BY 1 HAVING count(*) FILTER (event NOT IN ('SessionStart', 'SessionEnd', 'InstructionsLoaded', 'Notification')) = 0 AND count(*) FILTER (event = 'SessionStart') > 0),
 un AS (SELECT session_id FROM n WHERE session_id NOT IN (SELECT session_id FROM {calls}) AND session_id NOT IN (SELECT session_id FROM {requests}) AND session_id NOT IN (SELECT session_id FROM {faults}))
 SELECT s.session_id, first_ts, last_ts, CASE WHEN model IS NULL AND s.session_id IN (SELECT * FROM un) THEN '(unused)' ELSE model END AS model, start_source, end_reason, (SELECT count(*) FROM {calls} c WHERE c.session_id = s.session_id) AS calls, (SELECT count(*) FROM {agents} a WHERE a.session_id = s.session_id) AS agents, cwd, host, coalesce(tz_name, '-') AS tz FROM {sessions} s""")
entry("r10_ended_before_start", lambda S: R.ended_before_start(S.hook_events.withColumn("event", F.when(F.col("session_id").rlike("[02468]$"), "SessionEnd").otherwise(F.col("event"))), S.faults),
      "SELECT session_id FROM {hook_events} GROUP BY 1 HAVING count(*) FILTER (event <> 'SessionEnd' AND NOT regexp_matches(session_id, '[02468]$')) = 0 AND session_id NOT IN (SELECT session_id FROM {faults} WHERE session_id IS NOT NULL)")
OF_DIGIT = lambda df, digits: df.withColumn("session_id", F.when(F.col("session_id").rlike(f"[{digits}]$"), F.col("session_id")).otherwise("none"))
entry("r11_ran_nothing", lambda S: R.ran_nothing(S.hook_events.withColumn("event", F.when(F.col("session_id").rlike("[0-8]$"), F.when(F.col("ts") % 2 == 0, "SessionStart").otherwise("Notification")).otherwise(F.col("event"))), OF_DIGIT(S.calls, "12"), OF_DIGIT(S.requests, "34"), OF_DIGIT(S.faults, "56")),
      """WITH e AS (SELECT session_id, CASE WHEN NOT regexp_matches(session_id, '[0-8]$') THEN event WHEN ts % 2 = 0 THEN 'SessionStart' ELSE 'Notification' END AS event FROM {hook_events}),
      n AS (SELECT session_id FROM e GROUP BY 1 HAVING count(*) FILTER (event NOT IN ('SessionStart', 'SessionEnd', 'InstructionsLoaded', 'Notification')) = 0 AND count(*) FILTER (event = 'SessionStart') > 0)
      SELECT session_id FROM n WHERE session_id NOT IN (SELECT session_id FROM {calls} WHERE regexp_matches(session_id, '[12]$')) AND session_id NOT IN (SELECT session_id FROM {requests} WHERE regexp_matches(session_id, '[34]$')) AND session_id NOT IN (SELECT session_id FROM {faults} WHERE regexp_matches(session_id, '[56]$'))""")
entry("r12_prompts", lambda S: R.prompts(S.calls, S.requests, S.agents.withColumn("prompt_id", F.concat("session_id", F.lit("-p1"))), S.turn_durations, None), f"""WITH c AS (SELECT prompt_id, min(session_id) AS s1, min(ts) AS f1, max(ts) AS l1, count(*) AS calls, isum(failed) AS failed FROM {{calls}} GROUP BY 1),
 r AS (SELECT prompt_id, min(session_id) AS s2, min(ts) AS f2, max(ts) AS l2, count(*) AS requests, max(context_tokens) AS context_tokens, isum(output_tokens) AS output_tokens FROM {{requests}} WHERE {SETTLED} GROUP BY 1),
 a AS (SELECT session_id || '-p1' AS prompt_id, min(session_id) AS s3, min(started) AS f3, max(stopped) AS l3, count(*) AS agents FROM {{agents}} GROUP BY 1),
 w AS (SELECT session_id, prompt_id, isum(duration_ms) AS wall_ms FROM {{turn_durations}} WHERE prompt_id IS NOT NULL GROUP BY 1, 2),
 j AS (SELECT prompt_id, coalesce(s1, s2, s3) AS session_id, least(f1, f2, f3) AS first_ts, greatest(l1, l2, l3) AS last_ts, coalesce(calls, 0) AS calls, coalesce(failed, 0) AS failed, coalesce(agents, 0) AS agents, coalesce(requests, 0) AS requests, context_tokens, output_tokens FROM c FULL JOIN r USING (prompt_id) FULL JOIN a USING (prompt_id))
 SELECT j.*, wall_ms FROM j LEFT JOIN w USING (session_id, prompt_id)""")
entry("r13_effort", lambda S: R.effort(S.calls, S.turns, S.agents), """SELECT effort, permission_mode, agent_type, isum(calls) AS calls, isum(turns) AS turns, isum(failed) AS failed FROM (SELECT effort, permission_mode, agent_type, 1 AS calls, 0 AS turns, CASE WHEN failed = 1 THEN 1 ELSE 0 END AS failed FROM {calls}
 UNION ALL SELECT t.effort, t.permission_mode, a.agent_type, 0, 1, 0 FROM {turns} t LEFT JOIN {agents} a USING (agent_id)) GROUP BY 1, 2, 3""")
entry("r14_tokens", lambda S: R.tokens(S.requests, S.agents), f"""WITH g AS (SELECT model, agent_type, count(*) AS requests, isum(input_tokens) AS input, isum(cache_read_tokens) AS cache_read, isum(cache_creation_5m_tokens) AS cache_write_5m, isum(cache_creation_1h_tokens) AS cache_write_1h, isum(cache_creation_tokens) AS cache_write, isum(output_tokens) AS output, isum(thinking_tokens) AS thinking, isum(CASE WHEN thinking_tokens IS NOT NULL THEN output_tokens END) AS th
 FROM {{requests}} LEFT JOIN (SELECT agent_id, agent_type FROM {{agents}}) USING (agent_id) WHERE {SETTLED} GROUP BY 1, 2)
 SELECT model, agent_type, requests, input, cache_read, cache_write_5m, cache_write_1h, cache_write, output, thinking, round(CASE WHEN input + cache_read + cache_write > 0 THEN 100 * cache_read / (input + cache_read + cache_write) END, 6) AS cache_hit_percent, round(CASE WHEN th > 0 THEN 100 * thinking / th END, 6) AS think_percent FROM g""")
entry("r15_agents", lambda S: R.agents(S.agents.withColumns({"seq": F.lit(1), "prompt_id": F.lit(None).cast("string")}), None), "SELECT agent_id, agent_type, session_id, 1 AS seq, started, stopped, (stopped - started) // 1000 AS seconds, NULL::VARCHAR AS prompt_id FROM {agents}")
entry("r16_outcomes", lambda S: R.outcomes(S.calls), """SELECT 'edit' AS kind, session_id, file_path AS subject, NULL::VARCHAR AS branch, isum(lines_added) AS added, isum(lines_removed) AS removed, NULL::BIGINT AS passed, NULL::BIGINT AS failed, max(ts) AS last FROM {calls} WHERE tool IN ('Edit', 'Write') AND file_path IS NOT NULL GROUP BY 2, 3
 UNION ALL SELECT 'commit', session_id, commit_sha, max(commit_branch), NULL, NULL, NULL, NULL, max(ts) FROM {calls} WHERE commit_sha IS NOT NULL GROUP BY 2, 3 UNION ALL SELECT 'test', session_id, test_runner, NULL, NULL, NULL, count(*) FILTER (failed = 0), count(*) FILTER (failed = 1), max(ts) FROM {calls} WHERE test_runner IS NOT NULL GROUP BY 2, 3""")
entry("r17_coverage", lambda S: R.coverage(S.sessions.select(F.lit("/r").alias("root"), F.lit("proj").alias("project"), "session_id", F.col("last_ts").alias("modified"), (F.length("session_id") * 100).alias("bytes")), S.hook_events.select("session_id", "ts", F.col("event").isin("Stop", "UserPromptSubmit").alias("turn"), (F.col("event") == "Notification").alias("hook"), F.lit(False).alias("bad")), S.sessions.where("session_id like '%7'"), S.calls.where("session_id like '%5'"), 1_704_200_000_000),
      """WITH o AS (SELECT session_id, min(ts) AS started, max(CASE WHEN event IN ('Stop', 'UserPromptSubmit') THEN 1 ELSE 0 END) AS turn, max(CASE WHEN event = 'Notification' THEN 1 ELSE 0 END) AS hook FROM {hook_events} GROUP BY 1)
      SELECT '/r' AS root, 'proj' AS project, s.session_id, started, last_ts AS modified, length(s.session_id) * 100 AS bytes, CASE WHEN turn IS NULL THEN 'unreadable' WHEN started < 1704200000000 THEN 'before-store' WHEN turn = 0 THEN 'no-turn' WHEN hook = 1 THEN 'hook-ran' ELSE 'no-hook' END AS why
      FROM {sessions} s LEFT JOIN o USING (session_id) WHERE s.session_id NOT LIKE '%7' AND s.session_id NOT IN (SELECT session_id FROM {calls} WHERE session_id LIKE '%5')""")
entry("r18_events", lambda S: R.events(S.hook_events.withColumns({"load_reason": F.when(F.col("ts") % 5 == 0, "session_start"), "tool": F.when(F.col("ts") % 7 == 0, "Bash"), "command_name": F.when(F.col("ts") % 3 == 0, "review")})),
      "SELECT event, coalesce(nullif(source, ''), nullif(reason, ''), nullif(trigger, ''), nullif(error_type, ''), CASE WHEN ts % 5 = 0 THEN 'session_start' END, CASE WHEN ts % 7 = 0 THEN 'Bash' END, CASE WHEN ts % 3 = 0 THEN 'review' END, CASE WHEN json_valid(detail) THEN json_extract_string(detail, '$.notification_type') END) AS value, count(*) AS count, min(ts) AS first, max(ts) AS last FROM {hook_events} GROUP BY 1, 2")
entry("r19_compactions", lambda S: R.compactions(S.compactions, None), "SELECT entry_id, session_id, ts, trigger, pre_tokens AS before, post_tokens AS after, pre_tokens - post_tokens AS freed, cumulative_dropped_tokens AS dropped_total, duration_ms FROM {compactions}")
entry("r20_cost_chats", lambda S: R.cost_chats(S.session_costs, S.requests, S.hook_events, None), """WITH e AS (SELECT session_id, max(ts) AS ended FROM {hook_events} WHERE event = 'SessionEnd' GROUP BY 1),
 c AS (SELECT s.*, CASE WHEN started IS NOT NULL AND wall_ms IS NOT NULL THEN greatest(started + wall_ms, ended) END AS exit FROM {session_costs} s LEFT JOIN e USING (session_id)),
 p AS (SELECT r.session_id, isum(cost_usd_micros) AS requests_micros, isum(CASE WHEN source = 'ledger' THEN cost_usd_micros END) AS side_micros, isum(CASE WHEN cost_source = 'ledger' AND r.ts <= c.exit + 2000 THEN cost_usd_micros END) AS covered FROM {requests} r LEFT JOIN c ON c.session_id = r.session_id WHERE cost_usd_micros IS NOT NULL GROUP BY 1)
 SELECT session_id, requests_micros, CAST(round(cost_usd * 1000000) AS BIGINT) AS own_micros, CAST(round(cost_usd * 1000000) AS BIGINT) - requests_micros AS diff_micros, CASE WHEN exit IS NOT NULL AND cost_usd IS NOT NULL AND covered IS NOT NULL THEN greatest(CAST(round(cost_usd * 1000000) AS BIGINT) - covered, 0) END AS pre_ledger_micros, side_micros, api_ms, api_ms - api_no_retry_ms AS retry_ms, tool_ms, wall_ms FROM c FULL JOIN p USING (session_id)""")
entry("r21_cost_agents", lambda S: R.cost_agents(S.requests, S.agents, None), """SELECT r.session_id, r.agent_id, max(a.agent_type) AS agent_type, isum(cost_usd_micros) AS micros, isum(CASE WHEN cost_source = 'ledger' THEN cost_usd_micros END) AS ledger_micros, isum(CASE WHEN cost_source = 'table' THEN cost_usd_micros END) AS table_micros, isum(CASE WHEN source = 'ledger' THEN cost_usd_micros END) AS side_micros
 FROM {requests} r LEFT JOIN {agents} a ON a.agent_id = r.agent_id GROUP BY 1, 2""")
entry("r22_cost_calls", lambda S: R.cost_calls(S.requests, 25), "SELECT request_id, session_id, ts, agent_id, query_source, model, input_tokens, cache_read_tokens, cache_creation_tokens, output_tokens, cost_usd_micros, cost_source, CASE WHEN source = 'ledger' THEN 1 ELSE 0 END AS side_call FROM {requests} ORDER BY cost_usd_micros DESC NULLS LAST, request_id LIMIT 25")
entry("r23_cost_gaps", lambda S: R.cost_gaps(S.requests, S.agents.where("agent_type = 'review'")), "SELECT count(*) FILTER (cost_usd_micros IS NULL) AS unpriced, count(*) FILTER (source = 'ledger' AND cost_source = 'table') AS table_priced_side, count(*) FILTER (agent_id IS NOT NULL AND agent_id NOT IN (SELECT agent_id FROM {agents} WHERE agent_type = 'review')) AS unknown_agent, count(*) FILTER (starts_with(lower(model), 'gpt-')) AS list_equivalent, isum(CASE WHEN starts_with(lower(model), 'gpt-') THEN cost_usd_micros END) AS list_equivalent_micros FROM {requests}")
entry("r25_hooks", lambda S: R.hooks(S.stop_hooks, S.stop_hook_runs), "SELECT name, count(*) AS runs, count(duration_ms) AS timed, isum(duration_ms) AS total_ms, max(duration_ms) AS max_ms, isum(duration_ms) // count(duration_ms) AS avg_ms FROM {stop_hook_runs} WHERE entry_id IN (SELECT entry_id FROM {stop_hooks}) GROUP BY name")
entry("r26_turns", lambda S: R.turns(S.turn_durations, S.turns, None), "SELECT entry_id, session_id, prompt_id, ts, duration_ms, message_count, background_agents, (SELECT effort FROM {turns} t WHERE t.session_id = d.session_id AND t.prompt_id = d.prompt_id AND t.ts <= d.ts ORDER BY t.ts DESC, t.event_id DESC LIMIT 1) AS effort FROM {turn_durations} d")
entry("r26_turn_notes", lambda S: R.turn_notes(S.turn_durations), "SELECT count(duration_ms) AS turns, isum(duration_ms) AS total_ms, median(duration_ms) AS median_ms, quantile_disc(duration_ms, 0.9) AS p90_ms FROM {turn_durations}")
entry("r27_resumes", lambda S: R.resumes(S.hook_events), """SELECT event_id, session_id, ts, CASE WHEN json_type(detail, '$.seconds_since_last_response') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(json_extract(detail, '$.seconds_since_last_response') AS DOUBLE) END AS idle_s, CASE WHEN json_type(detail, '$.context_tokens') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(json_extract(detail, '$.context_tokens') AS DOUBLE) END AS context_tokens,
 CASE WHEN json_type(detail, '$.prompt_cache_likely_expired') = 'BOOLEAN' THEN CAST(json_extract(detail, '$.prompt_cache_likely_expired') AS BOOLEAN) END AS cache_expired, CASE WHEN json_type(detail, '$.estimated_cache_write_usd') = 'DOUBLE' THEN CAST(json_extract(detail, '$.estimated_cache_write_usd') AS DOUBLE) END AS cache_write_usd FROM {hook_events} WHERE event = 'SessionStart' AND source = 'resume'""")
entry("r28_waiting", lambda S: R.waiting(S.hook_events, S.requests), """WITH n AS (SELECT session_id, ts, CASE WHEN json_valid(detail) THEN json_extract_string(detail, '$.notification_type') END AS kind FROM {hook_events} WHERE event = 'Notification'),
 w AS (SELECT session_id, kind, ts, (SELECT min(ts) FROM {hook_events} u WHERE u.event = 'UserPromptSubmit' AND u.session_id = n.session_id AND u.ts > n.ts) AS p, (SELECT min(ts) FROM {requests} r WHERE r.source IS DISTINCT FROM 'ledger' AND r.session_id = n.session_id AND r.ts > n.ts) AS q FROM n WHERE kind IN ('idle_prompt', 'permission_prompt')),
 k AS (SELECT session_id, kind, CASE WHEN kind = 'permission_prompt' THEN least(p, q) ELSE p END AS fin, min(ts) AS start FROM w GROUP BY 1, 2, 3)
 SELECT session_id, kind, count(*) AS waits, count(*) FILTER (fin IS NULL) AS open, isum(fin - start) AS total_ms, median(fin - start) AS median_ms, max(fin - start) AS max_ms FROM k GROUP BY 1, 2""")

# Recipes
from tracewell.plans import recipes as Q  # noqa: E402

SID, AID = "s8", "a8-0"
MAIN = "coalesce(r.agent_id, '(main)') AS agent"
entry("q01_spend_per_agent", lambda S: Q.spend_per_agent(S.requests, S.agents, SID), f"SELECT {MAIN}, max(a.agent_type) AS agent_type, count(*) AS requests, max(context_tokens) AS peak_context, isum(output_tokens) AS output, isum(thinking_tokens) AS thinking, isum(cache_read_tokens) AS cache_read, isum(cache_creation_tokens) AS cache_write FROM {{requests}} r LEFT JOIN {{agents}} a ON a.agent_id = r.agent_id WHERE r.session_id = '{SID}' AND pending = 0 AND r.source IS DISTINCT FROM 'ledger' GROUP BY r.agent_id")
entry("q02_money_per_party", lambda S: Q.money_per_party(S.requests, S.agents, SID), f"SELECT {MAIN}, max(a.agent_type) AS agent_type, count(*) AS requests, count(*) FILTER (r.source = 'ledger') AS side_calls, round(coalesce(sum(cost_usd_micros), 0) / 1e6, 4) AS usd, count(*) FILTER (cost_usd_micros IS NULL) AS unpriced, coalesce(string_agg(DISTINCT cost_source, ',' ORDER BY cost_source), '') AS price_from FROM {{requests}} r LEFT JOIN {{agents}} a ON a.agent_id = r.agent_id WHERE r.session_id = '{SID}' AND pending = 0 GROUP BY r.agent_id")
entry("q03_agent_calls", lambda S: Q.agent_calls(S.calls, S.agents, SID), f"SELECT c.tool_use_id, coalesce(c.agent_id, '(main)') AS spawned_by, json_extract_string(input, '$.subagent_type') AS type, coalesce(a.model, json_extract_string(input, '$.model')) AS model, a.agent_id AS started_agent, started, round((stopped - started) / 60000.0, 1) AS wall_min, total_tokens, tool_uses, ts FROM {{calls}} c LEFT JOIN {{agents}} a ON a.parent_tool_use_id = c.tool_use_id WHERE c.session_id = '{SID}' AND tool IN ('Agent', 'Task') ORDER BY ts NULLS FIRST, c.tool_use_id, a.agent_id LIMIT 50")
entry("q04_family", lambda S: Q.family(S.requests, S.calls, S.agents, AID), f"WITH RECURSIVE tree(agent_id, depth) AS (SELECT '{AID}', 0 UNION SELECT a.agent_id, t.depth + 1 FROM tree t JOIN {{calls}} c ON c.agent_id = t.agent_id JOIN {{agents}} a ON a.parent_tool_use_id = c.tool_use_id) SELECT count(DISTINCT t.agent_id) AS agents, max(t.depth) AS depth, count(r.request_id) AS requests, isum(output_tokens) AS output, max(context_tokens) AS peak_context FROM tree t LEFT JOIN {{requests}} r ON r.agent_id = t.agent_id AND pending = 0 AND r.source IS DISTINCT FROM 'ledger'")


def DEEP(S: StandIns) -> tuple[DataFrame, DataFrame]:
    """Calls and agents: a chain of all customers, each order's agent started by its customer's, and a circle of nations."""
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    c, o, n = F.col("c_custkey"), S.table("orders"), F.col("n_nationkey")
    links = S.table("customer").select(name("d", c).alias("agent_id"), name("d", c - 1).alias("by")).unionByName(o.select(name("o", F.col("o_orderkey")).alias("agent_id"), name("d", F.col("o_custkey")).alias("by")))
    links = links.unionByName(S.table("nation").select(name("n", n).alias("agent_id"), name("n", (n + 1) % 25).alias("by")))
    call = F.concat(F.lit("t"), "agent_id")
    return links.select(call.alias("tool_use_id"), F.col("by").alias("agent_id")), links.select("agent_id", call.alias("parent_tool_use_id"))


entry("q04_descendants", lambda S: Q.descendants(*DEEP(S), "d0"), """WITH RECURSIVE up AS (SELECT 'd' || c_custkey AS a, 'd' || (c_custkey - 1) AS p FROM {customer} UNION ALL SELECT 'o' || o_orderkey, 'd' || o_custkey FROM {orders} UNION ALL SELECT 'n' || n_nationkey, 'n' || ((n_nationkey + 1) % 25) FROM {nation}),
 tree(agent_id, depth) AS (SELECT 'd0', 0 UNION ALL SELECT up.a, t.depth + 1 FROM tree t JOIN up ON up.p = t.agent_id) SELECT agent_id, depth FROM tree""")
entry("q05_tool_mix", lambda S: Q.tool_mix(S.calls, AID), f"SELECT tool, count(*) AS calls, isum(failed) AS failed, round(sum(duration_ms) / 60000.0, 1) AS tool_min, isum(bytes_delivered) AS bytes_into_context FROM {{calls}} WHERE agent_id = '{AID}' GROUP BY tool")
entry("q05_slowest_calls", lambda S: Q.slowest_calls(S.calls, AID), f"SELECT tool_use_id, round(duration_ms / 1000.0, 1) AS secs, tool, left(replace(coalesce(json_extract_string(input, '$.command'), file_path, ''), chr(10), ' '), 120) AS what, duration_ms FROM {{calls}} WHERE agent_id = '{AID}' ORDER BY duration_ms DESC NULLS LAST, tool_use_id LIMIT 10")
entry("q06_bytes_by_tool", lambda S: Q.bytes_by_tool(S.calls, SINCE), f"SELECT tool, count(*) AS calls, isum(bytes_delivered) AS bytes, max(bytes_delivered) AS largest, count(persisted_path) AS spilled_to_file FROM {{calls}} WHERE ts >= {SINCE} GROUP BY tool")
entry("q07_compactions", lambda S: Q.latest_compactions(S.compactions), f"SELECT entry_id, ts, session_id, {MAIN}, trigger, pre_tokens, post_tokens, pre_tokens - post_tokens AS freed, round(duration_ms / 1000.0, 1) AS secs FROM {{compactions}} r ORDER BY ts DESC NULLS LAST, entry_id LIMIT 20")
entry("q08_cache_outcomes", lambda S: Q.cache_outcomes(derive.request_cache(S.requests, S.compactions), S.requests, SINCE), f"WITH {CACHE_SQL} SELECT CASE WHEN agent_id IS NULL THEN '(main)' ELSE 'sub-agent' END AS party, entry_ttl, outcome, cause, count(*) AS requests FROM rc WHERE ts >= {SINCE} GROUP BY ALL")
entry("q09_cost_by_model", lambda S: Q.cost_by_model(S.session_costs.withColumn("model_costs", F.when(F.col("api_ms") % 3 > 0, F.create_map("model_a", "usd_a", F.lit("m9"), F.col("cost_usd") / 4))), None),
      "WITH u AS (SELECT *, unnest(CASE WHEN api_ms % 3 > 0 THEN [{'m': model_a, 'v': usd_a}, {'m': 'm9', 'v': cost_usd / 4}] ELSE [NULL] END) AS x FROM {session_costs}) SELECT session_id, round(cost_usd, 2) AS usd, round(wall_ms / 3600000.0, 2) AS wall_h, round(api_ms / 3600000.0, 2) AS api_h, x.m AS model, round(x.v, 2) AS model_usd FROM u")
entry("q10_without_stop", lambda S: Q.without_stop(S.agents, S.calls, "s10", 1_750_000_000_000), "SELECT a.agent_id, max(a.agent_type) AS agent_type, max(started) AS started, round((1750000000000 - max(c.ts)) / 60000.0) AS min_since_last_call FROM {agents} a LEFT JOIN {calls} c ON c.session_id = a.session_id AND c.agent_id = a.agent_id WHERE a.session_id = 's10' AND stopped IS NULL GROUP BY a.agent_id")
entry("q10_agent_counts", lambda S: Q.agent_counts(S.agents, SID), f"SELECT count(*) AS agents_in_session, count(*) FILTER (stopped IS NULL) AS without_stop, max(started) AS latest_start FROM {{agents}} WHERE session_id = '{SID}'")
entry("q11_turns", lambda S: Q.turns_of_session(S.hook_events, S.turn_durations, SID, 20), f"SELECT prompt_id, min(ts) AS first, count(*) AS submits, isum(prompt_bytes) AS prompt_bytes, (SELECT round(sum(d.duration_ms) / 1000.0, 1) FROM {{turn_durations}} d WHERE d.session_id = '{SID}' AND d.prompt_id = e.prompt_id) AS wall_s FROM {{hook_events}} e WHERE session_id = '{SID}' AND event = 'UserPromptSubmit' GROUP BY prompt_id")
entry("q12_peak_percentiles", lambda S: Q.peak_percentiles(S.requests, S.agents, SINCE), f"WITH p AS (SELECT a.agent_id, max(a.agent_type) AS t, max(context_tokens) AS peak FROM {{requests}} r JOIN {{agents}} a ON a.agent_id = r.agent_id WHERE pending = 0 AND r.source IS DISTINCT FROM 'ledger' AND ts >= {SINCE} GROUP BY 1) SELECT coalesce(t, '?') AS agent_type, count(*) AS n, round(quantile_cont(peak, 0.5), 4) AS p50, round(quantile_cont(peak, 0.9), 4) AS p90, max(peak) AS max FROM p GROUP BY 1")

# Raw records
from tracewell.functions import commands as C  # noqa: E402
from tracewell.functions import privacy as P  # noqa: E402
from tracewell.operators import classify as K  # noqa: E402
from tracewell.operators import extract as E  # noqa: E402
from tracewell.operators import merge as M  # noqa: E402
from tracewell.operators import reconcile as RC  # noqa: E402
from tracewell.plans import rawstandins as X  # noqa: E402
from tracewell.sources import raw as SRC  # noqa: E402
from tracewell.sources import sinks  # noqa: E402
from tracewell.streaming import ingest  # noqa: E402
from tracewell.tables import fenced, scratch  # noqa: E402


def P_(S: StandIns) -> DataFrame:
    return E.parsed(X.transcripts(S))


CONV = """
 cv AS (SELECT *, length(text) AS n, 's' || conv_id AS session_id, conv_id || '-' || turn AS tag, 1704067200000 + (conv_id % 100000) * 3600000 + turn * 60000 AS ms,
        last_value(CASE WHEN role NOT IN ('assistant', 'system') AND turn % 3 <> 0 THEN 'p' || conv_id || '-' || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS prompt_id FROM {conversations})"""
entry("s01_read_transcripts", lambda S: SRC.lines_of(X.transcripts(S).groupBy("path").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "raw"))), lambda l: l["raw"]), "\n"), F.lit('\n{"torn"\n{"cut')).alias("content")))[0].groupBy("path").agg(F.count("*").alias("lines")),
      f"WITH {CONV} SELECT '/h/projects/proj/' || session_id || '.jsonl' AS path, isum(CASE role WHEN 'assistant' THEN 6 ELSE 1 END + CASE WHEN turn = 0 THEN 1 ELSE 0 END) AS lines FROM cv GROUP BY session_id")
def FILES(S: StandIns) -> DataFrame:
    """The stand-in transcripts written to a few real files, each of many sessions one after the other, and read back by byte ranges."""
    folder = scratch(S.spark)
    X.transcripts(S).repartitionByRange(5, "path").sortWithinPartitions("path", "line_no").select("raw").write.text(folder)
    good, bad = SRC.read_transcripts(S.spark, folder)
    rows = good.unionByName(bad).select("path", "line_no", F.get_json_object("raw", "$.sessionId").alias("session_id"))
    return rows.groupBy("session_id").agg(F.count("*").alias("lines"), (F.count_distinct("path", "line_no") == F.max("line_no") - F.min("line_no") + 1).alias("in_a_row"))


entry("s01_split_files", FILES, f"WITH {CONV} SELECT session_id, isum(CASE role WHEN 'assistant' THEN 6 ELSE 1 END + CASE WHEN turn = 0 THEN 1 ELSE 0 END) AS lines, true AS in_a_row FROM cv GROUP BY session_id")
entry("s02_payloads", lambda S: SRC.payloads(X.payload_rows(S))[0].select("event", "session_id", "received_ms", F.get_json_object("payload", "$.nonce").alias("nonce")), "SELECT event, session_id, ts + d AS received_ms, event_id || '!' AS nonce FROM {hook_events}, UNNEST(CASE WHEN ts % 3 = 0 THEN [0, 400, 1400] ELSE [0] END) AS u(d)")
LEDGER = """
 lk AS (SELECT *, CAST(regexp_extract(request_id, '(\\d+)', 1) AS BIGINT) AS k FROM {requests}),
 ld AS (SELECT session_id, api_request_id AS api, k, k % 900 AS cost, 2 AS rank, FALSE AS partial, 0 AS n FROM lk WHERE k % 4 <> 0 UNION ALL SELECT session_id, api_request_id, k, k % 700, 3, FALSE, 1 FROM lk WHERE k % 8 = 1
   UNION ALL SELECT session_id, api_request_id, k, NULL, 3, TRUE, 2 FROM lk WHERE k % 16 = 1 UNION ALL SELECT session_id, 'side_' || request_id, k, k % 50, 1, FALSE, 3 FROM lk WHERE k % 10 = 0),
 lb AS (SELECT *, row_number() OVER (PARTITION BY api ORDER BY rank DESC, partial, n DESC) AS best FROM ld)"""
entry("s03_ledger", lambda S: SRC.ledger(X.ledger_lines(S))[0].select("request_id", "session_id", "rank", "partial", "cost"), f"WITH {LEDGER} SELECT api AS request_id, session_id, rank, partial, cost FROM ld")
entry("s04_lost_log", lambda S: SRC.lost_log(S.hook_events.select(F.when(F.col("ts") % 5 == 0, F.concat(F.lit("noise "), "event_id")).otherwise(F.concat_ws("\t", F.floor(F.col("ts") / 1000).cast("string"), "event", F.when(F.col("ts") % 2 == 0, "terminated by signal").otherwise("binary missing"), "session_id")).alias("raw"), F.col("ts").alias("modified_ms"))),
      "SELECT CASE WHEN ts % 5 = 0 THEN ts ELSE (ts // 1000) * 1000 END AS ts, CASE WHEN ts % 5 <> 0 AND ts % 2 = 0 THEN 'terminated' ELSE 'binary' END AS stage, CASE WHEN ts % 5 <> 0 THEN session_id END AS session_id, CASE WHEN ts % 5 = 0 THEN 'noise ' || event_id ELSE event || ': ' || CASE WHEN ts % 2 = 0 THEN 'terminated by signal' ELSE 'binary missing' END END AS error FROM {hook_events}")
entry("s05_agent_meta", lambda S: SRC.agent_meta(S.agents.select(F.concat(F.lit("/h/agent-"), "agent_id", F.lit(".meta.json")).alias("path"), F.to_json(F.struct(F.col("agent_type").alias("agentType"), F.col("parent_tool_use_id").alias("toolUseId"))).alias("content"))), "SELECT agent_id, agent_type, parent_tool_use_id FROM {agents}")
entry("s06_list_transcripts", lambda S: SRC.transcripts_of(S.sessions.select(F.concat(F.lit("/h/projects/p"), F.length("session_id").cast("string"), F.when(F.col("first_ts") % 4 == 0, "/x/subagents/agent-").otherwise("/"), "session_id", F.lit(".jsonl")).alias("path"), F.col("last_ts").alias("modified"), F.lit(9).alias("bytes"))), "SELECT '/h' AS root, 'p' || length(session_id) AS project, session_id, last_ts AS modified, 9 AS bytes FROM {sessions} WHERE first_ts % 4 <> 0")
entry("s07_call_lines", lambda S: SRC.call_lines(S.calls.select(F.xxhash64("tool_use_id").alias("line_no"), F.when(F.coalesce(F.col("duration_ms"), F.lit(0)) % 9 == 1, "[]").otherwise(F.to_json(F.struct(F.col("tool_use_id").alias("id"), "tool", "cwd"))).alias("raw"))).groupBy(F.when(F.col("status") == "ok", "ok").otherwise("unreadable").alias("status"), "tool").agg(F.count("*").alias("n")),
      "SELECT CASE WHEN coalesce(duration_ms, 0) % 9 = 1 THEN 'unreadable' ELSE 'ok' END AS status, CASE WHEN coalesce(duration_ms, 0) % 9 <> 1 THEN tool END AS tool, count(*) AS n FROM {calls} GROUP BY 1, 2")
entry("s10_report_json", lambda S: sinks.report_json(R.hooks(S.stop_hooks, S.stop_hook_runs).orderBy("name"), R.turn_notes(S.turn_durations), "hooks", "standin", "hooks").select(F.get_json_object("value", "$.topic").alias("topic"), F.size(F.from_json(F.get_json_object("value", "$.rows"), "array<array<string>>")).alias("n"), F.get_json_object("value", "$.rows[0][0]").alias("first")),
      "SELECT 'hooks' AS topic, count(*) AS n, (SELECT coalesce(name, '-') FROM {stop_hook_runs} ORDER BY name NULLS FIRST LIMIT 1) AS first FROM (SELECT DISTINCT name FROM {stop_hook_runs})")
entry("s11_archived", lambda S: sinks.archived(S.faults, "faults"), "SELECT fault_id, ts, session_id, tool_use_id, stage FROM {faults}")

ASSISTANT = "FROM cv WHERE role = 'assistant'"
entry("e01_requests", lambda S: E.requests_from_transcript(P_(S)).select("request_id", "session_id", "prompt_id", "ts", "model", "stop_reason", "api_request_id", "input_tokens", "cache_read_tokens", "cache_creation_tokens", "output_tokens"),
      f"WITH {CONV} SELECT 'm' || tag AS request_id, session_id, prompt_id, ms AS ts, 'model-' || (conv_id % 3) AS model, CASE WHEN n % 4 = 0 THEN 'end_turn' ELSE 'tool_use' END AS stop_reason, 'req' || tag AS api_request_id, n % 1000 AS input_tokens, turn * 1000 AS cache_read_tokens, n * 3 % 700 AS cache_creation_tokens, n AS output_tokens {ASSISTANT}")
entry("e02_context_tokens", lambda S: E.requests_from_transcript(P_(S)).select("request_id", "context_tokens"), f"WITH {CONV} SELECT 'm' || tag AS request_id, n % 1000 + turn * 1000 + n * 3 % 700 AS context_tokens {ASSISTANT}")
entry("e03_tool_uses", lambda S: E.tool_uses(P_(S)).select("request_id", "tool_use_id", "tool", "ts", "cwd", F.get_json_object("input", "$.command").alias("command")), f"WITH {CONV} SELECT 'm' || tag AS request_id, 't' || tag AS tool_use_id, 'Bash' AS tool, ms + 1000 AS ts, '/w' AS cwd, CASE WHEN n % 2 = 0 THEN 'git commit -m ''x ' || tag || '''' ELSE 'cd t' || turn || ' && pytest -q ' || tag || '.py | tail -3' END AS command {ASSISTANT}")
entry("e04_prompt_of", lambda S: E.prompt_of(P_(S)).where("type = 'assistant'").select("path", "line_no", "prompt_id"), f"WITH {CONV} SELECT '/h/projects/proj/' || session_id || '.jsonl' AS path, turn * 10 + k AS line_no, prompt_id FROM cv CROSS JOIN (SELECT unnest([0, 1]) AS k) WHERE role = 'assistant'")
entry("e05_iterations", lambda S: E.iterations(P_(S)).select("request_id", "seq", "type", "output_tokens"), f"WITH {CONV} SELECT 'm' || tag AS request_id, 1 AS seq, 'fallback_message' AS type, n % 77 AS output_tokens {ASSISTANT}")
entry("e06_compactions", lambda S: E.compactions(P_(S)).select("entry_id", "session_id", "ts", "trigger", "pre_tokens", "post_tokens"), f"WITH {CONV} SELECT 'u' || tag AS entry_id, session_id, ms AS ts, CASE WHEN n % 2 = 0 THEN 'auto' END AS trigger, n AS pre_tokens, n // 4 AS post_tokens FROM cv WHERE role = 'system'")
entry("e07_stop_hooks", lambda S: E.stop_hooks(P_(S))[0].select("entry_id", "session_id", "prompt_id", "hook_count"), f"WITH {CONV} SELECT 'h' || tag AS entry_id, session_id, prompt_id, 2 AS hook_count {ASSISTANT}")
entry("e07_stop_hook_runs", lambda S: E.stop_hooks(P_(S))[1].select("entry_id", "seq", "duration_ms"), f"WITH {CONV} SELECT 'h' || tag AS entry_id, seq, CASE WHEN seq = 0 THEN n END AS duration_ms FROM cv CROSS JOIN (SELECT unnest([0, 1]) AS seq) WHERE role = 'assistant'")
entry("e08_turn_durations", lambda S: E.turn_durations(P_(S)).select("session_id", "prompt_id", "ts", "duration_ms", "message_count"), f"WITH {CONV} SELECT session_id, prompt_id, ms + 3000 AS ts, CAST(floor(n * 7.5) AS BIGINT) AS duration_ms, turn AS message_count {ASSISTANT}")
entry("e09_mark_key", lambda S: E.marks(P_(S), "turn_duration").select("session_id", "line_no", F.substring("entry_id", 1, 5).alias("kind"), (F.substring("entry_id", 6, 16) == F.substring(F.sha2("raw", 256), 1, 16)).alias("of_line")), f"WITH {CONV} SELECT session_id, turn * 10 + 3 AS line_no, 'line#' AS kind, true AS of_line {ASSISTANT}")
entry("e10_session_costs", lambda S: E.session_costs(P_(S)).select("session_id", "cost_usd", "wall_ms", F.map_values("model_costs")[0].alias("model_usd")), f"WITH {CONV}, l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r {ASSISTANT}) SELECT session_id, n / 64.0 AS cost_usd, n * 10 AS wall_ms, n / 128.0 AS model_usd FROM l WHERE r = 1")
RESULT = "CASE WHEN n % 5 = 3 AND n % 2 = 0 THEN 'Permission to use Bash ' || text ELSE text END"
entry("e11_e14_tool_results", lambda S: E.tool_results(P_(S)), f"WITH {CONV} SELECT 't' || tag AS tool_use_id, strlen({RESULT}) AS bytes, CASE WHEN n % 5 = 3 THEN 1 ELSE 0 END AS failed, CASE WHEN n % 5 = 3 AND n % 2 = 0 THEN 'denied by permission' END AS outcome, CASE WHEN n % 5 = 3 THEN strlen({RESULT}) ELSE strlen(text) + 1 END AS real {ASSISTANT}")
CALLP = "SELECT * FROM {calls} WHERE ts IS NOT NULL AND failed IS NOT NULL"
entry("e15_e17_call_rows", lambda S: E.call_rows(SRC.payloads(X.call_payloads(S))[0]).select("tool_use_id", "ts", "duration_ms", "failed", "file_path", "read_start", "read_lines", "file_bytes_before", "lines_added", "lines_removed"),
      f"""SELECT tool_use_id, ts, duration_ms, failed, file_path, CASE WHEN tool = 'Read' THEN greatest(read_start - 5, 1) END AS read_start, read_lines, CASE WHEN tool = 'Write' THEN 0 WHEN tool = 'Edit' THEN duration_ms % 50 END AS file_bytes_before,
      CASE WHEN tool = 'Write' THEN 2 WHEN tool = 'Edit' THEN 2 END AS lines_added, CASE WHEN tool = 'Write' THEN 0 WHEN tool = 'Edit' THEN 1 END AS lines_removed FROM ({CALLP})""")
entry("e18_commits", lambda S: E.call_rows(SRC.payloads(X.call_payloads(S))[0]).where("commit_sha is not null").select("tool_use_id", "commit_sha", "commit_branch"), f"SELECT tool_use_id, left(sha256(tool_use_id), 8) AS commit_sha, 'main' AS commit_branch FROM ({CALLP}) WHERE tool = 'Bash'")
entry("e19_test_runner", lambda S: C.command_facts(E.tool_uses(P_(S)).select(F.get_json_object("input", "$.command").alias("command"))).select("command", "test_runner"), f"WITH {CONV} SELECT DISTINCT CASE WHEN n % 2 = 0 THEN 'git commit -m ''x ' || tag || '''' ELSE 'cd t' || turn || ' && pytest -q ' || tag || '.py | tail -3' END AS command, CASE WHEN n % 2 = 1 THEN 'pytest' END AS test_runner {ASSISTANT}")
entry("e20_agent_totals", lambda S: E.agent_totals(P_(S).withColumn("path", F.regexp_replace("path", "/s([0-9]+).jsonl", "/subagents/agent-a$1.jsonl"))), f"WITH {CONV}, l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY ms DESC) AS r {ASSISTANT}) SELECT 'a' || conv_id AS agent_id, isum(n % 1000 + turn * 1000 + n * 3 % 700 + n) AS total_tokens, count(*) AS tool_uses, max(CASE WHEN r = 1 THEN 'model-' || (conv_id % 3) END) AS model FROM l GROUP BY conv_id")
entry("e21_turn_end", lambda S: E.turn_end(P_(S).where("not (type = 'user' and message.content like '%tool_result%')")).select("session_id", "event", "ts"), f"WITH {CONV}, l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM cv WHERE role <> 'system') SELECT session_id, 'Stop' AS event, ms + 1000 AS ts FROM l WHERE r = 1 AND role = 'assistant' AND n % 4 = 0")
entry("e22_command_segments", lambda S: C.command_segments(E.tool_uses(P_(S)).select("tool_use_id", F.get_json_object("input", "$.command").alias("command"))).select("tool_use_id", "seq", "program", "args", "conditional", "parse_status"),
      f"""WITH {CONV} SELECT 't' || tag AS tool_use_id, k AS seq, CASE WHEN n % 2 = 0 THEN 'git' WHEN k = 0 THEN 'cd' WHEN k = 1 THEN 'pytest' ELSE 'tail' END AS program,
      CASE WHEN n % 2 = 0 THEN '["commit", "-m", "x ' || tag || '"]' WHEN k = 0 THEN '["t' || turn || '"]' WHEN k = 1 THEN '["-q", "' || tag || '.py"]' ELSE '["-3"]' END AS args, CASE WHEN n % 2 = 1 AND k = 1 THEN 1 ELSE 0 END AS conditional, 'ok' AS parse_status
      FROM cv CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) WHERE role = 'assistant' AND (k = 0 OR n % 2 = 1)""")
entry("e24_parts_to_refresh", lambda S: C.parts_to_refresh(S.calls, S.command_parts, 3).select("tool_use_id"), "SELECT tool_use_id FROM {calls} WHERE tool = 'Bash' AND (tool_use_id NOT IN (SELECT tool_use_id FROM {command_parts}) OR tool_use_id IN (SELECT tool_use_id FROM {command_parts} WHERE parse_status = 'unparsed'))")
entry("e25_chat_titles", lambda S: E.chat_titles(P_(S)), f"WITH {CONV} SELECT session_id, trim(regexp_replace(left(text, 20) || chr(10) || ' x', '\\s+', ' ', 'g')) AS title FROM cv WHERE turn = 0")
entry("e26_task_notices", lambda S: E.task_notices(P_(S).withColumn("message", F.col("message").withField("content", F.concat(F.lit("<task-id>a"), F.col("line_no").cast("string"), F.lit("</task-id><status>"), F.when(F.col("line_no") % 20 == 0, "done").otherwise(""), F.lit("</status>")))).where("promptId is not null")).groupBy("agent_id").agg(F.count("*").alias("n")), f"WITH {CONV} SELECT 'a' || (turn * 10) AS agent_id, count(*) AS n FROM cv WHERE role NOT IN ('assistant', 'system') AND turn % 3 <> 0 AND turn % 2 = 0 GROUP BY turn")
entry("e27_stop_hook_name", lambda S: E.stop_hooks(P_(S))[1].select("entry_id", "seq", "name"), f"WITH {CONV} SELECT 'h' || tag AS entry_id, seq, name FROM cv CROSS JOIN (VALUES (0, 'lint.sh'), (1, '#' || left(sha256('$X && y'), 8))) AS u(seq, name) WHERE role = 'assistant'")
entry("e28_event_rows", lambda S: E.event_rows(SRC.payloads(X.payload_rows(S))[0], "high").select("event", "session_id", "agent_id", "prompt_id", "ts", "source", "reason", "trigger", "error_type", "permission_mode", "prompt_bytes", "detail"),
      """SELECT event, session_id, agent_id, prompt_id, ts + d AS ts, source, reason, trigger, error_type, permission_mode, prompt_bytes, '{"nonce_bytes":' || (length(event_id) + 1) || '}' AS detail
      FROM {hook_events}, UNNEST(CASE WHEN ts % 3 = 0 THEN [0, 400, 1400] ELSE [0] END) AS u(d)""")
BATCH = lambda S: S.calls.where("request_id is not null").groupBy("session_id", "request_id").agg(F.array_sort(F.collect_list(F.struct("tool_use_id", F.col("tool").alias("tool_name"), F.repeat(F.lit("y"), (F.coalesce("bytes_delivered", F.lit(7)) % 90).cast("int")).alias("tool_response")))).alias("tool_calls")).select(F.lit(5).cast("bigint").alias("received_ms"), F.to_json(F.struct(F.lit("PostToolBatch").alias("hook_event_name"), "session_id", "tool_calls")).alias("payload"))
entry("e30_call_starts", lambda S: E.call_start_rows(SRC.payloads(X.call_payloads(S).withColumn("payload", F.regexp_replace("payload", "PostToolUse(Failure)?", "PreToolUse")))[0]).select("tool_use_id", "session_id", "ts", "tool", "cwd", F.get_json_object("input", "$.command").alias("command"), "test_runner"),
      f"SELECT tool_use_id, session_id, ts + coalesce(duration_ms, 0) AS ts, tool, cwd, CASE WHEN tool = 'Bash' THEN 'git commit -m ''[cut]''' END AS command, NULL AS test_runner FROM ({CALLP})")
entry("e31_batch_rows", lambda S: E.batch_rows(SRC.payloads(BATCH(S))[0], S.calls.where("tool = 'Read'").select("tool_use_id", "request_id")).select("tool_use_id", "bytes_delivered", "request_id"), "SELECT tool_use_id, coalesce(bytes_delivered, 7) % 90 AS bytes_delivered, CASE WHEN tool = 'Read' THEN request_id ELSE 'pending:' || min(tool_use_id) OVER (PARTITION BY request_id) END AS request_id FROM {calls}")
entry("e32_agent_rows", lambda S: E.agent_rows(SRC.payloads(X.payload_rows(S))[0]).groupBy("agent_id").agg(F.min("started").alias("started"), F.max("stopped").alias("stopped")), "SELECT agent_id, min(CASE WHEN event = 'SubagentStart' THEN ts END) AS started, max(CASE WHEN event = 'SubagentStop' THEN ts + CASE WHEN ts % 3 = 0 THEN 1400 ELSE 0 END END) AS stopped FROM {hook_events} WHERE event LIKE 'Subagent%' GROUP BY 1")

# Privacy
entry("p01_sanitize_input", lambda S: S.calls.select("tool_use_id", P.sanitize_input(F.col("tool"), F.col("input")).alias("input")).unionByName(S.table("conversations").select(F.concat_ws("-", "conv_id", "turn").alias("tool_use_id"), P.sanitize_input(F.when(F.col("turn") % 2 == 0, "mcp__x__y").otherwise("Bash"), F.to_json(F.struct(F.concat(F.lit("git commit -m '"), F.translate("text", "'\"\\", ""), F.lit("'")).alias("command"), F.col("text").alias("content"), F.col("role").alias("type"), F.col("turn").alias("n"), F.array("text").alias("list")))).alias("input"))),
      """SELECT tool_use_id, CASE WHEN tool = 'Agent' THEN '{"model":"m1","subagent_type":"' || json_extract_string(input, '$.subagent_type') || '"}' WHEN tool = 'Bash' THEN '{"command":"' || json_extract_string(input, '$.command') || '"}' ELSE '{}' END AS input FROM {calls}
      UNION ALL SELECT conv_id || '-' || turn, '{' || CASE WHEN turn % 2 = 0 THEN '"command_bytes":' || (strlen(t) + 16) ELSE '"command":"git commit -m ''[cut]''"' END || ',"content_bytes":' || strlen(text) || ',"list_bytes":' || strlen(l) || ',"n":' || turn
      || CASE WHEN turn % 2 = 0 THEN ',"type_bytes":' || strlen(role) ELSE ',"operand_bytes":' || (strlen(t) + 2) || ',"type":"' || role || '"' END || '}' FROM (SELECT *, translate(text, '''"\', '') AS t, CAST(to_json([text]) AS VARCHAR) AS l FROM {conversations})""")
entry("p02_cut_url", lambda S: S.table("pages").select("page_id", P.cut_url(F.concat(F.element_at(F.array(F.lit("http://u:p@x@"), F.lit("//me@"), F.lit("")), (F.col("page_id") % 3).cast("int") + 1), F.regexp_replace("url", "^https?://", ""))).alias("url")), "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'http://' WHEN 1 THEN '//' ELSE '' END || regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '', 's') AS url FROM {pages}")
entry("p03_sanitize_error", lambda S: S.calls.select("tool_use_id", P.sanitize_error(F.concat("error", F.when(F.col("duration_ms") % 2 == 0, "\n").otherwise(": "), F.lit("secret")), F.when(F.col("error") == "denied by permission", F.col("error"))).alias("error")), "SELECT tool_use_id, CASE WHEN error IS NULL THEN NULL WHEN error = 'denied by permission' OR duration_ms % 2 = 0 THEN error ELSE 'error text not stored' END AS error FROM {calls}")
entry("p04_sanitize_fault", lambda S: S.faults.select("fault_id", P.sanitize_fault(F.col("stage"), F.concat(F.when(F.col("ts") % 2 == 0, "torn: ").otherwise("part 3 (git): "), "error")).alias("error")), "SELECT fault_id, CASE WHEN stage <> 'parse' THEN CASE WHEN ts % 2 = 0 THEN 'torn: ' ELSE 'part 3 (git): ' END || error WHEN ts % 2 = 0 THEN 'error text not stored (' || (length(error) + 6) || ' bytes)' ELSE 'part 3 (git): error text not stored (' || length(error) || ' bytes)' END AS error FROM {faults}")
entry("p05_sanitize_detail", lambda S: S.table("documents").select("doc_id", P.sanitize_detail(F.to_json(F.struct(F.lit("kept").alias("status"), F.col("text").alias("secret"), F.lit("logout").alias("reason"), F.struct(F.col("n_chars").alias("size"), F.col("text").alias("deep"), F.array("text", F.lit("é")).alias("list")).alias("in"))), F.when(F.col("doc_id") % 2 == 0, "SessionEnd")).alias("detail")),
      """SELECT doc_id, '{"status":"kept","secret_bytes":' || strlen(text) || CASE WHEN doc_id % 2 = 0 THEN ',"reason":"logout"' ELSE ',"reason_bytes":6' END || ',"in":{"size":' || n_chars || ',"deep_bytes":' || strlen(text) || ',"list":[' || strlen(text) || ',2]}}' AS detail FROM {documents}""")
entry("p06_cut_content", lambda S: C.command_facts(S.table("documents").select(F.concat(F.lit("git commit -m 'x"), F.translate("text", "'\"\\", ""), F.lit("' && echo done")).alias("command"))).select("cut", "cut_bytes").distinct(), """SELECT DISTINCT 'git commit -m ''[cut]'' && echo done' AS cut, strlen(translate(text, '''"\\', '')) + 3 AS cut_bytes FROM {documents}""")
entry("p07_redact", lambda S: P.redact(S.calls, S.faults, S.command_parts)[3], """SELECT 'calls.input' AS column, count(*) FILTER (tool IN ('Bash', 'Agent')) AS changed FROM {calls} UNION ALL SELECT 'calls.error', 0 UNION ALL SELECT 'faults.error', count(*) FROM {faults} WHERE stage = 'parse'""")
entry("p08_count_unredacted", lambda S: P.count_unredacted(P.redact(S.calls, S.faults, S.command_parts)[0].unionByName(S.calls.where("tool = 'Bash'"))), "SELECT count(*) AS n FROM {calls} WHERE tool = 'Bash'")

# Merges
SEEN = lambda S: S.hook_events.select("session_id", "ts", F.when(F.col("ts") % 3 == 0, F.concat(F.lit("/d"), (F.col("ts") % 7).cast("string"))).alias("cwd"), F.when(F.col("ts") % 4 == 0, F.concat(F.lit("/t"), (F.col("ts") % 5).cast("string"))).alias("transcript_path"))
entry("m01_merge", lambda S: M.merge(S.requests.select("request_id", "ts", F.when(F.col("ts") % 3 != 0, F.col("model")).alias("model"), "output_tokens", "context_tokens"), S.requests.select(F.when(F.col("ts") % 5 == 0, F.concat(F.lit("new-"), "request_id")).otherwise(F.col("request_id")).alias("request_id"), (F.col("ts") + 5).alias("ts"), F.concat("model", F.lit("!")).alias("model"), (F.col("output_tokens") + 1).alias("output_tokens"), (F.col("context_tokens") - 1).alias("context_tokens")), ["request_id"], {"ts": "min", "model": "fill", "output_tokens": "overwrite", "context_tokens": "max"}),
      """SELECT request_id, ts, CASE WHEN ts % 3 <> 0 THEN model WHEN ts % 5 <> 0 THEN model || '!' END AS model, CASE WHEN ts % 5 <> 0 THEN output_tokens + 1 ELSE output_tokens END AS output_tokens, context_tokens FROM {requests}
      UNION ALL SELECT 'new-' || request_id, ts + 5, model || '!', output_tokens + 1, context_tokens - 1 FROM {requests} WHERE ts % 5 = 0""")
entry("m02_claim_occurrences", lambda S: M.claim_occurrences(SRC.payloads(X.payload_rows(S))[0].select("hash", "event", "session_id", F.get_json_object("payload", "$.nonce").alias("nonce"), "received_ms")).select("event", "session_id", "nonce", "received_ms", "ts", F.col("event_id").contains(":").alias("later")),
      "SELECT event, session_id, event_id || '!' AS nonce, ts + d AS received_ms, CASE d WHEN 1400 THEN ts + 1400 ELSE ts END AS ts, d = 1400 AS later FROM {hook_events}, UNNEST(CASE WHEN ts % 3 = 0 THEN [0, 400, 1400] ELSE [0] END) AS u(d)")
entry("m03_touch_sessions", lambda S: M.touch_sessions(SEEN(S)), """WITH e AS (SELECT session_id, ts, CASE WHEN ts % 3 = 0 THEN '/d' || (ts % 7) END AS cwd, CASE WHEN ts % 4 = 0 THEN '/t' || (ts % 5) END AS tp FROM {hook_events})
 SELECT session_id, min(ts) AS first_ts, max(ts) AS last_ts, arg_min(cwd, (ts, cwd)) FILTER (cwd IS NOT NULL) AS cwd, min(ts) FILTER (cwd IS NOT NULL) AS cwd_ts, arg_max(tp, (ts, tp)) FILTER (tp IS NOT NULL) AS transcript_path, max(ts) FILTER (tp IS NOT NULL) AS transcript_path_ts FROM e GROUP BY session_id""")
entry("m04_refresh_sessions", lambda S: M.refresh_sessions(S.sessions.select("session_id"), S.hook_events.withColumn("model", F.lit("started")), S.requests), """SELECT s.session_id, (SELECT source FROM {hook_events} e WHERE e.session_id = s.session_id AND event = 'SessionStart' ORDER BY ts, event_id LIMIT 1) AS start_source, (SELECT reason FROM {hook_events} e WHERE e.session_id = s.session_id AND event = 'SessionEnd' ORDER BY ts DESC, event_id DESC LIMIT 1) AS end_reason,
 coalesce((SELECT model FROM {requests} r WHERE r.session_id = s.session_id AND agent_id IS NULL AND source IS DISTINCT FROM 'ledger' ORDER BY ts DESC, request_id DESC LIMIT 1), CASE WHEN EXISTS (SELECT 1 FROM {hook_events} e WHERE e.session_id = s.session_id AND event = 'SessionStart') THEN 'started' END) AS model FROM {sessions} s""")
entry("m05_agent_turns", lambda S: M.agent_turns(S.hook_events).select("agent_id", "seq", "started", "stopped", "start_event_id", "stop_event_id"), """WITH e AS (SELECT agent_id, event, event_id, ts, lag(event) OVER w AS b, lead(event) OVER w AS ne, lead(event_id) OVER w AS ni, lead(ts) OVER w AS nt FROM {hook_events} WHERE event IN ('SubagentStart', 'SubagentStop') WINDOW w AS (PARTITION BY agent_id ORDER BY ts, event_id))
 SELECT agent_id, row_number() OVER (PARTITION BY agent_id ORDER BY ts, event_id) AS seq, CASE WHEN event = 'SubagentStart' THEN ts END AS started, CASE WHEN event = 'SubagentStop' THEN ts WHEN ne = 'SubagentStop' THEN nt END AS stopped, CASE WHEN event = 'SubagentStart' THEN event_id END AS start_event_id, CASE WHEN event = 'SubagentStop' THEN event_id WHEN ne = 'SubagentStop' THEN ni END AS stop_event_id FROM e WHERE event = 'SubagentStart' OR b IS DISTINCT FROM 'SubagentStart'""")
PENDING = lambda S: (S.requests.select(F.when(F.col("pending") == 1, F.concat(F.lit("pending:"), "request_id")).otherwise(F.col("request_id")).alias("request_id"), "session_id", "ts", "model", "pending"), S.calls.join(S.requests.select("request_id", "pending"), "request_id").select("tool_use_id", F.when(F.col("pending") == 1, F.concat(F.lit("pending:"), "request_id")).otherwise(F.col("request_id")).alias("request_id")), S.calls.where("tool <> 'Grep'").select("tool_use_id", "request_id"))
entry("m06_resolve_pending", lambda S: M.resolve_pending(*PENDING(S))[0].select("request_id", "ts", "model", "pending"), "WITH f AS (SELECT DISTINCT request_id FROM {calls} WHERE tool <> 'Grep') SELECT CASE WHEN pending = 1 AND f.request_id IS NULL THEN 'pending:' || r.request_id ELSE r.request_id END AS request_id, ts, model, CASE WHEN pending = 1 AND f.request_id IS NULL THEN 1 ELSE 0 END AS pending FROM {requests} r LEFT JOIN f ON f.request_id = r.request_id")
entry("m06_repointed_calls", lambda S: M.resolve_pending(*PENDING(S))[1], "WITH f AS (SELECT DISTINCT request_id FROM {calls} WHERE tool <> 'Grep') SELECT c.tool_use_id, CASE WHEN r.pending = 1 AND f.request_id IS NULL THEN 'pending:' || r.request_id ELSE r.request_id END AS request_id FROM {calls} c JOIN {requests} r ON r.request_id = c.request_id LEFT JOIN f ON f.request_id = r.request_id")
entry("m07_settle", lambda S: M.settle(S.requests.where("pending = 1 or source = 'hook'"), S.requests.select("request_id", "session_id", "agent_id", F.col("ts"), (F.col("output_tokens") + 1).alias("output_tokens"), F.lit("transcript").alias("source")), S.sessions.select("session_id", (F.col("first_ts") + 1000).alias("first_ts"))).select("request_id", "output_tokens", "pending", "source"),
      """WITH o AS (SELECT * FROM {requests} WHERE pending = 1 OR source = 'hook'), n AS (SELECT r.request_id, r.output_tokens + 1 AS output_tokens, r.ts, s.first_ts + 1000 AS f FROM {requests} r JOIN {sessions} s USING (session_id))
      SELECT coalesce(o.request_id, n.request_id) AS request_id, coalesce(n.output_tokens, o.output_tokens) AS output_tokens, CASE WHEN n.request_id IS NOT NULL THEN 0 ELSE o.pending END AS pending, coalesce(o.source, CASE WHEN n.request_id IS NOT NULL THEN 'transcript' END) AS source FROM o FULL JOIN n ON o.request_id = n.request_id WHERE o.request_id IS NOT NULL OR n.ts >= n.f""")
entry("m08_recount", lambda S: M.recount(S.requests, S.calls).select("request_id", "calls"), "SELECT r.request_id, count(c.tool_use_id) AS calls FROM {requests} r LEFT JOIN {calls} c ON c.request_id = r.request_id GROUP BY 1")
entry("m09_merge_session_costs", lambda S: M.merge_session_costs(S.session_costs.drop("model_a", "usd_a"), S.session_costs.select("session_id", (F.col("ts") - 7).alias("ts"), "started", (F.col("cost_usd") * 2).alias("cost_usd"), "api_ms", "api_no_retry_ms", "tool_ms", F.when(F.col("api_ms") % 2 == 0, F.col("wall_ms") + 1).otherwise(F.col("wall_ms") - 1).alias("wall_ms"))).select("session_id", "ts", "cost_usd", "wall_ms"),
      "SELECT session_id, ts, CASE WHEN wall_ms IS NOT NULL AND api_ms % 2 = 0 THEN cost_usd * 2 ELSE cost_usd END AS cost_usd, CASE WHEN wall_ms IS NOT NULL AND api_ms % 2 = 0 THEN wall_ms + 1 ELSE wall_ms END AS wall_ms FROM {session_costs}")
entry("m10_best_ledger", lambda S: M.best_ledger(SRC.ledger(X.ledger_lines(S))[0]).select("request_id", "cost", "rank", "partial"), f"WITH {LEDGER} SELECT api AS request_id, cost, rank, partial FROM lb WHERE best = 1")
HELD = lambda S: S.requests.where("stop_reason = 'end_turn'").select("request_id", "api_request_id")
entry("m11_join_ledger", lambda S: M.join_ledger(S.requests.where("source <> 'ledger' or source is null").withColumn("api_request_id", F.when(F.col("cache_read_tokens") % 2 == 0, F.col("api_request_id"))), SRC.ledger(X.ledger_lines(S))[0], HELD(S))[0].select("request_id", "cost_usd_micros", "cost_source", "source"),
      f"""WITH {LEDGER}, b AS (SELECT * FROM lb WHERE best = 1), o AS (SELECT *, CASE WHEN cache_read_tokens % 2 = 0 OR stop_reason = 'end_turn' THEN api_request_id END AS api FROM {{requests}} WHERE source IS DISTINCT FROM 'ledger')
      SELECT request_id, coalesce(b.cost, cost_usd_micros) AS cost_usd_micros, CASE WHEN b.cost IS NOT NULL THEN 'ledger' ELSE cost_source END AS cost_source, source FROM o LEFT JOIN b ON b.api = o.api
      UNION ALL SELECT b.api, b.cost, CASE WHEN b.cost IS NOT NULL THEN 'ledger' END, 'ledger' FROM b WHERE b.api NOT IN (SELECT api FROM o WHERE api IS NOT NULL) AND b.api NOT IN (SELECT api_request_id FROM {{requests}} WHERE stop_reason = 'end_turn')""")
LINES = "path string, line_no bigint, raw string"


def REPLAYED(S: StandIns, parts: int = 9) -> DataFrame:
    """Transcripts and ledger, each cut in files that micro-batches follow one by one; the ledger's runs are merged in between."""
    folder = scratch(S.spark)
    store = ingest.open_store(S.spark, f"{folder}/store")
    for name, lines, files, start in (("transcripts", X.transcripts(S), 3, ingest.transcript_batches), ("ledger", X.message_ledger(S), parts, ingest.ledger_batches)):
        lines.select("path", F.col("line_no").cast("bigint").alias("line_no"), "raw").repartition(files, F.xxhash64("raw")).write.parquet(f"{folder}/{name}")
        stream = S.spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name}")
        start(stream, store, f"{folder}/{name}-checkpoint").awaitTermination()
    store.compact("ledger")
    return ingest.requests(store)[0].select("request_id", "session_id", "prompt_id", "output_tokens", "cost_usd_micros", "cost_source", "source")


entry("m12_ledger_replay", REPLAYED, f"""WITH {CONV}, a AS (SELECT * FROM cv WHERE role = 'assistant'),
 ld AS (SELECT session_id, 'req' || tag AS api, n % 900 AS cost, 2 AS rank FROM a WHERE n % 4 <> 0 UNION ALL SELECT session_id, 'req' || tag, n % 700, 3 FROM a WHERE n % 8 = 1 UNION ALL SELECT session_id, 'side_' || tag, n % 50, 1 FROM a WHERE n % 10 = 0),
 b AS (SELECT api, arg_max(cost, rank) AS cost, any_value(session_id) AS session_id FROM ld GROUP BY api)
 SELECT 'm' || tag AS request_id, a.session_id, a.prompt_id, a.n AS output_tokens, b.cost AS cost_usd_micros, CASE WHEN b.cost IS NOT NULL THEN 'ledger' END AS cost_source, CAST(NULL AS VARCHAR) AS source FROM a LEFT JOIN b ON b.api = 'req' || tag
 UNION ALL SELECT api, session_id, NULL, NULL, cost, 'ledger', 'ledger' FROM b WHERE starts_with(api, 'side_')""")
entry("r24_ledger_notes", lambda S: M.join_ledger(S.requests.where("source <> 'ledger' or source is null"), SRC.ledger(X.ledger_lines(S))[0], HELD(S))[1], f"""WITH {LEDGER}, b AS (SELECT * FROM lb WHERE best = 1), o AS (SELECT api_request_id AS api FROM {{requests}} WHERE source IS DISTINCT FROM 'ledger'), h AS (SELECT api_request_id AS api FROM {{requests}} WHERE stop_reason = 'end_turn')
 SELECT 'side calls' AS kind, count(*) AS count FROM b WHERE api NOT IN (SELECT api FROM o) AND api NOT IN (SELECT api FROM h) UNION ALL SELECT 'held but unrecorded', count(*) FROM b WHERE api NOT IN (SELECT api FROM o) AND api IN (SELECT api FROM h) UNION ALL SELECT 'priced', count(*) FROM b JOIN o USING (api) WHERE cost IS NOT NULL""")
TURNS5 = lambda S: M.agent_turns(S.hook_events)
CUT = 1_705_500_000_000
entry("m18_recoverable_sessions", lambda S: M.recoverable_sessions(S.sessions, S.calls, S.requests, TURNS5(S), S.hook_events, CUT), f"""WITH q AS (SELECT * FROM {{sessions}} WHERE last_ts < {CUT}), p AS (SELECT session_id, max(ts) FILTER (event = 'UserPromptSubmit') AS p, max(ts) FILTER (event IN ('Stop', 'StopFailure')) AS e FROM {{hook_events}} GROUP BY 1),
 a AS (SELECT session_id, event, lag(event) OVER w AS b, lead(event) OVER w AS n FROM {{hook_events}} WHERE event LIKE 'Subagent%' WINDOW w AS (PARTITION BY agent_id ORDER BY ts, event_id))
 SELECT session_id, 'open call' AS reason FROM q WHERE session_id IN (SELECT session_id FROM {{calls}} WHERE failed IS NULL OR bytes_delivered IS NULL) UNION ALL SELECT session_id, 'pending request' FROM q WHERE session_id IN (SELECT session_id FROM {{requests}} WHERE pending = 1)
 UNION ALL SELECT session_id, 'open agent turn' FROM q WHERE session_id IN (SELECT session_id FROM a WHERE (event = 'SubagentStart' AND n IS DISTINCT FROM 'SubagentStop') OR (event = 'SubagentStop' AND b IS DISTINCT FROM 'SubagentStart')) UNION ALL SELECT session_id, 'missing turn end' FROM q WHERE session_id IN (SELECT session_id FROM p WHERE p IS NOT NULL AND (e IS NULL OR e < p))
 UNION ALL SELECT session_id, 'missing or lost session end' FROM q WHERE end_reason IS NULL OR end_reason IN ('never', 'lost')""")
entry("m19_rebuild_calls", lambda S: M.rebuild_calls(E.tool_uses(P_(S)), E.tool_results(P_(S)), E.tool_uses(P_(S)).where("tool_use_id like '%1'")).select("tool_use_id", "failed", "bytes_delivered", "source"), f"WITH {CONV} SELECT 't' || tag AS tool_use_id, CASE WHEN n % 5 = 3 THEN 1 ELSE 0 END AS failed, strlen({RESULT}) AS bytes_delivered, 'transcript' AS source {ASSISTANT} AND 't' || tag NOT LIKE '%1'")
#: A Stop of each session, as if read from its transcript: about its last row, some before its latest prompt.
ENDS = lambda S: S.sessions.select("session_id", F.lit("Stop").alias("event"), F.lit(None).cast("string").alias("error_type"), (F.col("last_ts") + (F.col("first_ts") % 3 - 1) * 50).alias("ts"))
END_SQL = "(last_ts + (first_ts % 3 - 1) * 50)"
entry("m20_rebuild_turn_ends", lambda S: M.rebuild_turn_ends(S.hook_events, ENDS(S)).select("session_id", "event", "prompt_id", "ts", "detail", F.length("event_id").alias("id_length")),
      f"WITH {OPEN_SQL} SELECT session_id, 'Stop' AS event, p_prompt AS prompt_id, greatest(p_ts, {END_SQL}) AS ts, '{M.REBUILT}' AS detail, 64 AS id_length FROM op JOIN {{sessions}} USING (session_id) WHERE p_ts <= {END_SQL}")


def WITH_REBUILT(S: StandIns) -> DataFrame:
    """Events, the rebuilt ends of open prompts, and later real ends: of the same prompt where its time is even, of another one where it is a multiple of 3, else of none."""
    rebuilt = M.rebuild_turn_ends(S.hook_events, ENDS(S))
    late = M.open_prompts(S.hook_events).where("p.ts % 5 <> 0").select(F.concat(F.lit("late"), "p.event_id").alias("event_id"), F.lit("Stop").alias("event"), "session_id", F.when(F.col("p.ts") % 2 == 0, F.col("p.prompt_id")).when(F.col("p.ts") % 3 == 0, "another").alias("prompt_id"), (F.col("p.ts") + F.when(F.col("p.ts") % 7 == 0, -1).otherwise(1)).alias("ts"))
    return S.hook_events.select("event_id", "event", "session_id", "agent_id", "prompt_id", "ts", "detail").unionByName(rebuilt.select("event_id", "event", "session_id", "prompt_id", "ts", "detail"), allowMissingColumns=True).unionByName(late, allowMissingColumns=True)


# a real end replaces the rebuilt one if it is not before the prompt, and of its prompt, if both name one
entry("m20_drop_rebuilt", lambda S: M.drop_rebuilt(WITH_REBUILT(S)).where(F.col("detail") == M.REBUILT).select("session_id", "prompt_id", "ts"),
      f"""WITH {OPEN_SQL}, l AS (SELECT *, CASE WHEN p_ts % 2 = 0 THEN p_prompt WHEN p_ts % 3 = 0 THEN 'another' END AS q FROM op JOIN {{sessions}} USING (session_id) WHERE p_ts <= {END_SQL}),
      real_ends AS (SELECT session_id, prompt_id, ts FROM {{hook_events}} WHERE event IN ('Stop', 'StopFailure') UNION ALL SELECT session_id, q, p_ts + CASE WHEN p_ts % 7 = 0 THEN -1 ELSE 1 END FROM l WHERE p_ts % 5 <> 0)
      SELECT session_id, p_prompt AS prompt_id, greatest(p_ts, {END_SQL}) AS ts FROM l WHERE NOT EXISTS (SELECT 1 FROM real_ends r WHERE r.session_id = l.session_id AND r.ts >= p_ts AND (r.prompt_id IS NULL OR p_prompt IS NULL OR r.prompt_id = p_prompt))""")
entry("m21_rebuild_agent_stops", lambda S: M.rebuild_agent_stops(TURNS5(S), S.hook_events.where("event = 'SubagentStart' and agent_id like '%-0'").select("agent_id", (F.col("ts") + 9).alias("ts")), S.hook_events.where("event = 'SubagentStart'").select("agent_id", (F.col("ts") + 4).alias("ts"))), """WITH e AS (SELECT agent_id, event, ts, event_id, lag(event) OVER w AS b, lead(event) OVER w AS n FROM {hook_events} WHERE event LIKE 'Subagent%' WINDOW w AS (PARTITION BY agent_id ORDER BY ts, event_id)), t AS (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY ts, event_id) AS seq FROM e WHERE event = 'SubagentStart' OR b IS DISTINCT FROM 'SubagentStart'),
 l AS (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY seq DESC) AS r FROM t) SELECT agent_id, seq, ts + CASE WHEN agent_id LIKE '%-0' THEN 9 ELSE 4 END AS stopped FROM l WHERE r = 1 AND event = 'SubagentStart' AND n IS DISTINCT FROM 'SubagentStop'""")
entry("m22_end_reasons", lambda S: M.end_reasons(S.sessions, S.hook_events, S.faults), """WITH e AS (SELECT session_id, max(ts) FILTER (event = 'SessionStart') AS st, max(ts) FILTER (event = 'SessionEnd') AS en, arg_max(reason, ts) FILTER (event = 'SessionEnd') AS reason FROM {hook_events} GROUP BY 1), f AS (SELECT session_id, max(ts) AS lost FROM {faults} WHERE error LIKE '%SessionEnd%' GROUP BY 1)
 SELECT s.session_id, CASE WHEN en >= coalesce(st, 0) THEN reason WHEN lost // 1000 >= coalesce(st, 0) // 1000 THEN 'lost' WHEN st IS NOT NULL THEN 'never' END AS end_reason FROM {sessions} s LEFT JOIN e USING (session_id) LEFT JOIN f USING (session_id)""")
UNFILLED = lambda S: M.unfilled(S.hook_events, S.agents.withColumn("seq", F.lit(1)), S.calls, S.requests)
UNFILLED_SQL = f"""{OPEN_SQL}, un AS (
 SELECT session_id, NULL AS tool_use_id, stopped AS ts, 'agent turn' AS kind, 'agent ' || agent_id || ' turn stopped ' || stopped || ': {M.UNFILLED['agent turn'].replace("'", "''")}' AS error, true AS once FROM {{agents}} a
 WHERE stopped IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {{requests}} r WHERE r.agent_id = a.agent_id AND r.ts BETWEEN a.started AND a.stopped)
 UNION ALL SELECT session_id, NULL, ts, 'stop reply', 'prompt ' || prompt_id || ' Stop ' || event_id || ': {M.UNFILLED['stop reply'].replace("'", "''")}', true FROM {{hook_events}} h
 WHERE event = 'Stop' AND prompt_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {{requests}} r WHERE r.session_id = h.session_id AND r.prompt_id = h.prompt_id AND r.agent_id IS NULL AND r.stop_reason = 'end_turn')
 UNION ALL SELECT session_id, NULL, p_ts, 'turn end', 'prompt ' || coalesce(p_prompt, '-') || ' UserPromptSubmit ' || p_id || ': {M.UNFILLED['turn end'].replace("'", "''")}', false FROM op
 UNION ALL SELECT session_id, tool_use_id, coalesce(ts, 0), 'call', 'call ' || tool_use_id || ': {M.UNFILLED['call'].replace("'", "''")}', false FROM {{calls}} WHERE (bytes_real IS NULL AND bytes_delivered IS NULL) OR request_id IS NULL
 UNION ALL SELECT session_id, NULL, coalesce(started, 0), 'agent stop', 'agent ' || agent_id || ' turn 1 open: {M.UNFILLED['agent stop'].replace("'", "''")}', false FROM {{agents}} WHERE stopped IS NULL)"""
entry("m23_unfilled", UNFILLED, f"WITH {UNFILLED_SQL} SELECT * FROM un")
# of the sessions whose last row's time leaves 1 and 2 by 3, what is open is marked already, after that row and before it
MARKED = lambda S: UNFILLED(S).join(S.sessions.where("last_ts % 3 <> 0").select("session_id", "last_ts"), "session_id").select("session_id", "error", F.lit("transcript").alias("stage"), (F.col("last_ts") + F.when(F.col("last_ts") % 3 == 1, 1).otherwise(-1)).alias("ts"))
entry("m23_mark_unfillable", lambda S: M.mark_unfillable(UNFILLED(S), MARKED(S), S.sessions).select("session_id", "tool_use_id", "ts", "stage", "error"),
      f"WITH {UNFILLED_SQL} SELECT session_id, tool_use_id, CASE WHEN once THEN ts ELSE last_ts END AS ts, 'transcript' AS stage, error FROM un JOIN {{sessions}} USING (session_id) WHERE last_ts % 3 = 0 OR (NOT once AND last_ts % 3 = 2)")
entry("m24_insert_lost_faults", lambda S: M.insert_lost_faults(S.faults.select(F.lit(1).alias("ts"), "stage", F.lit("s").alias("session_id"), "error").where("stage <> 'binary'"), S.faults.select(F.lit(1).alias("ts"), "stage", F.lit("s").alias("session_id"), "error").unionByName(S.faults.where("stage = 'store'").select(F.lit(1).alias("ts"), "stage", F.lit("s").alias("session_id"), "error"))), "SELECT 1 AS ts, stage, 's' AS session_id, error FROM {faults} WHERE stage IN ('binary', 'store')")
def RETAINED(S: StandIns) -> DataFrame:
    # what is asked of calls and agents is fenced, as parts, agents and archives are made of them again
    S.made["calls"] = fenced(S.calls.select("tool_use_id", "session_id", "agent_id", "agent_type", "request_id", "ts", "duration_ms", "tool", "bytes_delivered"))
    agents = fenced(S.agents.select("agent_id", "started", "stopped", "total_tokens"))
    tables = {"calls": S.calls, "requests": S.requests, "command_parts": S.command_parts, "agents": agents, "sessions": S.sessions}
    archives = {"agents": agents.withColumn("total_tokens", F.lit(0).cast("bigint")), "command_parts": S.command_parts.where("seq = 0").withColumn("parser", F.lit(0))}
    key = {"calls": F.col("tool_use_id"), "requests": F.col("request_id"), "command_parts": F.concat_ws("#", "tool_use_id", F.col("seq").cast("string")), "agents": F.col("agent_id"), "sessions": F.col("session_id")}
    more = {"agents": F.col("total_tokens"), "command_parts": F.col("parser").cast("bigint")}
    rows = [df.select(F.lit(n).alias("name"), "place", key[n].alias("id"), more.get(n, F.lit(None).cast("bigint")).alias("value")) for n, df in M.place(tables, archives, SINCE).items()]
    return reduce(lambda a, b: a.unionByName(b), rows)


# archived agents give way to those that aged out; the archive's copies of first parts differ, so they stay in both
entry("m25_retention", RETAINED, f"""WITH oldr AS (SELECT request_id FROM {{requests}} WHERE ts < {SINCE}), oldc AS (SELECT c.tool_use_id FROM {{calls}} c LEFT JOIN {{requests}} r ON r.request_id = c.request_id WHERE coalesce(c.ts, r.ts) < {SINCE}),
 a AS (SELECT *, coalesce(coalesce(stopped, started) < {SINCE}, false) AS old FROM {{agents}}), p AS (SELECT tool_use_id || '#' || seq AS id, seq, parser, tool_use_id IN (SELECT tool_use_id FROM oldc) AS old FROM {{command_parts}})
 SELECT 'calls' AS name, CASE WHEN tool_use_id IN (SELECT tool_use_id FROM oldc) THEN 'archive' ELSE 'kept' END AS place, tool_use_id AS id, NULL AS value FROM {{calls}}
 UNION ALL SELECT 'requests', CASE WHEN request_id IN (SELECT request_id FROM oldr) THEN 'archive' ELSE 'kept' END, request_id, NULL FROM {{requests}}
 UNION ALL SELECT 'sessions', CASE WHEN last_ts < {SINCE} THEN 'archive' ELSE 'kept' END, session_id, NULL FROM {{sessions}}
 UNION ALL SELECT 'agents', 'kept', agent_id, total_tokens FROM a WHERE NOT old UNION ALL SELECT 'agents', 'archive', agent_id, CASE WHEN old THEN total_tokens ELSE 0 END FROM a
 UNION ALL SELECT 'command_parts', 'kept', id, parser FROM p WHERE seq = 0 OR NOT old UNION ALL SELECT 'command_parts', 'archive', id, CASE WHEN seq = 0 THEN 0 ELSE parser END FROM p WHERE seq = 0 OR old""")
entry("m26_union_archive", lambda S: M.union_archive(S.requests.where("pending = 0").select("request_id", "model"), S.requests.select("request_id", F.lit("old").alias("model")), ["request_id"]), "SELECT request_id, CASE WHEN pending = 0 THEN model ELSE 'old' END AS model FROM {requests}")
entry("m27_settle_calls", lambda S: M.settle_calls(S.calls.select("tool_use_id", "failed", "bytes_delivered", F.lit(None).cast("string").alias("outcome"), "bytes_real"), S.calls.where("tool = 'Bash'").select("tool_use_id", F.lit(11).cast("bigint").alias("bytes"), F.lit(0).alias("failed"), F.lit(None).cast("string").alias("outcome"), F.lit(12).cast("bigint").alias("real"))).select("tool_use_id", "failed", "bytes_delivered", "bytes_real"),
      "SELECT tool_use_id, CASE WHEN tool = 'Bash' AND (failed IS NULL OR bytes_delivered IS NULL) THEN coalesce(failed, 0) ELSE failed END AS failed, CASE WHEN tool = 'Bash' AND (failed IS NULL OR bytes_delivered IS NULL) THEN coalesce(bytes_delivered, 11) ELSE bytes_delivered END AS bytes_delivered, CASE WHEN tool = 'Bash' AND (failed IS NULL OR bytes_delivered IS NULL) THEN coalesce(bytes_real, 12) ELSE bytes_real END AS bytes_real FROM {calls}")
entry("m28_insert_earliest", lambda S: M.insert_earliest(S.hook_events.select(F.concat("session_id", F.lit("/"), "event").alias("event_id"), "ts", F.col("event_id").alias("v"))), "SELECT session_id || '/' || event AS event_id, min(ts) AS ts, arg_min(event_id, (ts, event_id)) AS v FROM {hook_events} GROUP BY 1")

# Classification
#: By turns, commands of shell calls that hold the call's duration d; what the rules say of each; the programs of its parts, as path, seq and program.
SHELL_CASES = [
    ("git status && sed -i s/a/b/ x{d}.py", "edit,read", ["|0|git", "|1|sed"]),
    ("cat f{d}.py | head -3", "read", ["|0|cat", "|1|head"]),
    ("docker exec c bash -c 'pytest -q t{d}.py; sleep 1'", "test,wait", ["|0|docker", "/0|0|pytest", "/0|1|sleep"]),
    ("echo hi > out{d}.txt", "edit", ["|0|echo"]),
    ("sleep 5; ls d{d}", "read,wait", ["|0|sleep", "|1|ls"]),
    ("odd {d} 'quote", "other", ["|0|"]),
    ("git log -{d} | grep x > o.txt", "search,read,capture", ["|0|git", "|1|grep"]),
    ("jq . a{d}.json > t && mv t a{d}.json", "edit,housekeeping,read,capture", ["|0|jq", "|1|mv"]),
    ("find . -name x{d} -exec rm {{}} \\;", "housekeeping,search", ["|0|find"]),
    ("npm run build-{d} && echo $? >> log", "test,capture", ["|0|npm", "|1|echo"]),
    ("cat > n{d}.py <<'EOF'\nrm -r x; pytest\nEOF", "edit", ["|0|cat"]),
    ("git stash list; git branch b{d}", "git,read", ["|0|git", "|1|git"]),
    ("cd d{d} && export A=1", "other", ["|0|cd", "|1|export"]),
    ("printf %s {d} | tee f{d}.txt", "edit", ["|0|printf", "|1|tee"]),
    ("python3 -m pytest t{d}.py 2>&1 | tail -5", "test", ["|0|python3", "|1|tail"]),
    ("box.sh -v run go build ./p{d}", "test", ["|0|box.sh", "/0|0|go"]),
]
SHELL_RULES = [("wrapper", "box.sh", "run", None), ("tool", "Grep", None, "read")]


def COMMANDS(S: StandIns) -> DataFrame:
    d = F.coalesce("duration_ms", F.lit(0))
    parts = [[F.lit(x) for x in c.replace("{{}}", "{}").split("{d}")] for c, _, _ in SHELL_CASES]
    texts = [F.concat(*[y for x in p for y in (x, d.cast("string"))][:-1]) for p in parts]
    return S.calls.select(F.col("tool_use_id").alias("id"), "tool", F.when(F.col("tool") == "Bash", F.element_at(F.array(*texts), (d % len(texts)).cast("int") + 1)).alias("command"))


def of_case(values: list[str]) -> str:
    return f"CASE coalesce(duration_ms, 0) % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


entry("k01_classify", lambda S: K.classify(COMMANDS(S), S.spark.createDataFrame(SHELL_RULES, K.RULES_DDL)).select("id", "class", F.array_join("classes", ",").alias("classes"), "status"),
      f"""WITH k AS (SELECT tool_use_id AS id, CASE tool WHEN 'Bash' THEN {of_case([f"'{c}'" for _, c, _ in SHELL_CASES])} WHEN 'Grep' THEN 'read' WHEN 'Read' THEN 'read' WHEN 'Agent' THEN 'spawn' ELSE 'edit' END AS classes,
      CASE WHEN tool = 'Bash' AND coalesce(duration_ms, 0) % {len(SHELL_CASES)} = 5 THEN 'error' ELSE 'ok' END AS status FROM {{calls}}) SELECT id, split_part(classes, ',', 1) AS class, classes, status FROM k""")
# by the rules: a directory change, an echo and a reader without operands have no class; sed -n with a script only filters, and its output goes to a file; the rule says that a grep of src is a test
entry("k02_part_classes", lambda S: K.part_classes(S.command_parts.withColumnRenamed("tool_use_id", "id"), S.spark.createDataFrame([("test", "grep", "src lib", None)], K.RULES_DDL)).select("id", "seq", F.array_join("classes", ",").alias("classes")),
      """SELECT tool_use_id AS id, seq, CASE program WHEN 'cd' THEN '' WHEN 'git' THEN 'read' WHEN '/usr/bin/cat' THEN '' WHEN 'sed' THEN 'capture' WHEN 'pytest' THEN 'test' WHEN 'echo' THEN '' ELSE 'test' END AS classes FROM {command_parts}""")
entry("k03_expand_wrapped", lambda S: K.expand_wrapped(C.command_segments(COMMANDS(S).where("tool = 'Bash'").withColumnRenamed("id", "tool_use_id")).withColumnRenamed("tool_use_id", "id"), S.spark.createDataFrame(SHELL_RULES, K.RULES_DDL)).select("id", "path", "seq", F.coalesce("program", F.lit("")).alias("program")),
      f"""SELECT id, split_part(p, '|', 1) AS path, CAST(split_part(p, '|', 2) AS INTEGER) AS seq, split_part(p, '|', 3) AS program
      FROM (SELECT tool_use_id AS id, unnest({of_case([str(list(ps)) for _, _, ps in SHELL_CASES])}) AS p FROM {{calls}} WHERE tool = 'Bash')""")
entry("k04_parse_status", lambda S: K.parse_status(S.command_parts.withColumnRenamed("tool_use_id", "id")), "SELECT tool_use_id AS id, coalesce(arg_min(parse_status, seq) FILTER (parse_status <> 'ok'), 'ok') AS status FROM {command_parts} GROUP BY 1")

# Reconciliation
entry("c01_sessions", lambda S: RC.compare_sessions(S.sessions.where("session_id not like '%9'"), S.requests.where("session_id not like '%8'").groupBy("session_id").agg((F.min("ts") - 5).alias("ts"), F.max("model").alias("model"), F.count_if(F.col("pending") == 1).alias("prompts"))).select("class", "session_id"), """WITH s AS (SELECT * FROM {sessions} WHERE session_id NOT LIKE '%9'), t AS (SELECT session_id, min(ts) - 5 AS ts, max(model) AS model, count(*) FILTER (pending = 1) AS prompts FROM {requests} WHERE session_id NOT LIKE '%8' GROUP BY 1)
 SELECT 'session without transcript' AS class, session_id FROM s WHERE session_id NOT IN (SELECT session_id FROM t) UNION ALL SELECT 'session not stored', session_id FROM t WHERE session_id NOT IN (SELECT session_id FROM s) UNION ALL SELECT 'session before first row', session_id FROM s JOIN t USING (session_id) WHERE t.ts < first_ts
 UNION ALL SELECT 'session without model', session_id FROM s JOIN t USING (session_id) WHERE s.model IS NULL AND t.model IS NOT NULL UNION ALL SELECT 'session without prompt', session_id FROM s JOIN t USING (session_id) WHERE prompts = 0""")
READ_CALLS = lambda S: S.calls.where("tool <> 'Grep'").select("tool_use_id", "session_id", "agent_id", F.when(F.col("duration_ms") % 5 == 0, "other").otherwise(F.col("agent_type")).alias("agent_type"), F.when(F.col("file_bytes") % 9 == 0, "x").otherwise(F.col("tool")).alias("tool"), F.when(F.col("duration_ms") % 7 == 0, "?").otherwise(F.col("request_id")).alias("request_id"), F.coalesce("bytes_delivered", F.lit(1)).alias("bytes_delivered"), "failed", F.coalesce("ts", F.lit(5)).alias("ts"))
BATCH_ONLY = "(bytes_delivered IS NOT NULL AND bytes_real IS NULL AND duration_ms IS NULL AND failed IS NULL)"
entry("c02_calls", lambda S: RC.compare_calls(S.calls, READ_CALLS(S)).select("class", "id"), f"""WITH r AS (SELECT * FROM {{calls}} WHERE tool <> 'Grep') SELECT 'call extra' AS class, tool_use_id AS id FROM {{calls}} WHERE tool = 'Grep' UNION ALL SELECT 'call tool', tool_use_id FROM r WHERE file_bytes % 9 = 0
 UNION ALL SELECT 'call without size', tool_use_id FROM r WHERE bytes_delivered IS NULL UNION ALL SELECT 'call agent type', tool_use_id FROM r WHERE duration_ms % 5 = 0 UNION ALL SELECT 'call request_id', tool_use_id FROM r WHERE duration_ms % 7 = 0
 UNION ALL SELECT 'call batch only', tool_use_id FROM {{calls}} WHERE {BATCH_ONLY} UNION ALL SELECT 'call without ts', tool_use_id FROM r WHERE ts IS NULL AND NOT {BATCH_ONLY}""")
entry("c03_requests", lambda S: RC.compare_requests(M.recount(S.requests, S.calls), M.recount(S.requests, S.calls).withColumn("output_tokens", F.when(F.col("output_tokens") % 7 == 0, 1).otherwise(F.col("output_tokens")))).select("class", "id"),
      """WITH c AS (SELECT DISTINCT request_id FROM {calls}) SELECT 'request pending' AS class, request_id AS id FROM {requests} WHERE source IS DISTINCT FROM 'ledger' AND pending = 1 UNION ALL SELECT 'request tokens', request_id FROM {requests} WHERE source IS DISTINCT FROM 'ledger' AND output_tokens % 7 = 0 AND output_tokens <> 1
 UNION ALL SELECT CASE WHEN request_id IN (SELECT request_id FROM c) THEN 'request missing' ELSE 'request untracked' END, request_id FROM {requests} WHERE source = 'ledger'""")
entry("c03_token_sums", lambda S: RC.token_sums(S.requests, S.requests), f"SELECT isum(CASE WHEN {SETTLED} THEN context_tokens END) AS context, isum(CASE WHEN {SETTLED} THEN output_tokens END) AS output, isum(context_tokens) AS read_context, isum(output_tokens) AS read_output FROM {{requests}}")
READ_AGENTS = lambda S: S.agents.where("tool_uses % 4 <> 0").withColumns({"stopped": F.coalesce("stopped", F.lit(5)), "tool_uses": F.when(F.col("tool_uses") % 3 == 0, 0).otherwise(F.col("tool_uses")), "turns": F.when(F.col("tool_uses") % 5 == 0, 2).otherwise(1), "ends": F.array(F.col("stopped") + F.when(F.col("tool_uses") % 7 == 0, 1).otherwise(0))})
entry("c04_agents", lambda S: RC.compare_agents(S.agents, READ_AGENTS(S), S.agents.select("agent_id", F.lit(1).alias("seq"), F.when(F.col("tool_uses") % 9 != 0, F.col("started")).alias("started"), "stopped", (F.col("tool_uses") % 2 == 0).alias("rebuilt"))).select("class", "id"),
      """WITH r AS (SELECT * FROM {agents} WHERE tool_uses % 4 <> 0) SELECT 'agent extra' AS class, agent_id AS id FROM {agents} WHERE tool_uses % 4 = 0 UNION ALL SELECT 'agent tool uses', agent_id FROM r WHERE tool_uses % 3 = 0 UNION ALL SELECT 'agent open turn', agent_id FROM r WHERE stopped IS NULL
 UNION ALL SELECT 'agent turns', agent_id FROM r WHERE tool_uses % 5 = 0 UNION ALL SELECT 'agent turn without start', agent_id || '#1' FROM {agents} WHERE tool_uses % 9 = 0 UNION ALL SELECT 'agent stop rebuilt', agent_id || '#1' FROM {agents} WHERE tool_uses % 2 = 0 AND (tool_uses % 4 = 0 OR stopped IS NULL OR tool_uses % 7 = 0)""")
entry("c05_parts", lambda S: RC.compare_parts(S.calls, S.command_parts, 3).select("class", "id"), "WITH p AS (SELECT c.tool_use_id, max(p.parser) AS v, arg_min(parse_status, seq) FILTER (parse_status <> 'ok') AS st FROM {calls} c LEFT JOIN {command_parts} p ON p.tool_use_id = c.tool_use_id WHERE tool = 'Bash' GROUP BY 1) SELECT 'parts missing' AS class, tool_use_id AS id FROM p WHERE v IS NULL UNION ALL SELECT 'parts ' || st, tool_use_id FROM p WHERE st IS NOT NULL")
entry("c06_events", lambda S: RC.compare_events(S.hook_events, S.hook_events.where("ts % 5 <> 0").select("event_id", "session_id", "event", (F.col("ts") + F.when(F.col("ts") % 3 == 0, 900_000).otherwise(1500)).alias("ts"))).select("class", "session_id", "id"), """WITH b AS (SELECT event_id AS rid, session_id, event, ts + CASE WHEN ts % 3 = 0 THEN 900000 ELSE 1500 END AS rts FROM {hook_events} WHERE ts % 5 <> 0), n AS (SELECT rid, a.event_id, a.event FROM {hook_events} a JOIN b ON a.session_id = b.session_id AND a.event = b.event AND abs(a.ts - b.rts) <= 2000)
 SELECT event || ' missing' AS class, session_id, rid AS id FROM b WHERE rid NOT IN (SELECT rid FROM n) UNION ALL SELECT event || ' extra', session_id, event_id FROM {hook_events} WHERE event_id NOT IN (SELECT event_id FROM n) UNION ALL SELECT n.event || ' repeated', any_value(b.session_id), rid FROM n JOIN b USING (rid) GROUP BY rid, n.event HAVING count(*) > 1""")
entry("c06_compactions", lambda S: RC.compare_compactions(S.hook_events.withColumn("event", F.when(F.col("event") == "Notification", "PostCompact").otherwise(F.col("event"))), S.compactions).select("class", "id"),
      """WITH e AS (SELECT event_id, session_id, ts, CASE WHEN event = 'Notification' THEN 'PostCompact' ELSE event END AS kind FROM {hook_events} WHERE event IN ('PreCompact', 'Notification')), c AS (SELECT * FROM {compactions} WHERE ts IS NOT NULL), k AS (SELECT unnest(['PreCompact', 'PostCompact']) AS kind)
 SELECT k.kind || ' missing' AS class, entry_id AS id FROM c, k WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.kind = k.kind AND e.session_id = c.session_id AND abs(e.ts - c.ts) <= 60000)
 UNION ALL SELECT kind || ' without compaction', event_id FROM e WHERE NOT EXISTS (SELECT 1 FROM c WHERE e.session_id = c.session_id AND abs(e.ts - c.ts) <= 60000)""")
# sessions are put together in tens, so that many faults and rows are in reach of each other; rows are moved by up to 54 s, and a fifth of them is missing
GROUPED = lambda: F.substring("session_id", 1, 2)
FAULT_ROWS = lambda S: S.hook_events.where("event in ('StopFailure', 'SessionEnd', 'Stop') and ts % 5 <> 0").select(F.col("event_id").alias("row_id"), GROUPED().alias("session_id"), (F.col("ts") - F.col("ts") % 7 * 9000).alias("ts"))
entry("c07_pair_faults", lambda S: RC.pair_faults(S.faults.withColumns({"session_id": GROUPED(), "ts": F.col("ts") - F.col("ts") % 400_000}), FAULT_ROWS(S).withColumn("ts", F.col("ts") - F.col("ts") % 50_000)),
      """WITH f AS (SELECT fault_id, substr(session_id, 1, 2) AS g, ts - ts % 400000 AS ts FROM {faults}), r AS (SELECT row_id, g, ts - ts % 50000 AS ts FROM (SELECT event_id AS row_id, substr(session_id, 1, 2) AS g, ts - ts % 7 * 9000 AS ts FROM {hook_events} WHERE event IN ('StopFailure', 'SessionEnd', 'Stop') AND ts % 5 <> 0)),
 c AS (SELECT g, list({'ids': ['f' || fault_id, 'r' || row_id]} ORDER BY abs(f.ts - r.ts), f.ts, r.ts, fault_id, row_id) AS pairs FROM f JOIN r USING (g) WHERE abs(f.ts - r.ts) <= 60000 GROUP BY g),
 t AS (SELECT list_reduce(pairs, lambda a, p: CASE WHEN list_has_any(a.ids, p.ids) THEN a ELSE {'ids': a.ids || p.ids} END).ids AS ids FROM c)
 SELECT substr(ids[2 * k - 1], 2) AS fault_id, substr(ids[2 * k], 2) AS row_id FROM (SELECT ids, unnest(range(1, len(ids) // 2 + 1)) AS k FROM t)""")
#: A third of the turn ends as faults, some without their session; times in steps of twenty minutes, so that many faults and ends of sessions meet.
STEP = 1_200_000
LOST_ENDS = lambda S: S.hook_events.where("event in ('Stop', 'StopFailure') and ts % 3 = 0").select(F.col("event_id").alias("fault_id"), (F.col("ts") - F.col("ts") % STEP).alias("ts"), F.when(F.col("ts") % 5 > 2, F.col("session_id")).alias("session_id"), F.when(F.col("ts") % 2 == 0, "terminated").otherwise("binary").alias("stage"), F.concat("event", F.lit(": terminated by signal")).alias("error"))
MAIN_EVENTS = lambda S: S.hook_events.select("session_id", "agent_id", "event", F.when(F.col("event") == "SessionEnd", F.col("ts") - F.col("ts") % STEP + F.col("ts") % 7000).otherwise(F.col("ts")).alias("ts"))
entry("c07_judge_stops", lambda S: RC.judge_stops(LOST_ENDS(S), MAIN_EVENTS(S)), f"""WITH f AS (SELECT event_id AS fault_id, ts - ts % {STEP} AS ts, CASE WHEN ts % 5 > 2 THEN session_id END AS session_id, event FROM {{hook_events}} WHERE event IN ('Stop', 'StopFailure') AND ts % 3 = 0 AND ((event = 'Stop' AND (ts % 2 = 0 OR ts % 5 > 2)) OR (event = 'StopFailure' AND ts % 5 > 2))),
 m AS (SELECT session_id, event, CASE WHEN event = 'SessionEnd' THEN ts - ts % {STEP} + ts % 7000 ELSE ts END AS ts FROM {{hook_events}} WHERE agent_id IS NULL),
 p AS (SELECT session_id, ts, coalesce(lead(ts) OVER (PARTITION BY session_id ORDER BY ts), 9000000000000000) AS after FROM (SELECT DISTINCT session_id, ts FROM m WHERE event = 'UserPromptSubmit')),
 tn AS (SELECT p.session_id, p.ts AS prompt, after, count(*) FILTER (m.event = 'Stop') > 0 AS stopped, count(*) FILTER (m.event = 'StopFailure') > 0 AS failed FROM p LEFT JOIN m ON m.session_id = p.session_id AND m.event IN ('Stop', 'StopFailure') AND m.ts >= p.ts AND m.ts < after GROUP BY ALL),
 c AS (SELECT f.*, true AS named, f.session_id AS s FROM f WHERE session_id IS NOT NULL UNION ALL SELECT DISTINCT f.*, false, m.session_id FROM f JOIN m ON m.event = 'SessionEnd' AND m.ts >= f.ts AND m.ts < f.ts + 5000 WHERE f.session_id IS NULL),
 x AS (SELECT c.*, prompt, coalesce(stopped, false) AS stopped, coalesce(failed, false) AS failed FROM c LEFT JOIN tn ON tn.session_id = c.s AND tn.prompt < c.ts + 1000 AND tn.after >= c.ts + 1000),
 o AS (SELECT *, row_number() OVER (PARTITION BY s, event, prompt ORDER BY ts, fault_id) AS place, CASE WHEN s NOT IN (SELECT session_id FROM m) THEN 'unknown session' WHEN prompt IS NULL THEN 'no prompt' WHEN NOT stopped AND NOT failed THEN 'open turn' WHEN NOT CASE event WHEN 'Stop' THEN stopped ELSE failed END THEN 'unpaired' END AS told FROM x WHERE named),
 l AS (SELECT fault_id, bool_or(NOT stopped AND NOT failed) AS open FROM x WHERE NOT named AND prompt IS NOT NULL GROUP BY fault_id),
 w AS (SELECT fault_id, ts, false AS named, list(s ORDER BY s) AS ss, list(prompt ORDER BY s) AS ps FROM x JOIN l USING (fault_id) WHERE NOT named AND prompt IS NOT NULL AND stopped AND NOT open GROUP BY fault_id, ts
   UNION ALL SELECT fault_id, ts, true, [s], [prompt] FROM o WHERE told IS NULL AND place = 1 AND event = 'Stop'),
 q AS (SELECT list({{'id': fault_id, 'named': named, 'ss': ss, 'ps': ps, 'used': []::VARCHAR[], 'turns': []::VARCHAR[], 'got': []::VARCHAR[]}} ORDER BY ts, fault_id) AS items FROM w),
 r AS (SELECT list_reduce(list_prepend({{'id': '', 'named': true, 'ss': []::VARCHAR[], 'ps': []::BIGINT[], 'used': []::VARCHAR[], 'turns': []::VARCHAR[], 'got': []::VARCHAR[]}}, items), lambda a, i: list_transform(list_filter(range(1, len(i.ss) + 2), lambda k: k > len(i.ss) OR (NOT list_contains(a.turns, i.ss[k] || '#' || i.ps[k]) AND (i.named OR NOT list_contains(a.used, i.ss[k]))))[1:1],
   lambda k: CASE WHEN k > len(i.ss) THEN a ELSE {{'id': '', 'named': true, 'ss': []::VARCHAR[], 'ps': []::BIGINT[], 'used': CASE WHEN i.named THEN a.used ELSE list_append(a.used, i.ss[k]) END, 'turns': list_append(a.turns, i.ss[k] || '#' || i.ps[k]), 'got': list_append(a.got, i.id || '@' || i.ss[k])}} END)[1]).got AS got FROM q),
 g AS (SELECT split_part(x, '@', 1) AS fault_id, split_part(x, '@', 2) AS s FROM (SELECT unnest(got) AS x FROM r))
 SELECT o.fault_id, event, session_id, coalesce(told, CASE WHEN place = 1 AND (event = 'StopFailure' OR g.s IS NOT NULL) THEN 'paired' ELSE 'unpaired' END) AS verdict FROM o LEFT JOIN g USING (fault_id)
 UNION ALL SELECT f.fault_id, event, g.s, CASE WHEN coalesce(l.open, false) THEN 'open turn' WHEN g.s IS NOT NULL THEN 'paired' ELSE 'unpaired' END FROM f LEFT JOIN l USING (fault_id) LEFT JOIN g USING (fault_id) WHERE session_id IS NULL""")
ALLOWED = [(3, "Stop extra", ["e1", "tool=Bash"], None, "ids"), (5, "Stop extra", ["s2", "e77"], 1_704_300_000_000, "either"), (6, "Stop extra", ["e12"], None, "shadowed by the first"), (8, "Stop missing", [], 1_704_900_000_000, "old"), (9, "Stop missing", ["s1", "tool=Ba"], None, "session"), (12, "never", ["e"], None, "unused")]
ALLOWED_DDL = "entry int, class string, scopes array<string>, before_ts bigint, reason string"
MISSED = lambda S: S.hook_events.where("event = 'Stop'").select(F.when(F.col("ts") % 2 == 0, "Stop extra").otherwise("Stop missing").alias("class"), "session_id", F.when(F.col("ts") % 11 != 0, F.col("ts")).alias("ts"), F.col("event_id").alias("id"), F.when(F.col("ts") % 3 == 0, F.array(F.col("event_id"), F.lit("tool=Bash"))).otherwise(F.array("event_id")).alias("ids"))


def EXPLAINED(S: StandIns) -> DataFrame:
    judged, unused = RC.apply_allowlist(MISSED(S), S.spark.createDataFrame(ALLOWED, ALLOWED_DDL))
    return judged.select("class", "session_id", "id", "verdict", "reason").unionByName(unused.select("class", F.lit(None).cast("string").alias("session_id"), F.lit(None).cast("string").alias("id"), F.lit("unused").alias("verdict"), "reason"))


entry("c08_allowlist", EXPLAINED, f"""WITH e(entry, class, scopes, before_ts, reason) AS (VALUES {", ".join(f"({n}, '{c}', {str(s)}::VARCHAR[], {'NULL' if t is None else t}, '{r}')" for n, c, s, t, r in ALLOWED)}),
 m AS (SELECT CASE WHEN ts % 2 = 0 THEN 'Stop extra' ELSE 'Stop missing' END AS class, session_id, CASE WHEN ts % 11 <> 0 THEN ts END AS ts, event_id AS id, CASE WHEN ts % 3 = 0 THEN [event_id, 'tool=Bash'] ELSE [event_id] END AS ids FROM {{hook_events}} WHERE event = 'Stop'),
 w AS (SELECT m.*, (SELECT min(entry) FROM e WHERE e.class = m.class AND (coalesce(m.ts > 0 AND m.ts < e.before_ts, false)
   OR len(list_filter(e.scopes, lambda s: CASE WHEN starts_with(s, 'tool=') THEN list_contains(m.ids, s) ELSE starts_with(m.session_id, s) OR len(list_filter(m.ids, lambda i: starts_with(i, s))) > 0 END)) > 0)) AS entry FROM m)
 SELECT w.class, session_id, id, CASE WHEN e.entry IS NULL THEN 'unexplained' ELSE 'expected' END AS verdict, e.reason FROM w LEFT JOIN e ON e.entry = w.entry
 UNION ALL SELECT class, NULL, NULL, 'unused', reason FROM e WHERE entry NOT IN (SELECT entry FROM w WHERE entry IS NOT NULL)""")
