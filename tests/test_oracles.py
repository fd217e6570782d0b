"""A query of each kind against its SQL, on the smallest tables; the driver runs them all."""

from __future__ import annotations

import glob
import math
import os
import re
from decimal import Decimal

import pytest

from tracewell.plans import catalog

SF = "/root/testdata/sf0.001"
#: One of each series and of each plan shape; all of them are run by the driver.
NAMES = [
    "r29_cache", "m16_call_results", "m13_price", "r01_files", "r04_call_shape", "r05_context", "r06_sequences", "r12_prompts", "r20_cost_chats", "r26_turns", "r27_resumes", "r28_waiting", "q02_money_per_party", "q04_family", "q09_cost_by_model",
    "f08_recording_notes", "f11_display", "s03_ledger", "e01_requests", "e11_e14_tool_results", "e15_e17_call_rows", "e22_command_segments", "p01_sanitize_input", "p05_sanitize_detail", "m02_claim_occurrences", "m05_agent_turns", "m06_resolve_pending",
    "m07_settle", "m11_join_ledger", "m18_recoverable_sessions", "m20_drop_rebuilt", "m23_mark_unfillable", "m25_retention", "e28_event_rows", "e30_call_starts", "r08_refusals", "k01_classify", "k03_expand_wrapped", "c02_calls", "c04_agents", "c06_events", "c06_compactions", "c07_pair_faults", "c07_judge_stops", "c08_allowlist", "q04_descendants", "s01_split_files", "m12_ledger_replay",
]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no driver tables")
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def cell(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (int, float, Decimal)):
        return "None" if isinstance(value, float) and math.isnan(value) else f"{float(value):.6f}"
    return str(value)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    frame = catalog.queries()[name](spark, SF)
    got = frame.collect()
    found = duck.execute(catalog.oracles()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(frame.columns)
    want = sorted(tuple(cell(v) for _, v in sorted(zip(names, row, strict=True))) for row in found.fetchall())
    assert sorted(tuple(cell(row[c]) for c in sorted(names)) for row in got) == want


def test_retention_deals_calls_once(spark):
    if not os.path.isdir(SF):
        pytest.skip("no driver tables")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = catalog.queries()["m25_retention"](spark, SF)
        frame.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    made = plan[plan.index("Final Plan") : plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    dealt = [found[1] for line in made.splitlines() if "ReusedExchange" not in line and (found := re.search(r"Exchange hashpartitioning\((\w+)#", line))]
    assert [dealt.count(c) for c in ("l_orderkey", "o_orderkey", "tool_use_id")] == [1, 1, 1]


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracles())
