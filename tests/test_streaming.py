"""The store and the streams: what they give is what a batch gives, and a batch writes what came in, however much is stored."""

from __future__ import annotations

import json
import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tracewell import schema
from tracewell.operators import extract
from tracewell.sources import raw
from tracewell.streaming import ingest, store as stores
from tracewell.streaming.store import Rule, Store

LARGEST = {"t": Rule(["k"], lambda d: d.groupBy("k").agg(F.max("v").alias("v")))}
PAYLOADS = [(t, json.dumps({"hook_event_name": e, "session_id": "s", "agent_id": a, "cwd": f"/c{t}", "n": n})) for t, e, a, n in [(0, "SubagentStart", "a", 1), (800, "SubagentStart", "a", 1), (1600, "SubagentStart", "a", 1), (2000, "SubagentStop", "a", 2), (9000, "SubagentStop", "a", 3), (9500, "SessionStart", None, 4)]]


def rows(df):
    return sorted(map(str, df.collect()))


def pairs(spark, values):
    return spark.createDataFrame(list(values), "k long, v long")


def size_of(folder):
    return sum(p.stat().st_size for p in Path(folder).rglob("*") if p.is_file())


def test_a_batch_writes_what_came_in_however_much_is_stored(spark, tmp_path):
    written = {}
    for stored in (1_000, 100_000):
        store, folder = Store(spark, f"file://{tmp_path}/{stored}", LARGEST), f"{tmp_path}/{stored}"
        store.append("t", spark.range(stored).select(F.col("id").alias("k"), F.col("id").alias("v")), "first", 0)
        before = size_of(folder)
        for b in range(3):
            store.append("t", spark.range(500).select((F.col("id") * 7 + b).alias("k"), F.lit(10**9 + b).cast("long").alias("v")), "s", b)
        written[stored] = size_of(folder) - before
        assert store.read("t").where(f"v >= {10**9}").count() == len({i * 7 + b for i in range(500) for b in range(3)})
    assert written[100_000] <= 1.2 * written[1_000]


def test_runs_merge_by_levels_and_any_order_gives_the_same(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "FAN", 3)
    rng = random.Random(1)
    batches = [[(rng.randrange(40), rng.randrange(1000)) for _ in range(20)] for _ in range(10)]
    want = {}
    for b in batches:
        for k, v in b:
            want[k] = max(v, want.get(k, -1))
    for seed in (0, 1):
        order = list(range(10))
        random.Random(seed).shuffle(order)
        store = Store(spark, f"file://{tmp_path}/{seed}", LARGEST)
        merges = 0
        for n, b in enumerate(order):
            store.append("t", pairs(spark, batches[b]), "s", n)
            merges += store.compact("t")
        state = store.state("t")
        levels = [r["level"] for r in state["runs"]]
        assert merges >= 3 and max(levels) >= 2 and all(levels.count(k) < 3 for k in levels)
        assert dict(store.read("t").collect()) == want
        store.vacuum("t", 1, 0)
        assert dict(store.read("t").collect()) == want and {p.name for p in (tmp_path / str(seed) / "t" / "runs").iterdir()} == {r["id"] for r in state["runs"]}


def test_a_batch_counts_once_and_new_columns_are_null_before(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", {"t": Rule(["k"], lambda d: d)})
    assert store.read("t") is None and store.compact("t") == 0
    store.append("t", pairs(spark, [(1, 2)]), "a", 0)
    store.append("t", pairs(spark, [(1, 9)]), "a", 0)  # again
    store.append("t", pairs(spark, [(3, 4)]).withColumn("w", F.lit("x")), "b", 0)
    assert rows(store.read("t").select("k", "v", "w")) == ["Row(k=1, v=2, w=None)", "Row(k=3, v=4, w='x')"]
    assert store.state("t")["batches"] == {"a": 0, "b": 0} and store.state("t")["version"] == 2


def test_commits_that_meet_both_count(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", LARGEST)
    other, asked = Store(spark, f"file://{tmp_path}/s", LARGEST), []

    def change(state):
        asked.append(state["version"])
        if len(asked) == 1:  # another writer is faster
            other.append("t", pairs(spark, [(5, 5)]), "other", 0)
        return {**state, "batches": {**state["batches"], "mine": 0}}

    store.append("t", pairs(spark, [(1, 1)]), "first", 0)
    assert store._commit("t", change) and asked == [1, 2]
    assert store.state("t")["batches"] == {"first": 0, "other": 0, "mine": 0} and dict(store.read("t").collect()) == {1: 1, 5: 5}


def test_a_key_is_read_from_its_slot(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", LARGEST)
    store.append("t", pairs(spark, [(i, i) for i in range(100)]), "a", 0)
    store.append("t", pairs(spark, [(7, 700)]), "a", 1)
    one = store.read("t", k=7)
    assert [tuple(r) for r in one.collect()] == [(7, 700)]
    plan = one._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "EqualTo(_slot," in plan
    assert rows(store.read("t", F.col("k") < 2)) == ["Row(k=0, v=0)", "Row(k=1, v=1)"]


def test_payload_stream_gives_what_a_batch_gives(spark, tmp_path):
    store, source = ingest.open_store(spark, f"file://{tmp_path}/store"), tmp_path / "in"
    assert ingest.tables(store) == {} and ingest.requests(store) is None
    source.mkdir()
    order = [3, 0, 5, 1, 4, 2]
    for k in range(3):
        with open(source / f"{k}.json", "w") as f:
            f.writelines(json.dumps({"received_ms": PAYLOADS[i][0], "payload": PAYLOADS[i][1]}) + "\n" for i in order[2 * k : 2 * k + 2])
            f.write(json.dumps({"received_ms": k, "payload": "{}"}) + "\n")
        ingest.payload_stream(spark, str(source), store, f"file://{tmp_path}/cp").awaitTermination()
    good, _ = raw.payloads(spark.createDataFrame(PAYLOADS, "received_ms bigint, payload string"))
    got = ingest.tables(store)
    for name, table in ingest.derived(ingest.deliveries(good)).items():
        assert rows(got[name].select(table.columns)) == rows(table), name
    assert "detail" in got["events"].columns and store.read("faults").count() == 3


def test_ledger_stream_keeps_the_best_line(spark, tmp_path):
    store, source = ingest.open_store(spark, f"file://{tmp_path}/store"), tmp_path / "in"
    source.mkdir()
    (source / "s1.jsonl").write_text('{"request_id":"a","join":"log+span","cost_usd_micros":5}\n{"request_id":"b","join":"span","cost_usd_micros":1}\n{torn\n')
    ingest.ledger_stream(spark, str(source), store, f"file://{tmp_path}/cp").awaitTermination()
    (source / "s1.2.jsonl").write_text('{"request_id":"a","join":"log","cost_usd_micros":9}\n{"request_id":"b","join":"log","cost_usd_micros":2}\n')
    ingest.ledger_stream(spark, str(source), store, f"file://{tmp_path}/cp").awaitTermination()
    assert {r.request_id: r.cost for r in store.read("ledger").collect()} == {"a": 5, "b": 2} and store.read("ledger_faults").count() == 1
    got, summary = ingest.requests(store)
    assert {r.request_id: (r.cost_usd_micros, r.source, r.session_id) for r in got.collect()} == {"a": (5, "ledger", "s1"), "b": (2, "ledger", "s1")}
    assert {r.kind: r["count"] for r in summary.collect()} == {"side calls": 2, "held but unrecorded": 0, "priced": 0}


def test_lines_of_one_file_are_parsed_in_many_tasks(spark, tmp_path, monkeypatch):
    ledger = spark.range(400).selectExpr("'/l/s1.jsonl' AS path", "id AS line_no", """concat('{"request_id":"a', id % 40, '","join":"log","cost_usd_micros":', id % 40, '}') AS raw""")
    said = spark.range(400).selectExpr("'/t/s1.jsonl' AS path", "id AS line_no", """concat('{"type":"user","promptId":"p', id, '"}') AS raw""")
    tasks, store = {}, ingest.open_store(spark, f"file://{tmp_path}/store")

    def spied(name, f):
        def seen(lines):
            tasks[name] = lines.select(F.spark_partition_id().alias("p")).distinct().count()
            return f(lines)

        return seen

    monkeypatch.setattr(raw, "ledger", spied("ledger", raw.ledger))
    monkeypatch.setattr(extract, "parsed", spied("transcripts", extract.parsed))
    for name, lines, start in (("ledger", ledger, ingest.ledger_batches), ("transcripts", said, ingest.transcript_batches)):
        lines.coalesce(1).write.parquet(f"file://{tmp_path}/{name}")
        stream = spark.readStream.schema("path string, line_no bigint, raw string").parquet(f"file://{tmp_path}/{name}")
        start(stream, store, f"file://{tmp_path}/{name}-cp").awaitTermination()
    assert set(tasks) == {"ledger", "transcripts"} and min(tasks.values()) > 1
    assert store.read("ledger").count() == 40 and store.read("prompts").count() == 400
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def message(i, at, **more):
    return json.dumps({"type": "assistant", "sessionId": "s", "timestamp": f"2024-01-01T00:00:{at:02}Z", **more, "message": {"id": i, "model": "a", "content": [], **more.get("message", {})}})


def test_transcripts_prices_and_sessions_meet_in_any_order(spark, tmp_path):
    first = [json.dumps({"type": "user", "promptId": "p1", "sessionId": "s"}), message("m1", 1, requestId="r1"), "{torn"]
    second = [message("m1", 2, message={"stop_reason": "end_turn", "usage": {"input_tokens": 1, "cache_read_input_tokens": 2, "cache_creation_input_tokens": 3, "output_tokens": 7}}), message("m2", 3, requestId="r2")]
    third = [json.dumps({"type": "user", "promptId": "p2", "sessionId": "s"}), message("m3", 9), message("old", 0, requestId="r0")]
    all_lines = [x for x in (*first, *second, *third) if x != "{torn"]
    whole = extract.requests_from_transcript(extract.parsed(spark.createDataFrame([("/s.jsonl", i, x) for i, x in enumerate(all_lines)], "path string, line_no int, raw string")))
    starts = json.dumps({"hook_event_name": "SessionStart", "session_id": "s"})
    received = 1_704_067_201_000
    for case, order in enumerate(([0, 1, 2], [2, 0, 1])):
        folder = tmp_path / str(case)
        source, prices, hooks = folder / "lines", folder / "prices", folder / "hooks"
        store = ingest.open_store(spark, f"file://{folder}/store")
        for f in (source, prices, hooks):
            f.mkdir(parents=True)
        for turn, k in enumerate(order):
            name = source / ("s.jsonl" if k == 0 else f"s.{k}.jsonl")
            name.write_text("\n".join([first, second, third][k]) + "\n")
            os.utime(name, (1_700_000_000 + k, 1_700_000_000 + k))
            ingest.transcript_stream(spark, str(source), store, f"file://{folder}/cp").awaitTermination()
            if turn == case:
                (prices / "s.jsonl").write_text("".join(f'{{"request_id":"{r}","join":"log","cost_usd_micros":{v}}}\n' for r, v in [("r1", 5), ("r0", 6), ("side", 8)]))
                ingest.ledger_stream(spark, str(prices), store, f"file://{folder}/cp2").awaitTermination()
        (hooks / "a.json").write_text(json.dumps({"received_ms": received, "payload": starts}) + "\n")
        ingest.payload_stream(spark, str(hooks), store, f"file://{folder}/cp3").awaitTermination()
        own = [("h1", "s", "side2", 3, "hook", 1)]
        store.append("recorded", schema.conform(spark.createDataFrame(own, "request_id string, session_id string, api_request_id string, cost_usd_micros bigint, source string, ts bigint"), "requests"), "hooks", 0)
        assert rows(ingest.held(store).select(whole.columns)) == rows(whole)
        got, summary = ingest.requests(store)
        found = {r.request_id: (r.prompt_id, r.output_tokens, r.cost_usd_micros, r.source) for r in got.collect()}
        # what is older than its session's first event is not recorded, and so its ledger line is no side call
        assert found == {"m1": ("p1", 7, 5, None), "m2": ("p1", None, None, None), "m3": ("p2", None, None, None), "side": (None, None, 8, "ledger"), "h1": (None, None, 3, "hook")}
        assert {r.kind: r["count"] for r in summary.collect()} == {"side calls": 1, "held but unrecorded": 1, "priced": 1} and store.read("line_faults").count() == 1


@pytest.mark.parametrize("cut", range(4))
def test_parts_of_any_lines_merge_to_those_of_all(spark, cut):
    rng = random.Random(cut)
    lines = []
    for i in range(60):
        if rng.random() < 0.3:
            lines.append(json.dumps({"type": "user", **({"promptId": f"p{i}"} if rng.random() < 0.7 else {})}))
        else:
            usage = {"usage": {"input_tokens": i, "cache_read_input_tokens": 1, "cache_creation_input_tokens": 1, "output_tokens": i}} if rng.random() < 0.6 else {}
            lines.append(message(f"m{rng.randrange(12)}", i % 60, **({"requestId": f"r{i}"} if rng.random() < 0.5 else {}), message={**usage, **({"stop_reason": f"e{i}"} if rng.random() < 0.3 else {})}))
    p = extract.parsed(spark.createDataFrame([(f"/{i % 2}", i, x) for i, x in enumerate(lines)], "path string, line_no int, raw string"))
    half = F.pmod(F.xxhash64("line_no", F.lit(cut)), F.lit(2))
    parts = extract.message_parts(p.where(half == 0)).unionByName(extract.message_parts(p.where(half == 1)))
    once = extract.merge_message_parts(parts)
    assert rows(extract.merge_message_parts(once.unionByName(parts))) == rows(once) == rows(extract.message_parts(p))
    want = extract.requests_from_transcript(p)
    assert rows(extract.requests_of_parts(once, extract.prompt_lines(p)).select(want.columns)) == rows(want)
