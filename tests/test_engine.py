"""Rules that SQL does not express, on invented records: order of arrival, privacy, runs, commands, streaming against batch."""

from __future__ import annotations

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tracewell import schema
from tracewell.functions import commands, privacy
from tracewell.operators import classify, extract, filters, merge, reconcile
from tracewell.plans import catalog, recipes, reports
from tracewell.sources import raw, sinks


def rows(df):
    return sorted(map(str, df.collect()))


def test_conform_adds_missing_columns_as_typed_nulls(spark):
    df = schema.conform(spark.createDataFrame([("r1", 3)], "request_id string, ts int"), "requests")
    assert df.schema == schema.schema("requests")
    assert df.first()["model"] is None and df.first()["ts"] == 3


def test_lines_keep_bad_ones_apart_and_leave_a_torn_last_line(spark):
    files = spark.createDataFrame([("/a.jsonl", '{"type":"user"}\nnot json\n\n[1]\n{"type":"assistant"}\n{"torn'), ("/b.jsonl", "")], "path string, content string")
    good, bad = raw.lines_of(files)
    assert [r.line_no for r in good.orderBy("line_no").collect()] == [0, 4]
    assert [r.line_no for r in bad.orderBy("line_no").collect()] == [1, 3]


def test_transcript_rules(spark):
    lines = [
        {"type": "user", "promptId": "p1", "sessionId": "s", "timestamp": "2024-01-01T00:00:00Z", "message": {"content": "hi"}},
        {"type": "assistant", "sessionId": "s", "requestId": "req", "timestamp": "2024-01-01T00:00:01Z", "message": {"id": "m1", "model": "a", "content": [], "usage": {"input_tokens": 1, "cache_read_input_tokens": 2, "cache_creation_input_tokens": 3, "output_tokens": 1}}},
        {"type": "assistant", "sessionId": "s", "timestamp": "2024-01-01T00:00:05Z", "message": {"id": "m1", "model": "a", "stop_reason": "end_turn", "content": [{"type": "tool_use", "id": "t1", "name": "Read", "input": {"file_path": "x"}}], "usage": {"input_tokens": 10, "cache_read_input_tokens": 20, "cache_creation_input_tokens": 30, "output_tokens": "many"}}},
        {"type": "assistant", "sessionId": "s", "message": {"id": "m2", "model": "a", "content": []}},
        {"type": "assistant", "sessionId": "s", "message": {"id": "m3", "model": "<synthetic>", "content": []}},
    ]
    df = spark.createDataFrame([("/s.jsonl", i, json.dumps(x)) for i, x in enumerate(lines)], "path string, line_no int, raw string")
    got = {r.request_id: r for r in extract.requests_from_transcript(extract.parsed(df)).collect()}
    assert set(got) == {"m1", "m2"}
    assert got["m1"].context_tokens == 60 and got["m1"].output_tokens is None and got["m1"].prompt_id == "p1" and got["m1"].ts == 1704067201000
    assert got["m2"].context_tokens is None  # no usage is unknown, not zero
    assert [r.tool_use_id for r in extract.tool_uses(extract.parsed(df)).collect()] == ["t1"]


def test_commits_titles_and_notices(spark):
    df = spark.createDataFrame([("git commit -m x", "[main abc1234] x"), ("git commit", "[b (root-commit) 0123456789] y"), ("ls", "[main abc1234] x")], "c string, o string")
    sha, branch = extract.commit_from_text(F.col("c"), F.col("o"))
    assert [tuple(r) for r in df.select(sha, branch).collect()] == [("abc1234", "main"), ("0123456789", "b"), (None, None)]


PAYLOADS = [(t, json.dumps({"hook_event_name": e, "session_id": "s", "agent_id": a, "cwd": f"/c{t}", "n": n})) for t, e, a, n in [(0, "SubagentStart", "a", 1), (800, "SubagentStart", "a", 1), (1600, "SubagentStart", "a", 1), (2000, "SubagentStop", "a", 2), (9000, "SubagentStop", "a", 3), (9500, "SessionStart", None, 4)]]


def test_occurrences_do_not_depend_on_order(spark):
    want = None
    for seed in range(3):
        shuffled = PAYLOADS * (1 + seed)
        random.Random(seed).shuffle(shuffled)
        good, _ = raw.payloads(spark.createDataFrame(shuffled, "received_ms bigint, payload string"))
        got = rows(merge.claim_occurrences(good.distinct()).select("event", "received_ms", "ts"))
        want = want or got
        assert got == want
    assert sum("SubagentStart" in r for r in want) == 3 and sum("ts=1600" in r for r in want) == 1


def test_occurrences_of_a_hot_payload_equal_a_plain_fold(spark):
    rng = random.Random(7)
    times = {h: [rng.randrange(span) for _ in range(n)] for h, n, span in [("hot", 300_000, 3_000_000), ("b", 50, 9_000), ("c", 1, 5), ("d", 40, 900)]}
    data = [(h, t, "p") for h, ts in times.items() for t in ts] + [("b", 10, "p")] * 3
    times["b"].append(10)
    want = {}
    for h, ts in times.items():
        anchor = None
        for t in sorted(set(ts)):
            first = anchor is None
            if first or t - anchor > 1000:
                anchor, later = t, not first
            want[h, t] = (f"{h}:{anchor}" if later else h, anchor)
    got = merge.claim_occurrences(spark.createDataFrame(data, "hash string, received_ms long, payload string").repartition(7)).collect()
    assert len(got) == len(data) and {(r.hash, r.received_ms): (r.event_id, r.ts) for r in got} == want


def test_a_file_is_numbered_alike_however_it_is_split(spark, tmp_path):
    rng = random.Random(5)
    line = lambda i: json.dumps({"type": rng.choice(["user", "assistant"]), "promptId": rng.choice([None, f"p{i}é"]), "x": "y" * rng.randrange(300)})
    files = {"whole.jsonl": "".join(line(i) + "\n" for i in range(700)), "torn.jsonl": "\n".join(line(i) for i in range(500)) + '\n{"torn', "odd.jsonl": "\n\nnot json\r\n" + line(1) + "\n\n[1]\n" + line(2), "empty.jsonl": "", "blank.jsonl": "\n\n"}
    for name, text in files.items():
        (tmp_path / name).write_bytes(text.encode())
    keys = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "10"}
    held = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        good, bad = raw.read_transcripts(spark, f"file://{tmp_path}")
        assert good.select("path").rdd.getNumPartitions() > 1 and spark.read.text(f"file://{tmp_path}").rdd.getNumPartitions() > 20
        name = F.element_at(F.split("path", "/"), -1)
        got = [sorted((r.path, r.line_no, r.raw) for r in df.withColumn("path", name).collect()) for df in (good, bad)]
        parsed = extract.parsed(good)
        whole = rows(extract.prompt_of(parsed).select("path", "line_no", "prompt_id"))
        for stretch in (1, 7, 1000):
            assert rows(extract.prompt_of(parsed, stretch).select("path", "line_no", "prompt_id")) == whole
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    want = raw.lines_of(spark.createDataFrame(list(files.items()), "path string, content string"))
    assert got == [sorted((r.path, r.line_no, r.raw) for r in df.collect()) for df in want]
    assert len(got[0]) == 1202 and len(got[1]) == 2 and len(set(whole)) == 1202


def test_transcripts_are_listed_from_many_folders(spark, tmp_path):
    want = set()
    for root, projects in (("a", 40), ("b", 3)):
        for p in range(projects):
            folder = tmp_path / root / "projects" / f"p{p}"
            (folder / f"s{p}" / "subagents").mkdir(parents=True)
            (folder / f"s{p}.jsonl").write_text("x" * (p + 1))
            (folder / f"s{p}" / "subagents" / "agent-1.jsonl").write_text("y")
            (folder / "notes.txt").write_text("z")
            want.add((f"{tmp_path}/{root}", f"p{p}", f"s{p}", p + 1))
    found = raw.list_transcripts(spark, [f"file://{tmp_path}/a", f"file://{tmp_path}/b", f"file://{tmp_path}/b"])
    got = [(r.root.removeprefix("file:").replace("///", "/"), r.project, r.session_id, r.bytes) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want and all(r.modified > 1_600_000_000_000 for r in found.collect())
    assert "content" not in found._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]


def test_agent_turns_pair_a_stop_with_the_start_before_it(spark):
    e = [("e1", "SubagentStart", 1), ("e2", "SubagentStart", 2), ("e3", "SubagentStop", 3), ("e4", "SubagentStop", 4)]
    df = spark.createDataFrame([(i, v, "a", "s", None, t) for i, v, t in e], "event_id string, event string, agent_id string, session_id string, prompt_id string, ts bigint")
    assert [(r.started, r.stopped) for r in merge.agent_turns(df).orderBy("seq").collect()] == [(1, None), (2, 3), (None, 4)]


def test_settle_never_writes_a_row_of_another_session(spark):
    stored = schema.conform(spark.createDataFrame([("r1", "s1", 5), ("r2", "s1", 5)], "request_id string, session_id string, output_tokens bigint"), "requests")
    read = spark.createDataFrame([("r1", "s2", 9, 100), ("r2", "s1", 9, 100), ("r3", "s1", 9, 1)], "request_id string, session_id string, output_tokens bigint, ts bigint")
    sessions = spark.createDataFrame([("s1", 50), ("s2", 50)], "session_id string, first_ts bigint")
    assert {r.request_id: r.output_tokens for r in merge.settle(stored, read, sessions).collect()} == {"r1": 5, "r2": 9}
    assert {r.request_id: r.output_tokens for r in merge.settle(stored, read, sessions, overwrite=False).collect()} == {"r1": 5, "r2": 5}


SECRET = "s3cret words"


@pytest.mark.parametrize("tool", ["Bash", "mcp__x__y", "Edit"])
def test_no_text_passes_the_input_rules(spark, tool):
    value = json.dumps({"command": f"echo {SECRET} > f", "prompt": SECRET, "to": "x", "file_path": "/a/b", "n": 3, "flag": True, "none": None, "nested": {"x": SECRET}, "list": [SECRET], "url": "https://u:p@h/x?q=" + SECRET, "model": "m"})
    df = spark.createDataFrame([(tool, value)], "tool string, input string")
    once = df.withColumn("input", privacy.sanitize_input(F.col("tool"), F.col("input")))
    out = json.loads(once.first()["input"])
    assert SECRET not in once.first()["input"] and out["n"] == 3 and out["flag"] is True and (out["command"] == f"echo '[cut]' > f" if tool == "Bash" else out["command_bytes"] == len(SECRET) + 9)
    assert ("file_path" in out) == (tool != "mcp__x__y")
    assert once.withColumn("input", privacy.sanitize_input(F.col("tool"), F.col("input"))).first()["input"] == once.first()["input"]


def test_no_text_passes_the_detail_and_command_rules(spark):
    detail = json.dumps({"reason": "logout", "a": [{"b": {"c": SECRET}}], "x": 1})
    got = spark.createDataFrame([(detail,), ("{torn",), (None,)], "d string").select(privacy.sanitize_detail("d", F.lit("SessionEnd")).alias("d")).collect()
    assert SECRET not in got[0].d and '"reason":"logout"' in got[0].d and got[1].d is None and got[2].d is None
    for command in (f"git commit -m '{SECRET}'", f"cat <<EOF > x\n{SECRET}\nEOF\nls", f"echo {SECRET} > f", f"cat <<< '{SECRET}'", f"echo '{SECRET}"):
        assert SECRET not in (commands.cut_content(command)[0] or "")


@pytest.mark.parametrize(("command", "runner"), [("cd x && go test ./...", "go"), ("FOO=1 timeout 5 python -m pytest -q", "pytest"), ("npm run test", "npm"), ("env -u X npx jest", "jest"), ("echo pytest", None), ("cargo build", None), ("echo 'unbalanced", None)])
def test_runners(command, runner):
    assert commands.test_runner(command) == runner


def test_segments_see_quotes_and_separators():
    found = commands.segments("a 'b;c' && d | e\\ f; g > h 2>&1 # i; j\n(k $(l; m))")
    assert [(s.words, s.conditional, s.expands) for s in found] == [(["a", "b;c"], False, False), (["d"], True, False), (["e f"], False, False), (["g", "\0>", "h", "\0002>&1"], False, False), (["k", "$(l; m)"], False, True)]
    assert commands.segments('x "y') is None
    one = commands.segments("cat <<EOF > a; b\nx; 'y\nEOF\nc")
    assert [(s.words, s.body) for s in one] == [(["cat", "\0<<", "EOF", "\0>", "a"], "x; 'y\n"), (["b"], None), (["c"], None)]
    assert commands.redirected(one[0].words) == (["cat"], ["a"], True, True)


def test_sequences_leave_out_runs_inside_longer_ones(spark):
    steps = [("s1", "Read"), ("s1", "Edit"), ("s1", "Grep"), ("s2", "Read"), ("s2", "Edit"), ("s2", "Grep")]
    calls = spark.createDataFrame([(f"t{i}", s, None, i, tool, "/f" if tool != "Grep" else None, 10 if i else None) for i, (s, tool) in enumerate(steps)], "tool_use_id string, session_id string, agent_id string, ts bigint, tool string, file_path string, bytes_delivered bigint")
    parts = spark.createDataFrame([], schema.schema("command_parts"))
    got = reports.sequences(calls, parts).collect()
    assert [(r.run_key, r.occurrences, r.agents, r.bytes) for r in got] == [("Read new > Edit same > Grep", 2, 2, 30)]


def test_fault_pairs_are_one_to_one(spark):
    faults = spark.createDataFrame([("f1", "s", 1000), ("f2", "s", 2000), ("f3", "s", 900_000)], "fault_id string, session_id string, ts bigint")
    read = spark.createDataFrame([("r1", "s", 1500), ("r2", "s", 2500), ("r3", "s", 5_000_000)], "row_id string, session_id string, ts bigint")
    assert rows(reconcile.pair_faults(faults, read)) == ["Row(fault_id='f1', row_id='r1')", "Row(fault_id='f2', row_id='r2')"]


def test_report_json_of_an_empty_window(spark):
    empty = spark.createDataFrame([], "a string, b bigint")
    value = json.loads(sinks.report_json(empty, spark.createDataFrame([("n", 1)], "kind string, count bigint"), "t", "s", "x").first()["value"])
    assert value["rows"] == [] and value["columns"] == ["a", "b"] and value["notes"] == ["n 1"]


@pytest.mark.parametrize("bits", [0, 3, 16])
def test_ranks_and_medians_equal_a_sorted_list(spark, monkeypatch, bits):
    monkeypatch.setattr(filters, "LOW_BITS", bits)
    rng = random.Random(bits)
    data = [(rng.choice(["a", "b", None]), rng.choice([1, None]), rng.choice([None, -3, 0, 7, 7, 7, 8, 1 << 40, rng.randrange(-100, 100)])) for _ in range(400)] + [("none", 1, None), ("one", 1, 5)]
    df = spark.createDataFrame(data, "k string, j long, v long")
    counts = filters.value_counts(df, ["k", "j"], "v")
    got = {(r.k, r.j): (r.p1, r.p50, r.p90, r.p100, r.m) for r in filters.nearest_ranks(counts, ["k", "j"], "v", {"p1": 1, "p50": 50, "p90": 90, "p100": 100}, "m").collect()}
    groups = {}
    for k, j, v in data:
        groups.setdefault((k, j), []).extend([v] if v is not None else [])

    def of(x):
        x = sorted(x)
        return (*(x[-(-len(x) * p // 100) - 1] for p in (1, 50, 90, 100)), (x[(len(x) - 1) // 2] + x[len(x) // 2]) / 2) if x else (None,) * 5

    assert got == {g: of(x) for g, x in groups.items()}
    whole = filters.nearest_ranks(filters.value_counts(df, [], "v"), [], "v", {"p": 90}, "m").collect()
    assert [(r.p, r.m) for r in whole] == [of([v for _, _, v in data if v is not None])[2::2]]
    assert [tuple(r) for r in filters.nearest_ranks(filters.value_counts(df.limit(0), [], "v"), [], "v", {"p": 90}).collect()] == [(None,)]


def plain_pairs(faults, read, tolerance=60_000):
    """All pairs in reach, nearest first, each end once."""
    near = sorted((abs(ft - rt), ft, rt, f, r) for f, s, ft in faults for r, t, rt in read if s == t and s is not None and abs(ft - rt) <= tolerance)
    used, out = set(), set()
    for *_, f, r in near:
        if ("f", f) not in used and ("r", r) not in used:
            used |= {("f", f), ("r", r)}
            out.add((f, r))
    return out


def test_faults_take_the_nearest_row_and_leave_the_rest(spark):
    rng = random.Random(4)
    faults = [("f1", "s", 100_000), ("f2", "s", 150_000), ("f3", "s", 400_000), ("f4", "t", 0), ("f5", None, 0)]
    read = [(f"r{t}", "s", t * 1000) for t in (0, 50, 100, 150, 460)] + [("u", "t", 60_001)]
    assert plain_pairs(faults, read) == {("f1", "r100"), ("f2", "r150"), ("f3", "r460")}
    for k in range(12):  # unequal counts, ties, a chain whose gaps shrink, silent stretches
        span, n, m = rng.choice([300, 4000, 900_000]), rng.randrange(1, 60), rng.randrange(1, 60)
        faults += [(f"a{k}-{i}", f"k{k}", rng.randrange(span) // 10 * 10) for i in range(n)]
        read += [(f"b{k}-{i}", f"k{k}", rng.randrange(span) // 10 * 10) for i in range(m)]
    at = 0
    for i in range(40):
        (faults if i % 2 else read).append((f"{'fr'[i % 2 == 0]}c{i}", "chain", at))
        at += 50_000 - 1000 * i
    df = lambda data, name: spark.createDataFrame(data, f"{name} string, session_id string, ts long").repartition(5)
    got = [(r.fault_id, r.row_id) for r in reconcile.pair_faults(df(faults, "fault_id"), df(read, "row_id")).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_pairs(faults, read)
    assert reconcile.pair_faults(df(faults, "fault_id").limit(0), df(read, "row_id")).count() == 0


def plain_stops(faults, events):
    """Faults one after the other, by time and id."""
    main = {}
    for session, agent, event, ts in events:
        if agent is None:
            main.setdefault(session, []).append((ts, event))

    def turn(session, ts):
        prompts = [t for t, e in main.get(session, ()) if e == "UserPromptSubmit"]
        prompt = max((t for t in prompts if t < ts + 1000), default=None)
        after = min((t for t in prompts if prompt is not None and t > prompt), default=float("inf"))
        ends = {e for t, e in main.get(session, ()) if prompt is not None and prompt <= t < after}
        return prompt, "Stop" in ends, "StopFailure" in ends

    out, used, turns = {}, set(), set()
    for i, ts, session, stage, error in sorted(faults, key=lambda f: (f[1], f[0])):
        event = error.split(": ")[0]
        if ": " not in error or not (event == "Stop" and (stage == "terminated" or (session and stage == "binary")) or event == "StopFailure" and session and stage in ("terminated", "binary")):
            continue
        if session:
            prompt, stopped, failed = turn(session, ts)
            if session not in main:
                verdict = "unknown session"
            elif prompt is None:
                verdict = "no prompt"
            elif not stopped and not failed:
                verdict = "open turn"
            elif not (stopped if event == "Stop" else failed) or (session, event, prompt) in turns:
                verdict = "unpaired"
            else:
                verdict = "paired"
                turns.add((session, event, prompt))
            out[i] = (event, session, verdict)
            continue
        found = {s: turn(s, ts) for s, rows in main.items() if any(e == "SessionEnd" and ts <= t < ts + 5000 for t, e in rows)}
        found = {s: x for s, x in found.items() if x[0] is not None}
        free = sorted(s for s, (p, stopped, _) in found.items() if stopped and s not in used and (s, "Stop", p) not in turns)
        if any(not a and not b for _, a, b in found.values()):
            out[i] = (event, None, "open turn")
        elif not free:
            out[i] = (event, None, "unpaired")
        else:
            used.add(free[0])
            turns.add((free[0], "Stop", found[free[0]][0]))
            out[i] = (event, free[0], "paired")
    return out


@pytest.mark.parametrize("seed", range(4))
def test_lost_turn_ends_are_judged_by_their_turns(spark, seed):
    rng = random.Random(seed)
    sessions = [f"s{k}" for k in range(14)]
    events, faults = [], []
    for s in sessions:
        t = rng.randrange(4000)
        for _ in range(rng.randrange(0, 4)):
            events.append((s, None, "UserPromptSubmit", t))
            if rng.random() < 0.85:
                events.append((s, None, rng.choice(["Stop", "Stop", "Stop", "StopFailure"]), t + rng.randrange(1, 400)))
            t += rng.randrange(500, 3000)
        if rng.random() < 0.9:
            events.append((s, None, "SessionEnd", t + rng.randrange(2000)))
        events.append((s, "agent", "Stop", t))
    for i in range(60):
        event = rng.choice(["Stop", "Stop", "StopFailure", "SessionEnd"])
        faults.append((f"f{i:02}", rng.randrange(12_000) // 200 * 200, rng.choice([None, None, *sessions, "unheard"]), rng.choice(["terminated", "terminated", "binary", "store"]), rng.choice([f"{event}: killed", f"{event}: x", event])))
    want = plain_stops(faults, events)
    df = spark.createDataFrame(faults, "fault_id string, ts long, session_id string, stage string, error string")
    ev = spark.createDataFrame(events, "session_id string, agent_id string, event string, ts long")
    got = reconcile.judge_stops(df, ev).collect()
    assert len(got) == len(want) and {r.fault_id: (r.event, r.session_id, r.verdict) for r in got} == want
    if seed == 0:
        assert {v for *_, v in want.values()} >= {"paired", "unpaired", "unknown session"} and reconcile.judge_stops(df.limit(0), ev).count() == 0


def plain_allowed(mismatches, entries):
    used, out = set(), []
    for c, session, ts, ids in mismatches:
        for entry, kind, scopes, before, _ in entries:
            named = any(s in ids if s.startswith("tool=") else any(x and x.startswith(s) for x in (session, *ids)) for s in scopes)
            if kind == c and (named or (before is not None and ts is not None and 0 < ts < before)):
                used.add(entry)
                out.append((c, session, ts, tuple(ids), entry))
                break
        else:
            out.append((c, session, ts, tuple(ids), None))
    return out, {e[0] for e in entries} - used


def test_the_first_fitting_entry_explains_a_mismatch(spark):
    rng = random.Random(9)
    words = ["x", "x1", "x12", "s1", "s12", "tool=Bash", "tool=Ba", "y", "yy"]
    entries = [(n, rng.choice("abc"), rng.sample(words, rng.randrange(0, 3)), rng.choice([None, None, 10, 50]), f"r{9 - n % 10}") for n in rng.sample(range(100), 14)]
    entries.sort()
    found = [(rng.choice("abcd"), rng.choice([None, "s1", "s12", "s2"]), rng.choice([None, 0, -5, 9, 10, 49, 90]), rng.sample(words + ["z", "x123"], rng.randrange(1, 3))) for _ in range(300)]
    found += [("a", "s9", 50, ["x1"])] * 3
    want, unused = plain_allowed(found, entries)
    df = spark.createDataFrame([(c, s, t, "i", i) for c, s, t, i in found], "class string, session_id string, ts long, id string, ids array<string>")
    allowed = spark.createDataFrame(entries, "entry int, class string, scopes array<string>, before_ts long, reason string")
    judged, left = reconcile.apply_allowlist(df, allowed)
    assert sorted(map(str, ((r["class"], r.session_id, r.ts, tuple(r.ids), r.entry) for r in judged.collect()))) == sorted(map(str, want))
    assert {r.entry for r in left.collect()} == unused and any(e[4] is None for e in want)
    reasons = {e[0]: e[4] for e in entries}
    assert all(r.reason == reasons.get(r.entry) and r.verdict == ("expected" if r.entry is not None else "unexplained") for r in judged.collect())


@pytest.mark.parametrize("shape", ["chain", "circle", "fan", "forest"])
def test_descendants_of_deep_and_circular_agents(spark, shape):
    rng = random.Random(2)
    if shape == "chain":
        up = {f"a{i}": f"a{i - 1}" for i in range(1, 5001)}
    elif shape == "circle":
        up = {f"a{i}": f"a{(i + 1) % 7}" for i in range(7)} | {f"b{i}": f"b{(i + 1) % 5}" for i in range(5)} | {"c": "a3", "d": "b1"}
    elif shape == "fan":
        up = {f"x{i}": "a0" for i in range(100_000)} | {f"y{i}": "x7" for i in range(1000)}
    else:
        up = {f"a{i}": f"a{rng.randrange(i)}" for i in range(1, 300)} | {f"z{i}": f"z{rng.randrange(max(1, i))}" for i in range(1, 100)} | {"lone": None}
    want, level, depth = {"a0": 0}, ["a0"], 0
    below = {}
    for a, b in up.items():
        below.setdefault(b, []).append(a)
    while level:
        depth += 1
        level = [x for a in level for x in below.get(a, ()) if x not in want]
        want |= dict.fromkeys(level, depth)
    calls = spark.createDataFrame([(f"t{a}", b) for a, b in up.items()], "tool_use_id string, agent_id string")
    agents = spark.createDataFrame([(a, f"t{a}") for a in up] + [("top", None)], "agent_id string, parent_tool_use_id string")
    got = [(r.agent_id, r.depth) for r in recipes.descendants(calls, agents, "a0").collect()]
    assert len(got) == len(want) and dict(got) == want
    assert [tuple(r) for r in recipes.descendants(calls, agents, "nobody").collect()] == [("nobody", 0)]


#: Commands, what the rules say of them, and (for some) with the rules below.
CLASSED = [
    ("python3 - <<'EOF'\nopen('a', 'w').write('x')\nEOF", "edit"), ("python3 -c 'print(open(\"a\").read())'", "read"), ("node -e \"fs.writeFileSync('a', 'b')\"", "edit"), ("python3 tests/run_test.py", "test"), ("python3 -m mypy src", "test"),
    ("until [ -f x ]; do sleep 1; done", "wait"), ("for p in a b; do git -C $p log; done", "read"), ("(cd x && make)", "test"), ("{ echo a; echo b; } >> log", "edit"), ("{ go vet ./...; echo done; } > log", "test,capture"),
    ("git -C x branch", "read"), ("git tag -a v1 -m x", "git"), ("git grep foo", "search"), ("git apply --check p.diff", "read"), ("git apply p.diff", "edit"), ("git $x checkout main", "git"),
    ("sed -n 1,5p", "other"), ("sed -n 1,5p a.py", "read"), ("sed -Ei s/a/b/ a.py", "edit"), ("perl -Mi -e 1", "other"), ("perl -pi -e 1 a", "edit"), ("awk '{print}'", "other"), ("jq . a.json", "read"), ("sort", "other"), ("tr a b", "other"),
    ("sqlite3 a.db 'select 1'", "read"), ("sqlite3 a.db 'delete from t'", "other"), ("find . -delete", "housekeeping,search"), ("find . -name x -exec sed -i s/a/b/ {} +", "edit,search"),
    ("cargo fmt --check", "test"), ("cargo fmt", "edit"), ("go -C x test ./...", "test"), ("npm run tsc", "test"), ("npm install", "other"), ("npx eslint --fix .", "edit"), ("black .", "edit"), ("black --check .", "test"), ("terraform plan", "other"), ("deno run check.ts", "test"),
    ("cat <<EOF | tee a.txt\nx\nEOF", "edit"), ("ls | tee a.txt", "read,capture"), ("grep a b > t && mv t b", "edit,housekeeping,search,capture"), ("grep a b > t && mv t c", "housekeeping,search,capture"), ("echo $(git log) > x", "capture"), ("echo 'a $(b)' > x", "edit"), ("ls 2>/dev/null", "read"), ("> x", "capture"),
    ("docker run i sh -c 'docker exec c bash -c \"ls; pytest\"'", "test,read"), ("./run-tests.sh", "test"), ("nothing known", "other"), ("", "other"),
]
RULED = [("box run rm x", "housekeeping"), ("timeout 5 box -q run 'pytest -q'", "test"), ("lanes --all x", "test"), ("echo lanes --all", "other"), ("env lanes --all", "test"), ("box --all run ls", "read")]


def test_shell_commands_are_classed_by_the_rules(spark):
    schema = "id string, tool string, command string"
    got = {r.command: ",".join(r.classes) for r in classify.classify(spark.createDataFrame([(c, "Bash", c) for c, _ in CLASSED], schema)).withColumnRenamed("id", "command").collect()}
    assert got == dict(CLASSED)
    rules = spark.createDataFrame([("wrapper", "box", "run", None), ("test", "lanes", "--all --some", None), ("tool", "Read", None, "search")], classify.RULES_DDL)
    rows = spark.createDataFrame([(c, "Bash", c) for c, _ in RULED] + [("r", "Read", None), ("n", "Bash", None), ("q", "Bash", "a 'b"), ("m", None, None)], schema)
    got = {r.id: (",".join(r.classes), r.status) for r in classify.classify(rows, rules).collect()}
    assert got == {c: (x, "ok") for c, x in RULED} | {"r": ("search", "ok"), "n": ("other", "ok"), "q": ("other", "error"), "m": ("other", "ok")}


def test_json_is_decoded_once_a_row(spark):
    calls = spark.range(3).selectExpr("concat('t', id) as tool_use_id", "'Bash' as tool", "concat('{\"command\": \"echo ', id, '\", \"a\": 1, \"b\": \"x\"}') as input")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    clean = calls.select("tool_use_id", privacy.sanitize_input(F.col("tool"), F.col("input")).alias("input"))
    assert plan(clean).count("from_json") == 1 and plan(clean).count("parseJson") == 2  # keys; and whether a shell's command is a text
    payload = json.dumps({"hook_event_name": "PostToolUse", "session_id": "s", "tool_use_id": "t", "tool_name": "Read", "tool_input": {"file_path": "x", "off\\u0073et": 3}, "tool_response": {"file": {"startLine": 7}}, "cwd": "/w"})
    rows_ = extract.call_rows(raw.payloads(spark.createDataFrame([(5, payload.replace("\\\\u", "\\u"))], "received_ms bigint, payload string"))[0]).select("tool_use_id", "file_path", "read_start", "ts")
    assert [tuple(r) for r in rows_.collect()] == [("t", "/w/x", 7, 5)]
    assert plan(rows_).count("parseJson(payload") <= 2  # whether it is an object, and its fields


def test_only_facts_with_an_archive_are_compared_whole(spark):
    calls = spark.createDataFrame([("t1", "r1", 5), ("t2", "r1", None), ("t3", "r2", None), ("t4", "r9", None)], "tool_use_id string, request_id string, ts bigint")
    requests = spark.createDataFrame([("r1", 5), ("r2", 50)], "request_id string, ts bigint")
    parts = spark.createDataFrame([("t1", 0, "a"), ("t1", 1, "b"), ("t3", 0, "c"), ("gone", 0, "d")], "tool_use_id string, seq int, program string")
    kept, filed = merge.retain({"calls": calls, "requests": requests, "command_parts": parts}, {"command_parts": parts.where("seq = 0").withColumn("program", F.when(F.col("tool_use_id") == "gone", "d").otherwise("z"))}, 10)
    assert [r.tool_use_id for r in kept["calls"].orderBy("tool_use_id").collect()] == ["t3", "t4"] and filed["calls"].count() == 2
    assert sorted((r.tool_use_id, r.program) for r in kept["command_parts"].collect()) == [("t1", "a"), ("t3", "c")]
    assert sorted((r.tool_use_id, r.program) for r in filed["command_parts"].collect()) == [("gone", "d"), ("t1", "b"), ("t1", "z"), ("t3", "z")]
    assert "to_json" not in kept["calls"]._jdf.queryExecution().optimizedPlan().toString()


def test_archived_facts_are_placed_with_their_parents(spark):
    calls = spark.createDataFrame([("young", None, 50), ("old", None, 5)], "tool_use_id string, request_id string, ts bigint")
    requests = spark.createDataFrame([("r", 5)], "request_id string, ts bigint")
    parts = spark.createDataFrame([("young", 0, "a", "x"), ("young", 1, "b", "x"), ("old", None, "c", "x"), ("old", 1, "same", "x"), ("old", 2, "other", "x"), ("old", 3, "new", "x"), (None, 0, "none", "x")], "tool_use_id string, seq int, program string, args string")
    archive = spark.createDataFrame([("young", 0, "z"), ("old", 1, "same"), ("old", 2, "z"), (None, 0, "z")], "tool_use_id string, seq int, program string")  # keeps no args
    events = spark.createDataFrame([("e1", 5, "a"), ("e2", 5, None), ("e3", 5, None), ("e4", None, "d"), ("e5", 50, "e")], "event_id string, ts bigint, event string")
    filed = spark.createDataFrame([("e2", 5, None), ("e3", 5, "z"), ("e5", 5, "z")], "event_id string, ts bigint, event string")
    placed = merge.place({"calls": calls, "requests": requests, "command_parts": parts, "events": events}, {"command_parts": archive, "events": filed}, 10)
    got = sorted((r.place, r.tool_use_id or "-", -1 if r.seq is None else r.seq, r.program) for r in placed["command_parts"].collect())
    assert got == [("archive", "-", 0, "none"), ("archive", "-", 0, "z"), ("archive", "old", -1, "c"), ("archive", "old", 1, "same"), ("archive", "old", 2, "z"), ("archive", "old", 3, "new"), ("archive", "young", 0, "z"),
                   ("kept", "old", 2, "other"), ("kept", "young", 0, "a"), ("kept", "young", 1, "b")]
    assert sorted((r.place, r.event_id, r.event or "-") for r in placed["events"].collect()) == [("archive", "e1", "a"), ("archive", "e2", "-"), ("archive", "e3", "z"), ("archive", "e5", "z"), ("kept", "e3", "-"), ("kept", "e4", "d"), ("kept", "e5", "e")]


def test_long_quoted_words_are_split_in_linear_time():
    took = []
    for n in (10_000, 160_000):
        command = "git commit -m 'x" + "word and " * (n // 9) + "' && echo \"" + "y $? z " * (n // 7) + '"'
        start = time.perf_counter()
        found = commands.segments(command)
        took.append(time.perf_counter() - start)
        assert [len(s.words) for s in found] == [4, 2] and len(found[0].words[3]) == 1 + 9 * (n // 9) and found[1].expands
    assert took[1] < 64 * took[0] + 0.05  # sixteen times as long; quadratic time is 256 times


def test_descendants_write_agents_without_descendants_once(spark, monkeypatch):
    links = [(f"a{i}", f"a{i - 1}") for i in range(1, 18)] + [(f"leaf{i}", f"a{i % 18}") for i in range(500)]
    agents = spark.createDataFrame([(a, f"t{a}") for a, _ in links], "agent_id string, parent_tool_use_id string")
    calls = spark.createDataFrame([(f"t{a}", by) for a, by in links], "tool_use_id string, agent_id string")
    written, saved = [], recipes.saved
    monkeypatch.setattr(recipes, "saved", lambda df: written.append(saved(df)) or written[-1])
    got = {r.agent_id: r.depth for r in recipes.descendants(calls, agents, "a0").collect()}
    assert got == {"a0": 0} | {f"a{i}": i for i in range(1, 18)} | {f"leaf{i}": i % 18 + 1 for i in range(500)}
    assert sum(df.count() for df in written) < 3 * len(links)


def test_compared_calls_are_joined_without_columns_that_no_class_reads(spark):
    calls = spark.createDataFrame([("t1", "s1", None, "Read", "r1", 1, 0, 5, "long"), ("t2", "s1", None, "Read", "r1", 1, 0, 5, "long")], "tool_use_id string, session_id string, agent_id string, tool string, request_id string, bytes_delivered long, failed int, ts long, input string")
    got = reconcile.compare_calls(calls, calls.where("tool_use_id = 't1'").withColumn("tool", F.lit("Bash")))
    assert rows(got.select("class", "id")) == rows(spark.createDataFrame([("call tool", "t1"), ("call extra", "t2")], "class string, id string"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "input#" in line and "RDD" not in line]


def test_calls_of_known_requests_are_not_joined_to_be_repointed(spark):
    calls = spark.createDataFrame([("t1", "pending:t1"), ("t2", "pending:t1"), ("t3", "pending:t3"), ("t4", "r4"), ("t5", None)], "tool_use_id string, request_id string")
    uses = spark.createDataFrame([("t2", "r2"), ("t2", "r1"), ("t4", "r9")], "tool_use_id string, request_id string")
    requests = spark.createDataFrame([("pending:t1", 1, 1), ("r1", 2, 0)], "request_id string, ts long, pending int")
    merged, moved = merge.resolve_pending(requests, calls, uses)
    assert rows(moved) == rows(spark.createDataFrame([("t1", "r1"), ("t2", "r1"), ("t3", "pending:t3"), ("t4", "r4"), ("t5", None)], calls.schema))
    assert [tuple(r) for r in merged.collect()] == [("r1", 1, 0)]
    assert "Join LeftOuter, (request_id#" not in moved._jdf.queryExecution().optimizedPlan().toString()


def test_details_are_decoded_one_at_a_time_out_of_arrow_batches(spark):
    from pyspark.util import PythonEvalType

    data = [(json.dumps({"status": "kept", "secret": "é" * n}), None if n % 2 else "SessionEnd") for n in range(50)] + [(None, "SessionEnd"), ("{torn", None), ('"text"', None)]
    got = spark.createDataFrame(data, "d string, e string").coalesce(1).select(privacy.sanitize_detail("d", F.col("e")).alias("d")).collect()
    assert [r.d for r in got] == [f'{{"status":"kept","secret_bytes":{2 * n}}}' for n in range(50)] + [None] * 3
    assert privacy._details.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF


def test_sequences_equal_a_plain_count(spark):
    """Parties cut by batches, files used again, texts that hold the separator or end like a mark, and steps without a tool."""
    rng = random.Random(11)
    tools, files = ["Read", "Edit > x", "Edit > x new", "x", None, "a new", "a"], ["/f", "/g", None]
    data = [(f"t{i:05}", f"s{0 if i % 3 == 0 else rng.randrange(60)}", rng.choice([None, "a1", "a2"]), rng.choice([i, i // 4, None]), rng.choice(tools), rng.choice(files), rng.choice([None, 5, 1 << 40])) for i in range(3000)]
    calls = spark.createDataFrame(data, "tool_use_id string, session_id string, agent_id string, ts bigint, tool string, file_path string, bytes_delivered bigint").repartition(5)
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
        got = {(r.run_key, r.n): (r.occurrences, r.agents, r.bytes, r.mean_bytes) for r in reports.sequences(calls, spark.createDataFrame([], schema.schema("command_parts")), None).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)

    def key(run):
        marks = ["" if c[5] is None else " same" if c[5] in [b[5] for b in run[:i]] else " new" for i, c in enumerate(run)]
        return " > ".join(c[4] + m for c, m in zip(run, marks, strict=True) if c[4] is not None)

    parties = {}
    for c in sorted((c for c in data if c[3] is not None), key=lambda c: (c[1], c[2] or "", c[3], c[0])):
        parties.setdefault((c[1], c[2]), []).append(c)
    runs = {}
    for party, row in parties.items():
        for n in range(2, 6):
            for i in range(len(row) - n + 1):
                runs.setdefault((key(row[i : i + n]), n), []).append((party, row[i : i + n]))
    runs = {k: v for k, v in runs.items() if len({p for p, _ in v}) > 1}
    inside = {(key(v[0][1][i : i + m]), m, len(v)) for (_, n), v in runs.items() for m in range(2, n) for i in range(n - m + 1)}
    want = {}
    for (text, n), v in runs.items():
        sizes = [sum(c[6] for c in run) for _, run in v if all(c[6] is not None for c in run)]
        if (text, n, len(v)) not in inside:
            want[text, n] = (len(v), len({p for p, _ in v}), sum(sizes), sum(sizes) // len(sizes) if sizes else None)
    assert len(want) > 100 and got == want


def test_sequences_count_runs_without_their_calls(spark, monkeypatch):
    """No strings of calls are held in aggregates: those would be sorted, and spilled, with each run of each party."""
    monkeypatch.setattr(reports, "top", lambda rows, *_: rows)
    calls = spark.createDataFrame([], "tool_use_id string, session_id string, agent_id string, ts bigint, tool string, file_path string, bytes_delivered bigint")
    plan = reports.sequences(calls, spark.createDataFrame([], schema.schema("command_parts")))._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "SortAggregate(key=[run_key" in line and "occurrences" not in line.split("functions=")[0]]


def test_batch_calls_are_taken_out_of_their_batch_decoded(spark):
    call = lambda i, **more: {"tool_use_id": i, "tool_name": "T", "tool_response": "xé", **more}
    batch = lambda calls: json.dumps({"hook_event_name": "PostToolBatch", "session_id": "s", "agent_id": "a", "tool_calls": calls})
    told = [batch([call("1"), call("2", tool_response={"b": [1]})]), batch([None, call("3")]), batch([5, call("4")]), batch([]), batch(None), batch("t"), batch(call("5")), batch([call("6", tool_response=[{"type": "text", "text": "hé"}]), call(7)])]
    good, _ = raw.payloads(spark.createDataFrame([(i, p) for i, p in enumerate(told)], "received_ms bigint, payload string"))
    got = extract.batch_rows(good)
    assert sorted(map(str, ((r.tool_use_id, r.bytes_delivered, r.request_id) for r in got.collect()))) == sorted(map(str, [("1", 3, "pending:1"), ("2", 9, "pending:1"), (None, 0, None), ("3", 3, None), (None, 0, None), ("4", 3, None), ("5", 3, "pending:5"), ("6", 3, "pending:6"), ("7", 3, "pending:6")]))
    # the list itself stays behind where its calls become rows
    assert re.search(r"Generate explode\(calls#\d+\), \[\d+\]", got._jdf.queryExecution().optimizedPlan().toString())


def test_payloads_are_decoded_once(spark):
    told = ['{"session_id":7,"hook_event_name":"Stop"}', '{"session_id":1.50,"hook_event_name":"Stop"}', '{"session_id":{"a":1.0},"hook_event_name":"Stop"}', ' {"session_id":"\\u0041","hook_event_name":"Stop"}', '{"session_id":"t","hook_event_name":"Stop","a":', "[1]", None, '{"session_id":null,"hook_event_name":"Stop"}']
    good, faults = raw.payloads(spark.createDataFrame([(i, p) for i, p in enumerate(told)], "received_ms bigint, payload string"))
    assert sorted(r.session_id for r in good.collect()) == ["1.5", "7", "A", '{"a":1.0}']
    assert sorted((r.ts, r.session_id) for r in faults.collect()) == [(4, None), (5, None), (6, None), (7, None)]
    assert "[_decoded#" in good._jdf.queryExecution().optimizedPlan().toString()


def test_claims_join_no_payloads(spark):
    plan = catalog.queries()["m02_claim_occurrences"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object" not in plan[: plan.index("Join Inner")]


def test_equal_parts_are_looked_at_once(spark):
    """Also parts that lack values: none is lost where what was found of a part is joined."""
    data = [(f"c{i}", seq, *what) for i in range(30) for seq, what in enumerate([("sed", '["-i", "s/a/b/", "f"]', None), (None, None, None), ("cat", None, '["write\\t\\t?\\to"]'), ("git", '["status"]', "[]")])]
    df = spark.createDataFrame(data, "id string, seq int, program string, args string, files string").repartition(3)
    judged = classify.part_classes(df)
    got = {(r.id, r.seq): r.classes for r in judged.collect()}
    assert len(got) == 120 and all(got[f"c{i}", seq] == got["c0", seq] for i in range(30) for seq in range(4)) and got["c0", 0] == ["edit"] and got["c0", 1] == [] and got["c0", 3] == ["read"]
    assert re.search(r"Join Inner, \(what#\d+ = what#\d+\)", judged._jdf.queryExecution().optimizedPlan().toString())
