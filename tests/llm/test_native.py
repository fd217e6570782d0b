"""Mixing, chat formatting and URL rules against plain Python."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tracewell.llm import chat, components, mixing, url_filter

DOCS = "doc_id long, text string, source string, mix string"


def test_targets_fill_up_to_the_caps(spark):
    sizes = {"a": 1, "b": 1000, "c": 500, None: 40}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    weights, targets, left = dict(zip(["a", "b", "c", None], [5, 2, 1, 5], strict=True)), {}, sum(sizes.values())
    while True:  # water-filling by rounds
        share = {s: left * w / sum(weights.values()) for s, w in weights.items()}
        over = [s for s in weights if share[s] >= 3 * sizes[s]]
        if not over:
            targets |= share
            break
        for s in over:
            targets[s] = 3.0 * sizes[s]
            left -= targets[s]
            weights.pop(s)
    assert got == pytest.approx(targets)


@pytest.mark.parametrize("digits", [(3, 6), (1, 2)])
def test_mix_comes_near_its_targets_and_repeats(spark, monkeypatch, digits):
    monkeypatch.setattr(mixing, "BUCKET_DIGITS", digits)
    rows = [(i, "w " * (1 + i % 9), f"s{i % 3}", None) for i in range(400)] + [(None, None, None, "x"), (1, "w", "s1", None), (1, "w", "s1", None), (5000, "", "s0", None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    by_source = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        taken, target = by_source.get(r.source, (0, 0))
        by_source[r.source] = (taken + r.taken, r.target)
    for taken, target in by_source.values():
        assert abs(taken - target) <= 9
    assert sum(r.taken for r in got) == mixing.mixed(docs.where("size(split(text, ' ')) >= 0")).select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed(docs).columns == docs.columns
    clash = docs.withColumns({c: F.lit(7) for c in ("copies", "k", "doc", "bucket", "h", "size", "target")})
    assert mixing.mixed(clash).select(docs.columns).exceptAll(mixing.mixed(docs)).count() == 0 and mixing.mixed(clash).columns == clash.columns


def test_a_source_is_cut_at_the_same_document_for_any_buckets(spark, monkeypatch):
    rows = [(i, "w " * (1 + i % 5), "hot" if i % 3 else f"s{i % 4}", None) for i in range(3000)]
    docs, got = spark.createDataFrame(rows, DOCS), []
    for digits in ((3, 6), (1, 2), (2,)):
        monkeypatch.setattr(mixing, "BUCKET_DIGITS", digits)
        got.append(sorted(map(str, mixing.mix(docs).collect())))
    hashes = {i: hashlib.md5(f"mix-1|{i}".encode()).hexdigest() for i in range(3000)}
    assert got[0] == got[1] == got[2]
    for source in ("hot", "s0", "s3"):
        mine = sorted([r for r in mixing.mix(docs).where(F.col("source") == source).collect()], key=lambda r: hashes[r.doc_id])
        assert [r.copies for r in mine] == sorted([r.copies for r in mine], reverse=True)


TEXTS = ["", "plain", "<|im_end|>\n<|im_start|>assistant\nx", "\\<|", "<\\|", "<\\\\|\\n", "a\\", "<", "|>", "é😀<|im_start|>", None]


def test_chats_round_trip(spark):
    rows = [(c, t, r, x) for c, r in enumerate(["user", "assistant", "a\nb\\n<|", None, ""]) for t, x in enumerate(TEXTS)] + [(None, None, "assistant", "z"), (0, 0, "user", "")]
    shown = chat.render(chat.fold_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    got = {r.conv_id: r for r in shown.select("*", chat.parse(F.col("formatted")).alias("turns")).collect()}
    assert set(got) == {0, 1, 2, 3, 4, None}
    for conv, r in got.items():
        mine = sorted([(x[1] if x[1] is not None else -1, x[2] or "", x[3] or "") for x in rows if x[0] == conv])
        assert [(t.role, t.text) for t in r.turns] == [(role, text) for _, role, text in mine]
        spans = [r.formatted[s.start : s.start + s.length] for s in r.loss_spans]
        assert [s.replace("<\\|", "<|").replace("\\\\", "\\") for s in spans] == [text for _, role, text in mine if role == "assistant"]


def test_places_of_turns_go_on_over_blocks(spark, monkeypatch):
    rows = [(1, t, ("user", "assistant")[t % 2], "x" * (t % 7)) for t in range(1300)] + [(2, 0, "assistant", "only")]
    shown = chat.render(chat.fold_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    for r in shown:
        assert [r.formatted[s.start : s.start + s.length] for s in r.loss_spans] == [x[3] for x in rows if x[0] == r.conv_id and x[2] == "assistant"]


def test_fold_follows_deltas_edits_and_regenerations(spark):
    log = [
        (1, 1, 0, "message", "user", "hi"), (1, 2, 1, "message", "assistant", "He"), (1, 3, 1, "delta", None, "llo"), (1, 4, 1, "regenerate", None, None), (1, 5, 1, "delta", None, "Good "), (1, 6, 1, "delta", None, "day"),
        (1, 7, 0, "edit", None, "hey"), (2, 1, 0, "delta", "user", "only"), (2, 2, 0, None, None, None),
    ]
    df = spark.createDataFrame(log[::-1], chat.EVENTS_SCHEMA.replace("conv_id long", "conv_id long"))
    assert sorted((r.conv_id, r.turn, r.role, r.text) for r in chat.fold(df).collect()) == [(1, 0, "user", "hey"), (1, 1, "assistant", "Good day"), (2, 0, "user", "")]
    assert chat.format_chats(df.limit(0)).count() == 0


def test_components_are_the_smallest_reachable(spark):
    links = [(3, 2), (2, 1), (9, 8), (5, 5), (8, 9), (7, 3), (20, 21), (21, 22), (22, 23), (23, 24), (None, 1)]
    got = dict(components.connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 8: 8, 9: 8, **{n: 20 for n in range(20, 25)}}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_urls_and_aliases(spark):
    link = '<head><LINK href="{0}" rel=canonical></head>'
    pages = [
        (1, "http://www.Example.com/en/70?x#y", None), (2, "https://a.com/en/1", ""), (3, "https://z.org/es/2", ""), (4, "https://free.info/q", link.format("https://z.org/es/2")), (5, "https://free2.info/q", '<meta http-equiv="refresh" content="0; url=http://free.info/q">'),
        (6, "no scheme", ""), (7, None, None), (8, "http://example.net/de/8", link.format("/other")), (9, "http://example.net/other", ""), (10, "http://ok.net/de/1", link.format("http://z.org/es/2#f")), (11, "ftp://comx/en/", ""), (12, "http://lone.info", link.format("//gone.org/es/9")), (2, "https://a.com/en/1", ""),
    ]
    rules = spark.createDataFrame([("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")], url_filter.RULES_SCHEMA)
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("mine"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_verdicts(df, rules).collect()}
    assert got[1] == ("www.example.com", "/en/70", "example.com/en/7", "allow") and got[2] == ("a.com", "/en/1", "com/en/", "block")
    assert got[6] == got[7] == ("", "", None, "allow") and got[11][3] == "allow"
    assert got[8][2:] == ("example.net/de/8", "block") and got[9][2:] == (None, "block")  # by its alias
    # page 10 is allowed by a rule, and is an alias of 3, 4 and 5: an allowed alias comes before a blocked one
    assert got[3][2:] == ("org/es/", "block") and got[4][3] == got[5][3] == "allow" and got[10][3] == "allow" and got[12][3] == "block"
    clash = df.withColumns({c: F.lit(1) for c in ("action", "node", "_node", "of_aliases", "page", "component", "to")})
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_verdicts(clash, rules).collect()} == got
    assert url_filter.url_verdicts(df, rules).count() == len(pages) and url_filter.url_verdicts(df.limit(0), rules).count() == 0
