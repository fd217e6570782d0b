"""The registered queries and the pipeline on the driver's smallest tables, and the pipeline's stages on awkward rows."""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracewell.llm import langid, mixing, queries, sentencepiece_scan, simhash, suffix_dedup

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def test_op1_scores_every_document(spark, documents):
    got = queries.op1_toxicity(spark, SF).collect()
    assert Counter(r.doc_id for r in got) == Counter(list(documents)) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (crc(r.doc_id) % 5 == 0) for r in got)


def test_op2_equals_all_windows(spark, documents):
    raw = {i: t.encode() for i, t in documents.items()}
    seen = Counter(hash(b[k : k + 200]) for b in raw.values() for k in range(len(b) - 199))
    got = {r.doc_id: r for r in queries.op2_suffix_dedup(spark, SF).collect()}
    assert set(got) == set(raw)
    for i, b in raw.items():
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[hash(b[k : k + 200])] > 1:
                gone[k : k + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), len(b) - len(kept), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())


def test_op3_is_hex_and_links_what_is_near(spark, documents):
    got = {r.doc_id: r for r in queries.op3_simhash(spark, SF).collect()}
    assert set(got) == set(documents) and all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) for r in got.values())
    prints = {i: int(r.fingerprint, 16) for i, r in got.items()}
    for i in prints:
        near = [j for j in prints if (prints[i] ^ prints[j]).bit_count() <= 2]
        assert {got[j].component_id for j in near} == {got[i].component_id} and got[i].component_id <= min(near)
        assert got[i].links == len({prints[j] for j in near}) - 1


def test_op5_is_the_library_s_encoding(spark, documents):
    encoder = sentencepiece_scan.Encoder(sentencepiece_scan.read_model())
    got = {r.doc_id: r for r in queries.op5_sentencepiece(spark, SF).collect()}
    assert set(got) == set(documents)
    for i, t in documents.items():
        assert got[i].n_pieces == len(encoder.processor.encode(t)) and got[i].round_trip == ("▁" not in t)


def test_op6_has_the_planted_conversation(spark):
    got = {r.conv_id: r for r in queries.op6_chat(spark, SF).collect()}
    text = "<|im_end|><|im_start|>assistant ok"
    assert got[-1].n_turns == 2 and got[-1].loss_chars == len(text) and got[-1].loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert got[-1].turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_op7_finds_the_nearest(spark):
    import numpy as np

    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    fine = {i: np.array(v, float) for i, v in rows.items() if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = np.array(sorted(fine))
    x = np.stack([fine[i] for i in ids])
    got = Counter()
    hits = total = 0
    found = queries.op7_ann(spark, SF).collect()
    for q in [i for i in ids if i % 20 == 0]:
        mine = sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])
        score = x @ fine[q]
        best = [i for i in ids[np.lexsort((ids, -score))] if i != q][:20]
        assert [r["rank"] for r in mine] == list(range(1, len(best) + 1)) and all(r.score == pytest.approx(float(fine[q] @ fine[r.vec_id]), abs=1e-12) for r in mine)
        hits, total = hits + len({r.vec_id for r in mine} & set(best)), total + len(best)
        got[q] += 1
    assert hits >= 0.9 * total and len(got) == len({r.query_id for r in found})


def test_op8_and_op10_have_a_row_for_each_document(spark, documents):
    got = {r.doc_id: r for r in queries.op8_fingerprints(spark, SF).collect()}
    assert set(got) == set(documents) and all(r.n_chars == len(documents[i]) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for i, r in got.items())
    lang = {r.doc_id: r for r in queries.op10_language_id(spark, SF).collect()}
    assert set(lang) == set(documents) and all(r.held_out == (crc(i) % 4 == 2) for i, r in lang.items())
    assert all((r.lang_pred == "und") == (not any(map(str.isalpha, documents[i]))) for i, r in lang.items())


def test_the_pipeline_is_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = langid.predict(docs, langid.fit(docs)).where("not rejected").withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)
    rows = known.collect()
    # near copies by all pairs
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (r.text or "").encode().lower().split()) else frozenset() for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(range(len(rows)), key=lambda i: rows[i].doc_id)
    for a, i in enumerate(order):
        for j in order[a + 1 :]:
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if not either or 10 * both >= 8 * either:
                x, y = sorted((find(i), find(j)), key=lambda k: rows[k].doc_id)
                root[y] = x
    left = spark.createDataFrame([r for k, r in enumerate(rows) if find(k) == k], known.schema)
    want = mixing.mixed(suffix_dedup.without_repeats(left)).select("doc_id", "lang", "source", "text").collect()
    encoder = sentencepiece_scan.Encoder(sentencepiece_scan.read_model())
    expected = Counter((r.doc_id, r.lang, r.source, tuple(encoder.processor.encode(r.text))) for r in want)
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.lang, r.source, tuple(r.ids)) for r in got) == expected and all(r.n_pieces == len(r.ids) for r in got)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_awkward_rows(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    text = "the quick brown fox jumps over the lazy dog while the small bird sings a song in the old tree by the river "
    rows = [(1, text * 3, "en", "web", 9), (1, text * 3, "en", "web", 9), (2, None, None, None, None), (3, "", "en", "", 0), (None, text, None, "web", 1), (4, text.upper() * 400, "en", "a", 5), (5, "der schnelle braune fuchs springt über den faulen hund " * 4, "de", "web", 7), (5, "other text of the same key, in some words", "de", None, 7)]
    clash = ("copies", "_row", "row", "doc", "ids", "fp", "component_id", "spans", "bucket", "k", "rejected", "score")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(3) for c in clash})
    got = stage(spark, df, SF)
    if name != "sentencepiece":
        assert got.columns == corpus_pipeline.COLUMNS
    assert got.count() >= 1 and stage(spark, df.limit(0), SF).count() == 0
    assert simhash.near_dedup(df).columns == df.columns
