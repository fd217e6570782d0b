"""Quality, the prefix trie and spelling variants against plain versions, with nulls, ties, repeats, very long texts and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import prefix_trie, quality, queries, variants

SF = "/root/testdata/sf0.001"


def plain_words(text):
    """Slots by a plain reading: runs of one kind; marks behind words in capitals and words like the one before."""
    found, last = [], None
    for w in re.findall(r"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff\t\n\v\f\r ]+", text.encode("utf-8", "replace").decode("latin-1")):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), w)
        found.append(low)
        if len(re.findall("[A-Z]", w)) >= 2 and not re.search("[a-z]", w):
            found.append("<capitals>")
        if re.match(r"[A-Za-z\x80-\xff]", w):
            if low == last:
                found.append("<again>")
            last = low
    return found


def test_words_and_their_vectors_equal_a_plain_reading(spark):
    rng = random.Random(3)
    parts = ["the", "THE", "The", "été", "É", "--", "%%%", "12", "a1b", "ÉTÉ", "x", "\n", "   ", "\t", "日本", "."]
    texts = ["", "  ", "one"] + ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    slots = {}
    for t in texts:
        _, slot = quality.words(t.encode(), np.zeros(1, int))
        want = plain_words(t)
        assert len(slot) == len(want)
        for s, w in zip(slot.tolist(), want, strict=True):
            assert slots.setdefault(w, s) == s
    assert slots["<capitals>"] == quality.CAPITALS and slots["<again>"] == quality.AGAIN and len(set(slots.values())) >= len(slots) - 3  # words may share a slot
    dims, signs = quality.index_vectors()
    index = np.zeros((quality.SLOTS, quality.DIMS))
    np.put_along_axis(index, dims, signs, axis=1)
    sums = np.zeros_like(index)
    for t in texts:
        _, slot = quality.words(t.encode(), np.zeros(1, int))
        for i, s in enumerate(slot):
            for j in range(max(0, i - 2), min(len(slot), i + 3)):
                if j != i:
                    sums[s] += index[slot[j]]
    sums[: quality.MARKS] = index[: quality.MARKS]
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    vectors = quality.word_vectors(spark.createDataFrame([(t,) for t in [*texts, None]], "text string").repartition(5))
    assert np.allclose(vectors, sums / np.where(norm == 0, 1, norm), atol=1e-6)
    pooled = quality.pool(texts, vectors)
    for t, row in zip(texts, pooled, strict=True):
        _, slot = quality.words(t.encode(), np.zeros(1, int))
        n = max(1, (slot >= quality.MARKS).sum())
        assert np.allclose(row[: quality.DIMS], vectors[slot].sum(axis=0) / n, atol=1e-5) and np.allclose(row[quality.DIMS :], [(slot == m).sum() / n for m in range(quality.MARKS)])


def test_a_very_long_text_is_read_whole_and_in_pieces(monkeypatch):
    monkeypatch.setattr(quality, "PIECE", 1000)
    text = "word other " * 3000 + "x" * 5000 + " END"
    read = list(quality.pieces([text, "short", text]))
    assert all(len(data) <= 2001 for data, _, _ in read) and sum(len(data) - len(starts) for data, starts, _ in read) == 2 * len(text) + 5
    assert {o for _, _, owners in read for o in owners} == {0, 1, 2}
    vectors = np.random.default_rng(0).normal(size=(quality.SLOTS, quality.DIMS)).astype(np.float32)
    both = quality.pool([text, "short", text], vectors)
    assert np.allclose(both[0], both[2], atol=1e-6) and both[0][quality.DIMS + quality.CAPITALS] > 0


def test_temperature_is_the_best_of_those_tried():
    rng = np.random.default_rng(4)
    logit = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-logit / 3))).astype(float)
    weight = rng.random(400)
    loss = lambda t: -(weight * np.log(np.where(y == 1, 1 / (1 + np.exp(-logit / t)), 1 / (1 + np.exp(logit / t))))).sum()
    got = quality.temperature(logit, y, weight)
    assert all(loss(got) <= loss(t) + 1e-9 for t in np.exp2(np.linspace(-2, 4, 121))) and quality.temperature(logit[:0], y[:0], weight[:0]) == 1


def test_gradients_lower_the_loss_and_the_network_bends():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 2))
    y = ((x[:, 0] * x[:, 1]) > 0).astype(float)  # no plane tells these apart
    layers = quality.train(x, y, np.full(600, 1 / 600), quality.Params(rounds=1500, rate=0.03))
    assert (((quality._logits(layers, x) > 0) == (y == 1)).mean()) > 0.95


def test_quality_tells_held_out_texts_apart_and_takes_awkward_rows(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(300)]

    def text(good):
        ws = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 80))]
        return " ".join(ws) + "." if good else rng.choice([" | ".join(ws), " ".join(w.upper() + "!!" for w in ws), " ".join(w for w in ws[:10] for _ in range(8))])

    rows = [(i, text(i % 4 > 0), "clash", 1.0) for i in range(500)] + [(None, "a text", None, None), (501, None, None, None), (502, "", None, None), (7, "of a key that another has", "x", 2.0), (503, "long " * 300_000, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pooled string, score double")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 500) if i % 5] + [(3, None), (None, 1), (9, 1), (9, 1), (9999, 0)], "doc_id long, quality int")
    model = quality.fit(df, labels)
    got = quality.score(df, model, keep=["doc_id", "pooled"]).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got) and quality.score(df, model).columns == ["doc_id", "text", "pooled", "score", "predicted"]
    held = [r for r in got if r.doc_id is not None and r.doc_id < 500 and r.doc_id % 5 == 0]
    assert sum(r.predicted == int(r.doc_id % 4 > 0) for r in held) >= 0.97 * len(held)
    again = {(r.doc_id, r.pooled): r.score for r in quality.score(df.repartition(7), quality.fit(df.repartition(3), labels), keep=["doc_id", "pooled"]).collect()}
    assert all(again[r.doc_id, r.pooled] == pytest.approx(r.score, abs=1e-9) for r in got)
    none = quality.fit(df.limit(0), labels.limit(0))
    assert {r.score for r in quality.score(df, none).collect()} == {0.5} and quality.score(df.limit(0), model).count() == 0


def plain_trie(whole, words):
    """Nodes by hand: a dictionary of all prefixes of whole {conv_id: turns}."""
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    out = {}
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = sorted(c for c in cs if whole[c] == p)
        out[min(cs), len(p)] = (
            min(members[p[:-1]]) if p else None, len(cs), sum(len(q) == len(p) + 1 for q in below), sum(not any(len(x) > len(q) and x[: len(q)] == q for x in below) for q in below),
            sum((len(members[q]) - 1) * (words[q[-1]] if q else 0) for q in below), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        )
    return out


def nodes(df):
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()}


@pytest.mark.parametrize(("block", "chunk", "ids"), [(4096, 512, 256), (4, 2, 3), (2, 3, 1)])
def test_trie_equals_a_dictionary_of_prefixes(spark, monkeypatch, block, chunk, ids):
    for name, value in (("BLOCK", block), ("CHUNK", chunk), ("IDS", ids)):
        monkeypatch.setattr(prefix_trie, name, value)
    rng = random.Random(block)
    whole = {}
    for c in range(-3, 60):
        start = rng.choice([(), (), *[t for t in whole.values()]])
        whole[c] = (*start[: rng.randrange(8)], *(rng.randrange(3) for _ in range(rng.randrange(4))))
    whole |= {c: whole[5] + (1, 1, 1, 2) * 3 for c in range(100, 140)} | {200: (), 201: whole[5] + (1, 1, 1, 2) * 3 + (2,)}
    words = {0: 0, 1: 3, 2: 5}
    turns = [(c, i + 1, hashlib.md5(str(t).encode()).hexdigest(), words[t]) for c, ts in whole.items() for i, t in enumerate(ts)]
    rng.shuffle(turns)
    made = prefix_trie.trie(spark.createDataFrame([(c,) for c in whole], "conv_id long"), spark.createDataFrame(turns, "conv_id long, pos long, token string, words long"))
    assert made.count() == len(plain_trie(whole, words)) and nodes(made) == plain_trie(whole, words)


def test_tries_of_no_conversation_and_of_one(spark):
    convs, turns = spark.createDataFrame([], "conv_id long"), spark.createDataFrame([], "conv_id long, pos long, token string, words long")
    assert prefix_trie.trie(convs, turns).count() == 0
    one = spark.createDataFrame([(7,)], "conv_id long")
    empty, seven = hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"7").hexdigest()
    assert nodes(prefix_trie.trie(one, turns)) == {(7, 0): (None, 1, 0, 1, 0, seven)}
    two = spark.createDataFrame([(7, 1, "a" * 32, 3), (7, 2, "b" * 32, 4)], "conv_id long, pos long, token string, words long")
    assert nodes(prefix_trie.trie(one, two)) == {(7, 0): (None, 1, 1, 1, 0, empty), (7, 1): (7, 1, 1, 1, 0, empty), (7, 2): (7, 1, 0, 1, 0, seven)}


def test_turns_are_placed_by_turn_nulls_first_then_role_and_text(spark):
    rows = [(1, 3, "user", "c d"), (1, None, "user", None), (1, 3, "user", "c d"), (1, 700, None, "z"), (1, 3, "a", "e"), (None, 1, "user", "x"), (2, -5, "", "y " * 40_000), (1, 300, "user", "\x1cq")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("pos", "words", "token", "place", "stretch")})
    got = sorted((r.conv_id, r.pos, r.words) for r in prefix_trie.place(df).collect())
    assert got == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 2), (1, 5, 1), (1, 6, 1), (2, 1, 40_000)]
    tokens = {(r.conv_id, r.pos): r.token for r in prefix_trie.place(df).collect()}
    assert tokens[1, 3] == tokens[1, 4] and len(set(tokens.values())) == 6


def test_extents_and_sparse_tables_equal_a_scan():
    rng = np.random.default_rng(8)
    for n in (1, 2, 3, 7, 64, 100):
        v = rng.integers(0, 5, n)
        at, d = rng.integers(0, n, 50), rng.integers(0, 7, 50)
        before, after = prefix_trie.extents(v, at, d)
        for a, x, b, c in zip(at, d, before, after, strict=True):
            assert b == max([i for i in range(a) if v[i] < x], default=-1) and c == min([i for i in range(a + 1, n) if v[i] < x], default=n)


def plain_variants(counts):
    near = defaultdict(set)
    cut = defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            cut[i, w[:i] + w[i + 1 :]].add(w)
            if w[:i] + w[i + 1 :] in counts:
                near[w].add(w[:i] + w[i + 1 :])
                near[w[:i] + w[i + 1 :]].add(w)
    for ws in cut.values():
        for w in ws:
            near[w] |= ws
    form = {}
    for w, n in counts.items():
        near[w].discard(w)
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None)
    return out


@pytest.mark.parametrize(("tile", "group", "rows"), [(256, 4096, 1 << 15), (3, 8, 16), (5, 2, 1)])
def test_variants_equal_a_dictionary_of_cut_words(spark, monkeypatch, tile, group, rows):
    for name, value in (("TILE", tile), ("GROUP", group), ("ROWS", rows)):
        monkeypatch.setattr(variants, name, value)
    rng = random.Random(tile)
    counts = {}
    for _ in range(60):
        w = "".join(rng.choice("abàÿ") for _ in range(rng.randrange(1, 12)))
        for _ in range(8):
            counts.setdefault(w, rng.choice([2, 3, 30, 400, 4000, 50_000]))
            i = rng.randrange(len(w) + 1)
            w = rng.choice([w[:i] + "c" + w[i:], w[:i] + w[i + 1 :], w[:i] + "b" + w[i + 1 :]]) or "a"
    counts |= {"x" * 3000: 5, "x" * 2999: 50, "x" * 1500 + "y" + "x" * 1499: 7, "日本語" * 4: 2, "日本語" * 3 + "日本人": 40}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").withColumns({c: F.lit(1) for c in ("form", "block", "tile", "i")})
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.forms(df).collect()}
    assert got == plain_variants(counts)


def test_runs_and_vocabulary(spark):
    rows = [(1, "Été-ABCDEFG abcdefg\nabcdefgh1abcdefgÿ ×÷×÷×÷×"), (2, None), (3, ""), (None, "ABCDEFG"), (4, "q" * 100_000 + " " + "Q" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"run": F.lit(1), "n": F.lit(2)})
    found = variants.runs(df)
    got = Counter((r.doc_id, r.run) for r in found.collect())
    assert got == Counter({(1, "abcdefg"): 2, (1, "abcdefgh"): 1, (1, "abcdefgÿ"): 1, (1, "×÷×÷×÷×"): 1, (None, "abcdefg"): 1, (4, "q" * 100_000): 2})
    words = variants.vocabulary(found.withColumnRenamed("run", "word"))
    assert {(r.word, r.n) for r in words.collect()} == {("abcdefg", 3), ("q" * 100_000, 2)}
    assert variants.forms(words.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op12_prefix_trie", "op13_spelling"])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    frame = queries.QUERIES[name](spark, SF)
    found = con.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(frame.columns)
    assert Counter(tuple(r[c] for c in names) for r in frame.collect()) == Counter(found.fetchall())


def test_op13_deletes_the_letter_that_the_hash_names(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    counts = Counter()
    for r in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{r.doc_id}:{w}".encode())
            counts[w if h % 31 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    want = plain_variants({w: n for w, n in counts.items() if len(w) >= 7 and n >= 2})
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in queries.op13_spelling(spark, SF).collect()} == want


def test_op11_scores_held_out_documents(spark):
    got = {r.doc_id: r for r in queries.op11_quality(spark, SF).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [(got[r.doc_id].predicted, r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)
