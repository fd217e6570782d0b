"""The operators that run Python in tasks, against brute force on small tables with nulls, ties, repeats and clashing columns."""

from __future__ import annotations

import functools
import itertools
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from tracewell.llm import ann, fingerprints, langid, sentencepiece_scan, simhash, suffix_dedup, suffix_sort, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"


def docs(spark, texts, lang=None):
    return spark.createDataFrame([(i if i != 4 else None, t, lang(i) if lang else None, "s", 1, "taken") for i, t in enumerate(texts)], SCHEMA)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def test_fingerprints_and_components_equal_all_pairs(spark, monkeypatch):
    rng = random.Random(1)
    texts = ["", None, "One", "a b", " \t\x0b", "one"]
    base = words(rng, 300).split()
    for k in range(140):
        copy = list(base)
        copy[k] = "changed"
        texts += [" ".join(copy[: 100 + k])] if k % 4 else [words(rng, 40)]
    texts += texts[20:40]

    def print_of(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    fp = [print_of(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if (fp[a] ^ fp[b]).bit_count() <= 2:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    df = docs(spark, texts)
    ids = [i if i != 4 else None for i in range(len(texts))]
    least = {}
    for i in ids:
        if i is not None:
            least.setdefault(find(i), i)
    around = [len({y for y in fp if 0 < (x ^ y).bit_count() <= 2}) for x in fp]
    assert max(around) > 5
    for cell in (48, 1):
        monkeypatch.setattr(simhash, "CELL", cell)
        got = {r.doc_id: (r.fp, r.component_id, r.links) for r in simhash.components(df).collect()}
        assert got == {i: (simhash._signed(fp[k]), least[find(k)], around[k]) for k, i in enumerate(ids)}
    assert simhash.components(df.limit(0)).count() == 0


def test_near_dedup_keeps_one_of_each_group_and_clean_texts(spark, monkeypatch):
    rng = random.Random(2)
    clean = [words(rng, 200, 5000) for _ in range(40)]
    base = words(rng, 400, 5000).split()
    near = []
    for k in range(60):
        copy = list(base)
        for at in rng.sample(range(400), 3):
            copy[at] = f"edit{k}"
        near.append(" ".join(copy))
    df = docs(spark, clean + near + [clean[0], None, "", near[0]])
    for chunk in (1024, 8):
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        kept = simhash.near_dedup(df)
        assert kept.columns == df.columns
        ids = {r.doc_id for r in kept.collect()}
        assert {i for i in range(40)} - {4} <= ids and len([i for i in ids if i is not None and 40 <= i < 100]) == 1 and 100 not in ids and None in ids


def jaccard_components(texts, shingle=5, similarity=0.8):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        x, y = len(sets[i] & sets[j]), len(sets[i] | sets[j])
        if not y or 10 * x >= int(similarity * 10) * y:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(texts))]


def found_components(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(simhash.similar(df).collect())
    return [got[i] for i in range(len(texts))]


def test_similar_keeps_documents_below_the_similarity(spark):
    rng = random.Random(8)
    texts = []
    for k in range(60):  # pairs of Jaccard similarity 0.70 to 0.79
        a = words(rng, 304, 100_000).split()
        texts += [" ".join(a), " ".join([*a[: 300 - 33 - k % 15], *words(rng, 37 + k % 15, 100_000).split()])]
    passage = words(rng, 260, 100_000)
    texts += [f"{passage} {words(rng, 80, 100_000)}" for _ in range(60)]  # pairwise about 0.6
    assert jaccard_components(texts) == list(range(len(texts)))
    assert found_components(spark, texts) == list(range(len(texts)))


@pytest.mark.parametrize("chunk", [32, 4])
def test_similar_compares_all_pairs_of_hot_cells(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = random.Random(9)
    passages = [words(rng, 30, 100_000) for _ in range(24)]
    texts = [" ".join(passages[i] for i in sorted(rng.sample(range(24), 16))) for _ in range(150)]  # no rare shingles at all
    base = words(rng, 300, 100_000).split()
    for _ in range(80):  # a chain: each is near to its neighbours only
        at = rng.randrange(0, 290)
        base = [*base[:at], *words(rng, 8, 100_000).split(), *base[at + 8 :]]
        texts.append(" ".join(base))
    expected = jaccard_components(texts)
    assert 1 < len(set(expected)) < len(texts) - 80
    assert found_components(spark, texts) == expected


@pytest.mark.parametrize("n", [300, 1200])
def test_texts_of_one_template_are_not_paired(spark, monkeypatch, n):
    """Pages of one template at a similarity of 0.7 share cells, and none of them is near another but for one planted copy."""
    monkeypatch.setattr(simhash, "CHUNK", 16)
    pairs, save = [], simhash.saved

    def counted(df, name):
        found = save(df, name)
        if name == "pairs":
            pairs.append(found.count())
        return found

    monkeypatch.setattr(simhash, "saved", counted)
    rng = random.Random(11)
    template = words(rng, 165, 100_000)
    texts = [f"{template} {words(rng, 35, 100_000)}" for _ in range(n)]
    texts.append(texts[0][:-3] + "end")
    got = found_components(spark, texts)
    assert got == [*range(n), 0] and sum(pairs) <= 20 * n
    if n == 300:
        assert got == jaccard_components(texts)


def test_similar_equals_jaccard_of_all_pairs(spark):
    rng = random.Random(10)
    texts = [None, "", "one", "One", "a b c d", "a b c d e", "a b c d e f", " \t"]
    for n in (6, 9, 14, 25, 60, 150, 400, 900):
        for k in range(24):
            a = words(rng, n, 100_000).split()
            cut = max(1, round((n - 4) * (0.07 + 0.008 * k)))  # about 0.60 to 0.87
            texts += [" ".join(a), " ".join([*a[:-cut], *words(rng, cut, 100_000).split()]), " ".join(a[: n - cut])]
    line = words(rng, 40, 100_000)
    rest = words(rng, 300, 100_000)
    texts += [f"{line} {line} {rest}", " ".join([line] * 60) + f" {rest}", rest]  # the same shingles, one line repeated more often
    assert found_components(spark, texts) == jaccard_components(texts)


def windows_kept(texts):
    """Of each text: kept bytes and number of removed runs, by the hashes of all windows."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(xxhash.xxh3_128_intdigest(b[i : i + 200]) for b in raw for i in range(len(b) - 199))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[xxhash.xxh3_128_intdigest(b[i : i + 200])] > 1:
                gone[i : i + 200] = b"\1" * 200
        out.append((bytes(x for x, g in zip(b, gone, strict=True) if not g), len(re.findall(b"\1+", bytes(gone)))))
    return out


@pytest.mark.parametrize(("hot", "batch", "partitions", "mask"), [(8192, 8192, 1, -1), (8192, 5, 3, -1), (2, 3, 7, -1), (8192, 8192, 1, 0), (8192, 5, 7, 1), (2, 3, 3, 0)])
def test_suffix_dedup_equals_all_windows(spark, monkeypatch, hot, batch, partitions, mask):
    """mask: bits of the contexts' hashes that count; with few of them different contexts collide, inside a batch and between batches."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "CONTEXT_MASK", mask)
    monkeypatch.setattr(suffix_dedup, "BATCH", batch)
    rng = random.Random(3)
    letters = "abcdefgh é\n"
    passages = ["".join(rng.choice(letters) for _ in range(rng.randint(190, 500))) for _ in range(3)]
    texts = ["", None, "a" * 700, "xy" * 300, "short", "é" * 100, "q" * 199]
    for _ in range(70):
        p = rng.choice(passages)
        texts.append("".join(rng.choice(letters) for _ in range(rng.randint(0, 90))) + p[rng.randint(0, 30) : len(p) - rng.randint(0, 30)] + "".join(rng.choice(letters) for _ in range(rng.randint(0, 40))))
    texts += [texts[9], "tail" + texts[9]]
    df = docs(spark, texts).unionByName(docs(spark, texts).where("doc_id = 12")).repartition(partitions)
    rows = [(r.doc_id, r.text or "") for r in df.collect()]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in suffix_dedup.dedup(df).collect())
    want = zip(rows, windows_kept([t for _, t in rows]), strict=True)
    assert got == sorted((str(i), len(t.encode()), len(t.encode()) - len(kept), spans, kept) for (i, t), (kept, spans) in want)
    assert suffix_dedup.without_repeats(df).columns == df.columns and suffix_dedup.dedup(df.limit(0)).count() == 0


def test_suffix_dedup_of_one_prefix_in_very_many_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 100)
    rng = random.Random(13)
    text = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    passage = text(230)
    texts = [text(rng.randint(0, 60)) + passage[rng.choice((0, 0, 0, rng.randint(1, 40))) :] + text(rng.randint(0, 60)) for _ in range(1200)]
    df = docs(spark, texts)
    got = {r.doc_id: (bytes(r.kept), len(r.spans)) for r in suffix_dedup.dedup(df.repartition(5)).collect()}
    assert got == {i if i != 4 else None: x for i, x in enumerate(windows_kept(texts))}


def test_suffix_dedup_of_a_very_long_text_of_one_letter(spark):
    texts = ["a" * 3_000_000, "b" * 150, "a" * 500 + "c"]
    got = {r.doc_id: (r.n_bytes, bytes(r.kept), [tuple(s) for s in r.spans]) for r in suffix_dedup.dedup(docs(spark, texts)).collect()}
    assert got == {0: (3_000_000, b"", [(0, 3_000_000)]), 1: (150, b"b" * 150, []), 2: (501, b"c", [(0, 500)])}


def test_suffixes_are_sorted_and_collisions_do_not_count(monkeypatch):
    rng = random.Random(14)
    contexts, anchors, group = [], [], []
    for g in range(40):
        base = bytes(rng.choice(b"ab") for _ in range(328))
        for _ in range(rng.randint(1, 30)):
            left, right = rng.randint(0, 128), rng.randint(72, 200)
            own = bytearray(base[128 - left : 128 + right])
            if rng.random() < 0.7:
                own[rng.randrange(len(own))] ^= 1
            contexts.append(bytes(own))
            anchors.append(left)
            group.append(g)
    found = []
    for weak in (False, True):
        if weak:  # hashes that often collide
            monkeypatch.setattr(suffix_sort, "VALUES", np.arange(256, dtype=np.uint64) % 2)
            monkeypatch.setattr(suffix_sort, "BASE", np.uint64(1))
        s = suffix_sort.Suffixes(contexts, np.array(anchors), 128, 200)
        if not weak:
            suffixes = [c[a:] for c, a in zip(contexts, anchors, strict=True)]
            assert s.order(np.array(group)).tolist() == sorted(range(len(contexts)), key=lambda i: (group[i], suffixes[i], i))
        found.append([x.tolist() for x in s.repeats(np.array(group), 200)])
    places = [{k for k in range(129) for j in range(len(contexts)) if j != i and group[i] == group[j] and min(anchors[i], anchors[j]) >= k and len(a := contexts[i][anchors[i] - k : anchors[i] - k + 200]) == 200 and a == contexts[j][anchors[j] - k : anchors[j] - k + 200]} for i in range(len(contexts))]
    assert found[0] == [[-max(p, default=-1) for p in places], [-min(p, default=129) for p in places]]
    assert all(x == 1 or -x in p for x, p in zip(found[1][0], places, strict=True))


def test_long_texts_come_in_pieces(monkeypatch):
    rng = random.Random(4)
    text = bytes(rng.randrange(97, 123) for _ in range(9_000))
    whole = suffix_dedup.Anchors().runs([text])
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 2_000)
    pieces = suffix_dedup.Anchors().runs([b"no", text, b""])
    starts = lambda r: [(int(a) + k, int(a) + int(o)) for a, n, o in zip(r["at"], r["windows"], r["anchor"], strict=True) for k in range(int(n))]
    assert starts(whole) == starts(pieces) and [w for w, _ in starts(whole)] == list(range(9_000 - 199))


def test_scan_gives_the_library_s_ids(spark):
    model = sentencepiece_scan.read_model()
    encoder = sentencepiece_scan.Encoder(model)
    rng = random.Random(5)
    odd = ["", None, " ", "  a ", "\n", "é\tb", "中文😀" * 30, "thequickbrownfox" * 20, "x" * 150 + " y z  ", "a b", "aaa" * 70 + " " * 70 + "b", " " * 200, "▁▁ a▁"]
    odd += ["".join(rng.choice(["the", "ing", "é", "中", "😀", "\n", "QX", "==", "0", " ", "  "][: 9 + k % 3]) for _ in range(60)) for k in range(9)]
    odd += ["one text of several words and an " + "antidisestablishmentarianism" * 9 + " in it, more than once. " * 20]
    df = docs(spark, odd).withColumns({c: F.lit(1) for c in ("row", "no", "_row", "doc", "ids", "piece")})
    want = sorted((str(i if i != 4 else None), encoder.processor.encode(t or ""), (t or "").replace("▁", " ")) for i, t in enumerate(odd))
    for chunk in (encoder.longest, 40, 1 << 16):
        coded = sentencepiece_scan.decode(sentencepiece_scan.encode(df, model, chunk=chunk), model)
        assert sorted((str(r.doc_id), r.ids, r.decoded) for r in coded.collect()) == want
        assert set(coded.columns) == {*df.columns, "decoded"}
    assert sentencepiece_scan.encode(df.limit(0), model).count() == 0
    with pytest.raises(ValueError, match="longest piece"):
        sentencepiece_scan.encode(df, model, chunk=3)


def test_chunks_of_any_text_give_the_library_s_ids():
    encoder = sentencepiece_scan.Encoder(sentencepiece_scan.read_model())
    rng = random.Random(16)
    for k in range(60):
        t = "".join(rng.choice(["the ", "ing", "é", "中", "\n", "QX", " ", "  ", "word", "s of ", "tion", "."]) for _ in range(rng.randint(1, 60)))
        text, chunk = sentencepiece_scan.marked(t), rng.choice((encoder.longest, 25, 60))
        cuts = [(a, min(len(text), a + chunk)) for a in range(0, len(text), chunk)]
        frame = pd.DataFrame([{"row": 1, "no": n, "parent": 0, "n": len(m), "cells": (m == 0).tobytes(), "entry": 0, "exit": 0} for n, (a, b) in enumerate(cuts) for m in [encoder.chunk_matrix(text, a, b)]])
        path = sentencepiece_scan.ways(frame)
        got = [i for (a, b), r in zip(cuts, path.itertuples(), strict=True) for i in encoder.chunk_ids(text, a, b, r.entry, r.exit).tolist()]
        assert got == encoder.processor.encode(t)
        if len(cuts) > 3:  # in any order of combining
            parts = [encoder.chunk_matrix(text, a, b) for a, b in cuts]
            left = functools.reduce(sentencepiece_scan.combine, parts)
            both = sentencepiece_scan.combine(functools.reduce(sentencepiece_scan.combine, parts[:2]), functools.reduce(sentencepiece_scan.combine, parts[2:]))
            assert np.array_equal(left, both) and left[0, 0] == 0


def test_transfer_matrices_are_associative():
    encoder = sentencepiece_scan.Encoder(sentencepiece_scan.read_model())
    text = sentencepiece_scan.marked("antidisestablishmentarianism" * 4)
    bounds = [0, 20, 41, 70, len(text)]
    a, b, c, d = (encoder.transfer(text, x, y) for x, y in zip(bounds, bounds[1:], strict=False))
    both = sentencepiece_scan.combine
    assert np.array_equal(both(both(a, b), both(c, d)), both(a, both(b, both(c, d)))) and both(both(a, b), both(c, d))[0, 0] == 0


def test_edits_follow_the_order_of_keys(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS_PER_BUCKET", 7)
    rng = random.Random(6)
    texts = ["", None, "é", "abc"] + [words(rng, rng.randint(1, 80)) for _ in range(90)]
    df = docs(spark, texts).unionByName(docs(spark, texts).where("doc_id = 9"))
    rows = sorted(((r.doc_id if r.doc_id is not None else -(1 << 63), r.text or "", r.doc_id) for r in df.collect()))
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in fingerprints.edits(df).collect())
    import hashlib

    print_ = lambda t: fingerprints.fingerprints([t.encode()])[0]
    want = Counter()
    for k, (_, t, key) in enumerate(rows):
        cut, after = len(t) // 4, rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - cut] + after[:cut]
        near = [round(fingerprints.contained(print_(t), print_(x)), 9) for x in (edited, after)]
        want[(key, len(t), hashlib.sha256(edited.encode()).hexdigest(), fingerprints.shown(print_(t)), *near)] += 1
    assert got == want
    monkeypatch.setattr(fingerprints, "MOST_BUCKETS", 2)
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprints.edits(df).collect()) == Counter(k[:3] for k in want.elements())
    one = fingerprints.edits(docs(spark, ["lonely text"])).first()
    assert one.near_next == 1.0 and fingerprints.edits(df.limit(0)).count() == 0


def test_containment_is_of_bytes_and_resists_shifts(spark):
    rng = random.Random(7)
    text = words(rng, 800, 9000)
    a, b = fingerprints.fingerprints([text.encode(), ("shifted by this " + text).encode()])
    assert fingerprints.contained(a, b) > 0.95 and fingerprints.contained(a, a) == 1 and fingerprints.contained({}, a) == 0 and fingerprints.contained({}, {}) == 1
    slow = []
    at = 0
    while at < len(text):  # the same boundaries, byte by byte
        h, end = 0, None
        for i in range(max(0, at + fingerprints.LEAST - 32), len(text)):
            h = sum(int(fingerprints.GEAR[ord(text[i - k])]) << k for k in range(min(32, i + 1))) & 0xFFFFFFFF
            size = i + 1 - at
            if size >= fingerprints.LEAST and (h >> 25 == 0 or size >= fingerprints.NORMAL and h >> 27 == 0) or size == fingerprints.MOST:
                end = i + 1
                break
        end = end or len(text)
        slow.append((at, end))
        at = end
    assert next(fingerprints.chunks([text.encode()])) == slow
    df = spark.createDataFrame([(fingerprints.shown(a), fingerprints.shown(b)), ("", ""), ("", fingerprints.shown(b))], "a string, b string")
    assert [r[0] for r in df.select(fingerprints.containment(F.col("a"), F.col("b"))).collect()] == pytest.approx([fingerprints.contained(a, b), 1, 0])


def test_search_finds_the_nearest(spark):
    rng = np.random.default_rng(8)
    v = rng.standard_normal((600, 16)) * rng.uniform(0.5, 3, (600, 1))
    v[100:140] = v[100]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (1004, []), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(df, df.where("vec_id % 20 = 0"), k=20).collect()
    v = v.astype(np.float32).astype(float)
    hits = 0
    for q in range(0, 600, 20):
        mine = sorted([r for r in got if r.query_id == q], key=lambda r: r["rank"])
        score = v @ v[q]
        best = [i for i in np.lexsort((np.arange(600), -score.round(12))).tolist() if i != q][:20]
        assert [r["rank"] for r in mine] == list(range(1, 21)) and all(abs(r.score - score[r.vec_id]) < 1e-9 for r in mine)
        hits += len({r.vec_id for r in mine} & set(best))
    assert hits >= 0.9 * 30 * 20 and {r.query_id for r in got} == set(range(0, 600, 20))
    copies = [r.vec_id for r in sorted((r for r in got if r.query_id == 100), key=lambda r: r["rank"]) if 100 < r.vec_id < 140]
    assert copies == list(range(101, 101 + len(copies)))  # equal scores: the smaller vec_id first
    assert len(ann.nearest(df.where("vec_id < 5"), df.where("vec_id = 0")).collect()) == 4 and ann.nearest(df.limit(0), df).count() == 0


LANGUAGES = {"aa": "lorem ipsum dolor amet consectetur", "bb": "zwölf größe über straße mäßig", "cc": "où êtes garçon déjà très"}


def test_languages_are_told_apart(spark):
    rng = random.Random(9)
    text = lambda lang: " ".join(rng.choice(LANGUAGES[lang].split()) for _ in range(30))
    names = sorted(LANGUAGES)
    df = docs(spark, [text(names[i % 3]) for i in range(240)], lambda i: names[i % 3] if i % 7 else None)
    model = langid.fit(df)
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    assert all(r.lang_pred == names[i % 3] and 0 < r.score <= 1 and not r.rejected for i, r in got.items() if i is not None)
    others = docs(spark, [None, "", " 12 !?", "漢字仮名交じり文" * 20, "lorem"])
    judged = [(r.lang_pred, r.rejected) for r in langid.predict(others, model).orderBy("text").collect()]
    assert [x for x in judged if x[0] == "und"] == [("und", True)] * 3 and (True in [r for p, r in judged if p != "und"]) and ("aa", False) in judged
    assert langid.predict(others, langid.fit(df.limit(0))).where("lang_pred <> 'und'").count() == 0 and langid.predict(df.limit(0), model).count() == 0


def test_predictions_equal_plain_nearest_centroids(spark):
    rng = random.Random(12)
    text = lambda lang, n: " ".join(rng.choice(LANGUAGES[lang].split()) for _ in range(n))
    names = sorted(LANGUAGES)
    texts = [text(names[i % 3], rng.randint(1, 40)) + rng.choice(["", " 12!", " aé", "\n"]) for i in range(150)] + ["", None, "9", "漢字"]
    df = docs(spark, texts, lambda i: names[i % 3])
    model = langid.fit(df)

    def grams(t):
        raw = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in t.lower().encode())
        raw += b" " * (3 - len(raw))
        return Counter(((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761 % (1 << 32)) >> 19 for i in range(len(raw) - 2))

    counts = [grams(t) for t in texts if t is not None]
    df_ = Counter(g for c in counts for g in c)
    idf = {g: np.log((1 + len(counts)) / (1 + n)) + 1 for g, n in df_.items()}
    assert np.allclose(model.idf[sorted(idf)], [idf[g] for g in sorted(idf)], atol=1e-5)
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    for i, t in enumerate(texts):
        r = got[i if i != 4 else None]
        if not any(map(str.isalpha, t or "")):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0, True)
            continue
        v = {g: (1 + np.log(n)) * model.idf[g] for g, n in grams(t).items()}
        norm = sum(x * x for x in v.values()) ** 0.5
        cosine = [sum(x * float(c[g]) for g, x in v.items()) / norm for c in model.centroids]
        assert r.score == pytest.approx(max(cosine), abs=1e-5) and r.lang_pred == model.languages[model.of[int(np.argmax(cosine))]]


def test_hot_texts_and_dirty_languages_crowd_out_nothing(spark):
    rng = random.Random(15)
    text = lambda lang: " ".join(rng.choice(LANGUAGES[lang].split()) for _ in range(30))
    rows = [(text("aa"), "aa")] * 5000 + [(text(x), x) for x in ("bb", "cc") for _ in range(100)] + [(text("cc"), f"dirty{i}") for i in range(60)]
    rows += [("long déjà " * 9000, "only_long")]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(6)
    params = langid.Params(fit_rows=50, languages=30)
    kept = Counter(r.lang for r in langid.sample(df, params).collect())
    assert len(kept) == 30 and kept["aa"] == 1 and kept["bb"] == kept["cc"] == 50
    model = langid.fit(df.where("lang not like 'dirty%'"), params)
    assert model.languages == ["aa", "bb", "cc", "only_long"] and np.bincount(model.of).tolist() == [1, 4, 4, 1]
    again = langid.fit(df.where("lang not like 'dirty%'").repartition(3), params)
    assert np.array_equal(model.centroids, again.centroids) and np.array_equal(model.least, again.least)


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(10)
    for n in (1, 2, 7):
        emission, transition = rng.normal(size=n) * 2, rng.normal(size=(2, 2))
        first = np.zeros(n, bool)
        first[0] = True
        if n > 4:
            first[3] = True
        total, marked = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=n):
            s = sum(emission[i] * y[i] + transition[0 if first[i] else y[i - 1], y[i]] for i in range(n))
            total += np.exp(s)
            marked += np.exp(s) * np.array(y)
        want = np.zeros(n)
        want[:] = marked / total
        if n <= 4:
            assert toxicity.marginals(emission, first, transition) == pytest.approx(want)
        long = np.tile(emission, 40)
        starts = np.tile(first, 40)
        assert toxicity.marginals(long, starts, transition)[-n:] == pytest.approx(toxicity.marginals(emission, first, transition))


def test_toxic_spans_and_scores(spark):
    rng = random.Random(11)
    texts, labels = [], []
    for i in range(300):
        w = [f"plain{rng.randrange(60)}" for _ in range(25)]
        if i % 3 == 0:
            for at in rng.sample(range(25), 3):
                w[at] = rng.choice(["Nasty", "vile", "foul"])
        texts.append(" ".join(w))
        labels.append((i, int(i % 3 == 0)))
    df = docs(spark, texts)
    model = toxicity.fit(df, spark.createDataFrame(labels[:200], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert all(r.predicted == int(i % 3 == 0) for i, r in got.items() if i is not None and i >= 200)
    for i in (201, 204):
        assert {texts[i][s.start : s.end] for s in got[i].spans} <= {"Nasty", "vile", "foul"} and len(got[i].spans) == 3
    assert isinstance(got[5].score, float)  # the text column that was there gives way
    odd = toxicity.score(docs(spark, ["", None, "!!", "İnasty ..."]), model).collect()
    assert all(0 <= r.score <= 1 for r in odd) and sum(not r.spans for r in odd) >= 3 and toxicity.score(df.limit(0), model).count() == 0


def test_near_dedup_links_by_fingerprints_before_anything_else(spark, monkeypatch):
    rng = random.Random(5)
    base = words(rng, 900, 5000)
    texts = [base, base + " end", words(rng, 300, 5000), words(rng, 300, 5000)]
    rows = dict(enumerate(simhash.majority(simhash.shingle_hashes(simhash.words_of(t), 5)) for t in texts))
    assert int(rows[0] ^ rows[1]).bit_count() <= simhash.MOST < int(rows[0] ^ rows[2]).bit_count()
    prefixes = simhash.prefixes
    monkeypatch.setattr(simhash, "prefixes", lambda *a: prefixes(*a).limit(0))
    assert found_components(spark, texts) == [0, 0, 2, 3]


def test_dedup_leaves_no_tables_but_what_its_result_reads(spark):
    rng = random.Random(5)
    base = words(rng, 120)
    df = docs(spark, [base, base + " more", base, None, words(rng, 90), "x " + base[:400], ""])
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{spark.conf.get('spark.checkpoint.dir')}/tables-{spark.sparkContext.applicationId}")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    there = lambda: {s.getPath().getName() for s in fs.listStatus(folder)} if fs.exists(folder) else set()
    for operator, name in ((simhash.near_dedup, "gone"), (suffix_dedup.without_repeats, "spans")):
        before = there()
        kept = operator(df)
        (left,) = there() - before
        assert left.startswith(f"{name}-") and before <= there()
        assert kept.count() == (4 if name == "gone" else 7)
