"""Toxicity's fit and score against plain loops; very long texts; extra columns whose names clash."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tracewell.llm import chat, fingerprints, langid, simhash, toxicity, url_filter


def plain_marginals(emission, transition):
    """Of the words of one text, by loops over states; the state before the first word is clean."""
    n = len(emission)
    forward, backward = np.zeros((n, 2)), np.ones((n, 2))
    for i in range(n):
        for b in (0, 1):
            before = [1.0, 0.0] if i == 0 else forward[i - 1]
            forward[i, b] = sum(before[a] * math.exp(transition[a][b] + b * emission[i]) for a in (0, 1))
        forward[i] /= forward[i].sum()
    for i in range(n - 2, -1, -1):
        for a in (0, 1):
            backward[i, a] = sum(math.exp(transition[a][b] + b * emission[i + 1]) * backward[i + 1, b] for b in (0, 1))
        backward[i] /= backward[i].sum()
    p = forward * backward
    pairs = np.zeros((2, 2))
    for i in range(n):
        cell = np.array([[(float(a == 0) if i == 0 else forward[i - 1, a]) * math.exp(transition[a][b] + b * emission[i]) * backward[i, b] for b in (0, 1)] for a in (0, 1)])
        pairs += cell / cell.sum()
    return (p[:, 1] / p.sum(axis=1)) if n else np.zeros(0), pairs


def plain_score(model, text):
    words = re.findall(r"\w+", text)
    p, _ = plain_marginals([model.emission(w) for w in words], model.transition)
    top, total = max([1e-9, *p]), float(sum(p))
    top = min(top, 1 - 1e-9)
    x = [1, math.log(top / (1 - top)) / 10, math.log1p(total), math.log((total + 0.02) / (len(words) + 20)) / 4]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.calibration, strict=True))))


def toxic_texts(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = [f"plain{rng.randrange(40)}" for _ in range(rng.randrange(1, 20))]
        if i % 3 == 0:
            for _ in range(2):
                w.insert(rng.randrange(len(w) + 1), rng.choice(["nasty", "vile", "foulest"]))
        out.append((i, " ".join(w), int(i % 3 == 0)))
    return out


def test_the_fit_is_that_of_plain_loops(spark):
    rows, params = toxic_texts(60, 1), toxicity.Params(rounds=6)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"), params)
    words = [re.findall(r"\w+", t.lower()) for _, t, _ in rows]
    marked = toxicity.toxic_items(words, np.array([y for *_, y in rows]), params)
    feats = lambda w: [f"={w}", *toxicity.affixes(w)]
    truth = [[int(bool(y) and not marked.isdisjoint(feats(w))) for w in ws] for ws, (*_, y) in zip(words, rows, strict=True)]
    count = {}
    for ws in words:
        for w in ws:
            for f in feats(w):
                count[f] = count.get(f, 0) + 1
    weight, bias, trans = dict.fromkeys(count, 0.0), -3.0, np.zeros((2, 2))
    sums, bias_sum, trans_sum = dict.fromkeys(count, 1.0), 1.0, np.ones((2, 2))
    for _ in range(params.rounds):
        grad, bias_grad, seen, expected = dict.fromkeys(count, 0.0), 0.0, np.zeros((2, 2)), np.zeros((2, 2))
        for ws, ys in zip(words, truth, strict=True):
            p, pairs = plain_marginals([bias + sum(weight[f] for f in feats(w)) for w in ws], trans)
            expected += pairs
            for i, (w, y) in enumerate(zip(ws, ys, strict=True)):
                seen[ys[i - 1] if i else 0, y] += 1
                bias_grad += y - p[i]
                for f in feats(w):
                    grad[f] += y - p[i]
        for f in count:
            g = (grad[f] if count[f] >= 3 else 0.0) - params.l2 * weight[f]
            sums[f] += g * g
            weight[f] += params.rate * g / math.sqrt(sums[f])
        bias_sum += bias_grad**2
        bias += params.rate * bias_grad / math.sqrt(bias_sum)
        trans_sum += (seen - expected) ** 2
        trans = trans + params.rate * 0.1 * (seen - expected) / np.sqrt(trans_sum)
    assert model.bias == pytest.approx(bias, abs=1e-6) and np.allclose(model.transition, trans, atol=1e-6)
    got = {f"={w}": v for w, v in model.words.items()} | model.affixes
    assert all(got.get(f, 0.0) == pytest.approx(v, abs=1e-5) for f, v in weight.items()) and max(weight.values()) > 0.5


def test_scores_of_documents_are_those_of_plain_loops(spark):
    rows = toxic_texts(150, 2)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    odd = [(900, "", 0), (901, None, 0), (902, "!!", 0), (903, "Nasty", 0), (904, "vile " * 70 + "plain1", 0), (905, "plain2 " * 5000 + "vile", 0)]
    texts = dict((i, t or "") for i, t, _ in rows + odd)
    clash = spark.createDataFrame(rows + odd, "doc_id long, text string, spans int").withColumn("score", F.lit("x"))
    got = {r.doc_id: r for r in toxicity.score(clash, model).collect()}
    assert len(got) == len(texts) and all(got[i].score == pytest.approx(plain_score(model, t), abs=1e-9) for i, t in texts.items())
    assert [(s.start, s.end) for s in got[905].spans] == [(35_000, 35_004)]


def test_very_long_texts_are_read_whole(spark):
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(90_000)}" for _ in range(300_000))
    rows = [(1, long), (2, long + " end"), (3, long[:-40]), (4, "short one"), (5, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    words = long.split()
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(len(words) - 2)]
    want = "%016x" % sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    prints = {r.doc_id: r.fp & (1 << 64) - 1 for r in simhash.components(df).collect()}
    assert "%016x" % prints[1] == want and prints[1] == prints[5]
    near = {r.doc_id: r.component_id for r in simhash.similar(df).collect()}
    assert near == {1: 1, 2: 1, 3: 1, 4: 4, 5: 1}
    shown = {r.doc_id: r.fingerprint for r in fingerprints.with_fingerprint(df).collect()}
    assert shown[1] == shown[5] == fingerprints.shown(fingerprints.fingerprints([long.encode()])[0]) != shown[2]
    both = fingerprints.contained(*(fingerprints.fingerprints([t.encode()])[0] for t in (long, long + " end")))
    assert both > 0.99
    learn = [(i, " ".join(rng.choice(("der", "und", "nicht", "mit") if i % 2 else ("the", "and", "not", "with")) for _ in range(40)), "de" if i % 2 else "en") for i in range(80)]
    model = langid.fit(spark.createDataFrame(learn, "doc_id long, text string, lang string"))
    told = {r.doc_id: r.lang_pred for r in langid.predict(spark.createDataFrame([(1, "the and not with " * 200_000), (2, "der und nicht mit " * 200_000), (3, "1" * 3_000_000)], "doc_id long, text string"), model).collect()}
    assert told == {1: "en", 2: "de", 3: "und"}
    spoken = spark.createDataFrame([(1, 0, "user", "a<|im_end|>\\" * 100_000), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string")
    out = chat.render(chat.fold_rows(spoken)).select(chat.parse(F.col("formatted")).alias("turns")).first()
    assert [(t.role, t.text) for t in out.turns] == [("user", "a<|im_end|>\\" * 100_000), ("assistant", long)]


def test_clashing_names_change_nothing(spark):
    rng = random.Random(4)
    texts = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(0, 90)))) for i in range(25)]
    plain = spark.createDataFrame(texts, "doc_id long, text string")
    names = ("fingerprint", "bucket", "next", "n_chars", "row", "at", "first", "edited", "print", "key", "component", "node", "host", "path", "rule", "verdict", "action", "u", "v", "a", "b", "from_url", "to_url", "id")
    odd = lambda df: df.withColumns({c: F.lit(3) for c in names if c not in df.columns})
    rows = lambda df, *c: sorted(map(str, df.select(*c).collect()))
    own = fingerprints.edits(plain)
    assert rows(fingerprints.edits(odd(plain)), *own.columns) == rows(own, *own.columns)
    assert rows(fingerprints.with_fingerprint(odd(plain)), "doc_id", "fingerprint") == rows(fingerprints.with_fingerprint(plain), "doc_id", "fingerprint")
    pages = [(i, f"http://h{i % 4}.com/{('x', 'en', 'de')[i % 3]}/{i}", f'<link rel="canonical" href="http://h{(i + 1) % 4}.com/x/{i // 2}">' if i % 2 else None) for i in range(20)] + [(98, None, None), (99, "no scheme", "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rules = spark.createDataFrame([("h1.com", "/x/", "block"), ("com", "/de/", "allow")], url_filter.RULES_SCHEMA)
    want = url_filter.url_verdicts(df, rules)
    got = url_filter.url_verdicts(odd(df), rules)
    keep = ("page_id", "host", "path", "rule", "verdict")
    assert rows(got, *keep) == rows(want, *keep) and {r.verdict for r in want.collect()} == {"allow", "block"}
    assert url_filter.url_verdicts(df.limit(0), rules).count() == 0
