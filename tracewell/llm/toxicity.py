"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import map_texts, slices

WORD = re.compile(r"\w+")
SLICE_BYTES = 1 << 22
BLOCK = 64
CACHED_WORDS = 400_000


@dataclass(frozen=True)
class Params:
    fit_rows: int = 2000  # rows of each label, at most, that the field is fitted on
    fit_chars: int = 6_000  # longest text that it is fitted on
    lift: float = 8.0  # of a toxic item: its rate in toxic texts over that in clean ones
    pure_lift: float = 100.0  # from which an item is toxic though other items explain its texts
    support: float = 0.1  # of the toxic texts of the most frequent item, in which such an item is at least
    rounds: int = 60
    rate: float = 0.5
    l2: float = 0.3
    span: float = 0.5  # least marginal of an offending word


@dataclass(frozen=True)
class Model:
    words: dict[str, float]  # weights by feature; a word's emission is their sum
    affixes: dict[str, float]
    bias: float
    transition: np.ndarray  # log potentials, from state (0 clean, 1 toxic) to state
    calibration: np.ndarray  # of the document score: constant, weights of the document features

    def emission(self, word: str) -> float:
        word = word.lower()
        return self.bias + self.words.get(word, 0.0) + sum(self.affixes.get(a, 0.0) for a in affixes(word))


class Emissions(dict):
    """Emissions by word as written, filled as words come up and emptied when it is full."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = value = self.model.emission(word)
        return value


def affixes(word: str) -> list[str]:
    """Beginnings of three to eight letters, and the ending of four."""
    return [*(f"{word[:n]}-" for n in range(3, min(8, len(word)) + 1)), f"-{word[-4:]}"]


def messages(emission: np.ndarray, first: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages of all words, each as its odds of toxic over clean.

    first marks the first word of each text, before which the state is clean. A message passes a word
    as a 2 x 2 matrix acts on a vector; the matrices of a block of words are multiplied for all blocks at
    once, messages between blocks follow in order, and those inside the blocks again for all at once.
    """
    n = -(-max(len(emission), 1) // BLOCK) * BLOCK
    e = np.exp(np.clip(np.pad(emission, (0, n - len(emission))), -30, 30)).reshape(-1, BLOCK).T.copy()
    start = np.pad(first, (0, n - len(first)), constant_values=True).reshape(-1, BLOCK).T
    t = np.exp(transition)
    to_clean = np.where(start, t[0, 0], t[1, 0])  # from toxic; after a start mark both rows are those of clean
    to_toxic = np.where(start, t[0, 1], t[1, 1]) * e
    stay, go = t[0, 0], t[0, 1] * e

    def between(order: range, rows: bool) -> np.ndarray:
        a, b, c, d = np.ones(n // BLOCK), np.zeros(n // BLOCK), np.zeros(n // BLOCK), np.ones(n // BLOCK)
        for i in order:  # (a b; c d) times the next matrix, or the next matrix times it
            m00, m01, m10, m11 = stay, go[i], to_clean[i], to_toxic[i]
            if rows:
                a, b, c, d = a * m00 + b * m10, a * m01 + b * m11, c * m00 + d * m10, c * m01 + d * m11
            else:
                a, b, c, d = m00 * a + m01 * c, m00 * b + m01 * d, m10 * a + m11 * c, m10 * b + m11 * d
            scale = 1 / (a + b + c + d)
            a, b, c, d = a * scale, b * scale, c * scale, d * scale
        ratio, out = (0.0 if rows else 1.0), []
        steps = list(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist(), strict=True))
        for a1, b1, c1, d1 in steps if rows else reversed(steps):
            out.append(ratio)
            ratio = (b1 + ratio * d1) / (a1 + ratio * c1) if rows else (c1 + d1 * ratio) / (a1 + b1 * ratio)
        return np.array(out if rows else out[::-1])

    forward, backward = np.empty_like(e), np.empty_like(e)
    ratio = between(range(BLOCK), rows=True)
    for i in range(BLOCK):
        forward[i] = ratio = (go[i] + ratio * to_toxic[i]) / (stay + ratio * to_clean[i])
    ratio = between(range(BLOCK - 1, -1, -1), rows=False)
    for i in range(BLOCK - 1, -1, -1):
        backward[i] = ratio
        ratio = (to_clean[i] + to_toxic[i] * ratio) / (stay + go[i] * ratio)
    return forward.T.ravel()[: len(emission)], backward.T.ravel()[: len(emission)]


def marginals(emission: np.ndarray, first: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Probability of each word to be toxic."""
    forward, backward = messages(emission, first, transition)
    odds = forward * backward
    return odds / (1 + odds)


def toxic_items(texts: list[list[str]], toxic: np.ndarray, params: Params) -> set[str]:
    """Words (as =word) and affixes that mark toxic texts.

    Items are taken greedily, by the number of toxic texts not yet explained times the log of their lift, and then
    those of so high a lift that they need not explain a text of their own.
    """
    tokens, rows = (Counter(), Counter()), (Counter(), Counter())
    seen: list[set[str]] = []
    for words, y in zip(texts, toxic, strict=True):
        n = Counter(i for w in words for i in (f"={w}", *affixes(w)))
        tokens[y].update(n)
        rows[y].update(n.keys())
        if y:
            seen.append(set(n))
    n1, n0 = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    lift = {i: ((tokens[1][i] + 0.5) / n1) / ((tokens[0][i] + 0.5) / n0) for i, n in rows[1].items() if n >= 3}
    worth = {i: float(np.log(x)) for i, x in lift.items() if x >= params.lift}
    left, chosen = [t & worth.keys() for t in seen], []
    while left:
        count = Counter(i for t in left for i in t)
        best = max(count, key=lambda i: (count[i] * worth[i], len(i), i), default=None)
        if best is None or count[best] < 3:
            break
        chosen.append(best)
        left = [t for t in left if best not in t]
    most = max((rows[1][i] for i in chosen), default=0)
    return set(chosen) | {i for i, x in lift.items() if x >= params.pure_lift and rows[1][i] >= params.support * most}


def document_features(p: np.ndarray, first: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Of each of n texts: 1, the log odds of its largest marginal, and the logs of their sum and of their mean. rows: the text of each word."""
    top, total, words = np.full(n, 1e-9), np.zeros(n), np.zeros(n)
    if len(p):
        at = np.flatnonzero(first)
        top[rows[at]] = np.maximum(np.maximum.reduceat(p, at), 1e-9)
        total[rows[at]] = np.add.reduceat(p, at)
        words[rows[at]] = np.diff(np.append(at, len(p)))
    top = np.minimum(top, 1 - 1e-9)
    return np.stack([np.ones(n), np.log(top / (1 - top)) / 10, np.log1p(total), np.log((total + 0.02) / (words + 20)) / 4], axis=1)


def fit(docs: DataFrame, labels: DataFrame, params: Params = Params(), key: str = "doc_id") -> Model:
    """Fits the field on the texts of `docs` (key, text) that `labels` (key, toxic 0 or 1) marks.

    Of the labelled keys, fit_rows of each label are taken in the order of a hash before they meet the texts, so what
    is broadcast and collected is bounded by the parameters. A key that has several texts counts with the first of them, one with several labels is toxic. A word of a toxic text is
    labelled toxic if toxic_items() finds it or one of its affixes. Emissions are weights of the word and its affixes; weights and transitions follow the gradient of the log likelihood (AdaGrad), from forward-backward marginals.
    """
    labels = labels.where("toxic is not null").select(key, (F.col("toxic") > 0).cast("int").alias("toxic")).groupBy(key).agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    u = F.pmod(F.xxhash64(F.lit("fit"), F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    of = lambda y: labels.where(F.col("toxic") == y).where(u <= 1.5 * params.fit_rows / max(1, sizes.get(y, 0))).orderBy(u, key).limit(params.fit_rows)
    picked = of(0).unionByName(of(1))
    rows = docs.select(key, "text").where(F.length("text") <= params.fit_chars).join(F.broadcast(picked), key)
    rows = rows.groupBy(key, "toxic").agg(F.min("text").alias("text")).toPandas()
    rows = rows.sort_values([key, "text"])
    words = [[w.lower() for w in WORD.findall(t)] for t in rows["text"]]
    toxic = rows["toxic"].to_numpy(dtype=int) if len(rows) else np.zeros(0, int)
    marked = toxic_items(words, toxic, params)

    index: dict[str, int] = {}
    token = np.array([index.setdefault(w, len(index)) for t in words for w in t], np.int64)
    names: dict[str, int] = {}
    listed = [[names.setdefault(f, len(names)) for f in (f"={w}", *affixes(w))] for w in index]
    of_word = np.repeat(np.arange(len(index)), [len(f) for f in listed])
    feature = np.array([f for fs in listed for f in fs], np.int64)
    common = np.bincount(feature, weights=np.bincount(token, minlength=len(index))[of_word], minlength=len(names)) >= 3
    lengths = np.array([len(t) for t in words], np.int64)
    first = np.zeros(len(token), bool)
    first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    of = np.repeat(np.arange(len(words)), lengths)
    known = np.array([not marked.isdisjoint((f"={w}", *affixes(w))) for w in index], bool)
    y = (known[token] & (toxic[of] == 1)).astype(float) if len(token) else np.zeros(0)
    before = np.where(first, 0.0, np.concatenate([[0.0], y[:-1]])) if len(token) else y

    weight, bias, transition = np.zeros(len(names)), -3.0, np.zeros((2, 2))
    sums = [np.full(len(names), 1.0), 1.0, np.full((2, 2), 1.0)]
    for _ in range(params.rounds if len(token) else 0):
        s = bias + np.bincount(of_word, weights=weight[feature], minlength=len(index))[token]
        forward, backward = messages(s, first, transition)
        odds = forward * backward
        p = odds / (1 + odds)
        wrong = np.bincount(token, weights=y - p, minlength=len(index))
        grad_w = common * np.bincount(feature, weights=wrong[of_word], minlength=len(names)) - params.l2 * weight
        ahead = np.where(first, 0.0, np.concatenate([[0.0], forward[:-1]]))  # odds before the word
        t, e = np.exp(transition), np.exp(np.clip(s, -30, 30)) * backward
        pair = np.stack([np.full(len(s), t[0, 0]), t[0, 1] * e, ahead * t[1, 0], ahead * t[1, 1] * e])
        pair = (pair / pair.sum(axis=0)).sum(axis=1).reshape(2, 2)
        seen = np.array([[((1 - before) * (1 - y)).sum(), ((1 - before) * y).sum()], [(before * (1 - y)).sum(), (before * y).sum()]])
        grads = [grad_w, (y - p).sum(), seen - pair]
        for total, g in zip((0, 1, 2), grads, strict=True):
            sums[total] = sums[total] + g * g
        weight = weight + params.rate * grads[0] / np.sqrt(sums[0])
        bias = bias + params.rate * grads[1] / np.sqrt(sums[1])
        transition = transition + params.rate * 0.1 * grads[2] / np.sqrt(sums[2])
    s = bias + np.bincount(of_word, weights=weight[feature], minlength=len(index))[token] if len(token) else np.zeros(0)
    x = document_features(marginals(s, first, transition), first, of, len(words))
    calibration = np.array([0.0, 1.0, 0.0, 0.0])
    # a sampled row stands for all that it was sampled from, and for the root of that where labels are unequal in number
    prior = np.sqrt(np.where(toxic == 1, sizes.get(1, 0), sizes.get(0, 0)) / max(1, sum(sizes.values()))) / np.where(toxic == 1, max(1, toxic.sum()), max(1, (1 - toxic).sum()))
    for _ in range(40 if len(rows) else 0):  # Newton's method for a logistic regression
        q = 1 / (1 + np.exp(-np.clip(x @ calibration, -30, 30)))
        h = (x * (prior * q * (1 - q))[:, None]).T @ x + 1e-5 * np.eye(4)
        calibration = calibration + np.clip(np.linalg.solve(h, x.T @ (prior * (toxic - q)) - 1e-5 * calibration), -5, 5)
    named = {f: float(weight[i]) for f, i in names.items() if abs(weight[i]) > 1e-6}
    return Model({f[1:]: w for f, w in named.items() if f[0] == "="}, {f: w for f, w in named.items() if f[0] != "="}, float(bias), transition, calibration)


def score(docs: DataFrame, model: Model, params: Params = Params(), text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` (its columns in `keep`, all by default) with score, predicted and spans, from whole texts.

    score: 0 to 1, the calibrated aggregate of the marginals of all words. predicted: 1 if score >= 0.5, else 0.
    spans: (start, end, p) of each offending word, in code points, in order. Null and empty texts, and texts without a
    word, have no spans and the score of a text in which no word is toxic. Repeated rows stay; other columns
    pass through, and columns of these three names are replaced.
    """

    def maker() -> Callable[[list[str]], dict]:
        emissions = Emissions(model)

        def judge(texts: list[str]) -> dict:
            scores, spans = np.zeros(len(texts)), [[] for _ in texts]
            for part in slices([len(t) for t in texts], SLICE_BYTES):
                words = [WORD.findall(t) for t in texts[part]]
                lengths = np.array([len(w) for w in words])
                starts = np.cumsum(lengths) - lengths
                s = np.fromiter((e for w in words for e in map(emissions.__getitem__, w)), np.float64, int(lengths.sum()))
                first = np.zeros(len(s), bool)
                first[starts[lengths > 0]] = True
                of = np.repeat(np.arange(len(words)), lengths)
                p = marginals(s, first, model.transition)
                x = document_features(p, first, of, len(words))
                scores[part] = 1 / (1 + np.exp(-np.clip(x @ model.calibration, -30, 30)))
                found: dict[int, list[int]] = {}
                for k in np.flatnonzero(p >= params.span).tolist():
                    found.setdefault(int(of[k]), []).append(k)
                for i, ks in found.items():
                    at = [m.span() for m in WORD.finditer(texts[part.start + i])]
                    spans[part.start + i] = [{"start": at[k - starts[i]][0], "end": at[k - starts[i]][1], "p": float(p[k])} for k in ks]
            return {"score": scores, "predicted": (scores >= 0.5).astype("int32"), "spans": spans}

        return judge

    return map_texts(docs, keep, "score double, predicted int, spans array<struct<start:int,end:int,p:double>>", maker, text)
