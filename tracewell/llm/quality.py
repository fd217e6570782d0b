"""Document quality by random-indexing word vectors, pooled, and a two-layer network with calibrated probabilities."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import map_texts

#: Words are hashed to this many slots, each with a vector of DIMS; an index vector has NONZERO entries of 1 or -1.
SLOTS, DIMS, NONZERO, WINDOW = 1 << 14, 64, 4, 2
#: Slots that are marks: the word before is in capitals; it repeats the word before it. Words have the other slots.
CAPITALS, AGAIN, MARKS = 0, 1, 2
#: Bytes of text that are read at once. A longer text is read in pieces of so many; neighbours do not reach over their ends.
PIECE = 1 << 20
#: By byte: 0 white space, 1 letter (all of other alphabets), 2 digit, 3 other.
KIND = np.array([1 if b >= 128 or chr(b).isalpha() else 2 if chr(b).isdigit() else 0 if b in (9, 10, 11, 12, 13, 32) else 3 for b in range(256)], np.uint8)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64)
BASE, SPREAD = 0x100000001B3, 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Params:
    fit_rows: int = 3000  # labelled rows of each label, at most, that the network is fitted on
    hidden: int = 24
    rounds: int = 400
    rate: float = 0.01
    l2: float = 1e-3
    held: float = 0.25  # of the fit rows, that only set the temperature


@dataclass(frozen=True)
class Model:
    vectors: np.ndarray  # slot x dimension, of length 1 (or 0 for a slot without words)
    shift: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, float]
    temperature: float

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        logit = _logits(self.layers, (pooled - self.shift) / self.scale) / self.temperature
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64."""
    both = (np.uint64(BASE), np.uint64(pow(BASE, -1, 1 << 64)))
    return tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(2 * PIECE + 1, b, np.uint64)])) for b in both)  # type: ignore[return-value]


@lru_cache(1)
def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(dimensions, signs) of each slot's index vector."""
    rng = np.random.default_rng(11)
    return rng.random((SLOTS, DIMS)).argpartition(NONZERO, axis=1)[:, :NONZERO], rng.choice([-1.0, 1.0], (SLOTS, NONZERO))


def pieces(texts: Sequence[str]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """(bytes, starts, owners): texts in UTF-8, in batches of about PIECE bytes; where each piece starts and whose it is. Long texts are cut behind white space where there is some."""
    held, starts, owners, size = [], [], [], 0
    for owner, text in enumerate(texts):
        raw, at = text.encode("utf-8", "replace"), 0
        while at < len(raw):
            stop = min(len(raw), at + PIECE)
            if stop < len(raw):
                stop = max(raw.rfind(b" ", at, stop), raw.rfind(b"\n", at, stop)) + 1 or stop
            if held and size + stop - at > PIECE:
                yield b"".join(held), np.array(starts), np.array(owners)
                held, starts, owners, size = [], [], [], 0
            starts.append(size)
            owners.append(owner)
            held += [raw[at:stop], b"\n"]
            size, at = size + stop - at + 1, stop
    if held:
        yield b"".join(held), np.array(starts), np.array(owners)


def words(data: bytes, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pieces, slots) of the words, in order, of pieces of text that start at the places given: runs of letters without regard to A-Z or a-z, of digits, and of other characters; marks follow their word."""
    raw = np.frombuffer(data, np.uint8)
    kind = KIND[raw]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(kind)) + 1, [len(raw)]])
    start, end = edges[:-1], edges[1:]
    shown = kind[start] > 0 if len(raw) else np.zeros(0, bool)
    start, end = start[shown], end[shown]
    power, inverse = _powers()
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((LOWER[raw] + np.uint64(1)) * power[: len(raw)], dtype=np.uint64)])
    hashed = (sums[end] - sums[start]) * inverse[start] * np.uint64(SPREAD)
    hashed = (hashed ^ (hashed >> np.uint64(29))) * np.uint64(SPREAD)
    slot = (MARKS + (hashed >> np.uint64(32)) % np.uint64(SLOTS - MARKS)).astype(np.int64)
    large = np.concatenate([[0], np.cumsum((raw >= 65) & (raw <= 90))])
    small = np.concatenate([[0], np.cumsum((raw >= 97) & (raw <= 122))])
    capitals = (large[end] - large[start] >= 2) & (small[end] == small[start])
    letters = np.flatnonzero(kind[start] == 1) if len(start) else np.zeros(0, np.int64)
    piece = np.searchsorted(pieces, start, side="right") - 1
    again = letters[1:][(slot[letters[1:]] == slot[letters[:-1]]) & (piece[letters[1:]] == piece[letters[:-1]])]
    at = np.concatenate([np.flatnonzero(capitals) + 1, again + 1])
    mark = np.concatenate([np.full(int(capitals.sum()), CAPITALS), np.full(len(again), AGAIN)])
    return np.insert(piece, at, piece[at - 1]), np.insert(slot, at, mark)


def _contexts(texts: Sequence[str]) -> np.ndarray:
    """Of each slot, the sum of the index vectors of its words' neighbours, two to either side; slot x dimension, flat."""
    dims, signs = index_vectors()
    total = np.zeros(SLOTS * DIMS)
    for data, starts, _ in pieces(texts):
        piece, slot = words(data, starts)
        pairs = [(slot[step:][same], slot[:-step][same]) for step in range(1, WINDOW + 1) for same in [piece[step:] == piece[:-step]]]
        word = np.concatenate([x for a, b in pairs for x in (a, b)])
        beside = np.concatenate([x for a, b in pairs for x in (b, a)])
        total += np.bincount((word[:, None] * DIMS + dims[beside]).ravel(), weights=signs[beside].ravel(), minlength=SLOTS * DIMS)
    return total


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Word vectors (slot x dimension) from all whole texts of docs.

    The sums are whole numbers, so they do not depend on how the rows are dealt. What each task sends and what the driver gets is bounded by the size of the table, not by the rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS * DIMS)
        for batch in batches:
            total += _contexts([t for t in batch.column(0).to_pylist() if t])
        table = total.astype(np.int64).reshape(SLOTS, DIMS)
        used = np.flatnonzero(table.any(axis=1))
        for s in range(0, len(used), 1024):
            part = used[s : s + 1024]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array([table[i].tobytes() for i in part], pa.binary())], ["slot", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[slot] = total.get(slot, 0) + np.frombuffer(sums, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["slot", "sums"])

    schema = "slot int, sums binary"
    rows = docs.select(text).mapInArrow(count, schema).repartition("slot").mapInArrow(add, schema).collect()
    out = np.zeros((SLOTS, DIMS))
    for r in rows:
        out[r["slot"]] = np.frombuffer(r["sums"], np.int64)
    out[:MARKS] = 0  # a mark's vector is its own index vector: what stands beside it says little
    dims, signs = index_vectors()
    for mark in range(MARKS):
        out[mark, dims[mark]] = signs[mark]
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
    return out.astype(np.float32)


def pool(texts: Sequence[str], vectors: np.ndarray) -> np.ndarray:
    """Of each text the mean vector of its words (0 if it has none), and the share of marks of each kind."""
    total, n = np.zeros((len(texts), DIMS + MARKS)), np.zeros(len(texts))
    for data, starts, owners in pieces(texts):
        piece, slot = words(data, starts)
        if not len(slot):
            continue
        first = np.flatnonzero(np.diff(piece, prepend=-1))
        owner = owners[piece[first]]
        np.add.at(total[:, :DIMS], owner, np.add.reduceat(vectors[slot], first, axis=0))
        for mark in range(MARKS):
            np.add.at(total[:, DIMS + mark], owner, np.add.reduceat((slot == mark).astype(float), first))
        np.add.at(n, owner, np.add.reduceat((slot >= MARKS).astype(float), first))
    return total / np.maximum(n, 1)[:, None]


def _logits(layers: tuple, x: np.ndarray) -> np.ndarray:
    w1, b1, w2, b2 = layers
    return np.tanh(x @ w1 + b1) @ w2 + b2


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, params: Params) -> tuple:
    """A layer of tanh units and a logistic one, by Adam on the weighted log loss of all rows at once."""
    rng = np.random.default_rng(0)
    values = [rng.normal(0, 1 / np.sqrt(max(1, x.shape[1])), (x.shape[1], params.hidden)), np.zeros(params.hidden), rng.normal(0, 1 / np.sqrt(params.hidden), params.hidden), np.zeros(1)]
    moment, square = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for t in range(1, params.rounds + 1 if len(x) else 1):
        inner = np.tanh(x @ values[0] + values[1])
        out = (1 / (1 + np.exp(-np.clip(inner @ values[2] + values[3][0], -30, 30))) - y) * weight
        back = np.outer(out, values[2]) * (1 - inner * inner)
        grads = [x.T @ back + params.l2 * values[0], back.sum(axis=0), inner.T @ out + params.l2 * values[2], np.array([out.sum()])]
        for i, g in enumerate(grads):
            moment[i] = 0.9 * moment[i] + 0.1 * g
            square[i] = 0.999 * square[i] + 0.001 * g * g
            values[i] = values[i] - params.rate * (moment[i] / (1 - 0.9**t)) / (np.sqrt(square[i] / (1 - 0.999**t)) + 1e-8)
    return values[0], values[1], values[2], float(values[3][0])


def temperature(logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """What logits are divided by, from 1/4 to 16, for the least log loss of these rows."""
    if not len(logit):
        return 1.0
    tried = np.exp2(np.linspace(-2, 4, 121))
    loss = [(weight * np.logaddexp(0, np.where(y == 1, -1, 1) * logit / t)).sum() for t in tried]
    return float(tried[int(np.argmin(loss))])


def fit(docs: DataFrame, labels: DataFrame, params: Params = Params(), key: str = "doc_id") -> Model:
    """Fits the model: word vectors from all texts of `docs` (key, text), the network from those that `labels` (key, quality 0 or 1) marks.

    Of each label fit_rows keys are taken, in the order of a hash, before they meet the texts, so what is broadcast and collected is bounded. Each
    stands for as many as it was taken from. A key with several labels is of low quality; one with several texts counts with each of them, repeated texts once. A quarter
    of the rows sets the temperature. Null labels are left out; without labels every score is 1/2.
    """
    vectors = word_vectors(docs)
    labels = labels.where("quality is not null").select(key, (F.col("quality") > 0).cast("int").alias("quality")).groupBy(key).agg(F.min("quality").alias("quality"))
    sizes = {r["quality"]: r["count"] for r in labels.groupBy("quality").count().collect()}
    u = F.pmod(F.xxhash64(F.lit("quality"), F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    of = lambda y: labels.where((F.col("quality") == y) & (u <= 1.5 * params.fit_rows / max(1, sizes.get(y, 0)))).orderBy(u, key).limit(params.fit_rows)
    texts = docs.select(key, "text").join(F.broadcast(of(0).unionByName(of(1))), key)
    made = map_texts(texts, [key, "quality"], "pooled array<double>", lambda: lambda t: {"pooled": list(pool(t, vectors))}).distinct().toPandas()
    made = made.sort_values([key, "pooled"], key=lambda c: c.map(tuple) if c.name == "pooled" else c)
    x = np.stack(made["pooled"].to_list()) if len(made) else np.zeros((0, DIMS + MARKS))
    y = made["quality"].to_numpy(float)
    weight = np.where(y == 1, sizes.get(1, 0) / max(1, (y == 1).sum()), sizes.get(0, 0) / max(1, (y == 0).sum()))
    weight = weight / max(1e-12, weight.sum())
    shift, scale = (x.mean(axis=0), x.std(axis=0) + 1e-4) if len(x) else (np.zeros(DIMS + MARKS), np.ones(DIMS + MARKS))
    x = (x - shift) / scale
    held = np.random.default_rng(1).random(len(x)) < params.held
    layers = train(x[~held], y[~held], weight[~held] / max(1e-12, weight[~held].sum()), params) if len(x) else (np.zeros((DIMS + MARKS, 1)), np.zeros(1), np.zeros(1), 0.0)
    return Model(vectors, shift, scale, layers, temperature(_logits(layers, x[held]), y[held], weight[held]))


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, threshold: float = 0.7) -> DataFrame:
    """`docs` (its columns in `keep`, all by default) with score and predicted, from whole texts.

    score: the probability of high quality, 0 to 1. predicted: 1 if score >= threshold, else 0. Null and empty texts, and those without a word, pool to 0 and have
    the score of that. Repeated rows stay; other columns pass through, and columns of these two names are replaced.
    """

    def maker() -> Callable[[list[str]], dict]:
        def judge(texts: list[str]) -> dict:
            p = model.probability(pool(texts, model.vectors))
            return {"score": p, "predicted": (p >= threshold).astype("int32")}

        return judge

    return map_texts(docs, keep, "score double, predicted int", maker, text)
