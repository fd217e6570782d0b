"""Language ID by the nearest of several TF-IDF n-gram centroids for each language."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import map_texts, slices

#: n-grams of three bytes go to this many hash slots: the width of a vector.
SLOTS = 1 << 13
UNKNOWN = "und"
#: A text with fewer distinct n-grams cannot come as near to a centroid; what is asked of it falls with their square root.
FULL = 120
SLICE_BYTES = 1 << 23


@dataclass(frozen=True)
class Params:
    centroids: int = 4  # of each language
    languages: int = 256  # most frequent values of lang that are learned
    fit_rows: int = 1500  # distinct texts of each language, at most, that centroids are clustered from
    fit_chars: int = 20_000  # characters of a text, at most, that are clustered from
    rounds: int = 12  # of clustering
    margin: float = 0.35  # a text is rejected below this part of what its language's fit rows reach (see fit())


@dataclass(frozen=True)
class Model:
    idf: np.ndarray  # by slot
    languages: list[str]
    of: np.ndarray  # language of each centroid
    centroids: np.ndarray  # normalised; centroid x slot
    least: np.ndarray  # cosine of each language below which a text is rejected


def grams(text: bytes) -> np.ndarray:
    """Slots of a text's three-byte n-grams, all over the text; letters are lower-cased, ASCII digits and punctuation are spaces."""
    raw = np.frombuffer(text.translate(FOLD), np.uint8)
    if len(raw) < 3:
        raw = np.concatenate([raw, np.full(3 - len(raw), 32, np.uint8)])
    raw = raw.astype(np.uint32)
    code = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - SLOTS.bit_length() + 1)


#: By byte: ASCII digits, punctuation and control characters become a space, A-Z a-z.
FOLD = bytes(b if b >= 128 or chr(b).isalpha() and chr(b).islower() else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))


def vectors(texts: list[bytes], idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF vectors; a term's weight is 1 + log(count)."""
    out = np.zeros((len(texts), SLOTS), np.float32)
    for row, text in zip(out, texts, strict=True):
        n = np.bincount(grams(text), minlength=SLOTS)
        at = np.flatnonzero(n)
        row[at] = (1 + np.log(n[at])) * idf[at]
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def _bytes(texts: Iterable[str]) -> list[bytes]:
    return [t.lower().encode("utf-8", "replace") for t in texts]


def document_frequency(docs: DataFrame) -> np.ndarray:
    """Of each slot, the number of texts that have it, over all rows of `docs` (text); and the number of texts, last."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SLOTS + 1, np.int64)
        for batch in batches:
            for text in _bytes(batch["text"]):
                seen = np.zeros(SLOTS, bool)
                seen[grams(text)] = True
                total[:-1] += seen
                total[-1] += 1
        yield pd.DataFrame({"slot": np.arange(SLOTS + 1), "n": total})

    found = docs.select("text").mapInPandas(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SLOTS + 1, np.int64)
    out[found["slot"]] = found["n"]
    return out


def clusters(texts: Iterable[str], idf: np.ndarray, params: Params) -> tuple[np.ndarray, float]:
    """Centroids of a language's texts by spherical k-means, and the cosine below which a text is rejected."""
    x = vectors(_bytes(texts), idf)
    c = x[np.random.default_rng(0).permutation(len(x))[: params.centroids]]
    for _ in range(params.rounds):
        best = (x @ c.T).argmax(axis=1)
        c = np.stack([x[best == j].sum(axis=0) if (best == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c, params.margin * float(np.quantile((x @ c.T).max(axis=1), 0.01))


def sample(docs: DataFrame, params: Params) -> DataFrame:
    """(lang, h, text): up to fit_rows distinct texts with a letter of each of the most frequent languages of `docs` (text, lang), by order of hash.

    Copies count once, so they crowd out nothing. Of a text of over fit_chars characters a piece of so many is taken, at a place that its hash gives.
    """
    able = docs.select("lang", "text", F.xxhash64(F.lit("fit"), "text").alias("h")).where(F.col("text").rlike(r"\p{L}"))
    sizes = able.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("texts")).orderBy(F.desc("n"), "lang").limit(params.languages).collect()
    if not sizes:
        return able.limit(0)
    # hashes up to a bound that some more than fit_rows texts pass; which of them are taken is by exact order
    share = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], min(1.0, 1.5 * params.fit_rows / max(1, r["texts"])))))
    passed = able.where(F.pmod("h", F.lit(1 << 30)) / float(1 << 30) <= share[F.col("lang")])
    from_ = F.pmod(F.shiftright("h", 30), F.greatest(F.length("text") - params.fit_chars + 1, F.lit(1))).cast("int") + 1
    piece = F.when(F.length("text") <= params.fit_chars, F.col("text")).otherwise(F.substring(F.col("text"), from_, F.lit(params.fit_chars)))
    distinct = passed.select("lang", "h", piece.alias("text")).groupBy("lang", "h").agg(F.min("text").alias("text"))
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h"))
    return distinct.withColumn("at", order).where(F.col("at") <= params.fit_rows).drop("at")


def fit(docs: DataFrame, params: Params = Params()) -> Model:
    """Fits the model on `docs` (text, lang), null languages left out.

    Document frequencies are counted over all rows. Each language's centroids come from spherical k-means, a task a
    language, on its share of sample(): a bounded number of distinct texts, so repeated rows weigh as one. A language
    rejects a text whose cosine is below `margin` times the 1 % quantile of its own sample's. Only the `languages` most
    frequent values of lang are learned, ties by code point: each has centroids that go to every task.
    """
    docs = docs.where("lang is not null and text is not null").select("text", "lang")
    df = document_frequency(docs)
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1).astype(np.float32)

    def cluster(rows: pd.DataFrame) -> pd.DataFrame:
        c, least = clusters(rows.sort_values("h")["text"], idf, params)
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "centroids": [c.astype(np.float32).tobytes()], "least": [least]})

    found = sample(docs, params).groupBy("lang").applyInPandas(cluster, "lang string, centroids binary, least double").collect()
    found = sorted(found, key=lambda r: r["lang"])
    centroids = [np.frombuffer(r["centroids"], np.float32).reshape(-1, SLOTS) for r in found]
    of = np.repeat(np.arange(len(found)), [len(c) for c in centroids])
    return Model(idf, [r["lang"] for r in found], of, np.concatenate([np.zeros((0, SLOTS), np.float32), *centroids]), np.array([r["least"] for r in found]))


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` (its columns in `keep`, all by default) with lang_pred, score and rejected, from whole texts.

    lang_pred: language of the nearest centroid, ties to the first by code point; `und` where the text is null or
    has no letter. score: the cosine to that centroid (0 to 1; 0 for `und`). rejected: `und`, or a score below what the
    language asks for. Empty texts are `und`. Without a learned language every row is `und`. Repeated rows stay;
    other columns pass through, and columns of these three names are replaced.
    """

    def maker() -> Callable[[list[str]], dict]:
        names = np.array([*model.languages, UNKNOWN], object)
        least = np.append(model.least, np.inf)

        def judge(texts: list[str]) -> dict:
            score, pred = np.zeros(len(texts)), np.full(len(texts), -1)
            raw = _bytes(texts)
            shown = np.ones(len(texts))
            for part in slices([len(t) + 4 * SLOTS for t in raw], SLICE_BYTES) if model.languages else ():
                x = vectors(raw[part], model.idf)
                shown[part] = np.minimum(1, np.sqrt(np.count_nonzero(x, axis=1) / FULL))
                cosine = x @ model.centroids.T
                best = cosine.argmax(axis=1)
                score[part], pred[part] = np.clip(cosine[np.arange(len(best)), best], 0, 1), model.of[best]
            known = np.array([any(map(str.isalpha, t)) for t in texts], bool)
            score[~known], pred[~known] = 0, -1
            return {"lang_pred": names[pred], "score": score, "rejected": score < least[pred] * shown}

        return judge

    return map_texts(docs, keep, "lang_pred string, score double, rejected boolean", maker, text)
