"""Document fingerprints by content-defined chunking, and how much of one text another holds."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import map_texts, slices

#: Bytes of a chunk: at least, where boundaries become likelier, at most.
LEAST, NORMAL, MOST = 32, 64, 256
#: A boundary has this many zero bits at the top of its hash before NORMAL bytes, and after.
STRICT_BITS, LOOSE_BITS = 7, 5
#: Random value of each byte, by a fixed rule.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 7) for b in range(256)], np.uint32)
DIGEST_DIGITS, LENGTH_DIGITS = 16, 3
SLICE_BYTES = 1 << 21
#: Rows of a bucket, and buckets at most: beyond that, buckets grow. They are sorted and read as streams, so their size is of no account to memory.
ROWS_PER_BUCKET, MOST_BUCKETS = 512, 100_000


def gear_hash(raw: np.ndarray) -> np.ndarray:
    """At each byte, the sum of the values of the last 32 bytes, each shifted by its distance; by doubling."""
    h = GEAR[raw]
    for step in (1, 2, 4, 8, 16):
        h[step:] += h[:-step] << np.uint32(step)
    return h


def chunks(texts: Sequence[bytes]) -> Iterator[list[tuple[int, int]]]:
    """Of each text, its chunks (start, end). A boundary depends on the 32 bytes before it, and no chunk is shorter but the last."""
    h = gear_hash(np.frombuffer(b"".join(texts), np.uint8)) if any(texts) else np.zeros(0, np.uint32)
    loose = np.flatnonzero(h < 1 << (32 - LOOSE_BITS)) + 1
    strict = loose[h[loose - 1] < 1 << (32 - STRICT_BITS)].tolist()
    loose = loose.tolist()
    at = s = k = 0
    for text in texts:
        end, found = at + len(text), []
        while at < end:
            s = bisect_left(strict, at + LEAST, s)
            cut = strict[s] if s < len(strict) else end
            if cut >= at + NORMAL:
                k = bisect_left(loose, at + NORMAL, k)
                cut = min(loose[k] if k < len(loose) else end, at + MOST)
            cut = min(cut, end)
            found.append((at, cut))
            at = cut
        yield found


def fingerprints(texts: Sequence[bytes]) -> list[dict[str, int]]:
    """Of each text, the bytes of its distinct chunks by digest."""
    found = []
    for part in slices([len(t) for t in texts], SLICE_BYTES):
        own, joined = texts[part], b"".join(texts[part])
        digest = xxhash.xxh3_64_hexdigest
        found += [{digest(joined[a:b]): b - a for a, b in pieces} for pieces in chunks(own)]
    return found


def shown(print_: dict[str, int]) -> str:
    """A fingerprint as text: digest and length of each distinct chunk in hex digits, by digest."""
    return "".join([f"{d}{n:0{LENGTH_DIGITS}x}" for d, n in sorted(print_.items())])


def contained(a: dict[str, int], b: dict[str, int]) -> float:
    """The part of a's bytes that are in chunks of b too; between empty fingerprints 1, of an empty one in another 0."""
    if not a:
        return float(not b)
    return sum(n for d, n in a.items() if d in b) / sum(a.values())


def with_fingerprint(docs: DataFrame, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """docs with `fingerprint` of the whole text (see shown()). Null and empty texts have an empty one; equal texts have equal ones."""

    def maker() -> Callable[[list[str]], dict]:
        return lambda texts: {"fingerprint": [shown(f) for f in fingerprints([t.encode("utf-8", "replace") for t in texts])]}

    return map_texts(docs, keep, "fingerprint string", maker, text)


def containment(a: Column, b: Column) -> Column:
    """contained() of two fingerprint columns, by DataFrame functions."""
    width = DIGEST_DIGITS + LENGTH_DIGITS
    cut = lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), (F.length(x) / width).cast("int") - 1), lambda i: F.substring(x, (i * width + 1).cast("int"), F.lit(width))))
    weight = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda n, c: n + F.conv(F.right(c, F.lit(LENGTH_DIGITS)), 16, 10).cast("long"))
    return F.when(a == "", (b == "").cast("double")).otherwise(weight(F.array_intersect(cut(a), cut(b))) / weight(cut(a)))


def in_order(docs: DataFrame, key: str) -> tuple[DataFrame, int]:
    """docs (key, text) dealt to buckets of neighbouring keys, sorted, each followed by the first row of the next one.

    Adds `own`, false for that copy of a row. Bucket boundaries are keys of a sample (some 20 for each of MOST_BUCKETS buckets at most), which bears on the
    balance of buckets only. The last bucket is followed by the very first row. Rows are in the order of key, nulls first, then text.
    """
    order = F.coalesce(F.col(key), F.lit(-(1 << 63)))
    n, first = docs.agg(F.count("*"), F.min(order)).first()
    buckets = max(1, min(n // ROWS_PER_BUCKET, MOST_BUCKETS))
    sample = docs.select(order.alias("k")).sample(min(1.0, 20 * buckets / max(1, n)), seed=1).toPandas()["k"].to_numpy(np.int64)
    sample = np.sort(sample)
    bounds = np.unique(sample[np.linspace(0, len(sample), buckets, endpoint=False).astype(int)[1:]]) if len(sample) else sample
    bounds = bounds[bounds > first] if n else bounds

    @F.pandas_udf("long")
    def place(keys: pd.Series) -> pd.Series:
        at = np.searchsorted(bounds, keys.to_numpy(np.int64), side="right")
        starts = (at > 0) & (bounds[np.maximum(at, 1) - 1] == keys) if len(bounds) else np.zeros(len(at), bool)
        return pd.Series(2 * at + starts)

    placed = docs.select(key, "text", order.alias("_order"), place(order).alias("_place"))
    bucket = F.shiftright("_place", 1)
    to = lambda b, own, wrap: F.struct(b.cast("int").alias("bucket"), F.lit(own).alias("own"), F.lit(wrap).alias("wrap"))
    targets = F.array(to(bucket, True, False), F.when(F.col("_place") % 2 == 1, to(bucket - 1, False, False)), F.when(F.col("_order") == F.lit(first), to(F.lit(len(bounds)), False, True)))
    dealt = placed.select(key, "text", "_order", F.inline(F.filter(targets, lambda t: t.isNotNull())))
    dealt = dealt.repartitionById(len(bounds) + 1, "bucket").sortWithinPartitions("wrap", "_order", "text")
    return dealt.select(key, "text", "own"), len(bounds) + 1


def edits(docs: DataFrame, key: str = "doc_id", part: int = 4) -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row of `docs` (key, text); key is a whole number.

    The edited text drops a row's last floor(n_chars / part) code points and adds as many of the first ones of the next text
    (all of them, if fewer); the next row is by key, nulls first, ties by text, and after the last comes the first. near_*:
    contained() of the row's fingerprint in that of its edited text, and of the next text. Null texts count as empty.
    Repeated rows stay, each followed by the next. An empty table gives no rows. Further columns are not used.
    """
    names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    docs = docs.select(key, "text")
    dealt, _ = in_order(docs, key)
    schema = docs.select(key, F.lit(0).cast("long").alias(names[0]), *(F.lit("").alias(c) for c in names[1:4]), *(F.lit(0.0).alias(c) for c in names[4:])).schema
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        held: list[tuple] = []  # the last own row so far
        for batch in batches:
            keys = batch.column(key).to_pylist()
            rows = [*held, *zip(keys, [t or "" for t in batch.column("text").to_pylist()], batch.column("own").to_pylist(), strict=True)]
            for piece in slices([len(r[1]) for r in rows], SLICE_BYTES):
                stop = min(piece.stop + 1, len(rows))
                pairs = [(a, b[1]) for a, b in zip(rows[piece.start : stop - 1], rows[piece.start + 1 : stop], strict=True) if a[2]]
                edited = [(a[1][: len(a[1]) - len(a[1]) // part] + b[: len(a[1]) // part]).encode("utf-8", "replace") for a, b in pairs]
                prints = fingerprints([t.encode("utf-8", "replace") for _, t, _ in rows[piece.start : stop]])
                nexts = [(prints[i], prints[i + 1]) for i in range(stop - piece.start - 1) if rows[piece.start + i][2]]
                after = fingerprints(edited)
                made = [
                    [len(a[1]) for a, _ in pairs], [hashlib.sha256(e).hexdigest() for e in edited], [shown(x) for x, _ in nexts], [shown(x) for x in after],
                    [contained(x, e) for (x, _), e in zip(nexts, after, strict=True)], [contained(x, y) for x, y in nexts],
                ]
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array([a[0] for a, _ in pairs], batch.schema.field(key).type), *(pa.array(m, t) for m, t in zip(made, types, strict=True))], [key, *names])
            held = rows[-1:]

    return dealt.mapInArrow(run, schema)
